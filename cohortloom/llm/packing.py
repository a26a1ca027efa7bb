"""Packing by power-of-two decomposition: pieces of binary length, bucketed by length, one document per sequence.

A document of n ids gives n // longest pieces of the longest length and one piece for each binary digit of the rest,
longest first. Every piece is a sequence of its own, so no sequence crosses documents and none needs padding; a batch
draws sequences of one length. All of it is map side: nothing is shuffled.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from cohortloom.llm import vocab
from cohortloom.llm.common import id_and_text, releasing

#: Texts whose pieces a worker holds at once.
_SLICE_ROWS = 512
#: Bits of a sequence id below the length's exponent: the task's number and the piece's number in the task.
_TASK_BITS, _PIECE_BITS = 26, 32


def piece_lengths(n: int, longest: int) -> list[int]:
    """Lengths of the pieces of ``n`` ids: multiples of ``longest`` (a power of two), then the rest's binary digits."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in range(longest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack_documents(
    docs: DataFrame, path: str, longest: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text",
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece: ``doc_id``, ``start`` (ids of the document before it), ``length``, ``ids_crc32``,
    ``doc_tokens``, ``sequence_id``, ``offset`` (always 0), ``bucket`` (exponent of the length) and, with ``with_ids``,
    ``ids`` (little-endian unsigned 32-bit integers).

    Each text is encoded whole and closed by ``end_id``, so null and empty texts give one piece of one id. Sequence ids
    sort by bucket, so equal lengths lie together; they are unique over the result and come from the order of rows in
    the input's partitions. Repeated rows and ids are packed each on its own.
    """
    if longest & (longest - 1) or longest < 1:
        raise ValueError("longest must be a power of two")
    fields = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket"]
    schema = ", ".join(f"{f} long" for f in fields) + ", ids binary" * with_ids
    end = vocab.pack([end_id])

    def run(batches):
        task = TaskContext.get().partitionId()
        if task >> _TASK_BITS:
            raise ValueError("too many partitions for sequence ids")
        seen = [0] * (longest.bit_length() + 1)
        for batch in (b.slice(at, _SLICE_ROWS) for b in batches for at in range(0, b.num_rows, _SLICE_ROWS)):
            out, pieces = {f: [] for f in fields}, []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids, start = vocab.encode_packed(path, text) + end, 0
                for length in piece_lengths(len(ids) // 4, longest):
                    bucket, piece = length.bit_length() - 1, ids[4 * start : 4 * (start + length)]
                    number = (bucket << _TASK_BITS | task) << _PIECE_BITS | seen[bucket]
                    seen[bucket] += 1
                    row = (doc, start, length, zlib.crc32(piece), len(ids) // 4, number, 0, bucket)
                    for f, v in zip(fields, row, strict=True):
                        out[f].append(v)
                    if with_ids:
                        pieces.append(piece)
                    start += length
            columns = [pa.array(out[f], pa.int64()) for f in fields] + [pa.array(pieces, pa.binary())] * with_ids
            yield pa.RecordBatch.from_arrays(columns, fields + ["ids"] * with_ids)

    return id_and_text(docs, id_col, text_col).mapInArrow(lambda batches: releasing(run(batches)), schema)


def unpack_piece(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, "<u4")
