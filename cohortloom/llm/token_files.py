"""Token-id files: fixed-size id blocks transposed into planes, each plane compressed, with a chunk index.

The file format is a Parquet folder that Spark writes and reads, so it works on any store and a lost task is simply
written again:

* ``chunks``: one row per block of ``block_ids`` ids (the last of a shard is shorter): ``shard``, ``chunk``, ``first``
  (ids of the shard before it), ``n_ids``, ``planes`` (zstandard frames, one per bit or byte of an id), ``plane_bytes``
  and ``pieces``, the documents that lie in it.
* ``index``: ``shard``, ``chunk``, ``start`` (ids of all shards before it), ``n_ids``, ``plane_bytes``.

Shards follow each other in ascending document id, so the ids of all shards in order are the ids of all documents.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortloom.llm import vocab
from cohortloom.llm.common import id_and_text

_PIECE = "struct<row: long, doc_id: long, at: long, n_tokens: long, from: long, n: int>"
CHUNK_SCHEMA = (
    "shard int, chunk int, first long, n_ids int, planes array<binary>, plane_bytes array<int>, bits boolean, "
    f"pieces array<{_PIECE}>"
)
_ARROW_PIECE = pa.struct([
    ("row", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("from", pa.int64()),
    ("n", pa.int32()),
])


def to_planes(ids: np.ndarray, bits: bool, level: int = 3) -> list[bytes]:
    """The compressed bit or byte planes of unsigned 32-bit ids, lowest first."""
    table = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if bits:
        table = np.unpackbits(table, axis=1, bitorder="little")
        rows = [np.packbits(table[:, k], bitorder="little") for k in range(32)]
    else:
        rows = [np.ascontiguousarray(table[:, k]) for k in range(4)]
    compressor = zstandard.ZstdCompressor(level=level)
    return [compressor.compress(row.tobytes()) for row in rows]


def from_planes(planes: list[bytes], n_ids: int, bits: bool) -> np.ndarray:
    """The ids behind ``to_planes``."""
    raw = zstandard.ZstdDecompressor()
    rows = [np.frombuffer(raw.decompress(p), np.uint8) for p in planes]
    if bits:
        table = np.stack([np.unpackbits(r, count=n_ids, bitorder="little") for r in rows], axis=1)
        table = np.packbits(table, axis=1, bitorder="little")
    else:
        table = np.stack(rows, axis=1)
    return np.ascontiguousarray(table).view("<u4").ravel()


class _Shard:
    """Cuts the ids of one shard into blocks as they come."""

    def __init__(self, number: int, block_ids: int, bits: bool, level: int):
        self.number, self.block_ids, self.bits, self.level = number, block_ids, bits, level
        self.parts, self.held, self.chunk, self.first, self.row, self.total = [], 0, 0, 0, 0, 0
        self.pieces: list[list] = [[] for _ in _ARROW_PIECE]

    def add(self, doc_id: int | None, ids: bytes):
        """Yields the blocks that become full, each as a batch of one row."""
        n, done = len(ids) // 4, 0
        at, self.total = self.total, self.total + n
        while done < n:
            take = min(n - done, self.block_ids - self.held)
            self.parts.append(ids[4 * done : 4 * (done + take)])
            for values, value in zip(self.pieces, (self.row, doc_id, at, n, done, take), strict=True):
                values.append(value)
            self.held, done = self.held + take, done + take
            if self.held == self.block_ids:
                yield self.block()
        self.row += 1

    def block(self) -> pa.RecordBatch:
        planes = to_planes(np.frombuffer(b"".join(self.parts), "<u4"), self.bits, self.level)
        columns = [pa.array(v, f.type) for v, f in zip(self.pieces, _ARROW_PIECE, strict=True)]
        pieces = pa.StructArray.from_arrays(columns, fields=list(_ARROW_PIECE))
        row = [
            [self.number], [self.chunk], [self.first], [self.held], [planes], [[len(p) for p in planes]], [self.bits],
            pa.ListArray.from_arrays(pa.array([0, len(pieces)], pa.int32()), pieces),
        ]
        out = pa.RecordBatch.from_arrays([pa.array(v, f.type) if isinstance(v, list) else v for v, f in zip(row, _ARROW_CHUNK, strict=True)], schema=_ARROW_CHUNK)
        self.first, self.chunk = self.first + self.held, self.chunk + 1
        self.parts, self.held, self.pieces = [], 0, [[] for _ in _ARROW_PIECE]
        return out


_ARROW_CHUNK = pa.schema([
    ("shard", pa.int32()), ("chunk", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int32()),
    ("planes", pa.list_(pa.binary())), ("plane_bytes", pa.list_(pa.int32())), ("bits", pa.bool_()),
    ("pieces", pa.list_(_ARROW_PIECE)),
])


def write_token_files(
    docs: DataFrame, path: str, folder: str, end_id: int = 0, block_ids: int = 1 << 16, bits: bool = False,
    level: int = 3, id_col: str = "doc_id", text_col: str = "text",
) -> None:
    """Encode every whole text, close it with ``end_id`` and write the ids to ``folder`` in ascending ``doc_id`` order.

    Null ids come first; rows with the same id follow the hash of their text. Null and empty texts are one end id.
    Other columns are left out. An empty table writes an empty folder of both parts.
    """
    spark, end = docs.sparkSession, vocab.pack([end_id])

    def encode(batches):
        shard = _Shard(TaskContext.get().partitionId(), block_ids, bits, level)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                yield from shard.add(doc_id, vocab.encode_packed(path, text) + end)
        if shard.held:
            yield shard.block()

    order = ["doc_id", F.xxhash64("text")]
    texts = id_and_text(docs, id_col, text_col).repartitionByRange(*order).sortWithinPartitions(*order)
    texts.mapInArrow(encode, CHUNK_SCHEMA).write.mode("errorifexists").option("compression", "uncompressed").parquet(f"{folder}/chunks")
    chunks = spark.read.schema(CHUNK_SCHEMA).parquet(f"{folder}/chunks").select("shard", "chunk", "first", "n_ids", "plane_bytes")
    bases = shard_starts(chunks)
    chunks.join(bases, "shard").select(
        "shard", "chunk", (F.col("base") + F.col("first")).alias("start"), "n_ids", "plane_bytes"
    ).write.parquet(f"{folder}/index")


def shard_starts(chunks: DataFrame, width: int = 1024) -> DataFrame:
    """``shard`` and ``base``, the ids of all shards before it: sums by ``width`` shards, then inside each such run."""
    shards = chunks.groupBy("shard").agg(F.sum("n_ids").alias("n")).withColumn("run", F.expr(f"shard div {width}"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    runs = shards.groupBy("run").agg(F.sum("n").alias("m"))
    runs = runs.select("run", F.coalesce(F.sum("m").over(before(Window.orderBy("run"))), F.lit(0)).alias("run_base"))
    inside = F.coalesce(F.sum("n").over(before(Window.partitionBy("run").orderBy("shard"))), F.lit(0))
    return shards.withColumn("inside", inside).join(runs, "run").select(
        "shard", (F.col("run_base") + F.col("inside")).alias("base")
    )


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document, from the files: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens`` and
    ``ids_crc32``. Blocks are decompressed where they are read; only the ends of documents that lie across two blocks
    travel, to be joined."""
    schema = "shard int, row long, doc_id long, at long, n_tokens long, from long, crc long, part binary"
    names = ["shard", "row", "doc_id", "at", "n_tokens", "from", "crc", "part"]

    def decode(batches):
        for batch in batches:
            lists = batch.column("pieces")
            for k in range(batch.num_rows):
                chunk = {f: batch.column(f)[k].as_py() for f in ("shard", "n_ids", "planes", "bits")}
                raw = memoryview(from_planes(chunk["planes"], chunk["n_ids"], chunk["bits"]).tobytes())
                pieces = lists[k].values
                n, tokens = (pieces.field(f).to_numpy() for f in ("n", "n_tokens"))
                ends = 4 * np.cumsum(n, dtype=np.int64)
                bounds = zip((ends - 4 * n.astype(np.int64)).tolist(), ends.tolist(), (n == tokens).tolist(), strict=True)
                crcs, parts = [], []
                for start, end, whole in bounds:
                    crcs.append(zlib.crc32(raw[start:end]) if whole else None)
                    parts.append(None if whole else bytes(raw[start:end]))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(pieces), chunk["shard"], np.int32)),
                    *[pieces.field(f) for f in ("row", "doc_id", "at", "n_tokens", "from")],
                    pa.array(crcs, pa.int64()), pa.array(parts, pa.binary()),
                ], names)

    chunks = spark.read.schema(CHUNK_SCHEMA).parquet(f"{folder}/chunks")
    pieces = chunks.select("shard", "n_ids", "planes", "bits", "pieces").mapInArrow(decode, schema)
    parts = F.sort_array(F.collect_list(F.when(F.col("part").isNotNull(), F.struct("from", "part"))))
    docs = pieces.groupBy("shard", "row", "doc_id", "at", "n_tokens").agg(F.max("crc").alias("crc"), parts.alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda have, x: F.concat(have, x["part"]))
    index = spark.read.schema("shard int, chunk int, start long").parquet(f"{folder}/index")
    bases = index.where("chunk = 0").select("shard", F.col("start").alias("base"))
    return docs.join(bases, "shard").select(
        "doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens",
        F.coalesce("crc", F.crc32(joined)).alias("ids_crc32"),
    )
