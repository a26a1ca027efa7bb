"""Byte-level BPE encoding with offsets, and decoding, by the tokenizers library over Arrow batches.

A rank file becomes a tokenizer of the library: bytes are mapped to the byte-level alphabet, and every way of joining
two known byte strings into a ranked one becomes a merge of that rank. A text is cut by the pattern first; a match that
is itself ranked is one token.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cohortloom.llm import vocab
from cohortloom.llm.common import id_and_text


@lru_cache(maxsize=2)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def tokenizer_of_ranks(path: str, pattern: str):
    """A tokenizer whose ids are the ranks."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks = read_ranks(path)
    character = vocab.byte_characters()
    shown = {token: "".join(map(character.__getitem__, token)) for token in ranks}
    merges = []
    for token in sorted(ranks, key=ranks.__getitem__):
        for cut in range(1, len(token)):
            left, right = token[:cut], token[cut:]
            if left in ranks and right in ranks:
                merges.append((shown[left], shown[right]))
    model = models.BPE(vocab={shown[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True)
    tokenizer = Tokenizer(model)
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(pattern), "isolated"),
        pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
    ])
    return tokenizer


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str) -> vocab.ChunkEncoder:
    return vocab.ChunkEncoder(tokenizer_of_ranks(path, pattern), False, vocab.pack)


@lru_cache(maxsize=2)
def _byte_table(path: str) -> list[bytes | None]:
    ranks = read_ranks(path)
    table: list[bytes | None] = [None] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return table


def encode(path: str, pattern: str, text: str) -> np.ndarray:
    return np.frombuffer(b"".join(_encoder(path, pattern).values(text)), "<u4")


def decode_bytes(path: str, ids: np.ndarray) -> bytes:
    """The bytes behind the ids; an id without a token raises."""
    return b"".join(map(_byte_table(path).__getitem__, ids.tolist()))


def decode_pieces(path: str, ids: np.ndarray) -> list[str]:
    """The text that each id completes. A character split over several ids belongs to the last of them; bytes that end
    in the middle of a character give a replacement character."""
    table, decoder = _byte_table(path), codecs.getincrementaldecoder("utf-8")("replace")
    pieces = [decoder.decode(table[i]) for i in ids.tolist()]
    if rest := decoder.decode(b"", final=True):
        pieces[-1] += rest
    return pieces


def character_offsets(path: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last-plus-one character that each id touches: ids that share a split character overlap in it."""
    table = _byte_table(path)
    lengths = np.fromiter((len(table[i]) for i in ids.tolist()), np.int64, len(ids))
    raw = np.frombuffer(decode_bytes(path, ids), np.uint8)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    upto = np.cumsum((raw & 0xC0) != 0x80)  # characters begun in the first n + 1 bytes
    return upto[starts] - 1, upto[ends - 1]


def encode_documents(
    docs: DataFrame, path: str, pattern: str, offsets: bool = True, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id``, ``ids`` (array of int) and, with ``offsets``, ``starts`` and ``ends`` in characters.

    Null and empty texts have no ids. Repeated rows and null ids are kept; other columns are left out.
    """
    schema = "doc_id long, ids array<int>" + ", starts array<int>, ends array<int>" * offsets

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # ids of a few texts at a time
                part = batch.slice(at, 256)
                ids = [encode(path, pattern, t) for t in part.column("text").to_pylist()]
                rows = [part.column("doc_id"), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))]
                if offsets:
                    spans = [character_offsets(path, x) if len(x) else (x, x) for x in ids]
                    rows += [pa.array([s[k].astype(np.int32) for s in spans], pa.list_(pa.int32())) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(rows, ["doc_id", "ids", "starts", "ends"][: len(rows)])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id``, ``bytes`` and ``text`` behind the ids; null ids give no bytes."""

    def run(batches):
        for batch in batches:
            raw = [decode_bytes(path, np.array(x or [], np.int64)) for x in batch.column("ids").to_pylist()]
            text = pa.array([x.decode("utf-8", "replace") for x in raw], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(raw, pa.binary()), text], ["doc_id", "bytes", "text"])

    return encoded.selectExpr(f"`{id_col}` as doc_id", f"`{ids_col}` as ids").mapInArrow(
        run, "doc_id long, bytes binary, text string"
    )


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of encoding and decoding in one pass: ``doc_id``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``.

    Null and empty texts: no tokens and the digest of no bytes.
    """

    def run(batches):
        for batch in batches:
            n, of_ids, of_bytes = [], [], []
            for text in batch.column("text").to_pylist():
                ids = encode(path, pattern, text)
                n.append(len(ids))
                of_ids.append(hashlib.sha256(ids).hexdigest())
                of_bytes.append(hashlib.sha256(decode_bytes(path, ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return id_and_text(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
