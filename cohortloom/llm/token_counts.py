"""Token counts by a two-tier lookup of pre-token lengths, map side only.

Tier one is a compact table of the lengths of frequent pre-tokens, broadcast once: the pre-tokens that the vocabulary
itself holds, which its training found frequent. Its size is bounded by the vocabulary. Tier two is a bounded cache in
each Python worker for everything else. No pre-token is ever shuffled and the corpus is read once.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm import vocab
from cohortloom.llm.common import id_and_text, n_bytes


def frequent_lengths(path: str) -> tuple[str, bytes]:
    """Tier one: words of the vocabulary that follow a space, newline-joined, and their token counts in one byte each.

    Words whose count does not fit a byte are left to tier two.
    """
    tokenizer, word_level = vocab.load(path), vocab.is_word_level(path)
    byte_of = {c: b for b, c in vocab.byte_characters().items()}
    words = []
    for token in tokenizer.get_vocab(with_added_tokens=False):
        text = bytes(byte_of[c] for c in token.removesuffix("</w>") if c in byte_of).decode("utf-8", "ignore")
        word = text.removeprefix(" ")
        if (text[:1] == " " or word_level) and word.isalpha():
            words.append(word)
    words = sorted(set(words))
    lead = "" if word_level else " "
    counts = [len(e.ids) for e in tokenizer.encode_batch([lead + w for w in words], add_special_tokens=False)]
    kept = [(w, n) for w, n in zip(words, counts, strict=True) if n < 256]
    return "\n".join(w for w, _ in kept), bytes(n for _, n in kept)


@lru_cache(maxsize=2)
def _length_encoder(path: str) -> vocab.ChunkEncoder:
    return vocab.ChunkEncoder(vocab.load(path), vocab.is_word_level(path), len)


@lru_cache(maxsize=2)
def _pieces(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


class _Lengths(dict):
    """Tier one; ``__missing__`` goes on to tier two."""

    def __init__(self, table: tuple[str, bytes], rest: vocab.ChunkTable):
        super().__init__(zip(table[0].split("\n"), table[1], strict=True) if table[0] else ())
        self.rest = rest

    def __missing__(self, chunk: str) -> int:
        return self.rest[chunk]


def count_tokens(
    docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) of every whole text.

    ``path`` is a ``.json`` file of the tokenizers library or a sentencepiece ``.model``. Null text counts as empty:
    no bytes, no tokens. Rows are kept as they are, with repeated or null ids; other columns are left out. A long text is
    counted as a whole. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    is_model = path.endswith(".model")
    table = spark.sparkContext.broadcast(None if is_model else frequent_lengths(path))
    schema = "doc_id long, n_bytes long, n_tokens long"

    def run(batches):
        if is_model:
            processor = _pieces(path)
            count = lambda text: len(processor.encode(text, num_threads=1))
        else:
            encoder = _length_encoder(path)
            rest = encoder.exact if encoder.word_level else encoder.spaced
            if not isinstance(rest, _Lengths):
                lengths = _Lengths(table.value, rest)
                if encoder.word_level:
                    encoder.exact = lengths
                else:
                    encoder.spaced = lengths
            count = lambda text: sum(encoder.values(text))
        for batch in batches:
            counts = np.fromiter((count(t) for t in batch.column("text").to_pylist()), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts)], ["doc_id", "n_bytes", "n_tokens"]
            )

    texts = id_and_text(docs, id_col, text_col).withColumn("n_bytes", n_bytes(F.col("text")))
    return texts.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
