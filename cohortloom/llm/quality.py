"""Quality classifier: attention-based multiple-instance learning over the passages of a document.

A document is a bag of passages of a fixed number of words. Every passage of the whole text is encoded from its
character and word statistics; gated attention weighs the encodings, learned from document labels alone, and the
weighted representation is scored. One bad passage can so decide a long document.

The model is fitted on a bounded sample of labelled documents (``sample_docs``); scoring covers all documents, map side.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.llm.common import release_memory

PASSAGE_WORDS = 48
_SPACE, _SYMBOL, _MARK, _UPPER, _LOWER, _DIGIT, _WIDE, _OTHER, _LINE, _BAR, _SHOUT = range(11)
_CLASSES = 11
#: Features of a passage: class rates, word length, words, distinct words, words equal to the one before.
N_FEATURES = _CLASSES + 5


def _byte_classes() -> np.ndarray:
    table = np.full(256, _OTHER, np.uint8)
    for codes, kind in (
        (range(0x80, 0x100), _WIDE), (range(0x41, 0x5B), _UPPER), (range(0x61, 0x7B), _LOWER), (range(0x30, 0x3A), _DIGIT),
        (b" \t\v\f\r", _SPACE), (b"\n", _LINE), (b"#*$%&<>", _SYMBOL), (b".,;:?'\"()-", _MARK), (b"|", _BAR), (b"!", _SHOUT),
    ):
        table[list(codes)] = kind
    return table


_CLASS = _byte_classes()


def _few_texts(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of some texts, and the number of passages of each text (at least one)."""
    data = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
    kind = _CLASS[data]
    gap = (kind == _SPACE) | (kind == _LINE)
    starts = np.flatnonzero(~gap & np.r_[True, gap[:-1]])
    ends = np.flatnonzero(gap & np.r_[False, ~gap[:-1]])
    sizes = np.fromiter((len(r) + 1 for r in raws), np.int64, len(raws))
    text_ends = np.cumsum(sizes)
    words = np.searchsorted(starts, text_ends) - np.searchsorted(starts, text_ends - sizes)
    passages = np.maximum(1, -(-words // PASSAGE_WORDS))
    first_word = np.cumsum(words) - words
    first_passage = np.cumsum(passages) - passages
    total = int(passages.sum())
    rank = np.arange(len(starts)) - np.repeat(first_word, words)
    of_word = np.repeat(first_passage, words) + rank // PASSAGE_WORDS
    # A passage's bytes reach from its first word to the next passage's; a text without words is one empty passage.
    opens = np.zeros(len(data), np.int64)
    heads = np.flatnonzero(rank % PASSAGE_WORDS == 0)
    later = heads[rank[heads] > 0]
    opens[starts[later]] = 1
    opens[(text_ends - sizes)[1:]] += 1
    of_byte = np.cumsum(opens)
    counts = np.bincount(of_byte * _CLASSES + kind, minlength=total * _CLASSES).reshape(total, _CLASSES).astype(float)
    n = np.bincount(of_word, minlength=total).astype(float)
    length = (ends - starts).astype(float)
    chars = np.bincount(of_word, weights=length, minlength=total)
    if len(starts):
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        head = np.ndarray((len(data),), "<u8", padded.tobytes(), strides=(1,))[starts]
        tail = np.ndarray((len(data),), "<u8", padded.tobytes(), strides=(1,))[np.maximum(ends - 8, starts)]
        short = np.minimum(length, 8).astype(np.uint64)
        mask = np.where(short < 8, (np.uint64(1) << (short * np.uint64(8))) - np.uint64(1), np.uint64(2**64 - 1))
        code = ((head & mask) * np.uint64(0x9E3779B97F4A7C15)) ^ ((tail & mask) * np.uint64(0xC2B2AE3D27D4EB4F)) ^ length.astype(np.uint64)
        code ^= code >> np.uint64(31)
        inside = of_word[1:] == of_word[:-1]
        again = np.bincount(of_word[1:][inside & (code[1:] == code[:-1])], minlength=total)
        mixed = np.sort((of_word.astype(np.uint64) << np.uint64(40)) | (code & np.uint64(2**40 - 1)))
        fresh = np.r_[True, mixed[1:] != mixed[:-1]]
        distinct = np.bincount((mixed[fresh] >> np.uint64(40)).astype(np.int64), minlength=total)
    else:
        again = distinct = np.zeros(total)
    per_word = np.maximum(n, 1)
    rates = np.log1p(counts / per_word[:, None])
    features = np.column_stack([
        rates, np.log1p(chars / per_word), np.log1p(n), distinct / per_word, again / per_word, n >= 20,
    ])
    return features, passages


def passage_features(texts: list[str], slice_bytes: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of ``texts`` and the passages of each, about ``slice_bytes`` of text at a time."""
    features, passages, held, size = [], [], [], 0
    for text in [*texts, None]:
        if text is not None:
            held.append(text.encode())
            size += len(held[-1])
        if held and (text is None or size > slice_bytes):
            f, p = _few_texts(held)
            features.append(f)
            passages.append(p)
            held, size = [], 0
    if not features:
        return np.empty((0, N_FEATURES)), np.empty(0, np.int64)
    return np.concatenate(features), np.concatenate(passages)


@dataclass
class AttentionModel:
    """``encode`` (features to hidden), the two gates, their weights, and the final score."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    @staticmethod
    def start(mean, scale, hidden: int, gate: int, prior: float, seed: int) -> AttentionModel:
        rng = np.random.default_rng(seed)
        draw = lambda a, b: rng.standard_normal((a, b)) / np.sqrt(a)
        return AttentionModel(mean, scale, {
            "E": draw(N_FEATURES, hidden), "e": np.zeros(hidden), "V": draw(hidden, gate), "U": draw(hidden, gate),
            "w": draw(gate, 1)[:, 0], "c": draw(hidden, 1)[:, 0], "b": np.array(np.log(prior / (1 - prior))),
        })

    def forward(self, features: np.ndarray, passages: np.ndarray) -> tuple[np.ndarray, dict]:
        """Scores of bags; ``passages`` has the size of each bag."""
        w = self.weights
        x = np.clip((features - self.mean) / self.scale, -8, 8)
        starts = np.cumsum(passages) - passages
        h = np.tanh(x @ w["E"] + w["e"])
        v, u = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        a = (v * u) @ w["w"]
        a = np.exp(a - np.repeat(np.maximum.reduceat(a, starts), passages))
        a /= np.repeat(np.add.reduceat(a, starts), passages)
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        logit = z @ w["c"] + w["b"]
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30))), {"x": x, "h": h, "v": v, "u": u, "a": a, "z": z}

    def gradients(self, kept: dict, passages: np.ndarray, error: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss; ``error`` is score less label over the number of bags."""
        w, h, a, v, u = self.weights, kept["h"], kept["a"], kept["v"], kept["u"]
        starts = np.cumsum(passages) - passages
        dz = np.repeat(error, passages)[:, None] * w["c"]
        da = (dz * h).sum(axis=1)
        ds = a * (da - np.repeat(np.add.reduceat(a * da, starts), passages))
        dv, du = ds[:, None] * w["w"] * u * (1 - v**2), ds[:, None] * w["w"] * v * u * (1 - u)
        dh = a[:, None] * dz + dv @ w["V"].T + du @ w["U"].T
        dx = dh * (1 - h**2)
        return {
            "E": kept["x"].T @ dx, "e": dx.sum(axis=0), "V": h.T @ dv, "U": h.T @ du, "w": (v * u).T @ ds,
            "c": kept["z"].T @ error, "b": np.array(error.sum()),
        }


def fit_model(
    features: np.ndarray, passages: np.ndarray, labels: np.ndarray, hidden: int = 24, gate: int = 12, epochs: int = 60,
    batch: int = 64, rate: float = 0.004, decay: float = 1e-4, seed: int = 11,
) -> AttentionModel:
    """Adam on the log loss of document labels. With no labels the model scores 0.5 everywhere."""
    if not len(labels):
        model = AttentionModel.start(np.zeros(N_FEATURES), np.ones(N_FEATURES), hidden, gate, 0.5, seed)
        model.weights["c"] = model.weights["c"] * 0
        return model
    prior = (labels.sum() + 1) / (len(labels) + 2)
    model = AttentionModel.start(features.mean(axis=0), features.std(axis=0) + 1e-2, hidden, gate, prior, seed)
    starts, rng = np.cumsum(passages) - passages, np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in model.weights.items()}
    s = {k: np.zeros_like(v) for k, v in model.weights.items()}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), batch):
            bags = order[at : at + batch]
            rows = np.concatenate([np.arange(starts[i], starts[i] + passages[i]) for i in bags])
            score, kept = model.forward(features[rows], passages[bags])
            grads = model.gradients(kept, passages[bags], (score - labels[bags]) / len(bags))
            step += 1
            pace = rate * (1 - epoch / epochs) + rate / 50
            for k, g in grads.items():
                g = g + decay * model.weights[k] * (k not in "eb")
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.999 * s[k] + 0.001 * g * g
                model.weights[k] = model.weights[k] - pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
    return model


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id as text leaves 2 on division by 4. A null id is not held out, and has no
    label."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(
    docs: DataFrame, labels: DataFrame, sample_docs: int = 4000, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "quality",
) -> AttentionModel:
    """Fit on at most ``sample_docs`` labelled documents that are not held out, drawn by the hash of their id.

    Rows of ``labels`` with a null id or label are left out; of a repeated id the smallest label counts. Documents that
    repeat an id are one bag each.
    """
    chosen = labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    chosen = chosen.where(F.col("id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("id")))
    chosen = chosen.groupBy("id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(sample_docs)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))

    def bags(batches):
        for batch in batches:
            features, passages = passage_features(batch.column("text").to_pylist())
            ends = np.cumsum(passages)
            blobs = [features[e - n : e].astype("<f4").tobytes() for e, n in zip(ends, passages, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(blobs, pa.binary())], ["id", "label", "bag"])

    got = texts.join(F.broadcast(chosen), "id").select("id", "label", "text").mapInArrow(bags, "id long, label int, bag binary").toArrow()
    order = np.argsort(got.column("id").to_numpy(), kind="stable")
    bag = [np.frombuffer(b, "<f4").reshape(-1, N_FEATURES) for b in got.column("bag").to_pylist()]
    bag = [bag[i] for i in order]
    label = got.column("label").to_numpy()[order].astype(float)
    sizes = np.array([len(b) for b in bag], np.int64)
    return fit_model(np.concatenate(bag).astype(float) if bag else np.empty((0, N_FEATURES)), sizes, label)


def scorer(model: AttentionModel, spark):
    """A column function from text to score; null and empty texts are one passage without words."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        out = []
        for at in range(0, len(texts), 512):
            features, passages = passage_features([t or "" for t in texts.iloc[at : at + 512]])
            out.append(shared.value.forward(features, passages)[0])
            del features, passages
        release_memory()
        return pd.Series(np.concatenate(out) if out else np.empty(0))

    return score


def score_documents(
    docs: DataFrame, model: AttentionModel, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` (1 from ``threshold`` on) of every document.

    Only the text is scored. Repeated rows and null ids are kept; an empty table gives an empty result.
    """
    score = scorer(model, docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), score(F.col(f"`{text_col}`").cast("string")).alias("score"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
