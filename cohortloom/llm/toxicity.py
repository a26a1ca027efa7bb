"""Toxicity by a linear-chain conditional random field over the words of a document.

Words are tagged as offending or not. A word's score is the sum of the learned weights of its features (the word without
signs and digits, in lower case, its beginnings and its ending); transition weights between neighbouring tags make the chain.
Forward and backward passes give each word's marginal, exactly and over the whole text; offending words in a row are a span,
and a document's score comes from its marginals by a small logistic model.

Only documents are labelled. A word of a toxic document is a labelled offending token if one of its features occurs in far
more toxic than other documents of the training rows; all words of other documents are labelled clean.

The model is fitted on a bounded sample of labelled documents; tagging covers every word of all documents, map side.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.quality import held_out

BUCKETS = 1 << 17
WINDOW = 48
WORD = re.compile(r"\S+")
NOT_LETTERS = re.compile(r"[\W\d_]+")
CACHE = 200_000
FAINT = 0.25
SLICE = 1 << 21


def plain_word(word: str) -> str:
    """Letters of a word in lower case."""
    return NOT_LETTERS.sub("", word.lower())


def marks(plain: str) -> list[str]:
    """What may give a word away: itself and its beginnings."""
    return ["w" + plain, *[f"{n}{plain[:n]}" for n in (4, 5, 6) if len(plain) > n]] if plain else []


def features(plain: str) -> list[int]:
    """Feature numbers of a word: always seven, so that they form a matrix."""
    names = ["w" + plain, "3" + plain[:3], "4" + plain[:4], "5" + plain[:5], "6" + plain[:6], "e" + plain[-3:], f"l{min(len(plain), 12)}"]
    return [zlib.crc32(n.encode()) % BUCKETS for n in names]


def _running(m: np.ndarray) -> np.ndarray:
    """Row vectors (1, 1) times the products of all matrices up to each one, each scaled to sum one.

    ``m`` is (n, 2, 2). Blocks of about the square root of n run side by side, then their ends one after another.
    """
    n = len(m)
    side = max(1, math.isqrt(n))
    blocks = -(-n // side)
    padded = np.broadcast_to(np.eye(2), (blocks * side, 2, 2)).copy()
    padded[:n] = m
    steps = padded.reshape(blocks, side, 2, 2)
    done = np.empty_like(steps)
    a, b, c, d = (np.ones(blocks), np.zeros(blocks), np.zeros(blocks), np.ones(blocks))
    for k in range(side):
        p, q, r, s = (steps[:, k, i, j] for i in (0, 1) for j in (0, 1))
        a, b, c, d = a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s
        total = a + b + c + d
        a, b, c, d = a / total, b / total, c / total, d / total
        done[:, k, 0, 0], done[:, k, 0, 1], done[:, k, 1, 0], done[:, k, 1, 1] = a, b, c, d
    starts = np.empty((blocks, 2))
    v = np.array([0.5, 0.5])
    for i in range(blocks):
        starts[i] = v
        v = v @ done[i, -1]
        v = v / v.sum()
    out = np.einsum("bi,bkij->bkj", starts, done).reshape(-1, 2)[:n]
    return out / out.sum(axis=1, keepdims=True)


def marginals(scores: np.ndarray, firsts: np.ndarray, links: np.ndarray, opening: float) -> tuple[np.ndarray, np.ndarray]:
    """Probability that each word offends, and of each pair of tags with the word before (n, 2, 2; zero at a first word).

    All texts are one chain: the matrix of a text's first word forgets what was before. ``links[i, j]`` is the weight of
    tag j after tag i, ``opening`` that of an offending first word.
    """
    n = len(scores)
    if not n:
        return np.zeros(0), np.zeros((0, 2, 2))
    m = np.repeat(np.exp(np.clip(links, -30, 30))[None], n, axis=0)
    m[firsts] = np.array([[1.0, math.exp(max(min(opening, 30.0), -30.0))]] * 2)
    m[:, :, 1] *= np.exp(np.clip(scores, -30, 30))[:, None]
    ahead = _running(m)
    back = np.full((n, 2), 0.5)
    if n > 1:
        back[:-1] = _running(m[:0:-1].transpose(0, 2, 1))[::-1]
    both = ahead * back
    p = both[:, 1] / both.sum(axis=1)
    before = np.vstack([[0.5, 0.5], ahead[:-1]])
    pairs = before[:, :, None] * m * back[:, None, :]
    pairs /= pairs.sum(axis=(1, 2), keepdims=True)
    pairs[firsts] = 0
    return p, pairs


@dataclass
class ToxicityModel:
    """Feature weights, transition weights, and the logistic model over a document's marginals."""

    weights: np.ndarray
    links: np.ndarray
    opening: float
    head: np.ndarray

    def word_scores(self, words: list[str]) -> np.ndarray:
        return self.weights[np.array([features(plain_word(w)) for w in words]).reshape(-1, 7)].sum(axis=1)


def fit_chain(words: list[str], tags: np.ndarray, firsts: np.ndarray, rounds: int = 60, rate: float = 0.15, decay: float = 1e-5):
    """Weights by Adam on the exact likelihood of the labelled tokens: feature weights, links, opening."""
    plains = [plain_word(w) for w in words]
    known = {p: i for i, p in enumerate(dict.fromkeys(plains))}
    of_token = np.array([known[p] for p in plains], np.int64)
    table = np.array([features(p) for p in known]).reshape(-1, 7)
    params = {"w": np.zeros(BUCKETS), "links": np.zeros((2, 2)), "opening": np.zeros(1)}
    params["links"][:, 1] = params["opening"][:] = -2.0
    m, v = ({k: np.zeros_like(x) for k, x in params.items()} for _ in range(2))
    n = max(len(words), 1)
    observed = np.zeros((len(words), 2, 2))
    observed[np.arange(1, len(words)), tags[:-1], tags[1:]] = 1
    observed[firsts] = 0
    for step in range(1, rounds + 1):
        scores = params["w"][table].sum(axis=1)[of_token]
        p, pairs = marginals(scores, firsts, params["links"], float(params["opening"][0]))
        wrong = np.bincount(of_token, p - tags, len(known))
        grads = {
            "w": np.bincount(table.ravel(), np.repeat(wrong, 7), BUCKETS) / n + decay * params["w"],
            "links": (pairs - observed).sum(axis=0) / n, "opening": np.array([(p - tags)[firsts].sum() / n]),
        }
        pace = rate * (1 - step / (rounds + 1))
        for k, g in grads.items():
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
            params[k] = params[k] - pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-9)
    return params["w"], params["links"], float(params["opening"][0])


def fit_head(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 30, decay: float = 0.05) -> np.ndarray:
    """Logistic regression by Newton steps: weights of a document's signs, the last one the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + decay * np.eye(len(w))
        w = w - np.linalg.solve(curve, x.T @ (weight * (p - y)) + decay * w)
    return w


N_SIGNS = 3


def _signs(p: np.ndarray, of_text: np.ndarray, n: int) -> np.ndarray:
    """Per text: expected offending words, the surest one, and their share; zero for a text without words.

    Marginals below ``FAINT`` don't add up, so that a long text is not offending for its length.
    """
    expected = np.bincount(of_text, np.where(p >= FAINT, p, 0.0), n)
    size = np.bincount(of_text, minlength=n)
    surest = np.zeros(n)
    np.maximum.at(surest, of_text, p)
    return np.column_stack([np.log1p(expected), surest, np.sqrt(expected / np.maximum(size, 1))])


class _Tagger:
    """Tags texts in a worker; word scores are kept for up to ``CACHE`` words."""

    def __init__(self, model: ToxicityModel):
        self.model, self.known = model, {}

    def scores(self, words: list[str]) -> np.ndarray:
        known = self.known
        new = list({w for w in words if w not in known})
        if new:
            if len(known) + len(new) > CACHE:
                known.clear()
                new = list(set(words))
            known.update(zip(new, self.model.word_scores(new).tolist(), strict=True))
        return np.fromiter(map(known.__getitem__, words), float, len(words))

    def tag(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Marginals of all words, the text of each, and the signs of each text."""
        split = [t.split() for t in texts]
        sizes = np.array([len(s) for s in split], np.int64)
        of_text = np.repeat(np.arange(len(texts)), sizes)
        firsts = (np.cumsum(sizes) - sizes)[sizes > 0]
        p, _ = marginals(self.scores([w for s in split for w in s]), firsts, self.model.links, self.model.opening)
        return p, of_text, _signs(p, of_text, len(texts))

    def judge(self, texts: list[str], least: float) -> tuple[np.ndarray, list[list[dict]]]:
        """Scores of texts and their spans of words with a marginal of ``least`` or more, in code points."""
        p, of_text, signs = self.tag(texts)
        score = 1 / (1 + np.exp(-np.clip(np.column_stack([signs, np.ones(len(texts))]) @ self.model.head, -30, 30)))
        spans = [[] for _ in texts]
        starts = np.searchsorted(of_text, np.arange(len(texts)))
        hits = np.flatnonzero(p >= least)
        for i in np.unique(of_text[hits]):
            places = [(m.start(), m.end()) for m in WORD.finditer(texts[i])]
            mine = hits[of_text[hits] == i] - starts[i]
            for run in np.split(mine, np.flatnonzero(np.diff(mine) > 1) + 1):
                surest = float(p[starts[i] + run].max())
                spans[i].append({"start": places[run[0]][0], "stop": places[run[-1]][1], "score": surest})
        return score, spans


def _slices(texts: list[str]):
    """Texts of about ``SLICE`` characters together."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size > SLICE:
            yield held
            held, size = [], 0
    if held:
        yield held


def _chosen(labels: DataFrame, sample_docs: int, id_col: str, label_col: str) -> DataFrame:
    """At most ``sample_docs`` labelled ids of each label that are not held out, by the hash of the id; ``fold`` 0 to 3."""
    rows = labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("id"))).groupBy("id").agg(F.min("label").alias("label"))
    order = F.xxhash64("id")
    parts = [rows.filter(F.col("label") == k).orderBy(order, "id").limit(sample_docs) for k in (0, 1)]
    return parts[0].unionByName(parts[1]).withColumn("fold", F.pmod(order, F.lit(4)).cast("int"))


def train(
    docs: DataFrame, labels: DataFrame, sample_docs: int = 3000, windows: int = 4, marks_kept: int = 20_000, id_col: str = "doc_id",
    text_col: str = "text", label_col: str = "toxic",
) -> ToxicityModel:
    """Fit on at most ``sample_docs`` documents of each label, of which ``windows`` windows of ``WINDOW`` words are kept, in
    toxic documents those with offending tokens. A quarter of the documents fits only the document score.

    Held-out rows and rows with a missing id or label are left out; of a repeated id the smallest label counts and one text is
    read. Without both labels every document scores their smoothed share.
    """
    spark = docs.sparkSession
    chosen = _chosen(labels, sample_docs, id_col, label_col)
    usable = labels.filter(F.col(f"`{id_col}`").isNotNull() & ~held_out(F.col(f"`{id_col}`").cast("long"))).groupBy(F.col(f"`{label_col}`").cast("int").alias("label")).count()
    totals = {r["label"]: r["count"] for r in usable.filter("label IN (0, 1)").collect()}
    if len(totals) < 2:
        share = (totals.get(1, 0) + 1) / (sum(totals.values()) + 2)
        return ToxicityModel(np.zeros(BUCKETS), np.zeros((2, 2)), 0.0, np.array([0.0] * N_SIGNS + [math.log(share / (1 - share))]))
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    # Twice ``sample_docs`` rows at most.
    rows = texts.join(F.broadcast(chosen), "id")

    def counted(batches):
        for batch in batches:
            seen = {0: Counter(), 1: Counter()}
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                seen[label].update({m for w in set(text.split()) for m in marks(plain_word(w))})
            both = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(both, pa.string()), pa.array([seen[0][m] for m in both], pa.int64()), pa.array([seen[1][m] for m in both], pa.int64())], ["mark", "clean", "toxic"]
            )

    learned = rows.filter("fold < 3")
    sizes = {r.label: r["count"] for r in chosen.filter("fold < 3").groupBy("label").count().collect()}
    odds = F.log((F.col("toxic") + 0.5) / (sizes.get(1, 0) + 1)) - F.log((F.col("clean") + 0.5) / (sizes.get(0, 0) + 1))
    unsure = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    counts = learned.select("text", "label").mapInArrow(counted, "mark string, clean long, toxic long").groupBy("mark").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    strong = counts.filter((F.col("toxic") >= 3) & (odds - unsure > 2)).orderBy((odds - unsure).desc(), "mark").limit(marks_kept)
    telling = frozenset(r.mark for r in strong.collect())
    shared = spark.sparkContext.broadcast(telling)

    def windowed(batches):
        for batch in batches:
            out = []
            for ident, text, label in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "label")), strict=True):
                words = text.split()
                tags = [int(label and any(m in shared.value for m in marks(plain_word(w)))) for w in words] if label else [0] * len(words)
                spots = range(0, len(words), WINDOW)
                if label:
                    spots = [s for s in spots if any(tags[s : s + WINDOW])]
                picked = sorted(spots, key=lambda s: zlib.crc32(f"{ident} {s}".encode()))[:windows]  # noqa: B023
                out += [(ident, words[s : s + WINDOW], tags[s : s + WINDOW]) for s in picked]
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.list_(pa.string())), pa.array([o[2] for o in out], pa.list_(pa.int32()))],
                ["id", "words", "tags"],
            )

    # One text per id, so that the sample is bounded whatever repeats.
    single = learned.groupBy("id").agg(F.min("label").alias("label"), F.min_by("text", F.xxhash64("text")).alias("text"))
    got = single.mapInArrow(windowed, "id long, words array<string>, tags array<int>").orderBy("id", F.xxhash64("words")).collect()
    words = [w for r in got for w in r.words]
    tags = np.array([t for r in got for t in r.tags], np.int64)
    lengths = np.array([len(r.words) for r in got], np.int64)
    firsts = np.cumsum(lengths) - lengths
    weights, links, opening = fit_chain(words, tags, firsts)
    model = ToxicityModel(weights, links, opening, np.zeros(N_SIGNS + 1))
    held = spark.sparkContext.broadcast(model)

    def signs(batches):
        tagger = _Tagger(held.value)
        for batch in batches:
            found = [tagger.tag(part)[2] for part in _slices(batch.column("text").to_pylist())]
            flat = np.concatenate(found) if found else np.zeros((0, N_SIGNS))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), *[pa.array(flat[:, i]) for i in range(N_SIGNS)]], ["id", "label", "s0", "s1", "s2"])

    rest = rows.filter("fold = 3").groupBy("id").agg(F.min("label").alias("label"), F.min_by("text", F.xxhash64("text")).alias("text"))
    seen = rest.mapInArrow(signs, "id long, label int, s0 double, s1 double, s2 double").orderBy("id").toPandas()
    y = seen["label"].to_numpy(float)
    if len(set(y)) < 2:
        share = (totals[1] + 1) / (sum(totals.values()) + 2)
        model.head = np.array([1.0, 6.0, 1.0, math.log(share / (1 - share)) - 1.0])
        return model
    # The sample has other shares of the labels than the table.
    weight = np.where(y == 1, totals[1] / (y == 1).sum(), totals[0] / (y == 0).sum()) * len(y) / sum(totals.values())
    model.head = fit_head(seen[["s0", "s1", "s2"]].to_numpy(), y, weight)
    return model


def tag_documents(docs: DataFrame, model: ToxicityModel, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``score`` and ``spans`` (``start``, ``stop`` in code points, ``score``) of every document.

    Only the text is read, all of it; null and empty texts have no spans. Repeated rows and null ids are kept, an empty table
    gives an empty result, and other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64())]))

    def tagged(batches):
        tagger = _Tagger(shared.value)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            scores, spans = [], []
            for part in _slices(texts):
                score, found = tagger.judge(part, least)
                scores.append(score)
                spans += found
            scores = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(spans, kind)], ["doc_id", "score", "spans"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(tagged, "doc_id long, score double, spans array<struct<start: int, stop: int, score: double>>")


def score_documents(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` (1 from ``threshold`` on) and ``spans`` of every document."""
    tagged = tag_documents(docs, model)
    return tagged.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "spans"
    )
