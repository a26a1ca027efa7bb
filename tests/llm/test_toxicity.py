from __future__ import annotations

from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.llm import toxicity as tx
from cohortloom.llm.quality import held_out
from cohortloom.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.1"


def brute(scores, links, opening):
    """Marginals by all tag sequences of one text."""
    n, total, p, pairs = len(scores), 0.0, np.zeros(len(scores)), np.zeros((len(scores), 2, 2))
    for tags in product((0, 1), repeat=n):
        w = np.exp(opening * tags[0] + sum(s * t for s, t in zip(scores, tags, strict=True)) + sum(links[a, b] for a, b in zip(tags, tags[1:])))  # noqa: B905
        total += w
        p += w * np.array(tags)
        for i in range(1, n):
            pairs[i, tags[i - 1], tags[i]] += w
    return p / total, pairs / total


def test_marginals_match_all_sequences():
    rng = np.random.default_rng(4)
    sizes = [1, 5, 2, 9, 1, 3]
    scores, links, opening = rng.normal(0, 2, sum(sizes)), rng.normal(0, 1, (2, 2)), -0.7
    ends = np.cumsum(sizes)
    p, pairs = tx.marginals(scores, ends - sizes, links, opening)
    for end, size in zip(ends, sizes, strict=True):
        want_p, want_pairs = brute(scores[end - size : end], links, opening)
        assert p[end - size : end] == pytest.approx(want_p, abs=1e-9)
        assert pairs[end - size : end] == pytest.approx(want_pairs, abs=1e-9)
    assert tx.marginals(np.zeros(0), np.zeros(0, int), links, 0.0)[0].size == 0


def test_gradient_is_that_of_the_likelihood():
    """Expected less observed tags and links, as ``fit_chain`` uses them."""
    rng = np.random.default_rng(8)
    scores, links, opening, tags = rng.normal(size=6), rng.normal(size=(2, 2)), 0.3, [0, 1, 1, 0, 0, 1]

    def loss(s, k):
        weights = [(np.exp(opening * t[0] + s @ t + sum(k[a, b] for a, b in zip(t, t[1:]))), t) for t in product((0, 1), repeat=6)]  # noqa: B905
        return np.log(sum(w for w, _ in weights)) - np.log(next(w for w, t in weights if list(t) == tags))

    p, pairs = tx.marginals(scores, np.array([0]), links, opening)
    for i in range(6):
        bump = np.eye(6)[i] * 1e-5
        assert (loss(scores + bump, links) - loss(scores - bump, links)) / 2e-5 == pytest.approx(p[i] - tags[i], abs=1e-5)
    seen = np.zeros((2, 2))
    np.add.at(seen, (tags[:-1], tags[1:]), 1)
    for a, b in product((0, 1), repeat=2):
        bump = np.zeros((2, 2))
        bump[a, b] = 1e-5
        assert (loss(scores, links + bump) - loss(scores, links - bump)) / 2e-5 == pytest.approx(pairs.sum(axis=0)[a, b] - seen[a, b], abs=1e-5)


@pytest.fixture(scope="module")
def model(spark):
    return tx.train(spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet"))


def test_held_out_documents_and_spans(spark, model):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = tx.score_documents(docs, model).join(spark.read.parquet(f"{FOLDER}/labels.parquet"), "doc_id").filter("held_out").join(docs.select("doc_id", "text"), "doc_id").collect()
    toxic, clean = [r for r in rows if r.toxic], [r for r in rows if r.toxic == 0]
    assert sum(r.predicted for r in toxic) >= 0.9 * len(toxic) and sum(r.predicted for r in clean) <= 0.02 * len(clean)
    for r in rows:
        assert all(r.text[s.start : s.stop].strip() and 0.5 <= s.score <= 1 for s in r.spans)
    assert sum(bool(r.spans) for r in toxic) >= 0.85 * len(toxic)


def test_scores_match_a_word_by_word_pass(spark, model):
    """Forward and backward one word at a time, against the blocks over many texts at once."""
    def plain(text):
        words = text.split()
        s = model.word_scores(words)
        steps = [np.exp(np.array([0, model.opening + s[0]]))] if words else []
        for x in s[1:]:
            step = (steps[-1] @ np.exp(model.links)) * np.exp([0, x])
            steps.append(step / step.sum())
        back, p = np.ones(2), np.zeros(len(words))
        for i in reversed(range(len(words))):
            p[i] = steps[i][1] * back[1] / (steps[i] @ back)
            back = np.exp(model.links) @ (np.exp([0, s[i]]) * back)
            back /= back.sum()
        signs = tx._signs(p, np.zeros(len(words), int), 1)[0]
        return 1 / (1 + np.exp(-(signs @ model.head[:-1] + model.head[-1])))

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").filter("doc_id < 300")
    got = {r.doc_id: r.score for r in tx.tag_documents(docs, model).collect()}
    for r in docs.collect():
        assert got[r.doc_id] == pytest.approx(plain(r.text or ""), abs=1e-8)


def test_odd_documents(spark, model):
    long = "the of and " * 200_000 + "idiot"
    data = [(1, None), (2, ""), (3, " \n\t "), (None, "You idiot!"), (4, "!!! 123 ###"), (4, "!!! 123 ###"), (5, long), (6, "é IDIOT$$$ x")]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumns({"score": F.lit("mine"), "spans": F.lit(1)})
    rows = tx.score_documents(df, model).collect()
    assert len(rows) == len(data) and all(0 <= r.score <= 1 for r in rows)
    by = {r.doc_id: r for r in rows}
    assert by[1].score == by[2].score == by[3].score < 0.3 and by[None].held_out is False
    assert [long[s.start : s.stop] for s in by[5].spans] == ["idiot"] and by[6].spans[0].start == 2
    assert tx.score_documents(df.limit(0), model).count() == 0


def test_labels_missing_or_of_one_kind(spark):
    docs = spark.createDataFrame([(i, "a b c") for i in range(20)], "doc_id long, text string")
    none = spark.createDataFrame([(None, 1), (3, None)], "doc_id long, toxic int")
    assert {r.score for r in tx.score_documents(docs, tx.train(docs, none)).collect()} == {0.5}
    ones = spark.createDataFrame([(i, 1) for i in range(20)] + [(1, 1)], "doc_id long, toxic int")
    got = tx.score_documents(docs, tx.train(docs, ones)).collect()
    assert len({r.score for r in got}) == 1 and got[0].score > 0.5
    few = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    assert all(0 <= r.score <= 1 for r in tx.score_documents(docs, tx.train(docs, few)).collect())


def test_held_out_labels_are_not_learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    turned = labels.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = tx.train(docs, labels), tx.train(docs, turned)
    assert np.allclose(one.weights, two.weights) and np.allclose(one.head, two.head)


def test_registered_query_keeps_every_document(spark):
    folder = "/root/testdata/sf0.01"
    out = QUERIES["op13_chain_toxicity"](spark, folder)
    assert out.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    assert out.count() == spark.read.parquet(f"{folder}/documents.parquet").count()
