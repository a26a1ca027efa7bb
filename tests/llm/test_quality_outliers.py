"""Classifier, outlier rules, neighbours and chat formatting."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.llm import chat, neighbours, outliers, quality
from cohortloom.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.1"
WORD = r"[^\x20\x09-\x0D]+"


def test_features_do_not_depend_on_the_neighbours():
    texts = ["", " \n ", "one", "A b! c | ###\n" * 50, "é ß" * 9, "word " * 48, "word " * 49 + "\n\n", "x", ""]
    together, passages = quality.passage_features(texts)
    assert passages.tolist() == [max(1, -(-len(t.encode().split()) // quality.PASSAGE_WORDS)) for t in texts]
    ends = np.cumsum(passages)
    for text, end, n in zip(texts, ends, passages, strict=True):
        assert np.allclose(quality.passage_features([text])[0], together[end - n : end])


def test_gradients_are_right():
    rng = np.random.default_rng(0)
    passages = np.array([1, 3, 2])
    features, labels = rng.standard_normal((6, quality.N_FEATURES)), np.array([0.0, 1.0, 1.0])
    model = quality.AttentionModel.start(np.zeros(quality.N_FEATURES), np.ones(quality.N_FEATURES), 5, 4, 0.6, 1)

    def loss():
        s, _ = model.forward(features, passages)
        return -np.mean(labels * np.log(s) + (1 - labels) * np.log(1 - s))

    score, kept = model.forward(features, passages)
    grads = model.gradients(kept, passages, (score - labels) / 3)
    for name, grad in grads.items():
        at = tuple(0 for _ in grad.shape)
        old = model.weights[name].copy()
        for sign in (1, -1):
            step = old.copy()
            step[at] += sign * 1e-5
            model.weights[name] = step
            up, down = (loss(), 0.0) if sign == 1 else (up, loss())
        model.weights[name] = old
        assert grad[at] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-8), name


def test_held_out_accuracy(spark):
    got = QUERIES["op8_attention_quality"](spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = got.join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) for r in rows)
    unseen = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == r.quality for r in unseen]) > 0.98
    assert np.mean([r.predicted for r in unseen if r.quality == 1]) > 0.99


def test_classifier_edges(spark):
    docs = spark.createDataFrame([(1, None, "s"), (None, "", "s"), (2, "word " * 9000, "s"), (2, "word", "s")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    rows = quality.score_documents(docs, model).collect()
    assert len(rows) == 4 and all(r.score == 0.5 and r.predicted == 0 for r in rows)
    assert quality.score_documents(docs.where("false"), model).count() == 0


def plain_counts(text):
    words = re.findall(WORD, text or "")
    lines = [line for line in (text or "").split("\n") if re.search(WORD, line)]
    windows, covered = {}, set()
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    for places in windows.values():
        if len(places) > 1:
            covered.update(i + k for i in places for k in range(8))
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


TEXTS = [None, "", " \x0b\x0c ", "a b c d e f g h " * 3, "é ß x\x85y\n\na\na\n \n \n", "# * <b>|", "one two " * 5000, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w1 w2 w3 w4 w5 w6 w7 w8"]


def test_base_counts_equal_plain_counts():
    for text in TEXTS:
        assert outliers.count_text(text)[:5] == plain_counts(text)


def test_robust_fit_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    p = len(outliers.STATISTICS)
    x = rng.standard_normal((3000, p)) @ np.diag([0.2, 1, 1, 1, 0.2, 0.2]) + 1
    x[:500] += 6
    rows = spark.createDataFrame([("l", "s", row.tolist()) for row in x], "lang string, source string, x array<double>")
    fit = outliers.robust_fits(rows).first().fit
    inverse = np.array(fit.inverse).reshape(p, p)
    d = np.einsum("ij,jk,ik->i", x - fit.mean, inverse, x - fit.mean)
    core = x[np.argsort(d)[: int(0.75 * len(x))]]
    assert np.allclose(core.mean(axis=0), fit.mean, atol=0.02)
    spread = np.sqrt(np.diag(np.linalg.inv(inverse)))
    assert np.allclose(spread, np.maximum(core.std(axis=0), list(outliers.STATISTICS.values())), rtol=0.1)
    assert (d[:500] > outliers.CUTOFF).all() and (d[500:] < outliers.CUTOFF).mean() > 0.99


def test_verdicts_on_labelled_documents(spark):
    got = QUERIES["op3_robust_outliers"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    good = [r for r in got if r.quality == 1 and not r.base_failed]
    assert all(r.kept for r in good)
    assert np.mean([not r.kept for r in got if r.quality == 0]) > 0.9
    assert not any(r.kept and r.base_failed for r in got)


def test_outlier_edges(spark):
    rows = [(i, t, None, "s", 1) for i, t in enumerate(TEXTS)] + [(None, "a b " * 40, "en", None, 1)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept int")
    got = outliers.document_verdicts(docs).collect()
    assert sorted(tuple(r)[1:6] for r in got) == sorted(plain_counts(r[1]) for r in rows)
    assert [r.kept for r in got if r.n_words < 20] == [False] * sum(r.n_words < 20 for r in got)
    assert outliers.screened(docs).count() == len(rows) and outliers.document_verdicts(docs.where("false")).count() == 0


def test_texts_are_counted_by_one_worker_a_task(spark, monkeypatch):
    """A filter on the counts is no second call of them, which would hold a second Python worker for every task."""
    plans, write = [], outliers.written

    def calls(df):
        return df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython")

    monkeypatch.setattr(outliers, "written", lambda df, name: plans.append((name, calls(df))) or write(df, name))
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string")
    judged = outliers.screened(docs).where("outlier.kept").select("doc_id")
    assert dict(plans)["statistics"] == 1 and calls(judged) == 1


def plain_nearest(rows, asked, k):
    fine = {i: np.array(v, float) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    out = {}
    for q in asked:
        if q in fine:
            scores = sorted(((-float((fine[q] * v).sum()), i) for i, v in fine.items() if i != q))[:k]
            out[q] = [(i, -s) for s, i in scores]
    return out


def test_neighbours_reach_recall(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    want = plain_nearest(rows, [i for i, _ in rows if i % 20 == 0], 20)
    got = neighbours.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0), sample_rows=1000, leaf_size=25).collect()
    found = {}
    for r in got:
        found.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert found.keys() == want.keys() and all(sorted(v) == list(range(1, 21)) for v in found.values())
    hits = [len({i for i, _ in want[q]} & {i for i, _ in found[q].values()}) for q in want]
    assert np.mean(hits) / 20 >= 0.9
    for q, v in found.items():
        assert list(v.values()) == sorted(v.values(), key=lambda x: (-x[1], x[0])) or sorted(v.items()) == list(v.items())


def test_neighbours_of_copies_and_odd_vectors(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.standard_normal(8).round(3).tolist()) for i in range(60)] + [(100 + i, [1.0] * 8) for i in range(50)]
    rows += [(200, None), (201, [0.0] * 8), (202, [1.0, None] + [0.0] * 6), (203, [float("nan")] * 8), (204, [float("inf")] + [0.0] * 7), (None, [1.0] * 8)]
    rows += [(5, rows[5][1])]
    vectors = spark.createDataFrame([(i, v, 0.0) for i, v in rows], "vec_id long, embedding array<double>, score double")
    asked = [0, 5, 100, 130, 200, 201, 203]
    got = neighbours.nearest(vectors, vectors.where(F.col("vec_id").isin(asked)), k=7, probes=1000).orderBy("query_id", "rank").collect()
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 9)))
    assert found == {q: [(i, round(s, 9)) for i, s in v] for q, v in plain_nearest(rows, asked, 7).items()}
    none = vectors.where("false")
    assert neighbours.nearest(none, none).count() == 0


def test_neighbours_break_ties_by_id(spark):
    """1,900 different vectors with one score: the smallest ids are found although a leaf keeps few members."""
    rng = np.random.default_rng(3)
    rows = [(0, [1.0] + [0.0] * 8)] + [(i, [0.5, *rng.standard_normal(8).round(3).tolist()]) for i in rng.permutation(np.arange(1, 1901)).tolist()]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = neighbours.nearest(vectors, vectors.where("vec_id = 0"), k=20, probes=100_000).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(i, 0.5) for i in range(1, 21)]


def test_chat_round_trip(spark):
    odd = ["", None, "<|end|>", "\\<|", "<\\|text|>\\\\", "<|turn|>user<|text|>hi<|end|>", "a<", "|b", "é🙂\n"]
    rows = [(1, i, ["user", "assistant", None][i % 3], t) for i, t in enumerate(odd)] + [(None, 0, "assistant", "x"), (2, None, "<|user|>", "y")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parts", chat.text_parts(F.col("text")))
    got = chat.format_conversations(turns).select(
        "conv_id", "n_turns", chat.read_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")
    ).collect()
    assert len(got) == 3
    for row in got:
        mine = [r for r in rows if r[0] == row.conv_id]
        assert [(t.role, t.text) for t in row.turns] == [(r[2] or "", r[3] or "") for r in mine] and row.n_turns == len(mine)
        assert row.loss == "".join(r[3] or "" for r in mine if r[2] == "assistant")
    assert chat.format_conversations(turns.where("false")).count() == 0


def test_chat_attachments_are_recorded_in_order(spark):
    parts = [("text", "see <|image:9|>", None, None), ("Image", None, "a.png", 12), ("audio", None, "b.wav", None), (None, "end", None, None), ("document", None, "c", 5)]
    turns = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts array<{chat.PART_TYPE}>")
    row = chat.format_conversations(turns).first()
    assert row.formatted == "<|turn|>user<|text|>see <\\|image:9|><|image:1|><|audio:2|>end<|document:4|><|end|><|turn|>assistant<|text|><|end|>"
    assert [(a.turn, a.part, a.kind, a.ref, a.tokens) for a in row.attachments] == [
        (0, 1, "image", "a.png", 12), (0, 2, "audio", "b.wav", 750), (0, 4, "document", "c", 5)]
    assert row.attachment_tokens == 767 and [(s.start, s.length) for s in row.loss_spans] == [(len(row.formatted) - 7, 0)]


def test_chat_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("create view conversations as select * from read_parquet('/root/testdata/sf0.001/conversations.parquet')")
    got = QUERIES["op6_chat_parts"](spark, "/root/testdata/sf0.001")
    names = sorted(got.columns)
    want = con.execute(f"select {', '.join(names)} from ({ORACLE['op6_chat_parts']})").fetchall()
    assert sorted(map(tuple, got.select(names).collect())) == sorted(want)
