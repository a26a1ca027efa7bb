"""Stages of the pipeline against their operators' meaning."""

from __future__ import annotations

import os
import re

import corpus_pipeline
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cohortloom.llm import common, packing, quality, vocab


def test_stages_keep_columns_and_follow_decisions(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    schema, sizes = docs.dtypes, [docs.count()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        docs = corpus_pipeline.written(stage(spark, docs, folder), name.replace(" ", "-"))
        assert docs.dtypes == schema, name
        after = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        assert after.keys() <= before.keys()
        lost = before.keys() - after.keys()
        if name == "quality classifier":
            assert sum(labels.get(d) == 1 for d in lost) <= 0.02 * sum(v == 1 for v in labels.values())
        elif name == "SimHash near-dedup":
            assert len(set(after.values())) == len(after) and lost
        elif name == "suffix-array dedup":
            windows = {}
            for d in sorted(after):
                raw = before[d].encode()
                assert after[d] == before[d] or any(raw[i : i + 50] in windows for i in range(len(raw) - 49))
                for i in range(len(raw) - 49):
                    windows.setdefault(raw[i : i + 50], d)
        sizes.append(docs.count())
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder).select("doc_id", "length", "doc_tokens").collect()
    tokens = {r.doc_id: len(vocab.load(corpus_pipeline.public_tokenizers.path("word_bpe_49k.json")).encode(r.text, add_special_tokens=False).ids) + 1 for r in docs.limit(40).collect()}
    for doc_id, n in tokens.items():
        mine = [p for p in pieces if p.doc_id == doc_id]
        assert sum(p.length for p in mine) == n == mine[0].doc_tokens and len(mine) == len(packing.piece_lengths(n, 2048))
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.5 * sizes[0]


def test_stages_keep_columns_with_helper_names(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = ["_key", "_KEY_", "_outlier", "_repeats", "_block", "_fit", "_fit_lang", "_fit_source"]
    marked = docs.withColumns({name: F.concat(F.lit(name), F.col("doc_id")) for name in odd})
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out, plain = stage(spark, marked, ""), stage(spark, docs, "")
        assert out.columns == marked.columns, name
        rows = out.collect()
        assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in plain.select("doc_id").collect())
        assert all(r[c] == f"{c}{r.doc_id}" for r in rows for c in odd)


def test_stages_on_odd_documents(spark):
    """Null and empty texts, repeated rows and ids, null ids, and an empty table."""
    good = "The quick brown fox jumps over a lazy dog near the old river bank while seven small birds watch it from above today."
    data = [(1, good, "en", "a"), (1, good, "en", "a"), (None, good, None, None), (2, None, "en", "a"), (3, "", "en", "a"), (4, "one", "en", "a")]
    docs = spark.createDataFrame([(*r, 5) for r in data], "doc_id long, text string, lang string, source string, n_chars long")
    _, screen = corpus_pipeline.STAGES[1]
    assert all(r.text == good for r in screen(spark, docs, "").collect())
    _, near = corpus_pipeline.STAGES[2]
    kept = near(spark, docs, "").collect()
    assert [r.doc_id for r in kept if r.text == good] == [1]
    _, repeats = corpus_pipeline.STAGES[3]
    assert sorted(r.text or "" for r in repeats(spark, docs.filter("doc_id IN (2, 3, 4)"), "").collect()) == ["", "", "one"]
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, docs.limit(0), "").count() == 0


def test_stages_give_their_workers_memory_back(spark):
    """After scoring and packing a worker holds little more than before: it outlives its tasks."""
    words = " ".join(f"w{i}x" for i in range(400))
    docs = spark.range(16000, numPartitions=1).select(
        F.col("id").alias("doc_id"), F.concat(F.lit(words), F.lit(" "), F.col("id").cast("string")).alias("text")
    )

    path = corpus_pipeline.public_tokenizers.path("word_bpe_49k.json")

    def read(_):
        quality.passage_features(["a"])
        vocab.id_encoder(path)
        pages = open("/proc/self/smaps_rollup").read()
        mb = sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", pages))) >> 10
        yield pa.RecordBatch.from_pydict({"pid": [os.getpid()], "mb": [mb]})

    def held():
        rows = spark.range(64, numPartitions=64).mapInArrow(read, "pid long, mb long").groupBy("pid").agg(F.max("mb").alias("mb")).collect()
        return {r.pid: r.mb for r in rows}

    def grown():
        return max(mb - before.get(pid, min(before.values())) for pid, mb in held().items())

    before = held()
    score = quality.scorer(quality.fit_model(np.empty((0, quality.N_FEATURES)), np.empty(0, np.int64), np.empty(0)), spark)
    docs.select(score("text").alias("s")).agg(F.sum("s")).first()
    scored = grown()
    packing.pack_documents(docs, path).agg(F.sum("length")).first()
    packed = grown()
    assert scored < 30 and packed < 30, (scored, packed)


def test_near_dedup_leaves_texts_where_they_are(spark):
    """Texts are not shuffled for the rows kept, nor for the sets of candidates, where a bit a row is small enough to be sent."""
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(words[(k + i * i) % 200] for i in range(k % 90 + 8)) + f" only {k // 2}" for k in range(8000)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    near = corpus_pipeline.STAGES[2][1]
    want = sorted(r.doc_id for r in near(spark, docs, "").collect())
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "12k")
    try:
        out = near(spark, docs, "")
        assert sorted(r.doc_id for r in out.collect()) == want and len(want) < 8000
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_picked_rows(spark):
    """Negative, repeated, null and far-apart keys, and clashing names, as a semi-join has them."""
    keys = [-(2**62), -65, -64, -1, 0, 0, 1, 63, 64, 2**33, 2**33 + 63, 2**62, None]
    df = spark.createDataFrame([(k, f"t{i}", i) for i, k in enumerate(keys)], "key long, _word string, _bits int")
    wanted = spark.createDataFrame([(k,) for k in [-(2**62), -64, 0, 0, 63, 2**33 + 63, 5, None]], "key long")
    got = common.picked(df, "key", wanted)
    assert got.columns == df.columns
    assert sorted(got.collect()) == sorted(df.join(wanted, "key", "left_semi").collect()) and got.count() == 6
