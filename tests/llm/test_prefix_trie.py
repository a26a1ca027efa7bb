from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cohortloom.llm import prefix_trie
from cohortloom.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append((turn is not None, turn or 0, role, hashlib.md5(text.encode()).hexdigest(), text))
    turns = {c: [(t[2], t[4]) for t in sorted(ts)] for c, ts in turns.items()}
    rebuilt = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        donor = turns.get(c - int(c - 100 * int(c / 100)), [])
        rebuilt[c] = tuple(donor[:h] + own[h:])
    below = defaultdict(list)
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            below[seq[:d]].append(c)
    children = defaultdict(list)
    for node in below:
        if node:
            children[node[:-1]].append(node)
    totals = {}
    for node in sorted(below, key=len, reverse=True):
        kids = [totals[k] for k in children[node]]
        mine = (len(below[node]) - 1) * (len(node[-1][1]) if node else 0)
        totals[node] = (sum(k[0] for k in kids) or 1, mine + sum(k[1] for k in kids))
    out = []
    for node, convs in below.items():
        ends = sorted(c for c in convs if len(rebuilt[c]) == len(node))
        out.append((
            min(convs), len(node), min(below[node[:-1]]) if node else None, len(convs), len(children[node]), *totals[node],
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def result(df):
    assert df.columns == NAMES
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_whole_table_matches_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(QUERIES["op11_band_trie"](spark, folder)) == brute(rows)


def invented(seed, convs=150, longest=40):
    """Copies, long conversations, missing and negative ids, ties, repeated rows, missing roles, texts and turns."""
    rnd, rows = random.Random(seed), []
    for c in [*range(-120, -100), *rnd.sample(range(400), convs)]:
        n = rnd.choice([1, 2, 3, longest if c % 7 == 0 else 4])
        for t in range(n):
            text = "same" if c % 3 else rnd.choice(["a", "bb", "é€", "", None])
            rows.append((c, rnd.choice([t, t, None, 1]) if c % 5 == 0 else t, rnd.choice(["user", None]) if c % 4 == 0 else "user", text))
    return rows + rows[:5] + [(None, 1, "user", "lost"), (7000, None, None, None)]


@pytest.mark.parametrize("band", [2, 3, 32])
def test_bands_match_brute_force(spark, band):
    rows = invented(band)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("depth", F.lit("x")).withColumn("owner", F.lit(5)).repartition(3)
    assert result(prefix_trie.conversation_trie(df, band)) == brute(rows)


def test_ranges_of_one_conversation(spark):
    rows = [(1, i, "user", str(i % 4)) for i in range(300)] + [(0, i, "user", str(i % 4)) for i in range(3)]
    df = spark.createDataFrame(rows, SCHEMA)
    spark.conf.set("spark.cohortloom.rangeRows", "30")
    try:
        assert result(prefix_trie.conversation_trie(df, 4)) == brute(rows)
    finally:
        spark.conf.unset("spark.cohortloom.rangeRows")


def test_empty_table_and_turnless_conversations(spark):
    assert result(prefix_trie.conversation_trie(spark.createDataFrame([], SCHEMA))) == []
    rows = [(c, 1, "user", "x") for c in range(101, 130)]
    assert result(prefix_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_digest_of_many_ends_in_chunks(spark, monkeypatch):
    ends = spark.range(3000).selectExpr("1L AS depth", "if(id % 3 = 0, 5L, 6L) AS owner", "id AS conv_id")
    got = {r.owner: r.ends_sha256 for r in prefix_trie.id_digests(ends).collect()}
    for owner, keep in ((5, lambda i: i % 3 == 0), (6, lambda i: i % 3)):
        want = ",".join(str(i) for i in range(3000) if keep(i))
        assert got[owner] == hashlib.sha256(want.encode()).hexdigest()
