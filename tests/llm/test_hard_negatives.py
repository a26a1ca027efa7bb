from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.llm import hard_negatives as hn
from cohortloom.llm.queries import QUERIES

SCHEMA = "vec_id long, label long, vec array<double>"
def anchor():
    return F.col("vec_id") % 10 == 0


def brute(rows, every=10, positives=5, negatives=10, low=30, high=90):
    rows = sorted({(i, c, tuple(v)) for i, c, v in rows if i is not None and c is not None and v is not None and None not in v})
    rows = [r for r in rows if len(r[2]) == len(rows[0][2])]
    out = []
    for a in (r for r in rows if r[0] % every == 0):
        score = lambda r: int(np.dot(a[2], r[2]))  # noqa: B023, E731
        best = sorted((-score(r), r[0]) for r in rows if r[1] == a[1] and r != a)[:positives]
        others = sorted((-score(r), r[0]) for r in rows if r[1] != a[1])
        for p, pid in best:
            fit = [(n, nid) for n, nid in others if low * -p <= 100 * -n <= high * -p][:negatives]
            out += [(a[0], pid, k + 1, nid, -p, -n) for k, (n, nid) in enumerate(fit)]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def clustered(seed, n=900, size=6):
    """Clusters, copies of one vector under two labels, ties, and vectors without any structure."""
    rng = np.random.default_rng(seed)
    centres = rng.integers(-60, 60, (12, size))
    rows = []
    for i in range(n):
        if i % 3 == 0:
            vec = centres[0]
        elif i % 3 == 1:
            vec = centres[rng.integers(12)] + rng.integers(-4, 5, size)
        else:
            vec = rng.integers(-40, 40, size)
        rows.append((i, int(rng.integers(3)), [float(x) for x in vec]))
    return rows


@pytest.mark.parametrize(("part_rows", "sample_rows", "width"), [(4096, 4096, 16), (40, 300, 4), (25, 60, 3)])
def test_matches_brute_force(spark, part_rows, sample_rows, width):
    rows = clustered(part_rows)
    got = hn.hard_negatives(spark.createDataFrame(rows, SCHEMA), anchor(), part_rows=part_rows, sample_rows=sample_rows, width=width)
    assert found(got) == brute(rows)


def test_odd_rows(spark):
    rows = clustered(5, 120) + clustered(5, 20)
    rows += [(None, 1, [1.0] * 6), (500, None, [1.0] * 6), (510, 1, None), (520, 1, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (530, 1, [2.0] * 5), (540, 2, [0.0] * 6)]
    rows += [(10, 0, [7.0] * 6), (10, 1, [7.0] * 6), (550, 1, [3e6, -1.0, 2.0, 3.0, 4.0, 5.0])]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"leaf": F.lit("x"), "part": F.lit("y")})
    assert found(hn.hard_negatives(df, anchor(), part_rows=30)) == brute(rows)


def test_empty_and_lonely(spark):
    assert found(hn.hard_negatives(spark.createDataFrame([], SCHEMA), anchor())) == []
    assert found(hn.hard_negatives(spark.createDataFrame([(10, 1, [1.0, 2.0])], SCHEMA), anchor())) == []


def test_ranges_rule_out_leaves_on_structured_vectors():
    rng = np.random.default_rng(1)
    centres = rng.integers(-2000, 2000, (40, 8))
    x = (centres[rng.integers(40, size=4000)] + rng.integers(-20, 20, (4000, 8))).astype(float)
    tree = hn.fit_tree(x[:1000], float((x**2).sum(axis=1).max()), 16, 0.01)
    leaf, _, seen = tree.route(x)
    ways = tree.leaf_nodes()
    for node, children in enumerate(tree.children):
        m = len(children)
        tree.ranges[node] = (np.full((m, m), np.inf), np.full((m, m), -np.inf))
    for name, way in ways.items():
        mine = seen[leaf == name]
        for level, (node, j) in enumerate(way if len(mine) else []):
            d = mine[:, level * 16 : level * 16 + len(tree.children[node])]
            tree.ranges[node][0][:, j] = np.minimum(tree.ranges[node][0][:, j], d.min(axis=0))
            tree.ranges[node][1][:, j] = np.maximum(tree.ranges[node][1][:, j], d.max(axis=0))
    q = x[:50]
    d = np.sqrt((q**2).sum(axis=1)[:, None] + tree.largest - 2 * q @ x.T)
    outer = np.partition(d, 10, axis=1)[:, 10:11]
    inner = np.partition(d, 5, axis=1)[:, 5:6]
    pairs = {(r, c) for rows, leaves, _ in tree.survivors(q, inner, outer) for r, c in zip(rows, leaves, strict=True)}
    need = {(i, leaf[j]) for i in range(50) for j in np.flatnonzero((d[i] >= inner[i]) & (d[i] <= outer[i]))}
    assert need <= pairs and len(pairs) < 50 * tree.leaves / 4


def test_registered_query_on_whole_table(spark):
    folder = "/root/testdata/sf0.1"
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, [float(np.floor(256 * np.float64(x))) for x in r.embedding])
            for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    assert found(QUERIES["op12_sibling_range_negatives"](spark, folder)) == brute(rows, 100)
