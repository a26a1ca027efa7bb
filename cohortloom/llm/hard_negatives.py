"""Hard negatives by a multiway hyperplane tree whose split points keep distance ranges to their siblings' subtrees.

Vectors get one more component, the square root of the largest squared norm less the vector's own (zero for anchors), so that
the distance to an anchor falls strictly as the inner product grows and a window of scores is an annulus of distances.

The tree is fitted on a bounded sample: every node has a few split points far apart, and a vector goes to the nearest. Every
vector is then put into a leaf, and each leaf is cut into parts by the distance to its own split point. For every split point
the smallest and largest distance to each sibling's subtree, and to each part, are taken over all vectors. An anchor leaves out
each sibling for which, by one of the split points, the triangle inequality keeps all distances out of its annuli. What is
left is scored exactly, part by part. So the result is exact, and the tree only saves work; on vectors without structure in
many dimensions it saves little and every anchor meets most parts.

Vectors of one label that are equal are one member with their smallest ids, since no window can return more of them; so no
part can grow by copies.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.llm.common import written

SLACK = 1e-6
ANNULI = 64


@dataclass
class Tree:
    """Nodes with split points ``points`` (indices into ``vectors``) and ``children`` (node, or -1 - leaf)."""

    largest: float
    width: int
    vectors: np.ndarray
    extra: np.ndarray
    points: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    leaves: int = 0
    depth: int = 0
    ranges: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    def lift(self, vectors: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.largest - (vectors**2).sum(axis=1), 0))

    def distances(self, vectors: np.ndarray, extra: np.ndarray, node: int) -> np.ndarray:
        at = self.points[node]
        p, e = self.vectors[at], self.extra[at]
        squared = (vectors**2).sum(axis=1)[:, None] + (p**2).sum(axis=1) - 2 * vectors @ p.T + (extra[:, None] - e) ** 2
        return np.sqrt(np.maximum(squared, 0))

    def route(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Leaf, distance to its own split point, and distances to the split points of all nodes on the way."""
        extra, n = self.lift(vectors), len(vectors)
        leaf, near, seen = np.zeros(n, np.int64), np.zeros(n), np.full((n, self.depth * self.width), np.nan)

        def walk(node, rows, level):
            d = self.distances(vectors[rows], extra[rows], node)
            seen[rows, level * self.width : level * self.width + d.shape[1]] = d
            nearest = d.argmin(axis=1)
            for j, child in enumerate(self.children[node]):
                mine = rows[nearest == j]
                if not len(mine):
                    continue
                if child < 0:
                    leaf[mine], near[mine] = -1 - child, d[nearest == j, j]
                else:
                    walk(child, mine, level + 1)

        if self.points and n:
            walk(0, np.arange(n), 0)
        return leaf, near, seen

    def survivors(self, vectors: np.ndarray, inner: np.ndarray, outer: np.ndarray):
        """Pairs of anchor row and leaf that no split point rules out, and the distances to the split points on the way.

        ``inner`` and ``outer`` bound each anchor's annuli, (rows, windows); an empty annulus has ``inner`` above ``outer``.
        """
        n, zero = len(vectors), np.zeros(len(vectors))
        found = []

        def walk(node, rows, way):
            d = self.distances(vectors[rows], zero[rows], node)
            low, high = self.ranges[node]  # (split point, sibling)
            gap = np.maximum(d[:, :, None] - high, low - d[:, :, None]).max(axis=1)
            reach = (d[:, :, None] + high).min(axis=1)
            meets = (gap[:, :, None] <= outer[rows][:, None, :] + SLACK) & (reach[:, :, None] >= inner[rows][:, None, :] - SLACK)
            alive = (meets & (inner[rows] <= outer[rows])[:, None, :]).any(axis=2)
            here = np.pad(d, ((0, 0), (0, self.width - d.shape[1])), constant_values=np.nan)
            for j, child in enumerate(self.children[node]):
                on = alive[:, j]
                if on.any():
                    path = np.concatenate([way[on], here[on]], axis=1)
                    if child < 0:
                        found.append((rows[on], np.full(int(on.sum()), -1 - child), path))
                    else:
                        walk(child, rows[on], path)

        rows = np.flatnonzero((inner <= outer).any(axis=1))
        if self.points:
            walk(0, rows, np.zeros((len(rows), 0)))
        elif n:
            found.append((rows, np.zeros(len(rows), np.int64), np.zeros((len(rows), 0))))
        return found

    def leaf_nodes(self) -> dict[int, list[tuple[int, int]]]:
        """The (node, child place) pairs on the way to each leaf."""
        ways = {}

        def walk(node, way):
            for j, child in enumerate(self.children[node]):
                if child < 0:
                    ways[-1 - child] = [*way, (node, j)]
                else:
                    walk(child, [*way, (node, j)])

        if self.points:
            walk(0, [])
        return ways


def fit_tree(sample: np.ndarray, largest: float, width: int, leaf_share: float) -> Tree:
    """Split until a leaf holds ``leaf_share`` of the sample or fewer; split points are chosen farthest first."""
    tree = Tree(largest, width, sample, np.zeros(0))
    tree.extra = tree.lift(sample)

    def spread(rows):
        picked = [rows[0]]
        gap = np.full(len(rows), np.inf)
        while len(picked) < width:
            last = picked[-1]
            gap = np.minimum(gap, ((sample[rows] - sample[last]) ** 2).sum(axis=1) + (tree.extra[rows] - tree.extra[last]) ** 2)
            if gap.max() <= 0:
                break
            picked.append(rows[int(gap.argmax())])
        return np.array(picked)

    def grow(rows, level):
        points = spread(rows) if len(rows) > max(leaf_share * len(sample), 2 * width) else rows[:1]
        if len(points) < 2:
            tree.leaves += 1
            return -tree.leaves
        node = len(tree.points)
        tree.points.append(points)
        tree.children.append([])
        tree.depth = max(tree.depth, level + 1)
        nearest = tree.distances(sample[rows], tree.extra[rows], node).argmin(axis=1)
        tree.children[node] = [grow(rows[nearest == j], level + 1) for j in range(len(points))]
        return node

    if len(sample):
        grow(np.arange(len(sample)), 0)
    tree.leaves = max(tree.leaves, 1)
    return tree


def _matrix(column: pa.Array, kind: str, size: int) -> np.ndarray:
    """Packed vectors as rows of doubles."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), size).astype(float)


def _bounds(scores: np.ndarray, fits: np.ndarray, low: np.ndarray, k: int) -> np.ndarray:
    """The ``k``-th largest of the fitting scores of each row, ``low`` where there are fewer."""
    if scores.shape[1] < k:
        return low
    masked = np.where(fits, scores, -np.inf)
    return np.maximum(np.partition(masked, -k, axis=1)[:, -k], low)


class _Search:
    """One pass of anchors against all members: the best ``k`` of each window by score and id."""

    def __init__(self, spark, tree: Tree, sample_labels: np.ndarray, kind: str, same: bool, k: int):
        self.shared = spark.sparkContext.broadcast((tree, sample_labels))
        self.kind, self.size, self.same, self.k = kind, tree.vectors.shape[1], same, k

    def ask(self, batches):
        """Anchors to the leaves that they can't rule out, their windows narrowed by the scores of the sample."""
        tree, labels = self.shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                vectors = _matrix(batch.column("vec"), self.kind, self.size)
                own = np.array(batch.column("label").to_pylist())
                n = len(own)
                lows, highs = (np.array(batch.column(c).to_pylist(), float).reshape(n, -1) for c in ("low", "high"))
                scores = vectors @ tree.vectors.T
                fits = (labels == own[:, None]) == self.same
                if self.same:
                    fits &= (tree.vectors[None, :, 0] != vectors[:, None, 0]) if self.size else False
                for w in range(lows.shape[1]):
                    inside = fits & (scores <= highs[:, w : w + 1]) & (scores >= lows[:, w : w + 1])
                    lows[:, w] = _bounds(scores, inside, lows[:, w], self.k)
                norm = (vectors**2).sum(axis=1)[:, None] + tree.largest
                inner, outer = (np.sqrt(np.maximum(norm - 2 * np.clip(s, -1e300, 1e300), 0)) for s in (highs, lows))
                outer = np.where(lows <= highs, outer, -1.0)
                for rows, leaf, way in tree.survivors(vectors, inner, outer):
                    if not len(rows):
                        continue
                    picked = batch.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(leaf), picked.column("vec_id"), picked.column("row"), picked.column("label"), picked.column("vec"),
                            *[pa.array(list(x[rows]), pa.list_(pa.float64())) for x in (lows, highs, inner, outer)],
                            pa.array([list(r) for r in way], pa.list_(pa.float64())),
                        ],
                        ["leaf", "vec_id", "row", "label", "vec", "low", "high", "inner", "outer", "way"],
                    )

    def score(self, batches):
        """Parts in order, the members of each before its anchors: the best of the part for every anchor and window."""
        part, held, members = None, [], None
        for batch in batches:
            keys = batch.column("part").to_numpy()
            asks = batch.column("asks").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (asks[1:] != asks[:-1]), True]) if len(keys) else [0]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if keys[a] != part:
                    part, held, members = keys[a], [], None
                piece = batch.slice(a, b - a)
                if not asks[a]:
                    held.append(piece)
                    continue
                if members is None:
                    members = self._gather(held)
                yield from self._answers(piece, *members)

    def _gather(self, held):
        if not held:
            return np.zeros((0, self.size)), np.zeros(0), []
        vectors = np.concatenate([_matrix(p.column("vec"), self.kind, self.size) for p in held])
        labels = np.concatenate([np.array(p.column("label").to_pylist()) for p in held])
        return vectors, labels, [ids for p in held for ids in p.column("ids").to_pylist()]

    def _answers(self, whole, vectors, labels, ids):
        for at in range(0, whole.num_rows, 64):
            piece = whole.slice(at, 64)
            asked = _matrix(piece.column("vec"), self.kind, self.size)
            scores = asked @ vectors.T
            lows, highs = piece.column("low").to_pylist(), piece.column("high").to_pylist()
            own, anchors, rows = (piece.column(c).to_pylist() for c in ("label", "vec_id", "row"))
            out = []
            for i, anchor in enumerate(anchors):
                fits = (labels == own[i]) == self.same
                for w, (low, high) in enumerate(zip(lows[i], highs[i], strict=True)):
                    hits = np.flatnonzero(fits & (scores[i] >= low) & (scores[i] <= high))
                    extra = self.k + 1  # the anchor itself may be among them
                    if len(hits) > extra:
                        got = scores[i][hits]
                        hits = hits[got >= np.partition(got, -extra)[-extra]]  # all ties of the last one
                    itself = [self.same and np.array_equal(vectors[h], asked[i]) for h in hits]
                    best = sorted((-scores[i][h], v) for h, me in zip(hits, itself, strict=True) for v in ids[h] if not (me and v == anchor))
                    out += [(anchor, rows[i], w, v, int(-s)) for s, v in best[: self.k]]
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)],
                    ["vec_id", "row", "window", "found", "score"],
                )

    def run(self, anchors: DataFrame, members: DataFrame, parts: DataFrame) -> DataFrame:
        """``anchors``: ``vec_id``, ``row``, ``label``, ``vec``, arrays ``low`` and ``high``. Returns ``vec_id``, ``row``,
        ``window``, ``place`` (from 1 on), ``found``, ``score``."""
        lists = "low array<double>, high array<double>, inner array<double>, outer array<double>, way array<double>"
        asked = anchors.mapInArrow(self.ask, f"leaf long, vec_id long, row long, label long, vec binary, {lists}")
        asked = asked.join(parts, "leaf")
        far = "(get(way, i) - get(most, i) > get(outer, w) + {0} OR get(least, i) - get(way, i) > get(outer, w) + {0} OR get(way, i) + get(most, i) < get(inner, w) - {0})".format(SLACK)
        rules_out = f"exists(sequence(0, size(way) - 1), i -> coalesce({far}, false))"
        kept = asked.filter(f"exists(sequence(0, size(low) - 1), w -> get(inner, w) <= get(outer, w) AND (size(way) = 0 OR NOT {rules_out}))")
        none = F.lit(None)
        rows = members.select(
            "part", F.lit(False).alias("asks"), none.cast("long").alias("vec_id"), none.cast("long").alias("row"), "label", "vec",
            "ids", none.cast("array<double>").alias("low"), none.cast("array<double>").alias("high"),
        ).unionByName(kept.select(
            "part", F.lit(True).alias("asks"), "vec_id", "row", "label", "vec", none.cast("array<long>").alias("ids"), "low", "high"
        ))
        met = rows.repartition("part").sortWithinPartitions("part", "asks")
        found = met.mapInArrow(self.score, "vec_id long, row long, window int, found long, score long")
        best = Window.partitionBy("vec_id", "row", "window").orderBy(F.col("score").desc(), "found")
        return found.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= self.k)


def hard_negatives(
    vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, width: int = 16,
    part_rows: int = 4096, sample_rows: int = 4096,
) -> DataFrame:
    """For every anchor row and each of its first ``positives`` rows of the same label, the first ``negatives`` rows of other
    labels whose score is between ``low`` and ``high`` percent of the positive's, both included.

    ``vectors``: ``vec_id``, ``label`` and ``vec``, whole numbers as doubles; ``anchor`` is a condition on ``vec_id``. Scores
    are inner products, exact below 2^53; higher ones come first, ties by the smaller id. Returns ``anchor_id``,
    ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    Rows with a missing id, label, vector or component, or of another length than the smallest id's vector, take no part.
    Repeated rows count once; different rows with one id are rows of their own. An empty table gives an empty result. The tree
    is fitted on ``sample_rows`` members, whose scores also give first bounds; all rows are searched.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "vec").filter(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.forall("vec", lambda x: x.isNotNull()), F.lit(False))
    )
    square = F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + x * x)
    size, n, top, largest = rows.agg(
        F.min_by(F.size("vec"), F.struct("vec_id", F.size("vec"))), F.count(F.lit(1)), F.max(F.array_max(F.transform("vec", lambda x: F.abs(x)))), F.max(square)
    ).first()
    size, kind = size or 0, "<i2" if (top or 0) < 2**15 else "<f8"

    def pack(batches):
        for batch in batches:
            flat = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), size)
            blobs = [r.tobytes() for r in flat.astype(kind)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(blobs, pa.binary())], ["vec_id", "label", "vec"])

    packed = rows.filter(F.size("vec") == size).mapInArrow(pack, "vec_id long, label long, vec binary")
    packed = written(packed.dropDuplicates(["vec_id", "label", "vec"]), "negatives-rows")
    # Of equal vectors of one label no window can return more than its smallest ids.
    first = Window.partitionBy("label", "vec").orderBy("vec_id")
    keep = max(positives, negatives) + 1
    members = packed.withColumn("at", F.row_number().over(first)).filter(F.col("at") <= keep)
    members = written(members.groupBy("label", "vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "negatives-members")

    sample = members.select("label", "vec").orderBy(F.xxhash64("label", "vec")).limit(sample_rows).collect()
    matrix = np.frombuffer(b"".join(r.vec for r in sample), kind).reshape(len(sample), size).astype(float)
    labels = np.array([r.label for r in sample], np.int64)
    tree = fit_tree(matrix, float(largest or 0), width, part_rows / max(n, 1))
    ways = tree.leaf_nodes()
    shared = spark.sparkContext.broadcast(tree)

    def route(batches):
        for batch in batches:
            leaf, near, seen = shared.value.route(_matrix(batch.column("vec"), kind, size))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(leaf), pa.array(near), pa.array(list(seen), pa.list_(pa.float64()))], [*batch.schema.names, "leaf", "near", "seen"]
            )

    routed = written(members.mapInArrow(route, "label long, vec binary, ids array<long>, leaf long, near double, seen array<double>"), "negatives-routed")
    # Rings around a leaf's split point; a ring of many rows is cut further by hash. One row per leaf: no more than the sample.
    cuts = routed.groupBy("leaf").agg(
        F.percentile_approx("near", [i / ANNULI for i in range(1, ANNULI)], 1000).alias("cuts"), F.ceil(F.count(F.lit(1)) / part_rows).alias("pieces")
    )
    ring = F.size(F.filter("cuts", lambda c: c < F.col("near")))
    rings = F.least(F.col("pieces"), F.lit(ANNULI))
    ring = F.floor(ring * rings / ANNULI)
    cut = F.pmod(F.xxhash64("vec", "label"), F.greatest(F.ceil(F.col("pieces") / ANNULI), F.lit(1)))
    placed = routed.join(F.broadcast(cuts), "leaf").withColumn("part", F.col("leaf") * 2**40 + ring * 2**32 + cut)
    placed = placed.drop("cuts", "pieces", "near")
    spots = range(tree.depth * width)
    seen = [F.when(~F.isnan(F.get("seen", F.lit(i))), F.get("seen", F.lit(i))) for i in spots]
    empty = F.array().cast("array<double>")
    parts = written(placed.groupBy("part").agg(
        F.first("leaf").alias("leaf"), (F.array(*[F.min(s) for s in seen]) if seen else empty).alias("least"),
        (F.array(*[F.max(s) for s in seen]) if seen else empty).alias("most"),
    ), "negatives-parts")
    per_leaf = parts.groupBy("leaf").agg(
        F.array(*[F.min(F.get("least", F.lit(i))) for i in spots]).alias("least"), F.array(*[F.max(F.get("most", F.lit(i))) for i in spots]).alias("most")
    ).collect() if seen else []
    for node, children in enumerate(tree.children):
        tree.ranges[node] = (np.full((len(children), len(children)), np.inf), np.full((len(children), len(children)), -np.inf))
    for r in per_leaf:
        for level, (node, j) in enumerate(ways[r.leaf]):
            low_of, high_of = tree.ranges[node]
            m = len(low_of)
            low_of[:, j] = np.minimum(low_of[:, j], r.least[level * width : level * width + m])
            high_of[:, j] = np.maximum(high_of[:, j], r.most[level * width : level * width + m])

    members = placed.select("part", "label", "vec", "ids")
    one = F.array(F.lit(float("-inf"))), F.array(F.lit(float("inf")))
    anchors = packed.filter(anchor).withColumn("row", F.xxhash64("vec_id", "label", "vec"))
    anchors = written(anchors, "negatives-anchors")
    found = _Search(spark, tree, labels, kind, True, positives).run(anchors.withColumns({"low": one[0], "high": one[1]}), members, parts)
    found = written(found.select("vec_id", "row", "place", "found", "score"), "negatives-positives")
    lists = found.groupBy("vec_id", "row").agg(F.array_sort(F.collect_list(F.struct("place", "found", "score"))).alias("got"))
    asked = anchors.join(lists, ["vec_id", "row"]).select(
        "vec_id", "row", "label", "vec", F.transform("got", lambda g: F.ceil(g["score"] * low / 100).cast("double")).alias("low"),
        F.transform("got", lambda g: F.floor(g["score"] * high / 100).cast("double")).alias("high"),
    )
    hits = _Search(spark, tree, labels, kind, False, negatives).run(asked, members, parts)
    return hits.join(found.select("vec_id", "row", (F.col("place") - 1).alias("window"), F.col("found").alias("positive_id"), F.col("score").alias("positive_score")), ["vec_id", "row", "window"]).select(
        F.col("vec_id").alias("anchor_id"), "positive_id", F.col("place").cast("int").alias("rank"), F.col("found").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )
