"""Approximate nearest neighbours by inner product: a forest of random-projection trees.

The trees are fitted on a bounded sample of the vectors; every vector is then put into one leaf of each tree. A query
walks all trees through one shared priority queue: of all nodes not yet opened it opens the one whose worst margin on
the way is best, until it holds as many leaves as asked for. Leaves and the queries that reached them meet by one
shuffle, and each leaf's vectors are scored exactly in double precision.

Inner products become angles by one more component, the square root of the largest squared norm minus the vector's own
(zero for queries), so that near in angle is large in inner product. Equal vectors are one member of the index with their
smallest ids, since no query can return more of them; so no leaf can grow by copies.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass
class Forest:
    """Nodes of all trees: ``planes`` and ``cuts`` of inner nodes; a child below zero is leaf ``-1 - child``."""

    planes: np.ndarray
    cuts: np.ndarray
    children: np.ndarray
    roots: list[int]
    leaves: int
    largest: float

    def lift(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        """Vectors with the component that turns inner products into angles."""
        own = (vectors**2).sum(axis=1)
        extra = np.zeros(len(vectors)) if query else np.sqrt(np.maximum(self.largest - own, 0))
        return np.column_stack([vectors, extra])

    def leaves_of(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree."""
        lifted, out = self.lift(vectors, False), np.empty((len(vectors), len(self.roots)), np.int64)
        for t, root in enumerate(self.roots):
            node = np.full(len(vectors), root)
            while (inner := np.flatnonzero(node >= 0)).size:
                at = node[inner]
                side = (np.einsum("ij,ij->i", lifted[inner], self.planes[at]) > self.cuts[at]).astype(int)
                node[inner] = self.children[at, side]
            out[:, t] = -1 - node
        return out

    def probes(self, vectors: np.ndarray, wanted: int) -> list[list[int]]:
        """For each query the leaves found through the shared queue, best first."""
        length = np.sqrt((vectors**2).sum(axis=1, keepdims=True))
        scaled = vectors / length * np.sqrt(self.largest)
        margins = (self.lift(scaled, True) @ self.planes.T - self.cuts).tolist() if len(self.planes) else [[]] * len(vectors)
        children = self.children.tolist()
        found = []
        for margin in margins:
            queue, leaves = [(-np.inf, root) for root in self.roots], []
            heapq.heapify(queue)
            while queue and len(leaves) < wanted:
                worst, node = heapq.heappop(queue)
                if node < 0:
                    leaves.append(-1 - node)
                    continue
                heapq.heappush(queue, (max(worst, margin[node]), children[node][0]))
                heapq.heappush(queue, (max(worst, -margin[node]), children[node][1]))
            found.append(leaves)
        return found


def fit_forest(sample: np.ndarray, largest: float, trees: int, leaf_size: int, seed: int) -> Forest:
    """Split the sample by random projections at the median, until at most ``leaf_size`` of it lie in a leaf."""
    rng = np.random.default_rng(seed)
    forest = Forest(np.empty((0, 0)), np.empty(0), np.empty((0, 2), int), [], 0, largest)
    lifted, planes, cuts, children = forest.lift(sample, False), [], [], []

    def grow(rows: np.ndarray) -> int:
        if len(rows) > leaf_size:
            plane = rng.standard_normal(lifted.shape[1])
            plane /= np.sqrt((plane**2).sum())
            seen = lifted[rows] @ plane
            cut = float(np.median(seen))
            above = seen > cut
            if above.any() and not above.all():
                node = len(planes)
                planes.append(plane)
                cuts.append(cut)
                children.append([0, 0])
                children[node] = [grow(rows[~above]), grow(rows[above])]
                return node
        forest.leaves += 1
        return -forest.leaves

    forest.roots = [grow(np.arange(len(sample))) for _ in range(trees)]
    forest.planes = np.array(planes).reshape(len(planes), lifted.shape[1])
    forest.cuts, forest.children = np.array(cuts), np.array(children, int).reshape(-1, 2)
    return forest


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``vec_id`` and ``vec`` (doubles) of rows that take part."""
    vec = F.col(f"`{vec_col}`").cast("array<double>")
    fine = F.forall("vec", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(F.coalesce(x, F.lit(0.0))))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), vec.alias("vec"))
    return rows.where(F.col("vec_id").isNotNull() & fine & F.exists("vec", lambda x: x != 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 20, trees: int = 16, leaf_size: int = 100, probes: int = 120,
    sample_rows: int = 10_000, block_rows: int = 20_000, seed: int = 7, id_col: str = "vec_id", vec_col: str = "embedding",
) -> DataFrame:
    """The ``k`` nearest of ``vectors`` to each of ``queries``: ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``.

    Nearest is the largest inner product; ties go to the smaller id. A row never finds its own id. Vectors that are null,
    zero or hold null or non-finite components take no part, nor do null ids; all others must have one length. Repeated
    rows count once. Other columns are left out. Without vectors or queries the result is empty.

    ``trees``, ``leaf_size`` (of the sample) and ``probes`` (leaves a query opens) set the recall; ``sample_rows`` bounds
    what the trees are fitted on, ``block_rows`` how many vectors of a leaf meet in one block.
    """
    spark = vectors.sparkSession
    ranked = Window.partitionBy("vec").orderBy("vec_id")
    members = usable(vectors, id_col, vec_col).withColumn("n", F.dense_rank().over(ranked)).where(F.col("n") <= k + 1)
    members = members.groupBy("vec").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
    members = members.select(F.col("ids")[0].alias("member"), "ids", "vec")
    asked = usable(queries, id_col, vec_col).select(F.col("vec_id").alias("query_id"), "vec").distinct()
    asked_once = asked.groupBy("vec").agg(F.min("query_id").alias("asked"))

    norm = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)
    facts = members.agg(F.count("*").alias("rows"), F.max(norm).alias("largest")).first()
    sample = members.orderBy(F.xxhash64("member")).limit(sample_rows).select("vec").toArrow().column("vec").combine_chunks()
    forest = fit_forest(_matrix(sample), float(facts["largest"] or 0.0), trees if facts["rows"] else 0, leaf_size, seed)
    shared = spark.sparkContext.broadcast(forest)
    salts = max(1, -(-2 * facts["rows"] * trees // (max(forest.leaves, 1) * block_rows)))

    row = "leaf int, salt int, side int, id long, vec array<double>"
    names, kinds = ["leaf", "salt", "side", "id", "vec"], pa.list_(pa.float64())

    def rows_of(leaf, salt, side, ids, matrix, at):
        flat = pa.array(np.ascontiguousarray(matrix[at]).ravel())
        width = matrix.shape[1]
        vec = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * width), flat)
        columns = [pa.array(leaf, pa.int32()), pa.array(salt, pa.int32()), pa.array(np.full(len(at), side), pa.int32()), pa.array(ids[at]), vec]
        return pa.RecordBatch.from_arrays(columns, names)

    def put(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                ids, matrix = part.column("id").to_numpy(), _matrix(part.column("vec"))
                leaves = shared.value.leaves_of(matrix)
                at = np.repeat(np.arange(len(ids)), leaves.shape[1])
                yield rows_of(leaves.ravel(), (ids[at] // 8191) % salts, 0, ids, matrix, at)

    def ask(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                ids, matrix = part.column("id").to_numpy(), _matrix(part.column("vec"))
                found = shared.value.probes(matrix, probes)
                leaves = np.array([x for leaf in found for x in leaf], np.int64)
                at = np.repeat(np.arange(len(ids)), [len(x) for x in found])
                for salt in range(salts):
                    yield rows_of(leaves, np.full(len(at), salt), 1, ids, matrix, at)

    put_rows = members.select(F.col("member").alias("id"), "vec").mapInArrow(put, row)
    ask_rows = asked_once.select(F.col("asked").alias("id"), "vec").mapInArrow(ask, row)
    met = put_rows.union(ask_rows).repartition("leaf", "salt").sortWithinPartitions("leaf", "salt", "side")

    def score(batches):
        key, held_ids, held = None, [], []
        block = None
        for batch in batches:
            leaf, salt, side = (batch.column(c).to_numpy() for c in names[:3])
            ids, matrix = batch.column("id").to_numpy(), _matrix(batch.column("vec"))
            code = (leaf.astype(np.int64) << 32) + (salt << 1) + side
            starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            for a, b in zip(starts, [*starts[1:], len(code)], strict=True):
                if (leaf[a], salt[a]) != key:
                    key, held_ids, held, block = (leaf[a], salt[a]), [], [], None
                if side[a] == 0:
                    held_ids.append(ids[a:b])
                    held.append(matrix[a:b])
                elif held:
                    block = block or (np.concatenate(held_ids), np.concatenate(held))
                    for at in range(a, b, 512):
                        yield best(ids[at : min(b, at + 512)], matrix[at : min(b, at + 512)], *block)

    def best(query_ids, queries, member_ids, table):
        scores, wanted = queries @ table.T, min(k + 1 + 8, len(member_ids))
        top = np.argpartition(-scores, wanted - 1, axis=1)[:, :wanted]
        exact = (queries[:, None, :] * table[top]).sum(axis=2)
        asked_ids, found, values = [np.repeat(query_ids, wanted)], [member_ids[top].ravel()], [exact.ravel()]
        if wanted < len(member_ids):
            # Rows whose last place is shared by more members than were taken: all that reach it, up to rounding.
            last = np.partition(scores, -(k + 1), axis=1)[:, -(k + 1)]
            slack = 1e-12 * np.sqrt((queries**2).sum(axis=1) * (table**2).sum(axis=1).max())
            near = scores >= (last - slack)[:, None]
            for i in np.flatnonzero(near.sum(axis=1) > wanted):
                tied = np.flatnonzero(near[i])
                score = (queries[i] * table[tied]).sum(axis=1)
                first = np.lexsort((member_ids[tied], -score))[: k + 1]
                asked_ids.append(np.repeat(query_ids[i], len(first)))
                found.append(member_ids[tied[first]])
                values.append(score[first])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (asked_ids, found, values)], ["asked", "member", "score"])

    scored = met.mapInArrow(score, "asked long, member long, score double")
    scored = scored.groupBy("asked", "member").agg(F.max("score").alias("score"))
    groups = Window.partitionBy("asked").orderBy(F.desc("score"), "member")
    kept = scored.withColumn("n", F.row_number().over(groups)).where(F.col("n") <= k + 1).drop("n")
    kept = kept.join(members.select("member", "ids"), "member")
    answers = kept.groupBy("asked").agg(F.collect_list(F.struct("score", "ids")).alias("found"))
    found = asked.join(asked_once, "vec").join(answers, "asked").select("query_id", F.explode("found").alias("f"))
    found = found.select("query_id", F.col("f.score").alias("score"), F.explode("f.ids").alias("vec_id"))
    found = found.where(F.col("vec_id") != F.col("query_id")).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
