"""SimHash near-duplicates over a Gray-order hierarchical index.

Fingerprints are collapsed to distinct ones first, so exact copies cost nothing further. Fingerprints that may be near
share the bits of at least one mask; each mask is a dealing key, and the rows of a key are sorted by Gray rank, in which
neighbours differ in few bits. Over the sorted rows stands a tree: a node holds the bits that all its rows share, as a
mask and a pattern. A search goes down from the key's root, adds up the differences to the shared bits and drops a whole
node as soon as they exceed the radius. Only a spanning forest of the links found leaves a task.

With radius 2, masks are exact: cut 64 bits into three blocks, of which one must agree, and the other two into three
again. No link can be missed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.common import id_and_text, picked, releasing, written
from cohortloom.llm.components import connected

_LOWER = bytes(range(256)).lower()
_FAN = 8


def lower_words(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return text.encode().translate(_LOWER).split()


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 with seed 42 of every run of ``size`` words; of all words if there are fewer."""
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = (ends - [len(w) for w in words]).tolist()
    stops = ends.tolist()[size - 1 :] or [len(line)]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], seed=42) for a, b in zip(starts, stops, strict=False)], np.uint64)


def majority_bits(hashes: np.ndarray) -> int:
    """A bit is set if it is set in over half the hashes; none at all give zero."""
    count = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[at : at + (1 << 16)], "<u8").view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > len(hashes), bitorder="little").tobytes(), "little")


def _mixed(hashes: np.ndarray) -> np.ndarray:
    """A second 64 bits from the first."""
    h = hashes + np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each row of words (most significant first) in Gray order, as words: running parity from the top bit."""
    out, parity = np.empty_like(codes), np.zeros(len(codes), np.uint64)
    for k in range(codes.shape[1]):
        rank = codes[:, k].copy()
        for shift in (1, 2, 4, 8, 16, 32):
            rank ^= rank >> np.uint64(shift)
        out[:, k] = np.where(parity == 1, ~rank, rank)
        parity = out[:, k] & np.uint64(1)
    return out


class GrayTree:
    """Masks and patterns over groups of rows, each group sorted by Gray rank."""

    def __init__(self, codes: np.ndarray, group: np.ndarray):
        order = np.lexsort([*gray_rank(codes).T[::-1], group])
        self.order, self.codes, self.group = order, codes[order], group[order]
        ones, zeros, owner = self.codes, ~self.codes, self.group
        self.levels = [(None, None, owner)]
        while len(owner) > len(np.unique(owner)):
            opens = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            within = np.arange(len(owner)) - np.repeat(opens, np.diff(np.r_[opens, len(owner)]))
            first = np.flatnonzero(within % _FAN == 0)
            ones, zeros = np.bitwise_and.reduceat(ones, first), np.bitwise_and.reduceat(zeros, first)
            self.levels.append((ones, ones | zeros, owner[first], np.r_[first, len(owner)]))
            owner = owner[first]

    def near(self, radius: int, queries: np.ndarray, most: int = 2_000_000):
        """Yields pairs of rows (places in the sorted order) of one group within ``radius``; a bounded part at a time."""
        sizes = np.bincount(self.group)[self.group[queries]]
        cuts = np.r_[np.searchsorted(np.cumsum(sizes), np.arange(0, sizes.sum(), most)), len(queries)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            for q in np.array_split(queries[a:b], max(1, -(-int(sizes[a:b].sum()) // most))):
                if len(q):
                    yield self._search(radius, q)

    def _search(self, radius: int, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        top = self.levels[-1]
        node = np.searchsorted(top[2], self.group[q])
        seen = np.zeros(len(q), np.int64)
        parent = np.zeros((len(q), self.codes.shape[1]), np.uint64)
        for ones, shared, _, first in self.levels[:0:-1]:
            fresh = shared[node] & ~parent  # bits that this node adds to those its parents share
            seen = seen + np.bitwise_count((self.codes[q] ^ ones[node]) & fresh).sum(axis=1)
            alive = seen <= radius
            q, node, seen, parent = q[alive], node[alive], seen[alive], shared[node][alive]
            width = first[node + 1] - first[node]
            at = np.repeat(np.arange(len(q)), width)
            node = np.repeat(first[node], width) + np.arange(len(at)) - np.repeat(np.cumsum(width) - width, width)
            q, seen, parent = q[at], seen[at], parent[at]
        apart = np.bitwise_count(self.codes[q] ^ self.codes[node]).sum(axis=1)
        hit = (apart <= radius) & (q != node)
        return q[hit], node[hit]


def _roots(n: int, pairs: list[tuple[np.ndarray, np.ndarray]], root: np.ndarray | None = None) -> np.ndarray:
    """Smallest row reachable through the pairs."""
    root = np.arange(n) if root is None else root
    while True:
        before = root.copy()
        for a, b in pairs:
            low = np.minimum(root[a], root[b])
            np.minimum.at(root, a, low)
            np.minimum.at(root, b, low)
            np.minimum.at(root, before[a], low)
            np.minimum.at(root, before[b], low)
        root = root[root]
        if (root == before).all():
            return root


def spanning_links(codes: np.ndarray, group: np.ndarray, radius: int, large: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Links (as rows of the input) that connect within each group what lies within ``radius``.

    A large group is first gathered around pivots: rows near one pivot need no look at each other. Then only rows
    outside the group's largest cluster are searched.
    """
    tree = GrayTree(codes, group)
    n, size = len(codes), np.bincount(tree.group, minlength=int(group.max()) + 1)
    root, ask = np.arange(n), size[tree.group] > 1
    for g in np.flatnonzero(size > large).tolist():
        rows = np.flatnonzero(tree.group == g)
        free = np.ones(len(rows), bool)
        pairs = []
        for _ in range(64):
            if not free.any():
                break
            pivot = int(np.argmax(free))
            close = np.bitwise_count(tree.codes[rows] ^ tree.codes[rows[pivot]]).sum(axis=1) <= radius
            pairs.append((rows[close], np.full(int(close.sum()), rows[pivot])))
            free &= ~close
        root = _roots(n, pairs, root)
        names, counts = np.unique(root[rows], return_counts=True)
        ask[rows[root[rows] == names[np.argmax(counts)]]] = False
    for a, b in tree.near(radius, np.flatnonzero(ask)):
        root = _roots(n, [(a, b)], root)
    child = np.flatnonzero(root != np.arange(n))
    return tree.order[child], tree.order[root[child]]


def link_sorted(batches, radius: int, words: int, block: int = 200_000):
    """Runs ``spanning_links`` over batches sorted by ``mask`` and ``bits``, whole keys at a time."""
    held = []

    def flush(part: pa.Table):
        codes = np.column_stack([part.column(f"w{k}").to_numpy().view(np.uint64) for k in range(words)])
        mask, bits, name = (part.column(c).to_numpy() for c in ("mask", "bits", "name"))
        group = np.cumsum(np.r_[0, (mask[1:] != mask[:-1]) | (bits[1:] != bits[:-1])])
        a, b = spanning_links(codes, group, radius)
        return pa.RecordBatch.from_arrays([pa.array(name[a]), pa.array(name[b])], ["a", "b"])

    for batch in batches:
        held.append(batch)
        if sum(h.num_rows for h in held) >= block:
            rows = pa.Table.from_batches(held)
            mask, bits = rows.column("mask").to_numpy(), rows.column("bits").to_numpy()
            cut = int(np.flatnonzero((mask != mask[-1]) | (bits != bits[-1]))[-1]) + 1 if (mask[0], bits[0]) != (mask[-1], bits[-1]) else 0
            if cut:
                yield flush(rows.slice(0, cut))
                held = rows.slice(cut).combine_chunks().to_batches()
    if held and sum(h.num_rows for h in held):
        yield flush(pa.Table.from_batches(held))


def links(rows: DataFrame, keys: list[Column], radius: int, words: int = 1) -> DataFrame:
    """Edges ``a``, ``b`` of names whose codes lie within ``radius`` and agree in one of ``keys``.

    ``rows`` has ``name`` and the code's words ``w0``, ``w1``, ... as longs.
    """
    dealt = rows.select(
        "name", *[f"w{k}" for k in range(words)],
        F.posexplode(F.array(*keys)).alias("mask", "bits"),
    ).repartition("mask", "bits").sortWithinPartitions("mask", "bits")
    return dealt.mapInArrow(lambda batches: link_sorted(batches, radius, words), "a long, b long").distinct()


def exact_masks() -> list[int]:
    """Masks of which two 64-bit fingerprints at 2 or fewer differing bits share one: a third, and a third of the rest."""
    masks = []
    third = [range(0, 22), range(22, 43), range(43, 64)]
    for one in third:
        rest = [b for b in range(64) if b not in one]
        for k in range(3):
            masks.append(sum(1 << b for b in [*one, *rest[k::3]]))
    return masks


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``fingerprint`` (the 64 bits as a signed long) of every whole text."""

    def run(batches):
        for batch in batches:
            codes = [majority_bits(shingle_hashes(lower_words(t), size)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.array(codes, np.uint64).view(np.int64))], ["doc_id", "fingerprint"]
            )

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, fingerprint long")


def near_duplicates(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` of every document: the smallest id it reaches over
    links of fingerprints at 2 or fewer differing bits.

    Null, empty and wordless texts have fingerprint zero, linked like any other. Null ids are kept but name no component
    unless all its ids are null. Repeated rows are kept; other columns are left out.
    """
    rows = written(fingerprints(docs, size, id_col, text_col), "fingerprints")
    codes = rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first"))
    keys = [F.col("w0").bitwiseAND(F.lit(signed(m))) for m in exact_masks()]
    edges = links(codes.select(F.col("fingerprint").alias("name"), F.col("fingerprint").alias("w0")), keys, 2)
    roots = connected(edges)
    named = codes.join(roots, codes["fingerprint"] == roots["node"], "left").select(
        "fingerprint", "first", F.coalesce("root", "fingerprint").alias("root")
    )
    named = written(named, "roots")
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(smallest, "root").select("fingerprint", "component_id")
    return rows.join(named, "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def band_keys(hashes: np.ndarray, bands: int, rows: int = 5) -> np.ndarray:
    """A key for each band of ``rows`` least values of distinct hashes, each under a mixing of its own.

    Two sets share a key with probability J ** rows at Jaccard similarity J, however the change is spread.
    """
    rng = np.random.default_rng(5)
    odd = rng.integers(0, 2**64, (bands * rows, 1), np.uint64) | np.uint64(1)
    plus = rng.integers(0, 2**64, (bands * rows, 1), np.uint64)
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1 << 12):
        np.minimum(least, (hashes[at : at + (1 << 12)] * odd + plus).min(axis=1), out=least)
    return np.array([xxhash.xxh64_intdigest(band.tobytes(), seed=42) for band in least.reshape(bands, rows)], np.uint64)


def allowed_bits(similarity: float, bits: int = 128, slack: float = 2.0) -> int:
    """Differing bits of two sets of shingles at a Jaccard similarity, as the angle of equal-sized sets gives them, plus
    ``slack`` standard deviations, so that pairs at the limit are found."""
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(round(bits * share + slack * np.sqrt(bits * share * (1 - share))))


def tree_pairs(codes: np.ndarray, group: np.ndarray, radius: int, small: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows within ``radius`` that the Gray tree of their group finds: all pairs of a group of up to ``small`` rows;
    in a larger one each row with the first of up to 64 pivots that it is close to, so that pairs grow with the rows."""
    tree = GrayTree(codes, group)
    size = np.bincount(tree.group)[tree.group]
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for a, b in tree.near(radius, np.flatnonzero((size > 1) & (size <= small))):
        left.append(a[a < b])
        right.append(b[a < b])
    free = size > small
    for _ in range(64):
        rows = np.flatnonzero(free)
        pivots = rows[np.unique(tree.group[rows], return_index=True)[1]]
        if not len(pivots):
            break
        free[pivots] = False
        for a, b in tree.near(radius, pivots):
            a, b = a[free[b]], b[free[b]]
            left.append(a)
            right.append(b)
            free[b] = False
    return tree.order[np.concatenate(left)], tree.order[np.concatenate(right)]


def whole_keys(batches, flush, block: int):
    """Tables of whole (``mask``, ``bits``) keys, from sorted batches, each given to ``flush`` with its group numbers."""
    held, count = [], 0

    def made(part: pa.Table):
        mask, bits = part.column("mask").to_numpy(), part.column("bits").to_numpy()
        return flush(part, np.cumsum(np.r_[0, (mask[1:] != mask[:-1]) | (bits[1:] != bits[:-1])]))

    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= block:
            rows = pa.Table.from_batches(held)
            mask, bits = rows.column("mask").to_numpy(), rows.column("bits").to_numpy()
            other = np.flatnonzero((mask != mask[-1]) | (bits != bits[-1]))
            if len(other):
                cut = int(other[-1]) + 1
                yield made(rows.slice(0, cut))
                held = rows.slice(cut).combine_chunks().to_batches()
                count = len(rows) - cut
    if count:
        yield made(pa.Table.from_batches(held))


def alike(shared, a, b, similarity: float):
    """Whether sets of sizes ``a`` and ``b`` with ``shared`` members in common have the Jaccard similarity."""
    return shared >= similarity * (a + b - shared) - 1e-9


def set_links(sets: list[np.ndarray], root: np.ndarray, similarity: float) -> tuple[list[int], list[int]]:
    """Links by exact Jaccard similarity that connect one group's rows as all its links would; ``root`` tells what is
    connected already. Rows of the largest part are not compared with each other."""
    sizes = np.array([len(s) for s in sets])
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    _, part = np.unique(root, return_inverse=True)
    ask = np.flatnonzero(part != np.argmax(np.bincount(part)))
    mine, a, b = np.zeros(len(values), bool), [], []
    for row in ask.tolist():
        own = flat[starts[row] : starts[row] + sizes[row]]
        mine[own] = True
        shared = np.add.reduceat(mine[flat].astype(np.int64), starts)
        mine[own] = False
        met = np.flatnonzero(alike(shared, sizes[row], sizes, similarity) & (part != part[row]))
        for other in met[np.unique(part[met], return_index=True)[1]].tolist():
            a.append(row)
            b.append(other)
            part[part == part[other]] = part[row]
    return a, b


def shingle_sets(docs: DataFrame, key: str, size: int, text_col: str) -> DataFrame:
    """``key`` and ``set``, the bytes of the sorted distinct shingle hashes."""

    def run(batches):
        for batch in batches:
            sets = [np.unique(shingle_hashes(lower_words(t), size)).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(sets, pa.binary())], ["key", "set"])

    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")
    return docs.select(F.col(f"`{key}`").alias("key"), text).mapInArrow(lambda batches: releasing(run(batches)), "key long, set binary")


def exact_links(dealt: DataFrame, sets_of, radius: int, similarity: float) -> DataFrame:
    """Edges ``a``, ``b`` of exact Jaccard ``similarity`` that connect what all such pairs of one (``mask``, ``bits``) key do.

    ``dealt`` has ``mask``, ``bits``, ``name``, ``w0`` and ``w1``; ``sets_of`` gives ``key`` and ``set`` of a frame of names.
    Candidates within ``radius`` come first, from the Gray tree of each key, in numbers that grow with the rows, and are
    checked one by one. Crowded keys
    that these leave in several parts are then searched whole, part against part.
    """

    def candidates(batches):
        def flush(part: pa.Table, group: np.ndarray):
            codes = np.column_stack([part.column(c).to_numpy().view(np.uint64) for c in ("w0", "w1")])
            mask, bits, name = (part.column(c).to_numpy() for c in ("mask", "bits", "name"))
            a, b = tree_pairs(codes, group, radius)
            crowd = np.flatnonzero(np.bincount(group)[group] > 8)
            a, b = np.minimum(name[a], name[b]), np.maximum(name[a], name[b])
            return pa.RecordBatch.from_arrays(
                [pa.array(np.r_[np.full(len(a), -1), mask[crowd]].astype(np.int32)),
                 pa.array(np.r_[a, name[crowd]]), pa.array(np.r_[b, bits[crowd]])],
                ["mask", "a", "b"],
            )

        return releasing(whole_keys(batches, flush, 200_000))

    def checked(batches):
        for batch in batches:
            kept = []
            for left, right in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (left, right))
                kept.append(bool(alike(len(np.intersect1d(x, y, True)), len(x), len(y), similarity)))
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    def crowded(batches):
        def flush(part: pa.Table, group: np.ndarray):
            name, root = part.column("name").to_numpy(), part.column("root").to_numpy()
            sets, a, b = part.column("set"), [], []
            for start, end in zip(*(lambda o: (o, np.r_[o[1:], len(group)]))(np.flatnonzero(np.r_[True, group[1:] != group[:-1]])), strict=True):
                mine = [np.frombuffer(s.as_buffer(), np.uint64) for s in sets.slice(start, end - start)]
                left, right = set_links(mine, root[start:end], similarity)
                a.extend(name[start + np.array(left, int)].tolist())
                b.extend(name[start + np.array(right, int)].tolist())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        return releasing(whole_keys(batches, flush, 4_000))

    def by_key(rows):
        return rows.repartition("mask", "bits").sortWithinPartitions("mask", "bits", "name")

    found = written(by_key(dealt).mapInArrow(candidates, "mask int, a long, b long"), "candidates")
    pairs = found.where("mask < 0").select("a", "b").distinct()
    crowd = found.where("mask >= 0").select("mask", F.col("b").alias("bits"), F.col("a").alias("name"))
    names = pairs.select(F.explode(F.array("a", "b")).alias("key")).union(crowd.select("name")).distinct()
    sets = written(sets_of(names), "shingle-sets")
    both = pairs.join(sets.toDF("b", "sb"), "b").join(sets.toDF("a", "sa"), "a")
    edges = written(both.select("a", "b", "sa", "sb").mapInArrow(lambda batches: releasing(checked(batches)), "a long, b long"), "links")
    if crowd.isEmpty():
        return edges
    roots = connected(edges)
    parts = crowd.join(roots, crowd["name"] == roots["node"], "left").select("mask", "bits", "name", F.coalesce("root", "name").alias("root"))
    parts = written(parts, "parts")
    several = parts.groupBy("mask", "bits").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    asked = parts.join(several, ["mask", "bits"], "left_semi").join(sets.toDF("name", "set"), "name")
    return edges.union(by_key(asked).mapInArrow(crowded, "a long, b long"))


def similar_groups(docs: DataFrame, key: str, size: int = 5, similarity: float = 0.8, recall: float = 0.99, text_col: str = "text") -> DataFrame:
    """``key`` and ``group`` (the smallest key of its near-duplicate group) of every row of ``docs``.

    Two texts are near-duplicates if their sets of ``size``-word shingles have a Jaccard similarity of ``similarity`` or
    more. Bands of least shingle hashes deal them out: as many that a pair at the limit shares one with probability
    ``recall``, whether one passage, a tail or scattered words differ, and at any number of texts. The rows of a band's key
    stand under a Gray tree of 128-bit SimHash fingerprints of the distinct shingles, which finds the pairs that lie near.
    These are then checked on the sets, those of equal fingerprints too; only equal sets and checked links connect.
    ``key`` must be a unique long. Texts without words (null ones too) are copies of each other.
    """
    bands = int(np.ceil(np.log(1 - recall) / np.log(1 - similarity**5)))

    def run(batches):
        for batch in batches:
            codes, keys, names = [], [], []
            for text in batch.column("text").to_pylist():
                shingles = np.unique(shingle_hashes(lower_words(text), size))
                codes.append([majority_bits(shingles), majority_bits(_mixed(shingles))])
                keys.append(band_keys(shingles, bands).view(np.int64))
                names.append(xxhash.xxh3_128_digest(shingles.tobytes()))
            codes = np.array(codes, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), *[pa.array(codes[:, k].copy()) for k in range(2)], pa.array(keys, pa.list_(pa.int64())),
                 pa.array(names, pa.binary())],
                ["key", "w0", "w1", "bands", "same"],
            )

    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")
    rows = docs.select(F.col(f"`{key}`").alias("key"), text)
    rows = rows.mapInArrow(lambda batches: releasing(run(batches)), "key long, w0 long, w1 long, bands array<long>, same binary")
    rows = written(rows, "fingerprints")
    codes = written(rows.groupBy("same").agg(F.min("key").alias("name"), *[F.min_by(c, "key").alias(c) for c in ("w0", "w1", "bands")]), "codes")
    dealt = codes.select("name", "w0", "w1", F.posexplode("bands").alias("mask", "bits"))

    def sets_of(names: DataFrame) -> DataFrame:
        return shingle_sets(picked(docs, key, names.withColumnRenamed("key", key)), key, size, text_col)

    # Four deviations, so that hardly a pair at the limit is lost before its check.
    roots = connected(exact_links(dealt, sets_of, allowed_bits(similarity, slack=4.0), similarity))
    named = codes.join(roots, codes["name"] == roots["node"], "left").select("same", F.coalesce("root", "name").alias("group"))
    return rows.join(named, "same").select(F.col("key").alias(key), "group")
