"""Prefix trie of conversations, rolled up band by band.

A node is a distinct sequence of first turns. Its key is its depth and two 64-bit hashes of four running sums over the hashes
of its turns at their positions, so a node is found by one grouping whatever its depth. The conversation with the smallest id
below a node owns it; a conversation owns the lower end of its path, so (depth, owner) names a node too.

Subtree sums are taken in bands of ``BAND`` depths. A conversation adds up the nodes that it owns in a band and hands the
sums to the nodes of its path in that band: ``BAND`` rows at most. The first nodes of all bands then form a tree ``BAND``
times less deep, which is rolled up in the same way, and their completed totals are handed to the path in the band above.
Rounds grow with the logarithm of the depth, rows with the number of nodes times the rounds.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.common import written
from cohortloom.operators.ordered import ordered_rows, running_totals

BAND = 32
HEAD_TURNS = 5
CHUNK = 1 << 16
SUMS = ["s0", "s1", "s2", "s3"]


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``p`` (place from 1 on), ``mark`` (a digest of role and text) and ``chars`` (code points of the text).

    Turns are in the order of ``turn``, missing first, then of role and of the md5 of the text. A missing role or text is
    empty; rows without ``conv_id`` belong to no conversation and are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").isNotNull().alias("placed"), F.col("turn").cast("long").alias("turn"),
        role.alias("role"), F.md5(text.cast("binary")).alias("said"), F.length(text).cast("long").alias("chars"),
    ).filter("conv_id IS NOT NULL")
    out = ordered_rows(rows, ["conv_id"], ["placed", "turn", "role", "said"], ["chars"])
    mark = F.xxhash64(F.octet_length("role"), "role", "said")
    return out.select("conv_id", F.col("_rn").alias("p"), mark.alias("mark"), F.xxhash64(F.lit(1), "role", "said").alias("mark2"), "chars")


def spliced(turns: DataFrame, group: int = 100, choices: int = HEAD_TURNS + 1) -> DataFrame:
    """Conversations rebuilt on a shared start, as rows ``conv_id``, ``depth`` (from 1 on), ``mark``, ``mark2``, ``chars`` and
    ``length`` (turns of the rebuilt conversation); a rebuilt conversation without turns has one row of depth 0.

    The first h turns, h being the crc32 of the id modulo ``choices``, come from conversation id - id % ``group``, all of
    them if it has fewer and none if there is no such conversation. The conversation's own turns after its first h follow.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % choices
    heads = turns.filter((F.col("conv_id") % group == 0) & (F.col("p") < choices)).groupBy(F.col("conv_id").alias("donor")).agg(
        F.array_sort(F.collect_list(F.struct("p", "mark", "mark2", "chars"))).alias("head")  # fewer than ``choices`` turns
    )
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).withColumn("h", h)
    convs = convs.join(heads, F.col("conv_id") - F.col("conv_id") % group == F.col("donor"), "left")
    convs = convs.withColumn("head", F.when(F.col("head").isNotNull(), F.filter("head", lambda t: t["p"] <= F.col("h"))))
    given = F.coalesce(F.size("head"), F.lit(0))
    convs = convs.withColumn("given", F.when(F.col("head").isNull(), 0).otherwise(given))
    convs = convs.withColumn("length", (F.col("given") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("long"))
    own = turns.join(convs.select("conv_id", "h", "given", "length"), "conv_id").filter("p > h")
    own = own.select("conv_id", (F.col("p") - F.col("h") + F.col("given")).cast("long").alias("depth"), "mark", "mark2", "chars", "length")
    start = convs.select("conv_id", "length", F.inline("head")).selectExpr("conv_id", "p AS depth", "mark", "mark2", "chars", "length")
    none = convs.filter("length = 0").selectExpr("conv_id", "0L AS depth", "0L AS mark", "0L AS mark2", "0L AS chars", "length")
    return own.unionByName(start).unionByName(none)


def members(rows: DataFrame) -> DataFrame:
    """Every conversation under every node of its path: ``conv_id``, ``depth``, ``length``, ``chars``, and the hashes of the
    node (``a``, ``b``) and of its parent (``pa``, ``pb``). The root has its own rows of depth 0."""
    one, two = F.xxhash64("depth", "mark", "mark2"), F.xxhash64(F.lit(2), "depth", "mark2", "mark")
    low = F.lit(0xFFFFFFFF)
    marked = rows.withColumns({"one": one, "two": two}).withColumns({
        "v0": F.col("one").bitwiseAND(low), "v1": F.shiftrightunsigned("one", 32),
        "v2": F.col("two").bitwiseAND(low), "v3": F.shiftrightunsigned("two", 32),
    }).drop("one", "two", "mark", "mark2")
    summed = running_totals(marked.filter("depth > 0"), ["conv_id"], ["depth"], dict(zip(SUMS, ["v0", "v1", "v2", "v3"], strict=True)))
    sums, before = [F.col(s) for s in SUMS], [F.col(s) - F.col(f"v{i}") for i, s in enumerate(SUMS)]
    paths = summed.select(
        "conv_id", "depth", "length", "chars", F.xxhash64(*sums).alias("a"), F.xxhash64(F.lit(1), *sums).alias("b"),
        F.xxhash64(*before).alias("pa"), F.xxhash64(F.lit(1), *before).alias("pb"),
    )
    zeros = [F.lit(0).cast("long")] * len(SUMS)
    root = rows.filter("depth <= 1").select(
        "conv_id", F.lit(0).cast("long").alias("depth"), "length", F.lit(0).cast("long").alias("chars"), F.xxhash64(*zeros).alias("a"),
        F.xxhash64(F.lit(1), *zeros).alias("b"), F.lit(None).cast("long").alias("pa"), F.lit(None).cast("long").alias("pb"),
    )
    return paths.unionByName(root)


def _rolled(paths: DataFrame, values: list[str]) -> DataFrame:
    """Sums per node over the owned nodes below it in its band. ``paths``: ``conv_id``, ``band``, ``entries``."""
    def tail(name):
        later = F.filter("entries", lambda e: (e["depth"] >= F.col("at.depth")) & (e["owner"] == F.col("conv_id")) & e["inside"])
        return F.aggregate(later, F.lit(0).cast("long"), lambda acc, e: acc + e[name]).alias(name)

    spread = paths.withColumn("at", F.explode(F.filter("entries", lambda e: e["inside"])))
    spread = spread.select(F.col("at.depth").alias("depth"), F.col("at.owner").alias("owner"), *[tail(v) for v in values])
    return spread.groupBy("depth", "owner").agg(*[F.sum(v).alias(v) for v in values])


def subtree_sums(nodes: DataFrame, values: list[str], band: int = BAND) -> DataFrame:
    """Totals of ``values`` over every node's subtree: ``depth``, ``owner`` and the totals.

    ``nodes`` holds every conversation under every node of its path: ``conv_id``, ``depth`` (0 on), ``owner`` and, where the
    conversation owns the node, its values.
    """
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    # The first node of a band also ends the path of the band above.
    level = F.floor(F.col("depth") / band)
    bands = F.when((F.col("depth") % band == 0) & (F.col("depth") > 0), F.array(level - 1, level)).otherwise(F.array(level))
    entry = F.struct(
        "depth", "owner", (F.floor(F.col("depth") / band) == F.col("band")).alias("inside"), *[F.coalesce(v, F.lit(0)).cast("long").alias(v) for v in values]
    )
    paths = nodes.withColumn("band", F.explode(bands)).groupBy("conv_id", "band").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    paths = paths.filter(F.exists("entries", lambda e: e["owner"] == F.col("conv_id")))  # at most ``band`` + 1 entries
    if deepest < band:
        return _rolled(paths, values)
    paths = written(paths, "trie-paths")
    inner = written(_rolled(paths, values), "trie-inner")
    firsts = nodes.filter(F.col("depth") % band == 0).select("conv_id", "depth", "owner")
    mine = inner.select("depth", "owner", *[F.col(v) for v in values])
    firsts = firsts.join(mine, ["depth", "owner"]).select(
        "conv_id", (F.col("depth") / band).cast("long").alias("depth"), "owner", *[F.when(F.col("conv_id") == F.col("owner"), F.col(v)).alias(v) for v in values]
    )
    above = subtree_sums(written(firsts, "trie-firsts"), values, band)
    # A completed first node is handed to its owner's path in the band above; inside a band the sums are already there.
    done = above.filter("depth > 0").select(F.col("owner").alias("conv_id"), (F.col("depth") - 1).alias("band"), *values)
    handed = paths.join(done, ["conv_id", "band"]).select(F.explode(F.filter("entries", lambda e: e["inside"])).alias("at"), *values)
    handed = handed.select("at.depth", "at.owner", *values)
    return inner.unionByName(handed).groupBy("depth", "owner").agg(*[F.sum(v).alias(v) for v in values])


def _chunks(batches):
    """Ids of a node, sorted, as comma-joined texts of about ``CHUNK`` characters, with the first id of each."""
    for batch in batches:
        depth, owner, ids = (batch.column(n).to_pylist() for n in ("depth", "owner", "conv_id"))
        out, at = [], 0
        while at < len(ids):
            end, size = at, 0
            while end < len(ids) and depth[end] == depth[at] and owner[end] == owner[at] and size < CHUNK:
                size += len(str(ids[end])) + 1
                end += 1
            out.append((depth[at], owner[at], ids[at], ",".join(map(str, ids[at:end]))))
            at = end
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["depth", "owner", "first", "ids"])


def _digests(batches):
    """One SHA-256 per node over its chunks, which come in order; only one running digest is held."""
    key, digest, out = None, None, []
    for batch in batches:
        for depth, owner, ids in zip(*(batch.column(n).to_pylist() for n in ("depth", "owner", "ids")), strict=True):
            if (depth, owner) == key:
                digest.update(b"," + ids.encode())
                continue
            if key is not None:
                out.append((*key, digest.hexdigest()))
            key, digest = (depth, owner), hashlib.sha256(ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["depth", "owner", "ends_sha256"])
            out = []
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*key, digest.hexdigest())], ["depth", "owner", "ends_sha256"])


def id_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ascending, comma-joined ids of each node: ``depth``, ``owner``, ``ends_sha256``.

    Ids are sorted by range over all tasks and joined to chunks there; a node's chunks then meet in one task, since its digest
    is one run over them, and are read one by one.
    """
    ends = ends.repartitionByRange("depth", "owner", "conv_id").sortWithinPartitions("depth", "owner", "conv_id")
    chunks = ends.mapInArrow(_chunks, "depth long, owner long, first long, ids string")
    chunks = chunks.repartition("depth", "owner").sortWithinPartitions("depth", "owner", "first")
    return chunks.mapInArrow(_digests, "depth long, owner long, ends_sha256 string")


def trie(rows: DataFrame, band: int = BAND) -> DataFrame:
    """Every node of the trie of conversations given as ``spliced`` rows.

    Returns ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (missing for the root), ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens`` and ``ends_sha256``. No conversations give no nodes.
    """
    paths = written(members(written(rows, "trie-rows")), "trie-members")
    nodes = paths.groupBy("depth", "a", "b").agg(
        F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n_convs"), F.sum((F.col("length") == F.col("depth")).cast("long")).alias("n_ends"),
        F.max("chars").alias("chars"), F.max("pa").alias("pa"), F.max("pb").alias("pb"),
    )
    nodes = written(nodes, "trie-nodes")
    # A node's parent and its owner's path are joined by node key; crowded nodes near the root are split at run time.
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("owner").alias("parent_conv_id"))
    linked = nodes.join(parents, ["depth", "pa", "pb"], "left").select("depth", "owner", "n_convs", "parent_conv_id")
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count(F.lit(1)).alias("n_children"))
    children = children.join(nodes.select("depth", "a", "b", "owner"), ["depth", "a", "b"]).select("depth", "owner", "n_children")
    owned = F.col("conv_id") == F.col("owner")
    named = paths.select("conv_id", "depth", "a", "b", "length").join(nodes.select("depth", "a", "b", "owner", "n_convs", "n_ends", "chars"), ["depth", "a", "b"])
    named = written(named.select(
        "conv_id", "depth", "owner", "length", F.when(owned, (F.col("n_ends") == F.col("n_convs")).cast("long")).alias("n_leaves"),
        F.when(owned, (F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"),
    ), "trie-named")
    totals = subtree_sums(named.drop("length"), ["n_leaves", "saved_tokens"], band)
    digests = id_digests(named.filter("length = depth").select("depth", "owner", "conv_id"))
    key = ["depth", "owner"]
    out = linked.join(totals, key).join(children, key, "left").join(digests, key, "left")
    return out.select(
        F.col("owner").alias("conv_id"), "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame, band: int = BAND) -> DataFrame:
    """The trie of all conversations rebuilt by ``spliced``.

    Repeated rows are turns of their own; equal turn numbers follow role and text digest; extra columns are not read. Missing
    ids are left out, missing roles and texts are empty; an empty table gives no nodes. One conversation may hold any share of
    the rows: its turns are numbered and summed by ranges.
    """
    return trie(spliced(written(ordered_turns(conversations), "trie-turns")), band)
