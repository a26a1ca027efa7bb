"""Fingerprints, index and components against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from cohortloom.llm import simhash
from cohortloom.llm.components import connected


def plain_components(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_shared_masks_miss_no_link():
    masks = simhash.exact_masks()
    for i in range(64):
        for j in range(i, 64):
            assert any(not m >> i & 1 and not m >> j & 1 for m in masks)


def test_gray_rank_orders_codes():
    n = np.arange(1 << 12, dtype=np.uint64)
    gray = n ^ (n >> np.uint64(1))
    assert (simhash.gray_rank(gray[:, None])[:, 0] == n).all()
    rng = np.random.default_rng(2)
    two = rng.integers(0, 2**63, (50, 2), dtype=np.uint64)
    whole = [int(a) << 64 | int(b) for a, b in two]
    rank = []
    for code in whole:
        r = code
        for s in (1, 2, 4, 8, 16, 32, 64):
            r ^= r >> s
        rank.append(r)
    assert [int(a) << 64 | int(b) for a, b in simhash.gray_rank(two)] == rank


@pytest.mark.parametrize(("radius", "large"), [(2, 512), (2, 3), (9, 4), (0, 512)])
def test_spanning_links_equal_brute_force(radius, large):
    rng = np.random.default_rng(radius + large)
    centres = rng.integers(0, 2**63, (12, 2), dtype=np.uint64)
    codes = centres[rng.integers(0, 12, 300)].copy()
    for row in codes:
        for bit in rng.integers(0, 128, rng.integers(0, 5)):
            row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    group = np.sort(rng.integers(0, 5, 300))
    apart = np.bitwise_count(codes[:, None] ^ codes[None]).sum(axis=2)
    near = (apart <= radius) & (group[:, None] == group[None])
    a, b = simhash.spanning_links(codes, group, radius, large)
    assert plain_components(300, zip(a.tolist(), b.tolist(), strict=True)) == plain_components(300, zip(*map(list, np.nonzero(near)), strict=True))


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)]
    edges += [(500, k) for k in range(501, 540)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = plain_components(541, [e for e in edges if None not in e])
    assert got == {k: r for k, r in enumerate(want) if k != r}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def fingerprint(text, size):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    runs = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    codes = [xxhash.xxh64_intdigest(r, seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(c >> b & 1 for c in codes) > len(codes))


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcé") for _ in range(5)) for _ in range(200)]
    texts = [None, "", " \n\t ", "One", "one", "two words", "Two  words\n"]
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(30, 300))]
        for _ in range(4):
            copy = list(base)
            copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
        texts.append(" ".join(base))
    rows = [(i * 7 % 997, t, "x") for i, t in enumerate(texts)] + [(None, texts[10], "null id"), (3, texts[11], "again"), (3, texts[11], "again")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")).collect()
    codes = [fingerprint(t, 3) for _, t, _ in rows]
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if bin(codes[i] ^ codes[j]).count("1") <= 2]
    roots = plain_components(len(rows), linked)
    least = {}
    for (d, _, _), r in zip(rows, roots, strict=True):
        if d is not None:
            least[r] = min(d, least.get(r, d))
    want = [(d, f"{c:016x}", least.get(r)) for (d, _, _), c, r in zip(rows, codes, roots, strict=True)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_similar_groups_find_near_copies_and_leave_others(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    rows, truth = [], []
    for g in range(60):
        n = rng.choice([30, 120, 600])
        base = [rng.choice(words) for _ in range(n)]
        for k in range(5):
            copy = list(base)
            for _ in range(min(k, n // 60)):  # at most a sixtieth of the words: similarity over 0.8
                copy[rng.randrange(n)] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
            truth.append(g)
    groups = {r.key: r.group for r in simhash.similar_groups(spark.createDataFrame(rows, "key long, text string"), "key").collect()}
    assert [groups[k] for k in range(len(rows))] == [5 * g for g in truth]


def shingle_set(text, size=5):
    words = text.split()
    return {" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def jaccard(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return len(a & b) / len(a | b)


def changed_pairs(rng, words, kind, low, high, n):
    """Pairs of texts of 80-400 words whose five-word Jaccard lies in a range."""
    pairs = []
    while len(pairs) < n:
        base = [rng.choice(words) for _ in range(rng.randint(80, 400))]
        copy, share = list(base), (1 - (low + high) / 2) / (1 + (low + high) / 2)
        if kind == "passage":
            k = round(len(base) * share)
            at = rng.randrange(len(base) - k)
            copy[at : at + k] = [rng.choice(words) for _ in range(k)]
        elif kind == "tail":
            copy += [rng.choice(words) for _ in range(round(len(base) * (1 / ((low + high) / 2) - 1)))]
        else:
            for at in rng.sample(range(len(base)), max(1, round(len(base) * share / 5))):
                copy[at] = rng.choice(words)
        pair = " ".join(base), " ".join(copy)
        if low <= jaccard(*pair) < high:
            pairs.append(pair)
    return pairs


@pytest.mark.parametrize("others", [0, 4000])
@pytest.mark.parametrize("kind", ["passage", "tail", "scattered"])
def test_similar_groups_find_every_kind_of_change(spark, kind, others):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    pairs = changed_pairs(rng, words, kind, 0.80, 0.85, 300)
    texts = [t for pair in pairs for t in pair] + [" ".join(rng.choices(words, k=100)) for _ in range(others)]
    groups = {r.key: r.group for r in simhash.similar_groups(spark.createDataFrame(list(enumerate(texts)), "key long, text string"), "key").collect()}
    assert sum(groups[2 * k] == groups[2 * k + 1] for k in range(len(pairs))) >= 0.95 * len(pairs)


def test_similar_groups_join_nothing_below_the_similarity(spark):
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    pairs = changed_pairs(rng, words, "scattered", 0.70, 0.78, 100) + changed_pairs(rng, words, "tail", 0.70, 0.78, 100)
    texts = [t for pair in pairs for t in pair]
    groups = {r.key: r.group for r in simhash.similar_groups(spark.createDataFrame(list(enumerate(texts)), "key long, text string"), "key").collect()}
    assert [groups[k] for k in range(len(texts))] == list(range(len(texts)))


def test_similar_groups_of_one_template_are_those_of_exact_pairs(spark):
    rng = random.Random(13)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    base = [rng.choice(words) for _ in range(150)]
    texts = []
    for _ in range(250):
        copy = list(base)
        for at in rng.sample(range(150), rng.randint(1, 9)):
            copy[at] = rng.choice(words)
        texts.append(" ".join(copy))
    linked = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8]
    want = plain_components(len(texts), linked)
    groups = {r.key: r.group for r in simhash.similar_groups(spark.createDataFrame(list(enumerate(texts)), "key long, text string"), "key").collect()}
    assert all(want[k] == want[groups[k]] for k in range(len(texts)))
    assert len(set(want)) > 5 and sum(want[k] == groups[k] for k in range(len(texts))) >= 0.98 * len(texts)


def test_set_links_connect_as_all_pairs_do():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    sets = [np.unique(np.where(rng.random(60) < rng.uniform(0, 0.25), rng.integers(0, 2**63, 60, dtype=np.uint64), base)) for _ in range(120)]
    linked = [(i, j) for i in range(120) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))]
    done = linked[::3]
    a, b = simhash.set_links(sets, np.array(plain_components(120, done)), 0.8)
    assert set(zip(a, b, strict=True)) <= {p for i, j in linked for p in ((i, j), (j, i))}
    assert plain_components(120, done + list(zip(a, b, strict=True))) == plain_components(120, linked)


@pytest.mark.parametrize("most", [7, 10, 50, 100, 2_000_000])
def test_tree_asks_every_row_whatever_the_part(most):
    codes = np.zeros((10, 1), np.uint64)
    tree = simhash.GrayTree(codes, np.zeros(10, np.int64))
    pairs = [p for a, b in tree.near(0, np.arange(10), most) for p in zip(a.tolist(), b.tolist(), strict=True)]
    assert sorted(pairs) == [(i, j) for i in range(10) for j in range(10) if i != j]


def test_similar_groups_search_the_gray_tree():
    """Candidates come from the Gray tree of their key, and small groups lose no pair; pivots reach every row near them."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, (60, 2), np.uint64)
    codes = np.repeat(base, 5, axis=0)
    codes[:, 0] ^= np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)
    group = np.r_[np.repeat(np.arange(50), 5), np.full(50, 50)]
    a, b = simhash.tree_pairs(codes, group, 2)
    near = np.bitwise_count(codes[a] ^ codes[b]).sum(axis=1)
    assert (near <= 2).all() and (group[a] == group[b]).all()
    assert {(min(p), max(p)) for p in zip(a.tolist(), b.tolist(), strict=True) if group[p[0]] < 50} == {
        (5 * g + i, 5 * g + j) for g in range(50) for j in range(5) for i in range(j)
    }
    assert len(set(b[group[a] == 50].tolist())) == 40  # ten pivots reach the four others of their five
