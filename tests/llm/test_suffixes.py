"""Suffix sorting and removal of repeats against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest

from cohortloom.llm import suffix_array, suffix_dedup
from cohortloom.llm.suffix_array import PADDING, SuffixSorter, difference_cover

LENGTH = 50


@pytest.mark.parametrize("v", [3, 7, 16, 32, 64])
def test_cover_has_every_difference(v):
    cover = difference_cover(v)
    assert {(a - b) % v for a in cover for b in cover} == set(range(v))


@pytest.mark.parametrize("seed", range(24))
def test_suffix_order_and_classes(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(97, 97 + rng.choice([1, 2, 4]), rng.integers(60, 2500)).astype(np.uint8)
    if seed % 2:
        base = np.concatenate([base, base[: len(base) // 2], base[len(base) // 3 :]])
    text = np.concatenate([base, np.zeros(PADDING, np.uint8)])
    at, raw = rng.permutation(len(base) - LENGTH)[:800], text.tobytes()
    sorter = SuffixSorter(text, LENGTH)
    heads = [raw[p : p + LENGTH] for p in sorter.sort(at).tolist()]
    assert heads == sorted(heads)
    heads = [raw[p : p + LENGTH] for bucket in sorter.buckets(at, 100) for p in sorter.sort(bucket).tolist()]
    assert heads == sorted(heads)
    seen: dict[bytes, set] = {}
    for number, (ordered, tie) in enumerate(sorter.classes(at)):
        for p, k in zip(ordered.tolist(), tie.tolist(), strict=True):
            seen.setdefault(raw[p : p + LENGTH], set()).add((number, k))
    assert all(len(x) == 1 for x in seen.values()) and len(set().union(*seen.values())) == len(seen)


def brute(rows):
    order = lambda d: 2**63 if d is None else d
    least = {}
    for d, text in rows:
        raw = (text or "").encode()
        for i in range(len(raw) - LENGTH + 1):
            w = raw[i : i + LENGTH]
            least[w] = min(least.get(w, 2**64), order(d))
    out = []
    for d, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - LENGTH + 1):
            if least[raw[i : i + LENGTH]] < order(d):
                gone[i : i + LENGTH] = b"\1" * LENGTH
        spans = [i for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1])]
        out.append((d, len(raw), sum(gone), len(spans), bytes(b for b, g in zip(raw, gone, strict=True) if not g)))
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(2, 9)))
    passages = [" ".join(word() for _ in range(rng.randint(8, 40))) for _ in range(6)]
    rows = []
    for d in range(60):
        parts = [" ".join(word() for _ in range(rng.randint(0, 60)))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 2)
            parts += [p[a : a + rng.randint(30, 200)], word()]
        rows.append((d * 3 % 61, "".join(parts)))
    line = "the very common line that a good many of these documents have in common."
    rows += [(100 + k, word() + line + word()) for k in range(40)]
    rows += [(200, "ab" * 300), (201, "ab" * 40), (202, "x" * 500), (203, "x" * 49), (204, "x" * 50), (205, "ab" * 300), (None, "ab" * 60)]
    rows += [(None, line), (None, line), (7, line + "!"), (7, line + "!"), (206, None), (207, ""), (208, "x" * 200 + line * 3)]
    return rows


@pytest.mark.parametrize(("block", "hot"), [(2 << 20, 512), (700, 2)])
def test_removal_equals_brute_force(spark, monkeypatch, block, hot):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", block)
    rows = corpus()
    docs = spark.createDataFrame([(d, t, "k", 1) for d, t in rows], "doc_id long, text string, kept string, _x int")
    match = suffix_dedup._match_anchors
    if hot != 512:  # the workers import their own module, so the limit travels in the function

        def low(table):
            from cohortloom.llm import suffix_dedup as module

            module.HOT_BLOCKS = hot
            return match(table)

        monkeypatch.setattr(suffix_dedup, "_match_anchors", low)
    got = suffix_dedup.remove_repeats(docs, LENGTH).collect()
    assert len(got[0]) == 5 and got[0]["kept"] == "k"
    found = [
        (r.doc_id, r.repeats.n_bytes, sum(s.stop - s.start for s in r.repeats.spans), len(r.repeats.spans), bytes(r.repeats.kept)) for r in got
    ]
    assert sorted(found, key=repr) == brute(rows)


def test_slices_of_long_texts_give_the_same_windows():
    rng = np.random.default_rng(3)
    raw = rng.integers(97, 100, 40_000).astype(np.uint8).tobytes()
    whole, cut = ([], [])
    for out, size in ((whole, 1 << 20), (cut, 1000)):
        for parts in suffix_dedup.slices([b"", raw, b"short"], LENGTH, size):
            number, first, windows, place, gram = suffix_dedup.runs(parts, LENGTH)
            for n, f, w, p, g in zip(number, first, windows, place, gram, strict=True):
                out += [(n, f + k, f + p, g) for k in range(w)]
    assert {x[:3] for x in whole} == {x[:3] for x in cut} and {x[3] for x in whole} == {x[3] for x in cut}


def test_text_spans_keep_whole_characters(spark):
    passage = "éè" * 40
    docs = spark.createDataFrame([(1, "a" + passage + "b"), (2, "ü" + passage + "ö")], "doc_id long, text string")
    got = {r.doc_id: bytes(r.repeats.kept).decode() for r in suffix_dedup.remove_repeats(docs, LENGTH, as_text=True).collect()}
    assert got == {1: "a" + passage + "b", 2: "üö"}


def test_nothing_and_nulls(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.remove_repeats(none).count() == 0
    nulls = spark.createDataFrame([(None, None), (1, None)], "doc_id long, text string")
    assert [r.repeats.n_bytes for r in suffix_dedup.remove_repeats(nulls).collect()] == [0, 0]


def test_windows_without_an_equal_one_are_not_sorted():
    """Every window with an equal one stays, and few others do."""
    rng = np.random.default_rng(11)
    text = rng.integers(0, 256, 20_000).astype(np.uint8)
    text[9_000:9_300] = text[100:400]
    text = np.r_[text, np.zeros(suffix_array.PADDING, np.uint8)]
    kept = suffix_dedup._met_again(text, np.arange(19_900), 50)
    assert kept[100:351].all() and kept[9_000:9_251].all()
    assert kept.sum() < 4_000


def test_equal_segments_are_sorted_once(monkeypatch):
    """Of many copies of a segment in a bucket the suffix sorter gets one; the least id keeps it, all others lose it."""
    rng, n = np.random.default_rng(13), 200
    raw = rng.integers(0, 256, 70).astype(np.uint8)
    packed = suffix_dedup._pack(
        doc=np.arange(n)[::-1].copy(), number=np.arange(n, dtype=np.uint32), first=np.zeros(n, np.uint32), windows=np.full(n, 21, np.uint8),
        place=np.full(n, 25, np.uint8), home=np.zeros(n, np.uint32), text=np.tile(raw, n),
    )
    sorted_, classes = [], suffix_array.SuffixSorter.classes
    monkeypatch.setattr(suffix_array.SuffixSorter, "classes", lambda self, at: sorted_.append(len(at)) or classes(self, at))
    out = suffix_dedup._mark_suffixes(suffix_dedup._rows([(0, 2, packed)]), 50, 32)
    marks = suffix_dedup._together(out.column("payload").to_pylist())
    assert sum(sorted_) == 21
    assert marks["number"].tolist() == list(range(n - 1)) and set(marks["start"]) == {0} and set(marks["stop"]) == {70}


def test_zero_bytes_are_bytes(spark):
    """A text that goes on with zero bytes is longer than one that ends there."""
    rng = np.random.default_rng(17)
    stems = ["".join(map(chr, rng.integers(97, 123, 70))) for _ in range(20)]
    rows = [(10 * i + k, stem + "\0" * k) for i, stem in enumerate(stems) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: bytes(r.repeats.kept) for r in suffix_dedup.remove_repeats(docs, LENGTH).collect()}
    assert got == {i: text[-1:].encode() if i % 10 else text.encode() for i, text in rows}


def test_buckets_without_equal_windows_give_no_marks():
    """Two segments of one anchor whose windows all differ."""
    rng = np.random.default_rng(19)
    raw = rng.integers(0, 256, (2, 50)).astype(np.uint8)
    raw[1, 20:40] = raw[0, 20:40]
    packed = suffix_dedup._pack(
        doc=np.arange(2), number=np.arange(2, dtype=np.uint32), first=np.zeros(2, np.uint32), windows=np.ones(2, np.uint8),
        place=np.full(2, 20, np.uint8), home=np.zeros(2, np.uint32), text=raw.ravel(),
    )
    assert suffix_dedup._mark_suffixes(suffix_dedup._rows([(0, 2, packed)]), 50, 32).num_rows == 0
