"""Removal of byte strings that repeat across documents, by blockwise suffix sorting with a difference cover.

A byte goes if a string of ``length`` bytes that covers it also starts in a document with a smaller id. Only suffixes that
can have a partner are sorted:

1. **Anchors.** Of the short byte strings in a window of ``length`` bytes, the one with the least hash is the window's
   anchor. Equal windows have equal anchors, and neighbouring windows share one, so there is about one anchor for 16
   bytes. Map tasks send each anchor once for every block of documents it occurs in; an anchor of one document only
   drops out.
2. **Segments.** A block of documents finds the runs of windows of the anchors that are left and sends their bytes to
   the suffix bucket of the anchor. Equal segments of a block are sent once, by the smallest id; the others are
   covered by it. Anchors in very many blocks (a line that every document has) are dealt by window instead.
3. **Suffixes.** A bucket drops the windows whose hash no other has and sorts the suffixes that start the rest, one range
   of first bytes at a time, long ties by the ranks of a difference-cover sample (``suffix_array.py``). Those of equal
   segments stand in the order once, for the smallest id. Windows that agree lie together; those of larger ids are marked.
4. **Removal.** Marks return to their blocks and are united over the bytes of each document.

What travels is packed: one compressed row for many anchors, segments, marks or documents. Nothing is collected to the
driver but the total of bytes, and no step needs more of the corpus at once than a block or a bucket.
"""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.llm.common import release_memory, releasing, written
from cohortloom.llm.suffix_array import PADDING, SuffixSorter, words_at

#: Bytes of an anchor; the windows of one anchor differ in start by fewer than ``length - ANCHOR + 1``.
ANCHOR = 20
#: Text bytes in a block of documents, in what a map task packs at a time, and in one call of the hash.
BLOCK_BYTES, FLUSH_BYTES, SLICE_BYTES = 8 << 20, 8 << 20, 1 << 18
#: Blocks from which on an anchor's windows are dealt one by one.
HOT_BLOCKS = 512
_PACKED = "key long, kind int, payload binary"
_NO_ID = np.int64(2**63 - 1)


def _pack(**arrays: np.ndarray) -> bytes:
    """Arrays as byte planes, compressed."""
    head = [np.array([len(arrays)], "<i8").tobytes()]
    body = []
    for name, a in arrays.items():
        head.append(name.encode().ljust(8) + a.dtype.str.encode().ljust(8) + np.array([len(a)], "<i8").tobytes())
        body.append(np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(head + body))


def _unpack(payload: bytes) -> dict[str, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(payload)
    n, at, out = int(np.frombuffer(raw, "<i8", 1)[0]), 8, {}
    end = 8 + 24 * n
    for _ in range(n):
        name, kind, size = raw[at : at + 8].strip().decode(), np.dtype(raw[at + 8 : at + 16].strip().decode()), int(np.frombuffer(raw, "<i8", 1, at + 16)[0])
        at += 24
        plane = np.frombuffer(raw, np.uint8, size * kind.itemsize, end).reshape(kind.itemsize, size)
        out[name] = np.ascontiguousarray(plane.T).view(kind).reshape(size)
        end += size * kind.itemsize
    return out


def _together(payloads: list[bytes]) -> dict[str, np.ndarray]:
    parts = [_unpack(p) for p in payloads]
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    key, kind, payload = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"key": pa.array(key, pa.int64()), "kind": pa.array(kind, pa.int32()), "payload": pa.array(payload, pa.binary())})


def _stretches(values: np.ndarray) -> list[tuple[int, int, int]]:
    """Value, begin and end of each stretch of equal values."""
    opens = np.flatnonzero(np.r_[True, values[1:] != values[:-1]][: len(values)])
    return list(zip(values[opens].tolist(), opens.tolist(), [*opens[1:].tolist(), len(values)][: len(opens)], strict=True))


def _mix(words: list[np.ndarray]) -> np.ndarray:
    h = np.zeros(len(words[0]), np.uint64)
    for w in words:
        h = (h ^ w) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return h * np.uint64(0xD6E8FEB86659FD93)


def _dealt(values: np.ndarray, n: int) -> np.ndarray:
    """Places below ``n`` by the upper bits, so that sorted values are sorted by place."""
    return ((values >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def slices(raws: list[bytes], length: int, size: int = SLICE_BYTES):
    """Texts in groups of about ``size`` bytes: (number, offset, bytes) of each; a longer text comes in parts that
    overlap by ``length - 1``."""
    held, total = [], 0
    for number, raw in enumerate(raws):
        for offset in range(0, max(1, len(raw) - length + 1), 4 * size):
            part = raw if len(raw) <= 4 * size else raw[offset : offset + 4 * size + length - 1]
            held.append((number, offset, part))
            total += len(part)
            if total >= size:
                yield held
                held, total = [], 0
    if held:
        yield held


def runs(parts: list[tuple[int, int, bytes]], length: int):
    """Runs of windows with one anchor: text number, first window, windows, anchor's place less the first window's, and
    the anchor's hash."""
    data = np.frombuffer(b"".join(p[2] for p in parts) + bytes(PADDING), np.uint8)
    sizes = np.fromiter((len(p[2]) for p in parts), np.int64, len(parts))
    n = int(sizes.sum()) + 64
    word = lambda o: np.ndarray((n,), "<u8", data, offset=o, strides=(1,))
    gram = _mix([word(0), word(8), word(ANCHOR - 8)])
    low = np.uint64((1 << 24) - 1)
    key = (gram & ~low) | np.arange(n, dtype=np.uint64)
    span, width = length - ANCHOR + 1, 1
    least = key
    while 2 * width <= span:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    begins = np.cumsum(sizes) - sizes
    counts = np.maximum(sizes - length + 1, 0)
    of = np.repeat(np.arange(len(parts)), counts)
    at = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(begins, counts)
    anchor = (least[at] & low).astype(np.int64)
    first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (of[1:] != of[:-1])]) if len(of) else np.empty(0, np.int64)
    windows = np.diff(np.r_[first, len(of)])
    number = np.fromiter((p[0] for p in parts), np.int64, len(parts))[of[first]]
    offset = np.fromiter((p[1] for p in parts), np.int64, len(parts))[of[first]]
    # Anchors have small hashes; mixed again they spread evenly over the buckets.
    return number, at[first] - begins[of[first]] + offset, windows, anchor[first] - at[first], _mix([gram[anchor[first]]])


def _raw_texts(table: pa.Table, text_col: str) -> list[bytes]:
    return [(t or "").encode() for t in table.column(text_col).to_pylist()]


def _flushes(batches, text_col: str):
    """Batches as tables of about ``FLUSH_BYTES``."""
    held, size = [], 0
    for batch in batches:
        step = max(1, int(batch.num_rows * FLUSH_BYTES / 4 / max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            held.append(batch.slice(at, step))
            size += batch.nbytes * min(step, batch.num_rows - at) // max(1, batch.num_rows)
            if size >= FLUSH_BYTES:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _send_anchors(batches, length: int, buckets: int, text_col: str):
    for table in _flushes(batches, text_col):
        block = table.column("_block").to_numpy()
        texts, hashes = [], []
        for parts in slices(_raw_texts(table, text_col), length):
            number, _, _, _, gram = runs(parts, length)
            texts.append(number)
            hashes.append(gram)
        gram, number = np.concatenate(hashes), np.concatenate(texts)
        order = np.lexsort([number, gram])
        gram, number = gram[order], number[order]
        fresh = np.r_[True, (gram[1:] != gram[:-1]) | (number[1:] != number[:-1])][: len(gram)]
        gram, number = gram[fresh], number[fresh]
        opens = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]][: len(gram)])
        many = np.repeat(np.diff(np.r_[opens, len(gram)]) > 1, np.diff(np.r_[opens, len(gram)]))
        home = block[number]
        if many.any():  # one entry for each anchor and block
            order = np.lexsort([home, gram])
            gram, home, many = gram[order], home[order], many[order]
            fresh = np.r_[True, (gram[1:] != gram[:-1]) | (home[1:] != home[:-1])]
            gram, home, many = gram[fresh], home[fresh], many[fresh]
        place = _dealt(gram, buckets)
        cuts = np.searchsorted(place, np.arange(buckets + 1))
        rows = []
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            a, b = cuts[k], cuts[k + 1]
            code = home[a:b].astype(np.uint32) << np.uint32(1) | many[a:b]
            rows.append((k, 0, _pack(gram=np.diff(gram[a:b], prepend=np.uint64(0)), home=code)))
        yield from _rows(rows).to_batches()


def _match_anchors(table: pa.Table) -> pa.Table:
    """Of one bucket: the anchors of two documents or more, for each block that has them."""
    parts = [_unpack(p) for p in table.column("payload").to_pylist()]
    gram = np.concatenate([np.cumsum(p["gram"], dtype=np.uint64) for p in parts])
    home = np.concatenate([p["home"] for p in parts])
    order = np.argsort(gram, kind="stable")
    gram, home = gram[order], home[order]
    opens = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
    sizes = np.diff(np.r_[opens, len(gram)])
    again = (sizes > 1) | np.logical_or.reduceat((home & 1).astype(bool), opens)
    keep, hot = np.repeat(again, sizes), np.repeat(sizes > HOT_BLOCKS, sizes)
    gram, block, hot = gram[keep], home[keep] >> np.uint32(1), hot[keep]
    order = np.lexsort([gram, block])
    gram, block, hot = gram[order], block[order], hot[order]
    return _rows([(name, 1, _pack(gram=gram[a:b], hot=hot[a:b].astype(np.uint8))) for name, a, b in _stretches(block)])


def _send_texts(batches, text_col: str):
    """Documents of one block as one compressed row."""
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))
    for table in _flushes(batches, text_col):
        order = np.argsort(table.column("_block").to_numpy(), kind="stable")
        table = table.take(pa.array(order)).combine_chunks()
        rows = []
        for name, a, b in _stretches(table.column("_block").to_numpy()):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=options) as out:
                out.write_table(table.slice(a, b - a))
            rows.append((name, 0, sink.getvalue().to_pybytes()))
        yield from _rows(rows).to_batches()


def _block(table: pa.Table, id_col: str, text_col: str) -> tuple[pa.Table | None, list[bytes], np.ndarray]:
    """The documents of a block in a fixed order, their bytes and ids (the largest number for null)."""
    sent = [p for p, kind in zip(table.column("payload").to_pylist(), table.column("kind").to_pylist(), strict=True) if kind == 0]
    if not sent:
        return None, [], np.empty(0, np.int64)
    docs = pa.concat_tables([pa.ipc.open_stream(p).read_all() for p in sent])
    raws = _raw_texts(docs, text_col)
    ids = np.array([_NO_ID if i is None else i for i in docs.column(id_col).to_pylist()], np.int64)
    order = sorted(range(len(raws)), key=lambda k: (ids[k], raws[k]))
    return docs.take(pa.array(order, pa.int64())), [raws[k] for k in order], ids[order]


def _widest(length: int) -> int:
    """Bytes of the longest segment, in whole words."""
    return -(-(2 * length - ANCHOR) // 8) * 8


def _gather(joined: np.ndarray, at: np.ndarray, size: np.ndarray, most: int) -> np.ndarray:
    """Bytes from ``at`` on as rows of ``most`` bytes, zero beyond ``size``."""
    rows = np.lib.stride_tricks.sliding_window_view(joined, most)[at]
    rows[np.arange(most) >= size[:, None]] = 0
    return rows


def _first_equal(rows: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each row the one of the smallest id among those equal to it, or itself. Zeros beyond a row's size are none of
    its bytes."""
    words = np.column_stack([np.ascontiguousarray(rows).view("<u8"), sizes.astype(np.uint64)])
    code = _mix([words[:, k] for k in range(words.shape[1])])
    order = np.lexsort([ids, code])
    opens = np.flatnonzero(np.r_[True, code[order][1:] != code[order][:-1]][: len(order)])
    least = np.repeat(order[opens], np.diff(np.r_[opens, len(order)]))
    equal = (words[order] == words[least]).all(axis=1)
    first = np.arange(len(rows))
    first[order[equal]] = least[equal]
    return first


def _send_segments(table: pa.Table, length: int, buckets: int, id_col: str, text_col: str) -> pa.Table:
    """Of one block: segments for their buckets (kind 2) and marks that need none (kind 1, for the block itself)."""
    key = table.column("key")[0].as_py()
    _, raws, ids = _block(table, id_col, text_col)
    replies = [p for p, kind in zip(table.column("payload").to_pylist(), table.column("kind").to_pylist(), strict=True) if kind == 1]
    if not raws or not replies:
        return _rows([])
    wanted = _together(replies)
    order = np.argsort(wanted["gram"])
    gram, hot = wanted["gram"][order], wanted["hot"][order].astype(bool)
    found = []
    for parts in slices(raws, length):
        number, first, windows, place, code = runs(parts, length)
        at = np.minimum(np.searchsorted(gram, code), len(gram) - 1)
        hit = gram[at] == code
        found.append((number[hit], first[hit], windows[hit], place[hit], code[hit], hot[at[hit]]))
    number, first, windows, place, code, is_hot = map(np.concatenate, zip(*found, strict=True))
    joined = np.frombuffer(b"".join(raws) + bytes(PADDING), np.uint8)
    begins = np.cumsum([0, *map(len, raws)])[:-1]
    most = _widest(length)
    out, marks, again = [], [], []

    def collapsed(number, first, windows, place, code):
        """Segments by the smallest id among equal ones, a bounded part at a time, with their bytes."""
        by_code = np.argsort(code, kind="stable")
        for a in range(0, len(number), 1 << 16):
            b = by_code[a : a + (1 << 16)]
            sizes = windows[b] + length - 1
            rows = _gather(joined, begins[number[b]] + first[b], sizes, most)
            covered = ids[number[b]] > ids[number[b]][_first_equal(rows, sizes, ids[number[b]])]
            own = ~covered
            marks.append((number[b][covered], first[b][covered], first[b][covered] + sizes[covered]))
            b, sizes, rows = b[own], sizes[own], rows[own]
            yield b, sizes, rows, number[b], first[b], windows[b], place[b], code[b]

    def send(sizes, rows, number, first, windows, place, spread):
        goes = _dealt(spread, buckets)
        order = np.argsort(goes, kind="stable")
        sizes, rows, number, first, windows, place = (x[order] for x in (sizes, rows, number, first, windows, place))
        inside = np.arange(most) < sizes[:, None]
        for k, a, b in _stretches(goes[order]):
            out.append((k, 2, _pack(
                doc=ids[number[a:b]], number=number[a:b].astype(np.uint32), first=first[a:b].astype(np.uint32),
                windows=windows[a:b].astype(np.uint8), place=place[a:b].astype(np.uint8), home=np.full(b - a, key, np.uint32),
                text=rows[a:b][inside[a:b]],
            )))

    for at, sizes, rows, *seg in collapsed(number, first, windows, place, code):
        cold = ~is_hot[at]
        send(sizes[cold], rows[cold], *[x[cold] for x in seg])
        again.append([x[~cold] for x in seg])
    # Segments of hot anchors are cut into their windows, which are dealt by their bytes.
    number, first, windows, place, code = map(np.concatenate, zip(*again, strict=True)) if again else (np.empty(0, np.int64),) * 5
    cut = np.repeat(np.arange(len(number)), windows)
    step = np.arange(len(cut)) - np.repeat(np.cumsum(windows) - windows, windows)
    for _, sizes, rows, number, first, windows, place, _ in collapsed(
        number[cut], first[cut] + step, np.ones(len(cut), np.int64), place[cut] - step, code[cut]
    ):
        words = np.ascontiguousarray(rows).view("<u8")
        send(sizes, rows, number, first, windows, place, _mix([words[:, k] for k in range(words.shape[1])]))
    number, start, stop = map(np.concatenate, zip(*marks, strict=True)) if marks else (np.empty(0, np.int64),) * 3
    if len(number):
        out.append((key, 1, _pack(number=number.astype(np.uint32), start=start.astype(np.uint32), stop=stop.astype(np.uint32))))
    return _rows(out)


def _met_again(text: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Which windows may have an equal one: those whose hash shares its place in a table with another's. No equal windows
    are lost; the others need no sorting."""
    bits = max(10, int(8 * len(at)).bit_length())
    code = _mix([words_at(text, at, k) for k in (*range(0, length - 8, 8), length - 8)]) >> np.uint64(64 - bits)
    return (np.bincount(code.astype(np.int64), minlength=1 << bits) > 1)[code]


def _mark_suffixes(table: pa.Table, length: int, v: int) -> pa.Table:
    """Of one suffix bucket: marks for windows that also start in a smaller id's document, by block."""
    if table.column("kind")[0].as_py() == 1:  # marks that are made already
        return table
    segs = _together(table.column("payload").to_pylist())
    windows, place = segs["windows"].astype(np.int64), segs["place"].astype(np.int64)
    sizes, most = windows + length - 1, _widest(length)
    rows = _gather(np.r_[segs["text"], np.zeros(most, np.uint8)], np.cumsum(sizes) - sizes, sizes, most)
    first = _first_equal(rows, sizes, segs["doc"])  # equal segments are sorted once, and share what their suffixes meet
    own, several = first == np.arange(len(first)), np.bincount(first, minlength=len(first)) > 1
    slots = np.where(own, (sizes + 2 * v - 1) // v * v, 0)
    base = np.cumsum(slots) - slots + (-place) % v  # anchors at multiples of the period: equal windows, equal residues
    text = np.zeros(int(slots.sum()) + v + PADDING, np.uint8)
    seg_of = np.repeat(np.arange(len(windows)), slots // v)
    inner = np.arange(most) < (sizes * own)[:, None]
    text[(base[:, None] + np.arange(most))[inner]] = rows[inner]
    of = np.repeat(np.arange(len(windows)), windows)
    step = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
    met = np.full(len(of), _NO_ID)
    start_of = np.cumsum(windows) - windows
    at = (base[of] + step)[own[of]]
    at = at[_met_again(text, at, length) | several[of[own[of]]]]
    if not len(at):  # an anchor in common, but no window
        return _rows([])
    near = np.zeros(len(text), np.int8)
    near[at] = 1
    near[at + v] -= 1
    for ordered, tie in SuffixSorter(text, length, v, np.cumsum(near, dtype=np.int8) > 0).classes(at):
        seg = seg_of[ordered // v]
        doc = segs["doc"][seg]
        opens = np.flatnonzero(np.r_[True, tie[1:] != tie[:-1]])
        met[start_of[seg] + ordered - base[seg]] = np.minimum.reduceat(doc, opens)[tie]
    on = np.flatnonzero(met[start_of[first[of]] + step] < segs["doc"][of])
    if not len(on):
        return _rows([])
    begin = np.r_[True, (np.diff(on) > 1) | (of[on][1:] != of[on][:-1])]
    end = np.r_[begin[1:], True]
    seg = of[on[begin]]
    start = segs["first"][seg] + step[on[begin]].astype(np.uint32)
    stop = segs["first"][seg] + step[on[end]].astype(np.uint32) + np.uint32(length)
    home, number = segs["home"][seg], segs["number"][seg]
    order = np.argsort(home, kind="stable")
    number, start, stop = number[order], start[order], stop[order]
    return _rows([(name, 1, _pack(number=number[a:b], start=start[a:b], stop=stop[a:b])) for name, a, b in _stretches(home[order])])


def whole_characters(raw: bytes, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans drawn in to character limits, so that what stays is text; spans without a whole character go."""
    data = np.frombuffer(raw + b" ", np.uint8)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    starts = lead[np.searchsorted(lead, starts)]
    stops = lead[np.searchsorted(lead, stops, side="right") - 1]
    return starts[starts < stops], stops[starts < stops]


def _remove(table: pa.Table, id_col: str, text_col: str, into: str, as_text: bool) -> pa.Table:
    """Of one block: the documents with ``into``, from texts (kind 0) and marks (kind 1)."""
    docs, raws, _ = _block(table, id_col, text_col)
    marks = [p for p, kind in zip(table.column("payload").to_pylist(), table.column("kind").to_pylist(), strict=True) if kind == 1]
    sizes = np.array([len(r) for r in raws], np.int64)
    begins = np.cumsum(sizes + 1) - sizes - 1  # a byte between texts keeps their spans apart
    cover = np.zeros(int((sizes + 1).sum()) + 1, np.int32)
    for p in marks:
        m = _unpack(p)
        np.add.at(cover, begins[m["number"]] + m["start"], 1)
        np.add.at(cover, begins[m["number"]] + m["stop"], -1)
    gone = np.cumsum(cover) > 0
    edge = np.diff(gone.astype(np.int8), prepend=np.int8(0))
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    cuts = np.searchsorted(starts, [*begins, begins[-1] + sizes[-1] + 1])
    spans, kept = [], []
    for k, raw in enumerate(raws):
        a, b = starts[cuts[k] : cuts[k + 1]] - begins[k], stops[cuts[k] : cuts[k + 1]] - begins[k]
        if as_text and len(a):
            a, b = whole_characters(raw, a, b)
        spans.append([{"start": int(x), "stop": int(y)} for x, y in zip(a, b, strict=True)])
        kept.append(b"".join(raw[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(raw)], strict=True)))
    kind = pa.struct([("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), ("kept", pa.binary())])
    value = pa.array([{"n_bytes": int(n), "spans": s, "kept": x} for n, s, x in zip(sizes, spans, kept, strict=True)], kind)
    docs = docs.drop_columns(["_block"] + [c for c in docs.column_names if c == into])
    return docs.append_column(into, value)


def _in_worker(step, *args):
    """``step`` as a function of one group, whose memory is given back after it."""

    def run(table: pa.Table) -> pa.Table:
        out = step(table, *args)
        release_memory()
        return out

    return run


def _release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of finished steps, whose results are written."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remove_repeats(
    docs: DataFrame, length: int = 50, period: int = 32, id_col: str = "doc_id", text_col: str = "text", into: str = "repeats",
    as_text: bool = False,
) -> DataFrame:
    """``docs`` with the column ``into``: a struct of ``n_bytes``, ``spans`` (``start`` and ``stop`` in bytes of each
    maximal removed run) and ``kept`` (the remaining bytes). With ``as_text`` spans are drawn in to whole characters.

    Matches never cross documents and are judged on the input. A null text is empty. Rows with a null id come after all
    others and don't count for each other; rows that repeat an id don't count for each other either. Texts shorter than
    ``length`` keep all bytes; an empty table gives an empty result. A column named ``into`` is replaced. Ids must be
    whole numbers.
    """
    if length < ANCHOR + 8 or 2 * length - ANCHOR > 255:
        raise ValueError("length must lie between 28 and 137")
    spark = docs.sparkSession
    docs = docs.withColumn(id_col, F.col(f"`{id_col}`").cast("long"))
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    blocks = 1 + total // BLOCK_BYTES
    buckets = 6 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    home: Column = F.pmod(F.xxhash64(F.col(f"`{id_col}`"), text), F.lit(blocks)).cast("long").alias("_block")
    bare = docs.select(F.col(f"`{id_col}`"), text.alias(text_col), home)

    def texts(rows: DataFrame) -> DataFrame:
        return rows.mapInArrow(lambda b: releasing(_send_texts(b, text_col)), _PACKED)

    anchors = bare.select(text_col, "_block").mapInArrow(lambda b: releasing(_send_anchors(b, length, buckets, text_col)), _PACKED)
    again = written(anchors.groupBy("key").applyInArrow(_in_worker(_match_anchors), _PACKED), "anchors")
    _release(spark)
    met = texts(bare).union(again).groupBy("key")
    segments = met.applyInArrow(_in_worker(_send_segments, length, buckets, id_col, text_col), _PACKED)
    marks = segments.groupBy("kind", "key").applyInArrow(_in_worker(_mark_suffixes, length, period), _PACKED)
    marks = written(marks, "marks")
    _release(spark)
    whole = docs.select("*", home)
    fields = [f for f in docs.schema.fields if f.name != into]
    kind = T.StructType([
        T.StructField("n_bytes", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))),
        T.StructField("kept", T.BinaryType()),
    ])
    schema = T.StructType([*fields, T.StructField(into, kind)])
    return texts(whole).union(marks).groupBy("key").applyInArrow(_in_worker(_remove, id_col, text_col, into, as_text), schema)
