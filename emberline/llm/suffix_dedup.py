"""Removal of bytes in long strings that occur earlier in the corpus.

A string of SPAN bytes is judged by its window's anchor: the gram of GRAM bytes
with the least hash in it. Equal windows have equal anchors at equal places,
so that windows with one anchor form a segment, and only segments of one
anchor can hold equal windows.

1. Each batch of texts finds its segments in numpy. Segments that are whole
   copies of an earlier one in the batch are compared and decided there; of
   the others, two hashes and a place go to their anchor's task. Segments of
   very common anchors are cut into windows, each its own key, so that no
   anchor's task gets more than a bounded share.
2. There, a segment with the hashes of an earlier one is taken for a copy of
   it. The first segment of each content goes on if its anchor also has others
   of other content.
3. Copies in a row become one run, and the bytes of its earlier place are
   fetched. Of the segments that go on, the bytes are fetched as well and all
   their windows are suffix-sorted, those of one anchor together: a mergesort
   whose comparisons find the common extension of two suffixes by binary
   search over prefix polynomial hashes. Neighbours with a common extension of
   SPAN bytes are compared byte by byte.
4. Each text gathers its runs. It drops a run only if its own bytes there are
   those of the earlier place, or have the hash of bytes that were compared:
   a collision of hashes can leave a repeat in place, but never removes
   anything else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, pieces_of, table, text_or_empty

SPAN, GRAM = 100, 32
#: Grams in a window, and so windows that may share an anchor.
REACH = SPAN - GRAM + 1
#: Bytes of text that are looked at together.
BATCH = 1 << 20
#: Anchors with more segments than this have them cut into blocks of windows that are dealt by the bytes all windows of a block share.
HOT, BLOCK = 256, 8
#: Segments that are sorted together, unless one anchor has more.
SORTED_TOGETHER = 6_000
#: Bytes of a slice of a text, by which the bytes of segments and runs are fetched.
SLICE = 1 << 16
#: One text in so many is looked at to find very common anchors, which decides where their windows are dealt, never what is removed.
SAMPLED = 16
#: An anchor with one segment in so many of that sample, and with LEAST_COMMON at least, is very common; so there are no more than COMMON of them.
COMMON, LEAST_COMMON = 1 << 16, 64
#: Bits of a second hash that, with one of 64 bits, tell texts of one doc_id apart.
SUB_BITS = 18
_SEED = 42

U = np.uint64
_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit numbers (an invertible map)."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


_BYTE = _mixed(np.arange(1, 257, dtype=U) * U(0xA0761D6478BD642F))
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 to base**(n - 1) modulo 2**64, kept."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        steps = np.full(max(n, 1 << 16), base, dtype=U)
        steps[0] = 1
        known = _POWERS[base] = np.cumprod(steps, dtype=U)
    return known[:n]


class PrefixHash:
    """Polynomial hashes modulo 2**64, over scrambled bytes, of any part of a buffer."""

    def __init__(self, data: np.ndarray):
        self.data = data
        self.power = _powers(_MULTIPLIER, len(data) + 1)
        self.sums = np.r_[U(0), np.cumsum(_BYTE[data] * self.power[:-1], dtype=U)]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of parts, the same wherever a part lies."""
        return (self.sums[end] - self.sums[start]) * _powers(_INVERSE, len(self.data) + 1)[start]

    def same(self, a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
        """Whether n bytes from a on and from b on have equal hashes."""
        return (self.sums[a + n] - self.sums[a]) * self.power[b] == (self.sums[b + n] - self.sums[b]) * self.power[a]

    def common(self, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        """Length of the common extension of the suffixes at a and b, up to `most` bytes, by binary search."""
        n = np.zeros(len(a), dtype=np.int64)
        step = 1 << (most.bit_length() - 1)
        while step:
            fits = n + step <= most
            here = np.where(fits, n, 0)
            n = np.where(fits & self.same(a + here, b + here, step), n + step, n)
            step >>= 1
        return n


def segments(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> dict[str, np.ndarray]:
    """Segments of the texts that lie in data at `first` with `size` bytes, in order.

    text (its number), start (the first window's place in the text), windows
    (how many), off (the anchor's place in the first window), anchor and content
    (hashes).
    """
    n = len(data)
    none = np.empty(0, dtype=np.int64)
    if n < SPAN:
        return dict.fromkeys(("text", "start", "windows", "off"), none) | dict.fromkeys(("anchor", "content"), none.astype(U))
    prefix = PrefixHash(data)
    at = np.arange(n - GRAM + 1)
    gram = _mixed(prefix.of(at, at + GRAM))
    low = (gram & U(0xFFFFFFFF00000000)) | at.astype(U)  # ties go to the left
    width = 1
    while 2 * width <= REACH:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < REACH:
        low = np.minimum(low[: len(low) - (REACH - width)], low[REACH - width :])
    where = (low & U(0xFFFFFFFF)).astype(np.int64)
    text_of = np.repeat(np.arange(len(size)), size)
    last = (first + size)[text_of[: len(where)]] - SPAN
    real = np.flatnonzero(np.arange(len(where)) <= last)
    place = where[real]
    new = np.r_[True, (place[1:] != place[:-1]) | (real[1:] != real[:-1] + 1)] if len(real) else np.empty(0, dtype=bool)
    begin = real[new]
    windows = np.diff(np.r_[np.flatnonzero(new), len(real)])
    anchor = place[new]
    text = text_of[begin]
    off = anchor - begin
    content = _mixed(prefix.of(begin, begin + windows + SPAN - 1) + (off * 128 + windows).astype(U) * U(_MULTIPLIER))
    return {"text": text, "start": begin - first[text], "windows": windows, "off": off, "anchor": gram[anchor], "content": content}


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs that ranges cover; ranges that touch join."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.r_[True, start[1:] > end[:-1]]
    return start[new], end[np.r_[np.flatnonzero(new)[1:] - 1, len(end) - 1]]


def _units(raw: list[bytes], budget: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts in slices of about `budget` windows that overlap by SPAN - 1 bytes, and slices in groups of about that size.

    Each group is its bytes, and by slice the text's number, its first byte's
    place in the text and its size; memory does not follow the texts' lengths.
    """
    held, count = [], 0
    for t, x in enumerate(raw):
        for base in range(0, max(len(x) - SPAN + 1, 0), budget):
            held.append((t, base, x[base : base + budget + SPAN - 1]))
            count += len(held[-1][2])
            if count >= budget:
                yield _group(held)
                held, count = [], 0
    if held:
        yield _group(held)


def _group(held: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer(b"".join(x for _, _, x in held), dtype=np.uint8)
    text, base, size = (np.array(v, dtype=np.int64) for v in zip(*((t, b, len(x)) for t, b, x in held), strict=True))
    return data, text, base, size


def _ramp(size: np.ndarray) -> np.ndarray:
    """0 to size - 1 for each size, one after the other."""
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)


def _same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether size bytes (one at least) from a on and from b on are equal, for each pair."""
    out = np.empty(len(a), dtype=bool)
    for i in range(0, len(a), 1 << 13):
        x, y, n = a[i : i + (1 << 13)], b[i : i + (1 << 13)], size[i : i + (1 << 13)]
        if not len(x):
            break
        step = _ramp(n)
        out[i : i + (1 << 13)] = np.logical_and.reduceat(data[np.repeat(x, n) + step] == data[np.repeat(y, n) + step], np.cumsum(n) - n)
    return out


def _windows_apart(s: dict[str, np.ndarray], first: np.ndarray, prefix: PrefixHash, common: np.ndarray) -> dict[str, np.ndarray]:
    """Segments, those of common anchors (sorted) cut into windows whose key is the window's own hash."""
    hot = np.isin(s["anchor"], common)
    if not hot.any():
        return s
    own = {k: v[hot] for k, v in s.items()}
    n = own["windows"]
    j = _ramp(n)
    text, start, off = np.repeat(own["text"], n), np.repeat(own["start"], n) + j, np.repeat(own["off"], n) - j
    at = first[text] + start
    content = _mixed(prefix.of(at, at + SPAN) + off.astype(U) * U(_MULTIPLIER))
    cut_up = {"text": text, "start": start, "windows": np.ones(len(j), dtype=np.int64), "off": off, "anchor": _mixed(content ^ U(_MULTIPLIER)), "content": content}
    return {k: np.concatenate([v[~hot], cut_up[k]]) for k, v in s.items()}


def common_anchors(keyed: DataFrame) -> np.ndarray:
    """Very common anchors, sorted: COMMON at most, of a sample of the texts; they only decide how segments are dealt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for whole in batches for b in pieces_of(whole, "raw", budget=BATCH)):
            for data, text, _, size in _units([x.as_py() for x in batch.column(0)], BATCH):
                s = segments(data, np.cumsum(size) - size, size)
                pairs = np.unique(np.stack([s["anchor"], s["content"], text[s["text"]].astype(U)]), axis=1)[0]
                anchor, n = np.unique(pairs, return_counts=True)
                several = n > 1
                yield pa.record_batch([pa.array([None, *anchor[several].view(np.int64).tolist()], pa.int64()), pa.array([int(n.sum()), *n[several].tolist()], pa.int64())], names=["anchor", "n"])

    some = keyed.where(F.pmod(F.xxhash64("doc", "tag"), F.lit(SAMPLED)) == 0).select("raw")
    counted = cut(some.mapInArrow(run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where(f"anchor IS NULL OR n >= {LEAST_COMMON}"), "anchors")
    total = counted.where("anchor IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = counted.where(F.col("anchor").isNotNull() & (F.col("n") > total / COMMON)).select("anchor")  # under COMMON rows, as they hold over total / COMMON each
    return np.sort(np.array([r.anchor for r in found.collect()], dtype=np.int64).view(U))


def _packed(sub: np.ndarray, place: np.ndarray, off: np.ndarray, windows: np.ndarray) -> np.ndarray:
    return (sub << 45) | (place << 14) | (off << 7) | (windows - 1)


ANCHORS = "anchor long, content long, doc long, tag long, packed long"


def _mark(raw) -> int:
    h = xxhash.xxh64_intdigest(raw, _SEED)
    return h - (1 << 64) if h >> 63 else h


def find_segments(keyed: DataFrame, common: np.ndarray) -> DataFrame:
    """Segments of texts (doc, tag, sub, raw) as anchor, content, doc, tag and packed (sub, anchor's place, off, windows).

    Runs that a batch has decided itself come as packed = -1 - sub, with start
    and end in content and a hash of their bytes in anchor.
    """
    shipped = keyed.sparkSession.sparkContext.broadcast(common)  # COMMON numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for whole in batches for b in pieces_of(whole, "raw", budget=BATCH)):
            raw = [x.as_py() for x in batch.column(3)]
            docs, tags, subs = (batch.column(i).to_numpy().astype(np.int64) for i in range(3))
            for data, of, base, size in _units(raw, BATCH):
                first = np.cumsum(size) - size
                s = segments(data, first, size)
                if len(shipped.value):
                    s = _windows_apart(s, first, PrefixHash(data), shipped.value)
                unit, windows = s["text"], s["windows"]
                text = of[unit]
                start = base[unit] + s["start"]
                packed = _packed(subs[text], start + s["off"], s["off"], windows)
                order = np.lexsort((packed, tags[text], docs[text], s["content"], s["anchor"]))
                a, c, p, t = s["anchor"][order], s["content"][order], packed[order], text[order]
                at, long = first[unit[order]] + s["start"][order], windows[order] + SPAN - 1
                head = np.r_[True, (a[1:] != a[:-1]) | (c[1:] != c[:-1])] if len(a) else np.empty(0, dtype=bool)
                own = np.flatnonzero(head)[np.cumsum(head) - 1]
                # the first of each content goes on; a row of the same place (of a repeated row) says nothing new
                again = np.flatnonzero(~head & ((docs[t] != docs[t[own]]) | (tags[t] != tags[t[own]]) | (p >> 14 != p[own] >> 14)))
                true = (long[again] == long[own[again]]) & _same_bytes(data, at[again], at[own[again]], np.minimum(long[again], long[own[again]]))
                stays = np.sort(np.r_[np.flatnonzero(head), again[~true]])
                out = [[a[stays].view(np.int64), c[stays].view(np.int64), docs[t[stays]], tags[t[stays]], p[stays]]]
                rows = again[true]
                if len(rows):
                    # runs in the slices' bytes; a gap between slices keeps them apart
                    u = unit[order][rows]
                    b, e = merged(at[rows] + u, at[rows] + long[rows] + u)
                    u = np.searchsorted(first + np.arange(len(first)), b, side="right") - 1
                    b, e = b - u, e - u
                    view = memoryview(data)
                    marks = np.array([_mark(view[x:y]) for x, y in zip(b.tolist(), e.tolist(), strict=True)], dtype=np.int64)
                    shift = base[u] - first[u]
                    out.append([marks, ((b + shift) << 32) | (e + shift), docs[of[u]], tags[of[u]], -1 - subs[of[u]]])
                yield pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["anchor", "content", "doc", "tag", "packed"])

    return keyed.select("doc", "tag", "sub", "raw").mapInArrow(run, ANCHORS)


def decide(found: DataFrame) -> DataFrame:
    """What anchors' tasks know, as doc, tag, sub, start and end.

    Of batches' runs, also the mark; of copies, the earlier place (s_doc, s_tag,
    s_sub, s_start); of segments that are to be sorted, the anchor, off and how
    many segments the anchor has.
    """
    spread = found.repartition("anchor")
    by_content, by_anchor = Window.partitionBy("anchor", "content"), Window.partitionBy("anchor")
    place = F.struct("doc", "tag", F.shiftright("packed", 14).alias("place"))
    batch_run = F.col("packed") < 0
    seen = (
        spread.withColumn("place", F.when(~batch_run, place))
        .withColumn("first", F.min("place").over(by_content))
        .withColumn("low", F.min("content").over(by_anchor))
        .withColumn("high", F.max("content").over(by_anchor))
        .withColumn("segments", F.count("*").over(by_anchor))
    )
    later = ~batch_run & (F.col("place") > F.col("first"))
    mixed = ~batch_run & ~later & (F.col("low") != F.col("high"))

    def at(x):
        return x.bitwiseAND((1 << 31) - 1)

    off = F.shiftright("packed", 7).bitwiseAND(127)
    start, windows = at(F.shiftright("packed", 14)) - off, F.col("packed").bitwiseAND(127) + 1
    return seen.where(batch_run | later | mixed).select(
        "doc",
        "tag",
        F.when(batch_run, -1 - F.col("packed")).otherwise(F.shiftright("packed", 45)).cast("int").alias("sub"),
        F.when(batch_run, F.shiftright("content", 32)).otherwise(start).cast("int").alias("start"),
        F.when(batch_run, F.col("content").bitwiseAND((1 << 32) - 1)).otherwise(start + windows + (SPAN - 1)).cast("int").alias("end"),
        F.when(batch_run, F.col("anchor")).alias("mark"),
        F.when(later, F.col("first.doc")).alias("s_doc"),
        F.when(later, F.col("first.tag")).alias("s_tag"),
        F.when(later, F.shiftright("first.place", 31)).cast("int").alias("s_sub"),
        F.when(later, at(F.col("first.place")) - off).cast("int").alias("s_start"),
        F.when(mixed, F.col("anchor")).alias("anchor"),
        F.when(mixed, off).cast("int").alias("off"),
        F.when(mixed, F.col("segments")).alias("segments"),
    )


RUNS = "doc long, tag long, sub int, start int, s_doc long, s_tag long, s_sub int, s_start int, size int"


def copied_runs(known: DataFrame) -> DataFrame:
    """Copies in a row (of decide()'s rows with s_doc) as runs of `size` bytes, cut where the earlier text's slices begin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, tag, sub, start, s_doc, s_tag, s_sub, s_start, end = (c.to_numpy().astype(np.int64) for c in batch.columns)
            if not len(doc):
                continue
            key = np.stack([doc, tag, sub, s_doc, s_tag, s_sub, s_start - start])
            new = np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0) | (start[1:] > end[:-1])]
            b = np.flatnonzero(new)
            size = np.maximum.reduceat(end, b) - start[b]
            low = s_start[b] // SLICE
            n = (s_start[b] + size - 1) // SLICE - low + 1
            j = np.repeat(low, n) + _ramp(n)
            b, size = np.repeat(b, n), np.repeat(size, n)
            shift = np.maximum(j * SLICE - s_start[b], 0)
            long = np.minimum((j + 1) * SLICE - s_start[b], size) - shift
            columns = [doc[b], tag[b], sub[b], start[b] + shift, s_doc[b], s_tag[b], s_sub[b], s_start[b] + shift, long]
            yield pa.record_batch([pa.array(x, pa.int32() if i in (2, 3, 6, 7, 8) else pa.int64()) for i, x in enumerate(columns)], names=[x.split()[0] for x in RUNS.split(", ")])

    own = known.where("s_doc IS NOT NULL").select("doc", "tag", "sub", "start", "s_doc", "s_tag", "s_sub", "s_start", "end")
    near = ["doc", "tag", "sub", "s_doc", "s_tag", "s_sub"]
    return own.repartition("doc", "tag", "sub").sortWithinPartitions(*near, F.col("s_start") - F.col("start"), "start").mapInArrow(run, RUNS)


def fetched(slices: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (f_doc, f_tag, f_sub, f_at, f_size and others) with the bytes at these places; none goes SPAN + REACH bytes beyond its first byte's slice."""
    asked = wanted.withColumn("f_slice", F.floor(F.col("f_at") / SLICE).cast("int"))
    keys = ["f_doc", "f_tag", "f_sub", "f_slice"]
    return asked.join(slices, keys).withColumn("content", F.substring(F.col("piece"), F.col("f_at") - F.col("f_slice") * SLICE + 1, F.col("f_size"))).drop(*keys, "f_at", "f_size", "piece")


def suffix_order(prefix: PrefixHash, at: np.ndarray, sets: np.ndarray, span: int = SPAN) -> np.ndarray:
    """The order of suffixes of `span` bytes at `at` within each of the sets; sets holds rising numbers.

    Bottom-up mergesort of all sets in step: in each round, every element of a
    run finds its place in the neighbouring run by binary search, each
    comparison being a search for the common extension.
    """
    n = len(at)
    order = np.arange(n)
    begin = np.flatnonzero(np.r_[True, sets[1:] != sets[:-1]])
    size = np.diff(np.r_[begin, n])
    set_begin, set_end = np.repeat(begin, size), np.repeat(begin + size, size)
    most = int(size.max()) if n else 0
    width = 1
    while width < most:
        i = np.arange(n)
        run = (i - set_begin) // width
        left = run % 2 == 0
        other = set_begin + np.where(left, run + 1, run - 1) * width
        low = np.minimum(other, set_end)
        high = np.minimum(low + width, set_end)
        other_begin = low.copy()
        # left elements go before equal right ones
        live = np.flatnonzero(low < high)
        while len(live):
            mid = (low[live] + high[live]) >> 1
            a, b = at[order[live]], at[order[mid]]
            k = prefix.common(a, b, span)
            equal = k == span
            k = np.where(equal, 0, k)
            less = prefix.data[b + k] < prefix.data[a + k]  # the other run's element goes first
            goes = np.where(equal, ~left[live], less)
            low[live] = np.where(goes, mid + 1, low[live])
            high[live] = np.where(goes, high[live], mid)
            live = live[low[live] < high[live]]
        own_begin = set_begin + run * width
        target = np.minimum(own_begin, other_begin) + (i - own_begin) + (low - other_begin)
        target = np.where(other_begin >= set_end, i, target)
        new = np.empty_like(order)
        new[target] = order
        order = new
        width *= 2
    return order


def repeats(key: np.ndarray, doc: np.ndarray, place: np.ndarray, shift: np.ndarray, windows: np.ndarray, content: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Windows of segments that occur earlier, as (segment, window) pairs.

    Segments with one key can share windows. shift is the first window's place
    against the anchor's; (doc, place) says which segment is earlier.
    """
    size = np.array([len(x) for x in content], dtype=np.int64)
    data = np.frombuffer(b"".join(content), dtype=np.uint8)
    first = np.cumsum(size) - size
    segment = np.repeat(np.arange(len(size)), windows)
    nth = np.arange(len(segment)) - np.repeat(np.cumsum(windows) - windows, windows)
    relative = shift[segment] + nth
    order = np.lexsort((relative, key[segment]))
    k, r = key[segment][order], relative[order]
    new = np.r_[True, (k[1:] != k[:-1]) | (r[1:] != r[:-1])]
    sets = np.cumsum(new)
    several = np.bincount(sets)[sets] > 1
    order, sets = order[several], sets[several]
    none = np.empty(0, dtype=np.int64)
    if not len(order):
        return none, none
    segment, nth = segment[order], nth[order]
    at = first[segment] + nth
    prefix = PrefixHash(data)
    ranked = suffix_order(prefix, at, sets)
    a, b = ranked[:-1], ranked[1:]
    near = (sets[a] == sets[b]) & prefix.same(at[a], at[b], SPAN)
    pairs = np.flatnonzero(near)
    step = 1 << 16
    for i in range(0, len(pairs), step):
        x, y = at[a[pairs[i : i + step]]], at[b[pairs[i : i + step]]]
        truly = (data[x[:, None] + np.arange(SPAN)] == data[y[:, None] + np.arange(SPAN)]).all(axis=1)
        if not truly.all():  # a collision: that set is ordered by its bytes
            return _by_bytes(data, at, sets, segment, nth, doc, place)
    run = np.cumsum(np.r_[True, ~near]) - 1
    return _later(ranked, run, segment, nth, doc, place)


def _later(ranked: np.ndarray, run: np.ndarray, segment: np.ndarray, nth: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of suffixes with equal run numbers, those that aren't the earliest."""
    own = segment[ranked]
    order = np.lexsort((place[own], doc[own], run))
    head = np.r_[True, run[order][1:] != run[order][:-1]]
    first = own[order[np.flatnonzero(head)]][np.cumsum(head) - 1]
    mine = own[order]
    late = (doc[mine] != doc[first]) | (place[mine] != place[first])
    chosen = ranked[order[late]]
    return segment[chosen], nth[chosen]


def _by_bytes(data, at, sets, segment, nth, doc, place) -> tuple[np.ndarray, np.ndarray]:
    raw = data.tobytes()
    number: dict[tuple[int, bytes], int] = {}
    run = np.array([number.setdefault((int(s), raw[x : x + SPAN]), len(number)) for s, x in zip(sets, at.tolist(), strict=True)])
    return _later(np.arange(len(at)), run, segment, nth, doc, place)


RUN = "doc long, tag long, sub int, start int, end int, mark long, proof binary"


def sort_segments(rows: DataFrame) -> DataFrame:
    """Repeats (RUN, with marks) in segments (key, doc, tag, sub, place, shift, windows, content, mark); those with a mark are repeats as a whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0

        def runs(*columns) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
            made = [pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True)]
            return pa.record_batch([*made, pa.nulls(len(made[0]), pa.binary())], names=[x.split()[0] for x in RUN.split(", ")])

        def solved(t: pa.Table) -> pa.RecordBatch:
            key, doc, tag, sub, place, shift, windows = (t.column(i).to_numpy().astype(np.int64) for i in range(7))
            content = t.column(7).to_pylist()
            # texts of one doc_id in the order of their two hashes
            text = np.unique(np.stack([tag, sub]), axis=1, return_inverse=True)[1].reshape(-1)
            seg, nth = repeats(key, doc, (text << 32) | place, shift, windows, content)
            order = np.lexsort((nth, seg))
            seg, nth = seg[order], nth[order]
            new = np.r_[True, (seg[1:] != seg[:-1]) | (nth[1:] != nth[:-1] + 1)] if len(seg) else np.empty(0, dtype=bool)
            b = np.flatnonzero(new)
            e = np.r_[b[1:] - 1, len(seg) - 1] if len(b) else b
            s = seg[b]
            marks = [_mark(content[i][x : y + SPAN]) for i, x, y in zip(s.tolist(), nth[b].tolist(), nth[e].tolist(), strict=True)]
            start = place[s] + shift[s]
            return runs(doc[s], tag[s], sub[s], start + nth[b], start + nth[e] + SPAN, marks)

        for batch in batches:
            whole = pa.compute.is_valid(batch.column(8))
            t = batch.filter(whole)
            if t.num_rows:
                start = t.column(4).to_numpy().astype(np.int64) + t.column(5).to_numpy()
                yield runs(*(t.column(i).to_numpy() for i in (1, 2, 3)), start, start + t.column(6).to_numpy() + SPAN - 1, t.column(8).to_numpy())
            batch = batch.filter(pa.compute.invert(whole))
            if batch.num_rows:
                held.append(batch)
                count += batch.num_rows
            if count >= SORTED_TOGETHER:
                t = pa.Table.from_batches(held).combine_chunks()
                key = t.column(0).to_numpy()
                before = np.flatnonzero(key != key[-1])
                at = int(before[-1]) + 1 if len(before) else 0
                if at:
                    yield solved(t.slice(0, at))
                held = t.slice(at).to_batches()
                count = t.num_rows - at
        if held:
            yield solved(pa.Table.from_batches(held).combine_chunks())

    return rows.mapInArrow(run, RUN)


def repeated_runs(keyed: DataFrame) -> DataFrame:
    """Byte ranges that earlier strings cover (RUN), of texts (doc, tag, sub, raw); mark is the hash of a range's bytes, proof the bytes themselves."""
    known = cut(decide(find_segments(keyed, common_anchors(keyed))), "segments")
    i = F.sequence(F.lit(0), F.floor(F.greatest(F.octet_length("raw") - 1, F.lit(0)) / SLICE).cast("int"))
    slices = keyed.select(F.col("doc").alias("f_doc"), F.col("tag").alias("f_tag"), F.col("sub").alias("f_sub"), "raw", F.explode(i).alias("f_slice")).withColumn("piece", F.substring(F.col("raw"), F.col("f_slice") * SLICE + 1, F.lit(SLICE + SPAN + REACH))).drop("raw").dropDuplicates(["f_doc", "f_tag", "f_sub", "f_slice"])
    runs = copied_runs(known).select("doc", "tag", "sub", "start", "size", F.col("s_doc").alias("f_doc"), F.col("s_tag").alias("f_tag"), F.col("s_sub").alias("f_sub"), F.col("s_start").alias("f_at"), F.col("size").alias("f_size"))
    copies = fetched(slices, runs).select("doc", "tag", "sub", "start", (F.col("start") + F.col("size")).alias("end"), F.lit(None).cast("long").alias("mark"), F.col("content").alias("proof"))
    size = F.col("end") - F.col("start")
    own = known.where("anchor IS NOT NULL").distinct().select("doc", "tag", "sub", "start", (size - (SPAN - 1)).alias("windows"), "anchor", "off", "segments", F.col("doc").alias("f_doc"), F.col("tag").alias("f_tag"), F.col("sub").alias("f_sub"), F.col("start").alias("f_at"), size.alias("f_size"))
    bytes_of = fetched(slices, own)
    place, low = F.col("start") + F.col("off"), -F.col("off")
    hot = F.col("segments") > HOT
    # a hot anchor's windows by blocks of their place against the anchor; the bytes that all of a block share are in each of its windows
    blocks = F.when(hot, F.sequence(F.floor((low + REACH) / BLOCK).cast("int"), F.floor((low + F.col("windows") - 1 + REACH) / BLOCK).cast("int"))).otherwise(F.array(F.lit(None).cast("int")))
    split = bytes_of.withColumn("place", place).withColumn("shift", low).withColumn("block", F.explode(blocks))
    base = F.col("block") * BLOCK - REACH
    begin = F.when(hot, F.greatest(F.col("shift"), base)).otherwise(F.col("shift"))
    end = F.when(hot, F.least(F.col("shift") + F.col("windows"), base + BLOCK)).otherwise(F.col("shift") + F.col("windows"))
    shared = F.substring(F.col("content"), base + (BLOCK - 1) - F.col("shift") + 1, F.lit(SPAN - BLOCK + 1))
    parts = split.select(
        F.when(hot, F.xxhash64("anchor", "block", shared)).otherwise(F.col("anchor")).alias("key"),
        "doc", "tag", "sub", "place", begin.cast("int").alias("shift"), (end - begin).cast("int").alias("windows"),
        F.substring(F.col("content"), begin - F.col("shift") + 1, end - begin + (SPAN - 1)).alias("content"),
    )
    order = F.struct("doc", "tag", "sub", "place")
    same = Window.partitionBy("key", "shift", "content")
    # a part with the bytes of an earlier one, compared as the window's key, is all repeats
    later = order > F.min(order).over(same)
    first = parts.repartition("key").withColumn("later", later).sortWithinPartitions("key")
    sent = first.select("key", "doc", "tag", "sub", "place", "shift", "windows", F.when(~F.col("later"), F.col("content")).alias("content"), F.when(F.col("later"), F.xxhash64("content")).alias("mark"))
    in_batch = known.where("mark IS NOT NULL").select("doc", "tag", "sub", "start", "end", "mark", F.lit(None).cast("binary").alias("proof"))
    return in_batch.unionByName(copies).unionByName(sort_segments(sent))


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, doc (null as the least number), tag and sub (hashes that tell texts with one doc_id apart) and raw (the text's bytes)."""
    text, doc_id = text_or_empty(), F.col("doc_id").cast("long")
    sub = F.xxhash64(F.lit(1), text).bitwiseAND((1 << SUB_BITS) - 1).cast("int")
    return docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(-(2**63))).alias("doc"), F.xxhash64(text).alias("tag"), sub.alias("sub"), text.cast("binary").alias("raw"))


def dedup(docs: DataFrame) -> DataFrame:
    """Every row of docs (doc_id, text) without the bytes that earlier strings of SPAN bytes cover: doc_id, n_bytes, n_removed, n_spans, kept (bytes).

    A string is earlier if it starts in a smaller doc_id, or earlier in the same
    text. Null text counts as empty. Null doc_ids come before all others. Rows
    that repeat doc_id and text are one document and share its result; texts
    that share a doc_id, or have none, are told apart and ordered by hashes of 82 bits
    of the text, which removes nothing wrong even if two of them are alike.
    Texts under SPAN bytes stay whole. Texts of any length are searched in
    slices of bounded memory; one whole text and what is kept of it are held
    at a time. An empty table gives no rows. Other columns are ignored.
    """
    keyed = _keyed(docs)
    runs = repeated_runs(keyed).groupBy("doc", "tag", "sub").agg(F.collect_list(F.struct("start", "end", "mark", "proof")).alias("runs"))
    joined = keyed.join(runs, ["doc", "tag", "sub"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for whole in batches for b in pieces_of(whole, "raw", budget=BATCH)):
            rows = []
            for x, own in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                raw = x.as_py()
                sure = [(r["start"], r["end"]) for r in own or () if (_mark(raw[r["start"] : r["end"]]) == r["mark"] if r["proof"] is None else raw[r["start"] : r["end"]] == r["proof"])]
                spans = np.array(sure, dtype=np.int64).reshape(-1, 2)
                b, e = merged(spans[:, 0], spans[:, 1])
                kept, at = [], 0
                for x, y in zip(b.tolist(), e.tolist(), strict=True):
                    kept.append(raw[at:x])
                    at = y
                kept.append(raw[at:])
                rows.append((len(raw), int((e - b).sum()), len(b), b"".join(kept)))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.record_batch([batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.select("doc_id", "raw", "runs").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


