import hashlib
import random

import numpy as np
import pytest

from emberline.llm import suffix_dedup as sd
from tests.llm.helpers import corpus, docs


def plain(texts):
    """doc_id -> (n_bytes, n_removed, n_spans, sha256 of what is kept) by looking every 100-byte string up."""
    seen, out = set(), {}
    for d in sorted(texts):
        raw = (texts[d] or "").encode()
        covered = bytearray(len(raw))
        for i in range(len(raw) - 99):
            s = raw[i : i + 100]
            if s in seen:
                covered[i : i + 100] = b"\1" * 100
            else:
                seen.add(s)
        kept = bytes(b for b, c in zip(raw, covered, strict=True) if not c)
        spans = sum(c and not (i and covered[i - 1]) for i, c in enumerate(covered))
        out[d] = (len(raw), sum(covered), spans, hashlib.sha256(kept).hexdigest())
    return out


def got(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in sd.dedup(df).collect()}


def test_whole_table(spark, sf):
    rows = {r.doc_id: tuple(r[1:]) for r in sd.op6_suffix_dedup(spark, sf).collect()}
    assert rows == plain(corpus(sf))


def made(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeé", k=rng.randrange(1, 9))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    shared = [prose(rng.randrange(12, 60)) for _ in range(6)]
    line = "This very common line has some ninety-odd bytes and stands in many of the texts that are here."
    out = {}
    for d in range(140):
        parts = [prose(rng.randrange(1, 50)) for _ in range(rng.randrange(1, 5))]
        for _ in range(rng.randrange(3)):
            s = rng.choice(shared)
            a = rng.randrange(len(s) // 2)
            parts.insert(rng.randrange(len(parts) + 1), s[a : a + rng.randrange(90, 260)])
        if d % 2:
            parts.insert(rng.randrange(len(parts) + 1), line)
        out[d] = "".join(parts) if d % 5 else "\n".join(parts)
    for d in range(140, 200):  # copies with a few changes
        t = list(out[rng.randrange(140)])
        for _ in range(rng.randrange(4)):
            t[rng.randrange(len(t))] = rng.choice("xyz ")
        out[d] = "".join(t)
    out |= {300: "a" * 1000, 301: "ab" * 700, 302: "a" * 130, 303: "ab" * 50, 304: "abc" * 400 + "ab" * 300}
    return out


@pytest.mark.parametrize("hot", [sd.HOT, 2])
@pytest.mark.parametrize("batch", [sd.BATCH, 3000])
def test_made_texts(spark, monkeypatch, hot, batch):
    monkeypatch.setattr(sd, "HOT", hot)
    monkeypatch.setattr(sd, "BATCH", batch)
    texts = made(hot + batch)
    rows = list(texts.items())
    random.Random(1).shuffle(rows)
    assert got(docs(spark, rows).repartition(5)) == plain(texts)


def test_segments_hold_each_window_once():
    rng = random.Random(2)
    raw = [bytes(rng.choices(b"ab ", k=n)) for n in (0, 99, 100, 101, 5000, 170)]
    size = np.array([len(x) for x in raw])
    s = sd.segments(np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum(size) - size, size)
    windows = sorted((t, a + k) for t, a, n in zip(s["text"], s["start"], s["windows"], strict=True) for k in range(n))
    assert windows == [(t, i) for t, x in enumerate(raw) for i in range(len(x) - 99)]
    assert s["windows"].max() <= sd.REACH and (s["off"] >= 0).all() and (s["off"] < sd.REACH).all()
    # equal windows have equal anchors at equal places
    place = {}
    for t, a, n, off, anchor in zip(s["text"], s["start"], s["windows"], s["off"], s["anchor"], strict=True):
        for k in range(n):
            w = raw[t][a + k : a + k + 100]
            assert place.setdefault(w, (anchor, off - k)) == (anchor, off - k)


def test_suffix_order_and_extensions():
    rng = random.Random(3)
    raw = bytes(rng.choices(b"ab", k=3000)) + b"ab" * 200 + b"a" * 300 + bytes(100)
    data = np.frombuffer(raw, dtype=np.uint8)
    prefix = sd.PrefixHash(data)
    at = np.array(rng.sample(range(len(raw) - 100), 1500))
    sets = np.sort(np.array([rng.choice([0, 1, 2, 2, 2, 5]) for _ in at]))
    order = sd.suffix_order(prefix, at, sets)
    assert (sets[order] == sets).all() and sorted(order) == list(range(len(at)))
    for s in set(sets.tolist()):
        own = [raw[i : i + 100] for i in at[order[sets == s]]]
        assert own == sorted(own)
    a, b = at[:700], at[700:1400]
    common = prefix.common(a, b, 100)
    for x, y, n in zip(a, b, common, strict=True):
        assert n == next((i for i in range(100) if raw[x + i] != raw[y + i]), 100)


def test_collisions_remove_nothing(monkeypatch):
    monkeypatch.setattr(sd.PrefixHash, "same", lambda self, a, b, n: np.ones(len(a), dtype=bool))
    one, two = b"x" * 100, b"y" * 100
    n = np.array
    seg, nth = sd.repeats(n([7] * 3), n([1, 2, 3]), n([0] * 3), n([0] * 3), n([1] * 3), [one, two, one])
    assert seg.tolist() == [2] and nth.tolist() == [0]


@pytest.mark.parametrize("hot", [sd.HOT, 2])
@pytest.mark.parametrize("batch", [sd.BATCH, 3000])
def test_common_anchors_and_short_slices(spark, monkeypatch, hot, batch):
    """Anchors of all texts are common, and texts are cut into slices of 300 bytes."""
    for name, value in (("HOT", hot), ("BATCH", batch), ("SLICE", 300), ("SAMPLED", 1), ("LEAST_COMMON", 3)):
        monkeypatch.setattr(sd, name, value)
    texts = made(7 + hot + batch)
    df = docs(spark, list(texts.items())).repartition(3)
    assert len(sd.common_anchors(sd._keyed(df))) > 20
    assert got(df) == plain(texts)


def by_text(df):
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in sd.dedup(df).collect())


def test_texts_without_ids_are_told_apart(spark):
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(4000)]
    texts = list({" ".join(rng.choices(words, k=rng.randrange(20, 40))) for _ in range(5000)})
    for _ in range(300):  # some begin or end as others do
        a, b = rng.randrange(len(texts)), rng.randrange(len(texts))
        texts[a] = texts[a][:130] + texts[b][-130:]
    texts = list(dict.fromkeys(texts))
    df = docs(spark, [(None, t) for t in texts])
    order = {r.text: i for i, r in enumerate(sd._keyed(df).selectExpr("string(raw) AS text", "tag", "sub").orderBy("tag", "sub").collect())}
    want = plain({order[t]: t for t in texts})
    rows = [(r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in sd.dedup(df).collect()]
    assert sum(x[1] > 0 for x in rows) > 200 and sorted(rows) == sorted(want.values())


def test_alike_hashes_remove_nothing_of_other_texts(spark, monkeypatch):
    from pyspark.sql import functions as F

    rng = random.Random(12)
    one, other = ("".join(rng.choices("abcdefgh ", k=n)) for n in (209, 240))
    keyed = sd._keyed
    monkeypatch.setattr(sd, "_keyed", lambda d: keyed(d).withColumn("tag", F.lit(5).cast("long")).withColumn("sub", F.lit(3)))
    rows = [(1, one), (2, "ab " + one), (2, other), (None, one[:150]), (None, other[:120])]
    kept = sorted((r.doc_id or 0, r.kept.decode()) for r in sd.dedup(docs(spark, rows)).collect())
    # of two texts taken for one, repeats may stay; nothing that isn't one goes
    allowed = [{one[:150]}, {other[:120]}, {one, one[150:]}, {"ab " + one, "ab "}, {other, other[120:]}]
    assert len(kept) == 5 and all(any(k in a for _, k in kept) for a in allowed) and all(any(k in a for a in allowed) for _, k in kept)


def test_copies_are_compared(spark, monkeypatch):
    """All segments of an anchor seem to have one content: only what is equal goes."""
    whole = sd.segments
    monkeypatch.setattr(sd, "segments", lambda *a: whole(*a) | {"content": np.zeros(len(whole(*a)["content"]), dtype=np.uint64)})
    rng = random.Random(13)
    line, rest = ("".join(rng.choices("abcdefgh ", k=n)) for n in (90, 4000))
    df = docs(spark, [(d, rest[100 * d : 100 * d + 80] + line + rest[100 * d + 2000 : 100 * d + 2080]) for d in range(20)])
    assert all(r.n_removed == 0 for r in sd.dedup(df).collect())


def test_a_long_text_in_slices(spark, monkeypatch):
    monkeypatch.setattr(sd, "BATCH", 1 << 16)
    rng = random.Random(14)
    text = "".join(rng.choices("abcdefgh ", k=1_000_000))
    rows = [(1, text + "Z" + text[500:200_000]), (2, text[:900_000]), (3, "zz" + text[300_000:300_400])]
    out = sorted(tuple(r)[:4] for r in sd.dedup(docs(spark, rows)).collect())
    assert out == [(1, 1_199_501, 199_500, 1), (2, 900_000, 900_000, 1), (3, 402, 400, 1)]


def test_odd_rows(spark):
    long = "".join(random.Random(5).choices("abcdefgh ", k=400_000))
    rows = [(1, None), (2, ""), (5, long), (5, long), (None, long[:500]), (7, long[1000:1300] + "zz"), (8, "x" * 99), (9, "x" * 99)]
    df = docs(spark, rows).withColumnsRenamed({"lang": "tag", "source": "runs"})
    out = sorted(((r.doc_id or 0), r.n_bytes, r.n_removed, r.n_spans) for r in sd.dedup(df).collect())
    assert out == [(0, 500, 0, 0), (1, 0, 0, 0), (2, 0, 0, 0), (5, 400_000, 500, 1), (5, 400_000, 500, 1), (7, 302, 300, 1), (8, 99, 0, 0), (9, 99, 0, 0)]
    assert sd.dedup(docs(spark, [])).count() == 0
