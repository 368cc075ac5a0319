import hashlib
import random
import re

from pyspark.sql import functions as F

from emberline.llm import pii
from tests.llm.helpers import corpus, docs

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for k, kind in enumerate(pii.KINDS):
        for m in re.finditer(PATTERNS[kind], text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card":
                total = 0
                for i, d in enumerate(reversed(digits)):
                    v = int(d) * (1 + i % 2)
                    total += v - 9 if v > 9 else v
                if not 14 <= len(digits) <= 19 or total % 10:
                    continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_patterns_on_random_strings():
    rng = random.Random(6)
    for alphabet, n in (("a1.@-", 4000), ("0123456789 -", 3000), ("12.", 3000), ("+12 ().-x", 3000), ("aB9._%+-@. é\n", 3000), ("4539578763621486 -+.@a", 3000)):
        for _ in range(n):
            text = "".join(rng.choices(alphabet, k=rng.randrange(0, 40)))
            assert pii.base_spans(text) == plain(text), repr(text)
    assert pii.base_spans("1" * 200_000) == [] and pii.base_spans("a" * 200_000 + "@") == []


def test_whole_table(spark, sf):
    rows = {r.doc_id: r for r in pii.op10_personal_data(spark, sf).collect()}
    texts = corpus(sf)
    assert set(rows) == set(texts)
    for d, t in texts.items():
        spans = plain(t or "")
        listed = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        r = rows[d]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x[1] == k for x in spans) for k in range(4))
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert set(listed.split(",")) <= set(r.spans.split(",")) or not listed


def contexts():
    rows = [(i, f"filler words here then reach me at user{i}@mail{i}.example.com for news") for i in range(12)]
    rows += [(100 + i, f"filler then call us on +1 (555) 010-{1000 + i} today please") for i in range(12)]
    rows.append((50, "other words reach me at user [at] host.example for news"))
    rows.append((51, "do call us on 555-0102-77 today please"))
    rows += [(60 + i, f"the order number {10_000 + 37 * i} was sent") for i in range(12)]
    return rows


def test_contexts_reveal_unseen_identifiers(spark):
    rows = contexts()
    texts = dict(rows)
    found = {r.doc_id: [(x["start"], x["kind"], x["end"]) for x in r.extra] for r in pii.personal_data(docs(spark, rows)).collect()}
    extra = {d: [(pii.KINDS[k], texts[d][a:b]) for a, k, b in x] for d, x in found.items() if x}
    assert extra == {50: [("email", "user [at] host.example")], 51: [("phone", "555-0102-77")]}


def revealed(spark, rows):
    texts = dict(rows)
    return {r.doc_id: [(pii.KINDS[x["kind"]], texts[r.doc_id][x["start"] : x["end"]]) for x in r.extra] for r in pii.personal_data(docs(spark, rows)).collect() if r.extra}


def test_next_words_may_vary(spark):
    """One left cue, and next words that are all different or come from few."""
    for words in (1000, 40, 5):
        rows = [(i, f"then call us on +1 (555) 010-{1000 + i} w{i % words} please") for i in range(60)]
        rows += [(1000 + i, f"then call us on 555-0102-{10 + i} w{(500 + i) % words} please") for i in range(6)]
        rows += [(2000 + i, f"the order number {1_000_000 + 37 * i} w{i % words} was sent") for i in range(12)]
        assert revealed(spark, rows) == {1000 + i: [("phone", f"555-0102-{10 + i}")] for i in range(6)}


def test_many_unseen_do_not_hide_each_other(spark):
    """Four unseen among ten known are found; as dates outnumber the known, or with another shape, they tell against the cue."""
    known = [(i, f"then call us on +1 (555) 010-{1000 + i}") for i in range(10)]
    four = [(100 + i, f"then call us on 555-0102-{10 + i}") for i in range(4)]
    assert revealed(spark, known + four) == {100 + i: [("phone", f"555-0102-{10 + i}")] for i in range(4)}
    dates = [(200 + i, f"then call us on 2024-{10 + i // 28}-{1 + i % 28:02}") for i in range(60)]
    assert revealed(spark, known + dates) == {}
    codes = [(300 + i, f"then call us on ab{10_000 + i}") for i in range(4)]
    assert revealed(spark, known + codes) == {}


def test_long_candidates_are_whole():
    for own in ("a" * 100 + " [at] " + "b.c" * 100, "55 " * 20 + "55", "x" * 30 + "1" * 60, "ab-" * 9 + "12345"):
        text = f"then call us on {own}, please"
        assert [text[a:b] for a, _, b, _, _ in pii.mentions(text, [])] == [own]
    text = "ring 10.0.0.1 555-0102-77 now"
    assert [text[a:b] for a, k, b, _, _ in pii.mentions(text, pii.base_spans(text)) if k < 0] == ["555-0102-77"]
    for part in ("a", "--a", "a-", "+123456", "1.", "%a@", "a (at) "):
        assert len(pii.mentions(part * 50_000 + " 12345 ", [])) < 60_000


def test_rounds_go_on_until_none_is_new(spark):
    """Cue i reveals what cue i + 1 needs: six rounds."""
    rows = [(i, f"zero call on +1 (555) 010-{1000 + i}") for i in range(6)]
    for step in range(6):
        for n in range(3):
            own = f"555-{step}{n}02-77"
            rows += [(100 + 10 * step + n, f"cue{step - 1} on {own}" if step else f"zero call on {own}"), (200 + 10 * step + n, f"cue{step} on {own}")]
    assert len(revealed(spark, rows)) == 36  # two mentions of three a step


def test_masking(spark):
    df = docs(spark, [(1, "mail a.b@c.example now, 10.0.0.1"), (2, "né +1 (212) 555-0100 ñ"), (3, None), (None, "clean text"), (1, "mail a.b@c.example now, 10.0.0.1")])
    got = sorted((r.doc_id or 0, r.text, r.n_chars) for r in pii.masked(df).where("text IS NOT NULL").collect())
    assert got == [(0, "clean text", 10), (1, "mail <email> now, <ip>", 22), (1, "mail <email> now, <ip>", 22), (2, "né <phone> ñ", 12)]
    assert pii.masked(df).columns == df.columns and pii.masked(df).count() == 5


def test_odd_rows(spark):
    df = docs(spark, [(None, None), (1, ""), (1, ""), (None, "a@b.c"), (4, "x " * 100_000 + "1.2.3.4")]).withColumnsRenamed({"lang": "key", "source": "base"})
    rows = pii.personal_data(df).collect()
    assert sorted(len(r.base) for r in rows) == [0, 0, 0, 1, 1]
    assert pii.personal_data(docs(spark, [])).count() == 0


def test_many_signs_without_addresses_take_linear_time():
    text = "word @ " * 200_000 + "a.b@c.de"
    assert pii.base_spans(text) == [(len(text) - 8, 0, len(text))]


def test_narrow_doc_ids_are_masked(spark):
    df = docs(spark, [(1, "mail x@y.zz now"), (2, "none")]).withColumn("doc_id", F.col("doc_id").cast("int"))
    assert {r.text for r in pii.masked(df).collect()} == {"mail <email> now", "none"}


def test_many_and_long_identifiers_take_linear_time(spark):
    import time

    began = time.perf_counter()
    for one in ("user{}@mail{}.example.com ", "user{} [at] mail{}.example.com ", "10.0.{}.{} ", "+1 (555) 010-{}{}, ", "{}-{}-4455 "):
        text = "".join(one.format(i % 250, i % 250) for i in range(100_000))
        spans = pii.base_spans(text)
        assert len(pii.mentions(text, spans)) >= 99_999 or one.startswith("{}")
        out = pii.replaced(text, [x for s in spans for x in s])
        assert out.count("<") == len(spans)
    assert time.perf_counter() - began < 30
    long = "x" * 5000 + "@" + "y" * 5000 + ".example"
    df = docs(spark, [(1, f"mail {long} now"), (2, long)])
    assert {r.text for r in pii.masked(df).collect()} == {"mail <email> now", "<email>"}


def test_unseen_identifiers_are_masked_whole(spark):
    own = "5" * 2500 + "-" + "6" * 2500
    rows = [(i, f"then call us on +1 (555) 010-{1000 + i}") for i in range(40)]
    rows.append((99, f"then call us on {own} today"))
    rows += [(200 + i, f"then call us on 555-0102-{10 + i} today") for i in range(3)]
    got = {r.doc_id: r.text for r in pii.masked(docs(spark, rows)).collect()}
    assert all(got[200 + i] == "then call us on <phone> today" for i in range(3))
    assert got[99] in (f"then call us on {own} today", "then call us on <phone> today")


def test_overlapping_spans_are_one():
    assert pii.replaced("ab 1234 5678 cd", [3, 2, 12, 8, 3, 12]) == "ab <card> cd"
    assert pii.replaced("0123456789", [1, 0, 4, 3, 1, 6, 5, 2, 7, 8, 3, 9]) == "0<email>7<phone>9"
