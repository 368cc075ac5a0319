"""Personal data: base patterns, and more of it by bootstrapped contexts."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, forget, pieces_of, table, text_or_empty, whole_row

KINDS = ("email", "ip", "card", "phone")
#: A pattern is trusted from so many distinct known instances on, and this share of those that count.
MIN_KNOWN, MIN_PRECISION = 3, 0.8
#: An unseen identifier becomes known from this score on.
MIN_SCORE = 0.8

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
#: What may be an identifier that the base patterns don't take: groups of digits, spelt-out addresses, words with several digits.
#: Each is a whole run, however long; runs begin where none goes on, so that a search is linear.
_AT = r"[A-Za-z0-9._%+-]++(?:@|\x20?[\[(]at[\])]\x20?)[A-Za-z0-9._-]+"
_ADDRESS = re.compile(_AT)
_CANDIDATE = re.compile(rf"(?<![A-Za-z0-9._%+-]){_AT}|[+(]?[0-9][0-9().\x20/-]{{4,}}[0-9]|(?<![A-Za-z-])-*+([A-Za-z-]*+[0-9][A-Za-z0-9-]{{4,}})")
_LOCAL_RUN = re.compile(r"[A-Za-z0-9._%+-]*")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Code points before and after a candidate in which its context is read.
REACH = 48


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        own = text[max(done, text.rfind("@", done, at) + 1) : at]
        start = at - (len(own) - len(own.rstrip(_LOCAL)))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _DOTTED.finditer(text):
        parts = m[0].split(".")
        at = m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                yield at, at + size
            at += size + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the base patterns' spans, in that order; code points, end exclusive."""
    out = []
    if "@" in text:
        out += [(a, 0, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        if text.count(".") > 2:
            out += [(a, 1, b) for a, b in _ips(text)]
        for m in _DIGITS.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def _context(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns around a span: the two words before it on its line, and the word on either side."""
    before = text[max(0, start - REACH) : start].rpartition("\n")[2]
    after = text[end : end + REACH].partition("\n")[0]
    left = [w.strip("\"'()[]<>|*#$%&!") for w in _WORD.findall(before.lower())]
    right = [w.strip("\"'()[]<>|*#$%&!") for w in _WORD.findall(after.lower())]
    if start > REACH and len(left) and len(before) == REACH:
        left = left[1:]  # cut by the reach
    left = [w for w in left if w]
    right = [w for w in right if w]
    out = []
    if len(left) > 1:
        out.append(f"{left[-2]} {left[-1]} _")
    elif left:
        out.append(f"^ {left[-1]} _")
    if left and right:
        out.append(f"{left[-1]} _ {right[0]}")
    return out


def _candidates(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Candidates in the gaps between base spans, from the left."""
    at = 0
    for lo, hi in [(a, b) for a, _, b in base] + [(len(text), len(text))]:
        dead = -1  # the end of a run after which no address goes on
        while at < lo:
            m = _ADDRESS.match(text, at, lo) if at >= dead else None
            if not m:
                dead = max(dead, _LOCAL_RUN.match(text, at, lo).end())
                m = _CANDIDATE.search(text, at, lo)
            if not m:
                break
            yield m.span(m.lastindex or 0)
            at = m.end()
        at = max(at, hi)


def mentions(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, str, list[str]]]:
    """(start, kind or -1, end, instance, patterns) of the base spans and of other strings that may be identifiers."""
    found = [(a, k, b, text[a:b].lower(), _context(text, a, b)) for a, k, b in base]
    if "@" not in text and "at)" not in text and "at]" not in text and not _DIGIT.search(text):
        return found
    for a, b in _candidates(text, base):
        own = text[a:b]
        if sum("0" <= c <= "9" for c in own) < 5 and "@" not in own and "at" not in own:
            continue
        patterns = _context(text, a, b)
        if patterns:
            found.append((a, -1, b, own.lower(), patterns))
    return found


SCAN = "doc_id long, key long, alt long, base array<struct<start:int,kind:int,end:int>>, mentions array<struct<start:int,kind:int,end:int,instance:string,patterns:array<string>>>"


def _keys():
    """Two hashes of doc_id and text, which together tell rows apart at any size of a corpus."""
    return F.xxhash64(F.col("doc_id").cast("long"), text_or_empty()).alias("key"), F.xxhash64(F.lit(7), text_or_empty()).alias("alt")


def scan(docs: DataFrame) -> DataFrame:
    """Each row's base spans and mentions. key and alt tell rows apart (equal for equal doc_id and text)."""
    import pyspark.sql.pandas.types as conv
    from pyspark.sql.types import _parse_datatype_string

    schema = conv.to_arrow_schema(_parse_datatype_string(SCAN))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for whole in batches for b in pieces_of(whole)):
            base, seen = [], []
            for x in batch.column(3):
                text = x.as_py()
                spans = base_spans(text)
                base.append([{"start": a, "kind": k, "end": b} for a, k, b in spans])
                seen.append([dict(zip(("start", "kind", "end", "instance", "patterns"), m, strict=True)) for m in mentions(text, spans)])
            yield pa.record_batch([*batch.columns[:3], pa.array(base, schema.field(3).type), pa.array(seen, schema.field(4).type)], names=schema.names)

    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), *_keys(), text_or_empty().alias("text"))
    return rows.mapInArrow(run, SCAN)


def _like(kind: int):
    """Whether an unknown instance has the shape of a kind, so that a pattern's unknown instances may be unseen ones of it."""
    digits = F.length(F.regexp_replace("instance", "[^0-9]", ""))
    bare = ~F.col("instance").rlike("[a-z%_@]")
    return (
        F.col("instance").rlike(r"@|[\[(]at[\])]"),
        F.col("instance").rlike(r"^[0-9]{1,3}([ ./()-]+[0-9]{1,3}){3}$"),
        bare & digits.between(12, 19),
        bare & digits.between(7, 15),
    )[kind]


def judged(edges: DataFrame, known: DataFrame) -> DataFrame:
    """pattern, kind, f (distinct instances known as that kind), errors and wrong.

    Errors are instances of other kinds, unknown ones without the kind's shape,
    and those with it beyond f: as many unseen identifiers as known ones don't
    tell against a pattern, but three telephones among a thousand dates do.
    wrong are the errors without those of the kind's shape.
    """
    kinds = range(len(KINDS))
    rows = edges.join(known, "instance", "left")
    n = [F.count("*").alias("n")]
    n += [F.count(F.when(F.col("kind") == k, 1)).alias(f"f{k}") for k in kinds]
    n += [F.count(F.when(F.col("kind").isNull() & _like(k), 1)).alias(f"u{k}") for k in kinds]
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"f{k}").alias("f"), (F.col("n") - F.col(f"f{k}") - F.least(f"f{k}", f"u{k}")).alias("errors"), (F.col("n") - F.col(f"f{k}") - F.col(f"u{k}")).alias("wrong")) for k in kinds])).alias("j")
    return rows.groupBy("pattern").agg(*n).where(f"n >= {MIN_KNOWN}").select("pattern", each).select("pattern", "j.*")


def bootstrap(seen: DataFrame, rounds: int | None = None) -> DataFrame:
    """instance, kind and score of identifiers that contexts reveal.

    seen: instance, kind (-1: unknown) and pattern of each mention. In the
    graph of patterns and instances, a pattern's precision for a kind is
    f / (f + errors) as judged() counts them; it is trusted from MIN_KNOWN
    known instances and MIN_PRECISION on, and tells against the kind if it
    isn't and has MIN_KNOWN wrong ones. An unknown instance scores 1 - product(1 -
    precision) over the trusted patterns it is in, times their share of those
    that tell for or against; others, as with a next word that varies or
    with unseen identifiers alone, are left out. From MIN_SCORE on it is known from the next round
    on. Rounds end when none is new, or after so many. Ties between kinds go to
    the lower number.
    """
    edges = cut(seen.select("pattern", "instance").distinct(), "edges")
    known = cut(seen.where("kind >= 0").groupBy("instance").agg(F.min("kind").alias("kind")), "seeds")
    found = None
    for _ in itertools.count() if rounds is None else range(rounds):
        precision = F.col("f") / (F.col("f") + F.col("errors"))
        told = cut(judged(edges, known).withColumn("precision", F.when((F.col("f") >= MIN_KNOWN) & (precision >= MIN_PRECISION), precision)).where(f"precision IS NOT NULL OR wrong >= {MIN_KNOWN}").select("pattern", "kind", "precision"), "patterns")
        trusted = told.where("precision IS NOT NULL")
        if trusted.isEmpty():
            break
        open_edges = edges.join(known.select("instance"), "instance", "left_anti")
        miss = F.exp(F.sum(F.log(F.greatest(1 - F.col("precision"), F.lit(1e-6)))))
        voted = open_edges.join(trusted, "pattern").groupBy("instance", "kind").agg((1 - miss).alias("belief"), F.count("*").alias("votes"))
        against = open_edges.join(voted.select("instance").distinct(), "instance").join(told.where("precision IS NULL"), "pattern").groupBy("instance", "kind").agg(F.count("*").alias("against"))
        degree = F.col("votes") + F.coalesce("against", F.lit(0))
        scored = voted.join(against, ["instance", "kind"], "left").withColumn("score", F.col("belief") * F.col("votes") / degree).where(F.col("score") >= MIN_SCORE)
        best = scored.groupBy("instance").agg(F.max(F.struct("score", (-F.col("kind")).alias("rank"))).alias("b"))
        fresh = cut(best.select("instance", (-F.col("b.rank")).alias("kind"), F.col("b.score").alias("score")), "found")
        if fresh.isEmpty():
            break
        last = (known, told, found, fresh if found is not None else None)
        known = cut(known.union(fresh.select("instance", "kind")), "known")
        found = fresh if found is None else cut(found.union(fresh), "all-found")
        forget(*last)
    return found if found is not None else known.select("instance", "kind", F.lit(0.0).alias("score")).where("false")


def personal_data(docs: DataFrame, rounds: int | None = None) -> DataFrame:
    """Spans of personal data in every row of docs (doc_id, text): doc_id, base, extra (arrays of start, kind, end).

    base are the spans of the four patterns, leftmost and non-overlapping by
    kind. extra are spans of unseen identifiers that bootstrap() believes in;
    they never overlap base spans. Positions are code points, ends exclusive,
    kind an index of KINDS.

    Null and empty texts have no spans. Null doc_ids stay; repeated rows stay
    and have equal spans; an empty table gives no rows. Texts of any length are
    searched whole, in time in proportion to it. Other columns are ignored.
    """
    rows = cut(scan(docs), "spans")
    flat = rows.select("key", "alt", F.explode("mentions").alias("m")).select("key", "alt", "m.*")
    found = bootstrap(flat.select("instance", "kind", F.explode("patterns").alias("pattern")), rounds)
    extra = (
        flat.where("kind < 0").drop("kind").join(found, "instance")
        .groupBy("key", "alt").agg(F.array_sort(F.collect_set(F.struct("start", "kind", "end"))).alias("extra"))
    )
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return rows.join(extra, ["key", "alt"], "left").select("doc_id", "base", F.coalesce("extra", none).alias("extra"), "key", "alt")


def _listed(spans):
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))

    def count(kind: int):
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")

    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.array_sort(F.concat("base", "extra"))).alias("spans"),
    )


def replaced(text: str, spans: list[int]) -> str:
    """text with each span (start, kind, end, one after the other by start) as its kind in angle brackets, in one sweep; spans that begin within another are part of it."""
    out, at, end = [], 0, 0
    for start, kind, stop in zip(spans[::3], spans[1::3], spans[2::3], strict=True):
        if start >= end:
            out += [text[at:start], f"<{KINDS[kind]}>"]
        at = end = max(end, stop)
    return "".join([*out, text[at:]])


def masked(docs: DataFrame) -> DataFrame:
    """docs with each span of personal data replaced by its kind in angle brackets, n_chars counted anew; all columns and rows kept.

    Rows that personal_data() finds nothing in stay as they are, null texts
    too. An empty table stays empty.
    """

    @F.arrow_udf("string")
    def without(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([None if not x.is_valid else replaced(x.as_py(), y) for x, y in zip(texts, spans.to_pylist(), strict=True)], pa.string())

    spans = F.array_sort(F.concat("base", "extra"))
    flat = F.flatten(F.transform(spans, lambda x: F.array(x["start"], x["kind"], x["end"])))
    found = personal_data(docs).select("key", "alt", flat.alias("spans")).where(F.size("spans") > 0).dropDuplicates(["key", "alt"])
    joined = docs.select(whole_row(docs).alias("row"), "text", *_keys()).join(found, ["key", "alt"], "left")
    hit = F.col("spans").isNotNull()
    new = joined.withColumn("new", without(F.when(hit, F.col("text")), "spans"))
    out = new.select("row", F.when(hit, F.col("new")).otherwise(F.col("text")).alias("text"))
    own = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*[own.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
