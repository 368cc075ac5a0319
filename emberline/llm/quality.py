"""Repetition rules: how much of a text lies in n-grams and lines that the text repeats."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_or_empty

#: n-gram lengths, and the share of a text's word characters that may lie in repeated n-grams of that length (fixed values, as published for web corpora).
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Share of a text's word characters that may lie in lines that repeat an earlier line.
LINE_LIMIT = 0.20
MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"
BASE_N = 3
#: Multiplier of the rolling hash; odd, so that it has an inverse modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, dup_line_chars long, " + ", ".join(f"dup_{n}gram_chars long" for n in NGRAM_LIMITS)
)


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(n, BASE)], dtype=np.uint64)


def in_repeats(ids: np.ndarray, n: int) -> np.ndarray:
    """For each word, whether an n-word window that holds it is found twice or more.

    Windows are told apart by rolling hashes modulo 2**64 over scrambled word
    ids; windows of equal hash are then compared word by word with the first of
    their hash, so that a collision never counts as a repeat.
    """
    found = np.zeros(len(ids), dtype=bool)
    m = len(ids) - n + 1
    if m < 2:
        return found
    x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    power = _powers(n)
    rolled = np.zeros(m, dtype=np.uint64)
    for k in range(n):
        rolled += x[k : k + m] * power[n - 1 - k]
    order = np.argsort(rolled, kind="stable")
    h = rolled[order]
    same = h[1:] == h[:-1]
    if not same.any():
        return found
    first = np.flatnonzero(np.r_[True, ~same])
    head = order[np.repeat(first, np.diff(np.r_[first, m]))]
    pair = order != head
    a, b = order[pair], head[pair]
    equal = np.ones(len(a), dtype=bool)
    for k in range(n):
        equal &= ids[a + k] == ids[b + k]
    if not equal.all():  # a collision: compare the windows themselves
        windows = np.lib.stride_tricks.sliding_window_view(ids, n)
        _, inverse, count = np.unique(windows, axis=0, return_inverse=True, return_counts=True)
        starts = np.flatnonzero(count[inverse.ravel()] > 1)
    else:
        starts = np.concatenate([a, b])
    edge = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + n, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(text: str, limits: dict[int, float], line_limit: float) -> list:
    """The measures of one text, in the order of SCHEMA after doc_id."""
    number: dict[bytes, int] = {}
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    if raw.isascii():
        chars = np.array([len(w) for w in words], dtype=np.int64)
    else:
        chars = np.array([len(w.decode("utf-8", "surrogatepass")) for w in words], dtype=np.int64)
    total = int(chars.sum())
    seen: set[bytes] = set()
    dup_lines = dup_chars = 0
    for line in raw.split(b"\n"):
        own = line.split()
        if not own:
            continue
        if line in seen:
            dup_lines += 1
            dup_chars += sum(len(w.decode("utf-8", "surrogatepass")) for w in own)
        else:
            seen.add(line)
    symbols = sum(text.count(c) for c in SYMBOLS)
    repeat_words = int(in_repeats(ids, BASE_N).sum())
    covered = [int(chars[in_repeats(ids, n)].sum()) for n in limits]
    failed = len(words) < MIN_WORDS or 100 * repeat_words > 50 * len(words)
    kept = not failed and dup_chars <= line_limit * total and all(c <= share * total for c, share in zip(covered, limits.values(), strict=True))
    return [len(words), total, symbols, dup_lines, repeat_words, failed, kept, dup_chars, *covered]


def repetition(docs: DataFrame, limits: dict[int, float] | None = None, line_limit: float = LINE_LIMIT) -> DataFrame:
    """Repetition measures and verdict of every row of docs (doc_id, text), in one pass without a shuffle.

    n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines
    with a word that equal an earlier line), n_repeat_words (words in three-word
    windows found twice or more); base_failed where a text has under 50 words
    or over half of them repeat; dup_line_chars and dup_<n>gram_chars, the word
    characters inside repeated lines and n-grams. kept is false where
    base_failed or where a share of characters passes its limit.

    Null and empty texts have no words and fail the base rule. Repeated rows
    and null doc_ids are measured like any other; an empty table gives no rows;
    other columns are ignored. A text is measured whole, with some hundred bytes of
    memory for each of its words.
    """
    limits = dict(NGRAM_LIMITS if limits is None else limits)
    schema = SCHEMA.partition(", dup_5gram")[0] + "".join(f", dup_{n}gram_chars long" for n in limits)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(zip(*(measure(x.as_py(), limits, line_limit) for x in batch.column(1)), strict=True)) or [()] * (len(names) - 1)
            yield pa.record_batch([batch.column(0), *(pa.array(c, pa.bool_() if n in ("base_failed", "kept") else pa.int64()) for n, c in zip(names[1:], columns, strict=True))], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, schema)


def op4_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition(table(spark, sf_dir, "documents"))


def _sql() -> str:
    """The same measures in DuckDB SQL, windows compared as lists of words."""
    grams = [BASE_N, *NGRAM_LIMITS]
    ctes = []
    for n in grams:
        window = "concat_ws(' ', " + ", ".join(f"lead(w, {k}) OVER o" if k else "w" for k in range(n)) + ")"
        ctes.append(f"""
g{n} AS (SELECT k, i, CASE WHEN i + {n} - 1 <= n_words THEN {window} END AS g FROM words JOIN sizes USING (k) WINDOW o AS (PARTITION BY k ORDER BY i)),
r{n} AS (SELECT DISTINCT k, unnest(range(i, i + {n})) AS i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM g{n} WHERE g IS NOT NULL) WHERE c > 1),
c{n} AS (SELECT k, count(*) AS nw, sum(length(w)) AS nc FROM words JOIN r{n} USING (k, i) GROUP BY k)""")
    joins = "\n".join(f"LEFT JOIN c{n} USING (k)" for n in grams)
    shares = " AND ".join(f"coalesce(c{n}.nc, 0) <= CAST({share} AS DOUBLE) * word_chars" for n, share in NGRAM_LIMITS.items())
    covered = ", ".join(f"CAST(coalesce(c{n}.nc, 0) AS BIGINT) AS dup_{n}gram_chars" for n in NGRAM_LIMITS)
    space = "[ \\t\\n\\x0B\\x0C\\r]"
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT k, w, row_number() OVER (PARTITION BY k ORDER BY p) AS i FROM (
  SELECT k, unnest(l) AS w, generate_subscripts(l, 1) AS p FROM (SELECT k, regexp_split_to_array(text, '{space}+') AS l FROM d)) WHERE w <> ''),
sizes AS (SELECT k, count(*) AS n_words, sum(length(w)) AS word_chars FROM words GROUP BY k),
lines AS (SELECT k, line, count(*) AS c, sum(length(regexp_replace(line, '{space}', '', 'g'))) AS chars FROM (SELECT k, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_replace(line, '{space}', '', 'g') <> '' GROUP BY k, line),
dups AS (SELECT k, sum(c - 1) AS n_dup_lines, sum(chars - chars / c) AS dup_line_chars FROM lines GROUP BY k),{",".join(ctes)},
m AS (SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
  coalesce(c{BASE_N}.nw, 0) AS n_repeat_words, coalesce(dup_line_chars, 0) AS dup_line_chars, {covered},
  coalesce(n_words, 0) < {MIN_WORDS} OR 100 * coalesce(c{BASE_N}.nw, 0) > 50 * coalesce(n_words, 0) AS base_failed,
  {shares.replace("word_chars", "coalesce(word_chars, 0)")} AND coalesce(dup_line_chars, 0) <= CAST({LINE_LIMIT} AS DOUBLE) * coalesce(word_chars, 0) AS fine
FROM d LEFT JOIN sizes USING (k) LEFT JOIN dups USING (k)
{joins})
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND fine AS kept,
  CAST(dup_line_chars AS BIGINT) AS dup_line_chars, {", ".join(f"dup_{n}gram_chars" for n in NGRAM_LIMITS)} FROM m"""


ORACLE = _sql()
