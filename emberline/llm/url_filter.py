"""URL filters: host rules and listed URLs, met through a blocked Bloom filter and an exact join."""

from __future__ import annotations

import string
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .simhash import _met

#: (verdict, rule) of op13's contract: a host, its subdomains with it, and the start of a path (fixed values).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Words of a host's labels, cut at hyphens, whose pages op13's query lists (fixed values, of the kind that public URL filters use).
BAD_WORDS = ("adult", "ads", "bets", "casino", "pills", "porn", "spam", "xxx")
#: Parameters that name where a visitor came from, not what a page shows (fixed values).
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"
#: A block has 4 words of 64 bits, and each key a bit in each of them.
WORDS = 4
BITS_A_KEY = 16
#: The filter's blocks of 32 bytes, at most; a longer list makes it pass more, which the exact join then takes out.
MOST_BLOCKS = 1 << 20


def _lower(c):
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def parts(url):
    """host (A-Z lower-cased) and path of a URL column; both empty for null and where there is no ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return _lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def canonical(url):
    """A URL without scheme, "www.", usual port, fragment, tracking parameters and the path's last slash, its parameters sorted; null without a host."""
    host, path = parts(url)
    host = F.regexp_replace(host, r"^www\.|:(80|443)$", "")
    query = F.regexp_extract(url, r"^[^#]*?\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(TRACKING)))
    whole = F.concat(host, F.coalesce(F.nullif(F.regexp_replace(path, r"/$", ""), F.lit("")), F.lit("")), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))
    return F.when(host != "", whole)


class BlockedBloom:
    """A blocked Bloom filter over 64-bit hashes: a hash picks one block of 32 bytes, and a bit in each of its words."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @staticmethod
    def blocks_for(n: int, most: int = MOST_BLOCKS) -> int:
        return min(most, 1 << max(0, (n * BITS_A_KEY - 1) // (64 * WORDS)).bit_length())

    @staticmethod
    def places(h, blocks: int):
        """Column expressions of a hash column: the block, and the words with one bit each."""
        block = F.shiftrightunsigned(h, 40).bitwiseAND(blocks - 1)
        return block, [F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {6 * k}) & 63 AS INT))") for k in range(WORDS)]

    @classmethod
    def of(cls, hashes: DataFrame, most: int = MOST_BLOCKS) -> BlockedBloom:
        """The filter of hashes (h): bits are joined block by block in Spark; the driver gets `most` blocks at most."""
        blocks = cls.blocks_for(hashes.count(), most)
        block, bits = cls.places(F.col("h"), blocks)
        rows = hashes.select(block.alias("block"), *[b.alias(f"w{k}") for k, b in enumerate(bits)]).groupBy("block").agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(WORDS)]).toArrow()
        words = np.zeros((blocks, WORDS), dtype=np.uint64)
        if rows.num_rows:
            words[rows["block"].to_numpy()] = np.stack([rows[f"w{k}"].to_numpy() for k in range(WORDS)], axis=1).view(np.uint64)
        return cls(words)

    def may_hold(self, h: np.ndarray) -> np.ndarray:
        """False for hashes that are surely not in the filter."""
        h = h.view(np.uint64)
        block = (h >> np.uint64(40)).astype(np.int64) & (len(self.words) - 1)
        found = np.ones(len(h), dtype=bool)
        for k in range(WORDS):
            found &= (self.words[block, k] >> ((h >> np.uint64(6 * k)) & np.uint64(63))) & np.uint64(1) == 1
        return found


def listing(spark: SparkSession, rules: Sequence[tuple[str, str]], listed: DataFrame | None) -> DataFrame:
    """entry (unique), rule (null for a listed URL) and verdict of all that a URL is looked up in; of a URL or rule listed twice, "block" stays."""
    named = spark.createDataFrame([(r, r, v) for v, r in rules], "entry string, rule string, verdict string")
    if listed is not None:
        urls = listed.select(F.concat(F.lit("="), canonical(F.col("url"))).alias("entry")).where("entry IS NOT NULL").distinct()
        named = named.unionByName(urls.select("entry", F.lit(None).cast("string").alias("rule"), F.lit("block").alias("verdict")))
    return named.groupBy("entry").agg(F.max("rule").alias("rule"), F.max("verdict").alias("verdict"))


def _looked_up(host, path, own, rules: Sequence[tuple[str, str]]):
    """All entries that a URL may be found under: its canonical form, and each end of its host with each start of its path in a length that a rule has."""
    shapes = sorted({(r.partition("/")[0].count(".") + 1, len(r) - len(r.partition("/")[0])) for _, r in rules})
    ends = {n: F.substring_index(host, ".", -n) for n, _ in shapes}
    labels = F.size(F.split(host, r"\."))
    keys = [F.when((labels >= n) & (F.length(path) >= k), F.concat(ends[n], F.substring(path, 1, k))) for n, k in shapes]
    return F.array_compact(F.array(F.concat(F.lit("="), own), *keys))


def judged(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, listed: DataFrame | None = None, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """page_id, url, host, path, rule, verdict and is_listed of every row of pages (page_id, url).

    rules are (verdict, "host/path") pairs; a rule fits its host and all
    subdomains where the path starts with the rule's, and the longest that fits
    decides. Without a rule, a URL whose canonical form is that of one in listed
    (url) is blocked; all others are allowed. Rules and listed URLs go into one
    blocked Bloom filter, whose size has a bound; rows without a possible hit
    pass by without a shuffle, and possible hits are joined with the list
    exactly, very common entries by a broadcast.

    A null URL, or one without ://, has an empty host and path, no rule, and is
    allowed. Null page_ids and repeated rows stay; URLs may be of any length; an
    empty table gives no rows, and an empty list blocks nothing; other columns
    are ignored. Raises ValueError for a rule without a slash.
    """
    spark = pages.sparkSession
    if bad := [r for _, r in rules if "/" not in r]:
        raise ValueError(f"a rule is host/path: {bad}")
    entries = cut(listing(spark, rules, listed), "listed")
    bloom = spark.sparkContext.broadcast(BlockedBloom.of(entries.select(F.xxhash64("entry").alias("h")), most_blocks).words)

    @F.pandas_udf("array<boolean>")
    def may_hold(hashes: pd.Series) -> pd.Series:
        lengths = hashes.map(len).to_numpy()
        flat = np.concatenate(hashes.to_numpy()).astype(np.int64) if lengths.sum() else np.empty(0, np.int64)
        found = BlockedBloom(bloom.value).may_hold(flat)
        return pd.Series(np.split(found, np.cumsum(lengths)[:-1]) if len(lengths) else [], dtype=object)

    host, path = parts(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"), canonical(F.col("url")).alias("own"))
    rows = rows.select("page_id", "url", "host", "path", _looked_up(F.col("host"), F.col("path"), F.col("own"), rules).alias("keys"))
    tested = rows.withColumn("passes", may_hold(F.transform("keys", lambda k: F.xxhash64(k))))
    hits = F.filter("keys", lambda k, i: F.element_at("passes", i + 1))
    seen = cut(tested.select("page_id", "url", "host", "path", hits.alias("hits"), F.monotonically_increasing_id().alias("row")), "looked-up")

    possible = seen.select("row", F.explode("hits").alias("entry"))
    common = possible.groupBy("entry").agg(F.count("*").alias("n"))
    partners = cut(common.join(entries, "entry"), "hits")
    total = partners.agg(F.sum("n")).first()[0] or 0
    found = _met(possible, partners, "entry", total)
    rule = F.max(F.when(F.col("rule").isNotNull(), F.struct(F.length("rule").alias("long"), "rule", "verdict")))
    decided = found.groupBy("row").agg(rule.alias("by"), F.max(F.col("rule").isNull()).alias("is_listed"))
    verdict = F.coalesce("by.verdict", F.when(F.col("is_listed"), "block"), F.lit("allow"))
    columns = ["page_id", "url", "host", "path"]
    hit = seen.where(F.size("hits") > 0).join(decided, "row", "left").select(*columns, F.col("by.rule").alias("rule"), verdict.alias("verdict"), F.coalesce("is_listed", F.lit(False)).alias("is_listed"))
    free = seen.where(F.size("hits") == 0).select(*columns, F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"), F.lit(False).alias("is_listed"))
    return free.union(hit)


def bad_hosts(pages: DataFrame, words: Sequence[str] = BAD_WORDS) -> DataFrame:
    """url of each row of pages (url) with a host that holds one of the words between dots and hyphens."""
    host, _ = parts(F.col("url"))
    return pages.select("url").where(host.rlike(r"(^|[.-])(" + "|".join(words) + r")([.-]|$)"))


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list is made of the table itself: the URLs of all hosts with a bad word."""
    pages = table(spark, sf_dir, "pages")
    return judged(pages, RULES, bad_hosts(pages)).select("page_id", "host", "path", "rule", "verdict", "is_listed")


def _sql() -> str:
    words = "|".join(BAD_WORDS)
    tracked = TRACKING
    rules = ", ".join(f"('{v}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{r}')" for v, r in RULES)
    return f"""
WITH cut AS (SELECT row_number() OVER () AS k, page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
two AS (SELECT k, page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
    list_sort(list_filter(string_split(regexp_extract(url, '^[^#]*?\\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '{tracked}'))) AS params FROM cut),
own AS (SELECT *, regexp_replace(host, '^www\\.|:(80|443)$', '', 'g') AS bare, CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS query FROM two),
named AS (SELECT *, CASE WHEN bare <> '' THEN bare || regexp_replace(path, '/$', '') || query END AS canon FROM own),
listed AS (SELECT DISTINCT canon FROM named WHERE regexp_matches(host, '(^|[.-])({words})([.-]|$)')),
rules (verdict, h, p, rule) AS (VALUES {rules}),
best AS (SELECT k, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
    FROM named JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY k)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN l.canon IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, l.canon IS NOT NULL AS is_listed
FROM named LEFT JOIN best USING (k) LEFT JOIN listed l ON l.canon = named.canon"""


ORACLE = _sql()
