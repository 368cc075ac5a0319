import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.llm import url_filter as uf

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host):])[0]
    return "".join(c.lower() if c.isascii() else c for c in host), path


def plain(url, rules=RULES):
    host, path = split(url)
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def test_whole_table_against_brute_force(spark, sf):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()}
    rows = uf.op13_url_filters(spark, sf).collect()
    assert {r.page_id for r in rows} == urls.keys() and len(rows) == len(urls)
    for r in rows:
        host, path, rule, verdict = plain(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        bad = bool(re.search(r"(^|[.-])(" + "|".join(uf.BAD_WORDS) + r")([.-]|$)", host))
        assert r.is_listed >= bad
        assert r.verdict == (verdict or ("block" if r.is_listed else "allow"))


def test_sql_agrees(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    r = con.sql(uf.ORACLE)
    df = uf.op13_url_filters(spark, sf)
    assert r.columns == df.columns
    assert sorted(map(str, r.fetchall())) == sorted(str(tuple(x)) for x in df.collect())


URLS = [
    None, "", "net/", "mailto:x", "http://net", "http://net/", "http://NET/x", "http://a.b.net/?q", "http://knet/", "ftp://example.net/en/", "ftp://www.example.net/en", "ftp://xexample.net/en/",
    "http://example.com/de/a", "http://example.com/de?x", "http://example.com/DE/", "http://a.org/fr/#x", "http://org/fr/http://net/", "http://a.org?/fr/", "http://é.net/ü", "://net/", "http:///en/", "http://net/" + "x" * 50_000, "http://..net/", "http://net./",
]


@pytest.mark.parametrize("most", [1, 1 << 20])
def test_odd_urls(spark, most):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(0, URLS[0]), (5, URLS[5]), (None, "http://net/")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("a.b", F.lit(1)).withColumn("row", F.lit(0))
    got = uf.judged(df, most_blocks=most).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == (*plain(r.url)[:3], plain(r.url)[3] or "allow"), r.url
    assert uf.judged(df.limit(0)).count() == 0
    assert {r.verdict for r in uf.judged(df, (), df.limit(0)).collect()} == {"allow"}


def test_listed_urls_by_canonical_form(spark):
    listed = spark.createDataFrame([("http://www.a.com/x/?utm_source=f&b=2&a=1#top",), ("https://b.com",), (None,), ("x",), ("https://b.com/",)], "url string")
    same = ["https://a.com/x?a=1&b=2", "https://A.com:443/x/?b=2&a=1&ref=q", "http://b.com/#z", "https://b.com?gclid=1"]
    other = ["https://a.com/x?a=1", "https://m.a.com/x?a=1&b=2", "https://a.com/X?a=1&b=2", "https://b.com/?refs=1", "https://b.com:8080/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(same + other)], "page_id long, url string")
    got = {r.url: (r.verdict, r.is_listed) for r in uf.judged(pages, (), listed).collect()}
    assert got == {u: ("block", True) for u in same} | {u: ("allow", False) for u in other}
    with pytest.raises(ValueError):
        uf.judged(pages, [("block", "net")])


def test_rules_of_many_shapes(spark):
    rng = np.random.default_rng(0)
    word = lambda n: "".join(rng.choice(list("ab"), n))
    rules = {".".join(word(1) for _ in range(rng.integers(1, 4))) + "/" + word(rng.integers(0, 4)): rng.choice(["allow", "block"]) for _ in range(60)}
    urls = ["http://" + ".".join(word(1) for _ in range(rng.integers(1, 5))) + "/" + word(rng.integers(0, 6)) for _ in range(500)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    flat = [(v, r.partition("/")[0], "/" + r.partition("/")[2]) for r, v in rules.items()]
    got = {r.page_id: (r.rule, r.verdict) for r in uf.judged(pages, [(str(v), r) for r, v in rules.items()]).collect()}
    for i, u in enumerate(urls):
        _, _, rule, verdict = plain(u, flat)
        assert got[i] == (rule, verdict or "allow")


def test_filter_holds_all_and_few_others(spark):
    keys = spark.range(20_000).select(F.xxhash64("id").alias("h"))
    bloom = uf.BlockedBloom.of(keys)
    assert len(bloom.words) == 2048
    assert bloom.may_hold(keys.toPandas()["h"].to_numpy()).all()
    others = spark.range(20_000, 60_000).select(F.xxhash64("id").alias("h")).toPandas()["h"].to_numpy()
    assert bloom.may_hold(others).mean() < 0.02
    assert not uf.BlockedBloom.of(keys.limit(0)).may_hold(others).any()
