import itertools
import math
import random
from xml.etree import ElementTree

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.operators import facility, fitting, graph, prep, raster, scenario, spatial, summaries, weighted
from emberline.sources import tables
from emberline.sources.cities import City, Registry
from emberline.streaming.live import busy_by_window


def times_table(spark, n_sites, n_cells, seed):
    rng = random.Random(seed)
    w = [rng.randrange(1, 9) for _ in range(n_cells)]
    t = {(s, c): float(rng.randrange(50, 900)) for s in range(n_sites) for c in range(n_cells)}
    df = spark.createDataFrame([(s, c, float(w[c]), v) for (s, c), v in t.items()], "site_id long, cell_id long, w double, t double").coalesce(1).persist()

    def value(chosen, coverage=False):
        best = [min(t[s, c] for s in chosen) for c in range(n_cells)]
        return sum(x * (-(b <= 480) if coverage else b) for x, b in zip(w, best, strict=True)) / sum(w)

    return df, value


@pytest.mark.parametrize("coverage", [False, True])
def test_one_pass_swaps_equal_brute_force(spark, coverage):
    df, value = times_table(spark, 7, 15, 3)
    objective = facility.COVERAGE if coverage else facility.RESPONSE
    for chosen in ([0, 2, 5], [4]):
        got = {(r.out_site, r.in_site): r.value for r in facility.swap_values(df, chosen, objective).collect()}
        want = {(o, i): value([x for x in chosen if x != o] + [i], coverage) for o in chosen for i in range(7) if i not in chosen}
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-8) for k in want)


def test_planners(spark):
    df, value = times_table(spark, 7, 15, 4)
    first = facility.greedy(df, 1)
    assert value(first) == min(value([s]) for s in range(7))
    r = facility.redesign(df, 2)
    assert r.value == pytest.approx(value(r.sites)) and r.value <= r.first_value
    e = facility.expand(df, [0, 1], 1)
    assert set(e.sites) >= {0, 1} and e.value == pytest.approx(min(value([0, 1, s]) for s in range(2, 7)))
    m = facility.replace(df, [0, 1, 2], 1)
    best = min(value([x for x in (0, 1, 2) if x != o] + [i]) for o in (0, 1, 2) for i in range(3, 7))
    assert m.value == pytest.approx(min(best, value([0, 1, 2])))
    with pytest.raises(ValueError):
        facility.replace(df, [0], 0)
    with pytest.raises(ValueError):
        facility.greedy(df, 1, "fame")


@pytest.mark.parametrize(("seed", "coverage", "locked"), [(5, False, ()), (6, True, ()), (7, False, (1,))])
def test_interchange_makes_the_swaps_of_a_walk_through_the_places(spark, monkeypatch, seed, coverage, locked):
    df, value = times_table(spark, 9, 20, seed)
    objective = facility.COVERAGE if coverage else facility.RESPONSE
    sites, swaps, better = [0, 1, 2], [], True
    now = value(sites, coverage)
    while better:
        better = False
        for place in range(3):
            if sites[place] in locked:
                continue
            options = [(round(value([*sites[:place], i, *sites[place + 1 :]], coverage), 9), i) for i in range(9) if i not in sites]
            if min(options)[0] < now - 1e-9:
                swaps.append((sites[place], min(options)[1]))
                now, sites[place] = min(options)
                better = True
    passes, one = [], facility.swap_values
    monkeypatch.setattr(facility, "swap_values", lambda *a: passes.append(1) or one(*a))
    got = facility.improve(df, [0, 1, 2], objective, locked=locked)
    assert (got.swaps, got.sites) == (swaps, sites) and got.value == pytest.approx(now)
    assert swaps and len(passes) == len(swaps) + 1
    passes.clear()
    none = facility.improve(df, [0, 1, 2], objective, rounds=0)
    assert none.sites == [0, 1, 2] and not none.swaps and not passes
    assert facility.improve(df, [0, 1, 2], objective, locked=(0, 1, 2)).swaps == []


def test_weighted_quantiles(spark):
    rng = random.Random(1)
    rows = [(float(rng.randrange(300, 320)), float(rng.randrange(0, 5))) for _ in range(60)] + [(360.0, 2.0), (600.0, 1.0)]
    df = spark.createDataFrame(rows, "response_s double, w double")
    v = np.array(sorted({x for x, _ in rows}))
    w = np.array([sum(b for a, b in rows if a == x) for x in v])
    cum = np.cumsum(w)
    run = weighted.running_weight(df, width=7.0)
    for q in (0.01, 0.5, 0.9, 1.0):
        got = weighted.interpolated_quantile(run, q, "x").first().x
        assert got == pytest.approx(np.interp(q * cum[-1], cum, v))
    s = weighted.score_first_engine(df, weight="w").first()
    step = np.cumsum(w[w > 0]) / w.sum()
    assert s.p90_s == v[w > 0][np.searchsorted(step, 0.9)] and s.mean_s == pytest.approx((v * w).sum() / w.sum())
    assert s.share_within_10min == 1.0 and s.passes == 1


def test_curves_on_the_driver_and_in_spark_agree(spark, monkeypatch):
    rng = np.random.default_rng(4)
    km = rng.uniform(0.2, 8, 200)
    sec = np.where(km <= 2, 20 + 150 * np.sqrt(km), 110 + 60 * km) + rng.normal(0, 9, 200)
    df = spark.createDataFrame(list(zip(km.tolist(), sec.tolist(), strict=True)), "km double, seconds double")
    for robust in (False, True):
        own = fitting.fit_curve(df, robust, rounds=4)
        with monkeypatch.context() as m:
            m.setattr(fitting, "LOCAL", 0)
            dealt = fitting.fit_curve(df, robust, rounds=4)
        assert (own.a, own.b, own.c, own.e, own.breakpoint_km) == pytest.approx((dealt.a, dealt.b, dealt.c, dealt.e, dealt.breakpoint_km), rel=1e-7)


def test_robust_curve(spark):
    rng = np.random.default_rng(2)
    km = rng.uniform(0.2, 8, 150)
    sec = np.where(km <= 2, 20 + 150 * np.sqrt(km), 110 + 60 * km) + rng.normal(0, 2, 150)
    sec[::15] += 800
    c = fitting.fit_curve(spark.createDataFrame(list(zip(km.tolist(), sec.tolist(), strict=True)), "km double, seconds double"), rounds=6)
    assert c.e == pytest.approx(60, abs=2) and c.b == pytest.approx(150, abs=15)
    few = fitting.fit_curve(spark.createDataFrame([(1.0, 70.0), (2.0, 130.0), (3.0, 190.0)], "km double, seconds double"))
    assert (few.breakpoint_km, few.e) == (0.0, pytest.approx(60))
    with pytest.raises(ValueError):
        fitting.fit_curve(spark.createDataFrame([(1.0, 70.0)], "km double, seconds double"))


def test_robust_curve_of_many_pairs(spark, monkeypatch):
    """Fitted by tasks, the curve is that of numpy, without a row for each pair and breakpoint."""
    rng = np.random.default_rng(4)
    km = np.round(rng.uniform(0.2, 8, 701), 2)
    sec = np.where(km <= 2, 20 + 150 * np.sqrt(km), 110 + 60 * km) + np.round(rng.normal(0, 2, 701))
    sec[::15] += 5000
    df = spark.createDataFrame(list(zip(km.tolist(), sec.tolist(), strict=True)), "km double, seconds double")
    own = fitting.fit_curve(df, rounds=5)
    monkeypatch.setattr(fitting, "LOCAL", 0)
    monkeypatch.setattr(fitting, "MEDIAN_BUCKETS", 7)
    monkeypatch.setattr(fitting, "_fit_segments", None)
    dealt = fitting.fit_curve(df.repartition(5), rounds=5)
    assert (own.a, own.b, own.c, own.e, own.breakpoint_km) == pytest.approx((dealt.a, dealt.b, dealt.c, dealt.e, dealt.breakpoint_km), rel=1e-7)


def test_medians_of_many_pairs_looked_for_in_wrong_places(spark, monkeypatch):
    """Wherever the search begins and however few values are taken, medians of segments are exact, in a bounded number of passes."""
    rng = np.random.default_rng(6)
    km = np.sort(np.round(rng.uniform(0.2, 8, 900), 2))
    z = 100 * km + np.round(rng.normal(0, 40, 900)) + 3000 * (rng.random(900) < 0.1)
    df = spark.createDataFrame(list(zip(km.tolist(), z.tolist(), strict=True)), "km double, seconds double").repartition(3)
    breaks, lines = [1.0, 5.0], np.array([[0.0, 90.0], [5.0, 99.0], [10.0, 150.0], [0.0, 101.0]])
    rs = [r for _, _, _, r in fitting._residuals(km, z, breaks, lines)]
    n, middle = np.array([len(r) for r in rs]), np.array([np.median(r) for r in rs])
    monkeypatch.setattr(fitting, "FEW", 5)
    for pilot in ((np.zeros(0), np.zeros(0)), (km[::2], z[::2]), (km, z + 500)):
        assert fitting._segment_medians(df, breaks, lines, None, n, pilot).tolist() == middle.tolist()
        assert fitting._segment_medians(df, breaks, lines, middle, n, pilot).tolist() == [np.median(np.abs(r - m)) for r, m in zip(rs, middle, strict=True)]


def test_drive_curve_is_fitted_to_all_pairs(spark, monkeypatch):
    """No pair of over 50,000 is left out."""
    pairs = spark.range(60_000).selectExpr("id AS incident_id", "0.1 + id % 997 / 100 AS crow_km", "100 + id % 997 + id % 13 AS observed_s")
    seen = []
    monkeypatch.setattr(fitting, "fit_curve", lambda p: seen.append(p.count()))
    _, about = fitting.fit_drive_curve(pairs)
    assert seen == [60_000] and about["n_pairs"] == 60_000


def test_paths_turns_and_components(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(rng.randrange(9), rng.randrange(9), k, float(rng.randrange(1, 20))) for k in range(26)]
    e = spark.createDataFrame(rows, "u long, v long, key int, length double")
    best = {}
    for a, b, _, n in rows:
        best[a, b] = min(n, best.get((a, b), 1e9))
    d = {(a, b): 0.0 if a == b else best.get((a, b), math.inf) for a in range(9) for b in range(9)}
    for k, i, j in itertools.product(range(9), repeat=3):
        d[i, j] = min(d[i, j], d[i, k] + d[k, j])
    origins = spark.createDataFrame([(0,), (4,)], "origin long")
    want = {(o, n): d[o, n] for o in (0, 4) for n in range(9) if d[o, n] < math.inf}
    for f in (graph.shortest_paths, graph.search_by_origin):
        assert {(r.origin, r.node): r.dist for r in f(e, origins).collect()} == want
    sums = graph.tree_sums(graph.shortest_paths(e, origins), e, ["length"])
    assert {(r.origin, r.node): r.length for r in sums.collect()} == want
    groups = {}
    nodes = {x for r in rows for x in r[:2]}
    for n in nodes:
        groups.setdefault(frozenset(m for m in nodes if d[n, m] < math.inf and d[m, n] < math.inf), 0)
    want = max(groups, key=lambda g: (len(g), -min(g)))
    assert {r.node for r in graph.largest_component(e).collect()} == want
    monkeypatch.setattr(graph, "SMALL_GRAPH", 1)
    assert {r.node for r in graph.largest_component(e).collect()} == want
    assert graph.largest_component(e.where("false")).count() == 0


def test_nearest_by_cells_equals_broadcast(spark):
    rng = random.Random(3)
    pts = spark.createDataFrame([(i, 51 + rng.random() * 2, rng.random() * 3) for i in range(60)], "id long, lat double, lon double")
    sites = spark.createDataFrame([(i, 51 + rng.random() * 0.3, rng.random() * 0.5) for i in range(25)], "site long, s_lat double, s_lon double")
    plain = spatial.nearest(pts, "id", sites, "site", spatial.crow(), k=2)
    cells = spatial.nearest(pts, "id", sites, "site", spatial.crow(), k=2, small=0)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, cells.collect()))


def test_nearest_anywhere_on_earth(spark):
    """Near the poles, across the date line, far from all sites, and with fewer sites than asked for."""
    rng = random.Random(5)
    places = [(rng.uniform(-89.9, 89.9), rng.uniform(-180, 180)) for _ in range(80)] + [(89.5, 10.0), (89.6, -170.0), (-89.9, 0.0), (0.0, 179.99), (0.0, -179.99)]
    pts = spark.createDataFrame([(i, a, o) for i, (a, o) in enumerate(places)], "id long, lat double, lon double")
    at = [(rng.uniform(60, 89.9), rng.uniform(-180, 180)) for _ in range(20)] + [(0.0, -179.9), (0.01, 179.8)]
    sites = spark.createDataFrame([(i, a, o, "ab"[i % 2]) for i, (a, o) in enumerate(at)], "site long, s_lat double, s_lon double, kind string")
    for k in (1, 3, 30):
        plain = spatial.nearest(pts, "id", sites, "site", spatial.crow(), k=k, small=100)
        cells = spatial.nearest(pts, "id", sites, "site", spatial.crow(), k=k, small=0)
        assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, cells.collect()))
    both = pts.withColumn("kind", F.explode(F.array(F.lit("a"), F.lit("b"))))
    want = sorted((r.id, kind, r.site, r.km) for kind in "ab" for r in spatial.nearest(pts, "id", sites.where(F.col("kind") == kind), "site", spatial.crow(), small=100).collect())
    assert sorted((r.id, r.kind, r.site, r.km) for r in spatial.nearest(both, ["id", "kind"], sites, "site", spatial.crow(), small=0, by="kind").collect()) == want
    assert spatial.nearest(pts, "id", sites.where("false"), "site", spatial.crow()).count() == 0


def test_blur_keeps_all_incidents(spark):
    g = spark.createDataFrame([(0.0, 0.0, 1.0, 6, 5)], "x0 double, y0 double, px double, nx int, ny int")
    p = spark.createDataFrame([("all", 0, 0, 3), ("all", 4, 5, 1)], "layer string, row int, col int, n long")
    assert raster.blur(p, g).agg(F.sum("v")).first()[0] == pytest.approx(4.0)


def test_guards_and_tracks(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2020)], "id long, cal_year int")
    with pytest.raises(ValueError):
        prep.year_split(rows, [1999], [])
    assert prep.year_split(rows, [2020], [2021])[1] is None
    assert prep.year_split(rows.drop("cal_year"), [2020], [])[1] is None
    steps = spark.createDataFrame([("a", 0, 0.0, 0.0, 0.0, 100.0), ("a", 1, 10.0, 1.0, 0.0, 100.0), ("a", 2, 30.0, 1.0, 3.0, 100.0)], "k string, seq int, seconds double, x double, y double, total double")
    got = {r.i: (r.t, r.x, r.y) for r in scenario.track(steps, "k", "total", 5).collect()}
    assert got[0] == (0.0, 0.0, 0.0) and got[4] == pytest.approx((100.0, 1.0, 3.0)) and got[1] == pytest.approx((25.0, 1.0, 0.0))
    registry = Registry()
    registry.add(City("new-york", incidents="x"))
    assert registry.get(" New York", stations="s").required("stations").incidents == "x"
    with pytest.raises(FileNotFoundError):
        registry.get("NEW_YORK").required("stations")
    empty = rows.where("false")
    tables.write(empty, str(tmp_path / "out"), "csv")
    tables.write_json(rows, str(tmp_path / "json"))
    assert spark.read.text(str(tmp_path / "json")).first().value == '{"id":1,"cal_year":2020}'
    (tmp_path / "in.csv").write_bytes("﻿facilityname,lat,x\nA,1.5,\n".encode())
    assert [tuple(r) for r in tables.csv(spark, str(tmp_path / "in.csv"), columns=["facilityname", "lat", "none"]).collect()] == [("A", "1.5")]
    (tmp_path / "g.xml").write_text('<graphml><graph><node id="1"><data key="d0">51.5</data></node><edge source="1" target="2"><data key="d1">80</data></edge></graph></graphml>')
    nodes, edges = tables.graphml(spark, str(tmp_path / "g.xml"))
    assert nodes.first().data == {"d0": "51.5"} and edges.first().target == "2"


def test_graphml_is_written_and_read_once(spark, tmp_path):
    nodes = spark.createDataFrame([("1", {"x": "0.5", "name": 'a <b> & "c"'}), ("2", {"x": None}), ("3", None)], "id string, data map<string,string>")
    edges = spark.createDataFrame([("1", "2", {"length": "80"}), ("1", "2", {"length": "90"}), ("2", "1", {})], "source string, target string, data map<string,string>")
    path, built = str(tmp_path / "g"), []
    make = lambda: built.append(1) or (nodes, edges)
    for _ in range(2):
        n, e = tables.graphml_once(spark, path, make)
        assert {r.id: r.data or {} for r in n.collect()} == {"1": {"x": "0.5", "name": 'a <b> & "c"'}, "2": {}, "3": {}}
        assert sorted((r.source, r.target, (r.data or {}).get("length")) for r in e.collect() if r.source == "1") == [("1", "2", "80"), ("1", "2", "90")] and e.count() == 3
    assert built == [1]
    part = next((tmp_path / "g").glob("part-*")).read_bytes()
    root = ElementTree.fromstring(part)
    space = "{http://graphml.graphdrawing.org/xmlns}"
    assert [len(root.findall(f".//{space}{t}")) for t in ("key", "node", "edge")] == [3, 3, 3]
    (tmp_path / "g" / "_SUCCESS").unlink()
    tables.graphml_once(spark, path, make)
    assert built == [1, 1]
    tables.write_graphml(nodes.where("false"), edges.where("false"), str(tmp_path / "none"))
    assert [df.count() for df in tables.graphml(spark, str(tmp_path / "none"))] == [0, 0]


def test_stream_of_incidents(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:10:00", "A", "A"), ("2024-01-01 00:20:00", "A", "B"), ("2024-01-01 01:20:00", "A", "B"), ("2024-01-01 01:30:00", None, "B")], "ts string, station_ground string, deployed_from_station string").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    q = busy_by_window(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("busy").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.n_incidents, r.n_busy) for r in spark.sql("SELECT * FROM busy").collect()) == [(1, 1), (2, 1)]


def test_exact_samples_and_funnels(spark):
    rows = spark.range(100).withColumnRenamed("id", "k")
    a = sorted(r.k for r in prep.sample_exactly(rows, "k", 17).collect())
    assert len(a) == 17 and a == sorted(r.k for r in prep.sample_exactly(rows.repartition(5), "k", 17).collect())
    ranks = summaries.with_rank(rows.select("k", (F.col("k") % 7).cast("double").alias("v")), "v", "k", parts=4)
    assert [r.rank for r in ranks.orderBy("v", "k").collect()] == list(range(1, 101))


def test_plain_curve_counts_each_pair_once(spark, monkeypatch):
    """Without weights no pair is made anew for each breakpoint, and quantiles hold no group whole."""
    rng = np.random.default_rng(6)
    km = rng.uniform(0.2, 8, 300)
    df = spark.createDataFrame(list(zip(km.tolist(), (50 + 70 * km + rng.normal(0, 9, 300)).tolist(), strict=True)), "km double, seconds double")
    own = fitting.fit_curve(df, robust=False)
    monkeypatch.setattr(fitting, "LOCAL", 0)
    monkeypatch.setattr(fitting, "_fit_segments", None)
    monkeypatch.setattr(fitting.F, "percentile", None)
    dealt = fitting.fit_curve(df, robust=False)
    assert (own.a, own.b, own.c, own.e, own.breakpoint_km) == pytest.approx((dealt.a, dealt.b, dealt.c, dealt.e, dealt.breakpoint_km), rel=1e-7)


def test_largest_component_by_contraction(spark, monkeypatch):
    """Two-way streets shrink by ranges of numbers, so that no search goes on step by step."""
    rng = random.Random(8)
    e = [(a * 40 + b, a * 40 + b + s) for a in range(8) for b in range(39) for s in (1,)] + [(i, i + 40) for i in range(280) if i % 3]
    e += [(v, u) for u, v in e if rng.random() < 0.8] + [(1000, 1001), (1001, 1000), (5000, 5001)]
    df = spark.createDataFrame(e, "u long, v long")
    want = sorted(r.node for r in graph.largest_component(df).collect())
    monkeypatch.setattr(graph, "SMALL_GRAPH", 300)
    monkeypatch.setattr(graph, "RANGE_EDGES", 60)
    monkeypatch.setattr(graph, "reached", None)
    assert sorted(r.node for r in graph.largest_component(df).collect()) == want
    two = spark.createDataFrame([(i, (i + 1) % 50) for i in range(50)] + [(100 + i, 100 + (i + 1) % 60) for i in range(60)] + [(0, 100)], "u long, v long")
    monkeypatch.setattr(graph, "SMALL_GRAPH", 8)
    monkeypatch.setattr(graph, "RANGE_EDGES", 80)
    assert len(want) > 200 and graph.largest_component(two).count() == 60
