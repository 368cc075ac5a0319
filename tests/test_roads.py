"""Streets under trips, matching of sources, model files: against plain Python."""

import heapq
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.operators import fitting, graph, ml, prep, roads, scenario, spatial
from emberline.plans import more, planner
from emberline.plans import queries as plans

TABLES = "region nation customer supplier part orders lineitem events".split()
QUICK = ["road_speed", "ground_centroids", "fill_dates", "matched_features", "closed_presence", "hexbin", "held_out_snap", "held_out_observed", "cell_output", "held_out_models", "bng_to_wgs84", "demo_city", "largest_scc", "route_ratios", "training_rows_by_road", "engine_routes"]


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", QUICK)
def test_parity(spark, sf, con, name):
    df, want = plans.QUERIES[name](spark, sf), con.sql(plans.ORACLES[name])
    assert df.columns == want.columns
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want.fetchall()))


def made(seed, n=40, m=160):
    rng = random.Random(seed)
    rows = [(rng.randrange(n), rng.randrange(n), k, float(rng.randrange(1, 9)), rng.random(), rng.uniform(0, 360), rng.uniform(0, 360)) for k in range(m)]
    return [r for r in rows if r[0] != r[1]]


SCHEMA = "u long, v long, key int, length double, x double, bearing_start double, bearing_end double"


def test_routes_against_a_plain_search(spark, monkeypatch):
    rows = made(3)
    best = {}
    for r in sorted(rows, key=lambda r: (r[3], r[2])):
        best.setdefault(r[:2], r)
    pairs = [(o, d) for o in (0, 5, 9, 77) for d in range(0, 44, 3)]
    want = {}
    for o in {p[0] for p in pairs}:
        dist, done, heap = {o: 0.0}, {}, [(0.0, o)]
        while heap:
            d, u = heapq.heappop(heap)
            if u in done:
                continue
            into = min((a for (a, b), r in best.items() if b == u and a in done and done[a][0] + r[3] == d), default=None) if u != o else None
            if u == o:
                done[u] = (0.0, 0.0, 0, 0, None)
            else:
                r = best[into, u]
                up = done[into]
                bend = 0.0
                if up[4] is not None:
                    bend = abs(up[4] - r[5]) % 360
                    bend = min(bend, 360 - bend)
                done[u] = (d, up[1] + r[4], up[2] + (bend > 45), up[3] + (bend > 120), r[6])
            for (a, b), r in best.items():
                if a == u and d + r[3] < dist.get(b, 1e9):
                    dist[b] = d + r[3]
                    heapq.heappush(heap, (d + r[3], b))
        want |= {(o, d): done.get(d) if o < 40 and any(o in k for k in best) else None for x, d in pairs if x == o}
    e, asked = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([*pairs, *pairs[:5], (None, 3)], "origin long, node long")
    got = {(r.origin, r.node): r for r in roads.route_table(e, asked, values=["x"], bearings=True).collect()}
    assert set(got) == set(pairs)
    for p, r in got.items():
        w = want[p]
        assert r.found == (w is not None)
        if w:
            assert (r.dist, r.n_turns, r.n_sharp_turns) == (w[0], w[2], w[3]) and r.x == pytest.approx(w[1])
    monkeypatch.setattr(graph, "SMALL_GRAPH", 5)
    joined = {(r.origin, r.node): r for r in roads.route_table(e, asked, values=["x"], bearings=True).collect()}
    assert joined.keys() == got.keys()
    for p, r in joined.items():
        assert (r.found, r.dist, r.n_turns, r.n_sharp_turns) == (got[p].found, got[p].dist, got[p].n_turns, got[p].n_sharp_turns)
        assert not r.found or r.x == pytest.approx(got[p].x)


@pytest.mark.parametrize("small", [1, 30])
def test_routes_around_groups_of_origins(spark, monkeypatch, small):
    """Each group's part of a graph that no task holds whole gives the routes of the whole graph, far pairs and places that mislead among them."""
    rng = random.Random(small)
    rows, place = [], []
    for i in range(14):
        for j in range(14):
            place.append((i * 14 + j, 51.0 + i * 0.01, j * 0.01) if rng.random() < 0.9 else (i * 14 + j, 51.0 + rng.random(), rng.random()))
            for a, b in ((i + 1, j), (i, j + 1)):
                if a < 14 and b < 14:
                    u, v = i * 14 + j, a * 14 + b
                    own = (0, float(rng.randrange(1, 9)), rng.random(), rng.uniform(0, 360), rng.uniform(0, 360))
                    rows += [(u, v, *own)] if (i + j) % 5 == 0 or rng.random() < 0.1 else [(u, v, *own), (v, u, *own)]
    e = spark.createDataFrame(rows, SCHEMA)
    pairs = [(rng.randrange(196), rng.randrange(196)) for _ in range(300)] + [(3, 3), (500, 500), (500, 2), (2, 500)]
    asked, places = spark.createDataFrame(pairs, "origin long, node long"), spark.createDataFrame(place[:190], "node long, lat double, lon double")
    want = {(r.origin, r.node): r for r in roads.route_table(e, asked, values=["x"], bearings=True).collect()}
    monkeypatch.setattr(graph, "SMALL_GRAPH", small)
    monkeypatch.setattr(roads, "GROUPS", 5)
    monkeypatch.setattr(graph, "shortest_paths", None)  # no distances from an origin to all nodes
    ranked = {r.node: r["rank"] for r in graph.ranks(e).collect()}
    assert all(ranked[r[0]] <= ranked[r[1]] for r in rows)
    got = {(r.origin, r.node): r for r in roads.route_table(e, asked, values=["x"], bearings=True, places=places).collect()}
    assert got.keys() == want.keys() and 0 < sum(r.found for r in want.values()) < len(want)
    for p, r in got.items():
        w = want[p]
        assert (r.found, r.dist, r.n_turns, r.n_sharp_turns) == (w.found, w.dist, w.n_turns, w.n_sharp_turns)
        assert r.x == (None if w.x is None else pytest.approx(w.x))


def grid(spark, side=12):
    """The small street grid of the survey's sampling check: kinds, limits and lanes drawn at random, both ways open."""
    rng = random.Random(0)
    kinds = [("primary", "48 km/h", "3"), ("residential", "20 mph", "1"), ("secondary", "30 mph", "2")]
    rows = []
    for i in range(side):
        for j in range(side):
            for a, b in ((i + 1, j), (i, j + 1)):
                if a < side and b < side:
                    kind, limit, lanes = rng.choice(kinds)
                    length = 555.0 if a > i else 554.0
                    for u, v in ((i * side + j, a * side + b), (a * side + b, i * side + j)):
                        rows.append((u, v, 0, length, kind, limit, lanes, None))
    return spark.createDataFrame(rows, "u long, v long, key int, length double, highway string, maxspeed string, lanes string, width string")


def test_fit_and_sampling_check(spark):
    """400 trips, four in five to learn from: on the others the fitted weights miss by less than the prior."""
    e = grid(spark)
    rng = random.Random(42)
    trips = []
    while len(trips) < 400:
        o, d = rng.randrange(144), rng.randrange(144)
        km = 0.555 * math.hypot(o // 12 - d // 12, o % 12 - d % 12)
        if km > 0.3:
            trips.append((len(trips), o, d, 14, 146.0 + 72.0 * km))
    df = spark.createDataFrame(trips, "trip long, origin long, node long, hour int, seconds double")
    learn, test = df.where("trip % 5 > 0"), df.where("trip % 5 = 0")
    weights, log = roads.reroute_fit(e, learn)
    again, _ = roads.reroute_fit(e.repartition(3), learn.repartition(5))
    assert again == pytest.approx(weights)
    assert log[0]["trips"] == 320 == log[0]["changed"] and len(log) > 1
    assert len(log) == 5 or log[-1]["changed"] == 0
    prior = roads.reroute_fit(e, test, rounds=1)[1][0]["mae"]
    fitted = roads.reroute_fit(e, test, rounds=1, prior=weights)[1][0]["mae"]
    assert fitted < prior
    assert roads.reroute_fit(e, df.where("false"))[1] == [{"trips": 0, "changed": 0, "mae": None}]


def test_sampling_check_equals_a_plain_fit(spark):
    """Both errors on held-out trips equal those of a dense fit over routes found by relaxation."""
    e = grid(spark)
    trips = spark.createDataFrame([(i, (i * 37) % 144, (i * 61 + 5) % 144, i % 24, 60.0 + (i * 29) % 400) for i in range(200)] + [(900, 3, 3, 1, 9.0), (901, 3, 999, 1, 9.0)], "trip long, origin long, node long, hour int, seconds double")
    got = {r.model: (r.n, r.mae) for r in roads.sampling_check(e, trips, F.col("trip") % 5 == 0).collect()}
    rows, cols, _ = graph.segment_features(e, F.lit(0))
    edges = {(r.u, r.v): r for r in rows.select("u", "v", "length", F.array(*[c.cast("double") for c in cols]).alias("x")).collect()}
    out = {}
    for u, v in edges:
        out.setdefault(u, []).append(v)
    x, y, test = [], [], []
    for t in trips.where("origin <> node").collect():
        dist, todo = {t.origin: 0.0}, [t.origin]
        while todo:
            u = todo.pop(0)
            for v in out.get(u, ()):
                if dist[u] + edges[u, v].length < dist.get(v, math.inf):
                    dist[v] = dist[u] + edges[u, v].length
                    todo.append(v)
        if t.node not in dist:
            continue
        sums, at = np.zeros(len(cols)), t.node
        while at != t.origin:
            u = min(u for u in out[at] if at in out[u] and dist[u] + edges[u, at].length == dist[at])  # the grid is two-way
            sums += edges[u, at].length / 1000 * np.array(edges[u, at].x)
            at = u
        km, a = sums[0], 2 * math.pi * t.hour / 24
        sums[-3:] = km * (7 <= t.hour <= 9 or 16 <= t.hour <= 19), km * math.sin(a), km * math.cos(a)
        x.append(sums)
        y.append(t.seconds)
        test.append(t.trip % 5 == 0)
    x, y, test, prior = np.array(x), np.array(y), np.array(test), np.array(graph.prior_weights())
    a = x[~test].T @ x[~test]
    c = 1e-3 * (~test).sum() * (np.trace(a) / (~test).sum() + 1e-9) / len(prior)
    w = np.linalg.solve(a + c * np.eye(len(prior)), x[~test].T @ y[~test] + c * prior)
    for name, weights in (("prior", prior), ("fitted", w)):
        assert got[name] == (test.sum(), pytest.approx(np.abs(x[test] @ weights - y[test]).mean(), rel=1e-6))
    assert len(y) == 200 - sum(i * 37 % 144 == (i * 61 + 5) % 144 for i in range(200)) and got["fitted"][1] != got["prior"][1]
    assert [tuple(r) for r in roads.sampling_check(e, trips, F.lit(False)).orderBy("model").collect()] == [("fitted", 0, None), ("prior", 0, None)]


def test_times_of_the_models_own_are_found_again(spark):
    """Trips whose times the model made itself leave its weights where they are."""
    e = grid(spark)
    truth = [20.0, 1.3, 4.0, 0.5, *[3.0 * i for i in range(7)], 9.0, 2.0, -3.0]
    truth = (truth + [0.0] * 14)[: len(graph.prior_weights())]
    trips = spark.createDataFrame([(i, (i * 37) % 144, (i * 61 + 5) % 144, i % 24, 0.0) for i in range(600)], "trip long, origin long, node long, hour int, seconds double")
    rows, cols, names = graph.segment_features(e, F.lit(8))
    cost = rows.withColumn("cost", graph.slowness(cols, truth) * F.col("length") / 1000)
    at8 = trips.withColumn("hour", F.lit(8))
    routes = roads.route_table(cost, at8.select("origin", "node"), "cost").select("origin", "node", F.col("dist").alias("seconds"))
    timed = at8.drop("seconds").join(routes, ["origin", "node"])
    weights, log = roads.reroute_fit(e, timed, prior=truth)
    assert weights == pytest.approx(truth, abs=1e-6) and log[-1]["changed"] == 0 and log[-1]["mae"] == pytest.approx(0, abs=1e-6)


def test_repeated_incidents_and_stations_do_not_multiply_trips(spark, sf):
    inc, st, mob = (f(spark, sf) for f in (plans.fx.incidents, plans.fx.stations, plans.fx.mobilisations))
    want = prep.training_rows(mob, inc, st)
    twice = prep.training_rows(mob, inc.unionByName(inc.withColumn("hour_of_call", F.lit(99))), st.unionByName(st.withColumn("lat", F.col("lat") + 1)))
    assert sorted(map(str, want.collect())) == sorted(map(str, twice.collect()))
    assert prep.funnel(mob, inc.unionByName(inc), st.unionByName(st)).orderBy("step").collect() == prep.funnel(mob, inc, st).orderBy("step").collect()
    assert prep.trips_with_origin(inc, st.unionByName(st)).count() == prep.trips_with_origin(inc, st).count()


def test_road_rows_have_the_19_features(spark, sf):
    df = more._by_road(spark, sf)
    features = [c for c in df.columns if c.startswith("share_") or c.endswith("_per_km") or c == "mean_lanes"]
    assert len(features) == 19
    shares = [f"share_{g}" for g in graph.ROAD_GROUPS]
    off = df.where(F.col("start_node") != F.col("dest_node")).select(F.abs(sum(F.col(c) for c in shares) - 1).alias("d")).agg(F.max("d")).first()[0]
    assert off < 1e-9


def test_models_are_read_as_written(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = rng.uniform(0, 10, (300, 2))
    rows = spark.createDataFrame([(float(a), float(b), float(30 * a + b)) for a, b in x], "a double, b double, drive_s double")
    models = ml.fit_bag(rows, ["a", "b"], seeds=(1, 2), growth=ml.Growth(trees=3, leaves=4))
    ml.save_bag(models, str(tmp_path / "m"), ["a", "b"], trained_on="1996 to 1999")
    again, about = ml.load_bag(spark, str(tmp_path / "m"))
    assert about == {"columns": ["a", "b"], "trained_on": "1996 to 1999"} and len(again) == 2
    assert ml.predict_bag(again, rows).collect() == ml.predict_bag(models, rows).collect()


def test_street_pace_finds_the_effect(spark):
    rng = np.random.default_rng(2)
    s, n = rng.uniform(0, 1, 500), rng.integers(0, 24, 500)
    rows = spark.createDataFrame([(i, 1, int(n[i]), int(i % 2), float(1 + i % 7), float((100 + 30 * s[i]) * (1 + i % 7)), float(s[i])) for i in range(500)], "incident_id long, pump_order int, hour_of_call int, busy_flag int, road_km double, drive_s double, share_major double")
    got = {r.name: r.coefficient for r in fitting.pace_regression(rows, ["share_major"]).collect()}
    assert got["share_major"] == pytest.approx(30 * s.std(ddof=1), rel=1e-6) and abs(got["log_km"]) < 1e-6


def test_turnout_by_number_mapping_and_estimate(spark):
    sites = spark.createDataFrame([(0, "A  b", True), (1, "C", True), (2, "D", True), (3, "Demand cell 1", False)], "candidate_id long, site_name string, is_existing boolean")
    own = spark.createDataFrame([("c", 90.0, 30), ("d", 70.0, 30), ("demand cell 1", 99.0, 30)], "station string, turnout_s double, n long")

    def got(*a, **kw):
        return [r.turnout_s for r in planner.turnout_table(sites, *a, **kw).orderBy("site_id").collect()]

    assert got(None) == [60.0] * 4 and got(None, given=400.0) == [400.0] * 4  # a number stands as it is
    assert got(own) == [60.0, 90.0, 70.0, 60.0]
    given = {" a B": 500.0, "C": -1.0, "c ": 40.0, "Demand cell 1": 1.0}
    assert got(own, given=given) == [300.0, 40.0, 70.0, 60.0]
    assert got(None, given=given, default_s=80.0) == [300.0, 40.0, 80.0, 80.0]
    report = planner.turnout_report(sites, own, given=given).first()
    assert tuple(report) == ("mapping+estimated", 60.0, 3, 40.0, 70.0, 300.0)
    assert tuple(planner.turnout_report(sites, None).first()) == ("default", 60.0, 0, 60.0, 60.0, 60.0)
    assert tuple(planner.turnout_report(sites, own, given=75).first()) == ("scalar", 75.0, 0, 75.0, 75.0, 75.0)
    assert tuple(planner.turnout_report(sites.where("NOT is_existing"), own).first()) == ("estimated_station_prior", 60.0, 0, 60.0, 60.0, 60.0)
    assert planner.turnout_table(sites.where("false"), own, given=given).count() == 0


def test_plan_tells_of_its_held_out_checks(spark):
    from emberline.sources import demo

    inc = demo.incidents(spark, 600).withColumns({"cal_year": F.when(F.col("incident_id") % 4 == 0, 2000).otherwise(1999), "station_ground": F.lit("DEMO Station 1"), "deployed_from_station": F.lit("DEMO Station 1"), "hour_of_call": F.lit(3)})
    p = planner.plan(inc, demo.stations(spark), "expand", 1, cell_km=3.0, top_cells=5, demand_years=(1999,), eval_years=(2000,))
    labels = {r.label for r in p.summary.collect()}
    assert labels == {"plan", "current", "random", "held_out_plan", "held_out_current", "held_out_observed"}
    snap = p.snap.first()
    assert snap.n == 150 and 0 < snap.p50_km < snap.p95_km < 4
    assert {"covered", "drive_s", "assigned_site"} <= set(p.cells.columns)
