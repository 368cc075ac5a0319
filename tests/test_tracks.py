import random

import pytest
from pyspark.sql import functions as F

from emberline.operators import graph, roads, routing, scenario, spatial

STEPS = "k string, seq int, seconds double, x double, y double, total double"


def interpolated(samples, total, n):
    """Each instant looked up on its own: samples of (seconds from the start, x, y)."""
    end = samples[-1][0] or 1.0
    timed = [(t * total / end, x, y) for t, x, y in samples]
    if len(timed) < 2:
        return [(0, *timed[0][1:])]
    out = []
    for i in range(n):
        t = i * total / (n - 1)
        j = next((j for j in range(1, len(timed)) if timed[j][0] >= t - 1e-9), len(timed) - 1)
        (t0, x0, y0), (t1, x1, y1) = timed[j - 1], timed[j]
        f = (t - t0) / (t1 - t0) if t1 > t0 else 0.0
        out.append((i, x0 + f * (x1 - x0), y0 + f * (y1 - y0)))
    return out


def test_tracks_equal_a_lookup_of_each_instant(spark):
    rng = random.Random(1)
    tracks = {f"r{i}": ([0.0, *[rng.choice([0.0, 1.0, 7.5, 30.0, 0.01]) for _ in range(rng.randrange(1, 40))]], 60.0 + 10 * i) for i in range(12)}
    tracks |= {"one": ([0.0], 50.0), "still": ([0.0, 0.0, 0.0], 50.0), "late": ([0.0, 0.0, 5.0], 10.0), "no time": ([0.0, 4.0, 4.0], 0.0)}
    rows, want = [], {}
    for k, (seconds, total) in tracks.items():
        places = [(rng.random(), rng.random()) for _ in seconds]
        rows += [(k, 3 * i, s if i else 99.0, x, y, total) for i, (s, (x, y)) in enumerate(zip(seconds, places))]
        at = [sum(seconds[: i + 1]) for i in range(len(seconds))]
        if k != "no time":
            want |= {(k, i): (x, y) for i, x, y in interpolated([(t, x, y) for t, (x, y) in zip(at, places)], total, 25)}
    rows += [("null", 0, 0.0, 1.0, 1.0, None), ("null", 1, 1.0, 1.0, 1.0, None)]
    rng.shuffle(rows)
    got = {(r.k, r.i): r for r in scenario.track(spark.createDataFrame(rows, STEPS).repartition(3), "k", "total", 25).collect()}
    assert {r.t for k, r in got.items() if k[0] == "no time"} == {0.0}
    assert {k for k in got if k[0] != "no time"} == set(want)
    for k, (x, y) in want.items():
        assert (got[k].x, got[k].y) == (pytest.approx(x, abs=1e-6), pytest.approx(y, abs=1e-6)), k
        assert got[k].t == pytest.approx(k[1] * tracks[k[0]][1] / 24 if k[0] != "one" else 0.0)
    assert scenario.track(spark.createDataFrame([], STEPS), "k", "total").count() == 0


def test_nodes_of_paths(spark):
    rng = random.Random(2)
    n = 60
    edges = [(i, (i + 1) % n, 1.0 + i % 3) for i in range(n)] + [(rng.randrange(n), rng.randrange(n), 9.0) for _ in range(15)] + [(n, n + 1, 1.0)]
    e = spark.createDataFrame(edges, "u long, v long, length double")
    origins = spark.createDataFrame([(0,), (31,), (n,)], "origin long")
    paths = graph.search_by_origin(e, origins)
    parent = {(r.origin, r.node): r.parent for r in paths.collect()}
    pairs = [(0, 0), (0, 59), (0, 30), (31, 30), (31, 29), (n, n + 1), (0, n + 1), (0, 59)]
    want = set()
    for o, d in pairs:
        at = d if (o, d) in parent else None
        while at is not None:
            want.add((o, d, at))
            at = parent[o, at]
    got = [(r.origin, r.dest, r.node) for r in graph.path_nodes(paths, spark.createDataFrame(pairs, "origin long, dest long")).collect()]
    assert sorted(got) == sorted(want) and len([1 for r in got if r[:2] == (0, n + 1)]) == 0


def test_both_engines_of_a_race(spark):
    nodes = spark.createDataFrame([(i, 51.5, -0.1 + i * 0.01) for i in range(6)], "node long, lat double, lon double")
    edges = spark.createDataFrame([(i, i + 1, 10.0) for i in range(5)] + [(1, 0, 5.0)], "u long, v long, cost_s double")
    races = spark.createDataFrame([(7,), (8,)], "new_id int")
    places = spark.createDataFrame([(7, "new", 51.5, -0.07, 51.5, -0.0501, 1.2), (7, "old", 51.5, -0.1, 51.5, -0.0501, 3.0), (8, "old", 51.5, -0.07, 51.5, -0.1, 2.0)], "new_id int, engine string, lat double, lon double, dest_lat double, dest_lon double, crow_km double")
    got = {(r.new_id, r.engine, r.i): r for r in scenario.race_tracks(races, places, edges, nodes, points=11).collect()}
    assert {k[:2] for k in got} == {(7, "new"), (7, "old")} and len(got) == 22  # the third has no route
    assert got[7, "old", 5].lon == pytest.approx(-0.075) and got[7, "new", 10].lon == pytest.approx(-0.05)
    assert got[7, "old", 10].t == pytest.approx(got[7, "old", 0].attend_s) and got[7, "new", 0].attend_s < got[7, "old", 0].attend_s


def test_tracks_on_large_graphs_search_around_the_engines_alone(spark, monkeypatch):
    nodes = spark.createDataFrame([(i, 51.5, -0.1 + i * 0.01) for i in range(6)], "node long, lat double, lon double")
    edges = spark.createDataFrame([(i, i + 1, 10.0) for i in range(5)] + [(1, 0, 5.0)], "u long, v long, cost_s double")
    races = spark.createDataFrame([(7,), (8,)], "new_id int")
    places = spark.createDataFrame([(7, "new", 51.5, -0.07, 51.5, -0.0501, 1.2), (7, "old", 51.5, -0.1, 51.5, -0.0501, 3.0), (8, "old", 51.5, -0.07, 51.5, -0.07, 2.0)], "new_id int, engine string, lat double, lon double, dest_lat double, dest_lon double, crow_km double")
    own = lambda: sorted(map(tuple, scenario.race_tracks(races, places, edges, nodes, points=11).collect()))
    want = own()
    assert len(want) == 23  # an engine that stands at the incident has one row
    monkeypatch.setattr(graph, "SMALL_GRAPH", 3)
    monkeypatch.setattr(routing, "paths_by_region", None)  # distances from each origin to all nodes
    assert own() == want


@pytest.mark.parametrize("free", [True, False])
def test_ways_of_routes_equal_those_of_all_paths(spark, monkeypatch, free):
    rng = random.Random(4)
    rows = sorted({(rng.randrange(40), rng.randrange(40)) for _ in range(130)})
    e = spark.createDataFrame([(u, v, float(rng.randrange(0 if free else 1, 30)) if u != v else 1.0) for u, v in rows], "u long, v long, length double")
    at = spark.createDataFrame([(i, 51.0 + rng.random(), rng.random()) for i in range(38)], "node long, lat double, lon double")
    asked = spark.createDataFrame([(rng.randrange(40), rng.randrange(40)) for _ in range(60)], "origin long, node long").where("origin <> node")
    paths = graph.search_by_origin(e, asked.select("origin").distinct())
    want = {}
    for r in graph.path_nodes(paths, asked.select("origin", F.col("node").alias("dest"))).collect():
        want.setdefault((r.origin, r.dest), set()).add((r.node, r.dist))
    for small in (2_000_000, 20):
        monkeypatch.setattr(graph, "SMALL_GRAPH", small)
        got = {(r.origin, r.node): r for r in roads.route_table(e, asked, places=at, ways=True).collect()}
        assert {p for p, r in got.items() if r.found} == set(want) and all(got[p].way is None for p in got if not got[p].found)
        for p, nodes in want.items():
            assert got[p].way[0] == p[0] and got[p].way[-1] == p[1] and got[p].way_cost == sorted(got[p].way_cost)
            assert got[p].way_cost[-1] == got[p].dist and (free or set(zip(got[p].way, got[p].way_cost)) == nodes)


def test_a_few_points_meet_every_site(spark):
    rng = random.Random(5)
    sites = spark.createDataFrame([(i, 51 + rng.randrange(9) / 10, rng.randrange(9) / 10) for i in range(60)], "site long, s_lat double, s_lon double")
    points = spark.createDataFrame([(i, 51 + rng.random(), rng.random()) for i in range(9)] + [(9, None, 0.1)], "id long, lat double, lon double")
    assert spatial.nearest(points, "id", sites, "site", spatial.crow()).count() >= 9
    want = sorted(map(tuple, spatial.nearest(points, "id", sites, "site", spatial.crow(), small=0).collect()))
    old, spatial.SENT = spatial.SENT, 30
    try:
        assert sorted(map(tuple, spatial.nearest(points, "id", sites, "site", spatial.crow()).collect())) == want
    finally:
        spatial.SENT = old
