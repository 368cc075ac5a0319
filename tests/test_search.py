import numpy as np
import pytest

from emberline.operators import graph, roads, routing, search


def some_edges(n, m, seed, whole):
    rng = np.random.default_rng(seed)
    ends = np.unique(rng.integers(0, n, (m, 2)) * 3, axis=0)
    return ends[:, 0], ends[:, 1], rng.integers(1, 5, len(ends)).astype(float) if whole else rng.uniform(0.01, 9, len(ends))


@pytest.mark.parametrize(("n", "m", "whole"), [(60, 200, True), (150, 420, False), (40, 60, True), (1, 1, True)])
def test_origins_searched_together_equal_single_searches(n, m, whole):
    u, v, cost = some_edges(n, m, n, whole)
    rng = np.random.default_rng(1)
    s = roads.Streets(u, v, cost, rng.integers(0, 9, (len(u), 3)).astype(float), rng.uniform(0, 360, (len(u), 2)))
    origins = [int(x) * 3 for x in rng.integers(0, n + 3, 90)]
    wanted = [[int(x) * 3 for x in rng.integers(0, n + 3, k % 7)] for k in range(90)]
    met = 0
    for other in (None, s.cost * 1.5 + 0.25):
        for row, node, there, far, sums, mark in s.found(origins, wanted, other):
            for i, x, ok, d, total, way in zip(row, node, there, far, sums, mark, strict=True):
                want = s.routes(origins[i], wanted[i], other).get(int(x))
                assert ok == (want is not None)
                if ok:
                    assert (d, way) == (want[0], want[2]) and total.tolist() == want[1].tolist()
                met += 1
    assert met == 2 * sum(map(len, wanted))


def test_origins_are_dealt_to_all_cores_and_sums_come_with_the_search(spark):
    side = 8
    rows = [(i, j, 80.0 + (i * 37 + j) % 50) for i in range(side * side) for j in (i + 1, i + side) if j < side * side and (j != i + 1 or j % side)]
    e = spark.createDataFrame(rows, "u long, v long, length double")
    origins = spark.createDataFrame([(i,) for i in range(0, 64, 3)] + [(999,)], "origin long")
    got = graph.search_by_origin(e, origins, values=["length"])
    assert got.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism  # small partitions were joined into one task
    paths = graph.shortest_paths(e, origins)
    want = {(r.origin, r.node): (r.dist, r.parent) for r in paths.collect()}
    assert {(r.origin, r.node): (r.dist, r.parent) for r in got.collect()} == want
    assert all(r.length == r.dist for r in got.collect())


def test_small_graphs_are_not_cut_into_regions(spark, monkeypatch):
    u, v, cost = some_edges(40, 150, 5, True)
    e = spark.createDataFrame(list(zip(u.tolist(), v.tolist(), cost.tolist(), strict=True)), "u long, v long, length double")
    origins = spark.createDataFrame([(0,), (9,), (30,), (1,)], "origin long")
    want = sorted(map(tuple, routing.paths_by_region(e.withColumnRenamed("length", "c"), origins).collect()), key=repr)
    monkeypatch.setattr(routing, "paths_by_region", None)  # rounds of joins over pairs of origins and entries
    assert sorted(map(tuple, graph.shortest_paths(e, origins).collect()), key=repr) == want


def test_ways_in_by_slices_equal_those_of_all_places(monkeypatch):
    u, v, cost = some_edges(60, 200, 3, True)
    net = search.Net(u, v, cost)
    dist = net.distances(np.arange(7))
    places = np.flatnonzero(np.isfinite(dist))
    want = net.ways_in(dist, places)
    monkeypatch.setattr(search, "WAYS", 5)
    assert net.ways_in(dist, places).tolist() == want.tolist()
