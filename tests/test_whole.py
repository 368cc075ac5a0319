"""Queries over whole tables, against brute force and against SQL without id limits."""

import itertools

import duckdb
import numpy as np
import pytest

from emberline.plans import queries as plans

TABLES = "region nation customer supplier part orders lineitem events".split()


WHOLE = ["greedy_k3", "coverage_greedy_k2", "best_swap", "replace_r1", "assigned_demand", "random_baseline", "busy_blend_response", "travel_matrix", "closed_name_match", "edge_features", "edge_cost_policy", "segment_slowness", "edge_ratios", "shortest_paths", "paths_by_origin", "tree_sums"]


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def sites(spark, sf, con):
    """Times (site by cell) and weights from SQL, and the number of stations."""
    rows = con.sql(f"WITH {plans.WHOLE} SELECT site_id, cell_id, w, t FROM tm").fetchall()
    n, m = max(r[0] for r in rows) + 1, max(r[1] for r in rows) + 1
    assert len(rows) == n * m
    t, w = np.zeros((n, m)), np.zeros(m)
    for site, cell, weight, seconds in rows:
        t[site, cell], w[cell] = seconds, weight
    stations = con.sql("SELECT count(*) FROM supplier").fetchall()[0][0]
    assert stations > 8 and m > 60  # more than the small instance has
    return t, w, stations


def run(spark, sf, name):
    out = [tuple(r) for r in plans.QUERIES[name](spark, sf).collect()]
    spark.catalog.clearCache()
    return out


def close(got, want):
    assert len(got) == len(want)
    for a, b in zip(sorted(got), sorted(want), strict=True):
        assert a == pytest.approx(b, abs=2e-4)


def test_sites_against_brute_force(spark, sf, sites):
    t, w, k = sites
    old, new = list(range(k)), list(range(k, len(t)))

    def mean(chosen):
        return float((t[list(chosen)].min(0) * w).sum() / w.sum())

    swaps = [(o, i, mean([x for x in old if x != o] + [i])) for o in old for i in new]
    close(run(spark, sf, "best_swap"), swaps)
    best = min(swaps, key=lambda x: (round(x[2], 9), x[:2]))
    close(run(spark, sf, "replace_r1"), [best] if best[2] < mean(old) - 1e-9 else [])
    pairs = [mean([*old, *p]) for p in itertools.combinations(new, 2)]
    value = run(spark, sf, "expand_m2")[0][0]
    assert min(pairs) - 2e-4 <= value < mean(old)
    for name, n, term in (("greedy_k3", 3, lambda x: x), ("coverage_greedy_k2", 2, lambda x: -1.0 * (x <= 480))):
        chosen = []
        for _ in range(n):
            chosen.append(min((s for s in range(len(t)) if s not in chosen), key=lambda s: (round((w * term(t[[*chosen, s]].min(0))).sum(), 6), s)))
        assert [s for _, s in sorted(run(spark, sf, name))] == chosen


@pytest.mark.parametrize("name", WHOLE)
def test_parity(spark, sf, con, name):
    df, want = plans.QUERIES[name](spark, sf), con.sql(plans.ORACLES[name])
    assert df.columns == want.columns
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want.fetchall()))


def test_plans_take_all_stations(spark, monkeypatch):
    sf, seen = "/root/testdata/sf0.01", []

    def plan(inc, st, *args, **kw):
        seen.append((st.count(), args, set(kw) - {"demand_years", "eval_years"}))
        raise StopIteration

    monkeypatch.setattr(plans.planner, "plan", plan)
    for name in ("plan_summary", "redesign"):
        with pytest.raises(StopIteration):
            plans.QUERIES[name](spark, sf)
    n = plans.fx.table(spark, sf, "supplier").count()
    assert seen == [(n, ("expand", 2), set()), (n, ("redesign", 3), set())]


def test_streets_cover_part(spark, sf):
    """All of part is in the graph, paths from all origins are the shortest, and the small grid is as it was."""
    import heapq

    fx = plans.fx
    n = fx.table(spark, sf, "part").count()
    rows = [tuple(r) for r in fx.edges(spark, sf, None).select("u", "v", "length").collect()]
    side = next(x for x in range(n + 1) if x * x >= n)
    assert n > 144 and {x for r in rows for x in r[:2]} == set(range(n))
    assert {abs(v - u) for u, v, _ in rows} == {1, side} and fx.edges(spark, sf).count() == 474
    out = {}
    for u, v, c in rows:
        out.setdefault(u, []).append((v, c))
    want = {}
    for origin in range(0, n, 20):
        heap, done = [(0.0, origin)], {}
        while heap:
            d, u = heapq.heappop(heap)
            if u not in done:
                done[u] = d
                for v, c in out.get(u, ()):
                    heapq.heappush(heap, (d + c, v))
        want |= {(origin, v): d for v, d in done.items()}
    for name in ("paths_by_origin", "tree_sums"):
        assert {r[:2]: r[2] for r in run(spark, sf, name)} == want
    assert {r[0] for r in run(spark, sf, "route_ratios")} == set(range(0, n, 20))


def test_models_have_their_operators_defaults(spark, sf, monkeypatch):
    seen = []

    def note(name):
        def f(*args, **kw):
            seen.append((name, args[1:], kw))
            if name != "fit_bag":
                raise StopIteration

        return f

    for module, name in ((plans.ml, "fit_bag"), (plans.ml, "ablation"), (plans.ml, "permutation_importance"), (plans.ml, "predict_bag"), (plans.fitting, "bootstrap"), (plans.scenario, "closed_matches")):
        monkeypatch.setattr(module, name, note(name))
    for name in ("gbt_bag", "importance", "ablation", "bootstrap_ci", "closed_name_match"):
        with pytest.raises(StopIteration):
            plans.QUERIES[name](spark, sf)
    by = {name: (args, kw) for name, args, kw in seen}
    assert by["fit_bag"] == ((), {}) and by["bootstrap"] == ((), {}) and by["permutation_importance"][0][1:] == ("key",)
    assert {c for g in by["ablation"][0][1].values() for c in g} == set(plans.ml.FEATURES) and not by["ablation"][1]


def test_sites_at_one_place_meet_points_once(spark, monkeypatch):
    """Of many sites at few places the smallest at each is met, whatever their number."""
    from emberline.operators import spatial

    tables = []
    monkeypatch.setattr(spatial, "held", lambda df: tables.append(df.localCheckpoint()) or tables[-1])
    sites = spark.range(600).selectExpr("600 - id AS site", "51.0 + id % 30 / 100 AS s_lat", "id % 30 / 50 AS s_lon")
    pts = spark.range(200).selectExpr("id", "51.0 + (id * 7 % 31) / 103 AS lat", "(id * 11 % 37) / 61 AS lon")
    for k in (1, 3):
        tables.clear()
        cells = spatial.nearest(pts, "id", sites, "site", spatial.crow(), k=k, small=0)
        plain = spatial.nearest(pts, "id", sites, "site", spatial.crow(), k=k, small=1000)
        assert sorted(map(tuple, cells.collect())) == sorted(map(tuple, plain.collect()))
        assert tables[0].count() == 30 * k
        assert all(t.count() <= 200 for t in tables[1:-1])  # a row a point, never a pair


def test_late_share_of_restored_sites_by_narrowing(spark, sf, monkeypatch):
    """No task holds all values of a site for its percentile."""
    from emberline.operators import scenario

    asked, true = [], scenario.exact_quantiles
    monkeypatch.setattr(scenario, "exact_quantiles", lambda *a: asked.append(a[1:]) or true(*a), raising=True)
    plans.QUERIES["restore_ranking"](spark, sf).collect()
    assert asked == [("name", "a", [0.9])]


def test_pairs_of_stations_are_dealt_to_tasks(spark, sf):
    """One small file of stations is no single task's work."""
    assert plans.QUERIES["haversine_pairs"](spark, sf).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
