"""Queries against their SQL on the smallest tables, one connection, in sequence."""

import duckdb
import pytest

from emberline.plans import more  # noqa: F401  (registers its queries)
from emberline.plans import queries as plans

TABLES = "region nation customer supplier part orders lineitem events".split()
#: A selection that goes through every operator module; the driver runs all of them.
CHOSEN = ["nearest_attendance_score", "planner_rows", "training_funnel", "borough_code", "name_normalise", "numbers_from_text", "busy_by_station", "quantile_bins", "demand_grid", "candidates", "posture_metrics", "coverage_greedy_k2", "best_swap", "replace_r1", "restore_ranking", "closed_name_match", "kolesar_grid_ols", "edge_features", "edge_cost_policy", "paths_by_origin", "density_blur", "borough_top", "outer_percentiles", "turnout_vector", "turnout_report", "od_route_errors", "joined_streets", "race_tracks", "hotspots"]


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def key(row):
    return tuple((v is None, str(v)) for v in row)


@pytest.mark.parametrize("name", CHOSEN)
def test_parity(spark, sf, con, name):
    df = plans.QUERIES[name](spark, sf)
    want = con.sql(plans.ORACLES[name])
    assert df.columns == want.columns
    assert sorted(map(tuple, df.collect()), key=key) == sorted(want.fetchall(), key=key)


def test_every_oracle_has_a_query():
    assert set(plans.ORACLES) <= set(plans.QUERIES)


def test_hotspots(spark, sf):
    """Against plain counting of the incidents."""
    from collections import Counter
    from math import floor
    from statistics import median

    from emberline.sources import fixtures

    cells = {}
    for r in fixtures.incidents(spark, sf).dropna(subset=["dest_lat"]).collect():
        cells.setdefault((floor(r.dest_lon / 0.02), floor(r.dest_lat / 0.02)), []).append(r)
    want = []
    for rank, (at, own) in enumerate(sorted(cells.items(), key=lambda x: (-len(x[1]), x[0]))[:10], 1):
        hours = Counter(r.hour_of_call for r in own)
        want.append((rank, *at, len(own), min(hours, key=lambda h: (-hours[h], h)), round(median(r.travel_seconds for r in own if r.travel_seconds is not None), 4)))
    assert [tuple(r) for r in plans.QUERIES["hotspots"](spark, sf).orderBy("rank").collect()] == want
