import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.operators import quantiles, raster


@pytest.mark.parametrize("buckets", [2, 4096])
def test_quantiles_equal_numpy(spark, buckets):
    rng = np.random.default_rng(2)
    groups = {"even": rng.uniform(-5, 5, 101), "skewed": 10.0 ** rng.uniform(-30, 8, 60), "ties": rng.integers(0, 3, 50).astype(float), "one": np.array([7.5]), "wide": np.array([-1.7e308, 0.0, 1.7e308]), None: np.array([1.0, 2.0])}
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [("even", None), ("even", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "layer string, v double").repartition(5)
    qs = [0.0, 0.01, 0.025, 0.5, 0.95, 0.999, 1.0]
    got = {(r.layer, r.q): r.value for r in quantiles.exact_quantiles(df, "layer", "v", qs, buckets).collect()}
    assert {g for g, _ in got} == set(groups)
    for g, x in groups.items():
        for q in qs:
            if g != "wide" or q in (0.0, 0.5, 1.0):
                assert got[g, q] == pytest.approx(np.quantile(x, q), rel=1e-12, abs=1e-300), (g, q)
    assert quantiles.exact_quantiles(df.where("false"), "layer", "v", qs).count() == 0


def test_ticks_span_two_decades_below_the_top(spark):
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.exponential(5, 3000), np.zeros(500)])
    df = spark.createDataFrame([("all", float(x)) for x in v], "layer string, v double")
    got = raster.ticks(df).first().ticks
    top = np.percentile(v[v > 0], 99.9)
    assert got == pytest.approx([top / 100 * 10 ** (2 * f) for f in (0, 0.25, 0.5, 0.75, 1)])
    assert raster.ticks(df.where(F.col("v") <= 0)).count() == 0
