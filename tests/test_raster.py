import random

import pytest

from emberline.operators import raster


@pytest.mark.parametrize(("ny", "nx", "tile"), [(50, 37, 16), (3, 5, 16), (20, 9, 256)])
def test_blur_by_tiles_equals_spreading_each_pixel(spark, monkeypatch, ny, nx, tile):
    monkeypatch.setattr(raster, "TILE_PX", tile)  # before, each pixel was a row for each weight, on both axes
    rng = random.Random(ny)
    pixels = {(layer, rng.randrange(ny), rng.randrange(nx)): rng.randrange(1, 9) for layer in ("a", "b", None) for _ in range(6)}
    weights = raster.kernel(2.0)
    reach = len(weights) // 2

    def back(at, size):
        m = at % (2 * size)
        return 2 * size - 1 - m if m >= size else m

    want = {}
    for (layer, r, c), n in pixels.items():
        for i, a in enumerate(weights):
            for j, b in enumerate(weights):
                k = layer, back(r + i - reach, ny), back(c + j - reach, nx)
                want[k] = want.get(k, 0.0) + n * a * b
    df = spark.createDataFrame([(*k, n) for k, n in pixels.items()], "layer string, row int, col int, n long")
    rows = raster.blur(df, spark.createDataFrame([(nx, ny)], "nx int, ny int"), 2.0).collect()
    assert len(rows) == len(want)
    assert {(r.layer, r["row"], r["col"]): r.v for r in rows} == {k: pytest.approx(v) for k, v in want.items()}
