import math

import pytest
from pyspark.sql import functions as F

from emberline.functions import geo, text, times


def one(spark, *cols):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


def test_curve_and_attendance(spark):
    c = times.DEFAULT_CURVE
    got = one(spark, *[c.seconds(F.lit(x)) for x in (-1.0, 0.0, 1.913, 1.914)], c.seconds(F.lit(None).cast("double")), times.attendance(F.lit(-5.0), F.lit(400.0)), times.attendance(F.lit(10.0)))
    assert got[:2] == (15.846, 15.846) and got[4] is None and got[5:] == (300.0, 70.0)
    assert got[2] == pytest.approx(15.846 + 180.913 * math.sqrt(1.913)) and got[3] == pytest.approx(145.697 + 71.783 * 1.914)


def test_first_arrival_and_flat_speed(spark):
    got = one(spark, times.first_arrival(F.lit(100.0), F.lit(0.25), F.lit(200.0)), times.first_arrival(F.lit(100.0), F.lit(2.0), F.lit(200.0)), times.flat_speed_seconds(F.lit(2.8)))
    assert got == pytest.approx((125.0, 200.0, 15 + 2.8 * 1.3 / 28 * 3600))


def test_distances(spark):
    args = [F.lit(x) for x in (-0.1, 51.5, 0.1, 51.6)]
    plan, trip = one(spark, geo.haversine_km(*args), geo.haversine_km(*args, geo.RADIUS_TRIP_KM))
    assert plan == pytest.approx(17.76, abs=0.05) and trip / plan == pytest.approx(6371.0088 / 6371.0)
    assert one(spark, geo.bearing(F.lit(0.0), F.lit(51.0), F.lit(0.0), F.lit(50.0)), geo.turn_angle(F.lit(350.0), F.lit(20.0))) == pytest.approx((180.0, 30.0))


def test_grid_shift_on_a_published_point(spark):
    # the worked example of the national grid's guide: 651409.903, 313177.270 is about 52.65798 N, 1.71605 E
    lon, lat = geo.bng_to_wgs84(F.lit(651409.903), F.lit(313177.270))
    got = one(spark, lon, lat)
    assert got == pytest.approx((1.71605, 52.65798), abs=1e-4)
    x, y = geo.mercator(F.lit(1.5), F.lit(52.0))
    assert one(spark, *geo.from_mercator(x, y)) == pytest.approx((1.5, 52.0))


def test_texts(spark):
    got = one(spark, text.plain_name(F.lit("  Old   TOWN ")), text.closed_name(F.lit("Bow Fire-Station (LFB)")), text.building_name(F.lit("Euston (A) London Fire Brigade 2")), text.title(F.lit("KENSINGTON AND CHELSEA")), text.minutes_seconds(F.lit(125.4)), text.two_digits(F.lit(1234.0)), text.two_digits(F.lit(0.0)))
    assert got == ("old town", "bow", "euston", "Kensington and Chelsea", "2:05", 1200.0, 0.0)
    got = one(spark, text.least_number(F.lit("30 mph;20 mph")), text.least_number(F.lit("none")), text.mean_number(F.lit("2;3.5")), text.limit_kph(F.lit("30 mph"), F.lit("other")), text.limit_kph(F.lit("signals"), F.lit("trunk")), text.road_type(F.lit("primary_link")), text.road_group(F.lit("trunk_link")))
    assert got == (20.0, None, 2.75, pytest.approx(48.28032), 96.0, "primary", "major")
    kinds = [text.point_kind(F.lit(a).cast("string"), F.lit(b).cast("string"), F.lit(c).cast("string")) for a, b, c in (("crossing", "traffic_signals", None), ("crossing", None, "hump"), ("crossing", None, "no"), ("stop", None, None), (None, None, None))]
    assert one(spark, *kinds) == ("signals", "calming", "crossing", "give_way", None)
