"""Names, tags and labels as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What the three name conventions drop.
CLOSED_NOISE = r"\b(fire|station|stn|lfb)\b"
BUILDING_NOISE = r"\b(fire|station|stn|community|lfb|london fire brigade)\b"
# Road classes and default limits in km/h.
ROAD_GROUP = {
    "motorway": "major", "motorway_link": "major", "trunk": "major", "trunk_link": "major",
    "primary": "primary", "primary_link": "primary", "secondary": "secondary", "secondary_link": "secondary",
    "tertiary": "tertiary", "tertiary_link": "tertiary", "residential": "residential", "living_street": "residential",
    "unclassified": "minor", "busway": "minor", "road": "minor",
}
ROAD_GROUPS = ("major", "primary", "secondary", "tertiary", "residential", "minor")
ROAD_TYPES = ("motorway", "trunk", "primary", "secondary", "tertiary", "residential", "other")
LIMIT_KPH = {"motorway": 112.0, "trunk": 96.0, "primary": 48.0, "secondary": 48.0, "tertiary": 48.0, "residential": 32.0, "other": 32.0}
KPH_PER_MPH = 1.609344


def plain_name(c) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.trim(c)), r"\s+", " "))


def closed_name(c) -> Column:
    kept = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9 ]+", " "), CLOSED_NOISE, " ")
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def building_name(c) -> Column:
    words = F.regexp_replace(F.regexp_replace(F.lower(c), r"\([^)]*\)", ""), BUILDING_NOISE, "")
    return F.trim(F.regexp_replace(F.regexp_replace(words, "[^a-z ]", ""), r"\s+", " "))


def numbers(c, pattern: str = r"\d+(?:\.\d+)?") -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(f"({pattern})"), 1), lambda x: x.cast("double"))


def least_number(c) -> Column:
    """The least whole number in a text; null without any."""
    return F.array_min(numbers(c, r"\d+"))


def mean_number(c) -> Column:
    n = numbers(c)
    return F.aggregate(n, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(n), F.lit(0))


def lookup(c, table: dict, default) -> Column:
    out = None
    for key, value in table.items():
        out = F.when(c == key, F.lit(value)) if out is None else out.when(c == key, F.lit(value))
    return out.otherwise(F.lit(default))


def road_group(highway) -> Column:
    return lookup(highway, ROAD_GROUP, "minor")


def road_type(highway) -> Column:
    h = F.replace(F.lower(F.coalesce(highway, F.lit("other"))), F.lit("_link"), F.lit(""))
    return F.when(h.isin(*ROAD_TYPES), h).otherwise(F.lit("other"))


def limit_kph(maxspeed, kind) -> Column:
    """The posted limit; mph converted; a road type's default without digits."""
    text = F.lower(F.trim(maxspeed))
    digits = F.regexp_replace(F.split(text, r"\s+")[0], "[^0-9.]", "")
    value = digits.try_cast("double")
    return F.coalesce(F.when(text.contains("mph"), value * KPH_PER_MPH).otherwise(value), lookup(kind, LIMIT_KPH, 32.0))


def point_kind(highway, crossing, calming) -> Column:
    """What a tagged point is; the first rule that fits."""
    return (
        F.when((highway == "traffic_signals") | (crossing == "traffic_signals"), F.lit("signals"))
        .when(calming.isNotNull() & (calming != "no"), F.lit("calming"))
        .when(highway == "crossing", F.lit("crossing"))
        .when(highway.isin("give_way", "stop"), F.lit("give_way"))
    )


def title(c) -> Column:
    out = F.initcap(F.lower(c))
    for word in ("And", "Of", "Upon"):
        out = F.replace(out, F.lit(f" {word} "), F.lit(f" {word.lower()} "))
    return out


def minutes_seconds(s) -> Column:
    whole = F.round(s).cast("long")
    return F.format_string("%d:%02d", F.floor(whole / 60), F.pmod(whole, F.lit(60)))


def two_digits(x) -> Column:
    """x to two significant digits; 0 stays 0."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(x))) - 1)
    return F.when(x == 0, F.lit(0.0)).otherwise(F.round(x / power) * power)
