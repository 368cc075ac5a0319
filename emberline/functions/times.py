"""Travel and attendance times as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Curve:
    """Drive seconds by km: a + b * sqrt(km) up to the breakpoint, c + e * km beyond."""

    a: float
    b: float
    c: float
    e: float
    breakpoint_km: float

    def seconds(self, km) -> Column:
        d = F.when(km < 0, F.lit(0.0)).otherwise(km)
        return F.when(d <= self.breakpoint_km, F.lit(self.a) + F.lit(self.b) * F.sqrt(d)).otherwise(F.lit(self.c) + F.lit(self.e) * d)


# The published default curve, standards in seconds, shares and bounds.
DEFAULT_CURVE = Curve(a=15.846, b=180.913, c=145.697, e=71.783, breakpoint_km=1.913)
FIRST_MEAN_S, FIRST_P90_S, FIRST_SHARE = 360.0, 600.0, 0.90
SECOND_MEAN_S, SECOND_P95_S, SECOND_SHARE = 480.0, 720.0, 0.95
TURNOUT_S, TURNOUT_MOST_S = 60.0, 300.0
FLAT_KPH, FLAT_DETOUR, FLAT_FIXED_S = 28.0, 1.30, 15.0


def clipped(x, low: float, high: float) -> Column:
    """x within bounds; null stays null."""
    return F.when(x < low, F.lit(low)).when(x > high, F.lit(high)).otherwise(x)


def flat_speed_seconds(km, kph: float = FLAT_KPH, detour: float = FLAT_DETOUR, fixed: float = FLAT_FIXED_S) -> Column:
    return F.lit(fixed) + km * detour / max(kph, 1.0) * 3600.0


def attendance(drive_s, turnout_s=None) -> Column:
    """Drive time, not under 0, and turnout within its bounds."""
    turnout = F.lit(TURNOUT_S) if turnout_s is None else turnout_s
    return F.when(drive_s < 0, F.lit(0.0)).otherwise(drive_s) + clipped(turnout, 0.0, TURNOUT_MOST_S)


def first_arrival(t_near, busy, t_next) -> Column:
    """Expected first arrival where the nearest engine is away with probability `busy`."""
    p = clipped(busy, 0.0, 1.0)
    return (1 - p) * t_near + p * t_next


def is_rush(hour) -> Column:
    return hour.between(7, 9) | hour.between(16, 19)


def is_night(hour) -> Column:
    return (hour >= 22) | (hour <= 5)
