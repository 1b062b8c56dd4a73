"""Scores and costs that rank places, journeys, vehicles and delays; all column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def predicted_delay(delay: Column, ahead: Column, half_life: Column, early_half_life: float = 300.0, least: float = -120.0) -> Column:
    """A delay as it will be in ``ahead`` seconds: it halves every half-life (early running faster), and is at least ``least``; null stays null."""
    life = F.when(delay < 0, F.lit(early_half_life)).otherwise(half_life)
    return F.when(delay.isNotNull(), F.greatest(F.lit(least), delay * F.pow(F.lit(0.5), F.greatest(ahead, F.lit(0)) / life)))


def journey_cost(base: Column, walk: Column, transfers: Column, uncertain: Column, reluctance: float = 2.0, penalty: float = 300.0) -> Column:
    return base + (reluctance - 1) * walk + transfers * penalty + uncertain


def weight_bonus(weight: Column, most: float = 12.0) -> Column:
    return F.least(F.lit(most), F.log10(F.greatest(weight, F.lit(0)) + 1) * 4)


def distance_penalty(metres: Column, most: float = 40.0, per_km: float = 4.0) -> Column:
    return F.least(F.lit(most), F.coalesce(metres, F.lit(0.0)) / 1000 * per_km)


def faded(uses: Column, age_ms: Column, half_life_days: float = 14.0) -> Column:
    """Uses that lose half their weight every ``half_life_days``."""
    return uses * F.pow(F.lit(2.0), -F.greatest(age_ms, F.lit(0)) / (half_life_days * DAY_MS))


def usage_bonus(uses: Column) -> Column:
    return 24 * uses / (uses + 4)


def candidate_score(uses: Column, saved: Column, days: Column) -> Column:
    return 10 * uses + F.when(saved, 14).otherwise(0) + 6 * F.exp(-days / 10)


def destination_score(week: Column, total: Column, saved: Column, hours: Column) -> Column:
    return 4 * week + 1.5 * total + F.when(saved, 10).otherwise(0) + F.greatest(F.lit(0.0), 5 - hours / 12)


def match_score(delay_change: Column, metres: Column, same_trip: Column, next_change: Column, wrong_way: Column) -> Column:
    """How ill a vehicle fits a trip: small is good."""
    return F.abs(delay_change) + 2 * metres - F.when(same_trip, 240).otherwise(0) + 2 * F.coalesce(next_change, F.lit(0)) + F.when(wrong_way, 900).otherwise(0)


def refund_share(delay_min: Column, margin: int = 10) -> Column:
    """Percent of a fare that a delay gives back: from 60 minutes a quarter, from 120 a half; ``margin`` minutes below are ``near``."""
    return F.when(delay_min >= 120, 50).when(delay_min >= 60, 25).when(delay_min >= 60 - margin, 0)


def transit_kind(route_type: Column, number: Column) -> Column:
    """Kind of a route by its type code; plain numbers 1 to 33 of an unknown type are trams."""
    n = number.try_cast("int")
    return F.when(route_type == 0, "tram").when(route_type == 1, "metro").when(route_type == 2, "train").when(route_type == 4, "ferry").when(route_type.isin(5, 6, 7), "cable").when(route_type == 11, "trolleybus").when((route_type == 3) | n.isNull() | ~n.between(1, 33), "bus").otherwise("tram")


def kind_priority(kind: Column) -> Column:
    """Which kind names a stop that several serve: greater wins."""
    order = ["bus", "trolleybus", "cable", "ferry", "tram", "metro", "train"]
    out = F.lit(-1)
    for i, k in enumerate(order):
        out = F.when(kind == k, i).otherwise(out)
    return out
