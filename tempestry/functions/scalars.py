"""Scalar functions of readings, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tempestry.profile import LEVEL_NAME, METRIC_EPSILON, SCORE_WEIGHTS, TAIL_FLOOR, WEATHER_LEVEL


def local_time(t: Column, tz: Column) -> Column:
    """Wall-clock timestamp of epoch seconds in a time zone; null where the zone is unknown."""
    return F.from_utc_timestamp(F.timestamp_seconds(t), tz)


def robust_z(value: Column, median: Column, scale: Column, metric: str) -> Column:
    return (value - median) / F.greatest(scale, F.lit(METRIC_EPSILON.get(metric, 1.0)))


def bucket_confidence(bucket: Column, n: Column, least: int = 30) -> Column:
    """Trust in a baseline by the level it comes from; a whole station's counts more from `least` values on."""
    return (
        F.when(bucket.isin("smooth", "month_hour"), 1.0).when(bucket == "month", 0.55)
        .when((bucket == "city") & (n >= least), 0.35).when(bucket == "city", 0.2).otherwise(0.0)
    )


def tail_probability(anchors: Column, x: Column) -> Column:
    """Log-linear interpolation over anchors array<struct<v, p>> sorted by abs(v), at abs(x)."""
    size = F.abs(x)
    below = F.filter(anchors, lambda a: F.abs(a.v) <= size)
    above = F.filter(anchors, lambda a: F.abs(a.v) > size)
    a, b = F.element_at(below, -1), F.get(above, 0)
    floor = lambda p: F.log(F.greatest(p, F.lit(TAIL_FLOOR)))
    share = (size - F.abs(a.v)) / (F.abs(b.v) - F.abs(a.v))
    return F.when(F.size(below) == 0, F.get(anchors, 0).p).when(F.size(above) == 0, a.p).otherwise(F.exp(floor(a.p) + (floor(b.p) - floor(a.p)) * share))


def surprisal(p: Column) -> Column:
    return -F.log(F.greatest(p, F.lit(TAIL_FLOOR)))


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def rarity(anchors: Column, x: Column, proxy: Column) -> Column:
    """Surprisal of the tail on [0, 1]; the proxy where there are no anchors."""
    found = clamp01(surprisal(tail_probability(anchors, x)) / -math.log(TAIL_FLOOR))
    return F.when(F.size(anchors) > 0, found).otherwise(clamp01(proxy))


def humidex(t: Column, dew: Column) -> Column:
    return t + 0.5555 * (6.11 * F.exp(5417.7530 * (1 / 273.16 - 1 / (273.15 + dew))) - 10.0)


def wind_chill(t: Column, wind: Column) -> Column:
    p = F.pow(wind, F.lit(0.16))
    return F.when((t <= 10.0) & (wind > 4.8), 13.12 + 0.6215 * t - 11.37 * p + 0.3965 * t * p)


def weather_level(code: Column) -> Column:
    out = F.when(F.lit(False), 0)
    for level, codes in WEATHER_LEVEL.items():
        out = out.when(code.isin(codes), level)
    return out


def weather_category(code: Column) -> Column:
    out = F.when(F.lit(False), "")
    for level, codes in WEATHER_LEVEL.items():
        out = out.when(code.isin(codes), LEVEL_NAME[level])
    return out


def priority_score(**inputs: Column) -> Column:
    """Weighted sum of inputs clamped to [0, 1], on 0 to 100, to 3 places; inputs not given count nothing."""
    total = F.lit(0.0)
    for name, weight in SCORE_WEIGHTS.items():
        if name in inputs:
            total = total + weight * clamp01(inputs[name])
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), total * 100.0)), 3)


def severity(score: Column) -> Column:
    return F.when(score < 30, "info").when(score < 60, "warning").otherwise("severe")


def legacy_score(grade: Column) -> Column:
    return F.when(grade == "info", 20.0).when(grade == "warning", 45.0).when(grade == "severe", 70.0)


def dedupe_key(station: Column, kind: Column, metric: Column) -> Column:
    return F.concat_ws("|", station, kind, F.coalesce(metric, F.lit("none")))


def wet_bucket(amount: Column, percentiles: Column) -> Column:
    """Smallest stored percentile (array<struct<v, p>>) whose value reaches the amount, else the largest."""
    reached = F.filter(percentiles, lambda a: a.v >= amount)
    return F.coalesce(F.array_min(F.transform(reached, lambda a: a.p)), F.array_max(F.transform(percentiles, lambda a: a.p)))


# Labels and categories of weather codes for display.
DESCRIPTIONS = {
    ("Clear", "clear"): [0],
    ("Cloud cover", "cloud"): [1, 2, 3],
    ("Fog", "fog"): [45, 48],
    ("Rain", "precip"): [51, 53, 55, 56, 57, 61, 63, 65, 66, 67, 80, 81, 82],
    ("Snow", "snow"): [71, 73, 75, 77, 85, 86],
    ("Thunderstorm", "storm"): [95, 96, 99],
}


def weather_description(code: Column) -> Column:
    """Label and category of a weather code, a struct."""
    label, category = F.when(code.isNull(), "Unknown"), F.when(code.isNull(), "unknown")
    for (name, group), codes in DESCRIPTIONS.items():
        label, category = label.when(code.isin(codes), name), category.when(code.isin(codes), group)
    return F.struct(label.otherwise(F.concat(F.lit("WMO "), code.cast("string"))).alias("label"), category.otherwise("other").alias("category"))


def strength(signals: Column, grade: Column) -> Column:
    """Size of the first signal present, in the order of precedence; 1, 2 or 3 by grade where there is none."""
    first = F.coalesce(*[signals[k] for k in ("z_score", "level_jump", "abs_error", "difference", "gap")])
    return F.coalesce(F.abs(first), F.when(grade == "info", 1.0).when(grade == "warning", 2.0).otherwise(3.0))


def explanation(reason: Column, signals: Column, k: int = 3) -> Column:
    """Headline, and the first k signals in the detector's own order as text, a struct."""
    first = F.transform(F.slice(F.map_entries(signals), 1, k), lambda e: F.concat(e.key, F.lit("="), F.coalesce(e.value.cast("string"), F.lit("none"))))
    return F.struct(reason.alias("headline"), F.array_join(first, ", ").alias("evidence"))
