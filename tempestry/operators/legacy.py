"""The seven legacy rules, kept for comparison replays; grades are fixed scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempestry.functions import scalars as S
from tempestry.operators.climatology import places
from tempestry.operators.features import by_station, previous, previous_known
from tempestry.profile import Profile

# The metrics of the rules, the least gaps of the contrast, and what replaced which rule.
CHANGE_METRICS = ("temperature_2m", "wind_speed_10m", "precipitation")
CONTRAST_GAPS = {"temperature_2m": 5.0, "apparent_temperature": 5.0, "precipitation": 2.0, "wind_speed_10m": 15.0}
REPLACED_BY = {
    "rapid_change": ("temperature_shock",), "sustained_extreme": ("warm_spell", "cold_spell"), "comfort_divergence": ("heat_stress", "cold_stress"), "cross_city_contrast": ("spatial_anomaly",),
    "forecast_divergence": ("forecast_bust",), "wmo_transition": (), "fun_fact": (),
}
NEW = ("pressure_plunge", "heavy_rain_burst", "wind_gust_burst")
DAY = 86400


def _rule(df: DataFrame, kind: str, metric: Column, strength: Column, grade: Column, detail: Column | None = None) -> DataFrame:
    key = S.dedupe_key(F.col("station"), F.lit(kind), metric)
    return df.select(
        "station", "t", F.lit(kind).alias("detector"), metric.alias("metric"), places(strength, 3).alias("strength"), S.legacy_score(grade).alias("score"), grade.alias("severity"),
        (key if detail is None else F.concat_ws("|", key, detail)).alias("dedupe_key"),
    )


def same_hour_baseline(readings: DataFrame, metric: str, rolling_hours: int = 24, least: int = 7) -> DataFrame:
    """Adds mean, std and n of the values at the same local hour (within one, circular) in the 14 days before;
    with fewer than `least` of them, of the hours just before.

    Every row stands in the slots of its own and both neighbouring hours, and asks in its own: one window per
    (station, slot) instead of a self-join.
    """
    slots = F.array(*[F.pmod(F.col("hour") + k, F.lit(24)) for k in (-1, 0, 1)])
    spread = readings.select("station", "t", F.col("hour").alias("own"), F.col(metric).alias("v"), F.explode(slots).alias("slot"))
    w = Window.partitionBy("station", "slot").orderBy("t").rangeBetween(-14 * DAY, -1)
    spread = spread.withColumn("m1", F.avg("v").over(w)).withColumn("s1", F.stddev_pop("v").over(w)).withColumn("n1", F.count("v").over(w)).filter("slot = own")
    near = by_station().rangeBetween(-rolling_hours * 3600, -1)
    df = readings.withColumn("m2", F.avg(metric).over(near)).withColumn("s2", F.stddev_pop(metric).over(near)).withColumn("n2", F.count(metric).over(near))
    df = df.join(spread.select("station", "t", "m1", "s1", "n1").hint("merge"), ["station", "t"])
    enough = F.col("n1") >= least
    out = df.withColumn("mean", F.when(enough, F.col("m1")).otherwise(F.col("m2"))).withColumn("std", F.when(enough, F.col("s1")).otherwise(F.col("s2")))
    return out.withColumn("n", F.when(enough, F.col("n1")).otherwise(F.col("n2"))).drop("m1", "s1", "n1", "m2", "s2", "n2")


def rapid_change(readings: DataFrame, metric: str, p: Profile = Profile(), z_warn: float = 2.5, z_severe: float = 3.5) -> DataFrame:
    """One metric against its same-hour baseline; needs history in the day before and a spread."""
    day = F.count("*").over(by_station().rangeBetween(-DAY, -1))
    history = F.count(metric).over(by_station().rangeBetween(-14 * DAY, -1))
    df = same_hour_baseline(readings.withColumn("_day", day).withColumn("_history", history), metric)
    z = F.abs((F.col(metric) - F.col("mean")) / F.col("std"))
    fired = df.filter((F.col("_day") >= p.min_history) & (F.col("_history") >= p.min_history) & (F.col("std") > 0) & (z >= z_warn))
    return _rule(fired, "rapid_change", F.lit(metric), z, F.when(z >= z_severe, "severe").otherwise("warning"))


def sustained_extreme(readings: DataFrame, metric: str = "temperature_2m", p: Profile = Profile()) -> DataFrame:
    """This and the two previous values all beyond the 48-hour 5th or 95th percentile."""
    w, near = by_station(), by_station().rangeBetween(-2 * DAY, -1)
    df = readings.withColumn("low", F.percentile(metric, F.lit(0.05)).over(near)).withColumn("high", F.percentile(metric, F.lit(0.95)).over(near)).withColumn("_n", F.count("*").over(near))
    three = [F.col(metric), F.lag(metric, 1).over(w), F.lag(metric, 2).over(w)]
    df = df.withColumn("above", F.least(*three) >= F.col("high")).withColumn("below", F.greatest(*three) <= F.col("low")).withColumn("_all", three[1].isNotNull() & three[2].isNotNull())
    fired = df.filter((F.col("_n") >= p.min_history) & F.col("_all") & (F.col("low") != F.col("high")) & (F.col("above") | F.col("below")))
    return _rule(fired, "sustained_extreme", F.lit(metric), F.lit(2.0), F.lit("warning"))


def wmo_transition(readings: DataFrame) -> DataFrame:
    """A jump of two levels or more from the previous known weather code."""
    level = S.weather_level(F.col("weather_code"))
    df = readings.withColumn("level", level).withColumn("before", S.weather_level(previous_known("weather_code")))
    jump = F.abs(F.col("level") - F.col("before"))
    return _rule(df.filter(jump >= 2), "wmo_transition", F.lit("weather_code"), jump, F.when(F.col("level") == 3, "severe").otherwise("warning"))


def comfort_divergence(readings: DataFrame, p: Profile = Profile()) -> DataFrame:
    """The gap between apparent and actual temperature beyond two deviations of its baseline."""
    gap = F.abs(F.col("apparent_temperature") - F.col("temperature_2m"))
    df = same_hour_baseline(readings.withColumn("gap", gap), "gap", rolling_hours=48)
    limit = F.col("mean") + 2 * F.col("std")
    fired = df.filter((F.col("n") >= 7) & (F.col("gap") > limit))
    grade = F.when((F.col("gap") >= 1.5 * limit) & (F.col("gap") >= 8), "severe").otherwise("warning")
    return _rule(fired, "comfort_divergence", F.lit("apparent_temperature"), F.col("gap"), grade)


def cross_city_contrast(readings: DataFrame, peers: DataFrame, metric: str, p: Profile = Profile()) -> DataFrame:
    """Difference to a peer's latest value above the 95th percentile of the own 48 hours' distance to that value."""
    past = F.collect_list(metric).over(by_station().rangeBetween(-2 * DAY, -1))
    mine = readings.select("station", "t", F.col(metric).alias("own"), past.alias("past"))
    rows = mine.join(peers.select("station", "t", "peer", F.col(metric).alias("theirs")), ["station", "t"])
    gaps = F.sort_array(F.transform("past", lambda x: F.abs(x - F.col("theirs"))))
    at = (F.size(gaps) - 1) * 0.95
    low, high = F.get(gaps, F.floor(at).cast("int")), F.get(gaps, F.ceil(at).cast("int"))
    limit = low + (high - low) * (at - F.floor(at))
    gap = F.abs(F.col("own") - F.col("theirs"))
    fired = rows.filter((F.size("past") >= p.min_history) & (gap > limit) & (gap >= CONTRAST_GAPS[metric]))
    return _rule(fired, "cross_city_contrast", F.lit(metric), gap, F.lit("warning"), F.col("peer"))


def forecast_divergence(readings: DataFrame) -> DataFrame:
    """Needs fcst_temperature_2m and fcst_weather_code: two weather levels or six degrees off."""
    actual, said = S.weather_level(F.col("weather_code")), S.weather_level(F.col("fcst_weather_code"))
    levels = readings.filter(F.abs(actual - said) >= 2)
    by_level = _rule(levels, "forecast_divergence", F.lit("weather_code"), F.abs(actual - said), F.when(actual > said, "severe").otherwise("warning"))
    off = F.abs(F.col("temperature_2m") - F.col("fcst_temperature_2m"))
    by_temperature = _rule(readings.filter(off >= 6), "forecast_divergence", F.lit("temperature_2m"), off, F.when(off >= 9, "severe").otherwise("warning"))
    return by_level.unionByName(by_temperature)


def freezing_line(readings: DataFrame, peers: DataFrame) -> DataFrame:
    """Crossed 0 C since the previous reading while a peer is on the other side."""
    df = readings.withColumn("before", previous("temperature_2m"))
    df = df.filter(((F.col("before") < 0) & (F.col("temperature_2m") >= 0)) | ((F.col("before") >= 0) & (F.col("temperature_2m") < 0)))
    other = peers.select("station", "t", F.col("temperature_2m").alias("theirs"))
    across = other.groupBy("station", "t").agg(F.max(F.col("theirs") >= 0).alias("some_up"), F.max(F.col("theirs") < 0).alias("some_down"))
    fired = df.join(across.hint("merge"), ["station", "t"]).filter(((F.col("temperature_2m") >= 0) & F.col("some_down")) | ((F.col("temperature_2m") < 0) & F.col("some_up")))
    return _rule(fired, "fun_fact", F.lit("temperature_2m"), F.lit(1.0), F.lit("info"), F.lit("freezing_line"))


def record(readings: DataFrame, metric: str = "temperature_2m", p: Profile = Profile()) -> DataFrame:
    """Strictly beats the 14-day extreme, which the previous reading did not; the previous reading is held against
    the same history without itself.  Nothing where the previous reading has no value."""
    past = F.collect_list(metric).over(by_station().rangeBetween(-14 * DAY, -1))
    df = readings.withColumn("past", past).withColumn("before", previous(metric)).filter((F.size("past") >= p.min_history) & F.col("before").isNotNull())
    earlier = F.slice("past", 1, F.size("past") - 1)
    before, v = F.col("before"), F.col(metric)
    high = (v > F.array_max("past")) & ~(before > F.array_max(earlier))
    low = (v < F.array_min("past")) & ~(before < F.array_min(earlier))
    fired = df.withColumn("kind", F.when(high, "warm_record").when(low, "cold_record")).filter("kind IS NOT NULL")
    return _rule(fired, "fun_fact", F.lit(metric), F.lit(1.0), F.lit("info"), F.col("kind"))


def pack_differently(readings: DataFrame, peers: DataFrame, margin: float = 8.0) -> DataFrame:
    """The apparent gap to a peer's latest value reaches the margin, which the previous reading's did not."""
    mine = readings.withColumn("before", previous("apparent_temperature")).select("station", "t", "apparent_temperature", "before")
    rows = mine.join(peers.select("station", "t", "peer", F.col("apparent_temperature").alias("theirs")), ["station", "t"])
    gap, was = F.abs(F.col("apparent_temperature") - F.col("theirs")), F.abs(F.col("before") - F.col("theirs"))
    return _rule(rows.filter((gap >= margin) & (was < margin)), "fun_fact", F.lit("apparent_temperature"), gap, F.lit("info"), F.concat(F.lit("pack_differently|"), F.col("peer")))


def over_metrics(rule, readings: DataFrame, metrics=CHANGE_METRICS, **further) -> DataFrame:
    """A rule of one metric over all of `metrics`."""
    return reduce(DataFrame.unionByName, [rule(readings, metric=m, **further) for m in metrics])


def replay(readings: DataFrame, peers: DataFrame, forecast: DataFrame, p: Profile = Profile()) -> DataFrame:
    """All seven rules: `peers` with the metrics of the contrast, `forecast` the readings with their forecasts."""
    rules = [
        wmo_transition(readings), over_metrics(rapid_change, readings, p=p), over_metrics(sustained_extreme, readings, p=p), comfort_divergence(readings, p),
        over_metrics(cross_city_contrast, readings, CONTRAST_GAPS, peers=peers, p=p), forecast_divergence(forecast), freezing_line(readings, peers), pack_differently(readings, peers), record(readings, p=p),
    ]
    return reduce(DataFrame.unionByName, rules)


def against_native(old: DataFrame, incidents: DataFrame) -> DataFrame:
    """(old_type, replacement, old_raw, new_incidents) of every legacy rule, and of the detectors without one."""
    spark = old.sparkSession
    rows = [(o, " + ".join(ns) or None, n) for o, ns in REPLACED_BY.items() for n in ns or (None,)] + [(None, n, n) for n in NEW]
    pairs = spark.createDataFrame(rows, "old_type string, replacement string, detector string")
    new = pairs.join(F.broadcast(incidents.groupBy("detector").agg(F.count("*").alias("n"))), "detector", "left")  # a row a detector
    new = new.groupBy("old_type", "replacement").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("new_incidents"))
    counted = old.groupBy(F.col("detector").alias("old_type")).agg(F.count("*").alias("old_raw"))
    return new.join(F.broadcast(counted), "old_type", "left").select("old_type", "replacement", F.coalesce("old_raw", F.lit(0)).alias("old_raw"), "new_incidents")  # a row a rule
