"""Evaluation of replays: rates, distributions, recall against labelled windows, precision proxy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempestry.profile import DETECTORS


def station_days(readings: DataFrame) -> DataFrame:
    """One row: readings and station-days, a station's being its hours over 24, rounded half to even."""
    per = readings.groupBy("station").agg(F.count("*").alias("n"))
    return per.agg(F.sum("n").alias("readings"), F.sum(F.bround(F.col("n") / 24)).alias("days"))


def rates(incidents: DataFrame, candidates: DataFrame, readings: DataFrame) -> DataFrame:
    """Per type and OVERALL: incidents, raw firings, per 1000 readings, per station-day, collapse ratio."""
    spark = incidents.sparkSession
    raw = candidates.groupBy("detector").agg(F.count("*").alias("raw"))
    inc = incidents.groupBy("detector").agg(F.count("*").alias("incidents"))
    kinds = spark.createDataFrame([(d,) for d in DETECTORS], "detector string")
    per = kinds.join(raw.hint("merge"), "detector", "left").join(inc.hint("merge"), "detector", "left").select("detector", F.coalesce("incidents", F.lit(0)).alias("incidents"), F.coalesce("raw", F.lit(0)).alias("raw"))
    per = per.rollup("detector").agg(F.sum("incidents").alias("incidents"), F.sum("raw").alias("raw")).withColumn("detector", F.coalesce("detector", F.lit("OVERALL")))
    out = per.join(F.broadcast(station_days(readings)), how="cross")  # one row
    return out.select(
        "detector", "incidents", "raw", F.round(F.col("incidents") * 1000.0 / F.col("readings"), 4).alias("per_1000"), F.round(F.col("incidents") / F.col("days"), 4).alias("per_day"),
        F.round(F.when(F.col("incidents") > 0, F.col("raw") / F.col("incidents")).otherwise(0.0), 4).alias("collapse"),
    )


def severity_table(incidents: DataFrame) -> DataFrame:
    counted = incidents.groupBy("detector").pivot("severity", ["info", "warning", "severe"]).agg(F.count(F.lit(1)))
    return counted.na.fill(0)


def score_distribution(candidates: DataFrame, key: str = "detector") -> DataFrame:
    q = F.percentile("score", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99)))
    out = candidates.groupBy(key).agg(q.alias("q"), F.max("score").alias("top"), F.count("*").alias("n"))
    return out.select(key, *[F.round(F.get("q", k), 3).alias(n) for k, n in enumerate(("p50", "p90", "p99"))], "top", "n")


def histogram(rows: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts per bin of equal width; the last bin is closed."""
    at = F.least(F.floor((F.col(value) - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    return rows.filter(F.col(value).between(low, high)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def range_histogram(rows: DataFrame, value: str, bins: int = 30) -> DataFrame:
    """(bin, low, n): counts per bin of equal width over the values' own range, zero-filled; the last bin is closed.

    A single value is the middle of a range of one.
    """
    seen = rows.agg(F.min(value).alias("a"), F.max(value).alias("z")).filter("a IS NOT NULL")
    seen = seen.select(F.when(F.col("a") < F.col("z"), F.col("a")).otherwise(F.col("a") - 0.5).alias("a"), ((F.when(F.col("a") < F.col("z"), F.col("z")).otherwise(F.col("z") + 0.5) - F.when(F.col("a") < F.col("z"), F.col("a")).otherwise(F.col("a") - 0.5)) / bins).alias("w"))
    at = F.least(F.floor((F.col(value) - F.col("a")) / F.col("w")), F.lit(bins - 1)).cast("int")
    counted = rows.filter(F.col(value).isNotNull()).join(F.broadcast(seen), how="cross").groupBy(at.alias("bin")).agg(F.count("*").alias("n"))  # one row
    every = seen.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "a", "w")
    return every.join(counted.hint("merge"), "bin", "left").select("bin", (F.col("a") + F.col("bin") * F.col("w")).alias("low"), F.coalesce("n", F.lit(0)).alias("n"))


def rain_triggers(rain: DataFrame) -> DataFrame:
    """Candidates of heavy rain per trigger: number, and median, p90 and largest of score and six-hour total."""
    kinds = rain.sparkSession.createDataFrame([("hourly",), ("accumulation",)], "trigger string")
    q = F.array(F.lit(0.5), F.lit(0.9), F.lit(1.0))
    rows = rain.select(F.col("notes")["trigger"].alias("trigger"), "score", F.col("signals")["accumulation_mm"].alias("mm"))
    found = rows.groupBy("trigger").agg(F.count("*").alias("n"), F.percentile("score", q).alias("s"), F.percentile("mm", q).alias("a"))
    named = [F.round(F.get(c, k), 3).alias(f"{name}_{part}") for c, name in (("s", "score"), ("a", "mm")) for k, part in enumerate(("p50", "p90", "max"))]
    return kinds.join(F.broadcast(found), "trigger", "left").select("trigger", F.coalesce("n", F.lit(0)).alias("n"), *named)  # a row a trigger


def shares(incidents: DataFrame, key: str) -> DataFrame:
    counted = incidents.groupBy(key).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    return counted.join(F.broadcast(total), how="cross").select(key, "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))  # one row


def by_local_hour(incidents: DataFrame, stations: DataFrame) -> DataFrame:
    """Counts for hours 0 to 23 of the station's wall clock, zero-filled."""
    from tempestry.functions.scalars import local_time

    found = incidents.join(stations.hint("merge"), "station").groupBy(F.hour(local_time(F.col("onset_t"), F.col("tz"))).alias("hour")).agg(F.count("*").alias("n"))
    hours = incidents.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    return hours.join(found.hint("merge"), "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("n"))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    p = hits / n
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.greatest(F.lit(0.0), mid - half), F.least(F.lit(1.0), mid + half)


def within(incidents: DataFrame, windows: DataFrame) -> DataFrame:
    """Incidents with onset inside a window (station, from_t, until_t, ...) of their station, and the window's columns.

    Windows are cut into the days they touch, so the join is an equality on station and day; the exact bound follows.
    """
    day = lambda t: F.floor(t / 86400)
    days = windows.withColumn("_day", F.explode(F.sequence(day(F.col("from_t")), day(F.col("until_t")))))
    return incidents.withColumn("_day", day(F.col("onset_t"))).join(days.hint("merge"), ["station", "_day"]).filter(F.col("onset_t").between(F.col("from_t"), F.col("until_t"))).drop("_day")


def label_matches(incidents: DataFrame, labels: DataFrame) -> DataFrame:
    """Incidents within a day of a label's window at its station, with whether the type was expected."""
    found = within(incidents, labels)
    return found.select("label_id", "station", "detector", "metric", "onset_t", "severity", "priority_score", F.array_contains("expected", F.col("detector")).alias("is_expected"))


def spot_checks(incidents: DataFrame, checks: DataFrame) -> DataFrame:
    """Per check (check_id, station, kind, from_t, until_t) the number of its incidents above info, and the best of them:
    the highest score, of equal ones the earliest onset."""
    found = within(incidents.filter("severity <> 'info'"), checks).filter(F.col("detector") == F.col("kind"))
    best = found.groupBy("check_id").agg(F.count("*").alias("n"), F.max("priority_score").alias("best"), F.max_by("onset_t", F.struct("priority_score", -F.col("onset_t"))).alias("onset_t"))
    return checks.select("check_id").join(best.hint("merge"), "check_id", "left").select("check_id", F.coalesce("n", F.lit(0)).alias("n"), (F.col("n").isNotNull()).alias("passed"), "best", "onset_t")


def recall(incidents: DataFrame, labels: DataFrame) -> DataFrame:
    """Per label: found with an expected type, with it severe, with any type, and the best expected score."""
    m = label_matches(incidents, labels).groupBy("label_id").agg(
        F.max("is_expected").alias("expected_hit"), F.max(F.col("is_expected") & (F.col("severity") == "severe")).alias("severe_hit"), F.lit(True).alias("any_hit"),
        F.max(F.when(F.col("is_expected"), F.col("priority_score"))).alias("best_score"),
    )
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return labels.select("label_id").join(m.hint("merge"), "label_id", "left").select("label_id", no("expected_hit"), no("severe_hit"), no("any_hit"), "best_score")


def window_extremes(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Extremes of the enriched readings in every labelled window."""
    from tempestry.functions.scalars import humidex, wind_chill

    z = F.col("temperature_2m_z")
    at = features.withColumnRenamed("station", "s").join(labels, (F.col("s") == F.col("station")) & F.col("t").between(F.col("from_t"), F.col("until_t")))
    named = {
        "max_gust": F.max("wind_gusts_10m"), "max_gust_z": F.max("wind_gusts_10m_z"), "max_hourly_mm": F.max("precipitation"), "max_6h_mm": F.max("accumulation_6h"),
        "max_3h_fall": F.max(-F.col("pressure_delta")), "max_3h_dtemp": F.max(F.abs("temperature_2m_delta")), "min_temp_z": F.min(z), "max_temp_z": F.max(z), "max_abs_temp_z": F.max(F.abs(z)),
        "max_humidex": F.max(humidex(F.col("temperature_2m"), F.col("dew_point_2m"))), "min_wind_chill": F.min(wind_chill(F.col("temperature_2m"), F.col("wind_speed_10m"))),
    }
    return at.groupBy("label_id").agg(*[F.round(c, 3).alias(n) for n, c in named.items()])


def miss_decomposition(hits: DataFrame, extremes: DataFrame, labels: DataFrame, gates: DataFrame) -> DataFrame:
    """Missed labels: `cleared` lists the expected detectors whose physical gates the readings reached.

    gates: one row with gate_<metric>_<side>.
    """
    rows = labels.join(hits.filter("expected_hit").hint("merge"), "label_id", "left_anti").join(extremes.hint("merge"), "label_id", "left").join(F.broadcast(gates), how="cross")
    c = F.col
    warm, cold = F.abs("gate_temperature_2m_upper"), F.abs("gate_temperature_2m_lower")
    tests = {
        "wind_gust_burst": (c("max_gust") >= 90) | (c("max_gust_z") >= F.abs("gate_wind_gusts_10m_upper")),
        "heavy_rain_burst": (c("max_hourly_mm") >= 10) | (c("max_6h_mm") >= 12.5),
        "pressure_plunge": c("max_3h_fall") >= 6,
        "temperature_shock": (c("max_3h_dtemp") >= 5) & (c("max_abs_temp_z") >= warm),
        "cold_spell": c("min_temp_z") <= -cold,
        "warm_spell": c("max_temp_z") >= warm,
        "cold_stress": c("min_wind_chill") <= -25,
        "heat_stress": c("max_humidex") >= 38,
    }
    cleared = F.array_compact(F.array(*[F.when(F.array_contains("expected", F.lit(k)) & t, F.lit(k)) for k, t in tests.items()]))
    return rows.select("label_id", F.array_join(cleared, ",").alias("cleared"), F.when(F.size(cleared) > 0, "genuine gap").otherwise("resolution FN").alias("verdict"))


def chance_recall(incidents: DataFrame, labels: DataFrame, first_day: int, last_day: int) -> DataFrame:
    """Exact expectation of a label's recall if its window lay at any day of the range with equal odds.

    An incident is hit by the windows of a few start days, as many as the window is long; they are counted once each.
    """
    asks = labels.select("label_id", "station", F.explode("expected").alias("detector"), (F.col("until_t") - F.col("from_t")).alias("span"))
    met = asks.join(incidents.select("station", "detector", "onset_t").hint("merge"), ["station", "detector"])
    first = F.greatest(F.lit(first_day).cast("long"), F.ceil((F.col("onset_t") - F.col("span")) / 86400) + 1)
    last = F.least(F.lit(last_day).cast("long"), F.floor(F.col("onset_t") / 86400) + 1)
    days = met.select("label_id", first.alias("a"), last.alias("z")).filter("a <= z").select("label_id", F.explode(F.sequence("a", "z")).alias("day")).distinct()
    counted = days.groupBy("label_id").agg(F.count("*").alias("n"))
    return labels.select("label_id").join(counted.hint("merge"), "label_id", "left").select("label_id", F.round(F.coalesce("n", F.lit(0)) / F.lit(last_day - first_day + 1), 6).alias("chance"))


def boundary_jumps(smooth: DataFrame, month_hour: DataFrame, hour: int, metrics) -> DataFrame:
    """(station, boundary, metric, fixed_value, jump_smooth, jump_month): by how much the z score of a fixed value, midway
    between the medians of both days, changes over a calendar boundary at one local hour."""
    out = []
    at = lambda df, cond, name: df.filter(cond).filter(F.col("hour") == hour).filter(F.col("metric").isin(list(metrics))).select("station", "metric", F.struct("median", "scale").alias(name)).hint("merge")
    for boundary, m1, d1, m2, d2 in (("Dec31->Jan1", 12, 365, 1, 1), ("May31->Jun1", 5, 151, 6, 152)):
        rows = at(smooth, f"doy = {d1}", "a").join(at(smooth, f"doy = {d2}", "b"), ["station", "metric"])
        rows = rows.join(at(month_hour, f"month = {m1}", "c"), ["station", "metric"]).join(at(month_hour, f"month = {m2}", "e"), ["station", "metric"])
        fixed = (F.col("a.median") + F.col("b.median")) / 2
        z = {k: (fixed - F.col(f"{k}.median")) / F.col(f"{k}.scale") for k in "abce"}
        jumps = [F.round(F.abs(z[x] - z[y]) + 1e-9, 3).alias(n) for n, x, y in (("jump_smooth", "a", "b"), ("jump_month", "c", "e"))]
        out.append(rows.select("station", F.lit(boundary).alias("boundary"), "metric", F.round(fixed + 1e-9, 3).alias("fixed_value"), *jumps))
    return out[0].unionByName(out[1])


def usefulness(incidents: DataFrame) -> DataFrame:
    """useful, borderline or noise by physical bars of the incident's signals; signals: map<string,double>."""
    s = lambda k: F.coalesce(F.abs(F.col("signals")[k]), F.lit(0.0))
    chill = F.coalesce(F.col("signals")["wind_chill"], F.lit(0.0))
    bars = {
        "temperature_shock": ((s("z_score") >= 4) & (s("delta_c") >= 8), s("z_score") >= 3.5),
        "warm_spell": ((s("z_score") >= 4) | (s("departure_c") >= 10), s("z_score") >= 3.2),
        "cold_spell": ((s("z_score") >= 4) | (s("departure_c") >= 10), s("z_score") >= 3.2),
        "heavy_rain_burst": ((s("amount_mm") >= 15) | (s("accumulation_mm") >= 20), (s("amount_mm") >= 10) | (s("accumulation_mm") >= 15)),
        "wind_gust_burst": (s("gust_kmh") >= 80, (s("gust_kmh") >= 70) | (s("z_score") >= 4)),
        "heat_stress": (s("humidex") >= 40, s("humidex") >= 39),
        "cold_stress": (chill <= -30, chill <= -27),
        "pressure_plunge": (s("pressure_fall_hpa") >= 10, s("pressure_fall_hpa") >= 8),
        "spatial_anomaly": (s("difference") >= 8, s("difference") >= 6),
        "forecast_bust": (s("normalized_error") >= 4, F.lit(True)),
    }
    out = F.when(F.lit(False), "")
    for kind, (useful, borderline) in bars.items():
        is_kind = F.col("detector") == kind
        out = out.when(is_kind & useful, "useful").when(is_kind & borderline, "borderline").when(is_kind, "noise")
    return incidents.withColumn("label", out.otherwise("borderline"))


def detection_quality(found: DataFrame) -> DataFrame:
    """Per scenario true and false positives and false negatives from arrays `expected` and `got`."""
    return found.select(
        "scenario", F.size(F.array_intersect("expected", "got")).alias("tp"), F.size(F.array_except("got", "expected")).alias("fp"), F.size(F.array_except("expected", "got")).alias("fn")
    )


def detection_totals(quality: DataFrame) -> DataFrame:
    """Sums over scenarios, precision and recall (1 where there is nothing to be wrong about)."""
    t = quality.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    share = lambda a, b: F.when(F.col(a) + F.col(b) > 0, F.col(a) / (F.col(a) + F.col(b))).otherwise(1.0)
    return t.select("tp", "fp", "fn", F.round(share("tp", "fp"), 6).alias("precision"), F.round(share("tp", "fn"), 6).alias("recall"))


def conditional_recall(hits: DataFrame, misses: DataFrame) -> DataFrame:
    """Recall of all labels, and of those that the readings resolve: without the misses that no gate was reached for."""
    h = hits.agg(F.count("*").alias("labels"), F.count_if("expected_hit").alias("hits"))
    m = misses.agg(F.count_if(F.col("verdict") == "resolution FN").alias("unresolved"))
    rows = h.join(F.broadcast(m), how="cross")  # one row each
    open_ = F.col("labels") - F.col("unresolved")
    return rows.select("labels", "hits", "unresolved", F.round(F.col("hits") / F.col("labels"), 6).alias("recall"), F.round(F.when(open_ > 0, F.col("hits") / open_), 6).alias("conditional_recall"))
