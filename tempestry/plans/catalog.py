"""All registered station queries and their SQL counterparts, by inventory id."""

from __future__ import annotations

import uuid
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempestry.functions import scalars as S
from tempestry.operators import climatology as C
from tempestry.operators import detectors as D
from tempestry.operators import evaluation as E
from tempestry.operators import features as X
from tempestry.operators import feeds, lifecycle
from tempestry.operators.lineage import cut, shared_dir
from tempestry.plans import views
from tempestry.plans.sql import CHILL, HUMIDEX, STEP, TRAIN1, TRAIN2, with_
from tempestry.profile import CURRENT, DETECTORS, FORECAST_METRICS, MONTH_HOUR, SMOOTH_CLIPPED, WET_PERCENTILES, Profile
from tempestry.sources import artifact, tables

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
P = Profile(min_bucket_n=10)  # the month of readings at hand is short
PRESETS = {name: replace(p, min_bucket_n=10) for name, p in (("month_hour", MONTH_HOUR), ("smooth_clipped", SMOOTH_CLIPPED), ("current", CURRENT))}
AS_OF = 1706659200  # 2024-01-31


def query(name: str, sql: str | None = None):
    """Register a query and its SQL."""

    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = with_(sql)
        return f

    return keep


# ---- shared stages -----------------------------------------------------------------------------------


def train1(spark: SparkSession, d: str) -> DataFrame:
    return C.values(C.with_local(views.hourly(spark, d), views.stations(spark)).filter(F.col("t") < TRAIN1), P.climatology_metrics)


def train2(spark: SparkSession, d: str) -> DataFrame:
    return C.values(C.with_local(views.daily(spark, d), views.stations(spark)).filter(F.col("t") < TRAIN2), P.climatology_metrics)


def tail_rows(vals: DataFrame, readings: DataFrame, level: str = "smooth") -> DataFrame:
    """(metric, v): residuals, wet amounts and six-hour totals of the training part."""
    rest = C.residuals(vals, C.stats(vals, P)[level], C.LEVELS[level])
    wet = vals.filter((F.col("metric") == "precipitation") & (F.col("v") >= P.wet_mm)).select(F.lit("rain").alias("metric"), "v")
    return rest.unionByName(wet).unionByName(C.rolling_accumulations(readings, P).select(F.lit("rain_6h").alias("metric"), "v"))


#: What thresholds and tails are pooled over: the residuals of the metrics, wet hours, and wet six hours.
POOLED = [*P.climatology_metrics, "rain", "rain_6h"]
_FITTED: dict[tuple, dict] = {}


def climatology1(spark: SparkSession, d: str) -> dict:
    """The climatology of the training part: fitted once per application and content of the table, written, and read from
    then on."""
    key = (spark.sparkContext.applicationId, views.PARTS, views.content(spark, f"{d}/events.parquet"))
    if key not in _FITTED:
        totals = C.rolling_accumulations(views.hourly(spark, d).filter(F.col("t") < TRAIN1), P)
        path = f"{shared_dir(spark)}/climatology-{uuid.uuid4().hex}"
        fitted = artifact.load(spark, path, artifact.fit(cut(train1(spark, d)), totals, path, P))
        _FITTED[key] = {**fitted, "gates": {b: D.gates(*artifact.of_baseline(fitted, b)) for b in artifact.BASELINES}}
    return _FITTED[key]


def forget() -> None:
    """Fit anew, for example over other stations."""
    _FITTED.clear()


def _clim_of(spark: SparkSession, d: str, p: Profile) -> dict:
    fitted = climatology1(spark, d)
    return {**fitted, "gates": fitted["gates"]["smooth" if p.smooth_baseline else "month_hour"]}


def enriched(spark: SparkSession, d: str, p: Profile = P) -> DataFrame:
    """Features of all hourly readings; computed once, since every detector starts from them."""
    return cut(D.enriched(views.hourly(spark, d), views.stations(spark), _clim_of(spark, d, p), p))


def with_forecast(spark: SparkSession, d: str, df: DataFrame) -> DataFrame:
    return said_before(df, views.hourly(spark, d), views.forecasts(spark, d))


def said_before(df: DataFrame, readings: DataFrame, forecasts: DataFrame) -> DataFrame:
    """df with its forecasts and the rolling error of those of all `readings`."""
    mae = X.rolling_mae(df.select("t"), X.forecast_pairs(readings, forecasts, P), P)
    return X.matching_forecast(df, forecasts, P).join(mae.hint("merge"), "t")


PEER_COLUMNS = ["id", *[c for m in D.Z_METRICS for c in (m, f"{m}_z", f"{m}_conf")]]


def with_peers(spark: SparkSession, df: DataFrame) -> DataFrame:
    return X.with_peer_lists(df, views.stations(spark), PEER_COLUMNS)


def candidates(spark: SparkSession, d: str, p: Profile = P) -> DataFrame:
    """All ten detectors in one pass over the features with forecasts and peers."""
    df = enriched(spark, d, p)
    return cut(D.detect(joined(with_peers(spark, df), with_forecast(spark, d, df.select("station", "t", *FORECAST_METRICS))), p))


def joined(features: DataFrame, said: DataFrame) -> DataFrame:
    """Features of readings with what was forecast for them."""
    return features.join(said.drop(*FORECAST_METRICS).hint("merge"), ["station", "t"])


def incidents(spark: SparkSession, d: str, by: str = "strength", found: DataFrame | None = None) -> DataFrame:
    found = candidates(spark, d) if found is None else found
    return lifecycle.incidents(found, views.hourly(spark, d), P, by)


INCIDENT = ["station", "detector", "metric", "onset_t", "last_t", "hits", "peak_t", "peak_strength", "priority_score", "resolved_t", "status", "severity"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranked incident feed."""
    return feeds.events_feed(incidents(spark, sf_dir).select(*INCIDENT), 50)


# ---- sources and feeds -------------------------------------------------------------------------------


@query("s5_read_readings", "SELECT station, t, temperature_2m, precipitation, pressure_msl, weather_code FROM v1")
def s5(spark, d):
    return views.hourly(spark, d).select("station", "t", "temperature_2m", "precipitation", "pressure_msl", "weather_code")


@query("s7_dedupe_readings", "SELECT * FROM v3 QUALIFY row_number() OVER (PARTITION BY station, t ORDER BY polled_at, reading_id) = 1")
def s7(spark, d):
    return feeds.dedupe_first(views.raw(spark, d), ["station", "t"], ["polled_at", "reading_id"])


@query("s11_backfill_chunks", "SELECT k AS first_day, least(k + 4, (SELECT max(t) // 86400 FROM v1)) AS last_day, (SELECT count(*) FROM v1 WHERE t // 86400 BETWEEN k AND k + 4) AS n FROM (SELECT unnest(range((SELECT min(t) // 86400 FROM v1), (SELECT max(t) // 86400 FROM v1) + 1, 5)) AS k)")
def s11(spark, d):
    days = views.hourly(spark, d).groupBy(F.floor(F.col("t") / 86400).alias("day")).agg(F.count("*").alias("n"))
    ends = days.agg(F.min("day").alias("a"), F.max("day").alias("z"))
    chunks = ends.select("z", F.explode(F.sequence("a", "z", F.lit(5).cast("long"))).alias("first_day")).select("first_day", F.least(F.col("first_day") + 4, F.col("z")).alias("last_day"))
    # every day belongs to one chunk, so the range join is an equality on the chunk's first day
    first = days.join(F.broadcast(ends), how="cross").select((F.col("day") - (F.col("day") - F.col("a")) % 5).alias("first_day"), "n")
    return chunks.join(first.groupBy("first_day").agg(F.sum("n").alias("n")).hint("merge"), "first_day", "left").select("first_day", "last_day", F.coalesce("n", F.lit(0)).alias("n"))


@query("f1_readings_feed", f"SELECT station, t, temperature_2m FROM v1 WHERE station = 'click' AND t BETWEEN {TRAIN1} AND {AS_OF} ORDER BY t DESC LIMIT 50")
def f1(spark, d):
    return feeds.feed(views.hourly(spark, d), "t", "click", TRAIN1, AS_OF).select("station", "t", "temperature_2m")


_INC = ", ".join(INCIDENT)


@query("f2_events_feed", f"SELECT {_INC} FROM inc ORDER BY priority_score DESC NULLS LAST, onset_t DESC, station, detector, metric LIMIT 50")
def f2(spark, d):
    rows = incidents(spark, d).select(*INCIDENT)
    return rows.orderBy(F.desc_nulls_last("priority_score"), F.desc("onset_t"), "station", "detector", "metric").limit(feeds.bounded(50))


@query("f3_forecasts_feed", f"SELECT station, target_t, lead_hours, temperature_2m FROM v5 WHERE target_t >= {TRAIN1} ORDER BY target_t DESC, station LIMIT 50")
def f3(spark, d):
    return feeds.feed(views.forecasts(spark, d), "target_t", start=TRAIN1).select("station", "target_t", "lead_hours", "temperature_2m")


@query("f5_recent_history", f"SELECT station, t, temperature_2m FROM v1 WHERE station = 'view' AND t >= {TRAIN1} - 172800 AND t < {TRAIN1} ORDER BY t DESC LIMIT 24")
def f5(spark, d):
    return feeds.recent_history(views.hourly(spark, d), "view", TRAIN1, 48, 24).select("station", "t", "temperature_2m")


@query("f6_event_filter", f"SELECT {_INC} FROM inc WHERE onset_t BETWEEN {AS_OF} - 14*86400 AND {AS_OF} AND detector IN ('heat_stress', 'wind_gust_burst') AND severity IN ('warning', 'severe')")
def f6(spark, d):
    return feeds.event_filter(incidents(spark, d).select(*INCIDENT), AS_OF, ("heat_stress", "wind_gust_burst"), ("warning", "severe"), 14)


@query("f7_top_incidents", f"SELECT {_INC} FROM rinc ORDER BY priority_score DESC, onset_t, station, detector, metric LIMIT 30")
def f7(spark, d):
    return incidents(spark, d, "score").select(*INCIDENT).orderBy(F.desc("priority_score"), "onset_t", "station", "detector", "metric").limit(30)


@query("f8_health_counts", "SELECT (SELECT count(*) FROM v1) AS readings, (SELECT count(*) FROM inc) AS events")
def f8(spark, d):
    a = views.hourly(spark, d).agg(F.count("*").alias("readings"))
    return a.join(F.broadcast(incidents(spark, d).agg(F.count("*").alias("events"))), how="cross")


@query("f9_suppress_types", "SELECT detector, count(*) AS n FROM cand WHERE detector NOT IN ('forecast_bust') GROUP BY detector")
def f9(spark, d):
    return feeds.suppressed(candidates(spark, d), ["forecast_bust"]).groupBy("detector").agg(F.count("*").alias("n"))


# ---- joins -------------------------------------------------------------------------------------------


@query("j1_latest_peers", "SELECT station, t, peer, peer_t, temperature_2m FROM (SELECT r.station, r.t, p.station AS peer, f.t AS peer_t, f.temperature_2m FROM (SELECT station, t, peer_group FROM v1 JOIN v4 USING (station)) r JOIN v4 p ON p.peer_group = r.peer_group AND p.station <> r.station ASOF JOIN v1 f ON f.station = p.station AND f.t <= r.t)")
def j1(spark, d):
    return X.latest_peers(views.hourly(spark, d), views.stations(spark), ["temperature_2m"])


@query("j2_k_hour_delta", "SELECT station, t, round(temperature_2m_delta, 6) AS temperature_delta, round(pressure_delta, 6) AS pressure_delta FROM delta")
def j2(spark, d):
    h = X.with_history(views.hourly(spark, d), P)
    return h.select("station", "t", F.round("temperature_2m_delta", 6).alias("temperature_delta"), F.round("pressure_delta", 6).alias("pressure_delta"))


@query("j3_matching_forecast", "SELECT a.station, a.t, a.temperature_2m, f.temperature_2m AS forecast, f.lead_hours FROM v1 a LEFT JOIN v5 f ON f.station = a.station AND f.target_t = a.t AND f.lead_hours BETWEEN 3 AND 12")
def j3(spark, d):
    m = X.matching_forecast(views.hourly(spark, d), views.forecasts(spark, d), P)
    return m.select("station", "t", "temperature_2m", F.col("fcst_temperature_2m").alias("forecast"), "lead_hours")


@query("j4_forecast_pairs", f"SELECT station, t, temperature_2m, fcst_temperature_2m AS forecast FROM pairs WHERE t >= {AS_OF} - 14*86400 AND t < {AS_OF} ORDER BY t DESC, station LIMIT 200")
def j4(spark, d):
    p = X.forecast_pairs(views.hourly(spark, d), views.forecasts(spark, d), P).filter((F.col("t") >= AS_OF - P.pair_days * 86400) & (F.col("t") < AS_OF))
    return p.orderBy(F.desc("t"), "station").limit(P.pair_limit).select("station", "t", "temperature_2m", F.col("fcst_temperature_2m").alias("forecast"))


_LOOK = ", ".join(f"{m}_{c}" for m in D.Z_METRICS for c in ("median", "scale", "n", "bucket"))


@query("j5_climatology_lookup", f"SELECT station, t, {_LOOK} FROM look")
def j5(spark, d):
    vals = train1(spark, d)
    df = C.lookup(C.with_local(views.hourly(spark, d), views.stations(spark)), C.stats(vals, P), D.Z_METRICS, P)
    return df.select("station", "t", *[f"{m}_{c}" for m in D.Z_METRICS for c in ("median", "scale", "n", "bucket")])


@query("j6_wet_precip_lookup", "SELECT station, t, wet_count, total_count, wet_p50, wet_p95, wet_p99, wet_bucket FROM look")
def j6(spark, d):
    """The ladder of wet hours: day of year, month and hour, month, station."""
    rows = C.wet_lookup(C.with_local(views.hourly(spark, d), views.stations(spark)), C.wet_levels(train1(spark, d), P), P)
    return rows.select("station", "t", "wet_count", "total_count", "wet_p50", "wet_p95", "wet_p99", "wet_bucket")


@query("j7_label_match", "SELECT DISTINCT x.label_id, r.station, r.detector, r.metric, r.onset_t, r.severity, r.priority_score, EXISTS (SELECT 1 FROM v6 y WHERE y.label_id = x.label_id AND y.expected_type = r.detector) AS is_expected FROM rinc r JOIN v6 x ON x.station = r.station AND r.onset_t BETWEEN x.from_t AND x.until_t")
def j7(spark, d):
    return E.label_matches(incidents(spark, d, "score"), views.labels(spark))


@query("j8_spot_check_match", "SELECT c.check_id, count(r.onset_t) AS n, count(r.onset_t) > 0 AS passed, max(priority_score) AS best, arg_max(onset_t, {'s': priority_score, 'o': -onset_t}) AS onset_t FROM v7 c LEFT JOIN rinc r ON r.station = c.station AND r.detector = c.kind AND r.severity <> 'info' AND r.onset_t BETWEEN c.from_t AND c.until_t GROUP BY c.check_id")
def j8(spark, d):
    return E.spot_checks(incidents(spark, d, "score"), views.checks(spark))


@query("j9_event_marker_join", "SELECT r.station, r.detector, r.metric, r.peak_t, CASE r.metric WHEN 'temperature_2m' THEN v1.temperature_2m WHEN 'humidex' THEN v1.temperature_2m WHEN 'wind_chill' THEN v1.temperature_2m WHEN 'precipitation' THEN v1.precipitation WHEN 'wind_gusts_10m' THEN v1.wind_gusts_10m WHEN 'wind_speed_10m' THEN v1.wind_speed_10m WHEN 'pressure_msl' THEN v1.pressure_msl END AS y FROM rinc r JOIN v1 ON v1.station = r.station AND v1.t = r.peak_t")
def j9(spark, d):
    h = views.hourly(spark, d)
    r = incidents(spark, d, "score").join(h.withColumnRenamed("t", "peak_t"), ["station", "peak_t"])
    y = F.when(F.col("metric").isin("temperature_2m", "humidex", "wind_chill"), F.col("temperature_2m"))
    for m in ("precipitation", "wind_gusts_10m", "wind_speed_10m", "pressure_msl"):
        y = y.when(F.col("metric") == m, F.col(m))
    y = F.coalesce(y, F.col("signals")["value"])
    return r.select("station", "detector", "metric", "peak_t", y.alias("y")).filter("y IS NOT NULL")


@query("j10_chart_series", "SELECT coalesce(a.t, b.t) AS t, round(observed, 6) AS observed, round(forecast, 6) AS forecast FROM (SELECT t, avg(temperature_2m) AS observed FROM v1 GROUP BY t) a FULL JOIN (SELECT target_t AS t, avg(temperature_2m) AS forecast FROM v5 GROUP BY 1) b ON a.t = b.t")
def j10(spark, d):
    c = feeds.chart_series(views.hourly(spark, d), views.forecasts(spark, d), "temperature_2m")
    return c.select("t", F.round("observed", 6).alias("observed"), F.round("forecast", 6).alias("forecast"))


# ---- statistics and climatology ----------------------------------------------------------------------


def _by_station(spark, d, *aggs):
    return views.daily(spark, d).groupBy("station").agg(*aggs)


@query("a1_median", "SELECT station, round(median(temperature_2m), 6) AS m FROM v2 GROUP BY station")
def a1(spark, d):
    return _by_station(spark, d, F.round(F.median("temperature_2m"), 6).alias("m"))


@query("a2_mad", "SELECT station, round(mad(temperature_2m), 6) AS mad FROM v2 GROUP BY station")
def a2(spark, d):
    v = views.daily(spark, d)
    m = v.groupBy("station").agg(F.median("temperature_2m").alias("m"))
    return v.join(m, "station").groupBy("station").agg(F.round(F.median(F.abs(F.col("temperature_2m") - F.col("m"))), 6).alias("mad"))


@query("a3_percentile", "SELECT station, " + ", ".join(f"round(quantile_cont(pressure_msl, {q}), 6) AS p{i}" for i, q in enumerate((0.05, 0.5, 0.95, 0.995))) + " FROM v2 GROUP BY station")
def a3(spark, d):
    q = F.percentile("pressure_msl", F.array(*[F.lit(x) for x in (0.05, 0.5, 0.95, 0.995)]))
    return _by_station(spark, d, q.alias("q")).select("station", *[F.round(F.get("q", i), 6).alias(f"p{i}") for i in range(4)])


@query("a4_mean_pstd", "SELECT station, round(avg(wind_gusts_10m), 6) AS mean, round(stddev_pop(wind_gusts_10m), 6) AS pstd FROM v2 GROUP BY station")
def a4(spark, d):
    return _by_station(spark, d, F.round(F.avg("wind_gusts_10m"), 6).alias("mean"), F.round(F.stddev_pop("wind_gusts_10m"), 6).alias("pstd"))


for _level, _step, _keys in (("month_hour", "mh2", ["month", "hour"]), ("month", "mo2", ["month"]), ("city", "city2", []), ("smooth", "smooth2", ["doy", "hour"])):

    @query(f"{'w9_smooth_doy_window' if _level == 'smooth' else 'a5_robust_stats_' + _level}", f"SELECT station, {''.join(k + ', ' for k in _keys)}metric, n, median, mad, scale FROM {_step}")
    def a5(spark, d, level=_level):
        return C.stats(train2(spark, d), P)[level]


@query("a6_wet_precip_stats", "SELECT station, month, count(*) AS total_count, count(*) FILTER (WHERE v >= 0.1) AS wet_count, " + ", ".join(f"round(quantile_cont(v, {m / 100}) FILTER (WHERE v >= 0.1) + 1e-9, 4) AS p{m}" for m in (50, 75, 90, 95, 99)) + " FROM val2 WHERE metric = 'precipitation' GROUP BY ALL")
def a6(spark, d):
    return C.wet_levels(train2(spark, d), P)["month"]


def _pooled2(spark, d, level: str = "smooth"):
    return C.pooled(tail_rows(train2(spark, d), views.daily(spark, d).filter(F.col("t") < TRAIN2), level), POOLED)


@query("a7_tail_anchors", "SELECT metric, kind, k, v, p FROM tail2")
def a7(spark, d):
    return _pooled2(spark, d)[1]


@query("a8_rolling_accumulations", "SELECT station, t, round(v, 6) AS v FROM acc1")
def a8(spark, d):
    return C.rolling_accumulations(views.hourly(spark, d).filter(F.col("t") < TRAIN1), P).withColumn("v", F.round("v", 6))


@query("a9_empirical_thresholds", "SELECT * FROM thrall2")
def a9(spark, d):
    """Residuals of the day-of-year baseline, wet hours and wet six hours."""
    return _pooled2(spark, d)[0]


@query("a9b_legacy_thresholds", "SELECT * FROM thrmhall2")
def a9b(spark, d):
    """The same of the month and hour baseline."""
    return _pooled2(spark, d, "month_hour")[0]


@query("a9c_threshold_summary", "SELECT (SELECT upper_z FROM thr2 WHERE metric = 'temperature_2m') AS temperature_upper, (SELECT lower_z FROM thr2 WHERE metric = 'temperature_2m') AS temperature_lower, (SELECT upper_z FROM thr2 WHERE metric = 'wind_gusts_10m') AS gust_upper, (SELECT round(quantile_cont(v, 0.995) + 1e-9, 4) FROM val2 WHERE metric = 'precipitation' AND v >= 0.1) AS wet_amount")
def a9c(spark, d):
    pick = lambda m, c, name: F.max(F.when(F.col("metric") == m, F.col(c))).alias(name)
    return a9(spark, d).agg(pick("temperature_2m", "upper_z", "temperature_upper"), pick("temperature_2m", "lower_z", "temperature_lower"), pick("wind_gusts_10m", "upper_z", "gust_upper"), pick("rain", "upper_z", "wet_amount"))


@query("a10_rolling_mae", "SELECT t, " + ", ".join(f"round({m}_mae + 1e-9, 6) AS {m}_mae, {m}_pairs" for m in FORECAST_METRICS) + " FROM mae")
def a10(spark, d):
    h = views.hourly(spark, d)
    r = X.rolling_mae(h, X.forecast_pairs(h, views.forecasts(spark, d), P), P)
    return r.select("t", *[c for m in FORECAST_METRICS for c in (C.places(F.col(f"{m}_mae"), 6).alias(f"{m}_mae"), f"{m}_pairs")])


_JUMP = """SELECT a.station, '{name}' AS boundary, a.metric, round((a.median + b.median) / 2 + 1e-9, 3) AS fixed_value, round(abs(((a.median + b.median) / 2 - a.median) / a.scale - ((a.median + b.median) / 2 - b.median) / b.scale) + 1e-9, 3) AS jump_smooth,
 round(abs(((a.median + b.median) / 2 - c.median) / c.scale - ((a.median + b.median) / 2 - e.median) / e.scale) + 1e-9, 3) AS jump_month
 FROM smooth2 a JOIN smooth2 b ON b.station = a.station AND b.metric = a.metric AND b.hour = 0 AND b.doy = {d2} JOIN mh2 c ON c.station = a.station AND c.metric = a.metric AND c.hour = 0 AND c.month = {m1}
 JOIN mh2 e ON e.station = a.station AND e.metric = a.metric AND e.hour = 0 AND e.month = {m2} WHERE a.hour = 0 AND a.doy = {d1}"""


@query("a25_boundary_diagnostics", _JUMP.format(name="Dec31->Jan1", m1=12, d1=365, m2=1, d2=1) + " UNION ALL " + _JUMP.format(name="May31->Jun1", m1=5, d1=151, m2=6, d2=152))
def a25(spark, d):
    s = C.stats(train2(spark, d), P)
    return E.boundary_jumps(s["smooth"], s["month_hour"], 0, P.climatology_metrics)  # daily values stand at midnight


# ---- windows -----------------------------------------------------------------------------------------


@query("w1_history_n", "SELECT station, t, count(*) OVER (PARTITION BY station ORDER BY t RANGE BETWEEN 1209600 PRECEDING AND 1 PRECEDING) AS by_time, count(*) OVER (PARTITION BY station ORDER BY t ROWS BETWEEN 336 PRECEDING AND 1 PRECEDING) AS by_rows FROM v1")
def w1(spark, d):
    return views.hourly(spark, d).select("station", "t", X.history_n(P).alias("by_time"), X.history_n(Profile(history_rows=True)).alias("by_rows"))


@query("w2_accumulation_6h", "SELECT station, t, round(accumulation_6h, 6) AS mm FROM hist")
def w2(spark, d):
    return views.hourly(spark, d).select("station", "t", F.round(X.accumulation_6h(), 6).alias("mm"))


@query("w3_rolling_p05_delta", "SELECT station, t, round(p05_delta, 6) AS p05, n_deltas FROM hist")
def w3(spark, d):
    return X.with_history(views.hourly(spark, d), P).select("station", "t", F.round("p05_delta", 6).alias("p05"), "n_deltas")


@query("w5_rolling_percentiles", "SELECT station, t, round(quantile_cont(temperature_2m, 0.05) OVER w, 6) AS p05, round(quantile_cont(temperature_2m, 0.95) OVER w, 6) AS p95 FROM v1 WINDOW w AS (PARTITION BY station ORDER BY t RANGE BETWEEN 172800 PRECEDING AND 1 PRECEDING)")
def w5(spark, d):
    w = X.by_station().rangeBetween(-172800, -1)
    return views.hourly(spark, d).select("station", "t", *[F.round(F.percentile("temperature_2m", F.lit(q)).over(w), 6).alias(n) for n, q in (("p05", 0.05), ("p95", 0.95))])


@query("w6_streak3", "SELECT station, t, temperature_2m >= 20 AND lag(temperature_2m) OVER w >= 20 AND lag(temperature_2m, 2) OVER w >= 20 AS streak FROM v1 WINDOW w AS (PARTITION BY station ORDER BY t)")
def w6(spark, d):
    w = X.by_station()
    v = F.col("temperature_2m")
    return views.hourly(spark, d).select("station", "t", ((v >= 20) & (F.lag(v).over(w) >= 20) & (F.lag(v, 2).over(w) >= 20)).alias("streak"))


@query("w7_previous_code", "SELECT station, t, lag(temperature_2m) OVER w AS previous, last_value(nullif(weather_code, 0) IGNORE NULLS) OVER (PARTITION BY station ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS code FROM v1 WINDOW w AS (PARTITION BY station ORDER BY t)")
def w7(spark, d):
    h = views.hourly(spark, d).withColumn("code", F.nullif(F.col("weather_code"), F.lit(0)))
    return h.select("station", "t", X.previous("temperature_2m").alias("previous"), X.previous_known("code").alias("code"))


@query("w10_best_per_key", "SELECT station, t, detector, metric, strength, score FROM best")
def w10(spark, d):
    return lifecycle.best_per_key(candidates(spark, d)).select("station", "t", "detector", "metric", "strength", "score")


# ---- scalars -----------------------------------------------------------------------------------------


@query("x1_local_parts", "SELECT station, t, hour, month, doy FROM loc1")
def x1(spark, d):
    return C.with_local(views.hourly(spark, d), views.stations(spark)).select("station", "t", "hour", "month", "doy")


@query("x2_robust_z", "SELECT station, t, " + ", ".join(f"round({m}_z, 4) AS {m}_z, {m}_conf" for m in D.Z_METRICS) + " FROM feat")
def x2(spark, d):
    return enriched(spark, d).select("station", "t", *[c for m in D.Z_METRICS for c in (F.round(f"{m}_z", 4).alias(f"{m}_z"), f"{m}_conf")])


from tempestry.plans.sql import rarity as _rarity  # noqa: E402


@query("x5_rarity", f"SELECT station, t, round({_rarity('temperature_2m', 'upper', 'temperature_2m_z')}, 4) AS rarity FROM feat WHERE temperature_2m_z IS NOT NULL")
def x5(spark, d):
    df = enriched(spark, d).filter("temperature_2m_z IS NOT NULL")
    return df.select("station", "t", F.round(S.rarity(F.col("temperature_2m_upper"), F.col("temperature_2m_z"), F.lit(0.0)), 4).alias("rarity"))


@query("x6_wet_percentile_bucket", "SELECT station, t, wet_bucket AS level, CASE WHEN precipitation <= wet_p50 THEN 50 WHEN precipitation <= wet_p75 THEN 75 WHEN precipitation <= wet_p90 THEN 90 WHEN precipitation <= wet_p95 THEN 95 ELSE 99 END AS bucket FROM look WHERE precipitation >= 0.1 AND wet_p50 IS NOT NULL")
def x6(spark, d):
    """Where a wet hour stands among those of its own bucket, whatever level that is of."""
    rows = C.with_local(views.hourly(spark, d).filter(F.col("precipitation") >= P.wet_mm), views.stations(spark))
    rows = C.wet_lookup(rows, C.wet_levels(train1(spark, d), P), P).filter("wet_p50 IS NOT NULL")
    marks = F.array(*[F.struct(F.col(f"wet_p{m}").alias("v"), F.lit(m).alias("p")) for m in WET_PERCENTILES])
    return rows.select("station", "t", F.col("wet_bucket").alias("level"), S.wet_bucket(F.col("precipitation"), marks).alias("bucket"))


@query("x8_humidex_wind_chill", f"SELECT station, t, round({HUMIDEX}, 4) AS humidex, round({CHILL}, 4) AS wind_chill, round(abs(apparent_temperature - temperature_2m) + 1e-9, 4) AS gap FROM v1")
def x8(spark, d):
    t = F.col("temperature_2m")
    return views.hourly(spark, d).select(
        "station", "t", F.round(S.humidex(t, F.col("dew_point_2m")), 4).alias("humidex"), F.round(S.wind_chill(t, F.col("wind_speed_10m")), 4).alias("wind_chill"),
        C.places(F.abs(F.col("apparent_temperature") - t)).alias("gap"),
    )


@query("x10_weather_codes", "SELECT station, t, CASE WHEN weather_code = 95 THEN 3 WHEN weather_code = 63 THEN 2 WHEN weather_code = 51 THEN 1 ELSE 0 END AS level, CASE WHEN weather_code = 95 THEN 'severe' WHEN weather_code = 63 THEN 'moderate' WHEN weather_code = 51 THEN 'mild_precipitation' ELSE 'clear' END AS category FROM v1")
def x10(spark, d):
    code = F.col("weather_code")
    return views.hourly(spark, d).select("station", "t", S.weather_level(code).alias("level"), S.weather_category(code).alias("category"))


@query("x13_forecast_residual", "SELECT p.station, p.t, round(temperature_2m - fcst_temperature_2m, 6) AS residual, round(abs(temperature_2m - fcst_temperature_2m) / temperature_2m_mae, 6) AS normalized FROM pairs p JOIN mae USING (t)")
def x13(spark, d):
    h = views.hourly(spark, d)
    pairs = X.forecast_pairs(h, views.forecasts(spark, d), P)
    r = F.col("temperature_2m") - F.col("fcst_temperature_2m")
    return pairs.join(X.rolling_mae(h, pairs, P), "t").select("station", "t", F.round(r, 6).alias("residual"), F.round(F.abs(r) / F.col("temperature_2m_mae"), 6).alias("normalized"))


# ---- detectors and lifecycle -------------------------------------------------------------------------

CANDIDATE = ["station", "t", "metric", "strength", "score", "severity"]


def _detector(k: int):
    def run(spark, d):
        df = enriched(spark, d)
        df = with_forecast(spark, d, df) if k == 8 else with_peers(spark, df) if k == 9 else df
        return D.REGISTRY[k](df, P).select(*CANDIDATE)

    return run


for _k, _name in enumerate(DETECTORS):
    query(f"d{_k + 1}_{_name}", f"SELECT {', '.join(CANDIDATE)} FROM d{_k + 1}")(_detector(_k))


@query("d5_heavy_rain_burst_p95", f"SELECT {', '.join(CANDIDATE)}, evidence FROM d5_p95")
def d5_p95(spark, d):
    """Heavy rain without training quantiles: the gate is the 95th percentile of the bucket's own wet hours."""
    p = replace(P, quantile_gates=False)
    out = D.heavy_rain_burst(enriched(spark, d, p), p)
    return out.select(*CANDIDATE, S.explanation(F.col("reason"), F.col("signals"))["evidence"].alias("evidence"))


@query("u1_detect", "SELECT detector, metric, severity, count(*) AS n, max(score) AS top FROM cand GROUP BY ALL")
def u1(spark, d):
    return candidates(spark, d).groupBy("detector", "metric", "severity").agg(F.count("*").alias("n"), F.max("score").alias("top"))


@query("l1_collapse_incidents", f"SELECT {_INC} FROM inc")
def l1(spark, d):
    return incidents(spark, d).select(*INCIDENT)


@query("l4_replay_collapse", f"SELECT {_INC} FROM rinc")
def l4(spark, d):
    return incidents(spark, d, "score").select(*INCIDENT)


# ---- evaluation --------------------------------------------------------------------------------------

_KINDS = ", ".join(f"('{k}')" for k in DETECTORS)


@query("a11_incident_rates", f"""SELECT coalesce(detector, 'OVERALL') AS detector, CAST(sum(i) AS BIGINT) AS incidents, CAST(sum(r) AS BIGINT) AS raw, round(sum(i) * 1000.0::DOUBLE / (SELECT count(*) FROM v1), 4) AS per_1000,
 round(sum(i)::DOUBLE / (SELECT sum(round_even(n / 24.0::DOUBLE, 0)) FROM (SELECT count(*) AS n FROM v1 GROUP BY station)), 4) AS per_day, round(CASE WHEN sum(i) > 0 THEN sum(r)::DOUBLE / sum(i) ELSE 0.0 END, 4) AS collapse
 FROM (SELECT k AS detector, (SELECT count(*) FROM rinc WHERE detector = k) AS i, (SELECT count(*) FROM cand WHERE detector = k) AS r FROM (VALUES {_KINDS}) AS x(k)) GROUP BY ROLLUP (detector)""")
def a11(spark, d):
    c = candidates(spark, d)
    return E.rates(incidents(spark, d, "score", c), c, views.hourly(spark, d))


@query("a12_city_rates", "SELECT station, i AS incidents, r AS raw, round(i / n, 6) AS per_reading FROM (SELECT v.station, count(*)::DOUBLE AS n, (SELECT count(*) FROM rinc x WHERE x.station = v.station) AS i, (SELECT count(*) FROM cand x WHERE x.station = v.station) AS r FROM v1 v GROUP BY v.station)")
def a12(spark, d):
    n = views.hourly(spark, d).groupBy("station").agg(F.count("*").alias("n"))
    c = candidates(spark, d)
    i = incidents(spark, d, "score", c).groupBy("station").agg(F.count("*").alias("incidents"))
    r = c.groupBy("station").agg(F.count("*").alias("raw"))
    rows = n.join(i.hint("merge"), "station", "left").join(r.hint("merge"), "station", "left").na.fill(0)
    return rows.select("station", "incidents", "raw", F.round(F.col("incidents") / F.col("n"), 6).alias("per_reading"))


@query("a13_severity_table", "SELECT detector, count(*) FILTER (WHERE severity = 'info') AS info, count(*) FILTER (WHERE severity = 'warning') AS warning, count(*) FILTER (WHERE severity = 'severe') AS severe FROM rinc GROUP BY detector")
def a13(spark, d):
    return E.severity_table(incidents(spark, d, "score"))


@query("a16_score_distribution", "SELECT detector, round(quantile_cont(score, 0.5), 3) AS p50, round(quantile_cont(score, 0.9), 3) AS p90, round(quantile_cont(score, 0.99), 3) AS p99, max(score) AS top, count(*) AS n FROM cand GROUP BY detector")
def a16(spark, d):
    return E.score_distribution(candidates(spark, d))


_QS = ", ".join(f"round({agg}, 3) AS {name}_{part}" for name, col in (("score", "score"), ("mm", "mm")) for part, agg in (("p50", f"quantile_cont({col}, 0.5)"), ("p90", f"quantile_cont({col}, 0.9)"), ("max", f"max({col})")))


@query("a17_rain_trigger_mix", f"SELECT k.trigger, count(r.score) AS n, {_QS} FROM (VALUES ('hourly'), ('accumulation')) AS k(trigger) LEFT JOIN (SELECT d5.score, CASE WHEN f.precipitation >= greatest(f.wet_p995, 10.0) THEN 'hourly' ELSE 'accumulation' END AS trigger, round(f.accumulation_6h + 1e-9, 3) AS mm FROM d5 JOIN feat f ON f.station = d5.station AND f.t = d5.t) r ON r.trigger = k.trigger GROUP BY k.trigger")
def a17(spark, d):
    return E.rain_triggers(D.heavy_rain_burst(enriched(spark, d), P))


@query("a18_score_histogram", "SELECT CAST(least(floor(score / 5.0::DOUBLE), 19) AS INT) AS bin, count(*) AS n FROM cand GROUP BY 1")
def a18(spark, d):
    return E.histogram(candidates(spark, d), "score", 0.0, 100.0, 20)


_RANGE = "(SELECT CASE WHEN a < z THEN a ELSE a - 0.5::DOUBLE END AS lo, (CASE WHEN a < z THEN z ELSE z + 0.5::DOUBLE END - CASE WHEN a < z THEN a ELSE a - 0.5::DOUBLE END) / 30 AS w FROM (SELECT min(strength) AS a, max(strength) AS z FROM d1) WHERE a IS NOT NULL)"
# a single value is the middle of a range of one; without values there is no range and no bin
Z_HISTOGRAM = f"SELECT CAST(b AS INT) AS bin, round(any_value(lo + b * w), 6) AS low, count(v) AS n FROM (SELECT unnest(range(30)) AS b, lo, w FROM {_RANGE}) LEFT JOIN (SELECT strength AS v, least(floor((strength - lo) / w), 29) AS k FROM d1, {_RANGE}) ON k = b GROUP BY b"


@query("a18_z_histogram", Z_HISTOGRAM)
def a18z(spark, d):
    shocks = D.temperature_shock(enriched(spark, d), P).select(F.col("signals")["z_score"].alias("z"))
    return E.range_histogram(shocks, "z").withColumn("low", F.round("low", 6))


@query("a19_incidents_by_local_hour", "SELECT CAST(h AS INT) AS hour, count(i.station) AS n FROM range(24) AS x(h) LEFT JOIN (SELECT station, hour(timezone(tz, timezone('UTC', make_timestamp(onset_t * 1000000)))) AS hr FROM rinc JOIN v4 USING (station)) i ON i.hr = h GROUP BY h")
def a19(spark, d):
    return E.by_local_hour(incidents(spark, d, "score"), views.stations(spark))


@query("a20_severity_share", "SELECT severity, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM rinc), 6) AS share FROM rinc GROUP BY severity")
def a20(spark, d):
    return E.shares(incidents(spark, d, "score"), "severity")


@query("a20_type_share", "SELECT detector, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM rinc), 6) AS share FROM rinc GROUP BY detector")
def a20b(spark, d):
    return E.shares(incidents(spark, d, "score"), "detector")


_V = ["click", "error", "purchase", "signup", "view"]


@query("a21_event_distribution", f"SELECT s AS station, k AS detector, n, max(n) OVER () AS largest FROM (SELECT s, k, (SELECT count(*) FROM inc WHERE station = s AND detector = k) AS n FROM (VALUES {', '.join(f'({chr(39)}{x}{chr(39)})' for x in _V)}) AS a(s), (VALUES {_KINDS}) AS b(k))")
def a21(spark, d):
    return feeds.event_distribution(incidents(spark, d), _V, DETECTORS)


@query("a22_compare_series", "SELECT t, " + ", ".join(f'max(temperature_2m) FILTER (WHERE station = \'{s}\') AS "{s}"' for s in _V) + " FROM v1 GROUP BY t")
def a22(spark, d):
    return feeds.compare_series(views.hourly(spark, d), "temperature_2m", _V)


_RAW = [str(k) for k in range(20)]


@query("a22_last_arrivals", "SELECT t, " + ", ".join(f"arg_max(temperature_2m, {{'p': polled_at, 'r': reading_id}}) FILTER (WHERE station = '{s}') AS s{s}" for s in _RAW) + " FROM v3 GROUP BY t")
def a22b(spark, d):
    """The raw arrivals hold several readings of a station and hour: the last to arrive counts."""
    rows = feeds.compare_series(views.raw(spark, d), "temperature_2m", _RAW, ("polled_at", "reading_id"))
    return rows.withColumnsRenamed({s: f"s{s}" for s in _RAW})


@query("a23_latest_per_city", "SELECT station, max(t) AS t, arg_max(temperature_2m, t) AS temperature_2m FROM v1 GROUP BY station")
def a23(spark, d):
    return feeds.latest_per_station(views.hourly(spark, d), ["temperature_2m"])


@query("a24_freshness_status", f"SELECT max(polled_at) AS last_polled, CASE WHEN count(*) = 0 THEN 'awaiting' WHEN {AS_OF}000000 - max(polled_at) > 900000000 THEN 'stale' ELSE 'online' END AS status FROM v3")
def a24(spark, d):
    return feeds.freshness(views.raw(spark, d), "polled_at", AS_OF * 1000000, 900000000)


@query("a27_wilson_interval", "SELECT detector, round(greatest(0.0, (p + 1.96*1.96/(2*n)) / (1 + 1.96*1.96/n) - 1.96 * sqrt(p*(1-p)/n + 1.96*1.96/(4*n*n)) / (1 + 1.96*1.96/n)), 6) AS low, round(least(1.0, (p + 1.96*1.96/(2*n)) / (1 + 1.96*1.96/n) + 1.96 * sqrt(p*(1-p)/n + 1.96*1.96/(4*n*n)) / (1 + 1.96*1.96/n)), 6) AS high FROM (SELECT detector, count(*)::DOUBLE AS n, (count(*) FILTER (WHERE severity <> 'info'))::DOUBLE / count(*) AS p FROM rinc GROUP BY detector)")
def a27(spark, d):
    c = incidents(spark, d, "score").groupBy("detector").agg(F.count("*").cast("double").alias("n"), F.count_if(F.col("severity") != "info").cast("double").alias("h"))
    low, high = E.wilson(F.col("h"), F.col("n"))
    return c.select("detector", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


_RECALL = """SELECT l.label_id, coalesce(bool_or(m.x), false) AS expected_hit, coalesce(bool_or(m.x AND m.severity = 'severe'), false) AS severe_hit, count(m.onset_t) > 0 AS any_hit, max(CASE WHEN m.x THEN m.priority_score END) AS best_score
 FROM (SELECT DISTINCT label_id FROM v6) l LEFT JOIN (SELECT DISTINCT y.label_id, r.*, EXISTS (SELECT 1 FROM v6 z WHERE z.label_id = y.label_id AND z.expected_type = r.detector) AS x FROM rinc r JOIN v6 y ON y.station = r.station AND r.onset_t BETWEEN y.from_t AND y.until_t) m ON m.label_id = l.label_id GROUP BY l.label_id"""


@query("a28_weak_label_recall", _RECALL)
def a28(spark, d):
    return E.recall(incidents(spark, d, "score"), views.labels(spark))


_EXT = f"""SELECT y.label_id, round(max(wind_gusts_10m), 3) AS max_gust, round(max(wind_gusts_10m_z), 3) AS max_gust_z, round(max(precipitation), 3) AS max_hourly_mm, round(max(accumulation_6h), 3) AS max_6h_mm, round(max(-pressure_delta), 3) AS max_3h_fall,
 round(max(abs(temperature_2m_delta)), 3) AS max_3h_dtemp, round(min(temperature_2m_z), 3) AS min_temp_z, round(max(temperature_2m_z), 3) AS max_temp_z, round(max(abs(temperature_2m_z)), 3) AS max_abs_temp_z, round(max({HUMIDEX}), 3) AS max_humidex, round(min({CHILL}), 3) AS min_wind_chill
 FROM feat f JOIN (SELECT DISTINCT label_id, station, from_t, until_t FROM v6) y ON y.station = f.station AND f.t BETWEEN y.from_t AND y.until_t GROUP BY y.label_id"""


@query("a29_window_extremes", _EXT)
def a29(spark, d):
    return E.window_extremes(enriched(spark, d), views.labels(spark))


_GATE = "(SELECT {}_z FROM thr1 WHERE metric = '{}')"
_TESTS = {
    "wind_gust_burst": f"max_gust >= 90 OR max_gust_z >= abs({_GATE.format('upper', 'wind_gusts_10m')})", "heavy_rain_burst": "max_hourly_mm >= 10 OR max_6h_mm >= 12.5", "pressure_plunge": "max_3h_fall >= 6",
    "temperature_shock": f"max_3h_dtemp >= 5 AND max_abs_temp_z >= abs({_GATE.format('upper', 'temperature_2m')})", "cold_spell": f"min_temp_z <= -abs({_GATE.format('lower', 'temperature_2m')})",
    "warm_spell": f"max_temp_z >= abs({_GATE.format('upper', 'temperature_2m')})", "cold_stress": "min_wind_chill <= -25", "heat_stress": "max_humidex >= 38",
}


_MISSES = "SELECT label_id, coalesce(c, '') AS cleared, CASE WHEN c IS NULL THEN 'resolution FN' ELSE 'genuine gap' END AS verdict FROM (SELECT r.label_id, nullif(concat_ws(',', " + ", ".join(f"CASE WHEN ({t}) AND EXISTS (SELECT 1 FROM v6 q WHERE q.label_id = r.label_id AND q.expected_type = '{k}') THEN '{k}' END" for k, t in _TESTS.items()) + f"), '') AS c FROM ({_RECALL}) r LEFT JOIN ({_EXT}) e USING (label_id) WHERE NOT expected_hit)"


@query("a30_miss_decomposition", _MISSES)
def a30(spark, d):
    labels = views.labels(spark)
    gates = enriched(spark, d).select(*[f"gate_{m}_{s}" for m in D.Z_METRICS for s in ("upper", "lower")]).limit(1)
    return E.miss_decomposition(a28(spark, d), a29(spark, d), labels, gates)


@query("a30_conditional_recall", f"SELECT count(*) AS labels, count(*) FILTER (WHERE expected_hit) AS hits, (SELECT count(*) FROM ({_MISSES}) WHERE verdict = 'resolution FN') AS unresolved, round((count(*) FILTER (WHERE expected_hit))::DOUBLE / count(*), 6) AS recall, round((count(*) FILTER (WHERE expected_hit))::DOUBLE / nullif(count(*) - (SELECT count(*) FROM ({_MISSES}) WHERE verdict = 'resolution FN'), 0), 6) AS conditional_recall FROM ({_RECALL})")
def a30c(spark, d):
    return E.conditional_recall(a28(spark, d), a30(spark, d))


@query("a31_chance_recall", "SELECT l.label_id, round(count(DISTINCT CASE WHEN r.onset_t IS NOT NULL THEN k END) / 31.0::DOUBLE, 6) AS chance FROM (SELECT label_id, station, until_t - from_t AS span, unnest(range(19723, 19754)) AS k, expected_type FROM v6) l LEFT JOIN rinc r ON r.station = l.station AND r.detector = l.expected_type AND r.onset_t BETWEEN k*86400 - 86400 AND k*86400 - 86400 + span GROUP BY l.label_id")
def a31(spark, d):
    return E.chance_recall(incidents(spark, d, "score"), views.labels(spark), 19723, 19753)


@query("a32_precision_proxy", "SELECT label, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM (SELECT * FROM rinc ORDER BY priority_score DESC, onset_t, station, detector, metric LIMIT 30) GROUP BY label")
def a32(spark, d):
    top = incidents(spark, d, "score").orderBy(F.desc("priority_score"), "onset_t", "station", "detector", "metric").limit(30)
    return E.shares(E.usefulness(top), "label")


# ---- provider documents: rendered from the readings, then read ------------------------------------------

from tempestry.operators import legacy as G  # noqa: E402
from tempestry.sources import provider  # noqa: E402

_SENT = ("temperature_2m", "precipitation", "wind_gusts_10m", "pressure_msl")


def _iso(t):
    return F.date_format(F.timestamp_seconds(t), "yyyy-MM-dd'T'HH:mm")


@query("s1_read_current", "SELECT station, t, temperature_2m, precipitation, weather_code FROM v1")
def s1(spark, d):
    h = views.hourly(spark, d)
    current = F.struct(_iso(F.col("t") - 14400).alias("time"), *_SENT, "weather_code")
    docs = h.select("station", F.to_json(F.struct(F.lit(-14400).alias("utc_offset_seconds"), current.alias("current"))).alias("value"))
    return provider.read_current(docs)[0].select("station", "t", "temperature_2m", "precipitation", "weather_code")


def _series(h: DataFrame, metrics):
    rows = F.array_sort(F.collect_list(F.struct("t", *metrics)))
    return F.struct(F.transform(rows, lambda x: _iso(x.t)).alias("time"), *[rows[m].alias(m) for m in metrics])


@query("s2_read_archive", "SELECT station, t, temperature_2m, wind_gusts_10m, weather_code FROM v1")
def s2(spark, d):
    h = views.hourly(spark, d).withColumn("day", F.floor(F.col("t") / 86400))
    docs = h.groupBy("station", "day").agg(_series(h, (*_SENT, "weather_code")).alias("hourly"))
    docs = docs.select("station", F.to_json(F.struct(F.lit(0).alias("utc_offset_seconds"), "hourly")).alias("value"))
    return provider.read_archive(docs)[0].select("station", "t", "temperature_2m", "wind_gusts_10m", "weather_code")


@query("s3_read_forecast", "SELECT station, target_t, CAST(round_even((target_t - (target_t // 86400) * 86400) / 3600.0::DOUBLE, 0) AS INT) AS lead_hours, temperature_2m FROM v5")
def s3(spark, d):
    f = views.forecasts(spark, d).withColumn("issued_t", (F.floor(F.col("target_t") / 86400) * 86400).cast("long")).withColumnRenamed("target_t", "t")
    docs = f.groupBy("station", "issued_t").agg(_series(f, _SENT).alias("hourly"))
    docs = docs.select("station", "issued_t", F.to_json(F.struct(F.lit(0).alias("utc_offset_seconds"), "hourly")).alias("value"))
    return provider.read_forecast(docs).select("station", "target_t", "lead_hours", "temperature_2m")


# ---- legacy rules ------------------------------------------------------------------------------------


def _local(spark, d):
    return C.with_local(views.hourly(spark, d), views.stations(spark))


_BASE = """SELECT station, t, {v} AS v, day_n, hist_n, CASE WHEN n1 >= 7 THEN m1 ELSE m2 END AS mean, CASE WHEN n1 >= 7 THEN s1 ELSE s2 END AS std, CASE WHEN n1 >= 7 THEN n1 ELSE n2 END AS n FROM (
 SELECT a.*, (SELECT avg(b.{v}) FROM x b WHERE b.station = a.station AND b.t >= a.t - 1209600 AND b.t < a.t AND (b.hour - a.hour + 25) % 24 <= 2) AS m1, (SELECT stddev_pop(b.{v}) FROM x b WHERE b.station = a.station AND b.t >= a.t - 1209600 AND b.t < a.t AND (b.hour - a.hour + 25) % 24 <= 2) AS s1,
  (SELECT count(b.{v}) FROM x b WHERE b.station = a.station AND b.t >= a.t - 1209600 AND b.t < a.t AND (b.hour - a.hour + 25) % 24 <= 2) AS n1, avg({v}) OVER w AS m2, stddev_pop({v}) OVER w AS s2, count({v}) OVER w AS n2,
  count(*) OVER (PARTITION BY station ORDER BY t RANGE BETWEEN 86400 PRECEDING AND 1 PRECEDING) AS day_n, count({v}) OVER (PARTITION BY station ORDER BY t RANGE BETWEEN 1209600 PRECEDING AND 1 PRECEDING) AS hist_n
 FROM x a WINDOW w AS (PARTITION BY station ORDER BY t RANGE BETWEEN {r} PRECEDING AND 1 PRECEDING))"""


def _base(v: str, rolling: int, source: str = "loc1") -> str:
    return f"(WITH x AS (SELECT * FROM {source}) {_BASE.format(v=v, r=rolling)})"


@query("w4_same_local_hour_baseline", f"SELECT station, t, round(mean + 1e-9, 6) AS mean, round(std + 1e-9, 6) AS std, n FROM {_base('temperature_2m', 86400)}")
def w4(spark, d):
    return G.same_hour_baseline(_local(spark, d), "temperature_2m").select("station", "t", C.places(F.col("mean"), 6).alias("mean"), C.places(F.col("std"), 6).alias("std"), "n")


LEGACY = ["station", "t", "metric", "strength", "severity"]


def _rapid(m: str) -> str:
    return f"SELECT station, t, '{m}' AS metric, round(abs(v - mean) / std + 1e-9, 3) AS strength, CASE WHEN abs(v - mean) / std >= 3.5 THEN 'severe' ELSE 'warning' END AS severity FROM {_base(m, 86400)} WHERE day_n >= 12 AND hist_n >= 12 AND std > 0 AND abs(v - mean) / std >= 2.5"


def _sustained(m: str) -> str:
    return f"""SELECT station, t, '{m}' AS metric, 2.0::DOUBLE AS strength, 'warning' AS severity FROM (SELECT *, quantile_cont({m}, 0.05) OVER r AS lo, quantile_cont({m}, 0.95) OVER r AS hi, count(*) OVER r AS n, lag({m}) OVER w AS a, lag({m}, 2) OVER w AS b
 FROM v1 WINDOW w AS (PARTITION BY station ORDER BY t), r AS (PARTITION BY station ORDER BY t RANGE BETWEEN 172800 PRECEDING AND 1 PRECEDING)) WHERE n >= 12 AND lo <> hi AND b IS NOT NULL AND (least({m}, a, b) >= hi OR greatest({m}, a, b) <= lo)"""


@query("d11_rapid_change", " UNION ALL ".join(map(_rapid, G.CHANGE_METRICS)))
def d11(spark, d):
    return G.over_metrics(G.rapid_change, _local(spark, d), p=P).select(*LEGACY)


@query("d12_sustained_extreme", " UNION ALL ".join(map(_sustained, G.CHANGE_METRICS)))
def d12(spark, d):
    return G.over_metrics(G.sustained_extreme, views.hourly(spark, d), p=P).select(*LEGACY)


def _one_metric(metric):
    """d11 and d12 over one metric alone."""

    @query(f"d11_rapid_change_{metric}", _rapid(metric))
    def d11_further(spark, d):
        return G.rapid_change(_local(spark, d), metric, P).select(*LEGACY)

    @query(f"d12_sustained_extreme_{metric}", _sustained(metric))
    def d12_further(spark, d):
        return G.sustained_extreme(views.hourly(spark, d), metric, P).select(*LEGACY)


for _metric in G.CHANGE_METRICS[1:]:
    _one_metric(_metric)


_LEVEL = "CASE {} WHEN 95 THEN 3 WHEN 63 THEN 2 WHEN 51 THEN 1 WHEN 0 THEN 0 END"


_TRANSITION = f"SELECT station, t, 'weather_code' AS metric, CAST(abs(now - before) AS DOUBLE) AS strength, CASE WHEN now = 3 THEN 'severe' ELSE 'warning' END AS severity FROM (SELECT station, t, {_LEVEL.format('weather_code')} AS now, lag({_LEVEL.format('weather_code')}) OVER (PARTITION BY station ORDER BY t) AS before FROM v1) WHERE abs(now - before) >= 2"


@query("d13_wmo_transition", _TRANSITION)
def d13(spark, d):
    return G.wmo_transition(views.hourly(spark, d)).select("station", "t", "metric", F.col("strength").cast("double").alias("strength"), "severity")


_COMFORT = f"SELECT station, t, 'apparent_temperature' AS metric, round(v + 1e-9, 3) AS strength, CASE WHEN v >= 1.5 * (mean + 2 * std) AND v >= 8 THEN 'severe' ELSE 'warning' END AS severity FROM {_base('gap', 172800, '(SELECT *, abs(apparent_temperature - temperature_2m) AS gap FROM loc1)')} WHERE n >= 7 AND v > mean + 2 * std"


@query("d14_comfort_divergence", _COMFORT)
def d14(spark, d):
    return G.comfort_divergence(_local(spark, d), P).select(*LEGACY)


_PEER = "(SELECT r.station, r.t, r.temperature_2m AS own, p.station AS peer, f.temperature_2m AS theirs FROM (SELECT v1.*, peer_group FROM v1 JOIN v4 USING (station)) r JOIN v4 p ON p.peer_group = r.peer_group AND p.station <> r.station ASOF JOIN v1 f ON f.station = p.station AND f.t <= r.t)"


def _contrast(m: str) -> str:
    peer = _PEER.replace("r.temperature_2m AS own", f"r.{m} AS own").replace("f.temperature_2m AS theirs", f"f.{m} AS theirs")
    return f"SELECT station, t, peer, '{m}' AS metric, round(g + 1e-9, 3) AS strength, 'warning' AS severity FROM (SELECT q.station, q.t, q.peer, abs(own - theirs) AS g, count(*) AS n, quantile_cont(abs(b.{m} - theirs), 0.95) AS lim FROM {peer} q JOIN v1 b ON b.station = q.station AND b.t >= q.t - 172800 AND b.t < q.t GROUP BY ALL) WHERE n >= 12 AND g > lim AND g >= {G.CONTRAST_GAPS[m]}"


@query("d15_cross_city_contrast", " UNION ALL ".join(map(_contrast, G.CONTRAST_GAPS)))
def d15(spark, d):
    h = views.hourly(spark, d)
    peers = X.latest_peers(h, views.stations(spark), list(G.CONTRAST_GAPS))
    found = G.over_metrics(G.cross_city_contrast, h, G.CONTRAST_GAPS, peers=peers, p=P)
    return found.select("station", "t", F.substring_index("dedupe_key", "|", -1).alias("peer"), "metric", "strength", "severity")


_DIVERGENCE = f"""SELECT station, t, 'weather_code' AS metric, CAST(abs(a - f) AS DOUBLE) AS strength, CASE WHEN a > f THEN 'severe' ELSE 'warning' END AS severity FROM (SELECT v1.station, v1.t, {_LEVEL.format('v1.weather_code')} AS a, {_LEVEL.format('v5.weather_code')} AS f FROM v1 JOIN v5 ON v5.station = v1.station AND v5.target_t = v1.t WHERE lead_hours BETWEEN 3 AND 12) WHERE abs(a - f) >= 2
 UNION ALL SELECT station, t, 'temperature_2m', round(abs(temperature_2m - fcst_temperature_2m) + 1e-9, 3), CASE WHEN abs(temperature_2m - fcst_temperature_2m) >= 9 THEN 'severe' ELSE 'warning' END FROM pairs WHERE abs(temperature_2m - fcst_temperature_2m) >= 6"""


@query("d16_forecast_divergence", _DIVERGENCE)
def d16(spark, d):
    m = X.matching_forecast(views.hourly(spark, d), views.forecasts(spark, d), P)
    return G.forecast_divergence(m).select("station", "t", "metric", F.col("strength").cast("double").alias("strength"), "severity")


_FREEZING = f"SELECT DISTINCT q.station, q.t FROM {_PEER} q JOIN (SELECT station, t, lag(temperature_2m) OVER (PARTITION BY station ORDER BY t) AS before FROM v1) b ON b.station = q.station AND b.t = q.t WHERE (before < 0 AND own >= 0 AND theirs < 0) OR (before >= 0 AND own < 0 AND theirs >= 0)"


@query("d17_freezing_line", _FREEZING)
def d17(spark, d):
    h = views.hourly(spark, d)
    return G.freezing_line(h, X.latest_peers(h, views.stations(spark), ["temperature_2m"])).select("station", "t")


_RECORD = """SELECT station, t, dedupe_key FROM (SELECT *, CASE WHEN v > list_max(past) AND NOT coalesce(past[-1] > list_max(past[:-2]), false) THEN station || '|fun_fact|temperature_2m|warm_record' WHEN v < list_min(past) AND NOT coalesce(past[-1] < list_min(past[:-2]), false) THEN station || '|fun_fact|temperature_2m|cold_record' END AS dedupe_key
 FROM (SELECT station, t, temperature_2m AS v, list(temperature_2m) OVER (PARTITION BY station ORDER BY t RANGE BETWEEN 1209600 PRECEDING AND 1 PRECEDING) AS past FROM v1) WHERE len(past) >= 12) WHERE dedupe_key IS NOT NULL"""


@query("d19_record", _RECORD)
def d19(spark, d):
    return G.record(views.hourly(spark, d), p=P).select("station", "t", "dedupe_key")


_VARIANTS = (("month_hour", "_m"), ("smooth_clipped", "_c"), ("current", ""))


@query("l8_replay_profiles", " UNION ALL ".join(f"SELECT '{name}' AS profile, c.detector, count(*) AS raw, count(*) FILTER (WHERE severity = 'severe') AS severe, CAST(sum(CAST(round(score * 1000) AS BIGINT)) AS BIGINT) AS total_milli, (SELECT count(*) FROM rinc{v} r WHERE r.detector = c.detector) AS incidents FROM cand{v} c GROUP BY c.detector" for name, v in _VARIANTS))
def l8(spark, d):
    """The replay of all ten detectors under the three presets: one pass of history and forecasts for all of them, a
    lookup each in its own ladder, and one lifecycle, keyed by preset."""
    h, stations = views.hourly(spark, d), views.stations(spark)
    past = cut(D.with_past(h, stations, P))
    said = cut(with_forecast(spark, d, past.select("station", "t", *FORECAST_METRICS)))
    found = []
    for name, p in PRESETS.items():
        df = cut(D.with_baseline(past, _clim_of(spark, d, p), p))
        found.append(D.detect(joined(with_peers(spark, df), said), p).withColumn("dedupe_key", F.concat(F.lit(f"{name}|"), "dedupe_key")))
    found = cut(reduce(DataFrame.unionByName, found)).withColumn("profile", F.substring_index("dedupe_key", "|", 1))
    raw = found.groupBy("profile", "detector").agg(F.count("*").alias("raw"), F.count_if(F.col("severity") == "severe").alias("severe"), F.sum(F.round(F.col("score") * 1000).cast("long")).alias("total_milli"))
    ended = incidents(spark, d, "score", found).groupBy(F.substring_index("dedupe_key", "|", 1).alias("profile"), "detector").agg(F.count("*").alias("incidents"))
    return raw.join(ended.hint("merge"), ["profile", "detector"], "left").withColumn("incidents", F.coalesce("incidents", F.lit(0)))


_PACK = "SELECT q.station, q.t, q.peer, round(abs(own - theirs) + 1e-9, 3) AS gap FROM (SELECT r.station, r.t, r.apparent_temperature AS own, p.station AS peer, f.apparent_temperature AS theirs FROM (SELECT v1.*, peer_group FROM v1 JOIN v4 USING (station)) r JOIN v4 p ON p.peer_group = r.peer_group AND p.station <> r.station ASOF JOIN v1 f ON f.station = p.station AND f.t <= r.t) q JOIN (SELECT station, t, lag(apparent_temperature) OVER (PARTITION BY station ORDER BY t) AS before FROM v1) b ON b.station = q.station AND b.t = q.t WHERE abs(own - theirs) >= 8 AND abs(before - theirs) < 8"


@query("d18_pack_differently", _PACK)
def d18(spark, d):
    h = views.hourly(spark, d)
    out = G.pack_differently(h, X.latest_peers(h, views.stations(spark), ["apparent_temperature"]))
    return out.select("station", "t", F.substring_index("dedupe_key", "|", -1).alias("peer"), F.col("strength").alias("gap"))


# ---- scalar functions one by one ----------------------------------------------------------------------


@query("x3_bucket_confidence", "SELECT station, t, temperature_2m_bucket AS bucket, temperature_2m_conf AS confidence FROM feat")
def x3(spark, d):
    return enriched(spark, d).select("station", "t", F.col("temperature_2m_bucket").alias("bucket"), F.col("temperature_2m_conf").alias("confidence"))


@query("x4_tail_probability", f"SELECT station, t, round(exp(-9.210340371976182::DOUBLE * {_rarity('wind_gusts_10m', 'upper', 'wind_gusts_10m_z')}), 4) AS p FROM feat WHERE wind_gusts_10m_z IS NOT NULL")
def x4(spark, d):
    df = enriched(spark, d).filter("wind_gusts_10m_z IS NOT NULL")
    p = S.tail_probability(F.col("wind_gusts_10m_upper"), F.col("wind_gusts_10m_z"))
    return df.select("station", "t", F.round(F.greatest(p, F.lit(1e-4)), 4).alias("p"))


@query("x7_precip_features", "SELECT station, t, coalesce(precipitation, 0.0) AS amount, coalesce(precipitation, 0.0) >= 0.1 AS wet FROM v1")
def x7(spark, d):
    amount = F.coalesce("precipitation", F.lit(0.0))
    return views.hourly(spark, d).select("station", "t", amount.alias("amount"), (amount >= P.wet_mm).alias("wet"))


@query("x11_wmo_describe", "SELECT station, t, CASE WHEN weather_code = 95 THEN 'Thunderstorm' WHEN weather_code IN (63, 51) THEN 'Rain' ELSE 'Clear' END AS label, CASE WHEN weather_code = 95 THEN 'storm' WHEN weather_code IN (63, 51) THEN 'precip' ELSE 'clear' END AS category FROM v1")
def x11(spark, d):
    return views.hourly(spark, d).withColumn("x", S.weather_description(F.col("weather_code"))).select("station", "t", "x.label", "x.category")


@query("x14_priority_score", "SELECT station, t, detector, metric, score, CASE WHEN score < 30 THEN 'info' WHEN score < 60 THEN 'warning' ELSE 'severe' END AS severity FROM cand")
def x14(spark, d):
    return candidates(spark, d).select("station", "t", "detector", "metric", "score", S.severity(F.col("score")).alias("severity"))


@query("x17_dedupe_key", "SELECT DISTINCT station || '|' || detector || '|' || metric AS dedupe_key FROM cand")
def x17(spark, d):
    return candidates(spark, d).select("dedupe_key").distinct()


@query("x18_candidate_strength", "SELECT station, t, detector, metric, strength FROM cand WHERE detector NOT IN ('heat_stress', 'cold_stress')")
def x18(spark, d):
    c = candidates(spark, d).filter(~F.col("detector").isin("heat_stress", "cold_stress"))
    return c.select("station", "t", "detector", "metric", S.strength(F.col("signals"), F.col("severity")).alias("strength"))


@query("x19_merge_ids", "SELECT station, detector, metric, onset_t, hits, ts FROM inc WHERE detector IN ('warm_spell', 'cold_spell', 'wind_gust_burst')")
def x19(spark, d):
    """The merged ids in their order, shown by the times of their readings."""
    i = incidents(spark, d).filter(F.col("detector").isin("warm_spell", "cold_spell", "wind_gust_burst"))
    key = ["station", "detector", "metric", "onset_t"]
    ids = i.select(*key, F.posexplode("supporting_ids").alias("k", "id")).join(views.hourly(spark, d).select("id", F.col("t").cast("string").alias("at")).hint("merge"), "id")
    merged = ids.groupBy(*key).agg(F.count("*").alias("hits"), F.sort_array(F.collect_list(F.struct("k", "at"))).alias("l"))
    return merged.select(*key, "hits", F.array_join(F.transform("l", lambda x: x.at), ",").alias("ts"))


@query("x20_explain", "SELECT station, t, detector, metric, reason AS headline, evidence FROM cand")
def x20(spark, d):
    return candidates(spark, d).withColumn("x", S.explanation(F.col("reason"), F.col("signals"))).select("station", "t", "detector", "metric", "x.headline", "x.evidence")


X15_SQL = "SELECT station, t, detector, severity, CASE severity WHEN 'info' THEN 20.0 WHEN 'warning' THEN 45.0 ELSE 70.0 END AS score FROM old"


@query("x15_legacy_score")
def x15(spark, d):
    return legacy_rules(spark, d).select("station", "t", "detector", "severity", "score")


@query("x23_gate_threshold", "SELECT metric, coalesce(upper_z, 3.0) AS upper, coalesce(lower_z, -3.0) AS lower, CASE WHEN upper_z IS NULL THEN 'fixed' ELSE 'quantile' END AS source FROM thr1 WHERE metric <> 'precipitation'")
def x23(spark, d):
    vals = train1(spark, d)
    thr = C.pooled(C.residuals(vals, C.stats(vals, P)["smooth"], ["doy", "hour"]), [m for m in P.climatology_metrics if m != "precipitation"])[0]
    return thr.select("metric", F.coalesce("upper_z", F.lit(3.0)).alias("upper"), F.coalesce("lower_z", F.lit(-3.0)).alias("lower"), F.when(F.col("upper_z").isNull(), "fixed").otherwise("quantile").alias("source"))


@query("x24_confidence_input", "SELECT station, t, least(greatest(temperature_2m_conf, 0), 1, greatest(wind_gusts_10m_conf, 0)) AS confidence FROM feat")
def x24(spark, d):
    c = F.least(S.clamp01(F.col("temperature_2m_conf")), S.clamp01(F.col("wind_gusts_10m_conf")))
    return enriched(spark, d).select("station", "t", c.alias("confidence"))


# ---- comparisons of runs -----------------------------------------------------------------------------


_DAYS = "(SELECT sum(round_even(n / 24.0::DOUBLE, 0)) FROM (SELECT count(*) AS n FROM v1 GROUP BY station))"


@query("a14_before_after", f"SELECT k AS detector, before, after, round(before / {_DAYS}, 4) AS before_per_day, round(after / {_DAYS}, 4) AS after_per_day FROM (SELECT k, (SELECT count(*) FROM rinc_m WHERE detector = k) AS before, (SELECT count(*) FROM rinc WHERE detector = k) AS after FROM (VALUES " + _KINDS + ") AS x(k))")
def a14(spark, d):
    """Incidents of two replays side by side: on the month and hour baseline, and on the current one."""
    kinds = spark.createDataFrame([(k,) for k in DETECTORS], "detector string")
    for name, preset in (("before", "month_hour"), ("after", "current")):
        found = incidents(spark, d, "score", candidates(spark, d, PRESETS[preset])).groupBy("detector").agg(F.count("*").alias(name))
        kinds = kinds.join(found.hint("merge"), "detector", "left")
    days = E.station_days(views.hourly(spark, d)).select("days")
    rows = kinds.na.fill(0).join(F.broadcast(days), how="cross")  # one row
    return rows.select("detector", "before", "after", *[F.round(F.col(c) / F.col("days"), 4).alias(f"{c}_per_day") for c in ("before", "after")])


def legacy_rules(spark, d):
    """All seven rules over the hourly readings."""
    rows, h = _local(spark, d), views.hourly(spark, d)
    peers = cut(X.latest_peers(h, views.stations(spark), list(G.CONTRAST_GAPS)))
    return G.replay(rows, peers, X.matching_forecast(h, views.forecasts(spark, d), P), P)


def _named(kind: str, sql: str) -> str:
    return f"SELECT '{kind}' AS detector, station, t, severity FROM ({sql})"


STEP["old"] = " UNION ALL ".join([
    *[_named("rapid_change", _rapid(m)) for m in G.CHANGE_METRICS], *[_named("sustained_extreme", _sustained(m)) for m in G.CHANGE_METRICS], *[_named("cross_city_contrast", _contrast(m)) for m in G.CONTRAST_GAPS],
    _named("wmo_transition", _TRANSITION), _named("comfort_divergence", _COMFORT), _named("forecast_divergence", _DIVERGENCE),
    *[_named("fun_fact", f"SELECT *, 'info' AS severity FROM ({x})") for x in (_FREEZING, _PACK, _RECORD)],
])
_MAP = ", ".join([*[f"('{o}', {repr(' + '.join(ns)) if ns else 'NULL'}, {list(ns)})" for o, ns in G.REPLACED_BY.items()], *[f"(NULL, '{n}', ['{n}'])" for n in G.NEW]])


@query("a15_legacy_vs_native", f"SELECT old_type, replacement, (SELECT count(*) FROM old WHERE detector = old_type) AS old_raw, (SELECT count(*) FROM rinc WHERE list_contains(ns, detector)) AS new_incidents FROM (VALUES {_MAP}) AS m(old_type, replacement, ns)")
def a15(spark, d):
    """Raw events of every legacy rule against the incidents of what replaced it."""
    return G.against_native(legacy_rules(spark, d), incidents(spark, d, "score"))


# x15 is registered before the rules it reads have their texts
ORACLES["x15_legacy_score"] = with_(X15_SQL)


_QUALITY = """SELECT label_id AS scenario, CAST(len(list_intersect(e, g)) AS INT) AS tp, CAST(len(g) - len(list_intersect(e, g)) AS INT) AS fp, CAST(len(e) - len(list_intersect(e, g)) AS INT) AS fn
 FROM (SELECT label_id, list(expected_type) AS e, any_value(station) AS station, any_value(from_t) AS a, any_value(until_t) AS z FROM v6 GROUP BY label_id) l
 JOIN (SELECT y.label_id, coalesce(list(DISTINCT r.detector) FILTER (WHERE r.detector IS NOT NULL), []) AS g FROM (SELECT DISTINCT label_id, station, from_t, until_t FROM v6) y LEFT JOIN rinc r ON r.station = y.station AND r.onset_t BETWEEN y.from_t AND y.until_t GROUP BY y.label_id) m USING (label_id)"""


@query("a26_detection_quality", _QUALITY)
def a26(spark, d):
    """Labelled windows as scenarios: the expected detectors against those found."""
    labels = views.labels(spark)
    got = E.label_matches(incidents(spark, d, "score"), labels).groupBy("label_id").agg(F.collect_set("detector").alias("got"))
    rows = labels.join(got.hint("merge"), "label_id", "left").select(F.col("label_id").alias("scenario"), "expected", F.coalesce("got", F.array().cast("array<string>")).alias("got"))
    return E.detection_quality(rows)


@query("a26_detection_totals", f"SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, round(CASE WHEN sum(tp) + sum(fp) > 0 THEN sum(tp)::DOUBLE / (sum(tp) + sum(fp)) ELSE 1.0 END, 6) AS precision, round(CASE WHEN sum(tp) + sum(fn) > 0 THEN sum(tp)::DOUBLE / (sum(tp) + sum(fn)) ELSE 1.0 END, 6) AS recall FROM ({_QUALITY})")
def a26t(spark, d):
    return E.detection_totals(a26(spark, d))
