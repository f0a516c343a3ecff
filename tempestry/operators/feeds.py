"""Feeds: filters, order, top-k, and the dashboard's aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempestry.profile import Profile

MAX_LIMIT = 5000


def bounded(limit: int) -> int:
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must be between 1 and {MAX_LIMIT}")
    return limit


def feed(rows: DataFrame, time: str, station: str | None = None, start: int | None = None, end: int | None = None, limit: int = 50, first: tuple = ()) -> DataFrame:
    """Equality on station, inclusive range on time, newest first (after `first`), at most `limit` rows."""
    if station is not None:
        rows = rows.filter(F.col("station") == station)
    if start is not None:
        rows = rows.filter(F.col(time) >= start)
    if end is not None:
        rows = rows.filter(F.col(time) <= end)
    return rows.orderBy(*first, F.desc(time), "station").limit(bounded(limit))


def events_feed(incidents: DataFrame, limit: int = 50, **filters) -> DataFrame:
    """Highest priority first, nulls last, then newest."""
    return feed(incidents, "onset_t", limit=limit, first=(F.desc_nulls_last("priority_score"),), **filters).orderBy(F.desc_nulls_last("priority_score"), F.desc("onset_t"), "station", "detector", "metric")


def recent_history(readings: DataFrame, station: str, before: int, hours: int, limit: int | None = None) -> DataFrame:
    rows = readings.filter((F.col("station") == station) & (F.col("t") >= before - hours * 3600) & (F.col("t") < before)).orderBy(F.desc("t"))
    return rows if limit is None else rows.limit(limit)


def event_filter(incidents: DataFrame, as_of: int, kinds=(), grades=(), days: float = 7) -> DataFrame:
    """Empty selections mean all; the window of 1 to 60 days ends at `as_of`."""
    days = min(60, max(1, round(days)))
    rows = incidents.filter(F.col("onset_t").between(as_of - days * 86400, as_of))
    rows = rows.filter(F.col("detector").isin(list(kinds))) if kinds else rows
    return rows.filter(F.col("severity").isin(list(grades))) if grades else rows


def suppressed(candidates: DataFrame, kinds) -> DataFrame:
    return candidates.filter(~F.col("detector").isin(list(kinds)))


def dedupe_first(rows: DataFrame, keys: list[str], order: list, known: DataFrame | None = None) -> DataFrame:
    """First arrival per key wins; keys already stored stay as they are."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = rows.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")
    return out if known is None else out.join(known.select(*keys), keys, "left_anti")


def forecasts_of_new(arrivals: DataFrame, keys: list[str], order: list, p: Profile = Profile(), known: DataFrame | None = None, stored: DataFrame | None = None) -> DataFrame:
    """Forecasts to keep of arrivals (reading and forecast in one row): only if the reading was new, with an admissible
    lead, and the first for its station and target_t; `known` readings and `stored` forecasts were there before."""
    new = dedupe_first(arrivals, keys, order, known)
    return dedupe_first(new.filter(F.col("lead_hours").between(p.lead_min, p.lead_max)), ["station", "target_t"], order, stored)


def latest_per_station(readings: DataFrame, columns: list[str]) -> DataFrame:
    return readings.groupBy("station").agg(F.max_by(F.struct("t", *columns), "t").alias("r")).select("station", "r.*")


def freshness(rows: DataFrame, polled: str, as_of: int, stale_s: int = 900) -> DataFrame:
    last = F.max(polled)
    status = F.when(last.isNull(), "awaiting").when(F.lit(as_of) - last > stale_s, "stale").otherwise("online")
    return rows.agg(last.alias("last_polled"), status.alias("status"))


def compare_series(readings: DataFrame, metric: str, stations: list[str], arrival: tuple = ("id",)) -> DataFrame:
    """Time by station; of duplicates the last to arrive, `arrival` being the columns that order arrivals."""
    return readings.groupBy("t").pivot("station", stations).agg(F.max_by(metric, F.struct(*arrival)))


def chart_series(readings: DataFrame, forecasts: DataFrame, metric: str) -> DataFrame:
    """Full outer of the averages of readings and forecasts per time."""
    a = readings.groupBy("t").agg(F.avg(metric).alias("observed"))
    b = forecasts.groupBy(F.col("target_t").alias("t")).agg(F.avg(metric).alias("forecast"))
    return a.join(b, "t", "full")


def event_distribution(incidents: DataFrame, stations: list[str], kinds) -> DataFrame:
    """Counts of station by type, zero-filled, with the largest for scaling."""
    spark = incidents.sparkSession
    dims = spark.createDataFrame([(s, k) for s in stations for k in kinds], "station string, detector string")
    counts = incidents.groupBy("station", "detector").agg(F.count("*").alias("n"))
    out = dims.join(counts.hint("merge"), ["station", "detector"], "left").select("station", "detector", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    return out.withColumn("largest", F.max("n").over(Window.partitionBy()))  # one row per pair of dimension values


def date_chunks(spark, start: int, end: int, days: int) -> DataFrame:
    """Inclusive day chunks of a backfill, as epoch days."""
    starts = spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end), F.lit(days))).alias("first_day"))
    return starts.select("first_day", F.least(F.col("first_day") + days - 1, F.lit(end)).alias("last_day"))
