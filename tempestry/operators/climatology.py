"""Robust seasonal baseline: statistics per station and season, thresholds and tails.

All statistics are exact percentiles.  Values are counted per (station, season, metric, value) before the
31-fold spread over neighbouring days, so the spread rows grow with distinct values, not readings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempestry.functions.scalars import local_time
from tempestry.operators import selection
from tempestry.profile import LOWER_PERCENTILES, METRIC_EPSILON, SIGMA, UPPER_PERCENTILES, WET_PERCENTILES, Profile

LEVELS = {"smooth": ["doy", "hour"], "month_hour": ["month", "hour"], "month": ["month"], "city": []}


def places(c, n: int = 4):
    """Rounded to n places; what lies within 1e-9 of half goes up, so that equal inputs agree on any engine."""
    return F.round(c + 1e-9, n)


def with_local(readings: DataFrame, stations: DataFrame) -> DataFrame:
    """Adds doy, month and hour of the station's wall clock; null for unknown stations."""
    # the station dimension goes to the readings by a join that Spark may broadcast if it is small
    joined = readings.join(stations.select("station", "tz"), "station", "left")
    local = local_time(F.col("t"), F.col("tz"))
    return joined.withColumns({"doy": F.dayofyear(local), "month": F.month(local), "hour": F.hour(local)}).drop("tz")


def values(readings: DataFrame, metrics) -> DataFrame:
    """(station, t, doy, month, hour, metric, v) of all non-null values."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in metrics if m in readings.columns])
    rows = readings.select("station", "t", "doy", "month", "hour", F.explode(pairs).alias("x"))
    return rows.select("station", "t", "doy", "month", "hour", "x.metric", "x.v").filter(F.col("v").isNotNull())


def _epsilon(metric: str = "metric"):
    return F.coalesce(*[F.when(F.col(metric) == m, F.lit(e)) for m, e in METRIC_EPSILON.items()], F.lit(1.0))


def _weighted_median(l: str) -> str:
    """SQL of the median of array<struct<v, c>> l, sorted by v, with c the times of v; n is the sum of c."""
    at = "aggregate({0}, struct(0L AS seen, CAST(null AS double) AS v), (a, x) -> struct(a.seen + x.c AS seen, if(a.v IS NULL AND a.seen + x.c > {1}, x.v, a.v) AS v), a -> a.v)"
    return f"({at.format(l, '(n - 1) DIV 2')} + {at.format(l, 'n DIV 2')}) / 2"


def robust_stats(counted: DataFrame, keys: list[str]) -> DataFrame:
    """n, median, mad and scale per keys and metric from rows (keys, metric, v, c) that stand for c values.

    Both medians come from one list of a bucket's counted values, so the rows are shuffled once.
    """
    keys = [*keys, "metric"]
    lists = counted.groupBy(*keys).agg(F.sum("c").alias("n"), F.sort_array(F.collect_list(F.struct("v", "c"))).alias("l"))
    lists = lists.withColumn("m", F.expr(_weighted_median("l")))
    lists = lists.withColumn("away", F.expr("sort_array(transform(l, x -> struct(abs(x.v - m) AS v, x.c AS c)))")).withColumn("d", F.expr(_weighted_median("away")))
    return lists.select(
        *keys, F.col("n").cast("long").alias("n"), places(F.col("m")).alias("median"), places(F.col("d")).alias("mad"),
        places(F.greatest(SIGMA * F.col("d"), _epsilon())).alias("scale"),
    )


def counted(vals: DataFrame, keys: list[str]) -> DataFrame:
    return vals.groupBy("station", *keys, "metric", "v").agg(F.count("*").alias("c"))


def smoothed(vals: DataFrame, p: Profile = Profile()) -> DataFrame:
    """Counted values given to the days around theirs, circular over the year."""
    own = counted(vals, ["doy", "hour"]).filter(F.col("doy").isNotNull())
    near = F.sequence(F.lit(-p.smooth_days), F.lit(p.smooth_days))
    day = F.pmod(F.col("doy") - 1 + F.col("d"), F.lit(p.days)) + 1
    return own.withColumn("d", F.explode(near)).select("station", day.alias("doy"), "hour", "metric", "v", "c")


def stats(vals: DataFrame, p: Profile = Profile()) -> dict[str, DataFrame]:
    """The statistics of every level."""
    return {
        "smooth": robust_stats(smoothed(vals, p), ["station", "doy", "hour"]),
        **{level: robust_stats(counted(vals, LEVELS[level]), ["station", *LEVELS[level]]) for level in ("month_hour", "month", "city")},
    }


def wet_stats(counts: DataFrame, keys: list[str], p: Profile = Profile()) -> DataFrame:
    """total_count, wet_count and percentiles of wet amounts per keys, from rows (keys, metric, v, c) for c values."""
    wet = F.col("v") >= p.wet_mm
    marks = F.array(*[F.lit(m / 100) for m in WET_PERCENTILES])
    out = counts.filter(F.col("metric") == "precipitation").groupBy(*keys).agg(
        F.sum("c").alias("total_count"), F.coalesce(F.sum(F.when(wet, F.col("c"))), F.lit(0)).alias("wet_count"), F.percentile(F.when(wet, F.col("v")), marks, F.when(wet, F.col("c")).otherwise(0)).alias("q")
    )
    return out.select(*keys, "total_count", "wet_count", *[places(F.get("q", k)).alias(f"p{m}") for k, m in enumerate(WET_PERCENTILES)])


def wet_levels(vals: DataFrame, p: Profile = Profile()) -> dict[str, DataFrame]:
    """The wet statistics of every level; amounts are counted before they are spread over neighbouring days."""
    rain = vals.filter(F.col("metric") == "precipitation")
    return {
        "smooth": wet_stats(smoothed(rain, p), ["station", "doy", "hour"], p),
        **{level: wet_stats(counted(rain, LEVELS[level]), ["station", *LEVELS[level]], p) for level in ("month_hour", "month", "city")},
    }


def wet_lookup(readings: DataFrame, levels: dict[str, DataFrame], p: Profile = Profile()) -> DataFrame:
    """Adds wet_count, total_count, wet_p50 to wet_p99 and wet_bucket of the first level with enough wet hours (city: any)."""
    order = _ladder(p)
    parts = ["wet_count", "total_count", *[f"p{m}" for m in WET_PERCENTILES]]
    for level in order:
        table = levels[level]
        if level != "city":
            table = table.filter(F.col("wet_count") >= p.min_bucket_n)
        keys = ["station", *LEVELS[level]]
        table = table.select(*keys, F.struct(*parts, F.lit(level).alias("bucket")).alias(f"_wet_{level}"))
        readings = readings.join(table.hint("merge"), keys, "left")
    best = F.coalesce(*[F.col(f"_wet_{level}") for level in order])
    readings = readings.withColumns({(part if part.endswith("count") else f"wet_{part}"): best[part] for part in (*parts, "bucket")})
    return readings.drop(*[f"_wet_{level}" for level in order])


def rolling_accumulations(readings: DataFrame, p: Profile = Profile()) -> DataFrame:
    """Totals of six consecutive hourly rows that span exactly five hours, at least wet."""
    w = Window.partitionBy("station").orderBy("t")
    total = F.sum(F.coalesce("precipitation", F.lit(0.0))).over(w.rowsBetween(-5, 0))
    rows = readings.withColumn("v", total).withColumn("first", F.lag("t", 5).over(w))
    return rows.filter((F.col("t") - F.col("first") == 5 * 3600) & (F.col("v") >= p.wet_mm)).select("station", "t", "v")


def residuals(vals: DataFrame, level_stats: DataFrame, keys: list[str]) -> DataFrame:
    """(metric, v): distance from the rounded median in rounded scales of the value's own bucket."""
    joined = vals.join(level_stats.hint("merge"), ["station", *keys, "metric"])
    return joined.select("metric", ((F.col("v") - F.col("median")) / F.greatest("scale", _epsilon())).alias("v"))


def pooled(rows: DataFrame, metrics: list[str]) -> tuple[DataFrame, DataFrame]:
    """(thresholds, tails) of rows (metric, v), pooled over stations, found by narrowing (see `selection`).

    thresholds: metric, n, upper_z, lower_z and abs_z.  tails: metric, kind, k, v, p, anchor values of both tails with
    their tail probabilities.
    """
    up, low = [x / 100 for x in UPPER_PERCENTILES], [x / 100 for x in LOWER_PERCENTILES]
    marks = {m: [0.995, 0.005, *up, *low] for m in metrics} | {f"|{m}|": [0.995] for m in metrics}
    both = rows.select(F.explode(F.array(F.struct(F.col("metric").alias("key"), "v"), F.struct(F.concat(F.lit("|"), "metric", F.lit("|")).alias("key"), F.abs("v").alias("v")))).alias("x")).select("x.*")
    n, at = selection.percentiles(both, marks)
    known = [m for m in metrics if m in n]
    spark = rows.sparkSession
    level = spark.createDataFrame([(m, n[m], at[m, 0.995], at[m, 0.005], at[f"|{m}|", 0.995]) for m in known], "metric string, n long, upper_z double, lower_z double, abs_z double")
    tail = [
        (m, kind, k, at[m, x / 100], round((100 - x if kind == "upper" else x) / 100, 6))
        for m in known for kind, xs in (("upper", UPPER_PERCENTILES), ("lower", LOWER_PERCENTILES)) for k, x in enumerate(xs)
    ]
    anchors = spark.createDataFrame(tail, "metric string, kind string, k int, v double, p double")
    return level.select("metric", "n", *[places(F.col(c)).alias(c) for c in ("upper_z", "lower_z", "abs_z")]), anchors.withColumn("v", places(F.col("v")))


def _ladder(p: Profile) -> list[str]:
    """Levels in the order in which they are asked."""
    return [*(["smooth"] if p.smooth_baseline else []), "month_hour", "month", "city"]


def lookup(readings: DataFrame, levels: dict[str, DataFrame], metrics, p: Profile = Profile()) -> DataFrame:
    """Adds, per metric, median, scale, n and bucket of the first level with enough values (city: any)."""
    order = _ladder(p)
    for level in order:
        table = levels[level].filter(F.col("metric").isin(list(metrics)))
        if level != "city":
            table = table.filter(F.col("n") >= p.min_bucket_n)
        keys = ["station", *LEVELS[level]]
        packed = [F.max(F.when(F.col("metric") == m, F.struct("median", "scale", "n", F.lit(level).alias("bucket")))).alias(f"_{level}_{m}") for m in metrics]
        readings = readings.join(table.groupBy(*keys).agg(*packed).hint("merge"), keys, "left")
    best = {m: F.coalesce(*[F.col(f"_{level}_{m}") for level in order]) for m in metrics}
    readings = readings.withColumns({f"{m}_{part}": best[m][part] for m in metrics for part in ("median", "scale", "n", "bucket")})
    return readings.drop(*[f"_{level}_{m}" for level in order for m in metrics])
