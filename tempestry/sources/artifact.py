"""The climatology artifact on disk: six tables under one version, and detection's inputs read back from any version.

`levels` and `wet` hold the statistics of the whole fallback ladder, a partition a level, so that a lookup reads its own
level alone; `thresholds` and `tails` hold the gates and anchors of both baselines; `diagnostics` the jumps at calendar
boundaries; `settings` what the version was fitted with.  A version is seen once its commit file is there.
"""

from __future__ import annotations

import uuid
from dataclasses import asdict
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempestry.operators import climatology as C
from tempestry.operators.evaluation import boundary_jumps
from tempestry.profile import WET_PERCENTILES, Profile
from tempestry.sources import tables

BASELINES = ("smooth", "month_hour")
_SEASON = "station string, doy int, month int, hour int, "
SCHEMAS = {
    "levels": _SEASON + "metric string, n long, median double, mad double, scale double, level string",
    "wet": _SEASON + "total_count long, wet_count long, " + ", ".join(f"p{m} double" for m in WET_PERCENTILES) + ", level string",
    "thresholds": "baseline string, metric string, n long, upper_z double, lower_z double, abs_z double",
    "tails": "baseline string, metric string, kind string, k int, v double, p double",
    "diagnostics": "station string, boundary string, metric string, fixed_value double, jump_smooth double, jump_month double",
    "settings": "name string, value string",
}


def _as(df: DataFrame, schema: str) -> DataFrame:
    """df with the schema's columns in their order, null where it has none."""
    types = dict(part.split() for part in schema.split(", "))
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in types.items()])


def _ladder(levels: dict[str, DataFrame], schema: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [_as(df.withColumn("level", F.lit(name)), schema) for name, df in levels.items()])


def fit(vals: DataFrame, totals: DataFrame, path: str, p: Profile = Profile(), boundary_hour: int = 12) -> int:
    """Fit training values (`climatology.values`) and six-hour totals below `path`; the number of the new version.

    Residuals are taken from the statistics as stored, so they aren't computed again.  Empty training rows give empty
    tables.
    """
    spark, at = vals.sparkSession, f"{path}/data/{uuid.uuid4().hex}"
    _ladder(C.stats(vals, p), SCHEMAS["levels"]).write.partitionBy("level").parquet(f"{at}/levels")
    _ladder(C.wet_levels(vals, p), SCHEMAS["wet"]).write.partitionBy("level").parquet(f"{at}/wet")
    levels = _levels(spark, f"{at}/levels", "levels")
    rain = vals.filter((F.col("metric") == "precipitation") & (F.col("v") >= p.wet_mm)).select(F.lit("rain").alias("metric"), "v")
    rain = rain.unionByName(totals.select(F.lit("rain_6h").alias("metric"), "v"))
    pooled = {b: C.pooled(C.residuals(vals, levels[b], C.LEVELS[b]).unionByName(rain), [*p.climatology_metrics, "rain", "rain_6h"]) for b in BASELINES}
    for k, name in enumerate(("thresholds", "tails")):
        rows = [_as(pooled[b][k].withColumn("baseline", F.lit(b)), SCHEMAS[name]) for b in BASELINES]
        reduce(DataFrame.unionByName, rows).coalesce(1).write.parquet(f"{at}/{name}")  # a few rows a metric
    _as(boundary_jumps(levels["smooth"], levels["month_hour"], boundary_hour, p.climatology_metrics), SCHEMAS["diagnostics"]).write.parquet(f"{at}/diagnostics")
    spark.createDataFrame([(k, str(v)) for k, v in asdict(p).items()], SCHEMAS["settings"]).coalesce(1).write.parquet(f"{at}/settings")
    version = tables.last_version(spark, path) + 1
    tables.publish(spark, path, version, {"at": at})
    return version


def _levels(spark: SparkSession, at: str, name: str) -> dict[str, DataFrame]:
    """The tables of all levels, each with its own keys."""
    rows = spark.read.schema(SCHEMAS[name]).parquet(at)
    told = [c.split()[0] for c in SCHEMAS[name].split(", ")][4:-1]
    return {level: rows.filter(F.col("level") == level).select("station", *keys, *told) for level, keys in C.LEVELS.items()}


def load(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """All six tables of a version, the newest if none is named; levels and wet as one table a level."""
    at = tables.committed(spark, path, version)["at"]
    out: dict = {name: spark.read.schema(SCHEMAS[name]).parquet(f"{at}/{name}") for name in ("thresholds", "tails", "diagnostics", "settings")}
    return {**out, "levels": _levels(spark, f"{at}/levels", "levels"), "wet": _levels(spark, f"{at}/wet", "wet")}


def of_baseline(artifact: dict, baseline: str) -> tuple[DataFrame, DataFrame]:
    """(thresholds, tails) of one baseline."""
    return tuple(artifact[name].filter(F.col("baseline") == baseline).drop("baseline") for name in ("thresholds", "tails"))
