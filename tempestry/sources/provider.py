"""Landed provider documents to typed rows; malformed ones to a reject table.

Input frames have `station` and `value`, a JSON document; times become epoch seconds UTC in `t`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = (
    "temperature_2m", "apparent_temperature", "precipitation", "wind_speed_10m", "surface_pressure", "pressure_msl",
    "relative_humidity_2m", "dew_point_2m", "wind_gusts_10m", "cloud_cover", "snowfall", "snow_depth", "weather_code",
)
FORECAST_METRICS = tuple(m for m in METRICS if m != "apparent_temperature")


def to_utc(local: Column, offset: Column) -> Column:
    """Epoch seconds of an ISO time that carries its own offset or is local with `offset` seconds."""
    own = local.rlike("(Z|[+-][0-9]{2}:?[0-9]{2})$")
    seconds = F.unix_timestamp(F.try_to_timestamp(F.regexp_replace(local, "Z$", "+00:00")))
    return F.when(own, seconds).otherwise(seconds - F.coalesce(offset, F.lit(0))).cast("long")


def read_current(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(readings, rejects): one row of the `current` block; without block or time a document is rejected."""
    fields = ", ".join(f"{m}: double" for m in METRICS)
    rows = docs.withColumn("j", F.from_json("value", f"utc_offset_seconds int, current struct<time: string, {fields}>"))
    rows = rows.withColumn("t", to_utc(F.col("j.current.time"), F.col("j.utc_offset_seconds")))
    good = rows.filter("t IS NOT NULL").select("station", "t", *[F.col(f"j.current.{m}").alias(m) for m in METRICS]).withColumn("weather_code", F.col("weather_code").cast("int"))
    return good, rows.filter("t IS NULL").select("station", "value")


def _hourly(docs: DataFrame, metrics) -> DataFrame:
    arrays = ", ".join(f"{m}: array<double>" for m in metrics)
    return docs.withColumn("j", F.from_json("value", f"utc_offset_seconds int, hourly struct<time: array<string>, {arrays}>"))


def _exploded(rows: DataFrame, metrics) -> DataFrame:
    time = F.col("j.hourly.time")
    # an absent series is as long as the times, so that zipping keeps the document
    absent = F.transform(time, lambda _: F.lit(None).cast("double"))
    series = {m: F.coalesce(F.col(f"j.hourly.{m}"), absent) for m in metrics}
    out = rows.withColumns({"_time": time, **{f"_{m}": s for m, s in series.items()}})
    out = out.withColumn("x", F.explode(F.arrays_zip(F.col("_time"), *[F.col(f"_{m}") for m in metrics])))
    out = out.withColumn("t", to_utc(F.col("x._time"), F.col("j.utc_offset_seconds")))
    return out.select(*[c for c in out.columns if c not in ("value", "j", "x", "t") and not c.startswith("_")], "t", *[F.col(f"x._{m}").alias(m) for m in metrics])


def _fits(m: str) -> Column:
    series = F.col(f"j.hourly.{m}")
    return series.isNull() | (F.size(series) == F.size("j.hourly.time"))


def read_archive(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(readings, rejects): parallel arrays to rows; absent series are nulls, a length mismatch rejects the document."""
    rows = _hourly(docs, METRICS)
    ok = F.col("j.hourly.time").isNotNull()
    for m in METRICS:
        ok = ok & _fits(m)
    ok = F.coalesce(ok, F.lit(False))
    good = _exploded(rows.filter(ok), METRICS).filter("t IS NOT NULL")
    return good.withColumn("weather_code", F.col("weather_code").cast("int")), rows.filter(~ok).select("station", "value")


def read_forecast(docs: DataFrame) -> DataFrame:
    """Forecast rows from documents with `issued_t`; lenient: mismatched series are nulls, bad times are left out."""
    rows = _hourly(docs, FORECAST_METRICS).filter(F.col("j.hourly.time").isNotNull())
    fitted = F.struct(F.col("j.hourly.time").alias("time"), *[F.when(_fits(m), F.col(f"j.hourly.{m}")).alias(m) for m in FORECAST_METRICS])
    rows = rows.withColumn("j", F.struct(F.col("j.utc_offset_seconds").alias("utc_offset_seconds"), fitted.alias("hourly")))
    out = _exploded(rows, FORECAST_METRICS).filter("t IS NOT NULL").withColumnRenamed("t", "target_t")
    return out.withColumn("lead_hours", F.bround((F.col("target_t") - F.col("issued_t")) / 3600).cast("int"))
