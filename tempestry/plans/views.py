"""Station tables derived from the given ones, as DataFrames; times are epoch seconds in a column `t`."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempestry.operators.lineage import shared_dir
from tempestry.sources import tables


def session(spark: SparkSession) -> SparkSession:
    """UTC and adaptive execution, which all plans here assume."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    return spark


def epoch(ts: str):
    return F.unix_timestamp(F.col(ts).cast("timestamp")).cast("long")


#: Stations per event type, by user; more than one makes station-hours grow with the data (the bench does).
PARTS = 1


_STORED: dict[tuple, str] = {}


def content(spark: SparkSession, path: str) -> tuple:
    """What tells a table's files from those that were there before: names, sizes and times."""
    fs, at = tables._fs(spark, path)
    return tuple(sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(at)))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1: one reading per event type (and part of the users) and hour.

    Plans meet the readings many times, so the events are read once per application and content of their table; the
    readings are written and read from then on.
    """
    key = (spark.sparkContext.applicationId, PARTS, content(spark, f"{sf_dir}/events.parquet"))
    if key not in _STORED:
        path = f"{shared_dir(spark)}/hourly-{uuid.uuid4().hex}"
        readings(spark, sf_dir).write.parquet(path)
        _STORED[key] = path
    return session(spark).read.parquet(_STORED[key])


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The readings of V1 from the events."""
    e = session(spark).read.parquet(f"{sf_dir}/events.parquet").select("event_type", "ts", "value", *(["user_id"] if PARTS > 1 else []))
    station = F.col("event_type") if PARTS == 1 else F.concat_ws("-", "event_type", (F.col("user_id") % PARTS).cast("string"))
    cents = F.round(F.col("value") * 100).cast("long")
    hour = (F.floor(epoch("ts") / 3600) * 3600).cast("long")
    h = e.groupBy(station.alias("station"), hour.alias("t")).agg(
        F.count("*").cast("double").alias("n"), F.sum(cents).cast("double").alias("s"), F.max(cents).cast("double").alias("hi"), F.min(cents).cast("double").alias("lo")
    )
    kind = F.substring_index("station", "-", 1)
    shift = F.when(kind == "error", 35.0).when(kind == "view", 10.0).otherwise(0.0)
    null = F.lit(None).cast("double")
    return h.select(
        F.xxhash64("station", "t").alias("id"), "station", "t",
        (F.col("s") / F.col("n") / 250.0 - shift).alias("temperature_2m"),
        (F.col("s") / F.col("n") / 200.0 - shift).alias("apparent_temperature"),
        (F.col("s") / F.col("n") / 400.0).alias("dew_point_2m"),
        F.when(F.col("hi") > 12000.0, (F.col("hi") - 12000.0) / 1000.0).otherwise(0.0).alias("precipitation"),
        (F.col("lo") / 100.0).alias("wind_speed_10m"),
        (F.col("hi") / 250.0).alias("wind_gusts_10m"),
        (1020.0 - F.col("s") / 2000.0).alias("pressure_msl"),
        F.when(F.col("n") >= 6, 95).when(F.col("n") >= 4, 63).when(F.col("n") >= 2, 51).otherwise(0).alias("weather_code"),
        null.alias("surface_pressure"),
    )


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2: one reading per region and day."""
    session(spark)
    at = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    nation = at("nation").join(F.broadcast(at("region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")  # 25 and 5 rows
    supplier = at("supplier").select("s_suppkey", "s_nationkey").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "r_name")
    rows = at("lineitem").select("l_suppkey", "l_shipdate", "l_quantity", "l_discount").join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    day = (F.unix_date(F.col("l_shipdate").cast("date")).cast("long") * 86400).alias("t")
    n = F.count("*").cast("double")
    high = F.max("l_quantity").cast("double")
    return rows.groupBy(F.col("r_name").alias("station"), day).agg(
        (F.sum(F.col("l_quantity").cast("long")).cast("double") / n).alias("temperature_2m"),
        F.when(high > 45.0, high - 45.0).otherwise(0.0).alias("precipitation"),
        (high + n).alias("wind_gusts_10m"),
        (1000.0 + F.sum(F.round(F.col("l_discount") * 100).cast("long")).cast("double") / n).alias("pressure_msl"),
    )


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3: raw arrivals with natural duplicates per station and hour; polled_at in microseconds."""
    e = session(spark).read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        F.col("event_id").cast("long").alias("reading_id"), (F.col("user_id") % 20).cast("string").alias("station"),
        (F.floor(epoch("ts") / 3600) * 3600).cast("long").alias("t"), F.unix_micros(F.col("ts").cast("timestamp")).alias("polled_at"), F.col("value").alias("temperature_2m"),
    )


# The station dimension and the labelled windows.
STATIONS = [
    ("click", "America/Toronto", "A"), ("error", "America/Toronto", "A"), ("view", "America/Vancouver", "A"), ("signup", "America/Vancouver", "A"), ("purchase", "UTC", "A"),
    ("AFRICA", "UTC", "R"), ("AMERICA", "America/Toronto", "R"), ("ASIA", "UTC", "R"), ("EUROPE", "UTC", "R"), ("MIDDLE EAST", "UTC", "R"),
]
LABELS = [
    (1, "click", "2024-01-22", "2024-01-22", ["heavy_rain_burst", "wind_gust_burst"]), (2, "error", "2024-01-23", "2024-01-26", ["cold_stress", "cold_spell"]),
    (3, "view", "2024-01-25", "2024-01-25", ["temperature_shock"]), (4, "signup", "2024-01-27", "2024-01-28", ["heat_stress", "warm_spell"]),
    (5, "purchase", "2024-01-24", "2024-01-24", ["pressure_plunge"]), (6, "purchase", "2024-01-29", "2024-01-29", ["spatial_anomaly"]),
]


#: Days and detectors that are looked up by hand.
CHECKS = [
    (1, "purchase", "pressure_plunge", "2024-01-24"), (2, "click", "wind_gust_burst", "2024-01-22"), (3, "error", "cold_stress", "2024-01-24"),
    (4, "signup", "heat_stress", "2024-01-27"), (5, "view", "temperature_shock", "2024-01-25"), (6, "view", "heavy_rain_burst", "2024-01-03"),
]


def checks(spark: SparkSession) -> DataFrame:
    """Spot checks, from two days before to two days after."""
    rows = session(spark).createDataFrame(CHECKS, "check_id int, station string, kind string, day string")
    day = F.unix_date(F.col("day").cast("date")).cast("long") * 86400
    return rows.select("check_id", "station", "kind", (day - 2 * 86400).alias("from_t"), (day + 3 * 86400 - 1).alias("until_t"))


def stations(spark: SparkSession) -> DataFrame:
    """V4; parts of an event type are peers of the same part of the others."""
    rows = STATIONS if PARTS == 1 else [(f"{s}-{k}", tz, f"{group}{k}") for s, tz, group in STATIONS for k in range(PARTS)]
    return session(spark).createDataFrame(rows, "station string, tz string, peer_group string")


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5: the value of 24 hours before, with leads of 1 to 14 hours."""
    h = hourly(spark, sf_dir)
    lead = (1 + (F.floor(F.col("t") / 3600) % 24 * 7 + F.length("station")) % 14).cast("int")
    return h.select(
        "station", (F.col("t") + 86400).alias("target_t"), lead.alias("lead_hours"), (F.col("t") + 86400 - lead * 3600).alias("issued_t"),
        "temperature_2m", "precipitation", "wind_speed_10m", "wind_gusts_10m", "pressure_msl", "weather_code",
    )


def labels(spark: SparkSession) -> DataFrame:
    """V6, one row per label."""
    rows = session(spark).createDataFrame(LABELS, "label_id int, station string, start_date string, end_date string, expected array<string>")
    day = lambda c: F.unix_date(F.col(c).cast("date")).cast("long") * 86400
    return rows.withColumn("from_t", day("start_date") - 86400).withColumn("until_t", day("end_date") + 2 * 86400 - 1)
