"""Registered queries over stored tables, streams and backfills, by inventory id.

Every stream reads files that Spark writes from the given tables.  They land in parts; after each part the stream is
started on its checkpoint, handles what is new and ends, so every part is a restart.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempestry.operators import climatology as C
from tempestry.operators import detectors as D
from tempestry.operators import feeds
from tempestry.operators import features as X
from tempestry.operators.lineage import cut, shared_dir
from tempestry.plans import catalog, views
from tempestry.plans.catalog import INCIDENT, P
from tempestry.plans.sql import with_
from tempestry.profile import FORECAST_METRICS, WET_PERCENTILES
from tempestry.sources import tables
from tempestry.sources.backfill import Backfill
from tempestry.streaming import detection, lifecycle
from tempestry.streaming.detection import Batches

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
FORECAST = "station string, target_t long, lead_hours int, issued_t long, temperature_2m double, precipitation double, wind_speed_10m double, wind_gusts_10m double, pressure_msl double, weather_code int, t long"
FOUND = (
    "station string, t long, id long, detector string, detector_order int, metric string, strength double, score double, severity string, confidence double, "
    "signals map<string,double>, notes map<string,string>, reason string, supporting_ids array<long>, dedupe_key string"
)


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name], ORACLES[name] = f, with_(sql)
        return f

    return keep


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _spans(df: DataFrame, n: int) -> list[DataFrame]:
    """df in n parts by time, the earliest first."""
    a, z = df.agg(F.min("t"), F.max("t")).first()
    step = 1 if a is None else (z - a) // n + 1
    return [df] if a is None else [df.filter((F.col("t") >= a + k * step) & (F.col("t") < a + (k + 1) * step)) for k in range(n)]


def _fed(parts: list[DataFrame], path: str, schema, flow: Callable[[DataFrame], DataFrame], each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Land the parts one after the other, each as Spark deals it, and run the stream over what has come."""
    spark = parts[0].sparkSession
    for k, part in enumerate(parts):
        part.write.json(f"{path}/in/{k}")
        source = spark.readStream.schema(schema).json(f"{path}/in/*")
        writer = flow(source).writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").foreachBatch(each)
        writer.trigger(availableNow=True).start().awaitTermination()


@query("s6_stream_readings", "SELECT station, t, temperature_2m, precipitation, wind_gusts_10m, weather_code FROM v1")
def s6(spark, d):
    """Every reading lands again with the part after its own, long after the stream's watermark has forgotten it: what
    the watermark lets pass is held against what is stored."""
    path, h = _folder(spark, "stream"), cut(views.hourly(spark, d))
    spans = _spans(h, 3)
    parts = [a if b is None else a.unionByName(b) for a, b in zip([*spans, spans[-1]], [None, *spans])]
    stored = Batches(spark, f"{path}/readings", tables.READING)
    for k, part in enumerate(parts):
        part.write.json(f"{path}/in/{k}")
        stream = tables.stream_readings(spark, f"{path}/in/*").writeStream.option("checkpointLocation", f"{path}/state")
        stream.foreachBatch(lambda batch, number: detection.kept_new(stored, batch, number)).trigger(availableNow=True).start().awaitTermination()
    return stored.before().select("station", "t", "temperature_2m", "precipitation", "wind_gusts_10m", "weather_code")


_DELIVERED = "SELECT *, t + 3600 * (1 + reading_id % 14) AS target_t, 1 + reading_id % 14 AS lead_hours FROM v3"


@query("s8_dedupe_forecasts", f"SELECT station, target_t, CAST(lead_hours AS BIGINT) AS lead_hours, temperature_2m FROM ({_DELIVERED} QUALIFY row_number() OVER (PARTITION BY station, t ORDER BY polled_at, reading_id) = 1) WHERE lead_hours BETWEEN 3 AND 12 QUALIFY row_number() OVER (PARTITION BY station, target_t ORDER BY polled_at, reading_id) = 1")
def s8(spark, d):
    """Every arrival brings a forecast; it is kept if the reading was new, its lead is admissible and its time is new."""
    arrivals = views.raw(spark, d).withColumn("lead_hours", 1 + F.col("reading_id") % 14).withColumn("target_t", F.col("t") + 3600 * F.col("lead_hours"))
    kept = feeds.forecasts_of_new(arrivals, ["station", "t"], ["polled_at", "reading_id"], P)
    return kept.select("station", "target_t", "lead_hours", "temperature_2m")


@query("s9_write_events", f"SELECT {', '.join(c for c in INCIDENT if c != 'status')}, CASE WHEN hits > 1 THEN status ELSE 'open' END AS status FROM inc")
def s9(spark, d):
    """All incidents as open, then the longer ones as they ended, then the first batch again, which changes nothing."""
    path, rows = _folder(spark, "events"), cut(catalog.incidents(spark, d))
    tables.write_events(rows.withColumn("status", F.lit("open")), path, batch=0)
    tables.write_events(rows.filter("hits > 1"), path, batch=1)
    tables.write_events(rows.withColumn("status", F.lit("open")), path, batch=0)
    return tables.read_events(spark, path).select(*INCIDENT)


_TELLS = "station || '|' || detector || '|' || metric AS dedupe_key, onset_t, last_t, peak_t, peak_strength, priority_score, CAST(hits AS INT) AS hits, resolved_t, status"


def _upserts(path: str):
    """The sink of the lifecycle: incidents go to the event table, late readings to one of their own."""

    def each(batch: DataFrame, number: int) -> None:
        batch = cut(batch)
        tables.write_events(batch.filter("status <> 'late'").withColumn("event_id", F.xxhash64("dedupe_key", "onset_t")), f"{path}/events", batch=number)
        batch.filter("status = 'late'").select("station", F.col("onset_t").alias("t")).write.mode("overwrite").parquet(f"{path}/rejects/batch={number}")

    return each


def _lifecycle(parts: list[DataFrame], path: str, delay_s: int) -> None:
    spark, name = parts[0].sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, lifecycle.ROCKSDB)
    try:
        _fed(parts, path, lifecycle.TICK, lambda source: lifecycle.stream_incidents(source, P, delay_s), _upserts(path), "update")
    finally:
        spark.conf.set(name, before)


@query("l5_stream_lifecycle", f"SELECT station, {_TELLS} FROM inc")
def l5(spark, d):
    """The lifecycle from a stream of readings with their candidates, restarted twice; the event table at its end."""
    path = _folder(spark, "stream")
    _lifecycle(_spans(cut(lifecycle.ticks(views.hourly(spark, d), catalog.candidates(spark, d))), 3), path, 0)
    return _told(spark, path)


def _told(spark: SparkSession, path: str) -> DataFrame:
    return tables.read_events(spark, f"{path}/events").select("station", "dedupe_key", "onset_t", "last_t", "peak_t", "peak_strength", "priority_score", "hits", "resolved_t", "status")


DELAY_S = 6 * 3600
_PART = 250  # hours


def _shuffled(ticks: DataFrame) -> list[DataFrame]:
    """Ticks as they arrive: up to five hours late and so out of order, and one in ten again two parts later, empty.
    The last part ends the feed."""
    hour, first = F.col("t") / 3600, F.lit(ticks.agg(F.min("t")).first()[0] or 0) / 3600
    late_by = (hour * 7 + F.length("station")) % 6
    ticks = ticks.withColumn("part", F.floor((hour + late_by - first) / _PART))
    again = ticks.filter((hour + F.length("station")) % 10 == 3).withColumns({"part": F.col("part") + 2, "hits": F.lit(None).cast(ticks.schema["hits"].dataType)})
    end = ticks.agg(F.max("part")).first()[0]
    last = (end or 0) + 2
    closing = ticks.select("station").distinct().select("station", F.lit(0).cast("long").alias("t"), F.lit(None).cast(ticks.schema["hits"].dataType).alias("hits"), F.lit(True).alias("flush"), F.lit(last).cast("long").alias("part"))
    rows = cut(ticks.unionByName(again).unionByName(closing))
    return [rows.filter(F.col("part") == k).drop("part") for k in range(last + 1)]


def _out_of_order(spark: SparkSession, d: str) -> str:
    path = _folder(spark, "stream")
    _lifecycle(_shuffled(cut(lifecycle.ticks(views.hourly(spark, d), catalog.candidates(spark, d)))), path, DELAY_S)
    return path


@query("l7_out_of_order", f"SELECT station, {_TELLS} FROM inc")
def l7(spark, d):
    """Incidents from readings that arrive out of order, some again and too late: the same as from readings in order."""
    return _told(spark, _out_of_order(spark, d))


_ARRIVED = f"SELECT station, t, (t // 3600 + ((t // 3600) * 7 + length(station)) % 6 - (SELECT min(t) // 3600 FROM v1)) // {_PART} AS part FROM v1"


@query("l7_late_rejects", f"SELECT x.station, x.t FROM ({_ARRIVED}) x WHERE (t // 3600 + length(station)) % 10 = 3 AND x.t <= (SELECT max(y.t) FROM ({_ARRIVED}) y WHERE y.station = x.station AND y.part < x.part + 2) - {DELAY_S}")
def l7r(spark, d):
    """The readings that came after later ones had been handled."""
    return spark.read.option("basePath", (at := f"{_out_of_order(spark, d)}/rejects")).schema("station string, t long").parquet(at).select("station", "t")


def _clim(spark: SparkSession, d: str) -> dict:
    fitted = catalog.climatology1(spark, d)
    return {**fitted, "gates": fitted["gates"]["smooth"]}


def _detected(spark: SparkSession, clim: dict, rows: DataFrame, new: DataFrame, said: DataFrame) -> DataFrame:
    """Candidates of all ten detectors for the new readings among rows."""
    stations = views.stations(spark)
    df = cut(D.enriched(rows, stations, clim, P))
    features = X.with_peer_lists(df, stations, catalog.PEER_COLUMNS, new)
    mine = df.join(new.hint("merge"), ["station", "t"], "left_semi").select("station", "t", *FORECAST_METRICS)
    return D.detect(catalog.joined(features, catalog.said_before(mine, df, said)), P)


@query("l6_stream_detect", "SELECT station, t, detector, metric, strength, score, severity FROM cand")
def l6(spark, d):
    """Detection on arrival, all ten detectors; history, peers and forecasts are what the stream itself stored."""
    path, h, clim = _folder(spark, "stream"), cut(views.hourly(spark, d)), _clim(spark, d)
    forecasts = cut(views.forecasts(spark, d))
    stored, said, found = (Batches(spark, f"{path}/{n}", s) for n, s in (("readings", tables.READING), ("forecasts", FORECAST), ("candidates", FOUND)))

    def offered(new: DataFrame) -> DataFrame:
        """What came along with new readings: the forecast for a day later."""
        return forecasts.join(new.select("station", (F.col("t") + 86400).alias("target_t")).hint("merge"), ["station", "target_t"], "left_semi")

    each = detection.on_arrival(stored, found, lambda rows, new, fc: _detected(spark, clim, rows, new, fc), P, said, offered)
    _fed(_spans(h, 3), path, tables.READING, lambda source: source, each)
    return found.before().select("station", "t", "detector", "metric", "strength", "score", "severity")


@query("s11_backfill", f"SELECT {', '.join(INCIDENT)} FROM inc")
def s11b(spark, d):
    """An archive loaded in chunks of nine days: stopped in the middle, resumed by a new run, and run once more for nothing."""
    h, clim, fc = cut(views.hourly(spark, d)), _clim(spark, d), cut(views.forecasts(spark, d))
    fill = Backfill(spark, _folder(spark, "backfill"), tables.READING, FOUND, lambda a, z: h, lambda rows, new: _detected(spark, clim, rows, new, fc), P)
    a, z = h.agg(F.floor(F.min("t") / 86400), F.floor(F.max("t") / 86400)).first()
    fill.run(a, z, 9, stop_before=a + 18)
    fill.run(a, z, 9)
    if fill.run(a, z, 9):
        raise RuntimeError("a committed chunk was loaded again")
    return fill.events().select(*INCIDENT)


@query("s10_climatology_tables", "SELECT 'smooth' AS level, station, metric, n, median, mad, scale FROM smooth1 UNION ALL SELECT 'month_hour', station, metric, n, median, mad, scale FROM mh1 UNION ALL SELECT 'month', station, metric, n, median, mad, scale FROM mo1 UNION ALL SELECT 'city', station, metric, n, median, mad, scale FROM city1")
def s10(spark, d):
    levels = catalog.climatology1(spark, d)["levels"]
    return reduce(DataFrame.unionByName, [levels[k].select(F.lit(k).alias("level"), "station", "metric", "n", "median", "mad", "scale") for k in C.LEVELS])


def _season(keys: list[str]) -> str:
    return ", ".join(f"CAST({k if k in keys else 'NULL'} AS BIGINT) AS {k}" for k in ("doy", "month", "hour"))


_WET = ", ".join(("total_count", "wet_count", *[f"p{m}" for m in WET_PERCENTILES]))


@query("s10_wet_tables", " UNION ALL ".join(f"SELECT '{level}' AS level, station, {_season(keys)}, {_WET} FROM {step}" for (level, keys), step in zip(C.LEVELS.items(), ("wetsmooth1", "wetmh1", "wetmo1", "wetcity1"))))
def s10_wet(spark, d):
    wet = catalog.climatology1(spark, d)["wet"]
    season = lambda k: [(F.col(c) if c in C.LEVELS[k] else F.lit(None)).cast("long").alias(c) for c in ("doy", "month", "hour")]
    return reduce(DataFrame.unionByName, [wet[k].select(F.lit(k).alias("level"), "station", *season(k), *_WET.split(", ")) for k in C.LEVELS])


@query("s10_thresholds", "SELECT 'smooth' AS baseline, metric, n, upper_z, lower_z, abs_z FROM thrall1 UNION ALL SELECT 'month_hour', metric, n, upper_z, lower_z, abs_z FROM thrmhall1")
def s10_thresholds(spark, d):
    return catalog.climatology1(spark, d)["thresholds"]


@query("s10_tails", "SELECT 'smooth' AS baseline, metric, kind, k, v, p FROM tail1 UNION ALL SELECT 'month_hour', metric, kind, k, v, p FROM tailmh1")
def s10_tails(spark, d):
    return catalog.climatology1(spark, d)["tails"]
