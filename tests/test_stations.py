"""Station operators: literals, near misses, a property test of the lifecycle, batch against stream."""

import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tempestry.functions import scalars as S
from tempestry.operators import climatology as C
from tempestry.operators import detectors as D
from tempestry.operators import evaluation as E
from tempestry.operators import features as X
from tempestry.operators import feeds, legacy, lifecycle
from tempestry.plans import catalog, sql, views
from tempestry.profile import Profile
from tempestry.sources import artifact, provider, tables
from tempestry.streaming import lifecycle as stream

T0 = 1780329600  # 2026-06-01T16:00Z
READING = "id long, station string, t long, temperature_2m double, apparent_temperature double, dew_point_2m double, precipitation double, wind_speed_10m double, wind_gusts_10m double, pressure_msl double, surface_pressure double, weather_code int"
STATIONS = [("Toronto", "America/Toronto", "A"), ("Ottawa", "America/Toronto", "A"), ("Vancouver", "America/Vancouver", "A")]


def reading(k, station="Toronto", **over):
    row = {"id": 1000 + k, "station": station, "t": T0 - k * 3600, "temperature_2m": 20.0, "apparent_temperature": 20.0, "dew_point_2m": 10.0, "precipitation": 0.0, "wind_speed_10m": 10.0, "wind_gusts_10m": 20.0, "pressure_msl": 1010.0, "surface_pressure": None, "weather_code": 0}
    return tuple((row | over).values())


def history(n=12, station="Toronto", **offsets):
    return [reading(k, station, **offsets.get(f"h{k}", {})) for k in range(1, n + 1)]


WET = "total_count long, wet_count long, p50 double, p75 double, p90 double, p95 double, p99 double"


def prepared(spark, rows, t_scale=2.0, wet=(), rain=5.0, p=Profile()):
    """Features against a flat June baseline with gates T +-3, gust 3.2, wet 5 mm; `wet` are rows of Toronto's wet levels."""
    readings = spark.createDataFrame(rows, READING) if isinstance(rows, list) else rows
    stations = spark.createDataFrame(STATIONS, "station string, tz string, peer_group string")
    flat = [(s, m, 120, med, sc / 1.4826, sc) for s in ("Toronto", "Ottawa", "Vancouver") for m, med, sc in (("temperature_2m", 15.0 if s == "Vancouver" else 20.0, t_scale), ("wind_gusts_10m", 20.0, 10.0), ("pressure_msl", 1010.0, 2.0))]
    hours = [(s, 6, h, *rest) for s, *rest in flat for h in range(24)]
    hourly = spark.createDataFrame(hours, "station string, month int, hour int, metric string, n long, median double, mad double, scale double")
    none = lambda keys: spark.createDataFrame([], f"station string, {keys} metric string, n long, median double, mad double, scale double")
    levels = {"smooth": none("doy int, hour int,"), "month_hour": hourly, "month": none("month int,"), "city": none("")}
    thr = spark.createDataFrame([("temperature_2m", 3.0, -3.0), ("wind_gusts_10m", 3.2, None), ("pressure_msl", 3.0, -3.0), ("rain", rain, None)], "metric string, upper_z double, lower_z double")
    tail = spark.createDataFrame([], "metric string, kind string, k int, v double, p double")
    keys = {"smooth": "doy int, hour int,", "month_hour": "month int, hour int,", "month": "month int,", "city": ""}
    wet_levels = {n: spark.createDataFrame([("Toronto", *k, *rest) for level, k, rest in wet if level == n], f"station string, {c} {WET}") for n, c in keys.items()}
    return D.enriched(readings, stations, {"levels": levels, "wet": wet_levels, "gates": D.gates(thr, tail)}, p)


def fired(spark, detector, rows):
    out = detector(prepared(spark, rows)).filter(F.col("t") == T0).collect()
    return [(r.station, r.metric, r.strength, r.severity) for r in out]


def test_scores_and_bands(spark):
    row = spark.range(1).select(
        S.priority_score(rarity=F.lit(0.5), magnitude=F.lit(0.5), persistence=F.lit(0.4), compound=F.lit(0.5), confidence=F.lit(1.0)).alias("a"),
        S.priority_score(rarity=F.lit(9.0), magnitude=F.lit(-1.0)).alias("b"),
        *[S.severity(F.lit(x)).alias(f"s{i}") for i, x in enumerate((29.999, 30.0, 59.999, 60.0))],
        S.humidex(F.lit(30.0), F.lit(20.0)).alias("h"), S.wind_chill(F.lit(-10.0), F.lit(20.0)).alias("c"), S.wind_chill(F.lit(10.5), F.lit(20.0)).alias("n"),
    ).first()
    assert row.a == pytest.approx(100 * (0.15 + 0.1 + 0.06 + 0.05 + 0.05)) and row.b == 30.0
    assert [row.s0, row.s1, row.s2, row.s3] == ["info", "warning", "warning", "severe"]
    assert row.h == pytest.approx(37.6, abs=0.3) and row.c == pytest.approx(-17.9, abs=0.2) and row.n is None


def test_tail_is_log_linear_and_capped(spark):
    anchors = F.array(*[F.struct(F.lit(v).alias("v"), F.lit(p).alias("p")) for v, p in ((2.0, 0.1), (4.0, 0.001))])
    row = spark.range(1).select(*[S.tail_probability(anchors, F.lit(x)).alias(f"x{i}") for i, x in enumerate((1.0, 3.0, 9.0, -3.0))]).first()
    assert (row.x0, row.x2) == (0.1, 0.001) and row.x1 == pytest.approx(0.01) == row.x3


def test_temperature_shock(spark):
    assert fired(spark, D.temperature_shock, [reading(0, temperature_2m=28.0), *history(h3={"temperature_2m": 22.0})]) == [("Toronto", "temperature_2m", 4.0, "severe")]
    assert fired(spark, D.temperature_shock, [reading(0, temperature_2m=28.0), *history(h3={"temperature_2m": 24.0})]) == []
    assert fired(spark, D.temperature_shock, [reading(0, temperature_2m=28.0), *history(11, h3={"temperature_2m": 22.0})]) == []  # cold start


def test_pressure_plunge(spark):
    rows = [reading(0, pressure_msl=1000.0, wind_gusts_10m=55.0), *history(h3={"pressure_msl": 1007.0, "wind_gusts_10m": 35.0})]
    assert [(m, s) for _, m, s, _ in fired(spark, D.pressure_plunge, rows)] == [("pressure_msl", 7.0)]
    calm = [reading(0, pressure_msl=1000.0), *history(h3={"pressure_msl": 1007.0})]
    assert fired(spark, D.pressure_plunge, calm) == []


def test_rain_gusts_and_stress(spark):
    assert [s for *_, s, _ in fired(spark, D.heavy_rain_burst, [reading(0, precipitation=12.0), *history()])] == [12.0]
    assert fired(spark, D.heavy_rain_burst, [reading(0), *history(h1={"precipitation": 9.0}, h2={"precipitation": 9.0})]) == []
    assert [s for *_, s, _ in fired(spark, D.wind_gust_burst, [reading(0, wind_gusts_10m=95.0), *history()])] == [7.5]
    assert len(fired(spark, D.heat_stress, [reading(0, temperature_2m=33.0, dew_point_2m=24.0), *history()])) == 1
    assert len(fired(spark, D.cold_stress, [reading(0, temperature_2m=-20.0, wind_speed_10m=30.0), *history()])) == 1


def wet_row(count, p95, total=400):
    return (total, count, 1.0, 2.0, 4.0, p95, p95 + 5.0)


DOY, HOUR = 152, 12  # of T0 in Toronto


@pytest.mark.parametrize(
    "wet,rain,profile,amount,want",
    [
        # the training quantile rules, with the floor of 10 mm; the bucket is only told
        ([("smooth", (DOY, HOUR), wet_row(30, 30.0))], 5.0, {}, 12.0, ("training_wet_hour_upper_quantile_with_hazard_floor", "smooth", 10.0, 1.0, 95)),
        ([("smooth", (DOY, HOUR), wet_row(30, 30.0))], 14.0, {}, 12.0, None),
        # no quantile: the 95th percentile of the first level with enough wet hours
        ([("smooth", (DOY, HOUR), wet_row(30, 11.0)), ("month_hour", (6, HOUR), wet_row(90, 25.0))], None, {}, 12.0, ("fixed_wet_p95_fallback", "smooth", 11.0, 1.0, 99)),
        ([("smooth", (DOY, HOUR), wet_row(29, 11.0)), ("month_hour", (6, HOUR), wet_row(90, 25.0))], None, {}, 12.0, None),
        ([("month_hour", (6, HOUR), wet_row(30, 11.0))], None, {}, 12.0, ("fixed_wet_p95_fallback", "month_hour", 11.0, 1.0, 99)),
        ([("month", (6,), wet_row(30, 3.0))], None, {}, 12.0, ("fixed_wet_p95_fallback", "month", 10.0, 0.8, 99)),
        ([("city", (), wet_row(2, 3.0))], None, {}, 12.0, ("fixed_wet_p95_fallback", "city", 10.0, 0.8, 99)),
        # neither: nothing fires, however much it rains
        ([], None, {}, 90.0, None),
        ([], 5.0, {}, 12.0, ("training_wet_hour_upper_quantile_with_hazard_floor", "missing", 10.0, 0.8, None)),
        # fixed gates ask for the bucket although there is a quantile
        ([("smooth", (DOY, HOUR), wet_row(30, 13.0))], 5.0, {"quantile_gates": False}, 12.0, None),
        ([("smooth", (DOY, HOUR), wet_row(30, 3.0)), ("month_hour", (6, HOUR), wet_row(90, 11.5))], 5.0, {"quantile_gates": False, "smooth_baseline": False}, 12.0, ("fixed_wet_p95_floor", "month_hour", 11.5, 1.0, 99)),
    ],
)
def test_heavy_rain_ladder(spark, wet, rain, profile, amount, want):
    p = Profile(**profile)
    rows = D.heavy_rain_burst(prepared(spark, [reading(0, precipitation=amount), *history()], wet=wet, rain=rain, p=p), p).filter(F.col("t") == T0).collect()
    got = [(r.notes["threshold_source"], r.notes["baseline_bucket"], r.signals["threshold_mm"], r.confidence, r.signals["wet_amount_percentile"]) for r in rows]
    assert got == ([want] if want else [])


def test_wet_levels_count_and_spread(spark):
    rain = [(10, 1, 5, 0.0), (10, 1, 5, 4.0), (12, 1, 5, 8.0), (12, 1, 5, 8.0), (40, 2, 5, 2.0), (12, 1, 6, 0.05), (361, 12, 5, 6.0)]
    vals = spark.createDataFrame([("s", 0, d, m, h, "precipitation", v) for d, m, h, v in rain], "station string, t long, doy int, month int, hour int, metric string, v double")
    levels = C.wet_levels(vals, Profile())
    smooth = {(r.doy, r.hour): (r.total_count, r.wet_count, r.p50, r.p75) for r in levels["smooth"].collect()}
    assert smooth[10, 5] == (5, 4, 7.0, 8.0)  # 4, 8, 8, and 6 from the end of the year before
    assert smooth[26, 5] == (3, 3, 8.0, 8.0) and smooth[40, 5] == (1, 1, 2.0, 2.0) and smooth[12, 6] == (1, 0, None, None)
    assert {r.month: (r.total_count, r.wet_count) for r in levels["month"].collect()} == {1: (5, 3), 2: (1, 1), 12: (1, 1)}
    assert levels["city"].first().total_count == 7


def test_as_of_peers(spark):
    rows = [reading(0), reading(2, "Ottawa", temperature_2m=5.0), reading(1, "Vancouver", temperature_2m=None), reading(3, "Vancouver", temperature_2m=1.0)]
    peers = X.latest_peers(spark.createDataFrame(rows, READING), spark.createDataFrame(STATIONS, "station string, tz string, peer_group string"), ["temperature_2m"])
    got = {(r.peer, r.peer_t, r.temperature_2m) for r in peers.filter(f"station = 'Toronto' AND t = {T0}").collect()}
    assert got == {("Ottawa", T0 - 7200, 5.0), ("Vancouver", T0 - 3600, None)}


def test_one_shuffle_for_all_history_windows(spark):
    plan = X.with_history(spark.createDataFrame(history(), READING).repartition(3), Profile())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(station") == 1


def test_ladder(spark):
    rows = [("s", 10, 1, 5, "temperature_2m", float(v)) for v in range(40)]
    vals = spark.createDataFrame([(s, 0, d, 1, h, m, v) for s, d, _, h, m, v in rows], "station string, t long, doy int, month int, hour int, metric string, v double")
    levels = C.stats(vals)
    ask = spark.createDataFrame([("s", 0, 10, 1, 5), ("s", 1, 30, 1, 5), ("s", 2, None, None, None), ("x", 3, 1, 1, 1)], "station string, t long, doy int, month int, hour int")
    got = {r.t: (r.temperature_2m_bucket, r.temperature_2m_median) for r in C.lookup(ask, levels, ["temperature_2m"]).collect()}
    assert got == {0: ("smooth", 19.5), 1: ("month_hour", 19.5), 2: ("city", 19.5), 3: (None, None)}


CANDIDATE = "station string, t long, id long, detector string, detector_order int, metric string, strength double, score double, severity string, confidence double, signals map<string,double>, supporting_ids array<long>, dedupe_key string"


def random_case(rng):
    readings, cands = [], []
    for s in ("a", "b"):
        for k in range(40):
            readings.append((s, k * 3600))
            for key in ("x", "y"):
                if rng.random() < 0.5:
                    v = rng.choice([0.2, 0.5, 0.7, 1.0, 1.5, 2.0])
                    cands.append((s, k * 3600, k, "d", 0, key, v, v * 10, "info", 1.0, {"v": v}, [k], f"{s}|{key}"))
    return readings, cands


def folded(readings, cands, p):
    """Incidents by (dedupe_key, onset_t), reading by reading, from the rules of the lifecycle."""
    done = {}
    for station in sorted({s for s, _ in readings}):
        keys = {}
        for t in sorted(t for s, t in readings if s == station):
            hits = {}
            for c in cands:
                if c[0] == station and c[1] == t and (c[12] not in hits or c[7] >= hits[c[12]][1]):
                    hits[c[12]] = (c[6], c[7])
            for key in {*keys, *hits}:
                s, (strength, score) = keys.get(key), hits.get(key, (-1.0, 0.0))
                if s and s["active"]:
                    if strength < p.z_off:
                        s["clear"] += 1
                        if s["clear"] == p.k_off:
                            s["row"] = (*s["row"][:-1], t)
                            del keys[key]
                    else:
                        s["clear"] = 0
                        last, hits_, peak, peak_t, best, _, _ = s["row"]
                        s["row"] = (t, hits_ + 1, max(peak, strength), t if strength > peak else peak_t, max(best, score), "ongoing", None)
                    done[key, s["onset"]] = s["row"]
                elif strength < p.z_on:
                    keys.pop(key, None)
                else:
                    s = keys.setdefault(key, {"active": False, "onset": t, "enter": 0, "clear": 0, "row": (t, 0, 0.0, t, 0.0, "open", None)})
                    s["enter"] += 1
                    _, hits_, peak, peak_t, best, _, _ = s["row"]
                    s["row"] = (t, hits_ + 1, strength, t, score, "open", None) if strength >= peak else (t, hits_ + 1, peak, peak_t, best, "open", None)
                    if s["enter"] == p.k_on:
                        s["active"] = True
                        done[key, s["onset"]] = s["row"]
    return {k: (*r[:5], "resolved" if r[6] is not None else r[5], r[6]) for k, r in done.items()}


def told(rows):
    return {(r.dedupe_key, r.onset_t): (r.last_t, r.hits, r.peak_strength, r.peak_t, r.priority_score, r.status, r.resolved_t) for r in rows}


@pytest.mark.parametrize("k_on,k_off", [(1, 2), (2, 1), (2, 2), (3, 3)])
def test_lifecycle_equals_a_fold(spark, k_on, k_off):
    p = Profile(k_on=k_on, k_off=k_off)
    readings, cands = random_case(random.Random(k_on * 10 + k_off))
    got = lifecycle.incidents(spark.createDataFrame(cands, CANDIDATE), spark.createDataFrame(readings, "station string, t long"), p).collect()
    assert told(got) == folded(readings, cands, p)


def test_pending_peak_is_the_later_of_equals_with_its_score(spark):
    row = lambda t, strength, score: ("a", t, t, "d", 0, "x", strength, score, "info", score / 100, {"v": score}, [t], "a|x")
    cands = [row(0, 2.0, 50.0), row(3600, 2.0, 20.0), row(7200, 2.0, 30.0)]
    out = lifecycle.incidents(spark.createDataFrame(cands, CANDIDATE), spark.createDataFrame([("a", k * 3600) for k in range(3)], "station string, t long"), Profile(k_on=2)).first()
    assert (out.peak_t, out.priority_score, out.signals, out.onset_t, out.status, out.confidence) == (3600, 30.0, {"v": 20.0}, 0, "ongoing", 0.3)


@pytest.fixture
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, stream.ROCKSDB)
    yield
    spark.conf.set(name, before)


def streamed(spark, tmp_path, parts, p=Profile(), delay_s=0):
    """Rows of the stream, the parts landing one after the other and the stream starting anew for each."""
    got = []
    for k, part in enumerate(parts):
        part.write.json(str(tmp_path / "in" / str(k)))
        source = spark.readStream.schema(stream.TICK).json(str(tmp_path / "in" / "*"))
        drained(stream.stream_incidents(source, p, delay_s), tmp_path, lambda batch, _: got.extend(batch.collect()), "update")
    return got


@pytest.mark.parametrize("k_on,k_off", [(1, 2), (2, 2)])
def test_stream_equals_batch_over_restarts(spark, tmp_path, rocksdb, k_on, k_off):
    readings, cands = random_case(random.Random(5))
    p = Profile(k_on=k_on, k_off=k_off)
    ticks = stream.ticks(spark.createDataFrame(readings, "station string, t long"), spark.createDataFrame(cands, CANDIDATE)).persist()
    rows = streamed(spark, tmp_path, [ticks.filter(f"t >= {k * 50000} AND t < {(k + 1) * 50000}") for k in range(3)], p)
    assert told(rows) == folded(readings, cands, p)  # of several rows of an incident the last one


def test_out_of_order_and_late_readings(spark, tmp_path, rocksdb):
    readings, cands = random_case(random.Random(8))
    p, rng = Profile(), random.Random(1)
    ticks = {(r.station, r.t): r for r in stream.ticks(spark.createDataFrame(readings, "station string, t long"), spark.createDataFrame(cands, CANDIDATE)).collect()}
    parts = [[], [], [], []]
    for (_, t), r in ticks.items():
        parts[(t // 3600 + rng.randrange(4)) // 15].append(r)
    again = [r for r in parts[0] if r.t % 7200 == 0]  # far behind the clock by then
    double = [r for r in parts[2] if r.t // 3600 > 40]  # in the buffer still
    parts[2] += again
    end = [(s, 0, None, True) for s in ("a", "b")]
    rows = streamed(spark, tmp_path, [spark.createDataFrame(x or [ticks["a", 0]], stream.TICK).repartition(2) for x in (parts[0], parts[1], parts[2] + double, end)], p, 4 * 3600)
    assert sorted((r.station, r.onset_t) for r in rows if r.status == "late") == sorted((r.station, r.t) for r in again)
    assert told([r for r in rows if r.status != "late"]) == folded(readings, cands, p)


def test_a_silent_station_is_flushed_by_its_timer():
    """The processor with a store of plain maps."""

    class Store:
        def __init__(self):
            self.rows = {}

        exists, containsKey = lambda self: bool(self.rows), lambda self, k: k in self.rows
        getValue, removeKey = lambda self, k: self.rows[k], lambda self, k: self.rows.pop(k)

        def updateValue(self, k, v):
            self.rows[k] = v

        get, update = lambda self: self.rows[()], lambda self, v: self.rows.update({(): v})

    class Handle:
        def __init__(self):
            self.timers = []

        getValueState, getMapState = lambda self, *_: Store(), lambda self, *_: Store()
        listTimers, deleteTimer, registerTimer = lambda self: iter(self.timers), lambda self, t: self.timers.remove(t), lambda self, t: self.timers.append(t)

    class Now:
        getCurrentProcessingTimeInMs = staticmethod(lambda: 5000)

    import pandas as pd

    handle, processor = Handle(), stream.Stations(Profile(), 7200, 60)
    processor.init(handle)
    rows = pd.DataFrame({"t": [3600, 0], "hits": [[{"key": "a|x", "strength": 2.0, "score": 20.0, "detector_order": 0}], None], "flush": [False, False]})
    assert list(processor.handleInputRows(("a",), iter([rows]), Now)) == [] and handle.timers == [65000]
    assert list(processor.handleInputRows(("a",), iter([rows]), Now)) == [] and handle.timers == [65000]  # both wait already
    (out,) = processor.handleExpiredTimer(("a",), Now, None)
    assert out[["onset_t", "status"]].values.tolist() == [[3600, "open"]]
    (late,) = processor.handleInputRows(("a",), iter([rows]), Now)
    assert late[["onset_t", "status"]].values.tolist() == [[3600, "late"], [0, "late"]]


def test_provider_documents(spark):
    current = {"utc_offset_seconds": -14400, "current": {"time": "2026-05-27T08:00", "temperature_2m": 20.5, "weather_code": 3}}
    good, bad = provider.read_current(spark.createDataFrame([("a", json.dumps(current)), ("b", "{}"), ("c", "no json")], "station string, value string"))
    row = good.first()
    assert (row.station, row.t, row.temperature_2m, row.precipitation, row.weather_code) == ("a", 1779883200, 20.5, None, 3) and bad.count() == 2
    archive = {"utc_offset_seconds": 0, "hourly": {"time": ["2026-05-27T00:00", "2026-05-27T01:00"], "temperature_2m": [1.0, None]}}
    broken = {"hourly": {"time": ["2026-05-27T00:00"], "temperature_2m": [1.0, 2.0]}}
    good, bad = provider.read_archive(spark.createDataFrame([("a", json.dumps(archive)), ("b", json.dumps(broken))], "station string, value string"))
    assert sorted((r.t, r.temperature_2m, r.precipitation) for r in good.collect()) == [(1779840000, 1.0, None), (1779843600, None, None)] and bad.count() == 1
    rows = provider.read_forecast(spark.createDataFrame([("b", 1779840000 - 9000, json.dumps(broken))], "station string, issued_t long, value string")).collect()
    assert [(r.target_t, r.temperature_2m, r.lead_hours) for r in rows] == [(1779840000, None, 2)]  # 2.5 hours round to even


EVENT = "event_id long, onset_t long, last_t long, resolved_t long, x double"


def test_events_are_upserted_and_published_by_commits(spark, tmp_path):
    at = str(tmp_path / "e")
    rows = lambda *r: spark.createDataFrame(list(r), EVENT)
    seen = lambda: {(r.event_id, r.x, r.resolved_t) for r in tables.read_events(spark, at).collect()}
    with pytest.raises(ValueError):
        tables.read_events(spark, at)
    tables.write_events(rows((1, 0, 10, None, 1.0), (2, 50, 60, None, 2.0), (3, 86400, 86410, None, 3.0)), at, batch=0)
    # one incident of a day with two changes, twice in the batch; a new one comes to the other day
    tables.write_events(rows((1, 0, 30, 40, 1.5), (1, 0, 20, None, 1.2), (4, 90000, 90000, None, 4.0)), at, batch=1)
    want = {(1, 1.5, 40), (2, 2.0, None), (3, 3.0, None), (4, 4.0, None)}
    assert seen() == want
    tables.write_events(rows((1, 0, 10, None, 9.0)), at, batch=1)  # the same batch again, as after a restart
    tables.write_events(rows((2, 50, 60, None, 9.0)), at, batch=0)
    assert seen() == want
    tables.write_events(rows(), at, batch=2)
    assert seen() == want
    (tmp_path / "e" / "data" / "9-left").mkdir()  # a writer that was lost before its commit
    rows((5, 0, 1, None, 5.0)).write.parquet(str(tmp_path / "e" / "data" / "9-left" / "day=1970-01-01"))
    assert seen() == want
    tables.write_events(rows((2, 50, 70, 80, 2.5)), at)  # not a stream's
    assert (2, 2.5, 80) in seen()
    with pytest.raises(RuntimeError):
        tables.publish(spark, at, 1, {})


def test_climatology_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(0, 1.0), (86400, 2.0)], "onset_t long, x double")
    tables.write_climatology({"city": rows}, str(tmp_path / "c"))
    assert tables.read_climatology(spark, str(tmp_path / "c"), ["city"])["city"].count() == 2


def test_artifact_versions(spark, tmp_path):
    at, p = str(tmp_path / "a"), Profile(min_bucket_n=2)
    readings = spark.createDataFrame([reading(k, temperature_2m=20.0 + k % 5, precipitation=float(k % 3)) for k in range(72)], READING)
    stations = spark.createDataFrame(STATIONS, "station string, tz string, peer_group string")
    vals, totals = C.values(C.with_local(readings, stations), p.climatology_metrics), C.rolling_accumulations(readings, p)
    with pytest.raises(ValueError):
        artifact.load(spark, at)
    assert artifact.fit(vals.limit(0), totals.limit(0), at, p) == 1
    empty = artifact.load(spark, at)
    assert [empty[name].count() for name in ("thresholds", "tails", "diagnostics")] == [0, 0, 0] and empty["levels"]["smooth"].count() == 0
    assert artifact.fit(vals, totals, at, p) == 2
    (tmp_path / "a" / "data" / "lost").mkdir()  # a fit that was lost before its commit
    got = artifact.load(spark, at)
    for level, want in C.stats(vals, p).items():
        assert sorted(map(tuple, got["levels"][level].collect())) == sorted(map(tuple, want.select(got["levels"][level].columns).collect()))
    for level, want in C.wet_levels(vals, p).items():
        assert sorted(map(tuple, got["wet"][level].collect())) == sorted(map(tuple, want.select(got["wet"][level].columns).collect()))
    threshold, tail = artifact.of_baseline(got, "smooth")
    assert {r.metric for r in threshold.collect()} == {"temperature_2m", "precipitation", "wind_gusts_10m", "pressure_msl", "rain", "rain_6h"}
    assert tail.count() == 6 * 16
    assert {r.name: r.value for r in got["settings"].collect()}["min_bucket_n"] == "2"
    assert artifact.load(spark, at, 1)["thresholds"].count() == 0  # older versions stay readable


def drained(stream, tmp_path, each, mode="append"):
    stream.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "ck")).foreachBatch(each).trigger(availableNow=True).start().awaitTermination(120)


def test_stream_of_readings_keeps_the_first_arrival(spark, tmp_path):
    first = spark.createDataFrame([reading(k, temperature_2m=float(k)) for k in range(6)], READING)
    again = spark.createDataFrame([reading(k, temperature_2m=99.0) for k in range(3)], READING)
    late = spark.createDataFrame([reading(24 * 40, temperature_2m=-1.0)], READING)  # far behind the watermark
    for k, rows in enumerate((first, again, late)):
        rows.coalesce(1).write.json(str(tmp_path / "in" / f"b{k}"))
    source = spark.readStream.schema(READING).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(str(tmp_path / "in"))
    assert source.isStreaming
    got = []
    drained(tables.stream_readings(spark, str(tmp_path / "in" / "*"), 1), tmp_path, lambda batch, _: got.extend((r.t, r.temperature_2m) for r in batch.collect()))
    assert sorted(got) == sorted((T0 - k * 3600, float(k)) for k in range(6))


def rainy_month(spark):
    rows = [reading(k, temperature_2m=28.0 if k in (0, 4, 9) else 20.0, wind_gusts_10m=95.0 if k % 7 == 0 else 20.0) for k in range(40)]
    return spark.createDataFrame(rows, READING)


FOUND = "station string, t long, id long, detector string, detector_order int, metric string, strength double, score double, severity string, confidence double, signals map<string,double>, notes map<string,string>, reason string, supporting_ids array<long>, dedupe_key string"


def test_detection_on_arrival_equals_batch(spark, tmp_path):
    from tempestry.streaming.detection import Batches, on_arrival

    p, rows = Profile(), rainy_month(spark)
    detect = lambda df, new=None, said=None: D.detect(prepared(spark, df) if new is None else prepared(spark, df).join(new, ["station", "t"], "left_semi"), p, D.REGISTRY[:8])
    stored, found = Batches(spark, str(tmp_path / "readings"), READING), Batches(spark, str(tmp_path / "found"), FOUND)
    forecasts = Batches(spark, str(tmp_path / "forecasts"), "station string, target_t long, t long")
    offered = lambda new: new.select("station", (F.col("t") + 3600).alias("target_t"))
    each = on_arrival(stored, found, detect, p, forecasts, offered)
    parts = [rows.filter(f"t > {T0 - (40 - 10 * k) * 3600} AND t <= {T0 - (30 - 10 * k) * 3600}") for k in range(4)]
    for k, part in enumerate(parts):
        repeated = part.unionByName(part.withColumn("id", F.col("id") + 5000).withColumn("temperature_2m", F.lit(99.0)))
        before = parts[k - 1].withColumn("temperature_2m", F.lit(99.0)) if k else part.limit(0)
        each(repeated.unionByName(before), k)
        if k == 2:
            each(repeated.unionByName(before), k)  # the batch runs again
    each(rows.limit(0), 4)
    key = lambda r: (r.station, r.t, r.detector, r.strength, r.score)
    want = [key(r) for r in detect(rows).collect()]
    assert len(want) > 3 and sorted(map(key, found.before().collect())) == sorted(want)
    assert stored.before().count() == 40 and stored.before(None, T0 - 5 * 3600, T0 - 3600).count() == 5
    assert forecasts.before().count() == 40  # none of readings that were there before


def test_backfill_resumes_after_a_stop(spark, tmp_path):
    from tempestry.sources.backfill import Backfill, chunks

    assert chunks(3, 9, 3) == [(3, 5), (6, 8), (9, 9)]
    rng, p = random.Random(4), Profile()
    rows = []
    for s in ("Toronto", "Ottawa"):
        for k in range(24 * 9):
            rows.append(reading(k, s, id=k + (s == "Ottawa") * 1000, wind_gusts_10m=rng.choice([20.0, 95.0, 120.0]), temperature_2m=rng.choice([20.0, 20.0, 29.0])))
    archive = spark.createDataFrame(rows + rows[:50], READING).persist()
    detect = lambda df, new=None: D.detect(prepared(spark, df) if new is None else prepared(spark, df).join(new, ["station", "t"], "left_semi"), p, D.REGISTRY[:8])
    want = lifecycle.incidents(detect(archive.distinct()), archive.distinct(), p)
    last = T0 // 86400
    fill = Backfill(spark, str(tmp_path / "fill"), READING, FOUND, lambda a, z: archive, detect, p)
    assert fill.run(last - 9, last, 4, stop_before=last - 5) == [last - 9]
    # a chunk that was lost half-way: its readings are there, the ledger doesn't know it
    fill.readings.write(archive.filter(F.floor(F.col("t") / 86400) == last - 5).limit(3), last - 5)
    assert fill.run(last - 9, last, 4) == [last - 5, last - 1] and fill.run(last - 9, last, 4) == []
    assert told(fill.events().collect()) == told(want.collect()) and fill.readings.before().count() == 2 * 24 * 9


def test_merged_ids_keep_their_order(spark):
    row = lambda t, ids: ("a", t, t, "d", 0, "x", 2.0, 20.0, "info", 1.0, {"v": 1.0}, ids, "a|x")
    cands = [row(0, [7, 3]), row(3600, [3, 9]), row(7200, [1, 7])]
    out = lifecycle.incidents(spark.createDataFrame(cands, CANDIDATE), spark.createDataFrame([("a", k * 3600) for k in range(3)], "station string, t long"))
    assert [r.supporting_ids for r in out.collect()] == [[7, 3, 9, 1]]


def test_own_detectors_and_headlines(spark):
    rows = prepared(spark, [reading(0, temperature_2m=28.0), *history(h3={"temperature_2m": 22.0})])
    own = lambda df, p: df.filter(F.col("t") == T0).select("station", "t", "id", F.lit("own").alias("detector"))
    got = {r.detector: r for r in D.detect(rows, Profile(), (D.temperature_shock, D.warm_spell, own)).filter(F.col("t") == T0).withColumn("names", F.map_keys("signals")).collect()}
    assert set(got) == {"temperature_shock", "warm_spell", "own"}
    shock = got["temperature_shock"]
    assert shock.reason == "Toronto saw a warming temperature shock: 28.0C is 4.0 sigma from the local-hour baseline and changed +6.0C in 3h."
    assert shock.names[:3] == ["value", "median", "scale"] and shock.notes["direction"] == "warming" and shock.supporting_ids == [1000, 1003]
    e = spark.range(1).select(S.explanation(F.lit("x"), F.create_map(F.lit("b"), F.lit(2.0), F.lit("a"), F.lit(None).cast("double"), F.lit("c"), F.lit(1.5)), 2).alias("e")).first().e
    assert (e.headline, e.evidence) == ("x", "b=2.0, a=none")


def test_histogram_over_the_range(spark):
    rows = spark.createDataFrame([(0.0,), (1.0,), (2.9,), (3.0,), (None,)], "v double")
    assert [r.n for r in E.range_histogram(rows, "v", 3).orderBy("bin").collect()] == [1, 1, 2]
    assert [r.n for r in E.range_histogram(rows.filter("v = 1"), "v", 2).orderBy("bin").collect()] == [0, 1]
    assert E.range_histogram(rows.limit(0), "v", 2).count() == 0


@pytest.mark.parametrize("shocks", [[], [3.25], [3.0, 3.1, 4.5, 6.0]])
def test_histogram_of_few_shocks_agrees_with_its_sql(spark, shocks):
    db = duckdb.connect()
    db.sql("CREATE TABLE d1 (strength DOUBLE)")
    for z in shocks:
        db.execute("INSERT INTO d1 VALUES (?)", [z])
    found = E.range_histogram(spark.createDataFrame([(z,) for z in shocks], "z double"), "z").withColumn("low", F.round("low", 6))
    assert sorted(map(tuple, found.collect())) == sorted(db.sql(catalog.Z_HISTOGRAM).fetchall())
    assert found.count() == (30 if shocks else 0)


def test_zero_as_text_has_no_sign(spark):
    below = [-0.04, -0.0, 0.0, 0.04, -0.06, -1.25]
    got = [r.x for r in spark.createDataFrame([(k, v) for k, v in enumerate(below)], "k int, v double").orderBy("k").select(D.one(F.col("v")).alias("x")).collect()]
    assert got == ["0.0", "0.0", "0.0", "0.0", "-0.1", "-1.2"]
    assert got == [duckdb.sql(f"SELECT {sql._one(repr(v))}").fetchall()[0][0] for v in below]
    assert duckdb.sql("SELECT " + sql._text(sql._p3("-0.0004"))).fetchall()[0][0] == "0.0"


def test_events_are_read_once_for_all_uses_of_the_readings(spark, tmp_path):
    def land(n):
        rows = spark.range(n).select(F.col("id").alias("event_id"), F.timestamp_seconds(1704067200 + F.col("id") * 900).alias("ts"), F.lit(7).alias("user_id"), F.lit("click").alias("event_type"), (F.col("id") * 1.25).alias("value"))
        rows.write.mode("overwrite").parquet(f"{tmp_path}/events.parquet")

    told = lambda df: sorted(map(str, df.collect()))
    land(40)
    first = views.hourly(spark, str(tmp_path))
    uses = [first, views.hourly(spark, str(tmp_path)), views.forecasts(spark, str(tmp_path))]
    assert not any("events.parquet" in f for df in uses for f in df.inputFiles())
    assert {f for df in uses for f in df.inputFiles()} == set(first.inputFiles())
    assert told(first) == told(views.readings(spark, str(tmp_path))) and first.count() == 10
    land(80)  # other files, other readings
    assert told(views.hourly(spark, str(tmp_path))) == told(views.readings(spark, str(tmp_path))) and views.hourly(spark, str(tmp_path)).count() == 20


def test_feeds(spark):
    rows = spark.createDataFrame([("a", 1, 1.0), ("a", 1, 2.0), ("a", 2, 3.0), ("b", 2, 4.0)], "station string, t long, v double")
    assert [r.v for r in feeds.feed(rows, "t", "a", 1, 2, 2).collect()][0] == 3.0
    with pytest.raises(ValueError):
        feeds.feed(rows, "t", limit=5001)
    first = feeds.dedupe_first(rows, ["station", "t"], ["v"], rows.filter("station = 'b'"))
    assert sorted(r.v for r in first.collect()) == [1.0, 3.0]


def test_quality_and_wilson(spark):
    row = E.detection_quality(spark.createDataFrame([("s", ["a", "b"], ["b", "c"])], "scenario string, expected array<string>, got array<string>")).first()
    assert (row.tp, row.fp, row.fn) == (1, 1, 1)
    low, high = E.wilson(F.lit(8.0), F.lit(15.0))
    r = spark.range(1).select(low.alias("l"), high.alias("h")).first()
    assert (round(r.l, 2), round(r.h, 2)) == (0.30, 0.75)


def test_record_needs_a_new_extreme(spark):
    rows = [reading(0, temperature_2m=30.0), *history()]
    assert [r.dedupe_key for r in legacy.record(spark.createDataFrame(rows, READING)).collect()] == ["Toronto|fun_fact|temperature_2m|warm_record"]
    unknown = [reading(0, temperature_2m=30.0), *history(14, h1={"temperature_2m": None})]
    assert legacy.record(spark.createDataFrame(unknown, READING)).count() == 0  # the previous reading has no value
    again = [reading(0, temperature_2m=31.0), *history(h1={"temperature_2m": 30.0})]
    assert [r.t for r in legacy.record(spark.createDataFrame(again, READING)).collect()] == []


def test_registered_queries_have_sql():
    import __spark_entry__ as entry

    known, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(known) and len(known) > 80


def test_change_rules_are_registered_for_every_metric():
    from tempestry.operators import legacy
    from tempestry.plans import catalog

    for name in ("d11_rapid_change", "d12_sustained_extreme"):
        for metric in legacy.CHANGE_METRICS:
            query = name if metric == "temperature_2m" else f"{name}_{metric}"
            assert query in catalog.QUERIES and f"'{metric}' AS metric" in catalog.ORACLES[query]


@pytest.mark.parametrize("rest,bins", [(1 << 20, 256), (0, 4), (7, 3)])
def test_percentiles_by_narrowing(spark, rest, bins):
    import numpy as np

    from tempestry.operators import selection

    rng = np.random.default_rng(2)
    groups = {
        "normal": rng.standard_normal(3001), "ties": rng.integers(0, 3, 500).astype(float), "one": np.array([7.5]), "two": np.array([1.0, 2.0]), "same": np.full(100, -3.0),
        "far": np.array([*rng.standard_normal(300), 1e300, -1e300, 1.7e308, -1.7e308]), "tiny": rng.standard_normal(400) * 1e-300,
    }
    marks = {k: [0.0, 0.005, 0.25, 0.5, 0.9, 0.9999, 1.0] for k in (*groups, "absent")}
    rows = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs] + [("normal", None), ("other", 1.0)], "key string, v double").repartition(5)
    sizes, got = selection.percentiles(rows, marks, bins, rest)
    assert sizes == {k: len(v) for k, v in groups.items()}
    for (key, q), v in got.items():
        a = np.sort(groups[key])
        at = q * (len(a) - 1)
        want = a[int(at)] + (at - int(at)) * (a[min(int(at) + (at > int(at)), len(a) - 1)] - a[int(at)])
        assert v == pytest.approx(want, rel=1e-12), (key, q)
    assert selection.percentiles(rows.limit(0), marks) == ({}, {})


def test_checks_totals_and_conditional_recall(spark):
    day = 86400
    rows = [("a", "x", "m", 10 * day - 1, "warning", 40.0), ("a", "x", "m", 10 * day, "severe", 70.0), ("a", "x", "m", 12 * day + 5, "severe", 70.0), ("a", "x", "m", 11 * day, "info", 90.0), ("b", "x", "m", 10 * day, "severe", 99.0), ("a", "y", "m", 11 * day, "severe", 99.0)]
    incidents = spark.createDataFrame(rows, "station string, detector string, metric string, onset_t long, severity string, priority_score double")
    checks = spark.createDataFrame([(1, "a", "x", 10 * day, 12 * day + 5), (2, "a", "x", 10 * day, 10 * day), (3, "c", "x", 0, 99 * day), (4, "a", "x", 12 * day + 6, 12 * day + 9)], "check_id int, station string, kind string, from_t long, until_t long")
    got = {r.check_id: (r.n, r.passed, r.best, r.onset_t) for r in E.spot_checks(incidents, checks).collect()}
    assert got == {1: (2, True, 70.0, 10 * day), 2: (1, True, 70.0, 10 * day), 3: (0, False, None, None), 4: (0, False, None, None)}
    quality = spark.createDataFrame([("s", 2, 1, 0), ("u", 1, 0, 3)], "scenario string, tp int, fp int, fn int")
    assert tuple(E.detection_totals(quality).first()) == (3, 1, 3, 0.75, 0.5)
    assert tuple(E.detection_totals(quality.limit(0).unionByName(spark.createDataFrame([("v", 0, 0, 0)], quality.schema))).first())[3:] == (1.0, 1.0)
    hits = spark.createDataFrame([(1, True), (2, False), (3, False)], "label_id int, expected_hit boolean")
    misses = spark.createDataFrame([(2, "resolution FN"), (3, "genuine gap")], "label_id int, verdict string")
    assert tuple(E.conditional_recall(hits, misses).first()) == (3, 1, 1, 0.333333, 0.5)


def test_forecasts_are_kept_with_new_readings_only(spark):
    arrivals = spark.createDataFrame([("a", 0, 1, 100, 3), ("a", 0, 2, 100, 5), ("a", 1, 3, 100, 4), ("a", 2, 4, 200, 1), ("a", 3, 5, 300, 12), ("a", 4, 6, 400, 3)], "station string, t long, polled long, target_t long, lead_hours int")
    known = spark.createDataFrame([("a", 4)], "station string, t long")
    got = feeds.forecasts_of_new(arrivals, ["station", "t"], ["polled"], Profile(), known).collect()
    assert sorted((r.t, r.target_t) for r in got) == [(0, 100), (3, 300)]  # a repeat, a later one for 100, a short lead, a known reading
