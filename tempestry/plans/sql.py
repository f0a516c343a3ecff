"""DuckDB SQL of the station views and of the steps that many checks share, written from the definitions.

`with_(*names, body)` puts the needed steps before a query.
"""

from __future__ import annotations

import re

STEP: dict[str, str] = {}

STEP["v1"] = """
SELECT station, t, c_sum/n/250.0 - shift AS temperature_2m, c_sum/n/200.0 - shift AS apparent_temperature, c_sum/n/400.0 AS dew_point_2m,
  CASE WHEN c_max > 12000.0 THEN (c_max-12000.0)/1000.0 ELSE 0.0 END AS precipitation, c_min/100.0 AS wind_speed_10m, c_max/250.0 AS wind_gusts_10m,
  1020.0 - c_sum/2000.0 AS pressure_msl, CASE WHEN n >= 6 THEN 95 WHEN n >= 4 THEN 63 WHEN n >= 2 THEN 51 ELSE 0 END AS weather_code
FROM (SELECT event_type AS station, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS t, CAST(count(*) AS DOUBLE) AS n, CASE event_type WHEN 'error' THEN 35.0::DOUBLE WHEN 'view' THEN 10.0::DOUBLE ELSE 0.0::DOUBLE END AS shift,
    CAST(sum(CAST(round(value*100) AS BIGINT)) AS DOUBLE) AS c_sum, CAST(max(CAST(round(value*100) AS BIGINT)) AS DOUBLE) AS c_max, CAST(min(CAST(round(value*100) AS BIGINT)) AS DOUBLE) AS c_min
  FROM events GROUP BY ALL)"""
STEP["v2"] = """
SELECT r_name AS station, CAST(epoch(date_trunc('day', l_shipdate)) AS BIGINT) AS t, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE)/CAST(count(*) AS DOUBLE) AS temperature_2m,
  CASE WHEN max(l_quantity) > 45.0 THEN CAST(max(l_quantity) AS DOUBLE) - 45.0 ELSE 0.0 END AS precipitation, CAST(max(l_quantity) AS DOUBLE) + CAST(count(*) AS DOUBLE) AS wind_gusts_10m,
  1000.0 + CAST(sum(CAST(round(l_discount*100) AS BIGINT)) AS DOUBLE)/CAST(count(*) AS DOUBLE) AS pressure_msl
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL"""
STEP["v3"] = """
SELECT CAST(event_id AS BIGINT) AS reading_id, CAST(user_id % 20 AS VARCHAR) AS station, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS t, epoch_us(ts) AS polled_at, value AS temperature_2m FROM events"""
STEP["v4"] = """
SELECT * FROM (VALUES ('click','America/Toronto','A'),('error','America/Toronto','A'),('view','America/Vancouver','A'),('signup','America/Vancouver','A'),('purchase','UTC','A'),
 ('AFRICA','UTC','R'),('AMERICA','America/Toronto','R'),('ASIA','UTC','R'),('EUROPE','UTC','R'),('MIDDLE EAST','UTC','R')) AS s(station, tz, peer_group)"""
STEP["v5"] = """
SELECT station, t + 86400 AS target_t, CAST(1 + (((t // 3600) % 24) * 7 + length(station)) % 14 AS INT) AS lead_hours, temperature_2m, precipitation, wind_speed_10m, wind_gusts_10m, pressure_msl, weather_code FROM v1"""
STEP["v6"] = """
SELECT label_id, station, epoch(CAST(a AS TIMESTAMP))::BIGINT - 86400 AS from_t, epoch(CAST(b AS TIMESTAMP))::BIGINT + 2*86400 - 1 AS until_t, expected_type FROM (VALUES
 (1,'click','2024-01-22','2024-01-22','heavy_rain_burst'),(1,'click','2024-01-22','2024-01-22','wind_gust_burst'),(2,'error','2024-01-23','2024-01-26','cold_stress'),
 (2,'error','2024-01-23','2024-01-26','cold_spell'),(3,'view','2024-01-25','2024-01-25','temperature_shock'),(4,'signup','2024-01-27','2024-01-28','heat_stress'),
 (4,'signup','2024-01-27','2024-01-28','warm_spell'),(5,'purchase','2024-01-24','2024-01-24','pressure_plunge'),(6,'purchase','2024-01-29','2024-01-29','spatial_anomaly')) AS x(label_id, station, a, b, expected_type)"""
STEP["v7"] = """
SELECT check_id, station, kind, epoch(CAST(day AS TIMESTAMP))::BIGINT - 2*86400 AS from_t, epoch(CAST(day AS TIMESTAMP))::BIGINT + 3*86400 - 1 AS until_t FROM (VALUES
 (1,'purchase','pressure_plunge','2024-01-24'),(2,'click','wind_gust_burst','2024-01-22'),(3,'error','cold_stress','2024-01-24'),
 (4,'signup','heat_stress','2024-01-27'),(5,'view','temperature_shock','2024-01-25'),(6,'view','heavy_rain_burst','2024-01-03')) AS x(check_id, station, kind, day)"""
STEP["eps"] = """
SELECT * FROM (VALUES ('temperature_2m', 0.5::DOUBLE), ('precipitation', 0.1::DOUBLE), ('wind_gusts_10m', 1.0::DOUBLE), ('pressure_msl', 0.5::DOUBLE)) AS e(metric, eps)"""


def _local(source: str) -> str:
    return f"""
SELECT r.*, dayofyear(w) AS doy, month(w) AS month, hour(w) AS hour FROM (SELECT x.*, timezone(tz, timezone('UTC', make_timestamp(x.t * 1000000))) AS w FROM {source} x LEFT JOIN v4 USING (station)) r"""


def _values(source: str, where: str = "true") -> str:
    one = "SELECT station, t, doy, month, hour, '{0}' AS metric, {0} AS v FROM {1} WHERE {0} IS NOT NULL AND {2}"
    return " UNION ALL ".join(one.format(m, source, where) for m in ("temperature_2m", "precipitation", "wind_gusts_10m", "pressure_msl"))


def _stats(vals: str, keys: str) -> str:
    k = f"station, {keys}metric"
    return f"""
SELECT {k}, n, median, mad, scale FROM (
  SELECT {k}, any_value(n) AS n, round(any_value(m) + 1e-9, 4) AS median, round(median(abs(v - m)) + 1e-9, 4) AS mad, round(greatest(1.4826 * median(abs(v - m)), any_value(eps)) + 1e-9, 4) AS scale
  FROM {vals} JOIN (SELECT {k}, count(*) AS n, median(v) AS m FROM {vals} GROUP BY ALL) USING ({k}) JOIN eps USING (metric) GROUP BY {k})"""


def _smooth(vals: str) -> str:
    return f"SELECT station, (doy - 1 + d + 366) % 366 + 1 AS doy, hour, metric, v FROM {vals}, range(-15, 16) AS x(d) WHERE doy IS NOT NULL"


def _wet(vals: str, keys: str) -> str:
    marks = ", ".join(f"round(quantile_cont(v, {m / 100}) FILTER (WHERE v >= 0.1) + 1e-9, 4) AS p{m}" for m in (50, 75, 90, 95, 99))
    return f"SELECT station, {keys}count(*) AS total_count, count(*) FILTER (WHERE v >= 0.1) AS wet_count, {marks} FROM {vals} WHERE metric = 'precipitation' GROUP BY ALL"


def _residuals(vals: str, stats: str, keys: str) -> str:
    return f"SELECT metric, (v - median) / greatest(scale, eps) AS v FROM {vals} JOIN {stats} USING (station, {keys}, metric) JOIN eps USING (metric)"


def _thresholds(rest: str) -> str:
    return f"SELECT metric, count(*) AS n, round(quantile_cont(v, 0.995) + 1e-9, 4) AS upper_z, round(quantile_cont(v, 0.005) + 1e-9, 4) AS lower_z, round(quantile_cont(abs(v), 0.995) + 1e-9, 4) AS abs_z FROM {rest} GROUP BY metric"


def _tails(rows: str) -> str:
    ups, lows = [90.0, 95.0, 97.5, 99.0, 99.5, 99.9, 99.95, 99.99], [10.0, 5.0, 2.5, 1.0, 0.5, 0.1, 0.05, 0.01]
    parts = [f"SELECT metric, '{kind}' AS kind, {i} AS k, round(quantile_cont(v, {x / 100!r}) + 1e-9, 4) AS v, {round((100 - x if kind == 'upper' else x) / 100, 6)!r}::DOUBLE AS p FROM {rows} GROUP BY metric" for kind, xs in (("upper", ups), ("lower", lows)) for i, x in enumerate(xs)]
    return " UNION ALL ".join(parts)


def _accumulations(source: str) -> str:
    return f"""
SELECT station, t, v FROM (SELECT station, t, sum(coalesce(precipitation, 0.0)) OVER w AS v, lag(t, 5) OVER (PARTITION BY station ORDER BY t) AS f FROM {source}
  WINDOW w AS (PARTITION BY station ORDER BY t ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)) WHERE t - f = 18000 AND v >= 0.1"""


TRAIN1, TRAIN2 = 1705795200, 915148800  # 2024-01-21, 1999-01-01
for n, train in (("1", TRAIN1), ("2", TRAIN2)):
    STEP[f"loc{n}"] = _local(f"v{n}")
    STEP[f"val{n}"] = _values(f"loc{n}", f"t < {train}")
    STEP[f"near{n}"] = _smooth(f"val{n}")
    STEP[f"smooth{n}"] = _stats(f"near{n}", "doy, hour, ")
    STEP[f"mh{n}"] = _stats(f"val{n}", "month, hour, ")
    STEP[f"mo{n}"] = _stats(f"val{n}", "month, ")
    STEP[f"city{n}"] = _stats(f"val{n}", "")
    STEP[f"wetsmooth{n}"] = _wet(f"near{n}", "doy, hour, ")
    STEP[f"wetmh{n}"] = _wet(f"val{n}", "month, hour, ")
    STEP[f"wetmo{n}"] = _wet(f"val{n}", "month, ")
    STEP[f"wetcity{n}"] = _wet(f"val{n}", "")
    STEP[f"rest{n}"] = _residuals(f"val{n}", f"smooth{n}", "doy, hour")
    STEP[f"restmh{n}"] = _residuals(f"val{n}", f"mh{n}", "month, hour")
    STEP[f"thr{n}"] = _thresholds(f"rest{n}")
    STEP[f"thrmh{n}"] = _thresholds(f"restmh{n}")
    STEP[f"acc{n}"] = _accumulations(f"(SELECT * FROM v{n} WHERE t < {train})")
    more = f"SELECT 'rain', v FROM val{n} WHERE metric = 'precipitation' AND v >= 0.1 UNION ALL SELECT 'rain_6h', v FROM acc{n}"
    STEP[f"thrall{n}"] = _thresholds(f"(SELECT * FROM rest{n} UNION ALL {more})")
    STEP[f"thrmhall{n}"] = _thresholds(f"(SELECT * FROM restmh{n} UNION ALL {more})")
    STEP[f"tailmh{n}"] = _tails(f"(SELECT * FROM restmh{n} UNION ALL {more})")
    STEP[f"tail{n}"] = _tails(
        f"(SELECT * FROM rest{n} UNION ALL SELECT 'rain', v FROM val{n} WHERE metric = 'precipitation' AND v >= 0.1 UNION ALL SELECT 'rain_6h', v FROM acc{n})"
    )

_near = """(SELECT min({{'off': abs(b.t - (a.t - 10800)), 'late': -b.t, 'v': b.{m}}}) FROM v1p b WHERE b.station = a.station AND b.{m} IS NOT NULL AND b.t BETWEEN a.t - 13500 AND a.t - 8100).v"""
STEP["v1p"] = "SELECT *, pressure_msl AS pressure FROM v1"
STEP["delta"] = "SELECT station, t, " + ", ".join(f"a.{m} - {_near.format(m=m)} AS {m}_delta" for m in ("temperature_2m", "pressure", "wind_gusts_10m", "wind_speed_10m")) + " FROM v1p a"
STEP["hist"] = """
SELECT l.*, d.* EXCLUDE (station, t), count(*) OVER (PARTITION BY l.station ORDER BY l.t RANGE BETWEEN 1209600 PRECEDING AND 1 PRECEDING) AS history_n,
  sum(coalesce(precipitation, 0.0)) OVER (PARTITION BY l.station ORDER BY l.t RANGE BETWEEN 21599 PRECEDING AND CURRENT ROW) AS accumulation_6h,
  quantile_cont(pressure_delta, 0.05) OVER (PARTITION BY l.station ORDER BY l.t RANGE BETWEEN 1198800 PRECEDING AND 1 PRECEDING) AS p05_delta,
  count(pressure_delta) OVER (PARTITION BY l.station ORDER BY l.t RANGE BETWEEN 1198800 PRECEDING AND 1 PRECEDING) AS n_deltas
FROM loc1 l JOIN delta d ON d.station = l.station AND d.t = l.t"""


def _lookup(metric: str, levels: tuple) -> tuple[str, str]:
    joins, coal = "", []
    for level, keys in levels:
        on = "".join(f" AND {level}_{metric}.{k} = h.{k}" for k in keys.split())
        least = "" if level == "city1" else f" AND {level}_{metric}.n >= 10"
        joins += f" LEFT JOIN {level} {level}_{metric} ON {level}_{metric}.metric = '{metric}' AND {level}_{metric}.station = h.station{on}{least}"
        coal.append(level)
    cols = ", ".join(f"coalesce({', '.join(f'{lv}_{metric}.{c}' for lv in coal)}) AS {metric}_{c}" for c in ("median", "scale", "n"))
    names = {"smooth1": "smooth", "mh1": "month_hour", "mo1": "month", "city1": "city"}
    bucket = "CASE " + " ".join(f"WHEN {lv}_{metric}.n IS NOT NULL THEN '{names[lv]}'" for lv in coal) + f" END AS {metric}_bucket"
    return cols + ", " + bucket, joins


def _wet_lookup(levels: tuple) -> tuple[str, str]:
    """The same ladder on wet hours."""
    steps = [(f"wet{level}", keys) for level, keys in levels]
    joins = ""
    for level, keys in steps:
        on = "".join(f" AND {level}.{k} = h.{k}" for k in keys.split())
        joins += f" LEFT JOIN {level} ON {level}.station = h.station{on}{'' if level == 'wetcity1' else f' AND {level}.wet_count >= 10'}"
    parts = {"wet_count": "wet_count", "total_count": "total_count", **{f"p{m}": f"wet_p{m}" for m in (50, 75, 90, 95, 99)}}
    cols = ", ".join(f"coalesce({', '.join(f'{lv}.{c}' for lv, _ in steps)}) AS {name}" for c, name in parts.items())
    names = {"wetsmooth1": "smooth", "wetmh1": "month_hour", "wetmo1": "month", "wetcity1": "city"}
    return cols + ", CASE " + " ".join(f"WHEN {lv}.total_count IS NOT NULL THEN '{names[lv]}'" for lv, _ in steps) + " END AS wet_bucket", joins


_Z = ("temperature_2m", "wind_gusts_10m", "pressure_msl")
_eps = {"temperature_2m": 0.5, "wind_gusts_10m": 1.0, "pressure_msl": 0.5}
_LEVELS = (("smooth1", "doy hour"), ("mh1", "month hour"), ("mo1", "month"), ("city1", ""))


def _features(v: str, levels: tuple, thresholds: str) -> None:
    """The steps look, zed and feat of a variant: its fallback ladder and the thresholds its gates come from."""
    found = [*[_lookup(m, levels) for m in _Z], _wet_lookup(levels)]
    STEP[f"look{v}"] = f"SELECT h.*, {', '.join(x[0] for x in found)} FROM hist h {' '.join(x[1] for x in found)}"
    STEP[f"zed{v}"] = "SELECT *, " + ", ".join(f"({m} - {m}_median) / greatest({m}_scale, {_eps[m]}::DOUBLE) AS {m}_z" for m in _Z) + f" FROM look{v}"
    STEP[f"feat{v}"] = (
        "SELECT *, "
        + ", ".join(f"CASE WHEN {m}_z IS NULL THEN 0.0 WHEN {m}_bucket IN ('smooth', 'month_hour') THEN 1.0 WHEN {m}_bucket = 'month' THEN 0.55 WHEN {m}_n >= 10 THEN 0.35 ELSE 0.2 END::DOUBLE AS {m}_conf" for m in _Z)
        + ", "
        + ", ".join(f"(SELECT {s}_z FROM {thresholds} WHERE metric = '{m}') AS gate_{m}_{s}" for m in _Z for s in ("upper", "lower"))
        + f", (SELECT round(quantile_cont(v, 0.995) + 1e-9, 4) FROM val1 WHERE metric = 'precipitation' AND v >= 0.1) AS wet_p995 FROM zed{v}"
    )


_features("", _LEVELS, "thr1")
_features("_m", _LEVELS[1:], "thrmh1")


def rarity(metric: str, kind: str, x: str) -> str:
    """Scalar subquery: surprisal of the tail at abs(x) on [0, 1]."""
    a = f"(SELECT list({{'s': abs(v), 'p': p}} ORDER BY abs(v), v, p) FROM tail1 WHERE metric = '{metric}' AND kind = '{kind}')"
    return f"""rar({a}, abs({x}))"""


def expand(sql: str) -> str:
    """Replace rar(anchors, x) by its CASE expression over correlated lists."""
    out = sql
    while "rar(" in out:
        i = out.index("rar(")
        depth, j, parts, start = 1, i + 4, [], i + 4
        while depth:
            c = out[j]
            depth += c in "([{"
            depth -= c in ")]}"
            if (c == "," and depth == 1) or not depth:
                parts.append(out[start:j])
                start = j + 1
            j += 1
        a, x = parts
        below = f"[q FOR q IN {a} IF q.s <= {x}]"
        above = f"[q FOR q IN {a} IF q.s > {x}]"
        ln = lambda p: f"ln(greatest({p}, 0.0001::DOUBLE))"
        lo, hi = f"({below})[-1]", f"({above})[1]"
        prob = f"(CASE WHEN len({below}) = 0 THEN ({a})[1].p WHEN len({above}) = 0 THEN {lo}.p ELSE exp({ln(lo + '.p')} + ({ln(hi + '.p')} - {ln(lo + '.p')}) * ({x} - {lo}.s) / ({hi}.s - {lo}.s)) END)"
        out = out[:i] + f"(CASE WHEN {x} IS NOT NULL THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE, -ln(greatest({prob}, 0.0001::DOUBLE)) / -ln(0.0001::DOUBLE))) END)" + out[j:]
    return out


def score(**inputs: str) -> str:
    weights = {"rarity": 0.30, "magnitude": 0.20, "persistence": 0.15, "compound": 0.10, "forecast_surprise": 0.10, "spatial": 0.10, "confidence": 0.05}
    total = "0.0::DOUBLE"
    for name, w in weights.items():
        if name in inputs:
            total += f" + {w}::DOUBLE * greatest(0.0::DOUBLE, least(1.0::DOUBLE, {inputs[name]}))"
    return f"round(greatest(0.0::DOUBLE, least(100.0::DOUBLE, ({total}) * 100.0)), 3)"


SEVERITY = "CASE WHEN score < 30 THEN 'info' WHEN score < 60 THEN 'warning' ELSE 'severe' END AS severity"


def _p3(x: str) -> str:
    return f"round(({x})::DOUBLE + 1e-9, 3)"


def _text(x: str) -> str:
    """A rounded number as text; zero has no sign, also if what was rounded lay below it."""
    return f"CAST({x} + 0.0::DOUBLE AS VARCHAR)"


def _one(x: str) -> str:
    """A number to one place, as text."""
    return _text(f"round(({x})::DOUBLE + 1e-9, 1)")


def candidate(kind: str, order: int, source: str, where: str, metric: str, strength: str, confidence: str, inputs: dict, reason: str, first3: dict, useful: tuple[str, str]) -> str:
    """One detector's rows (station, t, detector, detector_order, metric, strength, score, severity, reason, evidence, label)."""
    evidence = " || ', ' || ".join(f"'{k}=' || coalesce({_text(_p3(x))}, 'none')" for k, x in first3.items())
    return f"""SELECT *, {SEVERITY} FROM (SELECT station, t, '{kind}' AS detector, {order} AS detector_order, {metric} AS metric, round({strength} + 1e-9, 3) AS strength, {score(**inputs, confidence=confidence)} AS score,
  {reason} AS reason, {evidence} AS evidence, CASE WHEN {useful[0]} THEN 'useful' WHEN {useful[1]} THEN 'borderline' ELSE 'noise' END AS label
  FROM {source} WHERE history_n >= 12 AND ({where}))"""


_T, _G = "temperature_2m", "wind_gusts_10m"
HUMIDEX = "(temperature_2m + 0.5555::DOUBLE * (6.11::DOUBLE * exp(5417.7530::DOUBLE * (1 / 273.16::DOUBLE - 1 / (273.15::DOUBLE + dew_point_2m))) - 10.0))"
CHILL = "(CASE WHEN temperature_2m <= 10.0 AND wind_speed_10m > 4.8 THEN 13.12::DOUBLE + 0.6215::DOUBLE * temperature_2m - 11.37::DOUBLE * pow(wind_speed_10m, 0.16::DOUBLE) + 0.3965::DOUBLE * temperature_2m * pow(wind_speed_10m, 0.16::DOUBLE) END)"
_FM = {"temperature_2m": (1.0, 8.0), "precipitation": (1.0, 10.0), "wind_speed_10m": (3.0, 30.0), "wind_gusts_10m": (5.0, 40.0), "pressure_msl": (1.0, 12.0)}
STEP["pairs"] = """
SELECT v1.station, v1.t, lead_hours, """ + ", ".join(f"v1.{m}, v5.{m} AS fcst_{m}" for m in _FM) + """
FROM v1 JOIN v5 ON v5.station = v1.station AND v5.target_t = v1.t WHERE lead_hours BETWEEN 3 AND 12"""
STEP["newest"] = """
SELECT a.t AS at, p.*, row_number() OVER (PARTITION BY a.t ORDER BY p.t DESC, p.station) AS k FROM (SELECT DISTINCT t FROM v1) a JOIN pairs p ON p.t >= a.t - 1209600 AND p.t < a.t"""
STEP["mae"] = (
    "SELECT a.t, "
    + ", ".join(f"greatest(coalesce(avg(abs(n.{m} - n.fcst_{m})), {f}::DOUBLE), {f}::DOUBLE) AS {m}_mae, count(abs(n.{m} - n.fcst_{m})) AS {m}_pairs" for m, (f, _) in _FM.items())
    + " FROM (SELECT DISTINCT t FROM v1) a LEFT JOIN newest n ON n.at = a.t AND n.k <= 200 GROUP BY a.t"
)
STEP["seqd"] = "SELECT station, t, row_number() OVER (PARTITION BY station ORDER BY t) AS seq FROM v1"


def _rain(feat: str, quantile: str, clipped: bool) -> str:
    """Heavy rain: the gate is `quantile`, else the bucket's 95th percentile of wet hours, and 10 mm at least."""
    known = f"coalesce({quantile}, wet_p95)"
    hg = f"(CASE WHEN {known} IS NOT NULL THEN greatest({known}, 10.0::DOUBLE) END)"
    tg = f"(CASE WHEN {known} IS NOT NULL THEN greatest({hg}, 12.5::DOUBLE) END)"
    amount, total = "coalesce(precipitation, 0.0)", "accumulation_6h"
    trust = "greatest(0.8::DOUBLE, CASE WHEN wet_bucket IN ('smooth', 'month_hour') THEN 1.0 WHEN wet_bucket = 'month' THEN 0.55 WHEN wet_bucket = 'city' THEN CASE WHEN wet_count >= 10 THEN 0.35 ELSE 0.2 END ELSE 0.0 END::DOUBLE)"
    return candidate(
        "heavy_rain_burst", 4, feat, f"{amount} >= 0.1 AND ({amount} >= {hg} OR {total} >= {tg})", "'precipitation'", f"greatest({amount}, {total})", trust,
        {
            "rarity": "1.0" if clipped else f"greatest({rarity('rain', 'upper', amount)}, {rarity('rain_6h', 'upper', total)})",
            "magnitude": f"greatest({amount}, {total}) / 20.0" if clipped else f"greatest({amount} / 25.0, {total} / 50.0)",
            "persistence": f"{total} / 15.0", "compound": f"CASE WHEN {total} >= {tg} THEN 1.0 ELSE 0.5 END",
        },
        f"station || ' has a heavy rain burst: ' || {_one(amount)} || ' mm this hour and ' || {_one(total)} || ' mm over 6h exceeds the wet-hour threshold of ' || {_one(hg)} || ' mm.'",
        {"amount_mm": amount, "accumulation_mm": total, "difference": f"greatest({amount}, {total})"},
        (f"{_p3(amount)} >= 15 OR {_p3(total)} >= 20", f"{_p3(amount)} >= 10 OR {_p3(total)} >= 15"),
    )


def _detectors(v: str, feat: str, clipped: bool) -> None:
    """The steps from features to incidents of a variant; clipped: without surprisal."""

    def rare(metric: str, kind: str, x: str) -> str:
        return f"least(abs({x}) / 4.0, 1.0)" if clipped else rarity(metric, kind, x)

    shock_gate = f"abs(CASE WHEN {_T}_z >= 0 THEN coalesce(gate_{_T}_upper, 3.0) ELSE coalesce(gate_{_T}_lower, -3.0) END)"
    z, dt = f"abs({_T}_z)", f"{_T}_delta"
    STEP[f"d1{v}"] = candidate(
        "temperature_shock", 0, feat, f"{z} >= {shock_gate} AND abs({dt}) >= 5", f"'{_T}'", z, f"{_T}_conf",
        {"rarity": f"CASE WHEN {_T}_z >= 0 THEN {rare(_T, 'upper', _T + '_z')} ELSE {rare(_T, 'lower', _T + '_z')} END", "magnitude": f"abs({dt}) / 6.0", "compound": "0.5"},
        f"station || ' saw a ' || CASE WHEN {dt} > 0 THEN 'warming' ELSE 'cooling' END || ' temperature shock: ' || {_one(_T)} || 'C is ' || {_one(z)} || ' sigma from the local-hour baseline and changed ' || CASE WHEN {dt} >= 0 THEN '+' ELSE '' END || {_one(dt)} || 'C in 3h.'",
        {"value": _T, "median": f"{_T}_median", "scale": f"{_T}_scale"}, (f"{_p3(z)} >= 4 AND abs({_p3(dt)}) >= 8", f"{_p3(z)} >= 3.5"),
    )
    fall, req = "(-pressure_delta)", "greatest(6.0::DOUBLE, abs(least(0.0::DOUBLE, p05_delta)))"
    rise = "coalesce(wind_gusts_10m_delta, wind_speed_10m_delta)"
    wind = "CASE WHEN wind_gusts_10m_delta IS NOT NULL THEN wind_gusts_10m WHEN wind_speed_10m_delta IS NOT NULL THEN wind_speed_10m END"
    STEP[f"d2{v}"] = candidate(
        "pressure_plunge", 1, feat, f"{fall} > 0 AND n_deltas >= 6 AND {fall} >= {req} AND ({rise} >= 8 OR {wind} >= 60)", "'pressure_msl'", fall, "1.0",
        {"rarity": f"{fall} / {req}", "magnitude": f"{fall} / 10.0", "compound": "1.0"},
        f"station || ' shows storm-onset signals: pressure_msl fell ' || {_one(fall)} || ' hPa in 3h while ' || CASE WHEN wind_gusts_10m_delta IS NOT NULL THEN 'wind_gusts_10m' ELSE 'wind_speed_10m' END || ' rose ' || {_one(rise)} || ' km/h.'",
        {"pressure_fall_hpa": fall, "difference": fall, "pressure_delta_hpa": "pressure_delta"}, (f"{_p3(fall)} >= 10", f"{_p3(fall)} >= 8"),
    )
    for k, kind, tail, side, op, fb in ((2, "warm_spell", "warm", "upper", ">=", "3.0"), (3, "cold_spell", "cold", "lower", "<=", "-3.0")):
        away = f"abs({_T} - {_T}_median)"
        STEP[f"d{k + 1}{v}"] = candidate(
            kind, k, feat, f"{_T}_z {op} coalesce(gate_{_T}_{side}, {fb})", f"'{_T}'", z, f"{_T}_conf",
            {"rarity": rare(_T, side, _T + "_z"), "magnitude": f"{z} / 6.0" if clipped else f"{away} / 12.0", "persistence": f"{z} / 4.0"},
            f"station || ' is in a {tail} temperature spell: ' || {_one(_T)} || 'C is ' || {_one(z)} || ' sigma from the local-hour baseline.'",
            {"value": _T, "median": f"{_T}_median", "departure_c": away}, (f"{_p3(z)} >= 4 OR {_p3(away)} >= 10", f"{_p3(z)} >= 3.2"),
        )
    STEP[f"d5{v}"] = _rain(feat, "wet_p995", clipped)
    high = f"greatest({_G}_z, 0.0::DOUBLE)"
    STEP[f"d6{v}"] = candidate(
        "wind_gust_burst", 5, feat, f"{_G}_z IS NOT NULL AND ({_G}_z >= coalesce(gate_{_G}_upper, 3.2) OR {_G} >= 90)", f"'{_G}'", high, f"{_G}_conf",
        {"rarity": rare(_G, "upper", high), "magnitude": f"{_G} / 90.0"},
        f"station || ' has an unusual gust burst: ' || {_one(_G)} || ' km/h is ' || {_one(_G + '_z')} || ' sigma above the local-hour baseline.'",
        {"value": _G, "median": f"{_G}_median", "z_score": high}, (f"{_p3(_G)} >= 80", f"{_p3(_G)} >= 70 OR {_p3(high)} >= 4"),
    )
    warm, cold = f"greatest({_T}_z, 0.0::DOUBLE)", f"least({_T}_z, 0.0::DOUBLE)"
    STEP[f"d7{v}"] = candidate(
        "heat_stress", 6, feat, f"{HUMIDEX} >= 38", "'humidex'", f"CASE WHEN {_T}_z IS NOT NULL THEN {warm} ELSE {HUMIDEX} - 38 END", f"{_T}_conf",
        {"rarity": f"coalesce({rare(_T, 'upper', warm)}, 0.0)", "magnitude": f"({HUMIDEX} - 38.0) / 2", "compound": "1.0", "persistence": "0.5"},
        f"station || ' has heat stress conditions: Humidex ' || {_one(HUMIDEX)} || ' from ' || {_one(_T)} || 'C air and ' || {_one('dew_point_2m')} || 'C dew point.'",
        {"humidex": HUMIDEX, "gap": f"{HUMIDEX} - 38", _T: _T}, (f"{_p3(HUMIDEX)} >= 40", f"{_p3(HUMIDEX)} >= 39"),
    )
    STEP[f"d8{v}"] = candidate(
        "cold_stress", 7, feat, f"{CHILL} <= -25", "'wind_chill'", f"coalesce(abs({_T}_z), 0.0)", f"{_T}_conf",
        {"rarity": f"coalesce({rare(_T, 'lower', cold)}, 0.0)", "magnitude": f"(-25.0 - {CHILL}) / 10", "compound": "1.0", "persistence": "0.5"},
        f"station || ' has cold stress conditions: wind chill ' || {_one(CHILL)} || 'C with ' || {_one(_T)} || 'C air and ' || {_one('wind_speed_10m')} || ' km/h wind.'",
        {"wind_chill": CHILL, "gap": f"-25 - {CHILL}", _T: _T}, (f"{_p3(CHILL)} <= -30", f"{_p3(CHILL)} <= -27"),
    )
    STEP[f"bust{v}"] = " UNION ALL ".join(
        f"SELECT f.station, f.t, f.history_n, '{m}' AS m, p.{m} AS obs, p.fcst_{m} AS fc, abs(p.{m} - p.fcst_{m}) AS err, abs(p.{m} - p.fcst_{m}) / {m}_mae AS norm, {a}::DOUBLE AS anchor, {m}_pairs AS n_pairs FROM {feat} f JOIN pairs p ON p.station = f.station AND p.t = f.t JOIN mae ON mae.t = f.t"
        for m, (_, a) in _FM.items()
    )
    STEP[f"d9{v}"] = candidate(
        "forecast_bust", 8, f"bust{v}", "n_pairs >= 3 AND norm >= 2.5", "m", "err", "1.0", {"magnitude": "err / anchor", "forecast_surprise": "norm / 4.0"},
        f"station || chr(39) || 's ' || m || ' missed the stored forecast by ' || {_one('err')} || ', ' || {_one('norm')} || 'x the recent global MAE.'",
        {"observed": "obs", "forecast": "fc", "residual": "obs - fc"}, (f"{_p3('norm')} >= 4", "true"),
    )
    STEP[f"peers{v}"] = f"""
SELECT r.station, r.t, p.station AS peer, f.t AS peer_t, {', '.join(f'f.{m}, f.{m}_z, f.{m}_conf' for m in _Z)} FROM (SELECT station, t, peer_group FROM v1 JOIN v4 USING (station)) r
JOIN v4 p ON p.peer_group = r.peer_group AND p.station <> r.station ASOF JOIN {feat} f ON f.station = p.station AND f.t <= r.t"""
    STEP[f"middle{v}"] = "SELECT station, t, " + ", ".join(f"median({m}_z) FILTER (WHERE {m}_z IS NOT NULL AND {m}_conf > 0) AS {m}_mid" for m in _Z) + f" FROM peers{v} GROUP BY station, t"
    STEP[f"spat{v}"] = "SELECT f.*, " + ", ".join(f"{m}_mid" for m in _Z) + f" FROM {feat} f JOIN middle{v} USING (station, t)"
    parts = []
    for m in _Z:
        up, low = f"coalesce(gate_{m}_upper, {'3.2' if m == _G else '3.0'})", f"coalesce(gate_{m}_lower, -3.0)"
        if m == _G:
            own, rar, limit = f"{m}_z >= {up}", rare(m, "upper", f"greatest({m}_z, 0.0::DOUBLE)"), up
        else:
            own = f"CASE WHEN {m}_z >= 0 THEN {m}_z >= {up} ELSE {m}_z <= {low} END"
            rar = f"CASE WHEN {m}_z >= 0 THEN {rare(m, 'upper', m + '_z')} ELSE {rare(m, 'lower', m + '_z')} END"
            limit = f"abs(CASE WHEN {m}_z >= 0 THEN {up} ELSE {low} END)"
        gap = f"abs({m}_z - {m}_mid)"
        parts.append(candidate(
            "spatial_anomaly", 9, f"spat{v}", f"{own} AND {gap} >= 5", f"'{m}'", f"abs({m}_z)", f"{m}_conf", {"rarity": rar, "spatial": f"{gap} / 5.0"},
            f"station || chr(39) || 's {m} anomaly differs from peers by ' || {_one(gap)} || ' sigma in climatology-normalized space.'",
            {"z_score": f"abs({m}_z)", "signed_z_score": f"{m}_z", "threshold_z": limit}, (f"{_p3(gap)} >= 8", f"{_p3(gap)} >= 6"),
        ))
    STEP[f"d10{v}"] = " UNION ALL ".join(parts)
    STEP[f"cand{v}"] = " UNION ALL ".join(f"SELECT * FROM d{k}{v}" for k in range(1, 11))
    STEP[f"best{v}"] = f"SELECT * FROM cand{v} QUALIFY row_number() OVER (PARTITION BY station, detector, metric, t ORDER BY score DESC, detector_order DESC) = 1"
    STEP[f"hits{v}"] = f"""
SELECT *, sum(fresh) OVER (PARTITION BY station, detector, metric ORDER BY seq) AS island FROM (
  SELECT *, CASE WHEN seq - lag(seq) OVER w - 1 < 2 THEN 0 ELSE 1 END AS fresh FROM best{v} JOIN seqd USING (station, t) WHERE strength >= 0.5 WINDOW w AS (PARTITION BY station, detector, metric ORDER BY seq))"""
    STEP[f"opened{v}"] = f"SELECT station, detector, metric, island, min(seq) AS opened FROM hits{v} WHERE strength >= 1.0 GROUP BY ALL"
    STEP[f"live{v}"] = f"SELECT h.*, opened FROM hits{v} h JOIN opened{v} USING (station, detector, metric, island) WHERE seq >= opened"
    for name, by in (("inc", "strength"), ("rinc", "score")):
        STEP[f"{name}{v}"] = f"""
SELECT i.* EXCLUDE (last_seq, island), s.t AS resolved_t, CASE WHEN s.t IS NOT NULL THEN 'resolved' WHEN hits > 1 THEN 'ongoing' ELSE 'open' END AS status,
  CASE WHEN priority_score < 30 THEN 'info' WHEN priority_score < 60 THEN 'warning' ELSE 'severe' END AS severity FROM (
  SELECT station, detector, metric, island, min(t) AS onset_t, max(t) AS last_t, max(seq) AS last_seq, count(*) AS hits, arg_max(t, {{'x': {by}, 'y': -seq}}) AS peak_t, max(strength) AS peak_strength, max(score) AS priority_score,
    arg_max(label, {{'x': {by}, 'y': -seq}}) AS label, string_agg(CAST(t AS VARCHAR), ',' ORDER BY seq) AS ts
  FROM live{v} GROUP BY ALL) i LEFT JOIN seqd s ON s.station = i.station AND s.seq = i.last_seq + 2"""


_detectors("", "feat", clipped=False)
STEP["d5_p95"] = _rain("feat", "NULL::DOUBLE", clipped=False)
_detectors("_c", "feat", clipped=True)  # smooth baseline, clipped scores
_detectors("_m", "feat_m", clipped=True)  # month and hour baseline, clipped scores


def with_(body: str) -> str:
    """`body` after all steps that it needs, directly or not."""
    names, order = re.compile(r"\b(" + "|".join(sorted(STEP, key=len, reverse=True)) + r")\b"), []

    def need(sql: str) -> None:
        for n in dict.fromkeys(names.findall(sql)):
            if n not in order and re.search(rf"(?:FROM|JOIN)\s*\(?\s*{n}\b", sql):
                need(STEP[n])
                if n not in order:
                    order.append(n)

    need(body)
    steps = ",\n".join(f"{n} AS MATERIALIZED ({expand(STEP[n]).strip()})" for n in order)
    return (f"WITH {steps}\n" if steps else "") + expand(body)
