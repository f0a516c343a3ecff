"""Parameters of a detection run, and the fixed tables of the domain."""

from __future__ import annotations

from dataclasses import dataclass, field

# Fixed values.
METRIC_EPSILON = {
    "temperature_2m": 0.5, "apparent_temperature": 0.5, "dew_point_2m": 0.5, "precipitation": 0.1, "wind_speed_10m": 1.0, "wind_gusts_10m": 1.0,
    "surface_pressure": 0.5, "pressure_msl": 0.5, "relative_humidity_2m": 1.0, "cloud_cover": 5.0, "snowfall": 0.1, "snow_depth": 0.01,
}
WEATHER_LEVEL = {
    0: [0, 1, 2, 3],
    1: [45, 48, 51, 53, 55, 56, 57, 61, 71, 73],
    2: [63, 65, 75, 80, 81],
    3: [82, 85, 86, 95, 96, 99],
}  # level -> codes
LEVEL_NAME = {0: "clear", 1: "mild_precipitation", 2: "moderate", 3: "severe"}
UPPER_PERCENTILES = (90.0, 95.0, 97.5, 99.0, 99.5, 99.9, 99.95, 99.99)
LOWER_PERCENTILES = (10.0, 5.0, 2.5, 1.0, 0.5, 0.1, 0.05, 0.01)
SCORE_WEIGHTS = {"rarity": 0.30, "magnitude": 0.20, "persistence": 0.15, "compound": 0.10, "forecast_surprise": 0.10, "spatial": 0.10, "confidence": 0.05}
DETECTORS = (
    "temperature_shock", "pressure_plunge", "warm_spell", "cold_spell", "heavy_rain_burst", "wind_gust_burst", "heat_stress", "cold_stress", "forecast_bust", "spatial_anomaly",
)
FORECAST_METRICS = {"temperature_2m": (1.0, 8.0), "precipitation": (1.0, 10.0), "wind_speed_10m": (3.0, 30.0), "wind_gusts_10m": (5.0, 40.0), "pressure_msl": (1.0, 12.0)}  # floor, anchor
SIGMA = 1.4826
TAIL_FLOOR = 1e-4
WET_PERCENTILES = (50, 75, 90, 95, 99)


@dataclass(frozen=True)
class Profile:
    """One calibration; the defaults are the current one, fixed values."""

    min_bucket_n: int = 30
    smooth_days: int = 15
    days: int = 366
    wet_mm: float = 0.1
    climatology_metrics: tuple = ("temperature_2m", "precipitation", "wind_gusts_10m", "pressure_msl")
    quantile_gates: bool = True
    surprisal: bool = True
    smooth_baseline: bool = True
    shock_z: float = 3.0
    shock_delta_c: float = 5.0
    shock_anchor_c: float = 6.0
    delta_hours: int = 3
    delta_tolerance_s: int = 2700
    fall_hpa: float = 6.0
    fall_anchor_hpa: float = 10.0
    wind_rise_kmh: float = 8.0
    confirming_gust_kmh: float = 60.0
    spell_z: float = 3.0
    spell_anchor_c: float = 12.0
    rain_mm: float = 10.0
    rain_6h_mm: float = 12.5
    rain_anchor_mm: float = 25.0
    rain_6h_anchor_mm: float = 50.0
    gust_z: float = 3.2
    gust_kmh: float = 90.0
    humidex: float = 38.0
    humidex_strong: float = 40.0
    wind_chill: float = -25.0
    wind_chill_strong: float = -35.0
    bust_k: float = 2.5
    bust_pairs: int = 3
    lead_min: int = 3
    lead_max: int = 12
    pair_days: int = 14
    pair_limit: int = 200
    spatial_gap: float = 5.0
    spatial_z: float = 3.0
    history_hours: int = 336
    history_rows: bool = False
    min_history: int = 12
    k_on: int = 1
    k_off: int = 2
    z_on: float = 1.0
    z_off: float = 0.5
    suppressed: tuple = field(default=("fun_fact",))


CURRENT = Profile()
MONTH_HOUR = Profile(smooth_baseline=False, surprisal=False)
SMOOTH_CLIPPED = Profile(surprisal=False)
