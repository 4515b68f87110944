"""Names, types and fixed values of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

KEYS = ("station",)
TS = "ts"
TARGET = "us_aqi"
LABEL = "target_aqi_t_plus_1h"

# Feature names, in model input order.
WEATHER = [
    "temperature_2m",
    "relative_humidity_2m",
    "surface_pressure",
    "precipitation",
    "cloud_cover",
    "wind_speed_10m",
    "wind_direction_10m",
    "wind_gusts_10m",
]
POLLUTANTS = ["pm2_5", "pm10", "nitrogen_dioxide", "sulphur_dioxide", "ozone", "carbon_monoxide"]
CALENDAR = ["hour", "day_of_week", "day_of_month", "month", "is_weekend", "season"]
REGIONAL = [
    "is_smog_season",
    "is_crop_burning_season",
    "is_brick_kiln_active",
    "wind_from_east",
    "days_since_rain",
]
DERIVED = [
    "aqi_change_rate",
    "aqi_rolling_mean_24h",
    "aqi_rolling_std_24h",
    "aqi_lag_1h",
    "aqi_lag_3h",
    "aqi_lag_6h",
    "aqi_lag_12h",
    "aqi_lag_24h",
    "temp_x_humidity",
    "wind_x_pm25",
]
FEATURES = WEATHER + POLLUTANTS + CALENDAR + REGIONAL + DERIVED
RAW = [TARGET] + WEATHER + POLLUTANTS

LAGS = [1, 3, 6, 12, 24]
ROLLING_ROWS = 24
CHANGE_ROWS = 3
RAIN_MM = 0.1
DRY_DAYS_DEFAULT = 30.0
EAST = (45, 135)

# Month sets.
SMOG_MONTHS = [10, 11, 12, 1, 2]
CROP_BURNING_MONTHS = [10, 11]
BRICK_KILN_MONTHS = [11, 12, 1, 2, 3]

# Air-quality bands (low, high, label, colour, emoji).
BANDS = [
    (0, 50, "Good", "#00e400", "🟢"),
    (51, 100, "Moderate", "#ffff00", "🟡"),
    (101, 150, "Unhealthy for Sensitive Groups", "#ff7e00", "🟠"),
    (151, 200, "Unhealthy", "#ff0000", "🔴"),
    (201, 300, "Very Unhealthy", "#8f3f97", "🟣"),
    (301, 500, "Hazardous", "#7e0023", "🟤"),
]

# Advisory text per band.
ADVISORIES = {
    "Good": "Air quality is satisfactory. Enjoy outdoor activities.",
    "Moderate": "Acceptable air quality. Sensitive individuals should limit prolonged outdoor exertion.",
    "Unhealthy for Sensitive Groups": "Children, elderly, and those with respiratory conditions should stay indoors.",
    "Unhealthy": "Everyone should reduce outdoor activity. Wear masks if going outside.",
    "Very Unhealthy": "Health alert! Avoid all outdoor activity. Keep windows closed.",
    "Hazardous": "EMERGENCY: Stay indoors. Use air purifiers. Seek medical attention if experiencing symptoms.",
}

# Guideline limit per pollutant, and the cap of the ratio in percent.
GUIDELINE_LIMITS = {
    "pm2_5": 15.0,
    "pm10": 45.0,
    "nitrogen_dioxide": 25.0,
    "ozone": 100.0,
    "sulphur_dioxide": 40.0,
    "carbon_monoxide": 4000.0,
}
GUIDELINE_CAP = 250.0

ALERT_THRESHOLD = 200.0
FORECAST_HOURS = 72
LOOKBACK_HOURS = 48
VALID_FORECAST = (0.0, 600.0)
DEFAULT_AQI = 75.0
DEFAULT_LAST_KNOWN = 100.0

# Model names in order of preference, the name of the last resort and of the baseline.
MODEL_CHAIN = ["xgboost", "random_forest", "ridge"]
LAST_RESORT = "fallback_last_known"
BASELINE = "persistence_baseline"

# Default model parameters.
FOREST_PARAMS = {"numTrees": 200, "maxDepth": 15, "minInstancesPerNode": 5, "featureSubsetStrategy": "all", "seed": 42}
RIDGE_PARAMS = {"alpha": 1.0, "degree": 2}
BOOSTED_PARAMS = {"rounds": 300, "depth": 8, "rate": 0.05, "rows": 0.8, "columns": 0.8, "patience": 10, "seed": 42}

FEATURE_TABLE = T.StructType(
    [T.StructField("station", T.StringType(), False), T.StructField(TS, T.TimestampNTZType(), False)]
    + [T.StructField(c, T.DoubleType(), False) for c in [TARGET] + FEATURES]
)

HOURLY_WEATHER_JSON = T.StructType(
    [
        T.StructField("station", T.StringType()),
        T.StructField(
            "hourly",
            T.StructType(
                [T.StructField("time", T.ArrayType(T.StringType()))]
                + [T.StructField(c, T.ArrayType(T.DoubleType())) for c in WEATHER]
            ),
        ),
    ]
)
HOURLY_AIR_JSON = T.StructType(
    [
        T.StructField("station", T.StringType()),
        T.StructField(
            "hourly",
            T.StructType(
                [T.StructField("time", T.ArrayType(T.StringType()))]
                + [T.StructField(c, T.ArrayType(T.DoubleType())) for c in POLLUTANTS + [TARGET]]
            ),
        ),
    ]
)

# Leaf code in a station payload for each column.
STATION_LEAVES = {
    "pm2_5": "pm25",
    "pm10": "pm10",
    "nitrogen_dioxide": "no2",
    "sulphur_dioxide": "so2",
    "ozone": "o3",
    "carbon_monoxide": "co",
    "temperature_2m": "t",
    "relative_humidity_2m": "h",
    "wind_speed_10m": "w",
    "surface_pressure": "p",
}

REGISTRY_TABLE = T.StructType(
    [
        T.StructField("model_name", T.StringType(), False),
        T.StructField("version", T.IntegerType(), False),
        T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("created", T.TimestampNTZType()),
        T.StructField("feature_list", T.ArrayType(T.StringType())),
        T.StructField("path", T.StringType()),
    ]
)
