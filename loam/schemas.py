"""Row shapes, fixed lookup values and price parameters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

TOPIC_NAMESPACE = "iot"

# Fields every message carries.
ENVELOPE = T.StructType([
    T.StructField(name, T.StringType())
    for name in ("device_id", "timestamp", "sensor_id", "tenant_id", "farm_id", "sensor_type")
])

CORRUPT = "_corrupt"

MESSAGE = T.StructType([
    T.StructField("topic", T.StringType()),
    T.StructField("value", T.BinaryType()),
    T.StructField("partition", T.IntegerType()),
    T.StructField("offset", T.LongType()),
    T.StructField("timestamp", T.TimestampType()),
])

# Columns of the lake tables.
LAKE_COLUMNS = [
    ("tenant_id", "string"), ("farm_id", "string"), ("sensor_id", "string"),
    ("device_id", "string"), ("event_time", "timestamp"), ("location", "string"),
    ("metrics", "string"), ("raw_topic", "string"),
    ("year", "int"), ("month", "int"), ("day", "int"), ("hour", "int"),
]

# Fields of a message's hardware report.
HARDWARE = T.StructType([
    T.StructField("firmware_version", T.StringType()),
    T.StructField("mac_address", T.StringType()),
    T.StructField("ip_address", T.StringType()),
    T.StructField("battery_level_percent", T.DoubleType()),
    T.StructField("memory_free_mb", T.LongType()),
    T.StructField("memory_total_mb", T.LongType()),
])

# Accepted spellings of a sensor type and the type they stand for.
TYPE_ALIASES = {
    "soil": "soil", "soil_sensor": "soil", "soil_moisture": "soil",
    "co2": "co2", "co2_sensor": "co2", "co2sensor": "co2",
    "weather": "weather", "weather_sensor": "weather", "weather_station": "weather",
    "temperature": "temperature", "temp_sensor": "temperature",
    "temperature_sensor": "temperature",
    "environment": "environment", "env_monitor": "environment",
    "environment_sensor": "environment", "environmental": "environment",
    "humidity": "humidity", "humidity_sensor": "humidity",
    "pressure": "pressure", "pressure_sensor": "pressure", "atmospheric": "pressure",
    "light": "light", "light_sensor": "light", "par_sensor": "light", "lux_sensor": "light",
    "flow": "flow", "flow_sensor": "flow", "water_flow": "flow",
}
UNKNOWN_TYPE = "unknown"

# The payload field that holds the measurements of each type.
METRIC_BLOCKS = {
    "soil": "soil_metrics", "co2": "air_quality", "weather": "weather_data",
    "temperature": "temperature_data", "environment": "pollution_metrics",
    "humidity": "humidity_data", "pressure": "pressure_data",
    "light": "light_data", "flow": "flow_data",
}

# Measurement fields of each type.
METRIC_FIELDS = {
    "soil": ["moisture_percent", "temperature_c", "ph", "electrical_conductivity_us_cm",
             "nitrogen_mg_kg", "phosphorus_mg_kg", "potassium_mg_kg", "organic_matter_percent"],
    "co2": ["co2_ppm", "temperature_c", "humidity_percent", "pressure_hpa", "voc_ppb",
            "air_quality_index"],
    "weather": ["temperature_c", "humidity_percent", "pressure_hpa", "wind_speed_m_s",
                "wind_direction_deg", "rainfall_mm", "uv_index", "solar_radiation_w_m2"],
    "temperature": ["current_temperature_c", "min_last_24h_c", "max_last_24h_c"],
    "environment": ["pm2_5_ug_m3", "pm10_ug_m3", "co_ppm", "no2_ppb", "so2_ppb", "o3_ppb"],
    "humidity": ["humidity_percent", "temperature_c", "dew_point_c", "heat_index_c"],
    "pressure": ["atmospheric_hpa", "sea_level_hpa", "pressure_trend", "temperature_c"],
    "light": ["lux", "par_umol_m2_s", "uv_index", "infrared_w_m2"],
    "flow": ["flow_rate_l_min", "cumulative_volume_l", "velocity_m_s", "pressure_bar",
             "temperature_c"],
}
TEXT_METRICS = {"pressure_trend"}

# What one pass over a message's JSON yields: nested objects are kept as JSON text.
PAYLOAD = T.StructType([
    *ENVELOPE.fields,
    *[T.StructField(name, T.StringType()) for name in ("location", *METRIC_BLOCKS.values())],
    T.StructField(CORRUPT, T.StringType()),
])

# Blocks the live terminal looks for, first one present wins.
TERMINAL_BLOCKS = ["soil_metrics", "air_quality", "weather_data", "temperature_data",
                   "pollution_metrics"]

# Typical days from planting to harvest.
GROWING_DAYS = {
    "maize": 90, "corn": 90, "rice": 120, "wheat": 100, "soybean": 100,
    "tomato": 75, "pepper": 80, "onion": 120, "cabbage": 70, "lettuce": 45,
    "carrot": 75, "potato": 90, "sweet potato": 120, "cowpea": 65,
    "groundnut": 120, "sorghum": 100, "millet": 90, "plantain": 300,
    "banana": 270, "cassava": 270, "yam": 240, "cocoa": 1095, "coffee": 1095,
    "palm oil": 365, "rubber": 365, "cotton": 160, "sugarcane": 365,
}
DEFAULT_GROWING_DAYS = 90

# Setup steps that leave a connection event.
SETUP_STEPS = ["kafka_topic_created", "mqtt_topic_created", "simulator_started"]

# Hardware keys a registry update may overlay.
HARDWARE_KEYS = ["manufacturer", "model", "serial_number", "operating_system", "power_type"]


@dataclass(frozen=True)
class Prices:
    """Price parameters. The ledger and the dashboards price a message differently."""

    ledger_message: float = 0.10 / 100000   # used for amount_due
    sensor_onboarding: float = 1.00
    message: float = 0.0005                 # used by cycle detail and dashboards
    storage_gb: float = 0.50
    query_unit: float = 0.01


@dataclass(frozen=True)
class QueryUnits:
    floor: float = 1.0
    per_gb: float = 1.0
    per_cpu_second: float = 2.0
    per_gb_second: float = 0.5


PRICES = Prices()
QUERY_UNITS = QueryUnits()
BYTES_PER_MESSAGE = 300


def metric_schema(sensor_type: str) -> T.StructType:
    return T.StructType([
        T.StructField(name, T.StringType() if name in TEXT_METRICS else T.DoubleType())
        for name in METRIC_FIELDS[sensor_type]
    ])
