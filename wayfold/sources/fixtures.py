"""Telemetry derived from the driver's events table, by fixed rules; and the same rules as SQL for checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMPRESSION = 256  # the event clock runs this much faster, so that gaps of minutes appear
VALID_SPEED = 250.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an event: who, when (microseconds), where, and the canonical readings."""
    e = table(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").alias("vehicle_id"),
        F.expr(f"unix_micros(cast(ts as timestamp)) div {COMPRESSION}").alias("t_us"),
        "event_type",
        F.col("value").alias("speed_kmh"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )
    vendor = F.when(F.col("vehicle_id") % 3 == 1, "A").when(F.col("vehicle_id") % 3 == 2, "B").otherwise("C")
    return e.select(
        "event_id", "vehicle_id", "t_us", "event_type", "speed_kmh", "k",
        (F.col("vehicle_id") % 5).alias("fleet_id"), vendor.alias("vendor"),
        F.concat(F.lit("f"), (F.col("vehicle_id") % 5).cast("string"), F.lit("-"), vendor).alias("connection_id"),
        F.when(F.col("vehicle_id") % 3 != 0, F.when(F.col("event_type") == "error", "OFF").otherwise("ON")).alias("ignition"),
        (F.lit(51.5) + F.col("k") * 0.0002).alias("lat"), (F.lit(-0.12) + (F.col("event_id") % 100) * 0.0001).alias("lon"),
        (100 - F.col("k")).alias("battery_soc"),
        ((F.col("event_type") == "purchase") & (F.col("k") < 20)).alias("charging"),
        ((F.col("event_type") == "click") & (F.col("k") % 10 == 0)).alias("harsh_brake"),
        F.when((F.col("event_type") == "error") & (F.col("k") % 5 == 0), F.concat(F.lit("P"), (F.col("k") + 1000).cast("string"))).alias("fault_code"),
    )


#: A common table expression "tel" with the rows of telemetry().
TEL = f"""e AS (SELECT event_id, user_id AS vehicle_id, epoch_us(ts) // {COMPRESSION} AS t_us, event_type, value AS speed_kmh, json_extract_string(props, '$.k')::INT AS k FROM events),
tel AS MATERIALIZED (SELECT event_id, vehicle_id, t_us, event_type, speed_kmh, k, vehicle_id % 5 AS fleet_id,
    CASE vehicle_id % 3 WHEN 1 THEN 'A' WHEN 2 THEN 'B' ELSE 'C' END AS vendor,
    'f' || (vehicle_id % 5) || '-' || CASE vehicle_id % 3 WHEN 1 THEN 'A' WHEN 2 THEN 'B' ELSE 'C' END AS connection_id,
    CASE WHEN vehicle_id % 3 <> 0 THEN CASE WHEN event_type = 'error' THEN 'OFF' ELSE 'ON' END END AS ignition,
    51.5::DOUBLE + k * 0.0002::DOUBLE AS lat, -0.12::DOUBLE + (event_id % 100) * 0.0001::DOUBLE AS lon, 100 - k AS battery_soc,
    event_type = 'purchase' AND k < 20 AS charging, event_type = 'click' AND k % 10 = 0 AS harsh_brake,
    CASE WHEN event_type = 'error' AND k % 5 = 0 THEN 'P' || (1000 + k) END AS fault_code FROM e)"""
