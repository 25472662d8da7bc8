"""Current values by signal, movement, freshness and live state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions.scalars import SECOND

STALE_US, OFFLINE_US = 60 * SECOND, 300 * SECOND
MOVING_KMH = 0.5


def current_values(signals: DataFrame) -> DataFrame:
    """Latest value by vehicle and signal; equal event times go to the later arrival, and events without a time to their arrival."""
    when = F.coalesce(F.col("t_us"), F.col("received_us"))
    latest = signals.where(F.col("value").isNotNull()).groupBy("vehicle_id", "signal").agg(F.max_by(F.struct("value", when.alias("t_us")), F.struct(when, F.col("arrival_seq"))).alias("v"))
    return latest.select("vehicle_id", "signal", "v.value", "v.t_us")


def movement(charging: Column, ignition: Column, speed: Column) -> Column:
    off = F.upper(F.trim(F.coalesce(ignition, F.lit("")))) == "OFF"
    return F.when(F.coalesce(charging, F.lit(False)), "CHARGING").when(off, "PARKED").when(F.coalesce(speed, F.lit(0.0)) > MOVING_KMH, "MOVING").otherwise("IDLE")


def freshness(connected: Column, last_us: Column, as_of_us: Column) -> Column:
    age = as_of_us - last_us
    return F.when(~connected, "OFFLINE").when(last_us.isNull(), "AWAITING_DATA").when(age > OFFLINE_US, "OFFLINE").when(age > STALE_US, "STALE").otherwise("LIVE")


def live_state(connected: Column, last_us: Column, speed: Column, as_of_us: Column) -> Column:
    age = as_of_us - last_us
    return (
        F.when(~connected, "OFFLINE").when(last_us.isNull(), "CONNECTED").when(age > OFFLINE_US, "OFFLINE").when(age > STALE_US, "STALE")
        .when(speed.isNull(), "DATA_RECENT").when(speed > MOVING_KMH, "MOVING").otherwise("IDLE")
    )


def backfill(stored: DataFrame, events: DataFrame, newest: int = 100) -> DataFrame:
    """Current values (vehicle_id, signal, value, t_us) after looking through the newest events of each vehicle.

    ``events``: vehicle_id, event_id, t_us and signals, a map of texts. A signal is replaced only by a strictly later
    value; of equally late ones the later id counts. Events without a time and values that are null say nothing.
    """
    rank = F.row_number().over(Window.partitionBy("vehicle_id").orderBy(F.desc("t_us"), F.desc("event_id")))
    recent = events.where("t_us IS NOT NULL").withColumn("n", rank).where(F.col("n") <= newest)
    found = recent.select("vehicle_id", "event_id", "t_us", F.explode("signals").alias("signal", "value")).where("value IS NOT NULL")
    best = found.groupBy("vehicle_id", "signal").agg(F.max_by(F.struct("value", "t_us"), F.struct("t_us", "event_id")).alias("fresh"))
    both = stored.select("vehicle_id", "signal", F.struct("value", "t_us").alias("old")).join(best, ["vehicle_id", "signal"], "full_outer")
    later = F.coalesce(F.col("old.t_us") < F.col("fresh.t_us"), F.col("old.t_us").isNull() & F.col("fresh").isNotNull())
    return both.withColumn("v", F.when(later, F.col("fresh")).otherwise(F.col("old"))).select("vehicle_id", "signal", "v.value", "v.t_us")


def age_label(seconds: Column, stamp: Column) -> Column:
    """Seconds, minutes or hours ago; for more than a day the date of the time itself."""
    return (
        F.when(seconds < 60, F.concat(seconds.cast("string"), F.lit("s ago")))
        .when(seconds < 3600, F.concat(F.floor(seconds / 60).cast("string"), F.lit("m ago")))
        .when(seconds < 86400, F.concat(F.floor(seconds / 3600).cast("string"), F.lit("h ago")))
        .otherwise(F.date_format(stamp, "yyyy-MM-dd"))
    )
