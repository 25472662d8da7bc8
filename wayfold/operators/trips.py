"""Points, implausible jumps, trip segmentation and what is derived from trips.

All windows run within a vehicle, so one shuffle on vehicle_id serves the whole chain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from wayfold.functions.scalars import SECOND, half_up, haversine_km

JUMP_KMH = 300.0
GAP_US = 300 * SECOND
MIN_POINTS, MIN_KM = 2, 0.05
IDLE_KMH, IDLE_POINTS, IDLE_US = 2.0, 5, 120 * SECOND


def by_vehicle() -> WindowSpec:
    return Window.partitionBy("vehicle_id").orderBy("t_us", "event_id")


def by_trip() -> WindowSpec:
    return Window.partitionBy("vehicle_id", "segment").orderBy("t_us", "event_id")



def deduplicate(points: DataFrame, arrival: str = "t_us") -> DataFrame:
    """The first arrival of each event id."""
    return points.withColumn("n", F.row_number().over(Window.partitionBy("event_id").orderBy(arrival))).where("n = 1").drop("n")


def gps_points(telemetry: DataFrame, max_speed: float = 250.0) -> DataFrame:
    """Readings with a place and a time, and a plausible speed."""
    return telemetry.where(F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("t_us").isNotNull() & (F.col("speed_kmh") <= max_speed))


def with_steps(points: DataFrame) -> DataFrame:
    """Distance and seconds from the point before, the speed between, and whether it is implausible."""
    last = lambda c: F.lag(c).over(by_vehicle())
    steps = points.withColumns({"step_km": haversine_km(last("lat"), last("lon"), F.col("lat"), F.col("lon")), "step_us": F.col("t_us") - last("t_us")})
    speed = F.when(F.col("step_us") > 0, F.col("step_km") * 3600.0 * SECOND / F.col("step_us")).otherwise(0.0)
    return steps.withColumn("step_kmh", F.when(F.col("step_us").isNotNull(), speed)).withColumn("jump", F.coalesce(F.col("step_kmh") > JUMP_KMH, F.lit(False)))


def segmented(steps: DataFrame) -> DataFrame:
    """Points of trips with their segment: by ignition where a vehicle reports it, else by gaps of over 300 s."""
    on = F.coalesce(F.col("ignition") == "ON", F.lit(False))
    marked = steps.withColumn("on", on).withColumn("was_on", F.coalesce(F.lag("on").over(by_vehicle()), F.lit(False)))
    marked = marked.withColumn("by_ignition", F.max(F.col("ignition").isNotNull()).over(Window.partitionBy("vehicle_id")))
    begins = F.when(F.col("by_ignition"), F.col("on") & ~F.col("was_on")).otherwise(F.col("step_us").isNull() | (F.col("step_us") > GAP_US))
    numbered = marked.withColumn("segment", F.sum(begins.cast("long")).over(by_vehicle()))
    return numbered.where(~F.col("by_ignition") | F.col("on") | F.col("was_on")).drop("was_on")


def trip_distances(points: DataFrame) -> DataFrame:
    """Kilometres of each segment over its points that are no jumps."""
    sound = points.where(~F.col("jump"))
    step = haversine_km(F.lag("lat").over(by_trip()), F.lag("lon").over(by_trip()), F.col("lat"), F.col("lon"))
    return sound.withColumn("km", step).groupBy("vehicle_id", "segment").agg(F.coalesce(F.sum("km"), F.lit(0.0)).alias("distance_km"))


def of_trips(points: DataFrame) -> DataFrame:
    """The points of viable trips (two points and 0.05 km at least), with the trip's id, distance, start and end.

    Distances skip jumps: the point before is the last one that is none. All windows lie within a vehicle, so the points
    are neither shuffled again nor joined.
    """
    whole = Window.partitionBy("vehicle_id", "segment")
    sound = F.when(~F.col("jump"), F.struct("lat", "lon"))
    last = F.last(sound, ignorenulls=True).over(by_trip().rowsBetween(Window.unboundedPreceding, -1))
    step = F.when(~F.col("jump"), haversine_km(last["lat"], last["lon"], F.col("lat"), F.col("lon")))
    sums = points.withColumn("km", step).withColumns({
        "trip_points": F.count("*").over(whole), "trip_km": F.coalesce(F.sum("km").over(whole), F.lit(0.0)),
        "started_us": F.min("t_us").over(whole), "ended_us": F.max("t_us").over(whole),
    })
    viable = sums.where((F.col("trip_points") >= MIN_POINTS) & (F.col("trip_km") >= MIN_KM))
    key = F.sha2(F.concat_ws("|", F.col("vehicle_id").cast("string"), F.col("started_us").cast("string")), 256)
    return viable.withColumn("trip_id", key).withColumn("distance_km", F.round("trip_km", 6)).drop("km", "trip_km", "trip_points")


def trips(points: DataFrame) -> DataFrame:
    """A row of each viable trip of segmented points."""
    per = of_trips(points).groupBy("vehicle_id", "segment").agg(
        F.first("trip_id").alias("trip_id"), F.min("fleet_id").alias("fleet_id"), F.first("started_us").alias("started_us"), F.first("ended_us").alias("ended_us"), F.first("distance_km").alias("distance_km"),
        F.count("*").alias("points"), F.count_if("jump").alias("jumps"), F.first("by_ignition").alias("by_ignition"),
        F.min("lon").alias("min_lon"), F.min("lat").alias("min_lat"), F.max("lon").alias("max_lon"), F.max("lat").alias("max_lat"),
    )
    return per.select(
        "trip_id", "vehicle_id", "fleet_id", "segment", F.row_number().over(Window.partitionBy("vehicle_id").orderBy("started_us")).alias("trip_number"), "started_us", "ended_us",
        half_up((F.col("ended_us") - F.col("started_us")) / float(SECOND)).alias("duration_s"), "distance_km", "points", "jumps",
        F.greatest(F.lit(0), half_up(100.0 * (F.col("points") - F.col("jumps")) / F.col("points"))).alias("completeness"),
        F.when(F.col("jumps") > 0, "MISSING_GPS_SEGMENTS").alias("note"), F.when(F.col("by_ignition"), "ignition").otherwise("gap").alias("mode"),
        "min_lon", "min_lat", "max_lon", "max_lat",
    )


def trip_events(points: DataFrame) -> DataFrame:
    """Start, end, harsh brakes, faults, charging starts and closed runs of idling; ``points`` are those of of_trips()."""
    first = F.row_number().over(by_trip())
    last = F.row_number().over(Window.partitionBy("vehicle_id", "segment").orderBy(F.desc("t_us"), F.desc("event_id")))
    idle = F.coalesce((F.coalesce("speed_kmh", F.lit(0.0)) < IDLE_KMH) & (F.col("ignition") == "ON"), F.lit(False))
    p = points.withColumns({"first": first, "last": last, "idle": idle, "was_charging": F.coalesce(F.lag("charging").over(by_trip()), F.lit(False))})
    p = p.withColumn("run", F.sum((~F.col("idle")).cast("long")).over(by_trip()))  # an idle run shares the number of the point before it
    within = Window.partitionBy("vehicle_id", "segment", "run", "idle")
    long_run = (F.count("*").over(within) >= IDLE_POINTS) & (F.max("t_us").over(within) - F.min("t_us").over(within) >= IDLE_US)
    closed = F.min("last").over(within) > 1  # a later point ends the run
    p = p.withColumn("idles", F.col("idle") & long_run & closed & (F.row_number().over(within.orderBy("t_us", "event_id")) == 1))
    fault = F.col("fault_code").isNotNull() & ~F.col("fault_code").isin("", "null")
    kinds = [
        ("TRIP_START", F.col("first") == 1), ("TRIP_END", F.col("last") == 1), ("HARSH_BRAKE", F.col("harsh_brake")), ("FAULT", fault),
        ("CHARGING", F.col("charging") & ~F.col("was_charging")), ("EXTENDED_IDLE", F.col("idles")),
    ]
    labels = F.array_compact(F.array(*[F.when(test, name) for name, test in kinds]))
    events = p.select("trip_id", "vehicle_id", "event_id", "t_us", F.explode(labels).alias("kind"), "distance_km")
    return events.withColumn("distance_km", F.when(F.col("kind") == "TRIP_END", F.col("distance_km")))


def route_points(points: DataFrame) -> DataFrame:
    """Sound points of trips in order, with markers and the starts of lines."""
    sound = points.where(~F.col("jump"))
    gap = F.col("t_us") - F.lag("t_us").over(by_trip())
    marker = F.col("harsh_brake") | F.col("fault_code").isNotNull()
    return sound.select("trip_id", "vehicle_id", "segment", "event_id", "t_us", "lat", "lon", marker.alias("is_marker"), (gap.isNull() | (gap > GAP_US)).alias("is_start"), F.row_number().over(by_trip()).alias("position"))


def route_gaps(points: DataFrame) -> DataFrame:
    """Gaps between neighbouring points of a trip: a jump on either side, or over 300 s."""
    step = (F.col("t_us") - F.lag("t_us").over(by_trip())) > GAP_US
    either = F.col("jump") | F.coalesce(F.lag("jump").over(by_trip()), F.lit(False))
    gap = F.lag("t_us").over(by_trip()).isNotNull() & (step | either)
    return points.withColumn("gap", gap).groupBy("trip_id").agg(F.count_if("gap").alias("gaps"), F.max("gap").alias("has_gaps"))


def date_of(us: Column) -> Column:
    return F.date_format(F.timestamp_micros(us), "yyyy-MM-dd")


def daily_summary(viable: DataFrame, events: DataFrame) -> DataFrame:
    """Trips by the day they start; event counts by the events' own day, on days with a trip."""
    days = viable.groupBy("vehicle_id", date_of(F.col("started_us")).alias("day")).agg(F.count("*").alias("trips"), F.round(F.sum("distance_km"), 6).alias("distance_km"), F.sum("duration_s").alias("driving_s"))
    kinds = ("HARSH_BRAKE", "FAULT", "CHARGING", "EXTENDED_IDLE")
    counts = events.groupBy("vehicle_id", date_of(F.col("t_us")).alias("day")).agg(*[F.count_if(F.col("kind") == k).alias(k.lower()) for k in kinds])
    filled = [F.coalesce(k.lower(), F.lit(0)).alias(k.lower()) for k in kinds]
    return days.join(counts, ["vehicle_id", "day"], "left").select("vehicle_id", "day", "trips", "distance_km", "driving_s", F.lit(0).alias("idle_duration_s"), *filled)


def reconcile(rebuilt: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored trip for each rebuilt one: starts within 300 s, or inside, or wholly around; the nearest start wins."""
    s = stored.select(F.col("trip_id").alias("stored_id"), F.col("vehicle_id").alias("stored_vehicle"), F.col("started_us").alias("s0"), F.col("ended_us").alias("s1"))
    near = F.abs(F.col("started_us") - F.col("s0")) <= GAP_US
    inside = (F.col("started_us") >= F.col("s0")) & (F.col("started_us") <= F.col("s1"))
    around = (F.col("s0") >= F.col("started_us")) & (F.col("s1") <= F.col("ended_us"))
    pairs = rebuilt.join(s, (F.col("vehicle_id") == F.col("stored_vehicle")) & (near | inside | around), "left")
    rank = F.row_number().over(Window.partitionBy("trip_id").orderBy(F.abs(F.col("started_us") - F.col("s0")).asc_nulls_last(), "s0", "stored_id"))
    return pairs.withColumn("n", rank).where("n = 1").select("trip_id", "vehicle_id", "started_us", "stored_id")


def in_dates(rows: DataFrame, column: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Rows whose time (microseconds, UTC) lies from the start of one day to the end of another, either of them open.

    The last day counts up to 23:59:59 and its first microsecond, so fractions of its last second lie outside.
    """
    if first is not None:
        rows = rows.where(F.col(column) >= F.unix_micros(F.lit(first).cast("timestamp")))
    if last is not None:
        rows = rows.where(F.col(column) <= F.unix_micros(F.lit(f"{last} 23:59:59").cast("timestamp")))
    return rows


def newest_days(summaries: DataFrame, first: str | None = None, last: str | None = None, days: int = 30) -> DataFrame:
    """The newest days of each vehicle's summaries between two days, with their ``place`` from the newest."""
    if first is not None:
        summaries = summaries.where(F.col("day") >= first)
    if last is not None:
        summaries = summaries.where(F.col("day") <= last)
    newest = Window.partitionBy("vehicle_id").orderBy(F.desc("day"))
    return summaries.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= days)


def rebuild_ranges(late: DataFrame, trips: DataFrame, margin_us: int = 1800 * SECOND) -> DataFrame:
    """(vehicle_id, from_us, to_us, jobs): the disjoint spans to rebuild for late times (vehicle_id, t_us).

    Each time asks for a margin on either side; a span that begins within a trip begins with that trip instead. Spans that
    meet are one. Times are merged before trips are looked up, so the join has a row a span.
    """
    def merged(spans: DataFrame) -> DataFrame:
        order = Window.partitionBy("vehicle_id").orderBy("from_us", "to_us")
        reached = F.max("to_us").over(order.rowsBetween(Window.unboundedPreceding, -1))
        numbered = spans.withColumn("fresh", F.coalesce(F.col("from_us") > reached, F.lit(True)).cast("int"))
        numbered = numbered.withColumn("span", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        return numbered.groupBy("vehicle_id", "span").agg(F.min("from_us").alias("from_us"), F.max("to_us").alias("to_us"), F.sum("jobs").alias("jobs")).drop("span")

    spans = merged(late.groupBy("vehicle_id", "t_us").agg(F.count("*").alias("jobs")).select("vehicle_id", (F.col("t_us") - margin_us).alias("from_us"), (F.col("t_us") + margin_us).alias("to_us"), "jobs"))
    held = trips.select(F.col("vehicle_id").alias("trip_vehicle"), "started_us", "ended_us")
    within = (F.col("vehicle_id") == F.col("trip_vehicle")) & F.col("from_us").between(F.col("started_us"), F.col("ended_us"))
    widened = spans.join(held, within, "left").groupBy("vehicle_id", "from_us", "to_us", "jobs").agg(F.min("started_us").alias("started_us"))
    return merged(widened.select("vehicle_id", F.least("from_us", "started_us").alias("from_us"), "to_us", "jobs"))
