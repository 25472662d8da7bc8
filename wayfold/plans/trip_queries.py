"""Queries over points and trips, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.functions.scalars import SECOND, bearing_degrees, haversine_km, sql_haversine
from wayfold.operators import trips as op
from wayfold.sources.fixtures import TEL, telemetry

W = "OVER (PARTITION BY vehicle_id ORDER BY t_us, event_id)"
WT = "OVER (PARTITION BY vehicle_id, segment ORDER BY t_us, event_id)"

PTS = f"""{TEL}, pts AS MATERIALIZED (SELECT * FROM tel WHERE speed_kmh <= 250),
st0 AS (SELECT *, lag(lat) {W} AS plat, lag(lon) {W} AS plon, t_us - lag(t_us) {W} AS step_us FROM pts),
st1 AS (SELECT *, {sql_haversine('plat', 'plon', 'lat', 'lon')} AS step_km FROM st0),
st2 AS (SELECT *, CASE WHEN step_us > 0 THEN step_km * 3600.0 * 1000000 / step_us WHEN step_us IS NOT NULL THEN 0.0 END AS step_kmh FROM st1),
steps AS MATERIALIZED (SELECT *, coalesce(step_kmh > 300, false) AS jump FROM st2)"""
SEG = f"""{PTS}, m0 AS (SELECT *, coalesce(ignition = 'ON', false) AS is_on, bool_or(ignition IS NOT NULL) OVER (PARTITION BY vehicle_id) AS by_ignition FROM steps),
m1 AS (SELECT *, coalesce(lag(is_on) {W}, false) AS was_on FROM m0),
m2 AS (SELECT *, sum(CASE WHEN by_ignition THEN CASE WHEN is_on AND NOT was_on THEN 1 ELSE 0 END ELSE CASE WHEN step_us IS NULL OR step_us > 300000000 THEN 1 ELSE 0 END END) {W} AS segment FROM m1),
seg AS MATERIALIZED (SELECT * FROM m2 WHERE NOT by_ignition OR is_on OR was_on)"""
DIST = f"""{SEG}, snd AS (SELECT *, lag(lat) {WT} AS slat, lag(lon) {WT} AS slon FROM seg WHERE NOT jump),
dist AS MATERIALIZED (SELECT vehicle_id, segment, coalesce(sum({sql_haversine('slat', 'slon', 'lat', 'lon')}), 0) AS km FROM snd GROUP BY ALL)"""
TRIPS = f"""{DIST}, agg AS (SELECT vehicle_id, segment, min(fleet_id) AS fleet_id, min(t_us) AS started_us, max(t_us) AS ended_us, count(*) AS points, count(*) FILTER (jump) AS jumps,
    bool_or(by_ignition) AS by_ignition, min(lon) AS min_lon, min(lat) AS min_lat, max(lon) AS max_lon, max(lat) AS max_lat FROM seg GROUP BY ALL),
trips AS MATERIALIZED (SELECT sha256(vehicle_id || '|' || started_us) AS trip_id, vehicle_id, fleet_id, segment, row_number() OVER (PARTITION BY vehicle_id ORDER BY started_us) AS trip_number,
    started_us, ended_us, floor((ended_us - started_us) / 1000000.0 + 0.5)::BIGINT AS duration_s, round(coalesce(km, 0), 6) AS distance_km, points, jumps,
    greatest(0, floor(100.0 * (points - jumps) / points + 0.5))::BIGINT AS completeness, CASE WHEN jumps > 0 THEN 'MISSING_GPS_SEGMENTS' END AS note,
    CASE WHEN by_ignition THEN 'ignition' ELSE 'gap' END AS mode, min_lon, min_lat, max_lon, max_lat
    FROM agg LEFT JOIN dist USING (vehicle_id, segment) WHERE points >= 2 AND coalesce(km, 0) >= 0.05)"""
OF = f"""{TRIPS}, ofp AS MATERIALIZED (SELECT seg.*, t.trip_id, t.distance_km, t.started_us, t.ended_us FROM seg JOIN trips t USING (vehicle_id, segment))"""
EVENTS = f"""{OF}, p0 AS (SELECT *, row_number() {WT} AS first, row_number() OVER (PARTITION BY vehicle_id, segment ORDER BY t_us DESC, event_id DESC) AS last,
    coalesce(coalesce(speed_kmh, 0) < 2 AND ignition = 'ON', false) AS idle, coalesce(lag(charging) {WT}, false) AS was_charging FROM ofp),
p1 AS MATERIALIZED (SELECT *, sum(CASE WHEN idle THEN 0 ELSE 1 END) {WT} AS run FROM p0),
runs AS (SELECT trip_id, vehicle_id, run, count(*) AS n, min(t_us) AS t_us, max(t_us) AS until, arg_min(event_id, (t_us, event_id)) AS event_id, min(last) AS to_end FROM p1 WHERE idle GROUP BY ALL),
tev AS MATERIALIZED (SELECT trip_id, vehicle_id, event_id, t_us, 'TRIP_START' AS kind, NULL::DOUBLE AS distance_km FROM p1 WHERE first = 1
    UNION ALL SELECT trip_id, vehicle_id, event_id, t_us, 'TRIP_END', distance_km FROM p1 WHERE last = 1
    UNION ALL SELECT trip_id, vehicle_id, event_id, t_us, 'HARSH_BRAKE', NULL FROM p1 WHERE harsh_brake
    UNION ALL SELECT trip_id, vehicle_id, event_id, t_us, 'FAULT', NULL FROM p1 WHERE fault_code IS NOT NULL AND fault_code NOT IN ('', 'null')
    UNION ALL SELECT trip_id, vehicle_id, event_id, t_us, 'CHARGING', NULL FROM p1 WHERE charging AND NOT was_charging
    UNION ALL SELECT trip_id, vehicle_id, event_id, t_us, 'EXTENDED_IDLE', NULL FROM runs WHERE n >= 5 AND until - t_us >= 120000000 AND to_end > 1)"""


def points(s: SparkSession, d: str) -> DataFrame:
    return op.gps_points(telemetry(s, d))


def segments(s: SparkSession, d: str) -> DataFrame:
    return op.segmented(op.with_steps(points(s, d)))


def viable(s: SparkSession, d: str) -> DataFrame:
    return op.trips(segments(s, d))


def of_trips(s: SparkSession, d: str) -> DataFrame:
    return op.of_trips(segments(s, d))


def events(s: SparkSession, d: str) -> DataFrame:
    return op.trip_events(of_trips(s, d))


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def gps_dedup(s, d):
    t = telemetry(s, d).select("event_id", "vehicle_id", "t_us")
    copies = t.withColumn("arrival", F.col("event_id")).union(t.where("event_id % 50 = 0").withColumn("arrival", F.col("event_id") + 1_000_000_000))
    return op.deduplicate(copies, "arrival").select("event_id", "vehicle_id", "t_us", "arrival")


def haversine(s, d):
    km = haversine_km(F.lit(51.5), F.lit(-0.12), F.col("lat"), F.col("lon"))
    return telemetry(s, d).select("event_id", F.round(km, 6).alias("km"))


def bearing(s, d):
    return telemetry(s, d).select("event_id", bearing_degrees(F.lit(51.4), F.lit(-0.2), F.col("lat"), F.col("lon")).alias("degrees"))


def route_length(s, d):
    p = op.with_steps(points(s, d))
    return p.select("vehicle_id", "event_id", F.round(F.sum(F.coalesce("step_km", F.lit(0.0)) * 1000).over(op.by_vehicle()), 3).alias("metres"))


def route_interpolate(s, d):
    """Where a tenth, two tenths, ... of a vehicle's route has been covered: the step that holds each distance."""
    p = op.with_steps(points(s, d)).withColumn("km", F.coalesce("step_km", F.lit(0.0)))
    whole = F.sum("km").over(Window.partitionBy("vehicle_id"))
    upto = F.sum("km").over(op.by_vehicle())
    p = p.select("vehicle_id", "event_id", "km", upto.alias("upto"), whole.alias("whole"))
    marks = p.withColumn("tenth", F.explode(F.sequence(F.lit(1), F.lit(9)))).where("km > 0 AND round(whole * tenth / 10, 9) > round(upto - km, 9) AND round(whole * tenth / 10, 9) <= round(upto, 9)")
    return marks.select("vehicle_id", "tenth", "event_id", F.round((F.col("whole") * F.col("tenth") / 10 - (F.col("upto") - F.col("km"))) / F.col("km"), 4).alias("fraction"))


def trip_route_gaps(s, d):
    return op.route_gaps(of_trips(s, d))


def trip_quality(s, d):
    """The quality issues of each trip."""
    g = op.route_gaps(of_trips(s, d))
    issues = F.array_compact(F.array(F.when(F.col("has_gaps"), "ROUTE_GAPS"), F.when(F.col("jumps") > 0, "IMPLAUSIBLE_JUMPS"), F.when(F.col("completeness") < 80, "INCOMPLETE")))
    return viable(s, d).join(g, "trip_id").select("trip_id", F.array_join(F.array_distinct(issues), ",").alias("issues"))


FIRST_DAY, LAST_DAY = "1970-03-19", "1970-03-20"


def vehicle_trips(s, d, first: str | None = None, last: str | None = None):
    """Trips with their events counted, of all days or of those from one to another."""
    counts = events(s, d).groupBy("trip_id").agg(F.count("*").alias("events"), F.count_if(F.col("kind") == "HARSH_BRAKE").alias("harsh_brakes"))
    t = op.in_dates(viable(s, d), "started_us", first, last)
    return t.join(counts, "trip_id", "left").select("trip_id", "vehicle_id", "trip_number", "distance_km", F.coalesce("events", F.lit(0)).alias("events"), F.coalesce("harsh_brakes", F.lit(0)).alias("harsh_brakes"))


def trip_page(s, d):
    """The second page of 50 trips, newest first, with one row more that tells of a third."""
    rank = viable(s, d).select("trip_id", "vehicle_id", "started_us").orderBy(F.desc("started_us"), "trip_id").offset(50).limit(51)
    n = rank.withColumn("position", F.row_number().over(Window.orderBy(F.desc("started_us"), "trip_id")))
    return n.select("trip_id", "vehicle_id", "started_us", "position").where("position <= 51")


def vehicle_stats(s, d):
    v = telemetry(s, d).select("vehicle_id").distinct()
    t = viable(s, d).groupBy("vehicle_id").agg(F.count("*").alias("trips"), F.round(F.sum("distance_km"), 4).alias("distance_km"), F.sum("duration_s").alias("duration_s"))
    return v.join(t, "vehicle_id", "left").select("vehicle_id", F.coalesce("trips", F.lit(0)).alias("trips"), F.coalesce("distance_km", F.lit(0.0)).alias("distance_km"), F.coalesce("duration_s", F.lit(0)).alias("duration_s"))


def trip_reconcile(s, d):
    """Trips rebuilt from the points of three quarters of the events, matched to the full set."""
    part = op.trips(op.segmented(op.with_steps(points(s, d).where("event_id % 4 <> 3"))))
    return op.reconcile(part, viable(s, d))


def trip_quarantine_range(s, d):
    """Rejected readings that fall within a trip of their vehicle."""
    bad = telemetry(s, d).where("speed_kmh > 250").select(F.col("event_id"), F.col("vehicle_id").alias("v"), F.col("t_us").alias("failed_us"))
    t = viable(s, d)
    return t.join(bad, (F.col("vehicle_id") == F.col("v")) & F.col("failed_us").between(F.col("started_us"), F.col("ended_us"))).groupBy("trip_id").agg(F.count("*").alias("rejected"), F.min("event_id").alias("first_event"))


def dirty_ranges(s, d):
    """The disjoint spans to rebuild for each vehicle with late events, half an hour either way and from the start of a trip."""
    return op.rebuild_ranges(telemetry(s, d).where("event_id % 31 = 0").select("vehicle_id", "t_us"), viable(s, d))


def daily_summary_read(s, d):
    """The newest 30 days of each vehicle up to some day."""
    return op.newest_days(op.daily_summary(viable(s, d), events(s, d)), FIRST_DAY, None).select("vehicle_id", "day", "place", "trips", "distance_km")


def gps_speed(s, d):
    return op.with_steps(points(s, d)).select("event_id", *r6("step_km"), "step_us", F.round("step_kmh", 4).alias("step_kmh"))


QUERIES = {
    "gps_points": lambda s, d: points(s, d).select("event_id", "vehicle_id", "t_us", *r6("lat", "lon"), "speed_kmh", "ignition", "charging", "harsh_brake", "fault_code"),
    "gps_dedup": gps_dedup,
    "haversine": haversine,
    "bearing": bearing,
    "route_length": route_length,
    "route_interpolate": route_interpolate,
    "gps_speed": gps_speed,
    "gps_jump_flags": lambda s, d: op.with_steps(points(s, d)).select("event_id", "vehicle_id", "jump"),
    "trip_segments": lambda s, d: segments(s, d).select("event_id", "vehicle_id", "segment", "by_ignition"),
    "trip_distance": lambda s, d: op.trip_distances(segments(s, d)).select("vehicle_id", "segment", *r6("distance_km")),
    "trips": lambda s, d: viable(s, d).drop("min_lon", "min_lat", "max_lon", "max_lat"),
    "trip_numbering": lambda s, d: viable(s, d).select("trip_id", "vehicle_id", "trip_number"),
    "trip_bbox": lambda s, d: viable(s, d).select("trip_id", *r6("min_lon", "min_lat", "max_lon", "max_lat")),
    "trip_events": events,
    "route_points": lambda s, d: op.route_points(of_trips(s, d)).select("trip_id", "event_id", "t_us", *r6("lat", "lon"), "is_marker", "is_start", "position"),
    "route_gaps": trip_route_gaps,
    "daily_summary": lambda s, d: op.daily_summary(viable(s, d), events(s, d)),
    "trip_quality": trip_quality,
    "vehicle_trips": vehicle_trips,
    "vehicle_trips_dated": lambda s, d: vehicle_trips(s, d, FIRST_DAY, LAST_DAY),
    "daily_summary_read": daily_summary_read,
    "trip_page": trip_page,
    "vehicle_stats": vehicle_stats,
    "trip_reconcile": trip_reconcile,
    "trip_quarantine_range": trip_quarantine_range,
    "dirty_ranges": dirty_ranges,
}

_DAY = "strftime(make_timestamp({}), '%Y-%m-%d')"
_GAPS = f"""{OF}, g0 AS (SELECT trip_id, lag(t_us) {WT} IS NOT NULL AND (t_us - lag(t_us) {WT} > 300000000 OR jump OR coalesce(lag(jump) {WT}, false)) AS gap FROM ofp),
gaps AS MATERIALIZED (SELECT trip_id, count(*) FILTER (gap) AS gaps, bool_or(gap) AS has_gaps FROM g0 GROUP BY 1)"""
_PART = TRIPS.replace("WHERE speed_kmh <= 250", "WHERE speed_kmh <= 250 AND event_id % 4 <> 3")

ORACLES = {
    "gps_points": f"WITH {PTS} SELECT event_id, vehicle_id, t_us, round(lat, 6) AS lat, round(lon, 6) AS lon, speed_kmh, ignition, charging, harsh_brake, fault_code FROM pts",
    "gps_dedup": f"""WITH {TEL}, c AS (SELECT event_id, vehicle_id, t_us, event_id AS arrival FROM tel UNION ALL SELECT event_id, vehicle_id, t_us, event_id + 1000000000 FROM tel WHERE event_id % 50 = 0)
        SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY arrival) = 1""",
    "haversine": f"WITH {TEL} SELECT event_id, round({sql_haversine('51.5', '-0.12', 'lat', 'lon')}, 6) AS km FROM tel",
    "bearing": f"""WITH {TEL}, b AS (SELECT event_id, degrees(atan2(sin(radians(lon - (-0.2))) * cos(radians(lat)),
        cos(radians(51.4)) * sin(radians(lat)) - sin(radians(51.4)) * cos(radians(lat)) * cos(radians(lon - (-0.2))))) AS g FROM tel)
        SELECT event_id, round(g + CASE WHEN g < 0 THEN 360 ELSE 0 END, 1) % 360 AS degrees FROM b""",
    "route_length": f"WITH {PTS} SELECT vehicle_id, event_id, round(sum(coalesce(step_km, 0) * 1000) {W}, 3) AS metres FROM steps",
    "route_interpolate": f"""WITH {PTS}, k AS (SELECT vehicle_id, event_id, coalesce(step_km, 0.0) AS km, sum(coalesce(step_km, 0.0)) {W} AS upto, sum(coalesce(step_km, 0.0)) OVER (PARTITION BY vehicle_id) AS whole FROM steps)
        SELECT vehicle_id, tenth::INT AS tenth, event_id, round((whole * tenth / 10 - (upto - km)) / km, 4) AS fraction FROM k, range(1, 10) r(tenth)
        WHERE km > 0 AND round(whole * tenth / 10, 9) > round(upto - km, 9) AND round(whole * tenth / 10, 9) <= round(upto, 9)""",
    "gps_speed": f"WITH {PTS} SELECT event_id, round(step_km, 6) AS step_km, step_us, round(step_kmh, 4) AS step_kmh FROM steps",
    "gps_jump_flags": f"WITH {PTS} SELECT event_id, vehicle_id, jump FROM steps",
    "trip_segments": f"WITH {SEG} SELECT event_id, vehicle_id, segment::BIGINT AS segment, by_ignition FROM seg",
    "trip_distance": f"WITH {DIST} SELECT vehicle_id, segment::BIGINT AS segment, round(km, 6) AS distance_km FROM dist",
    "trips": f"WITH {TRIPS} SELECT * EXCLUDE (min_lon, min_lat, max_lon, max_lat) REPLACE (segment::BIGINT AS segment) FROM trips",
    "trip_numbering": f"WITH {TRIPS} SELECT trip_id, vehicle_id, trip_number FROM trips",
    "trip_bbox": f"WITH {TRIPS} SELECT trip_id, round(min_lon, 6) AS min_lon, round(min_lat, 6) AS min_lat, round(max_lon, 6) AS max_lon, round(max_lat, 6) AS max_lat FROM trips",
    "trip_events": f"WITH {EVENTS} SELECT * FROM tev",
    "route_points": f"""WITH {OF} SELECT trip_id, event_id, t_us, round(lat, 6) AS lat, round(lon, 6) AS lon, harsh_brake OR fault_code IS NOT NULL AS is_marker,
        lag(t_us) {WT} IS NULL OR t_us - lag(t_us) {WT} > 300000000 AS is_start, row_number() {WT} AS position FROM ofp WHERE NOT jump""",
    "route_gaps": f"WITH {_GAPS} SELECT * FROM gaps",
    "daily_summary": f"""WITH {EVENTS}, dt AS (SELECT vehicle_id, {_DAY.format('started_us')} AS day, count(*) AS trips, round(sum(distance_km), 6) AS distance_km, sum(duration_s)::BIGINT AS driving_s FROM trips GROUP BY ALL),
        de AS (SELECT vehicle_id, {_DAY.format('t_us')} AS day, count(*) FILTER (kind = 'HARSH_BRAKE') AS harsh_brake, count(*) FILTER (kind = 'FAULT') AS fault, count(*) FILTER (kind = 'CHARGING') AS charging,
            count(*) FILTER (kind = 'EXTENDED_IDLE') AS extended_idle FROM tev GROUP BY ALL)
        SELECT vehicle_id, day, trips, distance_km, driving_s, 0 AS idle_duration_s, coalesce(harsh_brake, 0) AS harsh_brake, coalesce(fault, 0) AS fault, coalesce(charging, 0) AS charging, coalesce(extended_idle, 0) AS extended_idle
        FROM dt LEFT JOIN de USING (vehicle_id, day)""",
    "trip_quality": f"""WITH {_GAPS} SELECT trip_id, concat_ws(',', CASE WHEN has_gaps THEN 'ROUTE_GAPS' END, CASE WHEN jumps > 0 THEN 'IMPLAUSIBLE_JUMPS' END, CASE WHEN completeness < 80 THEN 'INCOMPLETE' END) AS issues
        FROM trips JOIN gaps USING (trip_id)""",
    "vehicle_trips": f"""WITH {EVENTS} SELECT trip_id, any_value(t.vehicle_id) AS vehicle_id, any_value(trip_number) AS trip_number, any_value(t.distance_km) AS distance_km, count(kind) AS events, count(*) FILTER (kind = 'HARSH_BRAKE') AS harsh_brakes
        FROM trips t LEFT JOIN tev USING (trip_id) GROUP BY trip_id""",
    "trip_page": f"WITH {TRIPS} SELECT trip_id, vehicle_id, started_us, row_number() OVER (ORDER BY started_us DESC, trip_id) - 50 AS position FROM trips QUALIFY position BETWEEN 1 AND 51",
    "vehicle_stats": f"""WITH {TRIPS} SELECT vehicle_id, count(trip_id) AS trips, coalesce(round(sum(distance_km), 4), 0) AS distance_km, coalesce(sum(duration_s), 0)::BIGINT AS duration_s
        FROM (SELECT DISTINCT vehicle_id FROM tel) LEFT JOIN trips USING (vehicle_id) GROUP BY 1""",
    "trip_reconcile": f"""WITH full_set AS MATERIALIZED (WITH {TRIPS} SELECT * FROM trips), part AS MATERIALIZED (WITH {_PART} SELECT * FROM trips)
        SELECT p.trip_id, p.vehicle_id, p.started_us, f.trip_id AS stored_id FROM part p LEFT JOIN full_set f ON p.vehicle_id = f.vehicle_id AND (abs(p.started_us - f.started_us) <= 300000000
            OR p.started_us BETWEEN f.started_us AND f.ended_us OR (f.started_us >= p.started_us AND f.ended_us <= p.ended_us))
        QUALIFY row_number() OVER (PARTITION BY p.trip_id ORDER BY abs(p.started_us - f.started_us) NULLS LAST, f.started_us, f.trip_id) = 1""",
    "trip_quarantine_range": f"""WITH {TRIPS} SELECT trip_id, count(*) AS rejected, min(event_id) AS first_event FROM trips t JOIN tel b ON t.vehicle_id = b.vehicle_id AND b.t_us BETWEEN started_us AND ended_us
        WHERE b.speed_kmh > 250 GROUP BY 1""",
    "dirty_ranges": f"""WITH {TRIPS}, l AS (SELECT vehicle_id, t_us - 1800000000 AS f, t_us + 1800000000 AS t FROM tel WHERE event_id % 31 = 0),
        s1 AS (SELECT *, coalesce(f > max(t) OVER (PARTITION BY vehicle_id ORDER BY f, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)::INT AS fresh FROM l),
        s2 AS (SELECT *, sum(fresh) OVER (PARTITION BY vehicle_id ORDER BY f, t ROWS UNBOUNDED PRECEDING) AS span FROM s1), s3 AS (SELECT vehicle_id, min(f) AS f, max(t) AS t, count(*) AS n FROM s2 GROUP BY vehicle_id, span),
        w AS (SELECT vehicle_id, least(f, coalesce((SELECT min(started_us) FROM trips x WHERE x.vehicle_id = s3.vehicle_id AND f BETWEEN started_us AND ended_us), f)) AS f, t, n FROM s3),
        w1 AS (SELECT *, coalesce(f > max(t) OVER (PARTITION BY vehicle_id ORDER BY f, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)::INT AS fresh FROM w),
        w2 AS (SELECT *, sum(fresh) OVER (PARTITION BY vehicle_id ORDER BY f, t ROWS UNBOUNDED PRECEDING) AS span FROM w1)
        SELECT vehicle_id, min(f) AS from_us, max(t) AS to_us, sum(n)::BIGINT AS jobs FROM w2 GROUP BY vehicle_id, span""",
}
ORACLES["vehicle_trips_dated"] = f"SELECT * FROM ({ORACLES['vehicle_trips']}) WHERE trip_id IN (WITH {TRIPS} SELECT trip_id FROM trips WHERE started_us >= epoch_us(TIMESTAMP '1970-03-19') AND started_us <= epoch_us(TIMESTAMP '1970-03-20 23:59:59'))"
ORACLES["daily_summary_read"] = f"SELECT vehicle_id, day, place::INT AS place, trips, distance_km FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY day DESC) AS place FROM ({ORACLES['daily_summary']}) WHERE day >= '1970-03-19') WHERE place <= 30"
