"""Queries over routes, payload helpers and snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold.operators import payloads as pl
from wayfold.operators import routes as rt
from wayfold.operators import trips as op
from wayfold.plans.ingest_queries import FRESH, LAST, MOVE, freshness, last_seen, movement
from wayfold.plans.mapping_queries import PAY, payloads
from wayfold.plans.trip_queries import _GAPS, EVENTS, OF, TRIPS, WT, events, of_trips, vehicle_stats, viable
from wayfold.sources.fixtures import TEL, telemetry


def route_simplified(s, d):
    kept = rt.simplified(op.route_points(of_trips(s, d)))
    return kept.select("trip_id", "event_id", "position", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), "is_marker", "is_start")


def route_geojson(s, d):
    return rt.geojson(route_simplified(s, d))


def route_sanitize(s, d):
    """Places of which some are invalid, and the lines that they leave."""
    t = telemetry(s, d).select("vehicle_id", "event_id", F.when(F.col("event_id") % 53 == 0, 195.0).when(F.col("event_id") % 61 == 0, float("nan")).otherwise(F.col("lat")).alias("lat"), "lon")
    return rt.sanitized(t, "vehicle_id", "event_id").select("vehicle_id", "event_id", "line")


def webhook_verify(s, d):
    p = payloads(s, d).select("event_id", "payload")
    good = F.pandas_udf(lambda b: b.map(lambda x: "sha256=" + pl.sign(x, "key")), "string")
    signed = p.withColumn("signature", F.when(F.col("event_id") % 5 == 0, "0" * 64).otherwise(good("payload")))
    return signed.select("event_id", pl.signature_valid(F.col("payload"), F.col("signature"), F.lit("key")).alias("valid"))


def redact_payload(s, d):
    body = F.concat(F.lit('{"auth":{"Token":"t'), F.col("event_id").cast("string"), F.lit('"},"k":'), F.col("k").cast("string"), F.lit("}"))
    return telemetry(s, d).select("event_id", pl.redact(body).alias("redacted"))


def inspect_fields(s, d):
    return pl.inspect_fields(payloads(s, d)).groupBy("path", "type").agg(F.count("*").alias("payloads"))


def vehicle_snapshot(s, d):
    """State, totals and health tags of each vehicle, as one record."""
    v = last_seen(s, d).select("vehicle_id", "fleet_id", movement().alias("movement"), freshness().alias("freshness"), "fault_code", "battery_soc")
    tags = F.array_compact(F.array(F.when(F.col("freshness").isin("STALE", "OFFLINE"), "DATA_QUALITY"), F.when(F.col("freshness") == "AWAITING_DATA", "AWAITING_DATA"), F.when(F.col("fault_code").isNotNull(), "FAULT_REPORTED")))
    return v.join(vehicle_stats(s, d), "vehicle_id").select("vehicle_id", "fleet_id", F.array_join(tags, ",").alias("tags"), "movement", "freshness", "battery_soc", "trips", "distance_km")


def trip_bundle(s, d):
    """Each trip with its route, events and quality."""
    e = events(s, d).groupBy("trip_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("t_us", "event_id", "kind")))).alias("events"), F.count("*").alias("n_events"))
    g = op.route_gaps(of_trips(s, d))
    t = viable(s, d).select("trip_id", "vehicle_id", "distance_km", "completeness")
    return t.join(route_geojson(s, d), "trip_id", "left").join(e, "trip_id", "left").join(g, "trip_id", "left").select("trip_id", "vehicle_id", "distance_km", "completeness", "features", "n_events", "has_gaps", F.sha2(F.concat_ws("|", "geojson", "events"), 256).alias("body_hash"))


QUERIES = {
    "route_simplified": route_simplified,
    "route_geojson": route_geojson,
    "route_sanitize": route_sanitize,
    "webhook_verify": webhook_verify,
    "redact_payload": redact_payload,
    "inspect_fields": inspect_fields,
    "vehicle_snapshot": vehicle_snapshot,
    "trip_bundle": trip_bundle,
}

_LAST_ONLY = LAST.split(", last AS MATERIALIZED", 1)[1]
#: Points of routes, and those that stay: lines between fixed points are halved at the farthest point until none is too far.
_SIMPLE = f"""rp AS MATERIALIZED (SELECT trip_id, event_id, lon, lat, harsh_brake OR fault_code IS NOT NULL AS is_marker, lag(t_us) {WT} IS NULL OR t_us - lag(t_us) {WT} > 300000000 AS is_start, row_number() {WT} AS position FROM ofp WHERE NOT jump),
    fx AS MATERIALIZED (SELECT *, is_marker OR is_start OR lead(is_start) OVER tw IS NOT FALSE AS fixed FROM rp WINDOW tw AS (PARTITION BY trip_id ORDER BY position)),
    ends AS MATERIALIZED (SELECT trip_id, position AS a, lead(position) OVER (PARTITION BY trip_id ORDER BY position) AS b FROM fx WHERE fixed),
    cut(trip_id, a, b) AS (SELECT trip_id, a, b FROM ends WHERE b - a > 1 UNION ALL SELECT trip_id, unnest([a, m]), unnest([m, b]) FROM (
        SELECT trip_id, a, b, arg_max(position, (num, -position)) AS m, max(num) AS num, any_value(len) AS len FROM (
            SELECT c.trip_id, c.a, c.b, p.position, sqrt((y.lon - x.lon) * (y.lon - x.lon) + (y.lat - x.lat) * (y.lat - x.lat)) AS len,
                CASE WHEN y.lon = x.lon AND y.lat = x.lat THEN sqrt((p.lon - x.lon) * (p.lon - x.lon) + (p.lat - x.lat) * (p.lat - x.lat)) ELSE abs((y.lon - x.lon) * (p.lat - x.lat) - (y.lat - x.lat) * (p.lon - x.lon)) END AS num
            FROM cut c JOIN fx x ON x.trip_id = c.trip_id AND x.position = c.a JOIN fx y ON y.trip_id = c.trip_id AND y.position = c.b JOIN fx p ON p.trip_id = c.trip_id AND p.position > c.a AND p.position < c.b)
        GROUP BY trip_id, a, b) WHERE num / CASE WHEN len > 0 THEN len ELSE 1 END > 5e-5),
    stay AS (SELECT trip_id, a AS position FROM cut UNION SELECT trip_id, b FROM cut UNION SELECT trip_id, position FROM fx WHERE fixed),
    simple AS MATERIALIZED (SELECT trip_id, event_id, position, round(lon, 6) AS lon, round(lat, 6) AS lat, is_marker, is_start FROM fx JOIN stay USING (trip_id, position))"""
_GEO = f"""{_SIMPLE}, nl AS (SELECT *, '[' || lon || ',' || lat || ']' AS xy, sum(is_start::INT) OVER (PARTITION BY trip_id ORDER BY position) AS line FROM simple),
    ln AS (SELECT trip_id, line, string_agg(xy, ',' ORDER BY position) AS c FROM nl GROUP BY 1, 2 HAVING count(*) > 1),
    ft AS (SELECT trip_id, 0 AS part, line AS place, '{{"type":"Feature","geometry":{{"type":"LineString","coordinates":[' || c || ']}}}}' AS f FROM ln UNION ALL SELECT trip_id, 1, position, '{{"type":"Feature","geometry":{{"type":"Point","coordinates":' || xy || '}}}}' FROM nl WHERE is_marker),
    geo AS MATERIALIZED (SELECT trip_id, count(*)::INT AS features, '{{"type":"FeatureCollection","features":[' || string_agg(f, ',' ORDER BY part, place) || ']}}' AS geojson FROM ft GROUP BY 1)"""
ORACLES = {
    "route_simplified": f"WITH RECURSIVE {OF}, {_SIMPLE} SELECT * FROM simple",
    "route_geojson": f"WITH RECURSIVE {OF}, {_GEO} SELECT * FROM geo",
    "trip_bundle": f"""WITH RECURSIVE bundled AS (SELECT 1), {_GAPS}, {_GEO}, ev AS MATERIALIZED (SELECT trip_id, count(*) AS n_events, '[' || string_agg('{{"t_us":' || t_us || coalesce(',"event_id":' || event_id, '') || ',"kind":"' || kind || '"}}', ',' ORDER BY t_us, event_id, kind) || ']' AS events
            FROM (WITH {EVENTS} SELECT * FROM tev) GROUP BY 1)
        SELECT t.trip_id, t.vehicle_id, t.distance_km, t.completeness, features, n_events, has_gaps, sha256(concat_ws('|', geojson, events)) AS body_hash FROM trips t LEFT JOIN geo USING (trip_id) LEFT JOIN ev USING (trip_id) LEFT JOIN gaps USING (trip_id)""",
    "inspect_fields": f"""WITH {PAY} SELECT replace(substr(j.fullkey, 3), '"', '') AS path, CASE j.type WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS type, count(*) AS payloads
        FROM pay, json_tree(pay.payload::JSON) j WHERE j.type NOT IN ('OBJECT', 'ARRAY') GROUP BY 1, 2""",
    "vehicle_snapshot": f"""WITH {TRIPS}, last AS MATERIALIZED{_LAST_ONLY}, st AS (SELECT vehicle_id, count(*) AS trips, round(sum(distance_km), 4) AS distance_km FROM trips GROUP BY 1), v AS (SELECT *, {MOVE} AS movement, {FRESH} AS freshness FROM last)
        SELECT vehicle_id, fleet_id, concat_ws(',', CASE WHEN freshness IN ('STALE', 'OFFLINE') THEN 'DATA_QUALITY' END, CASE WHEN freshness = 'AWAITING_DATA' THEN 'AWAITING_DATA' END, CASE WHEN fault_code IS NOT NULL THEN 'FAULT_REPORTED' END) AS tags,
            movement, freshness, battery_soc, coalesce(trips, 0) AS trips, coalesce(distance_km, 0.0) AS distance_km FROM v LEFT JOIN st USING (vehicle_id)""",
    "route_sanitize": f"WITH {TEL}, b AS (SELECT vehicle_id, event_id, event_id % 53 = 0 OR event_id % 61 = 0 AS bad FROM tel), n AS (SELECT vehicle_id, event_id, bad, sum(bad::INT) OVER (PARTITION BY vehicle_id ORDER BY event_id)::BIGINT AS line FROM b) SELECT vehicle_id, event_id, line FROM n WHERE NOT bad",
    "webhook_verify": f"WITH {TEL} SELECT event_id, event_id % 5 <> 0 AS valid FROM tel",
    "redact_payload": f"""WITH {TEL} SELECT event_id, '{{"auth":{{"Token":"[REDACTED]"}},"k":' || k || '}}' AS redacted FROM tel""",
}
