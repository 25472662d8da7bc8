"""Queries over repairs by rules, replays, the life of incidents, snapshots and cursors, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.operators import incidents as inc
from wayfold.operators import ingest, state
from wayfold.operators import mapping as mp
from wayfold.operators import payloads as pl
from wayfold.operators import repairs as rep
from wayfold.operators import replay as rp
from wayfold.operators import snapshots as snap
from wayfold.plans.fleet_queries import REC, records, replay_selection
from wayfold.plans.mapping_queries import _FOUND, PAY, payloads
from wayfold.plans.trip_queries import TRIPS, viable
from wayfold.sources.files import stored
from wayfold.sources.fixtures import TEL, telemetry

RULES = rep.RepairRule
REPAIRS = {
    "A": rep.RepairConfig((
        RULES("vehicle_speed", ("speed_mph", "data.speed_mph"), "SCALE_OFFSET", True, {}, 0.5, -1.0), RULES("battery_soc", ("charge_fraction", "data.charge_fraction"), "FRACTION_TO_PERCENT"),
        RULES("ignition_status", ("status", "metadata.status"), "ENUM_MAP", False, {"running": "ON", "stopped": "STOPPED"}), RULES("latitude", ("lat", "data.lat")), RULES("longitude", ("lon",)),
        RULES("harsh_brake", ("harsh_brake",), "ENUM_MAP", False, {"true": "YES", "false": "NO"}), RULES("fault_code", ("fault_code", "metadata.fault_code")), RULES("event_time", ("timestamp", "metadata.timestamp"), "ISO_TIME", True),
    )),
    "B": rep.RepairConfig((
        RULES("vehicle_speed", ("state.velocity_kmh", "velocity_kmh"), "DIRECT", True), RULES("battery_soc", ("state.battery_pct", "battery_pct")), RULES("odometer", ("state.distance_km",), "METRES_TO_KM"),
        RULES("charging_state", ("state.charging",), "ENUM_MAP", False, {"true": "CHARGING", "false": "NOT_CHARGING"}), RULES("event_time", ("time_measured",), "UNIX_MILLISECONDS", True),
    ), ("state.ignition", "true")),
    "C": rep.RepairConfig((
        RULES("vehicle_speed", ("speed",), "DIRECT", True), RULES("battery_soc", ("soc",)), RULES("latitude", ("lat",)), RULES("longitude", ("lon",)),
        RULES("ignition_status", ("status",), "ENUM_MAP", False, {"MOVING": "ON", "IDLE": "ON", "PARKED": "OFF"}), RULES("event_time", ("timestamp",), "ISO_TIME", True),
    )),
}
#: The same, typed out as SQL rows: repair, position, signal, sources, conversion, required, codes, scale, offset, range, choices.
REPAIR_ROWS = """('A', 0, 'vehicle_speed', ['speed_mph', 'data.speed_mph'], 'SCALE_OFFSET', true, NULL, 0.5, -1, 0, 300, NULL), ('A', 1, 'battery_soc', ['charge_fraction', 'data.charge_fraction'], 'FRACTION_TO_PERCENT', false, NULL, 100, 0, 0, 100, NULL),
    ('A', 2, 'ignition_status', ['status', 'metadata.status'], 'ENUM_MAP', false, '{"running":"ON","stopped":"STOPPED"}', NULL, NULL, NULL, NULL, ['ON', 'OFF']), ('A', 3, 'latitude', ['lat', 'data.lat'], 'DIRECT', false, NULL, 1, 0, -90, 90, NULL),
    ('A', 4, 'longitude', ['lon'], 'DIRECT', false, NULL, 1, 0, -180, 180, NULL), ('A', 5, 'harsh_brake', ['harsh_brake'], 'ENUM_MAP', false, '{"true":"YES","false":"NO"}', NULL, NULL, NULL, NULL, ['YES', 'NO']),
    ('A', 6, 'fault_code', ['fault_code', 'metadata.fault_code'], 'DIRECT', false, NULL, NULL, NULL, NULL, NULL, NULL), ('A', 7, 'event_time', ['timestamp', 'metadata.timestamp'], 'ISO_TIME', true, NULL, NULL, NULL, NULL, NULL, NULL),
    ('B', 0, 'vehicle_speed', ['state.velocity_kmh', 'velocity_kmh'], 'DIRECT', true, NULL, 1, 0, 0, 300, NULL), ('B', 1, 'battery_soc', ['state.battery_pct', 'battery_pct'], 'DIRECT', false, NULL, 1, 0, 0, 100, NULL),
    ('B', 2, 'odometer', ['state.distance_km'], 'METRES_TO_KM', false, NULL, 0.001, 0, 0, 2000000, NULL), ('B', 3, 'charging_state', ['state.charging'], 'ENUM_MAP', false, '{"true":"CHARGING","false":"NOT_CHARGING"}', NULL, NULL, NULL, NULL, ['CHARGING', 'NOT_CHARGING']),
    ('B', 4, 'event_time', ['time_measured'], 'UNIX_MILLISECONDS', true, NULL, NULL, NULL, NULL, NULL, NULL),
    ('C', 0, 'vehicle_speed', ['speed'], 'DIRECT', true, NULL, 1, 0, 0, 300, NULL), ('C', 1, 'battery_soc', ['soc'], 'DIRECT', false, NULL, 1, 0, 0, 100, NULL), ('C', 2, 'latitude', ['lat'], 'DIRECT', false, NULL, 1, 0, -90, 90, NULL), ('C', 3, 'longitude', ['lon'], 'DIRECT', false, NULL, 1, 0, -180, 180, NULL),
    ('C', 4, 'ignition_status', ['status'], 'ENUM_MAP', false, '{"MOVING":"ON","IDLE":"ON","PARKED":"OFF"}', NULL, NULL, NULL, NULL, ['ON', 'OFF']), ('C', 5, 'event_time', ['timestamp'], 'ISO_TIME', true, NULL, NULL, NULL, NULL, NULL, NULL)"""
#: The repairs of all payloads: one row of ev2 an event.
EVALUATED = f"""rr(cfg, pos, signal, sources, conv, req, codes, scale, off, lo, hi, choices) AS (VALUES {REPAIR_ROWS}),
    s0 AS (SELECT event_id, payload, pos, unnest(sources) AS path, generate_subscripts(sources, 1) AS place FROM pay JOIN rr ON cfg = vendor), s1 AS (SELECT *, {_FOUND} AS v FROM s0),
    s2 AS (SELECT event_id, pos, arg_min(v, place) AS v FROM s1 WHERE v IS NOT NULL AND json_type(v) <> 'NULL' GROUP BY 1, 2),
    s3 AS (SELECT p.event_id, p.payload, rr.*, v ->> '$' AS txt, CASE json_type(v) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'OBJECT' THEN 'other' WHEN 'ARRAY' THEN 'other' ELSE CASE WHEN v IS NOT NULL THEN 'number' END END AS kind
        FROM pay p JOIN rr ON cfg = vendor LEFT JOIN s2 ON s2.event_id = p.event_id AND s2.pos = rr.pos),
    s4 AS (SELECT *, CASE WHEN kind IN ('number', 'string') THEN try_cast(trim(txt) AS DOUBLE) END AS num, CASE WHEN regexp_matches(txt, '^\\d{{4}}-\\d\\d-\\d\\dT.*(?:Z|[+-]\\d\\d:\\d\\d)$') THEN try_cast(txt AS TIMESTAMPTZ) END AS stamp FROM s3),
    s5 AS (SELECT *, CASE WHEN scale IS NOT NULL THEN num * scale::DOUBLE + off::DOUBLE END AS number,
        CASE conv WHEN 'DIRECT' THEN CASE WHEN scale IS NULL AND kind = 'string' THEN txt END WHEN 'ENUM_MAP' THEN json_extract_string(codes, '$."' || txt || '"') WHEN 'ISO_TIME' THEN strftime(stamp AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.%gZ')
            WHEN 'UNIX_MILLISECONDS' THEN CASE WHEN num > 0 THEN strftime(make_timestamp((num * 1000)::BIGINT), '%Y-%m-%dT%H:%M:%S.%gZ') END END AS text FROM s4),
    s6 AS (SELECT *, CASE WHEN kind IS NULL THEN CASE WHEN req THEN 'required, but missing' ELSE 'unavailable' END
        WHEN scale IS NOT NULL THEN CASE WHEN number IS NULL THEN 'not a number' WHEN number < lo THEN 'below the range' WHEN number > hi THEN 'above the range' END
        WHEN conv = 'ENUM_MAP' AND text IS NULL THEN 'no meaning for this code' WHEN conv = 'ISO_TIME' AND text IS NULL THEN 'no time with a zone' WHEN text IS NULL THEN 'not a text' WHEN choices IS NOT NULL AND NOT list_contains(choices, text) THEN 'not one of its values' END AS message FROM s5),
    ev AS (SELECT event_id, list(signal || ': ' || message ORDER BY pos) FILTER (message IS NOT NULL AND (kind IS NOT NULL OR req)) AS errs, list(signal || ': ' || message ORDER BY pos) FILTER (kind IS NULL AND NOT req) AS warns,
        max(number) FILTER (signal = 'vehicle_speed' AND message IS NULL) AS vehicle_speed, max(number) FILTER (signal = 'battery_soc' AND message IS NULL) AS battery_soc, max(text) FILTER (signal = 'ignition_status' AND message IS NULL) AS ignition_status,
        max(text) FILTER (signal = 'event_time' AND message IS NULL) AS event_time, count(*) FILTER (signal = 'latitude' AND message IS NULL) AS lats, count(*) FILTER (signal = 'longitude' AND message IS NULL) AS lons,
        count(*) FILTER (signal <> 'event_time' AND message IS NULL) AS mapped FROM s6 GROUP BY 1),
    ev2 AS MATERIALIZED (SELECT ev.*, concat_ws('; ', CASE WHEN vendor = 'B' AND coalesce(json_extract_string(payload, '$.state.ignition'), 'null') <> 'true' THEN 'discriminator: another value' END, nullif(array_to_string(errs, '; '), ''),
        CASE WHEN event_time IS NULL THEN 'event_time: not mapped' END, CASE WHEN lats <> lons THEN 'position: half of it' END, CASE WHEN mapped = 0 THEN 'signals: none mapped' END) AS errors, coalesce(array_to_string(warns, '; '), '') AS warnings FROM ev JOIN pay USING (event_id))"""


def repair_report(s: SparkSession, d: str) -> DataFrame:
    """Each payload under its vendor's repair."""
    p, out = payloads(s, d), None
    for vendor, repair in REPAIRS.items():
        part = rep.evaluate(p.where(F.col("vendor") == vendor), repair)
        part = part.select("event_id", "success", F.array_join("errors", "; ").alias("errors"), F.array_join("warnings", "; ").alias("warnings"), F.round("vehicle_speed", 6).alias("vehicle_speed"), F.round("battery_soc", 6).alias("battery_soc"), "ignition_status", "event_time")
        out = part if out is None else out.unionByName(part)
    return out


def repair_rules_valid(s: SparkSession, d: str) -> DataFrame:
    """A set of rules a vehicle, each with the defect that its number asks for."""
    v = telemetry(s, d).select("vehicle_id").distinct()
    n = F.col("vehicle_id") % 13
    rule = lambda position, signal, sources, conversion, required, codes, scale: F.struct(F.lit(position).alias("position"), signal.alias("signal"), sources.alias("sources"), conversion.alias("conversion"), required.alias("required"), codes.alias("codes"), scale.alias("scale"))
    none, text = F.lit(None).cast("map<string,string>"), lambda x: F.lit(x)
    rules = F.array(
        rule(0, F.when(n == 1, "warp_speed").otherwise("vehicle_speed"), F.when(n == 2, F.array(text("auth.token"))).when(n == 3, F.array(text("a..b"))).otherwise(F.array(text("speed"), text("data.speed"))), F.when(n == 4, "CUBE").when(n == 5, "SCALE_OFFSET").when(n == 6, "ENUM_MAP").otherwise("DIRECT"), F.lit(False), none, F.lit(None).cast("double")),
        rule(1, F.when(n == 7, "vehicle_speed").when(n == 8, "altitude").otherwise("event_time"), F.array(text("timestamp")), F.lit("ISO_TIME"), n != 9, none, F.lit(1.0)),
    )
    rows = v.select(F.col("vehicle_id").alias("repair_id"), F.when(n == 10, " ").otherwise("repair").alias("name"), F.when(n == 11, "always").otherwise("matching").alias("live_mode"), F.when(n == 12, "x" * 201).alias("discriminator_path"), F.lit("v").alias("discriminator_value"), F.lit(0.0).alias("offset"), F.inline(rules))
    return rep.validate_rules(rows)


def _replayed(s, d):
    """The events that are still in quarantine, replayed: vendor A's by another profile, the others' by repairs.

    The list of events is written once; the numbering and each vendor's replay read it.
    """
    chosen = stored(replay_selection(s, d))
    events = stored(payloads(s, d).join(chosen.select("event_id"), "event_id", "left_semi"))
    conflicts = chosen.where("event_id % 97 = 0")
    own = tuple(r for r in mp.RULES["A", "1"] if r.signal != "altitude")
    ran = rp.by_profile(events.where("vendor = 'A'"), "A", "1", own)
    for vendor in ("B", "C"):
        ran = ran.unionByName(rp.by_repair(events.where(F.col("vendor") == vendor), REPAIRS[vendor], conflicts))
    return chosen.withColumn("job_id", rp.job_of(F.col("vendor"), F.col("fleet_id"))), ran


def replay_run(s, d):
    """Every item of the replays by vendor and fleet, with its place, its batch and what became of it."""
    items, ran = _replayed(s, d)
    return rp.frozen(items).join(ran, "event_id").select("job_id", "event_id", "position", "batch", "item_status", "message")


def replay_narrowed(s, d):
    """A replay of one connection of one fleet and vendor."""
    return replay_selection(s, d, fleet_id=2, vendor="B", connection_id="f2-B").select("event_id", "t_us")


def incident_events(s: SparkSession, d: str) -> DataFrame:
    """What happens to incidents: errors fail, some again, most are resolved later; sign-ups act on the incident of their time."""
    t = telemetry(s, d)
    category = F.when(F.col("k") % 2 == 0, "INVALID_VALUE").otherwise("SCHEMA_CHANGE")
    t = t.withColumn("category", category)
    step = lambda j, kind, seconds, reason, where: F.when(where, F.struct(F.lit(j).alias("j"), F.lit(kind).alias("kind"), (F.col("t_us") + seconds * 1_000_000).alias("at_us"), F.lit(reason).alias("reason")))
    steps = F.array_compact(F.array(
        step(0, inc.FAIL, F.lit(0), "first", F.lit(True)), step(1, inc.REPLAY_FAILED, F.lit(20), "replay", F.col("event_id") % 4 == 0), step(2, inc.FAIL, F.lit(25), "again", F.col("event_id") % 3 == 0),
        step(3, inc.RESOLVE, F.col("k") + 10, None, F.col("event_id") % 7 != 0), step(4, inc.FAIL, F.col("k") + 40, "anew", F.col("event_id") % 5 == 0), step(5, inc.RESOLVE, F.col("k") + 50, None, F.col("event_id") % 11 != 0),
    ))
    shown = [F.when(F.col("event_id") % 2 == 0, x).alias(n) for n, x in (("expected", "1"), ("observed", "2"))]
    failures = t.where("event_type = 'error'").select("fleet_id", "connection_id", "category", F.col("event_id").alias("raw_id"), F.when(F.col("event_id") % 6 != 0, F.col("vehicle_id")).alias("vehicle_id"), *shown, "event_id", F.explode(steps).alias("x"))
    failures = failures.select("fleet_id", "connection_id", "category", "raw_id", "vehicle_id", "x.kind", F.col("x.at_us").alias("t_us"), (F.col("event_id") * 8 + F.col("x.j")).alias("seq"), "x.reason", "expected", "observed")
    kind = F.when(F.col("k") % 3 == 0, inc.ACKNOWLEDGE).when(F.col("k") % 3 == 1, inc.MAPPING_READY).otherwise(inc.REPLAY)
    none = F.lit(None)
    acts = t.where("event_type = 'signup'").select("fleet_id", "connection_id", "category", none.cast("long").alias("raw_id"), none.cast("long").alias("vehicle_id"), kind.alias("kind"), "t_us", (F.col("event_id") * 8).alias("seq"), *[none.cast("string").alias(c) for c in ("reason", "expected", "observed")])
    return failures.unionByName(acts)


INCIDENTS = f"""{TEL}, t AS (SELECT *, CASE WHEN k % 2 = 0 THEN 'INVALID_VALUE' ELSE 'SCHEMA_CHANGE' END AS category FROM tel),
    fe AS (SELECT t.*, s.*, t_us + 1000000 * secs AS stamp_us FROM t, LATERAL (SELECT unnest(['FAIL', 'REPLAY_FAILED', 'FAIL', 'RESOLVE', 'FAIL', 'RESOLVE']) AS kind, unnest([0, 1, 2, 3, 4, 5]) AS j, unnest(['first', 'replay', 'again', NULL, 'anew', NULL]) AS reason,
        unnest([0, 20, 25, k + 10, k + 40, k + 50]) AS secs, unnest([true, event_id % 4 = 0, event_id % 3 = 0, event_id % 7 <> 0, event_id % 5 = 0, event_id % 11 <> 0]) AS used) s WHERE event_type = 'error' AND used),
    r0 AS (SELECT *, event_id * 8 + j AS seq, last_value(CASE WHEN kind IN ('FAIL', 'RESOLVE') THEN kind END IGNORE NULLS) OVER (PARTITION BY event_id ORDER BY stamp_us, j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM fe),
    r1 AS (SELECT *, kind = 'FAIL' AND before IS DISTINCT FROM 'FAIL' AS opens, kind = 'RESOLVE' AS closes FROM r0 WHERE kind = 'FAIL' OR before = 'FAIL'),
    r2 AS (SELECT *, sum(opens::INT) OVER (PARTITION BY event_id ORDER BY stamp_us, j) AS record FROM r1),
    a0 AS (SELECT fleet_id, connection_id, category, event_id AS raw_id, CASE WHEN event_id % 6 <> 0 THEN vehicle_id END AS vehicle_id, kind, stamp_us, seq, reason, CASE WHEN event_id % 2 = 0 THEN '1' END AS expected, CASE WHEN event_id % 2 = 0 THEN '2' END AS observed, opens, closes, record FROM r2
        UNION ALL SELECT fleet_id, connection_id, category, NULL, NULL, CASE k % 3 WHEN 0 THEN 'ACKNOWLEDGE' WHEN 1 THEN 'MAPPING_READY' ELSE 'REPLAY' END, t_us, event_id * 8, NULL, NULL, NULL, false, false, NULL FROM t WHERE event_type = 'signup'),
    a1 AS (SELECT *, sum(opens::INT - closes::INT) OVER (PARTITION BY fleet_id, connection_id, category ORDER BY stamp_us, seq ROWS UNBOUNDED PRECEDING) AS live FROM a0),
    a2 AS MATERIALIZED (SELECT *, sum((opens AND live = 1)::INT) OVER (PARTITION BY fleet_id, connection_id, category ORDER BY stamp_us, seq ROWS UNBOUNDED PRECEDING)::BIGINT AS number FROM a1 QUALIFY number > 0),
    rec AS MATERIALIZED (SELECT fleet_id, connection_id, category, number, raw_id, record::BIGINT AS record, any_value(vehicle_id) AS vehicle_id, min(stamp_us) AS first_us, max(stamp_us) FILTER (kind = 'FAIL') AS latest_us, count(*) FILTER (kind = 'FAIL') AS failures,
        arg_max(reason, (stamp_us, seq)) FILTER (kind IN ('FAIL', 'REPLAY_FAILED')) AS reason, bool_or(closes) AS closed, bool_or(kind = 'REPLAY_FAILED') AS bad, min((stamp_us, seq)) AS opened FROM a2 WHERE raw_id IS NOT NULL GROUP BY ALL),
    rec2 AS MATERIALIZED (SELECT r.*, CASE WHEN closed THEN 'RESOLVED' WHEN bad THEN 'REPLAY_FAILED' WHEN EXISTS (SELECT 1 FROM a2 x WHERE x.kind = 'REPLAY' AND x.fleet_id = r.fleet_id AND x.connection_id = r.connection_id AND x.category = r.category AND x.number = r.number AND (x.stamp_us, x.seq) > r.opened) THEN 'REPLAYING' ELSE 'UNRESOLVED' END AS status FROM rec r)"""


def _lived(s, d):
    return inc.numbered(incident_events(s, d), 3_600_000_000)


def incident_life(s, d):
    lived = _lived(s, d)
    out = inc.incidents(lived, inc.records(lived), F.substring_index("connection_id", "-", -1))
    return out.withColumn("stale", F.array_join("stale", ","))


def incident_life_records(s, d):
    return inc.records(_lived(s, d))


def _bodies(s, d, version: int) -> DataFrame:
    t = telemetry(s, d).where(F.col("event_id") % 3 < version)
    if version == 2:
        t = t.where("vehicle_id % 9 <> 0")
    return t.groupBy(F.lit("vehicle").alias("kind"), F.col("vehicle_id").cast("string").alias("entity")).agg(F.concat(F.lit('{"readings":'), F.count("*").cast("string"), F.lit(',"soc":'), F.min(F.floor(F.col("battery_soc") / 10)).cast("string"), F.lit("}")).alias("body"))


def snapshot_versions(s, d):
    """The log of three versions of the vehicles' snapshots; some vehicles are gone in the second and back in the third."""
    log = s.createDataFrame([], snap.SCHEMA)
    for version in (1, 2, 3):
        log = log.unionByName(snap.changed(snap.latest(log), _bodies(s, d, version)).withColumn("version", F.lit(version)))
    return log


def state_backfill(s, d):
    """Values from every third event, filled from the newest 100 of each vehicle."""
    t = telemetry(s, d).withColumn("signals", F.create_map(F.lit("vehicle_speed"), F.round(F.col("speed_kmh") * 100).cast("long").cast("string"), F.lit("ignition_status"), F.col("ignition"), F.lit("fault_code"), F.col("fault_code")))
    some = t.where("event_id % 3 = 0").select("vehicle_id", "t_us", F.col("t_us").alias("received_us"), F.col("event_id").alias("arrival_seq"), F.explode("signals").alias("signal", "value"))
    return state.backfill(state.current_values(some), t.select("vehicle_id", "event_id", "t_us", "signals"))


def source_rewind(s, d):
    e = F.col("event_id")
    polls = telemetry(s, d).select(
        "event_id", F.when(e % 7 == 1, "abc").when(e % 7 != 0, e.cast("string")).alias("cursor"), (e % 3).alias("events"), F.when(e % 3 > 0, e + 5).alias("last_sequence"),
        F.when(e % 11 != 0, F.when(e % 5 == 0, e - 10).otherwise(e + 1)).alias("latest_sequence"),
    )
    return ingest.rewound(polls).select("event_id", "action", "next_cursor")


def read_bootstrap(s, d):
    """What an empty store of snapshots asks for."""
    return snap.bootstrap(telemetry(s, d).select("vehicle_id").distinct(), viable(s, d), s.createDataFrame([], snap.SCHEMA))


def webhook_accept(s, d):
    """Requests with one defect or none: what is wrong with each, and the vehicle and event that it names."""
    t = telemetry(s, d).select("event_id", "vehicle_id", "connection_id", "fleet_id", "vendor")
    e = F.col("event_id")
    named = F.when(e % 13 == 0, "").otherwise(F.concat(F.lit('"'), F.when(e % 3 == 0, "source_vehicle_id").otherwise("vehicle_identifier"), F.lit('":"v'), F.when(e % 17 == 0, F.col("vehicle_id") + 15).otherwise(F.col("vehicle_id")).cast("string"), F.lit('",')))
    body = F.concat(F.lit("{"), named, F.when(e % 4 == 0, "").otherwise(F.concat(F.lit('"event_id":"e'), e.cast("string"), F.lit('",'))), F.lit('"n":1}'))
    sign = F.pandas_udf(lambda b: b.map(lambda x: "sha256=" + pl.sign(x, "key")), "string")
    sent = t.withColumn("body", body).withColumn("good", sign("body"))
    header = F.when(e % 2 == 0, "x-signature").otherwise("x-signature-sha256")
    headers = F.when(e % 19 == 0, F.create_map(F.lit("x-event-id"), F.lit("h"))).otherwise(F.create_map(header, F.when(e % 5 == 0, "0" * 64).otherwise(F.col("good")), F.lit("x-event-id"), F.lit("h")))
    requests = sent.select("event_id", F.when(e % 23 == 0, "f9-Z").otherwise(F.col("connection_id")).alias("connection_id"), headers.alias("headers"), "body")
    connections = t.select("connection_id", "fleet_id", "vendor").distinct().select("connection_id", F.when((F.col("fleet_id") != 3) | (F.col("vendor") != "C"), "key").alias("secret"))
    mappings = t.where("vehicle_id % 29 <> 0").select("connection_id", F.concat(F.lit("v"), F.col("vehicle_id").cast("string")).alias("source_vehicle_id")).distinct()
    return pl.webhook(requests, connections, mappings).select("event_id", "problem", "source_vehicle_id", "source_event_id")


QUERIES = {
    "repair_report": repair_report,
    "repair_rules_valid": repair_rules_valid,
    "replay_run": replay_run,
    "replay_narrowed": replay_narrowed,
    "replay_jobs": lambda s, d: rp.outcomes(replay_run(s, d)),
    "incident_life": incident_life,
    "incident_life_records": incident_life_records,
    "snapshot_versions": snapshot_versions,
    "state_backfill": state_backfill,
    "source_rewind": source_rewind,
    "read_bootstrap": read_bootstrap,
    "webhook_accept": webhook_accept,
}

_REPLAYED = f"""{REC}, {EVALUATED}, open_ AS (SELECT DISTINCT event_id, t_us, fleet_id, split_part(connection_id, '-', 2) AS vendor FROM rec WHERE status <> 'RESOLVED'),
    other AS (SELECT event_id, arg_min(err, pos) FILTER (err IS NOT NULL AND signal <> 'altitude') AS err FROM r3 GROUP BY 1),
    ran AS MATERIALIZED (SELECT o.*, vendor || '-' || fleet_id AS job_id, CASE WHEN vendor = 'A' THEN CASE WHEN d.verdict <> 'OK' THEN d.verdict WHEN d.version = '1' AND other.err IS NOT NULL THEN other.err WHEN d.version <> '1' THEN 'SCHEMA_CHANGE:profile mismatch' END
        WHEN o.event_id % 97 = 0 THEN 'conflicting identity' ELSE nullif(errors, '') END AS message FROM open_ o JOIN (SELECT event_id, verdict, version FROM det) d USING (event_id) LEFT JOIN other USING (event_id) LEFT JOIN ev2 USING (event_id)),
    placed AS (SELECT job_id, event_id, row_number() OVER (PARTITION BY job_id ORDER BY t_us, event_id) AS position, CASE WHEN message IS NULL THEN 'DONE' ELSE 'FAILED' END AS item_status, message FROM ran)"""
ORACLES = {
    "repair_report": f"WITH {PAY}, {EVALUATED} SELECT event_id, errors = '' AS success, errors, warnings, round(vehicle_speed, 6) AS vehicle_speed, round(battery_soc, 6) AS battery_soc, ignition_status, event_time FROM ev2",
    "repair_rules_valid": f"""WITH {TEL} SELECT DISTINCT vehicle_id AS repair_id, CASE vehicle_id % 13 WHEN 1 THEN 'unknown signal' WHEN 2 THEN 'sources' WHEN 3 THEN 'sources' WHEN 4 THEN 'conversion' WHEN 5 THEN 'scale' WHEN 6 THEN 'codes' WHEN 7 THEN 'signal mapped twice'
        WHEN 8 THEN 'no event time' WHEN 9 THEN 'event time must be required' WHEN 10 THEN 'name' WHEN 11 THEN 'live mode' WHEN 12 THEN 'filter' END AS problem FROM tel""",
    "replay_run": f"WITH {_REPLAYED} SELECT job_id, event_id, position, (position - 1) // 25 AS batch, item_status, message FROM placed",
    "replay_narrowed": f"WITH {REC} SELECT DISTINCT event_id, t_us FROM rec WHERE status <> 'RESOLVED' AND connection_id = 'f2-B'",
    "replay_jobs": f"""WITH {_REPLAYED} SELECT job_id, count(*) AS total, count(*) FILTER (item_status = 'DONE') AS done, count(*) FILTER (item_status = 'FAILED') AS failed, 100::INT AS percent,
        CASE WHEN bool_and(item_status = 'DONE') THEN 'SUCCESS' WHEN bool_or(item_status = 'DONE') THEN 'PARTIAL_SUCCESS' ELSE 'FAILED' END AS outcome FROM placed GROUP BY 1""",
    "incident_life": f"""WITH {INCIDENTS}, i AS (SELECT fleet_id, connection_id, category, number, min(stamp_us) FILTER (opens) AS first_us, max(stamp_us) FILTER (opens) AS last_us, arg_min({{'r': reason, 'e': expected, 'o': observed}}, (stamp_us, seq)) FILTER (opens) AS f,
            arg_max(CASE WHEN closes AND live = 0 THEN 'RESOLVED' WHEN kind = 'REPLAY' THEN 'REPLAYING' WHEN opens THEN 'UNRESOLVED' ELSE kind END, (stamp_us, seq)) FILTER ((closes AND live = 0) OR kind IN ('MAPPING_READY', 'REPLAY', 'REPLAY_FAILED') OR (opens AND live = 1)) AS status, max(stamp_us) FILTER (kind = 'ACKNOWLEDGE') AS acknowledged_us FROM a2 GROUP BY ALL),
        o AS (SELECT fleet_id, connection_id, category, number, count(DISTINCT raw_id) AS open_events, count(DISTINCT vehicle_id) AS open_vehicles FROM rec2 WHERE status <> 'RESOLVED' GROUP BY ALL)
        SELECT i.* EXCLUDE (f), f.r AS description, coalesce(open_events, 0) AS open_events, coalesce(open_vehicles, 0) AS open_vehicles, CASE category WHEN 'INVALID_VALUE' THEN 'health,alerts' ELSE 'location,trips,health,alerts' END AS stale,
            CASE WHEN category = 'INVALID_VALUE' THEN connection_id[4:] || ' is sending out-of-range sensor values' WHEN f.e IS NOT NULL THEN connection_id[4:] || ' format changed – expected 1, received 2' ELSE connection_id[4:] || ' event format does not match any known mapping' END AS title
        FROM i LEFT JOIN o USING (fleet_id, connection_id, category, number)""",
    "incident_life_records": f"WITH {INCIDENTS} SELECT fleet_id, connection_id, category, number, raw_id, record, vehicle_id, first_us, latest_us, failures, reason, status FROM rec2",
    "snapshot_versions": f"""WITH {TEL}, n AS (SELECT unnest([1, 2, 3]) AS version), b AS (SELECT version, vehicle_id, '{{"readings":' || count(*) || ',"soc":' || min(battery_soc // 10) || '}}' AS body FROM n JOIN tel ON event_id % 3 < version WHERE NOT (version = 2 AND vehicle_id % 9 = 0) GROUP BY 1, 2),
        g AS (SELECT version, vehicle_id, body, lag(body) OVER (PARTITION BY vehicle_id ORDER BY version) AS before FROM (SELECT vehicle_id, version FROM (SELECT DISTINCT vehicle_id FROM tel), n) LEFT JOIN b USING (version, vehicle_id)), c AS (SELECT * FROM g WHERE body IS DISTINCT FROM before)
        SELECT 'vehicle' AS kind, vehicle_id::VARCHAR AS entity, row_number() OVER (PARTITION BY vehicle_id ORDER BY version) AS revision, body, version::INT AS version FROM c""",
    "state_backfill": f"""WITH {TEL}, x AS (SELECT vehicle_id, event_id, t_us, unnest(['vehicle_speed', 'ignition_status', 'fault_code']) AS signal, unnest([round(speed_kmh * 100)::BIGINT::VARCHAR, ignition, fault_code]) AS value, row_number() OVER (PARTITION BY vehicle_id ORDER BY t_us DESC, event_id DESC) AS n FROM tel),
        o AS (SELECT vehicle_id, signal, arg_max(value, (t_us, event_id)) AS value, max(t_us) AS t FROM x WHERE event_id % 3 = 0 AND value IS NOT NULL GROUP BY 1, 2), f AS (SELECT vehicle_id, signal, arg_max(value, (t_us, event_id)) AS value, max(t_us) AS t FROM x WHERE n <= 100 AND value IS NOT NULL GROUP BY 1, 2)
        SELECT vehicle_id, signal, CASE WHEN o.t IS NULL OR o.t < f.t THEN f.value ELSE o.value END AS value, CASE WHEN o.t IS NULL OR o.t < f.t THEN f.t ELSE o.t END AS t_us FROM o FULL JOIN f USING (vehicle_id, signal)""",
    "source_rewind": f"""WITH {TEL}, p AS (SELECT event_id AS e, CASE e % 7 WHEN 0 THEN NULL WHEN 1 THEN 'abc' ELSE e::VARCHAR END AS c, CASE WHEN e % 11 = 0 THEN NULL WHEN e % 5 = 0 THEN e - 10 ELSE e + 1 END AS l FROM tel)
        SELECT e AS event_id, CASE WHEN e % 3 > 0 THEN 'ADVANCE' WHEN c IS NOT NULL AND l IS NOT NULL AND (c = 'abc' OR l < e) THEN 'REWIND' ELSE 'WAIT' END AS action,
            CASE WHEN e % 3 > 0 THEN (e + 5)::VARCHAR WHEN c IS NOT NULL AND l IS NOT NULL AND (c = 'abc' OR l < e) THEN l::VARCHAR ELSE c END AS next_cursor FROM p""",
    "read_bootstrap": f"WITH {TRIPS} SELECT DISTINCT 'vehicle' AS kind, vehicle_id::VARCHAR AS entity_id, vehicle_id FROM tel UNION ALL SELECT 'trip', trip_id::VARCHAR, vehicle_id FROM trips",
    "webhook_accept": f"""WITH {TEL}, m AS (SELECT DISTINCT vehicle_id AS v, connection_id AS c FROM tel WHERE vehicle_id % 29 <> 0),
        q AS (SELECT event_id AS e, connection_id AS c, vehicle_id + CASE WHEN event_id % 17 = 0 THEN 15 ELSE 0 END AS v FROM tel),
        w AS (SELECT *, CASE WHEN e % 23 = 0 THEN '404 no such connection' WHEN c = 'f3-C' THEN '401 no subscription' WHEN e % 19 = 0 THEN '401 no signature' WHEN e % 5 = 0 THEN '401 wrong signature' WHEN e % 13 = 0 THEN '400 no vehicle'
            WHEN EXISTS (SELECT 1 FROM m WHERE m.v = q.v AND m.c <> q.c) THEN '403 of another connection' WHEN EXISTS (SELECT 1 FROM m WHERE m.c = q.c) AND NOT EXISTS (SELECT 1 FROM m WHERE m.v = q.v AND m.c = q.c) THEN '403 not of this connection' END AS problem FROM q)
        SELECT e AS event_id, problem, CASE WHEN e % 13 <> 0 THEN 'v' || v END AS source_vehicle_id, CASE WHEN e % 4 = 0 THEN 'h' ELSE 'e' || e END AS source_event_id FROM w""",
}
