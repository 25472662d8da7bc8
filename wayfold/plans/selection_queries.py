"""Queries over tenants, profiles, live repairs, publishing and refreshes, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold.operators import selection as sl
from wayfold.plans.mapping_queries import DETECTED, PAY, detected, payloads
from wayfold.sources.fixtures import TEL, telemetry


def tenant_check(s, d):
    """One event in eleven comes from another fleet; fleet 3 has no connection to vendor C."""
    t = telemetry(s, d)
    asked = t.select("event_id", "connection_id", F.when(F.col("event_id") % 11 == 0, (F.col("fleet_id") + 1) % 5).otherwise(F.col("fleet_id")).alias("fleet_id"))
    return sl.tenant_check(asked, t.where("NOT (fleet_id = 3 AND vendor = 'C')")).select("event_id", "tenant")


FORMATS = [("A", "1"), ("A", "2"), ("B", "1"), ("C", "1"), ("C", "2")]
PROFILES = [sl.Profile("p1", "A", "1"), sl.Profile("p2", "A", "2", "RETIRED"), sl.Profile("p3", "B", "1"), sl.Profile("p4", "C", "1")]


def profile_resolution(s, d):
    """Some events force a profile, one of which doesn't exist."""
    forced = F.when(F.col("event_id") % 6 == 0, "p2").when(F.col("event_id") % 6 == 1, "p9")
    rows = detected(s, d).withColumn("forced_id", forced)
    return sl.resolve_profile(rows, FORMATS, PROFILES).select("event_id", "profile_id", "problem")


REPAIRS = [
    sl.Repair("r1", "A", 100, "matching", (("speed_mph", "data.speed_mph"),)),
    sl.Repair("r2", "A", 200, "invalid_only", (("lat",), ("timestamp", "time"))),
    sl.Repair("r3", "A", 300, "replay_only", ()),
    sl.Repair("r4", "C", 100, "matching", (("speed",),), ("status", "IDLE")),
    sl.Repair("r5", "C", 50, "invalid_only", (("soc",),)),
]


def live_repair(s, d):
    """The newest repair that applies to each payload; repairs are published by vendor here."""
    own = F.col("event_id") % 4 != 0
    rows = payloads(s, d).select("event_id", "payload", F.col("vendor").alias("connection_id"), own.alias("own_valid"))
    return sl.live_repair(rows, REPAIRS).select("event_id", "repair_id")


def publish_gate(s, d):
    """A draft a vehicle, tested by its events."""
    t = telemetry(s, d)
    v = F.col("draft_id")
    drafts = t.select(F.col("vehicle_id").alias("draft_id")).distinct().select(
        "draft_id", F.when(v % 7 == 0, "ACTIVE").otherwise("DRAFT").alias("status"), (v % 3).alias("revision"), F.when(v % 5 != 0, v % 3).alias("tested_revision"), (v % 3 + F.when(v % 4 == 0, 1).otherwise(0)).alias("asked_revision")
    )
    results = t.select(F.col("vehicle_id").alias("draft_id"), (F.col("event_type") == "view").alias("regression"), (F.col("k") > 3).alias("success"))
    return sl.publish_gate(drafts, results)


def _changes(s, d):
    """A trip changes with every purchase, a vehicle with every other event, and errors quarantine something."""
    t = telemetry(s, d)
    trip = F.col("event_type") == "purchase"
    kind = F.when(trip, "trip").when(F.col("event_type") == "error", "quarantine").otherwise("vehicle")
    return t.select(kind.alias("kind"), F.when(trip, F.floor(F.col("event_id") / 10)).otherwise(F.col("vehicle_id")).cast("long").alias("entity_id"), F.when(F.col("event_id") % 13 != 0, F.col("vehicle_id")).alias("vehicle_id"), F.col("t_us").alias("changed_us"))


def _queue(s, d):
    changes = _changes(s, d)
    trips = changes.where("kind = 'trip' AND vehicle_id % 2 = 0").select(F.col("entity_id").alias("trip_id"), "vehicle_id").distinct()
    return sl.refresh_queue(changes, trips), changes.where("vehicle_id IS NOT NULL").agg(F.max("changed_us").alias("now")).scalar()


def refresh_queue(s, d):
    """The queue at the time of the last change, and what is due by then."""
    queue, now = _queue(s, d)
    return sl.refresh_due(queue, now, 600_000_000, 3_000_000_000)


def refresh_schedule(s, d):
    """The queue after a pass of 40, of which some fail and some have changed meanwhile."""
    queue, now = _queue(s, d)
    number = F.col("entity_id").cast("long")
    queue = queue.withColumns({"attempts": (number % 10).cast("int"), "retry_us": F.when(number % 6 == 0, now + 1).otherwise(F.lit(None).cast("long"))})
    picked = sl.refresh_pick(queue, now, 40, 600_000_000, 3_000_000_000)
    results = picked.select("kind", "entity_id", (F.col("generation") - F.when(number % 5 == 0, 1).otherwise(0)).alias("generation"), (number % 3 == 0).alias("failed"))
    return sl.refresh_acknowledge(queue, results, now)


def _profile_sql() -> str:
    profiles = ", ".join(f"('{p.id}', '{p.vendor}', '{p.version}', '{p.status}')" for p in PROFILES)
    return f"""WITH {DETECTED}, pr(id, vendor, version, status) AS (VALUES {profiles}), fm(vendor, version) AS (VALUES {', '.join(map(str, FORMATS))}),
        x AS (SELECT event_id, vendor, version, CASE event_id % 6 WHEN 0 THEN 'p2' WHEN 1 THEN 'p9' END AS forced_id FROM det),
        y AS (SELECT x.*, f.id AS known_id, f.vendor IS NOT DISTINCT FROM x.vendor AND f.version IS NOT DISTINCT FROM x.version AS fits, a.id AS active_id, fm.vendor IS NOT NULL AS known
            FROM x LEFT JOIN pr f ON f.id = x.forced_id LEFT JOIN pr a ON a.vendor = x.vendor AND a.version = x.version AND a.status = 'ACTIVE' LEFT JOIN fm ON fm.vendor = x.vendor AND fm.version = x.version),
        z AS (SELECT *, CASE WHEN forced_id IS NOT NULL THEN CASE WHEN known_id IS NULL THEN 'UNKNOWN_FORMAT:profile not found' WHEN NOT fits THEN 'SCHEMA_CHANGE:profile mismatch' END
            WHEN NOT known THEN 'UNKNOWN_FORMAT:version' WHEN active_id IS NULL THEN 'SCHEMA_CHANGE:no active profile' END AS problem FROM y)
        SELECT event_id, CASE WHEN problem IS NULL THEN coalesce(forced_id, active_id) END AS profile_id, problem FROM z"""


_QUEUE = f"""{TEL}, ch AS MATERIALIZED (SELECT CASE event_type WHEN 'purchase' THEN 'trip' WHEN 'error' THEN 'quarantine' ELSE 'vehicle' END AS kind, CASE WHEN event_type = 'purchase' THEN event_id // 10 ELSE vehicle_id END AS entity_id, vehicle_id, t_us FROM tel WHERE event_id % 13 <> 0),
    tr AS (SELECT DISTINCT entity_id AS trip_id, vehicle_id FROM ch WHERE kind = 'trip' AND vehicle_id % 2 = 0),
    u AS (SELECT 'vehicle' AS kind, vehicle_id::VARCHAR AS entity_id, vehicle_id, t_us FROM ch UNION ALL SELECT 'trip', entity_id::VARCHAR, vehicle_id, t_us FROM ch WHERE kind = 'trip'
        UNION ALL SELECT 'trip', trip_id::VARCHAR, vehicle_id, t_us FROM tr JOIN ch USING (vehicle_id) WHERE kind = 'quarantine'),
    q AS MATERIALIZED (SELECT kind, entity_id, max(vehicle_id) AS vehicle_id, count(*) AS generation, min(t_us) AS first_us, max(t_us) AS last_us FROM u GROUP BY 1, 2)"""


QUERIES = {
    "tenant_check": tenant_check,
    "profile_resolution": profile_resolution,
    "live_repair": live_repair,
    "publish_gate": publish_gate,
    "refresh_queue": refresh_queue,
    "refresh_schedule": refresh_schedule,
}
ORACLES = {
    "tenant_check": f"""WITH {TEL}, c AS (SELECT DISTINCT connection_id, fleet_id FROM tel WHERE NOT (fleet_id = 3 AND vendor = 'C'))
        SELECT event_id, CASE WHEN EXISTS (SELECT 1 FROM c WHERE c.connection_id = tel.connection_id AND c.fleet_id = CASE WHEN event_id % 11 = 0 THEN (tel.fleet_id + 1) % 5 ELSE tel.fleet_id END) THEN 'ACCEPTED' ELSE 'CONNECTION_NOT_FOUND' END AS tenant FROM tel""",
    "profile_resolution": _profile_sql(),
    "live_repair": f"""WITH {PAY} SELECT event_id, CASE WHEN vendor = 'A' THEN CASE
            WHEN event_id % 4 = 0 AND json_exists(payload, '$.lat') AND (json_exists(payload, '$.timestamp') OR json_exists(payload, '$.time')) THEN 'r2'
            WHEN json_exists(payload, '$.speed_mph') OR json_exists(payload, '$.data.speed_mph') OR json_exists(payload, '$."data.speed_mph"') THEN 'r1' END
        WHEN vendor = 'C' THEN CASE WHEN json_extract_string(payload, '$.status') = 'IDLE' AND json_exists(payload, '$.speed') THEN 'r4' WHEN event_id % 4 = 0 AND json_exists(payload, '$.soc') THEN 'r5' END END AS repair_id FROM pay""",
    "publish_gate": f"""WITH {TEL}, g AS (SELECT vehicle_id AS v, count(*) FILTER (event_type <> 'view' AND k > 3) AS passed, count(*) FILTER (event_type = 'view' AND k <= 3) AS broken FROM tel GROUP BY 1)
        SELECT v AS draft_id, CASE WHEN v % 7 = 0 OR v % 4 = 0 THEN 'CONFLICT' WHEN v % 5 = 0 THEN 'UNTESTED' WHEN passed = 0 OR broken > 0 THEN 'TESTS_FAILED' ELSE 'PUBLISHED' END AS verdict FROM g""",
    "refresh_queue": f"""WITH {_QUEUE} SELECT *, generation = 1 OR last_us <= (SELECT max(last_us) FROM q) - 600000000 OR first_us <= (SELECT max(last_us) FROM q) - 3000000000 AS due FROM q""",
    "refresh_schedule": f"""WITH {_QUEUE}, n AS (SELECT max(last_us) AS now FROM q), a AS (SELECT q.*, now, entity_id::BIGINT AS c, (c % 10)::INT AS attempts, CASE WHEN c % 6 = 0 THEN now + 1 END AS retry_us FROM q, n),
        due AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY first_us, entity_id) AS place FROM a WHERE coalesce(retry_us <= now, true) AND (generation = 1 OR last_us <= now - 600000000 OR first_us <= now - 3000000000)),
        res AS (SELECT kind, entity_id, generation - CASE WHEN c % 5 = 0 THEN 1 ELSE 0 END AS read, c % 3 = 0 AS failed FROM due WHERE place <= 20)
        SELECT kind, entity_id, vehicle_id, generation, first_us, last_us, CASE WHEN failed AND read = generation THEN attempts + 1 ELSE attempts END AS attempts,
            CASE WHEN failed AND read = generation THEN now + 1000000 * CASE WHEN attempts + 1 >= 8 THEN 256 ELSE (1 << (attempts + 1)) END ELSE retry_us END AS retry_us
        FROM a LEFT JOIN res USING (kind, entity_id) WHERE NOT coalesce(read = generation AND NOT failed, false)""",
}
