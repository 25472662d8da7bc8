"""Queries over quarantine, insights, imports, jobs and the change feed, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.functions.scalars import SECOND
from wayfold.operators import fleet as fl
from wayfold.operators import replay as rp
from wayfold.plans.ingest_queries import FRESH, LAST, RAW, freshness, last_seen, raw, verdicts
from wayfold.plans.mapping_queries import NORMAL, normalized
from wayfold.plans.trip_queries import EVENTS, events
from wayfold.sources.fixtures import TEL, telemetry


def records(s: SparkSession, d: str) -> DataFrame:
    """A quarantine record of each payload that did not normalize; some are resolved later."""
    bad = normalized(s, d).where("verdict <> 'OK'")
    status = F.when(F.col("event_id") % 5 == 0, fl.RESOLVED).when(F.col("event_id") % 7 == 0, fl.ACKNOWLEDGED).otherwise(fl.UNRESOLVED)
    known = F.when(F.col("event_id") % 9 != 0, F.col("vehicle_id"))
    return fl.quarantine_records(bad.withColumns({"status": status, "attempt": (F.col("event_id") % 3).cast("int"), "known_vehicle": known}))


REC = f"""{NORMAL}, rec AS MATERIALIZED (SELECT n.event_id, n.vehicle_id, n.fleet_id, n.connection_id, n.t_us, split_part(n.verdict, ':', 1) AS category, split_part(n.verdict, ':', 2) AS reason,
    CASE WHEN n.event_id % 5 = 0 THEN 'RESOLVED' WHEN n.event_id % 7 = 0 THEN 'ACKNOWLEDGED' ELSE 'UNRESOLVED' END AS status, (n.event_id % 3)::INT AS attempt, CASE WHEN n.event_id % 9 <> 0 THEN n.vehicle_id END AS known_vehicle
    FROM norm n WHERE n.verdict <> 'OK' AND split_part(n.verdict, ':', 1) <> 'INFRA_ERROR')"""
INC = f"""{REC}, inc AS MATERIALIZED (SELECT fleet_id, connection_id, category, sha256(fleet_id || '|' || connection_id || '|' || category) AS incident_id, min(t_us) AS first_us, max(t_us) AS last_us,
    count(DISTINCT CASE WHEN status <> 'RESOLVED' THEN event_id END) AS open_events, count(DISTINCT CASE WHEN status <> 'RESOLVED' THEN known_vehicle END) AS open_vehicles,
    CASE WHEN bool_and(status = 'RESOLVED') THEN 'RESOLVED' ELSE 'UNRESOLVED' END AS status FROM rec GROUP BY 1, 2, 3)"""


def incidents(s, d):
    return fl.incidents(records(s, d))


#: Reasons as they are raised, each with its category, typed out.
REASONS = (
    ("Invalid coordinates: latitude 95 out of bounds", "INVALID_COORDINATES"), ("Missing longitude", "INVALID_COORDINATES"), ("Unparseable timestamp value", "INVALID_TIME"),
    ("Invalid event time", "INVALID_TIME"), ("Bad time format", "INVALID_TIME"), ("Invalid number for speed", "INVALID_VALUE"), ("speed is above max 250", "INVALID_VALUE"), ("charge is below min 0", "INVALID_VALUE"),
    ("Type error in field soc", "TYPE_ERROR"), ("Invalid type for soc", "TYPE_ERROR"), ("Same source event id, other payload: conflict", "IDEMPOTENCY_CONFLICT"), ("Vehicle not mapped", "MISSING_VEHICLE_MAPPING"),
    ("Vehicle ID not found in the payload", "MISSING_VEHICLE_MAPPING"), ("Token expired", "EXPIRED_AUTH"), ("401 Unauthorised", "EXPIRED_AUTH"), ("Unsupported OEM", "UNSUPPORTED_OEM"), ("Upstream timeout", "INFRA_ERROR"),
    ("ECONNREFUSED: connection refused", "INFRA_ERROR"), ("Service unavailable", "INFRA_ERROR"), ("Required field data.speed is missing", "SCHEMA_CHANGE"), ("Timestamp above max", "INVALID_TIME"), ("Vehicle not mapped after timeout", "MISSING_VEHICLE_MAPPING"),
)


def categorize(s, d):
    picked = F.element_at(F.array(*[F.lit(r) for r, _ in REASONS]), (F.col("event_id") % len(REASONS) + 1).cast("int"))
    return telemetry(s, d).select("event_id", fl.categorize(picked).alias("category"))


def _categorize_sql() -> str:
    return f"WITH {TEL} SELECT event_id, CASE event_id % {len(REASONS)} {' '.join(f'WHEN {i} THEN {c!r}' for i, (_, c) in enumerate(REASONS))} END AS category FROM tel"


def quarantine_summary(s, d):
    r = records(s, d)
    return r.groupBy("fleet_id").agg(F.count("*").alias("records"), *[F.count_if(F.col("status") == x).alias(x.lower()) for x in ("UNRESOLVED", "ACKNOWLEDGED", "RESOLVED")], F.sum("attempt").alias("attempts"))


def quarantine_fleet_counts(s, d):
    open_ = records(s, d).where("status <> 'RESOLVED'")
    return open_.groupBy("fleet_id").agg(F.count_distinct("event_id").alias("events"), F.count_distinct("known_vehicle").alias("vehicles"))


def incident_vehicles(s, d):
    return records(s, d).where("known_vehicle is not null").groupBy("connection_id", "category", F.col("known_vehicle").alias("vehicle_id")).agg(F.count("*").alias("events"), F.max("attempt").alias("attempt"))


def incident_list(s, d):
    return incidents(s, d).where("status = 'UNRESOLVED'").orderBy(F.desc("last_us"), "incident_id").limit(20).select("incident_id", "category", "last_us", "open_events")


def replay_selection(s, d, **narrowed):
    """Distinct quarantined events that a replay takes up; by default of all fleets, vendors and connections."""
    return rp.select(records(s, d).withColumn("vendor", F.substring_index("connection_id", "-", -1)), **narrowed)


def replay_items(s, d):
    """Items of a replay by fleet: those whose speed was out of range are fixed by a forced mapping, others fail."""
    r = records(s, d).where("status <> 'RESOLVED'")
    return r.select("fleet_id", "event_id", F.when(F.col("event_id") % 6 == 0, "PENDING").when(F.col("category") == "INVALID_VALUE", "DONE").otherwise("FAILED").alias("item_status"))


ITEMS = f"{REC}, items AS MATERIALIZED (SELECT fleet_id, event_id, CASE WHEN event_id % 6 = 0 THEN 'PENDING' WHEN category = 'INVALID_VALUE' THEN 'DONE' ELSE 'FAILED' END AS item_status FROM rec WHERE status <> 'RESOLVED')"


def replay_outcome(s, d):
    return fl.replay_progress(replay_items(s, d)).select("fleet_id", fl.replay_outcome(F.col("total"), F.col("done"), F.col("failed")).alias("outcome"))


def insight(s: SparkSession, d: str, metric: str) -> DataFrame:
    v = last_seen(s, d).withColumn("freshness", freshness())
    if metric == "safety":
        return fl.safety(events(s, d), v)
    if metric == "service":
        return fl.service(v)
    if metric == "charging":
        return fl.charging(v)
    return fl.quality(v, records(s, d))


METRICS = ("safety", "service", "charging", "quality")


def fleet_insights(s, d):
    """How many vehicles of each fleet each metric names. State is read once for the three metrics that it alone decides."""
    v = last_seen(s, d).withColumn("freshness", freshness())
    told = fl.tagged(v, records(s, d)).unionByName(fl.safety(events(s, d), v).select(F.lit("safety").alias("metric"), "fleet_id", "vehicle_id"))
    return told.groupBy("fleet_id", "metric").agg(F.count_distinct("vehicle_id").alias("vehicles"), F.min("vehicle_id").alias("first_vehicle"))


INSIGHT = {
    "safety": "SELECT fleet_id, vehicle_id, array_to_string(list_sort(list(DISTINCT kind)), ',') AS detail FROM tev JOIN (SELECT vehicle_id, fleet_id FROM last) USING (vehicle_id) WHERE kind IN ('HARSH_BRAKE', 'SPEED_VIOLATION') AND t_us >= (SELECT max(t_us) FROM tel) - 604800000000 GROUP BY 1, 2",
    "service": "SELECT fleet_id, vehicle_id, fault_code AS detail FROM last WHERE fault_code IS NOT NULL AND upper(fault_code) NOT IN ('NULL', 'NONE', '0', 'CLEAR', '')",
    "charging": "SELECT fleet_id, vehicle_id, battery_soc || '%' AS detail FROM last WHERE battery_soc < 20",
    "quality": f"SELECT fleet_id, vehicle_id, coalesce(reason, status) AS detail FROM (SELECT fleet_id, vehicle_id, {FRESH} AS status FROM last) LEFT JOIN (SELECT known_vehicle AS vehicle_id, arg_min(category, (t_us, event_id)) AS reason FROM rec WHERE status = 'UNRESOLVED' AND known_vehicle IS NOT NULL GROUP BY 1) USING (vehicle_id) WHERE reason IS NOT NULL OR status IN ('STALE', 'OFFLINE', 'ERROR')",
}
_LAST_ONLY = LAST.split(", last AS MATERIALIZED", 1)[1]
ALL = f"{EVENTS}, last AS MATERIALIZED{_LAST_ONLY}"
ALLREC = f"{REC}, last AS MATERIALIZED{_LAST_ONLY}"


def vendor_overview(s, d):
    v = last_seen(s, d)
    return v.groupBy("vendor").agg(F.count("*").alias("vehicles"), F.count_distinct(F.concat_ws("-", "fleet_id", "vendor")).alias("connections"), F.bool_or("connected").alias("has_active"), F.bool_or(~F.col("connected")).alias("needs_setup"), F.array_join(F.array_sort(F.collect_set(F.col("fleet_id").cast("string"))), ",").alias("fleets"))


def pipeline_health(s, d):
    n = normalized(s, d)
    counts = n.groupBy("fleet_id").agg(F.count("*").alias("raw"), F.count_if(F.col("verdict") == "OK").alias("processed"), F.count_if(F.col("verdict") != "OK").alias("quarantined"))
    double = verdicts(s, d).where("verdict = 'DUPLICATE'").groupBy(F.substring("connection_id", 2, 1).cast("long").alias("fleet_id")).agg(F.count("*").alias("true_duplicates"))
    return counts.join(double, "fleet_id", "left").select("*", F.lit(0).alias("duplicates"))


def vehicle_data_quality(s, d):
    n = normalized(s, d).groupBy("vehicle_id").agg(F.count_if(F.col("verdict") == "OK").alias("valid"), F.count_if(F.col("verdict") != "OK").alias("quarantined"))
    r = records(s, d).where("status = 'UNRESOLVED'").groupBy("vehicle_id").agg(F.count_distinct("event_id").alias("unresolved"))
    return n.join(r, "vehicle_id", "left").select("vehicle_id", "valid", "quarantined", F.coalesce("unresolved", F.lit(0)).alias("unresolved"))


# Imports: vehicle numbers derived from customers.


#: Prefixes of the three vendors' vehicle numbers, in order; the vendors have neutral names here, as in the whole library.
MAKERS = (("1VX", "Maker A", "A"), ("1VL", "Maker A", "A"), ("2CR", "Maker B", "B"), ("2CS", "Maker B", "B"), ("3NA", "Maker C", "C"), ("3NV", "Maker C", "C"))


def vin_decoded(s, rows):
    return fl.vin_decode(rows, list(MAKERS))


def vin_rows(s, d):
    c = s.read.parquet(f"{d}/customer.parquet")
    prefix = F.element_at(F.array(*[F.lit(p) for p in ("3NA", "1VX", "2CR", "ZZZ", "3N2", "IOQ")]), (F.col("c_custkey") % 6 + 1).cast("int"))
    n = F.lpad((F.col("c_custkey") - F.when(F.col("c_custkey") % 10 == 0, 6).otherwise(0)).cast("string"), 14, "0")
    vin = F.when(F.col("c_custkey") % 13 == 0, F.concat(prefix, F.substring(n, 1, 9))).otherwise(F.concat(prefix, n))
    return c.select(F.col("c_custkey").alias("row"), vin.alias("vin"), F.col("c_name").alias("label"))


VIN = """v0 AS (SELECT c_custkey AS row, CASE c_custkey % 6 WHEN 0 THEN '3NA' WHEN 1 THEN '1VX' WHEN 2 THEN '2CR' WHEN 3 THEN 'ZZZ' WHEN 4 THEN '3N2' ELSE 'IOQ' END AS prefix,
    lpad((c_custkey - CASE WHEN c_custkey % 10 = 0 THEN 6 ELSE 0 END)::VARCHAR, 14, '0') AS n, c_name AS label FROM customer),
vins AS MATERIALIZED (SELECT row, CASE WHEN row % 13 = 0 THEN prefix || substr(n, 1, 9) ELSE prefix || n END AS vin, label FROM v0),
makers(prefix, maker) AS (VALUES ('1VX', 'Maker A'), ('1VL', 'Maker A'), ('2CR', 'Maker B'), ('2CS', 'Maker B'), ('3NA', 'Maker C'), ('3NV', 'Maker C')),
dec AS MATERIALIZED (SELECT v.*, length(vin) = 17 AND regexp_full_match(vin, '[A-HJ-NPR-Z0-9]{17}') AS valid, e.maker AS exact, (SELECT arg_min(maker, m.prefix) FROM makers m WHERE substr(m.prefix, 1, 2) = substr(vin, 1, 2)) AS near FROM vins v LEFT JOIN makers e ON e.prefix = substr(vin, 1, 3)),
dec2 AS MATERIALIZED (SELECT row, vin, label, valid, coalesce(exact, near || ' (uncertain)') AS maker, CASE WHEN exact IS NOT NULL THEN 'HIGH' WHEN near IS NOT NULL THEN 'LOW' ELSE 'NONE' END AS confidence FROM dec),
prev AS MATERIALIZED (SELECT *, CASE WHEN NOT valid THEN 'invalid' WHEN row % 17 = 0 AND valid THEN 'duplicate-in-fleet' WHEN row_number() OVER (PARTITION BY vin ORDER BY row) > 1 THEN 'duplicate-in-file' WHEN confidence <> 'HIGH' THEN 'uncertain' ELSE 'valid' END AS status FROM dec2)"""


def known_vins(s, d):
    return vin_rows(s, d).where("row % 17 = 0").select("vin").distinct()


def import_preview(s, d):
    return fl.import_preview(vin_decoded(s, vin_rows(s, d)), F.col("row") % 17 == 0).drop("maker_id")


def csv_import(s, d):
    """Lines of an import file: numbers trimmed and in upper case, blank ones skipped."""
    rows = vin_rows(s, d)
    number = F.when(F.col("row") % 19 == 0, " ").otherwise(F.concat(F.lit(" "), F.lower("vin")))
    lines = rows.select("row", F.concat(number, F.lit(","), "label").alias("line"))
    return fl.csv_lines(lines).select("row", "vin", "label")


def page_offset(s, d):
    v = s.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_name")
    page = v.orderBy("c_custkey").offset(40).limit(20)
    return page.select("c_custkey", "c_name", v.agg(F.count("*").alias("n")).scalar().alias("total"))


def page_keyset(s, d):
    return s.read.parquet(f"{d}/customer.parquet").where("c_custkey > 60").orderBy("c_custkey").limit(20).select("c_custkey", "c_name")


def history_cursor(s, d):
    """Events after a cursor; a cursor beyond the last starts again from 0."""
    t = telemetry(s, d).where("vehicle_id = 7")
    last = t.agg(F.max("event_id").alias("m")).scalar()
    return t.where(F.col("event_id") > F.when(F.lit(10**9) > last, 0).otherwise(10**9)).orderBy("event_id").limit(25).select("event_id", "t_us")


def retention(s, d):
    rank = F.row_number().over(Window.partitionBy("vehicle_id").orderBy(F.desc("t_us"), F.desc("event_id")))
    return telemetry(s, d).withColumn("n", rank).where("n <= 20").select("vehicle_id", "event_id")


def feed(s, d):
    return fl.change_feed(telemetry(s, d).select("fleet_id", "event_id", "event_type", "t_us"))


FEED = f"{TEL}, feed AS MATERIALIZED (SELECT fleet_id, event_id, event_type, row_number() OVER (PARTITION BY fleet_id ORDER BY t_us, event_id, event_type) AS sequence FROM tel)"


def feed_contiguous(s, d):
    """How far a client that missed every 97th event can apply the feed of each fleet."""
    return fl.contiguous(feed(s, d).where("sequence % 97 <> 0"))


def jobs(s, d):
    """Background jobs derived from events: kind, state and times."""
    t = telemetry(s, d)
    status = F.when(F.col("event_id") % 10 == 0, "FAILED").when(F.col("event_id") % 11 == 0, "PENDING").when(F.col("event_id") % 12 == 0, "RUNNING").otherwise("DONE")
    return t.select(F.col("event_id").alias("job_id"), "fleet_id", F.element_at(F.array(F.lit("NORMALIZE"), F.lit("PROJECT"), F.lit("REPLAY")), (F.col("event_id") % 3 + 1).cast("int")).alias("kind"), status.alias("status"), F.col("t_us").alias("queued_us"), (F.col("event_id") % 4).cast("int").alias("worker"))


JOBS = f"""{TEL}, jobs AS MATERIALIZED (SELECT event_id AS job_id, fleet_id, CASE event_id % 3 WHEN 0 THEN 'NORMALIZE' WHEN 1 THEN 'PROJECT' ELSE 'REPLAY' END AS kind,
    CASE WHEN event_id % 10 = 0 THEN 'FAILED' WHEN event_id % 11 = 0 THEN 'PENDING' WHEN event_id % 12 = 0 THEN 'RUNNING' ELSE 'DONE' END AS status, t_us AS queued_us, (event_id % 4)::INT AS worker FROM tel)"""
ACT = f"""{JOBS}, a0 AS (SELECT *, coalesce(queued_us - lag(queued_us) OVER (PARTITION BY fleet_id, kind, worker ORDER BY queued_us, job_id) > 60000000, true) AS fresh FROM jobs),
a1 AS MATERIALIZED (SELECT *, sum(fresh::INT) OVER (PARTITION BY fleet_id, kind, worker ORDER BY queued_us, job_id) AS session FROM a0),
act AS MATERIALIZED (SELECT fleet_id, kind, worker, arg_min(job_id, (queued_us, job_id)) AS activity_id, count(*) AS jobs, min(queued_us) AS first_us, max(queued_us) AS last_us, count(*) FILTER (status = 'DONE') AS done, count(*) FILTER (status = 'FAILED') AS failed,
    count(*) FILTER (status = 'PENDING') AS pending, count(*) FILTER (status = 'RUNNING') AS running FROM a1 GROUP BY fleet_id, kind, worker, session)"""


def activities(s, d):
    return fl.activities(jobs(s, d), 60 * SECOND)


def queue_health(s, d):
    return fl.queue_health(jobs(s, d))


def job_claim_order(s, d):
    return fl.claim_order(jobs(s, d).where("status = 'PENDING'")).select("job_id", "position").where("position <= 50")


def worker_budget(s, d):
    load = jobs(s, d).groupBy("fleet_id").agg(F.count_if(F.col("status") == "PENDING").alias("pending"), F.round(F.count("*") / 200.0, 2).alias("rate"))
    return load.select("fleet_id", fl.worker_budget(F.col("pending"), F.col("rate"), F.col("fleet_id") == 4).alias("budget"))


def replica(s, d):
    """Snapshots with revisions; the replica keeps the highest of each entity, tombstones included."""
    t = telemetry(s, d)
    versions = t.select(F.col("vehicle_id").alias("entity"), F.col("event_id").alias("revision"), F.when(F.col("event_id") % 23 != 0, F.concat_ws("/", "event_type", F.col("k").cast("string"))).alias("body"))
    return fl.replica_merge(versions)


def deliveries(s, d):
    t = telemetry(s, d)
    ledger = t.select("event_id", "connection_id", "vehicle_id", F.when(F.col("event_id") % 4 == 0, "DELIVERED").otherwise("PENDING").alias("status"), (F.col("event_id") % 7).cast("int").alias("attempts"))
    cancelled = t.where("vehicle_id % 9 = 0").select("vehicle_id").distinct()
    return fl.delivery_status(ledger, cancelled)


def connection_activation(s, d):
    """Vehicles found at a vendor against those of the fleet and their access."""
    v = telemetry(s, d).select("vehicle_id", "fleet_id").distinct()
    found = v.where("vehicle_id % 4 <> 3").select("vehicle_id", (F.col("vehicle_id") % 5 != 2).alias("allowed"))
    return v.join(found, "vehicle_id", "left").select("vehicle_id", F.when(F.col("allowed").isNull(), "NOT_FOUND").when(F.col("allowed"), "AWAITING_DATA").otherwise("UNAUTHORISED_VEHICLE").alias("status"))


def job_context(s, d):
    """Jobs with the event that their JSON argument names."""
    arg = jobs(s, d).select("job_id", "kind", F.concat(F.lit('{"event":'), F.col("job_id").cast("string"), F.lit("}")).alias("argument"))
    t = telemetry(s, d).select(F.col("event_id").alias("e"), "vehicle_id", "fleet_id")
    return arg.join(t, F.get_json_object("argument", "$.event").cast("long") == F.col("e"), "left").select("job_id", "kind", "vehicle_id", "fleet_id")


def profile_pick(s, d):
    """The newest active profile of each vendor and version, repairs first."""
    rows = [("A", "1", "p1", "ACTIVE", False, 1), ("A", "1", "p2", "ACTIVE", True, 2), ("A", "1", "p3", "RETIRED", True, 3), ("B", "1", "p4", "ACTIVE", False, 4), ("B", "1", "p5", "ACTIVE", False, 5), ("C", "1", "p6", "DRAFT", True, 6)]
    profiles = s.createDataFrame(rows, "vendor string, version string, profile string, status string, repair boolean, published int")
    return fl.profile_pick(profiles)


QUERIES = {
    "categorize_failure": categorize,
    "quarantine_records": lambda s, d: records(s, d),
    "incident_rollup": incidents,
    "incident_status": lambda s, d: incidents(s, d).select("incident_id", "status"),
    "incident_vehicles": incident_vehicles,
    "incident_list": incident_list,
    "quarantine_summary": quarantine_summary,
    "quarantine_fleet_counts": quarantine_fleet_counts,
    "replay_selection": replay_selection,
    "replay_progress": lambda s, d: fl.replay_progress(replay_items(s, d)),
    "replay_outcome": replay_outcome,
    **{f"insight_{m}": (lambda m: lambda s, d: insight(s, d, m))(m) for m in METRICS},
    "fleet_insights": fleet_insights,
    "vendor_overview": vendor_overview,
    "pipeline_health": pipeline_health,
    "vehicle_data_quality": vehicle_data_quality,
    "vin_validate": lambda s, d: vin_rows(s, d).select("row", fl.vin_valid(F.col("vin")).alias("valid")),
    "vin_decode": lambda s, d: vin_decoded(s, vin_rows(s, d)).select("row", "maker", "confidence"),
    "csv_import": csv_import,
    "import_preview": import_preview,
    "import_confirm": lambda s, d: import_preview(s, d).where("status IN ('valid', 'uncertain')").join(known_vins(s, d), "vin", "left_anti").select("row", "vin", "maker"),
    "page_offset": page_offset,
    "page_keyset": page_keyset,
    "history_cursor": history_cursor,
    "retention_topn": retention,
    "change_feed": feed,
    "change_feed_catchup": lambda s, d: fl.catch_up(telemetry(s, d), 1000, 500),
    "feed_contiguous": feed_contiguous,
    "activity_sessions": activities,
    "activity_rollup": lambda s, d: fl.activity_rollup(activities(s, d)),
    "queue_health": queue_health,
    "job_claim_order": job_claim_order,
    "worker_budget": worker_budget,
    "replica_merge": replica,
    "delivery_status": deliveries,
    "connection_activation": connection_activation,
    "job_context": job_context,
    "profile_pick": profile_pick,
}

ORACLES = {
    "categorize_failure": _categorize_sql(),
    "quarantine_records": f"WITH {REC} SELECT * FROM rec",
    "incident_rollup": f"WITH {INC} SELECT * FROM inc",
    "incident_status": f"WITH {INC} SELECT incident_id, status FROM inc",
    "incident_vehicles": f"WITH {REC} SELECT connection_id, category, known_vehicle AS vehicle_id, count(*) AS events, max(attempt) AS attempt FROM rec WHERE known_vehicle IS NOT NULL GROUP BY 1, 2, 3",
    "incident_list": f"WITH {INC} SELECT incident_id, category, last_us, open_events FROM inc WHERE status = 'UNRESOLVED' ORDER BY last_us DESC, incident_id LIMIT 20",
    "quarantine_summary": f"WITH {REC} SELECT fleet_id, count(*) AS records, count(*) FILTER (status = 'UNRESOLVED') AS unresolved, count(*) FILTER (status = 'ACKNOWLEDGED') AS acknowledged, count(*) FILTER (status = 'RESOLVED') AS resolved, sum(attempt)::BIGINT AS attempts FROM rec GROUP BY 1",
    "quarantine_fleet_counts": f"WITH {REC} SELECT fleet_id, count(DISTINCT event_id) AS events, count(DISTINCT known_vehicle) AS vehicles FROM rec WHERE status <> 'RESOLVED' GROUP BY 1",
    "replay_selection": f"WITH {REC} SELECT DISTINCT event_id, t_us, fleet_id, split_part(connection_id, '-', 2) AS vendor, connection_id FROM rec WHERE status <> 'RESOLVED'",
    "replay_progress": f"WITH {ITEMS} SELECT fleet_id, count(*) AS total, count(*) FILTER (item_status = 'DONE') AS done, count(*) FILTER (item_status = 'FAILED') AS failed, floor(100.0 * count(*) FILTER (item_status <> 'PENDING') / count(*) + 0.5)::BIGINT AS percent FROM items GROUP BY 1",
    "replay_outcome": f"WITH {ITEMS}, p AS (SELECT fleet_id, count(*) AS total, count(*) FILTER (item_status = 'DONE') AS done, count(*) FILTER (item_status = 'FAILED') AS failed FROM items GROUP BY 1) SELECT fleet_id, CASE WHEN total = 0 THEN 'NO_EVENTS' WHEN failed = 0 AND done > 0 THEN 'SUCCESS' WHEN done > 0 THEN 'PARTIAL_SUCCESS' ELSE 'FAILED' END AS outcome FROM p",
    "insight_safety": f"WITH {ALL} {INSIGHT['safety']}",
    "insight_service": f"WITH {LAST} {INSIGHT['service']}",
    "insight_charging": f"WITH {LAST} {INSIGHT['charging']}",
    "insight_quality": f"WITH {ALLREC} {INSIGHT['quality']}",
    "vendor_overview": f"WITH {LAST} SELECT vendor, count(*) AS vehicles, count(DISTINCT fleet_id || '-' || vendor) AS connections, bool_or(connected) AS has_active, bool_or(NOT connected) AS needs_setup, array_to_string(list_sort(list(DISTINCT fleet_id::VARCHAR)), ',') AS fleets FROM last GROUP BY 1",
    "pipeline_health": f"""WITH n AS MATERIALIZED (WITH {NORMAL} SELECT event_id, vehicle_id % 5 AS fleet_id, verdict FROM norm), v AS MATERIALIZED (WITH {RAW} SELECT vehicle_id % 5 AS fleet_id, verdict FROM verdicts)
        SELECT fleet_id, raw, processed, quarantined, true_duplicates, 0 AS duplicates FROM (SELECT fleet_id, count(*) AS raw, count(*) FILTER (verdict = 'OK') AS processed, count(*) FILTER (verdict <> 'OK') AS quarantined FROM n GROUP BY 1)
        LEFT JOIN (SELECT fleet_id, count(*) AS true_duplicates FROM v WHERE verdict = 'DUPLICATE' GROUP BY 1) USING (fleet_id)""",
    "vehicle_data_quality": f"WITH {REC} SELECT vehicle_id, valid, quarantined, coalesce(unresolved, 0) AS unresolved FROM (SELECT vehicle_id, count(*) FILTER (verdict = 'OK') AS valid, count(*) FILTER (verdict <> 'OK') AS quarantined FROM norm GROUP BY 1) LEFT JOIN (SELECT vehicle_id, count(DISTINCT event_id) AS unresolved FROM rec WHERE status = 'UNRESOLVED' GROUP BY 1) USING (vehicle_id)",
    "vin_validate": f"WITH {VIN} SELECT row, valid FROM dec2",
    "vin_decode": f"WITH {VIN} SELECT row, maker, confidence FROM dec2",
    "csv_import": f"WITH {VIN} SELECT row, vin, label FROM vins WHERE row % 19 <> 0",
    "import_preview": f"WITH {VIN} SELECT row, vin, label, maker, confidence, status FROM prev",
    "import_confirm": f"WITH {VIN} SELECT row, vin, maker FROM prev WHERE status IN ('valid', 'uncertain') AND vin NOT IN (SELECT vin FROM vins WHERE row % 17 = 0)",
    "page_offset": "SELECT c_custkey, c_name, (SELECT count(*) FROM customer) AS total FROM customer ORDER BY c_custkey LIMIT 20 OFFSET 40",
    "page_keyset": "SELECT c_custkey, c_name FROM customer WHERE c_custkey > 60 ORDER BY c_custkey LIMIT 20",
    "history_cursor": f"WITH {TEL} SELECT event_id, t_us FROM tel WHERE vehicle_id = 7 AND event_id > 0 ORDER BY event_id LIMIT 25",
    "retention_topn": f"WITH {TEL} SELECT vehicle_id, event_id FROM tel QUALIFY row_number() OVER (PARTITION BY vehicle_id ORDER BY t_us DESC, event_id DESC) <= 20",
    "change_feed": f"WITH {FEED} SELECT * FROM feed",
    "change_feed_catchup": f"WITH {FEED} SELECT fleet_id, event_id, event_type, sequence FROM feed WHERE sequence > 1000 AND sequence <= 1500",
    "feed_contiguous": f"WITH {FEED}, g AS (SELECT fleet_id, sequence, row_number() OVER (PARTITION BY fleet_id ORDER BY sequence) AS n FROM feed WHERE sequence % 97 <> 0) SELECT fleet_id, max(sequence) FILTER (sequence = n) AS applied, count(*) FILTER (sequence <> n) AS held FROM g GROUP BY 1",
    "activity_sessions": f"WITH {ACT} SELECT * FROM act",
    "activity_rollup": f"WITH {ACT} SELECT fleet_id, kind, CASE WHEN sum(running) > 0 THEN 'RUNNING' WHEN sum(pending) > 0 THEN 'QUEUED' WHEN sum(failed) > 0 AND sum(done) = 0 THEN 'NEEDS_ATTENTION' WHEN sum(failed) > 0 THEN 'COMPLETED_WITH_ISSUES' ELSE 'COMPLETED' END AS status, count(*) AS activities, sum(jobs)::BIGINT AS jobs, sum(done)::BIGINT AS done, sum(failed)::BIGINT AS failed, min(first_us) AS first_us, max(last_us) AS last_us FROM act GROUP BY 1, 2",
    "queue_health": f"WITH {JOBS}, h AS (SELECT fleet_id, count(*) FILTER (status = 'PENDING') AS pending, count(*) FILTER (status = 'RUNNING') AS running, count(*) FILTER (status = 'FAILED') AS failed, min(queued_us) FILTER (status = 'PENDING') AS oldest_us, count(DISTINCT worker) FILTER (status = 'RUNNING') AS workers FROM jobs GROUP BY 1) SELECT *, CASE WHEN failed > pending OR workers = 0 THEN 'DEGRADED' ELSE 'HEALTHY' END AS health FROM h",
    "job_claim_order": f"WITH {JOBS}, p AS (SELECT *, CASE WHEN kind = 'NORMALIZE' OR (SELECT max(queued_us) FROM jobs WHERE status = 'PENDING') - queued_us > 600000000 THEN 0 WHEN kind = 'PROJECT' THEN 1 ELSE 2 END AS priority FROM jobs WHERE status = 'PENDING') SELECT job_id, row_number() OVER (ORDER BY priority, queued_us, job_id)::INT AS position FROM p QUALIFY position <= 50",
    "worker_budget": f"WITH {JOBS}, l AS (SELECT fleet_id, count(*) FILTER (status = 'PENDING') AS pending, round(count(*) / 200.0, 2) AS rate FROM jobs GROUP BY 1) SELECT fleet_id, CASE WHEN fleet_id = 4 OR pending >= 1000 THEN 20 WHEN rate >= 5 OR pending >= 200 THEN 4 ELSE 10 END AS budget FROM l",
    "replica_merge": f"WITH {TEL} SELECT vehicle_id AS entity, event_id AS revision, CASE WHEN event_id % 23 <> 0 THEN event_type || '/' || k END AS body FROM tel QUALIFY row_number() OVER (PARTITION BY vehicle_id ORDER BY event_id DESC) = 1",
    "delivery_status": f"""WITH {TEL}, l AS (SELECT connection_id, CASE WHEN event_id % 4 = 0 THEN 'DELIVERED' WHEN vehicle_id % 9 = 0 THEN 'CANCELLED' WHEN event_id % 7 >= 5 THEN 'EXHAUSTED' ELSE 'PENDING' END AS status, (event_id % 7)::INT AS attempts FROM tel)
        SELECT connection_id, status, count(*) AS deliveries, max(CASE WHEN status = 'PENDING' THEN least(60, pow(2, attempts))::INT END) AS longest_wait_s FROM l GROUP BY 1, 2""",
    "connection_activation": f"WITH {TEL}, v AS (SELECT DISTINCT vehicle_id FROM tel) SELECT vehicle_id, CASE WHEN vehicle_id % 4 = 3 THEN 'NOT_FOUND' WHEN vehicle_id % 5 <> 2 THEN 'AWAITING_DATA' ELSE 'UNAUTHORISED_VEHICLE' END AS status FROM v",
    "job_context": f"WITH {JOBS} SELECT job_id, kind, tel.vehicle_id, tel.fleet_id FROM jobs LEFT JOIN tel ON tel.event_id = job_id",
    "profile_pick": "SELECT * FROM (VALUES ('A', '1', 'p2'), ('B', '1', 'p5')) t(vendor, version, profile)",
    "fleet_insights": f"""WITH sf AS MATERIALIZED (WITH {ALL} {INSIGHT['safety']}), sv AS MATERIALIZED (WITH {LAST} {INSIGHT['service']}), ch AS MATERIALIZED (WITH {LAST} {INSIGHT['charging']}), ql AS MATERIALIZED (WITH {ALLREC} {INSIGHT['quality']}),
        u AS (SELECT 'safety' AS metric, fleet_id, vehicle_id FROM sf UNION ALL SELECT 'service', fleet_id, vehicle_id FROM sv UNION ALL SELECT 'charging', fleet_id, vehicle_id FROM ch UNION ALL SELECT 'quality', fleet_id, vehicle_id FROM ql)
        SELECT fleet_id, metric, count(DISTINCT vehicle_id) AS vehicles, min(vehicle_id) AS first_vehicle FROM u GROUP BY 1, 2""",
}
