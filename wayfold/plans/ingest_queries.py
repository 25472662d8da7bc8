"""Queries over incoming events and vehicle state, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.operators import ingest, state
from wayfold.sources.fixtures import TEL, telemetry

#: Raw envelopes: every event, exact copies of some and changed copies of others, in order of arrival.
RAW = f"""{TEL}, arrivals AS (SELECT *, event_id AS event_key, speed_kmh AS sent FROM tel UNION ALL SELECT *, event_id + 1000000000, speed_kmh FROM tel WHERE event_id % 50 = 0
    UNION ALL SELECT *, event_id + 2000000000, speed_kmh + 1 FROM tel WHERE event_id % 97 = 0),
raw AS MATERIALIZED (SELECT *, event_id::VARCHAR AS source_event_id, '{{"event_id":' || event_id || ',"speed":' || round(sent * 100)::BIGINT || ',"k":' || k || '}}' AS payload FROM arrivals),
hashed AS MATERIALIZED (SELECT *, sha256(payload) AS payload_hash FROM raw),
verdicts AS MATERIALIZED (SELECT *, CASE WHEN row_number() OVER (PARTITION BY connection_id, source_event_id, payload_hash ORDER BY event_key) > 1 THEN 'DUPLICATE'
    WHEN row_number() OVER (PARTITION BY connection_id, source_event_id ORDER BY event_key) > 1 THEN 'CONFLICT' ELSE 'NEW' END AS verdict,
    min(event_key) OVER (PARTITION BY connection_id, source_event_id, payload_hash) AS owner FROM hashed)"""


def raw(s: SparkSession, d: str) -> DataFrame:
    t = telemetry(s, d)
    copies = t.where("event_id % 50 = 0").withColumn("event_key", F.col("event_id") + 1_000_000_000).withColumn("sent", F.col("speed_kmh"))
    changed = t.where("event_id % 97 = 0").withColumn("event_key", F.col("event_id") + 2_000_000_000).withColumn("sent", F.col("speed_kmh") + 1)
    rows = t.withColumn("event_key", F.col("event_id")).withColumn("sent", F.col("speed_kmh")).union(copies).union(changed)
    payload = F.concat(F.lit('{"event_id":'), F.col("event_id").cast("string"), F.lit(',"speed":'), F.round(F.col("sent") * 100).cast("long").cast("string"), F.lit(',"k":'), F.col("k").cast("string"), F.lit("}"))
    rows = rows.withColumn("source_event_id", F.col("event_id").cast("string")).withColumn("payload", payload)
    return rows.withColumn("payload_hash", ingest.payload_hash(F.col("payload")))


def verdicts(s: SparkSession, d: str) -> DataFrame:
    return ingest.deduplicate(raw(s, d))


def status_counts(s, d):
    status = F.when(F.col("verdict") == "NEW", "ACCEPTED").when(F.col("verdict") == "CONFLICT", "QUARANTINED").otherwise("DUPLICATE")
    return verdicts(s, d).groupBy("connection_id", status.alias("status")).agg(F.count("*").alias("events"))


def last_seen(s, d):
    """Each vehicle's latest reading, against the latest reading of all."""
    t = telemetry(s, d)
    last = t.groupBy("vehicle_id", "fleet_id", "vendor").agg(F.max("t_us").alias("last_us"), F.max_by(F.struct("speed_kmh", "ignition", "charging", "battery_soc", "fault_code"), F.struct("t_us", "event_id")).alias("v"))
    return last.select("vehicle_id", "fleet_id", "vendor", "last_us", "v.*", (F.col("vehicle_id") % 11 != 0).alias("connected"), t.agg(F.max("t_us").alias("as_of")).scalar().alias("as_of"))


LAST = f"""{TEL}, last AS MATERIALIZED (SELECT vehicle_id, fleet_id, vendor, t_us AS last_us, speed_kmh, ignition, charging, battery_soc, fault_code, vehicle_id % 11 <> 0 AS connected, (SELECT max(t_us) FROM tel) AS as_of
    FROM tel QUALIFY row_number() OVER (PARTITION BY vehicle_id ORDER BY t_us DESC, event_id DESC) = 1)"""
MOVE = "CASE WHEN charging THEN 'CHARGING' WHEN upper(trim(coalesce(ignition, ''))) = 'OFF' THEN 'PARKED' WHEN speed_kmh > 0.5 THEN 'MOVING' ELSE 'IDLE' END"
FRESH = "CASE WHEN NOT connected THEN 'OFFLINE' WHEN last_us IS NULL THEN 'AWAITING_DATA' WHEN as_of - last_us > 300000000 THEN 'OFFLINE' WHEN as_of - last_us > 60000000 THEN 'STALE' ELSE 'LIVE' END"
LIVE = "CASE WHEN NOT connected THEN 'OFFLINE' WHEN last_us IS NULL THEN 'CONNECTED' WHEN as_of - last_us > 300000000 THEN 'OFFLINE' WHEN as_of - last_us > 60000000 THEN 'STALE' WHEN speed_kmh IS NULL THEN 'DATA_RECENT' WHEN speed_kmh > 0.5 THEN 'MOVING' ELSE 'IDLE' END"

movement = lambda: state.movement(F.col("charging"), F.col("ignition"), F.col("speed_kmh"))
freshness = lambda: state.freshness(F.col("connected"), F.col("last_us"), F.col("as_of"))
live = lambda: state.live_state(F.col("connected"), F.col("last_us"), F.col("speed_kmh"), F.col("as_of"))


def current_state(s, d):
    """Latest value of each signal, as text; some events arrive late."""
    t = telemetry(s, d).withColumn("arrival_seq", F.when(F.col("event_id") % 31 == 0, F.col("event_id") + 40).otherwise(F.col("event_id"))).withColumn("received_us", F.col("t_us"))
    signals = {"vehicle_speed": F.round(F.col("speed_kmh") * 100).cast("long").cast("string"), "battery_soc": F.col("battery_soc").cast("string"), "ignition_status": F.col("ignition"), "fault_code": F.col("fault_code"), "harsh_brake": F.when(F.col("harsh_brake"), "YES").otherwise("NO")}
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("signal"), v.alias("value")) for k, v in signals.items()]))
    return state.current_values(t.select("vehicle_id", "t_us", "received_us", "arrival_seq", pairs.alias("p")).select("vehicle_id", "t_us", "received_us", "arrival_seq", "p.*"))


def age_labels(s, d):
    seconds = F.expr("(as_of - last_us) div 1000000")
    return last_seen(s, d).select("vehicle_id", state.age_label(seconds, F.timestamp_micros("last_us")).alias("label"))


def fleet_overview(s, d):
    v = last_seen(s, d).withColumn("movement", movement()).withColumn("freshness", freshness())
    is_ = lambda c, x: F.count_if(F.col(c) == x)
    return v.groupBy("fleet_id").agg(
        F.count("*").alias("total"), is_("movement", "MOVING").alias("moving"), is_("movement", "IDLE").alias("idle"), is_("movement", "PARKED").alias("parked"), is_("movement", "CHARGING").alias("charging"),
        is_("freshness", "LIVE").alias("live"), is_("freshness", "STALE").alias("stale"), is_("freshness", "OFFLINE").alias("offline"), F.count_if(F.col("battery_soc") < 20).alias("attention"), F.count_if(~F.col("connected")).alias("no_connection"),
    )


def fleet_stats(s, d):
    v = last_seen(s, d).withColumn("status", freshness())
    return v.groupBy("fleet_id").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "LIVE").alias("receiving"), F.count_if(~F.col("connected")).alias("no_connection"), F.count_if(F.col("status").isin("STALE", "OFFLINE", "AWAITING_DATA")).alias("attention"))


def vehicle_list(s, d):
    """Vehicles with their state and, where there is one, the customer of the same number."""
    c = s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("vehicle_id"), F.col("c_name").alias("label"), F.col("c_mktsegment").alias("manufacturer"))
    return last_seen(s, d).select("vehicle_id", "fleet_id", "vendor", "last_us", live().alias("state")).join(c, "vehicle_id", "left")


def vehicle_search(s, d):
    term = "auto"
    v = vehicle_list(s, d)
    return v.where(F.lower("label").contains(term) | F.lower("manufacturer").contains(term)).select("vehicle_id", "label", "manufacturer")


def breadcrumbs(s, d):
    """The last 200 places of each vehicle, oldest first: how many, and the first and last of them."""
    rank = F.row_number().over(Window.partitionBy("vehicle_id").orderBy(F.desc("t_us"), F.desc("event_id")))
    kept = telemetry(s, d).withColumn("n", rank).where("n <= 200")
    trail = F.transform(F.array_sort(F.collect_list(F.struct("t_us", "event_id"))), lambda p: p["event_id"])
    return kept.groupBy("vehicle_id").agg(trail.alias("trail")).select("vehicle_id", F.size("trail").alias("points"), F.element_at("trail", 1).alias("oldest"), F.element_at("trail", -1).alias("newest"))


QUERIES = {
    "payload_hash": lambda s, d: raw(s, d).select("event_key", "payload_hash"),
    "idempotency_key": lambda s, d: raw(s, d).select("event_key", ingest.idempotency_key(F.col("connection_id"), F.when(F.col("event_id") % 7 != 0, F.col("source_event_id")), F.col("payload_hash")).alias("key")),
    "ingest_dedup": lambda s, d: verdicts(s, d).select("event_key", "connection_id", "verdict", "owner"),
    "ingest_fold": lambda s, d: ingest.fold(raw(s, d)).select("event_key", "connection_id", "verdict", "owner"),
    "ingest_status_counts": status_counts,
    "current_state": current_state,
    "movement_state": lambda s, d: last_seen(s, d).select("vehicle_id", movement().alias("movement")),
    "data_freshness": lambda s, d: last_seen(s, d).select("vehicle_id", freshness().alias("freshness")),
    "live_state": lambda s, d: last_seen(s, d).select("vehicle_id", live().alias("state"), "last_us"),
    "age_label": age_labels,
    "fleet_overview": fleet_overview,
    "fleet_stats": fleet_stats,
    "fleet_vehicle_list": vehicle_list,
    "vehicle_search": vehicle_search,
    "breadcrumbs": breadcrumbs,
    "latest_sample": lambda s, d: last_seen(s, d).select("vehicle_id", "last_us", "speed_kmh", "battery_soc"),
}

_SIGNALS = """SELECT vehicle_id, t_us, seq, 'vehicle_speed' AS signal, round(speed_kmh * 100)::BIGINT::VARCHAR AS value FROM late UNION ALL SELECT vehicle_id, t_us, seq, 'battery_soc', battery_soc::VARCHAR FROM late
    UNION ALL SELECT vehicle_id, t_us, seq, 'ignition_status', ignition FROM late UNION ALL SELECT vehicle_id, t_us, seq, 'fault_code', fault_code FROM late UNION ALL SELECT vehicle_id, t_us, seq, 'harsh_brake', CASE WHEN harsh_brake THEN 'YES' ELSE 'NO' END FROM late"""
_LIST = f"""{LAST}, vl AS (SELECT vehicle_id, fleet_id, vendor, last_us, {LIVE} AS state, c_name AS label, c_mktsegment AS manufacturer FROM last LEFT JOIN customer ON c_custkey = vehicle_id)"""

ORACLES = {
    "payload_hash": f"WITH {RAW} SELECT event_key, payload_hash FROM hashed",
    "idempotency_key": f"WITH {RAW} SELECT event_key, CASE WHEN event_id % 7 <> 0 THEN connection_id || ':' || source_event_id ELSE connection_id || ':hash:' || payload_hash END AS key FROM hashed",
    "ingest_dedup": f"WITH {RAW} SELECT event_key, connection_id, verdict, owner FROM verdicts",
    "ingest_fold": f"WITH {RAW} SELECT event_key, connection_id, verdict, owner FROM verdicts",
    "ingest_status_counts": f"WITH {RAW} SELECT connection_id, CASE verdict WHEN 'NEW' THEN 'ACCEPTED' WHEN 'CONFLICT' THEN 'QUARANTINED' ELSE 'DUPLICATE' END AS status, count(*) AS events FROM verdicts GROUP BY ALL",
    "current_state": f"""WITH {TEL}, late AS (SELECT *, CASE WHEN event_id % 31 = 0 THEN event_id + 40 ELSE event_id END AS seq FROM tel), sig AS ({_SIGNALS})
        SELECT vehicle_id, signal, value, t_us FROM sig WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY vehicle_id, signal ORDER BY t_us DESC, seq DESC) = 1""",
    "movement_state": f"WITH {LAST} SELECT vehicle_id, {MOVE} AS movement FROM last",
    "data_freshness": f"WITH {LAST} SELECT vehicle_id, {FRESH} AS freshness FROM last",
    "live_state": f"WITH {LAST} SELECT vehicle_id, {LIVE} AS state, last_us FROM last",
    "age_label": f"""WITH {LAST}, a AS (SELECT vehicle_id, last_us, (as_of - last_us) // 1000000 AS s FROM last)
        SELECT vehicle_id, CASE WHEN s < 60 THEN s || 's ago' WHEN s < 3600 THEN (s // 60) || 'm ago' WHEN s < 86400 THEN (s // 3600) || 'h ago' ELSE strftime(make_timestamp(last_us), '%Y-%m-%d') END AS label FROM a""",
    "fleet_overview": f"""WITH {LAST}, v AS (SELECT *, {MOVE} AS m, {FRESH} AS f FROM last) SELECT fleet_id, count(*) AS total, count(*) FILTER (m = 'MOVING') AS moving, count(*) FILTER (m = 'IDLE') AS idle,
        count(*) FILTER (m = 'PARKED') AS parked, count(*) FILTER (m = 'CHARGING') AS charging, count(*) FILTER (f = 'LIVE') AS live, count(*) FILTER (f = 'STALE') AS stale, count(*) FILTER (f = 'OFFLINE') AS offline,
        count(*) FILTER (battery_soc < 20) AS attention, count(*) FILTER (NOT connected) AS no_connection FROM v GROUP BY 1""",
    "fleet_stats": f"""WITH {LAST}, v AS (SELECT *, {FRESH} AS f FROM last) SELECT fleet_id, count(*) AS total, count(*) FILTER (f = 'LIVE') AS receiving, count(*) FILTER (NOT connected) AS no_connection,
        count(*) FILTER (f IN ('STALE', 'OFFLINE', 'AWAITING_DATA')) AS attention FROM v GROUP BY 1""",
    "fleet_vehicle_list": f"WITH {_LIST} SELECT * FROM vl",
    "vehicle_search": f"WITH {_LIST} SELECT vehicle_id, label, manufacturer FROM vl WHERE contains(lower(label), 'auto') OR contains(lower(manufacturer), 'auto')",
    "breadcrumbs": f"""WITH {TEL}, k AS (SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY t_us DESC, event_id DESC) AS n FROM tel QUALIFY n <= 200)
        SELECT vehicle_id, count(*)::INT AS points, arg_max(event_id, n) AS oldest, arg_min(event_id, n) AS newest FROM k GROUP BY 1""",
    "latest_sample": f"WITH {LAST} SELECT vehicle_id, last_us, speed_kmh, battery_soc FROM last",
}
