"""Quarantine and replay, insights, imports, jobs, snapshots and the change feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions.scalars import SECOND, half_up
from wayfold.operators.prefix import running

UNRESOLVED, ACKNOWLEDGED, RESOLVED = "UNRESOLVED", "ACKNOWLEDGED", "RESOLVED"
WEEK_US = 7 * 86400 * SECOND
LOW_CHARGE = 20
CLAIM_AGE_US = 600 * SECOND

#: Signs of each failure in its reason, the first that fits decides; anything else is a change of schema.
FAILURE_SIGNS = (
    ("INVALID_COORDINATES", ("coordinate", "latitude", "longitude")),
    ("INVALID_TIME", ("timestamp", "invalid event time", "time format", "invalid time")),
    ("INVALID_VALUE", ("invalid number", "below min", "above max", "invalid value")),
    ("TYPE_ERROR", ("type error", "invalid type")),
    ("IDEMPOTENCY_CONFLICT", ("conflict", "idempotency")),
    ("MISSING_VEHICLE_MAPPING", ("vehicle not mapped", "vehicle id not found", "not mapped")),
    ("EXPIRED_AUTH", ("expired", "unauthori", "auth")),
    ("UNSUPPORTED_OEM", ("unsupported oem",)),
    ("INFRA_ERROR", ("timeout", "connection refused", "unavailable")),
)
RETRYABLE = ("INFRA_ERROR",)


def categorize(reason: Column) -> Column:
    text, out = F.lower(reason), F.lit("SCHEMA_CHANGE")
    for category, signs in reversed(FAILURE_SIGNS):
        hit = F.lit(False)
        for sign in signs:
            hit = hit | text.contains(sign)
        out = F.when(hit, category).otherwise(out)
    return out


def quarantine_records(rejected: DataFrame) -> DataFrame:
    """A record of each rejected event, but for those that are tried again by themselves.

    ``rejected`` has its verdict as category:reason, and status, attempt and known_vehicle of its record.
    """
    parts = F.split("verdict", ":")
    made = rejected.select(
        "event_id", "vehicle_id", "fleet_id", "connection_id", "t_us", parts[0].alias("category"), parts[1].alias("reason"), "status", "attempt", "known_vehicle",
    )
    return made.where(~F.col("category").isin(*RETRYABLE))


def incidents(records: DataFrame) -> DataFrame:
    """Records by fleet, connection and category; resolved when all of them are."""
    open_ = F.col("status") != RESOLVED
    rolled = records.groupBy("fleet_id", "connection_id", "category").agg(
        F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us"), F.count_distinct(F.when(open_, F.col("event_id"))).alias("open_events"),
        F.count_distinct(F.when(open_, F.col("known_vehicle"))).alias("open_vehicles"), F.bool_and(~open_).alias("closed"),
    )
    key = F.sha2(F.concat_ws("|", F.col("fleet_id").cast("string"), "connection_id", "category"), 256)
    return rolled.select("fleet_id", "connection_id", "category", key.alias("incident_id"), "first_us", "last_us", "open_events", "open_vehicles", F.when(F.col("closed"), RESOLVED).otherwise(UNRESOLVED).alias("status"))


def replay_progress(items: DataFrame) -> DataFrame:
    p = items.groupBy("fleet_id").agg(F.count("*").alias("total"), F.count_if(F.col("item_status") == "DONE").alias("done"), F.count_if(F.col("item_status") == "FAILED").alias("failed"))
    return p.withColumn("percent", half_up(100.0 * (F.col("done") + F.col("failed")) / F.col("total")))


def replay_outcome(total: Column, done: Column, failed: Column) -> Column:
    return F.when(total == 0, "NO_EVENTS").when((failed == 0) & (done > 0), "SUCCESS").when(done > 0, "PARTIAL_SUCCESS").otherwise("FAILED")


def safety(events: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Vehicles with harsh braking or speeding in the week before the latest reading."""
    recent = events.where(F.col("kind").isin("HARSH_BRAKE", "SPEED_VIOLATION")).join(vehicles.select("vehicle_id", "fleet_id", "as_of"), "vehicle_id").where(F.col("t_us") >= F.col("as_of") - WEEK_US)
    return recent.groupBy("fleet_id", "vehicle_id").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("detail"))


def _faulty() -> Column:
    return F.col("fault_code").isNotNull() & ~F.upper("fault_code").isin("NULL", "NONE", "0", "CLEAR", "")


def _unfit() -> Column:
    return F.col("reason").isNotNull() | F.col("freshness").isin("STALE", "OFFLINE", "ERROR")


def _with_reason(vehicles: DataFrame, records: DataFrame) -> DataFrame:
    """Adds the category of each vehicle's oldest unresolved record."""
    reason = records.where((F.col("status") == UNRESOLVED) & F.col("known_vehicle").isNotNull()).groupBy(F.col("known_vehicle").alias("vehicle_id")).agg(F.min_by("category", F.struct("t_us", "event_id")).alias("reason"))
    return vehicles.join(reason, "vehicle_id", "left")


def service(vehicles: DataFrame) -> DataFrame:
    return vehicles.where(_faulty()).select("fleet_id", "vehicle_id", F.col("fault_code").alias("detail"))


def charging(vehicles: DataFrame) -> DataFrame:
    return vehicles.where(F.col("battery_soc") < LOW_CHARGE).select("fleet_id", "vehicle_id", F.concat(F.col("battery_soc").cast("string"), F.lit("%")).alias("detail"))


def quality(vehicles: DataFrame, records: DataFrame) -> DataFrame:
    """Vehicles with an unresolved record, or stale, offline or in error; the reason is the oldest record's category."""
    return _with_reason(vehicles, records).where(_unfit()).select("fleet_id", "vehicle_id", F.coalesce("reason", "freshness").alias("detail"))


def tagged(vehicles: DataFrame, records: DataFrame) -> DataFrame:
    """(metric, fleet_id, vehicle_id) of service, charging and quality in one pass over the vehicles."""
    metrics = F.array_compact(F.array(F.when(_faulty(), "service"), F.when(F.col("battery_soc") < LOW_CHARGE, "charging"), F.when(_unfit(), "quality")))
    return _with_reason(vehicles, records).select(F.explode(metrics).alias("metric"), "fleet_id", "vehicle_id")


def vin_valid(vin: Column) -> Column:
    return (F.length(vin) == 17) & vin.rlike("^[A-HJ-NPR-Z0-9]{17}$")


def vin_decode(rows: DataFrame, makers: list[tuple[str, str, str]]) -> DataFrame:
    """The maker of each vehicle number by three characters, or uncertainly by the first entry with the same two.

    ``makers``: (prefix, maker, maker_id) in order, a short list, which becomes an expression.
    """
    entry = lambda m: F.struct(F.lit(m[1]).alias("maker"), F.lit(m[2]).alias("maker_id"))
    clean = F.upper(F.trim("vin"))
    exact = near = F.lit(None).cast("struct<maker: string, maker_id: string>")
    for m in reversed(makers):
        exact = F.when(F.substring(clean, 1, 3) == m[0], entry(m)).otherwise(exact)
        near = F.when(F.substring(clean, 1, 2) == m[0][:2], entry(m)).otherwise(near)
    found = rows.withColumns({"exact": exact, "near": near})
    confidence = F.when(F.col("exact").isNotNull(), "HIGH").when(F.col("near").isNotNull(), "LOW").otherwise("NONE")
    maker = F.coalesce(F.col("exact.maker"), F.concat("near.maker", F.lit(" (uncertain)")))
    return found.withColumns({"maker": maker, "maker_id": F.coalesce("exact.maker_id", "near.maker_id"), "confidence": confidence}).select(*rows.columns, "maker", "maker_id", "confidence")


def csv_lines(lines: DataFrame) -> DataFrame:
    """vin and label of the lines of an import file; lines without a number are skipped."""
    parsed = lines.withColumn("p", F.from_csv("line", "vin string, label string"))
    return parsed.select(*[c for c in lines.columns if c != "line"], F.upper(F.trim("p.vin")).alias("vin"), F.trim("p.label").alias("label")).where(F.length("vin") > 0)


def import_preview(decoded: DataFrame, in_fleet: Column) -> DataFrame:
    """What an import would do with each row of vin_decode's result; of equal numbers in a file the first counts."""
    again = F.row_number().over(Window.partitionBy("vin").orderBy("row")) > 1
    status = F.when(~vin_valid(F.col("vin")), "invalid").when(in_fleet, "duplicate-in-fleet").when(again, "duplicate-in-file").when(F.col("confidence") != "HIGH", "uncertain").otherwise("valid")
    return decoded.withColumn("status", status)


FEED_RANGE_US = 3600 * SECOND


def change_feed(changes: DataFrame, only: Column | None = None) -> DataFrame:
    """A gapless sequence of each fleet's changes: ranges of an hour are counted first, then numbered within."""
    rows = running(changes.select("fleet_id", "event_id", "event_type", "t_us"), ["fleet_id"], ["t_us", "event_id", "event_type"], FEED_RANGE_US, name="sequence", only=only)
    return rows.select("fleet_id", "event_id", "event_type", "sequence")


def catch_up(changes: DataFrame, since: int, limit: int) -> DataFrame:
    """The changes after a sequence number, at most ``limit`` of each fleet; only the ranges that hold them are numbered."""
    held = (F.col("before") < since + limit) & (F.col("before") + F.col("in_range") > since)
    return change_feed(changes, held).where((F.col("sequence") > since) & (F.col("sequence") <= since + limit))


def contiguous(feed: DataFrame) -> DataFrame:
    """How far each fleet's received changes have no gap (null if the first is missing), and how many are held back behind one.

    The end of each run of numbers is found by a join on the next number; no fleet gathers in a task. Repeats count once.
    """
    seen = feed.select("fleet_id", "sequence").distinct()
    after = seen.select("fleet_id", (F.col("sequence") - 1).alias("sequence"))
    ends = seen.join(after, ["fleet_id", "sequence"], "left_anti").groupBy("fleet_id").agg(F.min("sequence").alias("end"))
    counts = seen.groupBy("fleet_id").agg(F.count("*").alias("n"), F.min("sequence").alias("first"))
    applied = F.when(F.col("first") == 1, F.col("end"))
    return counts.join(ends, "fleet_id").select("fleet_id", applied.alias("applied"), (F.col("n") - F.coalesce(applied, F.lit(0))).alias("held"))


def activities(jobs: DataFrame, gap_us: int) -> DataFrame:
    """Jobs of a fleet, kind and worker that follow each other within a gap, as one activity named by its first job."""
    w = Window.partitionBy("fleet_id", "kind", "worker").orderBy("queued_us", "job_id")
    fresh = F.coalesce(F.col("queued_us") - F.lag("queued_us").over(w) > gap_us, F.lit(True))
    numbered = jobs.withColumn("fresh", fresh).withColumn("session", F.sum(F.col("fresh").cast("int")).over(w))
    is_ = lambda s: F.count_if(F.col("status") == s)
    rolled = numbered.groupBy("fleet_id", "kind", "worker", "session").agg(
        F.min_by("job_id", F.struct("queued_us", "job_id")).alias("activity_id"), F.count("*").alias("jobs"), F.min("queued_us").alias("first_us"), F.max("queued_us").alias("last_us"),
        is_("DONE").alias("done"), is_("FAILED").alias("failed"), is_("PENDING").alias("pending"), is_("RUNNING").alias("running"),
    )
    return rolled.drop("session")


def activity_rollup(activities: DataFrame) -> DataFrame:
    total = activities.groupBy("fleet_id", "kind").agg(F.count("*").alias("activities"), *[F.sum(c).alias(c) for c in ("jobs", "done", "failed", "pending", "running")], F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"))
    status = (
        F.when(F.col("running") > 0, "RUNNING").when(F.col("pending") > 0, "QUEUED").when((F.col("failed") > 0) & (F.col("done") == 0), "NEEDS_ATTENTION")
        .when(F.col("failed") > 0, "COMPLETED_WITH_ISSUES").otherwise("COMPLETED")
    )
    return total.select("fleet_id", "kind", status.alias("status"), "activities", "jobs", "done", "failed", "first_us", "last_us")


def queue_health(jobs: DataFrame) -> DataFrame:
    pending, running = F.col("status") == "PENDING", F.col("status") == "RUNNING"
    h = jobs.groupBy("fleet_id").agg(F.count_if(pending).alias("pending"), F.count_if(running).alias("running"), F.count_if(F.col("status") == "FAILED").alias("failed"), F.min(F.when(pending, F.col("queued_us"))).alias("oldest_us"), F.count_distinct(F.when(running, F.col("worker"))).alias("workers"))
    return h.withColumn("health", F.when((F.col("failed") > F.col("pending")) | (F.col("workers") == 0), "DEGRADED").otherwise("HEALTHY"))


def claim_order(pending: DataFrame) -> DataFrame:
    """Position of each pending job: by priority, then age; jobs of over ten minutes come first."""
    now = pending.agg(F.max("queued_us").alias("now")).scalar()
    priority = F.when((F.col("kind") == "NORMALIZE") | (now - F.col("queued_us") > CLAIM_AGE_US), 0).when(F.col("kind") == "PROJECT", 1).otherwise(2)
    first = pending.withColumn("priority", priority).orderBy("priority", "queued_us", "job_id").limit(50)
    return first.withColumn("position", F.row_number().over(Window.orderBy("priority", "queued_us", "job_id")))


def worker_budget(pending: Column, rate: Column, quiet: Column) -> Column:
    """Jobs a tick: 20 with a backlog or in quiet hours, 4 under load, else 10."""
    return F.when(quiet | (pending >= 1000), 20).when((rate >= 5) | (pending >= 200), 4).otherwise(10)


def replica_merge(versions: DataFrame) -> DataFrame:
    """The highest revision of each entity; a null body is a tombstone and stays."""
    return versions.groupBy("entity").agg(F.max_by(F.struct("revision", "body"), "revision").alias("v")).select("entity", "v.revision", "v.body")


def delivery_status(ledger: DataFrame, cancelled: DataFrame) -> DataFrame:
    """Deliveries by connection and state: pending ones of cancelled vehicles are cancelled, after five attempts exhausted."""
    joined = ledger.join(cancelled.withColumn("gone", F.lit(True)), "vehicle_id", "left")
    status = F.when(F.col("status") == "DELIVERED", "DELIVERED").when(F.col("gone"), "CANCELLED").when(F.col("attempts") >= 5, "EXHAUSTED").otherwise("PENDING")
    wait = F.when(status == "PENDING", F.least(F.lit(60.0), F.pow(F.lit(2.0), F.col("attempts"))).cast("int"))
    return joined.select("connection_id", status.alias("state"), wait.alias("wait")).groupBy("connection_id", F.col("state").alias("status")).agg(F.count("*").alias("deliveries"), F.max("wait").alias("longest_wait_s"))


def profile_pick(profiles: DataFrame) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("vendor", "version").orderBy(F.desc("repair"), F.desc("published")))
    return profiles.where("status = 'ACTIVE'").withColumn("n", rank).where("n = 1").select("vendor", "version", "profile")
