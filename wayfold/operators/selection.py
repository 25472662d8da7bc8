"""Who may send, which mapping or repair applies, what may be published, and which snapshots are due."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.operators.contracts import once, with_values

NOT_FOUND = "CONNECTION_NOT_FOUND"


def tenant_check(requests: DataFrame, connections: DataFrame) -> DataFrame:
    """Adds ``tenant``: ACCEPTED where the connection belongs to the fleet that asks, else CONNECTION_NOT_FOUND.

    A connection of another fleet and one that doesn't exist look alike. Null ids are not found.
    """
    known = connections.select("connection_id", "fleet_id").distinct().withColumn("tenant", F.lit("ACCEPTED"))
    return requests.join(known, ["connection_id", "fleet_id"], "left").withColumn("tenant", F.coalesce("tenant", F.lit(NOT_FOUND)))


@dataclass(frozen=True)
class Profile:
    id: str
    vendor: str
    version: str
    status: str = "ACTIVE"


def resolve_profile(rows: DataFrame, formats: list[tuple[str, str]], profiles: list[Profile]) -> DataFrame:
    """Adds ``profile_id`` and ``problem``: the profile that maps a row of some vendor and version, or why there is none.

    ``forced_id``, where it is not null, names the profile, which must be of the row's vendor and version but needn't be
    active; otherwise it is the active one of the format. A format is to have one active profile; of several the first counts.
    """
    same = lambda p: (F.col("vendor") == p.vendor) & (F.col("version") == p.version)
    forced, fits = F.col("forced_id"), F.lit(False)
    active = F.lit(None).cast("string")
    for p in reversed(profiles):
        fits = F.when(forced == p.id, F.coalesce(same(p), F.lit(False))).otherwise(fits)
        if p.status == "ACTIVE":
            active = F.when(same(p), p.id).otherwise(active)
    known = F.lit(False)
    for vendor, version in formats:
        known = known | F.coalesce((F.col("vendor") == vendor) & (F.col("version") == version), F.lit(False))
    exists = forced.isin(*[p.id for p in profiles]) if profiles else F.lit(False)
    problem = (
        F.when(forced.isNotNull(), F.when(~exists, "UNKNOWN_FORMAT:profile not found").when(~F.col("fits"), "SCHEMA_CHANGE:profile mismatch"))
        .when(~F.col("known"), "UNKNOWN_FORMAT:version")
        .when(F.col("active").isNull(), "SCHEMA_CHANGE:no active profile")
    )
    read = once(rows, rows.columns, {"fits": fits, "known": known, "active": active}).withColumn("problem", problem)
    return read.withColumn("profile_id", F.when(F.col("problem").isNull(), F.coalesce("forced_id", "active"))).drop("fits", "known", "active")


@dataclass(frozen=True)
class Repair:
    id: str
    connection_id: str
    published_us: int
    live_mode: str  # replay_only, invalid_only or matching
    required: tuple[tuple[str, ...], ...]  # of each required rule, its sources
    discriminator: tuple[str, str] | None = None  # path and text


def live_repair(rows: DataFrame, repairs: list[Repair]) -> DataFrame:
    """Adds ``repair_id``: the newest published repair of the row's connection that applies to its payload, or null.

    A repair applies where its discriminator has its value and every required rule has a source that is there (JSON null is).
    ``own_valid`` tells that the connection's own format accepts the payload. Repairs for replays alone never apply here,
    those for invalid payloads only where it is false. Of repairs published at once the later in the list counts.
    """
    live = [r for r in repairs if r.live_mode != "replay_only"]
    paths = list(dict.fromkeys([p for r in live for sources in r.required for p in sources] + [r.discriminator[0] for r in live if r.discriminator]))
    read = with_values(rows.withColumn("parsed", F.try_parse_json("payload")), paths)
    value = lambda path: F.col(f"value_{paths.index(path)}")
    found = F.lit(None).cast("string")
    for r in sorted(live, key=lambda r: r.published_us):  # the last one wraps the others, so it is asked first
        here = F.col("connection_id") == r.connection_id
        if r.discriminator:
            here = here & F.coalesce(F.try_variant_get(value(r.discriminator[0]), "$", "string") == r.discriminator[1], F.lit(False))
        for sources in r.required:
            here = here & F.coalesce(*[value(p) for p in sources]).isNotNull()
        if r.live_mode == "invalid_only":
            here = here & ~F.coalesce(F.col("own_valid"), F.lit(False))
        found = F.when(here, r.id).otherwise(found)
    return once(read, rows.columns, {"repair_id": found})


def publish_gate(drafts: DataFrame, results: DataFrame) -> DataFrame:
    """The verdict on each draft (draft_id, status, revision, tested_revision, asked_revision) by the results of its tests.

    ``results``: draft_id, regression (whether the case is one of the existing format) and success. One case must pass, and
    none of the existing format may fail.
    """
    failed = F.count_if(F.col("regression") & ~F.col("success"))
    tests = results.groupBy("draft_id").agg(F.count_if(~F.col("regression") & F.col("success")).alias("passed"), failed.alias("broken"))
    verdict = (
        F.when((F.col("status") != "DRAFT") | ~F.col("revision").eqNullSafe(F.col("asked_revision")), "CONFLICT")
        .when(~F.col("tested_revision").eqNullSafe(F.col("asked_revision")), "UNTESTED")
        .when((F.coalesce("passed", F.lit(0)) == 0) | (F.col("broken") > 0), "TESTS_FAILED")
        .otherwise("PUBLISHED")
    )
    return drafts.join(tests, "draft_id", "left").select("draft_id", verdict.alias("verdict"))


def refresh_queue(changes: DataFrame, trips: DataFrame | None = None) -> DataFrame:
    """Changed rows (kind, entity_id, vehicle_id, changed_us) coalesced to one entry of each kind and entity.

    A change of a trip is one of its vehicle too; one of kind quarantine is one of its vehicle and of all its vehicle's
    ``trips`` (trip_id, vehicle_id). ``generation`` counts the changes, so that a refresh of an older one doesn't clear the
    entry; changes without a vehicle don't count. Counted map-side before the shuffle, the trips' share by vehicle.
    """
    known = changes.where("vehicle_id IS NOT NULL")
    trip = F.struct(F.lit("trip").alias("kind"), F.col("entity_id").cast("string").alias("entity_id"))
    vehicle = F.struct(F.lit("vehicle").alias("kind"), F.col("vehicle_id").cast("string").alias("entity_id"))
    both = F.when(F.col("kind") == "trip", F.array(trip, vehicle)).otherwise(F.array(vehicle))
    each = known.select("vehicle_id", F.lit(1).alias("n"), F.col("changed_us").alias("first_us"), F.col("changed_us").alias("last_us"), F.inline(both))
    if trips is not None:
        marks = known.where("kind = 'quarantine'").groupBy("vehicle_id").agg(F.count("*").alias("n"), F.min("changed_us").alias("first_us"), F.max("changed_us").alias("last_us"))
        each = each.unionByName(trips.join(marks, "vehicle_id").select("vehicle_id", "n", "first_us", "last_us", F.lit("trip").alias("kind"), F.col("trip_id").cast("string").alias("entity_id")))
    return each.groupBy("kind", "entity_id").agg(F.max("vehicle_id").alias("vehicle_id"), F.sum("n").alias("generation"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"))


QUIET_US, LONGEST_US, LONGEST_RETRY_S = 2_000_000, 10_000_000, 300


def refresh_due(queue: DataFrame, now: Column, quiet_us: int = QUIET_US, longest_us: int = LONGEST_US) -> DataFrame:
    """Adds ``due``: entries of the first change, those quiet for ``quiet_us``, and those that wait for ``longest_us`` however often they change.

    An entry that failed (``retry_us``, where there is such a column) waits until then.
    """
    due = (F.col("generation") == 1) | (F.col("last_us") <= now - quiet_us) | (F.col("first_us") <= now - longest_us)
    if "retry_us" in queue.columns:
        due = due & (F.col("retry_us").isNull() | (F.col("retry_us") <= now))
    return queue.withColumn("due", due)


def refresh_pick(queue: DataFrame, now: Column, limit: int, quiet_us: int = QUIET_US, longest_us: int = LONGEST_US) -> DataFrame:
    """The entries that a pass takes up, longest waiting first: half of the ``limit`` is kept for vehicles, the rest for trips.

    A pass of one takes the longest waiting entry of either kind, a vehicle before a trip. Ties go by entity_id.
    """
    due = refresh_due(queue, now, quiet_us, longest_us).where("due").drop("due")
    if limit < 2:
        return due.orderBy("first_us", F.desc("kind"), "entity_id").limit(limit)
    first = lambda kind, n: due.where(F.col("kind") == kind).orderBy("first_us", "entity_id").limit(n)
    return first("vehicle", limit // 2).unionByName(first("trip", limit - limit // 2))


def refresh_acknowledge(queue: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """The queue after a pass: what was refreshed goes, unless it has changed since; what failed is tried again later.

    ``results``: kind, entity_id, the generation that was read, and failed. Retries wait for 2, 4, 8, ... seconds, 300 at most.
    """
    done = results.select("kind", "entity_id", F.col("generation").alias("read"), "failed")
    same = F.col("read").eqNullSafe(F.col("generation"))
    joined = queue.join(done, ["kind", "entity_id"], "left").where(~(same & ~F.coalesce("failed", F.lit(True))))
    again = same & F.col("failed")
    wait = F.least(F.lit(float(LONGEST_RETRY_S)), F.pow(F.lit(2.0), F.least(F.col("attempts") + 1, F.lit(8)))).cast("long")
    joined = joined.withColumn("retry_us", F.when(again, now + wait * 1_000_000).otherwise(F.col("retry_us")))
    return joined.withColumn("attempts", F.when(again, F.col("attempts") + 1).otherwise(F.col("attempts"))).select(*queue.columns)
