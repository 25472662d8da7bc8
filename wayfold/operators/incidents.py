"""The life of quarantine incidents: which failure belongs to which, and what became of it.

Events are folded by windows. A raw event fails, perhaps again, and is resolved; its first failure opens a record, which is
filed under fleet, connection and category. An incident lasts while one of its records is open: with the last one's
resolution it is closed, and a later failure of the same kind starts a new one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.operators.prefix import running

FAIL, RESOLVE, REPLAY_FAILED = "FAIL", "RESOLVE", "REPLAY_FAILED"
ACKNOWLEDGE, MAPPING_READY, REPLAY = "ACKNOWLEDGE", "MAPPING_READY", "REPLAY"
KEY = ["fleet_id", "connection_id", "category"]
DAY_US = 86_400_000_000

#: Titles by category, and what is out of date while an incident lasts.
TITLES = {
    "SCHEMA_CHANGE": "{} event format does not match any known mapping",
    "INVALID_VALUE": "{} is sending out-of-range sensor values",
    "MISSING_VEHICLE_MAPPING": "Vehicles from {} are not registered in this fleet",
    "EXPIRED_AUTH": "{} account authorisation has expired",
    "INFRA_ERROR": "Temporary connectivity issue receiving data from {}",
    "UNSUPPORTED_OEM": "{} is not yet supported for data ingestion",
    "IDEMPOTENCY_CONFLICT": "{} source event ID reused with conflicting payload",
}
STALE = {
    "SCHEMA_CHANGE": ("location", "trips", "health", "alerts"),
    "UNKNOWN_FORMAT": ("location", "trips", "health", "alerts"),
    "INVALID_VALUE": ("health", "alerts"),
    "MISSING_VEHICLE_MAPPING": ("location", "trips", "health"),
    "EXPIRED_AUTH": ("location", "trips", "health"),
}


def title(category: Column, vendor: Column, reason: Column, expected: Column, observed: Column) -> Column:
    """What an incident is called; a change of format names both forms where they are known."""
    out = F.concat(F.lit("Data issue from "), vendor, F.lit(": "), F.substring(reason, 1, 80))
    for name, text in TITLES.items():
        before, after = text.split("{}")
        out = F.when(category == name, F.concat(F.lit(before), vendor, F.lit(after))).otherwise(out)
    both = (F.length(expected) > 0) & (F.length(observed) > 0)
    return F.when((category == "SCHEMA_CHANGE") & both, F.concat(vendor, F.lit(" format changed – expected "), expected, F.lit(", received "), observed)).otherwise(out)


def stale_projections(category: Column) -> Column:
    out = F.array().cast("array<string>")
    for name, parts in STALE.items():
        out = F.when(category == name, F.array(*[F.lit(p) for p in parts])).otherwise(out)
    return out


def episodes(events: DataFrame) -> DataFrame:
    """Adds to the events of records (``raw_id`` is not null) the number of the record, and whether it opens or closes there.

    A failure of a record that is open updates it (``opens`` is false), and its category stays that of the first failure;
    a resolution or a failed replay without an open record says nothing and is dropped.
    """
    own = Window.partitionBy("raw_id").orderBy("t_us", "seq")
    last = F.last(F.when(F.col("kind").isin(FAIL, RESOLVE), F.col("kind")), ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, -1))
    marked = events.where("raw_id IS NOT NULL").withColumn("was_open", F.coalesce(last == FAIL, F.lit(False)))
    marked = marked.where((F.col("kind") == FAIL) | F.col("was_open"))
    marked = marked.withColumn("opens", (F.col("kind") == FAIL) & ~F.col("was_open")).withColumn("closes", F.col("kind") == RESOLVE)
    upto = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = marked.withColumn("record", F.sum(F.col("opens").cast("int")).over(upto))
    first = Window.partitionBy("raw_id", "record").orderBy("t_us", "seq")
    return marked.withColumns({c: F.first(c).over(first) for c in KEY})


def numbered(events: DataFrame, width_us: int = DAY_US) -> DataFrame:
    """All events with the ``number`` of their incident within its key: those of records, and actions on the incident of their time.

    ``events``: fleet_id, connection_id, category, raw_id (null for actions), vehicle_id, kind, t_us, seq (which with t_us
    tells events apart), reason, expected, observed. Actions before the first incident are dropped; those after its end
    belong to the last one. Keys are cut into ranges of ``width_us``, so that none gathers in a task.
    """
    rows = episodes(events)
    actions = events.where("raw_id IS NULL").withColumns({"opens": F.lit(False), "closes": F.lit(False), "record": F.lit(None).cast("long")})
    both = rows.drop("was_open").unionByName(actions.withColumn("record", F.col("record").cast("long")), allowMissingColumns=True)
    change = F.when(F.col("opens"), 1).when(F.col("closes"), -1).otherwise(0)
    both = running(both, KEY, ["t_us", "seq"], width_us, change, "open_now")
    starts = F.when(F.col("opens") & (F.col("open_now") == 1), 1).otherwise(0)
    return running(both, KEY, ["t_us", "seq"], width_us, starts, "number").where("number > 0")


def records(lived: DataFrame) -> DataFrame:
    """The record of each failure of numbered() events: its incident, attempts, latest reason and status.

    A replay of the incident takes up its records that are open by then and whose replay has not failed yet.
    """
    own = lived.where("raw_id IS NOT NULL")
    rolled = own.groupBy(*KEY, "number", "raw_id", "record").agg(
        F.min("t_us").alias("first_us"), F.max(F.when(F.col("kind") == FAIL, F.col("t_us"))).alias("latest_us"), F.count_if(F.col("kind") == FAIL).alias("failures"),
        F.max_by("reason", F.when(F.col("kind").isin(FAIL, REPLAY_FAILED), F.struct("t_us", "seq"))).alias("reason"), F.min_by("vehicle_id", F.when(F.col("vehicle_id").isNotNull(), F.struct("t_us", "seq"))).alias("vehicle_id"),
        F.max("closes").alias("closed"), F.bool_or(F.col("kind") == REPLAY_FAILED).alias("replay_failed"), F.min(F.struct("t_us", "seq")).alias("opened"),
    )
    replays = lived.where(F.col("kind") == REPLAY).groupBy(*KEY, "number").agg(F.max(F.struct("t_us", "seq")).alias("replay"))
    status = F.when(F.col("closed"), "RESOLVED").when(F.col("replay_failed"), "REPLAY_FAILED").when(F.col("replay") > F.col("opened"), "REPLAYING").otherwise("UNRESOLVED")
    joined = rolled.join(replays, [*KEY, "number"], "left").withColumn("status", F.coalesce(status, F.lit("UNRESOLVED")))
    return joined.select(*KEY, "number", "raw_id", "record", "vehicle_id", "first_us", "latest_us", "failures", "reason", "status")


def incidents(lived: DataFrame, found: DataFrame, vendor: Column) -> DataFrame:
    """The incidents of numbered() events and their records(): times, counts, title, what is out of date and the status.

    The status is what the latest event made of it: opened, made ready, replayed, a record's replay failed; and RESOLVED
    when its last open record was resolved, until an action says otherwise. ``last_us`` is the latest opening of a record.
    """
    at = F.struct("t_us", "seq")
    ended = F.col("closes") & (F.col("open_now") == 0)
    told = F.when(ended, "RESOLVED").when(F.col("kind") == MAPPING_READY, "MAPPING_READY").when(F.col("kind") == REPLAY, "REPLAYING").when(F.col("kind") == REPLAY_FAILED, "REPLAY_FAILED").when(F.col("opens") & (F.col("open_now") == 1), "UNRESOLVED")
    opened = F.when(F.col("opens"), at)
    rolled = lived.groupBy(*KEY, "number").agg(
        F.min(F.when(F.col("opens"), F.col("t_us"))).alias("first_us"), F.max(F.when(F.col("opens"), F.col("t_us"))).alias("last_us"), F.max_by(told, F.when(told.isNotNull(), at)).alias("status"),
        F.max(F.when(F.col("kind") == ACKNOWLEDGE, F.col("t_us"))).alias("acknowledged_us"), F.min_by(F.struct("reason", "expected", "observed"), opened).alias("first"),
    )
    open_ = found.where("status <> 'RESOLVED'").groupBy(*KEY, "number").agg(F.count_distinct("raw_id").alias("open_events"), F.count_distinct("vehicle_id").alias("open_vehicles"))
    joined = rolled.join(open_, [*KEY, "number"], "left")
    named = title(F.col("category"), vendor, F.col("first.reason"), F.coalesce("first.expected", F.lit("")), F.coalesce("first.observed", F.lit("")))
    return joined.select(
        *KEY, "number", "first_us", "last_us", "status", "acknowledged_us", named.alias("title"), F.col("first.reason").alias("description"), stale_projections(F.col("category")).alias("stale"),
        F.coalesce("open_events", F.lit(0)).alias("open_events"), F.coalesce("open_vehicles", F.lit(0)).alias("open_vehicles"),
    )
