"""Identity of incoming events, deduplication and conflicts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEW, DUPLICATE, CONFLICT = "NEW", "DUPLICATE", "CONFLICT"


def payload_hash(payload: Column) -> Column:
    return F.sha2(payload, 256)


def idempotency_key(connection: Column, source_id: Column, digest: Column) -> Column:
    """By the source's own id if it has one, else by the hash of the payload."""
    return F.when(F.length(F.trim(source_id)) > 0, F.concat_ws(":", connection, source_id)).otherwise(F.concat_ws(":", connection, F.lit("hash"), digest))


def fold_one(rows: pd.DataFrame) -> pd.DataFrame:
    """The exact decision of a connection's events in order of arrival; only stored events count."""
    by_id: dict = {}
    by_hash: dict = {}
    verdicts, owners = [], []
    for event, source, digest in zip(rows["event_key"], rows["source_event_id"], rows["payload_hash"], strict=True):
        named = source is not None and source == source
        stored = by_id.get(source) if named else None
        if stored is not None and digest in stored:
            verdicts.append(DUPLICATE)
            owners.append(stored[digest])
        elif stored is not None:
            verdicts.append(CONFLICT)
            owners.append(event)
            stored[digest] = event
            by_hash.setdefault(digest, event)
        elif digest in by_hash:
            verdicts.append(DUPLICATE)
            owners.append(by_hash[digest])
        else:
            verdicts.append(NEW)
            owners.append(event)
            if named:
                by_id[source] = {digest: event}
            by_hash[digest] = event
    return rows.assign(verdict=verdicts, owner=owners)[["event_key", "connection_id", "source_event_id", "payload_hash", "verdict", "owner"]]


FOLD_SCHEMA = "event_key long, connection_id string, source_event_id string, payload_hash string, verdict string, owner long"


ROWS_A_PART = 25_000


def fold_part(rows: pd.DataFrame) -> pd.DataFrame:
    """The decision of some ids' events in order of arrival; ``first_of_hash`` says what other ids stored."""
    stored: dict = {}
    verdicts, owners = [], []
    for event, connection, source, digest, first in zip(rows["event_key"], rows["connection_id"], rows["source_event_id"], rows["payload_hash"], rows["first_of_hash"], strict=True):
        named = source is not None and source == source
        own = stored.get((connection, source)) if named else None
        if own is not None and digest in own:
            verdicts.append(DUPLICATE)
            owners.append(own[digest])
        elif own is not None:
            verdicts.append(CONFLICT)
            owners.append(event)
            own[digest] = event
        elif first != event:
            verdicts.append(DUPLICATE)
            owners.append(first)
        else:
            verdicts.append(NEW)
            owners.append(event)
            if named:
                stored[connection, source] = {digest: event}
    return rows.assign(verdict=verdicts, owner=owners)[["event_key", "connection_id", "source_event_id", "payload_hash", "verdict", "owner"]]


def parted(rows: DataFrame, rows_a_part: int) -> DataFrame:
    """Adds ``part``: all events of an id of a connection are in one, others are dealt by their hash; more events make more parts."""
    parts = rows.count() // rows_a_part + 1
    return rows.withColumn("part", F.pmod(F.xxhash64("connection_id", "source_event_id", F.when(F.col("source_event_id").isNull(), F.col("payload_hash"))), F.lit(parts)))


def fold(events: DataFrame, rows_a_part: int = ROWS_A_PART) -> DataFrame:
    """The verdicts of fold_one() over each connection; ``events`` has event_key in order of arrival.

    The first event of a payload hash is always stored, so events of different ids only meet in that event's key. With it
    joined, the fold goes over parts of the ids of about ``rows_a_part`` events, whatever the size of a connection.
    """
    rows = events.select("event_key", "connection_id", "source_event_id", "payload_hash")
    by_hash = rows.groupBy(F.col("connection_id").alias("c"), F.col("payload_hash").alias("h")).agg(F.min("event_key").alias("first_of_hash"))
    rows = parted(rows, rows_a_part).join(by_hash, F.col("connection_id").eqNullSafe(F.col("c")) & F.col("payload_hash").eqNullSafe(F.col("h")))
    return rows.drop("c", "h").groupBy("part").applyInPandas(lambda p: fold_part(p.sort_values("event_key")), FOLD_SCHEMA)


def deduplicate(events: DataFrame) -> DataFrame:
    """The same verdicts by least keys, without a fold.

    The first event of a payload hash is always stored: if its id has stored events, none has this hash (a conflict), and
    otherwise nothing has it (new). An id is known from its first event that is the first of its hash on; what it sends
    before are copies of other ids' payloads. From then on its first event of each hash is stored, and others are copies of
    that. Three least keys, by hash, by id and by both, thus decide; they are found map-side first, and no connection, id
    or hash gathers in a task but for the join of its rows with one number.
    """
    rows = events.select("event_key", "connection_id", "source_event_id", "payload_hash")
    by_hash = rows.groupBy("connection_id", "payload_hash").agg(F.min("event_key").alias("first_of_hash"))
    rows = rows.join(by_hash, ["connection_id", "payload_hash"])
    known = rows.where("source_event_id IS NOT NULL AND event_key = first_of_hash").groupBy("connection_id", "source_event_id").agg(F.min("event_key").alias("known_from"))
    rows = rows.join(known, ["connection_id", "source_event_id"], "left")
    stored = rows.where("event_key >= known_from").groupBy("connection_id", "source_event_id", "payload_hash").agg(F.min("event_key").alias("stored_key"))
    rows = rows.join(stored, ["connection_id", "source_event_id", "payload_hash"], "left")
    named = F.coalesce(F.col("event_key") >= F.col("known_from"), F.lit(False))
    owner = F.when(named, F.col("stored_key")).otherwise(F.col("first_of_hash"))
    verdict = F.when(owner != F.col("event_key"), DUPLICATE).when(named & (F.col("event_key") > F.col("known_from")), CONFLICT).otherwise(NEW)
    return rows.select("event_key", "connection_id", "source_event_id", "payload_hash", verdict.alias("verdict"), owner.alias("owner"))


def rewound(polls: DataFrame) -> DataFrame:
    """What a poll makes of each source's cursor: (action, next_cursor) beside its columns.

    ``polls``: cursor (text, null at first), events (rows on the page), last_sequence (of the page, null if empty) and
    latest_sequence (of the newest sample, null if the source has none). An empty page while the newest sample lies
    before the cursor means that the source began anew: the sample is taken in and the cursor set back to it. A cursor that
    is no number is set back likewise.
    """
    number = F.col("cursor").try_cast("long")
    behind = (F.col("events") == 0) & (F.length("cursor") > 0) & F.col("latest_sequence").isNotNull() & (number.isNull() | (F.col("latest_sequence") < number))
    action = F.when(behind, "REWIND").when(F.col("events") > 0, "ADVANCE").otherwise("WAIT")
    after = F.when(behind, F.col("latest_sequence").cast("string")).when(F.col("events") > 0, F.col("last_sequence").cast("string")).otherwise(F.col("cursor"))
    return polls.withColumns({"action": F.coalesce(action, F.lit("WAIT")), "next_cursor": after})
