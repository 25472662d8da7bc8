"""Structured Streaming forms of the batch operators: the same functions, with state by key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wayfold.operators import ingest, trips


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Deduplicator(StatefulProcessor):
    """What a connection has stored, by hash, by id and by both; a batch looks up and adds only what its rows name."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.by_hash = handle.getMapState("by_hash", "hash string", "owner long")
        self.by_id = handle.getMapState("by_id", "id string", "owner long")
        self.by_both = handle.getMapState("by_both", "id string, hash string", "owner long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        fresh = pd.concat(list(rows)).sort_values("event_key")
        verdicts, owners = [], []
        for event, source, digest in zip(fresh["event_key"], fresh["source_event_id"], fresh["payload_hash"], strict=True):
            event, named = int(event), isinstance(source, str)
            if named and self.by_both.containsKey((source, digest)):
                verdict, owner = ingest.DUPLICATE, self.by_both.getValue((source, digest))[0]
            elif named and self.by_id.containsKey((source,)):
                verdict, owner = ingest.CONFLICT, event
            elif self.by_hash.containsKey((digest,)):
                verdict, owner = ingest.DUPLICATE, self.by_hash.getValue((digest,))[0]
            else:
                verdict, owner = ingest.NEW, event
            if verdict != ingest.DUPLICATE:
                if named:
                    self.by_both.updateValue((source, digest), (event,))
                    if verdict == ingest.NEW:
                        self.by_id.updateValue((source,), (event,))
                if not self.by_hash.containsKey((digest,)):
                    self.by_hash.updateValue((digest,), (event,))
            verdicts.append(verdict)
            owners.append(int(owner))
        yield fresh.assign(verdict=verdicts, owner=owners)[["event_key", "connection_id", "source_event_id", "payload_hash", "verdict", "owner"]]

    def close(self) -> None:
        pass


def deduplicated(events: DataFrame) -> DataFrame:
    """Exact verdicts of a stream, by what each connection has stored, as maps in RocksDB.

    The state has no time limit, as late events are always accepted; a batch costs what its rows cost, whatever the history.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = events.select("event_key", "connection_id", "source_event_id", "payload_hash")
    return rows.groupBy("connection_id").transformWithStateInPandas(_Deduplicator(), ingest.FOLD_SCHEMA, "Append", "none")


def current_values(signals: DataFrame) -> DataFrame:
    """Latest value by vehicle and signal; a row each time one changes. Older event times never overwrite."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = tuple(state.get) if state.exists else None
        before = best
        for b in batches:
            for value, t_us, seq in zip(b["value"], b["t_us"], b["arrival_seq"], strict=True):
                if value is not None and (best is None or (t_us, seq) >= (best[1], best[2])):
                    best = (value, int(t_us), int(seq))
        if best is not None and best != before:
            state.update(best)
            yield pd.DataFrame([(key[0], key[1], best[0], best[1])], columns=["vehicle_id", "signal", "value", "t_us"])

    return signals.groupBy("vehicle_id", "signal").applyInPandasWithState(step, "vehicle_id long, signal string, value string, t_us long", "value string, t_us long, seq long", "update", GroupStateTimeout.NoTimeout)


def sequenced(changes: DataFrame) -> DataFrame:
    """The change feed: a gapless counter of each fleet, kept as state."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values(["t_us", "event_id", "event_type"])
        rows["sequence"] = range(n + 1, n + len(rows) + 1)
        state.update((n + len(rows),))
        yield rows[["fleet_id", "event_id", "event_type", "sequence"]]

    return changes.groupBy("fleet_id").applyInPandasWithState(step, "fleet_id long, event_id long, event_type string, sequence long", "n long", "append", GroupStateTimeout.NoTimeout)


def activity_windows(jobs: DataFrame, gap: str = "5 minutes", lateness: str = "1 hour") -> DataFrame:
    """Sessions of jobs by fleet; ``jobs`` has ts and fleet_id. Exactly the gap still joins."""
    return jobs.withWatermark("ts", lateness).groupBy(F.session_window("ts", gap), "fleet_id").agg(F.count("*").alias("jobs"))


HISTORY_BUCKETS = 256


def keep_trips_current(spark: SparkSession, points_path: str, trips_path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: appends a batch of points and builds the trips of the vehicles in it anew.

    Late points are handled by recomputing their vehicles from the whole history, whatever their age. Each batch writes its
    own folder, named by its number, so a repeated batch replaces itself; current_trips() reads the newest of each vehicle.
    Points lie in buckets by a hash of the vehicle, and only the buckets of a batch's vehicles are read.
    """
    bucket = F.pmod(F.xxhash64("vehicle_id"), F.lit(HISTORY_BUCKETS)).cast("int")

    def update(batch: DataFrame, number: int) -> None:
        batch.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{points_path}/batch={number}")
        touched = batch.select("vehicle_id").distinct()
        buckets = [r.bucket for r in touched.select(bucket.alias("bucket")).distinct().collect()]  # at most HISTORY_BUCKETS
        stored = spark.read.option("basePath", points_path).parquet(points_path)
        history = stored.where((F.col("batch") <= number) & F.col("bucket").isin(buckets)).drop("batch", "bucket")
        points = trips.segmented(trips.with_steps(trips.gps_points(history.join(touched, "vehicle_id", "left_semi"))))
        built = trips.trips(points)
        marks = touched.join(built, "vehicle_id", "left")  # a vehicle whose trips are gone leaves an empty row
        marks.write.mode("overwrite").parquet(f"{trips_path}/batch={number}")

    return update


def current_trips(spark: SparkSession, trips_path: str) -> DataFrame:
    """The trips of each vehicle from the last batch that touched it."""
    all_ = spark.read.option("basePath", trips_path).parquet(trips_path)
    last = all_.groupBy("vehicle_id").agg(F.max("batch").alias("batch"))
    return all_.join(last, ["vehicle_id", "batch"]).where("trip_id is not null").drop("batch")


def run_to_end(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Runs a stream over what is there into a table in memory."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
