from __future__ import annotations

from wayfold.operators import fleet, ingest, state, trips
from wayfold.plans import ingest_queries
from wayfold.sources.fixtures import telemetry
from wayfold.streaming import live


def stream_of(spark, df, folder, parts=3):
    """The rows as a stream of several files, one a micro-batch."""
    for i in range(parts):
        df.where(f"event_key % {parts} = {i}").coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_streamed_dedup_equals_the_fold(spark, sf_dir, tmp_path):
    raw = ingest_queries.raw(spark, sf_dir).select("event_key", "connection_id", "source_event_id", "payload_hash")
    raw.where("event_key < 1000000000").coalesce(1).write.parquet(str(tmp_path / "in"))
    raw.where("event_key >= 1000000000 and event_key < 2000000000").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    raw.where("event_key >= 2000000000").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    live.run_to_end(live.deduplicated(source), "dedup_out", str(tmp_path / "cp"))
    got = {r.event_key: r.verdict for r in spark.table("dedup_out").collect()}
    want = {r.event_key: r.verdict for r in ingest.fold(raw).collect()}
    assert got == want


def test_streamed_state_and_feed_equal_the_batch(spark, sf_dir, tmp_path):
    t = telemetry(spark, sf_dir)
    signals = t.selectExpr("event_id as event_key", "vehicle_id", "'battery_soc' as signal", "cast(battery_soc as string) as value", "t_us", "t_us as received_us", "event_id as arrival_seq")
    source = stream_of(spark, signals, tmp_path / "a")
    live.run_to_end(live.current_values(source), "state_out", str(tmp_path / "cpa"), "update")
    got: dict = {}
    for r in spark.table("state_out").orderBy("t_us").collect():
        got[r.vehicle_id] = (r.value, r.t_us)
    assert got == {r.vehicle_id: (r.value, r.t_us) for r in state.current_values(signals).collect()}
    changes = t.selectExpr("event_id as event_key", "fleet_id", "event_id", "event_type", "t_us")
    live.run_to_end(live.sequenced(stream_of(spark, changes, tmp_path / "b")), "feed_out", str(tmp_path / "cpb"))
    rows = spark.table("feed_out").collect()
    for f in {r.fleet_id for r in rows}:
        mine = sorted(r.sequence for r in rows if r.fleet_id == f)
        assert mine == list(range(1, len(mine) + 1))
    assert len(rows) == fleet.change_feed(changes).count()


def test_trips_kept_current_equal_the_batch(spark, sf_dir, tmp_path):
    t = telemetry(spark, sf_dir).where("vehicle_id < 6").withColumnRenamed("event_id", "event_key")
    source = stream_of(spark, t, tmp_path / "in").withColumnRenamed("event_key", "event_id")
    update = live.keep_trips_current(spark, str(tmp_path / "points"), str(tmp_path / "trips"))
    source.writeStream.foreachBatch(update).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = {r.trip_id: r.distance_km for r in live.current_trips(spark, str(tmp_path / "trips")).collect()}
    batch = trips.trips(trips.segmented(trips.with_steps(trips.gps_points(t.withColumnRenamed("event_key", "event_id")))))
    assert got == {r.trip_id: r.distance_km for r in batch.collect()}
