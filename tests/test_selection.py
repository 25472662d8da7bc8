from __future__ import annotations

from pyspark.sql import functions as F

from wayfold.operators import selection as sl


def test_a_connection_of_another_fleet_is_not_found(spark):
    asked = spark.createDataFrame([(1, "a", 1), (2, "a", 2), (3, None, 1), (4, "b", None)], "id int, connection_id string, fleet_id int")
    known = spark.createDataFrame([("a", 1), ("a", 1), (None, 1)], "connection_id string, fleet_id int")
    got = {r.id: r.tenant for r in sl.tenant_check(asked, known).collect()}
    assert got == {1: "ACCEPTED", 2: sl.NOT_FOUND, 3: sl.NOT_FOUND, 4: sl.NOT_FOUND}


def test_a_forced_profile_must_fit_but_may_be_retired(spark):
    rows = [(1, "A", "1", None), (2, "A", "1", "old"), (3, "B", "1", "old"), (4, "A", "1", "none"), (5, "A", None, None), (6, "B", "1", None), (7, None, None, "old")]
    profiles = [sl.Profile("now", "A", "1"), sl.Profile("old", "A", "1", "RETIRED")]
    df = spark.createDataFrame(rows, "id int, vendor string, version string, forced_id string")
    got = {r.id: (r.profile_id, r.problem) for r in sl.resolve_profile(df, [("A", "1"), ("B", "1")], profiles).collect()}
    mismatch = (None, "SCHEMA_CHANGE:profile mismatch")
    assert got == {
        1: ("now", None), 2: ("old", None), 3: mismatch, 4: (None, "UNKNOWN_FORMAT:profile not found"),
        5: (None, "UNKNOWN_FORMAT:version"), 6: (None, "SCHEMA_CHANGE:no active profile"), 7: mismatch,
    }
    assert {r.problem for r in sl.resolve_profile(df.where("id = 1"), [], []).collect()} == {"UNKNOWN_FORMAT:version"}


def test_the_newest_repair_that_applies(spark):
    repairs = [sl.Repair("new", "c", 3, "replay_only", ()), sl.Repair("mid", "c", 2, "invalid_only", (("x",),)), sl.Repair("kind", "c", 1, "matching", (("x", "y.z"),), ("k", "7"))]
    rows = [(1, '{"x":1}', False), (2, '{"x":1}', True), (3, '{"x":null}', False), (4, '{"k":7,"y":{"z":0}}', True), (5, '{"k":8,"x":0}', True), (6, "no json", False), (7, None, None)]
    df = spark.createDataFrame(rows, "id int, payload string, own_valid boolean").withColumn("connection_id", F.lit("c"))
    got = {r.id: r.repair_id for r in sl.live_repair(df, repairs).collect()}
    assert got == {1: "mid", 2: None, 3: "mid", 4: "kind", 5: None, 6: None, 7: None}
    assert {r.repair_id for r in sl.live_repair(df.withColumn("connection_id", F.lit("d")), repairs).collect()} == {None}


def test_publishing_takes_a_tested_draft(spark):
    drafts = spark.createDataFrame([(i, s, 2, t, a) for i, s, t, a in [(1, "DRAFT", 2, 2), (2, "ACTIVE", 2, 2), (3, "DRAFT", 1, 2), (4, "DRAFT", 2, 1), (5, "DRAFT", 2, 2), (6, "DRAFT", 2, 2), (7, "DRAFT", None, 2)]], "draft_id int, status string, revision int, tested_revision int, asked_revision int")
    results = spark.createDataFrame([(1, False, True), (1, False, False), (1, True, True), (5, False, True), (5, True, False)], "draft_id int, regression boolean, success boolean")
    got = {r.draft_id: r.verdict for r in sl.publish_gate(drafts, results).collect()}
    assert got == {1: "PUBLISHED", 2: "CONFLICT", 3: "UNTESTED", 4: "CONFLICT", 5: "TESTS_FAILED", 6: "TESTS_FAILED", 7: "UNTESTED"}


def test_changes_coalesce_and_wait_for_quiet(spark):
    changes = spark.createDataFrame([("trip", 5, 1, 10), ("trip", 5, 1, 30), ("vehicle", 1, 1, 20), ("vehicle", 2, 2, 95), ("vehicle", 2, 2, 1), ("trip", 9, None, 4)], "kind string, entity_id long, vehicle_id long, changed_us long")
    queue = sl.refresh_queue(changes)
    got = {(r.kind, r.entity_id): (r.generation, r.first_us, r.last_us, r.due) for r in sl.refresh_due(queue, F.lit(100), 60, 99).collect()}
    assert got == {("trip", "5"): (2, 10, 30, True), ("vehicle", "1"): (3, 10, 30, True), ("vehicle", "2"): (2, 1, 95, True)}
    assert sl.refresh_due(queue, F.lit(100), 60, 200).where("NOT due").count() == 1
    assert sl.refresh_queue(changes.limit(0)).count() == 0
    first = sl.refresh_queue(changes.where("changed_us = 95"))
    assert [(r.generation, r.due) for r in sl.refresh_due(first, F.lit(95), 60, 200).collect()] == [(1, True)]


def test_a_quarantined_reading_refreshes_the_trips_of_its_vehicle(spark):
    changes = spark.createDataFrame([("quarantine", 1, 1, 10), ("quarantine", 1, 1, 12), ("trip", 5, 1, 11), ("quarantine", 2, None, 1)], "kind string, entity_id long, vehicle_id long, changed_us long")
    trips = spark.createDataFrame([(5, 1), (6, 1), (7, 2)], "trip_id long, vehicle_id long")
    got = {(r.kind, r.entity_id): (r.generation, r.first_us, r.last_us) for r in sl.refresh_queue(changes, trips).collect()}
    assert got == {("vehicle", "1"): (3, 10, 12), ("trip", "5"): (3, 10, 12), ("trip", "6"): (2, 10, 12)}


def test_a_pass_keeps_room_for_both_kinds(spark):
    rows = [("vehicle", str(i), 1, i, i, 0, None) for i in range(5)] + [("trip", "a", 1, 0, 0, 2, None), ("trip", "b", 2, 1, 99, 0, None), ("trip", "c", 1, 2, 2, 0, 101)]
    queue = spark.createDataFrame(rows, "kind string, entity_id string, generation long, first_us long, last_us long, attempts int, retry_us long")
    pick = lambda n: [r.entity_id for r in sl.refresh_pick(queue, F.lit(100), n, 10, 200).collect()]
    assert pick(4) == ["0", "1", "a"] and pick(5) == ["0", "1", "a"] and pick(1) == ["0"]  # b is not quiet yet, c waits for its retry
    results = spark.createDataFrame([("vehicle", "0", 1, False), ("vehicle", "1", 0, False), ("trip", "a", 1, True)], "kind string, entity_id string, generation long, failed boolean")
    left = {(r.kind, r.entity_id): (r.attempts, r.retry_us) for r in sl.refresh_acknowledge(queue, results, F.lit(100)).collect()}
    assert ("vehicle", "0") not in left and left["vehicle", "1"] == (0, None) and left["trip", "a"] == (3, 100 + 8_000_000)
