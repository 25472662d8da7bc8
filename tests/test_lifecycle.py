"""Repairs by rules, replays, the life of incidents, snapshots and numbering, with the expected rows typed out."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from wayfold.operators import fleet, mapping, prefix, repairs, replay, snapshots, state, trips
from wayfold.operators import incidents as inc
from wayfold.operators import payloads as pl
from wayfold.plans import lifecycle_queries as lq

R = repairs.RepairRule
ALL = repairs.RepairConfig(
    (
        R("vehicle_speed", ("speed", "v.mph"), "MPH_TO_KMH", True), R("odometer", ("m",), "METRES_TO_KM"), R("latitude", ("lat",), "MICRODEGREES_TO_DEGREES"), R("longitude", ("lon",), "SCALE_OFFSET", False, {}, 2.0, 1.0),
        R("ignition_status", ("key",), "ENUM_MAP", False, {"1": "ON", "true": "OFF", "x": "MAYBE"}), R("fault_code", ("fault",)), R("event_time", ("t",), "UNIX_SECONDS", True),
    ),
    ("kind", "7"),
)


def report(spark, body: str, repair: repairs.RepairConfig = ALL):
    return repairs.evaluate(spark.createDataFrame([(body,)], "payload string"), repair).first()


def test_a_repair_that_maps_everything(spark):
    r = report(spark, '{"kind":7,"speed":null,"v":{"mph":" 10 "},"m":1500,"lat":51500000,"lon":0.25,"key":true,"fault":"P1","t":1767225600.5}')
    assert r.success and r.errors == [] and r.warnings == []
    assert (round(r.vehicle_speed, 4), r.odometer, r.latitude, r.longitude, r.ignition_status, r.fault_code, r.event_time) == (16.0934, 1.5, 51.5, 1.5, "OFF", "P1", "2026-01-01T00:00:00.500Z")
    assert [(f.signal, f.source, f.status) for f in r.fields][:2] == [("vehicle_speed", "v.mph", "mapped"), ("odometer", "m", "mapped")]


@pytest.mark.parametrize(
    ("body", "errors"),
    [
        ("[1]", ["payload: not a JSON object"]), ("nonsense", ["payload: not a JSON object"]), ("null", ["payload: not a JSON object"]),
        ('{"kind":7,"t":1}', ["vehicle_speed: required, but missing", "signals: none mapped"]),
        ('{"kind":"8","speed":1,"t":1}', ["discriminator: another value"]), ('{"speed":1,"t":1}', ["discriminator: another value"]),
        ('{"kind":7,"speed":"fast","t":1}', ["vehicle_speed: not a number", "signals: none mapped"]), ('{"kind":7,"speed":true,"m":1,"t":1}', ["vehicle_speed: not a number"]),
        ('{"kind":7,"speed":"1d","m":1,"t":1}', ["vehicle_speed: not a number"]), ('{"kind":7,"speed":-1,"m":1,"t":1}', ["vehicle_speed: below the range"]),
        ('{"kind":7,"speed":1,"lat":95000000,"t":1}', ["latitude: above the range"]), ('{"kind":7,"speed":1,"lat":1,"t":1}', ["position: half of it"]),
        ('{"kind":7,"speed":1,"key":"y","t":1}', ["ignition_status: no meaning for this code"]), ('{"kind":7,"speed":1,"key":"x","t":1}', ["ignition_status: not one of its values"]),
        ('{"kind":7,"speed":1,"fault":5,"t":1}', ["fault_code: not a text"]), ('{"kind":7,"speed":1,"t":0}', ["event_time: invalid Unix time", "event_time: not mapped"]),
        ('{"kind":7,"speed":1,"t":"soon"}', ["event_time: not a number", "event_time: not mapped"]),
    ],
)
def test_what_is_wrong_with_a_payload(spark, body, errors):
    r = report(spark, body)
    assert r.errors == errors and not r.success


@pytest.mark.parametrize(("text", "iso"), [("2026-01-01T01:00:00+01:00", "2026-01-01T00:00:00.000Z"), ("2026-01-01 00:00:00Z", None), ("2026-01-01T00:00:00", None), ("2026-01-01T00:00:00+0100", None), ("2026-13-01T00:00:00Z", None)])
def test_times_need_a_t_and_a_zone(spark, text, iso):
    repair = repairs.RepairConfig((R("vehicle_speed", ("s",)), R("event_time", ("t",), "ISO_TIME", True)))
    assert report(spark, f'{{"s":1,"t":"{text}"}}', repair).event_time == iso


def test_warnings_name_what_is_unknown(spark):
    assert report(spark, '{"kind":7,"speed":1,"t":1,"key":null}').warnings == ["odometer: unavailable", "latitude: unavailable", "longitude: unavailable", "ignition_status: unavailable", "fault_code: unavailable"]


def test_a_repair_from_its_rows(spark):
    rows = spark.createDataFrame(
        [(1, "event_time", ["t"], "UNIX_MILLISECONDS", True, None, None, None, "k", "v"), (0, "altitude", ["a.b"], "SCALE_OFFSET", False, None, 0.5, 1.0, "k", "v")],
        "position int, signal string, sources array<string>, conversion string, required boolean, codes map<string,string>, scale double, offset double, discriminator_path string, discriminator_value string",
    ).collect()
    r = report(spark, '{"k":"v","a":{"b":2},"a.b":4,"t":1000}', repairs.from_rows(rows))
    assert (r.success, r.altitude, r.event_time) == (True, 3.0, "1970-01-01T00:00:01.000Z")
    with pytest.raises(ValueError, match="unknown conversion"):
        report(spark, "{}", repairs.RepairConfig((R("altitude", ("a",), "CUBE"),)))


def raw_events(spark):
    good = '{"speed_mph":10,"charge_fraction":0.5,"timestamp":"2026-01-01T00:00:00Z","altitude":%d}'
    rows = [(i, 100 - i, "A", good % (9500 if i % 4 else 10**5)) for i in range(60)] + [(60, 1, "A", "{}"), (61, 2, "A", good.replace("10", '"x"') % 1)]
    return spark.createDataFrame(rows, "event_id long, t_us long, vendor string, payload string")


def test_a_replay_ends_alike_wherever_it_stops(spark, tmp_path):
    events = raw_events(spark)
    rules = tuple(mapping.Rule(r.path, "odometer" if r.signal == "altitude" else r.signal, r.conversion, r.codes) for r in mapping.RULES["A", "1"])

    def process(items):
        ran = replay.by_profile(events.join(items.select("event_id"), "event_id"), "A", "1", rules)
        return items.join(ran, "event_id")

    items = events.select(F.lit("job").alias("job_id"), "event_id", "t_us")
    whole = replay.Run(spark, str(tmp_path / "whole"))
    whole.start(items)
    assert [r.outcome for r in replay.outcomes(whole.items()).collect()] == ["RUNNING"]
    while whole.step(process, 10):
        pass
    want = sorted(tuple(r) for r in whole.items().select("event_id", "position", "batch", "item_status", "message").collect())
    parts = replay.Run(spark, str(tmp_path / "parts"))
    parts.start(items)
    assert parts.step(process)
    (tmp_path / "parts" / "step=1").mkdir()  # a step that was cut short
    parts = replay.Run(spark, str(tmp_path / "parts"))
    parts.start(items.limit(3))  # the list stays the first one
    seen = []
    while parts.step(process):
        seen.append(replay.outcomes(parts.items()).first())
    assert [(r.done + r.failed, r.percent, r.outcome) for r in seen] == [(50, 81, "RUNNING"), (62, 100, "PARTIAL_SUCCESS")]
    assert sorted(tuple(r) for r in parts.items().select("event_id", "position", "batch", "item_status", "message").collect()) == want
    assert [w[0] for w in sorted(want, key=lambda w: w[1])][:3] == [60, 61, 59] and {w[4] for w in want} == {None, "SCHEMA_CHANGE:", "INVALID_VALUE:speed_mph"}


def test_outcomes_of_replays(spark):
    rows = [("a", 1, "DONE"), ("a", 2, "DONE"), ("b", 1, "DONE"), ("b", 2, "FAILED"), ("c", 1, "FAILED"), ("d", 1, "DONE"), ("d", 2, None), ("e", None, None)]
    got = {r.job_id: (r.percent, r.outcome) for r in replay.outcomes(spark.createDataFrame(rows, "job_id string, event_id long, item_status string")).collect()}
    assert got == {"a": (100, "SUCCESS"), "b": (100, "PARTIAL_SUCCESS"), "c": (100, "FAILED"), "d": (50, "RUNNING"), "e": (100, "NO_EVENTS")}


def test_a_repair_leaves_conflicts_alone(spark):
    events = spark.createDataFrame([(1, '{"s":1,"t":"2026-01-01T00:00:00Z"}'), (2, '{"s":1,"t":"2026-01-01T00:00:00Z"}'), (3, "{}")], "event_id long, payload string")
    repair = repairs.RepairConfig((R("vehicle_speed", ("s",)), R("event_time", ("t",), "ISO_TIME", True)))
    got = {r.event_id: (r.item_status, r.message) for r in replay.by_repair(events, repair, events.where("event_id = 2")).collect()}
    assert got == {1: ("DONE", None), 2: ("FAILED", "conflicting identity"), 3: ("FAILED", "event_time: required, but missing; event_time: not mapped; signals: none mapped")}


def test_selection_narrows_by_what_is_given(spark):
    rows = [(1, 1, 1, "A", "c1", "i1", "UNRESOLVED"), (1, 1, 1, "A", "c1", "i2", "UNRESOLVED"), (2, 1, 1, "B", "c2", "i1", "REPLAY_FAILED"), (3, 1, 2, "A", "c3", "i3", "RESOLVED"), (4, 1, 2, "A", "c3", "i3", "UNRESOLVED")]
    q = spark.createDataFrame(rows, "event_id long, t_us long, fleet_id int, vendor string, connection_id string, incident_id string, status string")
    ids = lambda **k: sorted(r.event_id for r in replay.select(q, **k).collect())
    assert ids() == [1, 2, 4] and ids(incident_id="i1") == [1, 2] and ids(fleet_id=2) == [4] and ids(vendor="A", fleet_id=1) == [1]
    assert ids(connection_id="c2") == [2] and ids(event_ids=[3, 4]) == [4] and ids(event_ids=[]) == [1, 2, 4]


EVENT = "fleet_id int, connection_id string, category string, raw_id long, vehicle_id long, kind string, t_us long, seq long, reason string, expected string, observed string"


def lives(spark, steps, width=10):
    rows = [(1, "c", "SCHEMA_CHANGE", raw, 7, kind, t, i, f"r{t}", "1", "2") for i, (t, kind, raw) in enumerate(steps)]
    lived = inc.numbered(spark.createDataFrame(rows, EVENT), width)
    found = inc.records(lived)
    return inc.incidents(lived, found, F.lit("A")).orderBy("number").collect(), sorted((r.number, r.raw_id, r.record, r.failures, r.reason, r.status) for r in found.collect())


def test_a_failure_after_the_end_starts_a_new_incident(spark):
    steps = [(0, "ACKNOWLEDGE", None), (1, "FAIL", 1), (2, "FAIL", 2), (3, "FAIL", 1), (14, "RESOLVE", 1), (15, "RESOLVE", 9), (16, "ACKNOWLEDGE", None), (27, "RESOLVE", 2), (28, "RESOLVE", 2), (39, "FAIL", 2), (40, "MAPPING_READY", None)]
    got, found = lives(spark, steps)
    assert [(r.number, r.first_us, r.last_us, r.status, r.acknowledged_us, r.open_events) for r in got] == [(1, 1, 2, "RESOLVED", 16, 0), (2, 39, 39, "MAPPING_READY", None, 1)]
    assert found == [(1, 1, 1, 2, "r3", "RESOLVED"), (1, 2, 1, 1, "r2", "RESOLVED"), (2, 2, 2, 1, "r39", "UNRESOLVED")]
    assert got[0].title == "A format changed – expected 1, received 2" and got[0].stale == ["location", "trips", "health", "alerts"] and got[0].description == "r1"
    assert lives(spark, steps, 1) == (got, found) == lives(spark, steps, 10**6)


def test_replays_move_open_records(spark):
    steps = [(1, "FAIL", 1), (2, "FAIL", 2), (3, "REPLAY", None), (4, "REPLAY_FAILED", 1), (5, "FAIL", 3), (6, "RESOLVE", 2)]
    got, found = lives(spark, steps)
    assert [(r.status, r.open_events, r.open_vehicles) for r in got] == [("REPLAY_FAILED", 2, 1)]
    assert [(f[1], f[5]) for f in found] == [(1, "REPLAY_FAILED"), (2, "RESOLVED"), (3, "UNRESOLVED")]
    assert lives(spark, [(1, "RESOLVE", 1), (2, "REPLAY", None)]) == ([], [])


def test_titles_of_incidents(spark):
    rows = [("EXPIRED_AUTH", "A account authorisation has expired"), ("TYPE_ERROR", "Data issue from A: " + "x" * 80), ("SCHEMA_CHANGE", "A event format does not match any known mapping"), ("MISSING_VEHICLE_MAPPING", "Vehicles from A are not registered in this fleet")]
    df = spark.createDataFrame(rows, "category string, want string").withColumn("got", inc.title(F.col("category"), F.lit("A"), F.lit("x" * 90), F.lit(""), F.lit("")))
    assert df.where("got <> want").count() == 0


def test_numbers_have_no_gaps_whatever_the_ranges(spark):
    rows = [(f, (i * 37) % 100, i) for f in (1, 2) for i in range(80)]
    df = spark.createDataFrame(rows, "fleet_id int, t_us long, event_id long")
    want = {(f, e): n for f in (1, 2) for n, (t, e) in enumerate(sorted((t, e) for g, t, e in rows if g == f), 1)}
    for width in (1, 7, 1000):
        got = {(r.fleet_id, r.event_id): r.n for r in prefix.running(df, ["fleet_id"], ["t_us", "event_id"], width, name="n").collect()}
        assert got == want
    changes = df.withColumn("event_type", F.lit("x"))
    assert sorted((r.fleet_id, r.sequence) for r in fleet.catch_up(changes, 10, 5).collect()) == [(f, n) for f in (1, 2) for n in range(11, 16)]


def test_feeds_wait_behind_gaps(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (1, 4), (2, 2), (3, 1)], "fleet_id int, sequence long")
    assert {r.fleet_id: (r.applied, r.held) for r in fleet.contiguous(df).collect()} == {1: (2, 1), 2: (None, 1), 3: (1, 0)}


def test_snapshots_leave_tombstones_once(spark, tmp_path):
    store = snapshots.Store(spark, str(tmp_path / "log"))
    bodies = lambda d: spark.createDataFrame([("v", k, b) for k, b in d.items()], "kind string, entity string, body string")
    for version, d in enumerate([{"a": "1", "b": "1"}, {"a": "1", "b": "2"}, {"a": None, "b": "2"}, {"b": "2"}, {"a": "1", "b": "2", "c": None}], 1):
        store.write(bodies(d), version)
    store.write(bodies({"b": "2"}), 4)  # a version that is written again
    got = sorted((r.version, r.entity, r.revision, r.body) for r in store.log().collect())
    assert got == [(1, "a", 1, "1"), (1, "b", 1, "1"), (2, "b", 2, "2"), (3, "a", 2, None), (5, "a", 3, "1")]
    assert sorted((r.entity, r.revision, r.body) for r in snapshots.latest(store.log()).collect()) == [("a", 3, "1"), ("b", 2, "2")]
    merged = fleet.replica_merge(store.log(2).union(store.since(2)).select("entity", "revision", "body"))
    assert sorted(tuple(r) for r in merged.collect()) == [("a", 3, "1"), ("b", 2, "2")]


def test_an_empty_store_asks_for_everything(spark):
    v, t = spark.createDataFrame([(1,), (2,)], "vehicle_id long"), spark.createDataFrame([("x", 1)], "trip_id string, vehicle_id long")
    empty = spark.createDataFrame([], snapshots.SCHEMA)
    assert sorted(tuple(r) for r in snapshots.bootstrap(v, t, empty).collect()) == [("trip", "x", 1), ("vehicle", "1", 1), ("vehicle", "2", 2)]
    assert snapshots.bootstrap(v, t, spark.createDataFrame([("v", "1", 1, "b", 1)], snapshots.SCHEMA)).count() == 0


def test_backfill_takes_strictly_later_values(spark):
    stored = spark.createDataFrame([(1, "a", "old", 5), (1, "b", "old", 5), (2, "a", "only", 1)], "vehicle_id long, signal string, value string, t_us long")
    events = spark.createDataFrame([(1, 1, 5, {"a": "same", "c": "new"}), (1, 2, 6, {"b": "later", "a": None}), (1, 3, 6, {"b": "last"}), (1, 4, None, {"a": "timeless"}), (1, 0, 1, {"d": "too old"})], "vehicle_id long, event_id long, t_us long, signals map<string,string>")
    got = {(r.vehicle_id, r.signal): (r.value, r.t_us) for r in state.backfill(stored, events, 3).collect()}
    assert got == {(1, "a"): ("old", 5), (1, "b"): ("last", 6), (1, "c"): ("new", 5), (2, "a"): ("only", 1)}


def test_ranges_begin_with_the_trip_that_they_cut(spark):
    late = spark.createDataFrame([(1, 100), (1, 115), (1, 200), (2, 50)], "vehicle_id long, t_us long")
    built = spark.createDataFrame([(1, 85, 95), (1, 150, 190), (3, 0, 500)], "vehicle_id long, started_us long, ended_us long")
    got = sorted(tuple(r) for r in trips.rebuild_ranges(late, built, 10).collect())
    assert got == [(1, 85, 125, 2), (1, 150, 210, 1), (2, 40, 60, 1)]
    met = spark.createDataFrame([(1, 120, 190)], "vehicle_id long, started_us long, ended_us long")
    assert sorted(tuple(r) for r in trips.rebuild_ranges(late.where("vehicle_id = 1"), met, 10).collect()) == [(1, 90, 210, 3)]


def test_dates_include_the_last_day(spark):
    day = 86_400_000_000
    df = spark.createDataFrame([(1, -1), (2, 0), (3, 2 * day - 1_000_000), (4, 2 * day)], "id int, t long")
    assert [r.id for r in trips.in_dates(df, "t", "1970-01-01", "1970-01-02").orderBy("id").collect()] == [2, 3]
    assert trips.in_dates(df, "t").count() == 4


def test_webhook_requests(spark):
    sign = lambda b: "sha256=" + pl.sign(b, "k")
    body = '{"vehicle_id":"v1","event_id":"e"}'
    rows = [(1, "c", {"x-signature": f" {sign(body)} "}, body), (2, "c", {}, body), (3, "none", {"x-signature": sign(body)}, body), (4, "bare", {"x-signature": sign(body)}, body), (5, "c", {"x-signature": sign("{}")}, "{}"), (6, "d", {"x-signature": sign(body)}, body), (7, "c", {"x-signature": "sha256=0"}, body)]
    requests = spark.createDataFrame(rows, "id int, connection_id string, headers map<string,string>, body string")
    connections = spark.createDataFrame([("c", "k"), ("bare", None), ("d", "k")], "connection_id string, secret string")
    mappings = spark.createDataFrame([("c", "v1")], "connection_id string, source_vehicle_id string")
    got = {r.id: r.problem and r.problem[:3] for r in pl.webhook(requests, connections, mappings).collect()}
    assert got == {1: None, 2: "401", 3: "404", 4: "401", 5: "400", 6: "403", 7: "401"}


def test_rule_sets_of_the_queries(spark, sf_dir):
    assert {r.problem for r in lq.repair_rules_valid(spark, sf_dir).collect()} >= {None, "name", "sources", "codes"}
