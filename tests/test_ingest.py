from __future__ import annotations

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from wayfold.operators import contracts, fleet, ingest, mapping, payloads
from wayfold.plans import fleet_queries
from wayfold.sources import files


def frame(rows):
    return pd.DataFrame([(i, "c", s, h) for i, (s, h) in enumerate(rows)], columns=["event_key", "connection_id", "source_event_id", "payload_hash"])


def test_fold_counts_only_what_was_stored():
    assert ingest.fold_one(frame([("1", "a"), ("2", "a"), ("2", "b")]))["verdict"].tolist() == ["NEW", "DUPLICATE", "NEW"]


def test_fold_conflict_is_stored():
    assert ingest.fold_one(frame([("1", "a"), ("1", "b"), ("1", "b"), (None, "b"), (None, "z")]))["verdict"].tolist() == ["NEW", "CONFLICT", "DUPLICATE", "DUPLICATE", "NEW"]


def test_windows_agree_with_the_fold_where_each_hash_has_one_id(spark):
    r = random.Random(3)
    rows = [(i, f"c{r.randint(0, 3)}", str(r.randint(0, 30))) for i in range(400)]
    df = spark.createDataFrame([(i, c, s, f"{c}{s}{r.randint(0, 2)}") for i, c, s in rows], "event_key long, connection_id string, source_event_id string, payload_hash string")
    a, b = ({x.event_key: (x.verdict, x.owner) for x in f(df).collect()} for f in (ingest.deduplicate, ingest.fold))
    assert a == b


def test_deduplicate_is_exact_for_shared_hashes(spark):
    df = spark.createDataFrame(frame([("1", "a"), ("2", "a"), ("2", "b")]))
    assert [x.verdict for x in ingest.deduplicate(df).orderBy("event_key").collect()] == ["NEW", "DUPLICATE", "NEW"]


def test_deduplicate_equals_the_fold_on_random_events(spark):
    for seed in range(4):
        r = random.Random(seed)
        rows = [(i, f"c{r.randint(0, 2)}", r.choice([None, *"abcdef"]), r.choice("uvwxyz")) for i in range(300)]
        df = spark.createDataFrame(rows, "event_key long, connection_id string, source_event_id string, payload_hash string")
        a, b = ({x.event_key: (x.verdict, x.owner) for x in f(df).collect()} for f in (ingest.deduplicate, ingest.fold))
        assert a == b
    assert ingest.deduplicate(df.limit(0)).count() == 0


def test_a_source_that_begins_anew(spark):
    rows = [(1, None, 0, None, 5), (2, "9", 0, None, 5), (3, "9", 0, None, 9), (4, "x", 0, None, 5), (5, "9", 2, 12, 5), (6, "9", 0, None, None), (7, "", 0, None, 1)]
    df = spark.createDataFrame(rows, "id int, cursor string, events int, last_sequence long, latest_sequence long")
    got = {r.id: (r.action, r.next_cursor) for r in ingest.rewound(df).collect()}
    assert got == {1: ("WAIT", None), 2: ("REWIND", "5"), 3: ("WAIT", "9"), 4: ("REWIND", "5"), 5: ("ADVANCE", "12"), 6: ("WAIT", "9"), 7: ("WAIT", "")}


def test_contract_verdicts(spark):
    cases = [
        ("A", '{"speed_mph":10,"charge_fraction":0.5,"timestamp":"2026-01-01T00:00:00Z"}', "1", "OK"),
        ("A", '{"speed_mph":"x","charge_fraction":0.5,"timestamp":"2026-01-01T00:00:00Z"}', "1", "INVALID_VALUE:speed_mph"),
        ("A", '{"speed_mph":10,"charge_fraction":0.5,"timestamp":"soon"}', "1", "INVALID_TIME:timestamp"),
        ("A", '{"charge_fraction":0.5}', None, "SCHEMA_CHANGE:"),
        ("A", "not json", None, "SCHEMA_CHANGE:payload"),
        ("A", "[1]", None, "SCHEMA_CHANGE:"),
        ("Z", "{}", None, "UNKNOWN_FORMAT:"),
        ("A", '{"speed_mph":10,"charge_fraction":0.5,"timestamp":1767225600000}', "1", "TYPE_ERROR:timestamp"),
        ("A", '{"data.speed_mph":10,"data":{"speed_mph":"x","charge_fraction":0.5,"lat":1,"lon":1},"metadata":{"timestamp":"2026-01-01T00:00:00Z"}}', "2", "OK"),
        ("A", '{"data.speed_mph":null,"data":{"speed_mph":1,"charge_fraction":0.5,"lat":1,"lon":1},"metadata":{"timestamp":"2026-01-01T00:00:00Z"}}', None, "SCHEMA_CHANGE:"),
        ("B", '{"velocity_kmh":1,"battery_pct":5,"gps_lat":5,"gps_lon":1,"time_measured":5}', "1", "OK"),
        ("B", '{"state":{"velocity_kmh":null,"battery_pct":5,"gps_lat":5,"gps_lon":1},"velocity_kmh":2,"time_measured":0}', "1", "INVALID_TIME:time_measured"),
        ("C", '{"vehicle_id":"7","timestamp":"2026-01-01T00:00:00Z","speed":10,"soc":50,"odometer":-1}', "1", "INVALID_VALUE:odometer"),
        ("B", '{"state":{"velocity_kmh":1,"battery_pct":5,"gps_lat":95,"gps_lon":1},"time_measured":5}', "1", "INVALID_COORDINATES:state.gps_lat"),
    ]
    rows = contracts.detect(spark.createDataFrame([(i, v, p) for i, (v, p, _, _) in enumerate(cases)], "i int, vendor string, payload string")).orderBy("i").collect()
    assert [(r.version, r.verdict) for r in rows] == [c[2:] for c in cases]


def test_normalized_signals(spark):
    df = contracts.detect(spark.createDataFrame([("C", '{"vehicle_id":"7","timestamp":"2026-01-01T00:00:00Z","speed":10,"soc":50,"status":"PARKED"}')], "vendor string, payload string"))
    r = mapping.normalize(df).first()
    assert (r.vehicle_speed, r.battery_soc, r.ignition_status, r.latitude) == (10.0, 50.0, "OFF", None)


def test_all_rules_of_a_payload(spark):
    body = '{"speed_mph":100,"charge_fraction":0.5,"odo_miles":10,"status":"stopped","lat":1,"lon":2,"altitude":5,"heading":9,"harsh_brake":true,"fault_code":"P1","timestamp":"2026-01-01T00:00:00Z"}'
    loose = '{"velocity_kmh":1,"battery_pct":5,"gps_lat":5,"gps_lon":1,"gps_heading":400,"charging":false,"time_measured":5}'
    rows = [("A", body), ("A", body.replace('"altitude":5', '"altitude":9001')), ("A", body.replace("stopped", "towed")), ("B", loose), ("B", loose.replace("400", "40"))]
    got = mapping.normalize(contracts.detect(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, vendor string, payload string"))).orderBy("i").collect()
    assert [r.verdict for r in got] == ["OK", "INVALID_VALUE:altitude", "OK", "INVALID_VALUE:heading", "OK"]
    a, b = got[0], got[4]
    assert (round(a.vehicle_speed, 3), a.battery_soc, round(a.odometer, 4), a.ignition_status, a.altitude, a.heading, a.harsh_brake, a.fault_code, a.event_time) == (160.934, 50.0, 16.0934, "OFF", 5.0, 9.0, "YES", "P1", "2026-01-01T00:00:00Z")
    assert (b.vehicle_speed, b.heading, b.charging_state, b.event_time) == (1.0, 40.0, "NOT_CHARGING", None)
    assert got[2].ignition_status == "towed" and sum(len(r) for r in mapping.RULES.values()) == 36


def test_failure_categories(spark):
    rows = spark.createDataFrame([("Latitude out of bounds",), ("bad timestamp",), ("whatever",)], "reason string").select(fleet.categorize(F.col("reason")).alias("c")).collect()
    assert [r.c for r in rows] == ["INVALID_COORDINATES", "INVALID_TIME", "SCHEMA_CHANGE"]


def test_signature_and_redaction(spark):
    body = '{"a":[{"api_key":{"x":1}}],"b":2}'
    df = spark.createDataFrame([(body, "sha256=" + payloads.sign(body, "k")), (body, "no"), (None, None)], "body string, signature string")
    rows = df.select(payloads.signature_valid(F.col("body"), F.col("signature"), F.lit("k")).alias("v"), payloads.redact("body").alias("r")).collect()
    assert [r.v for r in rows] == [True, False, False]
    assert rows[0].r == '{"a":[{"api_key":{"x":"[REDACTED]"}}],"b":2}' and rows[2].r is None


def test_csv_import(spark, tmp_path):
    (tmp_path / "f.csv").write_text(" VIN ,Label\nwvwzz,one\n,two\n")
    assert [tuple(r) for r in files.read_vehicle_csv(spark, str(tmp_path / "f.csv")).collect()] == [("WVWZZ", "one")]


def test_latest_by_key(spark):
    a = spark.createDataFrame([(1, 1, "old"), (2, 5, "stays")], "k int, rev int, v string")
    b = spark.createDataFrame([(1, 1, "new"), (2, 4, "late")], "k int, rev int, v string")
    assert sorted(tuple(r) for r in files.latest_by_key(a, b, "k", "rev").collect()) == [(1, 1, "new"), (2, 5, "stays")]
    assert [tuple(r) for r in files.insert_new(a, spark.createDataFrame([(2, 1, "x"), (3, 1, "y")], "k int, rev int, v string"), "k").collect()] == [(3, 1, "y")]


def test_failures_by_their_signs(spark):
    df = spark.createDataFrame([(r, c) for r, c in fleet_queries.REASONS] + [(None, "SCHEMA_CHANGE"), ("", "SCHEMA_CHANGE")], "reason string, want string")
    assert df.withColumn("got", fleet.categorize(F.col("reason"))).where("got != want").count() == 0


def test_makers_of_vehicle_numbers(spark):
    rows = spark.createDataFrame([(1, " 3nv00000000000000 "), (2, "3N200000000000000"), (3, "1V"), (4, None), (5, "ZZZ")], "row int, vin string")
    got = {r.row: (r.maker, r.maker_id, r.confidence) for r in fleet_queries.vin_decoded(spark, rows).collect()}
    assert got == {1: ("Maker C", "C", "HIGH"), 2: ("Maker C (uncertain)", "C", "LOW"), 3: ("Maker A (uncertain)", "A", "LOW"), 4: (None, None, "NONE"), 5: (None, None, "NONE")}


def test_records_leave_out_what_is_tried_again(spark):
    rows = [(1, 1, 1, "c", 0, "INFRA_ERROR:timeout", "UNRESOLVED", 0, None), (2, 1, 1, "c", 0, "TYPE_ERROR:soc", "UNRESOLVED", 0, 1)]
    df = spark.createDataFrame(rows, "event_id long, vehicle_id long, fleet_id long, connection_id string, t_us long, verdict string, status string, attempt int, known_vehicle long")
    assert [(r.event_id, r.category, r.reason) for r in fleet.quarantine_records(df).collect()] == [(2, "TYPE_ERROR", "soc")]


def test_unknown_conversions_are_refused():
    with pytest.raises(ValueError, match="unknown conversion"):
        mapping.convert(F.lit(1.0), "FURLONGS")
