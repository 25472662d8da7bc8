"""What keeps the queries over events in bounds on large tables."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import functions as F

from wayfold.operators import contracts, ingest, repairs
from wayfold.plans import fleet_queries, lifecycle_queries, mapping_queries


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_payloads_are_made_in_more_tasks_than_the_file_has_row_groups(spark, sf_dir):
    assert "RepartitionByExpression [event_id" in plan(mapping_queries.payloads(spark, sf_dir))


def test_texts_are_not_tried_as_numbers(spark):
    rows = spark.createDataFrame([('{"a":"12","b":3}',)], "payload string").withColumn("parsed", F.try_parse_json("payload"))
    read = contracts.read_out(rows, {"a": F.lit(True), "b": F.lit(True)})
    assert read.select("kind_0", "number_0", "text_0", "kind_1", "number_1").first() == ("string", None, "12", "number", 3.0)
    assert "number_0" not in contracts.read_out(rows, {"a": F.lit(True)}, numbers=[]).columns


def test_replays_read_their_list_and_do_not_select_again(spark, sf_dir):
    for df in lifecycle_queries._replayed(spark, sf_dir):
        assert "get_json_object" not in plan(df)


def test_fold_by_parts_equals_the_fold_of_whole_connections(spark):
    rng = random.Random(7)
    rows = [(i, f"c{rng.randrange(2)}", rng.choice([None, "a", "b", "c", "d"]), f"h{rng.randrange(12)}") for i in range(400)]
    df = spark.createDataFrame(rows, "event_key long, connection_id string, source_event_id string, payload_hash string")
    whole = pd.DataFrame(rows, columns=["event_key", "connection_id", "source_event_id", "payload_hash"])
    want = {x.event_key: (x.verdict, x.owner) for _, g in whole.groupby("connection_id") for x in ingest.fold_one(g).itertuples()}
    assert {x.event_key: (x.verdict, x.owner) for x in ingest.fold(df, 20).collect()} == want


def test_a_large_connection_is_folded_in_parts(spark):
    df = spark.range(2000).selectExpr("id AS event_key", "'c' AS connection_id", "if(id % 2 = 0, string(id), null) AS source_event_id", "string(id) AS payload_hash")
    assert ingest.parted(df, 100).groupBy("part").count().agg(F.max("count")).first()[0] < 200


def test_long_expressions_are_compiled_apart_in_small_methods(spark):
    """A stage that makes them all in one method of over 8,000 bytes is interpreted by the JVM."""
    rows = spark.createDataFrame([(1, "A", '{"speed_mph":1}')], "event_id long, vendor string, payload string")
    stages = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenStringSeq(contracts.detect(rows)._jdf.queryExecution().executedPlan())
    assert max(stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())) < 8000


def test_a_row_is_read_at_the_places_of_its_own_contract_alone(spark):
    """Not at the paths of all vendors' contracts: the types looked up are as many as the longest contract has fields."""
    rows = spark.createDataFrame([(1, "A", '{"speed_mph":1}')], "event_id long, vendor string, payload string")
    longest = max(len(c.fields) for c in contracts.CONTRACTS)
    assert 0 < plan(contracts.detect(rows)).count("schemaOfVariant") <= longest


def test_quarantine_parses_a_payload_once_and_makes_no_signals(spark, sf_dir):
    told = plan(fleet_queries.records(spark, sf_dir))
    assert told.count("parseJson") == 1
    assert "MPH_TO_KMH" not in told and "NOT_CHARGING" not in told


def test_a_repair_looks_up_one_type_a_rule_and_makes_no_unused_fields(spark, sf_dir):
    repair = lifecycle_queries.REPAIRS["A"]
    p = mapping_queries.payloads(spark, sf_dir)
    told = plan(repairs.evaluate(p, repair).select("event_id", "errors"))
    assert told.count("schemaOfVariant") <= len(repair.rules) + 1
    assert "struct(signal" not in told


def test_repairs_of_odd_values(spark):
    """Numbers as texts, Unix times, null and missing sources, and times at the ends of what four digits tell."""
    rule = repairs.RepairRule
    config = repairs.RepairConfig((rule("vehicle_speed", ("a", "b")), rule("event_time", ("t",), "ISO_TIME", True), rule("fault_code", ("f",))), ("kind", "x"))
    cases = [
        ('{"kind":"x","a":null,"b":" 7 ","t":"2026-01-01T00:00:00Z"}', 7.0, "2026-01-01T00:00:00.000Z", ""),
        ('{"kind":"x","a":1e400,"b":3,"t":"2026-01-01T00:00:00Z"}', None, "2026-01-01T00:00:00.000Z", "vehicle_speed: not a number; signals: none mapped"),
        ('{"kind":"y","a":5,"t":"9999-12-31T23:59:59-01:00","f":4}', 5.0, None, "discriminator: another value; event_time: no time with a zone; fault_code: not a text; event_time: not mapped"),
        ('{"a":true,"t":7}', None, None, "discriminator: another value; vehicle_speed: not a number; event_time: no time with a zone; event_time: not mapped; signals: none mapped"),
        ("[1]", None, None, "payload: not a JSON object"),
    ]
    rows = repairs.evaluate(spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, payload string"), config)
    got = rows.orderBy("i").select("vehicle_speed", "event_time", F.array_join("errors", "; ")).collect()
    assert [tuple(r) for r in got] == [c[1:] for c in cases]
