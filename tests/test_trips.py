from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from wayfold.functions.scalars import haversine_km
from wayfold.operators import routes, trips

S = 1_000_000


def points(spark, rows):
    """rows: (seconds, ignition, lat) of one vehicle."""
    full = [(1, 1, i, t * S, 51.0 + lat if lat is not None else 51.0 + i * 0.002, 0.0, 30.0, ign, False, False, None) for i, (t, ign, lat) in enumerate(rows)]
    return spark.createDataFrame(full, "vehicle_id long, fleet_id long, event_id long, t_us long, lat double, lon double, speed_kmh double, ignition string, charging boolean, harsh_brake boolean, fault_code string")


def segments(spark, rows):
    return trips.segmented(trips.with_steps(points(spark, rows)))


def count(df):
    return sorted(r["n"] for r in df.groupBy("segment").agg(F.count("*").alias("n")).collect())


def test_distance_of_one_degree(spark):
    km = spark.range(1).select(haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("km")).first().km
    assert math.isclose(km, 111.19, abs_tol=0.01)


def test_a_degree_in_a_second_is_a_jump_and_so_is_the_way_back(spark):
    flags = [r.jump for r in trips.with_steps(points(spark, [(0, None, 0.0), (1, None, 1.0), (2, None, 0.0)])).orderBy("t_us").collect()]
    assert flags == [False, True, True]


def test_ignition_trip_ends_with_the_first_off_point(spark):
    assert count(segments(spark, [(0, "ON", None), (60, "ON", None), (120, "ON", None), (180, "OFF", None), (240, "OFF", None)])) == [4]
    assert count(segments(spark, [(0, "ON", None), (60, "OFF", None), (120, "ON", None), (180, "OFF", None)])) == [2, 2]


def test_ignition_mode_ignores_gaps(spark):
    assert count(segments(spark, [(0, "ON", None), (5000, "ON", None)])) == [2]


def test_gaps_split_only_beyond_300_seconds(spark):
    assert count(segments(spark, [(0, None, None), (300, None, None)])) == [2]
    assert count(segments(spark, [(0, None, None), (301, None, None)])) == [1, 1]
    assert count(segments(spark, [(0, None, None), (60, None, None), (400, None, None), (460, None, None), (520, None, None)])) == [2, 3]


def test_flagged_points_do_not_count_for_distance(spark):
    s = segments(spark, [(0, None, 0.0), (60, None, 0.002), (61, None, 1.0), (120, None, 0.004)])
    trip = trips.trips(s).first()
    one = trips.trip_distances(s).first()
    assert trip.jumps == 2 and math.isclose(trip.distance_km, round(one.distance_km, 6)) and trip.distance_km < 1


def test_extended_idle_needs_a_later_point_that_closes_it(spark):
    def events(closed):
        rows = [(i * 40, "ON", i * 0.002) for i in range(7)] + ([(300, "ON", 0.02)] if closed else [])
        p = segments(spark, rows).withColumn("speed_kmh", F.when(F.col("event_id").between(1, 6), 0.5).otherwise(30.0))
        return [r.kind for r in trips.trip_events(trips.of_trips(p)).collect()]

    assert events(True).count("EXTENDED_IDLE") == 1
    assert events(False).count("EXTENDED_IDLE") == 0


def test_line_keeps_corners_and_fixed_points():
    lon, lat = np.array([0.0, 1.0, 2.0, 3.0, 4.0]), np.array([0.0, 0.0, 0.0, 1.0, 2.0])
    none = np.zeros(5, bool)
    assert routes.keep_points(lon, lat, none, 1e-3).tolist() == [True, False, True, False, True]
    fixed = none.copy()
    fixed[1] = True
    assert routes.keep_points(lon, lat, fixed, 1e-3).tolist() == [True, True, True, False, True]
    assert routes.keep_points(lon[:0], lat[:0], none[:0]).tolist() == []


def test_geojson_counts_its_features(spark):
    p = spark.createDataFrame([("t", 1, 0.0, 0.0, False, True), ("t", 2, 0.1, 0.1, True, False), ("t", 3, 0.2, 0.2, False, True)], "trip_id string, position int, lon double, lat double, is_marker boolean, is_start boolean")
    row = routes.geojson(p).first()
    assert row.features == 2 and '"LineString"' in row.geojson and '"Point"' in row.geojson
