"""Simplified routes and their geometry as JSON."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

EPSILON = 5e-5


def keep_points(lon: np.ndarray, lat: np.ndarray, fixed: np.ndarray, epsilon: float = EPSILON) -> np.ndarray:
    """Which points a line keeps: its ends, fixed ones, and those farther than epsilon from the line between kept ones.

    Distances are planar, in degrees, to the infinite line through the two ends.
    """
    keep = fixed.copy()
    if len(keep):
        keep[[0, -1]] = True
    stack = list(zip(np.flatnonzero(keep)[:-1].tolist(), np.flatnonzero(keep)[1:].tolist(), strict=True))
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        x, y = lon[a + 1 : b] - lon[a], lat[a + 1 : b] - lat[a]
        dx, dy = lon[b] - lon[a], lat[b] - lat[a]
        length = np.hypot(dx, dy)
        off = np.abs(dx * y - dy * x) / length if length > 0 else np.hypot(x, y)
        far = int(off.argmax())
        if off[far] > epsilon:
            middle = a + 1 + far
            keep[middle] = True
            stack += [(a, middle), (middle, b)]
    return keep


def simplified(route_points: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """Route points that stay, a row each; lines are split at markers and at starts of segments.

    A trip's points go to Python as one array of coordinates, which is as long as the trip.
    """

    @F.pandas_udf("array<int>")
    def kept(lines: pd.Series) -> pd.Series:
        out = []
        for points in lines:
            lon, lat, fixed = (np.array([p[c] for p in points]) for c in ("lon", "lat", "fixed"))
            fixed = fixed.astype(bool)
            starts = np.flatnonzero([p["is_start"] for p in points])
            ends = starts[starts > 0] - 1  # the last point of a segment stays too
            fixed[ends] = True
            out.append(np.flatnonzero(keep_points(lon, lat, fixed, epsilon)).tolist())
        return pd.Series(out)

    point = F.struct("position", "lon", "lat", (F.col("is_marker") | F.col("is_start")).alias("fixed"), "is_start", "is_marker", "event_id")
    lines = route_points.groupBy("trip_id").agg(F.array_sort(F.collect_list(point)).alias("points")).repartition("trip_id")
    chosen = lines.select("trip_id", "points", F.explode(kept("points")).alias("i"))
    p = F.col("points")[F.col("i")]
    return chosen.select("trip_id", p["event_id"].alias("event_id"), p["position"].alias("position"), p["lon"].alias("lon"), p["lat"].alias("lat"), p["is_marker"].alias("is_marker"), p["is_start"].alias("is_start"))


def geojson(points: DataFrame) -> DataFrame:
    """A FeatureCollection of each trip: a LineString for each segment of two points or more, a Point for each marker."""
    from_start = F.sum(F.col("is_start").cast("int")).over(_line_window())
    xy = F.array("lon", "lat")
    numbered = points.withColumn("line", from_start)
    lines = numbered.groupBy("trip_id", "line").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", xy.alias("xy")))), lambda p: p["xy"]).alias("c")).where(F.size("c") > 1)
    line = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("LineString").alias("type"), F.col("c").alias("coordinates")).alias("geometry"))
    marker = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), xy.alias("coordinates")).alias("geometry"))
    a = lines.groupBy("trip_id").agg(F.array_sort(F.collect_list(F.struct("line", F.to_json(line).alias("f")))).alias("lines"))
    b = points.where("is_marker").groupBy("trip_id").agg(F.array_sort(F.collect_list(F.struct("position", F.to_json(marker).alias("f")))).alias("markers"))
    texts = F.concat(F.transform(F.coalesce("lines", F.array()), lambda x: x["f"]), F.transform(F.coalesce("markers", F.array()), lambda x: x["f"]))
    whole = F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(texts, ","), F.lit("]}"))
    return a.join(b, "trip_id", "full").select("trip_id", F.size(texts).alias("features"), whole.alias("geojson"))


def _line_window() -> WindowSpec:
    return Window.partitionBy("trip_id").orderBy("position")


def valid_place(lat: Column, lon: Column) -> Column:
    return lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon) & lat.between(-90, 90) & lon.between(-180, 180)


def sanitized(points: DataFrame, by: str, order: str) -> DataFrame:
    """Valid points with the number of their line; an invalid point splits a line."""
    fine = valid_place(F.col("lat"), F.col("lon"))
    return points.withColumn("line", F.sum((~fine).cast("int")).over(Window.partitionBy(by).orderBy(order))).where(fine)
