"""CSV imports, tables kept by key in place of a merge, and results that are written once for several readers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_vehicle_csv(spark: SparkSession, path: str) -> DataFrame:
    """vin and label of an import file: header in any case, blank numbers skipped, numbers in upper case."""
    raw = spark.read.csv(path, header=True)
    raw = raw.toDF(*[c.strip().lower() for c in raw.columns])
    if "vin" not in raw.columns:
        raise ValueError("the file has no column vin")
    label = F.trim("label") if "label" in raw.columns else F.lit(None).cast("string")
    return raw.select(F.upper(F.trim("vin")).alias("vin"), label.alias("label")).where(F.length("vin") > 0)


def latest_by_key(stored: DataFrame, fresh: DataFrame, key: str, order: str) -> DataFrame:
    """What an upsert leaves: the row of the highest order of each key, fresh rows winning a tie."""
    both = stored.withColumn("fresh", F.lit(0)).unionByName(fresh.withColumn("fresh", F.lit(1)), allowMissingColumns=True)
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order), F.desc("fresh")))
    return both.withColumn("n", rank).where("n = 1").drop("n", "fresh")


def insert_new(stored: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Rows of ``fresh`` whose key is not stored yet."""
    return fresh.join(stored.select(key), key, "left_anti")


def stored(df: DataFrame) -> DataFrame:
    """The rows, written now to the folder that all executors share (spark.checkpoint.dir; in local mode a temporary one).

    For what several branches of a plan read: each would otherwise compute it again.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"file://{tempfile.gettempdir()}/wayfold-checkpoints"
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
