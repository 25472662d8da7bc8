"""Tables written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, a temporary folder in local mode, as in tests, and else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        return f"file://{tempfile.gettempdir()}/wayfold-checkpoints"
    raise ValueError("spark.checkpoint.dir must name a folder that all executors share")


def saved(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared folder and reads them again, which cuts the lineage there."""
    return Scratch(df.sparkSession).saved(df)


class Scratch:
    """Tables of one operator; those that its result doesn't read are dropped when it is built.

    Used as a context: ``saved`` tables go at its end, ``kept`` ones stay, as the result is read after it.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.gone = spark, shared_folder(spark), []

    def _written(self, df: DataFrame) -> tuple[DataFrame, str]:
        path = f"{self.folder}/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def saved(self, df: DataFrame) -> DataFrame:
        table, path = self._written(df)
        self.gone.append(path)
        return table

    def kept(self, df: DataFrame) -> DataFrame:
        return self._written(df)[0]

    def drop(self) -> None:
        """Removes the tables saved so far."""
        context = self.spark.sparkContext
        for path in self.gone:
            at = context._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
        self.gone = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self.drop()
