"""Materialized views kept by revision: what changed since the last version, tombstones, and the replica that follows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["kind", "entity"]


def changed(last: DataFrame, bodies: DataFrame) -> DataFrame:
    """(kind, entity, revision, body) of the entities whose body is new, another one, or gone, with the next revision.

    ``last``: the highest revision of each entity; ``bodies``: (kind, entity, body), of each entity once. A body that is null
    or an entity that is no longer there leaves a tombstone, a null body, once; one that comes back goes on with its revision.
    Bodies are compared by their hash, so the old ones need not be read where ``last`` has body_hash.
    """
    digest = F.sha2(F.col("body"), 256)
    old = last.select(*KEY, F.col("revision").alias("last_revision"), (F.col("body_hash") if "body_hash" in last.columns else digest).alias("last_hash"))
    joined = old.join(bodies.select(*KEY, "body"), KEY, "full_outer").where(~digest.eqNullSafe(F.col("last_hash")))
    known = F.col("last_revision").isNotNull() | F.col("body").isNotNull()
    return joined.where(known).select(*KEY, (F.coalesce("last_revision", F.lit(0)) + 1).cast("long").alias("revision"), "body")


def latest(log: DataFrame) -> DataFrame:
    """The highest revision of each entity in a log of versions; tombstones stay."""
    return log.groupBy(*KEY).agg(F.max_by(F.struct("revision", "body"), "revision").alias("v")).select(*KEY, "v.revision", "v.body")


SCHEMA = "kind string, entity string, revision long, body string, version int"


class Store:
    """A log of snapshots in a folder, a part a version. Writing a version again replaces it, so a repeated step is safe."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def log(self, upto: int | None = None) -> DataFrame:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], SCHEMA)
        log = self.spark.read.schema(SCHEMA).parquet(self.folder)
        return log if upto is None else log.where(F.col("version") <= upto)

    def write(self, bodies: DataFrame, version: int) -> None:
        """Adds what has changed since the versions before."""
        changed(latest(self.log(version - 1)), bodies).write.mode("overwrite").parquet(f"{self.folder}/version={version}")

    def since(self, version: int) -> DataFrame:
        """What a replica that has this version still lacks; versions are folders, so older ones are not read."""
        return self.log().where(F.col("version") > version)


def bootstrap(vehicles: DataFrame, trips: DataFrame, store: DataFrame) -> DataFrame:
    """The refreshes (kind, entity_id, vehicle_id) that an empty store asks for: every vehicle and every trip; none otherwise."""
    empty = store.agg((F.count("*") == 0).alias("empty")).scalar()
    all_ = vehicles.select(F.lit("vehicle").alias("kind"), F.col("vehicle_id").cast("string").alias("entity_id"), "vehicle_id")
    return all_.union(trips.select(F.lit("trip"), F.col("trip_id").cast("string"), "vehicle_id")).where(empty)
