"""Replays of quarantined events: selection, a frozen list of items, batches that can be resumed, and outcomes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.operators import contracts, mapping, repairs
from wayfold.operators.prefix import running

BATCH = 25
DONE, FAILED, PENDING = "DONE", "FAILED", "PENDING"
DAY_US = 86_400_000_000


def select(quarantined: DataFrame, fleet_id: int | None = None, vendor: str | None = None, connection_id: str | None = None, incident_id: str | None = None, event_ids: list[int] | None = None) -> DataFrame:
    """The distinct quarantined events that a replay takes up; what is None doesn't narrow it.

    ``quarantined``: a row a record with event_id, t_us, fleet_id, vendor, connection_id, incident_id and status; resolved
    ones are left out. An empty list of ids doesn't narrow either.
    """
    rows = quarantined.where("status <> 'RESOLVED'")
    for column, value in {"fleet_id": fleet_id, "vendor": vendor, "connection_id": connection_id, "incident_id": incident_id}.items():
        if value is not None:
            rows = rows.where(F.col(column) == value)
    if event_ids:
        rows = rows.where(F.col("event_id").isin(*event_ids))
    return rows.select("event_id", "t_us", "fleet_id", "vendor", "connection_id").distinct()


def frozen(items: DataFrame, batch: int = BATCH, width_us: int = DAY_US) -> DataFrame:
    """(job_id, event_id, t_us, position, batch): each job's items in order of time, numbered from 1 without gaps.

    ``items`` has job_id, event_id and t_us; an event that a job lists twice is one item.
    """
    rows = items.select("job_id", "event_id", "t_us").distinct()
    placed = running(rows, ["job_id"], ["t_us", "event_id"], width_us, name="position")
    return placed.withColumn("batch", F.floor((F.col("position") - 1) / batch).cast("long"))


def by_profile(events: DataFrame, vendor: str, version: str, rules: tuple[mapping.Rule, ...]) -> DataFrame:
    """(event_id, item_status, message) of events run again through the contracts and a forced profile's rules.

    The profile must be of the vendor and of the version that the payload shows.
    """
    found = mapping.normalize(contracts.detect(events), {(vendor, version): rules})
    other = (F.col("vendor") != vendor) | (F.col("version") != version)
    wrong = F.when(F.col("verdict") != "OK", F.col("verdict")).when(other, "SCHEMA_CHANGE:profile mismatch")
    return found.select("event_id", F.when(wrong.isNull(), DONE).otherwise(FAILED).alias("item_status"), wrong.alias("message"))


def by_repair(events: DataFrame, repair: repairs.RepairConfig, conflicts: DataFrame | None = None) -> DataFrame:
    """The same by a published repair; events whose identity is in conflict (``conflicts`` has event_id) stay in quarantine."""
    found = repairs.evaluate(events, repair)
    message = F.when(~F.col("success"), F.array_join("errors", "; "))
    if conflicts is not None:
        found = found.join(conflicts.select("event_id", F.lit(True).alias("in_conflict")).distinct(), "event_id", "left")
        message = F.when(F.col("in_conflict"), "conflicting identity").otherwise(message)
    return found.select("event_id", F.when(message.isNull(), DONE).otherwise(FAILED).alias("item_status"), message.alias("message"))


def outcomes(items: DataFrame) -> DataFrame:
    """(job_id, total, done, failed, percent, outcome) of items with their status, null or PENDING for those not run yet."""
    is_ = lambda s: F.count_if(F.col("item_status") == s)
    rolled = items.groupBy("job_id").agg(F.count("event_id").alias("total"), is_(DONE).alias("done"), is_(FAILED).alias("failed"))
    ran = F.col("done") + F.col("failed")
    percent = F.when(F.col("total") == 0, 100).otherwise(F.floor(100.0 * ran / F.col("total") + 0.5)).cast("int")
    outcome = F.when(ran < F.col("total"), "RUNNING").when(F.col("total") == 0, "NO_EVENTS").when(F.col("failed") == 0, "SUCCESS").when(F.col("done") > 0, "PARTIAL_SUCCESS").otherwise("FAILED")
    return rolled.select("job_id", "total", "done", "failed", percent.alias("percent"), outcome.alias("outcome"))


class Run:
    """A replay kept in a shared folder: its list is written once, and each call runs the next batches of all jobs.

    Results are written a folder a step, named by the first batch it ran; a step that was cut short left no mark of success,
    so the next call runs the same batches again and overwrites it.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _exists(self, path: str) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def start(self, items: DataFrame, batch: int = BATCH) -> DataFrame:
        """The frozen list; a later call finds the first one's, whatever ``items`` has become."""
        path = f"{self.folder}/items"
        if not self._exists(path):
            frozen(items, batch).write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def step(self, process: Callable[[DataFrame], DataFrame], batches: int = 1) -> bool:
        """Runs the next ``batches`` batches of each job; false if there were none left.

        ``process`` gets items (job_id, event_id) and returns (job_id, event_id, item_status, message). Steps of one
        replay all run the same number of batches.
        """
        at = 0
        while self._exists(f"{self.folder}/step={at}"):
            at += 1
        items = self.spark.read.parquet(f"{self.folder}/items").where(F.col("batch").between(at * batches, (at + 1) * batches - 1))
        if items.isEmpty():
            return False
        process(items.select("job_id", "event_id")).select("job_id", "event_id", "item_status", "message").write.mode("overwrite").parquet(f"{self.folder}/step={at}")
        return True

    def items(self) -> DataFrame:
        """All items with their status so far."""
        listed = self.spark.read.parquet(f"{self.folder}/items")
        if not self._exists(f"{self.folder}/step=0"):
            return listed.withColumns({"item_status": F.lit(PENDING), "message": F.lit(None).cast("string")})
        ran = self.spark.read.schema("job_id string, event_id long, item_status string, message string").option("recursiveFileLookup", "true").parquet(f"{self.folder}/step=*")
        return listed.join(ran, ["job_id", "event_id"], "left").withColumn("item_status", F.coalesce("item_status", F.lit(PENDING)))


def job_of(vendor: Column, fleet: Column) -> Column:
    return F.concat(vendor, F.lit("-"), fleet.cast("string"))
