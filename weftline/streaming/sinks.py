"""Sinks of streams that count every micro-batch once, and upkeep of tables with an expiry.

A SnapshotTable is a folder of whole snapshots and a ledger with a small file per committed batch id. A batch writes its snapshot
first and commits by renaming its ledger file into place, which is one atomic step; readers take the snapshot of the last
committed batch. A batch that comes again after its commit changes nothing, one that died before it is written anew.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import oplog
from weftline.sources import tables


class SnapshotTable:
    """A table that batches update; update(old, batch) gives its next rows, old being None before the first."""

    def __init__(self, spark: SparkSession, path: str, update: Callable[[DataFrame | None, DataFrame], DataFrame], keep: int = 2):
        self.spark, self.path, self.update, self.keep = spark, path.rstrip("/"), update, keep

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _path(self, path: str):
        return self._fs(path)[1]

    def committed(self) -> list[int]:
        """The ids of committed batches that are still in the ledger, in order."""
        fs, ledger = self._fs(f"{self.path}/ledger")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(ledger) if s.getPath().getName().isdigit()) if fs.exists(ledger) else []

    def read(self) -> DataFrame | None:
        """The rows after the last committed batch, or None before the first."""
        done = self.committed()
        return self.spark.read.parquet(f"{self.path}/snapshot-{done[-1]}") if done else None

    def prepare(self, batch: DataFrame, batch_id: int) -> None:
        """Writes the snapshot after a batch, which counts only once it is committed."""
        self.update(self.read(), batch).write.mode("overwrite").parquet(f"{self.path}/snapshot-{batch_id}")

    def commit(self, batch_id: int) -> None:
        fs, ledger = self._fs(f"{self.path}/ledger")
        fs.mkdirs(ledger)
        draft = self._path(f"{self.path}/ledger/_{batch_id}")
        fs.create(draft, True).close()
        fs.rename(draft, self._path(f"{self.path}/ledger/{batch_id}"))
        for old in self.committed()[: -self.keep]:  # the ledger's last ids tell all before them as well
            fs.delete(self._path(f"{self.path}/ledger/{old}"), False)
            fs.delete(self._path(f"{self.path}/snapshot-{old}"), True)

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """For foreachBatch: counts a batch once, however often it comes."""
        done = self.committed()
        if done and batch_id <= done[-1]:
            return
        self.prepare(batch, batch_id)
        self.commit(batch_id)


def site_memory_sink(spark: SparkSession, path: str, keys: list[str], least: float = 0.3) -> SnapshotTable:
    """Site memory that grows batch by batch: keys with avg_score, query_count, success_count, last_score, is_valid."""

    def update(old: DataFrame | None, batch: DataFrame) -> DataFrame:
        return oplog.site_memory(batch, keys, least) if old is None else oplog.site_memory_update(old, batch, keys, least)

    return SnapshotTable(spark, path, update)


def upsert_sink(spark: SparkSession, path: str, keys: list[str], order: list[str]) -> SnapshotTable:
    """The newest row of each key by the columns order, batch by batch; among rows alike the table's own stays."""

    def update(old: DataFrame | None, batch: DataFrame) -> DataFrame:
        columns = [c for c in batch.columns if c not in keys]
        newest = batch.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("r")).select(*keys, "r.*")
        if old is None:
            return newest
        later = F.struct(*[F.col(f"new_{c}") for c in order]) > F.struct(*[F.col(f"old_{c}") for c in order])
        return tables.upsert(old, newest, keys, {c: F.when(later, F.col(f"new_{c}")).otherwise(F.col(f"old_{c}")) for c in columns})

    return SnapshotTable(spark, path, update)


def run_into(stream: DataFrame, table: SnapshotTable, checkpoint: str) -> DataFrame:
    """Runs a stream over all that is there now into a table, and reads it."""
    stream.writeStream.foreachBatch(table.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return table.read()


def write_expiring(df: DataFrame, path: str, expires: str = "expires_at") -> None:
    """Appends rows to a table that is partitioned by the day of their expiry; rows that never expire go to the day null."""
    df.withColumn("expires_day", F.to_date(expires)).write.mode("append").partitionBy("expires_day").parquet(path)


def compact(spark: SparkSession, path: str, as_of: str, expires: str = "expires_at") -> int:
    """Removes rows that expire by as_of, and returns how many partitions it touched.

    Days before that of as_of go as whole folders, without reading a row. The day of as_of is written anew (dynamic partition overwrite) from
    a copy of its live rows, if it has any that are over. No other file is touched.
    """
    sc = spark.sparkContext
    root = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(sc._jsc.hadoopConfiguration())
    day = spark.range(1).select(F.to_date(F.lit(as_of)).cast("string").alias("d")).first()["d"]
    touched = 0
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if name.startswith("expires_day=") and name[len("expires_day=") :] < day:  # dates sort as text; __HIVE_DEFAULT_PARTITION__ sorts behind them
            fs.delete(status.getPath(), True)
            touched += 1
    today = root.suffix(f"/expires_day={day}")
    if fs.exists(today):
        rows = spark.read.parquet(path).where(F.col("expires_day") == F.lit(day).cast("date"))
        over = F.col(expires) <= F.lit(as_of).cast("timestamp")
        if not rows.where(over).isEmpty():
            live = tables.stored(rows.where(~over), "live")
            if live.isEmpty():
                fs.delete(today, True)
            else:
                live.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("expires_day").parquet(path)
            touched += 1
    return touched
