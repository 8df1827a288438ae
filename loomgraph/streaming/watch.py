"""Change streams: debounce by session, micro-batches that keep a table current, heartbeats."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.scratch import folder


def debounce(changes: DataFrame, key: str, gap: str) -> DataFrame:
    """(key, n, first_us, last_us): runs of changes no further apart than ``gap``; batch or stream."""
    # A session window ends before ts + gap; one more microsecond lets a change at exactly the gap join.
    changes = changes.withColumn("ts", F.col("ts").cast("timestamp"))
    return changes.groupBy(key, F.session_window("ts", f"{gap} 1 microsecond").alias("w")).agg(
        F.count("*").alias("n"), F.unix_micros(F.min("ts")).alias("first_us"), F.unix_micros(F.max("ts")).alias("last_us")
    ).drop("w")


def upsert(current: DataFrame | None, batch: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Latest row of each key among the table and a batch of changes."""
    both = batch if current is None else current.unionByName(batch)
    return both.groupBy(key).agg(F.max(F.struct(*order, *[c for c in both.columns if c not in (key, *order)])).alias("r")).select(key, "r.*")


class LatestState:
    """A table kept by ``foreachBatch``: batch n makes version n from the newest one before it.

    A batch that runs twice writes the same version again. Versions are found in the folder, so that
    a restart with the same ``root`` goes on where the last run ended.
    """

    def __init__(self, spark: SparkSession, key: str, order: list[str], root: str | None = None):
        self.spark, self.key, self.order = spark, key, order
        self.root = root or f"{folder(spark)}/state-{uuid.uuid4().hex}"

    def versions(self) -> list[int]:
        """Versions written to the end."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/v*/_SUCCESS")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path) or []
        return sorted(int(f.getPath().getParent().getName()[1:]) for f in found)

    def read(self, before: int | None = None) -> DataFrame | None:
        """The newest version, or the newest before one."""
        known = [v for v in self.versions() if before is None or v < before]
        return self.spark.read.parquet(f"{self.root}/v{known[-1]}") if known else None

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        upsert(self.read(batch_id), batch, self.key, self.order).write.mode("overwrite").parquet(f"{self.root}/v{batch_id}")


def apply_changes(spark: SparkSession, path: str) -> DataFrame:
    """Final state of users after the stream of their events in micro-batches; refunded users leave."""
    folder, _, name = path.rpartition("/")
    source = spark.read.parquet(path)
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(path if not name.endswith(".parquet") or _is_dir(spark, path) else folder + "/{" + name + "}")
    state = LatestState(spark, "user_id", ["ts", "event_id"])
    run = (
        stream.select("user_id", "ts", "event_id", "event_type").writeStream.foreachBatch(state.apply)
        .option("checkpointLocation", f"{state.root}/checkpoint").trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return state.read().where("event_type <> 'refund'").select("user_id", "event_id", "event_type")


def _is_dir(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
