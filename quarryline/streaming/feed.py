"""The change feed on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarryline.operators import changefeed


def event_stream(spark: SparkSession, path: str, schema: StructType | str, *, ts: str = "ts", late: str = "10 minutes", files_per_trigger: int = 64) -> DataFrame:
    """A stream of event rows from Parquet files.  Files per trigger bound what
    a micro-batch takes, which is the feed's backpressure."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def file_stream(spark: SparkSession, root: str, *, files_per_trigger: int = 1000) -> DataFrame:
    """Files that appear below a folder: each row says that a path is dirty."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    rows = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_trigger).load(root)
    return rows.select("path", F.col("modificationTime").alias("ts"), F.col("length").alias("size"))


def follow(workspace, checkpoint: str, *, priority: int = changefeed.DEFAULT_PRIORITY, drain: bool = True) -> None:
    """Take what appeared below a workspace's folder since the last time: each
    file is a parse job in its queue, several events of one path being one job.
    With ``drain`` the jobs are done at once."""
    prefix = workspace.root.rstrip("/") + "/"

    def handle(batch: DataFrame, number: int) -> None:
        paths = batch.select(F.regexp_replace("path", r"^[a-z0-9]+:/*", "/").alias("path")).distinct().collect()  # files of one micro-batch
        workspace.enqueue((r.path.removeprefix(prefix), "parse", priority) for r in paths)
        if drain:
            workspace.drain()

    run_once(file_stream(workspace.spark, workspace.root), checkpoint, handle)


def debounced(events: DataFrame, key: str = "user_id", ts: str = "ts", gap: str = "200 milliseconds") -> DataFrame:
    return changefeed.debounce(events, key, ts, gap)


def run_once(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> None:
    """Handle all that is there in micro-batches and stop."""
    stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_forever(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None], every: str = "1 second"):
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def to_table(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes each micro-batch to its own folder, so that a batch
    that runs again replaces itself."""

    def handle(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return handle


def coalesced(events: DataFrame, *, timeout_ms: int | None = None) -> DataFrame:
    """Jobs coalesced by key in state: (path, kind, priority, events) each time
    a key changes.  ``events`` has path, kind and priority.  With a timeout a
    key that is quiet for so long leaves the state (for streams that run on;
    a timeout keeps a run of what is available from ending)."""

    def update(key: tuple, rows: Iterator, state) -> Iterator:
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        priority, n = state.get if state.exists else (1 << 30, 0)
        for frame in rows:
            priority = min(priority, int(frame["priority"].fillna(changefeed.DEFAULT_PRIORITY).min()))
            n += len(frame)
        state.update((priority, n))
        if timeout_ms is not None:
            state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame({"path": [key[0]], "kind": [key[1]], "priority": [priority], "events": [n]})

    return events.groupBy("path", "kind").applyInPandasWithState(update, "path string, kind string, priority int, events long", "priority int, events long", "update", "NoTimeout" if timeout_ms is None else "ProcessingTimeTimeout")
