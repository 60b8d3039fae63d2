"""Sinks that write each micro-batch once, and the progress of streams as a table.

A batch is written to a folder of its number in one write, dealt into routes: published, retry, dead_letters. A batch that is repeated after a failure replaces its own folder, so every row is there once.
A retry waits 2, 4, 8 ... seconds, `most` at most, and comes back as input once it is due.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

ROUTES = ("published", "retry", "dead_letters")
MOST = 60
#: Batches whose progress a listener holds until it is written.
HELD = 10_000
PROGRESS = "name string, batch long, rows long, backlog long, state_rows long, dropped long, watermark string, started string, millis long"


def routed(rows: DataFrame, error: Column, recoverable: Column, now: Column, attempts: int = 5) -> DataFrame:
    """rows with route, attempts, available_at and last_error: those without an error are published, recoverable ones wait for another attempt, the others are dead letters."""
    tried = F.coalesce(F.col("attempts") if "attempts" in rows.columns else F.lit(0), F.lit(0)) + F.when(error.isNotNull(), 1).otherwise(0)
    again = F.coalesce(recoverable, F.lit(False)) & (tried < attempts)
    route = F.when(error.isNull(), "published").when(again, "retry").otherwise("dead_letters")
    wait = F.make_dt_interval(secs=F.least(F.lit(float(MOST)), F.pow(F.lit(2.0), tried)))
    kept = [c for c in rows.columns if c not in ("route", "attempts", "available_at", "last_error")]
    return rows.select(*kept, route.alias("route"), tried.alias("attempts"), F.when(route == "retry", now + wait).otherwise(now).alias("available_at"), error.alias("last_error"))


class BatchSink:
    """Micro-batches below root, a folder a batch; use write as the function of foreachBatch."""

    def __init__(self, root: str, route: Callable[[DataFrame], DataFrame], event_id: str = "event_id"):
        self.root, self.route, self.event_id = root, route, event_id

    def write(self, rows: DataFrame, batch: int) -> None:
        """Writes a batch in place of what an earlier attempt at it has left; of equal ids within a batch one is written."""
        self.route(rows.dropDuplicates([self.event_id])).write.mode("overwrite").partitionBy("route").parquet(f"{self.root}/batch={batch}")

    def read(self, spark: SparkSession, route: str, schema: str) -> DataFrame:
        """The rows of a route, with the batch that wrote them."""
        return spark.read.option("basePath", self.root).schema(f"{schema}, batch long, route string").parquet(self.root).filter(F.col("route") == route).drop("route")

    def due(self, spark: SparkSession, schema: str, now: Column) -> DataFrame:
        """Rows to try again: those whose last attempt was routed to retry and whose time has come."""
        tries = spark.read.option("basePath", self.root).schema(f"{schema}, batch long, route string").parquet(self.root)
        last = tries.groupBy(self.event_id).agg(F.max_by(F.struct(*(c for c in tries.columns if c != self.event_id)), "attempts").alias("_last"))
        ended = tries.filter(F.col("route") != "retry").select(self.event_id).distinct()
        out = last.select(self.event_id, "_last.*").filter((F.col("route") == "retry") & (F.col("available_at") <= now))
        return out.join(ended, self.event_id, "left_anti").drop("route", "batch")


class ProgressTable(StreamingQueryListener):
    """Listens to streams and keeps one row a batch: rows, backlog of the sources, state, rows dropped as too late. write() appends them to a table."""

    def __init__(self) -> None:
        self.rows: deque[tuple] = deque(maxlen=HELD)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.rows.append(progress_row(event.progress))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def write(self, spark: SparkSession, path: str) -> int:
        """Appends what has come since the last time; the number of rows."""
        held = [self.rows.popleft() for _ in range(len(self.rows))]
        if held:
            spark.createDataFrame(held, PROGRESS).coalesce(1).write.mode("append").parquet(path)
        return len(held)


def progress_row(progress) -> tuple:
    """A row of PROGRESS from the progress of a batch; backlog is what sources report as not read yet (files or offsets), 0 where they report nothing."""
    metrics = [s.metrics or {} for s in progress.sources]
    backlog = sum(int(float(m.get("numFilesOutstanding", m.get("maxOffsetsBehindLatest", 0)) or 0)) for m in metrics)
    state = progress.stateOperators
    return (
        progress.name, progress.batchId, progress.numInputRows, backlog, sum(s.numRowsTotal for s in state), sum(s.numRowsDroppedByWatermark for s in state),
        (progress.eventTime or {}).get("watermark"), progress.timestamp, progress.batchDuration,
    )
