"""Events: envelopes, an idempotent inbox, workflow state that tolerates late events, and an outbox.

Everything works on streams and on tables alike; fold_workflows is the state of a table, workflow_state that of a stream.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

VERSION = "1.0"
PAYLOAD = "workflow string, tenant string, kind string, completed long, total long, occurred_at timestamp"
STATE = "workflow string, status string, completed long, updated_at timestamp"


def to_envelope(rows: DataFrame, event_id: Column, event_type: Column, payload: Column) -> DataFrame:
    return rows.select(event_id.cast("string").alias("event_id"), event_type.alias("event_type"), F.lit(VERSION).alias("schema_version"), F.to_json(payload).alias("payload"))


def from_envelope(envelopes: DataFrame, payload: str = PAYLOAD) -> DataFrame:
    """Envelopes with their payload parsed, and bad: the version or payload isn't known."""
    out = envelopes.withColumn("told", F.from_json("payload", payload))
    return out.withColumn("bad", (F.col("schema_version") != VERSION) | F.col("told.workflow").isNull()).select("event_id", "event_type", "bad", "told.*")


def inbox(events: DataFrame, group: str, delay: str | None = None, time: str = "occurred_at") -> DataFrame:
    """Each event once for a consumer group; with a delay, ids older than it are forgotten."""
    out = events.withColumn("consumer_group", F.lit(group))
    if delay:
        return out.withWatermark(time, delay).dropDuplicatesWithinWatermark(["consumer_group", "event_id"])
    return out.dropDuplicates(["consumer_group", "event_id"])


def accepted(events: DataFrame, tenants: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events of the workflow's own tenant, and the others for the dead-letter table."""
    known = events.join(tenants.select("workflow", F.col("tenant").alias("_owner")), "workflow", "left")
    own = F.col("tenant").eqNullSafe(F.col("_owner")) & ~F.col("bad")
    return known.filter(own).drop("_owner"), known.filter(~own).drop("_owner")


def fold_workflows(events: DataFrame) -> DataFrame:
    """The state of each workflow after all events (workflow, kind, completed, occurred_at, event_id), whatever their order.

    Counters are those of the latest progress. Once a report has begun, progress no longer changes the status; deletion ends it.
    """
    progress = F.col("kind") == "progress"
    order = F.struct("occurred_at", "event_id")
    latest = F.max_by(F.when(progress, F.col("completed")), F.when(progress, order))
    status = F.when(F.max(F.col("kind") == "deleted"), "deleted").when(F.max(F.col("kind") == "report"), "report_ready").when(F.max(F.col("kind") == "failed"), "failed").otherwise("in_progress")
    return events.groupBy("workflow").agg(status.alias("status"), F.coalesce(latest, F.lit(0)).alias("completed"), F.max("occurred_at").alias("updated_at"))


RANKS = {"in_progress": 0, "failed": 1, "report_ready": 2, "deleted": 3}
BY_KIND = {"progress": "in_progress", "failed": "failed", "report": "report_ready", "deleted": "deleted"}


def workflow_state(events: DataFrame) -> DataFrame:
    """The changing state of each workflow of a stream of events.

    What a state needs of a batch is the greatest rank, the last progress and the last time, in any order of rows and batches, so a late
    event changes nothing that a later one has told.
    """

    def fold(key: tuple, batches, state: GroupState):
        rank, completed, at, updated = state.get if state.exists else (0, 0, "", "")
        for batch in batches:
            marks = batch["occurred_at"].dt.strftime("%Y-%m-%dT%H:%M:%S.%f")
            own = marks + "|" + batch["event_id"].astype(str).str.zfill(20)
            rank = max(rank, int(batch["kind"].map(BY_KIND).map(RANKS).fillna(0).max()))
            updated = max(updated, marks.max())
            progress = own[batch["kind"] == "progress"]
            if len(progress) and progress.max() > at:
                at, completed = progress.max(), int(batch.loc[progress.idxmax(), "completed"])
        state.update((rank, completed, at, updated))
        status = next(k for k, v in RANKS.items() if v == rank)
        yield pd.DataFrame({"workflow": [key[0]], "status": [status], "completed": [completed], "updated_at": [pd.Timestamp(updated)]})

    slim = events.select("workflow", "kind", "completed", "occurred_at", "event_id")
    return slim.groupBy("workflow").applyInPandasWithState(fold, STATE, "rank int, completed long, at string, updated string", "append", GroupStateTimeout.NoTimeout)


# The statuses of a workflow.
STATUSES = ("created", "uploading", "transcribing", "correcting", "report_queued", "report_ready", "transcription_failed", "correction_failed", "report_failed", "deleting", "deleted")


def mapped_status(told: Column, current: Column, has_transcript: Column) -> Column:
    """A service's status as the workflow's: a failure is one of correction once a transcript is there; an unknown one changes nothing."""
    failed = F.when(has_transcript, "correction_failed").otherwise("transcription_failed")
    return F.when(told == "failed", failed).when(told.isin(*STATUSES), told).otherwise(current)


def lifecycle(events: DataFrame, workflows: DataFrame) -> DataFrame:
    """workflows (workflow, status) after their transcript events (workflow, kind, at): has_transcript, jobs, exists.

    A transcript makes one job however often it comes; deletion removes a workflow that is being deleted, and no other.
    """
    told = events.groupBy("workflow").agg(F.bool_or(F.col("kind").isin("transcript", "completed")).alias("t"), F.bool_or(F.col("kind") == "completed").alias("c"), F.bool_or(F.col("kind") == "deleted").alias("d"))
    out = workflows.join(told, "workflow", "left")
    gone = F.coalesce("d", F.lit(False)) & (F.col("status") == "deleting")
    return out.select("workflow", "status", F.coalesce("t", F.lit(False)).alias("has_transcript"), F.when(gone, 0).otherwise(F.coalesce("c", F.lit(False)).cast("int")).alias("jobs"), (~gone).alias("exists"))


def pending(outbox: DataFrame, now: Column, limit: int = 100) -> DataFrame:
    """The first rows to publish: not published yet, and due."""
    return outbox.filter(F.col("published_at").isNull() & (F.col("available_at") <= now)).orderBy("created_at", "event_id").limit(limit)


def published(outbox: DataFrame, now: Column, failed: Column, limit: int = 100, most: int = 60) -> DataFrame:
    """outbox after one round: the first due rows are published, or, where failed names an error, wait twice as long as before, `most` seconds at most."""
    due = pending(outbox, now, limit).select(F.col("event_id").alias("_due"))
    out = outbox.join(due, F.col("event_id") == F.col("_due"), "left")
    tried, bad = F.col("_due").isNotNull(), failed.isNotNull()
    attempts = F.col("attempts") + F.when(tried & bad, 1).otherwise(0)
    wait = F.make_dt_interval(secs=F.least(F.lit(most).cast("double"), F.pow(F.lit(2.0), attempts)))
    return out.select(
        *(c for c in outbox.columns if c not in ("attempts", "available_at", "published_at", "last_error")),
        attempts.alias("attempts"),
        F.when(tried & bad, now + wait).otherwise(F.col("available_at")).alias("available_at"),
        F.when(tried & ~bad, now).otherwise(F.col("published_at")).alias("published_at"),
        F.when(tried, failed).otherwise(F.col("last_error")).alias("last_error"),
    )


def reclaimed(messages: DataFrame, now: Column, idle: int = 300, limit: int = 10) -> DataFrame:
    """The messages (message, consumer, delivered_at, null if never) to work on next: those delivered too long ago first, else new ones."""
    late = F.col("delivered_at").isNotNull() & (F.unix_timestamp(now) - F.unix_timestamp("delivered_at") >= idle)
    rank = F.when(late, 0).when(F.col("delivered_at").isNull(), 1)
    order = Window.orderBy("_rank", "message")
    first = messages.withColumn("_rank", rank).filter(F.col("_rank").isNotNull()).orderBy("_rank", "message").limit(limit)
    any_late = F.min("_rank").over(Window.partitionBy())
    return first.withColumn("_any", any_late).filter(F.col("_rank") == F.col("_any")).withColumn("place", F.row_number().over(order)).drop("_rank", "_any")


def acknowledged(results: DataFrame) -> DataFrame:
    """(message, action) of results (message, error, recoverable): done and hopeless messages are acknowledged, the latter into the dead letters; others stay pending."""
    bad = F.col("error").isNotNull()
    return results.select("message", F.when(~bad, "ack").when(~F.coalesce("recoverable", F.lit(False)), "dead_letter").otherwise("pending").alias("action"))


def lag(messages: DataFrame, groups: DataFrame) -> DataFrame:
    """(stream, group, length, pending, lag) of messages (stream, message) and groups (stream, group, delivered, acked: the last numbers)."""
    listed = messages.groupBy("stream").agg(F.count("*").alias("length"))
    met = groups.join(messages.select("stream", "message"), "stream", "left").groupBy("stream", "group").agg(
        F.count_if((F.col("message") <= F.col("delivered")) & (F.col("message") > F.col("acked"))).alias("pending"), F.count_if(F.col("message") > F.col("delivered")).alias("lag")
    )
    return met.join(listed, "stream", "left").select("stream", "group", F.coalesce("length", F.lit(0)).alias("length"), "pending", "lag")


def expired(jobs: DataFrame, now: Column, seconds: int = 300, retries: int = 3) -> DataFrame:
    """jobs with next_status: those in work too long are queued again, or fail after `retries`."""
    late = (F.col("status") == "processing") & (F.unix_timestamp(now) - F.unix_timestamp("updated_at") >= seconds)
    return jobs.withColumn("next_status", F.when(late & (F.col("retries") >= retries), "failed").when(late, "queued").otherwise(F.col("status")))


def run_once(stream: DataFrame, path: str, mode: str = "append") -> None:
    """Work off what a stream's source holds now into Parquet files at path, with its checkpoint beside them."""
    stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start(path).awaitTermination()
