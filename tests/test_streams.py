"""Streams over micro-batches: timers, late and repeated events, batches that are killed and repeated, watermarks and progress."""

import datetime
import time

import pytest
from pyspark.sql import functions as F

from lodestone.streaming import events, processor, sinks

DAY = datetime.datetime(2024, 1, 1)


@pytest.fixture
def feed(spark, tmp_path):
    """Runs a stream of what has been fed so far to its end; each call is a restart from the checkpoint."""
    number = iter(range(100))

    def go(rows, schema, make, name="s", writer=None):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}/in")
        fed = spark.readStream.schema(schema).parquet(f"{tmp_path}/{name}/in")
        out = make(fed).writeStream.option("checkpointLocation", f"{tmp_path}/{name}/checkpoint").trigger(availableNow=True)
        path = f"{tmp_path}/{name}/out/{next(number)}"
        query = out.outputMode("append").foreachBatch(writer or (lambda df, batch: df.write.mode("append").parquet(path))).start()
        query.awaitTermination()
        return query

    return go


@pytest.fixture
def rocks(spark):
    settings = {"spark.sql.streaming.stateStore.providerClass": processor.PROVIDER, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k in settings:
        spark.conf.unset(k)


def event(flow, n, kind, minute, tenant="t", completed=0):
    return (flow, tenant, f"{flow}-{n}", kind, completed, DAY + datetime.timedelta(minutes=minute))


def outcomes(spark, tmp_path, k):
    return {(r.workflow, r.event_id): r for r in spark.read.schema(processor.OUTCOMES).parquet(f"{tmp_path}/s/out/{k}").collect()}


def test_processor(spark, feed, rocks, tmp_path):
    make = lambda fed: processor.processed(fed, lease=1000, retries=1)
    first = [
        event("a", 1, "created", 0), event("a", 2, "progress", 5, completed=5), event("a", 3, "completed", 9), event("a", 4, "claimed", 10),
        event("b", 1, "created", 0), event("b", 2, "completed", 1), event("b", 2, "completed", 1), event("b", 9, "completed", 2), event("b", 3, "claimed", 3), event("b", 4, "done", 4),
        event("c", 1, "progress", 0), event("d", 1, "created", 0), event("d", 2, "progress", 1, tenant="x"), event("d", 3, "deleted", 2), event("d", 4, "deleting", 3), event("d", 5, "deleted", 4), event("d", 6, "odd", 5),
        event("e", 1, "created", 0),
    ]
    feed(first, processor.EVENTS, make)
    got = outcomes(spark, tmp_path, 0)
    assert (got["a", "a-4"].status, got["a", "a-4"].job) == ("report_processing", "processing")
    assert (got["b", "b-4"].status, got["b", "b-4"].job, got["b", "b-4"].retries) == ("report_ready", "done", 0)
    assert got["c", "c-1"].reason == "unknown workflow" and got["d", "d-2"].reason == "another tenant" and got["d", "d-3"].reason == "not deleting"
    assert got["d", "d-5"].outcome == "done" and got["d", "d-5"].status is None and got["d", "d-6"].reason == "unknown workflow"
    rows = spark.read.schema(processor.OUTCOMES).parquet(f"{tmp_path}/s/out/0")
    assert rows.filter("event_id = 'b-2'").groupBy("outcome").count().collect().__len__() == 2
    # the lease runs out; a late progress and a repeated completion change nothing
    time.sleep(1.2)
    feed([event("a", 5, "progress", 2, completed=2), event("b", 5, "progress", 20, completed=9), event("b", 2, "completed", 1), event("e", 2, "odd", 1)], processor.EVENTS, make)
    got = outcomes(spark, tmp_path, 1)
    assert got["a", None].outcome == "expired" and (got["a", None].status, got["a", None].job, got["a", None].retries) == ("report_queued", "queued", 1)
    assert got["a", "a-5"].completed == 5 and got["e", "e-2"].reason == "unknown kind"
    assert got["b", "b-5"].status == "report_ready" and got["b", "b-5"].completed == 9 and got["b", "b-2"].outcome == "repeated"
    # claimed again, and out of retries
    feed([event("a", 6, "claimed", 30)], processor.EVENTS, make)
    time.sleep(1.2)
    feed([event("e", 3, "progress", 3, completed=1)], processor.EVENTS, make)
    failed = [r for k in (2, 3) for r in outcomes(spark, tmp_path, k).values() if r.outcome == "expired"]
    assert [(r.status, r.job, r.retries) for r in failed] == [("report_failed", "failed", 2)]


def test_ids_are_forgotten(spark, feed, rocks, tmp_path):
    make = lambda fed: processor.processed(fed, remembered=500)
    feed([event("a", 1, "created", 0)], processor.EVENTS, make)
    time.sleep(0.8)
    feed([event("a", 1, "created", 0)], processor.EVENTS, make)
    assert outcomes(spark, tmp_path, 1)["a", "a-1"].outcome == "done"


OUT = "event_id string, value long"
TRIED = f"{OUT}, attempts int, available_at timestamp, last_error string"


def test_a_killed_batch_leaves_every_row_once(spark, feed, tmp_path):
    now = F.lit(DAY)
    route = lambda rows: sinks.routed(rows, F.when(F.col("value") % 3 == 1, "E"), F.col("value") % 2 == 0, now)
    sink = sinks.BatchSink(f"{tmp_path}/sink", route)
    killed = []

    def write(rows, batch):
        sink.write(rows, batch)
        if not killed:
            killed.append(batch)
            raise RuntimeError("killed after the write, before the commit")

    rows = [(f"e{k}", k) for k in range(30)] + [("e5", 5)]
    with pytest.raises(Exception, match="killed"):
        feed(rows, OUT, lambda fed: fed, writer=write)
    feed([("late", 3)], OUT, lambda fed: fed, writer=write)
    read = {r: sink.read(spark, r, TRIED).collect() for r in sinks.ROUTES}
    ids = [x.event_id for rows in read.values() for x in rows]
    assert sorted(ids) == sorted({*ids}) and len(ids) == 31
    assert {x.value for x in read["retry"]} == {4, 10, 16, 22, 28} and {x.value for x in read["dead_letters"]} == {1, 7, 13, 19, 25}
    assert {x.attempts for x in read["published"]} == {0} and {x.attempts for x in read["retry"]} == {1}
    assert sink.due(spark, TRIED, now).count() == 0
    due = sink.due(spark, TRIED, F.lit(DAY + datetime.timedelta(seconds=2)))
    assert {r.value for r in due.collect()} == {4, 10, 16, 22, 28}
    # tried again: one works, the others wait longer or end as dead letters
    again = sinks.BatchSink(f"{tmp_path}/sink", lambda rows: sinks.routed(rows, F.when(F.col("value") > 4, "E"), F.col("value") < 20, F.lit(DAY), attempts=3))
    again.write(due, 1000)
    later = sink.due(spark, TRIED, F.lit(DAY + datetime.timedelta(seconds=60)))
    assert {(r.value, r.attempts) for r in later.collect()} == {(10, 2), (16, 2)}


def test_watermark_and_progress(spark, feed, tmp_path):
    listener = sinks.ProgressTable()
    spark.streams.addListener(listener)
    schema = "event_id string, occurred_at timestamp"
    at = lambda k, hour: (f"e{k}", DAY + datetime.timedelta(hours=hour))
    make = lambda fed: events.inbox(fed, "g", delay="1 hour")
    try:
        feed([at(1, 0), at(2, 0), at(1, 0)], schema, make)
        feed([at(3, 10), at(1, 0)], schema, make)
        last = feed([at(4, 10), at(2, 0), at(3, 10)], schema, make).lastProgress
        deadline = time.time() + 20
        while sum(r[2] for r in listener.rows) < 8 and time.time() < deadline:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    got = sorted(r.event_id for k in range(3) for r in spark.read.schema("event_id string").parquet(f"{tmp_path}/s/out/{k}").collect())
    assert got == ["e1", "e2", "e3", "e4"]
    # ids older than the delay have left the state, and the event that came after is dropped as late
    assert last["stateOperators"][0]["numRowsTotal"] <= 2
    assert listener.write(spark, f"{tmp_path}/progress") >= 3
    told = spark.read.schema(sinks.PROGRESS).parquet(f"{tmp_path}/progress")
    assert {r.rows for r in told.collect()} >= {3, 2} and told.agg(F.sum("dropped")).first()[0] >= 1
    assert told.filter("watermark LIKE '2024-01-01T09%'").count() >= 1
