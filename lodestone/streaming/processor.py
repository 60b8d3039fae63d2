"""The state of workflows inside a stream: one job each, leases that expire by timers, deletion, and an inbox that forgets.

Each workflow's rows of a micro-batch are taken in order of time and id. An event id that is remembered does nothing; ids are forgotten `remembered` milliseconds after they came (a time to live of the
store). A completed transcript makes one job, however often it comes. A claim leases the job; a timer queues it again when the lease runs out, and fails it after `retries`. Once a job exists, progress and
transcripts don't set the status back. A workflow that is being deleted loses its state when deletion is told; deletion of another one is a dead letter, as are events of unknown workflows, of another
tenant and of unknown kinds.

The state of a workflow has a few values and the ids of its last events, so it doesn't grow with its history.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

EVENTS = "workflow string, tenant string, event_id string, kind string, completed long, occurred_at timestamp"
#: outcome: done, repeated, dead, or of a timer expired; reason tells why an event is dead.
OUTCOMES = "workflow string, event_id string, kind string, outcome string, reason string, status string, job string, retries int, completed long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LEASE, RETRIES, REMEMBERED = 300_000, 3, 24 * 3600 * 1000


class WorkflowProcessor(StatefulProcessor):
    """lease: milliseconds that a claimed job may take; retries: how often it is queued again; remembered: milliseconds for which event ids are known."""

    def __init__(self, lease: int = LEASE, retries: int = RETRIES, remembered: int = REMEMBERED):
        self.lease, self.retries, self.remembered = lease, retries, remembered

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.flow = handle.getValueState("flow", "status string, tenant string, completed long, told string")
        self.job = handle.getValueState("job", "status string, retries int, until long")
        self.seen = handle.getMapState("seen", "event_id string", "kind string", self.remembered)

    def _row(self, key, event_id, kind, outcome, reason=None) -> Row:
        flow = self.flow.get() if self.flow.exists() else None
        job = self.job.get() if self.job.exists() else None
        return Row(
            workflow=key[0], event_id=event_id, kind=kind, outcome=outcome, reason=reason,
            status=flow and flow[0], job=job and job[0], retries=job and job[1], completed=flow and flow[2],
        )

    def _set(self, flow, status: str) -> None:
        self.flow.update((status, flow[1], flow[2], flow[3]))

    def _apply(self, key, row, now: int) -> str | None:
        """Takes one event in; returns why it is dead, if so."""
        if not self.flow.exists():
            if row.kind != "created":
                return "unknown workflow"
            self.flow.update(("created", row.tenant, 0, ""))
            return None
        flow, job = self.flow.get(), self.job.get() if self.job.exists() else None
        if flow[1] != row.tenant:
            return "another tenant"
        if row.kind == "progress":
            told = f"{row.occurred_at.isoformat()} {row.event_id}"
            if told > flow[3]:
                status = flow[0] if job or flow[0] == "deleting" else "transcribing"
                self.flow.update((status, flow[1], row.completed or 0, told))
        elif row.kind == "transcript":
            if not job and flow[0] != "deleting":
                self._set(flow, "transcript_completed")
        elif row.kind == "completed":
            if not job:
                self.job.update(("queued", 0, 0))
                if flow[0] != "deleting":
                    self._set(flow, "report_queued")
        elif row.kind == "claimed":
            if job and job[0] == "queued":
                self.job.update(("processing", job[1], now + self.lease))
                self.handle.registerTimer(now + self.lease)
                self._set(flow, "report_processing")
        elif row.kind == "done":
            if job and job[0] == "processing":
                self.handle.deleteTimer(job[2])
                self.job.update(("done", job[1], 0))
                self._set(flow, "report_ready")
        elif row.kind == "deleting":
            self._set(flow, "deleting")
        elif row.kind == "deleted":
            if flow[0] != "deleting":
                return "not deleting"
            if job and job[0] == "processing":
                self.handle.deleteTimer(job[2])
            self.flow.clear()
            self.job.clear()
        elif row.kind != "created":
            return "unknown kind"
        return None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        for row in sorted(rows, key=lambda r: (r.occurred_at, r.event_id)):
            if self.seen.containsKey((row.event_id,)):
                yield self._row(key, row.event_id, row.kind, "repeated")
                continue
            reason = self._apply(key, row, now)
            self.seen.updateValue((row.event_id,), (row.kind,))
            yield self._row(key, row.event_id, row.kind, "dead" if reason else "done", reason)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        job = self.job.get() if self.job.exists() else None
        if not job or job[0] != "processing" or job[2] != expiredTimerInfo.getExpiryTimeInMs():
            return
        flow = self.flow.get()
        failed = job[1] + 1 > self.retries
        self.job.update(("failed" if failed else "queued", job[1] + 1, 0))
        self._set(flow, "report_failed" if failed else "report_queued")
        yield self._row(key, None, "lease", "expired")

    def close(self) -> None:
        pass


def processed(events: DataFrame, lease: int = LEASE, retries: int = RETRIES, remembered: int = REMEMBERED) -> DataFrame:
    """OUTCOMES of a stream of EVENTS. The session's state store must be the RocksDB one (PROVIDER)."""
    return events.groupBy("workflow").transformWithState(WorkflowProcessor(lease, retries, remembered), OUTCOMES, "Append", "ProcessingTime")
