"""Job events: who is told, counts, and a JSON-lines file."""

from __future__ import annotations

import json
import logging
import threading
import time
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field
from typing import Any

log = logging.getLogger("lakepipe")


@dataclass(frozen=True)
class JobEvent:
    """One thing that happened: ``kind`` is like ``task.started``, ``task.finished``, ``task.failed`` or ``batch.finished``."""

    kind: str
    job_id: str
    name: str = ""
    rows_in: int | None = None
    rows_out: int | None = None
    seconds: float | None = None
    error: str | None = None
    at: float = field(default_factory=time.time)
    extra: dict[str, Any] = field(default_factory=dict)


class StateObserver:
    """Tells subscribers of events and counts them. A subscriber's error is logged and goes no further."""

    def __init__(self) -> None:
        self._lock = threading.Lock()
        self._subscribers: dict[int, Callable[[JobEvent], None]] = {}
        self._next = 0
        self._counts: Counter[str] = Counter()
        self._totals: Counter[str] = Counter()

    def subscribe(self, fn: Callable[[JobEvent], None]) -> int:
        with self._lock:
            self._next += 1
            self._subscribers[self._next] = fn
            return self._next

    def unsubscribe(self, token: int) -> bool:
        with self._lock:
            return self._subscribers.pop(token, None) is not None

    def emit(self, event: JobEvent) -> None:
        with self._lock:
            self._counts[event.kind] += 1
            for k in ("rows_in", "rows_out", "seconds"):
                self._totals[k] += getattr(event, k) or 0
            subscribers = list(self._subscribers.values())
        for fn in subscribers:
            try:
                fn(event)
            except Exception:
                log.exception("a telemetry subscriber failed on %s", event.kind)

    @contextmanager
    def _observe(self, what: str, name: str, spark=None) -> Iterator[dict]:
        job, began, found = uuid.uuid4().hex, time.time(), {}
        self.emit(JobEvent(f"{what}.started", job, name, extra={"status": "running"}))
        with _grouped(spark, job) as stages:
            try:
                yield found
            except BaseException as e:
                self.emit(JobEvent(f"{what}.failed", job, name, seconds=time.time() - began, error=f"{type(e).__name__}: {e}"[:500], extra={"status": "failed", "stages": stages()}))
                raise
            self.emit(JobEvent(f"{what}.finished", job, name, found.get("rows_in"), found.get("rows_out"), time.time() - began, extra={"status": "finished", "stages": stages()}))

    def observe_task(self, name: str, spark=None):
        """A context: put ``rows_out`` into the dict that it gives. With a Spark session the last event's ``extra`` has the stages
        that ran for it: stage_id, attempt, partitions (tasks), done and failed ones."""
        return self._observe("task", name, spark)

    def observe_batch(self, name: str):
        return self._observe("batch", name)

    def summary(self) -> dict[str, Any]:
        with self._lock:
            return {"events": dict(self._counts), "rows_in": int(self._totals["rows_in"]), "rows_out": int(self._totals["rows_out"]), "seconds": float(self._totals["seconds"])}

    def clear_counters(self) -> None:
        with self._lock:
            self._counts.clear()
            self._totals.clear()

    def reset(self) -> None:
        self.clear_counters()
        with self._lock:
            self._subscribers.clear()


@contextmanager
def _grouped(spark, job: str) -> Iterator[Callable[[], list[dict]]]:
    """In it, Spark's jobs of this thread are tagged ``job``; gives a function of their stages so far."""
    if spark is None:
        yield list
        return
    context = spark.sparkContext
    context.addJobTag(job)
    known = context.getLocalProperty("spark.jobGroup.id")
    group = known or job
    if not known:
        context.setLocalProperty("spark.jobGroup.id", job)
    before = set(context.statusTracker().getJobIdsForGroup(group))

    def stages() -> list[dict]:
        tracker, found = context.statusTracker(), {}
        for j in sorted(set(tracker.getJobIdsForGroup(group)) - before):
            info = tracker.getJobInfo(j)
            for s in info.stageIds if info else ():
                if (x := tracker.getStageInfo(s)) is not None:
                    found[s] = {"stage_id": s, "attempt": x.currentAttemptId, "partitions": x.numTasks, "done": x.numCompletedTasks, "failed": x.numFailedTasks, "job_status": info.status}
        return list(found.values())

    try:
        yield stages
    finally:
        context.removeJobTag(job)
        if not known:
            context.setLocalProperty("spark.jobGroup.id", None)


class JsonLinesSink:
    """Writes each event as a line of JSON."""

    def __init__(self, path: str) -> None:
        self._file = open(path, "a", encoding="utf-8")  # noqa: SIM115
        self._lock = threading.Lock()

    def __call__(self, event: JobEvent) -> None:
        line = json.dumps(asdict(event), default=str)
        with self._lock:
            if not self._file.closed:
                self._file.write(line + "\n")
                self._file.flush()

    def close(self) -> None:
        with self._lock:
            self._file.close()
