"""Background jobs on a session: status, throttled progress, cancellation, and eviction of old ones."""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

TTL, SWEEP, THROTTLE, PUSH = 3600.0, 1800.0, 0.1, 1.0


@dataclass
class Task:
    id: str
    kind: str
    status: str = "running"
    progress: dict = field(default_factory=dict)
    result: object = None
    error: str | None = None
    finished: float | None = None
    stop: threading.Event = field(default_factory=threading.Event, repr=False)
    _shown: float = 0.0

    def report(self, last: bool = False, **progress) -> None:
        """Progress at most once in THROTTLE seconds; the last always."""
        if last or time.monotonic() - self._shown >= THROTTLE:
            self._shown, self.progress = time.monotonic(), progress

    def as_dict(self) -> dict:
        return {"id": self.id, "kind": self.kind, "status": self.status, "progress": self.progress, "result": self.result, "error": self.error}


class Tasks:
    """Runs functions of a Task in threads; each in a Spark job group of its own, so that cancelling reaches its jobs."""

    def __init__(self, spark: SparkSession | None = None, clock: Callable[[], float] = time.time):
        self.spark, self.clock, self._swept = spark, clock, clock()
        self._all: dict[str, Task] = {}
        self._lock = threading.Lock()

    def submit(self, kind: str, body: Callable[[Task], object]) -> Task:
        self.sweep()
        task = Task(uuid.uuid4().hex, kind)
        with self._lock:
            self._all[task.id] = task

        def run() -> None:
            try:
                if self.spark is not None:
                    self.spark.sparkContext.setJobGroup(task.id, kind, interruptOnCancel=True)
                task.result = body(task)
                task.status = "cancelled" if task.stop.is_set() else "done"
            except Exception as e:  # noqa: BLE001  the error is the task's result
                task.status, task.error = ("cancelled", None) if task.stop.is_set() else ("error", str(e))
            task.finished = self.clock()

        threading.Thread(target=run, daemon=True).start()
        return task

    def get(self, id_: str) -> Task | None:
        with self._lock:
            return self._all.get(id_)

    def cancel(self, id_: str) -> bool:
        task = self.get(id_)
        if task is None or task.finished is not None:
            return False
        task.stop.set()
        if self.spark is not None:
            self.spark.sparkContext.cancelJobGroup(id_)
        return True

    def sweep(self) -> None:
        """Drops tasks that ended over TTL ago, at most once in SWEEP seconds."""
        now = self.clock()
        if now - self._swept < SWEEP:
            return
        self._swept = now
        with self._lock:
            self._all = {k: t for k, t in self._all.items() if t.finished is None or now - t.finished < TTL}

    def events(self, id_: str, every: float = PUSH) -> Iterator[str]:
        """Server-sent events of the task's state until it has ended."""
        while (task := self.get(id_)) is not None:
            yield f"data: {json.dumps(task.as_dict(), default=str)}\n\n"
            if task.finished is not None:
                return
            time.sleep(every)
        yield 'data: {"status": "not_found"}\n\n'
