"""Background jobs of a driver: one at a time, in order, with a status machine, events, and Spark jobs that stop on cancel."""

from __future__ import annotations

import queue
import threading
import time
import uuid
from collections.abc import Callable
from enum import Enum


class Status(Enum):
    NEVER_RUN = "NEVER_RUN"
    RUNNING = "RUNNING"
    COMPLETED = "COMPLETED"
    INTERRUPT_REQUESTED = "INTERRUPT_REQUESTED"
    INTERRUPTED = "INTERRUPTED"
    FAILED = "FAILED"


class Job:
    """What a subclass's ``work`` does, between a started and an ended event.

    ``supersedable``: a newer job of the same class replaces a waiting one and stops a running one; other jobs are refused while
    one of their class waits or runs.
    """

    name = "job"
    supersedable = False
    #: Seconds between two events of progress; the last item's is always sent.
    every = 0.1

    def __init__(self):
        self.id = uuid.uuid4().hex
        self.status = Status.NEVER_RUN
        self.error: Exception | None = None
        self.listen: Callable[[str, dict], None] = lambda kind, facts: None
        self.clock: Callable[[], float] = time.monotonic
        self._sent = float("-inf")
        self._lock = threading.Lock()

    def work(self) -> None:
        raise NotImplementedError(f"{type(self).__name__} has no work")

    def stop(self) -> None:
        """Asks a job to end; it sees that at ``stopping``."""
        self.status = Status.INTERRUPT_REQUESTED

    @property
    def stopping(self) -> bool:
        return self.status in (Status.INTERRUPT_REQUESTED, Status.INTERRUPTED)

    def progress(self, done: int, of: int, item: str = "", phase: str = "", last: bool = False) -> None:
        with self._lock:
            now = self.clock()
            if not last and now - self._sent < self.every:
                return
            self._sent = now
        self.listen("IN_PROGRESS", {"job": self.id, "item": item, "done": done, "of": of, "text": f"{phase}: {done}/{of}" if phase else ""})

    def run(self) -> Status:
        if self.stopping:
            self.status = Status.INTERRUPTED
            return self.status
        self.status, self._sent = Status.RUNNING, float("-inf")
        self.listen("STARTED", {"job": self.id, "name": self.name})
        try:
            self.work()
        except Exception as e:
            self.error, self.status = e, Status.FAILED
            self.listen("FAILED", {"job": self.id, "error": str(e)})
            return self.status
        self.status = Status.INTERRUPTED if self.status == Status.INTERRUPT_REQUESTED else Status.COMPLETED
        self.listen("INTERRUPTED" if self.status == Status.INTERRUPTED else "ENDED", {"job": self.id})
        return self.status


class SparkJob(Job):
    """A job whose Spark work runs under its id as job tag, so that stopping it cancels its Spark jobs."""

    def __init__(self, spark, body: Callable[[SparkJob], None], name: str = "spark"):
        super().__init__()
        self.spark, self.body, self.name = spark, body, name

    def work(self) -> None:
        context = self.spark.sparkContext
        context.addJobTag(f"job-{self.id}")
        context.setInterruptOnCancel(True)
        try:
            self.body(self)
        except Exception:
            if not self.stopping:
                raise
        finally:
            context.removeJobTag(f"job-{self.id}")

    def stop(self) -> None:
        super().stop()
        self.spark.sparkContext.cancelJobsWithTag(f"job-{self.id}")


class JobManager:
    """A worker that runs submitted jobs one after the other."""

    def __init__(self, listen: Callable[[str, dict], None] | None = None):
        self.listen = listen or (lambda kind, facts: None)
        self._waiting: list[Job] = []
        self._ready = threading.Condition()
        self._current: Job | None = None
        self._closed = False
        self._worker = threading.Thread(target=self._loop, daemon=True, name="jobs")
        self._worker.start()

    def submit(self, job: Job) -> str | None:
        """The job's id, or None if it is refused."""
        with self._ready:
            if self._closed:
                return None
            same = [j for j in self._waiting if type(j) is type(job)]
            running = self._current is not None and type(self._current) is type(job)
            if job.supersedable:
                for j in same:
                    self._waiting.remove(j)
                if running:
                    self._current.stop()
            elif same or running:
                return None
            job.listen = self.listen
            self._waiting.append(job)
            self._ready.notify_all()
            return job.id

    @property
    def waiting(self) -> list[str]:
        with self._ready:
            return [j.id for j in self._waiting]

    @property
    def current(self) -> str | None:
        with self._ready:
            return self._current.id if self._current else None

    def cancel(self, job_id: str) -> bool:
        """Stops the job if it runs; a waiting one will not run."""
        with self._ready:
            for job in [*([self._current] if self._current else []), *self._waiting]:
                if job.id == job_id:
                    job.stop()
                    return True
        return False

    def cancel_all(self) -> None:
        with self._ready:
            for job in self._waiting:
                job.stop()
            self._waiting.clear()
            if self._current:
                self._current.stop()

    def close(self) -> None:
        """Stops all jobs and returns when the running one has ended."""
        self.cancel_all()
        with self._ready:
            self._closed = True
            self._ready.notify_all()
        if threading.current_thread() is not self._worker:
            self._worker.join()

    def drain(self, timeout: float) -> bool:
        """Waits until nothing waits or runs; false if that takes longer."""
        with self._ready:
            return self._ready.wait_for(lambda: not self._waiting and self._current is None, timeout)

    def _loop(self) -> None:
        while True:
            with self._ready:
                self._ready.wait_for(lambda: self._waiting or self._closed)
                if self._closed and not self._waiting:
                    return
                job = self._waiting.pop(0)
                if job.stopping:
                    job.status = Status.INTERRUPTED
                    self._ready.notify_all()
                    continue
                self._current = job
            try:
                job.run()
            finally:
                with self._ready:
                    self._current = None
                    self._ready.notify_all()


class Debounced:
    """Runs the latest of the calls that come within ``delay`` seconds of each other, once they pause."""

    def __init__(self, delay: float = 0.15):
        self.delay = delay
        self._timer: threading.Timer | None = None
        self._lock = threading.Lock()

    def call(self, action: Callable[[], None]) -> None:
        with self._lock:
            if self._timer is not None:
                self._timer.cancel()
            self._timer = threading.Timer(self.delay, action)
            self._timer.daemon = True
            self._timer.start()

    def close(self) -> None:
        with self._lock:
            if self._timer is not None:
                self._timer.cancel()


class Progress:
    """Events of a manager, in the order they come, for readers on another thread."""

    def __init__(self):
        self.events: queue.Queue = queue.Queue()

    def __call__(self, kind: str, facts: dict) -> None:
        self.events.put((kind, facts))
