"""A durable queue of jobs and the one lane that runs them, on the driver."""

from __future__ import annotations

import json
import sqlite3
import threading
import time
from collections import OrderedDict, deque
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor, TimeoutError

STATES = ("queued", "running", "succeeded", "failed", "canceled")
#: Job kind -> (arguments it needs, arguments it may have).
KINDS = {
    "snapshot": ((), ("label",)),
    "recover-table": (("table",), ("snapshot",)),
    "recover-rows": (("table",), ("snapshot",)),
    "recover-column": (("table", "column"), ("snapshot",)),
    "as-of": (("at", "sql"), ()),
    "cycle": ((), ()),
}
RING, RINGS = 50, 64


class BadJob(ValueError):
    pass


def arguments(kind: str, args: dict) -> list[str]:
    """The job as words: its kind, what it needs, and what it may have where that is given."""
    if kind not in KINDS:
        raise BadJob(f'unknown job kind "{kind}"')
    needed, optional = KINDS[kind]
    given = {k: v for k, v in args.items() if isinstance(v, str) and v}
    if any(k not in given for k in needed):
        raise BadJob(f"{kind}: {' and '.join(f'args.{k}' for k in needed)} {'is' if len(needed) == 1 else 'are'} required")
    return [kind, *(given[k] for k in needed), *(given[k] for k in optional if k in given)]


class JobQueue:
    """Jobs in a small database file of the driver; ":memory:" forgets them."""

    def __init__(self, path: str = ":memory:", now: Callable[[], float] = time.time):
        self._db, self._lock, self._now = sqlite3.connect(path, check_same_thread=False), threading.RLock(), now
        self._db.row_factory = sqlite3.Row
        self._run("CREATE TABLE IF NOT EXISTS jobs (id INTEGER PRIMARY KEY AUTOINCREMENT, kind TEXT NOT NULL, args TEXT NOT NULL, state TEXT NOT NULL, submitted_at REAL, started_at REAL, finished_at REAL, output TEXT, error TEXT, progress TEXT, worker TEXT, lease_at REAL)")

    def _run(self, sql: str, *values):
        with self._lock, self._db:
            return self._db.execute(sql, values)

    @staticmethod
    def _job(row) -> dict | None:
        if row is None:
            return None
        return dict(row) | {k: json.loads(row[k]) if row[k] else None for k in ("args", "output", "progress")}

    def submit(self, kind: str, args: dict | None = None) -> int:
        arguments(kind, args or {})
        return self._run("INSERT INTO jobs (kind, args, state, submitted_at) VALUES (?, ?, 'queued', ?)", kind, json.dumps(args or {}), self._now()).lastrowid

    def get(self, job: int) -> dict | None:
        return self._job(self._run("SELECT * FROM jobs WHERE id = ?", job).fetchone())

    def list(self, state: str = "", kind: str = "", limit: int = 50) -> list[dict]:
        """The newest first."""
        return [self._job(r) for r in self._run("SELECT * FROM jobs WHERE (? = '' OR state = ?) AND (? = '' OR kind = ?) ORDER BY id DESC LIMIT ?", state, state, kind, kind, limit if limit > 0 else 50)]

    def next_queued(self) -> dict | None:
        return self._job(self._run("SELECT * FROM jobs WHERE state = 'queued' ORDER BY id LIMIT 1").fetchone())

    def mark_running(self, job: int, worker: str) -> bool:
        return self._run("UPDATE jobs SET state = 'running', started_at = ?, worker = ?, lease_at = ? WHERE id = ? AND state = 'queued'", self._now(), worker, self._now(), job).rowcount == 1

    def heartbeat(self, job: int) -> None:
        self._run("UPDATE jobs SET lease_at = ? WHERE id = ? AND state = 'running'", self._now(), job)

    def set_progress(self, job: int, progress: dict) -> None:
        self._run("UPDATE jobs SET progress = ? WHERE id = ? AND state = 'running'", json.dumps(progress), job)

    def finish(self, job: int, state: str, output: dict | None = None, error: str = "") -> bool:
        """False where the job no longer ran, as after a cancel."""
        return self._run("UPDATE jobs SET state = ?, finished_at = ?, output = ?, error = ? WHERE id = ? AND state = 'running'", state, self._now(), json.dumps(output, default=str) if output is not None else None, error or None, job).rowcount == 1

    def cancel_queued(self, job: int) -> bool:
        return self._run("UPDATE jobs SET state = 'canceled', finished_at = ? WHERE id = ? AND state = 'queued'", self._now(), job).rowcount == 1

    def fail_orphans(self, reason: str = "the driver restarted during execution") -> int:
        """Jobs that ran when the last driver ended."""
        return self._run("UPDATE jobs SET state = 'failed', finished_at = ?, error = ? WHERE state = 'running'", self._now(), reason).rowcount


class Runner:
    """Runs queued jobs one at a time: do(job, report) returns a job's output.

    A job's Spark jobs carry a tag, by which a cancel or a timeout ends them. The last events
    of each of the last jobs are kept.
    """

    def __init__(self, queue: JobQueue, do: Callable[[dict, Callable[[dict], None]], dict | None], spark=None, *, timeout: float | None = None, worker: str = "lane"):
        self.queue, self.do, self.spark, self.timeout, self.worker = queue, do, spark, timeout, worker
        self._lane, self._canceled, self._events, self._current = ThreadPoolExecutor(1), set(), OrderedDict(), None
        queue.fail_orphans()

    def event(self, job: int, what: str) -> None:
        self._events.setdefault(job, deque(maxlen=RING)).append({"at": time.time(), "event": what})
        while len(self._events) > RINGS:
            self._events.popitem(last=False)

    def events(self, job: int) -> list[dict]:
        return list(self._events.get(job, ()))

    def submit(self, kind: str, args: dict | None = None) -> int:
        job = self.queue.submit(kind, args)
        self.event(job, "queued")
        self._lane.submit(self.tick)
        return job

    def cancel(self, job: int) -> bool:
        """Takes a queued job out, or interrupts the running one; False where there is nothing to cancel."""
        if self.queue.cancel_queued(job):
            self.event(job, "canceled")
            return True
        found = self.queue.get(job)
        if not found or found["state"] != "running":
            return False
        self._canceled.add(job)
        if self.spark is not None:
            self.spark.interruptTag(f"job-{job}")
        self.event(job, "cancel requested")
        return True

    def tick(self) -> int | None:
        """Runs the next queued job to its end; its id."""
        job = self.queue.next_queued()
        if job is None or not self.queue.mark_running(job["id"], self.worker):
            return None
        k = job["id"]
        self.event(k, "running")

        def report(progress: dict) -> None:
            self.queue.heartbeat(k)
            self.queue.set_progress(k, progress)
            if k in self._canceled:
                raise InterruptedError("canceled")

        def tagged():
            if self.spark is not None:
                self.spark.addTag(f"job-{k}")
            try:
                return self.do(job, report)
            finally:
                if self.spark is not None:
                    self.spark.removeTag(f"job-{k}")

        with ThreadPoolExecutor(1) as one:
            running: Future = one.submit(tagged)
            try:
                state, output, error = "succeeded", running.result(self.timeout), ""
            except TimeoutError:
                self._canceled.add(k)
                if self.spark is not None:
                    self.spark.interruptTag(f"job-{k}")
                state, output, error = "failed", None, f"timed out after {self.timeout} s"
            except Exception as e:  # noqa: BLE001 - a job's failure is its result
                state, output, error = ("canceled" if k in self._canceled else "failed"), None, str(e)[:2000]
        self._canceled.discard(k)
        self.queue.finish(k, state, output, error)
        self.event(k, state)
        return k

    def drain(self) -> None:
        """Waits for the lane to be empty."""
        self._lane.submit(lambda: None).result()

    def close(self) -> None:
        self._lane.shutdown(wait=True)


class Scheduler:
    """Submits a cycle every so many seconds, unless one is queued or running."""

    def __init__(self, runner: Runner, every: float):
        self.runner, self.every, self._stop = runner, every, threading.Event()
        self._thread = threading.Thread(target=self._loop, daemon=True)

    def tick(self) -> int | None:
        q = self.runner.queue
        if q.list("queued", "cycle") or q.list("running", "cycle"):
            return None
        return self.runner.submit("cycle")

    def _loop(self) -> None:
        while not self._stop.wait(self.every):
            self.tick()

    def start(self) -> None:
        self._thread.start()

    def stop(self) -> None:
        self._stop.set()


def storage_jobs(snapshots) -> Callable[[dict, Callable[[dict], None]], dict | None]:
    """What a job does, on snapshots."""
    from datetime import datetime

    def do(job: dict, report) -> dict | None:
        kind, args = job["kind"], job["args"]
        arguments(kind, args)
        report({"phase": kind})
        if kind == "snapshot":
            return {"backup": snapshots.create(args.get("label"))}
        if kind == "cycle":
            return snapshots.cycle()
        if kind == "as-of":
            return {"rows": [r.asDict() for r in snapshots.as_of(datetime.fromisoformat(args["at"]), args["sql"]).limit(1000).collect()]}
        name = {"recover-table": snapshots.recover_table, "recover-rows": snapshots.recover_rows, "recover-column": snapshots.recover_column}[kind]
        return name(args["table"], *([args["column"]] if kind == "recover-column" else []), args.get("snapshot"))

    return do
