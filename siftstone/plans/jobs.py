"""The facade: scan jobs, one at a time, with progress, cancelling and retention."""

from __future__ import annotations

import queue
import threading
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from siftstone.plans import scan

KEEP_SECONDS = 2 * 3600
KEEP_JOBS = 50
INLINE_BYTES = 512 * 1024


@dataclass
class Job:
    path: str
    engine: str
    id: str = field(default_factory=lambda: uuid.uuid4().hex)
    status: str = "queued"
    stage: str = ""
    progress: float = 0.0
    summary: dict | None = None
    sarif: str | None = None
    error: str | None = None
    created_at: float = field(default_factory=time.time)
    finished_at: float | None = None


class Jobs:
    """First in, first out; one job runs.  `work(job, report)` gives (summary, sarif); without one, directories are scanned."""

    def __init__(self, spark: SparkSession, work=None):
        self.spark, self.work = spark, work or scan.work(spark)
        self.jobs: dict[str, Job] = {}
        self._queue: queue.Queue[Job] = queue.Queue()
        self._lock = threading.Lock()
        threading.Thread(target=self._run, daemon=True).start()

    def scan_directory(self, path: str, engine: str = "static", rescan: bool = False, wait_seconds: float = 0) -> Job:
        """Queues a scan, or gives the last finished one of the same path and engine unless `rescan`."""
        if engine not in ("static", "ai", "both"):
            raise ValueError(f"unknown engine: {engine}")
        with self._lock:
            self._forget()
            done = [j for j in self.jobs.values() if (j.path, j.engine, j.status) == (path, engine, "done")]
            if done and not rescan:
                return done[-1]
            job = Job(path, engine)
            self.jobs[job.id] = job
        self._queue.put(job)
        until = time.time() + min(wait_seconds, 120)
        while time.time() < until and job.finished_at is None:
            time.sleep(0.05)
        return job

    def get_scan(self, job_id: str, include_sarif: bool = False) -> dict:
        """The state of a job; a large log is left to its resource."""
        job = self.jobs[job_id]
        out = {k: getattr(job, k) for k in ("id", "path", "engine", "status", "stage", "progress", "summary", "error")}
        if include_sarif and job.sarif is not None:
            out["sarif" if len(job.sarif.encode()) <= INLINE_BYTES else "resource"] = job.sarif if len(job.sarif.encode()) <= INLINE_BYTES else f"sarif://job/{job.id}"
        return out

    def cancel_scan(self, job_id: str) -> bool:
        job = self.jobs[job_id]
        if job.finished_at is not None:
            return False
        running, job.status, job.finished_at = job.status == "running", "cancelled", time.time()
        if running:
            self.spark.sparkContext.cancelJobGroup(job.id)
        return True

    def server_status(self) -> dict:
        return {"queued": sum(j.status == "queued" for j in self.jobs.values()), "running": next((j.id for j in self.jobs.values() if j.status == "running"), None), "jobs": len(self.jobs)}

    def _forget(self) -> None:
        done = sorted((j for j in self.jobs.values() if j.finished_at), key=lambda j: j.finished_at, reverse=True)
        for n, j in enumerate(done):
            if n >= KEEP_JOBS or time.time() - j.finished_at > KEEP_SECONDS:
                del self.jobs[j.id]

    def _run(self) -> None:
        while True:
            job = self._queue.get()
            if job.status != "queued":
                continue
            job.status = "running"
            self.spark.sparkContext.setJobGroup(job.id, f"scan {job.path}", interruptOnCancel=True)

            def report(stage: str, progress: float, job=job) -> None:
                job.stage, job.progress = stage, progress

            try:
                summary, log = self.work(job, report)
                if job.status == "running":
                    job.summary, job.sarif, job.status, job.progress = summary, log, "done", 1.0
            except Exception as e:  # a failed job must not end the queue
                if job.status == "running":
                    job.status, job.error = "failed", str(e)
            job.finished_at = job.finished_at or time.time()
