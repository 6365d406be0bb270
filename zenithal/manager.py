"""Queries that the engine runs: registration, progress, results, cancellation, and the views over them.

A query runs under a tag of its own, a submitted one on a thread of its own; its result is
written as Parquet, so that it outlives executors and needs no driver memory, and the query
is stopped when the files grow beyond the limit. Ids are taken for good in a log beside the
results, which also keeps how each query ended, for the sessions that come later.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .errors import AnalysisError, ResultTooLargeError
from .sources.store import Store

EXECUTING, COMPLETED, FAILED, FAILED_LR, ABORTED = "EXECUTING", "COMPLETED", "FAILED", "FAILED_LR", "ABORTED"
#: Characters of a query that the short process list shows.
SHORT = 32

#: Queries that touch no more chunks than this run in the interactive scheduler pool.
INTERACTIVE_CHUNKS = 10

_PROCESSES = "Id long, User string, Host string, db string, Command string, Time double, State string, Info string, Progress string"
_QUERIES = "ID long, TYPE string, STATE string, SUBMITTED double, COMPLETED double, ROWS long, BYTES long, CHUNKS int, MESSAGE string, QUERY string"
_NAMES = [x.split()[0] for x in _QUERIES.split(", ")]


@dataclass
class Job:
    id: int
    query: str
    db: str | None
    kind: str = "ASYNC"
    state: str = EXECUTING
    submitted: float = field(default_factory=time.time)
    completed: float | None = None
    path: str | None = None
    rows: int | None = None
    size: int | None = None
    chunks: int | None = None
    message: str = ""
    tag: str = ""
    future: object = None
    names: list[str] = field(default_factory=list)
    over: bool = False  # the result grew beyond the limit

    def row(self) -> tuple:
        return self.id, self.kind, self.state, self.submitted, self.completed, self.rows, self.size, self.chunks, self.message, self.query


class QueryManager:
    def __init__(self, spark: SparkSession, folder: str, threads: int = 8, limit_bytes: int | None = 5001 << 20):
        self.spark, self.folder, self.limit_bytes = spark, folder.rstrip("/"), limit_bytes
        self.jobs: dict[int, Job] = {}
        self.store, self._lock, self._log = Store(spark), threading.Lock(), f"{self.folder}/_log"
        self._pool = ThreadPoolExecutor(threads, thread_name_prefix="query")

    def open(self, query: str, db: str | None, kind: str) -> Job:
        with self._lock:
            number = max((int(n.partition(".")[0]) for n in self.store.names(self._log) if n[:1].isdigit()), default=0) + 1
            while not self.store.create(f"{self._log}/{number}.begun", query):
                number += 1
            job = Job(number, query, db, kind)
            job.tag = f"query-{job.id}-{uuid.uuid4().hex[:8]}"
            self.jobs[job.id] = job
        return job

    def submit(self, query: str, db: str | None, build: Callable) -> Job:
        """Run build() -> (DataFrame, number of chunks or None) in the background."""
        job = self.open(query, db, "ASYNC")
        job.future = self._pool.submit(self._run, job, build)
        return job

    def run(self, query: str, db: str | None, build: Callable) -> Job:
        """The same at once, on the caller's thread; what fails is raised, and registered too."""
        job = self.open(query, db, "SYNC")
        self._run(job, build, raises=True)
        return job

    def _run(self, job: Job, build: Callable, raises: bool = False) -> None:
        sc, path, done = self.spark.sparkContext, f"{self.folder}/result-{job.id}-{uuid.uuid4().hex[:8]}", threading.Event()
        sc.addJobTag(job.tag)
        try:
            df, job.chunks = build()
            job.names = df.columns
            if job.state != EXECUTING:
                return
            # under fair scheduling, queries of few chunks need not wait for scans
            sc.setLocalProperty("spark.scheduler.pool", "interactive" if job.chunks is not None and job.chunks <= INTERACTIVE_CHUNKS else "scan")
            if self.limit_bytes is not None:
                threading.Thread(target=self._watch, args=(job, path, done), daemon=True).start()
            df.toDF(*[f"c{k}" for k in range(len(job.names))]).write.parquet(path)
            done.set()
            job.size = self.store.size(path)
            self._check(job)
            job.rows = self.spark.read.parquet(path).count()
            job.path = path
            self._end(job, COMPLETED)
        except Exception as e:  # noqa: BLE001  the job keeps what went wrong
            done.set()
            self.store.delete(path)
            if job.over:
                e = ResultTooLargeError(f"the result has more than the {self.limit_bytes} bytes that are the limit")
            self._end(job, FAILED_LR if job.over else FAILED, str(e).split("\n")[0])
            if raises:
                raise e
        finally:
            sc.setLocalProperty("spark.scheduler.pool", None)
            sc.removeJobTag(job.tag)

    def _check(self, job: Job) -> None:
        if self.limit_bytes is not None and job.size > self.limit_bytes:
            job.over = True
            raise ResultTooLargeError(f"the result has {job.size} bytes, the limit is {self.limit_bytes}")

    def _watch(self, job: Job, path: str, done: threading.Event) -> None:
        """Stop a query whose files have grown beyond the limit, finished or not."""
        while not done.wait(1.0):
            try:
                if self.store.size(path) > self.limit_bytes:
                    job.over = True
                    self.spark.sparkContext.cancelJobsWithTag(job.tag)
            except Exception:  # noqa: BLE001  files move while they are counted
                continue

    def _end(self, job: Job, state: str, message: str = "") -> None:
        with self._lock:
            if job.state != EXECUTING:
                return
            job.state, job.completed, job.message = state, time.time(), message
        self.store.create(f"{self._log}/{job.id}.json", json.dumps(dict(zip(_NAMES, job.row(), strict=True))))

    def job(self, job_id: int) -> Job:
        if job_id not in self.jobs:
            raise AnalysisError(f"no query has the id {job_id}")
        return self.jobs[job_id]

    def wait(self, job_id: int, timeout: float | None = None) -> Job:
        job = self.job(job_id)
        if job.future is not None:
            job.future.result(timeout)
        return job

    def result(self, job_id: int) -> DataFrame:
        job = self.job(job_id)
        if job.state != COMPLETED or job.path is None:
            raise AnalysisError(f"query {job_id} has no result: it is {job.state}" + (f" ({job.message})" if job.message else ""))
        return self.spark.read.parquet(job.path).toDF(*job.names)

    def delete_result(self, job_id: int) -> None:
        job = self.job(job_id)
        if job.path:
            self.store.delete(job.path)
            job.path = None

    def cancel(self, job_id: int) -> None:
        """Stop a query that runs; one that has ended stays as it is."""
        job = self.job(job_id)
        self._end(job, ABORTED, "cancelled")
        if job.state == ABORTED:
            threading.Thread(target=self._interrupt, args=(job,), daemon=True).start()

    def _interrupt(self, job: Job) -> None:
        """Interrupt what runs under the tag until the query's thread has ended: its next Spark job may not have begun yet."""
        while job.future is not None and not job.future.done():
            self.spark.sparkContext.cancelJobsWithTag(job.tag)
            time.sleep(0.5)

    def progress(self, job: Job) -> str:
        """Tasks done and in all of the stages that now run under the query's tag."""
        tracker = self.spark.sparkContext.statusTracker()
        done = total = 0
        for j in tracker.getJobIdsForTag(job.tag) if hasattr(tracker, "getJobIdsForTag") else tracker.getActiveJobsIds():
            info = tracker.getJobInfo(j)
            for s in info.stageIds if info else []:
                if stage := tracker.getStageInfo(s):
                    done, total = done + stage.numCompletedTasks, total + stage.numTasks
        return f"{done}/{total}" if job.state == EXECUTING else ""

    def processlist(self, full: bool = True) -> DataFrame:
        now = time.time()
        rows = [(j.id, "anonymous", "localhost", j.db, f"{j.kind}: query", now - j.submitted, j.state, j.query if full else j.query[:SHORT], self.progress(j)) for j in list(self.jobs.values()) if j.state == EXECUTING]
        return self.spark.createDataFrame(rows, _PROCESSES)

    def queries(self) -> DataFrame:
        """All queries: those of this session, and those that other sessions of the same folder have ended."""
        own = self.spark.createDataFrame([j.row() for j in list(self.jobs.values())], _QUERIES)
        if not any(n.endswith(".json") and int(n.partition(".")[0]) not in self.jobs for n in self.store.names(self._log)):
            return own
        kept = self.spark.read.schema(_QUERIES).option("pathGlobFilter", "*.json").json(self._log)
        return own.union(kept.join(own.select("ID"), "ID", "left_anti").select(*own.columns))
