"""Chunked tables in Parquet, filled in transactions.

A table lies under warehouse/database/table as trans_id=.../part=.../chunkId=... folders,
a part for each contribution. A transaction is a pair of files in warehouse/database/_trans:
one made when it begins, whose name takes the id for good, and one made when it ends, whose
name says how. Readers take the rows of committed ids alone, by a partition filter, so open
and aborted transactions are invisible to every session, and no id comes twice. A region
or key is a partition filter too. Rows are dealt by chunk before they are written, which keeps
the number of files near that of the chunks; a hot chunk is spread over several files by a salt.

A child lies in the chunk of its director's row. A child without one lies by its own
position (if it has none, the contribution fails), and what the pruning of chunks must know
of that, the number of such rows and how far children lie from their directors, is kept
beside the table.
"""

from __future__ import annotations

import json
import threading
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import CHILD, DIRECTOR, MATCH, REGULAR, Catalog, Placement, TableSpec
from ..errors import AnalysisError
from ..functions import spherical as S
from ..operators import partitioning as P
from .store import Store

TRANS, PART = "trans_id", "part"
STARTED, FINISHED, ABORTED = "STARTED", "FINISHED", "ABORTED"
#: Folders of director indexes and row counters.
INDEX, COUNTERS = "_index", "_rows"
#: Ids from here on are those of streams' batches.
STREAMS = 1 << 40


@dataclass
class Transaction:
    """A unit of ingest of one database: its rows are there for good, or not at all."""

    id: int
    db: str
    state: str = STARTED


@dataclass
class Contribution:
    """Rows that were, are being, or failed to be added to a table in a transaction."""

    id: int
    trans_id: int
    db: str
    table: str
    state: str = "IN_PROGRESS"
    error: str = ""
    again: object = None  # what a retry runs
    attempt: int = 0


class Ingest:
    def __init__(self, spark: SparkSession, catalog: Catalog, warehouse: str, salt: int = 4, auto_index: bool = True):
        """auto_index: a commit also indexes the rows that it adds to directors."""
        self.spark, self.catalog, self.warehouse, self.salt, self.auto_index = spark, catalog, warehouse.rstrip("/"), salt, auto_index
        self.contributions: dict[int, Contribution] = {}
        self.store, self._lock = Store(spark), threading.Lock()
        catalog.loader, catalog.placed, catalog.beside = self._load, self._placement, self._beside

    def path(self, db: str, table: str) -> str:
        return f"{self.warehouse}/{db}/{table}"

    # ---- transactions

    def _log(self, db: str) -> str:
        return f"{self.warehouse}/{db}/_trans"

    def _states(self, log: str) -> dict[int, str]:
        """State of each transaction; one that was aborted stays so whatever else its files say."""
        out: dict[int, str] = {}
        order = (STARTED, FINISHED, ABORTED)
        for name in self.store.names(log):
            number, _, state = name.partition(".")
            if number.isdigit() and state in order:
                out[int(number)] = max(out.get(int(number), STARTED), state, key=order.index)
        return out

    def begin(self, db: str, trans_id: int | None = None) -> Transaction:
        """Open a transaction; with an id, the one of that id, which may have been opened, or ended, before."""
        self.catalog.database(db)
        log = self._log(db)
        if trans_id is not None:
            self.store.create(f"{log}/{trans_id}.{STARTED}")
            return Transaction(trans_id, db, self._states(log)[trans_id])
        number = max((n for n in self._states(log) if n < STREAMS), default=0) + 1
        while not self.store.create(f"{log}/{number}.{STARTED}"):
            number += 1
        return Transaction(number, db)

    def transaction(self, db: str, trans_id: int) -> Transaction:
        """A transaction of any session by its id."""
        states = self._states(self._log(db))
        if trans_id not in states:
            raise AnalysisError(f"no transaction of {db} has the id {trans_id}")
        return Transaction(trans_id, db, states[trans_id])

    def transactions(self, db: str) -> DataFrame:
        """All transactions of a database with their states."""
        return self.spark.createDataFrame(sorted(self._states(self._log(db)).items()), "id long, state string")

    def commit(self, t: Transaction) -> None:
        self._open(t)
        if self.auto_index:
            for table in self.catalog.database(t.db).tables.values():
                if table.spec.role == DIRECTOR and table.path is not None and self.store.exists(f"{table.path}/{TRANS}={t.id}"):
                    self._build(table, INDEX, t.id)
        self._end(t, FINISHED)

    def abort(self, t: Transaction) -> None:
        """Delete what the transaction wrote."""
        self._end(t, ABORTED)
        for table in self.catalog.database(t.db).tables.values():
            if table.path is not None:
                self.store.delete(f"{table.path}/{TRANS}={t.id}")

    def _end(self, t: Transaction, state: str) -> None:
        with self._lock:
            self._open(t)
            self.store.create(f"{self._log(t.db)}/{t.id}.{state}")
            t.state = state

    def _open(self, t: Transaction) -> None:
        t.state = self._states(self._log(t.db)).get(t.id, ABORTED)
        if t.state != STARTED:
            raise AnalysisError(f"transaction {t.id} is {t.state}")

    # ---- tables

    def create(self, db: str, spec: TableSpec) -> None:
        """Register a table that `append` fills."""
        path = self.path(db, spec.name)
        self.catalog.register(db, spec, path)

    def _load(self, path: str, also: int | None = None) -> DataFrame:
        """Rows of the committed transactions, and of one that is open."""
        if not self.store.exists(f"{path}/_schema"):
            if self.store.exists(path):
                return self.spark.read.parquet(path)
            raise AnalysisError(f"the table at {path} has no columns yet: nothing was added to it")
        schema = T.StructType.fromJson(json.loads(self.store.read(f"{path}/_schema")))
        ids = [n for n, state in self._states(f"{path.rpartition('/')[0]}/_trans").items() if state == FINISHED or n == also]
        stored = T.StructType([*schema.fields, T.StructField(TRANS, T.LongType()), T.StructField(PART, T.LongType())])
        if "chunkId" in schema.names:  # a folder name comes last
            stored = T.StructType([*[f for f in schema.fields if f.name != "chunkId"], *stored.fields[-2:], T.StructField("chunkId", T.IntegerType())])
        df = self.spark.read.schema(stored).parquet(path)
        return df.where(F.col(TRANS).isin(sorted(ids)) if ids else F.lit(False)).drop(PART)

    def append(self, db: str, table: str, rows: DataFrame, t: Transaction, generated: dict[str, str] | None = None) -> None:
        """Rows of one contribution; generated columns are SQL expressions over the others."""
        self._append(db, table, rows, t, generated, self._number(db))

    def _append(self, db: str, table: str, rows: DataFrame, t: Transaction, generated: dict[str, str] | None, part: int) -> None:
        self._open(t)
        entry = self.catalog.table(table, db)
        spec = entry.spec
        for name, expression in (generated or {}).items():
            rows = rows.withColumn(name, F.expr(expression))
        chunker = self.catalog.database(db).chunker
        seen = None
        if spec.role == DIRECTOR:
            rows = P.locate(rows, chunker, spec.lon, spec.lat)
        elif spec.role == CHILD:
            rows, seen = self._placed(rows, spec, self._index(db, spec.director, t), chunker)
        elif spec.role == MATCH and "chunkId" not in rows.columns:
            rows = P.matches_by_index(rows, spec.key, self._index(db, spec.director, t), spec.key2, self._index(db, spec.director2, t))
        self._write(rows, entry, t, part, seen)

    def _index(self, db: str, director: str, t: Transaction) -> DataFrame:
        """(key, chunkId, subChunkId, lon, lat) of a director, one row for each key, the open transaction's rows included."""
        entry = self.catalog.table(director, db)
        spec = entry.spec
        df = self._load(entry.path, t.id) if entry.path is not None else entry.df
        df = df if "chunkId" in df.columns else P.locate(df, self.catalog.database(db).chunker, spec.lon, spec.lat)
        at = F.struct("chunkId", "subChunkId", F.col(spec.lon).cast("double").alias("lon"), F.col(spec.lat).cast("double").alias("lat"))
        return df.where(F.col(spec.key).isNotNull()).groupBy(F.col(spec.key).alias("key")).agg(F.min(at).alias("at")).select("key", "at.*")

    @staticmethod
    def _placed(rows: DataFrame, spec: TableSpec, index: DataFrame, chunker) -> tuple[DataFrame, Observation]:
        """Children with the cells of their directors, or of their own position where there is none, and what was seen on the way."""
        names = [c for c in rows.columns if c not in ("chunkId", "subChunkId")]
        at = index.select(*[F.col(c).alias(f"_at_{c}") for c in index.columns])
        df = rows.join(at, F.col(spec.key) == F.col("_at_key"), "left")
        lone = F.col("_at_key").isNull()
        if spec.lon and spec.lat:
            lon, lat = F.col(spec.lon).cast("double"), F.col(spec.lat).cast("double")
            chunk, sub = chunker.columns(lon, lat)
            far = F.max(S.ang_sep(lon, lat, F.col("_at_lon"), F.col("_at_lat")))
        else:
            chunk = sub = F.lit(None).cast("int")
            far = F.lit(0.0)
        failed = F.raise_error(F.concat(F.lit(f"{spec.name}: no director and no position for the key "), F.coalesce(F.col(spec.key).cast("string"), F.lit("NULL")))).cast("int")
        seen = Observation(f"placed-{spec.name}")
        df = df.select(*[F.col(f"`{c}`") for c in names], F.coalesce("_at_chunkId", chunk, failed).alias("chunkId"), F.coalesce("_at_subChunkId", sub).alias("subChunkId"), *[F.col(f"_at_{c}") for c in ("key", "lon", "lat")])
        return df.observe(seen, F.count(F.when(lone, 1)).alias("orphans"), F.coalesce(far, F.lit(0.0)).alias("reach")).drop("_at_key", "_at_lon", "_at_lat"), seen

    def _placement(self, path: str | None) -> Placement:
        """How a child table's rows lie, over all its contributions; those since aborted only make it more careful."""
        out = Placement()
        for name in self.store.names(f"{path}/_placement") if path else []:
            _, orphans, reach = name.split("_")
            out = Placement(out.orphans + int(orphans), max(out.reach, float.fromhex(reach)))
        return out

    def _write(self, rows: DataFrame, entry, t: Transaction, part: int, seen: Observation | None) -> None:
        """Write a contribution to its own folder; what an attempt before left there goes."""
        if not self.store.exists(f"{entry.path}/_schema"):
            self.store.create(f"{entry.path}/_schema", rows.schema.json())
        schema = T.StructType.fromJson(json.loads(self.store.read(f"{entry.path}/_schema")))
        if {f.name for f in schema} != set(rows.columns):
            raise AnalysisError(f"{entry.spec.name} has the columns {', '.join(schema.names)}, not {', '.join(rows.columns)}")
        rows = rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema])
        target = f"{entry.path}/{TRANS}={t.id}/{PART}={part}"
        if entry.spec.role == REGULAR:
            rows.write.mode("overwrite").parquet(target)
        else:
            salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns if c != "chunkId"][:4]), F.lit(self.salt))
            rows.repartition("chunkId", salt).write.mode("overwrite").partitionBy("chunkId").parquet(target)
        if seen is not None and (found := seen.get) and (found["orphans"] or found["reach"]):
            self.store.create(f"{entry.path}/_placement/{t.id}-{part}_{found['orphans']}_{float(found['reach']).hex()}")

    # ---- contributions

    def _number(self, db: str) -> int:
        """The next number of a contribution, taken for good."""
        folder = f"{self.warehouse}/{db}/_parts"
        number = max((int(n) for n in self.store.names(folder) if n.isdigit()), default=0) + 1
        while not self.store.create(f"{folder}/{number}"):
            number += 1
        return number

    def contribute(self, db: str, table: str, source, t: Transaction, generated: dict[str, str] | None = None, wait: bool = True) -> Contribution:
        """Add the rows of a source, a function that reads them; errors are kept with the contribution, for `retry`."""
        c = Contribution(self._number(db), t.id, db, table)
        c.again = lambda: self._append(db, table, source(), t, generated, c.id)
        self.contributions[c.id] = c
        thread = threading.Thread(target=self._contribute, args=(c,), daemon=True)
        thread.start()
        if wait:
            thread.join()
        return c

    def _contribute(self, c: Contribution) -> None:
        c.state, c.error, tag = "IN_PROGRESS", "", f"contribution-{id(self)}-{c.id}"
        sc = self.spark.sparkContext
        sc.addJobTag(tag)
        try:
            c.again()
            c.state = "FINISHED"
        except Exception as e:  # noqa: BLE001  the contribution keeps what went wrong
            c.state, c.error = ("CANCELLED" if c.state == "CANCELLED" else "FAILED"), str(e).split("\n")[0]
        finally:
            sc.removeJobTag(tag)
            c.attempt += 1
            record = {"id": c.id, "attempt": c.attempt, "trans_id": c.trans_id, "db": c.db, "table": c.table, "state": c.state, "error": c.error}
            self.store.create(f"{self.warehouse}/{c.db}/_parts/{c.id}.{c.attempt}.json", json.dumps(record))

    def retry(self, contribution: int) -> Contribution:
        """Run a failed contribution again: it writes its own folder anew, so no row comes twice."""
        c = self.contributions[contribution]
        if c.state not in ("FAILED", "CANCELLED"):
            raise AnalysisError(f"contribution {c.id} is {c.state}")
        self._contribute(c)
        return c

    def cancel(self, contribution: int) -> None:
        c = self.contributions[contribution]
        if c.state == "IN_PROGRESS":
            c.state = "CANCELLED"
            self.spark.sparkContext.cancelJobsWithTag(f"contribution-{id(self)}-{c.id}")

    def status(self, db: str | None = None) -> DataFrame:
        """All contributions of this session, and, of a database, those that other sessions have ended."""
        kind = "id long, trans_id long, db string, table string, state string, error string"
        own = self.spark.createDataFrame([(c.id, c.trans_id, c.db, c.table, c.state, c.error) for c in self.contributions.values()], kind)
        folder = f"{self.warehouse}/{db}/_parts"
        if db is None or not any(n.endswith(".json") for n in self.store.names(folder)):
            return own
        ended = self.spark.read.schema(f"{kind}, attempt int").option("pathGlobFilter", "*.json").json(folder)
        last = ended.groupBy("id").agg(*[F.max_by(c, "attempt").alias(c) for c in own.columns[1:]])
        mine = [c.id for c in self.contributions.values() if c.db == db]
        return own.where(F.col("db") == db).union(last.where(~F.col("id").isin(mine)) if mine else last)

    # ---- convenience

    def load(self, db: str, spec: TableSpec, rows: DataFrame, generated: dict[str, str] | None = None) -> None:
        """Create a table and fill it in a transaction of its own."""
        self.create(db, spec)
        t = self.begin(db)
        try:
            self.append(db, spec.name, rows, t, generated)
        except Exception:
            self.abort(t)
            self.catalog.drop_table(db, spec.name)
            raise
        self.commit(t)

    def drop(self, db: str, table: str) -> None:
        entry = self.catalog.table(table, db)
        self.catalog.drop_table(db, table)
        for path in (entry.path, self._side(entry, INDEX), self._side(entry, COUNTERS)):
            if path:
                self.store.delete(path)

    # ---- indexes and counters

    def _side(self, entry, what: str) -> str:
        return f"{self.warehouse}/{entry.db}/{what}/{entry.spec.name}"

    def _lacking(self, entry, what: str) -> list[int]:
        """Committed transactions whose rows of a table have no index or counters yet."""
        states = self._states(self._log(entry.db))
        ids = [int(n.partition("=")[2]) for n in self.store.names(entry.path) if n.startswith(f"{TRANS}=")]
        return [n for n in ids if states.get(n) == FINISHED and not self.store.exists(f"{self._side(entry, what)}/{TRANS}={n}/_SUCCESS")]

    def _build(self, entry, what: str, trans_id: int | None) -> str:
        """Write the index or counters of one transaction's rows, or of a table that is not filled in transactions."""
        df = entry.df if trans_id is None else self._load(entry.path, trans_id).where(F.col(TRANS) == trans_id)
        target = self._side(entry, what) if trans_id is None else f"{self._side(entry, what)}/{TRANS}={trans_id}"
        if what == INDEX:
            df = df if "chunkId" in df.columns else P.locate(df, self.catalog.database(entry.db).chunker, entry.spec.lon, entry.spec.lat)
            P.object_index(df, entry.spec.key).sort("key").write.mode("overwrite").parquet(target)
        else:
            key = F.col("chunkId") if "chunkId" in df.columns else F.lit(0)
            df.groupBy(key.alias("chunkId")).agg(F.count("*").alias("num_rows")).coalesce(1).write.mode("overwrite").parquet(target)
        return target

    def _managed(self, entry) -> bool:
        return entry.path is not None and self.store.exists(f"{entry.path}/_schema")

    def _make(self, entry, what: str, known: dict) -> None:
        if self._managed(entry):
            for n in self._lacking(entry, what):
                self._build(entry, what, n)
        else:
            path = self._build(entry, what, None)
            known[entry.db, entry.spec.name] = lambda: self.spark.read.parquet(path)

    def _beside(self, entry, what: str) -> DataFrame | None:
        """The index or counters of all committed rows; None where some transaction has none, in whichever session it was committed."""
        if not self._managed(entry) or not self.store.exists(side := self._side(entry, what)) or self._lacking(entry, what):
            return None
        ids = [n for n, state in self._states(self._log(entry.db)).items() if state == FINISHED]
        paths = [p for n in ids if self.store.exists(p := f"{side}/{TRANS}={n}")]
        return self.spark.read.parquet(*paths) if paths else None

    def build_director_index(self, db: str, table: str) -> None:
        """(key, chunkId, subChunkId) of a director, sorted by key so that a lookup reads few row groups; made where a commit did not make it."""
        entry = self.catalog.table(table, db)
        if entry.spec.role != DIRECTOR:
            raise AnalysisError(f"{table} is no director")
        self._make(entry, INDEX, self.catalog.indexes)

    def collect_row_counters(self, db: str, table: str) -> None:
        """(chunkId, num_rows) of a table, which COUNT(*) is answered from."""
        self._make(self.catalog.table(table, db), COUNTERS, self.catalog.counters)

    def delete_row_counters(self, db: str, table: str) -> None:
        entry = self.catalog.table(table, db)
        self.catalog.counters.pop((db, entry.spec.name), None)
        self.store.delete(self._side(entry, COUNTERS))
