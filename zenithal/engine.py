"""The engine: statements of the dialect in, DataFrames out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .catalog import Catalog
from .errors import AnalysisError, EngineError, ResultTooLargeError, UnsupportedQueryError
from .functions.registry import FunctionRegistry
from .manager import INTERACTIVE_CHUNKS, QueryManager
from .plans import ast as A
from .plans.builder import Builder
from .plans.parser import parse
from .sources.ingest import Ingest


class Engine:
    """A session over a catalog.

    strict: refuse joins that a shared-nothing system could not do within partitions, and
    outer joins with a condition. ignore_case: compare strings without regard to case.
    """

    def __init__(self, spark: SparkSession, warehouse: str, db: str | None = None, strict: bool = False, ignore_case: bool = False, limit_bytes: int | None = 5001 << 20):
        self.spark, self.db, self.strict, self.ignore_case = spark, db, strict, ignore_case
        self.catalog, self.functions = Catalog(spark), FunctionRegistry()
        self.ingest = Ingest(spark, self.catalog, warehouse)
        self.manager = QueryManager(spark, f"{warehouse.rstrip('/')}/_results", limit_bytes=limit_bytes)
        self.options: dict[str, object] = {"ROW_COUNTER_OPTIMIZATION": 1, "NO_MERGE": 0}

    def use(self, db: str) -> None:
        self.catalog.database(db)
        self.db = db

    def register_function(self, name: str, build: Callable[..., Column]) -> None:
        """A scalar function of the dialect by a function of columns."""
        self.functions.register(name, build)

    # ---- statements

    def sql(self, text: str) -> DataFrame:
        """The result of any statement; commands give one row that says what they did."""
        st = parse(text)
        if st.kind == "select":
            return self._plan(st.select, text)[0]
        if st.kind == "submit":
            self._refuse_system(st.select)
            self._builder().build(st.select)  # errors in the query show now
            job = self.manager.submit(text, self.db, lambda: self._plan(st.select, text))
            return self.spark.createDataFrame([(job.id, f"result({job.id})")], "jobId long, resultLocation string")
        if st.kind == "result":
            return self.manager.result(st.arg)
        if st.kind == "result_delete":
            self.manager.delete_result(st.arg)
            return self._said(f"result of query {st.arg} deleted")
        if st.kind == "cancel":
            self.manager.cancel(st.arg)
            return self._said(f"query {st.arg}: {self.manager.job(st.arg).state}")
        if st.kind == "processlist":
            return self.manager.processlist(st.full)
        if st.kind == "columns":
            return self._columns(*st.arg)
        if st.kind == "set_global":
            return self._set(*st.arg)
        return self._said("ignored")

    def execute(self, text: str) -> DataFrame:
        """Run a statement now. A SELECT is registered like a submitted one, and its written result returned; `sql` leaves it to Spark when to run."""
        st = parse(text)
        if st.kind != "select" or self._system(st.select):
            return self.sql(text)
        return self.manager.result(self.manager.run(text, self.db, lambda: self._plan(st.select, text)).id)

    def _said(self, message: str) -> DataFrame:
        return self.spark.createDataFrame([(message,)], "message string")

    def _builder(self) -> Builder:
        return Builder(self.catalog, self.functions, self.db, self.strict, self.ignore_case)

    @staticmethod
    def _system(s: A.Select) -> str | None:
        t = s.first
        return t.name.lower() if t is not None and (t.db or "").lower() == "information_schema" else None

    def _refuse_system(self, s: A.Select) -> None:
        if self._system(s):
            raise UnsupportedQueryError("Invalid or unsupported query: information_schema can not be queried in the background")

    def _plan(self, s: A.Select, text: str) -> tuple[DataFrame, int | None]:
        """The DataFrame, and the number of chunks it reads if pruning found any."""
        if name := self._system(s):
            views = {"processlist": self.manager.processlist, "queries": self.manager.queries}
            if name not in views or s.joins:
                raise AnalysisError(f"Unknown table 'information_schema.{name}'")
            scratch = Catalog(self.spark)
            scratch.create_database("information_schema")
            from .catalog import TableSpec

            scratch.register("information_schema", TableSpec(s.first.name), views[name]())
            return Builder(scratch, self.functions, "information_schema").build(s), None
        if (df := self._counted(s)) is not None:
            return df, None
        b = self._builder()
        df = b.build(s)
        chunks = sum(len(c) for c in b.pruned.values()) if b.pruned else None
        return df, chunks

    def pool(self, text: str) -> str:
        """Scheduler pool for a query: interactive if it reads few chunks, else that of scans."""
        st = parse(text)
        chunks = self._plan(st.select, text)[1] if st.select is not None else None
        return "interactive" if chunks is not None and chunks <= INTERACTIVE_CHUNKS else "scan"

    def _counted(self, s: A.Select) -> DataFrame | None:
        """COUNT(*) of a whole table from its row counters; the column keeps the spelling of the query."""
        if not self.options["ROW_COUNTER_OPTIMIZATION"] or s.first is None or len(s.items) != 1 or s.joins or s.where is not None or s.restrictors or s.group_by or s.having is not None or s.order_by or s.distinct:
            return None
        e = s.items[0].expr
        if not (isinstance(e, A.Call) and e.name.lower() == "count" and isinstance(e.args[0], A.Star)):
            return None
        table = self.catalog.table(s.first.name, s.first.db or self.db)
        counters = self.catalog.counter(table.db, table.spec.name)
        if counters is None:
            return None
        df = counters.agg(F.coalesce(F.sum("num_rows"), F.lit(0)).alias(s.items[0].alias or s.items[0].text))
        return df.limit(s.limit) if s.limit is not None else df

    def _columns(self, ref: A.TableRef, where) -> DataFrame:
        table = self.catalog.table(ref.name, ref.db or self.db)
        rows = [(f.name, f.dataType.simpleString(), "YES" if f.nullable else "NO", "PRI" if table.spec.key and f.name.lower() == table.spec.key.lower() and table.spec.role == "director" else "", None, "") for f in table.df.schema]
        df = self.spark.createDataFrame(rows, "Field string, Type string, Null string, Key string, Default string, Extra string")
        if where is None:
            return df
        scratch = Catalog(self.spark)
        scratch.create_database("c")
        from .catalog import TableSpec

        scratch.register("c", TableSpec("columns"), df)
        item = tuple(A.SelectItem(A.ColumnRef(c), None, c) for c in df.columns)
        return Builder(scratch, self.functions, "c").build(A.Select(item, A.TableRef("columns", None, None), (), where, (), (), None, (), None, False))

    def _set(self, name: str, value) -> DataFrame:
        known = next((k for k in self.options if name == k or name.endswith("_" + k)), None)
        if known is None:
            raise UnsupportedQueryError(f"Invalid or unsupported query: unknown global variable {name}")
        self.options[known] = value
        return self._said(f"{name} = {value}")

    # ---- results

    @staticmethod
    def _as_text(df: DataFrame, binary: str) -> tuple[list[dict], DataFrame]:
        """Schema of a result, and its values as strings, which Spark makes."""
        encode = {"hex": F.hex, "b64": F.base64, "array": F.hex}[binary]
        fields = df.schema.fields
        schema = [{"table": "", "column": f.name, "type": f.dataType.simpleString(), "is_binary": int(isinstance(f.dataType, T.BinaryType))} for f in fields]
        flat = df.toDF(*[f"c{k}" for k in range(len(fields))])

        def text(k: int, f: T.StructField) -> Column:
            c = F.col(f"c{k}")
            if isinstance(f.dataType, T.BinaryType):
                return encode(c).alias(f"c{k}")
            return (c.cast("int") if isinstance(f.dataType, T.BooleanType) else c).cast("string").alias(f"c{k}")

        return schema, flat.select(*[text(k, f) for k, f in enumerate(fields)])

    def to_json(self, df: DataFrame, binary: str = "hex") -> dict:
        """The result as {schema, rows} with values as strings; binary: hex, b64 or array. More than the engine's limit of bytes is refused on the way."""
        schema, texts = self._as_text(df, binary)
        rows, size = [], 0
        for r in texts.toLocalIterator():
            rows.append([list(bytes.fromhex(v)) if v is not None and f["is_binary"] and binary == "array" else v for v, f in zip(r, schema, strict=True)])
            size += sum(len(v) for v in r if v is not None)
            if self.manager.limit_bytes is not None and size > self.manager.limit_bytes:
                raise ResultTooLargeError(f"the result has more than the {self.manager.limit_bytes} bytes that are the limit; `write_json` has none")
        return {"schema": schema, "rows": rows}

    def write_json(self, df: DataFrame, path: str, binary: str = "hex") -> list[dict]:
        """Write a result of any size as files of one JSON array of strings a row (binary: hex or b64); returns its schema."""
        schema, texts = self._as_text(df, binary)
        texts.select(F.to_json(F.array(*texts.columns)).alias("value")).write.text(path)
        return schema

    # ---- the verbs of the asynchronous interface

    def submit(self, select: str) -> int:
        return self.sql(f"SUBMIT {select}").first().jobId

    def status(self, job_id: int) -> dict:
        j = self.manager.job(job_id)
        return {"id": j.id, "state": j.state, "rows": j.rows, "bytes": j.size, "chunks": j.chunks, "message": j.message, "progress": self.manager.progress(j)}

    def result(self, job_id: int) -> DataFrame:
        return self.manager.result(job_id)

    def cancel(self, job_id: int) -> None:
        self.manager.cancel(job_id)

    def delete_result(self, job_id: int) -> None:
        self.manager.delete_result(job_id)


__all__ = ["Engine", "EngineError"]
