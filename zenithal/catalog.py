"""Databases, tables and their roles."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .errors import AnalysisError
from .operators.chunker import Chunker

REGULAR, DIRECTOR, CHILD, MATCH = "regular", "director", "child", "match"
CHUNK, SUB_CHUNK = "chunkId", "subChunkId"


@dataclass(frozen=True)
class Striping:
    """Two-level partitioning of the sphere that the tables of a database share; overlap in degrees."""

    stripes: int = 85
    sub_stripes: int = 12
    overlap: float = 0.01667
    partitioning_id: int = 0


@dataclass(frozen=True)
class TableSpec:
    """Role of a table and the columns that it rests on.

    A director has a key and a position. A child has the key of its director. A match
    table has the keys of two directors, flags, and the largest separation of its pairs.
    """

    name: str
    role: str = REGULAR
    key: str | None = None
    lon: str | None = None
    lat: str | None = None
    director: str | None = None
    director2: str | None = None
    key2: str | None = None
    flag: str | None = None
    ang_sep: float | None = None
    unique_key: bool = True
    scan_rating: int = 0
    lock_in_memory: bool = False

    @property
    def partitioned(self) -> bool:
        return self.role != REGULAR

    @property
    def chunk_level(self) -> int:
        """0: whole, 1: by chunk, 2: by sub-chunk."""
        return 0 if not self.partitioned else 2 if self.role == DIRECTOR else 1

    def check(self) -> None:
        need = {DIRECTOR: ("key", "lon", "lat"), CHILD: ("key", "director"), MATCH: ("key", "director", "key2", "director2", "flag")}.get(self.role, ())
        if self.role not in (REGULAR, DIRECTOR, CHILD, MATCH) or any(getattr(self, k) is None for k in need):
            raise AnalysisError(f"table {self.name}: a {self.role} table needs {', '.join(need) or 'a known role'}")


@dataclass(frozen=True)
class Placement:
    """How rows of a child table lie: without a director, and at most so far (degrees) from it."""

    orphans: int = 0
    reach: float = 0.0


@dataclass
class Table:
    """A registered table: its spec and where its rows come from."""

    db: str
    spec: TableSpec
    load: Callable[[], DataFrame]
    path: str | None = None

    @property
    def df(self) -> DataFrame:
        return self.load()


@dataclass
class Database:
    name: str
    striping: Striping
    published: bool = True
    tables: dict[str, Table] = field(default_factory=dict)
    _chunker: Chunker | None = None

    @property
    def chunker(self) -> Chunker:
        if self._chunker is None:
            self._chunker = Chunker(self.striping.stripes, self.striping.sub_stripes, self.striping.overlap)
        return self._chunker


class Catalog:
    """All databases of a session, with director indexes and row counters."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.databases: dict[str, Database] = {}
        self.indexes: dict[tuple[str, str], Callable[[], DataFrame]] = {}
        self.counters: dict[tuple[str, str], Callable[[], DataFrame]] = {}
        #: How the table at a path is read, and how its rows lie.
        self.loader: Callable[[str], DataFrame] = spark.read.parquet
        self.placed: Callable[[str | None], Placement] = lambda path: Placement()
        self.beside: Callable[[Table, str], DataFrame | None] = lambda table, what: None

    def create_database(self, name: str, striping: Striping | None = None, published: bool = True) -> Database:
        if name in self.databases:
            raise AnalysisError(f"database {name} exists")
        self.databases[name] = Database(name, striping or Striping(), published)
        return self.databases[name]

    def drop_database(self, name: str) -> None:
        for t in list(self.database(name).tables):
            self.drop_table(name, t)
        del self.databases[name]

    def publish(self, name: str, published: bool = True) -> None:
        self.database(name).published = published

    def database(self, name: str) -> Database:
        if name not in self.databases:
            raise AnalysisError(f"Unknown database '{name}'")
        return self.databases[name]

    def family(self, name: str) -> list[str]:
        """Databases that share the partitioning of this one."""
        of = self.database(name).striping
        return [d.name for d in self.databases.values() if (d.striping.stripes, d.striping.sub_stripes, d.striping.partitioning_id) == (of.stripes, of.sub_stripes, of.partitioning_id)]

    def register(self, db: str, spec: TableSpec, source: DataFrame | str | Callable[[], DataFrame]) -> Table:
        """Register a table by a DataFrame, a Parquet path, or a function that gives the DataFrame."""
        spec.check()
        d = self.database(db)
        for director in filter(None, (spec.director, spec.director2)):
            if self.table(director, db).spec.role != DIRECTOR:
                raise AnalysisError(f"{director} is no director")
        path = source if isinstance(source, str) else None
        load = (lambda: self.loader(path)) if path else source if callable(source) else (lambda: source)
        d.tables[spec.name] = Table(db, spec, load, path)
        return d.tables[spec.name]

    def drop_table(self, db: str, name: str) -> None:
        self.table(name, db)
        del self.database(db).tables[name]
        self.indexes.pop((db, name), None)
        self.counters.pop((db, name), None)

    def table(self, name: str, db: str | None) -> Table:
        if db is None:
            raise AnalysisError(f"no database is named for table '{name}'")
        d = self.database(db)
        if name in d.tables:
            return d.tables[name]
        found = [t for k, t in d.tables.items() if k.lower() == name.lower()]
        if len(found) != 1:
            raise AnalysisError(f"Unknown table '{db}.{name}'")
        return found[0]

    def index(self, db: str, name: str) -> DataFrame | None:
        """(key, chunkId, subChunkId) of a director, if it is indexed."""
        own = self.indexes.get((db, name))
        return own() if own else self.beside(self.table(name, db), "_index")

    def counter(self, db: str, name: str) -> DataFrame | None:
        """(chunkId, num_rows) of a table, if its rows are counted."""
        own = self.counters.get((db, name))
        return own() if own else self.beside(self.table(name, db), "_rows")

    def save(self, path: str) -> None:
        """Write the metadata of tables that lie at a path as JSON."""
        dbs = [{"name": d.name, "striping": asdict(d.striping), "published": d.published, "tables": [{"spec": asdict(t.spec), "path": t.path} for t in d.tables.values() if t.path]} for d in self.databases.values()]
        self.spark.createDataFrame([(json.dumps({"databases": dbs}),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    def open(self, path: str) -> None:
        """Register what `save` wrote."""
        meta = json.loads("".join(r.value for r in self.spark.read.text(path).collect()))
        for d in meta["databases"]:
            self.create_database(d["name"], Striping(**d["striping"]), d["published"])
            for t in sorted(d["tables"], key=lambda t: t["spec"]["role"] != DIRECTOR):
                self.register(d["name"], TableSpec(**t["spec"]), t["path"])
