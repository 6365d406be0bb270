"""What the text and vector operators share: batches, folders, word kernels, components."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that go to Python at once. Texts are a few KB each, so a batch is a few MB.
BATCH_ROWS = 512
#: Bytes of text that a numpy kernel expands to 8-byte words at once.
SLICE_BYTES = 1 << 18
#: Links that one file of a table of links holds, and the files that it may have however few they are.
LINKS_A_FILE, FILES = 1 << 16, 8
#: Bytes of batches after which a Python worker gives free memory back.
RELEASE_BYTES = 1 << 20

_U64 = np.uint64


def ship(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python workers, once for each context."""
    sc = spark.sparkContext
    if getattr(sc, "_package_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    held = tempfile.TemporaryDirectory()
    with zipfile.ZipFile(path := f"{held.name}/{top.name}.zip", "w") as out:
        for p in sorted(top.rglob("*.py")):
            out.write(p, p.relative_to(top.parent))
    sc.addPyFile(path)
    sc._package_shipped = held  # the driver serves the file as long as the context lives


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keep Arrow batches small enough for texts of any usual length."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows or int(spark.conf.get(key, "10000")) <= 0:
        spark.conf.set(key, str(rows))


def release() -> None:
    """Give this process's free memory back to the system: Arrow's pool and, with glibc, the heap."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function of batches, which gives free memory back as batches pass and at its end: its worker stays for other tasks."""

    def passing(batches):
        passed = 0
        for batch in batches:
            if (passed := passed + batch.nbytes) >= RELEASE_BYTES:
                release()
                passed = 0
            yield batch

    def each(batches):
        try:
            yield from run(passing(batches))
        finally:
            release()

    return each


def frequent_values(held: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """The values that some arrays have `least` times in all (two at least), in order, and how often. Empties the list, so that one copy is sorted in place."""
    x = np.concatenate(held) if held else np.zeros(0, _U64)
    held.clear()
    x.sort()
    values = np.unique(x[: max(len(x) - least + 1, 0)][x[least - 1 :] == x[: max(len(x) - least + 1, 0)]])
    return values, np.searchsorted(x, values, "right") - np.searchsorted(x, values)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; an own one only where none is named and all runs on this machine."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        have = sc._jsc.sc().getCheckpointDir()
        if not have.isDefined() and not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir names no folder that the driver and the executors share")
        folder = have.get() if have.isDefined() else f"{tempfile.gettempdir()}/checkpoints"
        if not have.isDefined():
            sc.setCheckpointDir(folder)
    return folder


class Kept:
    """A table written to the shared folder: cuts lineage and survives lost executors."""

    def __init__(self, df: DataFrame, what: str, by: list[str] | None = None):
        self.spark = df.sparkSession
        self.path = f"{shared_folder(self.spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
        # shuffle files go when the table stands: nothing reads them again
        clean, conf = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", self.spark.conf
        before = conf.get(clean, "false")
        conf.set(clean, "true")
        try:
            (df.write.partitionBy(*by) if by else df.write).option("compression", "zstd").parquet(self.path)
        finally:
            conf.set(clean, before)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        atexit.register(self.drop)

    def drop(self) -> None:
        """Delete the files; to be called when nothing reads them any more."""
        atexit.unregister(self.drop)
        try:
            jvm, conf = self.spark._jvm, self.spark._jsparkSession.sessionState().newHadoopConf()
            path = jvm.org.apache.hadoop.fs.Path(self.path)
            path.getFileSystem(conf).delete(path, True)
        except Exception:  # noqa: BLE001  the session may have ended, and its folder with it
            pass


def fresh(columns: list[str], name: str) -> str:
    """A name like this one that no column has, whatever its case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- text as flat bytes


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n + 1 offsets of a string column; null is empty."""
    col = col.cast(pa.large_string()).fill_null("") if col.null_count or col.type != pa.large_string() else col
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, np.int64)[col.offset : col.offset + len(col) + 1]
    if data is None or len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


#: Space and the control characters 9 to 13 part words.
_SEPARATES = np.zeros(256, bool)
_SEPARATES[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words, and the index of the first word of each text (n + 1)."""
    inside = ~_SEPARATES[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cuts = offsets[:-1]
    cuts = cuts[cuts < len(data)]
    begins[cuts] = inside[cuts]  # a text starts a word of its own
    starts = np.flatnonzero(begins)
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | begins[1:]
    ends = np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x.astype(_U64, copy=True)
    x ^= x >> _U64(30)
    x *= _U64(0xBF58476D1CE4E5B9)
    x ^= x >> _U64(27)
    x *= _U64(0x94D049BB133111EB)
    x ^= x >> _U64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=_U64) * _U64(0x9E3779B97F4A7C15)) | _U64(1)
_BASE = _U64(0x9E3779B97F4A7C15)
_POWERS = np.ones(64, _U64)
_POWERS[1:] = _BASE
_POWERS = np.multiply.accumulate(_POWERS)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, in slices of bounded size."""
    global _POWERS
    out = np.zeros(len(starts), _U64)
    lens = ends - starts
    if not len(starts):
        return out
    if (longest := int(lens.max())) > len(_POWERS):
        more = np.full(longest, _BASE, _U64)
        more[0] = 1
        _POWERS = np.multiply.accumulate(more)
    total = np.cumsum(lens)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + SLICE_BYTES, "right")))
        n = lens[at:to]
        first = np.cumsum(n) - n
        inner = np.arange(int(n.sum())) - np.repeat(first, n)
        values = _BYTE[data[np.repeat(starts[at:to], n) + inner]] * _POWERS[inner]
        out[at:to] = np.add.reduceat(values, first)
        at = to
    return mix(out ^ (lens.astype(_U64) << _U64(56)))


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every run of n words in one flat array (runs may cross texts)."""
    if len(words) < n:
        return np.zeros(0, _U64)
    out = np.zeros(len(words) - n + 1, _U64)
    for k in range(n):
        out = mix(out * _U64(3) + words[k : len(words) - n + 1 + k])
    return out


_ROLL = _U64(0xD1342543DE82EF95)
_UNROLL = _U64(pow(0xD1342543DE82EF95, -1, 1 << 64))


_ROLLS: tuple[np.ndarray, np.ndarray] | None = None


def _rolls(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of an odd number, and of its inverse."""
    global _ROLLS
    if _ROLLS is None or len(_ROLLS[0]) < n:
        _ROLLS = tuple(np.multiply.accumulate(np.append(np.ones(1, _U64), np.full(max(n, 1 << 16), x))) for x in (_ROLL, _UNROLL))
    return _ROLLS


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every run of n words by prefix sums; for long windows."""
    if len(words) < n:
        return np.zeros(0, _U64)
    power, back = (x[: len(words)] for x in _rolls(len(words)))
    sums = np.zeros(len(words) + 1, _U64)
    np.cumsum(words * power, out=sums[1:])
    # each window's sum, brought back to the exponent 0
    return mix((sums[n:] - sums[:-n]) * back[: len(words) - n + 1])


# ---------------------------------------------------------------- groups by key


def shared_keys(rows: DataFrame, parts: int) -> DataFrame:
    """The rows (key, doc_id, ...) whose key different documents have, with the leader: the key's smallest doc_id.

    One shuffle by key and a sort; the sorted runs stream through, so that no group is
    held in memory but for the rows of one document.
    """
    sorted_rows = rows.repartition(parts, "key").sortWithinPartitions("key", "doc_id")

    def run(batches):
        last = leader = None  # key of the open run and its first document
        pending: list[pa.RecordBatch] | None = []  # its rows while they are of one document; None once there are others

        def led(batch, by):
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(by, pa.int64())], [*batch.schema.names, "leader"])

        for batch in batches:
            if not (n := len(batch)):
                continue
            key, doc = (batch.column(k).to_numpy() for k in (0, 1))
            begins = np.ones(n, bool)
            begins[1:] = key[1:] != key[:-1]
            begins[0] = key[0] != last
            start = np.flatnonzero(begins)
            at = int(start[0]) if len(start) else n
            if at:  # rows that continue the open run
                if pending is not None and doc[at - 1] != leader:
                    yield from (led(p, np.full(len(p), leader)) for p in pending)
                    pending = None
                if pending is None:
                    yield led(batch.slice(0, at), np.full(at, leader))
                else:
                    pending.append(batch.slice(0, at))
            if len(start):
                stop = np.append(start[1:], n)
                size = stop - start
                several = doc[start] != doc[stop - 1]
                lead = np.repeat(doc[start], size)
                keep = np.repeat(several, size)
                mask = pa.array(keep)
                yield led(batch.slice(at).filter(mask), lead[keep])
                last, leader = key[-1], int(doc[start[-1]])
                pending = None if several[-1] else [batch.slice(int(start[-1]))]

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return sorted_rows.mapInArrow(lean(run), kinds + ", leader long")


# ---------------------------------------------------------------- components


def files_of(links: int) -> int:
    """Files for a table of so many links: on local disks each one's permissions take helper processes of the executor."""
    return max(FILES, -(-links // LINKS_A_FILE))


def connected_components(edges: DataFrame, what: str = "components") -> Kept:
    """Smallest id that links reach from each id, as (id, component), for ids that have links.

    edges: long columns a and b, any order, repeats allowed. Alternates the
    large-star and small-star steps; each round is written to the shared folder,
    and joins are by key, so that no task gathers a component. It ends when the links
    are stars: each u (the larger id) has one v, and no v has a smaller one.
    """
    now = Kept(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().coalesce(files_of(edges.count())), what)
    while True:  # the number of rounds is logarithmic
        links, larger = now.df.agg(F.count("*"), F.count_distinct("u")).first()
        files = files_of(links)
        if links == larger and now.df.join(now.df.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty():
            break
        both = now.df.union(now.df.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        step = Kept(large.coalesce(files), what)
        least = step.df.groupBy("u").agg(F.min("v").alias("m"))
        small = step.df.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least).where("u <> v").distinct()
        after = Kept(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).coalesce(files), what)
        step.drop()
        now.drop()
        now = after
    out = now.df.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.df.select("v", "v").distinct())
    out = Kept(out.coalesce(files), what)
    now.drop()
    return out
