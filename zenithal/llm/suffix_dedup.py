"""Repeated passages by a sparse suffix array.

A suffix begins at a word. Of all suffixes only those are kept that begin at a
minimiser: the smallest hash of K words among the starts of some window, which the
content alone selects, so that each passage of `length` words holds one, at the same
place wherever it stands (K = length - window + 1). A first sort of the kept suffixes by
the hash of their first K words tells which stand in different documents. Those are then
sorted as text, by the words after the first K, and neighbours compared word by word; a
second sort by the words before them, from the nearest to the farthest, does the same on
the left. So each match is extended left and right: the runs of `length` words around two
suffixes are equal where their common words on both sides reach far enough, and the
document with the smallest id leads such runs. A word is repeated when it lies in a run
of `length` words that another document has too; runs that touch join to spans.

Suffixes whose first K words are frequent within some task (a bounded list), and sorted
runs of more than RUN suffixes, are not compared in one place. Of those with all their words
in common the first and the last document are taken within each task first; the runs of
words around what is left meet by hash, and the leaders come back to the suffixes: by a broadcast
where there are at most AROUND of them, else by a join whose skewed keys Spark splits. So no key
is one task's work however many documents share it.

Nulls and edges: null and empty texts, and texts of fewer words than `length`, have no
repeats; repeats inside one document alone don't count; the first document is the one
with the smallest id; a null id takes no part; rows that share an id count as one
document, whose spans are those of all its rows; words are compared by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Kept, flat, frequent_values, lean, mix, shared_keys, small_batches, window_hashes, word_bounds, word_hashes

#: First words that are known to be repeated without a sort; a bound on what is broadcast.
HEAVY = 1 << 16
#: Suffixes that are compared in one place; those of longer runs go by hash.
RUN = 1 << 15
#: Suffixes that are compared at once.
TOGETHER = 1 << 12
#: Different surroundings of frequent suffixes, of some 300 bytes each, up to which they are broadcast.
AROUND = 1 << 16

def _least(x: np.ndarray, w: int) -> np.ndarray:
    """Place of the leftmost smallest value of each window of w values."""
    at, size = np.arange(len(x)), 1
    while size < w:
        step = min(size, w - size)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(x[left] <= x[right], left, right)
        size += step
    return at


class Runs:
    """Runs of `length` words of some texts, with the K-word hash at the minimiser of each."""

    def __init__(self, col: pa.Array, length: int, window: int):
        data, offsets = flat(col)
        starts, ends, first = word_bounds(data, offsets)
        self.words, self.length, self.window, self.first = word_hashes(data, starts, ends), length, window, first
        count = np.maximum(np.diff(first) - length + 1, 0)
        self.doc = np.repeat(np.arange(len(count)), count)
        self.start = np.arange(len(self.doc)) - np.repeat(np.cumsum(count) - count, count)  # word of the text
        self.flat_start = self.start + first[:-1][self.doc]
        self.at = self.head = np.zeros(0, np.int64)
        if len(self.doc):
            heads = window_hashes(self.words, length - window + 1)
            self.at = _least(mix(heads), window)[self.flat_start]
            self.head = heads[self.at]
        # windows with one minimiser lie side by side
        self.new = np.ones(len(self.doc), bool)
        self.new[1:] = (self.at[1:] != self.at[:-1]) | (self.doc[1:] != self.doc[:-1])

    def heads(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, head)."""
        doc, head = self.doc[self.new], self.head[self.new]
        order = np.lexsort((head, doc))
        doc, head = doc[order], head[order]
        new = np.ones(len(doc), bool)
        new[1:] = (head[1:] != head[:-1]) | (doc[1:] != doc[:-1])
        return doc[new], head[new]

    def suffixes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, head, flat place, lo, hi) of the kept suffixes: runs that begin lo to hi words before one have it as their minimiser."""
        begin = np.flatnonzero(self.new)
        last = np.append(begin[1:], len(self.new)) - 1 if len(begin) else begin
        at = self.at[begin]
        return self.doc[begin], self.head[begin], at, at - self.flat_start[last], at - self.flat_start[begin]

    def sides(self, at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[pa.Array, pa.Array]:
        """The words after the first K, and those before the suffix from the nearest on, as far as its runs reach; big-endian, so that bytes sort as words do."""
        k, most = self.length - self.window + 1, self.window - 1
        out = []
        for begin, size, step in ((at + k, most - lo, 1), (at - 1, hi, -1)):
            cuts = np.concatenate([[0], np.cumsum(size)])
            inner = np.arange(cuts[-1]) - np.repeat(cuts[:-1], size)
            words = self.words[np.repeat(begin, size) + step * inner].astype(">u8")
            out.append(pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer((8 * cuts).astype(np.int32)), pa.py_buffer(words.tobytes())]))
        return tuple(out)


def _heads(texts: DataFrame, length: int, window: int) -> Kept:
    """(key, doc_id) of the sparse suffixes; and (key, null, docs) of keys frequent within a task."""

    def run(batches):
        held, docs, size = [], 0, 0

        def frequent():
            h, c = frequent_values(held, max(8, docs // 200))
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.nulls(len(h), pa.int64()), pa.array(c)], ["key", "doc_id", "docs"])

        for batch in batches:
            doc, head = Runs(batch.column(1), length, window).heads()
            yield pa.RecordBatch.from_arrays([pa.array(head.view(np.int64)), batch.column(0).take(pa.array(doc)), pa.nulls(len(doc), pa.int64())], ["key", "doc_id", "docs"])
            held.append(head)
            docs, size = docs + len(batch), size + len(head)
            if size >= 1 << 21:
                yield frequent()
                docs, size = 0, 0
        yield frequent()

    return Kept(texts.mapInArrow(lean(run), "key long, doc_id long, docs long"), "heads")


_SUFFIX = "key long, after binary, before binary, doc_id long, start int, stop int"


def _matches(texts: DataFrame, length: int, window: int, known: np.ndarray) -> Kept:
    """The suffixes of texts (doc_id, text, keys) whose heads are known or among the keys: head, words on both sides, doc_id, first and last start of their runs; and whether the head is known."""
    shared = texts.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        for batch in batches:
            runs = Runs(batch.column(1), length, window)
            doc, head, at, lo, hi = runs.suffixes()
            hot = _among(head, shared.value)
            keys = batch.column(2)
            own = np.repeat(np.arange(len(batch)), keys.value_lengths().fill_null(0).to_numpy())
            wanted = keys.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            # pairs (text, key) as one sorted array of hashes
            pairs = np.sort(mix(wanted ^ mix(own.astype(np.uint64))))
            some = np.flatnonzero(hot | _among(mix(head ^ mix(doc.astype(np.uint64))), pairs))
            doc, head, at, lo, hi, hot = (x[some] for x in (doc, head, at, lo, hi, hot))
            base = at - runs.first[:-1][doc]  # the suffix's word of its text
            after, before = runs.sides(at, lo, hi)
            yield pa.RecordBatch.from_arrays([pa.array(head.view(np.int64)), after, before, batch.column(0).take(pa.array(doc)), *(pa.array((base - x).astype(np.int32)) for x in (hi, lo)), pa.array(hot)], ["key", "after", "before", "doc_id", "start", "stop", "hot"])

    return Kept(texts.mapInArrow(lean(run), _SUFFIX + ", hot boolean"), "matches")


def _among(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    if not len(of):
        return np.zeros(len(x), bool)
    return of[np.minimum(np.searchsorted(of, x), len(of) - 1)] == x


def _padded(col: pa.Array, width: int) -> np.ndarray:
    """Words of a binary column (rows x width), zeros behind the shorter ones."""
    size = pc.binary_length(col).to_numpy(zero_copy_only=False).astype(np.int64) // 8
    out = np.zeros((len(col), width), np.uint64)
    words = np.frombuffer(b"".join(col.to_pylist()), ">u8")
    place = np.arange(len(words)) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(np.arange(len(col)), size), place] = words
    return out


def _common(words: np.ndarray, new: np.ndarray) -> np.ndarray:
    """How many words each row has in common with the one before it; -1 where a new run begins."""
    out = np.full(len(words), -1)
    out[1:] = np.cumprod(words[1:] == words[:-1], axis=1).sum(1)
    out[new] = -1
    return out


def compare(key: np.ndarray, doc: np.ndarray, lo: np.ndarray, hi: np.ndarray, after: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes x places) the smallest document, and whether there are others, of the run that begins so many words before each suffix.

    The suffixes are whole runs of one key, sorted by it and by the words after.
    """
    n, most = after.shape
    new = np.append(True, key[1:] != key[:-1])
    run, right = np.cumsum(new), _common(after, new)
    order = np.lexsort((before.astype(">u8").view(f"S{8 * most}").ravel(), run))
    left = _common(before[order], new)
    leader, several = np.zeros((n, most + 1), np.int64), np.zeros((n, most + 1), bool)
    group = np.empty(n, np.int64)
    for o in range(most + 1):  # o words in common on the left, and the others on the right
        rows = np.flatnonzero((lo <= o) & (o <= hi))
        if not len(rows):
            continue
        group[order] = np.cumsum(left < o)
        both = np.cumsum(right < most - o)[rows] * (n + 1) + group[rows]
        by = np.lexsort((doc[rows], both))
        d, first = doc[rows][by], np.flatnonzero(np.append(True, np.diff(both[by]) != 0))
        size = np.diff(np.append(first, len(d)))
        leader[rows[by], o] = np.repeat(d[first], size)
        several[rows[by], o] = np.repeat(d[first] != d[first + size - 1], size)
    return leader, several


_RUNS = "doc_id long, start int, stop int, leader long"


def _intervals(doc: np.ndarray, row: np.ndarray, at: np.ndarray, leader: np.ndarray) -> list[pa.Array]:
    """(doc_id, start, stop, leader) of runs at some starts, by row and start: those that follow each other with one leader are one."""
    begins = np.flatnonzero(np.append(True, (np.diff(row) != 0) | (np.diff(at) != 1) | (np.diff(leader) != 0))) if len(row) else row
    ends = np.append(begins[1:], len(row)) - 1 if len(row) else row
    return [pa.array(doc[row[begins]]), *(pa.array(at[x].astype(np.int32)) for x in (begins, ends)), pa.array(leader[begins])]


def _compared(suffixes: DataFrame, window: int, parts: int, longest: int) -> Kept:
    """(doc_id, start, stop, leader) of the runs that different documents have; and the suffixes of sorted runs that are too long, without a leader."""
    most = window - 1

    def resolve(t: pa.Table) -> pa.RecordBatch:
        after, before = (_padded(t.column(k).combine_chunks(), most) for k in (1, 2))
        key, doc, start, stop = (t.column(k).to_numpy().astype(np.int64) for k in (0, 3, 4, 5))
        suffix = stop + most - pc.binary_length(t.column(1).combine_chunks()).to_numpy(zero_copy_only=False).astype(np.int64) // 8
        leader, several = compare(key, doc, suffix - stop, suffix - start, after, before)
        leader, several = leader[:, ::-1], several[:, ::-1]  # by rising start
        row, place = np.nonzero(several)
        found = _intervals(doc, row, suffix[row] - most + place, leader[row, place])
        none = [pa.nulls(len(found[0]), k) for k in (pa.int64(), pa.binary(), pa.binary())]
        return pa.RecordBatch.from_arrays([*none, *found], ["key", "after", "before", "doc_id", "start", "stop", "leader"])

    def left(t: pa.Table):
        yield from t.append_column("leader", pa.nulls(len(t), pa.int64())).to_batches()

    def run(batches):
        held, size, long = [], 0, None  # rows of whole runs and of an open one; the key of an open run that is too long
        for batch in batches:
            if not len(batch):
                continue
            if long is not None:
                more = int(np.searchsorted(batch.column(0).to_numpy() != long, True))
                yield from left(pa.Table.from_batches([batch.slice(0, more)]))
                batch = batch.slice(more)
                if not len(batch):
                    continue
                long = None
            held.append(batch)
            size += len(batch)
            if size < min(TOGETHER, longest):
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            key = t.column(0).to_numpy()
            open_at = int(np.flatnonzero(np.append(True, key[1:] != key[:-1]))[-1])
            if open_at:
                yield resolve(t.slice(0, open_at))
                t = t.slice(open_at)
            if len(t) > longest:
                long = key[-1]
                yield from left(t)
                t = t.slice(len(t))
            held, size = t.to_batches(), len(t)
        if size:
            yield resolve(pa.Table.from_batches(held).combine_chunks())

    rows = suffixes.repartition(parts, "key").sortWithinPartitions("key", "after")
    return Kept(rows.mapInArrow(lean(run), _SUFFIX + ", leader long"), "compared")


def _hashed(suffixes: DataFrame, window: int, most_around: int) -> tuple[DataFrame, list[Kept]]:
    """(doc_id, start, stop, leader) of the runs that different documents have, for suffixes of any number with one key; and the tables behind them."""
    most = window - 1
    around = ["key", "after", "before"]
    rows = suffixes.withColumn("around", F.xxhash64(*around))
    alike = rows.groupBy("around", *around).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))

    def each_run(batches):
        for batch in batches:
            sums = []
            for k in (2, 3):  # hashes of the first words on each side, by their number
                words, h = _padded(batch.column(k), most), np.zeros((len(batch), most + 1), np.uint64)
                for j in range(most):
                    h[:, j + 1] = mix(h[:, j] * np.uint64(3) + words[:, j])
                sums.append(h)
            after, before = (pc.binary_length(batch.column(k)).to_numpy(zero_copy_only=False).astype(np.int64) // 8 for k in (2, 3))
            lo = most - after
            size = before - lo + 1
            row = np.repeat(np.arange(len(batch)), size)
            o = lo[row] + np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            key = batch.column(1).to_numpy().view(np.uint64)
            h = mix(mix(key[row] ^ sums[0][row, most - o]) + sums[1][row, o] * np.uint64(3) + o.astype(np.uint64))
            taken = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column(0).take(taken), pa.array(o.astype(np.int32)), *(batch.column(k).take(taken) for k in (4, 5))], ["hash", "around", "place", "low", "high"])

    runs = Kept(alike.mapInArrow(lean(each_run), "hash long, around long, place int, low long, high long"), "runs")
    leaders = Kept(runs.df.groupBy("hash").agg(F.min("low").alias("leader"), F.max("high").alias("last")).where("leader < last").select("hash", "leader"), "leaders")
    led = runs.df.join(leaders.df, "hash").groupBy("around").agg(F.collect_list(F.struct("place", "leader")).alias("found"))  # a window's places at most
    led = Kept(led, "led")

    def back(batches):
        for batch in batches:
            found = batch.column(2)
            row = np.repeat(np.arange(len(batch)), found.value_lengths().to_numpy())
            place, leader = (found.flatten().field(k).to_numpy().astype(np.int64) for k in (0, 1))
            yield rows_of(batch.column(0).to_numpy(), batch.column(1).to_numpy(), row, place, leader)

    def rows_of(doc, suffix, row, place, leader):
        # the runs of a document's suffixes follow each other: a copied text is one row
        docs, of = np.unique(doc, return_inverse=True)
        at, of = suffix[row] - place, of[row]
        order = np.lexsort((at, of))
        return pa.RecordBatch.from_arrays(_intervals(docs, of[order], at[order], leader[order]), ["doc_id", "start", "stop", "leader"])

    suffix = F.col("stop") + most - (F.length("after") / 8).cast("int")
    asked = rows.select("doc_id", suffix.alias("suffix"), "around")
    if led.df.count() > most_around:
        return asked.join(led.df, "around").select("doc_id", "suffix", "found").mapInArrow(lean(back), _RUNS), [runs, leaders, led]
    table = led.df.toArrow().combine_chunks().sort_by("around")
    found = table["found"].combine_chunks()
    cuts = np.concatenate([[0], np.cumsum(found.value_lengths().to_numpy(zero_copy_only=False))]) if len(table) else np.zeros(1, np.int64)
    shared = suffixes.sparkSession.sparkContext.broadcast((table["around"].to_numpy(), cuts, *(found.flatten().field(k).to_numpy() for k in (0, 1))))

    def looked_up(batches):
        around, cuts, places, leaders = shared.value
        for batch in batches:
            wanted = batch.column(2).to_numpy()
            at = np.minimum(np.searchsorted(around, wanted), max(len(around) - 1, 0))
            hit = np.flatnonzero(around[at] == wanted) if len(around) else np.zeros(0, np.int64)
            begin, size = cuts[at[hit]], cuts[at[hit] + 1] - cuts[at[hit]]
            e = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
            yield rows_of(batch.column(0).to_numpy(), batch.column(1).to_numpy(), np.repeat(hit, size), places[e].astype(np.int64), leaders[e])

    return asked.mapInArrow(lean(looked_up), _RUNS), [runs, leaders, led]


def _join(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Spans that the runs at some sorted starts cover."""
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > starts[:-1] + length
    first = np.flatnonzero(new)
    return starts[first], starts[np.append(first[1:], len(starts)) - 1] + length


def _spans(rows: DataFrame, length: int, parts: int) -> DataFrame:
    """Spans of each document from its repeated runs, those that begin at start to stop (doc_id, start, stop, leader)."""

    def of(doc, start, stop, leader):
        size = stop - start + 1
        start = np.repeat(start, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        leader = np.repeat(leader, size)
        order = np.argsort(start, kind="stable")
        start, leader = start[order], leader[order]
        a, b = _join(start, length)
        later = start[leader != doc]
        ca, cb = _join(later, length) if len(later) else (later, later)
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            inside = (start >= x) & (start < y)
            cut = (ca >= x) & (ca < y)
            yield doc, x, y, int(leader[inside].min()), ca[cut].tolist(), cb[cut].tolist()

    def run(batches):
        held: list[tuple] = []
        open_doc = None

        def close():
            if held:
                yield from of(open_doc, *(np.concatenate(x) for x in zip(*held, strict=True)))

        for batch in batches:
            if not len(batch):
                continue
            doc, start, stop, leader = (batch.column(k).to_numpy().astype(np.int64) for k in range(4))
            cuts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
            out = []
            for x, y in zip(cuts, np.append(cuts[1:], len(doc)), strict=True):
                if doc[x] != open_doc:
                    out += close()
                    open_doc, held = int(doc[x]), []
                held.append((start[x:y], stop[x:y], leader[x:y]))
            yield _rows(out)
        yield _rows(list(close()))

    def _rows(out):
        columns = list(zip(*out, strict=True)) or [[]] * 6
        ints = pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, ints if k > 3 else pa.int64()) for k, c in enumerate(columns)], ["doc_id", "start", "end", "first_doc", "cut_starts", "cut_ends"])

    return rows.select("doc_id", "start", "stop", "leader").repartition(parts, "doc_id").sortWithinPartitions("doc_id", "start").mapInArrow(lean(run), "doc_id long, start long, end long, first_doc long, cut_starts array<long>, cut_ends array<long>")


def repeats(docs: DataFrame, length: int = 50, window: int = 25, id_col: str = "doc_id", text_col: str = "text", longest: int = RUN, most_around: int = AROUND) -> DataFrame:
    """Spans of words that repeat across documents: doc_id, start, end (words), first_doc, cut_starts, cut_ends.

    first_doc is the smallest id among the documents that share some run of the span;
    the cuts are the parts of the span that a document of a smaller id has too.
    window: from 2 to length words; longest: suffixes of a sorted run that are compared in one
    place; most_around: different surroundings that are broadcast.
    """
    spark = docs.sparkSession
    small_batches(spark)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null and text is not null")
    heads = _heads(texts, length, window)
    frequent = heads.df.where("doc_id is null").groupBy("key").agg(F.sum("docs").alias("n")).orderBy(F.desc("n"), "key").limit(HEAVY).select("key").collect()
    known = F.broadcast(spark.createDataFrame(frequent, "key long"))
    rows = heads.df.where("doc_id is not null").select("key", "doc_id")
    some = shared_keys(rows.join(known, "key", "left_anti"), parts).select("doc_id", "key").union(rows.join(known, "key", "left_semi").select("doc_id", F.lit(None).cast("long")))
    wanted = some.groupBy("doc_id").agg(F.collect_list("key").alias("keys"))
    around = texts.join(wanted, "doc_id").select("doc_id", "text", "keys")
    matches = _matches(around, length, window, np.sort(np.array([r.key for r in frequent], np.int64).view(np.uint64)))
    heads.drop()
    columns = [c.split()[0] for c in _SUFFIX.split(", ")]
    compared = _compared(matches.df.where(~F.col("hot")).select(columns), window, parts, longest)
    hashed, kept = _hashed(matches.df.where("hot").select(columns).union(compared.df.where("leader is null").select(columns)), window, most_around)
    out = Kept(_spans(compared.df.where("leader is not null").select("doc_id", "start", "stop", "leader").union(hashed), length, parts), "repeats")
    for x in (matches, compared, *kept):
        x.drop()
    return out.df


def without_repeats(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without the words of the cuts, and without those that the cuts leave no word.

    The columns stay, and n_chars, if there, is made anew.
    """
    cuts = spans.where("size(cut_starts) > 0").groupBy("doc_id").agg(F.flatten(F.collect_list("cut_starts")).alias("a"), F.flatten(F.collect_list("cut_ends")).alias("b"))
    at = docs.columns.index(text_col)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))  # apart from the names of the documents' columns
    joined = whole.join(cuts, F.col("row").getField(id_col).cast("long") == F.col("doc_id"), "left").select(*[F.col("row").getField(c).alias(f"c{k}") for k, c in enumerate(docs.columns)], "a", "b")

    def run(batches):
        for batch in batches:
            texts, left = batch.column(at).to_pylist(), np.ones(len(batch), bool)
            for i, (a, b) in enumerate(zip(batch.column(len(docs_columns)).to_pylist(), batch.column(len(docs_columns) + 1).to_pylist(), strict=True)):
                if a:
                    texts[i] = cut_words(texts[i], sorted(zip(a, b, strict=True)))
                    left[i] = bool(texts[i].strip(" \t\n\x0b\x0c\r"))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if k == at else batch.column(k) for k in range(len(docs_columns))], docs_columns).filter(pa.array(left))

    docs_columns = docs.columns
    out = joined.mapInArrow(lean(run), docs.schema)
    return out.withColumn("n_chars", F.length(text_col).cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without some words, each with the white space after it."""
    data, offsets = flat(pa.array([text], pa.large_string()))
    starts, _, _ = word_bounds(data, offsets)
    edges = np.append(starts, len(data))
    raw, out, at = data.tobytes(), [], 0
    for a, b in spans:
        a, b = max(a, 0), min(b, len(starts))
        if b <= a or edges[b] <= at:
            continue
        out.append(raw[at : max(at, int(edges[a]))])
        at = int(edges[b])
    return b"".join([*out, raw[at:]]).decode()
