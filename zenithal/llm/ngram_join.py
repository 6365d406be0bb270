"""Exact n-gram Jaccard join of documents: prefix groups, size-banded tiles, bitmap bounds, exact sets.

A document's set holds the hashes of its word shingles. Documents with the same set
are one class, held by its smallest id. Two sets whose Jaccard similarity reaches
t = num / den share one of the first n - ceil(t n) + 1 shingles of each in any common
order; the order used has shingles that are frequent anywhere last, so that groups of
documents that share a key stay small. Each key's group first links its members to one
leader; what is proven by that is joined, so that large groups of near copies need no
pairs. Groups that still hold several components go to tiles: blocks of bounded size,
sorted by set size, in which only pairs of admissible sizes meet. Parity bitmaps (a bit
for each hash bucket that an odd number of shingles fall into) bound the overlap from
above, and pairs that pass are intersected exactly as sorted arrays. Every pair that
can link is either proven to be in one component already or intersected, so the
components are exact.

What is broadcast is a list of at most HEAVY frequent shingles, which affects the order
alone. Tables between steps lie in the shared folder.

Nulls and edges: a text that is null or has no words has an empty set and links with
nothing; one with fewer words than a shingle is one shingle of all of them; a null id
is carried with a null component; rows that share an id are one node.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, RELEASE_BYTES, Kept, connected_components, files_of, flat, frequent_values, lean, mix, release, shared_keys, shingle_hashes, small_batches, word_bounds, word_hashes

#: Frequent shingles that go last in the order; a bound on what is broadcast.
HEAVY = 1 << 16
#: Members of a group that one tile's side holds.
TILE = 512
_CHUNK = 1 << 21


def sets(col: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, end to end, and the n + 1 offsets."""
    data, offsets = flat(col)
    data = LOWER[data]
    starts, ends, first = word_bounds(data, offsets)
    words = word_hashes(data, starts, ends)
    count = np.diff(first)
    runs = np.maximum(count - n + 1, 0)
    doc = np.repeat(np.arange(len(count)), runs)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(runs) - runs, runs) + np.repeat(first[:-1], runs)
    h = shingle_hashes(words, n)[at] if len(at) else np.zeros(0, np.uint64)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):  # the whole sequence as one
        whole = np.array([mix(shingle_hashes(words[first[i] : first[i + 1]], int(count[i])) + np.uint64(count[i]))[0] for i in short], np.uint64)
        h, doc = np.concatenate([h, whole]), np.concatenate([doc, short])
    if len(short):
        order = np.argsort(doc, kind="stable")
        h, doc = h[order], doc[order]
    cuts = np.searchsorted(doc, np.arange(len(count) + 1))
    for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        h[x:y].sort()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(count) + 1))


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return (total[offsets[1:]] - total[offsets[:-1]]).view(np.int64)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def _survey(texts: DataFrame, n: int) -> Kept:
    """Size, digest and bitmap of each document's set, and, as rows without size, shingles that are frequent within a task."""

    def run(batches):
        held, docs = [], 0

        def frequent():
            h, c = frequent_values(held, max(4, docs // 500))
            none = pa.nulls(len(h), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, pa.array(h.view(np.int64)), pa.array(c), pa.nulls(len(h), pa.binary())], ["doc_id", "n", "a", "b", "bits"])

        size = 0
        for batch in batches:
            h, offsets = sets(batch.column(1), n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(_sums(mix(h), offsets)), pa.array(_sums(mix(h ^ np.uint64(0x5851F42D4C957F2D)), offsets)), pa.array([bitmap(h[x:y]) for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.binary())], ["doc_id", "n", "a", "b", "bits"])
            held.append(h)
            size, docs = size + len(h), docs + len(batch)
            if size >= _CHUNK * 2:
                yield frequent()
                size, docs = 0, 0
        yield frequent()

    return Kept(texts.mapInArrow(lean(run), "doc_id long, n long, a long, b long, bits binary"), "sets")


def _prefixes(texts: DataFrame, n: int, num: int, den: int, heavy: np.ndarray) -> DataFrame:
    """(doc_id, n, keys): the first shingles of each set in the common order."""
    shared = texts.sparkSession.sparkContext.broadcast(heavy)

    def run(batches):
        for batch in batches:
            h, offsets = sets(batch.column(1), n)
            size = np.diff(offsets)
            at = np.minimum(np.searchsorted(shared.value, h), max(len(shared.value) - 1, 0))
            late = shared.value[at] == h if len(shared.value) else np.zeros(len(h), bool)
            length = np.where(size > 0, size - -(-size * num // den) + 1, 0)
            # place in the common order: frequent shingles after the others of their set
            early = np.cumsum(~late)
            base = np.concatenate([[0], early])[offsets]
            place = np.arange(len(h)) - np.repeat(offsets[:-1], size)
            rank = early - np.repeat(base[:-1], size) - 1
            rank = np.where(late, np.repeat(np.diff(base), size) + place - rank - 1, rank)
            keys = h[rank < np.repeat(length, size)].view(np.int64)
            cuts = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.ListArray.from_arrays(pa.array(cuts), pa.array(keys))], ["doc_id", "n", "keys"])

    return texts.mapInArrow(lean(run), "doc_id long, n long, keys array<long>")


def bitmap(h: np.ndarray) -> bytes:
    """Parity bits of a set, at least two for each member, as little-endian 64-bit words."""
    width = 64
    while width < 2 * len(h):
        width *= 2
    odd = np.bincount((h & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _arrays(texts: DataFrame, n: int) -> DataFrame:
    """(id, arr): the sorted set of each document."""

    def run(batches):
        for batch in batches:
            h, offsets = sets(batch.column(1), n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([h[x:y].tobytes() for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.binary())], ["id", "arr"])

    return texts.mapInArrow(lean(run), "id long, arr binary")


def similar(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    """Exact test on two sorted arrays."""
    if min(len(x), len(y)) * den < max(len(x), len(y)) * num:
        return False
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    both = int((y[at] == x).sum()) if len(y) else 0
    return den * both >= num * (len(x) + len(y) - both) > 0


def _verified(pairs: DataFrame, texts: DataFrame, n: int, num: int, den: int) -> Kept:
    """The pairs (a, b) whose sets are similar; only the texts of their documents are read for that."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    arrays = Kept(_arrays(texts.join(ids, "doc_id", "left_semi"), n), "arrays")

    def run(batches):
        for batch in batches:
            ok = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), num, den) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            mask = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(mask) for k in (0, 1)], ["a", "b"])

    left = pairs.join(arrays.df.select(F.col("id").alias("a"), F.col("arr").alias("x")), "a")
    both = left.join(arrays.df.select(F.col("id").alias("b"), F.col("arr").alias("y")), "b").select("a", "b", "x", "y")
    out = Kept(both.coalesce(files_of(pairs.count())).mapInArrow(lean(run), "a long, b long"), "links")
    arrays.drop()
    return out


def admissible(x: bytes, y: bytes, n: int, m: int, num: int, den: int) -> bool:
    """Whether sizes and bitmaps let two sets of n and m members be similar."""
    if min(n, m) * den < max(n, m) * num:
        return False
    a, b = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
    apart = int(np.bitwise_count(a ^ np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)).sum())
    return apart <= n + m - 2 * -(-num * (n + m) // (num + den))


def _admitted(pairs: DataFrame, bits: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that sizes and bitmaps admit."""

    def run(batches):
        for batch in batches:
            ok = [admissible(*r, num, den) for r in zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True)]
            mask = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(mask) for k in (0, 1)], ["a", "b"])

    left = pairs.join(bits.select(F.col("doc_id").alias("a"), F.col("bits").alias("x"), F.col("n").alias("nx")), "a")
    both = left.join(bits.select(F.col("doc_id").alias("b"), F.col("bits").alias("y"), F.col("n").alias("ny")), "b")
    return both.select("a", "b", "x", "y", "nx", "ny").mapInArrow(lean(run), "a long, b long")


def tile_pairs(doc: np.ndarray, side: np.ndarray, n: np.ndarray, comp: np.ndarray, bits: list[bytes], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a tile that sizes and bitmaps admit, of different components; across sides if there are two."""
    order = np.argsort(n, kind="stable")
    doc, side, n, comp = doc[order], side[order], n[order], comp[order]
    bits = [np.frombuffer(bits[i], np.uint64) for i in order]
    width = np.array([len(b) for b in bits])
    folded: dict[int, np.ndarray] = {}
    for w in np.unique(width):  # wider bitmaps fold to narrower ones
        rows = [np.bitwise_xor.reduce(b.reshape(-1, w), axis=0) if len(b) >= w else np.zeros(w, np.uint64) for b in bits]
        folded[int(w)] = np.stack(rows)
    two = side.min() != side.max()
    left, right = [], []
    for i in range(len(doc)):
        to = int(np.searchsorted(n, n[i] * den // num, "right"))
        if to <= i + 1:
            continue
        m = folded[int(width[i])]
        apart = np.bitwise_count(m[i] ^ m[i + 1 : to]).sum(1)
        total = n[i] + n[i + 1 : to]
        least = -(-num * total // (num + den))  # the overlap that similarity takes
        ok = (apart <= total - 2 * least) & (comp[i + 1 : to] != comp[i])
        if two:
            ok &= side[i + 1 : to] != side[i]
        j = np.flatnonzero(ok) + i + 1
        left.append(np.full(len(j), doc[i]))
        right.append(doc[j])
    none = np.zeros(0, np.int64)
    a, b = np.concatenate(left or [none]), np.concatenate(right or [none])
    return np.minimum(a, b), np.maximum(a, b)


def _tiles(groups: DataFrame, comps: DataFrame, bits: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) that groups of several components still hold."""
    # documents without a proven link are components of their own
    own = groups.join(comps.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("key", "doc_id", "n", F.coalesce("component", "doc_id").alias("comp"))
    stats = own.groupBy("key").agg(F.count("*").alias("size"), F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).alias("members"), F.min("doc_id").alias("d0"))
    # keys with the same members are one group
    open_keys = stats.where("c0 <> c1").groupBy("size", "members", "d0").agg(F.min("key").alias("key")).select("key", "size")
    rows = own.join(open_keys, "key").join(bits.select("doc_id", "bits"), "doc_id")
    blocks = F.ceil(F.col("size") / TILE).cast("int")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), F.col("block").alias("side"), "doc_id", "n", "comp", "bits")

    def run(t: pa.Table) -> pa.Table:
        a, b = tile_pairs(*(t.column(c).to_numpy() for c in ("doc_id", "side", "n", "comp")), t.column("bits").to_pylist(), num, den)
        if t.nbytes >= RELEASE_BYTES:
            release()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("key", "lo", "hi").applyInArrow(run, "a long, b long").distinct()


def components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document: components of the links with Jaccard at least num / den."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = _texts(docs, id_col, text_col)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    survey = _survey(texts, n)
    frequent = survey.df.where("n is null").groupBy("a").agg(F.sum("b").alias("c")).where("c >= 8").orderBy(F.desc("c"), "a").limit(HEAVY)
    heavy = np.sort(np.array([r.a for r in frequent.select("a").collect()], np.int64).view(np.uint64))
    measured = survey.df.where("n is not null")
    classes = measured.where("n > 0 and doc_id is not null").groupBy("n", "a", "b").agg(F.min("doc_id").alias("rep"))
    reps = classes.select(F.col("rep").alias("doc_id")).distinct()

    keyed = _prefixes(texts.where("doc_id is not null"), n, num, den, heavy).where("n > 0").join(reps, "doc_id", "left_semi")
    groups = Kept(shared_keys(keyed.select(F.explode("keys").alias("key"), "doc_id", "n"), parts), "groups")
    bits = measured.where("n > 0 and doc_id is not null").select("doc_id", "n", "bits")
    texts = texts.where("doc_id is not null")

    # one edge for each document, to the leader of most of its groups
    leaders = groups.df.where("doc_id <> leader").groupBy("doc_id", "leader").count()
    stars = leaders.groupBy("doc_id").agg(F.max_by("leader", F.struct("count", -F.col("leader"))).alias("leader"))
    likely = Kept(_admitted(stars.select(F.col("leader").alias("a"), F.col("doc_id").alias("b")), bits, num, den), "pairs")
    proven = _verified(likely.df, texts, n, num, den)
    first = connected_components(proven.df)
    left = Kept(_tiles(groups.df, first.df, bits, num, den), "pairs")
    rest = _verified(left.df, texts, n, num, den)
    final = connected_components(proven.df.union(rest.df))
    for x in (groups, likely, proven, first, left, rest):
        x.drop()
    of_set = measured.select("doc_id", "n", "a", "b").join(classes, ["n", "a", "b"], "left")
    return of_set.join(final.df.withColumnRenamed("id", "rep"), "rep", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"))
