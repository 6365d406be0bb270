"""Toxicity by the nearest labelled examples: exact cosine of weighted TF-IDF over a block-max inverted index.

The fit takes about `per_class` labelled rows of each class, chosen by a hash of the
id (a documented bound), and their different texts. Its terms are all words of these, and the
beginnings of longer ones; none is left out. A term weighs its inverse document frequency, counted
over all documents, times its G statistic between the classes and a little more, so that words
that say little of the class hardly count, and rare words of one class do.
A term is known by a 64-bit hash of its letters, so that a batch of texts is cut into terms in
one go. Postings lie by term, examples in blocks of similar ones. Rare terms are summed over their
postings; frequent ones lie as dense rows with the largest weight in every block, and a block is
summed for the texts that this bound lets reach the k-th score there, so the neighbours are
the exact ones, by sums in double precision. They vote with weights that fall with the distance, and a monotone map from
leave-one-out votes of the examples themselves makes votes into probabilities. The
neighbours are the evidence.

Nulls and edges: a null or empty text, or one without a term, has no neighbours and
gets the rate of such texts among the examples; rows without text or label teach
nothing; ties between neighbours go to the smaller id; without examples every score
is 0; labels of a document that is listed twice count once for each row.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Kept, mix, small_batches

BLOCK, FEW = 64, 16
#: Terms of more than one example in so many lie as dense rows.
DENSE = 16
#: Letters by which longer words count a second time.
STEM = 5
#: Characters of texts that are cut into terms together, and texts that are searched together.
CHARS, TEXTS = 1 << 19, 32
#: More than the rounding of sums of unit vectors' products; scores within it are ties.
SLACK = 1e-11

_BREAK = re.compile(r"[\W\d_]")
_LETTER: np.ndarray | None = None
_POINT: np.ndarray | None = None
_POWERS: tuple[np.ndarray, np.ndarray] | None = None
_BASE = 0x9E3779B97F4A7C15


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of an odd number, and of its inverse, modulo 2 ** 64."""
    global _POWERS
    if _POWERS is None or len(_POWERS[0]) < n:
        size = max(n, 2 * CHARS)
        _POWERS = tuple(np.multiply.accumulate(np.append(np.ones(1, np.uint64), np.full(size, x, np.uint64))) for x in (_BASE, pow(_BASE, -1, 1 << 64)))
    return _POWERS


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Which code points are letters, and a random odd number for each."""
    global _LETTER, _POINT
    if _LETTER is None:
        _LETTER = np.array([(ch := chr(c)).isalnum() and not ch.isdecimal() for c in range(0x110000)])
        _POINT = mix(np.arange(1, 0x110001, dtype=np.uint64)) | np.uint64(1)
    return _LETTER, _POINT


def _groups(texts: list[str | None]):
    """Pieces of the texts in groups of bounded size, as (text number, piece); longer texts are cut between words."""
    group, size = [], 0
    for i, text in enumerate(texts):
        low, at = (text or "").lower(), 0
        while at < len(low):
            cut = _BREAK.search(low, at + CHARS) if len(low) - at > CHARS else None
            to = cut.end() if cut else len(low)
            group.append((i, low[at:to]))
            size, at = size + to - at, to
            if size >= CHARS:
                yield group
                group, size = [], 0
    if group:
        yield group


def tokens(group: list[tuple[int, str]]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of each word of some pieces in lower case, and of the beginnings of longer words."""
    letter, point = _tables()
    points = np.frombuffer(" ".join(t for _, t in group).encode("utf-32-le", "surrogatepass"), "<u4")
    inside = np.zeros(len(points) + 2, bool)
    inside[1:-1] = letter[points]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    # a word's hash: its part of one running sum, brought back to the exponent 0
    powers, back = _powers(len(points))
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(point[points] * powers[: len(points)], out=sums[1:])
    at, lens = sums[starts], ends - starts
    whole = mix((sums[ends] - at) * back[starts] ^ (lens.astype(np.uint64) << np.uint64(48)))
    long = np.flatnonzero(lens > STEM)
    begun = mix((sums[starts[long] + STEM] - at[long]) * back[starts[long]] ^ np.uint64(1 << 47))
    begins = np.cumsum([0, *(len(t) + 1 for _, t in group)])[:-1]
    doc = np.repeat(np.array([i for i, _ in group]), np.diff(np.append(np.searchsorted(starts, begins), len(starts))))
    return np.concatenate([doc, doc[long]]), np.concatenate([whole, begun])


def word_hash(word: str) -> np.uint64:
    """Hash of one word, or, with a star behind it, of the beginning of longer ones."""
    if word.endswith("*"):
        return tokens([(0, word[:-1] + "x" * STEM)])[1][1]
    return tokens([(0, word.lower())])[1][0]


class Terms:
    """Hashes of terms, each with its number."""

    def __init__(self, hashes: np.ndarray):
        self.order = np.argsort(hashes)
        self.sorted = np.append(hashes[self.order], np.uint64(0xFFFFFFFFFFFFFFFF))
        # where the hashes of each beginning lie
        bits = max(1, int(len(hashes)).bit_length() + 2)
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.sorted[:-1], np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)
        self.most = int(np.diff(self.first, append=len(hashes)).max())

    def __len__(self) -> int:
        return len(self.order)

    def __contains__(self, word: str) -> bool:
        return bool(len(self.find(np.array([word_hash(word)]))[0]))

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the hashes that are terms, and the terms' numbers."""
        at = self.first[(hashes >> self.shift).astype(np.int64)]
        left = np.flatnonzero(self.sorted[at] < hashes)
        for _ in range(self.most):
            at[left] += 1
            left = left[self.sorted[at[left]] < hashes[left]]
        hit = np.flatnonzero((self.sorted[at] == hashes) & (at < len(self)))
        return hit, self.order[at[hit]]

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text number, term, times) of the terms in each text, in that order."""
        seen, times = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for group in _groups(texts):
            doc, h = tokens(group)
            hit, term = self.find(h)
            u, n = np.unique(doc[hit] * len(self) + term, return_counts=True)
            seen.append(u)
            times.append(n)
        seen, times = np.concatenate(seen), np.concatenate(times)
        if len(seen) and not (np.diff(seen) > 0).all():  # a text in several groups
            seen, place = np.unique(seen, return_inverse=True)
            times = np.bincount(place, times).astype(np.int64)
        return seen // max(len(self), 1), seen % max(len(self), 1), times


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one after the other."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


class Voter:
    """Examples as a block-max inverted index over a fixed vocabulary, given as words or hashes; counts are by term, as dicts or (cuts, terms, times) end to end."""

    def __init__(self, terms: list[str] | np.ndarray, idf: np.ndarray, ids: np.ndarray, tf: list[dict] | tuple, labels: np.ndarray, weights: np.ndarray, k: int):
        hashes = terms if isinstance(terms, np.ndarray) else np.array([word_hash(t) for t in terms], np.uint64)
        if not isinstance(tf, tuple):
            tf = np.cumsum([0, *map(len, tf)]), *(np.array([x for c in tf for x in part(c)], np.int32) for part in (dict.keys, dict.values))
        cuts, term, times = tf
        sizes = np.diff(cuts)
        total = weights[sizes == 0].sum()
        self.base = float((weights * labels)[sizes == 0].sum() / total) if total else float((weights * labels).sum() / max(weights.sum(), 1e-12))
        self.x, self.y, self.k, self.idf = np.zeros(1), np.full(1, self.base), k, idf
        # examples with the same strongest term lie together
        some = np.flatnonzero(sizes)
        order = np.lexsort((-((1 + np.log(times)) * idf[term]), np.repeat(np.arange(len(sizes)), sizes)))
        some = some[np.lexsort((ids[some], term[order][cuts[some]]))]
        sizes = sizes[some]
        e = _ranges(cuts[some], sizes)
        e = e[np.lexsort((term[e], np.repeat(np.arange(len(some)), sizes)))]
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        self._build(hashes, ids[some], labels[some], weights[some], cuts, term[e], times[e])
        if self.n:
            votes = np.zeros(self.n)
            value = self._unit(np.repeat(np.arange(self.n), sizes), self._made[5], self._made[6], self.n)
            for a in range(0, self.n, TEXTS):
                own = np.arange(a, min(a + TEXTS, self.n))
                e = slice(cuts[a], cuts[own[-1] + 1])
                votes[own] = self.votes(len(own), *self.search(np.repeat(own - a, sizes[own]), self._made[5][e], value[e], len(own), own))
            self._calibrate(votes, self.label[: self.n], self.weight[: self.n])

    def __getstate__(self) -> tuple:
        """What the index is made from again, so that what is broadcast stays small."""
        return self._made, self.idf, self.k, self.base, self.x, self.y

    def __setstate__(self, state: tuple) -> None:
        made, self.idf, self.k, self.base, self.x, self.y = state
        self._build(*made)
        self._made = None  # who searches ships it no further

    def _build(self, *made) -> None:
        """The index: of the examples that have terms, given by place with their ids, labels, weights, terms and how often they have them."""
        self._made = made
        hashes, ids, labels, weights, cuts, term, times = made
        self.terms, self.v, self.n = Terms(hashes), len(hashes), len(ids)
        self.blocks = -(-self.n // BLOCK)
        self.places = self.blocks * BLOCK
        rest = np.zeros(self.places - self.n)
        self.ids = np.concatenate([ids, np.full(len(rest), np.iinfo(np.int64).max)]).astype(np.int64)
        self.label, self.weight = np.concatenate([labels, rest]), np.concatenate([weights, rest])
        sizes = np.diff(cuts)
        value = self._unit(np.repeat(np.arange(self.n), sizes), term, times, self.n)
        # their postings by term, then place
        order = np.argsort(term, kind="stable")
        term = term[order]
        self.place = np.repeat(np.arange(self.n, dtype=np.int32), sizes)[order]
        self.by_term = value[order]
        self.start = np.searchsorted(term, np.arange(self.v + 1))
        # terms of many examples as dense rows of each block, with their largest weights by block
        often = np.flatnonzero(np.diff(self.start) > self.n / DENSE)
        self.row = np.full(self.v, -1, np.int32)
        self.row[often] = np.arange(len(often))
        dense = np.zeros((len(often), self.places))
        mine = self.row[term] >= 0
        dense[self.row[term[mine]], self.place[mine]] = self.by_term[mine]
        self.dense = np.ascontiguousarray(dense.reshape(len(often), self.blocks, BLOCK).transpose(1, 0, 2))
        self.block_max = self.dense.max(2).T if self.n else np.zeros((len(often), 0))

    @property
    def posting(self) -> np.ndarray:
        """The weights as a dense array of terms, blocks and places (for small vocabularies)."""
        out = np.zeros((self.v, self.places))
        out[np.repeat(np.arange(self.v), np.diff(self.start)), self.place] = self.by_term
        return out.reshape(self.v, self.blocks, BLOCK)

    def vector(self, counts) -> tuple[np.ndarray, np.ndarray]:
        """Terms and unit TF-IDF weights of a text."""
        t, n = np.array(list(counts), np.int64), np.array(list(counts.values()))
        order = np.argsort(t)
        t = t[order]
        return t, self._unit(np.zeros(len(t), np.int64), t, n[order], 1)

    def _unit(self, doc: np.ndarray, term: np.ndarray, times: np.ndarray, texts: int) -> np.ndarray:
        """Weights of the terms of some texts, of length 1 for each text."""
        w = (1 + np.log(times)) * self.idf[term]
        size = np.sqrt(np.bincount(doc, w * w, texts))
        return w / np.maximum(size, 1e-300)[doc]

    def nearest(self, t: np.ndarray, w: np.ndarray, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest examples that share a term, nearest first."""
        _, places, scores = self.search(np.zeros(len(t), np.int64), t, w, 1, np.array([skip]))
        return places, scores

    def search(self, doc: np.ndarray, term: np.ndarray, w: np.ndarray, texts: int, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, place, cosine) of the k nearest examples of each text, nearest first; skip: a place for each text that does not count."""
        none = np.zeros(0, np.int64)
        if not self.n or not len(term):
            return none, none, np.zeros(0)
        frequent = self.row[term] >= 0
        rare, of, by = term[~frequent], doc[~frequent], w[~frequent]
        sizes = self.start[rare + 1] - self.start[rare]
        e = _ranges(self.start[rare], sizes)
        s = np.bincount(np.repeat(of, sizes) * self.places + self.place[e], self.by_term[e] * np.repeat(by, sizes), texts * self.places).astype(float, copy=False).reshape(texts, self.places)
        own = np.flatnonzero(skip >= 0) if skip is not None else none
        if len(own):
            s[own, skip[own]] = 0
        if frequent.any():
            weights = np.zeros((texts, len(self.block_max)))
            weights[doc[frequent], self.row[term[frequent]]] = w[frequent]
            bound = weights @ self.block_max
            # blocks that can reach the k-th of the scores so far, which only grow
            most = s.reshape(texts, self.blocks, BLOCK).max(2)
            need = (bound > 0) & (most + bound >= self._kth(most) - SLACK)
            for b in range(self.blocks):
                if len(rows := np.flatnonzero(need[:, b])):
                    s[rows, b * BLOCK : (b + 1) * BLOCK] += weights[rows] @ self.dense[b]
            if len(own):
                s[own, skip[own]] = 0
        # the k-th of the largest of each few is reached by k examples, so no better one is missed
        at, place = np.nonzero((s > 0) & (s >= self._kth(s.reshape(texts, -1, FEW).max(2)) - SLACK))
        score = s[at, place]
        order = np.lexsort((self.ids[place], -np.round(score, 11), at))
        at, place, score = at[order], place[order], score[order]
        best = np.arange(len(at)) - np.searchsorted(at, at) < self.k
        return at[best], place[best], score[best]

    def _kth(self, s: np.ndarray) -> np.ndarray:
        """The k-th largest of each row; 0 where there are no more."""
        return np.partition(s, -self.k, axis=1)[:, -self.k, None] if s.shape[1] > self.k else np.zeros((len(s), 1))

    def votes(self, texts: int, at: np.ndarray, place: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The vote of the neighbours of each text; the base rate where there are none."""
        by = self.weight[place] / (1.05 - np.minimum(score, 1))
        total = np.bincount(at, by, texts)
        return np.where(total > 0, np.bincount(at, by * self.label[place], texts) / np.maximum(total, 1e-300), self.base)

    def _calibrate(self, votes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> None:
        """Pool adjacent violators: a rising step function from votes to rates."""
        pools: list[list[float]] = []
        order = np.argsort(votes, kind="stable")
        for v, y, w in zip(votes[order], labels[order], weights[order], strict=True):
            pools.append([v, v, y * w, w])
            while len(pools) > 1 and (pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3] or pools[-2][1] == pools[-1][0]):
                a = pools.pop()
                pools[-1] = [pools[-1][0], a[1], pools[-1][2] + a[2], pools[-1][3] + a[3]]
        self.x = np.array([x for p in pools for x in (p[0], p[1])])
        self.y = np.array([r for p in pools for r in [(p[2] + 0.5 * self.base) / (p[3] + 0.5)] * 2])

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Probability of each text; and (text, id, cosine) of the examples behind it, nearest first."""
        out, parts = np.full(len(texts), self.base), []
        doc, term, times = self.terms.counts(texts)
        w = self._unit(doc, term, times, len(texts))
        for a in range(0, len(texts), TEXTS):
            n = min(TEXTS, len(texts) - a)
            e = slice(*np.searchsorted(doc, [a, a + n]))
            at, place, cosine = self.search(doc[e] - a, term[e], w[e], n)
            some = np.unique(at)
            out[a + some] = np.clip(np.interp(self.votes(n, at, place, cosine)[some], self.x, self.y), 0, 1)
            parts.append((at + a, self.ids[place], cosine))
        return out, *(np.concatenate(x) for x in zip(*parts, strict=True))


def parting(a: np.ndarray, b: np.ndarray, p: float, m: float) -> np.ndarray:
    """Weights of words that a of p texts of one class and b of m of the other have: G without one text of the class that has more, and a little for all."""

    def g(a, b):
        out, n = np.zeros(len(a)), a + b
        for seen, want in ((a, n * p), (b, n * m), (p - a, (p + m - n) * p), (m - b, (p + m - n) * m)):
            out += 2 * seen * np.log(np.where(seen > 0, seen * (p + m) / np.maximum(want, 1e-300), 1.0))
        return np.maximum(out, 0)

    more = a * m > b * p
    return np.minimum(g(a, b), g(np.maximum(a - more, 0), np.maximum(b - ~more, 0))) + 0.1


def fit(labels: DataFrame, docs: DataFrame, text_col: str = "text", label_col: str = "toxic", id_col: str = "doc_id", per_class: int = 3000, k: int = 11) -> Voter | None:
    """A voter from labels (id, 0 or 1) and the documents they are of, with document frequencies of all documents.

    The sample of labels is bounded, so it is broadcast to the documents; they are not
    shuffled. To the driver come the terms of the sample with their frequencies, and their
    counts in each text of it.
    """
    small_batches(docs.sparkSession)
    rows = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    n = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not n:
        return None
    share = F.element_at(F.create_map(*[F.lit(x) for c, m in n.items() for x in (c, min(1.0, per_class / m))]), F.col("label"))
    some = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share * (1 << 20)).distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    found = texts.join(F.broadcast(some), "id").groupBy(F.xxhash64("text").alias("h"), "label").agg(F.min("id").alias("id"), F.min("text").alias("text"))
    kept = Kept(found.select("id", "text", "label"), "examples")
    sample = kept.df

    def each_term(batches):
        for batch in batches:
            every = [tokens(group) for group in _groups(batch.column(0).to_pylist())]
            if every:
                doc, h = (np.concatenate(x) for x in zip(*every, strict=True))
                order = np.lexsort((h, doc))
                doc, h = doc[order], h[order]
                new = np.append(True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1]))[: len(h)]
                yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), batch.column(1).take(pa.array(doc[new]))], ["term", "label"])

    size = {r.label: r.n for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    p, m = float(size.get(1, 0)), float(size.get(0, 0))
    terms = sample.select("text", "label").mapInArrow(each_term, "term long, label int").groupBy("term").agg(F.sum("label").cast("double").alias("a"), F.count("*").cast("double").alias("n")).toArrow().sort_by("term")
    chosen, a, n_with = terms["term"].to_numpy().view(np.uint64), terms["a"].to_numpy(), terms["n"].to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(Terms(chosen))  # bounded by the sample

    def frequencies(batches):
        known = shared.value
        total, seen = np.zeros(len(known) + 1, np.int64), 0  # the last place counts the documents
        for batch in batches:
            _, term, _ = known.counts(batch.column(0).to_pylist())
            total[:-1] += np.bincount(term, minlength=len(known))
            seen += len(batch)
        total[-1] = seen
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "n"])

    counts = np.zeros(len(chosen) + 1, np.int64)
    counted = docs.select(F.col(text_col).cast("string")).mapInArrow(frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    counts[counted["term"].to_numpy()] = counted["n"].to_numpy()
    idf = np.log((1 + counts[-1]) / (1 + counts[:-1])) + 1
    term_weight = idf * parting(a, n_with - a, p, m) if p and m else idf

    def vectors(batches):
        known = shared.value
        for batch in batches:
            doc, term, times = known.counts(batch.column(1).to_pylist())
            cuts = pa.array(np.searchsorted(doc, np.arange(len(batch) + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.ListArray.from_arrays(cuts, pa.array(x.astype(np.int32))) for x in (term, times)), batch.column(2)], ["id", "terms", "tf", "label"])

    got = sample.select("id", "text", "label").mapInArrow(vectors, "id long, terms array<int>, tf array<int>, label int").toArrow().sort_by([("id", "ascending"), ("label", "ascending")])
    shared.destroy()
    ids, labels = got["id"].to_numpy(), got["label"].to_numpy().astype(float)
    weights = np.array([n[int(y)] / size[int(y)] for y in labels])
    each = got["terms"].combine_chunks()
    tf = np.concatenate([[0], np.cumsum(each.value_lengths().to_numpy(zero_copy_only=False))]), each.flatten().to_numpy(), got["tf"].combine_chunks().flatten().to_numpy()
    kept.drop()
    del got, each, terms, counted
    return Voter(chosen, term_weight, ids, tf, labels, weights, k)


def score(docs: DataFrame, voter: Voter | None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns with score, evidence (ids of the nearest examples) and similarity (their cosines)."""
    small_batches(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    picked = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).cast("string").alias("_text_"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])
    shared = docs.sparkSession.sparkContext.broadcast(voter)  # bounded by the sample and its terms

    def run(batches):
        v = shared.value
        for batch in batches:
            none = np.zeros(0, np.int64)
            found, at, ids, cosine = v.score(batch.column(len(keep)).to_pylist()) if v and len(batch) else (np.zeros(len(batch)), none, none, np.zeros(0))
            cuts = pa.array(np.searchsorted(at, np.arange(len(batch) + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found), pa.ListArray.from_arrays(cuts, pa.array(ids)), pa.ListArray.from_arrays(cuts, pa.array(cosine))], [*keep, "score", "evidence", "similarity"])

    return picked.mapInArrow(run, (schema + ", " if schema else "") + "score double, evidence array<long>, similarity array<double>")
