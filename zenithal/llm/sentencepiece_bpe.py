"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text is cut before every run of spaces: no piece of the vocabulary has a space
mark after another character (checked when the model is read; otherwise the whole
text is one word), so merges never cross these cuts; and before line ends, where no
longer piece holds one. Words not met before are
encoded together: their characters are one flat array of symbols; each round finds
the best-scored pair of every word (a segmented minimum), merges its leftmost
occurrences at once, compacts the arrays, and drops the words that have no pair
left. Characters without a piece become their UTF-8 bytes' pieces. Where a merge
creates a pair that is at least as good, only the occurrences up to it merge in
that round, so the result is that of merging one pair at a time.

A long word takes many rounds. It is cut wherever two characters stand side by side that do so
in no piece, as no merge crosses such a place; what is still longer than LONG characters
merges by a queue of its pairs, one at a time, which takes n log n steps.

Decoding gathers the pieces' bytes: the space mark gives a space, and one space is
taken from the front, as the model's dummy prefix put one there. Bytes that are no
valid UTF-8 give U+FFFD each.

Nulls and edges: a null or empty text has the begin and end ids alone; lone
surrogates cannot occur in Spark strings; repeated rows are encoded each.
"""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

MARK = "▁"
#: Words whose ids a worker remembers; the table starts anew when it is full.
REMEMBERED = 500_000
#: Characters of words that merge together.
FLAT_CHARS = 1 << 20
#: Characters of a word without a safe cut from which a queue merges it.
LONG = 4096
_NONE = np.int64(1 << 40)
_MODELS: dict[str, MergeModel] = {}


class MergeModel:
    """Tables of a SentencePiece BPE model with byte fallback and no normalisation."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bos, self.eos, self.unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        self.byte = np.full(256, self.unk, np.int64)
        pieces: dict[str, int] = {}
        score: dict[str, float] = {}
        self.bytes_of: list[bytes] = []
        self.is_byte = np.zeros(n, bool)
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[3:-1], 16)] = i
                self.is_byte[i] = True
                self.bytes_of.append(bytes([int(piece[3:-1], 16)]))
            elif sp.is_control(i):
                self.bytes_of.append(b"")
            elif sp.is_unknown(i):
                self.bytes_of.append(" ⁇ ".encode())
            else:
                pieces[piece] = i
                score[piece] = sp.get_score(i)
                self.bytes_of.append(piece.replace(MARK, " ").encode())
        self.chars = {p: i for p, i in pieces.items() if len(p) == 1}
        self.cut = all(MARK not in p.lstrip(MARK) for p in pieces)
        self.lines = not any("\n" in p for p in pieces if len(p) > 1)
        # ranks: equal scores have equal ranks, better scores lower ones
        ranks = {s: k for k, s in enumerate(sorted(set(score.values()), reverse=True))}
        # symbols: a piece's id, or n + code point for a character without a piece; such
        # characters merge with nothing unless they are part of a longer piece
        extra = sorted({c for p in pieces for c in p} - set(self.chars))
        self.n = n
        symbol = dict(pieces) | {c: n + k for k, c in enumerate(extra)}
        self.width = n + len(extra) + 1  # the last symbol: a character in no piece
        table = np.full(0x110000, self.width - 1, np.int32)
        for c in {*self.chars, *extra}:
            table[ord(c)] = symbol[c]
        self.symbol_of = table
        keys, out = [], []
        for p, i in pieces.items():
            for k in range(1, len(p)):
                if p[:k] in symbol and p[k:] in symbol:
                    keys.append(symbol[p[:k]] * self.width + symbol[p[k:]])
                    out.append((ranks[score[p]], i))
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.array(keys, np.int64)[order]
        self.rank = np.array([x[0] for x in out], np.int64)[order]
        self.merged = np.array([x[1] for x in out], np.int64)[order]
        # characters that stand side by side in some piece
        self.beside = np.unique(np.array([ord(a) << 21 | ord(b) for p in pieces for a, b in zip(p, p[1:], strict=False)], np.int64))
        self.table: dict[int, tuple[int, int]] | None = None
        self.known: dict[str, bytes] = {}
        # longest piece, for decoding tables
        lens = np.array([len(b) for b in self.bytes_of])
        self.piece_at = np.cumsum(lens) - lens
        self.piece_len = lens
        self.piece_bytes = np.frombuffer(b"".join(self.bytes_of), np.uint8)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (or _NONE) and merged id of each pair of symbols."""
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.rank[at], _NONE), self.merged[at]

    def merge(self, words: list[str]) -> list[bytes]:
        """The ids of each word, as little-endian unsigned 32-bit integers."""
        if all(len(w) <= LONG for w in words):
            return self._rounds(words)
        parts = [self._parts(w) if len(w) > LONG else [w] for w in words]
        short = iter(self._rounds([p for ps in parts for p in ps if len(p) <= LONG]))
        return [b"".join(next(short) if len(p) <= LONG else self._queue(p) for p in ps) for ps in parts]

    def _parts(self, word: str) -> list[str]:
        """The word cut at some of the places that no piece crosses."""
        points = np.frombuffer(word.encode("utf-32-le"), "<u4").astype(np.int64)
        key = points[:-1] << 21 | points[1:]
        at = np.minimum(np.searchsorted(self.beside, key), max(len(self.beside) - 1, 0))
        cuts = np.flatnonzero(self.beside[at] != key) + 1 if len(self.beside) else np.arange(1, len(word))
        if len(cuts):  # the last place within each stretch of some characters is enough
            stretch = cuts // 256
            cuts = cuts[np.append(stretch[1:] != stretch[:-1], True)]
        edges = [0, *cuts.tolist(), len(word)]
        return [word[a:b] for a, b in zip(edges, edges[1:], strict=False)]

    def _queue(self, word: str) -> bytes:
        """The ids of one long word: the best pair first, the leftmost of equals."""
        points = np.frombuffer(word.encode("utf-32-le"), "<u4").astype(np.int64)
        sym, n = self.symbol_of[points].astype(np.int64).tolist(), len(points)
        rank, into = self._fresh(np.array(sym, np.int64), np.zeros(n, np.int64))
        queue = [(int(r) << 40) + i for i, r in enumerate(rank.tolist()) if r < _NONE]
        best, made = rank.tolist(), into.tolist()
        heapq.heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = bytearray(b"\1" * n)

        def pair(i: int) -> None:
            """Look up the pair that begins at a symbol."""
            j = after[i]
            best[i] = _NONE
            if j < n and (found := self._pair_of(sym[i], sym[j])) is not None:
                best[i], made[i] = found
                heapq.heappush(queue, (best[i] << 40) + i)

        while queue:
            r, i = divmod(heapq.heappop(queue), 1 << 40)
            if not alive[i] or best[i] != r:
                continue  # what this stood for is gone
            j = after[i]
            sym[i], alive[j], after[i] = made[i], 0, after[j]
            if after[i] < n:
                before[after[i]] = i
            pair(i)
            if before[i] >= 0:
                pair(before[i])
        out = []
        for i in range(n):
            if alive[i]:
                out += [sym[i]] if sym[i] < self.n else [int(self.byte[b]) for b in chr(points[i]).encode()]
        return np.array(out, "<u4").tobytes()

    def _pair_of(self, left: int, right: int) -> tuple[int, int] | None:
        """Rank and merged id of one pair."""
        if self.table is None:
            self.table = dict(zip(self.keys.tolist(), zip(self.rank.tolist(), self.merged.tolist(), strict=True), strict=True))
        return self.table.get(left * self.width + right)

    def _rounds(self, words: list[str]) -> list[bytes]:
        """The same by merge rounds over all words together."""
        if not words:
            return []
        points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        lens = np.array([len(w) for w in words])
        sym, word, first = self.symbol_of[points].astype(np.int64), np.repeat(np.arange(len(words)), lens), np.arange(len(points))
        done_sym, done_word, done_first = [], [], []
        rank, into = self._fresh(sym, word)
        while len(sym):
            # the segmented minimum of each word that still has a pair
            begins = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.minimum.reduceat(rank, begins)
            sizes = np.diff(np.append(begins, len(sym)))
            live = np.repeat(best < _NONE, sizes)
            if not live.all():
                done_sym.append(sym[~live])
                done_word.append(word[~live])
                done_first.append(first[~live])
                sym, word, first, rank, into = (x[live] for x in (sym, word, first, rank, into))
                sizes, best = sizes[best < _NONE], best[best < _NONE]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == np.repeat(best, sizes))
            # in a chain of overlapping occurrences every second one merges
            new = np.concatenate([[True], np.diff(at) > 1])
            chain = np.flatnonzero(new)
            at = at[(np.arange(len(at)) - np.repeat(chain, np.diff(np.append(chain, len(at))))) % 2 == 0]
            owner = word[at]
            lone = np.concatenate([[True], owner[1:] != owner[:-1]])
            if not lone.all():
                at = at[self._until_better(sym, word, rank, into, at, owner, lone)]
            sym[at] = into[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            place = np.cumsum(keep) - 1
            sym, word, first, rank, into = (x[keep] for x in (sym, word, first, rank, into))
            at = place[at]
            changed = np.zeros(len(sym) + 1, bool)  # pairs with a merged symbol on either side
            changed[at] = changed[at - 1] = True
            touched = np.flatnonzero(changed[:-1])
            right = np.minimum(touched + 1, len(sym) - 1)
            r, m = self.pairs(sym[touched], sym[right])
            rank[touched] = np.where((right > touched) & (word[touched] == word[right]), r, _NONE)
            into[touched] = m
        sym, word, first = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (done_sym, done_word, done_first))
        order = np.argsort(first)
        sym, word, first = sym[order], word[order], first[order]
        # characters without a piece: the pieces of their bytes
        ids, parts = sym.astype("<u4"), word
        odd = np.flatnonzero(sym >= self.n)
        if len(odd):
            each = [[int(self.byte[b]) for b in chr(points[first[k]]).encode()] for k in odd]
            copies = np.ones(len(sym), np.int64)
            copies[odd] = [len(x) for x in each]
            parts, ids = np.repeat(word, copies), np.repeat(ids, copies)
            ends = np.cumsum(copies)
            for k, x in zip(odd, each, strict=True):
                ids[ends[k] - len(x) : ends[k]] = x
        cuts = np.searchsorted(parts, np.arange(len(words) + 1)) * 4
        data = ids.tobytes()
        return [data[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def _fresh(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, into = np.full(len(sym), _NONE), np.zeros(len(sym), np.int64)
        if len(sym) > 1:
            r, m = self.pairs(sym[:-1], sym[1:])
            rank[:-1] = np.where(word[:-1] == word[1:], r, _NONE)
            into[:-1] = m
        return rank, into

    def _until_better(self, sym, word, rank, into, at, owner, lone) -> np.ndarray:
        """Of each word's occurrences, those up to the first whose merge makes a pair of no worse rank."""
        m, r = into[at], rank[at]
        before = np.maximum(at - 1, 0)
        chained = np.concatenate([[False], (np.diff(at) == 2)]) & ~lone
        left = np.where(chained, np.concatenate([[0], m[:-1]]), sym[before])
        has_left = (at > 0) & (word[before] == owner)
        after = np.minimum(at + 2, len(sym) - 1)
        has_right = (at + 2 < len(sym)) & (word[after] == owner)
        worse = (has_left & (self.pairs(left, m)[0] <= r)) | (has_right & (self.pairs(m, sym[after])[0] <= r))
        begins = np.flatnonzero(lone)
        total = np.cumsum(worse) - worse
        return total == np.repeat(total[begins], np.diff(np.append(begins, len(at))))

    def ids(self, text: str) -> bytes:
        """All ids of one text, begin and end included."""
        return self.batch([text])[0]

    def batch(self, texts: list[str]) -> list[bytes]:
        known, cut = self.known, self.cut
        split = [self.words(t) if cut else [MARK + t.replace(" ", MARK)] if t else [] for t in texts]
        fresh = {w for ws in split for w in ws if w not in known}
        if len(known) + len(fresh) > REMEMBERED:
            known.clear()
            fresh = {w for ws in split for w in ws}
        group, chars = [], 0
        for w in fresh:
            group.append(w)
            chars += len(w)
            if chars >= FLAT_CHARS:
                known.update(zip(group, self.merge([self.spell(w) for w in group] if cut else group), strict=True))
                group, chars = [], 0
        known.update(zip(group, self.merge([self.spell(w) for w in group] if cut else group), strict=True))
        head, tail = np.uint32(self.bos).astype("<u4").tobytes(), np.uint32(self.eos).astype("<u4").tobytes()
        return [head + b"".join(map(known.__getitem__, ws)) + tail for ws in split]

    def words(self, text: str) -> list[str]:
        """Words without the one space before each; further spaces of a run stay in front of the word.

        Where line ends merge with nothing, a line's first word has its line end in front, and no space.
        """
        if not text:
            return []
        if MARK in text:
            text = text.replace(MARK, " ")
        if self.lines and "\n" in text:
            text = text.replace("\n", " \n")
        parts = text.split(" ")
        if "" not in parts:
            return parts
        out, spaces = [], 0
        for p in parts:
            if not p:
                spaces += 1
            elif self.lines and p[0] == "\n":
                if spaces:
                    out.append(" " * (spaces - 1))
                out.append(p)
                spaces = 0
            else:
                out.append(" " * spaces + p)
                spaces = 0
        if spaces:
            out.append(" " * (spaces - 1))
        return out

    def spell(self, word: str) -> str:
        if self.lines and word[:1] == "\n":
            return word
        return MARK + word.replace(" ", MARK)

    def decode(self, ids: bytes) -> bytes:
        """The text of some ids, in UTF-8."""
        seq = np.frombuffer(ids, "<u4").astype(np.int64)
        seq = seq[(seq != self.bos) & (seq != self.eos)]
        if not len(seq):
            return b""
        lens = self.piece_len[seq]
        first = np.cumsum(lens) - lens
        data = self.piece_bytes[np.repeat(self.piece_at[seq] - first, lens) + np.arange(int(lens.sum()))].tobytes()
        if data[:1] == b" " and not self.is_byte[seq[0]]:
            data = data[1:]
        try:
            data.decode() if self.is_byte[seq].any() else None
        except UnicodeDecodeError:
            return self._mend(data)
        return data

    @staticmethod
    def _mend(data: bytes) -> bytes:
        out, at = [], 0
        while at < len(data):
            try:
                data[at:].decode()
                out.append(data[at:])
                break
            except UnicodeDecodeError as e:
                out.append(data[at : at + e.start] + "�".encode())
                at += e.start + 1
        return b"".join(out)


def model(path: str) -> MergeModel:
    if path not in _MODELS:
        _MODELS[path] = MergeModel(path)
    return _MODELS[path]


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded) of every whole text; ids as little-endian unsigned 32-bit integers."""
    small_batches(docs.sparkSession)

    def run(batches):
        m = model(path)
        for batch in batches:
            ids = m.batch([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array([m.decode(x) for x in ids], pa.binary())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary, decoded binary")


def digest(docs: DataFrame, path: str, **columns: str) -> DataFrame:
    """Counts and digests of `encode_decode`, in the same pass, so that ids need not leave the worker."""
    small_batches(docs.sparkSession)
    id_col, text_col = columns.get("id_col", "doc_id"), columns.get("text_col", "text")

    def run(batches):
        m = model(path)
        for batch in batches:
            ids = m.batch([t or "" for t in batch.column(1).to_pylist()])
            sha = lambda x: hashlib.sha256(x).hexdigest()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(map(sha, ids), pa.string()), pa.array([sha(m.decode(x)) for x in ids], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
