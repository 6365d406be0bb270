"""Packing of tokenised documents into sequences of one length: concatenate and cut.

Two passes. The first encodes each partition of the documents and writes the ids
with each document's place in its partition. Prefix sums over the partitions'
token totals (one number for each partition) then give every document its global
place, and the second pass cuts at multiples of the length. A document that crosses
a cut becomes boundary records: one piece on each side. No shuffle.

Nulls and edges: a null or empty text is the separator alone; a null id is carried;
repeated rows are packed each for itself; an empty table gives no pieces; other
columns are not read.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Kept, lean, small_batches

SPECIAL = "<|endoftext|>"
_TOKENIZERS: dict[str, object] = {}


class ByteBpe:
    """The ids that the tokenizers library gives for a byte-level BPE file, without special tokens added.

    Where the same vocabulary also lies beside it as ranks, tiktoken encodes (the
    same ids, four times as fast), and the library's tokenizer is read when a text
    needs it. The special token's own string in a text is its id, as the library has
    it, unless `ordinary` says that it is plain text.
    """

    def __init__(self, path: str, ordinary: bool = False):
        import base64
        import os

        self.path, self.ordinary, self.fast = path, ordinary, None
        ranks = os.path.splitext(path)[0] + ".tiktoken"
        if os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    @functools.cached_property
    def slow(self):
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        out = Tokenizer.from_file(self.path)
        out.encode_special_tokens = self.ordinary
        return out

    def encode(self, text: str) -> np.ndarray:
        if self.fast is None or (not self.ordinary and SPECIAL in text):
            return np.asarray(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.asarray(self.fast.encode_to_numpy(text), np.uint32)


def byte_bpe(path: str, ordinary: bool = False) -> ByteBpe:
    """One tokenizer for each worker process and file."""
    if (key := f"{path}|{ordinary}") not in _TOKENIZERS:
        _TOKENIZERS[key] = ByteBpe(path, ordinary)
    return _TOKENIZERS[key]


def encoded(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", ordinary: bool = False) -> DataFrame:
    """(part, begin, doc_id, ids): ids as little-endian unsigned 32-bit integers, end_id last; begin counts within the partition."""
    small_batches(docs.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        bpe, part, begin = byte_bpe(tokenizer, ordinary), TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, begins = [], []
            for text in batch.column(1).to_pylist():
                tokens = bpe.encode(text) if text else np.zeros(0, np.uint32)
                ids.append(np.append(tokens, np.uint32(end_id)).astype("<u4").tobytes())
                begins.append(begin)
                begin += len(tokens) + 1
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(ids), pa.int64()), pa.array(begins, pa.int64()), batch.column(0).cast(pa.int64()), pa.array(ids, pa.binary())], ["part", "begin", "doc_id", "ids"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(lean(run), "part long, begin long, doc_id long, ids binary")


def concatenate_and_cut(tokens: DataFrame, length: int = 1024) -> DataFrame:
    """Pieces of `encoded` documents: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    The driver gets one total for each partition of the input, which the number of
    partitions bounds; the rows themselves stay where they are.
    """
    totals = tokens.groupBy("part").agg(F.sum(F.length("ids") / 4).cast("long").alias("n")).orderBy("part").collect()
    base, at = {}, 0
    for row in totals:
        base[row.part] = at
        at += row.n

    def run(batches):
        for batch in batches:
            out = {k: [] for k in ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")}
            for part, begin, doc, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n, start, place = len(ids) // 4, 0, base[part] + begin
                while start < n:
                    take = min(n - start, length - place % length)
                    for k, v in zip(out, (doc, start, take, ids[4 * start : 4 * (start + take)], n, place // length, place % length), strict=True):
                        out[k].append(v)
                    start += take
                    place += take
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if k == "ids" else pa.int64()) for k, v in out.items()], list(out))

    return tokens.select("part", "begin", "doc_id", "ids").mapInArrow(lean(run), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, length: int = 1024, **columns: str) -> DataFrame:
    """Pieces of all documents, packed into sequences of `length` tokens."""
    small_batches(docs.sparkSession)
    kept = Kept(encoded(docs, tokenizer, end_id, **columns), "tokens")
    return concatenate_and_cut(kept.df, length)


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum instead of their ids."""

    def run(batches):
        for batch in batches:
            crc = pa.array([zlib.crc32(x) for x in batch.column("ids").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("doc_id", "start", "length")), crc, *(batch.column(k) for k in ("doc_tokens", "sequence_id", "offset"))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return pieces.mapInArrow(lean(run), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
