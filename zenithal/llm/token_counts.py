"""Token counts of documents in flat, unindexed token files, by a separator scan.

A token file is a stream of unsigned 16- or 32-bit ids in which each document ends
with the end-of-document id. `file_blocks` reads such files from a file system, a range of
bytes for each block; `write_token_files` makes them as rows (file, block, payload) of at
most `block_tokens` ids. Blocks cut documents anywhere. Each block is searched for
the separator with one vectorised comparison, and yields its separators, the run
before its first and the run after its last one. A prefix scan over the blocks of
each file (a window over counts, not over tokens) gives ordinals and stitches the
documents that cross blocks. Hot files are no problem: a block is one short row.

Nulls and edges: a null or empty text is an empty document, and a null id is carried; rows
that repeat are counted each; an empty table gives no files and no counts; of the documents' other
columns none is read, whatever its name; a text of any length is cut into blocks. A null payload counts as empty; a file without a separator holds
one unended document; two separators in a row hold an empty document of length 0;
ids after the last separator are an unended document (`ended` false); a file whose bytes are no
whole number of ids is refused.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Kept, small_batches
from .packing import byte_bpe


def write_token_files(docs: DataFrame, tokenizer: str, eod: int, block_tokens: int = 1 << 16, id_col: str = "doc_id", text_col: str = "text") -> tuple[Kept, DataFrame]:
    """Token files of the documents, one for each partition: (file, block, payload), and (file, ordinal, doc_id), the order of the documents.

    The manifest holds no lengths or offsets: those come from the scan.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        bpe, file, held, have, block, first = byte_bpe(tokenizer, True), TaskContext.get().partitionId(), [], 0, 0, 0

        def cut(to: int):
            nonlocal held, have, block
            stream = np.concatenate(held) if held else np.zeros(0, "<u2")
            while have and have >= to:
                yield stream[:block_tokens].tobytes()
                stream, have = stream[block_tokens:], max(0, have - block_tokens)
            held = [stream]

        def rows(payloads, ids):
            nonlocal block
            k = len(payloads)
            out = pa.RecordBatch.from_arrays([pa.array([file] * (k + 1), pa.int64()), pa.array([*range(block, block + k), None], pa.int64()), pa.array([*payloads, None], pa.binary()), pa.array([None] * k + [first], pa.int64()), pa.array([None] * k + [ids], pa.list_(pa.int64()))], ["file", "block", "payload", "first", "ids"])
            block += k
            return out

        for batch in batches:
            for text in batch.column(1).to_pylist():
                tokens = bpe.encode(text) if text else np.zeros(0, np.uint32)
                held.append(np.append(tokens, np.uint32(eod)).astype("<u2"))
                have += len(tokens) + 1
            ids = batch.column(0).cast(pa.int64()).to_pylist()
            yield rows(list(cut(block_tokens)), ids)
            first += len(ids)
        yield rows(list(cut(1)), [])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kept = Kept(picked.mapInArrow(run, "file long, block long, payload binary, first long, ids array<long>"), "token-files")
    order = kept.df.where("first is not null").select("file", "first", F.posexplode("ids").alias("at", "doc_id")).select("file", (F.col("first") + F.col("at")).alias("ordinal"), "doc_id")
    return kept, order


def file_blocks(spark: SparkSession, path: str, id_bytes: int = 2, block_tokens: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """Flat token files under a path: (file, block, payload), each block a range of its file's bytes; and (file, path).

    Spark lists the files and deals out the ranges; each task reads its ranges with Arrow's
    file systems (local, HDFS, S3, GCS), so that no file is ever held as a whole.
    """
    small_batches(spark)
    size = block_tokens * id_bytes
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    whole = F.when(F.col("length") % id_bytes == 0, F.col("length")).otherwise(F.raise_error(F.concat(F.col("path"), F.lit(f" is no whole number of {id_bytes}-byte ids"))).cast("long"))
    named = files.select(F.xxhash64("path").alias("file"), "path", whole.alias("length"))
    last = F.greatest(F.ceil(F.col("length") / size) - 1, F.lit(0))
    ranges = named.select("file", "path", "length", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))
    dealt = ranges.repartition("file", F.floor(F.col("block") / 16)).select("file", "block", "path", (F.col("block") * size).alias("at"), F.least(F.lit(size), F.col("length") - F.col("block") * size).alias("n"))

    def read(batches):
        from pyarrow import fs

        for batch in batches:
            for file, block, name, at, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, place = fs.FileSystem.from_uri(name)
                with system.open_input_file(place) as f:
                    payload = f.read_at(n, at)
                yield pa.RecordBatch.from_arrays([pa.array([file], pa.int64()), pa.array([block], pa.int64()), pa.array([payload], pa.binary())], ["file", "block", "payload"])

    return dealt.mapInArrow(read, "file long, block long, payload binary"), named.select("file", "path")


def count_tokens(blocks: DataFrame, eod: int, id_bytes: int = 2) -> DataFrame:
    """(file, ordinal, n_tokens, ended) of every document in the token files (file, block, payload)."""

    def scan(batches):
        kind = np.dtype(f"<u{id_bytes}")
        for batch in batches:
            seps, heads, tails, inner = [], [], [], []
            for payload in batch.column(2).to_pylist():
                ids = np.frombuffer(payload or b"", kind)
                at = np.flatnonzero(ids == eod)
                seps.append(len(at))
                heads.append(int(at[0]) if len(at) else len(ids))
                tails.append(len(ids) - 1 - int(at[-1]) if len(at) else len(ids))
                inner.append((np.diff(at) - 1).tolist() if len(at) else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in (seps, heads, tails)), pa.array(inner, pa.list_(pa.int64()))], ["file", "block", "seps", "head", "tail", "inner"])

    found = blocks.select("file", "block", "payload").mapInArrow(scan, "file long, block long, seps long, head long, tail long, inner array<long>")
    # the prefix scan: separators before the block, and the run that is open as it begins
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = F.max(F.when(F.col("seps") > 0, F.col("block"))).over(before)
    stitched = found.select("file", "block", "seps", "head", "tail", "inner", F.coalesce(F.sum("seps").over(before), F.lit(0)).alias("ordinal"), last.alias("last"), F.lead("block").over(Window.partitionBy("file").orderBy("block")).isNull().alias("final"), F.coalesce(F.sum("tail").over(before), F.lit(0)).alias("run"))
    # tails of the blocks since the last separator: a running sum less its value before that block
    at_last = F.max_by(F.col("run"), F.when(F.col("seps") > 0, F.col("block"))).over(before)
    stitched = stitched.select("*", (F.col("run") - F.coalesce(at_last, F.lit(0))).alias("open"))
    ended = stitched.where("seps > 0").select("file", "ordinal", F.posexplode(F.concat(F.array(F.col("open") + F.col("head")), "inner")).alias("at", "n_tokens")).select("file", (F.col("ordinal") + F.col("at")).alias("ordinal"), "n_tokens", F.lit(True).alias("ended"))
    rest = stitched.where("final").select("file", (F.col("ordinal") + F.col("seps")).alias("ordinal"), F.when(F.col("seps") > 0, F.col("tail")).otherwise(F.col("open") + F.col("tail")).alias("n_tokens"), F.lit(False).alias("ended")).where("n_tokens > 0")
    return ended.union(rest)
