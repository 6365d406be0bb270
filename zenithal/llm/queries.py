"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, exact_topk, langid, ngram_join, packing, pii, sentencepiece_bpe, suffix_dedup, token_counts, toxicity
from .common import table

BPE, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: <|endoftext|> of the byte-level vocabulary.
EOD = 50256


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _fold(col: str, n: int):
    """The remainder of the CRC-32 of an id as text."""
    return F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(n))


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return ann.search(e, e.where("vec_id % 50 = 0"), k=5)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(BPE), end_id=0, length=1024))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return exact_topk.search(e, e.where("vec_id % 50 = 0"), k=5)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(_fold("doc_id", 3) == 1, F.lit(False))
    model = langid.fit(docs.where(~held).where("lang is not null"))
    return langid.predict(docs.select("doc_id", held.alias("held_out"), "text"), model, keep=["doc_id", "held_out"])


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(_fold("doc_id", 5) == 0, F.lit(False))
    voter = toxicity.fit(table(spark, sf_dir, "labels").where(~held), docs)
    scored = toxicity.score(docs.select("doc_id", held.alias("held_out"), "text"), voter, keep=["doc_id", "held_out"])
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence", "similarity")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = suffix_dedup.repeats(table(spark, sf_dir, "documents"), length=50)
    cuts = F.transform(F.arrays_zip("cut_starts", "cut_ends"), lambda c: F.concat_ws(":", c["cut_starts"].cast("string"), c["cut_ends"].cast("string")))
    return spans.select("doc_id", "start", "end", "first_doc", F.concat_ws(",", cuts).alias("cuts"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.digest(table(spark, sf_dir, "documents"), tokenizer_path(PIECES))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(table(spark, sf_dir, "documents"), n=4, num=85, den=100)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.spans(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, order = token_counts.write_token_files(table(spark, sf_dir, "documents"), tokenizer_path(BPE), EOD)
    counts = token_counts.count_tokens(files.df.where("block is not null"), EOD)
    return order.join(counts.where("ended"), ["file", "ordinal"]).select("doc_id", "n_tokens")


QUERIES = {f.__name__: f for f in (op1_ann, op2_packing, op3_exact_topk, op4_language_id, op5_toxicity, op6_suffix_dedup, op7_sentencepiece, op8_ngram_join, op9_pii, op10_token_counts)}

#: DuckDB SQL for the operators that it can express.
ORACLE: dict[str, str] = {
    "op3_exact_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
        )
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
        FROM s QUALIFY rank <= 5
    """,
    "op6_suffix_dedup": """
        WITH w AS (
            SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents WHERE text IS NOT NULL
        ), r AS (
            SELECT doc_id, i - 1 AS a, array_to_string(ws[i : i + 49], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)
        ), l AS (SELECT g, min(doc_id) AS leader FROM r GROUP BY g HAVING min(doc_id) <> max(doc_id)),
        s AS (
            SELECT doc_id, a, leader, sum(fresh) OVER (PARTITION BY doc_id ORDER BY a) AS span FROM (
                SELECT doc_id, a, leader, CASE WHEN a <= lag(a) OVER (PARTITION BY doc_id ORDER BY a) + 50 THEN 0 ELSE 1 END AS fresh FROM r JOIN l USING (g))
        ), c AS (
            SELECT doc_id, span, min(a) AS a, max(a) + 50 AS b FROM (
                SELECT doc_id, span, a, sum(fresh) OVER (PARTITION BY doc_id ORDER BY a) AS cut FROM (
                    SELECT doc_id, span, a, CASE WHEN a <= lag(a) OVER (PARTITION BY doc_id ORDER BY a) + 50 THEN 0 ELSE 1 END AS fresh FROM s WHERE leader <> doc_id))
            GROUP BY doc_id, span, cut
        ), k AS (SELECT doc_id, span, string_agg(a || ':' || b, ',' ORDER BY a) AS cuts FROM c GROUP BY doc_id, span)
        SELECT s.doc_id, min(a) AS start, max(a) + 50 AS "end", min(leader) AS first_doc, coalesce(any_value(cuts), '') AS cuts
        FROM s LEFT JOIN k ON k.doc_id = s.doc_id AND k.span = s.span GROUP BY s.doc_id, s.span
    """,
    "op8_ngram_join": """
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
                ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i : i + 3], ' ')) END) AS g FROM w
        ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        links AS (
            SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id
            JOIN n nx ON nx.doc_id = x.doc_id JOIN n ny ON ny.doc_id = y.doc_id
            GROUP BY x.doc_id, y.doc_id, nx.n, ny.n HAVING 100 * count(*) >= 85 * (nx.n + ny.n - count(*))
        ), reach AS (
            SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
        )
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.b) AS component_id
        FROM documents d JOIN reach r ON r.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id, n.n
    """,
}
