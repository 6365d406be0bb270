"""The corpus pipeline: stages over the documents table, each one operator's decision carried out.

Language identification rejects texts without a letter and, of those that are long enough
to tell, the ones whose likeness to every language is no more than chance gives; of each group of near copies (five-word shingles,
Jaccard 0.8) the document of the smallest id stays; passages of 50 words or more that an
earlier document has are cut; personal data gives way to its kind; what is left is packed
into sequences.

Nulls and edges: a null or empty text is in no language and goes in the first stage; of rows
that have both id and text in common one stays, rows that share an id alone are one document
whose rows stay or go together, and rows without an id are no copies of others; further columns are
carried, whatever their names; an empty table gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zenithal.llm import langid, ngram_join, packing, pii, suffix_dedup
from zenithal.llm.common import Kept, fresh
from zenithal.llm.queries import BPE, tokenizer_path

#: Deviations of the cosine of unrelated profiles, which is 1 / sqrt(size), below which a text's likeness counts as chance.
CHANCE = 3.0
#: Characters from which a text's likeness tells; of random letters, about 97 in 100 such texts stay under chance.
TELLS = 64


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in some language; lang stays as it is."""
    model = langid.fit(docs)
    lang, likeness = (fresh(docs.columns, c) for c in ("lang_pred", "likeness"))
    found = langid.predict(docs, model, names=(lang, likeness))
    like = (F.col(likeness) >= CHANCE / model.size**0.5) | (F.length("text") < TELLS)
    return found.where((F.col(lang) != langid.UNDETERMINED) & like).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each component of near copies."""
    found = ngram_join.components(docs, n=5, num=80, den=100)
    later = found.where("component_id <> doc_id").select("doc_id")
    kept = docs.join(later, "doc_id", "left_anti").select(*docs.columns)
    key = fresh(docs.columns, "id")
    twice = Kept(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias(key)), "twice").df
    if twice.isEmpty():
        return kept
    same = F.col("doc_id").eqNullSafe(F.col(key))
    again = kept.join(twice, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(twice, same, "left_anti").union(again)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document of a smaller id has; without those of which nothing is left."""
    return suffix_dedup.without_repeats(docs, suffix_dedup.repeats(docs, length=50))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return pii.redacted(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 tokens."""
    return packing.digest(packing.pack(docs, tokenizer_path(BPE), end_id=0, length=1024))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("personal_data", personal_data), ("packing", packed)]

#: Language profiles, tokenizers and transducers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the documents; each but the last is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = Kept(stage(spark, docs, sf_dir), name).df
    return STAGES[-1][1](spark, docs, sf_dir)
