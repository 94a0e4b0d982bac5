"""A corpus pipeline: quality filter, line dedup, near-duplicate removal, mixing, tokens.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and read again
as the next stage's documents. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchtide.llm import quality
from watchtide.llm.bpe import encode_documents
from watchtide.llm.common import dropped, stored, table
from watchtide.llm.line_dedup import dedup_lines
from watchtide.llm.mixing import mix
from watchtide.llm.ngram_join import jaccard_components, row_key
from watchtide.llm.queries import MIX_FRACTION, mix_levels, vocabulary_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), quality.in_training)
    scored = quality.score_documents(docs, model, keep=COLUMNS, with_text="text")
    return scored.where("predicted = 1").select(*COLUMNS)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten documents or more have. Copies of a text count as one document here, so
    that they keep their lines and one of them passes the next stage."""
    kept = dedup_lines(docs, keep=("doc_id", "lang", "source"), min_docs=10, min_key_chars=1, copies_as_one=True)
    return kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.char_length("kept_text").cast("long").alias("n_chars"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents, the row with the smallest id (of several texts of that id, the one
    with the smallest key; of equal rows, one). Rows that share an id are one document; rows without id stay."""
    found = jaccard_components(docs, width=4, percent=85)
    gone = found.where("not kept").select("key").distinct()
    twice = found.where("kept and key is not null").groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    kept = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("key"), *COLUMNS).join(gone, "key", "left_anti")
    once = kept.join(twice, "key", "left_anti").select(*COLUMNS)
    return once.unionByName(kept.join(twice, "key", "left_semi").groupBy("key").agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mixture takes, each as often as it takes it."""
    mixed = mix(docs, mix_levels(), MIX_FRACTION, epochs=1, keep=COLUMNS)
    return mixed.where("copies > 0").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the decoded text."""
    return encode_documents(docs, vocabulary_path(), keep=("doc_id", "lang", "source"))


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_common_lines),
    ("ngram_jaccard", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: The classifier and the tokenizer are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's output is stored, and deleted when the next one's stands; the last stage
    reads the one before it, which stays."""
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
            if before is not None:
                dropped(before)
            before = docs
    return docs
