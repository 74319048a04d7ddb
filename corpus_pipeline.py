"""The corpus pipeline: five stages over `documents`, each on all that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is
written as Parquet and read back as the next stage's docs.  All but the last
return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import bpe, decontaminate, neardup, secrets, toxicity
from rasterloom.llm.storage import materialise

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the toxicity operator predicts toxic; it learns from the labelled ones among docs."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs.select(*COLUMNS), model, keep=COLUMNS).filter("predicted = 0").select(*COLUMNS)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked at a similarity of 0.8 or more (five-word shingles), keep the document with the smallest id.

    One row stays, also where rows repeat (equal id and text) or all ids of a
    group are null; documents without words are in no group and all stay.
    """
    found = neardup.near_duplicates(docs, width=5, percent=80)
    best = found.filter("component is not null").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("k_null"), F.col("doc_id").alias("k_id"), F.col("th").alias("k_th"))).alias("k"))
    keep = best.select("k.*").union(found.filter("component is null").select(F.col("doc_id").isNull(), "doc_id", "th").distinct())
    keep = keep.select("k_null", F.coalesce("k_id", F.lit(0)).alias("k_id"), "k_th")
    rows = docs.select(*COLUMNS, F.xxhash64("text").alias("k_th"), F.col("doc_id").isNull().alias("k_null"), F.coalesce("doc_id", F.lit(0)).alias("k_id"))
    rows = rows.withColumn("k_row", F.when(F.coalesce(F.col("text").rlike(r"[^ \t-\r]"), F.lit(False)), 0).otherwise(F.monotonically_increasing_id()))
    key = ["k_th", "k_null", "k_id"]
    return rows.join(keep.hint("shuffle_hash"), key, "left_semi").dropDuplicates([*key, "k_row"]).select(*COLUMNS)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in which a window of a benchmark item occurs."""
    found = decontaminate.decontaminate(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=COLUMNS)
    return found.filter("not contaminated").select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret by its kind in brackets; n_chars follows the new text."""
    found = secrets.scan(docs.select(*COLUMNS), keep=("doc_id", "lang", "source", "n_chars"), redacted=True)
    size = F.when(F.col("n_spans") > 0, F.length("redacted").cast("long")).otherwise(F.col("n_chars"))
    return found.select("doc_id", F.col("redacted").alias("text"), "lang", "source", size.alias("n_chars"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and the ids of each text."""
    vocab = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode(docs, vocab, public_tokenizers.PATTERN, keep=("doc_id", "lang", "source"))


STAGES = [
    ("toxicity", remove_toxic),
    ("minhash_near_dedup", remove_near_duplicates),
    ("benchmark_decontamination", remove_contaminated),
    ("secret_scans", redact_secrets),
    ("byte_bpe", tokenize),
]

#: Fitted models and signatures are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return materialise(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0])
