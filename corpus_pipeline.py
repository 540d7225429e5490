"""A training corpus from the documents table, in five stages.

Each stage takes all that its predecessor kept; its result is written as Parquet to the
shared folder and read again. All stages but the last return the columns of ``documents``.

1. toxicity: documents whose restored text scores 0.7 or more go.
2. line dedup: fuzzy copies of lines go, all but the first of the table (lines too short for
   a shingle by exact copies). A document goes only if it had words and none are left.
3. near duplicates: of each component of documents that share 0.8 of their five-word
   n-grams, the one of the least doc_id stays.
4. decontamination: documents that hold a benchmark item go.
5. BPE: token ids and the digests of ids and decoded text, one row for each document.

Null and empty texts pass every stage (they are neither toxic, copies nor leaks) and end as
documents without tokens. Rows with a null doc_id pass the stages that compare documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwise.llm import bpe, decontamination, line_dedup, linking, ngram_join, toxicity

VOCABULARY = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, _table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(docs)
    changed = F.size("removed_lines") > 0
    return kept.where(~changed | F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")) \
        .withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))) \
        .select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    classes = ngram_join.ngram_components(docs, n=5, num=80, den=100)
    copies = classes.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.without_leaks(docs, _table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(docs, public_tokenizers.path(VOCABULARY), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("bpe", tokenize),
]

#: SQL can't express Viterbi decoding, MinHash, an SVD or BPE; tests/llm holds run() against
#: brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = linking.landed(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
