"""A training corpus from raw documents, in five stages.

Every stage but the last takes and returns documents (doc_id, text, lang, source, n_chars); each works on what
its predecessor kept, and its decisions take effect. The last returns token counts and digests.

Null or empty texts have no letter and go in the first stage. Rows that share an id are one document to the
near-duplicate stage: it goes or stays with all its texts, and of rows with one id and one text the one that comes first
as JSON stays. An empty table gives an empty result; columns beyond those of documents, of any name, go through the
first four stages unchanged.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import bpe, decontam, langid, linededup, minhash
from veilspark.llm.common import joinable, shared_dir, table, written

#: The stages rest on trained weights and merges, which SQL can't express; a test runs brute-force versions.
ORACLE_SQL = None


def counted(docs: DataFrame, names: list[str]) -> DataFrame:
    """n_chars as the text now is, columns in their order."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*(f"`{n}`" for n in names))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the calibrated model rejects, or that have no letter."""
    names = ("langid_label", "langid_score", "langid_rejected")
    return langid.predict(docs, langid.fit(docs, F.lit(True)), names=names).where(~F.col(names[2])).drop(*names)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without repeated lines, and without the documents that consist of them."""
    return counted(linededup.dedup(docs), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id."""
    gone = written(minhash.near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct(), "near-gone")
    left = docs.join(joinable(gone), "doc_id", "left_anti").select(*(f"`{n}`" for n in docs.columns))
    again = written(left.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id"), "repeated-ids")
    if again.isEmpty():
        return left
    small = joinable(again)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    once = left.join(small, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*")
    return left.join(small, "doc_id", "left_anti").select(*(f"`{c}`" for c in docs.columns)).unionByName(once)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents of which a twentieth or more are benchmark passages; shorter passages are cut out of the rest."""
    return counted(decontam.decontaminate(docs, table(spark, sf_dir, "benchmark")), docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and the digests of ids and decoded text. The codec's tables are small, as executors still hold memory
    of the stages before."""
    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, memo=100_000, max_states=60_000, rows=200)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    base = shared_dir(spark, "pipeline")
    for n, (name, stage) in enumerate(STAGES):
        path = f"{base}/{n}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
