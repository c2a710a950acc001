"""From raw documents to token ids: toxicity, line dedup, near-duplicate dedup, mixing, BPE encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; its result is written as Parquet
in the shared folder and read again. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import vertebra
from vertebra.llm import bpe, linededup, mixing, ordermh, toxicity
from vertebra.llm.common import saved
from vertebra.llm.queries import vocabulary


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    vertebra.ship(spark)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).where("predicted = 0").select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines like an earlier one go; a document left without a word goes with its last line. n_chars follows the text.

    That is asked by counts, not of kept_text: a filter on it would cut the texts twice in each task, in two Python workers.
    """
    vertebra.ship(spark)
    out = linededup.dedup(docs, with_text=True, with_links=False).where("n_removed = 0 or n_removed < n_lines")
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    out = out.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, the one with the smallest id."""
    vertebra.ship(spark)
    return ordermh.one_of_each(docs).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, left out or repeated so that sources come near their targets."""
    vertebra.ship(spark)
    return mixing.whole_documents(mixing.mix(docs), docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, and the digests of ids and of what they decode to."""
    vertebra.ship(spark)
    return bpe.encode(docs, vocabulary(), with_text=False).select("doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [("toxicity", toxicity_stage), ("line_dedup", line_dedup_stage), ("near_dedup", near_dedup_stage), ("mixing", mixing_stage), ("encoding", encoding_stage)]

#: Learned scores, alignment and BPE are beyond SQL. tests/llm holds line dedup, near dedup and encoding against brute force
#: or the public library by operator, toxicity by accuracy, mixing by its targets; of the whole pipeline it holds the counts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
