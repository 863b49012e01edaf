"""The corpus pipeline: stages over `documents`, each written as Parquet and read by the next.

Rules: a row with a null text is scored, compared and decontaminated as one without words, and mixing, which copies
words, drops it with all empty texts. Rows with a null doc_id pass the near-duplicate stage (only rows equal in id
and text are copies there) and are judged as others elsewhere; rows that share a doc_id are judged row by row. Null sources
and languages are values. Ties go to the smaller doc_id, then to the smaller SHA-256 of the text. A text of any length
is one row in every stage. Extra columns are carried to the end, whatever their names; a column `shard` is
replaced. Empty tables of documents, labels or benchmark items give what is left: no rows, no toxic ones, no hits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.decontam import drop_contaminated
from tessera.llm.exchange import shared_dir
from tessera.llm.mixing import mix_documents
from tessera.llm.ngram_join import near_dedup
from tessera.llm.sharding import shard_documents
from tessera.llm.toxicity import drop_toxic


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup(docs, width=5, threshold=(80, 100))


def _decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), short_alone=False)


def _mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_documents(docs)


def _sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shard_documents(docs, n_shards=40)


STAGES = [
    ("toxicity", _toxicity),
    ("ngram_join", _near_duplicates),
    ("decontamination", _decontamination),
    ("mixing", _mixing),
    ("sharding", _sharding),
]

#: A trained classifier and dependent rounding have no SQL. Tests read each stage that run() has written and hold it
#: against brute force on the stage before it; the classifier's decisions are held against its own scores and the labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, home = spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_dir(spark)
    for name, stage in STAGES:
        path = f"{home}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
