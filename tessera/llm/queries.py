"""The registered queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontam import decontaminate
from .line_dedup import line_dedup
from .mixing import mix
from .ngram_join import ngram_join
from .quality import quality
from .sharding import shard
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup
from .token_files import token_files
from .toxicity import toxicity


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_docs(spark, sf_dir), window=13, keep_text=False)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(_docs(spark, sf_dir))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_files(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_docs(spark, sf_dir), weights=(3, 1, 2))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_docs(spark, sf_dir))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(_docs(spark, sf_dir), n_shards=40, overhead=16)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(_docs(spark, sf_dir), keep_text=False)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(_docs(spark, sf_dir), width=4, threshold=(85, 100))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
