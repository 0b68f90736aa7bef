"""The registered queries of the corpus operators, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (op01_langid, op02_toxicity, op03_licenses, op04_sharding, op05_chat, op06_quality, op07_mixing, op08_search,
               op09_jaccard, op11_classifier, op12_runs, op13_importance)
from . import op10_packing as packing
from .common import table
from .oracle import ORACLE


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op01_langid.corpus_languages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op02_toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op03_licenses.scan(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op04_sharding.shard(table(spark, sf_dir, "documents"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn int, role string, text string")
    return op05_chat.digests(turns.unionByName(extra.select(*[F.col(f.name).cast(f.dataType) for f in turns.schema])))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op06_quality.quality(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op07_mixing.mix(table(spark, sf_dir, "documents"))


def op8_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op08_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op09_jaccard.linked(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_classifier_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_classifier.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_runs.runs(table(spark, sf_dir, "documents"), change=op12_runs.planted)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_importance.weighed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_langid, op2_toxicity, op3_licenses, op4_sharding, op5_chat, op6_quality, op7_mixing, op8_search,
                                   op9_jaccard, op10_packing, op11_classifier_quality, op12_periodic_runs,
                                   op13_importance_resampling)}

__all__ = ["ORACLE", "QUERIES"]
