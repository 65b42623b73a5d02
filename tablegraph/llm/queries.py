"""The registered queries of this folder, and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib.util
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tablegraph.llm import (
    alignment,
    decontaminate,
    fuzzy,
    jaccard,
    licenses,
    outliers,
    packing,
    passages,
    quality,
    sharding,
    tokens,
    toxicity,
    whitening,
)
from tablegraph.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def ranks_path() -> str:
    """The public vocabulary: ``TOKENIZER_RANKS``, or the file of the installed package."""
    chosen = os.environ.get("TOKENIZER_RANKS")
    if chosen:
        return chosen
    package = importlib.util.find_spec("public_tokenizers")
    return os.path.join(os.path.dirname(package.origin), "byte_bpe_50k.tiktoken")


def query(name: str):
    def register(function):
        QUERIES[name] = lambda spark, sf_dir: function(configure(spark), sf_dir.rstrip("/"))
        return function

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op1_packing")
def op1(spark, sf):
    return packing.pack(table(spark, sf, "documents"), ranks_path())


@query("op2_toxicity")
def op2(spark, sf):
    return toxicity.score(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op3_sharding")
def op3(spark, sf):
    return sharding.shard(table(spark, sf, "documents"))


@query("op4_decontamination")
def op4(spark, sf):
    return decontaminate.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op5_license_scan")
def op5(spark, sf):
    return licenses.scan(table(spark, sf, "documents"))


@query("op6_jaccard_join")
def op6(spark, sf):
    return jaccard.link(table(spark, sf, "documents"))


@query("op7_quality_rules")
def op7(spark, sf):
    return outliers.judge(table(spark, sf, "documents"))


@query("op8_quality_classifier")
def op8(spark, sf):
    return quality.classify(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op9_token_counts")
def op9(spark, sf):
    return tokens.count_tokens(table(spark, sf, "documents"), ranks_path())


@query("op10_substring_dedup")
def op10(spark, sf):
    return passages.merged(passages.shared_passages(table(spark, sf, "documents")))


@query("op11_tokenizer_alignment")
def op11(spark, sf):
    return alignment.align(table(spark, sf, "documents"), ranks_path(), alignment.piece_path())


@query("op12_embedding_whitening")
def op12(spark, sf):
    return whitening.whiten(table(spark, sf, "embeddings"))


@query("op13_simhash_near_dedup")
def op13(spark, sf):
    return fuzzy.near_duplicates(table(spark, sf, "documents"))
