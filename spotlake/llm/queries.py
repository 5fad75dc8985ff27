"""The subpackage's queries, by name, each over its whole table with production parameters."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import resample, sharding, substring
from .common import read

ORACLES: dict[str, str] = {"op1_sharding": sharding.ORACLE, "op8_substring": substring.ORACLE, "op12_resampling": resample.ORACLE}


def tokenizer(name: str) -> str:
    """Where the installed public tokenizer files are."""
    return importlib.import_module("public_tokenizers").path(name)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.interleave(read(spark, sf_dir, "documents"), 40)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode_digests

    return encode_digests(read(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .site_tree import main_text

    return main_text(read(spark, sf_dir, "pages"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import identify

    return identify(read(spark, sf_dir, "documents"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .multiset import fingerprint_pairs

    return fingerprint_pairs(read(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import hex_of, near_duplicates

    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_of(found["fp"]).alias("fingerprint"), "component_id")


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_digests(read(spark, sf_dir, "documents"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .multi_index import search

    return search(read(spark, sf_dir, "embeddings"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_tokens

    return pack_tokens(read(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op11_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quantiles import shop_quantiles

    return shop_quantiles(*(read(spark, sf_dir, name) for name in ("clicks", "sale_lines", "items")))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .brown import scored

    return scored(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
