"""The registered queries of this package and SQL for the same rows."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gapscore.llm import oracles
from gapscore.llm.conversations import repaired_conversations
from gapscore.llm.exact_dedup import duplicate_groups
from gapscore.llm.html_text import extracted
from gapscore.llm.line_dedup import without_repeated_chunks
from gapscore.llm.mixing import mixed_words
from gapscore.llm.nearest import nearest
from gapscore.llm.packing import packed
from gapscore.llm.quality import resampled
from gapscore.llm.simhash import near_duplicates
from gapscore.llm.spelling import spelling_variants
from gapscore.llm.substring_dedup import without_repeats
from gapscore.llm.token_counts import token_counts
from gapscore.llm.toxicity import scored


def vocabulary() -> tuple[str, str, tuple[tuple[str, int], ...]]:
    """The path of the byte-level BPE ranks, its pattern, and the added tokens with their ids."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        added = tuple((token["content"], token["id"]) for token in json.load(file)["added_tokens"])
    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, added


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(_table(spark, sf_dir, "documents"), with_kept=False)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(_table(spark, sf_dir, "documents"), *vocabulary())


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(_table(spark, sf_dir, "pages"))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = without_repeated_chunks(_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "text", "n_lines", "n_removed")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_groups(_table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_words(_table(spark, sf_dir, "documents"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(_table(spark, sf_dir, "documents"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired_conversations(_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_packing": op3_packing,
    "op4_toxicity": op4_toxicity,
    "op5_html_text": op5_html_text,
    "op6_nearest": op6_nearest,
    "op7_line_dedup": op7_line_dedup,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_simhash": op9_simhash,
    "op10_mixing": op10_mixing,
    "op11_spelling": op11_spelling,
    "op12_token_counts": op12_token_counts,
    "op13_conversations": op13_conversations,
}

ORACLES: dict[str, str] = {
    "op7_line_dedup": oracles.LINE_DEDUP,
    "op8_exact_dedup": oracles.EXACT_DEDUP,
    "op10_mixing": oracles.MIXING,
}
