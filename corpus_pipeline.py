"""From raw documents to packed batches: language, exact copies, near copies, repeated passages, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgml.llm.common import dropped, numbered, pin, pinned
from sparkgml.llm.exact import exact_dedup
from sparkgml.llm.language import fit_profiles, with_language
from sparkgml.llm.packing import pack
from sparkgml.llm.simhash import simhash_dedup
from sparkgml.llm.suffix import suffix_dedup


#: Half of what the strangest document of the test tables has: below it hardly an n-gram is any language's.
MIN_SCORE = 0.2


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops null texts, texts without letters, and texts whose score against the nearest profile is below MIN_SCORE; fills a null lang.

    A profile of fewer than 600 n-grams rejects nothing, and without profiles
    letters alone decide.
    """
    return with_language(docs, fit_profiles(docs), min_score=MIN_SCORE)


def without(rows: DataFrame, decisions: DataFrame, columns: list[str]) -> DataFrame:
    """The `columns` of the numbered `rows` less those that are decided against."""
    left = rows.join(decisions.where("not kept").select("doc_id"), "doc_id", "left_anti")
    return left.select(*[F.col("__doc_id").alias(c) if c == "doc_id" else F.col(c) for c in columns])


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of equal texts; null and empty texts are equal, null and repeated doc_ids rows of their own."""
    rows, _ = numbered(docs)
    return without(rows, exact_dedup(rows), docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the smallest doc_id of each component of near copies (0.8 of 5-word shingles).

    A null doc_id counts as the greatest; null and repeated doc_ids are rows of
    their own; texts without words are copies of each other.
    """
    rows, _ = numbered(docs, nulls_first=False)
    return without(rows, simhash_dedup(rows, shingle=5, similarity=0.8), docs.columns)


def passages_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes strings of 100 bytes that start earlier; every row stays, with what is left of its text.

    Null doc_ids come first, repeated ones are documents of their own; a null
    text comes back empty, and n_chars is that of what is left.
    """
    cut = suffix_dedup(docs, carry=True).select("row", F.col("kept_text").alias("text"))
    kept = {"text": F.col("text"), "n_chars": F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return cut.select(*[(kept[c] if c in kept else F.col("row")[c]).alias(c) for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each row: its length in tokens, bucket, shard, batch and position; null and empty texts have length 0."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("suffix_dedup", passages_stage),
    ("packing", packing_stage),
]

#: SQL can't express the stages; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each one's result is written before the next reads it, and what it was made from goes."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in STAGES[:-1]:
        before = pinned()
        docs = pin(stage(spark, docs, sf_dir))
        *parts, own = [p for p in pinned() if p not in before]
        dropped(spark, last + parts)
        last = [own]
    return STAGES[-1][1](spark, docs, sf_dir)
