"""A corpus pipeline of five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftspark.llm import mixing, near_dedup, piece_tokens, ppm_language, suffix_dedup
from weftspark.llm.common import crc_of_id, forget, kept, read_table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (`und`) go. The trees are learned as in op6: not from every fourth id by checksum."""
    tables = ppm_language.fit(ppm_language.gram_counts(docs.where(crc_of_id() % 4 != 2)))
    return ppm_language.with_language(docs, tables)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest id stays."""
    return near_dedup.keep_one(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes that also stand earlier, in strings of 100, leave the texts; texts of which nothing is left go."""
    return suffix_dedup.without_repeats(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as its source's target asks."""
    return mixing.mix(docs)


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Numbers of tokens and digests of each row's ids and of their decoding."""
    import public_tokenizers

    return piece_tokens.token_digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("mixed_sources", mixed_sources),
    ("piece_ids", piece_ids),
]
#: The language, alignment and tokenizer stages have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, kept(stage(spark, docs, sf_dir), name)
        forget(before)
    return docs
