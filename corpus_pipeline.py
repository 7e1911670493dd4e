"""A pipeline from raw documents to tokens. Each stage is written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftline.llm.common import documents, stored
from driftline.llm.queries import tokenizer_path


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified with a probability of at least one half."""
    from driftline.llm.langid import accepted

    return accepted(docs, least=0.5)


def unrepeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines of 20 or more characters that stand, up to one edit, at an earlier place."""
    from driftline.llm.lines import without_repeats

    return without_repeats(docs)


def unlike_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates by SimHash: that with the smallest id."""
    from driftline.llm.simhash import keep_first

    return keep_first(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of its source takes it: not at all, once or twice."""
    from driftline.llm.mix import taken

    return taken(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of what they decode to, a row per row of the mix."""
    from driftline.llm.bpe import round_trip

    return round_trip(docs, tokenizer_path())


STAGES = [
    ("language_id", known_language),
    ("line_dedup", unrepeated_lines),
    ("simhash_near_dedup", unlike_documents),
    ("source_mix", mixed_sources),
    ("bpe_round_trip", encoded),
]
#: language identification is a trained model, which SQL can't express; tests use a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
