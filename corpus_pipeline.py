"""Corpus pipeline: documents in, the training mix out.

Each stage takes ``(spark, docs, sf_dir)`` and returns the rows it keeps; stages are
written as Parquet and read again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carbonsplit.llm import decontamination, line_dedup, mixing, simhash, toxicity
from carbonsplit.llm.common import cut, read_table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores 0.7 or more go; it learns from those labelled documents that are in ``docs``."""
    return toxicity.kept(docs, read_table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier line go, and documents of which no words are left."""
    return line_dedup.without_repeats(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents whose fingerprints over three-word shingles are linked by at most two differing bits the one with the smallest id stays."""
    return simhash.one_of_each(docs, shingle=3, radius=2)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ten consecutive words of a benchmark item, or all of a shorter one, go."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    found = decontamination.contaminated_words(rows, read_table(spark, sf_dir, "benchmark"), keep=("row",))
    return found.filter("n_hit = 0").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; ``copy`` counts from 1."""
    return mixing.mixed_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
]

#: The model-based first stage has no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next one reads it.

    Null and empty texts pass all stages as the stages define it: they are not toxic,
    have no lines to lose, form one group of near-duplicates, are not contaminated and
    have size 0.  An empty table gives no rows.
    """
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
