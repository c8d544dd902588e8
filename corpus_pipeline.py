"""The training-data pipeline: every stage works on all rows that the one before kept.

``run`` reads ``documents`` and ``benchmark``. Each stage's result is written as
Parquet in the shared folder and reread by the next, so a lost executor repeats at
most one stage. The first three stages only drop rows, the fourth repeats and drops
whole documents, the last gives one row for each document written as token ids.
Nulls, empty texts, repeated rows and extra columns are handled as each operator
says; an empty table passes through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scriptorium.llm.common import read_table, settle
from scriptorium.llm.decontaminate import drop_contaminated
from scriptorium.llm.mixing import mix_sources
from scriptorium.llm.quality import keep_good
from scriptorium.llm.near_copies import drop_near_copies
from scriptorium.llm.token_files import token_report

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return keep_good(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are similar at 0.8 or more."""
    return drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark."""
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as equal shares of their sources ask."""
    return mix_sources(docs).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mixture, and each document's place in them."""
    return token_report(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality),
    ("near duplicates", deduplicate),
    ("decontamination", decontaminate),
    ("source mixing", mix),
    ("token ids", tokenize),
]

# Fingerprints and the tokenizer have no SQL form; tests/llm/test_pipeline.py has a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
