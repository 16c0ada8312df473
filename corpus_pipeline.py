"""A corpus pipeline of four stages, each written as Parquet and read again by the next.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep documents' columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm import aho_decontaminate, hyperdimensional, packing, simhash_vptree
from readloom.llm.common import free_name, table, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters, and those that resemble no language that was learnt, go."""
    langs, prototypes = hyperdimensional.fit(docs.filter(hyperdimensional.training_rows(docs)), "text", "lang")
    lang, score = (free_name(c, docs.columns) for c in ("_lang_pred", "_lang_score"))
    found = hyperdimensional.with_language(docs, langs, prototypes, pred_col=lang, score_col=score)
    known = (F.col(lang) != hyperdimensional.UNKNOWN) & (F.col(score) >= hyperdimensional.LEAST_SCORE)
    return found.filter(known).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the least id stays."""
    return simhash_vptree.one_of_each(docs).select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    prefix = "_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    scanned = aho_decontaminate.scan(docs, table(spark, sf_dir, "benchmark"), prefix=prefix)
    return scanned.filter(F.size(f"{prefix}spans") == 0).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document that is left, packed into sequences."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: SQL can't express the stages; tests/llm holds each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
