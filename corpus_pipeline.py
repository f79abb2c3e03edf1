"""A training-corpus pipeline: language, toxicity, near-duplicates, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's ``docs``. All but the last keep the columns of
``docs``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import langid, mixing, packing, simhash, toxicity
from gridloom.llm.common import read, save


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told (score at least 0.5).

    A null text, one without letters, and all texts where no row has text and lang, go. Repeated rows are judged
    alike; ties go to the first language in order, so a text between two has a score of 0.5 and stays; an empty
    table gives no rows.
    """
    return langid.keep_identified(docs)


def clean_speech(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold of 0.3.

    Null and empty texts have the score of a text without features. Repeated rows are judged alike; of labels that
    contradict each other 1 counts; without labels of both kinds all documents stay (or go, if all are labelled
    toxic); an empty table gives no rows.
    """
    return toxicity.keep_clean(docs, read(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that of the smallest doc_id.

    Null, empty and wordless texts are one group. Rows with a null doc_id stay. Of repeated rows one stays; rows
    with one id over different texts are told apart; an empty table gives no rows.
    """
    return simhash.keep_first(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents once, their sources interleaved block by block at their shares.

    A null source is a source. Null and repeated ids are kept; equal deadlines go by the source's name, rows of
    equal ids in any order; an empty table gives no rows.
    """
    return mixing.interleave(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 2048 tokens.

    A null or empty text is its end token; null ids stay null; repeated rows are packed once each; of windows with equal
    room the earlier one is taken; an empty table gives no rows.
    """
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("toxicity", clean_speech),
    ("near_dedup", near_dedup),
    ("mix", mix),
    ("pack", pack),
]

#: trained models and subword ids are beyond SQL; tests/llm holds every stage against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
