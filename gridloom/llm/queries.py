"""The corpus queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, html_text, langid, line_rules, lm_score, media, merkle, mixing, packing, quality, simhash, token_file, toxicity
from .common import read


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.schedule(read(spark, sf_dir, "documents").select("doc_id", "source"))
    return mixed.select(F.col("doc.doc_id").alias("doc_id"), F.col("doc.source").alias("source"), "quota", "block", "epoch", "slot", "release", "deadline", "position")


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.assess(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(read(spark, sf_dir, "documents"))


def op5_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.judge(read(spark, sf_dir, "documents"))


def op6_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file.round_trip(read(spark, sf_dir, "documents"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(read(spark, sf_dir, "pages"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.round_trip(read(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.dedup(read(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(read(spark, sf_dir, "documents"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": op1_mixing,
        "op2_langid": op2_langid,
        "op3_toxicity": op3_toxicity,
        "op4_lm_score": op4_lm_score,
        "op5_line_rules": op5_line_rules,
        "op6_token_file": op6_token_file,
        "op7_html": op7_html,
        "op8_media": op8_media,
        "op9_simhash": op9_simhash,
        "op10_packing": op10_packing,
        "op11_divergence": op11_divergence,
        "op12_merkle": op12_merkle,
        "op13_quality": op13_quality,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_line_rules": line_rules.ORACLE_SQL, "op11_divergence": divergence.ORACLE_SQL, "op12_merkle": merkle.ORACLE_SQL}
