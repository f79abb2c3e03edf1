"""Helpers shared by the corpus operators: global order, splits, sampling, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NullType

from ..sources.storage import new_folder, save, shared_dir

__all__ = ["add_starts", "crc_mod", "free_name", "hashed_share", "integer_id", "labelled_sample", "new_folder", "ordered", "read", "remainder_is", "row_share", "salted_join", "save", "shared_dir"]


def ordered(df: DataFrame, *keys: Column | str) -> DataFrame:
    """``df`` in the total order of ``keys``, with its place in column ``_place``.

    Rows are dealt by range, so a hot leading key spreads over many partitions when
    a later key tells its rows apart. ``_place`` is partition number * 2**33 plus the
    row's number in it; write the result before using it (see :func:`save`), because
    range bounds are sampled anew by every execution.
    """
    keys = [F.col(k) if isinstance(k, str) else k for k in keys]
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_place", F.monotonically_increasing_id())


def add_starts(placed: DataFrame, amount: Column, name: str) -> DataFrame:
    """Column ``name``: the sum of ``amount`` over all rows of earlier *partitions* of ``_place``.

    One row a partition comes to the driver (their number is a shuffle setting, not
    a number of documents) and goes back as a broadcast of the same size.
    """
    part = F.shiftright("_place", 33)
    sums = placed.groupBy(part.alias("_part")).agg(F.sum(amount).alias("n")).orderBy("_part").collect()
    rows, before = [], 0
    for r in sums:
        rows.append((r["_part"], before))
        before += int(r["n"] or 0)
    starts = placed.sparkSession.createDataFrame(rows or [(0, 0)], f"_part long, {name} long")
    return placed.withColumn("_part", part).join(F.broadcast(starts), "_part").drop("_part")


def crc_mod(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; null ids give null."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus))


def remainder_is(doc_id: Column, modulus: int, r: int) -> Column:
    """False for null ids, so that every row belongs to exactly one side of a split."""
    return F.coalesce(crc_mod(doc_id, modulus) == r, F.lit(False))


def hashed_share(key: Column, share: float | Column) -> Column:
    """True for a pseudo-random, repeatable ``share`` of the keys."""
    return F.pmod(F.xxhash64(F.coalesce(key.cast("string"), F.lit(""))), F.lit(1_000_003)) < F.lit(1_000_003) * share


def row_share(share: float | Column, *values: Column | str) -> Column:
    """True for a pseudo-random ``share`` of the rows, also of rows that are alike: their place in the partition counts."""
    return F.pmod(F.xxhash64(*values, F.monotonically_increasing_id()), F.lit(1_000_003)) < F.lit(1_000_003) * share


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, held_out: Column, sample_docs: int) -> tuple[DataFrame, dict[int, int], dict[int, int]]:
    """(label, text) of about ``sample_docs`` rows of each label 0 and 1 that aren't ``held_out``; ids and drawn rows by label.

    Ids are drawn first, by their hash, and go to all tasks: twice ``sample_docs`` of them. An id may have
    any number of rows, so their rows are counted and drawn once more. Contradicting labels of an id count as 1.
    """
    label = F.col(column).cast("int")
    known = labels.select("doc_id", label.alias("label")).filter("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label")).filter(~held_out)
    count = lambda df: {r["label"]: r["n"] for r in df.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = lambda sizes: F.when(F.col("label") == 1, min(1.0, sample_docs / max(1, sizes.get(1, 0)))).otherwise(min(1.0, sample_docs / max(1, sizes.get(0, 0))))
    n = count(known)
    ids = save(known.filter(hashed_share(F.col("doc_id"), share(n))), "sample-ids")
    rows = lambda *columns: docs.select("doc_id", *columns).join(F.broadcast(ids), "doc_id")
    sample = save(rows("text").filter(row_share(share(count(rows())), "doc_id", "text")).select("label", "text"), "labelled-sample")
    return sample, n, count(sample)


def integer_id(docs: DataFrame) -> Column:
    """``doc_id`` as a long; TypeError if it is of no integer type."""
    kind = docs.schema["doc_id"].dataType
    if not isinstance(kind, (IntegralType, NullType)):
        raise TypeError(f"doc_id must be of an integer type, not {kind.simpleString()}")
    return F.col("doc_id").cast("long").alias("doc_id")


def salted_join(rows: DataFrame, few: DataFrame, keys: list[str], spread: Column, parts: int = 16) -> DataFrame:
    """Inner join in which the rows of one key are dealt over ``parts`` tasks by a hash of ``spread``;
    each row of ``few``, which should be the smaller side by far, is copied to all of them."""
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(parts)))
    return left.join(few.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))), [*keys, "_salt"]).drop("_salt")


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have, ignoring case."""
    have = {c.lower() for c in df.columns}
    while stem.lower() in have:
        stem = f"_{stem}"
    return stem


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
