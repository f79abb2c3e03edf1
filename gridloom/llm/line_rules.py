"""Quality rules: per-text repetition counts and cross-document line frequency.

DataFrame functions only. A line is compared in lower case with runs of white space as one
blank. Its *documents* on a host are distinct texts, so that a copied text counts once.
A line is removed where more than ``host_limit`` documents of its host or more than
``corpus_limit`` documents of all hosts have it; a document that loses more than
``1 - min_left`` of its words is depleted. Counts are grouped map-side before
they are shuffled, and only lines above a limit are joined back, the rows of each dealt over 16 tasks
so that a line of a third of all documents isn't one task's.

Null text has no words (base_failed); a null source is a host of its own; repeated rows
are judged alike, each giving a row; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, salted_join, save

SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEATED = 0.5
HOST_LIMIT = 10
CORPUS_LIMIT = 100
MIN_LEFT = 0.5
NO_HOST = "\x01"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def window_hashes(words: Column) -> Column:
    """A 64-bit hash of each three words in a row; use it on a column, not on an expression."""
    each = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) >= 3, each).otherwise(F.array().cast("array<bigint>"))


def repeated_words(hashes: Column) -> Column:
    """Number of words in windows whose hash comes twice or more; ``hashes`` is a column."""

    def covered(p: Column) -> Column:
        again = F.filter(p, lambda x, k: F.get(p, k - 1)["h"].eqNullSafe(x["h"]) | F.get(p, k + 1)["h"].eqNullSafe(x["h"]))
        return F.size(F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    some = F.size(F.array_distinct(hashes)) < F.size(hashes)
    return F.when(some, F.get(F.transform(F.array(placed), covered), F.lit(0))).otherwise(F.lit(0))


def norm_line(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), SPACE, " "))


def line_keys(lines: Column) -> Column:
    """(hash, number of words) of each line that has a word."""
    keys = F.transform(lines, lambda x: F.transform(F.array(norm_line(x)), lambda n: F.struct(F.xxhash64(n).alias("h"), (F.length(n) - F.length(F.translate(n, " ", "")) + 1).alias("words"), (n != "").alias("some")))[0])
    return F.filter(keys, lambda k: k["some"])


def measured(docs: DataFrame) -> DataFrame:
    """The base counts and line keys of every row, stored under a row number."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce(F.col("source").cast("string"), F.lit(NO_HOST)).alias("host"), text.alias("text"))
    d = d.select("row", "doc_id", "host", "text", words_of(F.col("text")).alias("words"), F.split("text", "\n").alias("lines"))
    d = d.select("row", "doc_id", "host", "text", "words", F.filter("lines", lambda x: F.translate(x, SPACES, "") != "").alias("lines"), window_hashes(F.col("words")).alias("hashes"))
    d = d.select(
        "row", "doc_id", "host",
        F.xxhash64("text").alias("text_key"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("hashes")).cast("long").alias("n_repeat_words"),
        line_keys(F.col("lines")).alias("keys"),
    )
    return save(d, "line-keys")


def frequent_lines(rows: DataFrame, host_limit: int, corpus_limit: int) -> DataFrame:
    """host, h of the lines above a limit."""
    seen = rows.select("host", "text_key", F.explode(F.array_distinct(F.transform("keys", lambda k: k["h"]))).alias("h"))
    per_host = save(seen.groupBy("host", "h").agg(F.count_distinct("text_key").alias("docs")), "line-counts")
    total = per_host.groupBy("h").agg(F.sum("docs").alias("total")).filter(F.col("total") > corpus_limit)
    everywhere = salted_join(per_host, total, ["h"], F.col("host")).select("host", "h")  # a line of all hosts has a row a host
    return per_host.filter(F.col("docs") > host_limit).select("host", "h").union(everywhere).distinct()


def judge(docs: DataFrame, host_limit: int = HOST_LIMIT, corpus_limit: int = CORPUS_LIMIT, min_left: float = MIN_LEFT) -> DataFrame:
    """doc_id, n_words, the four base counts, base_failed, removed_words, kept."""
    rows = measured(docs)
    lines = rows.select("row", "host", F.explode("keys").alias("k")).select("row", "host", F.col("k.h").alias("h"), F.col("k.words").alias("words"))
    removed = salted_join(lines, frequent_lines(rows, host_limit, corpus_limit), ["host", "h"], F.col("row")).groupBy("row").agg(F.sum("words").alias("removed"))
    n, removed_words = F.col("n_words"), F.coalesce(F.col("removed"), F.lit(0))
    failed = (n < MIN_WORDS) | (F.col("n_repeat_words") > MAX_REPEATED * n)
    return rows.join(removed, "row", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), removed_words.cast("long").alias("removed_words"),
        (~failed & (n - removed_words >= min_left * n)).alias("kept"),
    )


def clean(docs: DataFrame, host_limit: int = HOST_LIMIT, corpus_limit: int = CORPUS_LIMIT, min_left: float = MIN_LEFT) -> DataFrame:
    """``docs`` (all columns) with frequent lines cut out of text; depleted documents are gone.

    Lines without a word stay. A document without words is depleted only by losing lines.
    """
    row, keys, bad = (free_name(docs, x) for x in ("row", "line_keys", "bad_lines"))
    stored = save(docs.withColumn(row, F.monotonically_increasing_id()), "docs-with-row")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = save(stored.select(F.col(row).alias("row"), F.coalesce(F.col("source").cast("string"), F.lit(NO_HOST)).alias("host"), F.xxhash64(text).alias("text_key"), line_keys(F.split(text, "\n")).alias("keys")), "line-keys")
    lines = rows.select("row", "host", F.explode("keys").alias("k")).select("row", "host", F.col("k.h").alias("h"), F.col("k.words").alias("words"))
    hit = salted_join(lines, frequent_lines(rows, host_limit, corpus_limit), ["host", "h"], F.col("row"))
    per_row = hit.groupBy(F.col("row").alias(row)).agg(F.sum("words").alias(keys), F.collect_set("h").alias(bad))
    kept = stored.join(per_row, row, "left").filter(F.coalesce(F.size(words_of(F.col("text"))) - F.col(keys) >= min_left * F.size(words_of(F.col("text"))), F.lit(True)))
    left = F.filter(F.split("text", "\n"), lambda x: ~F.array_contains(F.col(bad), F.xxhash64(norm_line(x))))
    return kept.withColumn("text", F.when(F.col(bad).isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))).select(*docs.columns)


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce(source, chr(1)) AS host FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM w, unnest(range(1, len(ws) - 1)) AS u(i)),
twice AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, unnest([0, 1, 2]) AS v(k) WHERE c > 1 GROUP BY r),
line AS (SELECT r, host, t, l FROM d, unnest(string_split(t, chr(10))) AS s(l) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
dup AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM line GROUP BY r),
norm AS (SELECT r, host, t, trim(regexp_replace(lower(l), '[\x20\x09-\x0D]+', ' ', 'g')) AS l FROM line),
per AS (SELECT host, l, count(DISTINCT t) AS docs FROM norm GROUP BY host, l),
bad AS (SELECT host, l FROM (SELECT *, sum(docs) OVER (PARTITION BY l) AS total FROM per) WHERE docs > 10 OR total > 100),
cut AS (SELECT r, sum(len(regexp_extract_all(l, '[^ ]+'))) AS n FROM norm JOIN bad USING (host, l) GROUP BY r),
m AS (SELECT d.doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(cut.n, 0) AS removed_words
  FROM d JOIN w USING (r) LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN cut USING (r))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, n_words < 50 OR 2 * n_repeat_words > n_words AS base_failed, removed_words::BIGINT AS removed_words,
  NOT (n_words < 50 OR 2 * n_repeat_words > n_words) AND n_words - removed_words >= 0.5 * n_words AS kept FROM m
"""
