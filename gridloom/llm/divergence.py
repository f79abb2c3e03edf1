"""Divergence audit: how the words of each source differ from other sources and from the language.

Two passes with a vocabulary automaton. The first counts in how many documents of a language each term occurs; the
terms of at least ``MIN_DOCS`` documents are kept. In the second pass texts, with every character that is no part
of a term turned into a blank, run through an Aho-Corasick automaton of the kept terms padded by a blank on both
sides: a match is a whole term, and two neighbours share their blank. An automaton holds at most about ``SHARD`` terms (a bound
on what is broadcast); a larger vocabulary is dealt over several by hash, and each of them takes a run of its own
over the texts, which costs time and never terms.

Counts stay sparse: a posting for each term that a group (language and source) has. With

    p = 1 + floor(10**9 * (count + 5) / (N + 5 * V))

of a term in a group (N occurrences of V kept terms), an absent term has the same p0 for all of the group, so the
distance of two groups is V * abs(p0 - q0) and, for terms that either has, abs(p - q) - abs(p0 - q0). The postings of a block of
terms and two tiles of ``TILE`` sources meet in one task of bounded size, which returns that sum for their pairs.

Null text, language and source count as ''. Repeated rows are documents of their own; ties rank by item;
a language of one source has no pairs, one without kept terms has distances of 0; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import salted_join, save

MIN_DOCS = 30
TOP = 50
SMOOTHING = 5
SHARD = 200_000
BLOCK = 4096
TILE = 128
PARTIAL_TERMS = 300_000  # entries that a task counts before it hands them on
PARTIAL_MATCHES = 4_000_000
#: bytes that end a term become blanks, A-Z become a-z, all others stay
FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def folded(text: str | None) -> bytes:
    return text.encode().translate(FOLDED) if text else b""


def _document_frequencies(partial: int):
    """(lang, term, documents that have it), partly summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = defaultdict(Counter)
        most = 0  # entries at most

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, c in counts.items():
                terms = pa.array([t.decode() for t in c], pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), terms, pa.array(c.values(), pa.int64())], ["lang", "term", "docs"])
            counts.clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                terms = set(folded(text.as_py()).split())
                counts[lang].update(terms)
                most += len(terms)
                if most > partial:
                    most = sum(map(len, counts.values()))
                    if most > partial // 2:
                        yield from rows()
                        most = 0
        yield from rows()

    return run


class Vocabulary:
    """Terms of a shard by number; the automaton is built once in a worker."""

    def __init__(self, terms: list[str]):
        self.terms = terms

    def __getstate__(self):
        return {"terms": self.terms}

    def automaton(self) -> ahocorasick.Automaton:
        if not hasattr(self, "built"):
            self.built = ahocorasick.Automaton()
            for k, term in enumerate(self.terms):
                self.built.add_word(f" {term} ", k)
            self.built.make_automaton()
        return self.built

    def matches(self, text: str | None) -> np.ndarray:
        """Numbers of the terms of a text, repeats included."""
        return np.array([k for _, k in self.automaton().iter(f" {folded(text).decode()} ")], np.int64)


def _occurrences(sent, offset: int, partial: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, found, total = sent.value, defaultdict(list), 0

        def rows() -> Iterator[pa.RecordBatch]:
            for (lang, source), parts in found.items():
                ids, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(ids), pa.string()), pa.array([source] * len(ids), pa.string()), pa.array(ids + offset), pa.array(n)], ["lang", "source", "id", "n"])
            found.clear()

        for batch in batches:
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text")):
                got = vocabulary.matches(text.as_py())
                if len(got):
                    found[lang, source].append(got)
                    total += len(got)
                if total > partial:
                    yield from rows()
                    total = 0
        yield from rows()

    return run


def permille(count: Column, total: Column) -> Column:
    """1 + floor(10**9 * count / total), exact by three steps of long division; 1 where total is 0. Totals below 9 * 10**15."""
    out, rest, total = F.lit(0).cast("long"), count, F.nullif(total, F.lit(0))
    for _ in range(3):
        up = (rest * 1000).alias("up")
        out, rest = out * 1000 + F.call_function("div", up, total), up % total
    return F.coalesce(1 + out, F.lit(1).cast("long"))


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS, shard: int = SHARD) -> tuple[DataFrame, int]:
    """(lang, term, id of the kept terms, number of shards); an id is the shard's number times 2**32 plus a number in it."""
    counted = docs.select("lang", "text").mapInArrow(_document_frequencies(PARTIAL_TERMS), "lang string, term string, docs long")
    kept = save(counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs), "kept-terms")
    distinct = kept.select("term").distinct()
    shards = -(-distinct.count() // shard)
    part = F.pmod(F.xxhash64("term"), F.lit(max(1, shards)))
    number = F.row_number().over(Window.partitionBy("part").orderBy("term")) - 1
    ids = distinct.withColumn("part", part).select("term", (F.shiftleft("part", 32) + number).alias("id"))
    return save(kept.join(ids, "term").select("lang", "term", "id"), "term-ids"), shards


def occurrences(docs: DataFrame, kept: DataFrame, shards: int) -> DataFrame:
    """lang, source, id, n: the postings, summed over all texts."""
    parts = []
    for k in range(shards):
        terms = kept.filter(F.shiftright("id", 32) == k).select("id", "term").distinct().orderBy("id").select("term").toArrow().column("term").to_pylist()  # about SHARD at most
        sent = docs.sparkSession.sparkContext.broadcast(Vocabulary(terms))
        counted = docs.mapInArrow(_occurrences(sent, k << 32, PARTIAL_MATCHES), "lang string, source string, id long, n long")
        parts.append(save(counted.groupBy("lang", "source", "id").agg(F.sum("n").alias("n")), "term-counts"))
        sent.destroy()
    found = parts[0] if parts else docs.select("lang", "source", F.lit(0).cast("long").alias("id"), F.lit(0).cast("long").alias("n")).limit(0)
    for part in parts[1:]:
        found = found.unionByName(part)
    # an automaton has the terms of all languages; those that aren't kept in the document's own go here
    return save(found.join(kept, ["lang", "id"]).select("lang", "source", "id", "term", "n"), "postings")


def _distances(tile: int):
    """Sums of abs(p - q) - abs(p0 - q0) for the pairs of two tiles (or one) over a block of terms."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        lang, _, first, second = key
        own = pdf.groupby("no", sort=True)["p0"].first()
        base, place = own.to_numpy(), {n: i for i, n in enumerate(own.index)}
        some = pdf[pdf["id"].notna()]
        ids, column = np.unique(some["id"].to_numpy(np.int64), return_inverse=True)
        p = np.repeat(base[:, None], max(1, len(ids)), axis=1)
        p[[place[n] for n in some["no"]], column] = some["p"].to_numpy(np.int64)
        numbers, found = own.index.to_numpy(), [np.zeros((3, 0), np.int64)]
        for i in np.flatnonzero(numbers // tile == first):
            others = np.flatnonzero((numbers // tile == second) & (numbers > numbers[i]))
            total = (np.abs(p[others] - p[i]) - np.abs(base[others] - base[i])[:, None]).sum(axis=1)
            found.append(np.stack([np.full(len(others), numbers[i]), numbers[others], total]))
        one, other, part = np.concatenate(found, axis=1)
        return pd.DataFrame({"lang": pd.Series([lang] * len(part), dtype=object), "a": one, "b": other, "part": part})

    return run


def _pairs(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value of every two sources of a language, both ways."""
    blocks = F.greatest(F.lit(1), F.ceil(F.col("v") / BLOCK)).cast("long")
    tiles = F.floor((F.col("sources") - 1) / TILE).cast("int")
    rows = postings.select("lang", "no", "p0", "v", "sources", F.pmod(F.xxhash64("id"), blocks).alias("block"), "id", "p")
    none = groups.select("lang", "no", "p0", "v", "sources", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("p"))
    own = F.floor(F.col("no") / TILE).cast("int")
    met = rows.unionByName(none).withColumn("other", F.explode(F.sequence(F.lit(0), tiles)))
    met = met.select("lang", "block", F.least(own, "other").alias("first"), F.greatest(own, "other").alias("second"), "no", "p0", "id", "p")
    sums = met.groupBy("lang", "block", "first", "second").applyInPandas(_distances(TILE), "lang string, a long, b long, part long").groupBy("lang", "a", "b").agg(F.sum("part").alias("part"))
    side = lambda x: groups.select("lang", F.col("no").cast("long").alias(x), F.col("source").alias(f"{x}_source"), F.col("p0").alias(f"{x}_p0"), *(["v"] if x == "a" else []))
    both = sums.join(side("a"), ["lang", "a"]).join(side("b"), ["lang", "b"])
    value = F.col("v") * F.abs(F.col("a_p0") - F.col("b_p0")) + F.col("part")
    ways = F.array(F.struct(F.col("a_source").alias("source"), F.col("b_source").alias("item")), F.struct(F.col("b_source").alias("source"), F.col("a_source").alias("item")))
    return both.select("lang", value.alias("value"), F.explode(ways).alias("way")).select("lang", "way.source", "way.item", "value")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, shard: int = SHARD) -> DataFrame:
    """lang, source, part, item, value, rank: distances of each group to the others of its
    language (part ``pair``, all ranks) and the terms that it has more of than the language (``term``, the ``top`` first)."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    d = docs.select(blank("lang"), blank("source"), blank("text"))
    kept, shards = kept_terms(d, min_docs, shard)
    counts = occurrences(d, kept, shards)
    smooth = lambda n, v: F.col(n) + SMOOTHING * F.col(v)
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"))
    groups = d.select("lang", "source").distinct().join(counts.groupBy("lang", "source").agg(F.sum("n").alias("own")), ["lang", "source"], "left").join(sizes, "lang", "left")
    lang = Window.partitionBy("lang")
    groups = groups.select("lang", "source", F.coalesce("own", F.lit(0)).alias("own"), F.coalesce("v", F.lit(0)).alias("v"), (F.row_number().over(lang.orderBy("source")) - 1).alias("no"), F.count("*").over(lang).alias("sources"))
    groups = save(groups.withColumn("p0", permille(F.lit(SMOOTHING).cast("long"), smooth("own", "v"))), "source-groups")
    postings = save(salted_join(counts, groups, ["lang", "source"], F.col("id")).withColumn("p", permille(F.col("n") + SMOOTHING, smooth("own", "v"))), "source-postings")
    total = groups.groupBy("lang").agg(F.sum("own").alias("all"), F.max("v").alias("v"))
    whole = counts.groupBy("lang", "id").agg(F.sum("n").alias("m"))
    whole = salted_join(whole, total, ["lang"], F.col("id")).select("lang", "id", permille(F.col("m") + SMOOTHING, smooth("all", "v")).alias("q"))
    more = postings.join(whole, ["lang", "id"]).filter(F.col("p") > F.col("q")).select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = _pairs(postings, groups).withColumn("rank", rank)
    terms = more.withColumn("rank", rank).filter(F.col("rank") <= top)  # the first of each task go on, no more
    shape = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return shape(pairs, "pair").unionByName(shape(terms, "term"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
occ AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM occ GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
size AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
cnt AS (SELECT lang, source, term, count(*) AS c FROM occ JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(n, 0) AS n, coalesce(v, 0) AS v FROM (SELECT DISTINCT lang, source FROM d)
  LEFT JOIN (SELECT lang, source, sum(c) AS n FROM cnt GROUP BY ALL) USING (lang, source) LEFT JOIN size USING (lang)),
p AS (SELECT lang, source, term, coalesce(c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c, 0) + 5)) // (n + 5 * v) AS p
  FROM g JOIN kept USING (lang) LEFT JOIN cnt USING (lang, source, term)),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(c) + 5)) // (sum(sum(c)) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang)) AS q
  FROM p GROUP BY lang, term),
dist AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN dist ON dist.lang = a.lang AND dist.source = a.source AND dist.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM pair UNION ALL FROM term))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
