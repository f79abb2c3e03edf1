"""Language identification by word-first backoff.

A text's words vote with their log10 frequency in each language. A word that no training text
has votes with the mean of its known character n-grams of the greatest size, 5 down to
1, that has any known. The model is fitted on a bounded sample of labelled rows, drawn by a hash of id, text
and row: about ``sample_docs`` a language, but ``max_docs`` over all languages, which then share them
evenly. It holds every word and n-gram of the sample, of every language, as sparse rows, so its size is that
of the sample's vocabulary.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, remainder_is, row_share, save

UNKNOWN = "und"
SAMPLE_DOCS = 2000
MAX_DOCS = 20_000
FEW_LANGS = 10_000  # sizes of so many languages are broadcast
SIZES = (5, 4, 3, 2, 1)
MEMO_WORDS = 300_000
WHOLE_CELLS = 20_000_000  # of a table, words by languages, up to which it is held unfolded
MEMO_CELLS = 4_000_000  # votes a worker keeps, over all languages
#: what a whole gram's mean counts against a known word's vote
GRAM_WEIGHT = 0.5
#: word characters that are neither letters nor decimal digits, as fractions, superscripts, circled numbers
NUMERALS = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
RUNS = re.compile(r"[^\W\d_]+")
LETTERS = re.compile(rf"[^\W\d_{NUMERALS}]+")


def words_of(text: str) -> Counter:
    """How often each run of letters comes, in lower case."""
    found = Counter(RUNS.findall(text.lower()))
    for run in [w for w in found if not w.isalpha()]:  # the few with numerals; the pattern that leaves those out is slow
        n = found.pop(run)
        for word in LETTERS.findall(run):
            found[word] += n
    return found


def grams(word: str, n: int) -> list[str]:
    w = f"<{word}>" if n > 1 else word
    return [w[i : i + n] for i in range(len(w) - n + 1)]


class Table:
    """Log10 frequencies of keys by language; only what differs from an absent key's is stored."""

    def __init__(self, rows: list[tuple[str, str, int]] | pa.Table, langs: dict[str, int]):
        if isinstance(rows, pa.Table):  # a column at a time: no object for each row
            names, keys, times = (rows.column(c) for c in ("lang", "key", "n"))
            lang = np.fromiter((langs[x.as_py()] for x in names), np.int32, len(rows))
            keys, n = (k.as_py() for k in keys), times.to_numpy().astype(np.float64)
        else:
            lang = np.fromiter((langs[x] for x, _, _ in rows), np.int32, len(rows))
            keys, n = (k for _, k, _ in rows), np.fromiter((n for _, _, n in rows), np.float64, len(rows))
        self.at: dict[str, int] = {}
        key = np.fromiter((self.at.setdefault(k, len(self.at)) for k in keys), np.int64, len(rows))
        total = np.bincount(lang, n, len(langs)) + 0.5 * (len(self.at) + 1)
        order = np.argsort(key, kind="stable")
        self.ends = np.cumsum(np.bincount(key, minlength=len(self.at)))
        self.lang, self.more = lang[order], (np.log10(n + 0.5) - np.log10(0.5))[order].astype(np.float32)
        self.absent = (np.log10(0.5) - np.log10(total)).astype(np.float32)
        self.rows = None

    def unfold(self) -> None:
        """Whole rows instead of sparse ones, where they are few enough to hold; the values are the same."""
        if len(self.at) * len(self.absent) <= WHOLE_CELLS:
            self.rows = np.tile(self.absent, (len(self.at), 1))
            self.rows[np.repeat(np.arange(len(self.at)), np.diff(self.ends, prepend=0)), self.lang] += self.more

    def mean(self, places: list[int]) -> np.ndarray:
        if self.rows is not None:
            return self.rows[places].mean(axis=0) if len(places) > 1 else self.rows[places[0]]
        out = np.zeros(len(self.absent), np.float32)
        for k in places:
            own = slice(self.ends[k - 1] if k else 0, self.ends[k])
            out[self.lang[own]] += self.more[own]
        return self.absent + out / np.float32(len(places))

    def __getitem__(self, key: str) -> np.ndarray:
        return self.mean([self.at[key]])


class Model:
    """Vote tables; ``langs`` in ascending order, so that ties go to the first. Rows are (language, key, times), a pair once."""

    def __init__(self, langs: list[str], prior: list[float], words: list[tuple[str, str, int]], parts: list[tuple[str, str, int]]):
        self.langs, self.prior = langs, np.array(prior)
        at = {lang: i for i, lang in enumerate(langs)}
        self.words, self.grams = Table(words, at), Table(parts, at)

    def scorer(self) -> "Scorer":
        """Kept with the model, so that a worker's next task finds its words again."""
        self.kept = getattr(self, "kept", None) or Scorer(self)
        return self.kept

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "kept"}

    def vote(self, word: str) -> np.ndarray:
        got = self.words.at.get(word)
        if got is not None:
            return self.words.mean([got])
        for n in SIZES:
            known = [k for k in map(self.grams.at.get, grams(word, n)) if k is not None]
            if known:
                return GRAM_WEIGHT * self.grams.mean(known)
        return np.zeros(len(self.langs), np.float32)


class Scorer:
    """A model with a bounded memo of votes."""

    def __init__(self, model: Model):
        self.model, self.row = model, {}
        model.words.unfold()
        model.grams.unfold()
        self.most = max(2, min(MEMO_WORDS, MEMO_CELLS // max(1, len(model.langs))))
        self.votes = np.zeros((self.most + 1, max(1, len(model.langs))), np.float32)

    def rows(self, words: list[str]) -> list[int]:
        memo = self.row
        out = [memo.get(w, -1) for w in words]
        for i, r in enumerate(out):
            if r < 0:
                if len(memo) >= self.most:
                    raise OverflowError
                w = words[i]
                memo[w] = out[i] = len(memo)
                self.votes[out[i]] = self.model.vote(w)
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        found = words_of(text) if text else None
        if not found or not self.model.langs:
            return UNKNOWN, 0.0
        total, words, times = self.model.prior.copy(), list(found), np.fromiter(found.values(), np.float32, len(found))
        for at in range(0, len(words), self.most // 2):
            part = words[at : at + self.most // 2]
            try:
                rows = self.rows(part)
            except OverflowError:
                self.row.clear()
                rows = self.rows(part)
            total += times[at : at + len(part)] @ self.votes[rows]
        best = int(np.argmax(total))
        share = np.power(10.0, total - total[best])
        return self.model.langs[best], float(1 / share.sum())


def _word_counts(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in pdfs:
        counts: dict[str, Counter] = {}
        for lang, text in zip(pdf["lang"], pdf["text"]):
            counts.setdefault(lang, Counter()).update(words_of(text))
        rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
        yield pd.DataFrame(rows, columns=["lang", "key", "n"])


def _gram_counts(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in pdfs:
        counts: dict[str, Counter] = {}
        for lang, word, n in zip(pdf["lang"], pdf["key"], pdf["n"]):
            c = counts.setdefault(lang, Counter())
            for size in SIZES:
                for g in grams(word, size):
                    c[g] += n
        rows = [(lang, g, n) for lang, c in counts.items() for g, n in c.items()]
        yield pd.DataFrame(rows, columns=["lang", "key", "n"])


def fit(docs: DataFrame, held_out: Column, sample_docs: int = SAMPLE_DOCS, max_docs: int = MAX_DOCS) -> Model:
    """Learn from rows that aren't ``held_out`` and have text and lang."""
    labelled = docs.select("doc_id", F.col("text"), F.col("lang").cast("string").alias("lang")).filter(~held_out & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = save(labelled.groupBy("lang").agg(F.count("*").alias("n")), "language-sizes")
    kinds = sizes.count()
    if not kinds:
        return Model([], [], [], [])
    share = sizes.select("lang", F.least(F.lit(1.0), F.lit(min(sample_docs, max_docs / kinds)) / F.col("n")).alias("_share"))
    sample = labelled.join(F.broadcast(share) if kinds <= FEW_LANGS else share, "lang").filter(row_share(F.col("_share"), "doc_id", "text")).select("lang", "text")
    kind = "lang string, key string, n long"
    words = save(sample.mapInPandas(_word_counts, kind).groupBy("lang", "key").agg(F.sum("n").alias("n")), "language-words")
    parts = words.mapInPandas(_gram_counts, kind).groupBy("lang", "key").agg(F.sum("n").alias("n"))
    rows = lambda df: df.select("lang", "key", "n").toArrow()  # noqa: E731  # the vocabulary of the sample
    found = words.select("lang").distinct().join(sizes, "lang").orderBy("lang").collect()  # no more than rows in the sample
    total = sum(r["n"] for r in found)
    return Model([r["lang"] for r in found], [float(np.log10(r["n"] / total)) for r in found], rows(words), rows(parts))


def predictor(docs: DataFrame, model: Model):
    """A column function: text -> struct(lang_pred, score)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double")
    def predict(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = sent.value.scorer()
        for part in texts:
            found = [scorer.predict(t.as_py()) for t in part]
            yield pa.StructArray.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([p for _, p in found], pa.float64())], ["lang_pred", "score"])

    return predict


def held_out(doc_id: Column) -> Column:
    return remainder_is(doc_id, 4, 2)


def identify(docs: DataFrame, **params) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row.

    ``und`` with score 0 for a null text, one without letters, or when nothing could be
    learned; a text of unknown letters only gets the most frequent language. Null doc_ids
    are never held out; repeated rows stay; ties go to the first language in order.
    """
    predict = predictor(docs, fit(docs, held_out(F.col("doc_id")), **params))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predict("text").alias("p"))
    return rows.select("doc_id", "held_out", "p.lang_pred", "p.score")


def keep_identified(docs: DataFrame, min_score: float = 0.5, **params) -> DataFrame:
    """``docs`` (all columns) without rows whose language is undetermined or scores below ``min_score``."""
    predict = predictor(docs, fit(docs, held_out(F.col("doc_id")), **params))
    p = free_name(docs, "language")
    return docs.withColumn(p, predict("text")).filter((F.col(f"{p}.lang_pred") != UNKNOWN) & (F.col(f"{p}.score") >= min_score)).drop(p)
