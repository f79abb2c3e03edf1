"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the n-grams (3 to 7 characters) of a text's lower-case words, blanks at their
ends included, hashed to ``2**HASH_BITS`` buckets, and whether a bucket comes at least 1, 2, 3 or 5
times. A feature's value is its log-count ratio

    r = log((p + 1) / (P + 1)) - log((q + 1) / (Q + 1))

of the toxic texts (p of P) and the others (q of Q) that have it. Weights come from logistic
regression on these values. The classifier is fitted on a bounded sample of labelled
rows: about ``sample_docs`` of each label, drawn by hashes of ids and rows; the bias is then moved to
the share of toxic rows among all labelled ones. A feature keeps a weight if at least ``MIN_DOCS`` texts of the sample have it
and its ratio is told from 0 by ``MIN_Z`` of its standard errors, which are about sqrt(1 / (p + 1) + 1 / (q + 1)).
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import batched, chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, labelled_sample, remainder_is, save

HASH_BITS = 20
GRAMS = (3, 4, 5, 6, 7)
LEVELS = (1, 2, 3, 5)
SAMPLE_DOCS = 6000
MIN_Z = 2.0
MIN_DOCS = 3
STEPS = 150
DOCS_AT_ONCE = 500
RIDGE = 1e-3
THRESHOLD = 0.3
MEMO_WORDS = 600_000
LONG_TOKEN = 64  # characters from which a token isn't remembered as a whole, only its words
TEXTS_AT_ONCE = 64  # whose tokens a scorer learns together
WORDS_AT_ONCE = 100_000  # words by which the memo may outgrow that
WORDS = re.compile(r"[^\W\d_]+")


def word_buckets(word: str) -> set[int]:
    w = f" {word} ".encode("utf-32-le")
    n = len(w) // 4
    return {zlib.crc32(w[4 * i : 4 * (i + k)]) & ((1 << HASH_BITS) - 1) for k in GRAMS for i in range(n - k + 1)}


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0xEDB88320), table >> 1)
    return table


CRC = _crc_table()


def all_buckets(words: list[str], number: np.ndarray | None = None) -> list[bytes]:
    """:func:`word_buckets` of each word, or what ``number`` makes of them (-1: left out), for all words at once: a
    running crc32 from every character goes on by one character a step."""
    raw = "".join(f" {w} " for w in words).encode("utf-32-le")
    b, size = np.frombuffer(raw, np.uint8).reshape(-1, 4), np.fromiter(map(len, words), np.int64, len(words)) + 2
    word, stop = np.repeat(np.arange(len(words)), size), np.repeat(np.cumsum(size), size)
    at, state, keys = np.arange(len(b)), np.full(len(b), 0xFFFFFFFF, np.uint32), []
    for k in range(1, max(GRAMS) + 1):
        inside = at + k <= stop[at]
        at, state = at[inside], state[inside]
        for j in range(4):
            state = CRC[(state ^ b[at + k - 1, j]) & 0xFF] ^ state >> 8
        if k in GRAMS:
            bucket = (~state & np.uint32((1 << HASH_BITS) - 1)).astype(np.int64)
            bucket = bucket if number is None else number[bucket].astype(np.int64)
            keys.append((word[at] << 32 | bucket)[bucket >= 0])
    found = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    ends = np.searchsorted(found, np.arange(1, len(words) + 1) << 32)
    flat = (found & 0xFFFFFFFF).astype(np.uint32).tobytes()
    return [flat[4 * lo : 4 * hi] for lo, hi in zip([0, *ends[:-1].tolist()], ends.tolist())]


class Features(dict):
    """Features (level << HASH_BITS | bucket) of texts; a bounded memo of tokens' buckets. If ``number`` is given, those without one are left out
    and the others go by it, so that all tables are as small as the model."""

    def __init__(self, number: np.ndarray | None = None, size: int = 1 << HASH_BITS):
        self.number, self.size = number, size
        self.counts = self.last = None  # scratch, made when first used

    def learn(self, tokens: list[str]) -> None:
        parts = [WORDS.findall(t) for t in tokens]
        words = list(dict.fromkeys(w for p in parts for w in p))
        known = dict(zip(words, all_buckets(words, self.number)))
        for token, p in zip(tokens, parts):
            self[token] = known[p[0]] if len(p) == 1 else b"".join(map(known.__getitem__, p))

    @staticmethod
    def tokens(text: str | None) -> Counter:
        """How often each token comes; no word has white space, so a token's words are looked for once."""
        words = Counter(text.lower().split()) if text else Counter()
        for token in [t for t in words if len(t) > LONG_TOKEN]:
            n = words.pop(token)
            for word in WORDS.findall(token):
                words[word] += n
        return words

    def prepare(self, several: list[Counter]) -> None:
        """Learn the tokens of several texts at once, which takes far less than one text at a time."""
        if sum(map(len, several)) > WORDS_AT_ONCE:
            return  # each text will do it, in parts
        new = {t for words in several for t in words if t not in self}
        if len(self) + len(new) > MEMO_WORDS:
            self.clear()
            new = {t for words in several for t in words}
        self.learn(list(new))

    def counted(self, words: Counter) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of a text's tokens, each once, and how often they come."""
        each = []
        for some in batched(words, WORDS_AT_ONCE):
            if len(self) > MEMO_WORDS:
                self.clear()
            if new := [t for t in some if t not in self]:
                self.learn(new)
            each += map(self.__getitem__, some)
        flat = np.frombuffer(b"".join(each), np.uint32)
        times = np.repeat(np.fromiter(words.values(), np.int32, len(each)), np.fromiter(map(len, each), np.int64, len(each)) // 4)
        if self.counts is None:
            self.counts, self.last = np.zeros(self.size, np.int32), np.zeros(self.size, np.int32)
        place = np.arange(len(flat), dtype=np.int32)
        self.counts[flat] = 0  # only what this text touches
        np.add.at(self.counts, flat, times)
        self.last[flat] = place
        bucket = flat[self.last[flat] == place]
        return bucket, self.counts[bucket]

    def of_text(self, text: str | None) -> np.ndarray:
        bucket, count = self.counted(self.tokens(text))
        return np.concatenate([bucket[count >= least] | np.uint32(k << HASH_BITS) for k, least in enumerate(LEVELS)])


class Model:
    """Sparse weights: feature, its weight, and the bias."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, bias: float):
        self.features, self.weights, self.bias = features, weights, bias

    def scorer(self):
        """text -> probability."""
        return lambda text: self.scores([text])[0]

    def scores(self, texts: list[str | None]) -> list[float]:
        """Probabilities of texts; their tokens' buckets are kept with the model, so that a worker's next task finds them again."""
        self.kept = getattr(self, "kept", None) or self._scorer()
        return self.kept(texts)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "kept"}

    def _scorer(self):
        bucket, level = self.features & ((1 << HASH_BITS) - 1), self.features >> HASH_BITS
        used, place = np.unique(bucket, return_inverse=True)
        number = np.full(1 << HASH_BITS, -1, np.int32)
        number[used] = np.arange(len(used))
        weight = np.zeros((len(LEVELS), len(used)))
        weight[level, place] = self.weights
        summed = np.cumsum(weight, axis=0).astype(np.float32).ravel()  # of all levels up to each
        features = Features(number, len(used))
        upto = (np.searchsorted(LEVELS, np.arange(LEVELS[-1] + 1), side="right") - 1) * len(used)  # by count, from 1 on

        def score(texts: list[str | None]) -> list[float]:
            out = []
            for some in batched(texts, TEXTS_AT_ONCE):
                tokens = [features.tokens(t) for t in some]
                features.prepare(tokens)
                for words in tokens:
                    bucket, count = features.counted(words)
                    z = self.bias + float(summed[upto[np.minimum(count, LEVELS[-1])] + bucket].sum(dtype=np.float64))
                    out.append(float(1 / (1 + np.exp(-np.clip(z, -500, 500)))))
            return out

        return score


def _featurise(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    features = Features()
    for pdf in pdfs:
        yield pd.DataFrame({"toxic": pdf["toxic"], "features": [features.of_text(t).tobytes() for t in pdf["text"]]})


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, texts that have it, toxic texts that have it) of a task's texts."""
    size = len(LEVELS) << HASH_BITS
    both, toxic = np.zeros(size, np.int32), np.zeros(size, np.int32)
    for batch in batches:
        for label, row in zip(batch.column("toxic").to_pylist(), batch.column("features")):
            found = np.frombuffer(row.as_py(), np.uint32)  # no feature comes twice
            both[found] += 1
            if label:
                toxic[found] += 1
    (some,) = np.nonzero(both)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(both[some].astype(np.int64)), pa.array(toxic[some].astype(np.int64))], ["feature", "n", "p"])


def solve(rows: list[np.ndarray], toxic: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of the chosen features (their places in ``rows``, values ``ratio``) and bias. Texts go
    through each step ``DOCS_AT_ONCE`` at a time, so that little more than the places themselves is held."""
    y, n = toxic.astype(np.float64), np.array([len(r) for r in rows])
    col, ends = np.concatenate(rows).astype(np.int32, copy=False), np.append(0, np.cumsum(n))
    w, b = np.zeros(len(ratio)), float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    m, v = np.zeros(len(ratio) + 1), np.zeros(len(ratio) + 1)
    for t in range(1, STEPS + 1):
        values, slope, errors = w * ratio, np.zeros(len(ratio)), 0.0
        for lo in range(0, len(rows), DOCS_AT_ONCE):
            some = slice(lo, lo + DOCS_AT_ONCE)
            size, part = n[some], col[ends[lo] : ends[min(lo + DOCS_AT_ONCE, len(rows))]]
            z, (full,) = np.full(len(size), b), np.nonzero(size)
            if len(part):
                z[full] += np.add.reduceat(values[part], (ends[:-1][some] - ends[lo])[full])
            err = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y[some]) / len(y)
            slope += np.bincount(part, np.repeat(err, size), len(ratio))
            errors += err.sum()
        g = np.append(ratio * slope + RIDGE * w, errors)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w * ratio, b


def _select(chosen: np.ndarray):
    """Texts with only the places of their chosen features."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = np.full(len(LEVELS) << HASH_BITS, -1, np.int32)
        place[chosen] = np.arange(len(chosen))
        for pdf in pdfs:
            each = (place[np.frombuffer(b, np.uint32)] for b in pdf["features"])
            yield pd.DataFrame({"toxic": pdf["toxic"], "features": [np.sort(x[x >= 0]).tobytes() for x in each]})

    return run


def _fit(ratio: np.ndarray):
    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, toxic = [], []
        for pdf in pdfs:
            rows += [np.frombuffer(b, np.int32) for b in pdf["features"]]
            toxic += pdf["toxic"].tolist()
        if rows:
            order = np.lexsort(([zlib.crc32(r) for r in rows], toxic))  # whatever order the shuffle gave
            w, b = solve([rows[i] for i in order], np.array(toxic)[order], ratio)
            yield pd.DataFrame({"weights": [w.astype("<f4").tobytes()], "bias": [b]})

    return run


def fit(docs: DataFrame, labels: DataFrame, held_out: Column, sample_docs: int = SAMPLE_DOCS, min_z: float = MIN_Z) -> Model:
    """Learn from labelled rows that aren't ``held_out``; contradicting labels of an id count as toxic."""
    rows, n, drawn = labelled_sample(docs, labels, "toxic", held_out, sample_docs)
    none = np.zeros(0, np.int64), np.zeros(0, np.float32)
    if not n.get(0) or not n.get(1):
        return Model(*none, 50.0 if n.get(1) else -50.0)
    if not drawn.get(0) or not drawn.get(1):
        return Model(*none, float(np.log(n[1] / n[0])))
    sample = save(rows.select(F.col("label").alias("toxic"), "text").mapInPandas(_featurise, "toxic int, features binary"), "toxic-sample")
    counts = sample.mapInArrow(_count, "feature long, n long, p long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("p").alias("p")).filter(F.col("n") >= MIN_DOCS)
    ratio = F.log((F.col("p") + 1) / (drawn[1] + 1)) - F.log((F.col("n") - F.col("p") + 1) / (drawn[0] + 1))
    error = F.sqrt(1 / (F.col("p") + 1) + 1 / (F.col("n") - F.col("p") + 1))
    top = counts.select("feature", ratio.alias("ratio"), error.alias("error")).filter(F.abs("ratio") >= min_z * F.col("error")).orderBy("feature").select("feature", "ratio").toArrow()  # no more than hash buckets
    features, ratios = top.column("feature").to_numpy(), top.column("ratio").to_numpy()
    got = sample.mapInPandas(_select(features), "toxic int, features binary").repartition(1).mapInPandas(_fit(ratios), "weights binary, bias double").collect()
    shift = np.log(n[1] / n[0]) - np.log(drawn[1] / drawn[0])
    return Model(features, np.frombuffer(got[0]["weights"], "<f4"), got[0]["bias"] + float(shift))


def scorer(docs: DataFrame, model: Model):
    """A column function: text -> probability of label 1."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in texts:
            yield pa.array(chain.from_iterable(sent.value.scores([t.as_py() for t in part[k : k + TEXTS_AT_ONCE]]) for k in range(0, len(part), TEXTS_AT_ONCE)), pa.float64())

    return score


def held_out(doc_id: Column) -> Column:
    return remainder_is(doc_id, 4, 2)


def assess(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **params) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Null and empty texts get the score of a text without features. Null doc_ids are never
    held out and have no label; repeated rows stay; without labels of both
    kinds every score is 0 (or 1 if all are toxic); an empty table gives no rows.
    """
    score = scorer(docs, fit(docs, labels, held_out(F.col("doc_id")), **params))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score("text").alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **params) -> DataFrame:
    """``docs`` (all columns) without rows that score ``threshold`` or more."""
    score = scorer(docs, fit(docs, labels, held_out(F.col("doc_id")), **params))
    s = free_name(docs, "toxicity")
    return docs.withColumn(s, score("text")).filter(F.col(s) < threshold).drop(s)
