"""Document quality by histogram gradient-boosted trees over document statistics.

``statistics`` turns a whole text into numbers (``NAMES``): lengths, shares of character classes, shapes of words,
repetition of words, pairs, triples and lines, line and sentence ends. Words are compared by 64-bit hashes that
numpy takes from one running sum over the characters.

Trees are complete, of ``DEPTH`` levels, and grown a level at a time on histograms of the loss's first two
derivatives over ``BINS`` quantile bins of each statistic. They are fitted on a bounded sample: about ``sample_docs`` labelled
rows of each label; the bias is then moved to the shares among all labelled ids. All trees lie in three
arrays, and a batch of texts goes through all of them together, one level a step.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, labelled_sample, remainder_is

SAMPLE_DOCS = 10_000
TREES = 150
DEPTH = 4
BINS = 64
RATE = 0.1
RIDGE = 1.0
LEAST = 1.0  # second derivatives on either side of a split
THRESHOLD = 0.7
PIECE = 1 << 20  # characters that are looked at together

BLANK, BREAK, LOWER, UPPER, DIGIT, MARK, SYMBOL = range(7)
SYMBOLS = set("#*$%&@|<>^~=+_\\/{}[]`")
ENDS = np.array([ord(c) for c in ".!?…。！？"], np.uint32)
NAMES = tuple("""
log_chars log_words log_lines word_length word_spread short_words long_words upper_letters digits marks symbols
letterless_words capital_words shouted_words symbol_words distinct_words once_words top_word top_ten_words word_entropy
next_repeats pair_repeats triple_repeats five_repeats line_repeats line_words line_spread ended_lines ended_words marks_per_word
""".split())  # fmt: skip


def _class(c: str) -> int:
    if c == "\n":
        return BREAK
    if c.isspace():
        return BLANK
    if c.isalpha():
        return UPPER if c.isupper() else LOWER
    if c.isdigit():
        return DIGIT
    return SYMBOL if c in SYMBOLS or unicodedata.category(c)[0] not in "PM" else MARK


CLASS = np.array([_class(chr(i)) for i in range(1 << 17)] + [LOWER], np.uint8)  # the last: planes 2 on, which hold ideographs
BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64


class Powers:
    """Powers of the base and of its inverse, as many as were ever asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def take(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            row = lambda b: np.cumprod(np.append(np.uint64(1), np.full(size - 1, b, np.uint64)))
            self.up, self.down = row(BASE), row(pow(BASE, -1, 1 << 64))
        return self.up[:n], self.down[:n]


POWERS = Powers()


def hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each slice of ``values``, whatever its place."""
    up, down = POWERS.take(len(values) + 1)
    total = np.append(np.uint64(0), np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[:-1]))
    return (total[ends] - total[starts]) * down[starts] * np.uint64(BASE) ^ (ends - starts).astype(np.uint64)


def pieces(text: str) -> Iterator[str]:
    """``text`` cut after white space, so that no word is cut."""
    at = 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and not text[end - 1].isspace():
            end += 1
        yield text[at:end]
        at = end


def words_of(piece: str) -> tuple[np.ndarray, ...]:
    """(character counts by class, line breaks; then for each word: hash, length, line, letters, upper, symbols, its first is upper, its last ends a sentence)."""
    u = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = CLASS[np.minimum(u, 1 << 17)]
    filled = np.concatenate(([0], (kind > BREAK).astype(np.int8), [0]))
    step = np.diff(filled)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    count = lambda mask: np.add.reduceat(mask.astype(np.int64), starts) if len(starts) else np.zeros(0, np.int64)
    line = np.cumsum(kind == BREAK)[starts] if len(starts) else np.zeros(0, np.int64)
    last = ends - 1
    return np.bincount(kind, minlength=7), hashes(u, starts, ends), ends - starts, line, count((kind == LOWER) | (kind == UPPER)), count(kind == UPPER), count(kind == SYMBOL), kind[starts] == UPPER, np.isin(u[last], ENDS)


def again(keys: np.ndarray) -> float:
    """Share of the keys that come twice or more."""
    if not len(keys):
        return 0.0
    _, n = np.unique(keys, return_counts=True)
    return float(n[n > 1].sum() / len(keys))


def statistics(text: str | None) -> np.ndarray:
    """The numbers ``NAMES`` of a text; all are 0 for null and for texts without a word, but for the lengths."""
    out = dict.fromkeys(NAMES, 0.0)
    parts, breaks = [], 0
    for piece in pieces(text or ""):
        found = words_of(piece)
        parts.append((found[0], *found[1:3], found[3] + breaks, *found[4:]))
        breaks += int(found[0][BREAK])
    if parts:
        classes = np.sum([p[0] for p in parts], axis=0)
        word, length, line, letters, upper, symbols, capital, ended = (np.concatenate([p[k] for p in parts]) for k in range(1, 9))
        out |= {"log_chars": np.log1p(classes.sum()), "log_words": np.log1p(len(word)), "log_lines": np.log1p(breaks + 1)}
        if n := len(word):
            solid = classes[2:].sum()
            shouted = (upper == letters) & (letters > 1)
            out |= {"word_length": length.mean(), "word_spread": length.std(), "short_words": (length <= 3).mean(), "long_words": (length >= 12).mean()}
            out |= {"upper_letters": classes[UPPER] / max(1, classes[UPPER] + classes[LOWER]), "digits": classes[DIGIT] / solid, "marks": classes[MARK] / solid, "symbols": classes[SYMBOL] / solid}
            out |= {"letterless_words": (letters == 0).mean(), "capital_words": (capital & ~shouted).mean(), "shouted_words": shouted.mean(), "symbol_words": (symbols > 0).mean()}
            _, times = np.unique(word, return_counts=True)
            times = np.sort(times)[::-1]
            share = times / n
            out |= {"distinct_words": len(times) / n, "once_words": (times == 1).sum() / n, "top_word": share[0], "top_ten_words": share[:10].sum(), "word_entropy": -(share * np.log(share)).sum()}
            chain = lambda k: hashes(word, np.arange(n - k + 1), np.arange(k, n + 1)) if n >= k else word[:0]
            out |= {"next_repeats": (word[1:] == word[:-1]).sum() / n, "pair_repeats": again(chain(2)), "triple_repeats": again(chain(3)), "five_repeats": again(chain(5))}
            first = np.flatnonzero(np.diff(line, prepend=-1))
            stop = np.append(first[1:], n)
            sizes = stop - first
            out |= {"line_repeats": again(hashes(word, first, stop)), "line_words": sizes.mean(), "line_spread": sizes.std(), "ended_lines": ended[stop - 1].mean(), "ended_words": ended.mean(), "marks_per_word": classes[MARK] / n}
    return np.array([out[k] for k in NAMES])


class Model:
    """``feature`` and ``cut`` of the inner nodes (trees x 2**DEPTH - 1), ``value`` of the leaves (trees x 2**DEPTH)."""

    def __init__(self, feature: np.ndarray, cut: np.ndarray, value: np.ndarray, bias: float):
        self.feature, self.cut, self.value, self.bias = feature, cut, value, bias

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 for rows of statistics."""
        trees, inner = self.feature.shape
        z = np.full(len(x), self.bias)
        if trees:
            feature, cut, value = self.feature.ravel(), self.cut.ravel(), self.value.ravel()
            row, top = np.arange(len(x))[:, None], inner * np.arange(trees)[None, :]
            node = np.zeros((len(x), trees), np.int64)
            for _ in range((inner + 1).bit_length() - 1):
                at = top + node
                node = 2 * node + 1 + (x[row, feature[at]] >= cut[at])
            z += value[(inner + 1) * np.arange(trees)[None, :] + node - inner].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def best_splits(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, bin, gain) of each node; g, h: nodes x features x bins. Rows in later bins go right."""
    gl, hl = np.cumsum(g, axis=2)[:, :, :-1], np.cumsum(h, axis=2)[:, :, :-1]
    ga, ha = g.sum(axis=2)[:, :, None], h.sum(axis=2)[:, :, None]
    gain = gl**2 / (hl + RIDGE) + (ga - gl) ** 2 / (ha - hl + RIDGE) - ga**2 / (ha + RIDGE)
    gain = np.where((hl >= LEAST) & (ha - hl >= LEAST), gain, 0.0).reshape(len(g), -1)
    best = gain.argmax(axis=1)
    return best // gl.shape[2], best % gl.shape[2], gain[np.arange(len(g)), best]


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS) -> Model:
    """Trees for the logistic loss of labels y over rows x."""
    rows, width = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)], axis=1)
    inner = (1 << depth) - 1
    feature, cut, value = np.zeros((trees, inner), np.int32), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    z = np.full(rows, np.log((y.sum() + 0.5) / (rows - y.sum() + 0.5)))
    bias = float(z[0])
    cells = binned + bins * np.arange(width)
    for t in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h, node = p - y, p * (1 - p), np.zeros(rows, np.int64)
        for level in range(depth):
            base, size = (1 << level) - 1, 1 << level
            at = ((node - base)[:, None] * (width * bins) + cells).ravel()
            sums = [np.bincount(at, np.repeat(v, width), size * width * bins).reshape(size, width, bins) for v in (g, h)]
            f, b, gain = best_splits(*sums)
            for k in np.flatnonzero(gain > 1e-9):
                feature[t, base + k], cut[t, base + k] = f[k], edges[f[k]][b[k]]
            node = 2 * node + 1 + (x[np.arange(rows), feature[t, node]] >= cut[t, node])
        leaf = node - inner
        value[t] = -RATE * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + RIDGE)
        z += value[t, leaf]
    return Model(feature, cut, value, bias)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [statistics(t.as_py()).tobytes() for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(rows, pa.binary())], ["label", "row"])


def _fit(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    found = sorted((x, y) for pdf in pdfs for x, y in zip(pdf["row"], pdf["label"]))  # whatever order the shuffle gave
    if found:
        x, y = np.array([np.frombuffer(r) for r, _ in found]), np.array([y for _, y in found], np.float64)
        m = boost(x, y)
        yield pd.DataFrame({"feature": [m.feature.astype("<i4").tobytes()], "cut": [m.cut.astype("<f8").tobytes()], "value": [m.value.astype("<f8").tobytes()], "bias": [m.bias]})


def fit(docs: DataFrame, labels: DataFrame, held_out: Column, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Learn from labelled rows that aren't ``held_out``; contradicting labels of an id count as 1."""
    sample, n, drawn = labelled_sample(docs, labels, "quality", held_out, sample_docs)
    inner = (1 << DEPTH) - 1
    if not drawn.get(0) or not drawn.get(1):
        bias = 50.0 if n.get(1) and not n.get(0) else -50.0 if not n.get(1) else float(np.log(n[1] / n[0]))
        return Model(np.zeros((0, inner), np.int32), np.zeros((0, inner)), np.zeros((0, inner + 1)), bias)
    # one task over a sample of bounded size
    (got,) = sample.mapInArrow(_measure, "label int, row binary").repartition(1).mapInPandas(_fit, "feature binary, cut binary, value binary, bias double").collect()
    shift = float(np.log(n[1] / n[0]) - np.log(drawn[1] / drawn[0]))
    return Model(np.frombuffer(got["feature"], "<i4").reshape(-1, inner), np.frombuffer(got["cut"], "<f8").reshape(-1, inner), np.frombuffer(got["value"], "<f8").reshape(-1, inner + 1), got["bias"] + shift)


def scorer(docs: DataFrame, model: Model):
    """A column function: text -> probability of label 1."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in texts:
            x = np.array([statistics(t.as_py()) for t in part]).reshape(len(part), len(NAMES))
            yield pa.array(np.concatenate([sent.value.scores(x[k : k + 1000]) for k in range(0, len(x), 1000)] or [np.zeros(0)]), pa.float64())

    return score


def held_out(doc_id: Column) -> Column:
    return remainder_is(doc_id, 4, 2)


def assess(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **params) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Null and empty texts get the score of a text without words. Null doc_ids are never
    held out and have no label; repeated rows stay and score alike; labels other than 0 and 1 are ignored; without labels of both
    kinds every score is 0 (or 1 if all are 1); an empty table gives no rows; other columns are ignored.
    """
    score = scorer(docs, fit(docs, labels, held_out(F.col("doc_id")), **params))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score("text").alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **params) -> DataFrame:
    """``docs`` (all columns) that score ``threshold`` or more."""
    score = scorer(docs, fit(docs, labels, held_out(F.col("doc_id")), **params))
    s = free_name(docs, "quality_score")
    return docs.withColumn(s, score("text")).filter(F.col(s) >= threshold).drop(s)
