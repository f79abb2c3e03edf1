"""Divergence audit, Merkle manifest and quality trees against brute force, SQL or held-out rows."""

import hashlib
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
from compare import rows_of_both
from pyspark.sql import functions as F

from gridloom.llm import common, divergence, langid, merkle, quality, queries, toxicity

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def ascii_lower(s):
    return "".join(c.lower() if c < "\x80" else c for c in s)


# divergence


def divergences(rows, min_docs=30, top=50):
    """Rows of the audit by the definition; rows: (lang, source, text)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    docs, counts = Counter(), Counter()
    for lang, source, text in rows:
        terms = [ascii_lower(t) for t in TERM.findall(text)]
        docs.update({(lang, t) for t in terms})
        counts.update((lang, source, t) for t in terms)
    out = []
    for lang in {r[0] for r in rows}:
        kept = sorted(t for (x, t), n in docs.items() if x == lang and n >= min_docs)
        sources = sorted({r[1] for r in rows if r[0] == lang})
        own = {s: {t: counts[lang, s, t] for t in kept} for s in sources}
        share = lambda c: {t: 1 + 10**9 * (n + 5) // (sum(c.values()) + 5 * len(kept)) for t, n in c.items()}  # noqa: E731, B023
        p, q = {s: share(own[s]) for s in sources}, share({t: sum(own[s][t] for s in sources) for t in kept})
        for s in sources:
            pair = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            term = [(p[s][t] - q[t], t) for t in kept if own[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pair, None), ("term", term, top)):
                ordered = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(ordered)]
    return sorted(out)


def audited(df, **params):
    return sorted(tuple(r) for r in divergence.audit(df, **params).select("lang", "source", "part", "item", "value", "rank").collect())


def test_divergence_sql(spark):
    mine, theirs = rows_of_both(spark, queries.op11_divergence, divergence.ORACLE_SQL, "/root/testdata/sf0.01")
    assert mine == theirs and len(mine) > 1000


def test_divergence_by_brute_force(spark, monkeypatch):
    """Small shards, blocks, tiles and partial counts; terms at the ends, next to each other, and inside others."""
    words = ["cat", "Cat", "cats", "at", "é", "É", "éa", "x y", "日本", "𝔘x", "a1b", "the", "then", " "]
    rows = [(("en", "fr", None)[i % 3], f"s{i % 7}" if i % 11 else None, " ".join(words[(i * k + k * k) % len(words)] for k in range(i % 13)) + ",the.cat"[: i % 9]) for i in range(300)]
    rows += [("de", "only", "cat cat")] + [("en", "s1", None), ("xx", "a", ""), ("xx", "b", "  "), ("xx", None, "cat")]
    for name, value in (("BLOCK", 2), ("TILE", 3), ("PARTIAL_TERMS", 5), ("PARTIAL_MATCHES", 7)):
        monkeypatch.setattr(divergence, name, value)
    df = spark.createDataFrame(rows, "lang string, source string, text string").withColumn("Term", F.lit(3)).withColumn("n", F.lit("x"))
    for shard in (4, 1000):
        assert audited(df, min_docs=5, shard=shard) == divergences(rows, 5)
    assert audited(df, min_docs=10_000) == divergences(rows, 10_000)  # no term is kept


def test_divergence_odd_rows(odd, empty):
    assert audited(empty) == []
    rows = [(r.lang, r.source, r.text) for r in odd.collect()]
    assert audited(odd, min_docs=1, top=3) == divergences(rows, 1, 3)


def test_exact_shares(spark):
    cases = [(0, 0), (5, 0), (5, 10), (1, 3), (10**13, 10**13 + 1), (8 * 10**15, 8 * 10**15), (7, 8999999999999999)]
    df = spark.createDataFrame(cases, "c long, n long")
    got = [r[0] for r in df.select(divergence.permille(F.col("c"), F.col("n"))).collect()]
    assert got == [1 + 10**9 * c // n if n else 1 for c, n in cases]


# Merkle


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of documents, by the definition."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: sha("".join(field(r[c]) if c != "text" else field(text) for c in merkle.FIELDS))
    groups = {}
    for r in rows:
        bad = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
        own = leaf(r, ascii_lower(r["text"]) if bad and r["text"] is not None else r["text"])
        groups.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), own))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][k : k + 8])) for k in range(0, len(out[-1]), 8)])
        return out

    def siblings(tree, i):
        for level in tree[:-1]:
            yield "".join(level[i // 8 * 8 : i]), "".join(level[i + 1 : i // 8 * 8 + 8])
            i //= 8

    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [levels([x[2] for x in sorted(groups[g])]) for g in names]
    top, out = levels([t[-1][0] for t in trees]), []
    for k, (g, tree) in enumerate(zip(names, trees)):
        for i, (some, doc, h, own) in enumerate(sorted(groups[g])):
            path, fold = [*siblings(tree, i), *siblings(top, k)], own
            for a, b in path:
                fold = sha(a + fold + b)
            out.append((doc if some else None, h, tree[-1][0], top[-1][0], sha("".join(a + b for a, b in path)), fold, fold == top[-1][0]))
    return sorted(out, key=repr)


def proven(df, **params):
    return sorted((tuple(r) for r in merkle.audit(df, **params).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


def test_manifest_of_the_table(spark, docs):
    assert proven(docs) == manifest([r.asDict() for r in docs.collect()])


def test_manifest_sql(spark):
    mine, theirs = rows_of_both(spark, queries.op12_merkle, merkle.ORACLE_SQL, "/root/testdata/sf0.001")
    assert mine == theirs


def test_manifest_odd_rows(odd, empty):
    assert proven(odd) == manifest([r.asDict() for r in odd.collect()])
    assert proven(odd.filter("lang = 'zz'")) == [] == proven(empty) and "root" in merkle.audit(empty).columns
    one = odd.filter("doc_id = 4")
    (r,) = proven(one)
    assert r[1] == r[2] == r[3] and r[4] == sha("")


@pytest.mark.parametrize("crowd", [3, 4096])
def test_manifest_of_crowded_ids(spark, crowd):
    """Ids far apart, negative, repeated with other texts, and equal rows; more groups than a run holds."""
    rows = [(i * 7 % 600 - 300, f"T{i}", "abcdefghijk"[i % 11] if i % 5 else None, "s", 1) for i in range(700)]
    rows += [(2**62 + i, "x", "é", None, None) for i in range(9)] + [(-(2**63), "y", "é", "", 0), (2**63 - 1, None, "é", "", 0)]
    rows += [(5, f"of one id {i}", "en", "s", 2) for i in range(60)] + [(5, "the same row", "en", "s", 2)] * 40 + [(None, f"n{i % 9}", "en", "s", 2) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    assert proven(df, crowd=crowd) == manifest([r.asDict() for r in df.collect()])


def test_ranks_are_exact(spark):
    rows = [(g, int(d)) for g in ("", "=a") for d in np.random.default_rng(4).integers(-(2**63), 2**63 - 1, 800)] + [("=a", d) for d in range(-900, 900)]
    df = spark.createDataFrame([(g, d, sha(str(d)), None, k) for k, (g, d) in enumerate(rows)], "grp string, doc_id long, leaf string, own string, row long")
    got = {(r.grp, r.doc_id): (r.i, r.total) for r in merkle.ranked(df).collect()}
    for g in ("", "=a"):
        ids = sorted(d for x, d in rows if x == g)
        assert [got[g, d] for d in ids] == [(k, len(ids)) for k in range(len(ids))]


# quality


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = quality.assess(docs, labels).join(labels, "doc_id", "left").collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    for held, least in ((False, 0.99), (True, 0.93)):
        some = [r for r in got if r.quality is not None and r.held_out == held]
        assert len(some) > 80 and sum(r.predicted == r.quality for r in some) >= least * len(some)
    bad = [r.predicted for r in got if r.quality == 0 and r.held_out]
    assert sum(bad) <= 0.15 * len(bad)
    assert quality.keep_good(docs, labels).columns == docs.columns


def plain_statistics(text):
    """Some of the numbers without numpy."""
    words = [w for w in re.split(r"\s+", text) if w]
    lines = [re.split(r"\s+", x.strip()) for x in text.split("\n") if x.strip()]
    n, times = len(words), Counter(words)
    twice = lambda keys: sum(c for c in Counter(keys).values() if c > 1) / len(keys) if keys else 0.0
    grams = lambda k: [tuple(words[i : i + k]) for i in range(n - k + 1)]
    letters = sum(c.isalpha() for c in text)
    return {
        "log_chars": np.log1p(len(text)), "log_words": np.log1p(n), "word_length": np.mean([len(w) for w in words]), "word_spread": np.std([len(w) for w in words]),
        "upper_letters": sum(c.isupper() for c in text) / max(1, letters), "distinct_words": len(times) / n, "top_word": max(times.values()) / n, "once_words": sum(c == 1 for c in times.values()) / n,
        "next_repeats": sum(a == b for a, b in zip(words, words[1:])) / n, "pair_repeats": twice(grams(2)), "triple_repeats": twice(grams(3)), "five_repeats": twice(grams(5)),
        "line_repeats": twice([tuple(x) for x in lines]), "line_words": np.mean([len(x) for x in lines]), "ended_words": sum(w[-1] in ".!?…。！？" for w in words) / n,
        "symbol_words": sum(any(c in quality.SYMBOLS or unicodedata.category(c)[0] in "SC" for c in w) for w in words) / n, "letterless_words": sum(not any(c.isalpha() for c in w) for w in words) / n,
        "shouted_words": sum(len(a := [c for c in w if c.isalpha()]) > 1 and all(c.isupper() for c in a) for w in words) / n,
    }


@pytest.mark.parametrize("piece", [7, 1 << 20])
def test_statistics_by_brute_force(docs, monkeypatch, piece):
    monkeypatch.setattr(quality, "PIECE", piece)
    texts = [r.text for r in docs.select("text").limit(25).collect()] + ["One", "a a a\n\na a a\n", " É été ÉTÉ x　日本。 𝔘 😀 |", "THE!! the%%% 12\n" * 5]
    for text in texts:
        got = dict(zip(quality.NAMES, quality.statistics(text)))
        for name, want in plain_statistics(text).items():
            assert got[name] == pytest.approx(want, abs=1e-12), (name, text)
    for text in (None, "", " \n\t"):
        got = dict(zip(quality.NAMES, quality.statistics(text)))
        assert all(v == 0 for k, v in got.items() if not k.startswith("log_"))


def walk(m, tree, x):
    node = 0
    while node < m.feature.shape[1]:
        node = 2 * node + 1 + bool(x[m.feature[tree, node]] >= m.cut[tree, node])
    return m.value[tree, node - m.feature.shape[1]]


def test_traversal_and_first_split_by_brute_force():
    rng = np.random.default_rng(6)
    x = rng.integers(0, 9, (400, 5)).astype(float)
    y = ((x[:, 1] > 4) ^ (x[:, 3] > 6) ^ (rng.random(400) < 0.05)).astype(float)
    m = quality.boost(x, y, trees=20, depth=3)
    some = rng.normal(4, 4, (50, 5))
    want = [1 / (1 + np.exp(-(m.bias + sum(walk(m, t, r) for t in range(20))))) for r in some]
    assert np.allclose(m.scores(some), want)
    p = y.mean() * np.ones(400)
    p = (y.sum() + 0.5) / 401 + 0 * p
    g, h = p - y, p * (1 - p)
    score = lambda k: g[k].sum() ** 2 / (h[k].sum() + quality.RIDGE)
    gains = {(f, c): score(x[:, f] < c) + score(x[:, f] >= c) for f in range(5) for c in range(1, 9)}
    assert gains[int(m.feature[0, 0]), m.cut[0, 0]] == pytest.approx(max(gains.values()))
    assert ((m.scores(x) >= 0.5) == y).mean() > 0.93
    flat = quality.boost(np.zeros((10, 2)), np.array([0.0, 1.0] * 5), trees=2, depth=2)
    assert np.allclose(flat.scores(np.zeros((3, 2))), 0.5)


def test_quality_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (3, 0, 0), (8, None, None), (None, 1, 1), (1, 0, 0), (5, 7, 1)], "doc_id long, quality int, toxic int")
    got = quality.assess(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (3, 4)}) == 1
    assert all(r.score < 1e-9 and r.predicted == 0 for r in quality.assess(odd, labels.limit(0)).collect())
    ones = quality.assess(odd, labels.filter("quality = 1")).collect()
    assert all(r.score > 1 - 1e-9 and r.predicted == 1 for r in ones)
    assert quality.assess(empty, labels).collect() == [] and quality.keep_good(empty, labels).count() == 0


# samples of labelled rows


@pytest.mark.parametrize("doc_id", [1, 3, None])  # none of them is held out
def test_many_rows_of_one_id(spark, doc_id):
    """A sample by rows: about as many as asked for, whatever the ids are."""
    rows = [(doc_id, ("le chat %d" if i % 2 else "the dog %d") % i if i % 3 else "the same text", "fr" if i % 2 and i % 3 else "en") for i in range(5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df, F.lit(False), sample_docs=200)
    times = lambda w: 10.0 ** max(model.words[w] - model.words.absent) * 0.5 - 0.5
    assert 120 < times("chat") < 300 and 20 < times("dog") + times("same") < 300
    got = langid.identify(df, sample_docs=200).collect()
    assert len(got) == 5000 and all(r.lang_pred in ("en", "fr") for r in got)
    labels = spark.createDataFrame([(doc_id, 1, 1), (99, 0, 0)], "doc_id long, quality int, toxic int")
    more = df.unionByName(spark.createDataFrame([(99, "x y z", "en")], df.schema))
    sample, n, drawn = common.labelled_sample(more, labels, "toxic", F.lit(False), 300)
    assert drawn == ({1: drawn[1], 0: 1} if doc_id else {0: 1}) and (doc_id is None or 200 < drawn[1] < 400) and sample.count() == sum(drawn.values())
    assert toxicity.assess(more, labels, sample_docs=300).count() == 5001 == quality.assess(more, labels, sample_docs=300).count()


def test_chosen_features_by_brute_force(spark):
    """Log-count ratios and the choice of features of a fit, counted plainly."""
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(rng.choice(["bad", "good", "fine", "ugly", "word", "text"], 6, p=[0.3, 0.05, 0.05, 0.3, 0.15, 0.15] if i % 3 == 0 else [0.03, 0.3, 0.3, 0.03, 0.17, 0.17]))) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(240)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.lit(False))
    have, toxic = Counter(), Counter()
    for i, text in rows:
        found = set(toxicity.Features().of_text(text).tolist())
        have.update(found)
        toxic.update(found if i % 3 == 0 else ())
    want = set()
    for f, n in have.items():
        p, q = toxic[f], n - toxic[f]
        ratio = np.log((p + 1) / 81) - np.log((q + 1) / 161)
        if n >= toxicity.MIN_DOCS and abs(ratio) >= toxicity.MIN_Z * np.sqrt(1 / (p + 1) + 1 / (q + 1)):
            want.add(f)
    assert set(model.features.tolist()) == want and len(want) > 20
    score = model.scorer()
    assert score("bad ugly bad") > 0.9 > 0.1 > score("good fine good")
