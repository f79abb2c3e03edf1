"""Language, toxicity, line rules, language model and HTML against brute force or held-out rows."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from compare import connect, rows_of_both
from pyspark.sql import functions as F

from gridloom.llm import html_text, langid, line_rules, queries, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def crc_mod(i, m):
    return zlib.crc32(str(i).encode()) % m if i is not None else None


def ascii_lower(s):
    return "".join(c.lower() if c < "\x80" else c for c in s)


# language


def test_language_held_out(docs):
    got = langid.identify(docs).join(docs, "doc_id").collect()
    assert len(got) == docs.count() and all(r.held_out == (crc_mod(r.doc_id, 4) == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_word_votes_by_brute_force():
    words = [("en", "the", 6), ("fr", "la", 4), ("en", "a", 2)]
    m = langid.Model(["en", "fr"], [math.log10(0.5)] * 2, words, [("en", "th", 3), ("fr", "l", 5)])
    en = lambda c: math.log10((c + 0.5) / (8 + 0.5 * 4))
    fr = lambda c: math.log10((c + 0.5) / (4 + 0.5 * 4))
    assert np.allclose(m.vote("the"), [en(6), fr(0)])
    assert np.allclose(m.vote("thx"), langid.GRAM_WEIGHT * m.grams["th"])  # no longer gram is known
    assert np.allclose(m.vote("xl"), langid.GRAM_WEIGHT * m.grams["l"])
    assert not m.vote("zz").any()
    lang, score = langid.Scorer(m).predict("The la")
    total = np.array([en(6) + en(0), fr(0) + fr(4)])
    p = 10**total / (10**total).sum()
    assert lang == ["en", "fr"][int(p.argmax())] and math.isclose(score, p.max(), rel_tol=1e-5)


def test_language_odd_rows(odd, empty):
    got = langid.identify(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (3, 4, 5))
    assert by[6].lang_pred in ("en", "fr") and by[7].lang_pred == "en" and by[8].lang_pred == "fr"
    kept = langid.keep_identified(odd, 0.0)
    assert kept.columns == odd.columns and kept.count() == 7
    assert langid.identify(empty).collect() == [] and langid.keep_identified(empty).count() == 0


def test_memo_overflow_keeps_votes(monkeypatch):
    monkeypatch.setattr(langid, "MEMO_WORDS", 4)
    m = langid.Model(["en", "fr"], [0.0, 0.0], [("en", "a", 3), ("fr", "b", 3)], [])
    assert langid.Scorer(m).predict("a c d e f g h a a b")[0] == "en"


def invented(lang, k):
    """A word of a language with a number: letters only, its own ending."""
    return "".join("abcdefghij"[int(c)] for c in f"{k:03d}") + "".join("klmnopqrst"[int(c)] for c in f"{lang:03d}")


def test_three_hundred_languages(spark):
    rows = [(i, " ".join(invented(i % 300, (7 * i + k) % 40) for k in range(30)), f"l{i % 300:03d}") for i in range(2400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, langid.held_out(F.col("doc_id")))
    assert model.langs == sorted({x for _, _, x in rows})
    train = [(t, x) for i, t, x in rows if crc_mod(i, 4) != 2]
    assert set(model.words.at) == {w for t, _ in train for w in t.split()}  # no word of the sample is lost
    got = {r.doc_id: (r.held_out, r.lang_pred) for r in langid.identify(docs).collect()}
    held = [got[i][1] == x for i, _, x in rows if got[i][0]]
    assert len(held) > 300 and sum(held) == len(held)


def test_the_sample_is_shared_by_the_languages(spark):
    rows = [(i, f"word{'ab'[i % 10 > 0]}", "big" if i % 10 else "small") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, F.lit(False), sample_docs=10_000, max_docs=400)
    some = langid.fit(docs, F.lit(False), sample_docs=50, max_docs=400)
    times = lambda m, w: 10.0 ** max(m.words[w] - m.words.absent) * 0.5 - 0.5
    assert 120 < times(model, "worda") < 280 and 120 < times(model, "wordb") < 280
    assert 20 < times(some, "worda") < 90 and 20 < times(some, "wordb") < 90


def test_numerals_are_no_letters(spark):
    rows = [(1, "the cat", "en"), (2, "½ ²", None), (3, "½", None), (4, "① 12 Ⅳ", None), (5, "x²", None)]
    got = {r.doc_id: r.lang_pred for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got == {1: "en", 2: "und", 3: "und", 4: "und", 5: "en"}


# toxicity


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = toxicity.assess(docs, labels).join(labels, "doc_id", "left").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (crc_mod(r.doc_id, 4) == 2) for r in got)
    train = [r for r in got if r.toxic is not None and not r.held_out]
    assert sum(r.predicted == r.toxic for r in train) >= 0.97 * len(train)
    held = [r for r in got if r.toxic is not None and r.held_out]
    assert sum(r.predicted == r.toxic for r in held) >= 0.88 * len(held)
    found, alarms = ([r.predicted for r in held if r.toxic == x] for x in (1, 0))
    assert sum(found) >= 0.75 * len(found) and sum(alarms) <= 0.03 * len(alarms)  # 14 toxic rows; fitted on some 50


def test_features_of_many_words(monkeypatch):
    text = " ".join(f"wort{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600)) + " wortaa wortaa"
    want = toxicity.Features().of_text(text)
    monkeypatch.setattr(toxicity, "MEMO_WORDS", 20)
    monkeypatch.setattr(toxicity, "WORDS_AT_ONCE", 7)
    few = toxicity.Features()
    assert np.array_equal(few.of_text(text), want) and len(few) <= 27


def test_features_by_brute_force():
    f, text = toxicity.Features(), "Bad bad Ünd bad"
    count = Counter()
    for w, n in Counter(toxicity.WORDS.findall(text.lower())).items():
        for b in toxicity.word_buckets(w):
            count[b] += n
    want = {b | k << toxicity.HASH_BITS for b, n in count.items() for k, least in enumerate(toxicity.LEVELS) if n >= least}
    got = f.of_text(text).tolist()
    assert set(got) == want and len(got) == len(want)
    assert f.of_text(None).size == 0 == f.of_text("12 !").size


def test_toxicity_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, 0), (3, 0, 0), (8, None, None), (None, 1, 1), (1, 1, 0), (5, 1, 7)], "doc_id long, quality int, toxic int")
    got = toxicity.assess(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    none = toxicity.assess(odd, labels.limit(0)).collect()
    assert all(r.score < 1e-9 and r.predicted == 0 for r in none)
    kept = toxicity.keep_clean(odd, labels.limit(0))
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert toxicity.assess(empty, labels).collect() == []


# line rules


@pytest.mark.parametrize("table", ["sf0.001", "sf0.01"])
def test_line_rules_sql(spark, table):
    d = f"/root/testdata/{table}"
    mine, theirs = rows_of_both(spark, queries.op5_line_rules, line_rules.ORACLE_SQL, d, connect(d))
    assert mine == theirs


def base_counts(text):
    words = WORD.findall(text or "")
    at = {}
    for i in range(len(words) - 2):
        at.setdefault(tuple(words[i : i + 3]), []).append(i)
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    again = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(again)


def test_line_counts_odd_rows(odd, empty):
    got = sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in line_rules.judge(odd).collect())
    assert got == sorted(base_counts(r.text) for r in odd.collect())
    assert line_rules.judge(empty).collect() == [] and line_rules.clean(empty).count() == 0


def test_frequent_lines_go(spark):
    body = [" ".join(f"w{i}x{k}" for k in range(60)) for i in range(12)]
    rows = [(i, f"Cookie  Banner\n{b}", "h") for i, b in enumerate(body)] + [(20, "cookie banner\nx y", "h"), (21, "cookie banner\n" + body[0] + " more", "other"), (22, "cookie banner\n" * 60, "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in line_rules.judge(docs, host_limit=10).collect()}
    assert got[0].removed_words == 2 and got[0].kept and got[21].removed_words == 0 and not got[22].kept
    clean = {r.doc_id: r.text for r in line_rules.clean(docs, host_limit=10).collect()}
    assert clean[0] == body[0] and clean[20] == "x y" and clean[21].startswith("cookie") and 22 not in clean
    copies = spark.createDataFrame([(i, body[0], "h") for i in range(50)], "doc_id long, text string, source string")
    assert all(r.kept for r in line_rules.judge(copies, host_limit=10).collect())


# html

LONG = "This is the text of an article that has been written for a test and it is long enough to be good."


def test_pages_of_the_table(spark, sf):
    import html as entities

    for r in queries.op7_html(spark, sf).join(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html"), "page_id").collect():
        body = re.sub(r"<[^>]*$", "", r.html.split("<article>")[1].split("</article>")[0])
        blocks = (" ".join(entities.unescape(re.sub("<[^>]+>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", body))
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""), ("", ""), ("plain", ""), (f"<p>{LONG}", LONG), (f"<p>{LONG}</p><nav><p>{LONG}</p></nav>", LONG),
        (f"<article><h2>Head</h2><p>{LONG}</p><p>Short.</p></article><footer>x</footer>", f"Head\n{LONG}\nShort."),
        (f'<p>{LONG}</p><div class="user-comments"><p>{LONG}</p></div><div id=cookieBanner>{LONG}</div>', LONG),
        (f"<main><p>{LONG}</p><p><a href='x'>{LONG}</a></p><form>{LONG}</form></main>", LONG),
        (f"<article><p>a &lt;b&gt; &amp;amp; &#65;&nbsp; x</p><p>{LONG}</p></article>", f"a <b> &amp; A x\n{LONG}"),
        (f'<script>var t="</p>{LONG}";</script><style>p</style><!-- {LONG} --><article>A<b>b</b>c<p>{LONG}<img src="a>b"></article>', f"Abc\n{LONG}"),
        (f"<head><title>t</title><body><nav><li>x<article><p>{LONG}</p></article>", LONG),
        ("<article><p>Only</p><p>short</p></article>", "Only\nshort"),
        (f'<div class="page has-sidebar"><p>{LONG}</p></div><div class="right-sidebar"><p>{LONG}</p></div>', LONG),
        (f'<article class="post comments-open"><p>{LONG}</p></article><article class="comment"><p>{LONG}</p></article>', LONG),
        (f'<div id="comments"><article><p>{LONG}</p></article></div><div class="menu-wrap"><main><p>{LONG}</p></main></div>', LONG),
        (f"<p>{LONG}</p><p>{LONG}", f"{LONG}\n{LONG}"), (f"<article><p>{LONG} <b", LONG),
    ],
)
def test_main_text(page, want):
    assert html_text.main_text(page) == want


POLISH = ["Wczoraj wieczorem mieszkańcy miasteczka zebrali się na rynku, żeby obejrzeć pokaz ogni sztucznych.", "Organizatorzy zapowiedzieli już kolejną edycję wydarzenia, która odbędzie się przyszłego lata nad rzeką."]


@pytest.mark.parametrize("wrap", ["<div>{}</div>", "<article>{}</article>"])
def test_a_language_without_stop_words(wrap):
    links = '<p><a href="/a">Strona główna serwisu</a> <a href="/b">Wiadomości</a></p>'
    page = links + wrap.format(f"{links}<p>{POLISH[0]}</p><p>{POLISH[1]}</p>{links}")
    assert html_text.main_text(page) == "\n".join(POLISH)
    notice = "<p>We use cookies so that the site can do what you want of it, and you can say no to all of them.</p>"
    assert set(POLISH) < set(html_text.main_text(wrap.format(f"{notice}{links}<p>{POLISH[0]}</p><p>{POLISH[1]}</p><p>{POLISH[0]} {POLISH[1]}</p>")).split("\n"))


def test_an_article_of_short_blocks():
    links = '<p><a href="/a">Home</a> <a href="/b">News</a></p>'
    assert html_text.main_text(f"<article>{links}<ul><li>two eggs</li><li>milk</li></ul></article>") == "two eggs\nmilk"


def test_ambiguous_blocks_take_the_nearest_label():
    assert html_text.inherit([0, 1, 0, 0, -1, 0], False) == [True, True, True, False, False, False]
    assert html_text.inherit([1, 0, -1], False) == [True, True, False]
    assert html_text.inherit([0, 0], True) == [True, True] and html_text.inherit([], True) == []


def test_html_odd_rows(spark):
    rows = [(1, "u", None), (None, None, f"<p>{LONG}</p>"), (1, "u", None), (2, "v", "<p>x" * 20_000)]
    got = html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 4 and sorted(r.n_chars for r in got) == [0, 0, len(LONG), 2 * 20_000 - 1]  # a page of short blocks has text


def test_fit_by_the_definition():
    """Weights of a small logistic fit: the gradient of loss and ridge vanishes."""
    rng = np.random.default_rng(3)
    rows = [np.flatnonzero(rng.random(6) < 0.5).astype(np.int32) for _ in range(60)]
    rows[7] = rows[7][:0]
    toxic, ratio = (rng.random(60) < 0.4).astype(int), rng.normal(size=6)
    w, b = toxicity.solve(rows, toxic, ratio)
    x = np.zeros((60, 6))
    for i, r in enumerate(rows):
        x[i, r] = ratio[r]
    v = w / ratio
    err = (1 / (1 + np.exp(-(x @ v + b))) - toxic) / 60
    assert np.abs(x.T @ err + toxicity.RIDGE * v).max() < 5e-3 and abs(err.sum()) < 5e-3
    none = toxicity.solve([r[:0] for r in rows], toxic, ratio)
    assert not none[0].any() and math.isclose(1 / (1 + math.exp(-none[1])), toxic.mean(), abs_tol=0.02)
