"""Mixing, near-duplicates, media and the pipeline against brute force."""

import hashlib
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from gridloom.llm import media, mixing, simhash, subword

# mixing


@settings(max_examples=150, deadline=None)
@given(st.lists(st.floats(1e-4, 1), min_size=1, max_size=40), st.sampled_from([64, 100, 4096]))
def test_schedule_stays_within_a_block(weights, period):
    w = {f"s{i}": x for i, x in enumerate(weights)}
    q = mixing.quotas(w, period)
    assert sum(q.values()) == period and min(q.values()) >= 1
    count = dict.fromkeys(q, 0)
    for t, (s, k, slot, release, due) in enumerate(mixing.period_order(q)):
        assert slot == t and k == count[s] and release <= t < due
        count[s] += 1
        assert all(abs(count[x] - (t + 1) * q[x] / period) < 1 for x in q)
    assert count == q


def test_quotas_refuse():
    with pytest.raises(ValueError):
        mixing.quotas({"a": 1.0, "b": 0.0})
    with pytest.raises(ValueError):
        mixing.quotas({str(i): 1.0 for i in range(9)}, 8)


def test_mix_of_a_table(docs):
    rows = mixing.schedule(docs, block_docs=2, period=64).select("doc.doc_id", "doc.source", "quota", "block", "epoch", "slot", "position").collect()
    sizes = {r.source: r.n for r in docs.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}
    assert len({(r.position) for r in rows}) == len(rows)
    order = {(s, k): slot for s, k, slot, _, _ in mixing.period_order({r.source: r.quota for r in rows})}
    for r in rows:
        blocks = -(-sizes[r.source] // 2)
        assert r.epoch == r.block // blocks and r.slot == r.block // r.quota * 64 + order[r.source, r.block % r.quota]
    seen = {}
    for r in rows:
        seen.setdefault(r.slot, set()).add(r.source)
    assert sorted(seen) == list(range(len(seen))) and all(len(s) == 1 for s in seen.values())


def test_long_mixes_keep_the_given_weights():
    from fractions import Fraction

    names = ["hot", *[f"s{i}" for i in range(19)], "tiny"]
    given = [(1 / 3) ** 0.7, *[(2 / 57) ** 0.7] * 19, 1e-5]
    whole = mixing._exact(given)
    assert [Fraction(w, sum(whole)) for w in whole] == [Fraction(w) / sum(map(Fraction, given)) for w in given]
    count, share = [0] * 21, np.array(given) / sum(given)
    for s, k, slot, release, due in mixing.block_order(names, whole, [10_000, *[1_000] * 19, 1]):
        assert k == count[s] and release <= slot < due
        count[s] += 1
        if slot % 97 == 0:
            assert np.abs(np.array(count) - (slot + 1) * share).max() < 1 + 1e-9
    assert sum(count) > 20_000 and count[20] == 1


def test_more_sources_than_slots_of_a_period(spark):
    docs = spark.range(5000).selectExpr("id AS doc_id", "concat('s', id) AS source")
    rows = mixing.schedule(docs).select("doc.doc_id", "slot", "epoch").collect()
    assert sorted(r.doc_id for r in rows) == list(range(5000)) == sorted(r.slot for r in rows)


def test_a_small_weight_is_not_raised(spark):
    docs = spark.range(101).selectExpr("id AS doc_id", "if(id = 100, 'tiny', 'big') AS source")
    rows = mixing.schedule(docs, {"big": 1.0, "tiny": 1e-4}, block_docs=1).select("mix_source", "slot").collect()
    tiny = [r.slot for r in rows if r.mix_source == "tiny"]
    end = 1 + max(r.slot for r in rows)
    assert len(rows) == end and len(tiny) == 1 and abs(1 - end * 1e-4 / 1.0001) < 1


def test_mix_once_and_odd_rows(odd, empty):
    got = mixing.interleave(odd)
    assert got.columns == odd.columns and sorted(got.collect(), key=repr) == sorted(odd.collect(), key=repr)
    assert mixing.interleave(empty).count() == 0 and mixing.schedule(empty).count() == 0
    assert mixing.schedule(odd, block_docs=1).select("doc.doc_id").distinct().count() == odd.select("doc_id").distinct().count()
    with pytest.raises(ValueError):
        mixing.schedule(odd, {"a": 1.0})


# near-duplicates


def slow_fingerprint(text):
    import xxhash

    words = "".join(c.lower() if c < "\x80" else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\r", " ").replace("\n", " ").split(" ")
    words = [w for w in words if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def slow_components(fps, ids, bits=4):
    parent = list(range(len(fps)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                parent[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(fps))]


def test_near_duplicates_of_a_table(docs):
    got = simhash.dedup(docs).collect()
    assert all(r.root <= r.fp for r in got)
    texts = {r.doc_id: r.text for r in docs.collect()}
    fps = [slow_fingerprint(texts[r.doc_id]) for r in got]
    assert [r.fp % 2**64 for r in got] == fps
    assert [r.component_id for r in got] == slow_components(fps, [r.doc_id for r in got])


@pytest.mark.parametrize("chunk", [1, 3, 2048])
def test_links_lose_nothing(spark, chunk):
    rng = np.random.default_rng(chunk)
    base = rng.integers(0, 2**63, 40, dtype=np.int64)
    fps = {int(x) for x in base}
    for x in base:  # chains, balls and sign bits
        for n in range(12):
            y = int(x)
            for b in rng.choice(64, n % 7, replace=False):
                y ^= 1 << int(b)
            fps.add(y - 2**64 if y >= 2**63 else y)
    fps = sorted(fps)
    edges = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long").repartition(5), chunk_homes=chunk)
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    want = slow_components([f % 2**64 for f in fps], fps)
    assert [roots.get(f, f) for f in fps] == want


def test_every_close_pair_shares_an_anchor():
    rng = np.random.default_rng(0)
    a = rng.integers(-(2**63), 2**63 - 1, 2000, dtype=np.int64)
    b = a.copy()
    for i in range(len(b)):
        for k in rng.choice(64, rng.integers(0, 5), replace=False):
            b[i] ^= np.int64(-(2**63)) if k == 63 else np.int64(1) << np.int64(k)
    homes = np.stack(simhash.home_anchors(a))
    row, key, _ = simhash.anchors(b)
    sets = [set() for _ in b]
    for r, k in zip(row, key):
        sets[r].add(int(k))
    assert all(any(int(h) in sets[i] for h in homes[:, i]) for i in range(len(a)))


def test_near_duplicates_odd_rows(odd, empty):
    got = simhash.dedup(odd).collect()
    fps = [slow_fingerprint(r.text) for r in odd.collect()]
    assert sorted(r.fp % 2**64 for r in got) == sorted(fps)
    assert all(r.component_id == 3 for r in got if r.fp == 0)
    assert {r.component_id for r in got if r.doc_id in (2, 8)} == {2}
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "2", "3", "6", "7", "None", "None"])
    assert simhash.dedup(empty).collect() == [] and simhash.keep_first(empty).count() == 0


def test_repeated_ids_over_different_texts(spark):
    text = lambda k: " ".join(f"{w}{k}" for w in ("lorem", "ipsum", "dolor", "sit", "amet", "elit", "sed", "do"))
    rows = [(5, text(1), "a"), (5, text(2), "b"), (5, text(2), "c"), (7, text(1), "d"), (3, text(3), "e"), (5, text(3), "f"), (9, text(4), "g"), (None, text(4), "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    kept = simhash.keep_first(docs).collect()
    assert sorted((r.doc_id, r.text) for r in kept if r.doc_id) == [(3, text(3)), (5, text(1)), (5, text(2)), (9, text(4))] and len(kept) == 5


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows(spark, odd, empty, stage, tmp_path):
    labels = [(1, 1, 0), (2, 1, 0), (3, 0, 1), (8, None, None), (None, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    run = dict(corpus_pipeline.STAGES)[stage]
    got = run(spark, odd, str(tmp_path))
    assert run(spark, empty, str(tmp_path)).count() == 0
    if stage == "pack":
        assert got.agg(F.sum("length")).first()[0] == sum(len(subword.word_ids(subword.default_path()).encode(r.text)) // 4 for r in odd.collect())
    else:
        key = lambda rows: Counter(repr(r) for r in rows)
        before, after = key(odd.collect()), key(got.collect())
        assert got.columns == odd.columns and not after - before and (stage != "mix" or after == before)


# media


def png(data=b"x"):
    chunk = lambda n, d: struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(data)) + chunk(b"IEND", b"")


GIF = b"GIF89a\x01\x00\x01\x00\x80\x00\x00\x00\x00\x00\xff\xff\xff\x2c\x00\x00\x00\x00\x01\x00\x01\x00\x00\x02\x02\x44\x01\x00\x3b"
BMP = struct.pack("<2sIIIIiiHHIIiiII", b"BM", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\0" * 4
JPEG = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08\x00\x01\x00\x01\x01\x01\x11\x00\xff\xda\x00\x08\x01\x01\x00\x00\x3f\x00\x12\xff\x00\x34\xff\xd9"
FORMS = {"image/png": png(), "image/gif": GIF, "image/bmp": BMP, "image/jpeg": JPEG, "audio/wav": media.to_wav(b"abcd")}


@pytest.mark.parametrize("kind", FORMS)
def test_formats(kind):
    value = FORMS[kind]
    assert media.sniff(value) == [(kind, 0, len(value))]
    assert (kind, 3, len(value)) in media.sniff(b"xyz" + value + b"tail")
    assert media.sniff(value[:-1]) == [] and media.sniff(value[:5]) == []


def test_false_signatures_and_nesting():
    assert media.sniff(b"BM RIFF GIF89a \x89PNG\r\n\x1a\n \xff\xd8\xff" * 5) == [] and media.sniff(None) == [] == media.sniff(b"")
    inner = png()
    outer = media.to_wav(b"ab" + inner)
    assert media.sniff(outer) == [("audio/wav", 0, len(outer)), ("image/png", 46, len(inner))]
    broken = bytearray(png())
    broken[-6] ^= 1
    assert media.sniff(bytes(broken)) == []


def test_identify_and_carve(spark):
    rows = [(1, bytearray(b"junk" + png()), "text/plain"), (2, bytearray(GIF), "image/png"), (3, None, None), (4, bytearray(b""), "x")]
    got = media.identify(spark.createDataFrame(rows, "id int, media binary, carved string"))
    out = {r.id: r for r in got.select("id", "detected_type", "_carved", F.transform("_carved", lambda c: media.cut(F.col("media"), c)).alias("cuts")).collect()}
    assert out[1].detected_type is None and bytes(out[1].cuts[0]) == png() and out[2].detected_type == "image/gif" and out[3].cuts == [] == out[4].cuts


def test_round_trip(docs, odd, empty):
    for df in (docs, odd):
        want = sorted((r.text or "").encode() for r in df.collect())
        pad = lambda b: b + b"\0" * (-len(b) % 64 if b else 64)
        got = sorted((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) for r in media.round_trip(df).collect())
        assert got == sorted((len(b), len(pad(b)), hashlib.sha256(pad(b)).hexdigest(), zlib.crc32(pad(b)[-64:]), len(pad(b)) + 44, hashlib.sha256(media.to_wav(pad(b))).hexdigest()) for b in want)
    assert media.round_trip(empty).collect() == []
    by = {}
    for r in media.round_trip(odd).collect():
        by.setdefault(r.payload_sha256, set()).add((r.feature, r.media_sha256))
    assert all(len(v) == 1 for v in by.values())


# pipeline


def test_pipeline(spark, sf, docs):
    last = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, last, sf)
        assert out.columns == docs.columns
        rows, before = out.collect(), {r.doc_id: r for r in last.collect()}
        assert 0.7 * len(before) <= len(rows) <= len(before) and all(before[r.doc_id] == r for r in rows), name
        if name == "near_dedup":
            fps = [slow_fingerprint(r.text) for r in before.values()]
            comps = slow_components(fps, list(before))
            assert {r.doc_id for r in rows} == {i for i, c in zip(before, comps) if i == c}
        if name == "mix":
            assert len(rows) == len(before)
        last = spark.createDataFrame(rows, docs.schema)
    pieces = corpus_pipeline.STAGES[-1][1](spark, last, sf).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in last.collect()}
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == {r.doc_id for r in pieces}
