"""Subword ids, token blocks and packing against the tokenizer library and brute force."""

import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import common, packing, subword, token_file

IDS = subword.WordIds(subword.default_path())


def library(text):
    return [*IDS.tokenizer.encode(text or "", add_special_tokens=False).ids, subword.END_ID]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abcAB .,!'\n\t\x1c1é́ßÿİK日_-<|>")), max_size=40))
def test_ids_are_the_librarys(text):
    assert np.frombuffer(IDS.encode(text), "<u4").tolist() == library(text)


def test_special_strings():
    for t in ("x<|endoftext|>y", "<|startoftext|> a", "it's I'LL", "...,,", "a.b,c"):
        assert np.frombuffer(IDS.encode(t), "<u4").tolist() == library(t)


def test_memo_may_overflow(monkeypatch):
    monkeypatch.setattr(subword, "MEMO_WORDS", 3)
    w = subword.WordIds(subword.default_path())
    for t in ("one two three four five", "six seven one two", "four five. six"):
        assert np.frombuffer(w.encode(t), "<u4").tolist() == library(t)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=30) | st.lists(st.integers(0, 70_000), max_size=30))
def test_value_coding_round_trip(values):
    v = np.array(values, "<u4")
    control, data = token_file.encode_values(v)
    assert len(control) == -(-len(v) // 4) and len(data) == sum(max(1, (int(x).bit_length() + 7) // 8) for x in v)
    assert token_file.decode_values(control, data, len(v)).tolist() == values


def test_blocks_keep_ids_and_notice_damage():
    block = token_file.encode_block([None, 5, -3], [2, 0, 1], np.array([7, 300, 70000], "<u4"))
    ids, counts, ranks = token_file.decode_block(block)
    assert ids == [None, 5, -3] and counts.tolist() == [2, 0, 1] and ranks.tolist() == [7, 300, 70000]
    with pytest.raises(ValueError):
        token_file.decode_block(block[:-1] + b"\xff\xff")


def expected_starts(rows):
    at, out = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = library(t)
        out.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    return out


def test_token_file_on_a_whole_table(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted(tuple(r) for r in token_file.round_trip(docs).collect())
    assert got == sorted(expected_starts(rows))


def test_small_blocks(docs):
    folder = common.new_folder(docs.sparkSession, "tokens")
    token_file.write_blocks(docs.limit(50), folder, block_ids=500)
    assert docs.sparkSession.read.parquet(f"{folder}/blocks").count() > 20
    assert sorted(tuple(r) for r in token_file.read_blocks(docs.sparkSession, folder).collect()) == sorted(expected_starts([(r.doc_id, r.text) for r in docs.limit(50).collect()]))


def test_another_session_reads_the_folder(docs):
    """The folder is all that a reader needs: ranks and blocks by their definition, and by a new session."""
    import pyarrow.parquet as pq

    folder = common.new_folder(docs.sparkSession, "tokens")
    token_file.write_blocks(docs, folder)
    ranks = pq.read_table(f"{folder}/ranks").to_pydict()
    by_rank = np.array([i for _, i in sorted(zip(ranks["rank"], ranks["id"]))])
    rows = {r.doc_id: r.text for r in docs.collect()}
    count = Counter(i for t in rows.values() for i in library(t))
    assert by_rank.tolist() == sorted(count, key=lambda i: (-count[i], i))
    seen = {}
    for block in pq.read_table(f"{folder}/blocks").column("block").to_pylist():
        ids, sizes, values = token_file.decode_block(block)
        for doc, part in zip(ids, np.split(by_rank[values], np.cumsum(sizes)[:-1])):
            seen[doc] = part.tolist()
    assert seen == {i: list(library(t)) for i, t in rows.items()}
    other = docs.sparkSession.newSession()
    assert sorted(tuple(r) for r in token_file.read_blocks(other, folder).collect()) == sorted(expected_starts(list(rows.items())))


def test_ids_of_many_words(monkeypatch):
    text = " ".join(f"wort{i}" for i in range(3000)) + " wort1 wort2"
    want = library(text)
    monkeypatch.setattr(subword, "MEMO_WORDS", 20)
    monkeypatch.setattr(subword, "WORDS_AT_ONCE", 7)
    few = subword.WordIds(subword.default_path())
    assert np.frombuffer(few.encode(text), "<u4").tolist() == list(want) and len(few) <= 200


def test_ids_must_be_numbers(spark):
    with pytest.raises(TypeError, match="integer"):
        token_file.round_trip(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_token_file_odd_rows(odd, empty):
    got = token_file.round_trip(odd).collect()
    assert sorted((r.n_tokens, r.ids_crc32) for r in got) == sorted((len(library(r.text)), crc(library(r.text))) for r in odd.collect())
    spans = sorted((r.start, r.start + r.n_tokens) for r in got)
    assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [None, None, 1, 1, 2, 3, 4, 5, 6, 7, 8]
    assert token_file.round_trip(empty).collect() == []


def check_packing(rows, texts):
    """Every id in exactly one piece; windows gapless from 0 and at most full."""
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for i, t in texts.items():
        ids, pieces = library(t), sorted(by_doc[i], key=lambda r: r.start)
        assert pieces[0].start == 0 and all(a.start + a.length == b.start for a, b in zip(pieces, pieces[1:]))
        assert pieces[-1].start + pieces[-1].length == len(ids) == pieces[0].doc_tokens
        assert all(p.ids_crc32 == crc(ids[p.start : p.start + p.length]) for p in pieces)
    windows = {}
    for r in rows:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for w in windows.values():
        at = 0
        for offset, length in sorted(w):
            assert offset == at and length > 0
            at += length
        assert at <= packing.WINDOW
    used = sum(r.length for r in rows)
    return used / (len(windows) * packing.WINDOW)


def test_packing_a_whole_table(docs):
    rows = packing.pack(docs).collect()
    assert check_packing(rows, {r.doc_id: r.text for r in docs.collect()}) > 0.9


def test_packing_many_partitions_and_rounds(docs):
    rows = packing.pack(docs.repartition(13, "doc_id"), open_windows=3, fan_in=2).collect()
    check_packing(rows, {r.doc_id: r.text for r in docs.collect()})


def test_packing_odd_rows(odd, empty):
    rows = packing.pack(odd).collect()
    assert sum(r.length for r in rows) == sum(len(library(r.text)) for r in odd.collect())
    assert packing.pack(empty).collect() == []


def test_open_windows_follow_the_rule():
    count = iter(range(100))
    w = packing.OpenWindows(2, 10, lambda: next(count))
    assert [w.place(n) for n in (6, 7, 3, 8, 2)] == [(0, 0), (1, 0), (1, 7), (2, 0), (2, 8)]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abcAB .,!'\n\t\x1c\x0b1é́ßÿİΣK日_-<|> \xa0")), max_size=40))
def test_ids_are_those_of_the_words(text):
    """What the language model relies on: words split at ASCII white space, in ASCII lower case."""
    words = text.encode().lower().split()
    ids = [i for w in words for i in np.frombuffer(IDS.of_word(w.decode()), "<u4").tolist()]
    assert [*ids, subword.END_ID] == library(text)
