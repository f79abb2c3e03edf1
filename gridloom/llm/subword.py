"""Subword ids of whole texts by a public tokenizer, cached by white-space-free word.

The vocabulary's normaliser and splitter never look across white space, so a text's ids are
the ids of its words in order. Words repeat; each worker keeps a bounded memo.
Plain Latin words go straight to the library's merge model, all others through
the library's whole pipeline. Prose of Latin letters, single commas and full stops is cut at those
marks too, as the splitter does, which makes far fewer different words. Texts with characters U+001C to U+001F, which Python
and the library don't both count as space, go to the library whole.
"""

from __future__ import annotations

import re

import numpy as np

LATIN = re.compile(r"([a-zß-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)").fullmatch
#: characters of prose that can be cut at single commas and full stops
PROSE = frozenset("abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ., \n")
ODD_SPACE = re.compile("[\x1c-\x1f]")
END_ID = 1
MEMO_WORDS = 600_000
WORDS_AT_ONCE = 100_000  # words by which the memo may outgrow that

_loaded: dict[str, "WordIds"] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_alphabet() -> list[str]:
    """The printable stand-in for each byte: itself where visible, else 256, 257, ... in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordIds(dict):
    """word -> its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.alphabet = byte_alphabet()
        self.four = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]

    def piece(self, s: str) -> bytes:
        """Ids of one lower-case run of letters or of punctuation, as the merge model has them."""
        got = self.get(s)
        if got is None:
            name = s if s.isascii() else "".join([self.alphabet[b] for b in s.encode()])
            four = self.four
            self[s] = got = b"".join([four[t.id] for t in self.model.tokenize(name)])
        return got

    def whole(self, s: str) -> bytes:
        return np.array(self.tokenizer.encode(s, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        low = word.lower()
        if low.isascii() and low.isalpha():
            got = self.piece(low)
        elif m := LATIN(low):
            letters, marks = m.groups()
            got = self.piece(letters) + self.piece(marks) if marks else self.piece(letters)
        else:
            got = self.whole(word)
        self[word] = got
        return got

    def of_word(self, word: str) -> bytes:
        """Ids of a text without ASCII white space, whatever else is in it."""
        if len(self) > MEMO_WORDS:
            self.clear()
        return self.whole(word) if ODD_SPACE.search(word) else self[word]

    def encode(self, text: str | None) -> bytes:
        """Ids of ``text`` (null: none) with the end id."""
        if not text:
            return END_BYTES
        if ODD_SPACE.search(text):
            return self.whole(text) + END_BYTES
        low = text.lower()
        prose = PROSE.issuperset(low) and not (".." in low or ",," in low or ".," in low or ",." in low)
        words = low.replace(".", " . ").replace(",", " , ").split() if prose else text.split()
        if len(self) > MEMO_WORDS:
            self.clear()
        if len(words) <= WORDS_AT_ONCE:
            return b"".join(map(self.__getitem__, words)) + END_BYTES
        out = []
        for at in range(0, len(words), WORDS_AT_ONCE):
            out += map(self.__getitem__, words[at : at + WORDS_AT_ONCE])
            if len(self) > MEMO_WORDS:
                self.clear()
        return b"".join(out) + END_BYTES


END_BYTES = END_ID.to_bytes(4, "little")


def word_ids(path: str) -> WordIds:
    """The worker's memo for ``path``; kept between tasks."""
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]
