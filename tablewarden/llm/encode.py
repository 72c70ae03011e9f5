"""Token ids of whole texts by the tokenizers library, with a bounded memory of encoded words.

A text of plain Latin letters, digits and signs is cut into pre-tokens here, and those not yet in
memory go straight to the tokenizer's model; many texts at once give each of their different words once. Any other text is cut where a printing character is
followed by a space or line end, which both vocabularies in use cut as well; of its words, those that
are not plain, and any text with an unusual space, take the tokenizer's whole way.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from tokenizers import Tokenizer

from tablewarden.llm.store import lean
from tablewarden.llm.words import starts_of

CACHED_WORDS = 150_000
MISSES_BEFORE_CLEARING = 10 * CACHED_WORDS
MANY_CHARS = 4 << 20  # a longer text is encoded alone

# The pre-token patterns of the two tokenizer files, for Latin-1 letters.
_L = "A-Za-zÀ-ÖØ-öø-ÿ"
_SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
_BYTE_TOKENS = re.compile(rf"{_SHORT}| ?[{_L}]+| ?[0-9]+| ?[^\s{_L}0-9]+|\s+(?!\S)|\s+")
_WORD_TOKENS = re.compile(rf"{_SHORT}|[{_L}]+|[0-9]|[^\s{_L}0-9]+")
_PLAIN = re.compile(rf"[ \n!-~{_L}]*")
_BYTE_WORDS = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
_WORD_WORDS = re.compile(r"[^ \n]+")
_ODD_SPACE = re.compile("[\\t\\x0b-\\x0d\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Words(dict):
    """Ids of words. A full memory takes no more words; it starts anew once too many were missed."""

    def __init__(self, encode):
        self.encode, self.missed = encode, 0

    def __missing__(self, word: str) -> bytes:
        coded = self.encode(word)
        if len(self) < CACHED_WORDS:
            self[word] = coded
        else:
            self.missed += 1
            if self.missed > MISSES_BEFORE_CLEARING:
                self.clear()
                self.missed = 0
        return coded


class TextEncoder:
    """Encodes texts like ``Tokenizer.encode(text, add_special_tokens=False)``.

    Special tokens spelled out in a text get their ids, as in the library; with ``spell_special`` they
    are ordinary text.
    """

    def __init__(self, path: str, spell_special: bool = False):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = spell_special
        form = json.loads(self.tokenizer.to_str())
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() < 1 << 16 else "<u4"
        # How added tokens start, in either case: a text with one of these goes the library's way.
        added = [] if spell_special else [t["content"][:2] for t in form["added_tokens"]]
        self.marks = sorted({m for start in added for m in (start.lower(), start.upper())})
        splitter = form["pre_tokenizer"] or {}
        self.lowers = splitter.get("type") == "Sequence" and form["normalizer"] is not None
        by_bytes = splitter.get("type") == "ByteLevel" and form["normalizer"] is None
        self.known = self.lowers or (by_bytes and not splitter["add_prefix_space"])
        self.words = _WORD_WORDS if self.lowers else _BYTE_WORDS
        self.tokens = _WORD_TOKENS if self.lowers else _BYTE_TOKENS
        self.letters = _byte_letters()
        self.space = self.letters[0x20]
        self.model = self.tokenizer.model
        self.kind = "H" if self.dtype == "<u2" else "I"
        self.ids_of_word = _Words(self._word).__getitem__
        self.ids_of_token = _Words(self._token).__getitem__ if self.lowers else self.ids_of_word

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, self.dtype).tobytes()

    def _token(self, token: str) -> bytes:
        """Ids of one lower-cased token of a plain text."""
        if not token.isascii():
            token = token.encode().decode("latin-1").translate(self.letters)
        return self._ids([token]) if token else b""

    def _ids(self, tokens: list[str]) -> bytes:
        coded = array(self.kind, [t.id for token in tokens for t in self.model.tokenize(token)])
        if sys.byteorder == "big":
            coded.byteswap()
        return coded.tobytes()

    def _word(self, word: str) -> bytes:
        bare = word[1:] if word[0] == " " else word
        if bare.isascii() and bare.isalpha():
            tokens = [bare.lower() if self.lowers else word.replace(" ", self.space)]
        elif _PLAIN.fullmatch(word):
            found = self.tokens.findall(word.lower() if self.lowers else word)
            tokens = [t.encode().decode("latin-1").translate(self.letters) for t in found]
        else:
            return self.whole(word)
        return self._ids(tokens)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian numbers of type ``dtype``."""
        if not text:
            return b""
        if any(mark in text for mark in self.marks):
            return self.whole(text)
        if self.known and _PLAIN.fullmatch(text):
            tokens = self.tokens.findall(text.lower() if self.lowers else text)
            return b"".join(map(self.ids_of_token, tokens))
        if not self.known or (not self.lowers and _ODD_SPACE.search(text)):
            return self.whole(text)
        return b"".join(map(self.ids_of_word, self.words.findall(text)))

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """``encode`` of each text. Where spaces are no part of a token, each different word of the plain
        texts is looked up once."""
        if not self.lowers:
            return [self.encode(text) for text in texts]
        plain = [
            i
            for i, text in enumerate(texts)
            if text and len(text) <= MANY_CHARS and not any(m in text for m in self.marks) and _PLAIN.fullmatch(text)
        ]
        coded = dict(zip(plain, self._of_words([texts[i].lower() for i in plain]), strict=True))
        return [coded[i] if i in coded else self.encode(text) for i, text in enumerate(texts)]

    def _of_words(self, texts: list[str]) -> list[bytes]:
        """Ids of lower-cased plain texts: of each different token once, then of words, then of texts."""
        split = pa.compute.ascii_split_whitespace(pa.array(texts, pa.string()))
        words = split.flatten().dictionary_encode()
        mixed = pa.compute.invert(pa.compute.utf8_is_alpha(words.dictionary))
        apart = pa.compute.replace_substring_regex(words.dictionary.filter(mixed), f"({self.tokens.pattern})", r"\1 ")
        apart = pa.compute.replace_with_mask(words.dictionary, mixed, pa.compute.ascii_trim_whitespace(apart))
        parts = pa.compute.ascii_split_whitespace(apart)
        tokens = parts.flatten().dictionary_encode()
        coded = list(map(self.ids_of_token, tokens.dictionary.to_numpy(zero_copy_only=False).tolist()))
        size = np.fromiter(map(len, coded), np.int64, len(coded)) // np.dtype(self.dtype).itemsize
        ids = np.frombuffer(b"".join(coded), self.dtype)
        offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
        for several, once in ((parts, tokens), (split, words)):
            which = once.indices.to_numpy()
            each = np.diff(offsets)[which]
            ids = ids[starts_of(offsets[which], each)]
            offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(each)])[several.offsets.to_numpy()]
        return [ids[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]

    def forget(self) -> None:
        """Let the words in memory go."""
        self.ids_of_word.__self__.clear()
        self.ids_of_token.__self__.clear()


_ENCODERS: dict[tuple[str, bool], TextEncoder] = {}


def encoder(path: str, spell_special: bool = False) -> TextEncoder:
    """One encoder per worker process and file."""
    key = (path, spell_special)
    if key not in _ENCODERS:
        _ENCODERS[key] = TextEncoder(path, spell_special)
    return _ENCODERS[key]


def encoding(batches: Iterator[pa.RecordBatch], coder: TextEncoder) -> Iterator[pa.RecordBatch]:
    """Pass a task's batches on; words in memory and freed memory do not outlive the task."""
    try:
        yield from lean(batches)
    finally:
        coder.forget()
