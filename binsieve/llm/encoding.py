"""Token ids of whole texts, word by word, with a bounded cache of words.

``WordEncoder`` splits texts with ``words.split`` and asks a function for the ids of each word not
seen before; ids are kept as packed little-endian 32-bit integers, so that a text's ids are one join
of bytes. Special-token strings inside texts become their ids, as the libraries do by default.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from array import array
from collections.abc import Callable

import numpy as np

from binsieve.llm import words
from binsieve.llm.common import steps

#: Words kept in a worker's cache, and the longest word kept.
CACHE_WORDS, CACHE_CHARS = 1_000_000, 48


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    held = array("I", ids)
    if sys.byteorder == "big":
        held.byteswap()
    return held.tobytes()


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Cache(dict):
    def __init__(self, ask: Callable[[str], bytes]):
        self.ask = ask

    def __missing__(self, word: str) -> bytes:
        ids = self.ask(word)
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = ids
        return ids


class WordEncoder:
    """Texts to packed ids; ``ask`` gives the packed ids of one word."""

    def __init__(self, ask, table: np.ndarray, pattern: str, special: dict[str, int], prepare=None):
        self.cache, self.table, self.pattern, self.special, self.prepare = _Cache(ask), table, pattern, special, prepare

    def _parts(self, text: str) -> list:
        """Plain stretches and special ids of a text that may hold special strings."""
        found: list = [text]
        for name, number in self.special.items():
            split = []
            for part in found:
                if isinstance(part, str) and name in part:
                    for i, plain in enumerate(part.split(name)):
                        split += [number] * (i > 0) + [plain]
                else:
                    split.append(part)
            found = split
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for a, b in steps(texts):
            some = texts[a:b]
            if any(s in t for t in some for s in self.special):
                for text in some:
                    out.append(b"".join(x.to_bytes(4, "little") if isinstance(x, int) else self._plain([x])[0] for x in self._parts(text)))
            else:
                out += self._plain(some)
        return out

    def _plain(self, texts: list[str]) -> list[bytes]:
        if self.prepare:
            texts = [self.prepare(t) for t in texts]
        whole, starts, stops, first = words.split(texts, self.table, self.pattern)
        cache = self.cache
        ids = [cache[whole[a:b]] for a, b in zip(starts, stops)]
        first = first.tolist()
        return [b"".join(ids[a:b]) for a, b in zip(first, first[1:])]


def _library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def special_tokens(path: str) -> dict[str, int]:
    """Ids of a file's added tokens, which are looked for in the text as it is, before all else."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    for x in file["added_tokens"]:
        if x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"] and file["normalizer"]:
            raise ValueError(f"added token {x['content']!r} is matched in a way that isn't supported")
    # Of two that begin at one place the longer is taken first, as it can hold the other.
    return {x["content"]: x["id"] for x in sorted(file["added_tokens"], key=lambda x: -len(x["content"]))}


def _asker(path: str, end: str = ""):
    model, letters = _library(path).model, byte_letters()

    def ask(word: str) -> bytes:
        shown = "".join(map(letters.__getitem__, word.encode()))
        return packed([t.id for t in model.tokenize(shown)])

    return ask


def lowered(text: str) -> str:
    """NFC and lower case, each code point alone."""
    if not text.isascii():
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        if "Σ" in text:
            text = text.replace("Σ", "σ")
    return text.lower()


_KEPT: dict = {}


def kept(key, make):
    """One object of a kind for the life of a Python worker."""
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def shared_classes(spark):
    """The class table, made once by the driver and sent to the executors (1.1 MB, of fixed size)."""
    return spark.sparkContext.broadcast(kept("classes", words.classes))


def byte_encoder(path: str, table: np.ndarray) -> WordEncoder:
    """Ids as the library gives for a byte-level BPE file."""
    return kept(("byte", path), lambda: WordEncoder(_asker(path), table, "byte", special_tokens(path)))


def word_encoder(path: str, table: np.ndarray) -> WordEncoder:
    """Ids as the library gives for a lower-casing BPE file with word ends."""
    return kept(("word", path), lambda: WordEncoder(_asker(path), table, "word", special_tokens(path), lowered))
