"""Exact token ids of whole texts, each distinct piece of text encoded once per worker.

A public tokenizer file decides how a text may be cut so that the ids of the cuts,
put together, are the ids of the whole text:

* ``"words"``: white space separates and is dropped (``word_bpe_49k``), so a text is
  cut at every run of ASCII white space;
* ``"spaced"``: a space belongs to the word behind it (``byte_bpe_50k``), so a text is
  cut before every single space that stands between two other characters.

The operators take the file as it is: the name of one of its special tokens in a text gets
that token's id, as by ``Tokenizer.encode(text, add_special_tokens=False)``. No such name
holds white space, so none is cut.

Ids are kept as little-endian integers of two bytes (four for vocabularies over
65 536 entries).
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain, islice, pairwise

import numpy as np
import regex

from .common import Codes, Ragged, byte_alphabet, worker_value

_BEFORE_WORD = re.compile(r"(?<=\S) (?=\S)")
# Marks the first piece of a text, which has no space before it. No other piece starts with a
# space: ``cut`` leaves none in the pieces, and in ``careful_cut`` they start behind one.
_HEAD = " "


def cut(text: str, style: str) -> list:
    """The pieces of ``text`` that can be encoded one by one, if none of them is ``odd``."""
    if style == "words":
        return text.encode().split()
    pieces = text.split(" ")
    pieces[0] = _HEAD + pieces[0]
    return pieces


def odd(piece, style: str) -> bool:
    """Does a space stand beside other white space here, so that the text must be cut with care?"""
    return style == "spaced" and (not piece or piece[-1].isspace() or (piece[0] != _HEAD and piece[0].isspace()))


def careful_cut(text: str) -> list[str]:
    """As ``cut``, but spaces beside other white space stay inside the pieces."""
    first, *others = _BEFORE_WORD.split(text)
    return [_HEAD + first, *others]


# Characters whose classes, cases and composed forms are the same in every Unicode version
# that a tokenizer may have been built with, and white space that all regular expressions know.
_COMMON = re.compile("[\n !-~\u00a1-\u024f]*").fullmatch
_WORD = re.compile(" ?[A-Za-z]+").fullmatch  # always one pre-token
# Fixed value: how byte-level tokenizers cut a text when their file names no pattern.
_BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SHOWN = byte_alphabet()


def _shown(word: str) -> str:
    """A pre-token as the model reads it: a printable character for each of its bytes."""
    if word.isascii() and word.isprintable():
        return word.replace(" ", _SHOWN[32])
    return "".join([_SHOWN[b] for b in word.encode()])


def _pre_tokens(path: str):
    """(lower-cased first?, finder of a text's pre-tokens), by the tokenizer file; no finder for files of another shape."""
    with open(path, encoding="utf-8") as file:
        config = json.load(file)
    normalizer, cutter = config["normalizer"], config["pre_tokenizer"] or {}
    steps = [s["type"] for s in (normalizer or {}).get("normalizers", [normalizer] if normalizer else [])]
    cuts = cutter.get("pretokenizers", [cutter])
    kinds = [c.get("type") for c in cuts]
    if not set(steps) <= {"NFC", "Replace", "Lowercase"} or cuts[-1].get("add_prefix_space"):
        return False, None
    if kinds == ["ByteLevel"] and not steps and cuts[0]["use_regex"]:
        return False, regex.compile(_BYTE_LEVEL).findall
    if kinds == ["Split", "ByteLevel"] and cuts[0]["behavior"] == "Removed" and cuts[0]["invert"] and not cuts[1]["use_regex"]:
        return "Lowercase" in steps, regex.compile(cuts[0]["pattern"]["Regex"]).findall
    return False, None


def id_type(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


class PieceEncoder:
    """Ids of texts by one tokenizer file; keeps the ids of at most ``cache`` pieces.

    ``spell_names``: names of special tokens in a text are spelt out like other text.
    """

    def __init__(self, path: str, style: str, cache: int = 900_000, spell_names: bool = True, cache_bytes: int = 48 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = spell_names
        self.style = style
        self.dtype = id_type(self.tokenizer.get_vocab_size())
        names = [] if spell_names else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.names = re.compile("|".join(map(re.escape, names))) if names else None
        self.model = self.tokenizer.model
        self.lower, self.find = _pre_tokens(path)
        self.cache, self.cache_bytes = cache, cache_bytes
        self.reset()

    def reset(self) -> None:
        self.codes, self.ids, self.held = Codes(), Ragged(self.dtype), 0

    @classmethod
    def of_worker(cls, path: str, style: str) -> PieceEncoder:
        """The encoder of the operators, by the untouched tokenizer file."""
        return worker_value(("encoder", path, style), lambda: cls(path, style, spell_names=False))

    def _string(self, piece) -> str:
        if self.style == "words":
            return piece.decode()
        return piece[1:] if piece[:1] == _HEAD else " " + piece

    def _learn(self, pieces: list) -> None:
        """Encode new pieces and add their ids in order.

        Pieces of common characters are cut into pre-tokens here and each distinct pre-token
        goes through the library's model once; all others go through its whole call.
        """
        words, parts, sizes, others = Codes(), [], [], []
        for piece in pieces:
            text = self._string(piece)
            if self.find and _WORD(text):
                parts.append(words[text.lower() if self.lower else text])
                sizes.append(1)
            elif self.find and _COMMON(text) and not (self.names and "<" in text and self.names.search(text)):
                found = self.find(text.lower() if self.lower else text)
                parts += map(words.__getitem__, found)
                sizes.append(len(found))
            else:
                others.append(text)
                parts.append(-len(others))
                sizes.append(1)
        tokenize = self.model.tokenize
        lists = [[t.id for t in tokenize(_shown(w))] for w in words]
        if others:
            lists += [e.ids for e in self.tokenizer.encode_batch_fast(others, add_special_tokens=False)]
        table = Ragged(self.dtype)
        table.extend(np.array(list(chain.from_iterable(lists)), self.dtype), np.array([len(x) for x in lists], np.int64))
        parts = np.array(parts, np.int64)
        flat, lengths = table.take(np.where(parts < 0, len(words) - 1 - parts, parts))
        ends, edges = np.append(0, np.cumsum(lengths)), np.append(0, np.cumsum(sizes))
        self.ids.extend(flat, ends[edges[1:]] - ends[edges[:-1]])

    def _code(self, text: str) -> np.ndarray:
        """The text's pieces as codes."""
        known = len(self.codes)
        pieces = cut(text, self.style)
        codes = list(map(self.codes.__getitem__, pieces))
        if self.style == "spaced" and len(self.codes) > known:
            new = list(islice(reversed(self.codes), len(self.codes) - known))
            if any(odd(p, self.style) for p in new):  # odd pieces are never kept
                for p in new:
                    del self.codes[p]
                codes = list(map(self.codes.__getitem__, careful_cut(text)))
        return np.array(codes, np.int64)

    def _encode(self, texts: list[str]) -> Iterator[bytes]:
        coded = [self._code(text) for text in texts]
        if len(self.codes) > len(self.ids):
            new = list(islice(reversed(self.codes), len(self.codes) - len(self.ids)))[::-1]
            self._learn(new)
            self.held += sum(map(len, new))
        flat, lengths = self.ids.take(np.concatenate(coded))
        ends = np.append(0, np.cumsum(lengths))[np.append(0, np.cumsum([len(c) for c in coded]))].tolist()
        for a, b in pairwise(ends):
            yield flat[a:b].tobytes()
        if len(self.codes) > self.cache or self.held > self.cache_bytes:
            self.reset()

    def encode_all(self, texts: Iterable[str], step: int = 2 << 20) -> Iterator[bytes]:
        """The ids of each text as bytes; new pieces are encoded for about ``step`` characters at a time."""
        some, size = [], 0
        for text in texts:
            some.append(text)
            size += len(text)
            if size >= step or len(some) >= 4096:
                yield from self._encode(some)
                some, size = [], 0
        if some:
            yield from self._encode(some)
