"""BPE encoding and decoding with a pair occurrence index (operator 13).

``encode`` gives the ids that the tokenizers library gives for a BPE file whose
pre-tokenizer drops white space; ``decode`` gives the library's text for ids.

A partition's documents are taken in blocks. A text is cut at ASCII white space; each new
chunk is normalised and cut into pre-tokens, and the block's new pre-tokens, each once, are
laid out as one array of symbols. The index maps every mergeable pair to all its positions
in that array. Active ranks (pairs that occur) are taken in ascending order from a heap;
a rank's merge is applied at all its positions at once (of positions that overlap, as in
"aaa", the left one), and the pairs that arise beside the merged symbols are added to the
lists of their ranks. A position whose symbols have changed since is stale and skipped.
Within one pre-token this is the order of the usual algorithm: least rank first, leftmost
first. Chunks keep their ids for the blocks that follow; the store is emptied when it
outgrows its bound, so memory depends on the block and not on the partition.

Names of special tokens in a text get the token's id, as by the library's plain call.
Printable ASCII chunks are cut here by the file's own pattern; all others by the library's
normaliser and pre-tokenizer objects.

Edge cases: a null or empty text has no ids and decodes to the empty text; ids that the file
does not know are left out by ``decode``, null ids decode to null; repeated rows and null
doc_ids are encoded row by row; an empty table gives an empty result; other columns are
ignored by ``encode`` and kept by ``decode``.
"""

from __future__ import annotations

import heapq
import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Codes, Ragged, byte_alphabet, worker_value


class Vocabulary:
    """Symbols and merges of a BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            self.config = json.load(file)
        model = self.config.pop("model")
        plain = {"dropout": (None, 0), "continuing_subword_prefix": (None, ""), "byte_fallback": (None, False), "ignore_merges": (None, False)}
        if model["type"] != "BPE" or any(model.get(k) not in allowed for k, allowed in plain.items()):
            raise ValueError("not a plain BPE file")
        self.special = {t["content"]: t["id"] for t in self.config["added_tokens"]}
        self.ids = {**model["vocab"], **self.special}
        self.size = max(self.ids.values()) + 1
        suffix = model["end_of_word_suffix"] or ""
        find = model["vocab"].get
        # Symbol of a byte inside a pre-token and at its end; -1 where the file has none.
        self.inner, self.last = (np.array([find(c + s, -1) for c in byte_alphabet()], np.int32) for s in ("", suffix))
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right, made = (np.array([model["vocab"][t] for t in ts], np.int64) for ts in zip(*((a, b, a + b) for a, b in merges)))
        self.left, self.right, self.made = left.astype(np.int32), right.astype(np.int32), made.astype(np.int32)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        first = np.flatnonzero(np.diff(keys[order], prepend=-1))  # of a pair listed twice the first rank holds
        self._keys, self._ranks = keys[order][first], order[first]

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols; -1 for pairs that never merge."""
        keys = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
        return np.where((self._keys[at] == keys) & (a >= 0) & (b >= 0), self._ranks[at], -1)

    # --- the index ---------------------------------------------------------------------

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pre-tokens (their bytes), one after the other, and the number of each."""
        sizes = np.array([len(w) for w in words], np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(sizes)
        symbols = self.inner[raw]
        symbols[ends - 1] = self.last[raw[ends - 1]]
        owner = np.repeat(np.arange(len(words)), sizes)
        if (symbols < 0).any():  # bytes without a symbol leave no trace
            owner, symbols = owner[symbols >= 0], symbols[symbols >= 0]
        n = len(symbols)
        symbols = np.append(symbols, np.int32(-1))  # the place behind the last word: no symbol
        new_word = np.diff(owner, prepend=-1, append=-1) != 0
        following, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        following[:-1][new_word[1:]] = before[:-1][new_word[:-1]] = following[-1] = before[-1] = n
        self._apply(symbols, following, before, n)
        alive = symbols[:n] >= 0
        return symbols[:n][alive], np.bincount(owner[alive], minlength=len(words))

    def _apply(self, symbols: np.ndarray, following: np.ndarray, before: np.ndarray, n: int) -> None:
        lists: dict[int, list[np.ndarray]] = {}  # rank -> positions of its pair

        def enter(at: np.ndarray) -> None:
            ranks = self.ranks(symbols[at], symbols[following[at]])
            at, ranks = at[ranks >= 0], ranks[ranks >= 0]
            if not len(at):
                return
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for rank, some in zip(ranks[np.append(0, cuts)].tolist(), np.split(at, cuts) if len(cuts) else [at], strict=True):
                if rank in lists:
                    lists[rank].append(some)
                else:
                    lists[rank] = [some]
                    heapq.heappush(active, rank)

        active: list[int] = []
        for a in range(0, n, 1 << 18):
            enter(np.arange(a, min(n, a + (1 << 18)), dtype=np.int32))
        while active:
            rank = heapq.heappop(active)
            found = lists.pop(rank)
            at = found[0] if len(found) == 1 else np.sort(np.concatenate(found))
            a, b, made = self.left[rank], self.right[rank], self.made[rank]
            second = following[at]
            fresh = (symbols[at] == a) & (symbols[second] == b)
            if not fresh.all():
                at, second = at[fresh], second[fresh]
                if not len(at):
                    continue
            if a == b and len(at) > 1:  # of a run of overlapping pairs every other one
                place = np.arange(len(at))
                starts = np.append(True, at[1:] != second[:-1])
                at = at[(place - np.maximum.accumulate(np.where(starts, place, 0))) % 2 == 0]
                second = following[at]
            after = following[second]
            symbols[at] = made
            symbols[second] = -1
            following[at] = after
            before[after] = at
            beside = before[at]
            beside = beside[beside < n]
            enter(np.unique(np.concatenate((beside, at))) if len(at) + len(beside) > 1 else at)


class Encoder:
    """Ids of whole texts by blocks; keeps the ids of at most ``cache`` chunks between them."""

    def __init__(self, path: str, cache: int = 250_000, cache_bytes: int = 16 << 20):
        from tokenizers import Tokenizer

        self.vocabulary = Vocabulary(path)
        self.library = Tokenizer.from_file(path)
        self.cache, self.cache_bytes = cache, cache_bytes
        normalizer, cutter = self.vocabulary.config["normalizer"], self.vocabulary.config["pre_tokenizer"]
        steps = [s["type"] for s in (normalizer or {}).get("normalizers", [normalizer] if normalizer else [])]
        cuts = (cutter or {}).get("pretokenizers", [])
        if not set(steps) <= {"NFC", "Replace", "Lowercase"} or [c["type"] for c in cuts] != ["Split", "ByteLevel"]:
            raise ValueError("white space must be dropped by a splitting pattern")
        if cuts[0]["behavior"] != "Removed" or not cuts[0]["invert"] or cuts[1]["add_prefix_space"] or cuts[1]["use_regex"]:
            raise ValueError("white space must be dropped by a splitting pattern")
        self.lower = "Lowercase" in steps
        self.pattern = regex.compile(cuts[0]["pattern"]["Regex"])
        self.names = re.compile("(" + "|".join(map(re.escape, self.vocabulary.special)) + ")") if self.vocabulary.special else None
        self.byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        self.reset()

    def reset(self) -> None:
        self.codes, self.ids, self.held = Codes(), Ragged(np.int32), 0

    def pre_tokens(self, chunk: str) -> list[bytes]:
        if chunk.isascii() and chunk.isprintable():
            return [w.encode() for w in self.pattern.findall(chunk.lower() if self.lower else chunk)]
        if self.library.normalizer:
            chunk = self.library.normalizer.normalize_str(chunk)
        return [bytes(map(self.byte_of.__getitem__, w)) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(chunk)]

    def _learn(self, chunks: list[bytes]) -> None:
        """Ids of new chunks, through the index over their distinct pre-tokens."""
        words, parts, sizes = Codes(), [], []
        for chunk in chunks:
            text, known = chunk.decode(), len(parts)
            pieces = self.names.split(text) if self.names and "<" in text else [text]
            for k, piece in enumerate(pieces):
                if k % 2:
                    parts.append(-1 - self.vocabulary.special[piece])  # a special token by its name
                elif piece:
                    parts += [words[w] for w in self.pre_tokens(piece)]
            sizes.append(len(parts) - known)
        table = Ragged(np.int32)
        if words:
            table.extend(*self.vocabulary.encode_words(list(words)))
        parts = np.array(parts, np.int64)
        special = np.unique(parts[parts < 0])  # they follow the words in the table
        table.extend((-1 - special).astype(np.int32), np.ones(len(special), np.int64))
        parts = np.where(parts < 0, len(words) + np.searchsorted(special, parts), parts)
        flat, lengths = table.take(parts)
        ends = np.append(0, np.cumsum(lengths))
        edges = np.append(0, np.cumsum(sizes))
        self.ids.extend(flat, ends[edges[1:]] - ends[edges[:-1]])

    def encode_block(self, coded: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the block's texts, given as chunk codes, and the number of each text's ids."""
        new = list(self.codes)[len(self.ids):]
        if new:
            self._learn(new)
            self.held += sum(map(len, new))
        sizes = [len(c) for c in coded]
        flat, lengths = self.ids.take(np.concatenate(coded) if coded else np.empty(0, np.int64))
        ends, edges = np.append(0, np.cumsum(lengths)), np.append(0, np.cumsum(sizes))
        if len(self.codes) > self.cache or self.held > self.cache_bytes:
            self.reset()
        return flat, ends[edges[1:]] - ends[edges[:-1]]

    def code(self, text: str) -> np.ndarray:
        """The text's chunks as codes."""
        chunks = text.encode().split()
        return np.fromiter(map(self.codes.__getitem__, chunks), np.int64, len(chunks))


def encode(docs: DataFrame, tokenizer: str, decoded: bool = False, block_bytes: int = 20 << 20, block_chunks: int = 250_000) -> DataFrame:
    """doc_id and ids (array of int) of every row of ``docs``; with ``decoded`` also the text that the ids decode to.

    A block ends at ``block_bytes`` of text or ``block_chunks`` new chunks.
    """
    names = ["doc_id", "ids", "decoded"][: 3 if decoded else 2]

    def make(batches):
        encoder, decoder = worker_value(("pair-index", tokenizer), lambda: (Encoder(tokenizer), Decoder(tokenizer)))

        def flush(rows, coded):
            flat, lengths = encoder.encode_block(coded)
            offsets = np.append(0, np.cumsum(lengths))
            at = 0
            while at < len(rows):  # slices of some 250 000 ids
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + (1 << 18), "right")) - 1)
                ids = pa.ListArray.from_arrays(
                    pa.array((offsets[at : to + 1] - offsets[at]).astype(np.int32)), pa.array(flat[offsets[at] : offsets[to]], pa.int32())
                )
                columns = [pa.array(rows[at:to], pa.int64()), ids, *([decoder.decode(ids)] if decoded else [])]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                at = to

        rows, coded, held, known = [], [], 0, len(encoder.codes)
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py() or ""
                rows.append(doc_id.as_py())
                coded.append(encoder.code(text))
                held += len(text)
                if held >= block_bytes or len(encoder.codes) - known >= block_chunks:
                    yield from flush(rows, coded)
                    rows, coded, held, known = [], [], 0, len(encoder.codes)
        if rows:
            yield from flush(rows, coded)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        make, "doc_id long, ids array<int>" + (", decoded string" if decoded else "")
    )


class Decoder:
    """Text of ids: a file without a decoder has its tokens joined by spaces, a byte-level one their bytes."""

    def __init__(self, path: str):
        vocabulary = Vocabulary(path)
        kind = (vocabulary.config.get("decoder") or {"type": None})["type"]
        if kind not in (None, "ByteLevel"):
            raise ValueError(f"unknown decoder {kind}")
        byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        tokens: list[bytes | None] = [None] * vocabulary.size
        for token, i in vocabulary.ids.items():
            plain = kind is None or any(c not in byte_of for c in token)
            tokens[i] = token.encode() if plain else bytes(map(byte_of.__getitem__, token))
        self.known = np.array([t is not None for t in tokens])
        between = b" " if kind is None else b""
        # Every token twice: as the first of a text and as a later one.
        self.tokens = pa.array([t or b"" for t in tokens] + [between + (t or b"") for t in tokens], pa.large_binary())

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """Texts of lists of ids, a bounded number of ids at a time."""
        return pa.concat_arrays([self._some(ids.slice(at, 64)) for at in range(0, len(ids), 64)] or [pa.array([], pa.string())])

    def _some(self, ids: pa.ListArray) -> pa.Array:
        size = len(self.known)
        lengths = np.diff(ids.offsets.to_numpy())
        flat = ids.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        lengths = np.where(ids.is_null().to_numpy(zero_copy_only=False), 0, lengths)
        inside = (flat >= 0) & (flat < size)
        inside[inside] = self.known[flat[inside]]
        owner = np.repeat(np.arange(len(ids)), lengths)
        flat, owner = flat[inside], owner[inside]
        later = np.diff(owner, prepend=-1) == 0
        taken = self.tokens.take(pa.array(flat + size * later))
        ends, data = (np.frombuffer(taken.buffers()[1], np.int64), taken.buffers()[2].to_pybytes()) if len(taken) else (np.zeros(1, np.int64), b"")
        cuts = ends[np.searchsorted(owner, np.arange(len(ids) + 1))]
        texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.array(texts, pa.string(), mask=ids.is_null().to_numpy(zero_copy_only=False))


def decode(ids: Column, tokenizer: str) -> Column:
    """The text of a column of id lists, special tokens included."""

    @F.arrow_udf("string")
    def text_of(column: pa.Array) -> pa.Array:
        decoder = worker_value(("decoder", tokenizer), lambda: Decoder(tokenizer))
        return decoder.decode(column)

    return text_of(ids)
