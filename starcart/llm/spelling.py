"""Spelling variant grouping by blocked Gram matrices (operator 12).

Words that differ by one inserted, deleted or replaced character are near; a word's form is
its most frequent near word, if that is at least ``ratio`` times as frequent, and following
the forms to the end gives the root of a group of variants.

One edit changes a word's letter counts by a squared distance of at most two, and its length
by at most one. Words are compared in blocks of adjacent lengths (L and L + 1) that agree in
the half which one edit leaves alone: with h = L // 2, two near words have the same first h
characters or the same last L - h ones. Within a block the squared distances of all letter
counts come from one NumPy product (|a|^2 + |b|^2 - 2 a.b); pairs at most two apart are
verified character by character. A pair whose halves both agree is taken in the block of its
beginning only.

Blocks with more than ``tile`` words are cut into tiles by a hash of the word, and every two
tiles meet in a cell of their own, so no task holds more than two tiles of a block. Cells are
read as sorted streams.

Words are counted by whole texts: maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z
lower-cased. With ``every``, the words of a document are damaged by rule before they count:
where it divides the checksum h of "<doc_id>:<run>", the character at h % length goes.

Edge cases: null and empty texts have no words, a null doc_id stands as an empty text in the
checksum, repeated rows count each, an empty table gives an empty result, other columns are
ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import Codes

_RUN = re.compile("[a-zÀ-ÿ]+")  # after lower-casing A-Z
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
DIMENSIONS = 32  # a-z, and the other letters folded into six


def _crc_steps() -> np.ndarray:
    """The checksum's table: what a zero byte makes of the low byte."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ np.where(table & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return table


_STEP = _crc_steps()
_LONGEST = 64  # bytes of a run whose checksum is put together by table


def joined_checksums(prefixes: np.ndarray, owners: np.ndarray, checksums: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """crc32 of prefix + run from their own checksums, for runs of at most ``_LONGEST`` bytes.

    Appending a run of k bytes moves the prefix's checksum through k zero bytes and adds the
    run's own.
    """
    moved = np.empty((_LONGEST + 1, len(prefixes)), np.uint32)
    moved[0] = prefixes
    for k in range(1, _LONGEST + 1):
        moved[k] = _STEP[moved[k - 1] & np.uint32(255)] ^ (moved[k - 1] >> np.uint32(8))
    return moved[np.minimum(sizes, _LONGEST), owners] ^ checksums


def word_counts(docs: DataFrame, every: int | None = None, shortest: int = 5, block_words: int = 3_000_000, block_docs: int = 60_000) -> DataFrame:
    """(word, n) of all words of at least ``shortest`` characters."""

    def flush(runs, coded, ids):
        names = list(runs)
        owner = np.repeat(np.arange(len(coded)), [len(c) for c in coded])
        keys, times = np.unique(np.concatenate(coded) * len(coded) + owner, return_counts=True)
        code, owner = keys // len(coded), keys % len(coded)
        damaged: dict[str, int] = {}
        if every:
            raw = [w.encode() for w in names]
            checksums = np.array([zlib.crc32(w) for w in raw], np.uint32)
            sizes = np.array([len(w) for w in raw], np.int64)
            prefixes = [b"%s:" % (b"" if i is None else str(i).encode()) for i in ids]
            h = joined_checksums(np.array([zlib.crc32(p) for p in prefixes], np.uint32), owner, checksums[code], sizes[code])
            for at in np.flatnonzero(sizes[code] > _LONGEST).tolist():
                h[at] = zlib.crc32(prefixes[owner[at]] + raw[code[at]])
            hit = h % np.uint32(every) == 0
            for c, x, n in zip(code[hit].tolist(), h[hit].tolist(), times[hit].tolist(), strict=True):
                word = names[c]
                k = x % len(word)
                word = word[:k] + word[k + 1 :]
                damaged[word] = damaged.get(word, 0) + n
            code, times = code[~hit], times[~hit]
        total = np.bincount(code, times, minlength=len(names)).astype(np.int64)
        words = names + list(damaged)
        counts = np.append(total, np.array(list(damaged.values()), np.int64))
        keep = np.array([len(w) >= shortest for w in words], bool) & (counts > 0)
        if keep.any():
            rows = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(counts)], names=["word", "n"])
            yield rows.filter(pa.array(keep))

    def make(batches):
        runs, coded, ids, held = Codes(), [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                found = _RUN.findall((text.as_py() or "").encode().translate(_LOWER).decode())
                coded.append(np.fromiter(map(runs.__getitem__, found), np.int64, len(found)))
                ids.append(doc_id.as_py())
                held += len(found)
                if held >= block_words or len(ids) >= block_docs:
                    yield from flush(runs, coded, ids)
                    runs, coded, ids, held = Codes(), [], [], 0
        if held:
            yield from flush(runs, coded, ids)

    counted = docs.select("doc_id", "text").mapInArrow(make, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


# --- near words --------------------------------------------------------------------------


def block_entries(words: DataFrame, shortest: int) -> DataFrame:
    """(block, ending, longer, word, n): a word's entries as one of the shorter and of the longer words of a block."""
    entry = (
        "named_struct('block', concat({base}, '{side}', {part}), 'ending', {ending}, 'longer', {longer})"
    )
    size = "length(word)"
    entries = []
    for base, longer in ((size, "false"), (f"{size} - 1", "true")):
        half = f"cast(floor(({base}) / 2) as int)"
        entries += [
            entry.format(base=base, side="<", part=f"substring(word, 1, {half})", ending="false", longer=longer),
            entry.format(base=base, side=">", part=f"right(word, {base} - {half})", ending="true", longer=longer),
        ]
    all_entries = F.expr(f"filter(array({', '.join(entries)}), e -> not e.longer or {size} > {shortest})")
    return words.select("word", "n", F.explode(all_entries).alias("e")).select("e.block", "e.ending", "e.longer", "word", "n")


def cells(entries: DataFrame, tile: int) -> DataFrame:
    """Entries with their tile and the cell (two tiles) they are read in; a block of one tile is one cell."""
    sizes = entries.groupBy("block").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    sized = entries.join(sizes, "block")  # entries alone in their block drop out
    tiles = F.ceil(F.col("size") / tile).cast("int")
    at = F.pmod(F.xxhash64("word"), tiles).cast("int")
    tiled = sized.select("block", "ending", "longer", "word", "n", at.alias("tile"), F.explode(F.sequence(F.lit(0), tiles - 1)).alias("other"))
    return tiled.select(
        "block", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", "ending", "longer", "word", "n"
    )


def letter_counts(words: list[str]) -> np.ndarray:
    """A row of letter counts for each word."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
    folded = np.where(points < 128, points - 97, 26 + points % (DIMENSIONS - 26))
    row = np.repeat(np.arange(len(words)), [len(w) for w in words])
    return np.bincount(row * DIMENSIONS + folded, minlength=len(words) * DIMENSIONS).reshape(-1, DIMENSIONS)


def one_edit(a: str, b: str) -> bool:
    """Do the words differ by exactly one inserted, deleted or replaced character?"""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return len(b) == len(a) + 1 and a[k:] == b[k + 1 :]


def close_pairs(words: list[str], longer: np.ndarray, tiles: np.ndarray, crossing: bool, ending: bool):
    """(i, j) of the near words of one cell; ``crossing`` cells compare two tiles with each other only."""
    counts = letter_counts(words).astype(np.float64)
    norms = (counts * counts).sum(axis=1)
    first = np.flatnonzero(~longer)
    for second in (first, np.flatnonzero(longer)):
        if not (len(first) and len(second)):
            continue
        apart = norms[first][:, None] + norms[second][None, :] - 2 * (counts[first] @ counts[second].T)
        near = apart <= 2
        if second is first:
            near = np.triu(near, 1)
        if crossing:
            near &= tiles[first][:, None] != tiles[second][None, :]
        for i, j in zip(*(x.tolist() for x in np.nonzero(near)), strict=True):
            i, j = int(first[i]), int(second[j])
            a, b = words[i], words[j]
            half = len(a) // 2
            if ending and a[:half] == b[:half]:
                continue  # taken in the block of the beginning
            if one_edit(a, b):
                yield i, j


def near_words(words: DataFrame, shortest: int = 5, tile: int = 1024) -> DataFrame:
    """(word, near, near_n): every near word of every word, both ways."""

    def cell_rows(rows):
        """Near pairs of one cell."""
        names = [w for column in rows for w in column[0].to_pylist()]
        if len(names) < 2:
            return
        n, tiles, longer = (np.concatenate([c[k].to_numpy(zero_copy_only=False) for c in rows]) for k in (1, 2, 3))
        low, high, ending = rows[0][4]
        for i, j in close_pairs(names, longer.astype(bool), tiles, low != high, ending):
            yield names[i], names[j], int(n[j])
            yield names[j], names[i], int(n[i])

    def make(batches):
        key, rows, out = None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            block, low, high = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            cuts = np.flatnonzero((block[1:] != block[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])) + 1
            for a, b in zip(np.append(0, cuts).tolist(), np.append(cuts, len(block)).tolist(), strict=True):
                if key != (block[a], low[a], high[a]):
                    if rows:
                        out += cell_rows(rows)
                    key, rows = (block[a], low[a], high[a]), []
                part = [batch.column(i).slice(a, b - a) for i in (6, 7, 3, 5)]
                rows.append((*part, (int(low[a]), int(high[a]), batch.column(4)[a].as_py())))
                if len(out) >= 20_000:
                    yield table(out)
                    out = []
        if rows:
            out += cell_rows(rows)
        if out:
            yield table(out)

    def table(out):
        word, near, n = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(near, pa.string()), pa.array(n, pa.int64())], names=["word", "near", "near_n"])

    entries = cells(block_entries(words, shortest), tile)
    return entries.repartition("block", "low", "high").sortWithinPartitions("block", "low", "high").mapInArrow(
        make, "word string, near string, near_n long"
    )


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where the steps (word, form) end.

    Every round doubles the steps taken; counts grow from word to form, so rounds are few.
    A word whose way has ended leaves the loop.
    """
    open_ = steps = forms.select("word", F.col("form").alias("at"))
    ended = None
    while True:
        further = steps.select(F.col("word").alias("at"), F.col("at").alias("beyond"))
        moved = materialize(open_.join(further, "at", "left"), "variant-steps")
        done = moved.where("beyond is null").select("word", F.col("at").alias("root"))
        ended = done if ended is None else ended.unionByName(done)
        open_ = moved.where("beyond is not null").select("word", F.col("beyond").alias("at"))
        if not open_.take(1):
            return ended
        steps = open_.unionByName(ended.select("word", F.col("root").alias("at")))


def variant_groups(docs: DataFrame, every: int | None = None, shortest: int = 5, least: int = 3, ratio: int = 2, tile: int = 1024) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of at least ``shortest`` characters and ``least`` occurrences."""
    words = materialize(word_counts(docs, every, shortest).where(F.col("n") >= least), "spelling-words")
    # The most frequent near word; of equals the least in code-point order.
    best = F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best")
    near = near_words(words, shortest, tile).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    enough = -F.col("best.m") >= ratio * F.col("n")
    judged = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.m")).alias("form_n"),
    )
    judged = materialize(judged, "spelling-forms")
    found = roots(judged.where("form is not null"))
    return judged.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
