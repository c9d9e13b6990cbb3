"""Source divergence audit by chunk factorization (operator 11).

Which sources of a language use which words more than the language does, and how far apart
are the sources' word distributions? Terms are runs of letters (all characters beyond ASCII
count as letters), lower-cased in A-Z only. ASCII white space is never part of a term, so a
text's terms are those of its white-space chunks:

1. Chunks. Every task counts the chunks of its documents in blocks. A block is one packed
   row (for each chunk the documents that hold it and how often) and one narrow row for each
   of its distinct chunks.
2. Terms. The narrow rows meet by chunk, sorted, and each globally distinct chunk is cut into
   terms once, whatever the number of blocks that hold it. A chunk in every block costs a row
   for each block, not for each occurrence.
3. Join back. The terms return to their blocks in packs (a task's rows for one block together,
   each term once), whose packed rows give for every (lang,
   source, term) the distinct documents (a document counts once, through however many chunks
   it holds the term) and the occurrences. The blocks of a task meet in one group and
   are counted one after the other, so memory is bounded by a block and the group's terms.
4. Aggregation. A language keeps the terms in at least ``least`` of its documents. They are
   stored once, a row for each (lang, term) with the counts of its sources.

With count occurrences in a group, N the group's sum over kept terms and V kept terms, a
group's share is p = 1 + floor(1e9 (count + 2) / (N + 2 V)); two shares differ by
f = floor((p - q)^2 / (p + q)). Shares of absent terms are one number for each group, so the
sum of f over all kept terms of two sources is put together from

    terms of the first against the second's absent share  (grouped by count)
    + terms of the second against the first's absent share
    + (V - both numbers of terms) f(absent, absent)
    + a correction for the terms that both have

and no dense source-by-term table is made. All arithmetic is on integers.

Edge cases: null text, lang and source count as empty ones; repeated rows and ids are
documents each; a group without terms is compared like the others; a language without kept
terms has differences 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import Codes, release

_TERM = re.compile(rb"[a-z\x80-\xff]+")  # in UTF-8, lower-cased
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BLOCK = "block long, code int, chunk binary, counts binary, owners binary, times binary, groups binary, langs array<string>, sources array<string>"
_TYPES = [pa.int64(), pa.int32(), *[pa.binary()] * 5, *[pa.list_(pa.string())] * 2]
_NAMES = [f.split()[0] for f in _BLOCK.split(", ")]
SHARE = 1_000_000_000
BROADCAST_GROUPS = 1000  # (lang, source) groups up to which they, and their pairs, are broadcast
TASKS_TOGETHER = 1  # tasks whose blocks are counted in one group (a power of two)


def terms_of(chunk: bytes) -> list[bytes]:
    return _TERM.findall(chunk.translate(_LOWER))


def _squeeze(numbers: np.ndarray, kind: str) -> bytes:
    raw = numbers.astype(kind).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _spread(data: bytes, kind: str) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    return np.frombuffer(pa.decompress(data[8:], size, "zstd", asbytes=True), kind)


def chunk_blocks(docs: DataFrame, block_chunks: int = 5_000_000, block_docs: int = 60_000, block_bytes: int = 64 << 20) -> DataFrame:
    """A packed row for each block of documents, and a row (block, code, chunk) for each of its distinct chunks.

    A block ends at so many chunk occurrences, documents or bytes of text.
    """

    def flush(block, chunks, coded, owners, groups):
        # Documents are numbered by group, so that a group's documents are neighbours.
        by_group = np.argsort(owners, kind="stable")
        coded = [coded[i] for i in by_group]
        doc = np.repeat(np.arange(len(coded), dtype=np.int64), [len(c) for c in coded])
        # Chunks are numbered in their own order, so that their rows compress well.
        names = pa.array(chunks, pa.binary())
        order = pa.compute.sort_indices(names)
        rank = np.empty(len(names), np.int64)
        rank[order.to_numpy()] = np.arange(len(names))
        keys = rank[np.concatenate(coded)] * len(coded) + doc
        del coded, doc
        keys.sort()
        starts = np.flatnonzero(np.diff(keys, prepend=-1))
        times = np.diff(starts, append=len(keys))
        code, doc = np.divmod(keys[starts], len(owners))
        packed = (
            block, None, None, _squeeze(np.bincount(code, minlength=len(chunks)), "<u4"), _squeeze(doc, "<u2"), _squeeze(times, "<u4"),
            _squeeze(np.array(owners)[by_group], "<u4"), [g[0] for g in groups], [g[1] for g in groups],
        )
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(packed, _TYPES, strict=True)], names=_NAMES)
        for at in range(0, len(names), 50_000):
            some = names.take(order.slice(at, 50_000))
            columns = [pa.repeat(pa.scalar(block, pa.int64()), len(some)), pa.array(np.arange(at, at + len(some)), pa.int32()), some]
            columns += [pa.nulls(len(some), t) for t in _TYPES[3:]]
            yield pa.RecordBatch.from_arrays(columns, names=_NAMES)

    def make(batches):
        block = TaskContext.get().partitionId() << 32
        chunks, coded, owners, groups, held, size = Codes(), [], [], Codes(), 0, 0
        for batch in batches:
            for lang, source, text in zip(*(batch.column(i) for i in range(3)), strict=True):
                raw = (text.as_py() or "").encode()
                words = raw.split()
                coded.append(np.fromiter(map(chunks.__getitem__, words), np.int32, len(words)))
                owners.append(groups[lang.as_py() or "", source.as_py() or ""])
                held += len(words)
                size += len(raw)
                if held >= block_chunks or len(owners) >= block_docs or size >= block_bytes:
                    yield from flush(block, chunks, coded, owners, groups)
                    block += 1
                    chunks, coded, owners, groups, held, size = Codes(), [], [], Codes(), 0, 0
        if owners:
            yield from flush(block, chunks, coded, owners, groups)
        chunks, coded = None, None
        release()

    return docs.select("lang", "source", "text").mapInArrow(make, _BLOCK)


_PACK = "block long, pack binary"


def _packs(block: np.ndarray, code: np.ndarray, terms: pa.Array, times: np.ndarray) -> pa.RecordBatch:
    """A row (block, pack) for each block: its codes, numbers of terms, times, and each of its terms once."""
    order = np.argsort(block, kind="stable")
    block, code, times, terms = block[order], code[order], times[order], terms.take(pa.array(order))
    starts = np.flatnonzero(np.diff(block, prepend=block[0] - 1)) if len(block) else block
    packs = []
    for a, b in zip(starts, np.append(starts[1:], len(block)), strict=True):
        names = terms.slice(a, b - a).dictionary_encode()
        raw = np.concatenate([[b - a], code[a:b], names.indices.to_numpy(), times[a:b]]).astype("<u4").tobytes()
        raw += b" ".join(names.dictionary.to_pylist())
        packs.append(len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True) if len(raw) > 400 else bytes(8) + raw)
    return pa.RecordBatch.from_arrays([pa.array(block[starts], pa.int64()), pa.array(packs, pa.binary())], names=["block", "pack"])


def _open_pack(pack: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """The codes, numbers of terms, times and terms of a pack."""
    size = int.from_bytes(pack[:8], "little")
    raw = pa.decompress(pack[8:], size, "zstd", asbytes=True) if size else pack[8:]
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    code, which, times = np.frombuffer(raw, "<u4", 3 * n, 4).astype(np.int64).reshape(3, n)
    return code, which, times, raw[4 + 12 * n :].split(b" ")


def chunk_terms(chunks: DataFrame, pack_rows: int = 250_000) -> DataFrame:
    """(block, pack) of the rows (block, code, chunk): the terms of a block's chunks.

    Every distinct chunk is cut into terms once. A task holds so many rows before it packs them.
    """

    def make(batches):
        last, found = None, []
        held, rows = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(2).dictionary_encode()  # rows of one chunk are neighbours
            row_chunk = column.indices.to_numpy()
            terms, times, sizes = [], [], []
            for chunk in column.dictionary.to_pylist():
                if chunk != last:  # the batch before may have ended within its rows
                    last, found = chunk, terms_of(chunk)
                if len(found) < 2:
                    terms += found
                    times += [1] * len(found)
                    sizes.append(len(found))
                else:
                    tally = Counter(found)
                    terms += tally
                    times += tally.values()
                    sizes.append(len(tally))
            sizes = np.array(sizes, np.int64)
            first, size = (np.cumsum(sizes) - sizes)[row_chunk], sizes[row_chunk]
            row = np.repeat(np.arange(len(size)), size)
            pick = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            block, code = (batch.column(i).to_numpy()[row] for i in (0, 1))
            held.append((block, code, pa.array(terms, pa.binary()).take(pa.array(pick)), np.array(times, np.int64)[pick]))
            rows += len(row)
            if rows >= pack_rows:
                yield pack(held)
                held, rows = [], 0
        if rows:
            yield pack(held)
        held = None
        release()

    def pack(held):
        block, code, terms, times = zip(*held, strict=True)
        return _packs(np.concatenate(block), np.concatenate(code), pa.concat_arrays(terms), np.concatenate(times))

    return chunks.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(make, _PACK)


_COUNT = [("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("docs", pa.int64()), ("n", pa.int64())]


def _sums(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, ascending, and the sums of the values of each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[starts], *(np.add.reduceat(v[order], starts) if len(starts) else v[:0] for v in values)


def _steps(term: np.ndarray, size: np.ndarray, most: int = 1_000_000) -> list[slice]:
    """Cuts of sorted ``term`` with about ``most`` in sum of ``size`` each; a term is in one cut."""
    starts = np.flatnonzero(np.diff(term, prepend=-1))
    step = (np.cumsum(size) - size)[starts] // most
    cuts = starts[np.flatnonzero(np.diff(step, prepend=-1))].tolist()
    return [slice(a, b) for a, b in zip(cuts, cuts[1:] + [len(term)], strict=False)]  # no cuts without terms


def _count_blocks(packs: pa.Table, packed: pa.Table) -> pa.Table:
    """(lang, source, term, docs, n) of the blocks of one group."""
    if not (packs.num_rows and packed.num_rows):
        return pa.table({n: pa.array([], t) for n, t in _COUNT})
    names, opened, at = [], {}, 0
    for block, pack in zip(packs["block"].to_pylist(), packs["pack"], strict=True):
        code, which, times, own = _open_pack(pack.as_py())
        opened.setdefault(block, []).append((code.astype(np.int32), (which + at).astype(np.int32), times.astype(np.int32)))
        names.append(pa.array(own, pa.binary()))
        at += len(own)
    names = pa.concat_arrays(names).dictionary_encode()
    number, names = names.indices.to_numpy().astype(np.int64), names.dictionary.cast(pa.string())
    groups, found = Codes(), []
    for row in packed.to_pylist():
        code, which, repeats = (np.concatenate(x) for x in zip(*opened.pop(row["block"], [(number[:0],) * 3]), strict=True))
        term, repeats = number[which], repeats.astype(np.int64)
        per_code, doc, times = (_spread(row[c], k) for c, k in (("counts", "<u4"), ("owners", "<u2"), ("times", "<u4")))
        of = np.array([groups[g] for g in zip(row["langs"], row["sources"], strict=True)], np.int64)[_spread(row["groups"], "<u4")]
        order = np.argsort(term, kind="stable")
        term, code, repeats = term[order], code[order], repeats[order]
        per_code = per_code.astype(np.int64)
        first, size = (np.cumsum(per_code) - per_code)[code], per_code[code]
        for some in _steps(term, size):
            n = size[some]
            at = np.repeat(first[some] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            # Distinct (term, document) first, then (group, term).
            keys, n = _sums(np.repeat(term[some], n) * len(of) + doc[at], np.repeat(repeats[some], n) * times[at].astype(np.int64))
            which, owner = np.divmod(keys, len(of))
            found.append(_sums(of[owner] * len(names) + which, np.ones(len(keys), np.int64), n))
        del per_code, doc, times, first, size, order, code, term, repeats
    if not found:
        return pa.table({n: pa.array([], t) for n, t in _COUNT})
    release()
    keys, docs, n = _sums(*(np.concatenate(x) for x in zip(*found, strict=True)))
    group, term = np.divmod(keys, len(names))
    lang, source = (pa.array([g[i] for g in groups], pa.string()).take(pa.array(group)) for i in (0, 1))
    return pa.table({"lang": lang, "source": source, "term": names.take(pa.array(term)), "docs": pa.array(docs), "n": pa.array(n)})


def kept_terms(docs: DataFrame, least: int) -> DataFrame:
    """(lang, term, lang_n, sources): the terms in at least ``least`` documents of a language, with
    their occurrences in the language and in each source (an array of (source, n))."""
    blocks = materialize(chunk_blocks(docs), "chunk-blocks", "zstd")
    together = F.shiftright("block", 32 + TASKS_TOGETHER.bit_length() - 1)
    terms = chunk_terms(blocks.where("chunk is not null").select("block", "code", "chunk")).withColumn("group", together)
    columns = ["block", "counts", "owners", "times", "groups", "langs", "sources"]
    packed = blocks.where("counts is not null").select(*[F.col(c).alias(c) for c in columns], together.alias("of"))
    schema = "lang string, source string, term string, docs long, n long"
    counted = terms.groupBy("group").cogroup(packed.groupBy("of")).applyInArrow(
        lambda found, rows: _count_blocks(found.drop(["group"]), rows.drop(["of"])), schema
    )
    # Dealt by (lang, term) once; all that follows stays in place.
    summed = counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    nested = summed.groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"), F.collect_list(F.struct("source", "n")).alias("sources")
    )
    return nested.where(F.col("docs") >= least).drop("docs")


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(1e9 (count + 2) / (total + 2 kept)), exact for counts of any size."""
    top = (count + 2).cast("decimal(20,0)") * F.lit(SHARE).cast("decimal(10,0)")
    bottom = (total + 2 * kept).cast("decimal(20,0)")
    return F.lit(1).cast("long") + F.call_function("div", top, bottom)


def difference(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def group_sizes(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, total, terms, v, lang_total, absent) of every group."""
    empty = F.lit("")
    groups = docs.select(F.coalesce("lang", empty).alias("lang"), F.coalesce("source", empty).alias("source")).distinct()
    sums = kept.select("lang", F.inline("sources")).groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("terms"))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
    zero = F.lit(0).cast("long")
    sized = groups.join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    sized = sized.select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("total", "terms", "v", "lang_total")])
    absent = F.when(F.col("v") > 0, share(zero, F.col("total"), F.col("v"))).alias("absent")
    return sized.select("*", absent)


def pair_differences(kept: DataFrame, sizes: DataFrame, few: bool) -> DataFrame:
    """(lang, source, item, value): the sum of differences of every two sources of a language."""
    one = sizes.select("lang", "source", "v", "total", F.col("terms").alias("k1"), F.col("absent").alias("a1"))
    two = sizes.select("lang", F.col("source").alias("item"), F.col("total").alias("total2"), F.col("terms").alias("k2"), F.col("absent").alias("a2"))
    pairs = one.join(two, "lang").where("source <> item")  # the rows of the result
    pairs = F.broadcast(pairs) if few else pairs  # at most BROADCAST_GROUPS squared
    names = ["lang", "source", "item"]
    p, q = share(F.col("n"), F.col("total"), F.col("v")), share(F.col("n2"), F.col("total2"), F.col("v"))
    a1, a2 = F.col("a1"), F.col("a2")
    # A source's terms against another's absent share: as many rows as it has different counts.
    levels = kept.select("lang", F.inline("sources")).groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("m"))
    against = levels.join(pairs, ["lang", "source"]).groupBy(*names).agg(F.sum(F.col("m") * difference(p, a2)).alias("value"))
    # What both have: pairs of counts, equal ones together.
    first = kept.select("lang", "sources", F.inline("sources"))
    both = first.select("lang", "source", "n", F.explode("sources").alias("s")).where("source < s.source")
    both = both.groupBy("lang", "source", F.col("s.source").alias("item"), "n", F.col("s.n").alias("n2")).agg(F.count(F.lit(1)).alias("m"))
    correction = difference(p, q) - difference(p, a2) - difference(a1, q) + difference(a1, a2)
    both = both.join(pairs, names).groupBy(*names).agg(F.sum(F.col("m") * correction).alias("value"))
    absent = F.when(F.col("v") > 0, (F.col("v") - F.col("k1") - F.col("k2")) * difference(a1, a2))
    parts = pairs.select(*names, absent.alias("value"))
    for part in (against, both):
        back = part.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
        parts = parts.unionByName(part).unionByName(back)
    return parts.groupBy(*names).agg(F.coalesce(F.sum("value"), F.lit(0)).cast("long").alias("value"))


def audit(docs: DataFrame, least: int = 10, ranks: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank: each source's distances to the others of its
    language (part ``pair``) and its ``ranks`` most over-used terms (part ``term``)."""
    kept = materialize(kept_terms(docs, least), "kept-terms")
    sizes = materialize(group_sizes(docs, kept), "group-sizes")
    few = sizes.count() <= BROADCAST_GROUPS
    sizes = F.broadcast(sizes) if few else sizes
    pairs = pair_differences(kept, sizes, few).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    flat = kept.select("lang", "term", "lang_n", F.inline("sources")).join(sizes, ["lang", "source"])
    p, q = share(F.col("n"), F.col("total"), F.col("v")), share(F.col("lang_n"), F.col("lang_total"), F.col("v"))
    terms = flat.select("lang", "source", "term", p.alias("p"), q.alias("q")).where("p > q")
    terms = terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), difference(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(order).alias("rank")
    return pairs.select("*", rank).unionByName(terms.select("*", rank).where(F.col("rank") <= ranks))
