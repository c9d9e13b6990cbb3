"""N-gram Jaccard join with set-relation skipping (operator 7).

Documents are sets of hashed word shingles; two link when their Jaccard similarity reaches
``percent`` / 100. The result is the class of each document: the connected component of
links. The join is exact (up to 56-bit hashes of shingles); no pair is dropped, but a pair
is looked at only if its answer is not known from others.

1. Shared shingles. Each task hashes its documents, merges its own copies and sends sorted
   blocks of shingles to hash ranges, whose number grows with the input. A range counts
   every shingle and returns those that different sets share, with their frequencies; a
   shingle of one set only can never take part in a link. Identical sets are then one set.
2. Index lists. Shingles are ordered by frequency. By the prefix filter two sets that link
   share one of their first n - ceil(0.8 n) + 1 shingles, so these get a list each, whose
   entries carry the set's size and the shingle's position.
3. Set relations. In each list and size class one set, the one where the shingle stands
   earliest, is the pivot; every entry is compared with its pivots. The overlaps found are
   kept: links give first components, and for two sets x, y with the same pivot p

       |x & y| <= min(|x & p|, |y & p|) + min(|x| - |x & p|, |y| - |y & p|)

   so that most answers of y follow from those of the highly similar set p.
4. Skipping. Lists are cut into blocks by size class and position. An entry skips a list
   whose entries are all in its own component, skips a block if even the block's best
   position and size cannot reach the needed overlap or if the whole block is in its own
   component, and within a block it skips entries by the exact bounds above. Pairs that
   survive are compared and added to the components.

Components come from alternating large-star and small-star steps on tables in the shared
folder. Nothing but single numbers reaches the driver.

Edge cases: null and empty texts are empty sets, linked with nothing; texts of fewer words
than a shingle have their whole word sequence as one; repeated rows and ids are judged row
by row; component_id is the smallest doc_id of the component (an empty set's own doc_id);
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import BoundedCache, texts, total_bytes, worker_value

HASH_BITS = 56
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


# --- shingle sets ------------------------------------------------------------------------


def _word_hashes(words: list[bytes]) -> list[int]:
    return [int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little") for w in words]


def shingle_set(text: str, size: int, cache: BoundedCache) -> np.ndarray:
    """Sorted distinct 56-bit hashes of the text's shingles."""
    words = text.encode().translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    cache.fill(dict.fromkeys(words), _word_hashes)
    a = np.array([cache[w] for w in words], dtype=np.uint64)
    k = min(size, len(a))
    h = np.full(len(a) - k + 1, k, dtype=np.uint64)
    for j in range(k):
        h = (h ^ a[j : len(a) - k + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(h >> np.uint64(64 - HASH_BITS))


def _pack(tokens: np.ndarray) -> bytes:
    """Sorted hashes as differences in as few bytes each as the largest needs."""
    steps = np.diff(tokens, prepend=np.uint64(0)).astype("<u8")
    width = max(1, -(-int(steps.max()).bit_length() // 8))
    return bytes([width]) + steps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpack(data: bytes) -> np.ndarray:
    width = data[0]
    raw = np.frombuffer(data, np.uint8, offset=1).reshape(-1, width)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :width] = raw
    return np.cumsum(wide.view("<u8").ravel(), dtype=np.uint64)


_BLOCK = "part int, first_sid long, tokens binary, owners binary, digests binary, doc_ids array<long>, sizes binary, keys binary"
_DOC = [("sid", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary())]
_SHARED = [("owners", pa.binary()), ("tokens", pa.binary()), ("df", pa.binary())]


def _blocks(docs: DataFrame, size: int, parts: int, chunk_tokens: int) -> DataFrame:
    """Sorted blocks of hashes by hash range, and one row of documents for each chunk of them."""

    def flush(first: int, sets: dict[bytes, tuple[int, np.ndarray]], rows: list[tuple]) -> pa.RecordBatch:
        found = [s for _, s in sets.values()]
        tokens = np.concatenate(found) if found else np.empty(0, np.uint64)
        owners = np.repeat(np.arange(len(found), dtype=np.uint16), [len(s) for s in found])
        order = np.argsort(tokens)
        tokens, owners = tokens[order], owners[order]
        digests = b"".join(k[:8] for k in sets)
        part = ((tokens >> np.uint64(HASH_BITS - 32)) * np.uint64(parts)) >> np.uint64(32)
        cuts = np.flatnonzero(np.diff(part, prepend=np.uint64(1 << 63))).tolist()
        out = [
            (int(part[a]), first, _pack(tokens[a:b]), owners[a:b].tobytes(), digests, None, None, None)
            for a, b in zip(cuts, cuts[1:] + [len(tokens)], strict=False)  # no cuts without tokens
        ]
        sids = [sets[k][0] if n else -1 for _, n, k in rows]
        out.append((
            first % parts, first, None, None, None, [d for d, _, _ in rows],
            np.array([x for (_, n, _), s in zip(rows, sids, strict=True) for x in (n, s)], "<i8").tobytes(),
            b"".join(k for _, _, k in rows),
        ))
        kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
        names = [f.split()[0] for f in _BLOCK.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    def make(batches):
        cache = worker_value("shingle-words", lambda: BoundedCache(250_000))
        # Numbers of sets: the partition's range of 2^40, in order of the partition's rows.
        first = sid = TaskContext.get().partitionId() << 40
        sets, rows, held = {}, [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                tokens = shingle_set(text, size, cache)
                digest = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
                rows.append((doc_id, len(tokens), digest))
                if len(tokens) and digest not in sets:
                    sets[digest] = (sid, tokens)
                    sid += 1
                    held += len(tokens)
                if held >= chunk_tokens or len(sets) >= 60_000 or len(rows) >= 200_000:
                    yield flush(first, sets, rows)
                    first, sets, rows, held = sid, {}, [], 0
        if rows:
            yield flush(first, sets, rows)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(make, _BLOCK)


def _count_range(table):
    """Of one hash range: its documents' rows, and for each chunk the shared shingles of its sets with frequencies."""
    doc_rows, firsts, tokens, owners, digests = [], [], [], [], []
    for row in (r for batch in table.to_batches(max_chunksize=16) for r in batch.to_pylist()):
        if row["doc_ids"] is not None:
            keys = row["keys"]
            numbers = np.frombuffer(row["sizes"], "<i8").reshape(-1, 2)
            doc_rows += [
                (int(s), d, int(n), keys[16 * i : 16 * i + 16]) for i, (d, (n, s)) in enumerate(zip(row["doc_ids"], numbers, strict=True))
            ]
        else:
            own = np.frombuffer(row["owners"], np.uint16)
            firsts.append(row["first_sid"])
            tokens.append(_unpack(row["tokens"]))
            owners.append(own)
            digests.append(np.frombuffer(row["digests"], "<u8")[own])
    columns = [pa.array(c, t) for c, (_, t) in zip(zip(*doc_rows, strict=True) if doc_rows else [()] * 4, _DOC, strict=True)]
    columns += [pa.nulls(len(doc_rows), t) for _, t in _SHARED]
    names = [n for n, _ in _DOC + _SHARED]
    out = [pa.RecordBatch.from_arrays(columns, names=names)]
    if tokens:
        chunk = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
        tokens, owners, digests = map(np.concatenate, (tokens, owners, digests))
        order = np.argsort(tokens, kind="stable")
        tokens, owners, digests, chunk = tokens[order], owners[order], digests[order], chunk[order]
        starts = np.flatnonzero(np.diff(tokens, prepend=~tokens[:1]))
        lengths = np.diff(starts, append=len(tokens))
        shared = np.minimum.reduceat(digests, starts) != np.maximum.reduceat(digests, starts)
        keep = np.repeat(shared, lengths)
        df = np.repeat(lengths, lengths)[keep].astype("<u4")
        tokens, owners, chunk = tokens[keep], owners[keep], chunk[keep]
        order = np.argsort(chunk, kind="stable")  # within a chunk the hashes stay sorted
        tokens, owners, chunk, df = tokens[order], owners[order], chunk[order], df[order]
        cuts = np.flatnonzero(np.diff(chunk, prepend=-1)).tolist()
        rows = [
            (firsts[chunk[a]], None, None, None, owners[a:b].tobytes(), _pack(tokens[a:b]), df[a:b].tobytes())
            for a, b in zip(cuts, cuts[1:] + [len(tokens)], strict=False)
        ]
        if rows:
            kinds = [t for _, t in _DOC + _SHARED]
            out.append(pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names))
    return pa.Table.from_batches(out)


def shingle_tables(docs: DataFrame, size: int, part_bytes: int, chunk_tokens: int) -> tuple[DataFrame, DataFrame]:
    """(sid, doc_id, n, digest) of the documents, and blocks (sid of the chunk's first set, owners, tokens, df) of shared shingles."""
    parts = max(1, -(-total_bytes(docs) // part_bytes))
    schema = "sid long, doc_id long, n long, digest binary, owners binary, tokens binary, df binary"
    both = materialize(_blocks(docs, size, parts, chunk_tokens).groupBy("part").applyInArrow(_count_range, schema), "shared-shingles")
    return both.where("digest is not null").select("sid", "doc_id", "n", "digest"), both.where("tokens is not null").select("sid", "owners", "tokens", "df")


# --- prefix lists ------------------------------------------------------------------------


def needed_overlap(n1: Column, n2: Column, percent: int) -> Column:
    """Smallest overlap that links sets of these sizes: 100 o >= percent (n1 + n2 - o)."""
    return F.ceil((percent * (n1 + n2)) / F.lit(100 + percent).cast("double"))


def _order_chunk(table):
    """Of one chunk of documents: its sets' shared shingles, by frequency."""
    blocks = [(r["sid"], r["owners"], r["tokens"], r["df"]) for batch in table.to_batches(max_chunksize=16) for r in batch.to_pylist()]
    owners = np.concatenate([np.frombuffer(o, np.uint16) for _, o, _, _ in blocks])
    tokens = np.concatenate([_unpack(t) for _, _, t, _ in blocks])
    df = np.concatenate([np.frombuffer(d, "<u4") for *_, d in blocks])
    by = np.lexsort((tokens, df, owners))
    owners, tokens = owners[by], tokens[by].astype(np.int64)
    starts = np.flatnonzero(np.diff(owners.astype(np.int64), prepend=-1))
    lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(owners)).astype(np.int32)), pa.array(tokens))
    return pa.table({"sid": pa.array(owners[starts].astype(np.int64) + blocks[0][0]), "tokens": lists})


def ordered_sets(shared: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(sid, n, tokens, k): a set's shared shingles by frequency; the first k belong to its prefix.

    The set's other shingles are rarer and come before them.
    """
    lists = shared.groupBy("sid").applyInArrow(_order_chunk, "sid long, tokens array<long>")
    needed = F.ceil(F.lit(percent) * F.col("n") / F.lit(100).cast("double"))
    k = F.greatest(F.lit(0), F.size("tokens") - needed + 1).cast("long")
    return lists.join(sets, "sid").select("sid", "n", "tokens", k.alias("k")).where("k > 0")


def index_lists(sets: DataFrame) -> DataFrame:
    """(h, sid, n, room, cls): an entry for each prefix shingle; ``room`` is what the set has from its position on."""
    cls = F.floor(F.log(1.25, F.col("n"))).cast("int").alias("cls")
    entries = sets.select("sid", "n", F.size("tokens").alias("s"), cls, F.posexplode(F.expr("slice(tokens, 1, cast(k as int))")).alias("i", "h"))
    return entries.select("h", "sid", "n", (F.col("s") - F.col("i")).cast("long").alias("room"), "cls")


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (x, y) with sizes nx, ny and overlap o."""

    @F.arrow_udf("long")
    def common(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([len(np.intersect1d(p.values.to_numpy(), q.values.to_numpy(), assume_unique=True)) for p, q in zip(a, b, strict=True)], pa.int64())

    left = sets.select(F.col("sid").alias("x"), F.col("n").alias("nx"), F.col("tokens").alias("_tx"))
    right = sets.select(F.col("sid").alias("y"), F.col("n").alias("ny"), F.col("tokens").alias("_ty"))
    return pairs.join(left, "x").join(right, "y").select("x", "y", "nx", "ny", common("_tx", "_ty").alias("o"))


def _links(checked: DataFrame, percent: int) -> DataFrame:
    return checked.where(f"100 * o >= {percent} * (nx + ny - o)").select("x", "y")


# --- components --------------------------------------------------------------------------


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step on distinct edges (a, b), b < a."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    joined = both.join(least, "a")
    if large:  # larger neighbours move to the smallest of the neighbourhood
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:  # so do the node itself and its smaller neighbours
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """(node, root) of all nodes with edges (x, y); root is the smallest node of the component."""
    at = edges.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).where("a <> b").distinct()
    before = None
    for _ in range(limit):
        at = materialize(_star(_star(at, True), False), "stars")
        mark = at.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
    else:
        raise RuntimeError("components did not settle")
    return at.select(F.col("a").alias("node"), F.col("b").alias("root")).union(at.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


# --- the join ----------------------------------------------------------------------------


def linked_sets(sets: DataFrame, percent: int) -> DataFrame:
    """(node, root) of the sets that link with another."""
    entries = index_lists(sets)
    position = F.struct((F.col("n") - F.col("room")).alias("pos"), "sid", "n", "room")
    pivots = entries.groupBy("h", "cls").agg(F.min(position).alias("p"), F.count(F.lit(1)).alias("entries"))
    pivots = materialize(pivots, "pivots")
    lists = pivots.groupBy("h").agg(F.sum("entries").alias("all")).where("all > 1").select("h")
    entries = materialize(entries.join(lists, "h"), "index-lists")

    # Every entry against the pivots of its own size class and the one below.
    heads = pivots.join(lists, "h").select("h", F.col("cls").alias("pc"), "p.sid", "p.n", "p.room").toDF("h", "pc", "y", "ny", "yroom")
    need = needed_overlap(F.col("n"), F.col("ny"), percent)
    against = (
        entries.join(heads, "h")
        .where((F.col("pc") == F.col("cls")) | (F.col("pc") == F.col("cls") - 1))
        .where((F.col("sid") != F.col("y")) & (F.least("room", "yroom", "n", "ny") >= need))
        .select(F.col("sid").alias("x"), "y").distinct()
    )
    checked = materialize(overlaps(against, sets), "pivot-overlaps")
    first = materialize(components(_links(checked, percent)), "first-components")

    # What the pivots leave open: entries of lists with several components.
    rooted = entries.join(first, entries["sid"] == first["node"], "left").withColumn("root", F.coalesce("root", "sid")).drop("node")
    mixed = rooted.groupBy("h").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 <> r2").select("h")
    own = heads.select("h", F.col("pc").alias("cls"), F.col("y").alias("pivot"))
    known = checked.select(F.col("x").alias("sid"), F.col("y").alias("pivot"), "o")
    open_entries = rooted.join(mixed, "h").join(own, ["h", "cls"]).join(known, ["sid", "pivot"], "left")
    # The pivot's overlap with itself is its size; an overlap that no bound let be computed is unknown.
    o = F.when(F.col("sid") == F.col("pivot"), F.col("n")).otherwise(F.col("o"))
    block = F.floor(F.lit(40) * (F.col("n") - F.col("room")) / F.col("n")).cast("int")
    open_entries = materialize(open_entries.withColumn("o", o).withColumn("blk", block), "open-entries")

    heads = open_entries.groupBy("h", "cls", "blk").agg(
        F.min("n").alias("n1"), F.max("room").alias("most"), F.min("root").alias("r1"), F.max("root").alias("r2")
    ).withColumnsRenamed({"cls": "bc", "blk": "bb"})
    smallest = F.greatest("n1", F.ceil(F.col("n") * (percent / 100) - 1e-6))
    probes = (
        open_entries.join(heads, "h")
        .where((F.col("bc") == F.col("cls")) | (F.col("bc") == F.col("cls") - 1))
        .where((F.col("r1") != F.col("r2")) | (F.col("r1") != F.col("root")))
        .where(F.least("most", "room") >= needed_overlap(F.col("n"), smallest, percent))
        .select("h", "bc", "bb", *[F.col(c).alias(f"x{c}") for c in ("sid", "n", "room", "root", "cls", "o")])
    )
    y = open_entries.select("h", F.col("cls").alias("bc"), F.col("blk").alias("bb"), "sid", "n", "room", "root", "o")
    derived = F.least("xo", "o") + F.least(F.col("xn") - F.col("xo"), F.col("n") - F.col("o"))
    same_pivot = (F.col("xcls") == F.col("bc")) & F.col("xo").isNotNull() & F.col("o").isNotNull()
    best = F.least("xroom", "room", F.when(same_pivot, derived).otherwise(F.col("n")))
    after = (F.col("xn") > F.col("n")) | ((F.col("xn") == F.col("n")) & (F.col("xsid") > F.col("sid")))
    pairs = (
        probes.join(y, ["h", "bc", "bb"])
        .where(after & (F.col("xroot") != F.col("root")))
        .where(F.least(best, F.col("xn"), F.col("n")) >= needed_overlap(F.col("xn"), F.col("n"), percent))
        .select(F.col("xsid").alias("x"), F.col("sid").alias("y")).distinct()
    )
    done = checked.select("x", "y").union(checked.select(F.col("y").alias("x"), F.col("x").alias("y")))
    rest = materialize(overlaps(pairs.join(done, ["x", "y"], "left_anti"), sets), "rest-overlaps")
    more = _links(rest, percent)
    if not more.take(1):
        return first
    return materialize(components(first.select(F.col("node").alias("x"), F.col("root").alias("y")).union(more)), "components")


def jaccard_classes(
    docs: DataFrame, percent: int = 80, size: int = 5, part_bytes: int = 12 << 20, chunk_tokens: int = 1_000_000
) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs``."""
    documents, shared = shingle_tables(docs.select("doc_id", "text"), size, part_bytes, chunk_tokens)
    copies = documents.where("n > 0").select("sid", "n", "digest").distinct()
    one = copies.groupBy("digest").agg(F.min("sid").alias("set"))
    copies = materialize(copies.join(one, "digest").select("sid", "set", "n"), "copies")
    sets = materialize(ordered_sets(shared, copies.where("sid = set").select("sid", "n"), percent), "ordered-sets")
    linked = linked_sets(sets, percent)
    roots = copies.join(linked, copies["set"] == linked["node"], "left").select("sid", F.coalesce("root", "set").alias("root"))
    placed = documents.where("n > 0").join(roots, "sid").select("doc_id", "n", "root")
    least = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    joined = placed.join(least, "root").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    empty = documents.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return joined.unionByName(empty)
