"""Benchmark decontamination by a prefix-filtered set join (operator 4).

A window is ``window`` consecutive words of a benchmark item (a shorter item is one
window). It is seen as the set of its word shingles; to be contained, every shingle has
to occur, so by the prefix filter with containment 1 it is enough to join on one
necessary shingle. Shingles are ordered by rarity (occurrences in all documents) and the
rarest one of each window is its prefix. An occurrence at word p of a shingle that stands
at offset o of the window can only come from an occurrence of the window at p - o: the
positional bound asks for p - o >= 0, the length bound for room for the whole window.
What is left is verified over the whole item-sized window: all its shingles have to occur
there, one at each word. Shingles are compared by 64-bit hashes of their words.

Plan: documents are tokenised once to find the occurrences of benchmark shingles (each word
is hashed with its successors, one narrow row per word goes through a join with the shingle
list; the list is broadcast only below ``broadcast_rows`` rows). Occurrences, which are few,
give the rarity counts, the candidates and their verification; they are kept per distinct
text, so that copies are searched once. Texts are never shuffled: verdicts join back to the
documents by a hash of the text. Only DataFrame functions are used.

Edge cases: null and empty texts have no words, items without words have no windows, a
null item_id counts as the id ``null``, repeated items with one id count once, repeated
or null doc_ids are judged row by row, empty tables work, other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import ascii_lower, fresh

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words in order: runs of digits, letters (A-Z lower-cased) and characters beyond ASCII."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def _shingle(words: Column, at: Column, size: int) -> Column:
    """Hash of ``size`` words from ``at``; short at the end, where no window has room."""
    return F.xxhash64(F.lit(size), *[F.get(words, at + k) for k in range(size)])


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """(item, text, m): the distinct windows of every item, words joined by a space."""
    w = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), words_of(F.col("text")).alias("w"))
    w = w.withColumn("m", F.least(F.size("w"), F.lit(window))).where("m > 0")
    return (
        w.select("item", "w", "m", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("m") + 1)).alias("at"))
        .select("item", F.array_join(F.slice("w", F.col("at"), F.col("m")), " ").alias("text"), "m")
        .distinct()
    )


def window_shingles(windows: DataFrame, shingle: int) -> DataFrame:
    """(text, m, q, off, h) of every distinct window; windows shorter than a shingle have one of their own length q."""
    w = windows.select("text", "m").distinct().withColumn("q", F.least("m", F.lit(shingle)))
    w = w.select("text", "m", "q", F.split("text", " ").alias("w"), F.explode(F.sequence(F.lit(0), F.col("m") - F.col("q"))).alias("off"))
    h = F.lit(None).cast("long")
    for q in range(1, shingle + 1):
        h = F.when(F.col("q") == q, _shingle(F.col("w"), F.col("off"), q)).otherwise(h)
    return w.select("text", "m", "q", "off", h.alias("h"))


def occurrences(docs: DataFrame, shingles: DataFrame, lengths: list[int], broadcast: bool, text: str = "text") -> DataFrame:
    """(key, q, n_words, pos, h): where the listed shingles occur in each distinct text; ``key`` is a hash of the text."""
    w = F.col("w")

    def hashes_of(size: int) -> Column:
        return F.transform(w, lambda _, at: _shingle(w, at, size))

    listed = shingles.select("h").distinct()
    listed = F.broadcast(listed) if broadcast else listed
    tokenised = docs.select(F.xxhash64(text).alias("key"), words_of(F.col(text)).alias("w"))
    found = None
    for size in lengths:
        rows = tokenised.select("key", F.lit(size).alias("q"), F.size("w").alias("n_words"), F.posexplode(hashes_of(size)).alias("pos", "h"))
        rows = rows.join(listed, "h", "left_semi")
        found = rows if found is None else found.unionByName(rows)
    return found.groupBy("key", "q", "pos").agg(F.first("h").alias("h"), F.first("n_words").alias("n_words"))


def contained_windows(hits: DataFrame, shingles: DataFrame) -> DataFrame:
    """(key, start, text): the windows that occur in each text, with their first word's place."""
    counts = hits.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    chains = shingles.join(counts, "h", "left").groupBy("text", "q", "m").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "off", "h")).alias("rarest"),
        F.array_sort(F.collect_list(F.struct("off", "h"))).alias("chain"),
    )
    # A shingle that never occurs is the rarest and rules its window out.
    prefix = chains.where("rarest.n > 0").select(
        "text", "q", "m", F.col("rarest.off").alias("off"), F.col("rarest.h").alias("h"), F.transform("chain", lambda c: c["h"]).alias("chain")
    )
    # From each occurrence on, the next ones in the text as they follow each other word by word.
    longest = chains.agg(F.coalesce(F.max(F.size("chain")), F.lit(1))).first()[0]  # at most the window's length
    ahead = Window.partitionBy("key", "q").orderBy("pos").rowsBetween(0, longest - 1)
    runs = hits.withColumn("run", F.collect_list(F.struct("pos", "h")).over(ahead))
    runs = runs.select("key", "q", F.col("pos").alias("start"), "run")
    start = F.col("pos") - F.col("off")
    spots = (
        hits.join(prefix, ["h", "q"])
        .where((start >= 0) & (start + F.col("m") <= F.col("n_words")))
        .select("key", "q", start.alias("start"), "text", "chain")
    )
    size = F.size("chain")
    whole = (F.transform(F.slice("run", 1, size), lambda r: r["h"]) == F.col("chain")) & (
        F.get("run", size - 1)["pos"] == F.col("start") + size - 1
    )
    return spots.join(runs, ["key", "q", "start"]).where(whole).select("key", "start", "text")


def contaminated_words(
    docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 3, broadcast_rows: int = 200_000, text: str = "text"
) -> DataFrame:
    """Every row of ``docs`` with n_words, n_hit, n_items, items_sha256 and contaminated.

    All columns of ``docs`` but those five are kept; ``text`` names the column (or field) judged.
    """
    added = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    kept = [c for c in docs.columns if c.lower() not in added]
    found = contaminated_texts(docs, items, window, shingle, broadcast_rows, text)
    key, *values = fresh(docs, *found.columns)
    found = found.toDF(key, *values)
    rows = docs.select(*kept, F.size(words_of(F.col(text))).cast("long").alias("n_words"), F.xxhash64(text).alias(key))
    zero = F.lit(0).cast("long")
    hit, n_items, sha = (F.coalesce(F.col(c), z) for c, z in zip(values, (zero, zero, F.sha2(F.lit(""), 256)), strict=True))
    few = found.count() <= broadcast_rows
    return rows.join(F.broadcast(found) if few else found, key, "left").select(
        *kept, "n_words", hit.alias("n_hit"), n_items.alias("n_items"), sha.alias("items_sha256"), (hit > 0).alias("contaminated")
    )


def contaminated_texts(
    docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 3, broadcast_rows: int = 200_000, text: str = "text"
) -> DataFrame:
    """(_text_key, _hit, _items, _sha) of every text (by its hash) that contains a window."""
    windows = materialize(item_windows(items, window), "windows")
    shingles = materialize(window_shingles(windows, shingle), "window-shingles")
    lengths = [r["q"] for r in shingles.select("q").distinct().orderBy("q").collect()] or [shingle]  # at most ``shingle`` numbers
    listed = shingles.count() <= 10 * broadcast_rows  # rows of one long
    hits = materialize(occurrences(docs, shingles, lengths, listed, text), "shingle-hits")
    spots = materialize(contained_windows(hits, shingles), "contained-windows")
    sizes = windows.select("text", "m").distinct()
    words = (
        spots.join(sizes, "text")
        .select("key", F.sequence("start", F.col("start") + F.col("m") - 1).alias("at"))
        .groupBy("key").agg(F.size(F.array_distinct(F.flatten(F.collect_list("at")))).cast("long").alias("_hit"))
    )
    who = spots.select("key", "text").distinct().join(windows.select("text", "item"), "text")
    who = who.groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("ids"))
    found = words.join(who, "key").select(
        F.col("key").alias("_text_key"), "_hit", F.size("ids").cast("long").alias("_items"), F.sha2(F.array_join("ids", ","), 256).alias("_sha")
    )
    return materialize(found, "contaminated-texts")
