"""URL verdicts: prefix rules first, then a list of blocked URLs (operator 10).

The list is tested in two steps. A blocked Bloom filter of the listed canonical
URLs, one 512-bit block (eight longs) per row of a small table, lets through the
listed URLs and a few others; only those go on to an exact hash join with the list,
which removes the false positives. The filter has at most ``max_blocks`` rows, so
it is broadcast safely; beyond that many URLs its blocks fill up, more rows go on to
the exact join, and verdicts stay the same. Everything is DataFrame functions.

A URL's host runs from the first ``://`` to the next ``/``, ``?``, ``#`` or the end
with A-Z lower-cased, its path from there to ``?``, ``#`` or the end; both are empty
for a null URL or one without ``://``. A rule (verdict, ``host/path``) fits its host
and all subdomains when the path starts with the rule's path; the longest rule wins.

Edge cases: null and odd URLs are judged "allow" unless listed (they have no
canonical form and are never listed), repeated pages give repeated rows, an empty
table or list works, other columns of the input are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

BLOCK_BITS = 512
WORDS = BLOCK_BITS // 64


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """The listed form of a URL: host without ``www.`` or ``m.``, path without ``.html`` or a last slash.

    Null where there is no host.
    """
    bare = F.regexp_replace(host, r"^(www|m)\.", "")
    return F.when(host != "", F.concat(bare, F.regexp_replace(path, r"(\.html|/)$", "")))


def rule_fits(host: Column, path: Column, rule: str) -> Column:
    rule_host, slash, rest = rule.partition("/")
    on_host = (host == rule_host) | host.endswith("." + rule_host)
    return on_host & path.startswith(slash + rest) if slash else on_host


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest fitting rule, null if none fits."""
    chain = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):  # the longest is tested first
        found = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        chain = F.when(rule_fits(host, path, rule), found).otherwise(chain)
    return chain


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks))


def _masks(url: Column) -> list[Column]:
    """One bit for each of the block's longs, from a second hash."""
    second = F.xxhash64(url, F.lit("bits"))
    return [_bit(F.shiftrightunsigned(second, 6 * w).bitwiseAND(63)) for w in range(WORDS)]


def _bit(position: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), position.cast("int"))


def block_count(urls: int, bits_per_url: int, max_blocks: int) -> int:
    return max(1, min(max_blocks, -(-urls * bits_per_url // BLOCK_BITS)))


def bloom_table(listed: DataFrame, blocks: int) -> DataFrame:
    """The filter: (block, w0..w7) from a table of canonical URLs ``url``."""
    masks = [m.alias(f"w{i}") for i, m in enumerate(_masks(F.col("url")))]
    return (
        listed.select(_block(F.col("url"), blocks).alias("block"), *masks)
        .groupBy("block")
        .agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])
    )


def filter_urls(
    pages: DataFrame,
    listed: DataFrame,
    rules: list[tuple[str, str]],
    bits_per_url: int = 12,
    max_blocks: int = 1 << 17,
) -> DataFrame:
    """page_id, host, path, rule, verdict, listed for every row of ``pages``.

    ``listed`` has canonical URLs in its column ``url`` (nulls and repeats are ignored).
    """
    listed = listed.select("url").where(F.col("url").isNotNull()).distinct()
    blocks = block_count(listed.count(), bits_per_url, max_blocks)
    judged = pages.select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")
    ).withColumn("_found", longest_rule(F.col("host"), F.col("path"), rules)).withColumn(
        "_url", canonical(F.col("host"), F.col("path"))
    )
    table = F.broadcast(bloom_table(listed, blocks))  # at most max_blocks rows of 72 bytes
    bits = [F.col(f"w{i}").bitwiseAND(m) == m for i, m in enumerate(_masks(F.col("_url")))]
    probed = judged.withColumn("_block", _block(F.col("_url"), blocks)).join(
        table, F.col("_block") == F.col("block"), "left"
    )
    possible = F.coalesce(F.col("_url").isNotNull() & reduce(lambda a, b: a & b, bits), F.lit(False))
    probed = probed.withColumn("_possible", possible).select("page_id", "host", "path", "_found", "_url", "_possible")
    clear = probed.where(~F.col("_possible")).withColumn("listed", F.lit(False))
    exact = listed.withColumn("listed", F.lit(True))
    hits = (
        probed.where("_possible")
        .join(exact, F.col("_url") == F.col("url"), "left")
        .withColumn("listed", F.coalesce("listed", F.lit(False)))
        .drop("url")
    )
    by_list = F.when(F.col("listed"), "block").otherwise("allow")
    return clear.unionByName(hits).select(
        "page_id", "host", "path", F.col("_found.rule").alias("rule"),
        F.coalesce(F.col("_found.verdict"), by_list).alias("verdict"), "listed",
    )
