"""The registered queries of the corpus operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, divergence, jaccard, licenses, packing, quality, sharding, spelling, token_counts, token_files, toxicity, url_filter
from .common import read

# The rules of operator 10.
URL_RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]
TOXIC_FROM = 0.7  # fixed value: scores from here on are toxic
# Host names whose URLs make up the list of operator 10's query.
LISTED_SITES = ("adult-x", "casino-win", "cheap-pills", "spam-farm")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and unigram tokens of every document, over the pieces of the 32k vocabulary."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model")).drop("text")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as binary shards of 49k-vocabulary ids, every document looked up through the index."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return token_files.token_table(read(spark, sf_dir, "documents"), path, "words", end_id=2, vocabulary=49_408)


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents linked by Jaccard similarity 0.8 of their 5-word shingles."""
    return jaccard.jaccard_classes(read(spark, sf_dir, "documents"), percent=80, size=5)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in sequences of at most 2048 tokens."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack_documents(read(spark, sf_dir, "documents"), path, "spaced", end_id=0, length=2048)


def training_fold(doc_id="doc_id"):
    """Rows whose toxicity labels may be learnt from: crc32 of the doc_id as text, mod 3, is not 1."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 != 1


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document, learnt from two thirds of the labels."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(training_fold()))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    held_out = F.coalesce(~training_fold(), F.lit(False)).alias("held_out")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and the learned quality verdict of every document."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return quality.judge(docs.select("doc_id", "text"), quality.train(docs, labels)).drop("text")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against 10-word windows of the benchmark items."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.contaminated_words(docs, read(spark, sf_dir, "benchmark"), window=10).drop("text")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents on a ring of 24 shards with bounded loads."""
    return sharding.shard_documents(read(spark, sf_dir, "documents"), shards=24)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of all documents that a licence family claims."""
    return licenses.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))


def listed_urls(pages: DataFrame) -> DataFrame:
    """Canonical URLs of the pages on a listed site: the block list of operator 10's query."""
    host, path = url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url"))
    sites = "|".join(LISTED_SITES)
    return pages.where(host.rlike(rf"(^|\.)({sites})\.")).select(url_filter.canonical(host, path).alias("url"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL against the rules and the list of URLs on listed sites."""
    pages = read(spark, sf_dir, "pages")
    return url_filter.filter_urls(pages, listed_urls(pages), URL_RULES).drop("listed")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of every language's sources to each other, and the terms that each over-uses most."""
    return divergence.audit(read(spark, sf_dir, "documents"), least=10, ranks=10)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents, every 97th (by checksum) damaged first."""
    return spelling.variant_groups(read(spark, sf_dir, "documents"), every=97)


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the text they decode to, as digests."""
    path = public_tokenizers.path("word_bpe_49k.json")
    coded = bpe.encode(read(spark, sf_dir, "documents"), path, decoded=True)
    decimal = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(decimal, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op10_sql() -> str:
    fits = " UNION ALL ".join(
        f"SELECT '{verdict}' AS verdict, '{rule}' AS rule, '{rule.partition('/')[0]}' AS h, '/{rule.partition('/')[2]}' AS p"
        for verdict, rule in URL_RULES
    )
    sites = "|".join(LISTED_SITES)
    return f"""
WITH cut AS (
  SELECT page_id, row_number() OVER () AS k,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, k, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
canon AS (
  SELECT *, regexp_replace(host, '^(www|m)\\.', '') || regexp_replace(path, '(\\.html|/)$', '') AS url FROM parts),
listed AS (SELECT DISTINCT url FROM canon WHERE regexp_matches(host, '(^|\\.)({sites})\\.')),
rules AS ({fits}),
best AS (
  SELECT k, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM canon JOIN rules ON (host = h OR host LIKE '%.' || h) AND starts_with(path, p) GROUP BY k)
SELECT page_id, host, path, rule,
       coalesce(verdict, CASE WHEN host <> '' AND url IN (SELECT url FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
FROM canon LEFT JOIN best USING (k)"""


def op4_sql(documents: str = "documents") -> str:
    words = (
        "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
        "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    )
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS k, {words} AS w FROM {documents}),
b AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, {words} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, least(len(w), 10) AS m, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS t
  FROM b, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS r(i) WHERE len(w) > 0),
spot AS (
  SELECT k, m, i, array_to_string(w[i:i + m - 1], ' ') AS t
  FROM d, (SELECT DISTINCT m FROM win) AS sizes, unnest(range(1, len(w) - m + 2)) AS r(i)),
hit AS (SELECT k, i, m, item FROM spot JOIN win USING (m, t)),
words AS (SELECT k, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + m)) AS r(p) GROUP BY k),
found AS (SELECT k, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (k) LEFT JOIN found USING (k)"""


def op11_sql(documents: str = "documents") -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    share = "(1 + (1000000000::HUGEINT * ({c} + 2)) // ({n} + 2 * v))"
    differ = "((p - q) * (p - q)) // (p + q)"
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         unnest(regexp_extract_all({lower}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM {documents}),
grp AS (SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM {documents}),
kept AS (SELECT lang, term, count(*) AS whole FROM d GROUP BY lang, term HAVING count(DISTINCT k) >= 10),
langs AS (SELECT lang, count(*) AS v, sum(whole) AS n FROM kept GROUP BY lang),
cnt AS (SELECT lang, source, term, count(*) AS c FROM d SEMI JOIN kept USING (lang, term) GROUP BY ALL),
sums AS (SELECT g.lang, g.source, coalesce(sum(c), 0) AS n FROM grp g LEFT JOIN cnt USING (lang, source) GROUP BY ALL),
grid AS (
  SELECT s.lang, s.source, kept.term, coalesce(c, 0) AS c, {share.format(c="coalesce(c, 0)", n="s.n")} AS p,
         {share.format(c="whole", n="langs.n")} AS q
  FROM sums s JOIN kept USING (lang) JOIN langs USING (lang) LEFT JOIN cnt ON cnt.lang = s.lang AND cnt.source = s.source AND cnt.term = kept.term),
far AS (
  SELECT a.lang, a.source, b.source AS item, sum({differ.replace("p", "a.p").replace("q", "b.p")}) AS value
  FROM grid a JOIN grid b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, {differ} AS value FROM grid WHERE c > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_token_files": op2_token_files,
    "op3_toxicity": op3_toxicity,
    "op5_quality": op5_quality,
    "op4_decontamination": op4_decontamination,
    "op7_jaccard": op7_jaccard,
    "op8_packing": op8_packing,
    "op6_sharding": op6_sharding,
    "op9_licenses": op9_licenses,
    "op10_url_filter": op10_url_filter,
    "op11_divergence": op11_divergence,
    "op12_spelling": op12_spelling,
    "op13_bpe": op13_bpe,
}


def sql() -> dict[str, str]:
    return {"op4_decontamination": op4_sql(), "op10_url_filter": op10_sql(), "op11_divergence": op11_sql()}
