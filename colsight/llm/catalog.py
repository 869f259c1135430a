"""The registered queries of the operators, with production parameters, and their SQL where it can express them."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colsight.llm.common import table
from colsight.llm.decontaminate import decontaminate
from colsight.llm.katz import score_texts
from colsight.llm.mixing import mix_sources
from colsight.llm.periodic import collapse_runs
from colsight.llm.prefix_free import cut_repeated_bytes
from colsight.llm.quality import judge_quality
from colsight.llm.secrets import scan_secrets
from colsight.llm.simhash import near_duplicates
from colsight.llm.spelling import spelling_variants
from colsight.llm.substring_dedup import cut_repeated_words
from colsight.llm.token_counts import count_tokens
from colsight.llm.url_filter import ALLOW, BLOCK, GlobRule, HostRule, filter_urls
from colsight.llm.warc import read_archives, write_archives
from colsight.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its own name, with the SQL that must give the same rows."""
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql.strip()
        return function

    return register


@query()
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts with a cache of this run's own, so that all distinct texts are encoded."""
    import public_tokenizers

    return count_tokens(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), scratch_path(spark, "token-cache")
    )


@query()
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_repeated_bytes(table(spark, sf_dir, "documents"))


HOST_RULES = (
    HostRule(ALLOW, "org"), HostRule(BLOCK, "example.org", "/es/"), HostRule(BLOCK, "example.org", "/en/1"),
    HostRule(ALLOW, "com", "/fr/"), HostRule(BLOCK, "com", "/de/"),
)

#: Host names of shops, gambling, adult pages, advertising and link farms.
GLOB_RULES = tuple(
    GlobRule(BLOCK, f"*{part}*{tail}")
    for part in ("adult-", "casino", "-pills", "-bets", "ads-", "spam-") for tail in ("", "/**")
)

_URL_RULES = "('org/', 'allow'), ('example.org/es/', 'block'), ('example.org/en/1', 'block'), ('com/fr/', 'allow'), ('com/de/', 'block')"


@query(f"""
WITH rules AS (
  SELECT r AS rule, v AS verdict, substr(r, 1, instr(r, '/') - 1) AS rh, substr(r, instr(r, '/')) AS rp
  FROM (VALUES {_URL_RULES}) t(r, v)),
cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
best AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM parts JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT p.page_id, p.host, p.path, b.rule,
       coalesce(b.verdict, CASE WHEN regexp_matches(p.host, 'adult-|casino|-pills|-bets|ads-|spam-')
                                THEN 'block' ELSE 'allow' END) AS verdict
FROM parts p LEFT JOIN best b USING (page_id)""")
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), HOST_RULES, GLOB_RULES)


@query(r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
grams AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM item WHERE len(w) > 0)),
spots AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, (SELECT DISTINCT n FROM grams))),
hits AS (SELECT doc_id, i, n, item_id FROM spots JOIN grams USING (n, gram)),
words AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit
          FROM (SELECT doc_id, i, unnest(range(0, n)) AS k FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""")
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.expr("aggregate(zip_with(hit_to, hit_from, (t, f) -> t - f), 0L, (n, x) -> n + x)")
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


@query()
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query(r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
spots AS (
  SELECT doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS gram
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM doc)),
gone AS (
  SELECT DISTINCT doc_id, i + k AS i
  FROM (SELECT doc_id, i, unnest(range(0, 50)) AS k
        FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY gram) AS least FROM spots) WHERE doc_id > least)),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM doc),
kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS text, count(*) AS n
  FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM doc LEFT JOIN kept USING (doc_id)""")
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_repeated_words(table(spark, sf_dir, "documents"))


@query()
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


@query()
def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"), judged="judged")
    name = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.filter("spans", lambda s: s["kind"] != "learned")

    def number(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", number("assign"), number("access"), number("hex"), number("learned"),
        F.sha2(F.array_join(F.transform(base, name), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", name), ",").alias("spans"), "judged",
    )


@query()
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


@query("""
WITH page AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
best AS (SELECT *, max(page_id) OVER (PARTITION BY d, n) AS largest FROM page)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 1000 AND page_id < largest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id < largest THEN largest END AS refers_to
FROM best""")
def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages to archives below the shared folder and reads them back."""
    manifest = write_archives(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    return read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def with_planted_runs(documents: DataFrame) -> DataFrame:
    """``documents`` (doc_id, text), some of whose texts repeat a stretch of their own words up to their end."""
    rows = documents.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    chosen = rows.withColumn("words", F.when((F.col("h") % 10 == 0) & F.col("text").isNotNull(), words))
    n = F.size("words")
    sized = chosen.withColumn("a", F.when(n > 0, F.floor(F.col("h") / 10) % n).cast("int"))
    g, left = F.floor(F.col("h") / 10), F.size("words") - F.col("a")
    p = (1 + F.floor(left / (3 + g % 8))).cast("int")
    periods = F.array_repeat(F.slice("words", F.col("a") + 1, p), F.ceil(left / p).cast("int"))
    planted = F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(F.flatten(periods), F.lit(1), left))
    return sized.select("doc_id", F.when(F.col("a").isNull(), F.col("text")).otherwise(F.concat_ws(" ", planted)).alias("text"))


@query()
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collapse_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    order = F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"], r["start"], r["period"]))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", F.array_max(order)).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"),
        F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def dropped_letter(doc_id: int | None, run: str) -> str:
    """``run`` without one code point where a checksum of it and its document says so; a null id changes nothing."""
    h = zlib.crc32(f"{doc_id}:{run}".encode()) if doc_id is not None else 1
    return run if h % 31 else run[:h % len(run)] + run[h % len(run) + 1:]


@query()
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"), change=dropped_letter)
