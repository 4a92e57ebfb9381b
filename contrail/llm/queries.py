"""One query per operator over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .conversations import damaged, digests, repair
from .exact_dedup import exact_dedup
from .jaccard import near_duplicates
from .language import dictionaries, held_out, identify
from .licenses import license_scan
from .line_dedup import line_dedup
from .middle import fill_in_middle, restore
from .mixing import mix_sources
from .pieces import encode_documents, load
from .sharding import ring_shards
from .token_counts import count_tokens, ranks
from .topk import topk
from .url_filter import url_verdicts

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op1_token_counts(spark: SparkSession, folder: str, ranks_path: str = RANKS) -> DataFrame:
    """Tokens of every document, attributed to its lines by their first character."""
    return count_tokens(table(spark, folder, "documents"), ranks(ranks_path), F.col("text"))


def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = line_dedup(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


def op3_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    return topk(rows, rows.where(F.col("vec_id") % 100 == 0))


def op4_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan(table(spark, folder, "documents")).drop("spans", "expressions")


def op5_sentencepiece(spark: SparkSession, folder: str, model_path: str = PIECES) -> DataFrame:
    """Every document's pieces as a digest, and whether they decode to its text."""
    done = encode_documents(table(spark, folder, "documents"), load(model_path))
    return done.select("doc_id", "n_tokens", F.sha2(F.array_join("tokens", " "), 256).alias("tokens_sha256"), "round_trip")


def op6_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mix_sources(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    return url_verdicts(table(spark, folder, "pages"), rules)


def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return identify(docs, dictionaries(docs.where(~held_out(F.col("doc_id")))))


def op9_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))


def op10_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup(table(spark, folder, "documents"))


def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Cheapest repair of damaged conversations: a row for every conversation, those that lost all rows too."""
    given = table(spark, folder, "conversations")
    done = repair(damaged(given))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    said = [F.struct("conv_id").alias("_k"), "*"]
    every = given.select("conv_id").distinct().select(*said)
    out = every.join(done.summary.select(*said).drop("conv_id"), "_k", "left").join(digests(done.rows).select(*said).drop("conv_id"), "_k", "left")
    return out.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op12_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as an example with its middle last, by digest, and the text rebuilt from it."""
    made = fill_in_middle(table(spark, folder, "documents"))
    return made.select(
        "doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"))


def op13_ring_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's place in 40 shards, exactly full: bounded loads without slack."""
    placed = ring_shards(table(spark, folder, "documents"), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("home").alias("home_shard"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_token_counts, op2_line_dedup, op3_exact_topk, op4_license_scan, op5_sentencepiece, op6_mix_sources, op7_url_filter, op8_language_id, op9_jaccard_join, op10_exact_dedup,
    op11_conversation_repair, op12_fill_in_middle, op13_ring_shards)}

_SPACES = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOW = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

ORACLE: dict[str, str] = {
    "op2_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (SELECT doc_id, pos, line, translate(trim(line, {_SPACES}), {_LOW}) AS key FROM lines),
shared AS (SELECT key, min(doc_id) AS keeper FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
judged AS (SELECT k.doc_id, k.pos, k.line, s.key IS NOT NULL AND k.doc_id <> s.keeper AS gone FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id""",
    "op3_exact_topk": """
WITH v AS (
  SELECT vec_id, [floor(1024 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10""",
    "op6_mix_sources": r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    coalesce(len(regexp_extract_all(text, '[#$%&*|!]+')), 0)::BIGINT AS marks,
    (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM documents),
k AS (SELECT *, -ln(u) / greatest(0.1, CASE WHEN size > 0 THEN 1 - marks::DOUBLE / size ELSE 1.0 END) AS key FROM d),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INTEGER]::DOUBLE AS w
  FROM k GROUP BY source),
f AS (
  SELECT *, source_size::DOUBLE * 2 AS cap, sum(source_size) OVER ()::DOUBLE * 1.5 AS total, sum(w) OVER () AS all_w,
    sum(source_size::DOUBLE * 2) OVER by_fill AS full_caps, sum(w) OVER () - sum(w) OVER by_fill AS rest
  FROM s WINDOW by_fill AS (ORDER BY source_size::DOUBLE * 2 / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
t AS (
  SELECT source, source_size, least(cap, w * greatest(total / all_w, max(CASE WHEN rest > 0 THEN (total - full_caps) / rest END) OVER ())) AS target FROM f),
g AS (SELECT *, floor(target)::BIGINT AS spent, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS epochs FROM t),
p AS (
  SELECT k.doc_id, k.size, g.source_size, g.target, g.epochs, g.spent - g.epochs * g.source_size AS budget,
    coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id NULLS LAST, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM k JOIN g ON k.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, budget - before)))::BIGINT AS taken FROM p""",
    "op7_url_filter": r"""
WITH rules(rhost, rpath, action) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
p AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
fits AS (
  SELECT page_id, rhost || rpath AS rule, action, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC) AS place
  FROM p JOIN rules ON (host = rhost OR suffix(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT p.page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM p LEFT JOIN fits ON fits.page_id = p.page_id AND place = 1""",
    "op10_exact_dedup": f"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS chars, translate(coalesce(text, ''), {_SPACES}, '') AS norm FROM documents),
g AS (SELECT *, sha256(norm) AS text_sha256 FROM n)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size, row_number() OVER w = 1 AS kept, text_sha256
FROM g WINDOW w AS (PARTITION BY norm ORDER BY chars DESC, doc_id)""",
    "op12_fill_in_middle": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
h AS (SELECT *, ('0x' || substr(x, 1, 8))::BIGINT AS h1, ('0x' || substr(x, 9, 8))::BIGINT AS h2, ('0x' || substr(x, 17, 8))::BIGINT AS h3, ('0x' || substr(x, 25, 8))::BIGINT AS h4 FROM d),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE t END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p""",
}
