"""The contract queries of the numbered operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import merkle, ppm, runs, substrings
from .licenses import scan
from .materialise import materialise
from .packing import pack
from .simhash import near_duplicates
from .sketches import next_likeness
from .tiling import leaks
from .toxicity import score, train
from .urls import judge
from .warc import round_trip


OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
g AS (SELECT html, max(page_id) AS first FROM p WHERE n >= 1000 GROUP BY html)
SELECT page_id, n AS payload_bytes, sha1(p.html) AS payload_digest,
  CASE WHEN page_id < first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < first THEN first END AS refers_to
FROM p LEFT JOIN g ON g.html = p.html
"""


#: Host and pattern rules written out by hand, not taken from the operator.
OP7_SQL = r"""
WITH u AS (
  SELECT page_id, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low, coalesce(url, '') AS url,
    instr(coalesce(url, ''), '://') AS pos
  FROM pages
), r AS (
  SELECT page_id, low, CASE WHEN pos > 0 THEN regexp_extract(substr(url, pos + 3), '^[^?#]*') ELSE '' END AS rest,
    CASE WHEN pos > 0 THEN substr(low, pos + 3) END AS tail
  FROM u
), h AS (
  SELECT page_id, low, tail, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '/.*$') AS path
  FROM r
), j AS (
  SELECT *,
    CASE WHEN ('.' || host) LIKE '%.www.example.com' AND path LIKE '/en/%' THEN 'www.example.com/en/'
      WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/en/%' THEN 'example.com/en/'
      WHEN ('.' || host) LIKE '%.net' AND path LIKE '/es/%' THEN 'net/es/'
      WHEN ('.' || host) LIKE '%.net' AND path LIKE '/fr/%' THEN 'net/fr/'
      WHEN ('.' || host) LIKE '%.com' AND path LIKE '/%' THEN 'com/' END AS rule,
    CASE WHEN regexp_matches(tail, '^([^/?#]*\.)?www\.') THEN '@@||www.'
      WHEN regexp_matches(low, '[^a-z0-9.%_-]page=2([^a-z0-9.%_-]|$)') THEN '@@^page=2^'
      WHEN regexp_matches(tail, '^([^/?#]*\.)?blog\.') THEN '||blog.'
      WHEN regexp_matches(low, '[^a-z0-9.%_-]utm_source=feed([^a-z0-9.%_-]|$)') THEN '^utm_source=feed^'
      WHEN regexp_matches(tail, '^([^/?#]*\.)?m\..*/de/') THEN '||m.*/de/'
      WHEN regexp_matches(tail, '^([^/?#]*\.)?ads\.') THEN '||ads.'
      WHEN regexp_matches(low, '[^a-z0-9.%_-]track([^a-z0-9.%_-]|$)') THEN '^track^'
      WHEN regexp_matches(low, '[^a-z0-9.%_-]sponsored([^a-z0-9.%_-]|$)') THEN '^sponsored^' END AS hit
  FROM h
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN hit IS NULL OR hit LIKE '@@%' THEN 'allow' ELSE 'block' END AS verdict,
  CASE WHEN rule IS NULL THEN hit END AS pattern
FROM j
"""


#: Trees of runs of 8 level by level; numbers of a tree's nodes tell where it ends.
OP11_SQL = r"""
WITH RECURSIVE d AS (
  SELECT *, coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
      || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') AS head,
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
    xor(4294967295, list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda r, c:
      list_reduce(range(8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(r, c)), 4294967295::BIGINT)) AS crc
  FROM documents
), leaves AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS h,
    CASE WHEN crc % 3 = 0 THEN sha256(head || coalesce(octet_length(encode(low)) || ':' || low, '-')) END AS tampered
  FROM d
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM leaves
), up AS (
  SELECT tree, 0 AS level, pos, n, h FROM placed
  UNION ALL
  SELECT tree, level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY tree, level, pos // 8, n
), forest AS (
  SELECT 1000 AS level, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, count(*) OVER () AS n, h FROM up WHERE n = 1
  UNION ALL
  SELECT level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM forest WHERE n > 1 GROUP BY level, pos // 8, n
), subroots AS (
  SELECT tree, h AS subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS place FROM up WHERE n = 1
), nodes AS (
  SELECT tree, level, pos, n, h FROM up UNION ALL SELECT NULL, level, pos, n, h FROM forest
), parts AS (
  SELECT tree, level, pos,
    coalesce(string_agg(h, '') OVER (PARTITION BY tree, level, pos // 8 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
    coalesce(string_agg(h, '') OVER (PARTITION BY tree, level, pos // 8 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM nodes WHERE n > 1
), steps AS (
  SELECT l.tree, l.pos, p.level, p.before, p.after FROM placed l JOIN parts p ON p.tree = l.tree AND p.pos = l.pos // (8 ** p.level)::BIGINT
  UNION ALL
  SELECT l.tree, l.pos, p.level, p.before, p.after FROM placed l JOIN subroots s ON s.tree = l.tree
    JOIN parts p ON p.tree IS NULL AND p.pos = s.place // (8 ** (p.level - 1000))::BIGINT
), paths AS (
  SELECT tree, pos, list(before || '.' || after ORDER BY level) AS path FROM steps GROUP BY tree, pos
), folded AS (
  SELECT l.doc_id, l.h AS leaf, s.subroot, (SELECT h FROM forest WHERE n = 1) AS root, sha256(coalesce(replace(array_to_string(path, ''), '.', ''), '')) AS proof_sha256,
    list_reduce(coalesce(path, []), lambda x, p: sha256(split_part(p, '.', 1) || x || split_part(p, '.', 2)), coalesce(tampered, l.h)) AS folded_root
  FROM placed l JOIN subroots s ON s.tree = l.tree LEFT JOIN paths p ON p.tree = l.tree AND p.pos = l.pos
)
SELECT *, folded_root = root AS verified FROM folded
"""


#: Windows as texts, each with the smallest id that holds it.
OP12_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), p AS (
  SELECT doc_id, words, unnest(range(len(words))) AS i FROM w
), s AS (
  SELECT doc_id, i, words[i + 1] AS word, CASE WHEN i + 50 <= len(words) THEN array_to_string(words[i + 1 : i + 50], ' ') END AS win FROM p
), f AS (
  SELECT doc_id, i, word, coalesce(doc_id > min(doc_id) OVER (PARTITION BY win), FALSE) AND win IS NOT NULL AS hit FROM s
), c AS (
  SELECT doc_id, i, word, bool_or(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM f
), k AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept FROM c GROUP BY doc_id
)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON k.doc_id = w.doc_id
"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op2_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(_table(spark, sf_dir, "documents"))


def op3_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return next_likeness(_table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(_table(spark, sf_dir, "documents"))


def op6_materialise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(spark, _table(spark, sf_dir, "documents"))


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(_table(spark, sf_dir, "pages")).drop("candidates")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return score(docs, train(docs, _table(spark, sf_dir, "labels")))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = round_trip(_table(spark, sf_dir, "pages"))
    page = lambda c: F.regexp_extract(c, "^urn:page:(-?[0-9]+)$", 1).try_cast("long")
    return found.select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to_id").alias("refers_to")
    )


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, merkle.leaf(*(lower if f == "text" else F.col(f) for f in fields)))
    found = merkle.manifest(docs, fields, "lang", "doc_id", keep={"doc_id": F.col("doc_id"), "tampered": tampered})
    folded = merkle.fold(F.coalesce("tampered", "leaf"), F.col("places"), F.col("siblings")).alias("folded_root")
    rows = found.select("doc_id", "leaf", "subroot", "root", merkle.proof(F.col("siblings")).alias("proof_sha256"), folded)
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(_table(spark, sf_dir, "documents"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select("doc_id", "n_words", gone.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): of ids whose crc32 ends in 0 the words from a certain one on repeat with a certain period."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g, n = F.floor(h / 10), F.size("words")
    at = F.when((h % 10 == 0) & (n > 0), g % n).cast("int").alias("at")
    split = docs.select("doc_id", F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("words"))
    placed = split.select("doc_id", "words", at, (1 + F.floor((n - at) / (3 + g % 8))).cast("int").alias("every"))
    tail = F.transform(F.sequence(F.col("at"), F.size("words") - 1), lambda i: F.get("words", F.col("at") + (i - F.col("at")) % F.col("every")))
    edited = F.when(F.col("at").isNull(), F.col("words")).otherwise(F.concat(F.slice("words", 1, F.col("at")), tail))
    return placed.select("doc_id", F.array_join(edited, " ").alias("text"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find_runs(with_planted_runs(_table(spark, sf_dir, "documents")))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    best = [F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")]
    milli = F.expr("1000 * best.length div best.period").alias("exponent_milli")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *best, milli, F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")
    )


_QUERIES = (op1_simhash, op2_ppm, op3_sketches, op4_decontaminate, op5_licenses, op6_materialise, op7_urls, op8_toxicity, op9_warc, op10_packing, op11_merkle, op12_substrings, op13_runs)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    sql = {"op11_merkle": OP11_SQL, "op12_substrings": OP12_SQL, "op9_warc": OP9_SQL, "op7_urls": OP7_SQL, "pipeline": corpus_pipeline.ORACLE_SQL}
    return {k: v for k, v in sql.items() if v}
