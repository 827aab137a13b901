"""The registered queries of the corpus operators: production parameters, whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiforge.llm import conversation_repair, decontaminate, hard_negatives, language, line_dedup, mixing, ngram_join, quality, sharding, substring_dedup, suffix_dedup, topk_search, warc
from kpiforge.llm import repair_sql
from kpiforge.llm.common import table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = warc.read_chunks(warc.write(table(spark, sf_dir, "pages"), revisit_from=0), with_data=False)
    return chunks.filter("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.summary(table(spark, sf_dir, "documents"))


def op2_line_dedup_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.summary(table(spark, sf_dir, "documents"), per_chars=line_dedup.PER_CHARS)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents")).drop("kept_text")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = decontaminate.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return judged.drop("text_key")


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_components(table(spark, sf_dir, "documents"), k=4, percent=85)


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk_search.search(topk_search.build_index(vectors), vectors.filter("vec_id % 50 = 0"), k=5)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(table(spark, sf_dir, "documents"), shards=16)
    law, grown = F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return placed.select("doc_id", "size", "text_crc32", law, "shard", "slot", grown)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.predict(docs, language.fit(docs))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, moved)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(conversation_repair.damage(table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_line_dedup": op2_line_dedup,
    "op2_line_dedup_edits": op2_line_dedup_edits,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_source_mixing": op5_source_mixing,
    "op6_ngram_join": op6_ngram_join,
    "op7_exact_topk": op7_exact_topk,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_sharding": op9_sharding,
    "op10_language_id": op10_language_id,
    "op11_suffix_dedup": op11_suffix_dedup,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_conversation_repair": op13_conversation_repair,
}

#: Integer vectors as DuckDB lists: those that take part, and the inner products of two rows a and b.
_VECTORS = """list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)"""
_SCORE = "coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])), 0)::BIGINT"

SQL: dict[str, str] = {
    "op13_conversation_repair": repair_sql.SQL,
    # Base32 of a SHA-1: each five hex digits are four letters.
    "op1_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
f AS (SELECT h, min(page_id) AS head FROM p GROUP BY h)
SELECT p.page_id, strlen(p.h)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(x, (j // 4 * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * (j % 4))::INT) & 31)::INT + 1, 1)), '') AS payload_digest,
  CASE WHEN p.page_id = f.head THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN p.page_id <> f.head THEN f.head END AS refers_to
FROM p JOIN f USING (h)
""",
    "op7_exact_topk": f"""
WITH r AS (SELECT DISTINCT vec_id, {_VECTORS})
SELECT a.vec_id AS query_id, (row_number() OVER w)::INTEGER AS rank, b.vec_id, {_SCORE} AS score
FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
WINDOW w AS (PARTITION BY a.vec_id ORDER BY {_SCORE} DESC, b.vec_id)
QUALIFY row_number() OVER w <= 5
""",
    "op12_hard_negatives": f"""
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END::BIGINT AS label, {_VECTORS} AND label IS NOT NULL),
pair AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same, {_SCORE} AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
pos AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pair WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT pos.anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, n.vec_id AS negative_id, positive_score, n.score AS negative_score
FROM pos JOIN pair n ON n.anchor_id = pos.anchor_id AND NOT n.same AND 80 * positive_score <= 100 * n.score AND n.score <= positive_score
WINDOW w AS (PARTITION BY pos.anchor_id, positive_id ORDER BY n.score DESC, n.vec_id)
QUALIFY row_number() OVER w <= 5
""",
    # Near lines by halves and levenshtein: of two lines one edit apart a half of the shorter is untouched.
    "op2_line_dedup": """
WITH l AS (
  SELECT doc_id, i - 1 AS line_no, string_split(text, chr(10))[i] AS line
  FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(i)),
live AS (SELECT *, md5(line) AS h FROM l WHERE trim(line, ' ') <> ''),
firsts AS (SELECT h, any_value(line) AS line, min((doc_id, line_no)) AS place FROM live GROUP BY h),
sized AS (SELECT *, length(line)::INT AS n FROM firsts WHERE length(line) >= 16),
shorter AS (SELECT h, line, place, n AS m FROM sized),
longer AS (SELECT h, line, place, n, n AS m FROM sized UNION ALL SELECT h, line, place, n, n - 1 FROM sized),
near AS (
  SELECT a.place AS pa, a.h AS ha, b.place AS pb, b.h AS hb FROM shorter a JOIN longer b
    ON a.m = b.m AND substr(a.line, 1, a.m // 2) = substr(b.line, 1, a.m // 2)
    WHERE a.h <> b.h AND levenshtein(a.line, b.line) <= 1
  UNION
  SELECT a.place, a.h, b.place, b.h FROM shorter a JOIN longer b
    ON a.m = b.m AND substr(a.line, a.m // 2 + 1) = substr(b.line, b.n - (b.m - b.m // 2) + 1)
    WHERE a.h <> b.h AND levenshtein(a.line, b.line) <= 1),
gone AS (SELECT CASE WHEN pa < pb THEN hb ELSE ha END AS h FROM near),
stay AS (
  SELECT f.place[1] AS doc_id, f.place[2] AS line_no, f.h FROM firsts f
  WHERE f.h NOT IN (SELECT h FROM gone)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(h, chr(10) ORDER BY line_no) AS hs FROM stay GROUP BY doc_id),
counts AS (SELECT doc_id, count(*) AS n FROM live GROUP BY doc_id)
SELECT d.doc_id, coalesce(c.n, 0)::BIGINT AS n_lines, (coalesce(c.n, 0) - coalesce(k.n, 0))::BIGINT AS n_removed,
  sha256(coalesce(k.hs, '')) AS kept_sha256
FROM documents d LEFT JOIN counts c USING (doc_id) LEFT JOIN kept k USING (doc_id)
""",
    # Every pair of lines of like length, without segments.  DuckDB's levenshtein counts bytes, so the letters
    # beyond ASCII stand as control characters in it; there is room for 30 of them.
    "op2_line_dedup_edits": """
WITH l AS (
  SELECT doc_id, i - 1 AS line_no, string_split(text, chr(10))[i] AS line
  FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(i)),
live AS (SELECT *, md5(line) AS h FROM l WHERE trim(line, ' ') <> ''),
firsts AS (SELECT h, any_value(line) AS line, min((doc_id, line_no)) AS place FROM live GROUP BY h),
wide AS (SELECT coalesce(string_agg(DISTINCT c, ''), '') AS cs FROM (SELECT unnest(regexp_extract_all(line, '[^\\x00-\\x7F]')) AS c FROM firsts)),
thin AS (SELECT cs, substr((SELECT string_agg(chr(i::INT), '' ORDER BY i) FROM range(1, 32) AS r(i) WHERE i <> 10), 1, length(cs)) AS ts FROM wide),
sized AS (SELECT h, place, translate(line, cs, ts) AS line, length(line)::INT AS n, greatest(1, length(line) // 50)::INT AS k FROM firsts, thin WHERE length(line) >= 16),
gaps AS (SELECT *, unnest(range(0, k + 1))::INT AS gap FROM sized),
gone AS (
  SELECT CASE WHEN a.place < b.place THEN b.h ELSE a.h END AS h FROM gaps a JOIN sized b ON a.n + a.gap = b.n
  WHERE a.h <> b.h AND levenshtein(a.line, b.line) <= a.k),
stay AS (
  SELECT f.place[1] AS doc_id, f.place[2] AS line_no, f.h FROM firsts f
  WHERE f.h NOT IN (SELECT h FROM gone)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(h, chr(10) ORDER BY line_no) AS hs FROM stay GROUP BY doc_id),
counts AS (SELECT doc_id, count(*) AS n FROM live GROUP BY doc_id)
SELECT d.doc_id, coalesce(c.n, 0)::BIGINT AS n_lines, (coalesce(c.n, 0) - coalesce(k.n, 0))::BIGINT AS n_removed,
  sha256(coalesce(k.hs, '')) AS kept_sha256
FROM documents d LEFT JOIN counts c USING (doc_id) LEFT JOIN kept k USING (doc_id)
""",
}
