"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from trailforge.llm import bpe, conversations, fingerprints, line_dedup, merkle, mixing, near_text, near_vectors, quality, sharding, token_files, toxicity, url_filter
from trailforge.llm.common import small_batches, table, written


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return table(spark, sf_dir, "documents")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_text.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), table(spark, sf_dir, "labels")
    model = toxicity.character_model(docs)
    learned = toxicity.train(docs, labels.where(~held_out()), model)
    scored = toxicity.score(docs.select("doc_id", "text"), model, learned)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = bpe.encode_docs(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs.select("doc_id", "text"), model).select("doc_id", *quality.COLUMNS, "base_failed", "kept")


URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge(table(spark, sf_dir, "pages"), rules)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(documents(spark, sf_dir))
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, files = token_files.write_token_files(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_token_files(folder, files, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.drop_frequent_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``n_near``: for documents whose id 100 divides, the others within six bits of the fingerprint."""
    found = written(fingerprints.edited(documents(spark, sf_dir)), "edited")
    asks = F.col("doc_id") % 100 == 0
    near = fingerprints.within(found, asks).select(F.col("fp").alias("_fp"), (F.col("n") - 1).alias("_n"))
    asked = found.where(asks).join(near, F.col("fp") == F.col("_fp"), "left").drop("_fp")
    rows = asked.unionByName(found.where(~F.coalesce(asks, F.lit(False))).withColumn("_n", F.lit(None).cast("bigint")))
    hexed = lambda c: F.lower(F.hex(c))
    return rows.select("doc_id", "n_chars", "edited_sha256", hexed("fp").alias("fingerprint"), hexed("edited_fp").alias("edited_fingerprint"), "near_edited", "near_next", F.col("_n").alias("n_near"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    counts, edits = conversations.repair(conversations.damaged(rows))
    found = counts.join(conversations.digests(edits).withColumnRenamed("conv_id", "_conv"), F.col("conv_id").eqNullSafe(F.col("_conv"))).withColumnRenamed("conv_id", "_own").drop("_conv")
    every = rows.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("_own")), "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.document_proofs(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_simhash_near_dedup, op2_toxicity, op3_byte_bpe, op4_sharding, op5_quality_rules, op6_url_filter, op7_mixing, op8_token_files, op9_embedding_near_dedup, op10_line_dedup, op11_fingerprints, op12_conversation_repair, op13_merkle_manifest)}

OP10_SQL = r"""
WITH lines AS (
  SELECT doc_id, r, pos, line, lower_az AS key FROM (
    SELECT doc_id, r, pos, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az
    FROM (SELECT doc_id, row_number() OVER () AS r, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                 generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents))),
frequent AS (SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (key IN (SELECT key FROM frequent)) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (key NOT IN (SELECT key FROM frequent)), '')) AS kept_sha256
FROM lines GROUP BY doc_id, r
"""

OP6_SQL = r"""
WITH cut AS (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path, row_number() OVER () AS r FROM cut),
rules(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits AS (
  SELECT r, h || p AS rule, v, row_number() OVER (PARTITION BY r ORDER BY length(h || p) DESC, length(h) DESC) AS k
  FROM parts JOIN rules ON (host = h OR suffix(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM parts LEFT JOIN fits ON parts.r = fits.r AND k = 1
"""

def _crc32(text: str) -> str:
    """SQL for the crc32 of an ASCII text, bit by bit."""
    byte = f"list_transform(range(1, length({text}) + 1), lambda i: ascii(substr({text}, i, 1))::BIGINT)"
    bits = "list_reduce(range(0, 8), lambda d, k: xor(d >> 1, 3988292384 * (d & 1)), xor(c, b))"
    return f"xor(list_reduce({byte}, lambda c, b: {bits}, 4294967295::BIGINT), 4294967295::BIGINT)"


OP13_SQL = f"""
WITH RECURSIVE enc AS (
  SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
         || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
leaves AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         CASE WHEN {_crc32("doc_id::VARCHAR")} % 5 = 0 THEN sha256(head || coalesce(strlen(low) || ':' || low, '-')) END AS tampered FROM enc),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n,
         dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g FROM leaves),
tree AS (
  SELECT g, 0 AS level, pos, n, leaf AS digest FROM placed
  UNION ALL SELECT g, any_value(level) + 1, pos // 16, any_value((n + 15) // 16), sha256(string_agg(digest, '' ORDER BY pos)) FROM tree WHERE n > 1 GROUP BY g, pos // 16),
subroots AS (SELECT g, digest AS subroot, count(*) OVER () AS n FROM tree WHERE n = 1),
top AS (
  SELECT 0 AS level, g AS pos, n, subroot AS digest FROM subroots
  UNION ALL SELECT any_value(level) + 1, pos // 16, any_value((n + 15) // 16), sha256(string_agg(digest, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY pos // 16),
own AS (
  SELECT p.g, p.pos, t.level, string_agg(t.digest, '' ORDER BY t.pos) FILTER (t.pos < (p.pos >> (4 * t.level))) AS l, string_agg(t.digest, '' ORDER BY t.pos) FILTER (t.pos > (p.pos >> (4 * t.level))) AS r
  FROM placed p JOIN tree t ON t.g = p.g AND t.n > 1 AND t.pos // 16 = p.pos >> (4 * t.level + 4) GROUP BY p.g, p.pos, t.level),
further AS (
  SELECT s.g, t.level, string_agg(t.digest, '' ORDER BY t.pos) FILTER (t.pos < (s.g >> (4 * t.level))) AS l, string_agg(t.digest, '' ORDER BY t.pos) FILTER (t.pos > (s.g >> (4 * t.level))) AS r
  FROM subroots s JOIN top t ON t.n > 1 AND t.pos // 16 = s.g >> (4 * t.level + 4) GROUP BY s.g, t.level),
steps AS (
  SELECT g, pos, list({{'l': coalesce(l, ''), 'r': coalesce(r, '')}} ORDER BY k) AS s FROM (
    SELECT g, pos, level AS k, l, r FROM own UNION ALL SELECT p.g, p.pos, 1000 + f.level, f.l, f.r FROM placed p JOIN further f USING (g)) GROUP BY g, pos),
folded AS (
  SELECT p.g, p.pos, coalesce(tampered, leaf) AS digest, coalesce(s, []) AS s FROM placed p LEFT JOIN steps USING (g, pos)
  UNION ALL SELECT g, pos, sha256(s[1].l || digest || s[1].r), s[2:] FROM folded WHERE len(s) > 0)
SELECT p.doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(s.s, lambda x: x.l || x.r), ''), '')) AS proof_sha256, f.digest AS folded_root, f.digest = root AS verified
FROM placed p JOIN subroots USING (g) CROSS JOIN (SELECT digest AS root FROM top WHERE n = 1) JOIN folded f ON f.g = p.g AND f.pos = p.pos AND len(f.s) = 0 LEFT JOIN steps s ON s.g = p.g AND s.pos = p.pos
"""

OP12_SQL = rf"""
WITH RECURSIVE hit AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS c FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE WHEN c = 4 THEN 'user' ELSE role END AS role, CASE c WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN c = 3 THEN 2 ELSE 1 END)) AS copy FROM hit WHERE c <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged),
faults AS (
  SELECT *, CASE WHEN core = '' THEN 2 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 3 WHEN right(core, 1) NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS fault,
         substr(role, 1, 1) AS r, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS b, count(*) OVER (PARTITION BY conv_id) AS n
  FROM (SELECT *, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS core FROM placed)),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 2) AS blank, count(*) FILTER (fault = 3) AS duplicate, count(*) FILTER (fault = 1) AS truncated,
         count(*) FILTER (b IS NOT NULL AND b || r NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv_id),
ins(st, k, run, onto) AS (VALUES ('', 0, '', ''), ('', 1, 'I', 'u'), ('', 2, 'II', 'a'), ('s', 0, '', 's'), ('s', 1, 'I', 'u'), ('s', 2, 'II', 'a'), ('u', 0, '', 'u'), ('u', 1, 'I', 'a'), ('a', 0, '', 'a'), ('a', 1, 'I', 'u')),
lines AS (SELECT st, k, run, onto, CASE run WHEN '' THEN '' WHEN 'I' THEN CASE onto WHEN 'u' THEN chr(10) || 'user:' ELSE chr(10) || 'assistant:' END ELSE chr(10) || 'user:' || chr(10) || 'assistant:' END AS more FROM ins),
acts(e) AS (VALUES ('D'), ('K'), ('R')),
path AS (
  SELECT conv_id, 0::BIGINT AS i, max(n) AS n, '' AS st, 0::BIGINT AS cost, '' AS audit, '' AS lines FROM faults GROUP BY conv_id
  UNION ALL
  SELECT conv_id, i, n, st, cost, audit, lines FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id, st ORDER BY cost, audit) AS best FROM (
      SELECT p.conv_id, f.i, p.n, CASE e WHEN 'D' THEN onto WHEN 'K' THEN r WHEN 'R' THEN CASE onto WHEN 'u' THEN 'a' ELSE 'u' END END AS st,
             p.cost + 2 * k + CASE e WHEN 'D' THEN 3 WHEN 'K' THEN fault ELSE 2 + fault END AS cost, p.audit || run || e AS audit,
             p.lines || more || CASE e WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || role || ':' || text ELSE chr(10) || CASE onto WHEN 'u' THEN 'assistant' ELSE 'user' END || ':' || text END AS lines
      FROM path p JOIN faults f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1 JOIN lines l ON l.st = p.st CROSS JOIN acts
      WHERE e = 'D' OR fault < 2 AND (e = 'R' OR r = 's' AND onto = '' OR r = 'u' AND onto <> 'u' OR r = 'a' AND onto = 'u'))) WHERE best = 1),
ended AS (
  SELECT conv_id, cost + 2 * k AS cost, audit || run AS audit, lines || more AS lines FROM path JOIN lines l USING (st) WHERE i = n AND onto IN ('', 'a')
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY cost + 2 * k, audit || run) = 1)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(substr(coalesce(lines, ''), 2)) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""

ORACLES = {"op6_url_filter": OP6_SQL, "op10_line_dedup": OP10_SQL, "op12_conversation_repair": OP12_SQL, "op13_merkle_manifest": OP13_SQL}
