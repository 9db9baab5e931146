"""The registered queries of this subpackage, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, decontaminate, langid, line_dedup, packing, resampling, secrets, sharding, simhash, token_file, topk, toxicity, url_filter
from .common import fold, table, texts

URL_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(texts(spark, sf_dir))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.judge(texts(spark, sf_dir), table(spark, sf_dir, "benchmark"), ["doc_id"])


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir)
    model = langid.fit(docs.where(fold() != 0).select("doc_id", "text", "lang"))
    out = langid.identify(docs, model, ["doc_id"])
    return out.select("doc_id", (fold() == 0).alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_dropped").cast("long").alias("n_dropped"), F.length("text").cast("long").alias("n_chars_kept"), F.sha2("text", 256).alias("kept_sha256"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(texts(spark, sf_dir))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir).select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.letter_model(docs)
    classifier = toxicity.fit(toxicity.labelled(docs.where(fold() != 0), labels), model)
    out = toxicity.judge(docs, model, classifier, ["doc_id"])
    return out.select("doc_id", (fold() == 0).alias("held_out"), "score", "predicted")


def op9_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file.round_trip(texts(spark, sf_dir).select("doc_id", "text"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.URLFilter(URL_RULES).judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversations.repaired(conversations.damaged(rows), rows)


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return out.select("doc_id", "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(texts(spark, sf_dir).select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def queries() -> dict:
    every = (
        op1_simhash, op2_topk, op3_decontaminate, op4_langid, op5_line_dedup, op6_packing, op7_secrets, op8_toxicity, op9_token_file, op10_url_filter,
        op11_conversations, op12_sharding, op13_resampling,
    )
    return {f.__name__: f for f in every}


OP10_SQL = r"""
WITH parts AS (
  SELECT page_id, coalesce(contains(url, '://'), false) AS has, substr(url, strpos(url, '://') + 3) AS rest FROM pages
), hosts AS (
  SELECT page_id, has, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM parts
), split AS (
  SELECT page_id,
         CASE WHEN has THEN translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN has THEN regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') ELSE '' END AS path
  FROM hosts
), rules(rule_host, rule_path, rule, verdict) AS (
  VALUES ('com', '/', 'com/', 'allow'), ('example.com', '/en/', 'example.com/en/', 'block'),
         ('www.example.com', '/en/', 'www.example.com/en/', 'allow'), ('net', '/es/', 'net/es/', 'block'), ('net', '/fr/', 'net/fr/', 'block')
), fits AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM split JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id
)
SELECT s.page_id, s.host, s.path, f.rule, coalesce(f.verdict, 'allow') AS verdict FROM split s LEFT JOIN fits f USING (page_id)
"""


OP3_SQL = r"""
WITH dl AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), il AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, len(w) AS n, unnest(list_transform(range(1, greatest(len(w) - 12, 1) + 1), lambda i: array_to_string(w[i:i + least(len(w), 13) - 1], ' '))) AS win, least(len(w), 13) AS size
  FROM il WHERE len(w) > 0
), sizes AS (
  SELECT DISTINCT size FROM windows
), grams AS (
  SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS p, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS win
  FROM dl, sizes WHERE len(w) >= size
), hits AS (
  SELECT g.doc_id, g.p, g.size, w.item_id FROM grams g JOIN windows w ON g.win = w.win AND g.size = w.size
), covered AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + size)) AS q FROM (SELECT DISTINCT doc_id, p, size FROM hits)) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(len(d.w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * n_hit >= coalesce(len(d.w), 0) AS contaminated
FROM dl d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM pairs
)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 10
"""


#: crc32 of a text's UTF-8 bytes, a bit at a time.
CRC32 = r"""xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(range(0, CAST(length(hex(encode({x}))) / 2 AS BIGINT)), lambda i: CAST('0x' || substr(hex(encode({x})), CAST(2 * i + 1 AS INT), 2) AS BIGINT)),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END)))"""

OP11_SQL = (
    r"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations
), coded AS (
  SELECT k, CRC AS crc FROM (SELECT DISTINCT k FROM named)
), hit AS (
  SELECT n.conv_id, turn, CASE WHEN crc % 20 = 4 THEN 'user' ELSE role END AS role,
         CASE crc % 20 WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE crc % 20 WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM named n JOIN coded USING (k)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS tail, role[1] AS initial FROM hit
), judged AS (
  SELECT *, CASE WHEN tail = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate' WHEN tail NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) AS before
  FROM placed
), totals AS (
  SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS n
  FROM judged GROUP BY conv_id
), inserts(a, b, spent, said, lines) AS (
  VALUES (0, 0, 0, '', ''), (0, 2, 3, 'I', E'\nuser:'), (0, 3, 6, 'II', E'\nuser:\nassistant:'), (1, 1, 0, '', ''), (1, 2, 3, 'I', E'\nuser:'), (1, 3, 6, 'II', E'\nuser:\nassistant:'),
         (2, 2, 0, '', ''), (2, 3, 3, 'I', E'\nassistant:'), (3, 3, 0, '', ''), (3, 2, 3, 'I', E'\nuser:')
), edits(b, edit, asked, c, new_role, cost) AS (
  VALUES (0, 'D', '', 0, '', 4), (1, 'D', '', 1, '', 4), (2, 'D', '', 2, '', 4), (3, 'D', '', 3, '', 4), (0, 'R', '', 2, 'user', 3), (1, 'R', '', 2, 'user', 3), (3, 'R', '', 2, 'user', 3), (2, 'R', '', 3, 'assistant', 3),
         (0, 'K', 's', 1, '', 0), (0, 'K', 'u', 2, '', 0), (1, 'K', 'u', 2, '', 0), (3, 'K', 'u', 2, '', 0), (2, 'K', 'a', 3, '', 0)
), ways AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS pos, 0 AS state, {'cost': 0, 'audit': '', 'lines': ''} AS best FROM totals
  UNION ALL
  SELECT w.conv_id, w.pos + 1, e.c, min({'cost': w.best.cost + i.spent + e.cost + CASE WHEN e.edit <> 'D' AND j.fault = 'truncated' THEN 3 ELSE 0 END, 'audit': w.best.audit || i.said || e.edit,
         'lines': w.best.lines || i.lines || CASE e.edit WHEN 'D' THEN '' WHEN 'R' THEN E'\n' || e.new_role || ':' || j.text ELSE E'\n' || j.role || ':' || j.text END})
  FROM ways w JOIN judged j ON w.conv_id IS NOT DISTINCT FROM j.conv_id AND j.pos = w.pos + 1 JOIN inserts i ON i.a = w.state
       JOIN edits e ON e.b = i.b AND (e.edit = 'D' OR j.fault NOT IN ('blank', 'duplicate')) AND (e.edit <> 'K' OR e.asked = j.initial)
  GROUP BY w.conv_id, w.pos, e.c
), ended AS (
  SELECT w.conv_id, min({'cost': w.best.cost + i.spent, 'audit': w.best.audit || i.said, 'lines': w.best.lines || i.lines}) AS best
  FROM ways w JOIN totals t ON w.conv_id IS NOT DISTINCT FROM t.conv_id AND w.pos = t.n JOIN inserts i ON i.a = w.state AND (i.b = 3 OR (w.state = 0 AND i.b = 0))
  GROUP BY w.conv_id
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(best.cost, 0) AS BIGINT) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(substr(best.lines, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN totals t ON c.conv_id IS NOT DISTINCT FROM t.conv_id LEFT JOIN ended e ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""
).replace("CRC AS", CRC32.format(x="k") + " AS")

OP13_SQL = (
    r"""
WITH listed AS (
  SELECT 'd' AS side, doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 'b', NULL, row_number() OVER (), regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), counted AS (
  SELECT side, r, word, count(*) AS n FROM (SELECT side, r, unnest(w) AS word FROM listed) GROUP BY ALL
), coded AS (
  SELECT word, CRC % 10000 AS bucket FROM (SELECT DISTINCT word FROM counted)
), held AS (
  SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0) AS s, coalesce(sum(n) FILTER (side = 'b'), 0) AS t FROM counted JOIN coded USING (word) GROUP BY bucket
), sums AS (
  SELECT coalesce(sum(s), 0) AS big_s, coalesce(sum(t), 0) AS big_t FROM held
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln((t + 1)::DOUBLE * (big_s + 10000)::DOUBLE / ((s + 1)::DOUBLE * (big_t + 10000)::DOUBLE))) AS BIGINT) AS gain FROM held, sums
), weighed AS (
  SELECT r, CAST(sum(n) AS BIGINT) AS n_features, CAST(floor(sum(n * gain)::DOUBLE / sum(n)) AS BIGINT) AS weight FROM counted JOIN coded USING (word) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY r
), scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM listed l LEFT JOIN weighed w USING (r) WHERE l.side = 'd'
), able AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_features >= 20
)
SELECT s.doc_id, s.n_features, s.weight, s.score, CASE WHEN a.rank <= (SELECT (10 * count(*)) // 100 FROM able) THEN a.rank END AS rank FROM scored s LEFT JOIN able a USING (doc_id)
"""
).replace("CRC %", CRC32.format(x="word") + " %")


def oracle_sql() -> dict[str, str]:
    return {"op2_topk": OP2_SQL, "op3_decontaminate": OP3_SQL, "op10_url_filter": OP10_SQL, "op11_conversations": OP11_SQL, "op13_resampling": OP13_SQL}
