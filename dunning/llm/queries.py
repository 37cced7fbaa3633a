"""Registered queries of the training-data operators, with production parameters
over their whole tables, and the DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import embedding_dedup, minhash_dedup
from .common import read
from .compression_quality import quality
from .decontamination import overlaps
from .exact_dedup import exact_dedup
from .lm_score import score
from .packing import pack
from .piece_sampling import encode
from .ranked_search import search
from .suffix_dedup import remove_repeats
from .transcripts import chat_turns
from .turn_repair import damaged, repair
from .url_filter import filter_urls


def op1_embedding_dedup(spark, sf_dir):
    return embedding_dedup.near_duplicates(read(spark, sf_dir, "embeddings"))


def op2_exact_dedup(spark, sf_dir):
    return exact_dedup(read(spark, sf_dir, "documents"))


def op4_compression_quality(spark, sf_dir):
    return quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_chat_format(spark, sf_dir):
    return chat_turns(read(spark, sf_dir, "conversations"))


def op6_piece_sampling(spark, sf_dir):
    return encode(read(spark, sf_dir, "documents"))


#: The rules that op7 judges by.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op7_url_filter(spark, sf_dir):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return filter_urls(read(spark, sf_dir, "pages"), rules)


def op8_packing(spark, sf_dir):
    return pack(read(spark, sf_dir, "documents"))


def op9_minhash_dedup(spark, sf_dir):
    return minhash_dedup.near_duplicates(read(spark, sf_dir, "documents"), words=2).drop("keeper", "th")


def op3_suffix_dedup(spark, sf_dir):
    return remove_repeats(read(spark, sf_dir, "documents"))


def op10_lm_score(spark, sf_dir):
    return score(read(spark, sf_dir, "documents"))


def op11_turn_repair(spark, sf_dir):
    return repair(damaged(read(spark, sf_dir, "conversations")))


def op12_ranked_search(spark, sf_dir):
    return search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("item_th")


def op13_decontamination(spark, sf_dir):
    found = overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


QUERIES = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_compression_quality": op4_compression_quality,
    "op5_chat_format": op5_chat_format,
    "op6_piece_sampling": op6_piece_sampling,
    "op7_url_filter": op7_url_filter,
    "op8_packing": op8_packing,
    "op9_minhash_dedup": op9_minhash_dedup,
    "op10_lm_score": op10_lm_score,
    "op11_turn_repair": op11_turn_repair,
    "op12_ranked_search": op12_ranked_search,
    "op13_decontamination": op13_decontamination,
}

ORACLES = {
    "op1_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e) * list_inner_product(b.e, b.e)) >= 0.98
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b
)
SELECT e.vec_id, (SELECT count(*) FROM link l WHERE l.a = e.vec_id) AS n_links, r.component_id, r.component_id = e.vec_id AS kept
FROM embeddings e JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = e.vec_id
""",
    "op2_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS h,
         length(coalesce(text, '')) AS n
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
       count(*) OVER (PARTITION BY h) AS group_size,
       row_number() OVER (PARTITION BY h ORDER BY n DESC, doc_id) = 1 AS kept,
       h AS text_sha256
FROM d
""",
    "op7_url_filter": r"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u
), r AS (
  SELECT *, row_number() OVER (ORDER BY length(host) DESC, length(prefix) DESC) AS place
  FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) t(host, prefix, verdict)
), hit AS (
  SELECT p.page_id, min(r.place) AS place FROM p JOIN r
    ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.prefix)
  GROUP BY p.page_id
)
SELECT p.page_id, p.host, p.path, r.host || r.prefix AS rule, coalesce(r.verdict, 'allow') AS verdict
FROM p LEFT JOIN hit ON hit.page_id = p.page_id LEFT JOIN r ON r.place = hit.place
""",
    "op11_turn_repair": r"""
WITH RECURSIVE source AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key
  FROM conversations
), bits AS (
  SELECT c, CASE WHEN b7 & 1 = 1 THEN xor(b7 >> 1, 3988292384) ELSE b7 >> 1 END AS v FROM (
  SELECT c, CASE WHEN b6 & 1 = 1 THEN xor(b6 >> 1, 3988292384) ELSE b6 >> 1 END AS b7 FROM (
  SELECT c, CASE WHEN b5 & 1 = 1 THEN xor(b5 >> 1, 3988292384) ELSE b5 >> 1 END AS b6 FROM (
  SELECT c, CASE WHEN b4 & 1 = 1 THEN xor(b4 >> 1, 3988292384) ELSE b4 >> 1 END AS b5 FROM (
  SELECT c, CASE WHEN b3 & 1 = 1 THEN xor(b3 >> 1, 3988292384) ELSE b3 >> 1 END AS b4 FROM (
  SELECT c, CASE WHEN b2 & 1 = 1 THEN xor(b2 >> 1, 3988292384) ELSE b2 >> 1 END AS b3 FROM (
  SELECT c, CASE WHEN b1 & 1 = 1 THEN xor(b1 >> 1, 3988292384) ELSE b1 >> 1 END AS b2 FROM (
  SELECT c, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END AS b1 FROM range(256) t(c))))))))
), crc AS (
  SELECT key, 0 AS i, length(key) AS n, 4294967295::BIGINT AS h FROM (SELECT DISTINCT key FROM source)
  UNION ALL
  SELECT key, i + 1, n, xor(h >> 8, v) FROM crc JOIN bits ON c = (xor(h, ascii(key[i + 1])) & 255) WHERE i < n
), damaged AS (
  SELECT conv_id, turn, f, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN f = 1 THEN '' WHEN f = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM source JOIN (SELECT key, xor(h, 4294967295) % 20 AS f FROM crc WHERE i = n) USING (key)
), copied AS (
  SELECT *, unnest(CASE WHEN f = 3 THEN [0, 1] ELSE [0] END) AS copy FROM damaged WHERE f <> 0
), rows AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
         regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS bare, left(role, 1) AS r FROM copied
), faults AS (
  SELECT *, CASE WHEN bare = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
                 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
         lag(r) OVER (PARTITION BY conv_id ORDER BY i) AS r0
  FROM rows
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
         count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
         count(*) FILTER (i > 1 AND r0 || r NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM faults GROUP BY conv_id
), step AS (
  -- every way to take one turn: inserts before it, then the edit; states 0 (nothing), 1 (s), 2 (u), 3 (a)
  SELECT conv_id, i, s0, CASE edit WHEN 'D' THEN s1 WHEN 'S' THEN 1 ELSE CASE WHEN s1 = 2 THEN 3 ELSE 2 END END AS s2,
         5 * ins + CASE edit WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END + CASE WHEN edit <> 'D' AND fault = 't' THEN 5 ELSE 0 END AS cost,
         repeat('I', ins) || replace(edit, 'S', 'K') AS audit,
         said || CASE edit WHEN 'D' THEN [] WHEN 'R' THEN [CASE WHEN s1 = 2 THEN 'assistant:' ELSE 'user:' END || text] ELSE [role || ':' || text] END AS said
  FROM faults, (SELECT s0, ins, CASE WHEN ins = 0 THEN s0 WHEN (ins % 2 = 1) = (s0 = 2) THEN 3 ELSE 2 END AS s1,
                       [CASE WHEN (k % 2 = 0) = (s0 = 2) THEN 'assistant:' ELSE 'user:' END FOR k IN range(ins)] AS said
                FROM range(4) a(s0), range(3) b(ins)), (VALUES ('K'), ('S'), ('R'), ('D')) e(edit)
  WHERE edit = 'D' OR (fault NOT IN ('b', 'd') AND (edit = 'R' OR (edit = 'S' AND s1 = 0 AND r = 's') OR (edit = 'K' AND r = CASE WHEN s1 = 2 THEN 'a' ELSE 'u' END)))
), path AS (
  SELECT conv_id, 0::BIGINT AS i, 0::BIGINT AS s, {'cost': 0::BIGINT, 'audit': '', 'said': []::VARCHAR[]} AS best FROM counts
  UNION ALL
  SELECT p.conv_id, p.i + 1, t.s2::BIGINT, min({'cost': (p.best.cost + t.cost)::BIGINT, 'audit': p.best.audit || t.audit, 'said': p.best.said || t.said})
  FROM path p JOIN step t ON t.conv_id IS NOT DISTINCT FROM p.conv_id AND t.i = p.i + 1 AND t.s0 = p.s
  GROUP BY p.conv_id, p.i, t.s2
), ended AS (
  SELECT p.conv_id, min({'cost': best.cost + [0, 10, 5, 0][s + 1], 'audit': best.audit || ['', 'II', 'I', ''][s + 1],
                         'said': best.said || [[], ['user:', 'assistant:'], ['assistant:'], []][s + 1]}) AS best
  FROM path p JOIN counts c ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND p.i = c.n GROUP BY p.conv_id
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.cost, 0)::BIGINT AS cost,
       coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
""",
    "op12_ranked_search": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), total AS (
  SELECT count(*) AS docs, sum(len(w))::BIGINT AS terms FROM d WHERE len(w) > 0
), tf AS (
  SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) GROUP BY r, t
), weight AS (
  SELECT t, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, total GROUP BY t
), item AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM benchmark
), norm AS (
  SELECT r, doc_id, 100 - 50 + (50 * len(w) * docs) // terms AS m FROM d, total
), score AS (
  SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM item JOIN weight USING (t) JOIN tf USING (t) JOIN norm USING (r) GROUP BY item_id, r, doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST)::INTEGER AS rank, doc_id, score
FROM score WHERE score > 0
QUALIFY rank <= 50
""",
    "op13_decontamination": r"""
WITH i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), win AS (
  SELECT DISTINCT item_id, k, array_to_string(w[s:s + k - 1], ' ') AS t
  FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS s FROM (SELECT *, least(len(w), 10) AS k FROM i WHERE len(w) > 0))
), d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), hit AS (
  SELECT r, s, k, item_id
  FROM (SELECT r, k, s, array_to_string(w[s:s + k - 1], ' ') AS t
        FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)) JOIN win USING (k, t)
), words AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(s, s + k)) AS p FROM hit) GROUP BY r
), named AS (
  SELECT r, count(item_id) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS item_id FROM hit) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(named.n, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN named USING (r)
""",
}
