"""The registered queries of this folder: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import merkle, minhash, quality, vector_codes
from .ann_search import approximate_neighbours
from .chat_format import mask_text, preference_pairs, swapped_endings
from .common import id_hash_mod
from .language_id import fit_on, identify
from .lm_scoring import lm_scores
from .packing import pack_mixture
from .pieces import round_trips
from .simhash import near_duplicates
from .token_output import token_output
from .tokens import public_path
from .topk_search import exact_topk


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return exact_topk(vectors, vectors.where("vec_id % 100 = 0"), 10)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = lm_scores(table(spark, sf_dir, "documents"))
    return scores.select("doc_id", "n_words", F.round("log_score", 3).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"), "n_backoff")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_hash_mod("doc_id", 5) == 0
    model = fit_on(docs.where(~held_out), public_path("byte_bpe_50k.json"))
    return identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = preference_pairs(swapped_endings(table(spark, sf_dir, "conversations")))
    return pairs.select("pair_id", "block", "prompt", "chosen", "rejected", "prompt_turns", "chosen_turns", "rejected_turns", mask_text("chosen_mask").alias("chosen_mask"), mask_text("rejected_mask").alias("rejected_mask"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trips(table(spark, sf_dir, "documents"), public_path("piece_bpe_32k.model"))


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return approximate_neighbours(vectors, vectors.where("vec_id % 20 = 0"), 20)


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_mixture(table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = id_hash_mod("doc_id", 4) == 2
    model = quality.fit_on(docs.where(~held_out), labels.where(~held_out))
    return quality.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return rows.withColumn("codebooks_sha256", F.lit(vector_codes.fingerprint(books)))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tamper_report(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0)


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_topk": op1_exact_topk,
    "op2_simhash": op2_simhash,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_language_id": op4_language_id,
    "op5_chat_format": op5_chat_format,
    "op8_sentencepiece": op8_sentencepiece,
    "op6_ann": op6_ann,
    "op7_token_output": op7_token_output,
    "op9_packing": op9_packing,
    "op10_quality": op10_quality,
    "op11_vector_codes": op11_vector_codes,
    "op12_merkle": op12_merkle,
    "op13_minhash": op13_minhash,
}

_CODES_SQL_START = """
WITH whole AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
wide AS (SELECT CAST(max(len(v)) // 4 AS BIGINT) AS d FROM whole),
parts AS (SELECT vec_id, p, v[p * d + 1 : (p + 1) * d] AS x FROM whole, wide, unnest(range(4)) AS t(p)),
b0 AS (
  SELECT p, e, x FROM parts JOIN (
    SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM whole QUALIFY e < 256) USING (vec_id))"""
#: A round: every part's nearest entry, then means of its parts (rounded down) for each entry that has any.
_CODES_SQL_ROUND = """,
a{n} AS (
  SELECT vec_id, p, e, far FROM (
    SELECT vec_id, b.p, e, list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS far
    FROM parts a JOIN b{n} b ON a.p = b.p)
  QUALIFY row_number() OVER (PARTITION BY vec_id, p ORDER BY far, e) = 1),
m{n} AS (
  SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM (
    SELECT p, e, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n
    FROM (SELECT p, e, x, unnest(range(1, len(x) + 1)) AS i FROM a{n} JOIN parts USING (vec_id, p)) GROUP BY p, e, i)
  GROUP BY p, e),
b{next} AS (SELECT p, e, coalesce(m{n}.x, b{n}.x) AS x FROM b{n} LEFT JOIN m{n} USING (p, e))"""
_CODES_SQL_END = """,
a4 AS (
  SELECT vec_id, p, e, far FROM (
    SELECT vec_id, b.p, e, list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS far
    FROM parts a JOIN b4 b ON a.p = b.p)
  QUALIFY row_number() OVER (PARTITION BY vec_id, p ORDER BY far, e) = 1),
coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(far) AS BIGINT) AS error
  FROM a4 JOIN whole USING (vec_id) GROUP BY vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(x[i] AS VARCHAR), ',' ORDER BY p, e, i)) FROM (SELECT p, e, x, unnest(range(1, len(x) + 1)) AS i FROM b4)) AS codebooks_sha256
FROM coded
"""

ORACLE_SQL: dict[str, str] = {
    "op3_lm_scoring": r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
t AS (SELECT doc_id, i, words[i] AS a, CASE WHEN i > 1 THEN words[i - 1] END AS b, CASE WHEN i > 2 THEN words[i - 2] END AS c
      FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM w)),
u AS (SELECT a, count(*) AS n FROM t GROUP BY a),
bi AS (SELECT b, a, count(*) AS n FROM t WHERE i > 1 GROUP BY b, a),
tri AS (SELECT c, b, a, count(*) AS n FROM t WHERE i > 2 GROUP BY c, b, a),
total AS (SELECT count(*) AS n FROM t),
s AS (SELECT t.doc_id, t.i,
        CASE WHEN tri.n >= 2 THEN 2 WHEN bi.n >= 2 THEN 1 ELSE 0 END AS used, least(t.i - 1, 2) AS depth,
        CASE WHEN tri.n >= 2 THEN ln(tri.n / ctx.n) WHEN bi.n >= 2 THEN ln(bi.n / cu.n) ELSE ln(u.n / total.n) END AS log
      FROM t JOIN u ON t.a = u.a CROSS JOIN total
      LEFT JOIN bi ON t.b = bi.b AND t.a = bi.a
      LEFT JOIN tri ON t.c = tri.c AND t.b = tri.b AND t.a = tri.a
      LEFT JOIN u cu ON t.b = cu.a
      LEFT JOIN bi ctx ON t.c = ctx.b AND t.b = ctx.a),
d AS (SELECT doc_id, sum(log + (depth - used) * ln(0.4)) AS v, count(*) FILTER (used < depth) AS n_backoff FROM s GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, round(coalesce(v, 0), 3) AS log_score,
       round(CASE WHEN len(words) > 0 THEN v / len(words) END, 6) AS mean_log_score, coalesce(n_backoff, 0) AS n_backoff
FROM w LEFT JOIN d USING (doc_id)
""",
    "op1_exact_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
           FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores) WHERE rank <= 10
""",
    "op5_chat_format": """
WITH last AS (SELECT conv_id, max(turn) AS turn FROM conversations GROUP BY conv_id),
ends AS (SELECT c.* FROM conversations c JOIN last USING (conv_id, turn)),
turns AS (
  SELECT conv_id AS pair_id, 'chosen' AS side, turn, role, text FROM conversations
  UNION ALL
  SELECT c.conv_id, 'rejected', c.turn, c.role, c.text FROM conversations c JOIN last l ON c.conv_id = l.conv_id AND c.turn < l.turn
  UNION ALL
  SELECT l.conv_id, 'rejected', l.turn, e.role, e.text FROM last l JOIN ends e ON e.conv_id = xor(l.conv_id, 1)),
both_sides AS (
  SELECT pair_id, turn,
         string_agg(role || chr(0) || text, chr(1) ORDER BY role, text) FILTER (side = 'chosen') AS a,
         string_agg(role || chr(0) || text, chr(1) ORDER BY role, text) FILTER (side = 'rejected') AS b
  FROM turns GROUP BY pair_id, turn),
differs AS (SELECT pair_id, coalesce(min(CASE WHEN a IS DISTINCT FROM b THEN turn END), 1000000) AS at FROM both_sides GROUP BY pair_id),
parts AS (
  SELECT t.pair_id, t.turn, CASE WHEN t.turn < d.at THEN 'prompt' ELSE t.side END AS part, t.side,
         '<|' || t.role || '|>' || chr(10) AS head, t.text || '<|end|>' || chr(10) AS body, t.role
  FROM turns t JOIN differs d USING (pair_id) WHERE t.turn >= d.at OR t.side = 'chosen')
SELECT pair_id, CAST(0 AS BIGINT) AS block,
       coalesce(string_agg(head || body, '' ORDER BY turn) FILTER (part = 'prompt'), '') AS prompt,
       coalesce(string_agg(head || body, '' ORDER BY turn) FILTER (part = 'chosen'), '') AS chosen,
       coalesce(string_agg(head || body, '' ORDER BY turn) FILTER (part = 'rejected'), '') AS rejected,
       CAST(count(*) FILTER (part = 'prompt') AS INT) AS prompt_turns,
       CAST(count(*) FILTER (part = 'chosen') AS INT) AS chosen_turns,
       CAST(count(*) FILTER (part = 'rejected') AS INT) AS rejected_turns,
       coalesce(string_agg(length(head) || ':0,' || length(body) || ':' || CAST(role = 'assistant' AS INT), ',' ORDER BY turn) FILTER (part = 'chosen'), '') AS chosen_mask,
       coalesce(string_agg(length(head) || ':0,' || length(body) || ':' || CAST(role = 'assistant' AS INT), ',' ORDER BY turn) FILTER (part = 'rejected'), '') AS rejected_mask
FROM parts GROUP BY pair_id
""",
    "op11_vector_codes": _CODES_SQL_START + "".join(_CODES_SQL_ROUND.format(n=n, next=n + 1) for n in range(4)) + _CODES_SQL_END,
    "op12_merkle": """
WITH RECURSIVE
said AS (
  SELECT doc_id, lang, n_chars, text, source,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail, CAST(doc_id AS VARCHAR) AS id FROM documents),
crc(id, i, c) AS (
  SELECT id, 0, CAST(4294967295 AS BIGINT) FROM said WHERE id IS NOT NULL GROUP BY id
  UNION ALL
  SELECT id, i + 1, list_reduce(list_prepend(xor(c, ascii(substr(id, i + 1, 1))), [CAST(k AS BIGINT) for k in range(8)]), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)
  FROM crc WHERE i < length(id)),
tampered AS (SELECT id, xor(c, 4294967295) % 7 = 0 AS yes FROM crc WHERE i = length(id)),
leaves AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
    sha256(head || coalesce(strlen(CAST(n_chars + CAST(coalesce(yes, false) AS BIGINT) AS VARCHAR)) || ':' || (n_chars + CAST(coalesce(yes, false) AS BIGINT)), '-') || tail) AS shown
  FROM said LEFT JOIN tampered USING (id)),
places AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY lang) AS nodes FROM leaves),
low(lang, level, place, nodes, h) AS (
  SELECT lang, 0, place, nodes, leaf FROM places
  UNION ALL
  SELECT lang, level + 1, place // 2, (nodes + 1) // 2, sha256(string_agg(h, '' ORDER BY place)) FROM low WHERE nodes > 1 GROUP BY lang, level, place // 2, nodes),
trees AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS place, count(*) OVER () AS nodes FROM low WHERE nodes = 1),
high(level, place, nodes, h) AS (
  SELECT 0, place, nodes, subroot FROM trees
  UNION ALL
  SELECT level + 1, place // 2, (nodes + 1) // 2, sha256(string_agg(h, '' ORDER BY place)) FROM high WHERE nodes > 1 GROUP BY level, place // 2, nodes),
climb(doc_id, lang, row, level, place, nodes, h, proof) AS (
  SELECT doc_id, lang, place, 0, place, nodes, shown, '' FROM places
  UNION ALL
  SELECT c.doc_id, c.lang, c.row, c.level + 1, c.place // 2, (c.nodes + 1) // 2,
    sha256(CASE WHEN c.place % 2 = 1 THEN s.h || c.h ELSE c.h || coalesce(s.h, '') END), proof || coalesce(s.h, '')
  FROM climb c LEFT JOIN low s ON c.lang IS NOT DISTINCT FROM s.lang AND c.level = s.level AND s.place = xor(c.place, 1)
  WHERE c.nodes > 1),
climb2(doc_id, lang, row, level, place, nodes, h, proof) AS (
  SELECT c.doc_id, c.lang, c.row, 0, t.place, t.nodes, c.h, c.proof FROM climb c JOIN trees t ON c.lang IS NOT DISTINCT FROM t.lang WHERE c.nodes = 1
  UNION ALL
  SELECT c.doc_id, c.lang, c.row, c.level + 1, c.place // 2, (c.nodes + 1) // 2,
    sha256(CASE WHEN c.place % 2 = 1 THEN s.h || c.h ELSE c.h || coalesce(s.h, '') END), proof || coalesce(s.h, '')
  FROM climb2 c LEFT JOIN high s ON c.level = s.level AND s.place = xor(c.place, 1)
  WHERE c.nodes > 1)
SELECT p.doc_id, p.leaf, t.subroot, r.h AS root, sha256(c.proof) AS proof_sha256, c.h AS folded_root, c.h = r.h AS verified
FROM places p JOIN climb2 c ON c.nodes = 1 AND c.lang IS NOT DISTINCT FROM p.lang AND c.row = p.place
JOIN trees t ON t.lang IS NOT DISTINCT FROM p.lang CROSS JOIN (SELECT h FROM high WHERE nodes = 1) r
""",
    "op13_minhash": r"""
WITH RECURSIVE
w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i : i + 2], ' ') AS shingle
      FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 2, least(len(words), 1)) + 1)) AS i FROM w)),
n AS (SELECT w.doc_id, count(shingle) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id),
both_have AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY u, v),
e AS (SELECT u, v FROM both_have JOIN n a ON u = a.doc_id JOIN n b ON v = b.doc_id WHERE 100 * k >= 85 * (a.n + b.n - k)),
links AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, l.v FROM reach r JOIN links l ON r.other = l.u)
SELECT n.doc_id, CAST(n AS BIGINT) AS n_shingles, min(other) AS component_id, n.doc_id = min(other) AS kept
FROM n JOIN reach USING (doc_id) GROUP BY n.doc_id, n
""",
}
