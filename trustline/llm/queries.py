"""Queries of this subpackage for the entry module: name -> (spark, sf_dir) -> DataFrame, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cap_filters, conversation_repair, dart_minhash, digest_index, language_id, line_quality, packing, piece_codec, prefix_trie, sharding, sketches, token_counts, toxicity
from .common import fold, table

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text, by a byte convolutional network learned outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    held = fold("doc_id", 4) == 2
    net = language_id.train(docs, ~held)
    return language_id.classify(docs.select("doc_id", "text"), net).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op2_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text, by a conditional random field over its lines."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = fold("doc_id", 3) == 1
    field = line_quality.train(docs, labels, ~held)
    scored = line_quality.score_quality(docs.select("doc_id", "text"), field)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at cosine 0.95 or more."""
    return cap_filters.near_vectors(table(spark, sf_dir, "embeddings"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every whole text under the unigram vocabulary, by count-only Viterbi."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), PIECE_MODEL).drop("text")


def op5_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text and the text decoded from them."""
    return piece_codec.encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), PIECE_MODEL).drop("text")


def op6_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal and nearly equal documents: five-word shingles, weighted similarity 0.8 or more."""
    return dart_minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bottom-k fingerprints of every whole text and of its edited text, and their likenesses."""
    return sketches.edited_fingerprints(table(spark, sf_dir, "documents"))


def op8_uniform_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 16 shards whose counts are at most one apart."""
    raw = F.col("text").cast("binary")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.coalesce(F.crc32(raw), F.lit(0)).cast("bigint").alias("text_crc32"),
        F.lit("rows").alias("law"),
    )
    return sharding.uniform_shards(docs, 16).withColumn("grown_shard", F.lit(None).cast("int"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens in sequences of 2048 with the corpus's own mixture of sources."""
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), BYTE_BPE)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text, by the weighted pattern grammar."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = fold("doc_id", 4) == 2
    model = toxicity.train(docs, labels, ~held)
    scored = toxicity.score_toxicity(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= toxicity.TOXIC_FROM).cast("int").alias("predicted"))


def op11_digest_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose texts are equal but for white space, by an index built up in three generations."""
    return digest_index.exact_duplicates(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations' prefixes, with what each of them saves."""
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of the damaged conversations, and the cheapest edits that repair their structure."""
    return conversation_repair.damage_and_repair(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_line_quality": op2_line_quality,
    "op3_cap_filters": op3_cap_filters,
    "op4_token_counts": op4_token_counts,
    "op5_piece_codec": op5_piece_codec,
    "op6_dart_minhash": op6_dart_minhash,
    "op7_fingerprints": op7_fingerprints,
    "op8_uniform_shards": op8_uniform_shards,
    "op9_packing": op9_packing,
    "op10_toxicity": op10_toxicity,
    "op11_digest_index": op11_digest_index,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_conversation_repair": op13_conversation_repair,
}

# Everything that links reach, and the smallest id there; near (a, b) and ids (node, id) come before.
_REACH = """both_ways AS (SELECT a, b FROM near UNION SELECT b, a FROM near),
  reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a),
  component AS (SELECT i.node, least(min(i.id), coalesce(min(j.id), min(i.id))) AS component_id FROM ids i LEFT JOIN reach r ON r.a = i.node LEFT JOIN ids j ON j.node = r.b GROUP BY 1)"""

_VECTORS = f"""WITH RECURSIVE sound AS (
    SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
    WHERE len(list_filter(embedding, lambda x: x <> 0)) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  near AS (SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.vec_id < b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
  ids AS (SELECT vec_id AS node, vec_id AS id FROM embeddings),
  {_REACH}
SELECT vec_id, (SELECT count(*) FROM both_ways WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN component ON node = vec_id"""

_NEAR_DUPLICATES = f"""WITH RECURSIVE spoken AS (
    SELECT DISTINCT md5(text) AS node, list_filter(regexp_split_to_array(text, '[\\x00-\\x20]+'), lambda w: w <> '') AS ws FROM documents WHERE regexp_matches(text, '[^\\x00-\\x20]')),
  shingles AS (SELECT node, shingle, count(*) AS n FROM (
    SELECT node, unnest(CASE WHEN len(ws) < 5 THEN [ws] ELSE list_transform(range(1, len(ws) - 3), lambda i: ws[i:i + 4]) END) AS shingle FROM spoken) q GROUP BY 1, 2),
  sizes AS (SELECT node, sum(n) AS size FROM shingles GROUP BY 1),
  near AS (SELECT q.a, q.b FROM (SELECT x.node AS a, y.node AS b, sum(least(x.n, y.n)) AS shared FROM shingles x JOIN shingles y ON x.shingle = y.shingle AND x.node < y.node GROUP BY 1, 2) q
    JOIN sizes sa ON sa.node = a JOIN sizes sb ON sb.node = b WHERE shared >= 0.8 * (sa.size + sb.size - shared) - 1e-9),
  ids AS (SELECT md5(text) AS node, min(doc_id) AS id FROM documents WHERE md5(text) IN (SELECT node FROM spoken) GROUP BY 1),
  {_REACH}
SELECT doc_id, coalesce(component_id, doc_id) AS component_id, coalesce(doc_id = component_id, true) AS kept, c.node AS text_class FROM documents d LEFT JOIN component c ON c.node = md5(d.text)"""

_EXACT_DUPLICATES = """WITH digests AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256 FROM digests WINDOW w AS (PARTITION BY text_sha256)"""



def _crc32(text: str) -> str:
    """CRC-32 of an ASCII text, a byte and then a bit at a time."""
    bits = "list_reduce([xor(s, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length({text}) + 1), lambda i: ascii(substr({text}, i, 1))::BIGINT)), lambda s, b: {bits}), 4294967295)"


_PREFIX_TRIE = f"""WITH turns AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p FROM conversations WHERE conv_id IS NOT NULL),
  told AS (SELECT conv_id, p, md5(length(role) || ':' || role || text) AS h, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words FROM turns),
  convs AS (SELECT conv_id, list({{'h': h, 'words': words}} ORDER BY p) AS own FROM told GROUP BY 1),
  taking AS (SELECT conv_id, own, conv_id - conv_id % 20 AS donor, {_crc32('conv_id::VARCHAR')} % 4 AS h FROM convs),
  rebuilt AS (SELECT t.conv_id, list_concat(coalesce(d.own[1:t.h], []), t.own[t.h + 1:]) AS ts FROM taking t LEFT JOIN convs d ON d.conv_id = t.donor),
  members AS (SELECT conv_id, d AS depth, array_to_string(list_transform(ts[1:d], lambda x: x.h), '') AS key, CASE WHEN d > 0 THEN ts[d].words ELSE 0 END AS words, len(ts) = d AS ends FROM rebuilt, unnest(range(0, len(ts) + 1)) AS u(d)),
  nodes AS (SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM members GROUP BY 1, 2),
  linked AS (SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes c WHERE c.depth = n.depth + 1 AND c.key[:32 * n.depth] = n.key) AS n_children FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.key = n.key[:32 * p.depth])
SELECT a.conv_id, a.depth, a.parent_conv_id, a.n_convs, a.n_children, count(*) FILTER (b.n_children = 0) AS n_leaves, CAST(sum((b.n_convs - 1) * b.words) AS BIGINT) AS saved_tokens, a.ends_sha256
FROM linked a JOIN linked b ON starts_with(b.key, a.key) GROUP BY a.conv_id, a.depth, a.parent_conv_id, a.n_convs, a.n_children, a.ends_sha256, a.key"""

_CONVERSATION_REPAIR = f"""WITH RECURSIVE named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
  kinds AS (SELECT *, {_crc32('name')} % 20 AS kind FROM named),
  dealt AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM kinds, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS t(time) WHERE kind <> 0),
  placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(length(role) || ':' || role || text)) AS i FROM dealt),
  judged AS (SELECT *, left(role, 1) AS ini, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 'truncated' ELSE '' END AS fault, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS ini_before FROM placed),
  steps AS (SELECT conv_id, i, ini, fault IN ('blank', 'duplicate') AS goes, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS more FROM judged),
  sizes AS (SELECT conv_id, max(i) AS n FROM steps GROUP BY 1),
  -- The best (cost, audit) from each of the four states: nothing yet, after system, after user, after assistant.
  best AS (SELECT conv_id, n + 1 AS i, [{{'c': 0, 'a': ''}}, {{'c': 6, 'a': 'II'}}, {{'c': 3, 'a': 'I'}}, {{'c': 0, 'a': ''}}] AS g FROM sizes
    UNION ALL
    SELECT conv_id, i, [list_min([b[1], {{'c': g2.c + 3, 'a': 'I' || g2.a}}]), list_min([b[2], {{'c': g2.c + 3, 'a': 'I' || g2.a}}]), g2, g3] AS g FROM (
      SELECT conv_id, i, b, list_min([b[3], {{'c': b[4].c + 3, 'a': 'I' || b[4].a}}]) AS g2, list_min([b[4], {{'c': b[3].c + 3, 'a': 'I' || b[3].a}}]) AS g3 FROM (
        SELECT s.conv_id, s.i, list_transform([1, 2, 3, 4], lambda q: list_min(list_concat([{{'c': f.g[q].c + 4, 'a': 'D' || f.g[q].a}}],
          CASE WHEN s.goes THEN [] ELSE [{{'c': f.g[[3, 3, 4, 3][q]].c + 3 + s.more, 'a': 'R' || f.g[[3, 3, 4, 3][q]].a}}] END,
          CASE WHEN s.goes OR (q = 1 AND s.ini NOT IN ('s', 'u')) OR (q IN (2, 4) AND s.ini <> 'u') OR (q = 3 AND s.ini <> 'a') THEN []
            ELSE [{{'c': f.g[CASE s.ini WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END].c + s.more, 'a': 'K' || f.g[CASE s.ini WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END].a}}] END))) AS b
        FROM best f JOIN steps s ON s.conv_id IS NOT DISTINCT FROM f.conv_id AND s.i = f.i - 1) q1) q2),
  solved AS (SELECT conv_id, g[1].c AS cost, g[1].a AS audit FROM best WHERE i = 1),
  letters AS (SELECT conv_id, p, audit[p] AS e, sum(CASE WHEN audit[p] = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY p) AS i FROM solved, unnest(range(1, length(audit) + 1)) AS t(p)),
  lines AS (SELECT l.conv_id, l.p, l.e, j.role, j.text, j.ini, row_number() OVER (PARTITION BY l.conv_id ORDER BY l.p) AS place FROM letters l LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM l.conv_id AND j.i = l.i AND l.e <> 'I' WHERE l.e <> 'D'),
  leads AS (SELECT conv_id, max(CASE WHEN place = 1 AND e = 'K' AND ini = 's' THEN 1 ELSE 0 END) AS lead FROM lines GROUP BY 1),
  repaired AS (SELECT l.conv_id, sha256(string_agg(CASE WHEN e = 'K' THEN role WHEN (place - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY p)) AS h
    FROM lines l JOIN leads d ON d.conv_id IS NOT DISTINCT FROM l.conv_id GROUP BY 1),
  counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (ini_before || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY 1)
SELECT o.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal,
  CAST(coalesce(s.cost, 0) AS BIGINT) AS cost, coalesce(s.audit, '') AS audit, coalesce(r.h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN solved s ON s.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM o.conv_id"""

ORACLES: dict[str, str] = {"op3_cap_filters": _VECTORS, "op6_dart_minhash": _NEAR_DUPLICATES, "op11_digest_index": _EXACT_DUPLICATES, "op12_prefix_trie": _PREFIX_TRIE, "op13_conversation_repair": _CONVERSATION_REPAIR}
