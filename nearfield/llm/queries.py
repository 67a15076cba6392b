"""The queries of these operators and, where SQL can express them, DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm import ballkmeans, bpe, html, langid, lmscore, media, merkle, metricjoin, neardup, packing, sharding, topk, toxicity
from nearfield.llm.base import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@query
def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


@query
def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.byte_shards(table(spark, sf_dir, "documents"), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _crc_table() -> str:
    def entry(n: int) -> int:
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        return n

    return "[" + ",".join(str(entry(n)) for n in range(256)) + "]"


ORACLE_SQL["op5_sharding"] = f"""
WITH rows AS (
  SELECT doc_id, coalesce(text, '') AS body, strlen(coalesce(text, ''))::BIGINT + 1 AS size, list_transform({_crc_table()}, lambda x: x::BIGINT) AS t FROM documents),
crcs AS (
  SELECT doc_id, size, xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(body)), '..'), lambda h: ('0x' || h)::BIGINT)),
    lambda a, b: xor(a >> 8, list_extract(t, 1 + (xor(a, b) & 255)))), 4294967295::BIGINT) AS text_crc32
  FROM rows),
line AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS whole FROM crcs),
cut AS (SELECT *, floor((2 * upto - size) * 16 / (2 * whole))::INT AS shard FROM line)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, NULL::INT AS grown_shard
FROM cut"""


@query
def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_components(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors.where("key % 100 = 0"), vectors, 10)


ORACLE_SQL["op6_exact_top_k"] = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM whole q JOIN whole c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10"""


@query
def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


@query
def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.sound_columns(table(spark, sf_dir, "documents"))


@query
def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.cross_entropy_difference(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0"))


@query
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def instruction_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts and responses of ``conversations`` under limits on tokens, segments and loss-bearing tokens at once."""
    pairs = packing.instructions(table(spark, sf_dir, "conversations"))
    return packing.pack_instructions(pairs, public_tokenizers.path("word_bpe_49k.json"), ["conv_id", "turn"])


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.document_manifest(table(spark, sf_dir, "documents"))


_FIELDS = "doc_id::VARCHAR source lang n_chars::VARCHAR".split()


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen({c})::VARCHAR || ':' || {c}, '-')" for c in [*_FIELDS, text]) + ")"


def _tree_sql(name: str, leaves: str) -> str:
    """``name`` (g, level, pos, n, node) of ``leaves`` (g, pos, n, node), and ``name_sides`` with what stands left and right of each node in its run."""
    run = "PARTITION BY g, level, pos // 8 ORDER BY pos"
    return f"""{name} AS (
  SELECT g, 0 AS level, pos, n, node FROM {leaves} UNION ALL
  SELECT g, level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(node, '' ORDER BY pos)) FROM {name} WHERE n > 1 GROUP BY g, level, pos // 8, n),
{name}_sides AS (SELECT g, level, pos, coalesce(string_agg(node, '') OVER ({run} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(node, '') OVER ({run} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name} WHERE n > 1)"""


_LOWER = f"translate(text, '{merkle.UPPER}', '{merkle.LOWER}')"
ORACLE_SQL["op11_merkle_manifest"] = f"""
WITH RECURSIVE crcs AS (
  SELECT *, xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..'), lambda h: ('0x' || h)::BIGINT)),
    lambda a, b: xor(a >> 8, list_extract({_crc_table()}, 1 + (xor(a, b) & 255))::BIGINT)), 4294967295::BIGINT) AS crc FROM documents),
leaves AS (
  SELECT coalesce('+' || lang, '') AS g, doc_id, {_leaf_sql("text")} AS node, CASE WHEN crc % 3 = 0 THEN {_leaf_sql(_LOWER)} ELSE {_leaf_sql("text")} END AS offered FROM crcs),
own AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, node) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM leaves),
{_tree_sql("low", "own")},
subroots AS (SELECT g, node FROM low WHERE n = 1),
tops AS (SELECT '' AS g, g AS of, row_number() OVER (ORDER BY encode(g)) - 1 AS pos, count(*) OVER () AS n, node FROM subroots),
{_tree_sql("high", "tops")},
root AS (SELECT node AS root FROM high WHERE n = 1),
base AS (SELECT o.g, o.pos, o.doc_id, o.node AS leaf, o.offered, t.node AS subroot, t.pos AS top_at FROM own o JOIN tops t ON t.of = o.g),
proofs AS (
  SELECT b.g, b.pos, s.level, s.l, s.r FROM base b JOIN low_sides s ON s.g = b.g AND s.pos = b.pos // (8::BIGINT ** s.level)::BIGINT UNION ALL
  SELECT b.g, b.pos, 100 + s.level, s.l, s.r FROM base b JOIN high_sides s ON s.pos = b.top_at // (8::BIGINT ** s.level)::BIGINT),
steps AS (SELECT *, row_number() OVER (PARTITION BY g, pos ORDER BY level) AS i FROM proofs),
fold AS (
  SELECT g, pos, 0::BIGINT AS i, offered AS h FROM base UNION ALL
  SELECT f.g, f.pos, s.i, sha256(s.l || f.h || s.r) FROM fold f JOIN steps s ON s.g = f.g AND s.pos = f.pos AND s.i = f.i + 1),
folded AS (SELECT g, pos, arg_max(h, i) AS folded_root FROM fold GROUP BY g, pos),
whole AS (SELECT g, pos, sha256(string_agg(l || r, '' ORDER BY i)) AS proof_sha256 FROM steps GROUP BY g, pos)
SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM base JOIN folded USING (g, pos) LEFT JOIN whole USING (g, pos), root"""


@query
def op12_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ballkmeans.clusters(ballkmeans.integer_vectors(table(spark, sf_dir, "embeddings")))


def _rounds_sql(k: int, rounds: int) -> str:
    gap = "list_sum(list_transform(list_zip(r.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    out = f"""rows AS (
  SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c, v FROM rows QUALIFY c < {k})"""
    for i in range(rounds + 1):
        out += f""",
a{i} AS (SELECT id, vec_id, c, d FROM (SELECT r.id, r.vec_id, c.c, {gap} AS d FROM rows r, c{i} c) QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, c) = 1)"""
        if i < rounds:
            out += f""",
s{i} AS (SELECT c, pos, sum(x) AS s, count(*) AS n FROM (SELECT a.c, unnest(r.v) AS x, generate_subscripts(r.v, 1) AS pos FROM a{i} a JOIN rows r USING (id)) GROUP BY ALL),
c{i + 1} AS (SELECT c, coalesce(m.v, o.v) AS v FROM c{i} o LEFT JOIN (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY pos) AS v FROM s{i} GROUP BY c) m USING (c))"""
    return out


ORACLE_SQL["op12_ball_kmeans"] = f"""
WITH {_rounds_sql(16, 3)}
SELECT vec_id, c::INT AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(list_transform(v, lambda x: x::VARCHAR), ',')) AS centroid_sha256
FROM a3 JOIN c3 USING (c)"""


@query
def op13_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metricjoin.near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE_SQL["op13_embedding_near_dedup"] = """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v) * list_inner_product(b.v, b.v)) >= 0.98),
reached AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b),
least AS (SELECT a AS vec_id, min(b) AS component_id FROM reached GROUP BY a)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN least USING (vec_id)"""
