"""The queries of this subpackage, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, impact, lines, minhash, multi_index, packing, pii, quality, secrets, sharding


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Bytes of text that a shard may hold.
SHARD_BYTES = 1 << 20


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(_table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.encode(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digest=True)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.groups(_table(spark, sf_dir, "documents")).drop("rk")


def op5_impact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op6_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"), SHARD_BYTES)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.link_documents(_table(spark, sf_dir, "documents"), 2, 80)


def op10_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.link_vectors(_table(spark, sf_dir, "embeddings"), 0.9)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_quality": op3_quality,
    "op4_fuzzy_lines": op4_fuzzy_lines,
    "op5_impact_topk": op5_impact_topk,
    "op6_extendible_shards": op6_extendible_shards,
    "op7_packing": op7_packing,
    "op8_secrets": op8_secrets,
    "op9_minhash": op9_minhash,
    "op10_multi_index": op10_multi_index,
}

_FINITE = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

ORACLES: dict[str, str] = {
    "op5_impact_topk": f"""
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings WHERE {_FINITE}),
        s AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op6_extendible_shards": f"""
        WITH d AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes, lpad(bin(('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT), 60, '0') AS bits FROM documents),
        p AS (SELECT r.range AS depth, substr(bits, 1, r.range) AS prefix, sum(n_bytes) AS bytes, count(*) AS n FROM d, range(61) r GROUP BY ALL),
        f AS (SELECT doc_id, n_bytes, prefix, depth, row_number() OVER (PARTITION BY doc_id ORDER BY depth) AS k
              FROM d JOIN p ON substr(d.bits, 1, p.depth) = p.prefix AND (bytes <= {SHARD_BYTES} OR n <= 1))
        SELECT doc_id, n_bytes, prefix AS shard, depth::INT AS depth FROM f WHERE k = 1""",
    "op9_minhash": """
        WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        i AS (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS k FROM d WHERE len(w) > 0),
        sh AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[k] || ' ' || w[k + 1] END AS s FROM i),
        n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
        c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
        e AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * shared >= 80 * (a.n + b.n - shared)),
        r(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y),
        m AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
        SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
        FROM d JOIN m ON m.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op10_multi_index": f"""
        WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE {_FINITE} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
        r(x, y) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y),
        m AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
        SELECT g.vec_id, (SELECT count(*) FROM l WHERE l.x = g.vec_id)::BIGINT AS n_links, component_id, g.vec_id = component_id AS kept
        FROM embeddings g JOIN m ON m.x = g.vec_id""",
}
