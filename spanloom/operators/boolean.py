"""Set operators on result sets (rec_id, score, hit_count, aux_count, hits)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HITS = "array<struct<s:bigint,e:bigint>>"
COLUMNS = ["rec_id", "score", "hit_count", "aux_count", "hits"]


def hit_set(*arrays):
    """Spans of several hit tables as one sorted set."""
    return F.array_sort(F.array_distinct(F.concat(*arrays)))


def merge_entries(ir: DataFrame) -> DataFrame:
    """Rows of the same record become one: scores and counts add up, hits unite."""
    return ir.groupBy("rec_id").agg(
        F.sum("score").alias("score"), F.sum("hit_count").cast("bigint").alias("hit_count"), F.sum("aux_count").cast("bigint").alias("aux_count"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits")
    )


def concat(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*COLUMNS).unionByName(b.select(*COLUMNS))


def or_(a: DataFrame, b: DataFrame) -> DataFrame:
    return merge_entries(concat(a, b))


def _sides(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    other = b.select("rec_id", *[F.col(c).alias(f"o_{c}") for c in COLUMNS[1:]])
    return a.select(*COLUMNS).join(other.hint("merge"), "rec_id", how)


def and_(a: DataFrame, b: DataFrame) -> DataFrame:
    return _sides(a, b, "inner").select(
        "rec_id", (F.col("score") + F.col("o_score")).alias("score"), (F.col("hit_count") + F.col("o_hit_count")).alias("hit_count"), (F.col("aux_count") + F.col("o_aux_count")).alias("aux_count"), hit_set("hits", "o_hits").alias("hits")
    )


def and_not(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a whose record isn't in b, with a's scores."""
    return a.select(*COLUMNS).join(b.select("rec_id").hint("merge"), "rec_id", "left_anti")


def xor(a: DataFrame, b: DataFrame) -> DataFrame:
    j = _sides(a.withColumn("hit_count", F.col("hit_count")), b, "full_outer").where("score is null or o_score is null")
    return j.select("rec_id", *[F.coalesce(c, f"o_{c}").alias(c) for c in COLUMNS[1:]])


def not_(records: DataFrame, total: int, a: DataFrame) -> DataFrame:
    """Records that aren't in a; each scores sqrt(N - n) / N."""
    n = a.agg(F.count("*")).scalar()
    out = records.select("rec_id").join(a.select("rec_id").hint("merge"), "rec_id", "left_anti").withColumn("_n", n)
    return out.select("rec_id", (F.sqrt(F.lit(float(total)) - F.col("_n")) / F.lit(float(max(total, 1)))).alias("score"), F.lit(1).cast("bigint").alias("hit_count"), F.lit(1).cast("bigint").alias("aux_count"), F.array().cast(HITS).alias("hits"))


def not_within(records: DataFrame, total: int, a: DataFrame, spans: DataFrame) -> DataFrame:
    """Records that aren't in a but have the field; hits are the field's spans."""
    have = spans.groupBy("rec_id").agg(F.array_sort(F.collect_set(F.struct("s", "e"))).alias("hits"))
    return not_(records, total, a).drop("hits").join(have, "rec_id")


def join_by_key(a: DataFrame, a_records: DataFrame, b: DataFrame, b_records: DataFrame, keep: str = "left") -> DataFrame:
    """Key equi-join of sets of two databases: rows of one side, with both scores added."""
    ka = a.join(a_records.select("rec_id", "key"), "rec_id").where("key is not null")
    kb = b.join(b_records.select("rec_id", "key"), "rec_id").where("key is not null")
    if keep == "right":
        ka, kb = kb, ka
    other = kb.groupBy("key").agg(F.sum("score").alias("o_score"))
    return ka.join(other, "key").select("rec_id", "key", (F.col("score") + F.col("o_score")).alias("score"), "hit_count", "aux_count", "hits")
