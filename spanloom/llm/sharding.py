"""Shards of bounded bytes by extendible hashing.

A document's hash is 60 bits of the MD5 of its id. The directory is indexed by leading bits: a bucket is a
prefix, and only a bucket over the byte limit splits on its next bit, so depths differ from place to place.
All depths of a band of BAND bits are summed at once over one aggregation; what still overflows at the
band's end goes on to the next band.

A bucket of one row is final even if that row alone is over the limit. Rows that share all 60 bits (repeated
ids) are cut into numbered slices instead: within the bucket, rows are numbered per input partition and
partitions by a running sum, so that no task sees the whole bucket. Null ids hash as empty strings, null and
empty texts count no bytes, texts of any length count whole. Equal hashes always share a bucket, so there are no ties.
Empty input gives no rows. Extra columns are kept out of the way and not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise

BITS = 60
BAND = 12


def hash_bits(column: str):
    """Column: 60 hash bits as a string of 0 and 1."""
    digest = F.md5(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))
    return F.lpad(F.conv(F.substring(digest, 1, 15), 16, 2), BITS, "0")


def directory(sizes: DataFrame, limit: int) -> DataFrame:
    """(prefix) of every final bucket; sizes: (bits, bytes, rows), one row for each hash value."""
    todo, leaves, depth = sizes, None, 0
    while True:
        hi = min(BITS, depth + BAND)
        cells = todo.groupBy(F.substring("bits", 1, hi).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
        by = cells.select(F.explode(F.sequence(F.lit(depth), F.lit(hi))).alias("depth"), "cell", "bytes", "rows").withColumn("prefix", F.expr("substring(cell, 1, depth)"))
        by = by.groupBy("depth", "prefix").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
        by = materialise(by, "shard-depths")
        fits = (F.col("bytes") <= limit) | (F.col("rows") <= 1) | (F.col("depth") == BITS)
        # a bucket is final if it fits and its parent doesn't
        parents = by.where(~fits).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
        final = by.where(fits).withColumn("parent", F.expr("substring(prefix, 1, depth - 1)"))
        top = final.where(F.col("depth") == depth).select("prefix") if depth == 0 else None
        split = final.where(F.col("depth") > depth).join(parents, ["depth", "parent"], "left_semi").select("prefix")
        here = split if top is None else split.unionByName(top)
        leaves = here if leaves is None else leaves.unionByName(here)
        over = by.where((F.col("depth") == hi) & ~fits).select(F.col("prefix").alias("cell"))
        if hi == BITS or over.isEmpty():
            return leaves
        todo = materialise(todo.withColumn("cell", F.substring("bits", 1, hi)).join(over, "cell", "left_semi").drop("cell"), "shard-over")
        depth = hi


def shard(docs: DataFrame, limit: int, whole: bool = False) -> DataFrame:
    """doc_id, n_bytes, shard (prefix, and slice number after a dot where a prefix of full depth overflows), depth; if whole, also doc, the row itself."""
    own = [F.struct("*").alias("doc")] if whole else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row"), *own)
    rows = materialise(rows.withColumn("bits", hash_bits("doc_id")), "shard-rows")
    sizes = rows.groupBy("bits").agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("rows"))
    sizes = materialise(sizes, "shard-sizes")
    leaves = materialise(directory(sizes, limit).withColumn("depth", F.length("prefix")), "shard-directory")
    depths = [r["depth"] for r in leaves.select("depth").distinct().collect()]  # at most 61 numbers
    # one equi-join for all depths that occur: a row looks up its prefix of each of them
    keyed = sizes.withColumn("prefix", F.explode(F.array(*[F.substring("bits", 1, d) for d in sorted(depths)]))) if depths else sizes.withColumn("prefix", F.lit(""))
    placed = keyed.join(leaves, "prefix").select("bits", "prefix", "depth", ((F.col("depth") == BITS) & (F.col("bytes") > limit) & (F.col("rows") > 1)).alias("over"))
    out = rows.join(placed, "bits")
    carried = ["doc"] if whole else []
    plain = out.where(~F.col("over")).select("doc_id", "n_bytes", F.col("prefix").alias("shard"), "depth", *carried)
    hot = out.where("over")
    # first-fit would need one task: every row gets its running byte offset, and slices start at multiples of the room that no row can overrun
    per = hot.groupBy("bits", "part").agg(F.sum("n_bytes").alias("b"), F.max("n_bytes").alias("most"))
    per = per.withColumn("before", F.sum("b").over(W.partitionBy("bits").orderBy("part").rowsBetween(W.unboundedPreceding, -1))).withColumn("most", F.max("most").over(W.partitionBy("bits")))
    run = F.sum("n_bytes").over(W.partitionBy("bits", "part").orderBy("row").rowsBetween(W.unboundedPreceding, -1))
    at = F.coalesce("before", F.lit(0)) + F.coalesce(run, F.lit(0))
    room = F.greatest(F.lit(limit) - F.col("most"), F.lit(1))
    sliced = hot.join(per.drop("b"), ["bits", "part"]).withColumn("slice", F.floor(at / room))
    return plain.unionByName(sliced.select("doc_id", "n_bytes", F.concat("prefix", F.lit("."), F.col("slice").cast("string")).alias("shard"), "depth", *carried))


def write_shards(docs: DataFrame, limit: int, path: str) -> None:
    """Every document once, with every column but one that is named shard already, as one folder for each shard."""
    placed = shard(docs, limit, whole=True).repartition("shard")
    placed.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns if c != "shard"], "shard").write.partitionBy("shard").parquet(path)
