"""Life of a stored database: append, import, delete, expire, merge; saved result sets."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .database import Database


def append(a: Database, b: Database) -> Database:
    """Records of both; b's ids must be others than a's. A key that occurs in both gets a revised one in b."""
    taken = a.records.select("key").distinct().withColumn("_t", F.lit(True))
    rec = b.records.join(taken, "key", "left").withColumn("key", F.when(F.col("_t"), F.concat("key", F.lit("."), F.col("rec_id").cast("string"))).otherwise(F.col("key"))).drop("_t").select(*a.records.columns)
    both = lambda x, y: x.select(*[c for c in x.columns if c != "bucket"]).unionByName(y.select(*[c for c in y.columns if c != "bucket"]))
    typed = {k: a.typed_table(k).unionByName(b.typed_table(k)) for k in {*a.typed, *b.typed}}
    return replace(a, tables=None, whole=False, records=a.records.unionByName(rec), texts=both(a.texts, b.texts), postings=both(a.postings, b.postings), fields=both(a.fields, b.fields), typed=typed, types={**b.types, **a.types})


def delete(db: Database, keys: DataFrame, undo: bool = False) -> Database:
    """Marks records by key."""
    k = keys.select("key").distinct().withColumn("_k", F.lit(True))
    rec = db.records.join(k, "key", "left").withColumn("deleted", F.when(F.col("_k"), F.lit(not undo)).otherwise(F.col("deleted"))).drop("_k")
    return replace(db, whole=False, records=rec.select(*db.records.columns))


def expire(db: Database, now: datetime) -> Database:
    """Marks records whose date of expiry has passed."""
    return replace(db, whole=False, records=db.records.withColumn("deleted", F.col("deleted") | F.coalesce(F.col("date_expires") <= F.lit(now), F.lit(False))))


def collapse(db: Database) -> Database:
    """Only what belongs to records that aren't deleted."""
    ids = db.live.select("rec_id")
    keep = lambda t: t.join(ids, "rec_id", "left_semi")
    return replace(db, tables=None, records=db.live, texts=keep(db.texts), postings=keep(db.postings), fields=keep(db.fields), typed={k: keep(t) for k, t in db.typed.items()})


def unique_keys(records: DataFrame) -> DataFrame:
    """Of records with one key, all but the first get a numbered one."""
    n = F.row_number().over(W.partitionBy("key").orderBy("rec_id"))
    return records.withColumn("_n", n).withColumn("key", F.when(F.col("_n") > 1, F.concat("key", F.lit("."), (F.col("_n") - 1).cast("string"))).otherwise(F.col("key"))).drop("_n")


def save_set(ir: DataFrame, path: str, made: datetime) -> None:
    """A result set with the moment it was made."""
    ir.withColumn("_made", F.lit(made)).write.mode("overwrite").parquet(path)


def load_set(spark: SparkSession, path: str, changed: datetime | None = None) -> DataFrame | None:
    """A saved set; None if the database changed after it was made."""
    ir = spark.read.parquet(path)
    if changed is not None:
        made = ir.agg(F.min("_made")).first()[0]
        if made is not None and made < changed:
            return None
    return ir.drop("_made")


def check(db: Database) -> DataFrame:
    """problem, n: postings, fields without a record, spans beyond their text, keys that repeat."""
    r = db.records.select("rec_id", "length")
    parts = [
        (db.postings.join(r, "rec_id", "left_anti"), "posting without record"), (db.fields.join(r, "rec_id", "left_anti"), "field without record"), (db.fields.join(r, "rec_id").where("e >= length or s > e"), "field beyond its text"),
        (db.records.groupBy("key").count().where("count > 1"), "repeated key"),
    ]
    out = None
    for t, what in parts:
        x = t.agg(F.count("*").alias("n")).select(F.lit(what).alias("problem"), "n")
        out = x if out is None else out.unionByName(x)
    return out
