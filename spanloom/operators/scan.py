"""Dictionaries, facets and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metaphone import metaphone, metaphone_keys
from ..functions.text import byte_slice, glob_regex
from ..plans.ast import QueryError
from ..sources.database import Database
from .proximity import containers, exploded, inside


def _postings(db: Database, field: str | None) -> DataFrame:
    p = db.live_postings
    if field is None:
        return p
    hits = inside(p.select("rec_id", "s", "e"), db.fields.where(F.col("field") == field.upper()))
    return p.join(hits, ["rec_id", "s", "e"])


def dictionary(db: Database, field: str | None = None, where: Column | None = None) -> DataFrame:
    """term, freq. where: a condition on the term."""
    if field is None:
        return db.frequencies if where is None else db.frequencies.where(where)
    p = _postings(db, field)
    return (p if where is None else p.where(where)).groupBy("term").agg(F.count("*").alias("freq"))


def scan(db: Database, start: str = "", field: str | None = None, n: int | None = None, offset: int = 0) -> DataFrame:
    """Terms in order from a position; `a|b` scans from each."""
    out = None
    for s in start.lower().split("|"):
        d = dictionary(db, field, F.col("term") >= s)
        if n is not None:
            d = d.orderBy("term").offset(offset).limit(n)
        out = d if out is None else out.unionByName(d).distinct()
    return out


def scan_truncated(db: Database, prefix: str = "", suffix: str = "", field: str | None = None) -> DataFrame:
    return dictionary(db, field, F.startswith("term", F.lit(prefix.lower())) & F.endswith("term", F.lit(suffix.lower())))


def scan_glob(db: Database, glob: str, field: str | None = None) -> DataFrame:
    return dictionary(db, field, F.rlike("term", F.lit(glob_regex(glob.lower()))))


def scan_soundex(db: Database, word: str, field: str | None = None) -> DataFrame:
    return dictionary(db, field, F.rlike("term", F.lit("^[a-z]")) & (F.soundex("term") == F.soundex(F.lit(word))))


def scan_metaphone(db: Database, word: str, field: str | None = None) -> DataFrame:
    keys = F.array(*[F.lit(k) for k in metaphone_keys(word)])
    return dictionary(db, field).where(F.arrays_overlap(metaphone("term"), keys))


def strings(scanned: DataFrame) -> DataFrame:
    """A scan without frequencies."""
    return scanned.select("term").distinct()


def merged(a: DataFrame, b: DataFrame, add: bool = True) -> DataFrame:
    """Scan lists as one, each term once: frequencies added, or the larger."""
    return a.unionByName(b).groupBy("term").agg((F.sum("freq") if add else F.max("freq")).alias("freq"))


def facets(db: Database, ir: DataFrame, field: str | None = None, most_records: int | None = None) -> DataFrame:
    """term, freq over the content of a field (or of the container) around each hit of a result set."""
    if most_records is not None and most_records > 1 and ir.count() > most_records:
        raise QueryError(12)
    if field is None:
        spans = containers(exploded(ir), db.fields).select("rec_id", F.col("ps").alias("fs"), F.col("pe").alias("fe")).distinct()
    else:
        f = db.fields.where(F.col("field") == field.upper()).select("rec_id", F.col("s").alias("fs"), F.col("e").alias("fe"))
        spans = exploded(ir).join(f, "rec_id").where("fs <= s and fe >= e").select("rec_id", "fs", "fe").distinct()
    p = db.postings.join(spans, "rec_id").where("fs <= s and fe >= e").select("rec_id", "term", "s", "fs", "fe")
    if db.stop_words:
        p = p.where(~F.col("term").isin(sorted(db.stop_words)))
    return p.groupBy("term").agg(F.count("*").alias("freq"))


def field_values(db: Database, kind: str, field: str) -> DataFrame:
    """Distinct values of a typed field with their frequency."""
    t = db.typed_table(kind).where(F.col("field") == field.upper())
    cols = [c for c in t.columns if c not in ("rec_id", "field", "s", "e")]
    return t.groupBy(*cols).agg(F.count("*").alias("freq"))


def content_facets(db: Database, ir: DataFrame, field: str) -> DataFrame:
    """value, freq: whole contents of a field's instances in the found records."""
    f = db.fields.where(F.col("field") == field.upper()).join(ir.select("rec_id"), "rec_id", "left_semi").join(db.texts, "rec_id")
    return f.select(F.lower(F.trim(byte_slice(F.col("text"), F.col("s"), F.col("e")))).alias("value")).groupBy("value").agg(F.count("*").alias("freq"))


def totals(db: Database) -> DataFrame:
    """words, unique_words, records, deleted."""
    if db.tables is not None and db.whole:
        w = db.frequencies.agg(F.coalesce(F.sum("freq"), F.lit(0).cast("bigint")).alias("words"), F.count("*").alias("unique_words"))
    else:
        w = db.postings.agg(F.count("*").alias("words"), F.countDistinct("term").alias("unique_words"))
    r = db.records.agg(F.count("*").alias("records"), F.coalesce(F.sum(F.col("deleted").cast("bigint")), F.lit(0).cast("bigint")).alias("deleted"))
    return w.select(F.lit(1).alias("k"), "*").join(r.select(F.lit(1).alias("k"), "*"), "k").drop("k")


def centroid(db: Database) -> DataFrame:
    """field, term, freq: every field's vocabulary."""
    j = db.postings.select("rec_id", "term", "s", "e").join(db.fields.select("rec_id", "field", F.col("s").alias("fs"), F.col("e").alias("fe")), "rec_id").where("fs <= s and fe >= e")
    return j.groupBy("field", "term").agg(F.count("*").alias("freq"))


