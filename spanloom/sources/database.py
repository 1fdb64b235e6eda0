"""A searchable collection as a bundle of DataFrames, and collections searched as one."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import postings as make_postings
from ..functions.text import word_counts
from .scratch import written

#: Folders of the postings table: a term's postings lie in one of them, sorted by term. One for so many bytes of text.
BUCKET_BYTES, LEAST_BUCKETS, MOST_BUCKETS = 256 << 20, 8, 4096

RECORD_COLUMNS = {
    "rec_id": "bigint", "volume": "int", "key": "string", "path": "string", "file": "string", "doctype": "string", "lang": "string", "charset": "string", "category": "int", "priority": "int",
    "date": "timestamp", "date_modified": "timestamp", "date_created": "timestamp", "date_expires": "timestamp", "deleted": "boolean", "length": "bigint",
}
TYPED = {
    "numbers": "rec_id bigint, field string, s bigint, e bigint, value double",
    "dates": "rec_id bigint, field string, s bigint, e bigint, lo timestamp, hi timestamp",
    "ranges": "rec_id bigint, field string, s bigint, e bigint, lo double, hi double",
    "boxes": "rec_id bigint, field string, s bigint, e bigint, n double, w double, so double, ea double",
    "hashes": "rec_id bigint, field string, s bigint, e bigint, value string",
}


def records(df: DataFrame) -> DataFrame:
    """Any subset of the record columns (rec_id at least, and text for its length) filled up with defaults."""
    have = set(df.columns)
    default = {"volume": F.lit(0), "key": F.col("rec_id").cast("string"), "charset": F.lit("UTF-8"), "deleted": F.lit(False), "priority": F.lit(0), "category": F.lit(0)}
    cols = []
    for c, t in RECORD_COLUMNS.items():
        x = F.col(c) if c in have else F.octet_length("text") if c == "length" and "text" in have else default.get(c, F.lit(None))
        cols.append(x.cast(t).alias(c))
    return df.select(*cols)


class WordTables:
    """Postings of the words that queries ask for: one pass over the texts for those of a query, written once."""

    def __init__(self, texts: DataFrame):
        self.texts = texts
        self._made: dict[tuple[str, str], DataFrame] = {}

    def add(self, wanted: Iterable[tuple[str, str]]) -> None:
        """wanted: see word_test."""
        new = [w for w in dict.fromkeys(wanted) if w not in self._made]
        if new:
            self._made |= dict.fromkeys(new, written(make_postings(self.texts, wanted=new), "words"))

    def of(self, kind: str, text: str) -> DataFrame:
        self.add([(kind, text)])
        return self._made[kind, text]


@dataclass(frozen=True)
class Database:
    """records, texts (rec_id, text), postings, fields (rec_id, field, path, s, e) and typed side tables."""

    records: DataFrame
    texts: DataFrame
    postings: DataFrame
    fields: DataFrame
    typed: Mapping[str, DataFrame] = field(default_factory=dict)
    types: Mapping[str, str] = field(default_factory=dict)
    stop_words: frozenset[str] = frozenset()
    aliases: Mapping[str, str] = field(default_factory=dict)
    #: term, freq of all postings, and the number of their folders, once saved
    terms: DataFrame | None = None
    buckets: int = 0
    #: of a database that isn't saved: tables of the words asked for, instead of all postings
    tables: WordTables | None = None
    #: nothing is deleted or left out, so that every posting, span and typed row has a live record
    whole: bool = False

    @property
    def spark(self) -> SparkSession:
        return self.records.sparkSession

    @classmethod
    def build(cls, rows: DataFrame, fields: DataFrame | None = None, typed: Mapping[str, DataFrame] | None = None, types: Mapping[str, str] | None = None, stop_words: frozenset[str] = frozenset(), **more) -> Database:
        """rows: rec_id, text and any record columns."""
        spark = rows.sparkSession
        texts = rows.select(F.col("rec_id").cast("bigint").alias("rec_id"), F.coalesce("text", F.lit("")).alias("text"))
        p = make_postings(texts)
        if stop_words:
            p = p.where(~F.col("term").isin(sorted(stop_words)))
        if fields is None:
            fields = spark.createDataFrame([], "rec_id bigint, field string, path string, s bigint, e bigint")
        return cls(records(rows), texts, p, fields, dict(typed or {}), {k.upper(): v for k, v in (types or {}).items()}, stop_words, **more)

    @cached_property
    def live(self) -> DataFrame:
        return self.records.where(~F.col("deleted"))

    @cached_property
    def total(self) -> int:
        return self.live.count()

    @cached_property
    def has_fields(self) -> bool:
        return not self.fields.isEmpty()

    def typed_table(self, kind: str) -> DataFrame:
        return self.typed[kind] if kind in self.typed else self.spark.createDataFrame([], TYPED[kind])

    @property
    def vocabulary(self) -> DataFrame:
        """term of every distinct one; of a saved database its dictionary is read."""
        return self.terms.select("term") if self.terms is not None else self.postings.select("term").distinct()

    @property
    def frequencies(self) -> DataFrame:
        """term, freq over all live records."""
        if self.tables is None or not self.whole:
            return self.live_postings.groupBy("term").agg(F.count("*").alias("freq"))
        n = word_counts(self.texts.where("rec_id is not null"))
        return (n.where(~F.col("term").isin(sorted(self.stop_words))) if self.stop_words else n).groupBy("term").agg(F.sum("n").alias("freq"))

    @property
    def live_postings(self) -> DataFrame:
        return self.postings.where("rec_id is not null") if self.whole else self.postings.join(self.live.select("rec_id").hint("merge"), "rec_id", "left_semi")

    def words(self, kind: str, text: str) -> DataFrame:
        """Postings among which are all those of a kind (see word_test) and text; the caller's condition tells which."""
        if self.tables is None:
            return self.postings
        p = self.tables.of(kind, text)
        return p.where(~F.col("term").isin(sorted(self.stop_words))) if self.stop_words else p

    def save(self, path: str, mode: str = "error", buckets: int | None = None) -> None:
        """Write the tables; buckets: folders of the postings, by default as many as the texts' size asks for."""
        self.records.write.mode(mode).parquet(f"{path}/records")
        self.texts.write.mode(mode).parquet(f"{path}/texts")
        if buckets is None:
            size = self.spark.read.parquet(f"{path}/records").agg(F.sum("length")).first()[0] or 0
            buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, -(-size // BUCKET_BYTES)))
        bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
        # rows of one hot term are spread over several tasks by the record
        out = self.postings.withColumn("bucket", bucket).repartition("bucket", F.pmod(F.xxhash64("rec_id"), F.lit(4)))
        out.sortWithinPartitions("bucket", "term", "rec_id", "s").write.mode(mode).partitionBy("bucket").parquet(f"{path}/postings")
        self.spark.read.parquet(f"{path}/postings").groupBy("term").agg(F.count("*").alias("freq")).write.mode(mode).parquet(f"{path}/terms")
        # rows of one field are spread over several tasks by the record, and a task writes few fields
        self.fields.repartition("field", F.pmod(F.xxhash64("rec_id"), F.lit(4))).write.mode(mode).partitionBy("field").parquet(f"{path}/fields")
        for k, t in self.typed.items():
            t.write.mode(mode).parquet(f"{path}/typed_{k}")
        meta = json.dumps({"types": dict(self.types), "typed": sorted(self.typed), "stop": sorted(self.stop_words), "aliases": dict(self.aliases), "fields": not self.fields.isEmpty(), "buckets": buckets})
        self.spark.createDataFrame([(meta,)], "meta string").coalesce(1).write.mode(mode).parquet(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Database:
        m = json.loads(spark.read.parquet(f"{path}/meta").first()[0])
        fields = "rec_id bigint, field string, path string, s bigint, e bigint"
        f = spark.read.schema(fields).parquet(f"{path}/fields").select("rec_id", "field", "path", "s", "e") if m["fields"] else spark.createDataFrame([], fields)
        return cls(
            spark.read.parquet(f"{path}/records"), spark.read.parquet(f"{path}/texts"), spark.read.parquet(f"{path}/postings"), f,
            {k: spark.read.parquet(f"{path}/typed_{k}") for k in m["typed"]}, m["types"], frozenset(m["stop"]), m["aliases"], spark.read.parquet(f"{path}/terms"), m["buckets"],
        )

    def lookup(self, term: str) -> DataFrame:
        """Postings of one whole term; of a saved database only its folder is read."""
        p = self.words("exact", term).where(F.col("term") == term)
        if self.buckets and "bucket" in self.postings.columns:
            p = p.where(F.col("bucket") == F.pmod(F.xxhash64(F.lit(term)), F.lit(self.buckets)).cast("int"))  # a constant to the optimizer
        return p

    def restricted(self, keep: DataFrame) -> Database:
        """Only records whose rec_id is among keep's."""
        return replace(self, records=self.records.join(keep.select("rec_id").distinct(), "rec_id", "left_semi"), whole=False)


@dataclass(frozen=True)
class VirtualDatabase:
    """Databases searched as one; each is scored by itself and results carry its volume."""

    members: tuple[Database, ...]

    def search(self, query, **options) -> DataFrame:
        from ..plans.engine import Engine

        out = None
        for v, db in enumerate(self.members):
            r = Engine(db, **options).run(query).withColumn("volume", F.lit(v))
            out = r if out is None else out.unionByName(r)
        return out

    def statistics(self, query, **options) -> DataFrame:
        """volume, hits, total of every member."""
        got = self.search(query, **options).groupBy("volume").agg(F.count("*").alias("hits"))
        totals = None
        for v, db in enumerate(self.members):
            t = db.live.agg(F.count("*").alias("total")).withColumn("volume", F.lit(v))
            totals = t if totals is None else totals.unionByName(t)
        return totals.join(got, "volume", "left").select("volume", F.coalesce("hits", F.lit(0)).alias("hits"), "total")
