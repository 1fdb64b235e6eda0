"""From raw documents to packed sequences: quality, line dedup, near-duplicates, personal data, packing.

Every stage takes documents with null or empty texts, texts of any length, repeated rows and ids, empty tables and
further columns, whatever their names, and passes those columns on; what it makes of each case is said at the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.llm import lines, minhash, packing, pii, quality
from spanloom.llm.common import SMALL, materialise
from spanloom.llm.queries import vocabulary

#: No SQL form: the classifier's floats, MinHash and the tokenizer have none; tests hold stages against brute force.
ORACLE_SQL = None


def _recounted(docs: DataFrame) -> DataFrame:
    """n_chars follows a text that a stage changed."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. Null texts are scored as empty ones; repeated rows fare alike."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of like lines one occurrence stays.

    Documents stay with what is left of their texts; those of which nothing is left (each of their lines stands
    elsewhere) go, so that no shells reach the next stages. Texts that were null or blank before stay. Repeated rows are
    the same occurrences, so they all keep the lines.
    """
    return _recounted(lines.dedup(docs, drop_emptied=True))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, similarity 0.8 or more.

    The smallest doc_id stays; of rows that repeat it, one (of equal rows any, of other texts in the same group the one
    with the smallest text key). Rows of one doc_id whose texts are not alike are told apart and stay. Null and blank
    texts, and rows without an id, are like nothing and stay, but equal rows with an id are one document.
    """
    found = materialise(minhash.link_rows(docs, 5, 80), "pipeline-links").where("doc_id is not null")
    first = F.min("tk").over(W.partitionBy("doc_id", "root"))
    repeated = found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    # ids are told by a count first: only rows of repeated ids go through the window
    again = materialise(found.join(repeated.select("doc_id"), "doc_id", "left_semi").where("kept and root is not null").withColumn("first", first), "pipeline-again")
    gone = found.where("not kept").select("doc_id", "tk").unionByName(again.where("tk <> first").select("doc_id", "tk")).distinct()
    gone = materialise(gone.select(F.col("doc_id").alias("_gone_id"), F.col("tk").alias("_gone_tk")), "pipeline-gone")
    # the documents stay where they are as long as the dropped ids are few; else both sides are shuffled
    keyed = docs.withColumns({"_own_id": F.col("doc_id").cast("long"), "_own_tk": minhash.text_key()})
    out = keyed.join(F.broadcast(gone) if gone.count() <= SMALL else gone, F.expr("_own_id = _gone_id and _own_tk = _gone_tk"), "left_anti")
    if not repeated.isEmpty():  # equal rows are one document
        out = out.where("_own_id is not null").dropDuplicates(["_own_id", "_own_tk"]).unionByName(out.where("_own_id is null"))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts becomes its kind. Null and empty texts, and rows without any, stay as they are."""
    return _recounted(pii.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens, by piece, with the pieces' ids. Null and empty texts are the single end id; repeated rows are packed each."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("quality", keep_good),
    ("line_dedup", dedup_lines),
    ("minhash", dedup_documents),
    ("pii", redact),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
