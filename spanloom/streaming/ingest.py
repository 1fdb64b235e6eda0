"""Extensions on streams: incremental indexing, time to live, and term counts over windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import postings


def read_folder(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    """Rows of the files that appear in a folder."""
    r = spark.readStream.schema(schema).format(fmt)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.load(path)


def index_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Postings of arriving records (rec_id, text), appended to a table; exactly once by the sink's log."""
    return postings(rows).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def watch(rows: DataFrame, action, checkpoint: str) -> StreamingQuery:
    """Calls action(batch, number) whenever a folder has changed."""
    return rows.writeStream.foreachBatch(action).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, ts: str, keys: list[str], width: str, late: str, value: str | None = None) -> DataFrame:
    """Counts (and sums) over tumbling windows; rows later than the watermark don't count."""
    aggs = [F.count("*").alias("n")] + ([F.sum(value).alias("total")] if value else [])
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), *keys).agg(*aggs).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", *(["total"] if value else []))


def alive(rows: DataFrame, expires: str, now=None) -> DataFrame:
    """Rows whose time to live hasn't passed; now defaults to the moment of the batch."""
    return rows.where(F.col(expires).isNull() | (F.col(expires) > (F.lit(now) if now is not None else F.current_timestamp())))
