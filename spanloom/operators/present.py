"""Presentation: contents of elements, contexts, containers, highlights, records by key, output formats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import byte_slice
from ..sources.database import Database
from ..sources.scratch import written
from .proximity import containers, exploded


def content(db: Database, spans: DataFrame) -> DataFrame:
    """spans (rec_id, s, e, ...) with their content."""
    return spans.join(db.texts, "rec_id").withColumn("content", byte_slice(F.col("text"), F.col("s"), F.col("e"))).drop("text")


def present(db: Database, ir: DataFrame, element: str = "F") -> DataFrame:
    """rec_id, content: F the full text, B and H its first line, S the first 200 characters, R raw with hits kept out, L the language, M metadata; else a field's contents, one under another."""
    r = ir.select("rec_id").distinct().join(db.texts, "rec_id")
    el = element.upper()
    if el in ("F", "R"):
        return r.select("rec_id", F.col("text").alias("content"))
    if el in ("B", "H"):
        return headline(db, ir).withColumnRenamed("headline", "content")
    if el == "S":
        return r.select("rec_id", F.substring(F.regexp_replace("text", r"\s+", " "), 1, 200).alias("content"))
    if el in ("L", "M"):
        m = db.records.join(ir.select("rec_id").distinct(), "rec_id", "left_semi")
        return m.select("rec_id", F.col("lang").alias("content") if el == "L" else F.to_json(F.struct("key", "doctype", "lang", "path", "category", "date", "length")).alias("content"))
    f = content(db, db.fields.where(F.col("field") == el).join(ir.select("rec_id").distinct(), "rec_id", "left_semi"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("s", "e", "content"))), lambda x: x["content"])
    return f.groupBy("rec_id").agg(F.array_join(parts, "\n").alias("content"))


def headline(db: Database, ir: DataFrame, width: int = 80) -> DataFrame:
    """rec_id, headline: the first line that isn't blank, cut to a width."""
    r = ir.select("rec_id").distinct().join(db.texts, "rec_id")
    line = F.trim(F.regexp_extract("text", r"^\s*([^\n]*)", 1))
    return r.select("rec_id", F.when(F.length(line) > width, F.concat(F.substring(line, 1, width - 3), F.lit("..."))).otherwise(line).alias("headline"))


def contexts(db: Database, ir: DataFrame, around: int = 40) -> DataFrame:
    """rec_id, n (from 1), s, e, before, hit, after: text around every hit, in characters."""
    h = ir.select("rec_id", F.array_sort("hits").alias("hits")).join(db.texts.hint("merge"), "rec_id").select("rec_id", "hits", "text")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            # a few records at a time, so that what is cut out of them stays small
            for at in range(0, len(b), 64):
                part = b.slice(at, 64)
                cols: list[list] = [[] for _ in range(7)]
                for rec, hits, text in zip(*(c.to_pylist() for c in part.columns)):
                    if not hits or text is None:
                        continue
                    s, e = [x["s"] for x in hits], [x["e"] for x in hits]
                    first, last = s, [x + 1 for x in e]
                    if not text.isascii():
                        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
                        ends = np.cumsum(1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))
                        first, last = np.searchsorted(ends, s, "right").tolist(), np.searchsorted(ends, last, "left") + 1
                        last = last.tolist()
                    for c, x in zip(cols, ([rec] * len(s), range(1, len(s) + 1), s, e, [text[max(0, i - around) : i] for i in first], [text[i:j] for i, j in zip(first, last)], [text[j : j + around] for j in last])):
                        c += x
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()))], names=["rec_id", "n", "s", "e", "before", "hit", "after"])

    return h.mapInArrow(run, "rec_id bigint, n int, s bigint, e bigint, before string, hit string, after string")


def nth_context(db: Database, ir: DataFrame, n: int, around: int = 40) -> DataFrame:
    return contexts(db, ir, around).where(F.col("n") == n)


def best_hit(ir: DataFrame) -> DataFrame:
    """rec_id, s, e of the hit that is closest to its successor; the only hit, if there is one."""
    h = exploded(ir).withColumn("gap", F.lead("s").over(W.partitionBy("rec_id").orderBy("s", "e")) - F.col("e"))
    return h.groupBy("rec_id").agg(F.min_by(F.struct("s", "e"), F.struct(F.coalesce("gap", F.lit(1 << 40)), F.col("s"))).alias("h")).select("rec_id", "h.s", "h.e")


def peer_spans(db: Database, ir: DataFrame) -> DataFrame:
    """rec_id, hs, he (the hit), field, s, e (its smallest container)."""
    c = containers(exploded(ir), db.fields)
    return c.select("rec_id", F.col("s").alias("hs"), F.col("e").alias("he"), F.col("pf").alias("field"), F.col("ps").alias("s"), F.col("pe").alias("e"))


def peer_content(db: Database, ir: DataFrame) -> DataFrame:
    return content(db, peer_spans(db, ir))


def ancestor_content(db: Database, ir: DataFrame, field: str) -> DataFrame:
    """Contents of the field's instances that hold a hit."""
    f = db.fields.where(F.col("field") == field.upper()).select("rec_id", F.col("s").alias("fs"), F.col("e").alias("fe"))
    a = exploded(ir).join(f, "rec_id").where("fs <= s and fe >= e").select("rec_id", F.col("fs").alias("s"), F.col("fe").alias("e")).distinct()
    return content(db, a)


def descendants_content(db: Database, ir: DataFrame, ancestor: str, descendant: str) -> DataFrame:
    """ancestor\\descendant: contents of one field's instances inside the other's that hold a hit."""
    a = ancestor_content(db, ir, ancestor).select("rec_id", F.col("s").alias("as"), F.col("e").alias("ae"))
    d = db.fields.where(F.col("field") == descendant.upper()).select("rec_id", "s", "e").join(a, "rec_id").where("as <= s and ae >= e")
    return content(db, d.select("rec_id", "s", "e").distinct())


def node_tree(db: Database, ir: DataFrame) -> DataFrame:
    """rec_id, hs, he, nodes: every hit's chain of containers, outermost first."""
    f = db.fields.select("rec_id", "field", F.col("s").alias("fs"), F.col("e").alias("fe"))
    j = exploded(ir, "hs", "he").join(f, "rec_id").where("fs <= hs and fe >= he")
    node = F.struct((F.col("fs") - F.col("fe")).alias("n"), F.col("fs"), F.col("field"), F.col("fe"))
    chain = F.transform(F.array_sort(F.collect_set(node)), lambda x: F.struct(x["field"].alias("field"), x["fs"].alias("s"), x["fe"].alias("e")))
    return j.groupBy("rec_id", "hs", "he").agg(chain.alias("nodes"))


def hit_table_json(db: Database, ir: DataFrame) -> DataFrame:
    """rec_id, json: hits with their node chains."""
    t = node_tree(db, ir)
    return t.groupBy("rec_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("hs", "he", "nodes")))).alias("json"))


def hit_table_xml(db: Database, ir: DataFrame) -> DataFrame:
    t = node_tree(db, ir).select("rec_id", "hs", "he", F.array_join(F.transform("nodes", lambda x: F.format_string('<node name="%s" s="%d" e="%d"/>', x["field"], x["s"], x["e"])), "").alias("x"))
    one = F.struct("hs", "he", F.format_string('<hit s="%d" e="%d">%s</hit>', "hs", "he", "x").alias("x"))
    return t.groupBy("rec_id").agg(F.concat(F.lit("<hits>"), F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["x"]), ""), F.lit("</hits>")).alias("xml"))


def highlighted(db: Database, ir: DataFrame, before: str = "<b>", after: str = "</b>") -> DataFrame:
    """rec_id, text with every hit marked. Hits that overlap an earlier one stay unmarked."""
    h = ir.select("rec_id", F.array_sort("hits").alias("hits")).join(db.texts, "rec_id").select("rec_id", "text", "hits", F.encode("text", "UTF-8").alias("b"))
    part = lambda s, e: F.decode(F.substring("b", (s + 1).cast("int"), (e - s).cast("int")), "UTF-8")
    zero = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).cast("bigint").alias("at"))

    def add(acc, x):
        piece = F.concat(part(acc["at"], x["s"]), F.lit(before), part(x["s"], x["e"] + 1), F.lit(after))
        return F.when(x["s"] < acc["at"], acc).otherwise(F.struct(F.concat(acc["parts"], F.array(piece)).alias("parts"), (x["e"] + 1).alias("at")))

    h = h.select("rec_id", "text", "b", F.aggregate("hits", zero, add).alias("m"))
    tail = part(F.col("m.at"), F.octet_length("text").cast("bigint"))
    return h.select("rec_id", F.when(F.size("m.parts") > 0, F.concat(F.array_join("m.parts", ""), tail)).otherwise(F.col("text")).alias("text"))


def summary(db: Database, ir: DataFrame, sentences: int = 2, width: int = 200) -> DataFrame:
    """rec_id, summary: the sentences that hold most hits, in the text's order, cut to a width."""
    s = db.texts.join(ir.select("rec_id"), "rec_id", "left_semi").select("rec_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"[^.!?]+[.!?]*|[.!?]+"), F.lit(0))).alias("k", "raw"))
    w = W.partitionBy("rec_id").orderBy("k")
    s = s.withColumn("e", F.sum(F.octet_length("raw")).over(w)).withColumn("s", F.col("e") - F.octet_length("raw"))
    hits = exploded(ir, "hs", "he")
    n = s.join(hits, "rec_id", "left").groupBy("rec_id", "k", "raw").agg(F.sum(F.when((F.col("hs") >= F.col("s")) & (F.col("hs") < F.col("e")), 1).otherwise(0)).alias("n"))
    top = n.withColumn("r", F.row_number().over(W.partitionBy("rec_id").orderBy(F.desc("n"), "k"))).where(F.col("r") <= sentences)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "raw"))), lambda x: F.trim(F.regexp_replace(x["raw"], r"\s+", " "))), " ")
    return top.groupBy("rec_id").agg(F.left(text, F.lit(width)).alias("summary"))


def key_lookup(db: Database, key: str) -> DataFrame:
    return db.records.where(F.col("key") == key)


def neighbour_keys(db: Database) -> DataFrame:
    """rec_id, key, previous, next in key order. Ranges of keys go to tasks; each takes its borders from the ranges' ends."""
    n = int(db.spark.conf.get("spark.sql.shuffle.partitions"))
    # written, for the ranges' borders are sampled and small ranges put together at run time: worked out twice, the numbers of the parts may differ
    r = written(db.live.select("rec_id", "key").repartitionByRange(n, "key").withColumn("part", F.spark_partition_id()), "ranges")
    w = W.partitionBy("part").orderBy("key", "rec_id")
    r = r.select("rec_id", "key", "part", F.lag("key").over(w).alias("previous"), F.lead("key").over(w).alias("next"))
    ends = r.groupBy("part").agg(F.min("key").alias("lo"), F.max("key").alias("hi"))  # one row a task
    over = W.orderBy("part")
    ends = ends.select("part", F.lag("hi").over(over).alias("before"), F.lead("lo").over(over).alias("after"))
    r = r.join(F.broadcast(ends), "part")
    return r.select("rec_id", "key", F.coalesce("previous", "before").alias("previous"), F.coalesce("next", "after").alias("next"))


def first_last_key(db: Database) -> DataFrame:
    return db.live.agg(F.min("key").alias("first"), F.max("key").alias("last"))


_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"))


def formatted(db: Database, ir: DataFrame, syntax: str = "SUTRS") -> DataFrame:
    """rec_id, record in SUTRS (plain), HTML, SGML, XML, RAW, JSON or USMARC-like lines."""
    r = ir.select("rec_id", "score").join(db.records.select("rec_id", "key", "doctype", "lang").hint("merge"), "rec_id").join(db.texts.hint("merge"), "rec_id")
    esc = F.col("text")
    for x, y in _ESCAPES:
        esc = F.replace(esc, F.lit(x), F.lit(y))
    s = syntax.upper()
    if s == "SUTRS":
        rec = F.format_string("Key: %s\nDoctype: %s\n\n%s", "key", F.coalesce("doctype", F.lit("")), "text")
    elif s == "HTML":
        rec = F.concat(F.lit("<html><head><title>"), F.col("key"), F.lit("</title></head><body><pre>"), esc, F.lit("</pre></body></html>"))
    elif s in ("SGML", "XML"):
        rec = F.concat(F.lit("<?xml version=\"1.0\" encoding=\"UTF-8\"?>" if s == "XML" else ""), F.lit("<record key=\""), F.col("key"), F.lit("\">"), esc, F.lit("</record>"))
    elif s == "RAW":
        rec = F.col("text")
    elif s == "JSON":
        rec = F.to_json(F.struct("key", "doctype", "lang", F.round("score", 6).alias("score"), "text"))
    elif s == "USMARC":
        rec = F.format_string("001 %s\n041 0 $a%s\n520 $a%s", "key", F.coalesce("lang", F.lit("")), F.regexp_replace("text", r"\s+", " "))
    else:
        raise ValueError(f"unknown syntax {syntax}")
    return r.select("rec_id", rec.alias("record"))
