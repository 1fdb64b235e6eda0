"""Typed predicates: numbers, dates, intervals, boxes, hashes, identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import bounds, parse_range
from ..plans.ast import QueryError
from .boolean import HITS

RELATIONS = {"=", "<>", "<", "<=", ">", ">="}


def _set(rows: DataFrame) -> DataFrame:
    return rows.groupBy("rec_id").agg(F.count("*").alias("hit_count"), F.lit(1).cast("bigint").alias("aux_count"), F.array_sort(F.collect_set(F.struct("s", "e"))).alias("hits"))


def of_field(table: DataFrame, field: str) -> DataFrame:
    if "*" in field or "?" in field:
        from ..functions.text import glob_regex

        return table.where(F.rlike("field", F.lit(glob_regex(field))))
    return table.where(F.col("field") == field)


def compare(c: Column, relation: str, v) -> Column:
    v = v if isinstance(v, Column) else F.lit(v)
    ops = {"=": c == v, "<>": c != v, "<": c < v, "<=": c <= v, ">": c > v, ">=": c >= v}
    if relation not in ops:
        raise QueryError(117, relation)
    return ops[relation]


def numeric(table: DataFrame, field: str, relation: str, text: str) -> DataFrame:
    try:
        v = float(text)
    except ValueError:
        raise QueryError(125, text) from None
    rows = of_field(table, field)
    if relation == "<>":  # the complement within the field
        return _set(rows.join(rows.where(F.col("value") == v).select("rec_id"), "rec_id", "left_anti"))
    return _set(rows.where(compare(F.col("value"), relation, v)))


def currency_value(c: Column) -> Column:
    """Amount of money as decimal(18,4): symbols, codes and thousands separators go."""
    x = F.regexp_replace(c, r"[^0-9.,-]", "")
    x = F.when(F.rlike(x, F.lit(r",[0-9]{2}$")), F.regexp_replace(F.regexp_replace(x, r"\.", ""), ",", ".")).otherwise(F.regexp_replace(x, ",", ""))
    return x.try_cast("decimal(18,4)")


def date_point(table: DataFrame, field: str, relation: str, text: str) -> DataFrame:
    """Dates with a precision: = means within the query's year, month or day; the others compare whole intervals."""
    lo, hi = bounds(text)
    a, b = F.lit(lo), F.lit(hi)
    rows = of_field(table, field)
    cond = {"=": (F.col("lo") >= a) & (F.col("hi") <= b), "<": F.col("hi") < a, "<=": F.col("hi") <= b, ">": F.col("lo") > b, ">=": F.col("lo") >= a}
    if relation == "<>":
        return _set(rows.join(rows.where(cond["="]).select("rec_id"), "rec_id", "left_anti"))
    if relation not in cond:
        raise QueryError(117, relation)
    return _set(rows.where(cond[relation]))


def interval_condition(relation: str, fs: Column, fe: Column, qs, qe) -> Column:
    """The relation matrix of a stored interval [fs, fe] and a query interval [qs, qe]."""
    qs, qe = F.lit(qs), F.lit(qe)
    table = {
        "before": fs < qs, "before_strict": fe < qs, "before_during": fs <= qe, "before_during_strict": fe <= qe, "during": fs.between(qs, qe) | fe.between(qs, qe), "during_strict": (fs > qs) & (fe < qe),
        "during_after": fe >= qs, "during_after_strict": fs >= qs, "after": fe > qe, "after_strict": fs > qe,
    }
    same = {"<": "before", "<=": "before_during_strict", "=": "during", ">": "after", "<{": "before_strict", "<[": "before_during", ">{": "after_strict", ">[": "during_after", ">=": "during_after_strict"}
    name = same.get(relation, relation)
    if name not in table:
        raise QueryError(117, relation)
    return table[name]


def date_interval(table: DataFrame, field: str, relation: str, text: str) -> DataFrame:
    qs, qe = parse_range(text)
    return _set(of_field(table, field).where(interval_condition(relation, F.col("lo"), F.col("hi"), qs, qe)))


def number_interval(table: DataFrame, field: str, relation: str, lo: float, hi: float) -> DataFrame:
    return _set(of_field(table, field).where(interval_condition(relation, F.col("lo"), F.col("hi"), lo, hi)))


def hash_key(c: Column, fold: bool = True) -> Column:
    """Key of a hashed field: quotes and outer and repeated white space don't count; nor does case, if folded."""
    x = F.trim(F.regexp_replace(F.regexp_replace(c, "[\"']", ""), r"\s+", " "))
    return F.hex(F.xxhash64(F.lower(x) if fold else x))


def hashed(table: DataFrame, field: str, text: str, fold: bool = True) -> DataFrame:
    return _set(of_field(table, field).where(hash_key(F.col("value"), fold) == hash_key(F.lit(text), fold)))


def lexical(table: DataFrame, field: str, relation: str, text: str) -> DataFrame:
    """Comparison of the first eight lower-cased characters."""
    return _set(of_field(table, field).where(compare(F.substring(F.lower("value"), 1, 8), relation, F.substring(F.lower(F.lit(text)), 1, 8))))


def _overlap(a: Column, b: Column, c: Column, d: Column) -> Column:
    return F.greatest(F.least(b, d) - F.greatest(a, c), F.lit(0.0))


def box_overlap(n: float, w: float, s: float, e: float) -> Column:
    """Stored box (n, w, so, ea) touches the query box; a west beyond the east crosses the date line."""
    lat = (F.col("so") <= F.lit(n)) & (F.col("n") >= F.lit(s))
    meets = lambda w1, e1, w2, e2: (w1 <= e2) & (e1 >= w2)
    parts = [(w, e)] if w <= e else [(w, 180.0), (-180.0, e)]
    lon = None
    for a, b in parts:
        stored = F.when(F.col("w") <= F.col("ea"), meets(F.col("w"), F.col("ea"), F.lit(a), F.lit(b))).otherwise(meets(F.col("w"), F.lit(180.0), F.lit(a), F.lit(b)) | meets(F.lit(-180.0), F.col("ea"), F.lit(a), F.lit(b)))
        lon = stored if lon is None else lon | stored
    return lat & lon


def box_score(n: float, w: float, s: float, e: float) -> Column:
    """Square root of the overlap's share of the stored box times its share of the query box."""
    lat = _overlap(F.col("so"), F.col("n"), F.lit(s), F.lit(n))
    parts = [(w, e)] if w <= e else [(w, 180.0), (-180.0, e)]
    lon = None
    for a, b in parts:
        x = F.when(F.col("w") <= F.col("ea"), _overlap(F.col("w"), F.col("ea"), F.lit(a), F.lit(b))).otherwise(_overlap(F.col("w"), F.lit(180.0), F.lit(a), F.lit(b)) + _overlap(F.lit(-180.0), F.col("ea"), F.lit(a), F.lit(b)))
        lon = x if lon is None else lon + x
    width = F.when(F.col("w") <= F.col("ea"), F.col("ea") - F.col("w")).otherwise(360 - F.col("w") + F.col("ea"))
    own = (F.col("n") - F.col("so")) * width
    query = (n - s) * ((e - w) if w <= e else 360 - w + e)
    area = lat * lon
    part = lambda whole: F.when(whole > 0, area / F.nullif(whole, F.lit(0.0))).otherwise(F.lit(0.0))
    return F.sqrt(part(own) * part(F.lit(float(query))))


def boxes(table: DataFrame, field: str | None, text: str) -> DataFrame:
    """A set with gscore. text: N,W,S,E."""
    try:
        n, w, s, e = (float(x) for x in text.split(","))
    except ValueError:
        raise QueryError(125, text) from None
    rows = table if field is None else of_field(table, field)
    rows = rows.where(box_overlap(n, w, s, e)).withColumn("g", box_score(n, w, s, e))
    return rows.groupBy("rec_id").agg(F.count("*").alias("hit_count"), F.lit(1).cast("bigint").alias("aux_count"), F.array().cast(HITS).alias("hits"), F.max("g").alias("gscore"))
