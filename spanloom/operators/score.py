"""Score normalisations of a term's result set.

A set has rec_id, hit_count (tf), aux_count, hits. N is the number of records, df the set's rows,
idf = ln(N / df). Where a norm is zero, scores are zero.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METHODS = ("none", "l2", "l1", "max", "log", "bytes", "af", "cosine_metric", "aux1", "aux2", "aux3")


#: Constants of the AF method: how strongly frequencies are damped, and how query weights saturate.
AF_DAMP, AF_K = 0.75, 7 - 1000


def _div(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / F.nullif(b, F.lit(0.0)))


def normalise(ir: DataFrame, total: int, method: str = "l2", weight: float = 1.0, lengths: DataFrame | None = None, extra: str | None = None) -> DataFrame:
    """The set with its score. extra: a column added to tf * idf before norms (the geographic score)."""
    w, tf = F.lit(float(weight)), F.col("hit_count").cast("double")
    if method in ("none", "aux1", "aux2", "aux3"):
        return ir.withColumn("score", F.lit(0.0))
    x = F.col(extra) if extra else F.lit(0.0)
    stat = ir.agg(
        F.count("*").alias("df"), F.sum(tf * tf).alias("t2"), F.sum(tf).alias("t1"), F.max(tf).alias("tm"), F.sum(x * x).alias("x2"), F.sum(tf * x).alias("tx"), F.sum(x).alias("x1"), F.sum(F.log1p(tf)).alias("tl")
    ).select(F.struct("*")).scalar()
    ir = ir.withColumn("_st", stat)
    df = F.greatest(F.col("_st.df"), F.lit(1))
    idf = F.log(F.lit(float(total)) / df)
    s = tf * idf + x
    if method in ("l2", "cosine_metric"):
        norm = F.sqrt(F.col("_st.t2") * idf * idf + 2 * idf * F.col("_st.tx") + F.col("_st.x2"))
        score = _div(s * w, norm)
    elif method == "l1":
        score = _div(s * w, F.col("_st.t1") * F.abs(idf) + F.abs(F.col("_st.x1")))
    elif method == "max":
        score = (0.4 + 0.6 * _div(s, F.col("_st.tm") * idf)) * w
    elif method == "log":
        score = F.when(s > 0, (1 + F.log(s)) * w).otherwise(F.lit(0.0))
    elif method == "bytes":
        if lengths is None:
            raise ValueError("lengths are needed")
        ir = ir.join(lengths.select("rec_id", "length"), "rec_id", "left")
        score = tf * w * idf / (1 + F.log(F.greatest(F.col("length").cast("double"), F.lit(1.0))))
    elif method == "af":
        # over the set's sum of damped frequencies; weights of -1 or less have no logarithm and score nothing
        if weight <= -1 or weight == 0:
            score = F.lit(0.0)
        else:
            share = F.log((F.lit(float(total)) - idf + 0.5) / (idf + 0.5)) * F.lit(math.log(weight + 1))
            damped = F.lit(AF_DAMP * (AF_K + 1) * weight / (AF_K + weight)) * share * F.col("_st.tl")
            score = _div(_div(tf * idf, share) + x, F.when(damped == 0, F.lit(1.0)).otherwise(F.abs(damped))) * w
    else:
        raise ValueError(f"unknown normalisation {method}")
    return ir.withColumn("score", score).drop("_st", "length")


_NEAR = ((4, 20.0), (10, 8.0), (100, 1.5), (1000, 1.0))


def distance_factor(gap: Column) -> Column:
    out = None
    for most, f in _NEAR:
        out = F.when(gap <= most, f) if out is None else out.when(gap <= most, f)
    return out.otherwise(0.98)


def distance_weighted(ir: DataFrame) -> DataFrame:
    """Final pass of the distance metric: records that match several terms gain by their closest consecutive hits."""
    h = F.array_sort("hits")
    gaps = F.zip_with(F.slice(h, F.lit(1), F.greatest(F.size(h) - 1, F.lit(0))), F.slice(h, F.lit(2), F.greatest(F.size(h) - 1, F.lit(0))), lambda a, b: b["s"] - a["e"])
    closest = F.array_min(gaps)
    return ir.withColumn("score", F.when((F.col("aux_count") > 1) & (F.size("hits") > 1), F.col("score") * distance_factor(closest)).otherwise(F.col("score")))


def scaled(ir: DataFrame, factor: int = 100) -> DataFrame:
    """scaled: scores as whole numbers from 1 to factor."""
    ends = ir.agg(F.min("score").alias("lo"), F.max("score").alias("hi")).select(F.struct("*")).scalar()
    ir = ir.withColumn("_m", ends)
    share = _div(F.col("score") - F.col("_m.lo"), F.col("_m.hi") - F.col("_m.lo"))
    return ir.withColumn("scaled", F.greatest(F.lit(1), F.least(F.lit(factor), (F.floor(share * (factor - 1) + 0.5) + 1).cast("int")))).drop("_m")


def with_priority(ir: DataFrame, factor: float) -> DataFrame:
    """Scores raised by the factor over the record's priority (none: nothing); the factor is taken in the scores' range."""
    ends = ir.agg(F.min("score").alias("lo"), F.max("score").alias("hi")).select(F.struct("*")).scalar()
    ir = ir.withColumn("_m", ends)
    share = F.when((F.col("_m.hi") != 0) & (F.col("_m.hi") != F.col("_m.lo")), F.lit(factor) * (F.col("_m.hi") - F.col("_m.lo")) / F.nullif(F.col("_m.hi"), F.lit(0.0))).otherwise(F.lit(factor))
    return ir.withColumn("score", F.col("score") + F.when(F.col("priority") != 0, share / F.nullif(F.col("priority"), F.lit(0))).otherwise(F.lit(0.0))).drop("_m")


#: Newsrank: additions up to an age in days, then factors up to an age in hours.
_AGES = ((1, 5.0), (2, 4.0), (3, 1.75), (7, 0.75), (14, 0.55), (24, 0.43), (60, 0.32), (100, 0.21), (300, 0.10))
_HOURS = ((2, 12.0), (3, 9.0), (4, 6.2), (8, 4.6), (12, 3.2), (16, 2.6), (23, 2.2))


def newsrank_factor(date: Column, now: Column) -> Column:
    """Weight of a record by its age in hours at `now`."""
    hours = F.floor((F.unix_timestamp(now) - F.unix_timestamp(date)) / 3600).cast("int")
    hours = F.when((hours < 0) & (hours > -18), 2).otherwise(hours)
    # whole days towards zero
    days = F.when(hours < 0, -F.floor(-hours / 24)).otherwise(F.floor(hours / 24)).cast("int")
    w = F.when(days == -1, F.lit(-7.0)).when(days < 0, days * 6.0).when(days == 0, F.lit(10.0)).otherwise(F.lit(1.0))
    for most, gain in _AGES:
        w = w + F.when(days <= most, gain).otherwise(0.0)
    factor = None
    for most, f in _HOURS:
        factor = F.when(hours <= most, f) if factor is None else factor.when(hours <= most, f)
    return w * factor.otherwise(1.0)
