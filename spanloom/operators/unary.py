"""Operators that trim, re-order or filter one result set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import glob_regex
from .score import newsrank_factor

#: Scores are compared as rounded numbers, so that equal ones tie whatever the order of their sums.
PLACES = 9


def best_first(score: str = "score") -> list[Column]:
    return [F.round(score, PLACES).desc(), F.col("rec_id").desc()]


def boost(ir: DataFrame, w: float) -> DataFrame:
    return ir.withColumn("score", F.col("score") * F.lit(float(w)))


def hit_count(ir: DataFrame, n: float) -> DataFrame:
    """At least n hits; for a negative n at most |n|."""
    return ir.where(F.col("hit_count") >= int(n) if n >= 0 else F.col("hit_count") <= int(-n))


def trim(ir: DataFrame, n: float, total: int) -> DataFrame:
    """The best n rows; a fraction is a share of all records, and of a mixed number both parts count."""
    k = int(n) + int((n - int(n)) * total)
    return ir.orderBy(*best_first()).limit(k)


def reduce(ir: DataFrame, n: float = 0) -> DataFrame:
    """Records that match most terms.

    Rows are ranked by aux count; c0, c1 are the first two. n = 0 means c0. If c0 or c1 is n, rows of at
    least n terms stay; else rows over 1 term (n > 2) or any. The rows ranked before the point where the
    cut is looked for always stay: one, or two if neither count is n and there are four rows or more.
    """
    order = [F.col("aux_count").desc(), *best_first()]
    top = ir.orderBy(*order).limit(2).agg(F.sort_array(F.collect_list(F.struct("aux_count", F.round("score", PLACES).alias("r"), "rec_id")), asc=False).alias("t"))
    st = top.select(F.struct(F.get("t", F.lit(0))["aux_count"].alias("c0"), F.get("t", F.lit(1))["aux_count"].alias("c1"), F.col("t.rec_id").alias("ids"))).scalar()
    size = ir.agg(F.count("*")).scalar()
    x = ir.withColumn("_t", st).withColumn("_n", size)
    want = F.lit(int(n)) if n else F.col("_t.c0")
    met = (F.col("_t.c0") == want) | (F.col("_t.c1") == want)
    cut = F.when(met, want - 1).when(want > 2, F.lit(1)).otherwise(F.lit(0))
    always = F.when(met | (F.col("_n") < 4), 1).otherwise(2)
    stays = (F.col("aux_count") > cut) | F.array_contains(F.slice("_t.ids", F.lit(1), always), F.col("rec_id")) | (F.col("_n") <= 1)
    return x.where(stays).drop("_t", "_n")


def with_records(ir: DataFrame, records: DataFrame, cond: Column) -> DataFrame:
    return ir.join(records.where(cond).select("rec_id").hint("merge"), "rec_id", "left_semi")


def key_matches(glob: str) -> Column:
    return F.rlike("key", F.lit(glob_regex(glob)))


def file_matches(glob: str) -> Column:
    rx = F.lit(glob_regex(glob))
    return F.rlike("path", rx) | F.rlike("file", rx)


def date_between(lo, hi) -> Column:
    return F.col("date").between(F.lit(lo), F.lit(hi))


SORTS = {"score", "hits", "reversehits", "date", "reversedate", "auxcount", "index", "key", "newsrank", "category", "adjscore", "unsorted"}


def sort_order(by: str, now=None) -> list[Column]:
    """Ordering columns; the set must be joined with its records for date, key, category and newsrank."""
    b = by.lower()
    score, index = F.round("score", PLACES).desc(), F.col("rec_id").desc()
    table = {
        "score": [score, index], "hits": [F.col("hit_count").desc(), score, index], "reversehits": [F.col("hit_count"), score, index], "auxcount": [F.col("aux_count").desc(), score, index], "index": [F.col("rec_id")],
        "key": [F.col("key"), F.col("rec_id")], "category": [F.col("category").desc(), score, index], "adjscore": [score, F.col("category").desc(), index],
        "date": [F.col("date").desc_nulls_last(), score, index], "reversedate": [F.col("date").asc_nulls_last(), score, index], "unsorted": [],
    }
    if b == "newsrank":
        return [(newsrank_factor(F.col("date"), now) * F.round("score", PLACES)).desc_nulls_last(), F.col("date").desc_nulls_last(), index]
    if b not in table:
        raise ValueError(f"unknown sort order {by}")
    return table[b]


def drawn_together(categories: list[int], scores: list[float], factor: float, compat: bool = False) -> list[int]:
    """Positions of a list ranked by score, then category, after rows of one category have drawn together.

    For every row with a category, in order: as long as scores fall by no more than the factor's share of the whole range,
    a row of that category behind one of another moves up to it, with the one it passes behind it. With compat the two rows are
    written over those in their places, so that some rows appear twice and others are lost.
    """
    at, n = list(range(len(scores))), len(scores)
    if n <= 4 or not scores[0] or scores[0] == scores[-1]:
        return at
    gap = factor * (scores[0] - scores[-1]) / scores[0]
    for i in range(n - 3):
        mine = categories[at[i]]
        if not mine:
            continue
        for j in range(i + 1, n - 2):
            a, b = at[j], at[j + 1]
            if scores[a] > scores[b] + gap:
                break
            if categories[a] != mine and categories[b] == mine:
                if compat:
                    at[i + 1], at[i + 2] = b, a
                else:
                    at[i + 1 : j + 2] = [b, a, *at[i + 1 : j]]
    return at


def magnetism(top: DataFrame, factor: float, compat: bool = False) -> DataFrame:
    """Of a bounded top list ranked by score, then category: rows of one category draw together across small score gaps (see drawn_together).

    One pass down the list, so it runs as one task over the list that the caller limited.
    """

    def run(batches):
        import pandas as pd

        b = pd.concat(list(batches), ignore_index=True)
        b["r"] = b["score"].round(PLACES)
        b = b.sort_values(["r", "category", "rec_id"], ascending=[False, False, False]).reset_index(drop=True)
        if len(b):
            b = b.iloc[drawn_together(b["category"].tolist(), b["r"].tolist(), factor, compat)].reset_index(drop=True)
        b["place"] = range(1, len(b) + 1)
        yield b[["rec_id", "score", "category", "place"]]

    return top.select("rec_id", "score", "category").coalesce(1).mapInPandas(run, "rec_id long, score double, category int, place int")


def drop_by_terms(ir: DataFrame, least: int) -> DataFrame:
    return ir.where(F.col("aux_count") >= least)


def drop_by_score(ir: DataFrame, least: float) -> DataFrame:
    return ir.where(F.col("score") >= least)


def ranked(ir: DataFrame, by: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """The rows from offset on, at most limit, with their place. Only these reach the one task that numbers them."""
    top = ir.orderBy(*by).limit(offset + limit)
    return top.withColumn("place", F.row_number().over(W.orderBy(*by))).where(F.col("place") > offset)
