"""Exact top-k search by inner product over an impact-ordered index, a batch of queries at a time.

A block of candidates is indexed as two planes: components rounded to multiples of LEVEL, and what rounding took from
them; the dimensions with the largest levels come first. For a batch of queries, impacts (query component times level) are
added to accumulators in that order, STEP dimensions at a time as one matrix product. A candidate's score can't differ from its
accumulator by more than the norms of the query and the candidate in what is still open allow (Cauchy-Schwarz). A query's
processing stops only when those bounds prove that few candidates can be members of the
top k, or when nothing is open; all possible members are then rescored exactly, in integers.

Queries are met with all rows in blocks: every row lies in one block of bounded size, which is indexed once, and
every query is sent to every block and streams by its index. Blocks return k rows a query.

Vectors that are null, empty or hold null or non-finite components take no part; of two lengths the shorter
counts as padded by zeros. A query's own row is not its candidate; other rows of the same id are. Repeated rows are all
candidates, and repeated queries are all answered; ties go to the smaller id. Empty tables give no rows. Vectors with a
component beyond LARGE are scored in whole numbers of any size; a score that no long holds is given as the nearest long.
Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, ship
from .vectors import matrix, usable

LEVEL = 16
CANDIDATES = 8_192
FEW = 48
#: Dimensions that are added between two proofs.
STEP = 256
#: Candidates of which only the best one counts when the k-th score is bounded.
FOLD = 32
#: Queries that are met with a block at once, and pairs that are rescored at once.
QUERIES, RESCORED = 256, 65_536
#: Up to this size of its components the inner product of two vectors of up to 2,048 components fits a long, and a double.
LARGE = 1 << 20


class ImpactIndex:
    """Impact-ordered planes of a block of integer vectors: levels, then what rounding took from them, large dimensions first."""

    def __init__(self, x: np.ndarray):
        self.x = x
        level = LEVEL * np.rint(x / LEVEL)
        self.order = np.argsort(-(level * level).sum(0), kind="stable")
        planes = level[:, self.order], (x - level)[:, self.order]
        self.norm = max((np.linalg.norm(p, axis=1).max(initial=0) for p in (x.astype(float), planes[0])), default=0.0)
        # sums of whole numbers below 2 ** 24 are exact in floats
        self.planes = {t: [np.ascontiguousarray(p.T, t) for p in planes] for t in (np.float32, np.float64)}
        # norm of the largest row in the dimensions from each one on
        self.rest = [np.sqrt(np.append(np.cumsum((p * p)[:, ::-1], axis=1).max(axis=0, initial=0)[::-1], 0)) for p in planes]

    def top(self, q: np.ndarray, k: int, ids: np.ndarray, rows: np.ndarray, own: int) -> list[tuple[int, int]]:
        """(id, score) of the k best rows but `own`, by score, then id."""
        _, i, s = self.tops(q[None, :], k, ids, rows, np.array([own]))
        return [(int(a), int(b)) for a, b in zip(i, s)]

    def tops(self, q: np.ndarray, k: int, ids: np.ndarray, rows: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the query, id and score of each query's k best rows but its own, by query, score and id."""
        n, width = self.x.shape
        sizes = np.linalg.norm(q, axis=1)
        kind = np.float32 if sizes.max(initial=0) * self.norm < 1 << 24 else np.float64
        slop = 1e-6 + width * 2.0**-52 * sizes * self.norm
        sent = np.ascontiguousarray(q[:, self.order], kind)
        acc = np.zeros((len(q), n), kind)
        place = np.argsort(rows, kind="stable")
        at = np.searchsorted(rows, own, sorter=place).clip(max=n - 1)
        mine = rows[place[at]] == own if n else np.zeros(len(q), bool)
        acc[np.flatnonzero(mine), place[at[mine]]] = -np.inf
        found_q, found_c = [], []
        live = np.arange(len(q))  # queries with too many possible members
        for plane, lo in [(p, lo) for p in (0, 1) for lo in range(0, width, STEP)]:
            hi = min(lo + STEP, width)
            acc += sent[live, lo:hi] @ self.planes[kind][plane][lo:hi]
            last = plane == 1 and hi == width
            # what is open in this plane and in the next one bounds what a candidate can still get or lose
            room = np.linalg.norm(sent[live, hi:].astype(float), axis=1) * self.rest[plane][hi] + (sizes[live] * self.rest[1][0] if plane == 0 else 0)
            fold = FOLD if n >= 2 * FOLD * k else 1
            # the k-th best of groups' best is no better than the k-th best
            best = acc[:, : n // fold * fold].reshape(len(live), fold, n // fold).max(axis=1) if fold > 1 else acc
            floor = np.partition(best, best.shape[1] - k, axis=1)[:, best.shape[1] - k].astype(float) if best.shape[1] >= k else np.full(len(live), -np.inf)
            possible = acc >= np.maximum(floor - 2 * room - slop[live], np.finfo(kind).min)[:, None]
            done = np.full(len(live), True) if last else possible.sum(axis=1) <= FEW
            a, c = np.nonzero(possible[done])
            found_q.append(live[done][a])
            found_c.append(c)
            live, acc = live[~done], acc[~done]
            if not len(live):
                break
        qi, ci = np.concatenate(found_q), np.concatenate(found_c)
        whole = q.astype(np.int64)
        exact = np.zeros(len(qi), np.int64)
        for lo in range(0, len(qi), RESCORED):
            some = slice(lo, lo + RESCORED)
            exact[some] = (self.x[ci[some]] * whole[qi[some]]).sum(axis=1)
        order = np.lexsort((ids[ci], -exact, qi))
        qi, ci, exact = qi[order], ci[order], exact[order]
        keep = np.arange(len(qi)) - np.searchsorted(qi, qi) < k
        return qi[keep], ids[ci[keep]], exact[keep]


class Block:
    """Candidates of one block: an index of the ordinary ones, and the few with large components."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, x: np.ndarray):
        big = np.abs(x).max(axis=1, initial=0) > LARGE
        self.all = rows, ids, x
        self.rows, self.ids, self.index = rows[~big], ids[~big], ImpactIndex(x[~big].astype(np.int64))
        self.big = rows[big], ids[big], x[big]

    def tops(self, q: np.ndarray, k: int, own: np.ndarray) -> list[tuple[int, int, int]]:
        """(number of the query, id, score) of each query's k best rows but its own."""
        large = np.abs(q).max(axis=1, initial=0) > LARGE
        out = [(i, *b) for i in np.flatnonzero(large) for b in _exact(q[i], k, own[i], *self.all)]
        small = np.flatnonzero(~large)
        if len(small) and len(self.rows):
            for lo in range(0, len(small), QUERIES):
                part = small[lo : lo + QUERIES]
                out += [(part[i], a, s) for i, a, s in zip(*(x.tolist() for x in self.index.tops(q[part], k, self.ids, self.rows, own[part])))]
        # the best k of both kinds are told apart by the rank over all blocks
        return out + [(i, *b) for i in small for b in _exact(q[i], k, own[i], *self.big)] if len(self.big[0]) else out


def _exact(q: np.ndarray, k: int, own: int, rows: np.ndarray, ids: np.ndarray, x: np.ndarray) -> list[tuple[int, int]]:
    whole = [int(v) for v in q]
    scored = [(int(i), sum(a * int(b) for a, b in zip(whole, y))) for r, i, y in zip(rows, ids, x) if r != own]
    return sorted(scored, key=lambda b: (-b[1], b[0]))[:k]


def quantise(x: np.ndarray) -> np.ndarray:
    """floor(256 x), as doubles; a component that overflows even those counts as the largest one."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(256 * x), -np.finfo(float).max, np.finfo(float).max)


def search(rows: DataFrame, is_query, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for each row of (vec_id, embedding) that is_query picks."""
    spark = rows.sparkSession
    ship(spark)
    base = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    base = base.where(usable("v") & F.col("vec_id").isNotNull()).withColumn("row", F.monotonically_increasing_id())
    base = materialise(base, "impact-rows")
    size = base.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("w")).first()
    width = size["w"] or 1
    blocks = max(1, -(-size["n"] // CANDIDATES))
    # a block's rows: the hash of the row number, not of the vector, so that copies spread
    cand = base.select(F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("role"), "row", "vec_id", "v")
    quer = base.where(is_query).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("role"), "row", "vec_id", "v")

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, parts, here = None, [], None
        for b in batches:
            # a block's candidates come first, then its queries
            for (block, role), x in b.groupby(["block", "role"]):
                if block != at:
                    at, parts, here = block, [], None
                if role == 0:
                    parts.append((x["row"].to_numpy(), x["vec_id"].to_numpy(), quantise(matrix(x["v"].tolist(), width))))
                    continue
                if here is None and parts:
                    here = Block(*(np.concatenate(p) for p in zip(*parts)))
                out = []
                if here is not None:
                    row, own = x["row"].to_numpy(), x["vec_id"].to_numpy()
                    out = [(row[n], own[n], i, max(-(1 << 63), min((1 << 63) - 1, s))) for n, i, s in here.tops(quantise(matrix(x["v"].tolist(), width)), k, row)]
                yield pd.DataFrame(out, columns=["row", "query_id", "vec_id", "score"]).astype("int64")

    met = cand.unionByName(quer).repartition("block").sortWithinPartitions("block", "role")
    got = met.mapInPandas(meet, "row long, query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return got.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
