"""Near-duplicate vectors through an inverted multi-index.

Two codebooks, one for each half of the unit vectors, span a grid of cells; every vector is a member of the
cell of its nearest centroids. A vector's search visits cells in multi-sequence order, that is by the sum of
its two half distances, nearest first: as many cells as reach the target recall on pairs at the threshold,
planted around a bounded sample (SAMPLE vectors, which also train the codebooks). Members met are verified
by the cosine in double precision. A pair counts for both vectors if either meets the other, so links are
symmetric; each ordered pair is counted in one place.

Identical vectors are one candidate with a multiplicity. Cells are cut into blocks of bounded size, members
against visitors; a block pair returns counts and a spanning forest of its links, never its pairs.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and vectors of
different lengths don't link. Repeated rows each give a row and are each other's links; a cosine of exactly the threshold
links, and of equally near centroids the first one counts. Empty tables give no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialise, ship
from .vectors import matrix, usable

SAMPLE = 20_000
CELL = 256
MOST_CENTROIDS = 256
BLOCK = 2048


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = (((c * c).sum(1) - 2 * x @ c.T)).argmin(1)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


class MultiIndex:
    """Codebooks of both halves and the multi-sequence order of their grid's cells."""

    def __init__(self, left: np.ndarray, right: np.ndarray):
        self.left, self.right = left, right
        self.cells = len(left) * len(right)

    def visits(self, x: np.ndarray, t: int) -> np.ndarray:
        """The t cells nearest to each row, nearest first.

        The cell of the i-th and the j-th nearest centroid has (i + 1)(j + 1) - 1 cells before it, so only
        ranks with (i + 1)(j + 1) <= t can be among the first t: what multi-sequence traversal would pop.
        """
        h = x.shape[1] // 2
        d = [(a * a).sum(1)[:, None] + (c * c).sum(1) - 2 * a @ c.T for a, c in ((x[:, :h], self.left), (x[:, h:], self.right))]
        order = [y.argsort(1, kind="stable") for y in d]
        t = min(t, self.cells)
        i, j = np.array([(i, j) for i in range(min(t, len(self.left))) for j in range(min(t // (i + 1), len(self.right)))]).T
        by = np.take_along_axis(d[0], order[0][:, i], 1) + np.take_along_axis(d[1], order[1][:, j], 1)
        first = by.argsort(1, kind="stable")[:, :t]
        return np.take_along_axis(order[0], i[first], 1) * len(self.right) + np.take_along_axis(order[1], j[first], 1)

    def calibrate(self, x: np.ndarray, threshold: float, recall: float, seed: int = 11) -> int:
        """Cells to visit so that a partner at the threshold is met with the target recall."""
        rng = np.random.default_rng(seed)
        x = x[rng.choice(len(x), min(len(x), 4000), replace=False)]
        noise = rng.standard_normal(x.shape)
        noise -= (noise * x).sum(1, keepdims=True) * x
        noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-12)
        # half of the planted partners sit at the threshold, half anywhere above it
        cos = np.where(np.arange(len(x)) % 2, threshold, rng.uniform(threshold, 1, len(x)))[:, None]
        y = cos * x + np.sqrt(1 - cos**2) * noise
        cell = {0: self.visits(x, 1)[:, 0], 1: self.visits(y, 1)[:, 0]}
        t = 1
        while t < self.cells:
            met = (self.visits(x, t) == cell[1][:, None]).any(1) | (self.visits(y, t) == cell[0][:, None]).any(1)
            if met.mean() >= recall:
                break
            t = min(self.cells, max(t + 1, int(t * 1.4)))
        return t


def _forest(a: np.ndarray, b: np.ndarray, nodes: int) -> np.ndarray:
    """Smallest node connected with each node over edges (a, b)."""
    root = np.arange(nodes)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def link_vectors(rows: DataFrame, threshold: float = 0.9, recall: float = 0.98, sample: int = SAMPLE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of (vec_id, embedding)."""
    spark = rows.sparkSession
    ship(spark)
    kind = "<f4" if dict(rows.dtypes)["embedding"] == "array<float>" else "<f8"  # components travel as they came
    base = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    good = base.where(usable("v") & F.exists("v", lambda x: x != 0) & F.col("vec_id").isNotNull())
    reps = materialise(good.groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("mult")), "imi-reps")
    size = reps.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("w")).first()
    n, width = size["n"], size["w"] or 2
    width += width % 2
    alone = base.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if not n:
        return alone.withColumn("kept", F.lit(True))

    def unit(vs) -> np.ndarray:
        x = matrix(vs, width)
        x /= np.abs(x).max(1, keepdims=True)  # else the squares of huge or tiny components leave the range
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    # the rows with the smallest hashes: a sample of a documented bound
    some = unit([r.v for r in reps.select("v", F.xxhash64("id").alias("h")).orderBy("h").limit(sample).collect()])
    k = int(min(MOST_CENTROIDS, max(2, round((n / CELL) ** 0.5))))
    index = MultiIndex(kmeans(some[:, : width // 2], k), kmeans(some[:, width // 2 :], k))
    t = index.calibrate(some, threshold, recall)
    shared = spark.sparkContext.broadcast((index, t))  # two codebooks of at most MOST_CENTROIDS rows

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        idx, t = shared.value
        for b in batches:
            x = unit(b["v"])
            cells = idx.visits(x, t)
            yield pd.DataFrame({"id": b["id"], "mult": b["mult"], "dim": b["v"].map(len), "x": [r.tobytes() for r in matrix(b["v"], width).astype(kind)], "cell": cells[:, 0], "visits": list(cells.astype(np.int32))})

    placed = materialise(reps.mapInPandas(assign, "id long, mult long, dim int, x binary, cell int, visits array<int>"), "imi-placed")
    # at most MOST_CENTROIDS ** 2 cells
    members = placed.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("mbs"))
    visitors = placed.select(F.explode("visits").alias("cell")).groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("vbs"))
    grid = F.broadcast(materialise(members.join(visitors, "cell"), "imi-grid"))
    h = F.xxhash64("id")
    cols = ["id", "mult", "dim", "x", "home", "visits"]
    m = placed.withColumn("home", F.col("cell")).join(grid, "cell").select("cell", F.pmod(h, "mbs").cast("int").alias("mb"), F.explode(F.sequence(F.lit(0), F.col("vbs") - 1)).alias("vb"), F.lit(0).alias("role"), *cols)
    v = placed.withColumn("home", F.col("cell")).withColumn("cell", F.explode("visits")).join(grid, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("mbs") - 1)).alias("mb"), F.pmod(h, "vbs").cast("int").alias("vb"), F.lit(1).alias("role"), *cols)

    def meet(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        mem, vis = b[b["role"] == 0], b[b["role"] == 1]
        if not len(mem) or not len(vis):
            return pd.DataFrame({"id": [], "n": [], "root": []})
        xm, xv = (unit(np.frombuffer(b"".join(y["x"]), kind).reshape(len(y), width)) for y in (mem, vis))
        im, iv = mem["id"].to_numpy(), vis["id"].to_numpy()
        hit = (xv @ xm.T >= threshold) & (iv[:, None] != im) & (vis["dim"].to_numpy()[:, None] == mem["dim"].to_numpy())
        i, j = np.nonzero(hit)
        if not len(i):
            return pd.DataFrame({"id": [], "n": [], "root": []})
        seen, home = np.array(mem["visits"].tolist()), vis["home"].to_numpy()
        back = np.ones(len(i), bool)  # the member doesn't meet the visitor by itself
        for c in range(seen.shape[1]):
            back &= seen[j, c] != home[i]
        nv = np.bincount(i, weights=mem["mult"].to_numpy()[j], minlength=len(iv))
        nm = np.bincount(j[back], weights=vis["mult"].to_numpy()[i[back]], minlength=len(im))
        ids, at = np.unique(np.concatenate([iv, im]), return_inverse=True)
        root = _forest(at[: len(iv)][i], at[len(iv) :][j], len(ids))
        n = np.bincount(at, weights=np.concatenate([nv, nm]), minlength=len(ids)).astype(np.int64)
        linked = np.zeros(len(ids), bool)
        linked[at[: len(iv)][i]] = linked[at[len(iv) :][j]] = True
        return pd.DataFrame({"id": ids[linked], "n": n[linked], "root": ids[root][linked]})

    found = materialise(m.unionByName(v).groupBy("cell", "mb", "vb").applyInPandas(meet, "id long, n long, root long"), "imi-found")
    comp = materialise(components(found.select(F.col("id").alias("a"), F.col("root").alias("b")), "imi-cc"), "imi-comp")
    per = found.groupBy("id").agg(F.sum("n").alias("n"))
    group = (
        reps.join(per, "id", "left").join(comp.withColumnRenamed("node", "id"), "id", "left")
        .select("v", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("root", "id").alias("component_id"))
    )
    out = base.join(group, "v", "left").select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
