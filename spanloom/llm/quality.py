"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Statistics are counts of the whole text, turned into logs and smoothed log-ratios so that short and long
texts lie on one scale. Class means and covariances come from sums over all labelled training rows (no
sample); each covariance is shrunk towards the pooled one and towards its own diagonal. The score is the
posterior of label 1: a logistic of the difference of the two log densities, each from a Mahalanobis
distance by the class's Cholesky factor, which is computed once and sent with the scoring function.

Null and empty texts have the statistics of no words and get a score like any other. Rows with a null
label teach nothing. Without rows of both classes the score is the share of label 1 (0.5 without any).
A score of exactly 0.7 predicts 1. Texts may be of any length, for statistics are sums over them; empty tables give no rows.
Repeated rows count and are scored each. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, ship

STATS = 14
_CLASS = np.zeros(256, np.int64)
for _c in range(256):
    _ch = chr(_c)
    _CLASS[_c] = (
        1 if _c < 128 and _ch.islower() else 2 if _c < 128 and _ch.isupper() else 3 if _ch in "0123456789" else 4 if _ch in " \t\r\x0b\x0c"
        else 5 if _ch == "\n" else 6 if _ch in ".,;:?'\"-()" else 7 if _ch == "!" else 8 if _ch == "|" else 9 if 32 < _c < 127 else 10 if _c >= 192 else 11 if _c >= 128 else 0
    )


def statistics(text: str) -> list[float]:
    """Transformed statistics of one text."""
    raw = text.encode("utf-8", "surrogatepass")
    n = np.bincount(_CLASS, weights=np.bincount(np.frombuffer(raw, np.uint8), minlength=256), minlength=12)
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x]
    w, u, size = len(words), len(set(words)), len(raw)
    letters = n[1] + n[2] + n[10]
    chars = size - n[11] + 1
    log = np.log
    ended = sum(x[-1:] in b".!?" for x in lines)
    edged = sum(not (97 <= x[-1] <= 122 or 65 <= x[-1] <= 90 or x[-1] > 127 or x[-1] in b".,") for x in words)
    return [
        log(1 + w),
        log((letters + 5) / (w + 1)),
        log((n[9] + 0.5) / chars * 10 + 0.01),
        log((n[7] + 0.5) / chars * 10 + 0.01),
        log((n[8] + 0.5) / chars * 10 + 0.01),
        log((n[2] + 1) / (letters + 20)),
        log((n[3] + 0.5) / chars * 10 + 0.01),
        log((n[6] + 1) / (w + 5)),
        log((u + 2) / (w + 2)),
        log((w + 5) / (len(lines) + 1)),
        (ended + 0.5) / (len(lines) + 1),
        log((edged + 0.5) / (w + 5)),
        log((len(set(lines)) + 1) / (len(lines) + 1)),
        log((n[10] + 1) / (letters + 20)),
    ]


@dataclass(frozen=True)
class Qda:
    """Class priors, means and inverse Cholesky factors; both are ready for any number of rows."""

    log_prior: tuple[float, float]
    mean: tuple[np.ndarray, np.ndarray]
    inv_chol: tuple[np.ndarray, np.ndarray]
    log_det: tuple[float, float]

    def score(self, x: np.ndarray) -> np.ndarray:
        d = []
        for k in (0, 1):
            z = (x - self.mean[k]) @ self.inv_chol[k].T
            d.append(self.log_prior[k] - self.log_det[k] - 0.5 * (z * z).sum(1))
        return 1 / (1 + np.exp(-np.clip(d[1] - d[0], -500, 500)))


def fit(n: list[float], s: list[np.ndarray], ss: list[np.ndarray], to_pooled: float = 0.1, to_diagonal: float = 0.05, floor: float = 1e-3) -> Qda:
    """From each class's count, sum and sum of outer products."""
    mean = [s[k] / n[k] for k in (0, 1)]
    cov = [ss[k] / n[k] - np.outer(mean[k], mean[k]) for k in (0, 1)]
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / (n[0] + n[1])
    inv, det = [], []
    for k in (0, 1):
        c = (1 - to_pooled) * cov[k] + to_pooled * pooled
        c = (1 - to_diagonal) * c + to_diagonal * np.diag(np.diag(c)) + floor * np.eye(len(c))
        chol = np.linalg.cholesky(c)
        inv.append(np.linalg.inv(chol))
        det.append(float(np.log(np.diag(chol)).sum()))
    total = n[0] + n[1]
    return Qda((float(np.log(n[0] / total)), float(np.log(n[1] / total))), tuple(mean), tuple(inv), tuple(det))


def features(docs: DataFrame) -> DataFrame:
    """doc_id, x array<double> of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), 1024):
                part = b.iloc[lo : lo + 1024]
                yield pd.DataFrame({"doc_id": part["doc_id"], "x": [statistics(t) for t in part["text"]]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, "doc_id long, x array<double>")


def held_out(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(rows: DataFrame) -> Qda | float:
    """rows: x, y (0 or 1). The model; or the share of label 1, if a class is missing."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = {0: None, 1: None}
        for b in batches:
            for y, part in b.groupby("y"):
                x = np.array(part["x"].tolist())
                v = np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])
                acc[y] = v if acc[y] is None else acc[y] + v
        for y, v in acc.items():
            if v is not None:
                yield pd.DataFrame({"y": y, "k": np.arange(len(v)), "v": v})

    got = rows.mapInPandas(sums, "y int, k int, v double").groupBy("y", "k").agg(F.sum("v").alias("v")).collect()  # 2 x 211 numbers
    vec = {y: np.array([v for _, v in sorted((r.k, r.v) for r in got if r.y == y)]) for y in (0, 1)}
    n = [float(vec[y][0]) if len(vec[y]) else 0.0 for y in (0, 1)]
    if min(n) < 2:
        return n[1] / sum(n) if sum(n) else 0.5
    d = STATS
    return fit(n, [vec[y][1 : 1 + d] for y in (0, 1)], [vec[y][1 + d :].reshape(d, d) for y in (0, 1)])


def learn(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, Qda | float]:
    """The table of statistics and the model of labels.quality of rows not held out."""
    ship(docs.sparkSession)
    table = materialise(features(docs), "quality-x")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("y in (0, 1)").where(~held_out())
    return table, train(table.join(known, "doc_id").select("x", "y"))


def _scores(model: Qda | float, x: np.ndarray) -> np.ndarray:
    return np.full(len(x), model) if isinstance(model, float) else model.score(x)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The documents, with all their columns, whose score is at least the threshold."""
    model = learn(docs, labels)[1]

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(_scores(model, np.array([statistics(t) for t in text]).reshape(len(text), STATS)))

    return docs.where(score(F.coalesce(F.col("text"), F.lit(""))) >= threshold)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; learns from labels.quality of rows not held out."""
    table, model = learn(docs, labels)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.array(b["x"].tolist()).reshape(len(b), STATS)
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": _scores(model, x)})

    out = table.mapInPandas(run, "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
