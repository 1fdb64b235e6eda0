"""Near-duplicate documents by b-bit MinHash.

A document's set is its distinct k-word shingles as 64-bit hashes. LANES minima give BANDS band keys for
candidates (at a similarity of 0.8 a pair misses every band with a probability of 3e-6) and, cut to their
low BITS bits, one packed signature. Candidates whose set sizes are too far apart, or whose similarity, estimated from the signatures' equal lanes
and corrected for lanes equal by chance, lies more than five standard deviations below the threshold go;
the others are confirmed on their full sets. Texts of the same words are one candidate. Buckets never emit
all their pairs (see common.link_in_buckets), yet components are those of all links found.

Null, empty and blank texts have empty sets and are linked with nothing; empty tables give no rows. Texts may be of any
length: a set is held by one task, 8 bytes for each shingle. Repeated rows each give a row; rows that repeat a doc_id
with other texts are linked by their own texts and never join each other's groups for the id's sake. The smallest
doc_id of a group stays; where several rows have it, all of them do (the pipeline keeps one). Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, link_in_buckets, materialise, ship

BANDS, ROWS, BITS = 32, 5, 2
LANES = BANDS * ROWS
LONGS = LANES * BITS // 64
SLACK = 0.2
MEMBERS = 1024

_rng = np.random.default_rng(20240917)
_MULT = (_rng.integers(1 << 62, (1 << 64) - 1, LANES, dtype=np.uint64) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_BAND = _rng.integers(1 << 62, (1 << 64) - 1, BANDS, dtype=np.uint64)
_P, _A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, w: bytes) -> bytes:
        if len(self) > 500_000:
            self.clear()
        h = self[w] = xxhash.xxh3_64_digest(w)
        return h


def words_of(text: str) -> list[bytes]:
    """A-Z lower-cased, cut at space and \\t..\\r."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingle_set(words: list[bytes], k: int, cache: _Words) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; of fewer words, the hash of all; of none, nothing."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.frombuffer(b"".join(map(cache.__getitem__, words)), ">u8").astype(np.uint64)
    n = len(h)
    width = min(k, n)
    acc = h[: n - width + 1].copy()
    for j in range(1, width):
        acc = acc * _P + h[j : n - width + 1 + j]
    s = np.sort(_mix(acc + np.uint64(width)))
    return s[np.append(True, s[1:] != s[:-1])]


def minima(s: np.ndarray) -> np.ndarray:
    """The least product with each lane's multiplier, modulo 2 ** 32: mixed hashes are as good in their upper halves."""
    half = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(LANES, np.iinfo(np.uint32).max, np.uint32)
    for lo in range(0, len(half), 1024):
        np.minimum(out, np.multiply.outer(half[lo : lo + 1024], _MULT).min(0), out)
    return out.astype(np.uint64)


def signature(low: np.ndarray) -> np.ndarray:
    """Rows of LANES minima -> rows of LONGS packed longs of their low BITS bits."""
    x = (low & np.uint64((1 << BITS) - 1)).reshape(len(low), LONGS, 64 // BITS)
    shift = np.arange(0, 64, BITS, dtype=np.uint64)
    return np.bitwise_or.reduce(x << shift, axis=2).view(np.int64)


def band_keys(low: np.ndarray) -> np.ndarray:
    x = low.reshape(len(low), BANDS, ROWS)
    acc = np.broadcast_to(_BAND, (len(low), BANDS)).copy()
    for j in range(ROWS):
        acc = _mix(acc * _P + x[:, :, j])
    return acc.view(np.int64)


def estimate(a: str, b: str) -> str:
    """SQL: similarity from two signatures, corrected for lanes that agree by chance."""
    lanes = [f"({a}[{k}] ^ {b}[{k}])" for k in range(LONGS)]
    differ = " + ".join(f"bit_count(({x} | shiftrightunsigned({x}, 1)) & {0x5555555555555555}L)" for x in lanes)
    chance = 1.0 / (1 << BITS)
    return f"((1 - ({differ}) / {float(LANES)}D - {chance}D) / {1 - chance}D)"


def may_be_like(x: str, y: str, percent: int) -> str:
    """Necessary for a link of two marks (signature sig, set size n): sizes allow the similarity, and the estimate lies not far below it."""
    return f"100 * least({x}.n, {y}.n) >= {percent} * greatest({x}.n, {y}.n) and {estimate(f'{x}.sig', f'{y}.sig')} >= {percent / 100 - SLACK}"


def text_key():
    """Column: tells texts apart, the same in every run."""
    return F.xxhash64(F.lit(11), F.col("text").cast("string"))


def sketch(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, tk, n_shingles, words (digest of the word sequence), sig, bands of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = _Words()
        for b in batches:
            for lo in range(0, len(b), 512):
                part = b.iloc[lo : lo + 512]
                n, seq, low = [], [], []
                for t in part["text"]:
                    w = words_of(t)
                    s = shingle_set(w, k, cache)
                    n.append(len(s))
                    seq.append(hashlib.md5(b" ".join(w)).digest() if w else None)
                    low.append(minima(s))
                low = np.array(low)
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "tk": part["tk"].to_numpy(), "n_shingles": n, "words": seq, "sig": list(signature(low)), "bands": list(band_keys(low))})

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("tk"), F.coalesce("text", F.lit("")).alias("text"))
    return src.mapInPandas(run, "doc_id long, tk long, n_shingles long, words binary, sig array<long>, bands array<long>")


def link_documents(docs: DataFrame, k: int, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; links need 100 * intersection >= percent * union."""
    return link_rows(docs, k, percent).drop("tk", "root")


def link_rows(docs: DataFrame, k: int, percent: int = 80) -> DataFrame:
    """The same with tk (text_key), by which rows of one doc_id are told apart, and root, which tells groups apart (null: no words)."""
    spark = docs.sparkSession
    ship(spark)
    rows = materialise(sketch(docs, k), "minhash-rows")
    # one node for each sequence of words, found again by the first row that has it
    reps = materialise(
        rows.where("words is not null and doc_id is not null").groupBy("words").agg(F.min(F.struct("doc_id", "tk")).alias("at"), F.first("sig").alias("sig"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n")).select(F.xxhash64("words").alias("id"), "words", "at.*", "sig", "bands", "n"), "minhash-reps"
    )
    members = reps.select("id", F.explode("bands").alias("key")).distinct()
    texts: list[DataFrame] = []

    def describe(ids: DataFrame) -> DataFrame:
        """Signatures and set sizes of documents that meet any other; their texts are set apart once, here."""
        ids = materialise(ids, "minhash-ids")
        at = reps.join(ids, "id", "left_semi").select("doc_id", "tk", "id")
        src = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("tk"), "text")
        # repeated rows have the same text, whichever is met
        texts.append(materialise(src.join(at, ["doc_id", "tk"]).select("id", "text"), "minhash-texts"))
        return reps.join(ids, "id", "left_semi").select("id", F.struct("sig", "n").alias("mark"))

    def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache, a, first = _Words(), None, None
        for b in batches:
            out = []
            for x, salt, right, t in zip(b["a"], b["salt"], b["b"], b["text"]):
                s = shingle_set(words_of(t), k, cache)
                if right == -1 or first is None or (x, salt) != a:
                    a, first = (x, salt), s
                    continue
                both = len(np.intersect1d(first, s, assume_unique=True))
                if 100 * both >= percent * (len(first) + len(s) - both) and both:
                    out.append((x, right))
            yield pd.DataFrame(out, columns=["a", "b"])

    def verify(pairs: DataFrame) -> DataFrame:
        near = materialise(pairs, "minhash-near")
        # a text that is the left side of many pairs is sent once for every MEMBERS of them
        salts = near.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("salts"))
        right = near.join(salts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.col("b").alias("id"), F.lit(1).alias("side"))
        left = salts.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("a").alias("id"), F.lit(0).alias("side"))
        return (
            left.unionByName(right).join(texts[0], "id")
            .select("a", "salt", F.when(F.col("side") == 0, F.lit(-1)).otherwise(F.lit(1)).alias("side"), "id", "text")
            .repartition("a", "salt").sortWithinPartitions("a", "salt", "side", "id")
            .select("a", "salt", F.when(F.col("side") == -1, F.lit(-1).cast("long")).otherwise(F.col("id")).alias("b"), "text")
            .mapInPandas(confirm, "a long, b long").distinct()
        )

    links = link_in_buckets(members, describe, verify, "minhash", may_be_like("x.mark", "y.mark", percent), whole=True)
    comp = materialise(components(links, "minhash-cc"), "minhash-comp")
    node = reps.select("words", "id", "doc_id").join(comp.withColumnRenamed("node", "id"), "id", "left").select("words", "doc_id", F.coalesce("root", "id").alias("root"))
    node = materialise(node, "minhash-nodes")
    least = node.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n"))
    group = node.join(least.where("n > 1").select("root", "component_id"), "root", "left").select("words", "root", F.coalesce("component_id", "doc_id").alias("component_id"))
    out = rows.select("doc_id", "tk", "n_shingles", "words").join(group, "words", "left")
    out = out.select("doc_id", "tk", "root", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
