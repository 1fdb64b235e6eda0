"""Hierarchical residual best-fit packing of token sequences.

Each input partition tokenises its documents and packs them best-fit, longest first. Nearly full bins are
final. Underfull bins become items: they are gathered in groups of bounded size, packed best-fit again, and
so on up a tree until one group holds them all or a round gains next to nothing. A bin's pieces move as one
block, so a round ships (bin, used) only and the pieces are renumbered by one join at the end.

Memory: one partition's pieces (flushed every FLUSH of them, or every FLUSH_IDS ids), or GROUP bins, as narrow rows.
Null and empty texts are the single end id, empty tables give no rows. Texts of any length are cut after tokenising. Of pieces of
one length the earlier goes first, of equally full bins any. Repeated rows are packed each. Extra columns are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, ship

FLUSH = 200_000
#: Tokens held until they are packed, where the ids themselves are asked for.
FLUSH_IDS = 4_000_000
GROUP = 200_000
NEARLY = 8
ROUNDS = 6

_L, _N = "a-zªµºßà-öø-ÿ", "0-9²³¹¼½¾"
_PRE = re.compile(rf"[{_L}]+|[{_N}]|'(?:s|t|re|ve|m|ll|d)|[^\s{_L}{_N}\x85\xa0]+")
_SLOW = re.compile("[^\x00-\x1b\x20-\xff]")


class WordTokenizer:
    """Ids of a word-level BPE (white space dropped, lower case) as little-endian bytes, by caching words.

    Latin-1 texts are already in NFC, and no pre-token spans white space, so a text's ids are those of its
    white-space words, and a word's those of its pre-tokens. Unseen pre-tokens of a batch are encoded in one
    call; ends of words are told by the vocabulary's end-of-word suffix. Any other text goes to the library whole.
    """

    WORDS, PRETOKENS = 1_000_000, 700_000

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.encode_special_tokens = True
        vocab = self.lib.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        for k, v in vocab.items():
            self.ends[v] = k.endswith("</w>")
        self.words: dict[str, bytes] = {}
        self.pretokens: dict[str, bytes] = {}

    def _one(self, text: str) -> bytes:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, new: set[str]) -> None:
        if len(self.words) + len(new) > self.WORDS:
            self.words.clear()
        if len(self.pretokens) > self.PRETOKENS:
            self.pretokens.clear()
        parts = {w: _PRE.findall(w) for w in new}
        todo = list({p for x in parts.values() for p in x}.difference(self.pretokens))
        for lo in range(0, len(todo), 8192):
            some = todo[lo : lo + 8192]
            ids = np.array(self.lib.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(some):
                raw, at = ids.tobytes(), (ends * 4).tolist()
                self.pretokens.update((p, raw[a:b]) for p, a, b in zip(some, [0, *at], at))
            else:
                self.pretokens.update((p, self._one(p)) for p in some)
        get = self.pretokens
        for w, x in parts.items():
            self.words[w] = get[x[0]] if len(x) == 1 else b"".join([get[p] for p in x])

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [None if _SLOW.search(t) else t.lower().split() for t in texts]
        new = set().union(*(x for x in split if x)).difference(self.words)
        if new:
            before = len(self.words)
            self._learn(new)
            if len(self.words) < before + len(new):  # the cache was emptied: learn what this batch needs again
                self._learn(set().union(*(x for x in split if x)).difference(self.words))
        get = self.words
        return [self._one(t) if x is None else b"".join([get[w] for w in x]) for t, x in zip(texts, split)]


@lru_cache(1)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def best_fit(sizes: list[int], limit: int) -> tuple[list[int], list[int], list[int]]:
    """Best-fit decreasing: for each item its bin and its offset there; and each bin's use. Ties go by position."""
    bin_of, offset, used = [0] * len(sizes), [0] * len(sizes), []
    open_: list[list[int]] = [[] for _ in range(limit + 1)]  # by room left
    mask = 0  # bit r: some bin has r left
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        n = sizes[k]
        fit = mask >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            b = open_[room].pop()
            if not open_[room]:
                mask ^= 1 << room
        else:
            room, b = limit, len(used)
            used.append(0)
        bin_of[k], offset[k] = b, used[b]
        used[b] += n
        if left := room - n:
            open_[left].append(b)
            mask |= 1 << left
    return bin_of, offset, used


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, used long"


def pack(docs: DataFrame, path: str, limit: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if asked for) of every piece."""
    spark = docs.sparkSession
    ship(spark)
    end = np.array([end_id], "<u4").tobytes()
    step = 4 * limit

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = word_tokenizer(path)
        home, made = TaskContext.get().partitionId() << 36, 0
        rows: list[tuple] = []
        tokens = 0

        def flush() -> pd.DataFrame:
            nonlocal made
            bins, offsets, used = best_fit([r[3] for r in rows], limit)
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])
            bins = np.array(bins, np.int64)
            out["bin"], out["offset"], out["used"] = home + made + bins, offsets, np.array(used, np.int64)[bins]
            made += len(used)
            rows.clear()
            return out

        for b in batches:
            for lo in range(0, len(b), 256):
                for d, raw in zip(b["doc_id"][lo : lo + 256], tok.encode(list(b["text"][lo : lo + 256]))):
                    raw += end
                    for k, at in enumerate(range(0, len(raw), step)):
                        x = raw[at : at + step]
                        rows.append((d, k, at // 4, len(x) // 4, zlib.crc32(x), *([np.frombuffer(x, "<u4").astype("i4")] if with_ids else [])))
                    tokens += len(raw) // 4
                if len(rows) >= FLUSH or with_ids and tokens >= FLUSH_IDS:
                    tokens = 0
                    yield flush()
        if rows:
            yield flush()

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    pieces = materialise(src.mapInPandas(local, PIECE.replace("bin long", "ids array<int>, bin long") if with_ids else PIECE), "pack-pieces")

    def merge(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("bin")
        ids = b["bin"].to_numpy()
        bins, offsets, used = best_fit(b["used"].tolist(), limit)
        bins = np.array(bins, np.int64)
        first = np.full(len(used), -1, np.int64)  # a merged bin is named after its first part
        np.maximum.at(first, bins, ids)
        return pd.DataFrame({"bin": ids, "parent": first[bins], "moved": offsets, "used": np.array(used, np.int64)[bins]})

    moves = None
    todo = pieces.where(F.col("used") < limit - NEARLY).select("bin", "used").distinct()
    scratch = []
    for r in range(ROUNDS):
        todo = materialise(todo, "pack-under")
        n = todo.count()
        if n < 2:
            break
        groups = -(-n // GROUP)
        # fewer, wider groups each time, mixed anew: siblings of the last round meet others
        done = materialise(
            todo.withColumn("g", F.pmod(F.xxhash64("bin", F.lit(r)), F.lit(groups))).groupBy("g").applyInPandas(merge, "bin long, parent long, moved long, used long"),
            "pack-merge",
        )
        scratch.append(done)
        here = done.select("bin", F.col("parent").alias("p2"), F.col("moved").alias("m2"))
        if moves is None:
            moves = here.withColumnsRenamed({"p2": "parent", "m2": "moved"})
        else:
            moves = moves.join(here.withColumnRenamed("bin", "parent"), "parent", "left").select("bin", F.coalesce("p2", "parent").alias("parent"), (F.col("moved") + F.coalesce("m2", F.lit(0))).alias("moved"))
        left = done.select(F.col("parent").alias("bin"), "used").distinct()
        m = left.count()
        if groups == 1 or n - m < n // 100:
            break
        todo = left.where(F.col("used") < limit - NEARLY)
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    if moves is None:
        out = pieces.select(*cols, F.col("bin").alias("sequence_id"), "offset", *(["ids"] if with_ids else []))
    else:
        out = pieces.join(moves, "bin", "left").select(*cols, F.coalesce("parent", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("moved", F.lit(0))).alias("offset"), *(["ids"] if with_ids else []))
    return out
