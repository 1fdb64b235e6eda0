"""Byte-level BPE by overlapping chunk encoding.

Texts up to one chunk are encoded where they lie. Longer ones are cut into overlapping chunks, whose
pre-token boundaries are found in parallel; neighbours are stitched at the first boundary of the overlap
on which both agree (a pre-token depends only on the text from its start, so from there on they agree),
and the pieces between such cuts are encoded in parallel. A chunk pair that never resynchronises (one
pre-token longer than the overlap) is scanned on from the last sure boundary. Decoding concatenates the
raw bytes of the tokens.

Null and empty texts have no tokens, empty tables no rows. Texts may be of any length; a long one is put together in one
task, as text and as ids. There are no ties: an encoding is unique. Repeated rows each give a row. Extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, ship

CHUNK = 32_768
OVERLAP = 1_024


@lru_cache(2)
def _encoder(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(2)
def _splitter(pattern: str) -> regex.Pattern:
    return regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


def chunk_cuts(n: int, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """[start, end) of the chunks that cover n characters; each but the last reaches `overlap` into its successor."""
    return [(s, min(n, s + chunk + overlap)) for s in range(0, max(n, 1), chunk)]


def boundaries(text: str, pattern: str, last: bool) -> list[int]:
    """Starts of pre-tokens in a chunk that can be trusted: the two before a cut may change with what follows."""
    starts = [m.start() for m in _splitter(pattern).finditer(text)]
    return starts if last else starts[:-2]


def stitch(text: str, chunks: list[list[int]], pattern: str, chunk: int = CHUNK) -> list[int]:
    """Cuts at which the text may be encoded piece by piece. chunks: each chunk's sure boundaries, absolute.

    A cut must be a boundary of both neighbours, after a character that isn't white space (else the piece
    before it would take a longer run of white space for one pre-token).
    """
    cuts, sure = [0], chunks[0]
    for nxt in chunks[1:]:
        known = set(sure)
        at = next((p for p in nxt if p in known and p and not text[p - 1].isspace()), None)
        if at is None:
            known, last = set(nxt), max([p for p in sure if p >= cuts[-1]], default=cuts[-1])
            tail = []
            for m in _splitter(pattern).finditer(text, last):
                p = m.start()
                tail.append(p)
                if p in known and p > cuts[-1] and not text[p - 1].isspace():
                    at = p
                    break
            if at is None:  # nothing of this chunk agrees: the scan ran to the end of the text
                return cuts
        cuts.append(at)
        sure = [p for p in nxt if p >= at]
    return cuts


def encode_piece(text: str, path: str, pattern: str) -> list[int]:
    enc = _encoder(path, pattern)
    try:
        return enc.encode_ordinary(text)
    except BaseException as e:  # the library's regex gives up on some endless runs: the same pre-tokens, one by one
        if isinstance(e, (KeyboardInterrupt, SystemExit)):
            raise
        return [i for m in _splitter(pattern).finditer(text) for i in enc._core_bpe.encode_single_piece(m.group().encode())]


def decode_ids(ids: list[int], path: str, pattern: str) -> bytes:
    """Raw bytes of the tokens, one after another; they need not be valid UTF-8 before the last."""
    return _encoder(path, pattern).decode_bytes(ids)


PIECES = "row long, doc_id long, part int, ids array<int>, raw binary"


def encode(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP, digest: bool = False) -> DataFrame:
    """doc_id, ids array<int>, decoded binary of every document; digest: n_tokens, ids_sha256, decoded_sha256 instead."""
    ship(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "doc_id long, ids array<int>, decoded binary"

    def result(ids_of: list[tuple[int, list[int], bytes]]) -> pd.DataFrame:
        if not digest:
            return pd.DataFrame(ids_of, columns=["doc_id", "ids", "decoded"])
        rows = [(d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(raw).hexdigest()) for d, ids, raw in ids_of]
        return pd.DataFrame(rows, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    def short(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), 512):
                out = []
                for d, t in zip(b["doc_id"][lo : lo + 512], b["text"][lo : lo + 512]):
                    ids = encode_piece(t, path, pattern)
                    out.append((d, ids, decode_ids(ids, path, pattern)))
                yield result(out)

    def to_chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row, d, t in zip(b["row"], b["doc_id"], b["text"]):
                cuts = chunk_cuts(len(t), chunk, overlap)
                for lo in range(0, len(cuts), 256):
                    yield pd.DataFrame([(row, d, lo + k, s, e == len(t), t[s:e]) for k, (s, e) in enumerate(cuts[lo : lo + 256])], columns=["row", "doc_id", "part", "at", "last", "text"])

    def pretokenise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row, d, k, s, last, t in b.itertuples(index=False):
                yield pd.DataFrame([(row, d, k, s, t, [s + p for p in boundaries(t, pattern, last)])], columns=["row", "doc_id", "part", "at", "text", "starts"])

    def join_chunks(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("part")
        text = "".join(t[:chunk] for t in b["text"])
        cuts = stitch(text, [list(x) for x in b["starts"]], pattern, chunk)
        return pd.DataFrame([(key[0], b["doc_id"].iloc[0], k, text[s:e]) for k, (s, e) in enumerate(zip(cuts, [*cuts[1:], len(text)]))], columns=["row", "doc_id", "part", "text"])

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row, d, k, t in b.itertuples(index=False):
                ids = encode_piece(t, path, pattern)
                yield pd.DataFrame([(row, d, k, ids, decode_ids(ids, path, pattern))], columns=["row", "doc_id", "part", "ids", "raw"])

    def whole(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("part")
        return result([(b["doc_id"].iloc[0], [int(i) for ids in b["ids"] for i in ids], b"".join(b["raw"]))])

    short_rows = base.where(F.length("text") <= chunk).mapInPandas(short, schema)
    # a row number tells repeated rows apart; it is fixed by writing the long rows once
    long_rows = materialise(base.where(F.length("text") > chunk).withColumn("row", F.monotonically_increasing_id()), "bpe-long")
    parts = (
        long_rows.mapInPandas(to_chunks, "row long, doc_id long, part int, at long, last boolean, text string")
        .repartition("row", "part")
        .mapInPandas(pretokenise, "row long, doc_id long, part int, at long, text string, starts array<long>")
        .groupBy("row").applyInPandas(join_chunks, "row long, doc_id long, part int, text string")
        .repartition("row", "part")
        .mapInPandas(pieces, PIECES)
        .groupBy("row").applyInPandas(whole, schema)
    )
    return short_rows.unionByName(parts)
