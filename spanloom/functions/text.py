"""Texts to words and spans with byte offsets, as DataFrame expressions."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metaphone import metaphone_keys

WORD_RUNS = r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"
#: Spans that a task gathers before it hands them on.
FLUSH = 1 << 16


def spans_of(df: DataFrame, key: str, text: str, words: bool = False, lines: bool = False, sentences: bool = False, wanted: Iterable[tuple[str, str]] | None = None) -> DataFrame:
    """key, kind (WORD, LINE, SENT), raw (of words), pos (ordinal of the word), s, e (inclusive byte offsets).

    wanted: only words that pass word_test; their ordinals are those among all words.

    One pass over each text in Arrow batches, without a shuffle. As array expressions, running byte offsets cost several
    interpreted calls and an appended array for each run, which was slower.
    """
    wanted = None if wanted is None else list(wanted)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        keep = None if wanted is None else word_test(wanted)
        # letters and digits of any script; lines; sentences with their closing marks
        kinds = [(k, re.compile(rx)) for k, rx, on in (("WORD", r"[^\W_]+", words), ("LINE", r"[^\n]+", lines), ("SENT", r"[^.!?]+[.!?]*|[.!?]+", sentences)) if on]
        out: list[list] = [[] for _ in range(6)]

        def flush():
            cols = [pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()))]
            for x in out:
                x.clear()
            return pa.RecordBatch.from_arrays(cols, names=[key, "kind", "raw", "pos", "s", "e"])

        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not t:
                    continue
                spans = []
                for kind, rx in kinds:
                    found = [m.span() for m in rx.finditer(t)]
                    place = range(len(found))
                    if keep is not None and kind == "WORD":
                        place = [n for n, (a, b) in enumerate(found) if keep(t[a:b].lower())]
                        found = [found[n] for n in place]
                    if found:
                        spans.append((kind, found, place))
                at = None
                if spans and not t.isascii():
                    code = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4")
                    at = np.concatenate([[0], np.cumsum(1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))])
                for kind, found, place in spans:
                    out[0] += [k] * len(found)
                    out[1] += [kind] * len(found)
                    out[2] += [t[a:b] for a, b in found] if kind == "WORD" else [None] * len(found)
                    out[3] += place
                    if at is None:
                        out[4] += [a for a, _ in found]
                        out[5] += [b - 1 for _, b in found]
                    else:
                        ends = np.array(found)
                        out[4] += at[ends[:, 0]].tolist()
                        out[5] += (at[ends[:, 1]] - 1).tolist()
                if len(out[0]) >= FLUSH:
                    yield flush()
        if out[0]:
            yield flush()

    src = df.select(F.col(key).cast("bigint").alias(key), F.col(text).cast("string").alias(text))
    return src.mapInArrow(run, f"{key} bigint, kind string, raw string, pos int, s bigint, e bigint")


def word_test(wanted: Iterable[tuple[str, str]]) -> Callable[[str], bool]:
    """Whether a lower-cased word may be among those wanted, pairs of a kind (exact, right, left, infix, glob, phonetic, metaphone) and a text.

    No word is missed; some may pass that the caller's own condition refuses: those of one first letter for Soundex, and words
    beyond ASCII where Python's and Spark's case mappings might part.
    """
    wanted = [(k, w if k == "metaphone" else w.lower()) for k, w in wanted]
    tests: list[Callable[[str], bool]] = []
    if exact := frozenset(w for k, w in wanted if k == "exact"):
        tests.append(exact.__contains__)
    for kind, w in wanted:
        if kind == "right":
            tests.append(lambda x, w=w: x.startswith(w))
        elif kind == "left":
            tests.append(lambda x, w=w: x.endswith(w))
        elif kind == "infix":
            tests.append(lambda x, w=w: w in x)
        elif kind == "glob":
            tests.append(lambda x, m=re.compile(glob_regex(w)).match: m(x) is not None)
        elif kind == "phonetic":
            tests.append(lambda x, a=w[:1]: x[:1] == a)
        elif kind == "metaphone":
            # a word's keys are worked out once
            tests.append(lru_cache(1 << 18)(lambda x, keys=frozenset(metaphone_keys(w)): not keys.isdisjoint(metaphone_keys(x))))
        elif kind != "exact":
            raise ValueError(kind)
    if any(k == "glob" or not w.isascii() for k, w in wanted):
        tests.append(lambda x: not x.isascii())
    return tests[0] if len(tests) == 1 else lambda x: any(f(x) for f in tests)


def word_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """term, n: the words of texts counted batch by batch, so that a term has several rows but far fewer than it has postings."""

    def run(batches):
        import pyarrow as pa

        rx, counts = re.compile(r"[^\W_]+"), Counter()

        def flush():
            b = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["raw", "n"])
            counts.clear()
            return b

        for b in batches:
            for t in b.column(0).to_pylist():
                counts.update(rx.findall(t or ""))
                if len(counts) >= 4 * FLUSH:
                    yield flush()
        yield flush()

    return df.select(F.col(text).cast("string").alias(text)).mapInArrow(run, "raw string, n bigint").select(F.lower("raw").alias("term"), "n")


def postings(df: DataFrame, key: str = "rec_id", text: str = "text", wanted: Iterable[tuple[str, str]] | None = None) -> DataFrame:
    """rec_id, term, raw, pos (ordinal of the word), s, e; wanted: see spans_of."""
    return spans_of(df, key, text, words=True, wanted=wanted).select(key, F.lower("raw").alias("term"), "raw", "pos", "s", "e")


def field_spans(df: DataFrame, key: str = "rec_id", text: str = "text", lines: bool = True, sentences: bool = True) -> DataFrame:
    """rec_id, field, path, s, e of the fields LINE and SENT."""
    return spans_of(df, key, text, lines=lines, sentences=sentences).select(key, F.col("kind").alias("field"), F.col("kind").alias("path"), "s", "e")


def line_spans(df: DataFrame, key: str = "rec_id", text: str = "text") -> DataFrame:
    return field_spans(df, key, text, sentences=False)


def sentence_spans(df: DataFrame, key: str = "rec_id", text: str = "text") -> DataFrame:
    return field_spans(df, key, text, lines=False)


def byte_slice(text: Column, s: Column, e: Column) -> Column:
    """The bytes s..e of a text, as a string."""
    return F.decode(F.substring(F.encode(text, "UTF-8"), (s + 1).cast("int"), (e - s + 1).cast("int")), "UTF-8")


def glob_regex(glob: str, anchored: bool = True) -> str:
    """A glob (* ? [..] [!..] {a,b}) as a regular expression that Java and Python read alike."""
    out, k, depth = [], 0, 0
    while k < len(glob):
        c = glob[k]
        k += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := glob.find("]", k + (glob[k : k + 1] in "!]"))) > 0:
            body = glob[k:end].replace("\\", "\\\\").replace("[", "\\[")
            out.append("[" + ("^" + body[1:] if body[:1] == "!" else body) + "]")
            k = end + 1
        elif c == "{":
            out.append("(?:")
            depth += 1
        elif c == "}" and depth:
            out.append(")")
            depth -= 1
        elif c == "," and depth:
            out.append("|")
        else:
            out.append(re.escape(c) if not c.isalnum() else c)
    rx = "".join(out) + ")" * depth
    return f"^(?s:{rx})$" if anchored else f"(?s:{rx})"
