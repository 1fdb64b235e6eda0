"""Secret scan with a trigram inverted index.

Each rule's regex carries a Boolean query over trigrams that any match must hold: a disjunction of
conjunctions, derived from its literals. Every Arrow batch is indexed by itself, as one shard: one pass
over its bytes gives the postings of the trigrams that some rule asks for, conjunctions intersect postings,
disjunctions unite them, and the regex verifies the candidate documents' whole texts. A rule whose regex
has no mandatory trigram scans every document. No shuffle, and memory bounded by the batch.

Null and empty texts have no spans, empty tables give no rows; texts may be of any length and are scanned whole. Spans that
start alike go by kind as listed. Repeated rows each give a row; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import re._parser as sre_parser
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

Query = frozenset  # of conjunctions, each a frozenset of trigrams; the empty conjunction matches all
MOST = 64


def _strings(tree, fold: bool) -> tuple[list[str] | None, list[frozenset]]:
    """Of a parsed regex: its exact strings if these are few, and the conjunction sets any match satisfies."""
    exact: list[str] | None = [""]
    done: list[set[frozenset]] = []  # each: alternatives, of which any match satisfies one

    def close() -> None:
        nonlocal exact
        if exact:
            alts = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in exact}
            if alts and frozenset() not in alts:
                done.append(alts)
        exact = [""]

    for op, arg in tree:
        name, options = str(op), None
        if name == "LITERAL":
            options = [chr(arg).lower() if fold else chr(arg)]
        elif name == "IN" and not any(str(o) in ("NEGATE", "CATEGORY") for o, _ in arg):
            chars = [chr(c) for o, a in arg for c in (range(a[0], a[1] + 1) if str(o) == "RANGE" else [a])]
            chars = sorted({c.lower() if fold else c for c in chars})
            options = chars if len(chars) <= 8 else None
        elif name == "SUBPATTERN":
            sub, inner = _strings(arg[-1], fold or bool(arg[1] & re.IGNORECASE))
            if sub is not None:
                options = sub
            else:
                close()
                done.extend(inner)
                continue
        elif name == "BRANCH":
            subs = [_strings(x, fold) for x in arg[1]]
            if all(s is not None for s, _ in subs):
                options = [x for s, _ in subs for x in s]
            else:
                close()
                done.append({frozenset()})
                continue
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            lo, hi, body = arg
            sub, inner = _strings(body, fold)
            if sub is not None and (lo, hi) == (0, 1):
                options = ["", *sub]
            elif sub is not None and lo == hi and lo <= 8:
                for _ in range(lo):
                    exact = [a + b for a in exact for b in sub]
                continue
            elif lo:
                if sub is not None and len(exact) * len(sub) <= MOST:
                    exact = [a + b for a in exact for b in sub]
                close()
                done.extend(inner)
                exact = [""]
                done.append({frozenset()})
                continue
        elif name in ("ASSERT", "ASSERT_NOT", "AT"):
            continue
        if options is None or len(exact) * len(options) > MOST:
            close()
            done.append({frozenset()})
        else:
            exact = [a + b for a in exact for b in options]
    if any(frozenset() in d for d in done) or len(done):
        close()
        return None, [d for d in done if frozenset() not in d]
    return exact, []


def trigram_query(pattern: str) -> tuple[Query, bool]:
    """(disjunction of conjunctions, whether it is over lower-cased text) for a Python regex."""
    tree = sre_parser.parse(pattern)
    fold = bool(tree.state.flags & re.IGNORECASE) or bool(re.search(r"\(\?[a-z]*i", pattern))
    exact, groups = _strings(tree, fold)
    if exact is not None:
        groups = [{frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in exact}]
    # a folded rule is asked of lower-cased bytes; a trigram beyond ASCII isn't three bytes and asks nothing
    groups = [{frozenset(g.lower() if fold else g for g in conj if g.isascii()) for conj in alts} for alts in groups]
    query: set[frozenset] = {frozenset()}
    for alts in groups:
        if frozenset() in alts:
            continue
        query = {a | b for a in query for b in alts}
        if len(query) > MOST:
            query = set(alts)
    return frozenset(query), fold


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    keep: Callable[[re.Match], bool] | None = None
    base: bool = False


def _long_value(m: re.Match) -> bool:
    return len(m.group(2)) >= 8


def _of(n: int) -> Callable[[re.Match], bool]:
    return lambda m: m.end() - m.start() >= n


#: The base rules in their listed order, then those of the operator's own.
RULES = (
    Rule("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", _long_value, True),
    Rule("access", r"AKIA[A-Z0-9]+", _of(16), True),
    Rule("hex", r"[0-9a-f]{32,}", None, True),
    Rule("pem", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)


class Scanner:
    """Rules compiled with their trigram queries; scan() indexes a batch of texts and yields each text's spans."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = [(r, re.compile(r.pattern), *trigram_query(r.pattern)) for r in rules]
        grams = {(g, fold) for _, _, q, fold in self.rules for c in q for g in c}
        self.grams = sorted(grams)
        self.number = {g: k + 1 for k, g in enumerate(self.grams)}
        self.tables = {}
        for fold in {f for _, f in grams}:
            t = np.zeros(1 << 24, np.uint8 if len(grams) < 255 else np.uint16)
            for g, f in grams:
                b = g.encode()
                if f == fold:
                    t[(b[0] << 16) | (b[1] << 8) | b[2]] = self.number[g, f]
            self.tables[fold] = t

    def postings(self, raw: list[bytes]) -> dict[int, np.ndarray]:
        """Trigram number -> sorted positions of the texts that hold it."""
        ends = np.cumsum([len(b) + 3 for b in raw])
        joined = b"\x00\x00\x00".join(raw) + b"\x00\x00\x00"
        found: dict[int, np.ndarray] = {}
        for fold, table in self.tables.items():
            a = np.frombuffer(joined.lower() if fold else joined, np.uint8)
            step = 1 << 22
            hits = []
            for lo in range(0, len(a), step):
                x = a[lo : lo + step + 2].astype(np.uint32)
                k = table[(x[:-2] << 16) | (x[1:-1] << 8) | x[2:]]
                at = np.flatnonzero(k)
                hits.append((k[at].astype(np.int64), np.searchsorted(ends, at + lo, "right")))
            pair = np.unique(np.concatenate([k * len(raw) + d for k, d in hits])) if hits else np.zeros(0, np.int64)
            for k in np.unique(pair // len(raw)):
                found[int(k)] = pair[pair // len(raw) == k] % len(raw)
        return found

    def scan(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        if not texts:
            return out
        post = self.postings([t.encode() for t in texts])
        none = np.zeros(0, np.int64)
        for rule, rx, query, fold in self.rules:
            if frozenset() in query:
                candidates: Iterator[int] | range = range(len(texts))
            else:
                candidates = set()
                for conj in query:
                    lists = sorted((post.get(self.number[g, fold], none) for g in conj), key=len)
                    got = lists[0]
                    for x in lists[1:]:
                        got = np.intersect1d(got, x, assume_unique=True)
                    candidates |= set(got.tolist())
            for d in candidates:
                out[d] += [(rule.kind, m.start(), m.end()) for m in rx.finditer(texts[d]) if rule.keep is None or rule.keep(m)]
        return out


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end, code points, by start then kind as listed)."""
    ship(docs.sparkSession)
    order = {r.kind: k for k, r in enumerate(rules)}
    base = {r.kind for r in rules if r.base}
    kinds = [r.kind for r in rules if r.base]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(rules)
        for b in batches:
            for lo in range(0, len(b), 1024):
                part = b.iloc[lo : lo + 1024]
                rows = []
                for d, spans in zip(part["doc_id"], scanner.scan(list(part["text"]))):
                    spans.sort(key=lambda s: (s[1], order[s[0]], s[2]))
                    own = ",".join(f"{k}:{s}:{e}" for k, s, e in spans if k in base)
                    rows.append((d, *(sum(k == x for k, _, _ in spans) for x in kinds), hashlib.sha256(own.encode()).hexdigest(), ",".join(f"{k}:{s}:{e}" for k, s, e in spans)))
                yield pd.DataFrame(rows, columns=["doc_id", *(f"n_{k}" for k in kinds), "base_sha256", "spans"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return src.mapInPandas(run, "doc_id long, " + "".join(f"n_{k} long, " for k in kinds) + "base_sha256 string, spans string")
