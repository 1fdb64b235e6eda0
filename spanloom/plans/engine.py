"""Query trees to DataFrames."""

from __future__ import annotations

import re
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import parse_range
from ..functions.metaphone import metaphone_keys
from ..functions.text import WORD_RUNS, glob_regex
from ..operators import boolean as B
from ..operators import proximity as P
from ..operators import score as S
from ..operators import typed as T
from ..operators import unary as U
from ..sources.database import Database
from .ast import Binary, Node, QueryError, Term, Unary, terms, weighted
from .parser import parse

_WORD = re.compile(r"[^\W_]+")


class Engine:
    """Compiles trees over one database. Nothing is collected but the number of records.

    normalization: see operators.score. compat: literal behaviour of operators whose documented meaning differs
    (FAR, bounds of DIST and HITCOUNT). date_range: restricts all lookups to records of those dates. join_words: a
    phrase of letters that is not found is looked for as one word. phrase_limit: a phrase whose words all occur so often becomes
    a chain of PRECEDES; the words' frequencies are read for that. sorts: further sort orders (function, private1,
    extindex64, any name): a function that gives ordering columns, or a table (rec_id, sort_key) to sort by.
    priority: how much a record's priority adds to its score, divided by the priority.
    """

    def __init__(self, db: Database, normalization: str = "l2", compat: bool = False, date_range: str | None = None, now: datetime | None = None, phonetic: str = "soundex", synonyms: dict | None = None, join_words: bool = False, phrase_limit: int | None = None, sorts: dict | None = None, priority: float = 0.0):
        if normalization not in S.METHODS:
            raise QueryError(3, normalization)
        self.db, self.method, self.compat, self.now, self.phonetic, self.synonyms = db, normalization, compat, now, phonetic, synonyms
        self.join_words, self.phrase_limit, self.priority = join_words, phrase_limit, priority
        self.sorts = {k.lower(): v for k, v in (sorts or {}).items()}
        self.records = db.live
        if date_range:
            lo, hi = parse_range(date_range)
            self.records = self.records.where(U.date_between(lo, hi))
        self.restricted = bool(date_range)
        self._memo: dict[Node, DataFrame] = {}

    @property
    def total(self) -> int:
        return self.db.total

    @property
    def lengths(self) -> DataFrame:
        return self.db.records.select("rec_id", "length").hint("merge")

    # -- entry points

    def run(self, query: str | Node) -> DataFrame:
        """The unordered result set of a query."""
        node = parse(query, self.compat) if isinstance(query, str) else query
        if self.synonyms:
            from .parser import expand

            node = expand(node, self.synonyms)
        if self.db.stop_words and all(self._only_stops(t) for t in terms(node)):
            raise QueryError(4)
        if self.db.tables is not None:
            self.db.tables.add(w for t in terms(node) for w in self._wanted(t))  # in one pass
        out = self.compile(node)
        if self.method == "cosine_metric":
            out = S.distance_weighted(out)
        return out

    def search(self, query: str | Node, sort: str = "score", limit: int | None = None, offset: int = 0) -> DataFrame:
        """Results with their records' metadata, ranked."""
        out = self.run(query).join(self.db.records.hint("merge"), "rec_id")
        if self.priority:
            out = S.with_priority(out, self.priority)
        out, by = self._ordered(out, sort)
        if limit is None:
            return out.orderBy(*by) if by else out
        return U.ranked(out, by, limit, offset) if by else out.limit(limit)

    def _only_stops(self, t: Term) -> bool:
        words = [w.lower() for w in _WORD.findall(t.text)]
        return not t.relation and t.mode in ("exact", "case", "phrase") and bool(words) and all(w in self.db.stop_words for w in words)

    def _ordered(self, out: DataFrame, sort: str) -> tuple[DataFrame, list[Column]]:
        """The set joined with its records, and its ordering columns."""
        own = self.sorts.get(sort.lower())
        if own is None:
            return out, U.sort_order(sort, F.lit(self.now) if self.now else F.current_timestamp())
        if callable(own):
            return out, [*own(), *U.best_first()]
        return out.join(own.select("rec_id", "sort_key"), "rec_id", "left"), [F.col("sort_key").asc_nulls_last(), F.col("rec_id")]

    # -- compilation

    def compile(self, n: Node) -> DataFrame:
        if n not in self._memo:
            if isinstance(n, Term):
                self._memo[n] = self._term(n)
            elif isinstance(n, Unary):
                self._memo[n] = self._unary(n)
            else:
                self._memo[n] = self._binary(n)
        return self._memo[n]

    def spans(self, field: str) -> DataFrame:
        """Instances of a field; `A\\B` is a path, and either may be a glob."""
        f = self.db.fields
        name = field.upper()
        if "\\" in name:
            return f.where(self._path_matches(name))
        if re.search(r"[*?\[{]", name):
            return f.where(F.rlike("field", F.lit(glob_regex(name))))
        return f.where(F.col("field") == name)

    @staticmethod
    def _path_matches(path: str) -> Column:
        parts = [glob_regex(p, anchored=False) for p in path.split("\\")]
        return F.rlike(F.upper("path"), F.lit(r"(?:^|\\)" + r"\\".join(parts) + "$"))

    def has_field(self, field: str) -> bool:
        return not self.spans(field).isEmpty()

    def _finish(self, hits: DataFrame, t: Term) -> DataFrame:
        """hits: rec_id, s, e -> a scored set."""
        ir = hits.groupBy("rec_id").agg(F.count("*").alias("hit_count"), F.lit(1).cast("bigint").alias("aux_count"), F.array_sort(F.collect_list(F.struct(F.col("s").cast("bigint").alias("s"), F.col("e").cast("bigint").alias("e")))).alias("hits"))
        if t.free:
            ir = ir.withColumn("hits", F.array().cast(B.HITS))
        return self._score(ir, t.weight)

    def _score(self, ir: DataFrame, weight: float, extra: str | None = None) -> DataFrame:
        out = S.normalise(ir, self.total, self.method, weight, self.lengths, extra)
        return out.select(*B.COLUMNS)

    def _only_live(self, rows: DataFrame) -> DataFrame:
        if self.db.whole and not self.restricted:
            return rows.where("rec_id is not null")
        # ids pack so well in files that a table of millions looks small enough to broadcast
        return rows.join(self.records.select("rec_id").hint("merge"), "rec_id", "left_semi")

    def _wanted(self, t: Term) -> list[tuple[str, str]]:
        """What a term looks up, as kinds and texts for word_test."""
        if t.relation or t.field and self.db.types.get(t.field, "string") not in ("string", "text", "any", "isbn"):
            return []
        text = self.db.aliases.get(t.text.lower(), t.text)
        if t.mode in ("left", "infix", "glob", "phonetic", "metaphone"):
            return [self._pattern(t.mode, text)]
        words = [w.lower() for w in _WORD.findall(text)]
        if t.mode in ("phrase", "phrase_right"):
            joined = [("exact", "".join(words))] if self.join_words else []
            return [("right" if t.mode == "phrase_right" and k == len(words) - 1 else "exact", w) for k, w in enumerate(words)] + joined
        if t.mode in ("right", "case_right"):
            return [("right", text.lower())]
        return [("exact", w) for w in words] if t.mode == "exact" and len(words) > 1 else [("exact", text.lower())]

    def _pattern(self, mode: str, text: str) -> tuple[str, str]:
        sounds = mode == "metaphone" or mode == "phonetic" and self.phonetic == "metaphone"
        return ("metaphone", text) if sounds else (mode, text.lower())

    def _term(self, t: Term) -> DataFrame:
        if t.relation:
            return self._typed(t)
        text = self.db.aliases.get(t.text.lower(), t.text)
        if t.field and t.field in self.db.types and self.db.types[t.field] not in ("string", "text", "any", "isbn"):
            return self._typed(Term(t.text, "typed", t.field, "=", t.weight))
        low = text.lower()
        if t.mode in ("phrase", "phrase_right"):
            if self.phrase_limit is not None and self._all_common(text):
                from .parser import phrase_to_prox

                return self.compile(weighted(phrase_to_prox(text), t.weight))
            hits = self._phrase(text, t.mode == "phrase_right").select("rec_id", "s", "e")
            if self.join_words and not re.search(r"[0-9]", text):
                # the joined word counts only where the phrase isn't found at all
                none = hits.agg(F.count("*")).scalar() == 0
                hits = hits.unionByName(self.db.lookup("".join(_WORD.findall(low))).select("rec_id", "s", "e").where(none))
        elif t.mode == "exact":
            words = _WORD.findall(low)
            hits = self._phrase(text, False) if len(words) > 1 else self.db.lookup(low)
        elif t.mode == "right":
            hits = self.db.words("right", low).where(F.startswith("term", F.lit(low)))
        elif t.mode in ("left", "infix", "glob", "phonetic", "metaphone"):
            hits = self._by_dictionary(t.mode, text)
        elif t.mode == "case":
            hits = self.db.lookup(low).where(F.col("raw") == text)
        elif t.mode == "case_right":
            hits = self.db.words("right", low).where(F.startswith("term", F.lit(low)) & F.startswith("raw", F.lit(text)))
        elif t.mode == "exactterm":
            hits = self._exact_term(low)
        else:
            raise QueryError(3, t.mode)
        hits = hits.select("rec_id", "s", "e")
        hits = self._only_live(hits)
        if t.field:
            hits = P.inside(hits, self.spans(t.field))
        return self._finish(hits, t)

    def _all_common(self, text: str) -> bool:
        words = [w.lower() for w in _WORD.findall(text)]
        freq = self.db.terms
        if freq is None:
            p = self.db.postings
            if self.db.tables is not None:
                self.db.tables.add([("exact", w) for w in words])
                p = reduce(DataFrame.unionByName, [self.db.lookup(w) for w in dict.fromkeys(words)])
            freq = p.where(F.col("term").isin(words)).groupBy("term").agg(F.count("*").alias("freq"))
        found = {r["term"]: r["freq"] for r in freq.where(F.col("term").isin(words)).collect()}  # the phrase's words
        return len(words) > 1 and all(found.get(w, 0) >= self.phrase_limit for w in words)

    def _by_dictionary(self, mode: str, text: str) -> DataFrame:
        """Patterns are matched against distinct terms, then joined with the postings."""
        p = self.db.words(*self._pattern(mode, text))
        words = self.db.vocabulary if self.db.tables is None else p.select("term").distinct()
        low = text.lower()
        if mode == "left":
            good = words.where(F.endswith("term", F.lit(low)))
        elif mode == "infix":
            good = words.where(F.contains("term", F.lit(low)))
        elif mode == "glob":
            good = words.where(F.rlike("term", F.lit(glob_regex(low))))
        elif mode == "metaphone" or self.phonetic == "metaphone":
            keys = metaphone_keys(text)
            from ..functions.metaphone import metaphone

            good = words.withColumn("m", metaphone("term")).where(F.arrays_overlap("m", F.array(*[F.lit(k) for k in keys])))
        else:
            good = words.where(F.rlike("term", F.lit("^[a-z]"))).where(F.soundex("term") == F.soundex(F.lit(text)))
        return p.join(good.select("term"), "term", "left_semi")

    def _phrase(self, text: str, truncated: bool) -> DataFrame:
        """Consecutive words; the rest of the words is looked for only where the first one is."""
        words = [w.lower() for w in _WORD.findall(text)]
        if not words:
            raise QueryError(125, text)
        if len(words) == 1:
            return self.db.words("right", words[0]).where(F.startswith("term", F.lit(words[0]))) if truncated else self.db.lookup(words[0])
        out = self.db.lookup(words[0]).select("rec_id", "pos", "s", "e")
        for k, w in enumerate(words[1:], 1):
            last = truncated and k == len(words) - 1
            q = self.db.words("right", w).where(F.startswith("term", F.lit(w))) if last else self.db.lookup(w)
            q = q.select("rec_id", (F.col("pos") - k).alias("pos"), F.col("e").alias("e2"))
            out = out.join(q, ["rec_id", "pos"]).select("rec_id", "pos", "s", F.col("e2").alias("e"))
        return out

    def _exact_term(self, low: str) -> DataFrame:
        """Whole terms only: not part of one joined by - _ . or ,"""
        h = self.db.lookup(low).select("rec_id", "s", "e").join(self.db.texts, "rec_id").withColumn("b", F.encode("text", "UTF-8"))
        # a letter takes four bytes at most; what is cut in two at the far end is no letter then
        part = lambda a, n: F.make_valid_utf8(F.substring("b", (a + 1).cast("int"), n.cast("int")).cast("string"))
        first = F.greatest(F.col("s") - 5, F.lit(0))
        before, after = part(first, F.col("s") - first), part(F.col("e") + 1, F.lit(5))
        joined = F.rlike(before, F.lit(r"[\p{L}\p{N}][-_.,]\z")) | F.rlike(after, F.lit(r"^(?:[-_]|[.,][\p{L}\p{N}])"))
        return h.where(~joined).select("rec_id", "s", "e")

    def _typed(self, t: Term) -> DataFrame:
        """Cascade over the field's type; without one, over what the term looks like."""
        rel = t.relation or "="
        if rel == "RECT":
            ir = T.boxes(self.db.typed_table("boxes"), t.field, t.text)
            return self._score(self._only_live(ir), t.weight, "gscore")
        kind = self.db.types.get(t.field or "", None)
        if kind is None:
            kind = "numerical" if re.fullmatch(r"-?[0-9.]+", t.text) else "string"
        d = self.db
        if kind in ("numerical", "number", "computed", "currency", "ttl", "boolean", "dotnumber", "inet"):
            text = t.text
            if kind == "boolean":
                text = "1" if text.lower() in ("1", "true", "yes", "y", "on") else "0"
            if kind in ("dotnumber", "inet"):
                text = str(dotted(text))
            if kind == "currency":
                text = re.sub(r"[^0-9.-]", "", text)
            ir = T.numeric(d.typed_table("numbers"), t.field, rel, text)
        elif kind in ("date", "time", "expires"):
            ir = T.date_interval(d.typed_table("dates"), t.field, rel, t.text) if re.search(r"/|\.\.", t.text) or rel[-1] in "{[" else T.date_point(d.typed_table("dates"), t.field, rel, t.text)
        elif kind in ("date-range", "duration"):
            ir = T.date_interval(d.typed_table("dates"), t.field, rel, t.text)
        elif kind in ("range", "numrange"):
            lo, _, hi = t.text.partition("..")
            ir = T.number_interval(d.typed_table("ranges"), t.field, rel, float(lo), float(hi or lo))
        elif kind in ("box", "bounding-box"):
            ir = T.boxes(d.typed_table("boxes"), t.field, t.text)
            return self._score(self._only_live(ir), t.weight, "gscore")
        elif kind in ("hash", "casehash"):
            ir = T.hashed(d.typed_table("hashes"), t.field, t.text, kind == "casehash")
        elif kind == "lexi":
            ir = T.lexical(d.typed_table("hashes"), t.field, rel, t.text)
        elif kind in ("phonetic", "phone2", "metaphone", "metaphone2"):
            return self._phonetic_field(t, kind)
        elif kind in ("string", "text", "any", "isbn"):
            if rel not in ("=", "<>"):
                raise QueryError(113, f"{t.field} is text")
            found = self._term(Term(t.text, "exact", t.field, None, t.weight))
            return B.not_(self.records, self.total, found) if rel == "<>" else found
        else:
            raise QueryError(113, kind)
        return self._score(self._only_live(ir), t.weight)

    def _phonetic_field(self, t: Term, kind: str) -> DataFrame:
        """Every word of the query sounds like a word of one and the same field instance."""
        words = _WORD.findall(t.text)
        out = None
        for w in words:
            hits = self._by_dictionary("metaphone" if "meta" in kind else "phonetic", w).select("rec_id", "s", "e")
            f = self.spans(t.field).select("rec_id", F.col("s").alias("fs"), F.col("e").alias("fe"))
            x = hits.join(f, "rec_id").where("fs <= s and fe >= e")
            out = x if out is None else out.join(x.select("rec_id", "fs", "fe").distinct(), ["rec_id", "fs", "fe"], "left_semi").unionByName(x.join(out.select("rec_id", "fs", "fe").distinct(), ["rec_id", "fs", "fe"], "left_semi"))
        return self._finish(self._only_live(out.select("rec_id", "s", "e")), t)

    def _unary(self, n: Unary) -> DataFrame:
        op, arg = n.op, n.arg
        a = self.compile(n.child)
        if op == "NOT":
            if arg in (None, "*"):
                return B.not_(self.records, self.total, a)
            return B.not_within(self.records, self.total, a, self.spans(arg)).select(*B.COLUMNS)
        if op in ("WITHIN", "INSIDE"):
            if arg == "*":
                return a
            if not re.search(r"[*?\[{]", arg) and not self.has_field(arg):
                try:
                    lo, hi = parse_range(arg)
                except QueryError:
                    return a.limit(0)
                return U.with_records(a, self.records, U.date_between(lo, hi))
            return P.within(a, self.spans(arg), self.total, self.method, self.lengths)
        if op == "XWITHIN":
            return P.xwithin(a, self.spans(arg), self.total, self.method, self.lengths) if self.has_field(arg) else a
        if op == "INCLUSIVE":
            return P.inclusive(a, self.spans(arg), self.total, self.method, self.lengths)
        if op == "SIBLING":
            return P.sibling(a, self.spans(arg) if arg else self.db.fields)
        if op == "REDUCE":
            return U.reduce(a, arg or 0)
        if op == "HITCOUNT":
            return U.hit_count(a, arg)
        if op == "TRIM":
            return U.trim(a, arg, self.total)
        if op == "BOOST":
            return U.boost(a, arg)
        if op == "SORTBY":
            out, by = self._ordered(a.join(self.db.records.hint("merge"), "rec_id"), arg)
            return out.orderBy(*by).select(*B.COLUMNS) if by else a
        if op == "WITHKEY":
            return U.with_records(a, self.records, U.key_matches(arg))
        if op == "FILE":
            return U.with_records(a, self.records, U.file_matches(arg))
        if op == "EXTENSION":
            return U.with_records(a, self.records, U.file_matches(f"*.{arg}"))
        if op == "DOCTYPE":
            return U.with_records(a, self.records, F.upper("doctype") == arg.upper())
        raise QueryError(110, op)

    def _binary(self, n: Binary) -> DataFrame:
        op, arg = n.op, n.arg
        a, b = self.compile(n.left), self.compile(n.right)
        flip = {"NOR": "OR", "NAND": "AND", "XNOR": "XOR"}
        if op in flip:
            return B.not_(self.records, self.total, self._binary(Binary(flip[op], n.left, n.right)))
        if op == "OR":
            return B.or_(a, b)
        if op == "AND":
            return B.and_(a, b)
        if op == "ANDNOT":
            return B.and_not(a, b)
        if op == "NOTAND":
            return B.and_not(b, a)
        if op == "XOR":
            return B.xor(a, b)
        if op in ("JOIN", "JOINL", "JOINR"):  # within one database a key is a record
            return B.and_(a, b)
        this, other = b, a  # the last operand is the reference

        def prox(metric: float, order: str | None = None, swap: bool = False) -> DataFrame:
            return P.char_prox(this, other, metric, order, self.lengths, swap)

        fields = self.db.fields
        if op == "NEAR":
            if arg is None:
                return P.peer(this, other, fields) if self.db.has_fields else prox(50)
            return prox(arg, None, False)
        if op in ("BEFORE", "AFTER"):
            order = op.lower()
            if arg is None:
                return P.peer(this, other, fields, order) if self.db.has_fields else prox(50, order)
            return prox(arg, order)
        if op == "FAR":
            if not self.db.has_fields:
                return prox(-50, None, True)
            apart = P.peer(this, other, fields, None, True)
            return P.char_prox(apart, other, -50, None, self.lengths, False) if self.compat else apart
        if op == "ADJ":
            return prox(3, None, True)
        if op == "FOLLOWS":
            return prox(4, "after")
        if op == "PRECEDES":
            return prox(4, "before")
        if op == "NEIGHBOR":
            return prox(0.05, None, True)
        if op == "PEER":
            return P.peer(this, other, fields)
        if op in ("PEERA", "PEERB"):
            return P.peer(this, other, fields, {"PEERA": "after", "PEERB": "before"}[op])
        if op == "XPEER":
            return P.peer(this, other, fields, None, True)
        if op == "ANDFIELD":
            return P.and_field(this, other, self.spans(arg))
        if op in ("BEFOREFIELD", "AFTERFIELD"):
            return P.and_field(this, other, self.spans(arg), op[: -len("FIELD")].lower())
        if op == "ORFIELD":
            return P.within(B.or_(a, b), self.spans(arg), self.total, self.method, self.lengths)
        raise QueryError(110, op)


def dotted(text: str) -> int:
    """A dotted number (IPv4, or any numbers below 256) as one number."""
    v = 0
    for x in text.split("."):
        v = v * 256 + int(x)
    return v


def smart_search(db: Database, text: str, field: str | None = None, **options) -> DataFrame:
    """The literal phrase; else words in one container (or one field); else any, reduced to the most terms. First that finds anything."""
    from .parser import combined, literal_phrase

    eng = Engine(db, **options)
    words = re.findall(WORD_RUNS.split("|")[0].replace(r"\p{L}\p{N}", r"^\W_"), text)
    plans: list[Node] = [literal_phrase(text)]
    if len(words) > 1:
        plans.append(combined("ANDFIELD", text, field.upper()) if field else combined("PEER", text))
    plans.append(Unary("REDUCE", combined("OR", text), len(words)))
    for k, p in enumerate(plans):
        out = eng.run(p)
        if k == len(plans) - 1 or not out.isEmpty():
            return out
    return out


def feedback(db: Database, key: str, field: str | None = None, weight: float = 1.0, most_single: int = 15) -> Node:
    """Alternatives of a record's words, each weighing as often as it occurs there; words that occur once go beyond the first fifteen unless longer than eight characters."""
    from .parser import _chain

    rec = db.live.where(F.col("key") == key).select("rec_id")
    hits = db.postings.join(rec, "rec_id", "left_semi")
    if field:
        hits = P.inside(hits.select("rec_id", "s", "e"), db.fields.where(F.col("field") == field.upper())).join(hits, ["rec_id", "s", "e"])
    counts = hits.where(~F.col("term").isin(sorted(db.stop_words)) if db.stop_words else F.lit(True)).groupBy("term").agg(F.count("*").alias("n"), F.min("s").alias("first")).orderBy("first").collect()  # one record's words
    singles, out = 0, []
    for r in counts:
        if r["n"] == 1:
            singles += 1
            if singles > most_single and len(r["term"]) <= 8:
                continue
        out.append(Term(r["term"], weight=r["n"] * weight))
    if not out:
        raise QueryError(4)
    return _chain("OR", out)
