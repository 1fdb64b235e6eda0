"""Personal data by weak supervision, by DataFrame functions only.

Base spans are what four patterns with their checks find; they always stay. The method adds spans: loose
candidate patterns, one for each further kind, are voted on by LABELERS (a strict shape or check sum, gazetteers, the
words before it, counter-indicating words before it, the characters around it, base spans elsewhere in the text), each
for, against or abstaining. Base spans are voted on, too, so that what the labelers say of them teaches their reliability.
Expectation-maximisation over the vote patterns of the whole corpus estimates every labeler's
reliability and each pattern's probability; with these as soft labels a naive Bayes span classifier is
trained over the candidate's kind, votes, length and surroundings, and accepts a candidate from 0.5 on. Numbers that
base refuses (cards that fail their check sum, two cards in a row, dotted numbers that are no address) are candidates.

The corpus meets the model only through counts of (kind, votes, features), whose number is bounded by
their alphabet, so EM is one expression over one row. Offsets are code points, ends exclusive. Null and
empty texts have no spans, empty tables no rows; without candidates nothing is added. Texts may be of any length: work
grows with a text and its spans. Spans that start alike go by kind as listed; redaction names overlapping
spans after the first. Repeated rows each give a row. `redact` passes other columns through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gazetteers as g
from .common import materialise

#: Base kinds as listed: pattern, cheap test that any match passes, check. Possessive quantifiers and looks
#: behind change no match; they keep long runs linear and off the stack.
_E = "[A-Za-z0-9._%+-]"
BASE = {
    "email": (rf"(?:(?<!{_E})|\G){_E}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda t: F.contains(t, F.lit("@")), None),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda t: F.rlike(t, F.lit(r"[0-9]\.[0-9]")), lambda v: F.rlike(v, F.lit(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$"))),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", lambda t: F.rlike(t, F.lit(r"[0-9](?:[\x20-]?[0-9]){11}")), lambda v: F.length(_digits(v)).between(12, 19) & F.call_function("luhn_check", _digits(v))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: F.contains(t, F.lit("+")), lambda v: F.length(_digits(v)).between(9, 15)),
}
KINDS = tuple(BASE)


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


#: Candidate kinds of the method: loose pattern, cheap test, strict shape, gazetteer, words that speak for it when before it.
_CAP = r"[A-Z\u00C0-\u00DE]\p{Ll}{1,20}"
_TITLE = r"(?:Mr|Mrs|Ms|Dr|Herr|Frau|Mme|Sr|Sra)\.?\x20"
_CARD = r"card|account|acct|iban|konto|karte|compte|carte|cuenta|tarjeta|visa|payment"
_PHONE = r"tel|phone|call|mobile|cell|fax|dial|reach|handy|anruf"


def _any(words: list[str]) -> str:
    return "(?:" + "|".join(words) + ")"


def _test(pattern: str):
    return lambda t: F.rlike(t, F.lit(pattern))


ADDED = {
    "email_spelt": (r"(?i)\b[a-z0-9][a-z0-9._%+-]{0,63}\s?[\[(]\s?at\s?[\])]\s?[a-z0-9-]{1,63}(?:\s?(?:\.|[\[(]\s?dot\s?[\])])\s?[a-z0-9-]{2,63}){1,4}", _test(r"(?i)[\[(]\s?at\s?[\])]"), r"(?i)^\S+\s?[\[(]\s?at\s?[\])]\s?\S+\s?(?:\.|[\[(]\s?dot\s?[\])])\s?[a-z]{2,}$", rf"(?i)\b{_any(g.DOMAINS)}$", r"e-?mail|mail|contact|write|reach"),
    "phone_local": (r"(?<![0-9+(])(?<!\+[0-9]{1,3} )\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])", _test(r"[0-9]{3}[\x20.-][0-9]{4}"), r"^(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}-)[2-9][0-9]{2}-[0-9]{4}$", rf"^\(?{_any(g.AREAS)}", _PHONE),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", _test(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"), r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$", "^$", r"ssn|social|security|tax"),
    "iban": (r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?\b", _test(r"\b[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}"), r"^[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?$", rf"^{_any(g.IBAN)}[0-9]", _CARD + "|bank"),
    "person": (rf"(?:\b{_TITLE}|(?<=\b(?:[Nn]ame|[Dd]ear|[Cc]ontact|[Aa]uthor|[Ss]igned|[Ss]incerely|[Rr]egards|[Cc]all|[Bb]y)[:,]?[\x20\n])){_CAP}(?:\x20{_CAP})?\b", _test(rf"\b{_TITLE}{_CAP}|\b(?:[Nn]ame|[Dd]ear|[Cc]ontact|[Aa]uthor|[Ss]igned|[Ss]incerely|[Rr]egards|[Cc]all|[Bb]y)[:,]?[\x20\n]{_CAP}"), rf"^{_TITLE}|\x20", rf"\b{_any(g.GIVEN)}\b|\b{_any(g.SURNAMES)}$", r"name|signed|dear|contact|author|sincerely|regards|call"),
    "account": (r"(?<![\p{L}0-9.,/])(?:[0-9]{12,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3})(?![\p{L}0-9])", _test(r"[0-9]{4}[\x20-]?[0-9]{4}[\x20-]?[0-9]{4}"), None, rf"^{_any(g.ISSUERS)}", _CARD),
    "phone_bare": (r"(?<![\p{L}0-9.,+/#-])[0-9]{9,11}(?![\p{L}0-9.,/-])", _test(r"[0-9]{9}"), r"^(?:0|1?[2-9])[0-9]{8,9}$", rf"^0|^1?{_any(g.AREAS)}", _PHONE),
    "dotted": (r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){1,5}(?!\.?[0-9])", _test(r"[0-9]\.[0-9]"), r"^[0-9]+(?:\.[0-9]+){3}$", "^$", r"ip|host|server|address|adresse"),
}
#: The same for base spans, which stay whatever the votes are.
_BASE_VOTES = {
    "email": (r"\.[A-Za-z]{2,}$", rf"(?i)\.{_any(g.DOMAINS)}$", r"e-?mail|mail|contact|write|reach"),
    "ip": (r".", r"^(?:10|127|192\.168)\.", r"ip|host|server|address|adresse"),
    "card": (r".", rf"^{_any(g.ISSUERS)}", _CARD),
    "phone": (r".", rf"^\+{_any(g.CALLING)}", _PHONE),
}
ALL = (*KINDS, *ADDED)
_AGAINST = r"(?i)(?:version|v\.|license|licence|order|invoice|isbn|issn|page|fig|section|chapter|serial|model|item|sku|build|release|id)\W{0,3}$"
LABELERS = 6
FEATURES = 3
ROUNDS = 25
BEFORE = 32
BLOCK = 64

SPAN = "struct<start:int,kind:int,end:int>"


def let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def before(values: Column, kind: str, zero: Column, op) -> Column:
    """For every value the running op of those before it. Blocks keep appended arrays short, so work is nearly linear."""

    def scan(block: Column, first: Column) -> Column:
        start = F.struct(F.array().cast(f"array<{kind}>").alias("at"), first.alias("p"))
        return F.aggregate(block, start, lambda acc, x: F.struct(F.concat(acc["at"], F.array(acc["p"])).alias("at"), op(acc["p"], x).alias("p")), lambda acc: acc["at"])

    def all_of(v: Column) -> Column:
        nth = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int"))
        return let(F.transform(nth, lambda c: F.slice(v, c * BLOCK + 1, F.lit(BLOCK))), lambda blocks: F.flatten(
            F.zip_with(scan(F.transform(blocks, lambda b: F.aggregate(b, zero, op)), zero), blocks, lambda p, b: scan(b, p))
        ))

    return let(values, lambda v: F.when(F.size(v) > 0, all_of(v)).otherwise(F.array().cast(f"array<{kind}>")))


def spans(text: Column, pattern: str, cheap, check) -> Column:
    """Array of (start, end, value) of a pattern's matches: the pieces between matches give the offsets."""

    def place(m: Column) -> Column:
        pieces = F.split(text, pattern, -1)
        sizes = F.zip_with(F.slice(pieces, F.lit(1), F.size(m)), m, lambda a, b: F.struct(F.length(a).alias("gap"), F.length(b).alias("len"), b.alias("value")))
        at = lambda z: before(F.transform(z, lambda x: x["gap"] + x["len"]), "int", F.lit(0), lambda p, x: p + x)
        return let(sizes, lambda z: F.zip_with(at(z), z, lambda s, x: F.struct((s + x["gap"]).alias("start"), (s + x["gap"] + x["len"]).alias("end"), x["value"].alias("value"))))

    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    found = F.when(cheap(text), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) > 0, place(m)).otherwise(none))).otherwise(none)
    return F.filter(found, lambda s: check(s["value"])) if check else found


def windows(text: Column) -> Column:
    """A text as pieces of WINDOW code points, by which a part is cut out without counting from the text's start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{WINDOW}}}"), F.lit(0))


WINDOW = 256


def cut(pieces: Column, start: Column, end: Column) -> Column:
    """The code points start to end (exclusive) of the text whose windows these are."""
    first = F.floor(F.greatest(start, F.lit(0)) / WINDOW).cast("int")
    last = F.floor((end - 1) / WINDOW).cast("int")

    def part(k: Column) -> Column:
        a = F.greatest(start - k * WINDOW, F.lit(0))
        return F.substring(F.coalesce(F.get(pieces, k), F.lit("")), a + 1, F.least(end - k * WINDOW, F.lit(WINDOW)) - a)

    return F.when(end > start, F.array_join(F.transform(F.sequence(first, F.greatest(first, last)), part), "")).otherwise(F.lit(""))


def _of_kind(n: int):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(n).alias("kind"), s["end"].alias("end"))


def _valued(text: Column) -> Column:
    """Base spans with their values, by start, then kind."""
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")

    def of(n: int):
        return lambda s: F.struct(s["start"].alias("start"), F.lit(n).alias("kind"), s["end"].alias("end"), s["value"].alias("value"))

    return F.array_sort(F.concat(none, *[F.transform(spans(text, *BASE[k]), of(n)) for n, k in enumerate(KINDS)]))


def _luhn(v: Column) -> Column:
    return F.call_function("luhn_check", _digits(v))


def _votes(pieces: Column, s: Column, others: Column, shape: Column, gazetteer: str, words: str) -> list[Column]:
    """Votes of the labelers, 0 against, 1 abstains, 2 for; then the features, each a digit."""
    left = cut(pieces, F.greatest(s["start"] - BEFORE, F.lit(0)), s["start"])
    prev = F.coalesce(F.nullif(F.right(left, F.lit(1)), F.lit("")), F.lit(" "))
    nxt = F.coalesce(F.nullif(cut(pieces, s["end"], s["end"] + 1), F.lit("")), F.lit(" "))
    has = lambda c, rx: F.rlike(c, F.lit(rx))
    glued = has(prev, r"[\p{L}\p{N}_]") | has(nxt, r"[\p{L}\p{N}_]")
    length = s["end"] - s["start"]
    return [
        shape,
        F.when(has(s["value"], gazetteer), 2).otherwise(1),
        F.when(has(left, rf"(?i)\b(?:{words})"), 2).otherwise(1),
        F.when(has(left, _AGAINST), 0).otherwise(1),
        F.when(glued, 0).when(has(prev, r"[\s(:\"']") & has(nxt, r"[\s.,;)!?\"']"), 2).otherwise(1),
        F.when(others, 2).otherwise(1),
        F.when(length < 12, 0).when(length < 16, 1).when(length < 24, 2).otherwise(3),
        F.when(has(prev, r"[:=]"), 2).when(has(left, r"[:=]\s*$"), 3).when(has(prev, r"\s"), 1).otherwise(0),
        F.when(has(nxt, r"[.,;)\s]"), 1).otherwise(0),
    ]


def _candidates(text: Column, pieces: Column, base: Column) -> Column:
    """Array of (start, kind, end, key): what is voted on, base spans among it."""
    none = F.array().cast("array<struct<start:int,kind:int,end:int,key:string>>")

    def voted(kind: int, s: Column, others: Column, shape: Column, gazetteer: str, words: str) -> Column:
        key = F.concat(F.lit(chr(97 + kind)), *[v.cast("string") for v in _votes(pieces, s, others, shape, gazetteer, words)])
        return F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"), key.alias("key"))

    def added(kind: int, strict: str | None, gazetteer: str, words: str):
        def one(s: Column) -> Column:
            # a card number: its check sum speaks for it, another length than sixteen against it
            shape = F.when(F.rlike(s["value"], F.lit(strict)), 2).otherwise(0) if strict else F.when(_luhn(s["value"]), 2).when(F.length(_digits(s["value"])) == 16, 1).otherwise(0)
            return voted(kind, s, F.size(base) > 0, shape, gazetteer, words)

        return one

    def own(kind: int, strict: str, gazetteer: str, words: str):
        return lambda s: voted(kind, s, F.size(base) > 1, F.when(F.rlike(s["value"], F.lit(strict)), 2).otherwise(0), gazetteer, words)

    place = lambda s: F.shiftleft(s["start"].cast("long"), 32) + s["end"]
    parts = [F.transform(F.filter(base, lambda s, n=n: s["kind"] == n), own(n, *_BASE_VOTES[k])) for n, k in enumerate(KINDS)]
    for n, (pattern, cheap, strict, gazetteer, words) in enumerate(ADDED.values()):
        f = added(n + len(KINDS), strict, gazetteer, words)
        # what is a base span already isn't added once more
        new = lambda c: let(F.array_intersect(F.transform(c, place), F.transform(base, place)), lambda had: F.filter(c, lambda s: ~F.array_contains(had, place(s))))
        parts.append(F.transform(let(spans(text, pattern, cheap, None), lambda c: F.when((F.size(c) > 0) & (F.size(base) > 0), new(c)).otherwise(c)), f))
    return F.concat(none, *parts)


def _em(patterns: Column) -> Column:
    """From array<struct<n, hot array<double>>> of vote patterns, the log-odds weight of each (labeler, vote) and the bias."""
    width = 3 * LABELERS
    start = [0.2, 0.3, 0.5] * LABELERS
    arr = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    zero = arr([0.0] * width)

    def sigmoid(x: Column) -> Column:
        return 1 / (1 + F.exp(-x))

    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    def spread(acc: Column, p: Column, weight: Column) -> Column:
        return F.zip_with(acc, p, lambda a, h: a + weight * h)

    def step(st: Column) -> Column:
        soft = F.transform(patterns, lambda p: F.struct(p["n"].alias("n"), p["hot"].alias("hot"), sigmoid(st["bias"] + dot(p["hot"], st["w"])).alias("r")))
        yes = F.aggregate(soft, zero, lambda acc, p: spread(acc, p["hot"], p["n"] * p["r"]))
        no = F.aggregate(soft, zero, lambda acc, p: spread(acc, p["hot"], p["n"] * (1 - p["r"])))
        # every labeler votes once for a candidate: its three counts sum to the class's size
        total = lambda c: F.aggregate(F.slice(c, 1, 3), F.lit(0.0), lambda s, x: s + x)
        both = F.struct(yes.alias("yes"), no.alias("no"))
        return F.transform(F.array(both), lambda b: F.struct(
            F.zip_with(b["yes"], b["no"], lambda y, n: F.log((y + 1) / (total(b["yes"]) + 3)) - F.log((n + 1) / (total(b["no"]) + 3))).alias("w"),
            F.log((total(b["yes"]) + 1) / (total(b["no"]) + 1)).alias("bias"),
        ))[0]

    first = F.struct(F.transform(F.zip_with(arr(start), arr([s for _ in range(LABELERS) for s in (0.5, 0.3, 0.2)]), lambda a, b: a / b), lambda x: F.log(x)).alias("w"), F.lit(0.0).alias("bias"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), first, lambda st, _: step(st))


def _hot(key: Column) -> Column:
    """One-hot votes of a key of one kind digit, the votes and the features."""
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LABELERS - 1)), lambda j: F.transform(F.array(F.lit("0"), F.lit("1"), F.lit("2")), lambda v: F.when(F.substring(key, j + 2, F.lit(1)) == v, 1.0).otherwise(0.0))))


def accepted_keys(counts: DataFrame) -> DataFrame:
    """key, posterior, score of every candidate pattern, from its counts (key, n); accepted is score >= 0.5."""
    votes = counts.groupBy(F.substring("key", 2, LABELERS).alias("v")).agg(F.sum("n").alias("n"))
    votes = votes.select(F.struct(F.col("n").cast("double").alias("n"), _hot(F.concat(F.lit("0"), "v")).alias("hot")).alias("p"))
    model = votes.agg(F.collect_list("p").alias("ps")).select(_em(F.col("ps")).alias("m"))  # at most 3 ** LABELERS patterns
    soft = counts.withColumn("m", model.scalar()).withColumn("hot", _hot(F.col("key")))
    z = F.col("m.bias") + F.aggregate(F.zip_with("hot", "m.w", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    soft = soft.select("key", "n", (1 / (1 + F.exp(-z))).alias("posterior"))
    # naive Bayes over kind, votes and features, with soft labels
    parts = F.transform(F.sequence(F.lit(1), F.lit(1 + LABELERS + FEATURES)), lambda j: F.concat(j.cast("string"), F.lit(":"), F.substring(F.col("key"), j, F.lit(1))))
    one = soft.select("key", "n", "posterior", F.explode(parts).alias("f"))
    weight = one.groupBy("f").agg(F.sum(F.col("n") * F.col("posterior")).alias("y"), F.sum(F.col("n") * (1 - F.col("posterior"))).alias("x"))
    total = soft.agg(F.sum(F.col("n") * F.col("posterior")).alias("y"), F.sum(F.col("n") * (1 - F.col("posterior"))).alias("x")).select(F.struct("y", "x"))
    weight = weight.withColumn("t", total.scalar()).select("f", (F.log((F.col("y") + 1) / (F.col("t.y") + 4)) - F.log((F.col("x") + 1) / (F.col("t.x") + 4))).alias("w"), F.log((F.col("t.y") + 1) / (F.col("t.x") + 1)).alias("bias"))
    scored = one.join(weight, "f").groupBy("key", "posterior").agg((1 / (1 + F.exp(-(F.sum("w") + F.max("bias"))))).alias("score"))
    return scored


def _accepted(found: DataFrame) -> DataFrame:
    counts = found.select(F.explode("_pii_cand.key").alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    keys = accepted_keys(counts).where("score >= 0.5")
    return materialise(keys.agg(F.collect_set("key").alias("keys")), "pii-model")  # one row, bounded by the alphabet of keys


def detect(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns, _pii_base and _pii_all (array of (start, kind, end)) of every row."""
    src = docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_pii_text"))
    src = src.withColumn("_pii_found", _valued(F.col("_pii_text")))
    # pieces are cut only of texts that hold anything to vote on
    maybe = F.size("_pii_found") > 0
    for _, cheap, *_ in ADDED.values():
        maybe = maybe | cheap(F.col("_pii_text"))
    src = src.withColumn("_pii_pieces", F.when(maybe, windows(F.col("_pii_text"))))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,key:string>>")
    cand = F.when(F.col("_pii_pieces").isNotNull(), _candidates(F.col("_pii_text"), F.col("_pii_pieces"), F.col("_pii_found"))).otherwise(none)
    base = F.transform("_pii_found", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    found = materialise(src.select(*keep, base.alias("_pii_base"), cand.alias("_pii_cand")), "pii-found")
    found = found.withColumn("_pii_ok", _accepted(found).select("keys").scalar())
    added = F.transform(F.filter("_pii_cand", lambda c: (c["kind"] >= len(KINDS)) & F.array_contains("_pii_ok", c["key"])), lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))
    every = F.array_sort(F.concat("_pii_base", added))
    return found.select(*keep, "_pii_base", F.when(F.size("_pii_cand") > 0, every).otherwise(F.col("_pii_base")).alias("_pii_all"))


def _names() -> Column:
    return F.array(*[F.lit(k) for k in ALL])


def _joined(c: str) -> Column:
    return F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.element_at(_names(), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _is_kind(n: int):
    return lambda s: s["kind"] == n


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added (spans beyond the base ones)."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    out = detect(src, ["doc_id"])
    counts = [F.size(F.filter("_pii_base", _is_kind(n))).cast("long").alias(f"n_{k}") for n, k in enumerate(KINDS)]
    return out.select("doc_id", *counts, F.sha2(_joined("_pii_base"), 256).alias("base_sha256"), _joined("_pii_all").alias("spans"), (F.size("_pii_all") - F.size("_pii_base")).cast("long").alias("n_added"))


def redact(docs: DataFrame) -> DataFrame:
    """The documents, with all their columns, every span of text replaced by its kind in angle brackets."""
    names = [f"`{c}`" for c in docs.columns]
    out = detect(docs, names)
    # a span that starts before the farthest end so far overlaps an earlier one and belongs to it
    ends = before(F.transform("_pii_all", lambda s: s["end"]), "int", F.lit(0), lambda p, x: F.greatest(p, x))

    def masked(pieces: Column) -> Column:
        def one(s: Column, end: Column) -> Column:
            return F.when(s["start"] >= end, F.concat(cut(pieces, end, s["start"]), F.lit("<"), F.upper(F.element_at(_names(), s["kind"] + 1)), F.lit(">"))).otherwise(F.lit(""))

        tail = cut(pieces, F.array_max(F.transform("_pii_all", lambda s: s["end"])), F.length("text"))
        return F.concat(F.array_join(F.zip_with(F.col("_pii_all"), ends, one), ""), tail)

    text = F.when(F.size("_pii_all") > 0, let(windows(F.col("text")), masked)).otherwise(F.col("text"))
    return out.withColumn("text", text).select(*names)
