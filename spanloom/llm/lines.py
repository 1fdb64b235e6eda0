"""Fuzzy line deduplication, by DataFrame functions only.

Lines are normalised (lower case, runs of anything but letters and digits become one space). Equal ones are
one node; two nodes are linked if their edit similarity in words (one less Levenshtein distance over the longer
length; words are compared by 20 hash bits) is `similarity` or more. Of every connected group the occurrence with the
smallest (doc_id, line) stays.

Pigeonhole blocks: a line's blocks are its pairs of neighbouring words. An edit touches two of them, so of any 2d + 1
blocks of a line one survives d edits; taken from the front of an order that all lines share (the longer pair first, then by
hash; long words are the rare ones), two lines within d edits have one in common. The KEYS first blocks are a line's join
keys: enough for every similar pair of lines under twenty words, and for longer ones a sample of as many blocks, of
which similar lines share about half at the least similarity (and repeated blocks, where a line has many). README has the measured recall. What meets is held against
necessary conditions (lengths, numbers of words that the other lacks), then verified. SimHash has no part in this: at a
similarity of 0.8 two lines' SimHashes differ in 13 of 64 bits on average, and blocks of bits that let such pairs meet
let all lines meet.

Buckets emit all their pairs only while these are few (see AT_ONCE and common.link_in_buckets), yet groups are those of all similar pairs that share a key,
however many lines share it.
Blank lines (without letter or digit) are always kept. Null texts have no lines, empty tables no rows; lines may be of
any length. Ties in (doc_id, line) are rows that repeat a doc_id: with the same text they are the same occurrence and
are treated alike, with other texts the smaller (doc_id, line) still leads. Columns other than doc_id and text pass
through `dedup` untouched, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SMALL, components, discard, link_in_buckets, materialise, sweep

SIMILARITY = 0.8
#: Blocks of a line that are its join keys, at most.
KEYS = 10
#: Pairs for each line in buckets up to which all are compared at once.
AT_ONCE = 4


def words_of(line: Column) -> Column:
    """Runs of letters and digits of a line in lower case. Without the usual ends there are seldom empty ones to be removed."""
    words = F.split(F.btrim(line, F.lit(" .,;:!?")), r"[^\p{L}\p{N}]+")
    ends = (F.get(words, F.lit(0)) == "") | (F.get(words, F.size(words) - 1) == "")
    return F.when(ends, F.array_remove(words, "")).otherwise(words)


def coded(codes: str) -> Column:
    """A string with one character for the 20 hash bits of each word: edits of words are edits of characters."""
    units = F.transform(codes, lambda c: F.lpad(F.hex(c.bitwiseAND(F.lit((1 << 20) - 1)) + F.lit(0x10000)), 8, "0"))
    return F.decode(F.unhex(F.array_join(units, "")), "UTF-32")


def row_key() -> Column:
    """Tells rows with the same doc_id and other texts apart."""
    return F.xxhash64(F.lit(3), "doc_id", "text")


def let(value: str, name: str, body: str) -> str:
    """SQL: body with name bound to a value that is computed once, however often body has the name and wherever a filter is pushed."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def distance(a: str, b: str, most: str) -> str:
    """SQL: the edit distance of two texts, -1 beyond most. Ends that both share are cut off first, by bisection: they add nothing."""

    def shared(end: str, t: str) -> str:
        mid = "cast((x.lo + x.hi + 1) div 2 as int)"
        room = f"least(length({t}.a), length({t}.b))"
        step = f"if(x.lo >= x.hi, x, if({end}({t}.a, {mid}) = {end}({t}.b, {mid}), named_struct('lo', {mid}, 'hi', x.hi), named_struct('lo', x.lo, 'hi', {mid} - 1)))"
        return f"aggregate(sequence(0, cast(ceil(log2({room} + 1)) as int)), named_struct('lo', 0, 'hi', {room}), (x, i) -> {step}).lo"

    inner = let(shared("right", "u"), "back", f"levenshtein(left(u.a, length(u.a) - back), left(u.b, length(u.b) - back), {most})")
    inner = let(shared("left", "t"), "front", let("named_struct('a', substring(t.a, front + 1), 'b', substring(t.b, front + 1))", "u", inner))
    return let(f"named_struct('a', {a}, 'b', {b})", "t", inner)


#: Words of a line from which the sets of words are compared before the distance is taken.
LONG = 64


def close(a: str, b: str, words_a: str, words_b: str, most: str) -> str:
    """SQL: whether the edit distance of two texts is most at most. Their distinct words, where given, refuse what lacks more of the other's: the
    distance's work grows with the square of the lengths, theirs with the lengths.
    """
    lacks = lambda x, y: f"coalesce(size(array_except({x}, {y})), 0) <= {most}"
    return f"abs(length({a}) - length({b})) <= {most} and {lacks(words_a, words_b)} and {lacks(words_b, words_a)} and {distance(a, b, most)} >= 0"


def lost(n: str, similarity: float) -> str:
    """SQL: words of n that a similar line may lack."""
    return f"cast(floor({1 - similarity!r}D * {n} + 1e-9D) as int)"


#: Words of a line up to which its counters can't overflow.
COUNTED = 30_000


def marks_of(texts: DataFrame) -> DataFrame:
    """id, mark of lines h with codes w and counted (see below): n words, quarters b0 to b3 of the 256 bits that their codes set, and c, four 16-bit counters
    of words by the last bits of their codes; c is null unless most words of the line are repeated ones. By aggregation, not by
    functions of arrays: those are interpreted word by word.
    """
    quarter = lambda k: F.bit_or(F.expr(f"if((x >> 6 & 3) = {k}, shiftleft(1L, x & 63), 0L)")).alias(f"b{k}")
    counts = F.sum(F.expr("if(counted, shiftleft(1L, 16 * (x & 3)), 0L)"))
    out = texts.select("h", "counted", F.explode("w").alias("x")).groupBy("h").agg(F.max("counted").alias("counted"), F.count("*").cast("int").alias("n"), *map(quarter, range(4)), counts.alias("c"))
    return out.select(F.col("h").alias("id"), F.struct("n", "b0", "b1", "b2", "b3", F.when(F.col("counted"), F.col("c")).alias("c")).alias("mark"))


def may_be_like(x: str, y: str, similarity: float) -> str:
    """Necessary for similarity of two lines with n, b0 to b3, c: lengths are near, neither sets more bits that the other lacks than it
    may lose words, and where both have counters, neither counts more beyond the other's. Kept short, for it is compiled into joins.
    """
    most = lost(f"greatest({x}.n, {y}.n)", similarity)
    gone = lambda a, b: " + ".join(f"bit_count({a}.b{k} & ~{b}.b{k})" for k in range(4)) + f" <= {most}"
    at = lambda a, k: f"(shiftrightunsigned({a}.c, {16 * k}) & 65535)"
    # what y counts beyond x is what x counts beyond y and the difference in words
    beyond = " + ".join(f"greatest({at(x, k)} - {at(y, k)}, 0)" for k in range(4)) + f" + greatest({y}.n - {x}.n, 0) <= {most}"
    return f"abs({x}.n - {y}.n) <= {most} and {gone(x, y)} and {gone(y, x)} and ({x}.c is null or {y}.c is null or {beyond})"


def line_keys(docs: DataFrame, similarity: float) -> DataFrame:
    """doc_id, rk, line, h, h2, n (words), keys, w (codes of the words, if it has keys) of every line; blank lines have no h."""
    t = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    t = t.select("doc_id", row_key().alias("rk"), F.posexplode(F.split(F.lower("text"), "\n")).alias("line", "raw")).select("doc_id", "rk", "line", words_of(F.col("raw")).alias("words"))
    hashed = lambda seed: F.when(F.size("words") > 0, F.xxhash64(F.lit(seed), "words"))
    t = t.select("doc_id", "rk", "line", "words", hashed(0).alias("h"), hashed(1).alias("h2"), F.size("words").alias("n"))
    # a word's code is six bits of length and 20 of its hash; a block is the codes' sum (the longer the smaller) and the second code,
    # which is short, for it is interpreted, and never null, so that arrays of it are sorted as plain longs
    codes = F.transform("words", lambda w: F.shiftleft(F.least(F.octet_length(w), F.lit(63)), 20).bitwiseOR(F.pmod(F.xxhash64(F.lit(9), w), F.lit(1 << 20)).cast("int")))
    blocks = "zip_with(slice(w, 1, n - 1), slice(w, 2, n - 1), (a, b) -> coalesce(-(shiftleft(cast(a + b as bigint), 26) | b), 0L))"
    # only a line from which a similar one may differ has keys
    t = t.withColumn("d", F.expr(lost(f"floor(n / {similarity!r}D + 1e-9D)", similarity)))
    t = t.select("doc_id", "rk", "line", "h", "h2", "n", "d", F.when(F.expr("n > 1 and d > 0"), codes).alias("w"))
    t = t.withColumn("all", F.expr(f"if(w is not null, sort_array({blocks}), cast(array() as array<bigint>))"))
    t = t.withColumns({"each": F.array_distinct("all"), "most": F.expr(f"least({KEYS}, 2 * d + 1)")})
    # in a line that goes round in circles a few new words would push all common blocks back: its repeated blocks are keys, too
    again = f"slice(array_distinct(filter(all, (x, i) -> get(all, i - 1) = x)), 1, {KEYS})"
    keys = f"if(4 * size(each) < 3 * size(all), array_union(slice(each, 1, most), {again}), slice(each, 1, most))"
    return t.select("doc_id", "rk", "line", "h", "h2", "n", F.expr(keys).alias("keys"), "w")


def groups(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, rk, line, group_doc_id, group_line, kept of every line; blank lines are kept and their own group."""
    keyed = materialise(line_keys(docs, similarity), "lines-keyed", hashes=True)
    nodes = keyed.where("h is not null").groupBy("h", "h2").agg(F.min(F.struct("doc_id", "line", "n")).alias("first"), F.count("*").alias("times")).select("h", "h2", "first.*", "times")
    nodes = materialise(nodes, "lines-nodes")
    texts: list[DataFrame] = []
    rows: list[DataFrame] = []
    # of repeated lines only the first occurrence meets others
    again = nodes.where("times > 1").select("h", "h2", F.struct("doc_id", "line").alias("at"))
    lone = keyed.where("size(keys) > 0").join(F.broadcast(again) if again.count() <= SMALL else again, ["h", "h2"], "left")
    lone = lone.where(F.col("at").isNull() | (F.col("doc_id").eqNullSafe(F.col("at.doc_id")) & (F.col("line") == F.col("at.line"))))

    def few(ids: DataFrame) -> DataFrame:
        """Written ids, one long each, broadcast unless they are too many."""
        return F.broadcast(ids) if ids.count() <= 2 * SMALL else ids

    def describe(ids: DataFrame) -> DataFrame:
        """Number and bitmap of the words of lines that meet any other."""
        ids = materialise(ids.withColumnRenamed("id", "h"), "lines-ids")
        # counted is written, for an explosion would work it out for every word again
        counted = F.expr(f"2 * size(array_distinct(w)) < size(w) and size(w) <= {COUNTED}").alias("counted")
        out = materialise(lone.join(few(ids), "h", "left_semi").select("h", "w", counted), "lines-texts", hashes=True)
        if not out.groupBy("h").count().where("count > 1").isEmpty():  # rows that repeat a document have the same lines
            out = materialise(out.dropDuplicates(["h"]), "lines-texts")
        texts.append(out)
        # what is left to do needs no codes of lines that meet none
        rows.append(materialise(keyed.select("doc_id", "rk", "line", "h", "h2"), "lines-rows"))
        discard(ids, keyed)
        sweep(docs.sparkSession)
        return marks_of(out)

    def verify(pairs: DataFrame) -> DataFrame:
        sweep(docs.sparkSession)
        ids = materialise(pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct(), "lines-ids")
        # each text becomes a string once, not with every pair
        sets = F.expr(f"if(size(w) > {LONG}, array_distinct(w), null)").alias("s")
        met = texts[0].join(few(ids), "h", "left_semi").select("h", F.size("w").alias("n"), coded("w").alias("t"), sets)
        met = materialise(met, "lines-met")
        words = lambda c: met.select(F.col("h").alias(c), *[F.col(x).alias(f"{x}{c}") for x in ("n", "t", "s")])
        both = pairs.join(words("a"), "a").join(words("b"), "b").withColumn("most", F.expr(lost("greatest(na, nb)", similarity)))
        return both.where(close("ta", "tb", "sa", "sb", "most")).select("a", "b")

    members = lone.select(F.col("h").alias("id"), F.explode("keys").alias("key"))
    # lengths of similar lines differ by a factor of 1 / similarity at most; a little more, so that rounding parts none
    band = f"floor(ln(mark.n) / {-math.log(similarity - 0.01)!r}D)"
    links = link_in_buckets(members, describe, verify, "lines", may_be_like("x.mark", "y.mark", similarity), whole=True, band=band, at_once=AT_ONCE)
    comp = materialise(components(links, "lines-cc"), "lines-comp")
    discard(*texts)
    placed = nodes.join(comp.withColumnRenamed("node", "h"), "h", "left")
    best = placed.where("root is not null").groupBy("root").agg(F.min(F.struct("doc_id", "line")).alias("best"))
    # lines that stand once and are like no other are their own groups
    keep = placed.where("times > 1 or root is not null").join(best, "root", "left").select("h", "h2", F.coalesce("best", F.struct("doc_id", "line")).alias("best"))
    out = rows[0].join(keep, ["h", "h2"], "left").select("doc_id", "rk", "line", F.coalesce("best", F.struct("doc_id", "line")).alias("best"))
    kept = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("line") == F.col("best.line"))
    return out.select("doc_id", "rk", "line", F.col("best.doc_id").alias("group_doc_id"), F.col("best.line").alias("group_line"), kept.alias("kept"))


def dedup(docs: DataFrame, similarity: float = SIMILARITY, drop_emptied: bool = False) -> DataFrame:
    """The documents, with all their columns, their dropped lines taken out of text.

    Every document stays, unless drop_emptied: then one that lost lines goes if what is left has no letter or digit.
    """
    marks = groups(docs, similarity)
    # a document's dropped lines as bits, 64 to a long; all longs of a document are there, in order
    words = marks.groupBy("doc_id", "rk", F.floor(F.col("line") / 64).alias("word")).agg(F.bit_or(F.expr("case when kept then 0L else shiftleft(1L, cast(line % 64 as int)) end")).alias("gone"))
    masks = words.groupBy("doc_id", "rk").agg(F.array_sort(F.collect_list(F.struct("word", "gone"))).alias("m"), F.bit_or("gone").alias("any")).where("any <> 0")
    masks = masks.select(F.col("doc_id").alias("_mask_doc"), F.col("rk").alias("_mask_rk"), F.col("m.gone").alias("_mask"))
    keyed = docs.withColumn("_mask_key", F.xxhash64(F.lit(3), F.col("doc_id").cast("long"), F.col("text").cast("string")))
    out = keyed.join(masks, (keyed["_mask_key"] == masks["_mask_rk"]) & keyed["doc_id"].cast("long").eqNullSafe(masks["_mask_doc"]), "left")
    left = F.expr("array_join(filter(split(text, '\n'), (x, i) -> (shiftrightunsigned(_mask[cast(floor(i / 64) as int)], i % 64) & 1) = 0), '\n')")
    out = out.withColumn("text", F.when(F.col("_mask").isNull(), F.col("text")).otherwise(left))
    if drop_emptied:
        out = out.where(F.col("_mask").isNull() | F.rlike("text", F.lit(r"[\p{L}\p{N}]")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
