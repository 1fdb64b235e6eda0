"""What keeps queries in bounds on large tables, by small fixtures and by plans."""

import random

import pytest
from pyspark.sql import functions as F

from spanloom.functions.text import glob_regex, postings, word_counts
from spanloom.operators import present, scan
from spanloom.operators.proximity import _prox_in_record
from spanloom.plans.engine import Engine
from spanloom.plans.parser import parse_rpn
from spanloom.queries import QUERIES
from spanloom.sources import maintenance as M
from spanloom.sources import tables
from spanloom.sources.database import Database

from .conftest import SF


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def make(spark, texts):
    return Database.build(spark.createDataFrame(list(texts.items()), "rec_id long, text string"))


@pytest.mark.parametrize("name", ["op_within_dates", "search_date_range", "sort_function"])
def test_records_are_not_broadcast(spark, name):
    """Files of ids are small; in the driver's memory the ids of millions of records are not."""
    assert "Broadcast" not in plan(QUERIES[name](spark, SF))


def test_key_neighbours_number_their_ranges_once(spark):
    rows = spark.range(300).select((F.col("id") * 7 % 300).alias("rec_id"), F.lit("x").alias("text"))
    got = present.neighbour_keys(Database.build(rows))
    keys = sorted(str(k) for k in range(300))
    assert {r.key: (r.previous, r.next) for r in got.collect()} == {k: (keys[i - 1] if i else None, keys[i + 1] if i < 299 else None) for i, k in enumerate(keys)}
    assert "rangepartitioning" not in plan(got)


def test_metaphone_keys_are_made_of_distinct_terms(spark):
    d = make(spark, {1: "there their", 2: "quick there"})
    p = plan(Engine(d, phonetic="metaphone").run("there~")).split("\n")
    keys, distinct = ([k for k, x in enumerate(p) if n in x] for n in ("ArrowEvalPython", "HashAggregate(keys=[term"))
    assert len(keys) == 2 * 1 and all(any(i > k for i in distinct) for k in keys)  # of the set and of its norm
    p = plan(scan.scan_metaphone(d, "there"))
    assert 0 <= p.index("ArrowEvalPython") < p.index("HashAggregate")
    assert {r.term: r.freq for r in scan.scan_metaphone(d, "there").collect()} == {"there": 2, "their": 1}


def test_only_wanted_words_are_written(spark):
    tables._built.clear()
    QUERIES["op_near_n"](spark, SF)
    d = tables.database(spark, SF, "documents")
    assert {r.term for r in d.lookup("the").select("term").distinct().collect()} == {"the"} and set(d.tables._made) == {("exact", "the"), ("exact", "of")}
    assert {r.term for r in d.tables.of("exact", "of").select("term").distinct().collect()} == {"the", "of"}


def test_wanted_words_are_those_of_all(spark):
    r = random.Random(3)
    words = ["There", "éther", "ÉTHER", "ing", "siNG", "x1", "theirs", "K", "İng", "ΟΔΟΣ", "straße", "th"]
    texts = spark.createDataFrame([(k, " ".join(r.choice(words) for _ in range(50))) for k in range(9)], "rec_id long, text string")
    every = postings(texts)
    tests = {
        ("exact", "éther"): F.col("term") == "éther", ("exact", "k"): F.col("term") == "k", ("right", "th"): F.startswith("term", F.lit("th")), ("left", "ing"): F.endswith("term", F.lit("ing")), ("infix", "he"): F.contains("term", F.lit("he")),
        ("glob", "?th*"): F.rlike("term", F.lit(glob_regex("?th*"))), ("phonetic", "there"): F.soundex("term") == F.soundex(F.lit("there")),
    }
    some = postings(texts, wanted=list(tests))
    for (kind, w), cond in tests.items():
        rows = lambda p: sorted(map(tuple, p.where(cond).collect()))
        assert rows(every) == rows(some) == rows(postings(texts, wanted=[(kind, w)])) and rows(every), (kind, w)
    want = {r.term: r["count"] for r in every.groupBy("term").count().collect()}
    assert {r.term: r.n for r in word_counts(texts).groupBy("term").agg(F.sum("n").alias("n")).collect()} == want


def test_changed_tables_are_not_taken_for_whole(spark):
    d = tables.database(spark, SF, "benchmark")
    key = d.records.orderBy("rec_id").first()
    gone = M.delete(d, spark.createDataFrame([(key.key,)], "key string"))
    assert gone.total == d.total - 1 and key.rec_id not in {r.rec_id for r in Engine(gone).run(parse_rpn("*e*")).collect()}
    assert scan.totals(gone).first().deleted == 1 and not M.collapse(gone).postings.where(F.col("rec_id") == key.rec_id).count()


def test_pairs_of_a_record_are_counted_not_listed(spark):
    import numpy as np

    r = random.Random(8)
    for _ in range(300):
        a, b = (np.array(sorted({(s, s + r.randrange(6)) for s in (r.randrange(40) for _ in range(r.randrange(1, 9)))}), "int64") for _ in "ab")
        d, far, order = r.randrange(12), r.random() < 0.5, r.choice([None, "before", "after"])
        pairs = []
        for x in a.tolist():
            for y in b.tolist():
                gap = y[0] - x[1] - 1 if x[0] < y[0] else x[0] - y[1] - 1
                if ((gap < 0 or gap >= d) if far else 0 <= gap <= d) and (order is None or (x[0] >= y[0]) == (order == "before")):
                    pairs.append((tuple(x), tuple(y)))
        n, of_a, of_b = _prox_in_record(a, b, d, far, order)
        assert n == len(pairs) and set(map(tuple, a[of_a].tolist())) == {x for x, _ in pairs} and set(map(tuple, b[of_b].tolist())) == {y for _, y in pairs}
    d = make(spark, {1: "a b a", 2: "b"})
    for q in ("a b NEAR:9", "a b DIST>500"):
        assert "Generate" not in plan(Engine(d).run(parse_rpn(q)))


def test_contexts_against_slices(spark):
    text = "é the 😀the the" + "–" * 50 + " the"
    d = make(spark, {1: text, 2: "the", 3: "x"})
    ir = Engine(d).run("the")
    import re

    got = [tuple(r) for r in present.contexts(d, ir, 4).orderBy("rec_id", "n").collect()]
    want = []
    for k, t in ((1, text), (2, "the")):
        for n, m in enumerate(re.finditer(r"the", t), 1):
            s = len(t[: m.start()].encode())
            want.append((k, n, s, s + 2, t[max(0, m.start() - 4) : m.start()], "the", t[m.end() : m.end() + 4]))
    assert got == want and "MapInArrow" in plan(present.contexts(d, ir)).split("Join")[0]
