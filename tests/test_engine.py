"""Hand-computed micro fixtures."""

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from spanloom.functions import dates, values
from spanloom.functions.metaphone import metaphone_keys
from spanloom.functions.text import glob_regex, postings
from spanloom.operators import present, scan
from spanloom.operators import score as S
from spanloom.operators import unary as U
from spanloom.plans.ast import QueryError
from spanloom.plans.engine import Engine, dotted, feedback, smart_search
from spanloom.plans.parser import parse_rpn
from spanloom.sources import maintenance as M
from spanloom.sources.database import Database, VirtualDatabase


def db(spark, texts, fields=(), **more):
    rows = spark.createDataFrame(list(texts.items()), "rec_id long, text string")
    f = spark.createDataFrame([(r, n, n, s, e) for r, n, s, e in fields], "rec_id long, field string, path string, s long, e long") if fields else None
    return Database.build(rows, f, **more)


def run(d, q, **o):
    return {r.rec_id: r for r in Engine(d, **o).run(parse_rpn(q)).collect()}


@pytest.fixture(scope="module")
def prox(spark):
    return db(spark, {1: "alpha beta gamma alpha", 2: "beta" + " " * 60 + "alpha", 3: "alpha-beta", 4: "nothing"})


def test_offsets_are_bytes(spark):
    p = {(r.term, r.pos, r.s, r.e) for r in postings(spark.createDataFrame([(1, "é ÀB, x")], "rec_id long, text string")).collect()}
    assert p == {("é", 0, 0, 1), ("àb", 1, 3, 5), ("x", 2, 8, 8)}
    many = postings(spark.createDataFrame([(1, "ab " * 300)], "rec_id long, text string"))
    assert [(r.s, r.pos) for r in many.orderBy("s").collect()] == [(3 * k, k) for k in range(300)]


def test_proximity(prox):
    # gaps: 1: beta..alpha 0-4,17-21 / beta 6-9: 1 and 7; 2: 60; 3: 1
    assert {k: v.hit_count for k, v in run(prox, "alpha beta NEAR:50").items()} == {1: 2, 3: 1}
    assert set(run(prox, "alpha beta NEAR:60")) == {1, 2, 3}
    assert {k: v.hit_count for k, v in run(prox, "alpha beta ADJ").items()} == {1: 1, 3: 1}
    assert set(run(prox, "alpha beta BEFORE:10")) == {1, 3} and set(run(prox, "beta alpha BEFORE:10")) == {1} and set(run(prox, "alpha beta AFTER:100")) == {1, 2}
    assert set(run(prox, "alpha beta DIST>50")) == {2} and set(run(prox, "alpha beta FAR")) == {2}
    # a hit overlaps itself: never near, always far
    assert run(prox, "gamma gamma NEAR:50") == {} and set(run(prox, "gamma gamma DIST>50")) == {1}


@pytest.fixture(scope="module")
def tree(spark):
    # one speech of two lines, then another
    return db(spark, {1: "love hate\nlove out\nspot", 2: "hate x\nlove", 3: "love only"}, [(1, "SPEECH", 0, 17), (1, "LINE", 0, 8), (1, "LINE", 10, 17), (1, "SPEECH", 19, 22), (1, "LINE", 19, 22), (2, "SPEECH", 0, 10), (2, "LINE", 0, 5), (2, "LINE", 7, 10), (3, "LINE", 0, 8)])


def test_structure(tree):
    assert {k: v.hit_count for k, v in run(tree, "love hate PEER").items()} == {1: 1} and {k: v.hit_count for k, v in run(tree, "love hate XPEER").items()} == {1: 1, 2: 1}
    assert set(run(tree, "love hate PEERb")) == {1} and run(tree, "love hate PEERa") == {}
    assert {k: v.hit_count for k, v in run(tree, "love hate AND:SPEECH").items()} == {1: 2, 2: 1} and set(run(tree, "hate love BEFORE:SPEECH")) == {1, 2}
    assert set(run(tree, "love SIBLING")) == set() and set(run(tree, "love hate OR SIBLING")) == {1}
    assert set(run(tree, "love NOT:SPEECH")) == set() and set(run(tree, "hate NOT:LINE")) == {3}


def test_within_rescoring(tree):
    whole = run(tree, "love hate OR")
    same = run(tree, "love hate OR WITHIN:LINE")
    assert all(same[k].score == pytest.approx(whole[k].score) for k in whole)  # nothing dropped
    part = run(tree, "love hate OR WITHIN:SPEECH")  # record 3 goes: tf stays, df is 2 of 3
    assert set(part) == {1, 2} and part[1].score == pytest.approx(3 / math.sqrt(9 + 4))
    assert set(run(tree, "love hate OR XWITHIN:SPEECH")) == {3} and set(run(tree, "love hate OR INCLUSIVE:SPEECH")) == {1, 2}
    assert set(run(tree, "love XWITHIN:NOWHERE")) == {1, 2, 3}


def test_scores(spark):
    d = db(spark, {1: "a", 2: "a a", 3: "a a a", 4: "b"})
    idf, tf = math.log(4 / 3), {1: 1, 2: 2, 3: 3}
    share = math.log((4 - idf + 0.5) / (idf + 0.5)) * math.log(2)
    want = {
        "l2": lambda t: t / math.sqrt(14), "l1": lambda t: t / 6, "max": lambda t: 0.4 + 0.6 * t / 3, "log": lambda t: 1 + math.log(t * idf), "bytes": lambda t: t * idf / (1 + math.log(2 * t - 1)), "none": lambda t: 0, "af": lambda t: t * idf / share / abs(sum(0.75 * math.log(x + 1) * share for x in tf.values())),
    }
    for m, f in want.items():
        got = run(d, "a", normalization=m)
        assert {k: pytest.approx(f(t)) for k, t in tf.items()} == {k: v.score for k, v in got.items()}, m
    assert run(d, "a:2")[3].score == pytest.approx(6 / math.sqrt(14)) and run(d, "a NOT")[4].score == pytest.approx(math.sqrt(1) / 4)
    assert {r.rec_id: r.scaled for r in S.scaled(Engine(d).run("a")).collect()} in ({1: 1, 2: k, 3: 100} for k in (50, 51))  # one half, give or take a last bit


def test_distance_metric(spark):
    d = db(spark, {1: "x y", 2: "x" + " q" * 30 + " y", 3: "x", 4: "z"})
    base, far = run(d, "x y OR"), run(d, "x y OR", normalization="cosine_metric")
    assert far[1].score == pytest.approx(20 * base[1].score) and far[2].score == pytest.approx(1.5 * base[2].score) and far[3].score == pytest.approx(base[3].score)


def test_boolean_operand_order(spark):
    d = db(spark, {1: "a", 2: "a b", 3: "b", 4: "c"})
    got = {q: set(run(d, f"a b {q}")) for q in ("OR", "AND", "ANDNOT", "NOTAND", "XOR", "NOR", "NAND", "XNOR")}
    assert got == {"OR": {1, 2, 3}, "AND": {2}, "ANDNOT": {1}, "NOTAND": {3}, "XOR": {1, 3}, "NOR": {4}, "NAND": {1, 3, 4}, "XNOR": {2, 4}}
    assert set(run(d, "a zzz ANDNOT")) == {1, 2} and run(d, "zzz a ANDNOT") == {} and set(run(d, "zzz NOT")) == {1, 2, 3, 4}


def test_reduce_table(spark):
    rows = [(i, float(10 - i), 1, a, []) for i, a in enumerate([3, 3, 2, 1, 1])]
    ir = spark.createDataFrame(rows, "rec_id long, score double, hit_count long, aux_count long, hits array<struct<s:bigint,e:bigint>>")
    keep = lambda n, x=ir: {r.rec_id for r in U.reduce(x, n).collect()}
    assert keep(0) == {0, 1} and keep(3) == {0, 1} and keep(2) == {0, 1, 2, 3, 4} and keep(4) == {0, 1, 2}
    assert keep(9, ir.where("rec_id > 3")) == {4}


def test_trims(spark):
    d = db(spark, {k: "a " * k for k in range(1, 11)})
    assert set(run(d, "a TRIM:3")) == {8, 9, 10} and set(run(d, "a TRIM:0.2")) == {9, 10} and run(d, "a TRIM:0") == {} and set(run(d, "a HITCOUNT:9")) == {9, 10} and set(run(d, "a HITCOUNT<3")) == {1, 2}


def test_match_modes(spark):
    d = db(spark, {1: "Automobile auto-mobile", 2: "auto.", 3: "Robert Rupert", 4: "the quick fox", 5: "quick the"})
    hits = lambda q, **o: set(run(d, q, **o))
    assert hits("auto") == {1, 2} and hits("auto.") == {2} and hits("auto*") == {1, 2} and hits("*mobile") == {1} and hits("*omob*") == {1} and hits("a?to") == {1, 2} and hits("{robert,fox}") == {3, 4}
    assert hits("Auto>") == {1} and hits("Robert=") == {3} and hits("robert=") == set() and hits("rupert~") == {3} and hits("kwik~", phonetic="metaphone") == {4, 5}
    assert hits('"quick fox"') == {4} and hits('"quick t"*') == {5} and run(d, "quick$")[4].hits == []


def test_typed(spark):
    num = spark.createDataFrame([(1, "P", 0, 0, 5.0), (2, "P", 0, 0, 7.5)], "rec_id long, field string, s long, e long, value double")
    day = datetime(2020, 5, 17, 12)
    dt = spark.createDataFrame([(1, "D", 0, 0, day, day), (2, "D", 0, 0, datetime(2021, 1, 1), datetime(2021, 1, 1)), (3, "R", 0, 0, datetime(2020, 1, 1), datetime(2020, 12, 31))], "rec_id long, field string, s long, e long, lo timestamp, hi timestamp")
    box = spark.createDataFrame([(1, "B", 0, 0, 10.0, 0.0, 0.0, 10.0), (2, "B", 0, 0, 10.0, 170.0, 0.0, -170.0), (3, "B", 0, 0, 80.0, 50.0, 70.0, 60.0)], "rec_id long, field string, s long, e long, n double, w double, so double, ea double")
    d = db(spark, {1: "a", 2: "b", 3: "c"}, typed={"numbers": num, "dates": dt, "boxes": box}, types={"P": "numerical", "D": "date", "R": "date-range", "B": "box", "T": "string"})
    ids = lambda q: set(run(d, q))
    assert ids("P>5") == {2} and ids("P>=5") == {1, 2} and ids("P<>5") == {2} and ids("P=5") == {1}
    assert ids("D=2020") == {1} and ids("D=2020-05") == {1} and ids("D=20200517") == {1} and ids("D>2020-05") == {2} and ids("D<2021") == {1}
    assert ids("R<2020-06/2021-06") == {3} and ids("R=2020-06/2021-06") == {3} and ids("R>{2020-06/2021-06") == set()
    assert ids("RECT{5,5,-5,15}") == {1} and ids("RECT{5,175,-5,-175}") == {2}
    assert run(d, "RECT{10,0,0,10}")[1].score > 0
    with pytest.raises(QueryError) as e:
        run(d, "T>x")
    assert e.value.code == 113


def test_deleted_expired_collapsed(spark):
    rows = spark.createDataFrame([(1, "a b", "k1", datetime(2020, 1, 1)), (2, "a", "k2", None)], "rec_id long, text string, key string, date_expires timestamp")
    d = Database.build(rows)
    gone = M.delete(d, spark.createDataFrame([("k2",)], "key string"))
    assert set(run(gone, "a")) == {1} and gone.total == 1 and set(run(M.delete(gone, spark.createDataFrame([("k2",)], "key string"), True), "a")) == {1, 2}
    late = M.expire(d, datetime(2021, 1, 1))
    assert set(run(late, "a")) == {2} and M.collapse(late).postings.count() == 1
    both = M.append(d, Database.build(rows.withColumn("rec_id", F.col("rec_id") + 10)))
    assert {r.key for r in both.records.collect()} == {"k1", "k2", "k1.11", "k2.12"} and set(run(both, "b")) == {1, 11}
    assert {r.problem: r.n for r in M.check(both).collect()} == {"posting without record": 0, "field without record": 0, "field beyond its text": 0, "repeated key": 0}


def test_save_load_virtual(spark, tree, tmp_path):
    tree.save(str(tmp_path / "db"))
    again = Database.load(spark, str(tmp_path / "db"))
    assert {k: v.score for k, v in run(again, "love hate PEER").items()} == {k: v.score for k, v in run(tree, "love hate PEER").items()}
    v = VirtualDatabase((again, tree))
    assert {(r.volume, r.rec_id) for r in v.search(parse_rpn("out")).collect()} == {(0, 1), (1, 1)} and [r.hits for r in v.statistics(parse_rpn("out")).collect()] == [1, 1]
    M.save_set(Engine(tree).run("love"), str(tmp_path / "set"), datetime(2024, 1, 1))
    assert M.load_set(spark, str(tmp_path / "set")).count() == 3 and M.load_set(spark, str(tmp_path / "set"), datetime(2024, 2, 1)) is None


def test_scan_and_facets(spark, tree):
    assert {r.term: r.freq for r in scan.scan(tree, "l").collect()} == {"love": 4, "only": 1, "out": 1, "spot": 1, "x": 1}
    assert {r.term for r in scan.scan_soundex(tree, "hat").collect()} == {"hate"} and {r.term for r in scan.scan_glob(tree, "?at*").collect()} == {"hate"}
    assert {r.term: r.freq for r in scan.facets(tree, Engine(tree).run("hate"), "LINE").collect()} == {"love": 1, "hate": 2, "x": 1}
    with pytest.raises(QueryError):
        scan.facets(tree, Engine(tree).run("love"), "LINE", 2)
    assert scan.totals(tree).first().asDict() == {"words": 10, "unique_words": 6, "records": 3, "deleted": 0}
    assert {r.term: r.freq for r in scan.merged(scan.scan(tree, "x"), scan.scan(tree, "x")).collect()} == {"x": 2}


def test_presentation(spark, tree):
    ir = Engine(tree).run("spot")
    assert present.peer_content(tree, ir).first().content == "spot" and [n.field for n in present.node_tree(tree, ir).first().nodes] == ["LINE", "SPEECH"]
    assert present.highlighted(tree, ir).first().text.endswith("<b>spot</b>") and present.contexts(tree, ir, 5).first().before == " out\n"
    love = Engine(tree).run("love")
    assert {(r.rec_id, r.content) for r in present.ancestor_content(tree, love, "LINE").collect()} == {(1, "love hate"), (1, "love out"), (2, "love"), (3, "love only")}
    assert {r.content for r in present.descendants_content(tree, Engine(tree).run("hate"), "SPEECH", "LINE").collect()} == {"love hate", "love out", "hate x", "love"}
    assert {r.rec_id: (r.s, r.e) for r in present.best_hit(Engine(tree).run("love hate OR")).collect()}[1] == (0, 3)
    for s in ("SUTRS", "HTML", "XML", "SGML", "RAW", "JSON", "USMARC"):
        assert "spot" in present.formatted(tree, ir, s).first().record
    assert present.present(tree, ir, "H").first().content == "love hate" and present.hit_table_xml(tree, ir).first().xml.count("<node") == 2


def test_smart_and_feedback(spark, tree):
    assert {r.rec_id for r in smart_search(tree, "love hate").collect()} == {1} and {r.rec_id for r in smart_search(tree, "hate love").collect()} == {1}
    assert {r.rec_id for r in smart_search(tree, "spot only").collect()} == {1, 3}
    assert {r.rec_id for r in Engine(tree).run(feedback(tree, "2")).collect()} == {1, 2, 3}


def test_sorts_and_magnetism(spark):
    rows = spark.createDataFrame([(1, "a", 1, datetime(2020, 1, 1)), (2, "a a", 2, datetime(2024, 5, 31)), (3, "a a a", 1, None), (4, "b", 1, None)], "rec_id long, text string, category int, date timestamp")
    d = Database.build(rows)
    order = lambda by: [r.rec_id for r in Engine(d, now=datetime(2024, 6, 1)).search("a", by, 9).orderBy("place").collect()]
    assert order("score") == [3, 2, 1] and order("reversehits") == [1, 2, 3] and order("date") == [2, 1, 3] and order("category") == [2, 3, 1] and order("newsrank")[0] == 2 and order("index") == [1, 2, 3]
    top = spark.createDataFrame([(1, 1.0, 1), (2, 0.9, 2), (3, 0.89, 1), (4, 0.1, 3)], "rec_id long, score double, category int")
    assert [r.rec_id for r in U.magnetism(top, 0.1).orderBy("place").collect()] == [1, 2, 3, 4]  # too few rows
    top = top.unionByName(spark.createDataFrame([(5, 0.05, 1), (6, 0.01, 0), (7, 0.0, 0)], "rec_id long, score double, category int"))
    assert [r.rec_id for r in U.magnetism(top, 0.1).orderBy("place").collect()] == [1, 3, 2, 4, 5, 6, 7]
    cats, scores = [1, 2, 2, 1, 0, 0, 0], [1.0, 0.99, 0.98, 0.97, 0.2, 0.1, 0.0]
    assert U.drawn_together(cats, scores, 0.1) == [0, 3, 2, 1, 4, 5, 6] and U.drawn_together(cats, scores, 0.1, compat=True) == [0, 3, 3, 2, 4, 5, 6]
    assert U.drawn_together([0, 2, 2, 1, 0, 0, 0], scores, 0.1) == list(range(7))
    assert set(run(d, "a", date_range="2024")) == {2} and set(run(d, "a WITHIN:2020")) == {1}


def test_functions(spark):
    assert dates.precision("2020") == "year" and dates.precision("202005") == "month" and dates.precision("17 May 2020") == "day" and dates.plus(datetime(2020, 1, 31), 1, "month") == datetime(2020, 2, 29)
    assert dates.parse_range("2020-01-01/+2 days")[1].day == 2 and dates.navigate(datetime(2024, 3, 31), "last month")[1].day == 29
    assert metaphone_keys("Knight")[0] == metaphone_keys("night")[0] and metaphone_keys("Smith") == ["SM0", "XMT"] and metaphone_keys("Schmidt")[0] == "XMT" and metaphone_keys("") == []
    assert glob_regex("a*[!b]?{c,d}") == "^(?s:a.*[^b].(?:c|d))$" and dotted("1.2.3.4") == 16909060
    r = spark.createDataFrame([("GB82 WEST 1234 5698 7654 32", "978-3-16-148410-0", "DEUTDEFF", "1.2.3.4", "10..20")], "a string, b string, c string, d string, e string")
    lo, hi = values.range_of(F.col("e"))
    x = r.select(values.iban_valid(F.col("a")), values.isbn_valid(F.col("b")), values.bic_valid(F.col("c")), values.dotted_value(F.col("d")), lo, hi).first()
    assert tuple(x) == (True, True, True, 16909060.0, 10.0, 20.0)
    ttl = spark.createDataFrame([("90",), ("2 hours",), ("30 sec",), ("1 month",), ("2030-01-01",)], "x string").select(dates.ttl_minutes(F.col("x")), dates.expires_at(F.col("x"), F.lit(datetime(2024, 1, 31)))).collect()
    assert ttl[0][1] == datetime(2024, 1, 31, 1, 30) and ttl[1][0] == 120 and ttl[2][0] == 0.5 and ttl[3][1] == datetime(2024, 2, 29) and ttl[4][1] == datetime(2030, 1, 1)


def test_stop_words_joined_words_and_phrase_limit(spark):
    texts = {1: "the data base is here", 2: "a database of the is", 3: "the is the is", 4: "is so the"}
    d = db(spark, texts, stop_words=frozenset({"the", "is"}))
    for q in ("the", "the is OR", '"the is"'):
        with pytest.raises(QueryError) as e:
            run(d, q)
        assert e.value.code == 4
    assert set(run(d, "the database OR")) == {2}
    d = db(spark, texts)
    assert set(run(d, '"data base"', join_words=True)) == {1} and set(run(db(spark, {2: texts[2]}), '"data base"', join_words=True)) == {2} and run(db(spark, {2: texts[2]}), '"data base"') == {}
    assert set(run(d, '"the is"')) == {2, 3} and set(run(d, '"is the"', phrase_limit=3)) == set(run(d, "is the PRECEDES")) and set(run(d, '"is the"', phrase_limit=100)) == {3}


def test_own_sorts_priority_and_fluent_sets(spark):
    from spanloom.plans.fluent import Session

    rows = spark.createDataFrame([(1, "a b", 0), (2, "a a c", 2), (3, "a a a", 1)], "rec_id long, text string, priority int")
    d = Database.build(rows)
    keys = spark.createDataFrame([(1, "m"), (3, "k")], "rec_id long, sort_key string")
    order = lambda by, **o: [r.rec_id for r in Engine(d, **o).search("a", by, 9).orderBy("place").collect()]
    assert order("function", sorts={"function": lambda: [F.col("rec_id") % 2]}) == [2, 3, 1] and order("ExtIndex64", sorts={"extindex64": keys}) == [3, 1, 2]
    with pytest.raises(ValueError):
        order("function")
    plain, more = ({r.rec_id: r.score for r in Engine(d, priority=p).search("a b OR").collect()} for p in (0.0, 0.5))
    share = 0.5 * (max(plain.values()) - min(plain.values())) / max(plain.values())
    assert more == pytest.approx({1: plain[1], 2: plain[2] + share / 2, 3: plain[3] + share})
    s = Session(d)
    a, b, c = s.term("a"), s.term("b"), s.term("c")
    ids = lambda x: {r.rec_id for r in x.frame().collect()}
    assert ids(a & b) == {1} and ids(a - b) == {2, 3} and ids(b | c) == {1, 2} and ids(~a) == set() and ids(a ^ b) == {2, 3} and ids(a.near(b, 5)) == {1} and ids(a.adj(b)) == {1} and ids(a.nand(b)) == {2, 3}
    assert (a.near(b, 5) | c).rpn == "a b NEAR:5 c OR" and [r.rec_id for r in a.boost(2).top(1).collect()] == [3]
    with pytest.raises(AttributeError):
        a.nothing(b)


def test_far_pairs_by_subtraction(spark):
    """Against all pairs, with hits of any width and overlaps."""
    import random

    r = random.Random(5)
    texts = {k: " ".join(r.choice(["aa", "bbbb", "c", "-----------------------------"]) for _ in range(r.randrange(2, 40))) for k in range(1, 9)}
    d = db(spark, texts)
    import re

    for q, far in (("aa bbbb NEAR:9", False), ("aa bbbb DIST>=9", True), ("aa aa DIST>=30", True), ("aa bbbb NEAR:20%", False)):
        x, y = q.split()[:2]
        got = {k: (v.hit_count, len(v.hits)) for k, v in run(d, q).items()}
        want = {}
        for k, t in texts.items():
            most = max(2, math.floor(0.5 + 0.2 * (len(t) - 1))) if "%" in q else int(re.findall("[0-9]+", q)[-1])
            spans = [[(m.start(), m.end() - 1) for m in re.finditer(rf"\b{w}\b", t)] for w in (x, y)]
            pairs = [(p, o) for p in spans[0] for o in spans[1] if (lambda g: (g < 0 or g >= most) if far else 0 <= g <= most)(o[0] - p[1] - 1 if p[0] < o[0] else p[0] - o[1] - 1)]
            if pairs:
                want[k] = (len(pairs), len({s for pair in pairs for s in pair}))
        assert got == want, q


def test_summary_and_contexts(spark):
    d = db(spark, {1: "One thing. The fox é and the fox! Nothing else. A fox."})
    ir = Engine(d).run("fox")
    assert present.summary(d, ir, 1).first().summary == "The fox é and the fox!" and present.summary(d, ir, 2).first().summary == "The fox é and the fox! A fox."
    got = [(r.n, r.before, r.hit, r.after) for r in present.contexts(d, ir, 6).orderBy("n").collect()]
    assert got == [(1, ". The ", "fox", " é and"), (2, "d the ", "fox", "! Noth"), (3, "se. A ", "fox", ".")]
    assert present.highlighted(d, ir).first().text.count("<b>fox</b>") == 3
