"""Document classes, streams and the registered queries."""

import importlib.util
import sys
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from spanloom.plans.engine import Engine
from spanloom.plans.parser import parse_rpn
from spanloom.sources import doctypes as D
from spanloom.streaming import ingest

from .conftest import SF


def fields(r):
    raw = r.text.encode()
    return {(f, raw[s : e + 1].decode()) for f, _, s, e in r.fields}


def test_lines_and_paragraphs():
    assert [r.text for r in D.parse("a\n\nb c\n", "ONELINE")] == ["a", "b c"]
    assert ("HEADLINE", "Über") in fields(D.parse("Über\ntext", "FIRSTLINE")[0])
    f = fields(D.parse("Head\nline two.\n\nNext é one. Two!", "PARA")[0])
    assert {("PARA", "Head\nline two."), ("PARA", "Next é one. Two!"), ("LINE", "line two."), ("SENTENCE", "Two!"), ("HEADLINE", "Head")} <= f


def test_tag_values():
    (r,) = D.parse("Name: Edward\nCity: New\n  York\nDate: 12 Jan 1924\n\nBody text\nmore", "MEMO")
    assert fields(r) == {("NAME", "Edward"), ("CITY", "New\n  York"), ("DATE", "12 Jan 1924"), ("BODY", "Body text\nmore")}
    assert [fields(r) for r in D.parse("a: 1\nb: 2\n\na: 3\n", "COLONGRP")] == [{("A", "1"), ("B", "2")}, {("A", "3")}]
    (r,) = D.parse("@FILE { http://x/y\nTitle{5}:\thallo\nBody{7}:\tab\ncd\n.\n}\n", "SOIF")
    assert r.key == "http://x/y" and ("TITLE", "hallo") in fields(r)


def test_delimited():
    rs = D.parse('id;name\n1;"a;b"\n2;c;d;e\n', "CSV")
    assert [fields(r) for r in rs] == [{("ID", "1"), ("NAME", "a;b")}, {("ID", "2"), ("NAME", "c"), ("FIELD03", "d"), ("FIELD04", "e")}] and [r.key for r in rs] == ["1", "2"]
    assert D.separator("a\tb\n1\t2") == "\t" and D.separator("a|b|c\n1|2|3") == "|"


def test_markup():
    (r,) = D.parse("<FOO><A>This is it</A><D x='é'>Los Angeles</D></FOO>", "XML")
    assert {("A", "This is it"), ("D", "Los Angeles"), ("D@X", "é")} <= fields(r) and ("D", "FOO\\D") in {(f, p) for f, p, _, _ in r.fields}
    (r,) = D.parse("<html><title>T</title><body><p>one<p>two<br>three<script>if (a<b) x</script></body></html>", "HTML")
    assert {("TITLE", "T"), ("P", "one")} <= fields(r) and not any(f == "B" for f, _ in fields(r))
    assert ("META.AUTHOR", "me") in fields(D.parse('<head><meta name="author" content="me"></head><body>x', "HTMLMETA")[0])
    assert [r.key for r in D.parse("<rss><item><guid>1</guid></item><item><guid>2</guid></item></rss>", "RSS")] == ["1", "2"]


def test_mail_and_bibliography():
    rs = D.parse("From a@b Mon Jan  1 00:00:00 2024\nSubject: hi\nMessage-Id: <1@x>\n\nBody\n\nFrom c@d Mon Jan  1 00:00:00 2024\nSubject: two\n\nx\n", "MAILFOLDER")
    assert [r.key for r in rs] == ["1@x", None] and ("SUBJECT", "hi") in fields(rs[0]) and ("BODY", "Body") in fields(rs[0])
    (r,) = D.parse('@book{k1, title = {A {Nested} T}, year = 1999, note="n"}', "BIBTEX")
    assert r.key == "k1" and {("TITLE", "A {Nested} T"), ("YEAR", "1999"), ("NOTE", "n")} <= fields(r)
    (r,) = D.parse("TY  - JOUR\nTI  - Title\nID  - 7\nER  - \n", "RIS")
    assert r.key == "7" and ("TITLE", "Title") in fields(r)
    assert [r.key for r in D.parse("PMID- 1\nTI  - A\n      b\n\nPMID- 2\nTI  - C\n", "MEDLINE")] == ["1", "2"]
    assert ("AUTHOR", "B") in fields(D.parse("%A B\n%T C\n", "REFERBIB")[0])


@pytest.mark.parametrize(
    "text,path,want", [("<!DOCTYPE html><p>", "", "HTML"), ("<?xml version='1.0'?><a/>", "", "XML"), ("@article{x, a=1}", "", "BIBTEX"), ("TY  - JOUR", "", "RIS"), ("a,b,c\n1,2,3\n", "", "CSV"), ("Name: x\nCity: y\n\nText", "", "MEMO"), ("plain", "x.html", "HTML"), ("plain words", "", "PLAINTEXT"), ("<rss><item/></rss>", "", "RSS"), ("%A x\n", "", "REFERBIB")]
)
def test_autodetect(text, path, want):
    assert D.autodetect(text, path) == want


def test_files_to_database(spark, tmp_path):
    (tmp_path / "a.memo").write_text("Name: Edward\nAge: 42\nDate: 1924-01-12\nKey: e1\n\nHello Ürld\n")
    (tmp_path / "b.csv").write_text("name,age,city\nAnn,7,Rome\nBob,9,Oslo\n")
    recs = D.parse_files(D.read_files(spark, str(tmp_path)))
    db = D.to_database(recs, {"AGE": "numerical"})
    assert db.total == 3
    r = Engine(db).search(parse_rpn("name/edward")).collect()
    assert len(r) == 1 and r[0].doctype == "MEMO" and r[0].date == datetime(1924, 1, 12)
    assert Engine(db).run(parse_rpn("AGE<10")).count() == 2 and Engine(db).run(parse_rpn("oslo FILE:*.csv")).count() == 1
    bad = D.parse_files(spark.createDataFrame([("x", None), ("y", "")], "path string, content string"))
    assert bad.count() == 2


def test_pages_are_html(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select(F.col("url").alias("path"), F.col("html").alias("content"))
    recs = D.parse_files(pages, "HTML")
    assert recs.count() == pages.count() and recs.where(F.exists("fields", lambda f: f["field"] == "TITLE")).count() > 0


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([(1, "a b"), (2, "c")], "rec_id long, text string").write.parquet(str(src))
    rows = ingest.read_folder(spark, str(src), "rec_id long, text string")
    ingest.index_stream(rows, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    seen = []
    ingest.watch(rows, lambda b, n: seen.append(b.count()), str(tmp_path / "cp2")).awaitTermination()
    assert seen == [2]
    ev = spark.createDataFrame([(datetime(2024, 1, 1, 0, 1), "x", 1.0), (datetime(2024, 1, 1, 0, 7), "x", 2.0)], "ts timestamp, kind string, v double")
    got = ingest.windowed_counts(ev, "ts", ["kind"], "5 minutes", "10 minutes", "v").collect()
    assert {(r.start.minute, r.n, r.total) for r in got} == {(0, 1, 1.0), (5, 1, 2.0)}
    assert ingest.alive(ev, "ts", datetime(2024, 1, 1, 0, 5)).count() == 1


def _entry(name="__spark_entry__"):
    from .conftest import ROOT

    spec = importlib.util.spec_from_file_location(name, f"{ROOT}/__spark_entry__.py")
    m = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(m)
    return m


def test_entry_and_oracle(spark):
    import duckdb

    m = _entry()
    q, o = m.queries(), m.oracle_sql()
    assert set(o) <= set(q) and m.entry(spark).columns == ["rec_id", "score", "hit_count", "aux_count"]
    c = duckdb.connect()
    for t in ("documents", "conversations", "benchmark", "labels", "events", "supplier", "part"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name in ("op_or", "op_near_n", "op_peer", "op_within_dropping", "op_reduce", "num_range", "span_during", "rect", "norm_af", "facet_terms", "sort_score"):
        a = q[name](spark, SF)
        cols = sorted(a.columns)
        norm = lambda rows: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows)
        assert norm(tuple(r) for r in a.select(cols).collect()) == norm(c.execute(f"SELECT {', '.join(cols)} FROM ({o[name]})").fetchall()), name


def test_entry_without_the_llm_part(monkeypatch):
    for k in [k for k in sys.modules if k.startswith("spanloom.llm") or k == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, k)
    monkeypatch.setitem(sys.modules, "spanloom.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    m = _entry("entry_alone")
    assert "op_or" in m.queries() and not any(k.startswith("op1_") or k == "pipeline" for k in m.queries())
