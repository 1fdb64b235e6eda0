"""The pipeline's stages, each on what the one before kept."""

import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from spanloom.llm import minhash
from tests.llm.test_operators import lines_with_one_key_in_common, norm, roots, want_groups

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage takes and gives."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.materialise(stage(spark, docs, SF), "test")
        out[name] = docs, after
        docs = after
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_columns_stay(stages):
    for name, (before, after) in stages.items():
        assert name == "packing" or after.columns == before.columns


def test_quality_drops_documents(stages):
    before, after = (texts(x) for x in stages["quality"])
    assert 0 < len(after) < len(before) and all(before[d] == t for d, t in after.items())


def test_line_dedup_keeps_one_line_of_each_group(stages):
    before, after = (texts(x) for x in stages["line_dedup"])
    want = want_groups(sorted((d, k, tuple(norm(x))) for d, t in before.items() for k, x in enumerate(t.split("\n"))))
    left = {d: "\n".join(x for k, x in enumerate(t.split("\n")) if want[d, k] == (d, k)) for d, t in before.items()}
    # documents of which nothing is left go
    left = {d: t for d, t in left.items() if t == before[d] or re.search(r"[^\W_]", t)}
    assert after == left and len(after) < len(before)


def shingled(t, k=5):
    w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def near_duplicates(rows):
    """doc_id -> smallest one reachable, by all pairs that share a shingle."""
    s = {d: shingled(t) for d, t in rows.items()}
    at, pairs = {}, set()
    for d, x in s.items():
        for g in x:
            at.setdefault(g, []).append(d)
    for v in at.values():
        pairs |= {(a, b) for i, a in enumerate(v) for b in v[:i]}
    return roots(sorted(s), [(a, b) for a, b in pairs if 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b])])


def test_near_duplicates_of_what_line_dedup_left(stages):
    before, after = (texts(x) for x in stages["minhash"])
    root = near_duplicates(before)
    assert after == {d: t for d, t in before.items() if root[d] == d}


def test_near_duplicates_of_whole_texts(spark, stages):
    """The same stage on the texts that the quality stage kept, where copies are still whole."""
    rows = stages["line_dedup"][0]
    root = near_duplicates(texts(rows))
    kept = texts(corpus_pipeline.dedup_documents(spark, rows, SF))
    assert set(kept) == {d for d, r in root.items() if d == r} and len(root) - len(kept) > 50


def test_no_copy_is_left(stages):
    """Of the near-duplicates of whole texts one at most is left whole after both stages."""
    before, after = texts(stages["line_dedup"][0]), texts(stages["minhash"][1])
    left = {}
    for d, r in near_duplicates(before).items():
        if after.get(d) == before[d]:
            left.setdefault(r, []).append(d)
    assert all(len(v) == 1 for v in left.values())


def test_redaction_and_packing(stages):
    before, after = stages["pii"]
    assert after.where(F.col("text").rlike(r"@mail\d|\+1 \(\d{3}\)|\d{16}")).isEmpty() and not before.where(F.col("text").rlike(r"@mail\d")).isEmpty()
    assert after.where(F.col("n_chars") != F.length("text")).isEmpty() and after.count() == before.count()
    packed = stages["packing"][1]
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(texts(after))
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").isEmpty()
    assert packed.where("length = 1 and piece = 0").isEmpty()  # no text is empty by now


HARD = [(1, None), (2, ""), (3, " \n "), (4, "a b c d e f g"), (4, "a b c d e f g"), (5, "a b c d e f g"), (6, "x" * 50_000), (None, "no id at all here"), (7, "one two three four five six seven"), (7, "other words stand under the same id here"), (8, "one two three four five six seven"), (9, "mail me@mail.example.com")]
EXTRA = "text_key long, tk long, kept boolean, h long, line int, id long, first long, _mask string, n_chars long"


@pytest.mark.parametrize("rows", [HARD, []])
def test_hard_rows(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for c in EXTRA.split(", "):
        n, t = c.split(" ")
        if n != "_mask":
            docs = docs.withColumn(n, F.lit(None).cast(t))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        got = [(r.doc_id, r.text) for r in out.collect()] if name != "packing" else out.count()
        if name != "packing":
            assert out.columns == docs.columns
        if name == "quality":
            assert set(got) <= set(rows)
        if name == "line_dedup" and rows:
            assert sorted(got, key=str) == sorted([r for r in rows if r not in [(5, "a b c d e f g"), (8, "one two three four five six seven")]], key=str)
        if name == "minhash" and rows:
            assert sorted(got, key=str) == sorted([r for r in dict.fromkeys(rows) if r[0] not in (5, 8)], key=str)
        if name == "pii" and rows:
            assert (9, "mail <EMAIL>") in got and len(got) == len(rows)
        if name == "packing" and rows:
            assert got >= len(rows)
        if name == "packing" and not rows:
            assert got == 0


def test_run_on_an_empty_table(spark, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_repeated_ids_with_other_texts_are_told_apart(spark):
    a, b = " ".join(f"w{k}" for k in range(60)), " ".join(f"v{k}" for k in range(60))
    rows = [(7, a), (7, b), (3, b + " end"), (8, a + " end"), (7, a + " also")]
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.link_documents(spark.createDataFrame(rows, "doc_id long, text string"), 5).collect())
    assert got == [(3, 57, 3, True), (7, 56, 3, False), (7, 56, 7, True), (7, 57, 7, True), (8, 57, 7, False)]
    kept = sorted((r.doc_id, r.text) for r in corpus_pipeline.dedup_documents(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect())
    assert len(kept) == 2 and kept[0] == (3, b + " end") and kept[1][0] == 7 and kept[1][1] in (a, a + " also")


def test_line_dedup_compares_hot_buckets_in_full(spark):
    docs = spark.createDataFrame(lines_with_one_key_in_common(400), "doc_id long, text string")
    assert sorted(texts(corpus_pipeline.dedup_lines(spark, docs, SF))) == list(range(0, 800, 2))
