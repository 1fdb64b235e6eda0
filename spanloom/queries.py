"""Registered queries over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import present, scan
from .operators import score as S
from .operators import unary as U
from .plans.ast import Node, Term, Unary
from .plans.engine import Engine, smart_search
from .plans.parser import combined, expand, free_form, literal_phrase, parse, parse_infix, parse_rpn, phonetic_words, phrase_to_prox, words
from .plans.sql import WORDS as _WORD_RUNS
from .plans.sql import SqlQuery, base_views, to_sql
from .plans.sql import q as _q
from .sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: name: (database, RPN text or tree[, normalisation])
RPN: dict[str, tuple] = {
    "term_exact": ("documents", "the"), "term_right": ("documents", "ther*"), "term_left": ("documents", "*ing"), "term_infix": ("documents", "*tion*"), "term_glob": ("documents", "th?r*n"), "term_glob_set": ("documents", "{ther,and}[a-e]*"),
    "term_case": ("documents", "The="), "term_case_right": ("documents", "Th>"), "term_weight": ("documents", "the:3 of:-2 OR"), "term_field": ("conversations", "role/user"), "term_free": ("documents", "the$ of$ AND"),
    "phrase": ("documents", '"of the"'), "phrase_truncated": ("documents", '"of th"*'), "phrase_field": ("documents", 'LINE/"in the"'),
    "op_or": ("documents", "the of OR"), "op_and": ("documents", "the of AND"), "op_andnot": ("documents", "the of ANDNOT"), "op_notand": ("documents", "the of NOTAND"), "op_xor": ("documents", "the de XOR"), "op_xnor": ("documents", "the de XNOR"),
    "op_nor": ("documents", "the de NOR"), "op_nand": ("documents", "the of NAND"), "op_not": ("documents", "the NOT"), "op_not_field": ("conversations", "the NOT:ROLE"), "op_noop": ("documents", "the of <noop> OR"),
    "op_near_n": ("documents", "the of NEAR:20"), "op_near_percent": ("documents", "the of NEAR:5%"), "op_before_n": ("documents", "the of BEFORE:10"), "op_after_n": ("documents", "the of AFTER:10"), "op_near_bare": ("documents", "the of NEAR"),
    "op_before_bare": ("conversations", "the of BEFORE"), "op_after_bare": ("conversations", "the of AFTER"), "op_near_nofields": ("benchmark", "the of NEAR"), "op_far_nofields": ("benchmark", "the of FAR"), "op_far": ("documents", "the of FAR"),
    "op_adj": ("documents", "the of ADJ"), "op_follows": ("documents", "the of FOLLOWS"), "op_precedes": ("documents", "the of PRECEDES"), "op_neighbor": ("documents", "the of NEIGHBOR"), "op_dist_le": ("documents", "the of DIST<=15"), "op_dist_gt": ("documents", "the of DIST>500"),
    "op_near_lt": ("documents", "the of NEAR<12"), "op_near_gt": ("documents", "the of NEAR>12"),
    "op_peer": ("conversations", "the of PEER"), "op_peera": ("conversations", "the of PEERa"), "op_peerb": ("conversations", "the of PEERb"), "op_xpeer": ("conversations", "the of XPEER"), "op_and_field": ("conversations", "user the AND:TURN"),
    "op_before_field": ("conversations", "user the BEFORE:TURN"), "op_after_field": ("conversations", "user the AFTER:TURN"), "op_or_field": ("conversations", "user the OR:ROLE"), "op_within": ("conversations", "the of OR WITHIN:TEXT"),
    "op_within_dropping": ("conversations", "user the OR WITHIN:ROLE"), "op_within_path": ("conversations", "the user OR WITHIN:TURN\\TEXT"), "op_within_glob": ("conversations", "the user OR WITHIN:T*T"), "op_within_dates": ("events", "value>=0 WITHIN:2024-01"),
    "op_xwithin": ("conversations", "user the OR XWITHIN:ROLE"), "op_inclusive": ("conversations", "user the OR INCLUSIVE:TEXT"), "op_inside": ("conversations", "the user OR INSIDE:ROLE"), "op_sibling": ("conversations", "the of OR SIBLING"),
    "op_reduce": ("documents", "the of OR with OR REDUCE"), "op_reduce_n": ("documents", "the of OR with OR REDUCE:2"), "op_hitcount": ("documents", "the HITCOUNT:5"), "op_hitcount_lt": ("documents", "the HITCOUNT<5"), "op_trim": ("documents", "the of OR TRIM:25"),
    "op_trim_share": ("documents", "the of OR TRIM:0.1"), "op_boost": ("documents", "the BOOST:2.5 of OR"), "op_withkey": ("documents", "the WITHKEY:1*"), "op_file": ("documents", "the FILE:src1/*"), "op_extension": ("documents", "the EXTENSION:txt"), "op_doctype": ("documents", "the DOCTYPE:src3"),
    "op_sortby": ("documents", "the SORTBY:Hits"),
    "num_eq": ("parts", "SIZE=7"), "num_ne": ("parts", "SIZE<>7"), "num_lt": ("parts", "PRICE<1000"), "num_range": ("parts", "PRICE>=1000 PRICE<=1200 AND"), "currency": ("suppliers", "BALANCE>5000"), "hash": ("events", "KIND=click"),
    "date_month": ("events", "TS=2024-01"), "date_before": ("events", "TS<2024-01-10"), "date_after": ("events", "TS>20240110"), "span_before": ("events", "SPAN<2024-01-10/2024-01-12"), "span_during": ("events", "SPAN=2024-01-10/2024-01-12"),
    "span_after": ("events", "SPAN>2024-01-10/2024-01-12"), "span_le": ("events", "SPAN<=2024-01-10/2024-01-12"), "span_before_during": ("events", "SPAN<[2024-01-10/2024-01-12"), "span_after_strict": ("events", "SPAN>{2024-01-10/2024-01-12"),
    "interval": ("events", "BAND=40..60"), "rect": ("suppliers", "RECT{40,-60,-20,60}"), "rect_dateline": ("suppliers", "RECT{60,150,-60,-150}"),
    "text_field_mixed": ("parts", 'NAME/"part 1"* TYPE/*A* OR'),
    **{f"norm_{m}": ("documents", "the of OR", m) for m in ("none", "l1", "max", "log", "bytes", "af")},
}
INFIX = {
    "infix_nested": ("documents", "the and (of or with) not de"), "infix_within": ("conversations", "role/(user or assistant)"), "infix_xwithin": ("conversations", "role!/(user or the)"), "infix_boost": ("documents", "(the or of):2 or with"), "infix_prox": ("documents", "(the near:10 of) or (with before:20 the)"),
}
BUILT: dict[str, tuple[str, Callable[[], Node]]] = {
    "words": ("documents", lambda: words("the of the with")), "free_form": ("documents", lambda: free_form("ther of")), "literal_phrase": ("documents", lambda: literal_phrase("of  the")), "phrase_to_prox": ("documents", lambda: phrase_to_prox("of the")),
    "words_peer": ("conversations", lambda: combined("PEER", "the of")), "words_and_field": ("conversations", lambda: combined("ANDFIELD", "the of", "TEXT")), "thesaurus": ("documents", lambda: expand(parse("the"), {"the": [("of", 0.5), ("with", 0.25)]})),
}


def result(ir: DataFrame) -> DataFrame:
    return ir.select("rec_id", F.round("score", 6).alias("score"), F.col("hit_count").cast("bigint").alias("hit_count"), F.col("aux_count").cast("bigint").alias("aux_count"))


def _tree(kind: str, node: Node, method: str = "l2") -> Query:
    return lambda spark, sf_dir: result(Engine(tables.database(spark, sf_dir, kind), method).run(node))


def _add_trees() -> None:
    for name, (kind, text, *method) in RPN.items():
        node = parse_rpn(text)
        QUERIES[name], ORACLES[name] = _tree(kind, node, *method), to_sql(node, kind, *method)
    for name, (kind, text) in INFIX.items():
        node = parse_infix(text)
        QUERIES[name], ORACLES[name] = _tree(kind, node), to_sql(node, kind)
    for name, (kind, make) in BUILT.items():
        QUERIES[name], ORACLES[name] = _tree(kind, make()), to_sql(make(), kind)


def _views(kind: str, select: str) -> str:
    return "WITH " + ",\n".join(f"{k} AS ({s})" for k, s in base_views(kind)) + "\n" + select


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def wrap(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return wrap


def _db(spark: SparkSession, sf_dir: str, kind: str = "documents"):
    return tables.database(spark, sf_dir, kind)


_TOP = parse_rpn("the of OR")


def _top_sql(order: str, extra: str = "", join: str = "") -> str:
    s = SqlQuery("documents")
    k = s.set(_TOP)
    return s.text(f"SELECT * FROM (SELECT t.rec_id, round(score, 6) AS score, row_number() OVER (ORDER BY {order})::INT AS place{extra} FROM t{k} t {join}) WHERE place <= 20")


def _top(by: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Engine(_db(spark, sf_dir)).search(_TOP, by, 20).select("rec_id", F.round("score", 6).alias("score"), "place")

    return run


def _add_sorts() -> None:
    best = "round(score, 9) DESC, t.rec_id DESC"
    labels = "LEFT JOIN (SELECT doc_id, max(quality) AS category FROM labels GROUP BY doc_id) l ON l.doc_id = t.rec_id"
    orders = {
        "score": best, "hits": f"hit_count DESC, {best}", "reversehits": f"hit_count, {best}", "auxcount": f"aux_count DESC, {best}", "index": "t.rec_id", "key": "t.rec_id::VARCHAR, t.rec_id",
        "category": f"coalesce(category, 0) DESC, {best}", "adjscore": "round(score, 9) DESC, coalesce(category, 0) DESC, t.rec_id DESC",
    }
    for by, order in orders.items():
        QUERIES[f"sort_{by}"] = _top(by)
        ORACLES[f"sort_{by}"] = _top_sql(order, "", labels if "category" in order else "")


@query(_views("events", "SELECT rec_id, place::INT AS place FROM (SELECT rec_id, row_number() OVER (ORDER BY date DESC NULLS LAST, rec_id DESC) AS place FROM r) WHERE place <= 20"))
def sort_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(_db(spark, sf_dir, "events"), "none").search("VALUE>=-1e9", "date", 20).select("rec_id", "place")


def _newsrank_sql() -> str:
    s = SqlQuery("events")
    k = s.set(parse_rpn("VALUE>=50"))
    hours = f"CASE WHEN h < 0 AND h > -18 THEN 2 ELSE h END"
    days = "CASE WHEN hh < 0 THEN -floor(-hh / 24.0) ELSE floor(hh / 24.0) END"
    gains = " + ".join(f"CASE WHEN d <= {a} THEN {g} ELSE 0 END" for a, g in ((1, 5.0), (2, 4.0), (3, 1.75), (7, 0.75), (14, 0.55), (24, 0.43), (60, 0.32), (100, 0.21), (300, 0.10)))
    factor = "CASE " + " ".join(f"WHEN hh <= {a} THEN {g}" for a, g in ((2, 12.0), (3, 9.0), (4, 6.2), (8, 4.6), (12, 3.2), (16, 2.6), (23, 2.2))) + " ELSE 1.0 END"
    aged = f"SELECT t.rec_id, score, date, floor((epoch(TIMESTAMP {_q(tables.fixed_now().isoformat(sep=' '))})::BIGINT - floor(epoch(date))) / 3600) AS h FROM t{k} t JOIN r ON r.rec_id = t.rec_id"
    weighed = f"SELECT *, ((CASE WHEN d = -1 THEN -7.0 WHEN d < 0 THEN d * 6.0 WHEN d = 0 THEN 10.0 ELSE 1.0 END) + {gains}) * {factor} AS w FROM (SELECT *, {days} AS d FROM (SELECT *, {hours} AS hh FROM ({aged})))"
    return s.text(f"SELECT rec_id, place::INT AS place FROM (SELECT rec_id, row_number() OVER (ORDER BY w::DOUBLE * round(score, 9) DESC NULLS LAST, date DESC NULLS LAST, rec_id DESC) AS place FROM ({weighed})) WHERE place <= 20")


@query(_newsrank_sql())
def sort_newsrank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(_db(spark, sf_dir, "events"), now=tables.fixed_now()).search("VALUE>=50", "newsrank", 20).select("rec_id", "place")


def _magnetism_sql(factor: float) -> str:
    """The list as a state that a recursion walks: row i draws rows j + 1 of its category up."""
    s = SqlQuery("documents")
    k = s.set(_TOP)
    top = f"SELECT t.rec_id, score, round(score, 9) AS r, coalesce(category, 0)::INT AS category, row_number() OVER (ORDER BY round(score, 9) DESC, coalesce(category, 0) DESC, t.rec_id DESC) AS p FROM t{k} t LEFT JOIN (SELECT doc_id, max(quality) AS category FROM labels GROUP BY doc_id) l ON l.doc_id = t.rec_id QUALIFY p <= 50"
    first = f"SELECT 1::BIGINT AS i, 2::BIGINT AS j, list({{'rec_id': rec_id, 'score': score, 'r': r, 'category': category}} ORDER BY p) AS t, {factor!r}::DOUBLE * (max(r) - min(r)) / max(r) AS gap FROM top50"
    over = "j > len(t) - 2 OR t[i].category = 0 OR t[j].r > t[j + 1].r + gap"
    swap = "t[j].category <> t[i].category AND t[j + 1].category = t[i].category"
    moved = "list_concat(list_concat(t[1:i], [t[j + 1], t[j]]), list_concat(t[i + 1:j - 1], t[j + 2:len(t)]))"
    step = f"SELECT CASE WHEN {over} THEN i + 1 ELSE i END, CASE WHEN {over} THEN i + 2 ELSE j + 1 END, CASE WHEN NOT ({over}) AND {swap} THEN {moved} ELSE t END, gap FROM walk WHERE i <= len(t) - 3"
    s.ctes += [("top50", top), ("walk(i, j, t, gap)", f"{first} UNION ALL {step}"), ("ended", "SELECT t FROM walk ORDER BY i DESC, j DESC LIMIT 1")]
    text = s.text("SELECT x.rec_id, round(x.score, 6) AS score, x.category, place::INT AS place FROM (SELECT unnest(t) AS x, generate_subscripts(t, 1) AS place FROM ended)")
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


@query(_magnetism_sql(0.05))
def sort_magnetism(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = U.magnetism(Engine(_db(spark, sf_dir)).search(_TOP, "adjscore", 50), 0.05)
    return got.withColumn("score", F.round("score", 6))


def _distance_sql() -> str:
    s = SqlQuery("documents")
    k = s.set(_TOP)
    near = f"SELECT rec_id, min(gap) AS gap, max(n) AS n FROM (SELECT rec_id, lead(s) OVER (PARTITION BY rec_id ORDER BY s, e) - e AS gap, count(*) OVER (PARTITION BY rec_id) AS n FROM h{k}) GROUP BY rec_id"
    factor = "CASE WHEN gap <= 4 THEN 20.0 WHEN gap <= 10 THEN 8.0 WHEN gap <= 100 THEN 1.5 WHEN gap <= 1000 THEN 1.0 ELSE 0.98 END::DOUBLE"
    return s.text(f"SELECT t.rec_id, round(CASE WHEN aux_count > 1 AND n > 1 THEN score * {factor} ELSE score END, 6) AS score, hit_count, aux_count FROM t{k} t JOIN ({near}) g ON g.rec_id = t.rec_id")


@query(_distance_sql())
def distance_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return result(Engine(_db(spark, sf_dir), "cosine_metric").run(_TOP))


@query()
def term_soundex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return result(Engine(_db(spark, sf_dir)).run(phonetic_words("there")))


@query()
def term_metaphone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return result(Engine(_db(spark, sf_dir), phonetic="metaphone").run("there~"))


@query(to_sql(parse_rpn("the."), "documents"))
def term_exactterm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return result(Engine(_db(spark, sf_dir)).run(parse_rpn("the.")))


@query(to_sql(parse_rpn('"of the"'), "documents"))
def smart_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return result(smart_search(_db(spark, sf_dir), "of the"))


@query(to_sql(Unary("REDUCE", combined("OR", "the qqqq of"), 3), "documents"))
def smart_reduced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return result(smart_search(_db(spark, sf_dir), "the qqqq of"))


@query(_views("documents", "SELECT term, count(*) AS freq FROM p GROUP BY term"))
def scan_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.dictionary(_db(spark, sf_dir))


@query(_views("documents", "SELECT term, count(*) AS freq FROM p WHERE term >= 'th' GROUP BY term ORDER BY term LIMIT 50"))
def scan_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.scan(_db(spark, sf_dir), "th", n=50)


@query(_views("conversations", "SELECT term, count(*) AS freq FROM p WHERE EXISTS (SELECT 1 FROM f WHERE f.rec_id = p.rec_id AND field = 'ROLE' AND f.s <= p.s AND f.e >= p.e) GROUP BY term"))
def scan_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.dictionary(_db(spark, sf_dir, "conversations"), "ROLE")


@query(_views("documents", "SELECT term, count(*) AS freq FROM p WHERE term LIKE 'th%ing' GROUP BY term"))
def scan_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.scan_truncated(_db(spark, sf_dir), "th", "ing")


@query(_views("documents", "SELECT term, count(*) AS freq FROM p WHERE regexp_matches(term, '^t.e.*[a-n]$') GROUP BY term"))
def scan_globbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.scan_glob(_db(spark, sf_dir), "t?e*[a-n]")


@query()
def scan_sounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.scan_soundex(_db(spark, sf_dir), "there")


@query()
def scan_metaphones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.scan_metaphone(_db(spark, sf_dir), "there")


@query(_views("events", "SELECT value, count(*) AS freq FROM numbers GROUP BY value"))
def scan_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.field_values(_db(spark, sf_dir, "events"), "numbers", "VALUE")


def _facet_sql() -> str:
    s = SqlQuery("conversations")
    k = s.set(parse_rpn("user the AND:TURN"))
    return s.text(f"SELECT term, count(*) AS freq FROM p JOIN (SELECT DISTINCT h.rec_id, f.s AS fs, f.e AS fe FROM h{k} h JOIN f ON f.rec_id = h.rec_id AND field = 'TURN' AND f.s <= h.s AND f.e >= h.e) c ON c.rec_id = p.rec_id AND fs <= p.s AND fe >= p.e GROUP BY term")


@query(_facet_sql())
def facet_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _db(spark, sf_dir, "conversations")
    return scan.facets(db, Engine(db).run(parse_rpn("user the AND:TURN")), "TURN")


def _facet_content_sql() -> str:
    s = SqlQuery("conversations")
    k = s.set(parse_rpn("the"))
    return s.text(f"SELECT lower(trim(role)) AS value, count(*) AS freq FROM conversations WHERE conv_id IN (SELECT rec_id FROM t{k}) GROUP BY 1")


@query(_facet_content_sql())
def facet_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _db(spark, sf_dir, "conversations")
    return scan.content_facets(db, Engine(db).run("the"), "ROLE")


@query(_views("documents", "SELECT (SELECT count(*) FROM p) AS words, (SELECT count(DISTINCT term) FROM p) AS unique_words, (SELECT count(*) FROM r) AS records, 0::BIGINT AS deleted"))
def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.totals(_db(spark, sf_dir))


@query(_views("conversations", "SELECT field, term, count(*) AS freq FROM p JOIN f ON f.rec_id = p.rec_id AND f.s <= p.s AND f.e >= p.e GROUP BY ALL"))
def centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.centroid(_db(spark, sf_dir, "conversations"))


def _join_sql() -> str:
    a, b = SqlQuery("documents"), SqlQuery("benchmark")
    i, j = a.set(parse_rpn("the")), b.set(parse_rpn("the"))
    inner = a.text(f"SELECT * FROM t{i}"), b.text(f"SELECT * FROM t{j}")
    return f"SELECT a.rec_id, a.rec_id::VARCHAR AS key, round(a.score + b.score, 6) AS score, a.hit_count FROM ({inner[0]}) a JOIN ({inner[1]}) b ON a.rec_id = b.rec_id"


@query(_join_sql())
def op_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN of two databases by key."""
    from .operators.boolean import join_by_key

    a, b = _db(spark, sf_dir), _db(spark, sf_dir, "benchmark")
    j = join_by_key(Engine(a).run("the"), a.records, Engine(b).run("the"), b.records)
    return j.select("rec_id", "key", F.round("score", 6).alias("score"), "hit_count")


def _virtual_sql() -> str:
    parts = []
    for v, kind in enumerate(("documents", "benchmark")):
        s = SqlQuery(kind)
        k = s.set(_TOP)
        parts.append(f"SELECT * FROM ({s.text(f'SELECT rec_id, round(score, 6) AS score, hit_count, {v} AS volume FROM t{k}')})")
    return " UNION ALL ".join(parts)


@query(_virtual_sql())
def virtual_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources.database import VirtualDatabase

    r = VirtualDatabase((_db(spark, sf_dir), _db(spark, sf_dir, "benchmark"))).search(_TOP)
    return r.select("rec_id", F.round("score", 6).alias("score"), "hit_count", "volume")


def _scaled_sql() -> str:
    s = SqlQuery("documents")
    k = s.set(_TOP)
    return s.text(f"SELECT rec_id, least(100, greatest(1, floor((score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) * 99 + 0.5) + 1))::INT AS scaled FROM t{k}")


@query(_scaled_sql())
def scaled_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.scaled(Engine(_db(spark, sf_dir)).run(_TOP)).select("rec_id", "scaled")


@query(_views("documents", "SELECT doc_id AS rec_id, text AS content FROM documents WHERE doc_id IN (SELECT rec_id FROM p WHERE term = 'the')"))
def present_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _db(spark, sf_dir)
    return present.present(db, Engine(db).run("the"), "F")


@query(_views("conversations", "SELECT conv_id AS rec_id, string_agg(role, chr(10) ORDER BY turn) AS content FROM conversations WHERE conv_id IN (SELECT rec_id FROM p WHERE term = 'the') GROUP BY 1"))
def present_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _db(spark, sf_dir, "conversations")
    return present.present(db, Engine(db).run("the"), "ROLE")


@query(_views("documents", "SELECT rec_id, CASE WHEN length(line) > 80 THEN left(line, 77) || '...' ELSE line END AS headline FROM (SELECT rec_id, trim(regexp_extract(text, '^\\s*([^\\n]*)', 1)) AS line FROM r WHERE rec_id IN (SELECT rec_id FROM p WHERE term = 'the'))"))
def present_headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _db(spark, sf_dir)
    return present.headline(db, Engine(db).run("the"))


@query(_views("conversations", "SELECT DISTINCT h.rec_id, f.s, f.e, rtrim(c.line, chr(10)) AS content FROM p h JOIN f ON f.rec_id = h.rec_id AND field = 'TURN' AND f.s <= h.s AND f.e >= h.e JOIN c ON c.rec_id = f.rec_id AND c.first_byte = f.s WHERE term = 'with'"))
def present_ancestor(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _db(spark, sf_dir, "conversations")
    return present.ancestor_content(db, Engine(db).run("with"), "TURN")


def _char_runs() -> str:
    """Runs of the texts with their places, in bytes (s, e) and in characters (cs)."""
    return f"SELECT rec_id, raw, k, sum(strlen(raw)) OVER o - strlen(raw) AS s, sum(strlen(raw)) OVER o - 1 AS e, sum(length(raw)) OVER o - length(raw) AS cs FROM (SELECT rec_id, unnest(x) AS raw, generate_subscripts(x, 1) AS k FROM (SELECT rec_id, regexp_extract_all(text, '{_WORD_RUNS}') AS x FROM r)) WINDOW o AS (PARTITION BY rec_id ORDER BY k)"


@query(_views("documents", f"SELECT c.rec_id, row_number() OVER (PARTITION BY c.rec_id ORDER BY c.s)::INT AS n, c.s::BIGINT AS s, c.e::BIGINT AS e, substring(text, greatest(cs - 40, 0)::BIGINT + 1, least(cs, 40)::BIGINT) AS before, raw AS hit, substring(text, (cs + length(raw))::BIGINT + 1, 40) AS after FROM ({_char_runs()}) c JOIN r ON r.rec_id = c.rec_id WHERE lower(raw) = 'the'"))
def present_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _db(spark, sf_dir)
    return present.contexts(db, Engine(db).run("the"))


@query(_views("documents", f"SELECT rec_id, string_agg(CASE WHEN lower(raw) = 'the' THEN '<b>' || raw || '</b>' ELSE raw END, '' ORDER BY k) AS text FROM ({_char_runs()}) GROUP BY rec_id HAVING bool_or(lower(raw) = 'the')"))
def present_highlighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _db(spark, sf_dir)
    return present.highlighted(db, Engine(db).run("the"))


@query()
def present_node_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _db(spark, sf_dir, "conversations")
    return present.hit_table_json(db, Engine(db).run("with"))


@query(_views("documents", "SELECT rec_id, key, lag(key) OVER (ORDER BY key, rec_id) AS previous, lead(key) OVER (ORDER BY key, rec_id) AS next FROM r"))
def key_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return present.neighbour_keys(_db(spark, sf_dir))


def _date_range_sql() -> str:
    s = SqlQuery("events")
    rows = "SELECT rec_id, count(*) AS hit_count, 1::BIGINT AS aux_count FROM numbers WHERE field = 'VALUE' AND value >= 50 AND rec_id IN (SELECT rec_id FROM r WHERE date >= TIMESTAMP '2024-01-01' AND date < TIMESTAMP '2024-02-01') GROUP BY rec_id"
    k = s.add(s.score(1.0, rows), SqlQuery.NONE)
    return s.text(f"SELECT rec_id, round(score, 6) AS score, hit_count, aux_count FROM t{k}")


@query(_date_range_sql())
def search_date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lookups restricted to records of a range of dates."""
    return result(Engine(_db(spark, sf_dir, "events"), date_range="2024-01").run("VALUE>=50"))


@query(to_sql(Unary("NOT", Term("standard", "exact", "TYPE")), "parts"))
def text_ne(spark: SparkSession, sf_dir: str) -> DataFrame:
    return result(Engine(_db(spark, sf_dir, "parts")).run(Term("standard", "typed", "TYPE", "<>")))


@query(to_sql(parse_rpn("the of AND"), "documents"))
def term_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = replace(_db(spark, sf_dir), aliases={"article": "the"})
    return result(Engine(db).run("article of AND"))


@query(_views("conversations", "SELECT DISTINCT h.rec_id, g.s, g.e, rtrim(substr(c.line, length(c.role) + 3), chr(10)) AS content FROM p h JOIN f ON f.rec_id = h.rec_id AND f.field = 'TURN' AND f.s <= h.s AND f.e >= h.e JOIN f g ON g.rec_id = f.rec_id AND g.field = 'TEXT' AND f.s <= g.s AND f.e >= g.e JOIN c ON c.rec_id = f.rec_id AND c.first_byte = f.s WHERE term = 'with'"))
def present_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _db(spark, sf_dir, "conversations")
    return present.descendants_content(db, Engine(db).run("with"), "TURN", "TEXT")


def _best_hit_sql() -> str:
    s = SqlQuery("documents")
    k = s.set(_TOP)
    return s.text(f"SELECT rec_id, s, e FROM (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY coalesce(gap, 1099511627776), s) AS n FROM (SELECT *, lead(s) OVER (PARTITION BY rec_id ORDER BY s, e) - e AS gap FROM h{k})) WHERE n = 1")


@query(_best_hit_sql())
def present_best_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return present.best_hit(Engine(_db(spark, sf_dir)).run(_TOP))


@query(_views("documents", "SELECT r.rec_id, '<?xml version=\"1.0\" encoding=\"UTF-8\"?><record key=\"' || key || '\">' || replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') || '</record>' AS record FROM r WHERE rec_id IN (SELECT rec_id FROM p WHERE term = 'the')"))
def present_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _db(spark, sf_dir)
    return present.formatted(db, Engine(db).run("the"), "XML")


@query(_views("documents", "SELECT DISTINCT term FROM p WHERE term LIKE 'th%'"))
def scan_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.strings(scan.scan_truncated(_db(spark, sf_dir), "th"))


def _join_right_sql() -> str:
    a, b = SqlQuery("documents"), SqlQuery("benchmark")
    i, j = a.set(parse_rpn("the")), b.set(parse_rpn("the"))
    inner = a.text(f"SELECT * FROM t{i}"), b.text(f"SELECT * FROM t{j}")
    return f"SELECT b.rec_id, b.rec_id::VARCHAR AS key, round(a.score + b.score, 6) AS score, b.hit_count FROM ({inner[0]}) a JOIN ({inner[1]}) b ON a.rec_id = b.rec_id"


@query(_join_right_sql())
def op_join_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The join of two databases by key, with the right one's rows."""
    from .operators.boolean import join_by_key

    a, b = _db(spark, sf_dir), _db(spark, sf_dir, "benchmark")
    j = join_by_key(Engine(a).run("the"), a.records, Engine(b).run("the"), b.records, "right")
    return j.select("rec_id", "key", F.round("score", 6).alias("score"), "hit_count")


def _priority_sql() -> str:
    s = SqlQuery("documents")
    k = s.set(_TOP)
    labels = "LEFT JOIN (SELECT doc_id, max(toxic) AS priority FROM labels GROUP BY doc_id) l ON l.doc_id = t.rec_id"
    share = "0.5 * (max(score) OVER () - min(score) OVER ()) / max(score) OVER ()"
    return s.text(f"SELECT t.rec_id, round(score + CASE WHEN coalesce(priority, 0) <> 0 THEN {share} / priority ELSE 0 END, 6) AS score FROM t{k} t {labels}")


@query(_priority_sql())
def search_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores raised by the records' priorities."""
    return Engine(_db(spark, sf_dir), priority=0.5).search(_TOP).select("rec_id", F.round("score", 6).alias("score"))


@query(to_sql(parse_rpn("the of NEAR:20 with OR"), "documents"))
def fluent_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .plans.fluent import Session

    s = Session(_db(spark, sf_dir))
    return result((s.term("the").near(s.term("of"), 20) | s.term("with")).frame())


@query(to_sql(parse_rpn("of the PRECEDES"), "documents"))
def phrase_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A phrase of common words is a chain of PRECEDES."""
    return result(Engine(_db(spark, sf_dir), phrase_limit=10).run(parse_rpn('"of the"')))


@query(to_sql(parse_rpn("the"), "documents"))
def phrase_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A phrase that isn't found is looked for as one word."""
    return result(Engine(_db(spark, sf_dir), join_words=True).run(parse_rpn('"t he"')))


@query(_views("events", "SELECT rec_id, place::INT AS place FROM (SELECT rec_id, row_number() OVER (ORDER BY rec_id % 7, rec_id DESC) AS place FROM r) WHERE place <= 20"))
def sort_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order of the caller's own."""
    own = {"function": lambda: [F.col("rec_id") % 7]}
    return Engine(_db(spark, sf_dir, "events"), "none", sorts=own).search("VALUE>=-1e9", "function", 20).select("rec_id", "place")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources.doctypes import parse_files

    pages = tables.table(spark, sf_dir, "pages").select(F.concat_ws("|", "page_id", "url").alias("path"), F.col("html").alias("content"))
    return parse_files(pages, "HTML").withColumn("page_id", F.split("path", r"\|")[0].cast("bigint"))


@query("SELECT page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title FROM pages")
def doctype_html_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles by the spans that the HTML class emits."""
    from .functions.text import byte_slice

    f = _pages(spark, sf_dir).select("page_id", "text", F.explode("fields").alias("x")).where("x.field = 'TITLE'")
    return f.select("page_id", byte_slice(F.col("text"), F.col("x.s"), F.col("x.e")).alias("title"))


@query("SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a href=\"([^\"]*)\"', 1)) AS href FROM pages")
def doctype_html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .functions.text import byte_slice

    f = _pages(spark, sf_dir).select("page_id", "text", F.explode("fields").alias("x")).where("x.field = 'A@HREF'")
    return f.select("page_id", byte_slice(F.col("text"), F.col("x.s"), F.col("x.e")).alias("href"))


@query("SELECT conv_id AS rec_id, count(*) AS turns FROM (SELECT conv_id, unnest(string_split(string_agg(role || ': ' || replace(text, chr(10), ' '), chr(10) ORDER BY turn), chr(10))) AS line FROM conversations GROUP BY conv_id) WHERE line LIKE 'user:%' GROUP BY 1")
def doctype_tag_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as tag: value files: fields named after the roles."""
    from .sources.doctypes import parse_files

    c = tables.table(spark, sf_dir, "conversations").withColumn("line", F.concat("role", F.lit(": "), F.replace("text", F.lit("\n"), F.lit(" "))))
    files = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n").alias("content"))
    r = parse_files(files.select(F.col("conv_id").cast("string").alias("path"), "content"), "COLONDOC")
    f = r.select(F.col("path").cast("bigint").alias("rec_id"), F.explode("fields").alias("x")).where("x.field = 'USER'")
    return f.groupBy("rec_id").agg(F.count("*").alias("turns"))


@query("SELECT term, levenshtein(term, 'there')::INT AS distance FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM benchmark) WHERE levenshtein(term, 'there') <= 2")
def fuzzy_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: terms within two edits, by a bounded distance on distinct terms."""
    t = tables.table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("term")).distinct()
    d = F.levenshtein("term", F.lit("there"), 2)
    return t.select("term", d.alias("distance")).where("distance >= 0")


@query("SELECT sha256(text) AS digest, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1")
def function_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "documents").where("text is not null").groupBy(F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("n"))


@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: the streaming aggregation over a bounded table."""
    from .streaming.ingest import windowed_counts

    e = tables.table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value").where("ts is not null")
    w = windowed_counts(e, "ts", ["event_type"], "1 hour", "1 hour", "value")
    return w.select("start", "event_type", "n", F.round("total", 4).alias("total"))


_add_trees()
_add_sorts()
