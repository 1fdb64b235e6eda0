"""Document classes: how a file is cut into records, and which spans of a record are which field.

A parser takes one file's text and yields records (text, key, fields), fields being (name, path, s, e) with
inclusive byte offsets into the record's text; fields may overlap. Parsers see texts with one character a
byte, so that their offsets are bytes. Files are parsed where they lie, by Arrow batches.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Record:
    text: str
    key: str | None = None
    fields: list[tuple[str, str, int, int]] = field(default_factory=list)

    def add(self, name: str, s: int, e: int, path: str | None = None) -> None:
        if e > s:
            up = re.sub(r"\s+", "_", name.strip()).upper()
            self.fields.append((up, (path or up).upper(), s, e - 1))

    def value(self, name: str) -> str | None:
        return next((self.text[s : e + 1] for f, _, s, e in self.fields if f == name.upper()), None)


Parser = Callable[[str], Iterator[Record]]
PARSERS: dict[str, Parser] = {}


def doctype(*names: str) -> Callable[[Parser], Parser]:
    def wrap(f: Parser) -> Parser:
        for n in names:
            PARSERS[n] = f
        return f

    return wrap


# -- lines and paragraphs


@doctype("PLAINTEXT", "SIMPLE")
def plaintext(t: str) -> Iterator[Record]:
    yield Record(t)


@doctype("ONELINE", "TSLDOC")
def oneline(t: str) -> Iterator[Record]:
    """Every line that isn't blank is a record."""
    for line in t.split("\n"):
        if line.strip():
            yield Record(line)


@doctype("FIRSTLINE")
def firstline(t: str) -> Iterator[Record]:
    """The whole file, its first line as HEADLINE."""
    r = Record(t)
    if m := re.search(r"\S[^\n]*", t):
        r.add("HEADLINE", m.start(), m.end())
    yield r


@doctype("PARA", "PTEXT")
def para(t: str) -> Iterator[Record]:
    """Pages, paragraphs, lines and sentences as overlapping fields; the first line is the HEADLINE."""
    r = Record(t)
    for name, rx in (("PAGE", r"[^\f]+"), ("PARA", r"(?:[^\n\f]+(?:\n(?!\s*\n))?)+"), ("LINE", r"[^\n\f]+"), ("SENTENCE", r"[^.!?\s][^.!?]*[.!?]*")):
        for m in re.finditer(rx, t):
            if m.group().strip():
                r.add(name, m.start(), m.start() + len(m.group().rstrip()))
    if m := re.search(r"\S[^\n]*", t):
        r.add("HEADLINE", m.start(), m.end())
    yield r


# -- tag: value


def tag_values(r: Record, at: int = 0, end: int | None = None, rx: str = r"[A-Za-z][\w .-]*") -> int:
    """Adds `Tag: value` lines with their continuation lines as fields, up to a blank line; returns where it ended."""
    t, end = r.text, len(r.text) if end is None else end
    head = re.compile(rf"({rx}):[ \t]*")
    while at < end:
        stop = t.find("\n", at, end)
        stop = end if stop < 0 else stop
        if not t[at:stop].strip():
            return min(stop + 1, end)
        if m := head.match(t, at, stop):
            last = stop
            while last + 1 < end and t[last + 1] in " \t":
                nxt = t.find("\n", last + 1, end)
                nxt = end if nxt < 0 else nxt
                if not t[last + 1 : nxt].strip():
                    break
                last = nxt
            r.add(m[1], m.end(), m.end() + len(t[m.end() : last].rstrip()))
            stop = last
        at = stop + 1
    return end


@doctype("COLONDOC", "METADOC", "IAFADOC", "ROADS++", "DVBLINE", "EUROMEDIA", "MISMEDIA", "FILMLINE", "BIBCOLON", "IKNOWDOC", "OZSEARCH", "GILS", "DIF", "ISOTEIA")
def colondoc(t: str) -> Iterator[Record]:
    """One record of tag: value lines, blank lines between them or not."""
    r, at = Record(t), 0
    while at < len(t):
        at = tag_values(r, at)
    r.key = r.value("HANDLE") or r.value("KEY")
    yield r


@doctype("COLONGRP", "DIALOG-B")
def colongrp(t: str) -> Iterator[Record]:
    """Blank lines part records."""
    for block in re.split(r"\n[ \t]*\n+", t):
        if block.strip():
            r = Record(block.strip("\n"))
            tag_values(r)
            r.key = r.value("KEY")
            yield r


@doctype("MEMO")
def memo(t: str) -> Iterator[Record]:
    """Tag: value head, a line of dashes or a blank line, then the BODY."""
    r = Record(t)
    if m := re.search(r"^[-=_*]{3,}[ \t]*$", t, re.M):
        tag_values(r, 0, m.start())
        at = m.end() + 1
    else:
        at = tag_values(r)
    r.add("BODY", at, len(t.rstrip()))
    yield r


@doctype("SOIF", "HARVEST")
def soif(t: str) -> Iterator[Record]:
    """@TYPE { url, then Attribute{size}: value of so many bytes."""
    for m in re.finditer(r"@(\w+)\s*\{\s*(\S*)[^\n]*\n", t):
        nxt = re.compile(r"^\}\s*$", re.M).search(t, m.end())
        stop = nxt.start() if nxt else len(t)
        r, at = Record(t[m.start() : stop + 1], m[2]), m.end()
        head = re.compile(r"([\w-]+)\{(\d+)\}:[ \t]?")
        while h := head.search(t, at, stop):
            r.add(h[1], h.end() - m.start(), min(h.end() + int(h[2]), stop) - m.start())
            at = h.end() + int(h[2])
        yield r


# -- delimited


def separator(t: str) -> str:
    """The separator that the first lines agree on best."""
    lines = [x for x in t.split("\n")[:20] if x]
    best, most = ",", 0
    for sep in ",;\t|\x1f":
        counts = [x.count(sep) for x in lines]
        score = min(counts, default=0) * 1000 + sum(c == counts[0] for c in counts) if counts and counts[0] else 0
        if score > most:
            best, most = sep, score
    return best


@doctype("CSV", "TSV", "CSVDOC")
def csvdoc(t: str) -> Iterator[Record]:
    """A header, then a record a row; columns beyond the header are FIELDnn. Values are written one a line, so that spans are theirs."""
    sep = separator(t)
    quote = "'" if t[:1] == "'" or t.count("'" + sep) > t.count('"' + sep) else '"'
    rows = csv.reader(io.StringIO(t), delimiter=sep, quotechar=quote)
    header = [h.strip() for h in next(rows, [])]
    for row in rows:
        if not any(x.strip() for x in row):
            continue
        r, parts, at = Record(""), [], 0
        for k, v in enumerate(row):
            name = header[k] if k < len(header) and header[k] else f"FIELD{k + 1:02d}"
            parts.append(v)
            r.fields += [(re.sub(r"\s+", "_", name).upper(),) * 2 + (at, at + len(v) - 1)] if v else []
            at += len(v) + 1
        r.text = "\n".join(parts)
        r.key = r.value("KEY") or r.value("ID")
        yield r


# -- markup

_TAG = re.compile(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<[?!][^>]*>|<(/?)([A-Za-z_][\w:.-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*?)(/?)>", re.S)
_ATTR = re.compile(r"([\w:.-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_VOID = {"BR", "HR", "IMG", "INPUT", "META", "LINK", "AREA", "BASE", "COL", "EMBED", "SOURCE", "TRACK", "WBR"}
_IMPLIED = {"P": {"P"}, "LI": {"LI"}, "TR": {"TR", "TD", "TH"}, "TD": {"TD", "TH"}, "TH": {"TD", "TH"}, "DT": {"DT", "DD"}, "DD": {"DT", "DD"}, "OPTION": {"OPTION"}}


def markup(t: str, html: bool = False, attributes: bool = True) -> Record:
    """Contents of elements as fields, nested paths with backslashes, attributes as ELEMENT@NAME; ends that lack are implied."""
    r = Record(t)
    open_: list[tuple[str, int]] = []

    def close(upto: int, at: int) -> None:
        while len(open_) > upto:
            name, s = open_[-1]
            r.add(name, s, at, "\\".join(n for n, _ in open_))
            open_.pop()

    at = 0
    while m := _TAG.search(t, at):
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].upper()
        if m[1]:
            k = next((k for k in range(len(open_) - 1, -1, -1) if open_[k][0] == name), None)
            if k is not None:
                close(k, m.start())
            continue
        if html and open_ and open_[-1][0] in _IMPLIED.get(name, ()):
            close(len(open_) - 1, m.start())
        if attributes:
            for a in _ATTR.finditer(m[3] or ""):
                g = 2 if a[2] is not None else 3 if a[3] is not None else 4
                r.add(f"{name}@{a[1]}", m.start(3) + a.start(g), m.start(3) + a.end(g), "\\".join([n for n, _ in open_] + [f"{name}@{a[1]}"]))
        if m[4] or html and name in _VOID:
            continue
        open_.append((name, m.end()))
        if html and name in ("SCRIPT", "STYLE"):
            end = re.compile(rf"</{name}\s*>", re.I).search(t, at)
            at = end.start() if end else len(t)
    close(0, len(t.rstrip()))
    return r


@doctype("XML", "XMLBASE", "GILSXML", "CAP", "NEWSML", "SGML", "SGMLTAG", "SGMLNORM", "RDF", "XMLREC")
def xml(t: str) -> Iterator[Record]:
    yield markup(t)


def _elements(t: str, name: str) -> Iterator[Record]:
    for m in re.finditer(rf"<{name}(?:\s[^>]*)?>.*?</{name}\s*>", t, re.S | re.I):
        r = markup(m.group())
        r.key = r.value("GUID") or r.value("ID") or r.value("LINK")
        yield r


@doctype("RSS", "RSS1", "RSS2", "RSS.9X", "RSSCORE", "RSSARCHIVE")
def rss(t: str) -> Iterator[Record]:
    """Every item of a feed."""
    yield from _elements(t, "item")


@doctype("ATOM")
def atom(t: str) -> Iterator[Record]:
    yield from _elements(t, "entry")


@doctype("HTML", "HTML--", "HTMLCACHE", "HTMLREMOTE", "HTMLZERO")
def html(t: str) -> Iterator[Record]:
    r = markup(t, True)
    r.key = None
    yield r


@doctype("HTMLHEAD", "HTMLMETA")
def htmlhead(t: str) -> Iterator[Record]:
    """Only the head: title, and META.NAME for every meta element."""
    m = re.search(r"</head\s*>|<body[\s>]", t, re.I)
    r = markup(t[: m.start()] if m else t, True)
    full = Record(t, None, r.fields)
    for m in re.finditer(r"<meta\s([^>]*)>", t, re.I):
        a = {x[1].lower(): x for x in _ATTR.finditer(m[1])}
        name = a.get("name") or a.get("property") or a.get("http-equiv")
        if name and "content" in a:
            c = a["content"]
            g = 2 if c[2] is not None else 3 if c[3] is not None else 4
            full.add("META." + (name[2] or name[3] or name[4]), m.start(1) + c.start(g), m.start(1) + c.end(g))
    yield full


# -- mail and news


def _message(t: str) -> Record:
    r = Record(t)
    at = t.find("\n") + 1 if t.startswith("From ") else 0
    at = tag_values(r, at, None, r"[A-Za-z][\w-]*")
    r.add("BODY", at, len(t.rstrip()))
    r.key = (r.value("MESSAGE-ID") or "").strip("<> \n") or None
    return r


@doctype("MAILFOLDER", "NEWSFOLDER", "MIME")
def mailfolder(t: str) -> Iterator[Record]:
    """A message at every `From ` line after a blank one; headers and BODY."""
    for part in re.split(r"(?:^|(?<=\n\n))(?=From \S+)", t):
        if part.strip():
            yield _message(part)


@doctype("MAILDIGEST", "LISTDIGEST", "IRLIST", "AOLLIST", "YAHOOLIST")
def maildigest(t: str) -> Iterator[Record]:
    """Messages between lines of dashes."""
    for part in re.split(r"\n-{20,}[^\n]*\n+", t):
        if re.match(r"\s*[A-Za-z][\w-]*:", part):
            yield _message(part.lstrip("\n"))


# -- bibliography


@doctype("BIBTEX")
def bibtex(t: str) -> Iterator[Record]:
    for m in re.finditer(r"@(\w+)\s*\{\s*([^,\s]+)\s*,", t):
        depth, k = 1, m.end()
        while k < len(t) and depth:
            depth += {"{": 1, "}": -1}.get(t[k], 0)
            k += 1
        r = Record(t[m.start() : k], m[2])
        r.add("TYPE", 1, 1 + len(m[1]))
        for f in re.finditer(r"(\w+)\s*=\s*(?:\{((?:[^{}]|\{[^{}]*\})*)\}|\"([^\"]*)\"|(\w+))", r.text):
            g = 2 if f[2] is not None else 3 if f[3] is not None else 4
            r.add(f[1], f.start(g), f.end(g))
        yield r


def _tagged(t: str, start: str, line: str, names: dict[str, str], key: str | None) -> Iterator[Record]:
    """Records from one start line to the next; two-letter tags with continuation lines."""
    cuts = [m.start() for m in re.finditer(start, t, re.M)]
    for s, e in zip(cuts, [*cuts[1:], len(t)]):
        r = Record(t[s:e].rstrip())
        for m in re.finditer(line, r.text, re.M):
            r.add(names.get(m[1], m[1]), m.start(2), m.start(2) + len(m[2].rstrip()))
        r.key = r.value(key) if key else None
        yield r


@doctype("RIS")
def ris(t: str) -> Iterator[Record]:
    return _tagged(t, r"^TY  - ", r"^([A-Z][A-Z0-9])  - ?(.*(?:\n(?![A-Z][A-Z0-9]  -).*)*)", {"TY": "TYPE", "AU": "AUTHOR", "TI": "TITLE", "T1": "TITLE", "PY": "YEAR", "KW": "KEYWORD", "AB": "ABSTRACT", "JO": "JOURNAL"}, "ID")


@doctype("MEDLINE")
def medline(t: str) -> Iterator[Record]:
    return _tagged(t, r"^PMID\s*- ", r"^([A-Z]{2,4})\s*- (.*(?:\n {6}.*)*)", {"TI": "TITLE", "AU": "AUTHOR", "AB": "ABSTRACT", "DP": "DATE", "TA": "JOURNAL"}, "PMID")


@doctype("REFERBIB", "ENDNOTE", "PAPYRUS")
def refer(t: str) -> Iterator[Record]:
    for block in re.split(r"\n[ \t]*\n+", t):
        if not block.strip():
            continue
        r = Record(block.strip("\n"))
        names = {"A": "AUTHOR", "T": "TITLE", "D": "DATE", "J": "JOURNAL", "K": "KEYWORD", "X": "ABSTRACT", "0": "TYPE", "F": "KEY"}
        for m in re.finditer(r"^%(\S) (.*(?:\n(?!%).*)*)", r.text, re.M):
            r.add(names.get(m[1], m[1]), m.start(2), m.start(2) + len(m[2].rstrip()))
        r.key = r.value("KEY")
        yield r


@doctype("MARC", "USMARC")
def marc(t: str) -> Iterator[Record]:
    """ISO 2709 records: fields by tag, subfields as TAG$code."""
    for raw in t.split("\x1d"):
        if len(raw) < 25 or not raw[12:17].isdigit():
            continue
        base, r = int(raw[12:17]), Record(raw)
        for k in range(24, base - 1, 12):
            tag, n, at = raw[k : k + 3], raw[k + 3 : k + 7], raw[k + 7 : k + 12]
            if not (n.isdigit() and at.isdigit()):
                break
            s = base + int(at)
            e = s + int(n) - 1
            r.add(tag, s, e)
            for m in re.finditer(r"\x1f(.)([^\x1f\x1e]*)", raw[s:e]):
                r.add(f"{tag}${m[1]}", s + m.start(2), s + m.end(2), f"{tag}\\{tag}${m[1]}")
        r.key = (r.value("001") or "").strip() or None
        yield r


# -- archives and external programs


@doctype("WARC")
def warc(t: str) -> Iterator[Record]:
    """A record of an archive: its WARC headers as fields, and the BODY of the stated length."""
    at = 0
    while m := re.compile(r"^WARC/[\d.]+\r?\n", re.M).search(t, at):
        end = re.compile(r"\r?\n\r?\n").search(t, m.end())
        if not end:
            return
        n = re.search(r"(?im)^Content-Length:\s*(\d+)", t[m.end() : end.start()])
        stop = min(end.end() + int(n[1]) if n else len(t), len(t))
        r = Record(t[m.start() : stop])
        tag_values(r, m.end() - m.start(), end.start() - m.start() + 1)
        r.add("BODY", end.end() - m.start(), stop - m.start())
        r.key = r.value("WARC-RECORD-ID") or r.value("WARC-TARGET-URI")
        yield r
        at = max(stop, end.end())


def external(files: DataFrame, argv: list[str], timeout: float = 60.0) -> DataFrame:
    """(path, content) with every content replaced by what a program, asked for by the caller, makes of it; null if it fails."""

    def run(batches):
        import subprocess

        for b in batches:
            out = []
            for c in b["content"]:
                try:
                    p = subprocess.run(argv, input=(c or "").encode(), capture_output=True, timeout=timeout, check=True)
                    out.append(p.stdout.decode("utf-8", "replace"))
                except (subprocess.SubprocessError, OSError):
                    out.append(None)
            yield pd.DataFrame({"path": b["path"], "content": out})

    return files.select("path", "content").mapInPandas(run, "path string, content string")


# -- recognition

_BY_EXTENSION = {"html": "HTML", "htm": "HTML", "xml": "XML", "sgml": "SGML", "sgm": "SGML", "rdf": "RDF", "csv": "CSV", "tsv": "CSV", "bib": "BIBTEX", "ris": "RIS", "mbox": "MAILFOLDER", "memo": "MEMO", "mrc": "MARC", "rss": "RSS", "atom": "ATOM", "soif": "SOIF", "warc": "WARC"}
_BY_CONTENT = (
    ("WARC", r"\AWARC/\d"), ("MAILFOLDER", r"\AFrom \S+ .*\d{4}"), ("MEDLINE", r"\APMID\s*- "), ("RIS", r"\ATY  - "), ("BIBTEX", r"\A\s*@\w+\s*\{\s*[^,\s]+\s*,"), ("SOIF", r"\A\s*@\w+\s*\{"), ("REFERBIB", r"\A%[A-Z0-9] "), ("ATOM", r"(?i)\A\s*(?:<\?xml[^>]*>\s*)?<feed[\s>]"), ("RSS", r"(?i)\A\s*(?:<\?xml[^>]*>\s*)?<rss[\s>]"),
    ("HTML", r"(?i)\A\s*(?:<!doctype html|<html|<head|<body)"), ("XML", r"\A\s*<\?xml"), ("SGML", r"\A\s*<[A-Za-z]"), ("MARC", r"\A\d{5}[a-z]"), ("MIME", r"(?i)\A(?:[\w-]+:[^\n]*\n(?:[ \t][^\n]*\n)*)*(?:message-id|received|mime-version):"), ("MEMO", r"\A(?:[A-Z][\w -]*:[^\n]*\n)+\s*(?:[-=_*]{3,}[ \t]*)?\n\S"), ("COLONDOC", r"\A(?:[A-Za-z][\w -]*:[^\n]*\n?){2,}"),
    ("CSV", r"\A[^\n]*([,;\t|])[^\n]*\1[^\n]*\n[^\n]*\1[^\n]*\1"),
)


def autodetect(text: str, path: str = "") -> str:
    """A doctype's name by the content's beginning, else by the extension, else PLAINTEXT."""
    head = text[:4096]
    for name, rx in _BY_CONTENT:
        if re.search(rx, head):
            return name
    return _BY_EXTENSION.get(path.rsplit(".", 1)[-1].lower(), "PLAINTEXT")


def parse(text: str, name: str = "AUTODETECT", path: str = "") -> list[Record]:
    """Records of a file; offsets are bytes of UTF-8."""
    raw = text.encode("utf-8").decode("latin-1")
    name = name.upper()
    if name == "AUTODETECT":
        name = autodetect(raw, path)
    if name not in PARSERS:
        raise ValueError(f"unknown doctype {name}")
    out = list(PARSERS[name](raw))
    for r in out:
        r.text = r.text.encode("latin-1").decode("utf-8", "replace")
        r.key = r.key.encode("latin-1").decode("utf-8", "replace") if r.key else r.key
    return out


SCHEMA = "path string, seq int, doctype string, key string, text string, fields array<struct<field:string,path:string,s:bigint,e:bigint>>"


def parse_files(files: DataFrame, name: str = "AUTODETECT", extra: dict[str, Parser] | None = None) -> DataFrame:
    """files: (path, content). One row a record. extra: parsers of further doctypes (plugins)."""

    def run(batches):
        PARSERS.update(extra or {})
        for b in batches:
            for p, c in zip(b["path"], b["content"]):
                c = c if c is not None else ""
                kind = autodetect(c.encode("utf-8").decode("latin-1"), p) if name.upper() == "AUTODETECT" else name.upper()
                rows = [(p, k, kind, r.key or f"{p}#{k}", r.text, [{"field": f, "path": q, "s": s, "e": e} for f, q, s, e in r.fields]) for k, r in enumerate(parse(c, kind, p))]
                yield pd.DataFrame(rows, columns=["path", "seq", "doctype", "key", "text", "fields"])

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def read_files(spark, path: str, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """(path, content) of the text files under a path."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=recursive, pathGlobFilter=glob)
    return files.select(F.input_file_name().alias("path"), F.col("value").alias("content"))


def to_database(records: DataFrame, types: dict[str, str] | None = None, **more):
    """Parsed records as a Database: ids from paths and places, reserved fields into the record table, typed side tables."""
    from ..functions.dates import timestamp_of
    from ..functions.text import byte_slice
    from .database import Database

    r = records.withColumn("rec_id", F.xxhash64("path", "seq"))
    f = r.select("rec_id", F.explode("fields").alias("x"), "text").select("rec_id", "x.*", "text")
    values = f.withColumn("value", byte_slice(F.col("text"), F.col("s"), F.col("e"))).drop("text")
    reserved = ("DATE", "CREATED", "MODIFIED", "EXPIRES", "LANGUAGE", "CATEGORY", "PRIORITY")
    meta = values.where(F.col("field").isin(*reserved)).groupBy("rec_id").pivot("field", list(reserved)).agg(F.first("value"))
    rows = r.drop("fields").join(meta, "rec_id", "left").select(
        "rec_id", "text", "key", "path", F.element_at(F.split("path", "/"), -1).alias("file"), "doctype", F.col("LANGUAGE").alias("lang"), timestamp_of(F.col("DATE")).alias("date"), timestamp_of(F.col("CREATED")).alias("date_created"),
        timestamp_of(F.col("MODIFIED")).alias("date_modified"), timestamp_of(F.col("EXPIRES")).alias("date_expires"), F.col("CATEGORY").try_cast("int").alias("category"), F.col("PRIORITY").try_cast("int").alias("priority"),
    )
    types = {k.upper(): v for k, v in (types or {}).items()}
    typed = typed_tables(values, types)
    return Database.build(rows, values.select("rec_id", "field", "path", "s", "e"), typed, types, **more)


def typed_tables(values: DataFrame, types: dict[str, str]) -> dict[str, DataFrame]:
    """Side tables of (rec_id, field, s, e, value) by the declared types; values that don't parse are left out."""
    from ..functions.dates import timestamp_of
    from ..functions.values import dotted_value, money, number_of, range_of

    of = lambda *kinds: values.where(F.col("field").isin([k for k, v in types.items() if v in kinds] or [""]))
    at = ["rec_id", "field", "s", "e"]
    numbers = of("numerical", "number", "computed", "ttl").select(*at, number_of(F.col("value")).alias("value"))
    numbers = numbers.unionByName(of("currency").select(*at, money(F.col("value")).cast("double").alias("value"))).unionByName(of("dotnumber", "inet").select(*at, dotted_value(F.col("value")).cast("double").alias("value")))
    numbers = numbers.unionByName(of("boolean").select(*at, F.when(F.lower(F.trim("value")).isin("1", "true", "yes", "y", "on"), 1.0).otherwise(0.0).alias("value")))
    day = timestamp_of(F.col("value"))
    dates = of("date", "time").select(*at, day.alias("lo"), day.alias("hi"))
    spans = of("date-range", "duration").select(*at, timestamp_of(F.split("value", "/")[0]).alias("lo"), timestamp_of(F.get(F.split("value", "/"), F.lit(-1) + F.size(F.split("value", "/")))).alias("hi"))
    box = F.transform(F.split("value", r"[,\s]+"), lambda x: x.try_cast("double"))
    boxes = of("box").select(*at, F.get(box, 0).alias("n"), F.get(box, 1).alias("w"), F.get(box, 2).alias("so"), F.get(box, 3).alias("ea")).where("ea is not null")
    lo, hi = range_of(F.col("value"))
    return {
        "numbers": numbers.where("value is not null"), "dates": dates.unionByName(spans).where("lo is not null"), "ranges": of("range", "numrange").select(*at, lo.alias("lo"), hi.alias("hi")).where("lo is not null"),
        "boxes": boxes, "hashes": of("hash", "casehash", "lexi").select(*at, "value"),
    }
