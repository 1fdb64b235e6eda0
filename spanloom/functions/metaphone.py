"""Double Metaphone keys of words: a primary and, where a spelling has two readings, a secondary one."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOWELS = "AEIOUY"
_PLAIN = {"B": "P", "F": "F", "L": "L", "M": "M", "N": "N", "R": "R", "V": "F", "Q": "K", "K": "K", "Z": "S"}


def _letters(word: str) -> str:
    x = unicodedata.normalize("NFD", word.replace("ß", "ss").replace("ç", "s").replace("Ç", "S"))
    return "".join(c for c in x.upper() if "A" <= c <= "Z")


def metaphone_keys(word: str, size: int = 6) -> list[str]:
    w = _letters(word)
    a: list[str] = []
    b: list[str] = []

    def add(x: str, y: str | None = None) -> None:
        a.append(x)
        b.append(x if y is None else y)

    n, k = len(w), 0
    at = lambda i: w[i] if 0 <= i < n else ""
    has = lambda i, *xs: any(i >= 0 and w.startswith(x, i) for x in xs)
    slavic = any(x in w for x in ("W", "K", "CZ", "WITZ"))
    if w[:2] in ("GN", "KN", "PN", "WR", "PS"):
        k = 1
    elif w[:1] == "X":
        add("S")
        k = 1
    while k < n and len(a) < size + 4:
        c = w[k]
        if c in VOWELS:
            if k == 0:
                add("A")
            k += 1
            continue
        step = 2 if at(k + 1) == c and c not in "CHJWX" else 1
        if c in _PLAIN:
            if c == "Z" and at(k + 1) == "H":
                add("J")
                step = 2
            elif c == "Z" and slavic and k > 0 and at(k - 1) != "T":
                add("S", "TS")
            elif c == "L" and step == 2 and k == n - 3 and has(k - 1, "ILLO", "ILLA", "ALLE"):
                add("L", "")
            elif not (c == "B" and k == n - 1 and at(k - 1) == "M"):
                add(_PLAIN[c])
        elif c == "C":
            if has(k, "CH"):
                step = 2
                if k == 0 and has(0, "CHAR", "CHEM", "CHOR", "CHYM", "CHIA"):
                    add("K")
                elif has(k - 1, "SCH") or at(k + 2) in ("T", "S") or k > 0 and has(k - 2, "ORCHES", "ARCHIT"):
                    add("K")
                elif k == 0:
                    add("X")
                else:
                    add("X", "K")
            elif has(k, "CZ"):
                add("S", "X")
                step = 2
            elif has(k, "CIA"):
                add("X")
                step = 3
            elif has(k, "CC") and not (k == 1 and w[0] == "M"):
                if at(k + 2) in ("I", "E", "H") and not has(k + 2, "HU"):
                    add("KS" if has(k - 1, "ACCE", "UCCE", "UCCES") else "X")
                    step = 3
                else:
                    add("K")
                    step = 2
            elif at(k + 1) in ("K", "G", "Q") and at(k + 1):
                add("K")
                step = 2
            elif at(k + 1) in ("I", "E", "Y") and at(k + 1):
                add("S", "X" if has(k, "CIO", "CIE") else None)
            else:
                add("K")
        elif c == "D":
            if has(k, "DG") and at(k + 2) in ("I", "E", "Y"):
                add("J")
                step = 3
            elif has(k, "DG"):
                add("TK")
                step = 2
            else:
                add("T")
                step = 2 if has(k, "DT", "DD") else 1
        elif c == "G":
            if at(k + 1) == "H":
                step = 2
                if k > 0 and at(k - 1) not in VOWELS:
                    add("K")
                elif k == 0:
                    add("J" if at(2) == "I" else "K")
                elif k > 2 and at(k - 1) == "U" and at(k - 3) in ("C", "G", "L", "R", "T"):
                    add("F")
                elif at(k - 1) != "I" and not (k > 1 and at(k - 2) in ("B", "H", "D")) and k + 2 >= n:
                    add("K")
            elif at(k + 1) == "N":
                step = 2
                if k == 1 and at(0) in VOWELS and not slavic:
                    add("KN", "N")
                elif not has(k + 2, "EY") and not slavic:
                    add("N", "KN")
                else:
                    add("KN")
            elif has(k, "GLI") and not slavic:
                add("KL", "L")
                step = 2
            elif at(k + 1) and at(k + 1) in "EIY" and step == 1:
                add("K", "J") if k == 0 and at(1) != "I" or has(k - 1, "RGE", "OGY") else add("J", "K")
            else:
                add("K")
        elif c == "H":
            if (k == 0 or at(k - 1) in VOWELS) and at(k + 1) and at(k + 1) in VOWELS:
                add("H")
                step = 2
        elif c == "J":
            if has(k, "JOSE") or has(0, "SAN "):
                add("H")
            elif k == 0:
                add("J", "A")
            elif at(k - 1) in VOWELS and not slavic and at(k + 1) in ("A", "O"):
                add("J", "H")
            elif k == n - 1:
                add("J", "")
            elif at(k + 1) not in ("L", "T", "K", "S", "N", "M", "B", "Z") and at(k - 1) not in ("S", "K", "L"):
                add("J")
            step = 2 if at(k + 1) == "J" else 1
        elif c == "P":
            if at(k + 1) == "H":
                add("F")
                step = 2
            else:
                add("P")
                step = 2 if at(k + 1) in ("P", "B") and at(k + 1) else 1
        elif c == "S":
            if has(k - 1, "ISL", "YSL"):
                step = 1
            elif has(k, "SUGAR") and k == 0:
                add("X", "S")
            elif has(k, "SH"):
                add("S" if has(k + 1, "HEIM", "HOEK", "HOLM", "HOLZ") else "X")
                step = 2
            elif has(k, "SIO", "SIA"):
                add("S", None if slavic else "X")
                step = 3
            elif k == 0 and at(1) in ("M", "N", "L", "W") or at(k + 1) == "Z":
                add("S", "X")
                step = 2 if at(k + 1) == "Z" else 1
            elif has(k, "SC"):
                if at(k + 2) == "H":
                    add("SK" if at(k + 3) in ("O", "E", "U") and at(k + 3) else "X", None if k else "S")
                elif at(k + 2) and at(k + 2) in "IEY":
                    add("S")
                else:
                    add("SK")
                step = 3
            elif k == n - 1 and has(k - 2, "AIS", "OIS"):
                add("", "S")
            else:
                add("S")
        elif c == "T":
            if has(k, "TION", "TIA", "TCH"):
                add("X")
                step = 3
            elif has(k, "TH") or has(k, "TTH"):
                add("0", "T")
                step = 2 if at(k + 1) == "H" else 3
            else:
                add("T")
                step = 2 if at(k + 1) in ("T", "D") and at(k + 1) else 1
        elif c == "W":
            if at(k + 1) == "R":
                add("R")
                step = 2
            elif k == 0 and (at(1) and at(1) in VOWELS or has(0, "WH")):
                add("A", "F" if at(1) in VOWELS else None)
            elif has(k - 1, "EWSKI", "EWSKY", "OWSKI", "OWSKY") or k == n - 1 and at(k - 1) in VOWELS:
                add("", "F")
            elif has(k, "WICZ", "WITZ"):
                add("TS", "FX")
                step = 4
        elif c == "X":
            if not (k == n - 1 and has(k - 3, "IAU", "EAU") or k == n - 1 and has(k - 2, "AU", "OU")):
                add("KS")
            step = 2 if at(k + 1) in ("C", "X") and at(k + 1) else 1
        k += step
    out = ["".join(a)[:size], "".join(b)[:size]]
    return [x for x in dict.fromkeys(out) if x]


@F.pandas_udf(T.ArrayType(T.StringType()))
def metaphone(words: pd.Series) -> pd.Series:
    return words.map(metaphone_keys)


#: Else the optimizer copies conditions on keys from the distinct terms to all postings: below the aggregate, and to the other side of a join on the term.
metaphone = metaphone.asNondeterministic()
