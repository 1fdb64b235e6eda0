"""Query trees. They are plan-time values: nothing runs before a tree is compiled and its result is used."""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace
from typing import Any

MESSAGES = {1: "Permanent system error", 2: "Temporary system error", 3: "Unsupported search", 4: "Only stop words", 12: "Too many records retrieved", 13: "Result set not sorted", 32: "Resources exhausted", 100: "Unspecified error", 108: "Malformed query", 109: "Database unavailable", 110: "Operator unsupported", 113: "Unsupported attribute type", 114: "Unsupported use attribute", 117: "Unsupported relation", 125: "Malformed search term"}


class QueryError(Exception):
    """A numbered diagnostic."""

    def __init__(self, code: int, detail: str = ""):
        super().__init__(f"{code}: {MESSAGES.get(code, 'Error')}" + (f" ({detail})" if detail else ""))
        self.code = code


@dataclass(frozen=True)
class Node:
    pass


@dataclass(frozen=True)
class Term(Node):
    """text looked up by mode: exact, right, left, infix, glob, phonetic, metaphone, case, case_right, exactterm, phrase, phrase_right."""

    text: str
    mode: str = "exact"
    field: str | None = None
    relation: str | None = None
    weight: float = 1.0
    free: bool = False


@dataclass(frozen=True)
class Unary(Node):
    op: str
    child: Node
    arg: Any = None


@dataclass(frozen=True)
class Binary(Node):
    """RPN `left right op`: the reference operand of an unordered operator is the right one."""

    op: str
    left: Node
    right: Node
    arg: Any = None


def terms(node: Node) -> list[Term]:
    if isinstance(node, Term):
        return [node]
    if isinstance(node, Unary):
        return terms(node.child)
    return terms(node.left) + terms(node.right)


def to_rpn(node: Node) -> str:
    if isinstance(node, Term):
        mark = {"right": "*", "case": "=", "case_right": ">", "exactterm": ".", "phonetic": "~", "phrase": "", "exact": ""}
        body = node.text
        if node.mode in ("phrase", "phrase_right"):
            body = f'"{node.text}"' + ("*" if node.mode == "phrase_right" else "")
        elif node.mode == "left":
            body = f"*{node.text}"
        elif node.mode == "infix":
            body = f"*{node.text}*"
        else:
            body += mark.get(node.mode, "")
        if node.free:
            body += "$"
        if node.weight != 1:
            body += f":{node.weight:g}"
        return (f"{node.field}{node.relation or '/'}" if node.field else "") + body
    op = node.op + (f":{node.arg:g}" if isinstance(node.arg, (int, float)) else f":{node.arg}" if node.arg is not None else "")
    if isinstance(node, Unary):
        return f"{to_rpn(node.child)} {op}"
    return f"{to_rpn(node.left)} {to_rpn(node.right)} {op}"


def to_json(node: Node) -> dict:
    d = {"kind": type(node).__name__}
    for k, v in asdict(node).items() if isinstance(node, Term) else [(k, getattr(node, k)) for k in node.__dataclass_fields__]:
        d[k] = to_json(v) if isinstance(v, Node) else v
    return d


def from_json(d: dict) -> Node:
    cls = {"Term": Term, "Unary": Unary, "Binary": Binary}[d["kind"]]
    return cls(**{k: from_json(v) if isinstance(v, dict) and "kind" in v else v for k, v in d.items() if k != "kind"})


def weighted(node: Node, w: float) -> Node:
    """A tree whose scores are w times as large."""
    if isinstance(node, Term):
        return replace(node, weight=node.weight * w)
    return Unary("BOOST", node, w)
