"""Queries built by method calls: each set is a tree, compiled when a DataFrame is asked for.

    s = Session(db)
    s.term("alpha").near(s.term("beta"), 20).within("TITLE").boost(2).top(10, "date")
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..sources.database import Database
from .ast import Binary, Node, Term, Unary, to_rpn
from .engine import Engine
from .parser import parse


class Session:
    """Sets over one database with one engine's options."""

    def __init__(self, db: Database, **options):
        self.engine = Engine(db, **options)

    def term(self, text: str, mode: str = "exact", field: str | None = None, weight: float = 1.0) -> ResultSet:
        return ResultSet(self.engine, Term(text, mode, field and field.upper(), None, weight))

    def where(self, field: str, relation: str, value) -> ResultSet:
        """A typed predicate."""
        return ResultSet(self.engine, Term(str(value), "typed", field.upper(), relation))

    def query(self, text: str) -> ResultSet:
        return ResultSet(self.engine, parse(text, self.engine.compat))


@dataclass(frozen=True)
class ResultSet:
    engine: Engine
    node: Node

    def _unary(self, op: str, arg=None) -> ResultSet:
        return ResultSet(self.engine, Unary(op, self.node, arg))

    def _binary(self, op: str, other: ResultSet, arg=None) -> ResultSet:
        return ResultSet(self.engine, Binary(op, self.node, other.node, arg))

    def __or__(self, other):
        return self._binary("OR", other)

    def __and__(self, other):
        return self._binary("AND", other)

    def __sub__(self, other):
        return self._binary("ANDNOT", other)

    def __xor__(self, other):
        return self._binary("XOR", other)

    def __invert__(self):
        return self._unary("NOT")

    def near(self, other, most: float | None = None):
        """Within so many bytes (below 1: a share of the record), or in one container."""
        return self._binary("NEAR", other, most)

    def before(self, other, most: float | None = None):
        return self._binary("BEFORE", other, most)

    def after(self, other, most: float | None = None):
        return self._binary("AFTER", other, most)

    def within(self, field: str):
        return self._unary("WITHIN", field)

    def without(self, field: str):
        return self._unary("XWITHIN", field)

    def inclusive(self, field: str):
        return self._unary("INCLUSIVE", field)

    def inside(self, field: str):
        return self._unary("INSIDE", field)

    def sibling(self, field: str | None = None):
        return self._unary("SIBLING", field)

    def both_in(self, other, field: str):
        return self._binary("ANDFIELD", other, field.upper())

    def with_key(self, glob: str):
        return self._unary("WITHKEY", glob)

    def in_file(self, glob: str):
        return self._unary("FILE", glob)

    def of_doctype(self, name: str):
        return self._unary("DOCTYPE", name)

    def reduce(self, n: int = 0):
        return self._unary("REDUCE", n)

    def trim(self, n: float):
        return self._unary("TRIM", n)

    def hit_count(self, n: int):
        return self._unary("HITCOUNT", n)

    def boost(self, weight: float):
        return self._unary("BOOST", weight)

    def __getattr__(self, name: str):
        """The other operators on pairs by their names: nor, nand, xnor, far, adj, follows, precedes, neighbor, peer, peera, peerb, xpeer, join."""
        if name.upper() not in ("NOR", "NAND", "XNOR", "FAR", "ADJ", "FOLLOWS", "PRECEDES", "NEIGHBOR", "PEER", "PEERA", "PEERB", "XPEER", "JOIN", "NOTAND"):
            raise AttributeError(name)
        return lambda other: self._binary(name.upper(), other)

    @property
    def rpn(self) -> str:
        return to_rpn(self.node)

    def frame(self) -> DataFrame:
        return self.engine.run(self.node)

    def top(self, limit: int, sort: str = "score", offset: int = 0) -> DataFrame:
        return self.engine.search(self.node, sort, limit, offset)
