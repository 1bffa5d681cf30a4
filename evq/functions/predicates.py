"""Conditions as Columns.

The language has two truth values: comparing a missing field is false, and its
negation true. In a WHERE, null counts as false, so a condition that isn't
negated needs no care. Negations are pushed down to the comparisons, and a
negated comparison becomes ``field IS NULL OR NOT comparison``; that form still
reaches the files as a pushed filter, as ``coalesce`` would not.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from evq.functions import scalars

#: Predicates are plain data: {"op": and/or, "args"}, {"op": not, "arg"}, or
#: {"op": cmp, "cmp": ==, ..., in, cidr, "field", "type", "value"}.
Predicate = dict[str, Any]


def _literal(value: Any, kind: str) -> Column:
    return F.lit(scalars.parse_time(value)).cast("timestamp_ntz") if kind == "time" else F.lit(value)


def _fits(value: Any, kind: str) -> bool:
    """Type-strict: a value of another type equals nothing."""
    if kind == "int":
        return isinstance(value, int) and not isinstance(value, bool)
    return isinstance(value, bool) if kind == "bool" else isinstance(value, str)


def _leaf(p: Predicate, c: Column) -> Column:
    """A comparison where the field is present; null where it is missing, but for tests of null themselves."""
    op, value, kind = p["cmp"], p["value"], p["type"]
    if op in ("==", "!=") and value is None:
        return c.isNull() if op == "==" else c.isNotNull()
    if op == "in":
        found = [_literal(v, kind) for v in value if _fits(v, kind)]
        return c.isin(found) if found else F.lit(False)
    if op == "cidr":
        return scalars.in_cidr(c, value) if kind == "ip" else F.lit(False)
    if not _fits(value, kind):
        # another type is never equal, so it is unequal wherever the field is present
        return c.isNotNull() if op == "!=" else F.lit(False)
    if op in ("contains", "startswith", "endswith", "like"):
        folded, text = scalars.ascii_lower(c), scalars.ascii_fold(value)
        return folded.like(scalars.glob_to_like(text)) if op == "like" else getattr(folded, op)(F.lit(text))
    right = _literal(value, kind)
    return {"==": c.__eq__, "!=": c.__ne__, "<": c.__lt__, "<=": c.__le__, ">": c.__gt__, ">=": c.__ge__}[op](right)


def to_column(p: Predicate, resolve: Callable[[str], Column], negated: bool = False) -> Column:
    """The condition for a WHERE; ``resolve`` gives the column of a field."""
    op = p["op"]
    if op == "not":
        return to_column(p["arg"], resolve, not negated)
    if op in ("and", "or"):
        parts = [to_column(x, resolve, negated) for x in p["args"]]
        out = parts[0]
        for part in parts[1:]:
            out = out & part if (op == "and") != negated else out | part
        return out
    c = resolve(p["field"])
    if not negated:
        return _leaf(p, c)
    if p["value"] is None:
        return c.isNotNull() if p["cmp"] == "==" else c.isNull()
    leaf = _leaf(p, c)
    if p["cmp"] == "cidr":  # a text that is no address of the family is in no block
        return ~F.coalesce(leaf, F.lit(False))
    return c.isNull() | ~leaf


def fields_of(p: Predicate | None) -> set[str]:
    if p is None:
        return set()
    if p["op"] == "cmp":
        return {p["field"]}
    return set().union(*(fields_of(x) for x in p.get("args", [p.get("arg")])))


def conjuncts(p: Predicate) -> list[Predicate]:
    return [x for a in p["args"] for x in conjuncts(a)] if p["op"] == "and" else [p]


def conjunction(parts: list[Predicate]) -> Predicate | None:
    return None if not parts else parts[0] if len(parts) == 1 else {"op": "and", "args": parts}


def renamed(p: Predicate, change: Callable[[str], str]) -> Predicate:
    if p["op"] == "cmp":
        return p | {"field": change(p["field"])}
    return p | ({"arg": renamed(p["arg"], change)} if p["op"] == "not" else {"args": [renamed(x, change) for x in p["args"]]})
