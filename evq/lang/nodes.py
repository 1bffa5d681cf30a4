"""Syntax of a program, as dataclasses; the Python builder makes the same nodes."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any

from evq.lang.diagnostics import Span


@dataclass
class Name:
    text: str
    span: Span | None = None


@dataclass
class FieldRef:
    """``field``, or ``alias.field`` on a correlation."""

    alias: str | None
    name: str
    span: Span | None = None

    @property
    def text(self) -> str:
        return f"{self.alias}.{self.name}" if self.alias else self.name


@dataclass
class Duration:
    seconds: int
    span: Span | None = None


@dataclass
class Literal:
    kind: str  # str, int, bool, null
    value: Any
    span: Span | None = None


@dataclass
class Compare:
    op: str  # == != < <= > >= contains startswith endswith like
    field: FieldRef
    value: Literal
    span: Span | None = None


@dataclass
class InList:
    field: FieldRef
    values: list[Literal]
    span: Span | None = None


@dataclass
class InCidr:
    field: FieldRef
    block: Literal
    span: Span | None = None


@dataclass
class Not:
    arg: Any
    span: Span | None = None


@dataclass
class And:
    args: list[Any]
    span: Span | None = None


@dataclass
class Or:
    args: list[Any]
    span: Span | None = None


@dataclass
class Observe:
    entity: str
    span: Span | None = None


@dataclass
class Ref:
    name: str
    span: Span | None = None


@dataclass
class Join:
    inputs: list[Ref]
    keys: list[FieldRef]
    within: Duration | None = None
    span: Span | None = None


@dataclass
class Sequence:
    steps: list[Ref]
    keys: list[FieldRef]
    within: Duration | None = None
    span: Span | None = None


@dataclass
class Filter:
    predicate: Any
    span: Span | None = None


@dataclass
class Select:
    fields: list[FieldRef]
    span: Span | None = None


@dataclass
class Within:
    duration: Duration
    span: Span | None = None


@dataclass
class Pipeline:
    source: Any
    stages: list[Any] = field(default_factory=list)


@dataclass
class Let:
    name: str
    pipeline: Pipeline
    span: Span | None = None


@dataclass
class Preserve:
    target: Ref
    content: bool = False
    span: Span | None = None


@dataclass
class Emit:
    target: Ref
    title: str | None = None
    severity: str = "medium"
    span: Span | None = None


@dataclass
class Window:
    """Either ``last``, or ``start`` and ``end`` as written."""

    last: Duration | None = None
    start: str | None = None
    end: str | None = None
    span: Span | None = None


@dataclass
class Investigation:
    name: str
    title: str | None = None
    targets: list[Name] | None = None
    window: Window | None = None
    statements: list[Any] = field(default_factory=list)
    span: Span | None = None


def to_json(node: Any) -> Any:
    """A node as plain data, each dataclass with its kind."""
    if is_dataclass(node) and not isinstance(node, type):
        return {"kind": type(node).__name__, **{f.name: to_json(getattr(node, f.name)) for f in fields(node)}}
    if isinstance(node, list):
        return [to_json(x) for x in node]
    return node
