"""Programs from Python, to the same syntax nodes as from text.

    proc = observe("Process").filter(field("name").in_("powershell.exe", "pwsh")).select("pid", "name")
    net = observe("NetworkConnection").filter(~field("remote_ip").in_cidr("10.0.0.0/8"))
    program = investigation("x", window=last("30d"), proc=proc, net=net,
                            pair=sequence(["proc", "net"], on=["host", "pid"], within="20m"),
                            outputs=[emit("pair", severity="high"), preserve("pair")])
"""

from __future__ import annotations

import re
from typing import Any

from evq.lang import nodes as n
from evq.lang.parser import UNITS


def seconds(text: str | int) -> n.Duration:
    if isinstance(text, int):
        return n.Duration(text)
    found = re.fullmatch(r"([0-9]+)([smhd])", text)
    if not found:
        raise ValueError(f"'{text}' is no duration; write a number and s, m, h or d")
    return n.Duration(int(found[1]) * UNITS[found[2]])


def _ref(text: str) -> n.FieldRef:
    alias, _, name = text.rpartition(".")
    return n.FieldRef(alias or None, name)


def _literal(value: Any) -> n.Literal:
    kind = {bool: "bool", int: "int", str: "str", type(None): "null"}.get(type(value))
    if kind is None:
        raise TypeError(f"{value!r} is no literal of the language")
    return n.Literal(kind, value)


class Condition:
    def __init__(self, node: Any):
        self.node = node

    def __and__(self, other: Condition) -> Condition:
        return Condition(n.And([self.node, other.node]))

    def __or__(self, other: Condition) -> Condition:
        return Condition(n.Or([self.node, other.node]))

    def __invert__(self) -> Condition:
        return Condition(n.Not(self.node))


class field:  # noqa: N801
    """A field in a condition."""

    def __init__(self, name: str):
        self.ref = _ref(name)

    def _compare(self, op: str, value: Any) -> Condition:
        return Condition(n.Compare(op, self.ref, _literal(value)))

    def __eq__(self, value: Any) -> Condition:  # type: ignore[override]
        return self._compare("==", value)

    def __ne__(self, value: Any) -> Condition:  # type: ignore[override]
        return self._compare("!=", value)

    def __lt__(self, value: Any) -> Condition:
        return self._compare("<", value)

    def __le__(self, value: Any) -> Condition:
        return self._compare("<=", value)

    def __gt__(self, value: Any) -> Condition:
        return self._compare(">", value)

    def __ge__(self, value: Any) -> Condition:
        return self._compare(">=", value)

    __hash__ = None  # type: ignore[assignment]

    def contains(self, text: str) -> Condition:
        return self._compare("contains", text)

    def startswith(self, text: str) -> Condition:
        return self._compare("startswith", text)

    def endswith(self, text: str) -> Condition:
        return self._compare("endswith", text)

    def like(self, glob: str) -> Condition:
        return self._compare("like", glob)

    def in_(self, *values: Any) -> Condition:
        return Condition(n.InList(self.ref, [_literal(v) for v in values]))

    def in_cidr(self, block: str) -> Condition:
        return Condition(n.InCidr(self.ref, _literal(block)))


class Stages:
    def __init__(self, source: Any, stages: tuple = ()):
        self.source, self.stages = source, stages

    def _with(self, stage: Any) -> Stages:
        return Stages(self.source, (*self.stages, stage))

    def filter(self, condition: Condition) -> Stages:
        return self._with(n.Filter(condition.node))

    def select(self, *fields: str) -> Stages:
        return self._with(n.Select([_ref(f) for f in fields]))

    def within(self, duration: str | int) -> Stages:
        return self._with(n.Within(seconds(duration)))


def observe(entity: str) -> Stages:
    return Stages(n.Observe(entity))


def binding(name: str) -> Stages:
    return Stages(n.Ref(name))


def join(inputs: list[str], on: list[str], within: str | int | None = None) -> Stages:
    return Stages(n.Join([n.Ref(x) for x in inputs], [_ref(k) for k in on], None if within is None else seconds(within)))


def sequence(steps: list[str], on: list[str], within: str | int) -> Stages:
    return Stages(n.Sequence([n.Ref(x) for x in steps], [_ref(k) for k in on], seconds(within)))


def emit(name: str, title: str | None = None, severity: str = "medium") -> n.Emit:
    return n.Emit(n.Ref(name), title, severity)


def preserve(name: str, content: bool = False) -> n.Preserve:
    return n.Preserve(n.Ref(name), content)


def last(duration: str | int) -> n.Window:
    return n.Window(last=seconds(duration))


def between(start: str, end: str) -> n.Window:
    return n.Window(start=start, end=end)


def investigation(name: str, *, window: n.Window | None = None, targets: list[str] | None = None, title: str | None = None, outputs: list[Any], **bindings: Stages) -> n.Investigation:
    """Bindings stand in the order given."""
    statements = [n.Let(k, n.Pipeline(s.source, list(s.stages))) for k, s in bindings.items()]
    return n.Investigation(name, title, None if targets is None else [n.Name(t) for t in targets], window, [*statements, *outputs])
