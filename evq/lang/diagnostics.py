"""Findings of the compiler about a program."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Span:
    """Where a piece of source stands; lines and columns count from 1."""

    line: int
    column: int
    length: int = 1


@dataclass(frozen=True)
class Diagnostic:
    severity: str  # error, warning
    code: str
    message: str
    span: Span | None = None
    hint: str | None = None

    def render(self, source: str = "", filename: str = "<program>") -> str:
        place = f"{filename}:{self.span.line}:{self.span.column}: " if self.span else f"{filename}: "
        out = [f"{place}{self.severity} {self.code}: {self.message}"]
        lines = source.splitlines()
        if self.span and 0 < self.span.line <= len(lines):
            out += [f"  {lines[self.span.line - 1]}", "  " + " " * (self.span.column - 1) + "^" * max(1, self.span.length)]
        if self.hint:
            out.append(f"  hint: {self.hint}")
        return "\n".join(out)

    def to_json(self) -> dict:
        at = {"line": self.span.line, "column": self.span.column, "length": self.span.length} if self.span else None
        return {"severity": self.severity, "code": self.code, "message": self.message, "span": at, "hint": self.hint}


class CompileError(Exception):
    """A program that can't be compiled, with all diagnostics found."""

    def __init__(self, diagnostics: list[Diagnostic]):
        super().__init__("; ".join(f"{d.code}: {d.message}" for d in diagnostics))
        self.diagnostics = diagnostics

    @property
    def errors(self) -> list[Diagnostic]:
        return [d for d in self.diagnostics if d.severity == "error"]

    def render(self, source: str = "", filename: str = "<program>") -> str:
        return "\n".join(d.render(source, filename) for d in self.diagnostics)
