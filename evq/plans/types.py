"""What a binding holds: records of one entity, or chains of records."""

from __future__ import annotations

from dataclasses import dataclass, field

from evq.catalog import ENTITIES


@dataclass(frozen=True)
class EvidenceType:
    entity: str
    #: Field: type, host and time included.
    schema: dict[str, str]
    #: Nodes of the observations that this comes from.
    lineage: tuple[str, ...] = ()

    def render(self) -> str:
        return f"Evidence<{self.entity}>"

    @property
    def inner(self) -> str:
        return self.entity

    shape = "Evidence"


@dataclass(frozen=True)
class DerivedType:
    shape: str  # Join, Sequence
    aliases: tuple[str, ...]
    entities: tuple[str, ...]
    #: alias.field: type.
    schema: dict[str, str]
    lineage: tuple[str, ...] = field(default=())

    @property
    def inner(self) -> str:
        return f"{self.shape}<{', '.join(self.entities)}>"

    def render(self) -> str:
        return f"Derived<{self.inner}>"


def observed(entity: str, node: str) -> EvidenceType:
    return EvidenceType(entity, ENTITIES[entity].schema, (node,))


def correlated(shape: str, aliases: list[str], inputs: list[EvidenceType]) -> DerivedType:
    schema = {f"{a}.{f}": kind for a, t in zip(aliases, inputs) for f, kind in t.schema.items()}
    lineage = dict.fromkeys(x for t in inputs for x in t.lineage)
    return DerivedType(shape, tuple(aliases), tuple(t.entity for t in inputs), schema, tuple(lineage))
