"""The five entities, and the tables that hold their records."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: host and time belong to every entity.
ENVELOPE = ("host", "time")
SPARK_TYPES = {"str": T.StringType(), "int": T.LongType(), "time": T.TimestampNTZType(), "ip": T.StringType(), "bool": T.BooleanType()}


@dataclass(frozen=True)
class Entity:
    name: str
    capability: str
    fields: dict[str, str]
    natural_key: tuple[str, ...]
    #: Fields that need a privilege of their own.
    gated: dict[str, str] = field(default_factory=dict)

    @property
    def schema(self) -> dict[str, str]:
        """All addressable fields with their types."""
        return {"host": "str", "time": "time", **self.fields}


def _fields(text: str) -> dict[str, str]:
    return {name: kind or "str" for name, _, kind in (x.partition(":") for x in text.split())}


# Field names, types, keys and privileges of the data model.
ENTITIES = {
    e.name: e
    for e in (
        Entity("Process", "collect:process", _fields("pid:int ppid:int name path cmdline user"), ("host", "pid", "time"), {"cmdline": "collect:process.cmdline"}),
        Entity("File", "collect:file", _fields("pid:int path name extension size:int action attribution sha256"), ("host", "path", "time", "pid"), {"sha256": "collect:file.hash"}),
        Entity(
            "NetworkConnection", "collect:network", _fields("pid:int protocol direction state local_ip:ip local_port:int remote_ip:ip remote_port:int"),
            ("host", "pid", "protocol", "local_ip", "local_port", "remote_ip", "remote_port", "time"),
        ),
        Entity("User", "collect:user", _fields("name uid domain home"), ("host", "name", "uid")),
        Entity("Event", "collect:event", _fields("channel provider event_id:int record_id:int level pid:int message"), ("host", "channel", "provider", "event_id", "record_id", "time")),
    )
}


def schema(entity: str) -> T.StructType:
    return T.StructType([T.StructField(name, SPARK_TYPES[kind]) for name, kind in ENTITIES[entity].schema.items()])


#: Columns that a table may have besides its fields: what comes first wins among records of one natural key.
ORDER = ("_source", "_row")
#: Envelope columns that a table may have; the others get defaults.
LABELS = ("time_source", "observed_at", "collector", "collector_version", "source")


class Catalog:
    """Entities as normalised tables: host, time and the entity's fields, typed as in ``schema``."""

    def __init__(self, tables: dict[str, DataFrame] | None = None, name: str = "catalog", reference_time: str | None = None):
        self.tables: dict[str, DataFrame] = {}
        self.name = name
        self.reference_time = reference_time
        for entity, df in (tables or {}).items():
            self.register(entity, df)

    def register(self, entity: str, df: DataFrame) -> None:
        """Use ``df`` for an entity. Missing fields are null; rows without a time are left out; other columns are ignored."""
        if entity not in ENTITIES:
            raise ValueError(f"unknown entity type '{entity}'; there are {', '.join(ENTITIES)}")
        missing = {"host", "time"} - set(df.columns)
        if missing:
            raise ValueError(f"{entity} needs the columns {', '.join(sorted(missing))}")
        columns = [
            (F.col(name).cast(SPARK_TYPES[kind]) if name in df.columns else F.lit(None).cast(SPARK_TYPES[kind])).alias(name)
            for name, kind in ENTITIES[entity].schema.items()
        ]
        extra = [c for c in (*ORDER, *LABELS) if c in df.columns]
        self.tables[entity] = df.select(*columns, *extra).where(F.col("time").isNotNull())

    def table(self, entity: str) -> DataFrame:
        try:
            return self.tables[entity]
        except KeyError:
            raise LookupError(f"the catalog has no table for {entity}") from None
