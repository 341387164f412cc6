"""Peers, schemas, relations, mappings and trust, as plain Python values."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, DataType, DateType, DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampNTZType

from ..functions.skolem import SUFFIX
from .compile import Head
from .rules import Tgd


class UnsupportedType(ValueError):
    """A field type outside the eight that the data model has."""


def spark_type(name: str) -> DataType:
    """The Spark type of a declared one, e.g. ``VARCHAR(10)`` or ``INT``."""
    base = name.strip().upper().split("(")[0].strip()
    by = {"INT": IntegerType(), "INTEGER": IntegerType(), "BIGINT": LongType(), "LONG": LongType(), "DOUBLE": DoubleType(), "CHAR": StringType(), "VARCHAR": StringType(), "CLOB": StringType(), "STRING": StringType(), "BOOL": BooleanType(), "BOOLEAN": BooleanType(), "DATE": DateType(), "TIMESTAMP": TimestampNTZType()}
    if base not in by:
        raise UnsupportedType(name)
    return by[base]


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    key: bool = False
    nullable: bool = True
    labeled: bool = True


@dataclass(frozen=True)
class Relation:
    """A relation ``peer.schema.name`` with ordered fields."""

    peer: str
    schema: str
    name: str
    fields: tuple[Field, ...]

    @property
    def full(self) -> str:
        return f"{self.peer}.{self.schema}.{self.name}"

    @property
    def keys(self) -> tuple[str, ...]:
        return tuple(f.name for f in self.fields if f.key)

    def head(self, labeled: frozenset[str] | None = None) -> Head:
        own = frozenset(f.name for f in self.fields if f.labeled) if labeled is None else labeled
        return Head(tuple(f.name for f in self.fields), own, {f.name: spark_type(f.type).simpleString() for f in self.fields})

    def struct(self, labeled: frozenset[str] | None = None) -> StructType:
        own = frozenset(f.name for f in self.fields if f.labeled) if labeled is None else labeled
        out = []
        for f in self.fields:
            out.append(StructField(f.name, spark_type(f.type), True))
            if f.name in own:
                out.append(StructField(f.name + SUFFIX, StringType(), True))
        return StructType(out)


@dataclass(frozen=True)
class TrustCondition:
    """``peer`` trusts updates of ``origin`` to ``relation`` at ``priority`` where ``predicate`` holds."""

    peer: str
    relation: str
    origin: str
    priority: int
    predicate: str | None = None

    MAX = 100_000
    OWN = 100_001

    def __post_init__(self):
        if not 1 <= self.priority <= self.MAX:
            raise ValueError(f"priority {self.priority} is not within 1..{self.MAX}")


@dataclass
class System:
    """Everything a catalog declares."""

    name: str = ""
    relations: dict[str, Relation] = field(default_factory=dict)
    mappings: list[Tgd] = field(default_factory=list)
    trust: list[TrustCondition] = field(default_factory=list)
    #: Relations that are views only: mappings through them are composed away.
    virtual: set[str] = field(default_factory=set)

    def add(self, relation: Relation) -> Relation:
        if relation.full in self.relations:
            raise ValueError(f"{relation.full} is declared twice")
        self.relations[relation.full] = relation
        return relation

    def find(self, name: str) -> Relation:
        """By full name or an unambiguous suffix of it."""
        if name in self.relations:
            return self.relations[name]
        found = [r for full, r in self.relations.items() if full.endswith("." + name)]
        if len(found) != 1:
            raise KeyError(f"{'ambiguous' if found else 'unknown'} relation {name}")
        return found[0]

    def peers(self) -> list[str]:
        return sorted({r.peer for r in self.relations.values()})


def aligned(df: DataFrame, struct: StructType) -> DataFrame:
    """``df`` with exactly the columns of ``struct``; missing companions are null."""
    from pyspark.sql import functions as F

    return df.select(*[(F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in struct.fields])
