"""Layouts of provenance relations: one per mapping, one wide union, or joined along paths."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import asr, relational

RULE = "MRULE"


def outer_union(provenance: Mapping[str, DataFrame]) -> DataFrame:
    """All mapping relations in one wide relation; ``MRULE`` names the mapping of a row."""
    return relational.outer_union(dict(provenance), RULE)


def from_outer_union(wide: DataFrame, mapping: str, columns: list[str]) -> DataFrame:
    """One mapping's relation out of the wide one; the filter on MRULE reaches the scan."""
    return wide.where(F.col(RULE) == mapping).select(*columns)


def outer_join(provenance: list[DataFrame], width: int = 3) -> list[DataFrame]:
    """Every ``width`` neighbouring mapping relations as one simulated left outer join."""
    out = []
    for i in range(0, len(provenance), width):
        part = provenance[i : i + width]
        out.append(part[0] if len(part) == 1 else asr.simulated(part, "left"))
    return out
