"""Local update capture: what changed since the last snapshot, and where it goes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..plans.compile import minus, within


def changes(now: DataFrame, before: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(inserted, deleted) rows between two snapshots, as sets; a modification is one of each."""
    return now.subtract(before), before.subtract(now)


@dataclass
class LocalUpdates:
    """Changes to a relation's local contributions and rejections."""

    local_ins: DataFrame
    local_del: DataFrame
    reject_ins: DataFrame
    reject_del: DataFrame


def routed(inserted: DataFrame, deleted: DataFrame, local: DataFrame, rejected: DataFrame, derivable: DataFrame) -> LocalUpdates:
    """Inserted rows become local, and stop being rejected; deleted rows leave the local
    ones if they are there, and are rejected if a mapping derives them."""
    return LocalUpdates(inserted, within(deleted, local), within(deleted, derivable), within(inserted, rejected))


def net(inserted: DataFrame, deleted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Insertions and deletions of one batch without those that cancel out."""
    return minus(inserted, deleted), minus(deleted, inserted)
