"""Access-support relations: joins of mapping (provenance) relations kept for reuse.

``inner`` keeps the natural join of a path of relations; ``real`` outer joins keep maximal rows
only (a shorter path's row appears if no longer one extends it), which is what Spark's outer
joins give; ``simulated`` ones keep every subpath's rows padded with nulls, which makes them
maintainable by appending.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _pair(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    shared = [c for c in left.columns if c in right.columns]
    if not shared:
        raise ValueError("relations of a path share a column")
    return left.join(right, shared, how)


def inner(frames: list[DataFrame]) -> DataFrame:
    """Natural join of all relations, in order."""
    return reduce(lambda a, b: _pair(a, b, "inner"), frames).distinct()


def real(frames: list[DataFrame], how: str) -> DataFrame:
    """Left, right or full outer natural join of all relations."""
    if how not in ("left", "right", "full"):
        raise ValueError(how)
    return reduce(lambda a, b: _pair(a, b, how), frames).distinct()


def simulated(frames: list[DataFrame], how: str) -> DataFrame:
    """Union of the inner joins of all contiguous subpaths of two or more relations: those that
    start at the first (left), end at the last (right), or any (full)."""
    n = len(frames)
    spans = [(i, j) for i in range(n) for j in range(i + 2, n + 1) if (how == "full" or (how == "left" and i == 0) or (how == "right" and j == n))]
    columns = list(dict.fromkeys(c for f in frames for c in f.columns))
    kinds = {c: f.schema[c].dataType for f in reversed(frames) for c in f.columns}
    parts = []
    for i, j in spans:
        joined = inner(frames[i:j])
        parts.append(joined.select(*[(F.col(c) if c in joined.columns else F.lit(None).cast(kinds[c])).alias(c) for c in columns]))
    return reduce(DataFrame.unionByName, parts).distinct()


def rewrite(atoms: list[str], stored: dict[str, list[str]]) -> list[str]:
    """Atoms of a rule with stored joins in place of the relations they cover: the longest stored
    join that fits first, each relation covered once."""
    left = list(atoms)
    used = []
    for name, covers in sorted(stored.items(), key=lambda x: (-len(x[1]), x[0])):
        if all(left.count(c) >= covers.count(c) for c in covers):
            for c in covers:
                left.remove(c)
            used.append(name)
    return used + left
