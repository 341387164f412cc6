"""Labeled nulls: a companion column with a deterministic label.

A labeled-nullable column ``c`` has a companion ``c_LN`` (string).  A null companion says that
``c`` is an ordinary value (or SQL null); otherwise ``c`` is null and the companion names
the labeled null.  A label is a hash of a Skolem function's name and arguments, so equal
firings give equal labels on any executor, in any order, without a service.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SUFFIX = "_LN"


def label(function: str, args: list[tuple[Column, Column | None]]) -> Column:
    """The label of ``function(args)``; every argument is tagged and length-prefixed, so
    neither nulls nor joined strings can collide."""
    parts: list[Column] = [F.lit(function)]
    for value, companion in args:
        text = value.cast("string")
        own = F.when(text.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.length(text), F.lit(":"), text))
        parts.append(own if companion is None else F.when(companion.isNull(), own).otherwise(F.concat(F.lit("l"), F.length(companion), F.lit(":"), companion)))
    return F.sha2(F.concat_ws("|", *parts), 256)
