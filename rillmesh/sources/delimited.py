"""Delimited files, one per relation, named ``<peer>_<schema>_<relation>.<ext>`` in lower case."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.skolem import SUFFIX
from ..plans.catalog import Relation, System, spark_type

SEPARATOR, EXTENSION, ORDINARY = "|", "txt", "1"


def file_name(r: Relation, extension: str = EXTENSION) -> str:
    return f"{r.peer}_{r.schema}_{r.name}.{extension}".lower()


def read(spark: SparkSession, folder: str, relation: Relation, separator: str = SEPARATOR, extension: str = EXTENSION, labels: bool = True) -> DataFrame:
    """Rows of a relation's file.  After the values a file may hold one label per labeled-nullable
    field; 1 says ordinary value and becomes null.  A value that its type can't hold is an error that names it."""
    fields = [StructField(f.name, spark_type(f.type)) for f in relation.fields]
    marked = [f.name for f in relation.fields if f.labeled] if labels else []
    schema = StructType([StructField(f.name, StringType()) for f in fields] + [StructField(n + SUFFIX, StringType()) for n in marked])
    df = spark.read.schema(schema).option("sep", separator).csv(f"{folder.rstrip('/')}/{file_name(relation, extension)}")
    typed = lambda f: F.col(f"`{f.name}`").try_cast(f.dataType)
    wrong = lambda f: F.raise_error(F.concat(F.lit(f"{relation.name}.{f.name} can't hold "), F.col(f"`{f.name}`"))).cast(f.dataType)
    checked = [F.when(F.col(f"`{f.name}`").isNotNull() & typed(f).isNull(), wrong(f)).otherwise(typed(f)).alias(f.name) for f in fields]
    return df.select(*checked, *[F.when(F.col(n + SUFFIX) != ORDINARY, F.col(n + SUFFIX)).alias(n + SUFFIX) for n in marked])


def write(df: DataFrame, folder: str, relation: Relation, separator: str = SEPARATOR, extension: str = EXTENSION) -> None:
    """The relation as delimited part files in a folder of that name."""
    names = [f.name for f in relation.fields]
    marks = [F.coalesce(F.col(f.name + SUFFIX), F.lit(ORDINARY)).alias(f.name + SUFFIX) if f.name + SUFFIX in df.columns else F.lit(ORDINARY).alias(f.name + SUFFIX) for f in relation.fields if f.labeled]
    df.select(*names, *marks).write.mode("overwrite").option("sep", separator).csv(f"{folder.rstrip('/')}/{file_name(relation, extension)}")


def import_all(spark: SparkSession, folder: str, system: System, peer: str | None = None, **options) -> tuple[dict[str, DataFrame], list[str]]:
    """Local rows by relation, and the names of relations without a readable file."""
    found, failed = {}, []
    for full, r in system.relations.items():
        if peer is not None and r.peer != peer:
            continue
        try:
            found[full] = read(spark, folder, r, **options)
        except Exception as error:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(error):
                raise
            failed.append(full)
    return found, failed
