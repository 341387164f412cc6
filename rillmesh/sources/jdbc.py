"""Relations in other databases, through Spark's JDBC source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.catalog import Field, Relation


def read(spark: SparkSession, url: str, table: str, partition_column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 16, **options: str) -> DataFrame:
    """A table; with a numeric column and its bounds it is read in parallel ranges."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if partition_column and bounds:
        reader = reader.option("partitionColumn", partition_column).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", partitions)
    return reader.load()


def write(df: DataFrame, url: str, table: str, replace: bool = False, **options: str) -> None:
    df.write.format("jdbc").option("url", url).option("dbtable", table).options(**options).mode("overwrite" if replace else "append").save()


def relation(spark: SparkSession, url: str, table: str, peer: str, schema: str, **options: str) -> Relation:
    """A relation declared by the table's own columns."""
    kinds = {"int": "INT", "bigint": "LONG", "double": "DOUBLE", "boolean": "BOOL", "date": "DATE", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP"}
    df = read(spark, url, table, **options)
    return Relation(peer, schema, table, tuple(Field(n, kinds.get(k, "VARCHAR")) for n, k in df.dtypes))
