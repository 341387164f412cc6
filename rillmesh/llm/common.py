"""Helpers shared by the training-data operators.

Everything here is about placement rather than semantics: where intermediate
tables go, how many rows cross into Python at a time, and how a document id is
reduced to a reproducible fold.
"""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import run_dir, write

#: Rows per Arrow batch.  Texts may be megabytes long, so a batch is kept short.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named input table; the path is only ever handed to Spark's reader."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fresh_dir(spark: SparkSession, tag: str) -> str:
    """A new, unused folder among this application's intermediate tables."""
    return f"{run_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once to the shared folder and read again.

    This cuts the lineage with replicated storage: losing an executor later
    costs a re-read, not a recomputation, and a column used twice is computed
    once.
    """
    return df.sparkSession.read.schema(df.schema).parquet(write(df, tag))


def dropped(df: DataFrame) -> None:
    """Deletes the files behind a table made by :func:`written`."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def short_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bounds what one Arrow batch holds, whatever the length of the texts, and lets Python
    workers on this machine find the package wherever the driver was started (a cluster gets it
    by ``--py-files``)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    root = str(Path(__file__).resolve().parents[2])
    known = [p for p in spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([*known, root])


def refuse(given: list[str], made: list[str]) -> None:
    """Raises if a column that is carried along has the name of one that is made."""
    clash = sorted({c.lower() for c in given} & {c.lower() for c in made})
    if clash:
        raise ValueError(f"columns {clash} would stand twice; rename them first")


def id_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds`` (null id: of empty text)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(folds))
