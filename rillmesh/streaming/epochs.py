"""An epoch log of published updates, and a stream over it.

Publishing appends one Parquet folder per epoch; a folder appears by rename when it is
complete, so readers see whole epochs only.  ``follow`` turns new epochs into micro-batches.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


class EpochLog:
    """Update batches below ``root``, numbered from 1; ``schema`` is what an empty log reads as."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType | str | None = None):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)
        self._fs.mkdirs(self._path(f"{self.root}/log"))

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def last(self) -> int:
        """The latest epoch, 0 before the first."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/log"))]
        return max((int(n[6:]) for n in names if n.startswith("epoch=")), default=0)

    def publish(self, updates: DataFrame, retries: int = 8) -> int:
        """Appends ``updates`` as the next epoch and returns its number.

        The rename never overwrites nor moves into a folder that is there, so of two writers one gets the
        number and the other takes the next (on file systems whose rename is atomic)."""
        aside = f"{self.root}/pending/{uuid.uuid4().hex}"
        updates.write.parquet(aside)
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        for _ in range(retries):
            n = self.last() + 1
            final = self._path(f"{self.root}/log/epoch={n:010d}")
            try:
                context.rename(self._path(aside), final, none)
                return n
            except Exception:
                if not self._fs.exists(final):
                    raise
        raise RuntimeError("no epoch could be taken")

    def read(self, after: int = 0, upto: int | None = None) -> DataFrame:
        """Updates of epochs in (after, upto]; the folder name prunes the scan."""
        if not self.last():
            if self.schema is None:
                raise ValueError("nothing is published, and the log was opened without a schema")
            empty = self.spark.createDataFrame([], self.schema)
            return empty if "epoch" in empty.columns else empty.withColumn("epoch", F.lit(None).cast("int"))
        df = self.spark.read.option("basePath", f"{self.root}/log").parquet(f"{self.root}/log")
        df = df.where(F.col("epoch") > after)
        return df.where(F.col("epoch") <= upto) if upto is not None else df

    def follow(self, step: Callable[[DataFrame, int], None], checkpoint: str, schema) -> StreamingQuery:
        """Runs ``step`` on what has been published since the last run, then stops."""
        stream = self.spark.readStream.schema(schema).option("basePath", f"{self.root}/log").parquet(f"{self.root}/log/*")
        return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dump(tables: dict[str, DataFrame], folder: str) -> None:
    """All tables as Parquet below ``folder``."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}")


def restore(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder.rstrip('/')}/{n}") for n in names}
