"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

CHECKPOINT_KEY = "spark.checkpoint.dir"
#: Only where the session names no shared folder and runs on this machine alone.
LOCAL_CHECKPOINT = "file:///tmp/rillmesh-checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, as the session names it."""
    named = spark.conf.get(CHECKPOINT_KEY, None)
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
        named = LOCAL_CHECKPOINT
    return named.rstrip("/")


@dataclass
class Stored:
    """A relation as a growing list of immutable Parquet folders.

    Appending never touches earlier parts and reading is one scan over the listed folders, so
    the plan of a fixpoint's accumulator stays flat however many rounds it takes.
    """

    spark: SparkSession
    schema: StructType
    parts: list[str] = field(default_factory=list)

    @classmethod
    def of(cls, df: DataFrame, tag: str = "rel") -> Stored:
        stored = cls(df.sparkSession, df.schema)
        stored.parts.append(write(df, tag))
        return stored

    @classmethod
    def empty(cls, spark: SparkSession, schema: StructType) -> Stored:
        return cls(spark, schema)

    def df(self) -> DataFrame:
        if not self.parts:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*self.parts)

    def plus(self, other: Stored) -> Stored:
        return Stored(self.spark, self.schema, [*self.parts, *other.parts])

    def bytes(self) -> int:
        """Size of the files, from the file system's metadata."""
        conf, total = self.spark._jsc.hadoopConfiguration(), 0
        for part in self.parts:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(part)
            total += path.getFileSystem(conf).getContentSummary(path).getLength()
        return total

    def is_empty(self) -> bool:
        """Whether no part has a row: read from file footers, up to the first that has one, so a
        fixpoint's test for "nothing new" costs no job."""
        conf = self.spark._jsc.hadoopConfiguration()
        jvm = self.spark._jvm
        for part in self.parts:
            folder = jvm.org.apache.hadoop.fs.Path(part)
            for status in folder.getFileSystem(conf).listStatus(folder):
                if not status.getPath().getName().startswith("part-"):
                    continue
                source = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromStatus(status, conf)
                reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source)
                try:
                    if reader.getRecordCount() > 0:
                        return False
                finally:
                    reader.close()
        return True


def run_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark)}/rillmesh-{spark.sparkContext.applicationId}"


def write(df: DataFrame, tag: str = "rel") -> str:
    """Writes ``df`` to a fresh folder and returns its path."""
    path = f"{run_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def clear(spark: SparkSession) -> None:
    """Deletes all intermediate tables of this application; DataFrames over them go stale."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
