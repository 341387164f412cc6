"""A sharded table with size-tiered compaction and versioned manifests.

Arrivals are appended as small immutable Parquet shards.  A manifest lists the shards that
make up a version; a commit writes the next manifest beside the last and moves it to its
final name, which fails if that version exists, so of two concurrent writers one wins and
the other retries.  Readers follow a manifest and never see half a change.

Compaction puts shards into tiers by the logarithm of their size and merges runs of at least
``fan_in`` neighbours of one tier into files near the target.  Shards that
have reached the target are left alone, so each byte is rewritten about once per tier.
Merging reads whole shards and writes whole files: tasks are filled by size, nothing is
shuffled, and keys play no part, so a hot key cannot unbalance it.

All data steps are DataFrame reads and writes; the driver handles file names and sizes only.
The commit needs a file system whose rename without overwriting is atomic (HDFS, local disks); on a
store that copies to rename, two writers could both succeed, so there one writer at a time must commit.

Defined results: an empty arrival adds no shard; null values, ties and repeated rows are stored as they are, very long
texts too; columns are those of the table's schema by name: others of an arrival are not stored, and a missing one is an
error; rows of any key go to any shard; reading a table without any shard gives no rows of its schema.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common

TARGET_BYTES = 128 << 20
FAN_IN = 4
#: What a shard of an arrival should hold, where the arrival's size is known.
SHARD_BYTES = 16 << 20
#: Upper size of the lowest tier.
BASE_BYTES = 1 << 20


@dataclass(frozen=True)
class Shard:
    path: str  # below the table's folder
    bytes: int
    arrival: int  # version that first held its oldest rows


@dataclass
class Manifest:
    version: int
    schema: str
    shards: list[Shard] = field(default_factory=list)


class CommitConflict(RuntimeError):
    """Another writer has committed this version."""


class ShardedTable:
    """A table below ``root``; every method is a job or a metadata step on the driver."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType | None = None, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN):
        self.spark, self.root, self.target_bytes, self.fan_in = spark, root.rstrip("/"), target_bytes, fan_in
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)
        if self.version() < 0:
            if schema is None:
                raise ValueError("a new table needs a schema")
            self._commit(Manifest(0, schema.json()))

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def version(self) -> int:
        """The latest committed version, -1 if there is none."""
        folder = self._path(f"{self.root}/_manifests")
        if not self._fs.exists(folder):
            return -1
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return max((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), default=-1)

    def manifest(self, version: int | None = None) -> Manifest:
        version = self.version() if version is None else version
        stream = self._fs.open(self._path(f"{self.root}/_manifests/v{version:012d}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        got = json.loads(text)
        return Manifest(got["version"], got["schema"], [Shard(**s) for s in got["shards"]])

    def _commit(self, m: Manifest) -> Manifest:
        """Writes aside, then renames; the rename fails if the version is taken."""
        folder = f"{self.root}/_manifests"
        self._fs.mkdirs(self._path(folder))
        aside, final = self._path(f"{folder}/.{uuid.uuid4().hex}"), self._path(f"{folder}/v{m.version:012d}.json")
        out = self._fs.create(aside, False)
        out.write(bytearray(json.dumps(asdict(m)).encode()))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(aside, final, none)
        except Exception as error:
            self._fs.delete(aside, False)
            if self._fs.exists(final):
                raise CommitConflict(f"version {m.version} exists") from error
            raise
        return m

    def _written(self, df: DataFrame, arrival: int) -> list[Shard]:
        name = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{name}")
        found = []
        for s in self._fs.listStatus(self._path(f"{self.root}/{name}")):
            if s.getPath().getName().startswith("part-"):
                found.append(Shard(f"{name}/{s.getPath().getName()}", s.getLen(), arrival))
        return sorted(found, key=lambda s: s.path)

    def append(self, arrival: DataFrame, expected_bytes: int | None = None, retries: int = 5) -> Manifest:
        """Adds rows as new shards, one per task that wrote any; an expected size merges tasks
        (without a shuffle) so that shards come near ``SHARD_BYTES``."""
        schema = self.schema()
        if expected_bytes is not None:
            arrival = arrival.coalesce(max(1, -(-expected_bytes // SHARD_BYTES)))
        new = self._written(arrival.select(*[F.col(c).cast(schema[c].dataType) for c in schema.names]), self.version() + 1)
        for _ in range(retries):
            now = self.manifest()
            try:
                return self._commit(Manifest(now.version + 1, now.schema, now.shards + new))
            except CommitConflict:
                continue
        raise CommitConflict("gave up")

    def size_of(self, file: str) -> int:
        """Bytes of any file that Spark can read."""
        path = self._path(file)
        return path.getFileSystem(self._conf).getFileStatus(path).getLen()

    def schema(self) -> StructType:
        return StructType.fromJson(json.loads(self.manifest().schema))

    def tier(self, shard: Shard) -> int:
        return 0 if shard.bytes <= BASE_BYTES else 1 + int(math.log(shard.bytes / BASE_BYTES, self.fan_in))

    def runs(self, shards: list[Shard]) -> list[list[Shard]]:
        """Runs to merge: shards of one tier in arrival order, cut near the target size."""
        tiers: dict[int, list[Shard]] = {}
        for s in shards:
            if s.bytes < self.target_bytes * 3 // 4:
                tiers.setdefault(self.tier(s), []).append(s)
        found = []
        for _, members in sorted(tiers.items()):
            run, size = [], 0
            for s in sorted(members, key=lambda s: (s.arrival, s.path)):
                if run and size + s.bytes > self.target_bytes and len(run) >= 2:
                    found.append(run)
                    run, size = [], 0
                run.append(s)
                size += s.bytes
            if len(run) >= self.fan_in:
                found.append(run)
        return found

    def compact(self) -> Manifest | None:
        """One round: merges every ready run, one output file each, in a single job per
        table; None if nothing was ready."""
        now = self.manifest()
        runs = self.runs(now.shards)
        if not runs:
            return None
        schema = self.schema()
        merged: list[Shard] = []
        # A run's shards become one task: read whole, written as one file.
        parts = [self.spark.read.schema(schema).parquet(*[f"{self.root}/{s.path}" for s in run]).coalesce(1) for run in runs]
        for at in range(0, len(parts), 64):
            job = parts[at]
            for p in parts[at + 1 : at + 64]:
                job = job.union(p)
            merged += self._written(job, min(s.arrival for run in runs[at : at + 64] for s in run))
        gone = {s.path for run in runs for s in run}
        for _ in range(5):
            latest = self.manifest()
            if not gone <= {s.path for s in latest.shards}:
                raise CommitConflict("another compaction took these shards")
            try:
                return self._commit(Manifest(latest.version + 1, latest.schema, [s for s in latest.shards if s.path not in gone] + merged))
            except CommitConflict:
                continue
        raise CommitConflict("gave up")

    def compact_all(self, rounds: int = 20) -> Manifest:
        """Rounds until no tier is ready."""
        for _ in range(rounds):
            if self.compact() is None:
                break
        return self.manifest()

    def vacuum(self) -> int:
        """Deletes data files that the latest manifest doesn't list; older versions go stale."""
        live = {s.path for s in self.manifest().shards}
        folder, gone = self._path(f"{self.root}/data"), 0
        if not self._fs.exists(folder):
            return 0
        for batch in self._fs.listStatus(folder):
            files = [s.getPath() for s in self._fs.listStatus(batch.getPath())]
            kept = [p for p in files if f"data/{batch.getPath().getName()}/{p.getName()}" in live]
            if not kept:
                gone += len(files)
                self._fs.delete(batch.getPath(), True)
            else:
                for p in files:
                    if p.getName().startswith("part-") and p not in kept:
                        gone += 1
                        self._fs.delete(p, False)
        return gone

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version; its files are named, so later commits don't matter."""
        m = self.manifest(version)
        schema = StructType.fromJson(json.loads(m.schema))
        if not m.shards:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{s.path}" for s in m.shards])


ARRIVALS = 4


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arriving in four appends, compacted and read back from the last manifest."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    store = ShardedTable(spark, common.fresh_dir(spark, "shards"), docs.schema)
    size = sum(store.size_of(f) for f in docs.inputFiles())
    for n in range(ARRIVALS):
        store.append(docs.where(common.id_fold(F.col("doc_id"), ARRIVALS) == n), size // ARRIVALS)
        store.compact()
    store.compact_all()
    store.vacuum()
    return store.read().select("doc_id", "lang", "source", "n_chars", F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"))


OP9_SQL = "SELECT doc_id, lang, source, n_chars, sha256(text) AS text_sha256 FROM documents"
