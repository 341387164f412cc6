"""Near-duplicates by SimHash and covering locality-sensitive hashing.

A text's fingerprint is the bitwise majority of the XXH64 hashes of its word shingles.
Two fingerprints link if they differ in at most ``radius`` bits.  The search is exact: with
``r = radius`` every bit position gets a fixed non-zero vector of ``r + 1`` bits, and each of the
``2**(r+1) - 1`` non-zero vectors ``w`` defines one table whose mask keeps the positions with
an odd inner product with ``w``.  For any ``r`` positions some ``w`` is orthogonal to all of their
vectors, so a pair that differs only there agrees under that mask: every pair
within the radius shares a bucket in some table.

Equal fingerprints are merged before the search (a group of copies is one row), so a
bucket holds different fingerprints only.  A bucket of up to ``pair_limit`` fingerprints
is compared directly.  In a larger one the pairs are found without enumerating them: with
radius 2, two fingerprints are linked exactly if some value lies within one bit of both, so
each member is keyed by itself and by its one-bit neighbours among the positions that the
mask leaves free, and members of one key are linked to the key's first member.  Both
ways find every link; only the work differs.  Components of the links give the classes.

Defined results: null and empty texts have fingerprint 0, which links like any other;
fewer than three words form one shingle; very long texts are hashed whole, their bits counted in slices; a row per
row comes back, so repeated rows repeat, and rows of one id with different texts each have their own fingerprint;
of equal fingerprints no one is preferred, a component is named by its smallest id; rows with a null
id are fingerprinted, and belong to the component of their fingerprint (null if no id is in it); an empty table
gives no row; only the id and text columns are read, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, graph

BITS, SHINGLE, SEED, RADIUS = 64, 3, 42, 2
PAIR_LIMIT = 24
_SPACES = bytes(range(9, 14)) + b" "
#: A-Z to a-z and every separator to a space; bytes of other characters stay.
_FOLD = bytes((b + 32) if 65 <= b <= 90 else 32 if b in _SPACES else b for b in range(256))


def folded_words(text: str | None) -> list[bytes]:
    """Words between spaces and control spaces, A-Z as a-z."""
    return [w for w in (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split(b" ") if w]


def shingle_hashes(text: str | None, size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of every run of ``size`` words, joined by spaces (repeats included)."""
    return hashed(folded_words(text), size, seed)


def hashed(words: list[bytes], size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The same of words that are already folded."""
    from xxhash import xxh64_intdigest

    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= size:
        return np.array([xxh64_intdigest(b" ".join(words), seed)], np.uint64)
    # Every shingle is a slice of the joined text.
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    lo, hi = starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist()
    return np.fromiter((xxh64_intdigest(joined[a:b], seed) for a, b in zip(lo, hi, strict=True)), np.uint64, len(lo))


def majority(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65536):  # long texts in slices
        counts += np.unpackbits(hashes[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """``doc_id`` and ``fp`` (the 64 bits as a signed long) for every row."""
    common.short_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [signed(majority(shingle_hashes(t, size))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    return rows.mapInArrow(run, "doc_id long, fp long")


def masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """Masks of the covering tables.  Positions take the non-zero vectors in turn, so
    each mask keeps a little over half of the bits."""
    kinds = (1 << (radius + 1)) - 1
    vector = [i % kinds + 1 for i in range(bits)]
    return [sum(1 << i for i in range(bits) if bin(vector[i] & w).count("1") % 2) for w in range(1, kinds + 1)]


def links(nodes: DataFrame, radius: int = RADIUS, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """Links (u, v: fingerprints) whose components are those of all pairs within ``radius``.

    ``nodes`` has distinct ``fp``.  Buckets are sized first by an aggregate, which leaves
    only fingerprints that met another one; buckets of up to ``pair_limit`` are compared
    directly, larger ones through one-bit neighbours.
    """
    if radius != 2:
        raise ValueError("large buckets are solved for radius 2 only")
    mask = F.array(*[F.lit(signed(m)) for m in masks(radius)])
    keyed = nodes.select("fp", F.posexplode(mask).alias("t", "mask")).select("fp", "t", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = common.written(keyed.join(sizes, ["t", "key"]), "buckets")
    small = met.where(F.col("n") <= pair_limit).select("t", "key", F.col("fp").alias("u"))
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius
    direct = small.join(small.withColumnRenamed("u", "v"), ["t", "key"]).where((F.col("u") < F.col("v")) & near).select("u", "v")
    # Flips of positions that the mask leaves free; the value itself is one key more.
    flips = F.concat(F.array(F.lit(0).cast("long")), F.filter(F.array(*[F.lit(signed(1 << i)) for i in range(BITS)]), lambda b: b.bitwiseAND(F.col("mask")) == 0))
    reached = met.where(F.col("n") > pair_limit).select("fp", F.explode(flips).alias("flip")).select(F.col("fp").bitwiseXOR(F.col("flip")).alias("z"), "fp").distinct()
    # At most 65 fingerprints lie within one bit of a value, so these groups are bounded.
    first = reached.groupBy("z").agg(F.min("fp").alias("v"), F.count("*").alias("n")).where("n > 1").select("z", "v")
    starred = reached.join(first, "z").where("fp <> v").select(F.col("fp").alias("u"), "v")
    return direct.unionByName(starred)


def classes(prints: DataFrame, radius: int = RADIUS, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """``fp`` and ``component_id`` for every distinct fingerprint of ``prints`` (doc_id, fp)."""
    nodes = common.written(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    found = graph.components(links(nodes.select("fp"), radius, pair_limit))
    named = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("component", "fp")).select("fp", "root", "rep")
    named = common.written(named, "named")
    least = common.written(named.groupBy("root").agg(F.min("rep").alias("component_id")), "least")
    return common.written(named.join(least, "root").select("fp", "component_id"), "classes")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = SHINGLE, radius: int = RADIUS, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """``doc_id, fp, component_id`` for every row."""
    prints = common.written(fingerprints(docs, id_col, text, size), "prints")
    return prints.join(classes(prints, radius, pair_limit), "fp").select("doc_id", "fp", "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and component ids of all documents."""
    found = near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
