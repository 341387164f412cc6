"""Language identification with hyperdimensional profiles.

Each letter owns a fixed random vector of +1/-1 entries, derived from its code
point alone.  An n-gram is the elementwise product (binding) of its letters'
vectors, each rotated (permuted) by its place in the n-gram, so order matters.  A
text is the sum (bundle) of its n-grams' vectors; a language's prototype is the
bundle of its training texts, each scaled to unit length.  A text takes the
language whose prototype has the largest cosine with it.

Training is one map-side pass: every task sends one vector per language it met,
so what is shuffled is bounded by tasks x languages x dimensions.  Prediction is a
map without any shuffle.

Defined results: null text, or a text without a letter, gives ``und`` and score
0; rows repeat if the input repeats them, and rows that share an id (or have none) are each predicted by their own text; null
languages are not learnt; with no learnable language every text is ``und``; equal cosines take the alphabetically first language;
very long texts are encoded whole; an empty table gives no row; columns that are carried along may have any name
but those that are made, which is refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

DIMENSIONS = 1024
ORDER = 3
UNDETERMINED = "und"
#: Texts whose n-gram table is multiplied at once; bounds a task's memory.
BLOCK = 64
#: Unit vectors are summed as integers of this scale, so that sums don't depend on their order.
SCALE = 1 << 24
#: Languages that may be learnt: what the driver and every worker hold is so many vectors at most.
MOST_LANGUAGES = 10_000
#: Sharpness of the cosine softmax that becomes the score.
SHARPNESS = 12.0


class Encoder:
    """Maps texts to bundled n-gram vectors; state is a cache of letter vectors."""

    def __init__(self, dimensions: int = DIMENSIONS, order: int = ORDER):
        self.dimensions, self.order = dimensions, order
        self.vectors: dict[int, np.ndarray] = {}
        self.letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)

    def vector(self, code: int) -> np.ndarray:
        """The letter's own vector: a function of its code point only."""
        v = self.vectors.get(code)
        if v is None:
            if len(self.vectors) > 20_000:
                self.vectors.clear()
            bits = np.random.Generator(np.random.Philox(key=code)).integers(0, 2, self.dimensions, dtype=np.int8)
            v = self.vectors[code] = bits * np.int8(2) - np.int8(1)
        return v

    def codes(self, text: str | None) -> np.ndarray:
        """Lower-cased letters with every other run as one space, space at both ends."""
        points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letters = self.letter[points]
        if not letters.any():
            return np.empty(0, np.uint32)
        points = np.concatenate([[32], np.where(letters, points, 32), [32]]).astype(np.uint32)
        return points[np.concatenate([[True], (points[1:] != 32) | (points[:-1] != 32)])]

    def encode(self, texts: list[str | None]) -> np.ndarray:
        """One row per text: its bundle (all zero where it has no letter)."""
        out = np.zeros((len(texts), self.dimensions), np.float32)
        for at in range(0, len(texts), BLOCK):
            self._block([self.codes(t) for t in texts[at : at + BLOCK]], out[at : at + BLOCK])
        return out

    def _block(self, docs: list[np.ndarray], out: np.ndarray) -> None:
        have = [i for i, c in enumerate(docs) if len(c) >= self.order]
        if not have:
            return
        alphabet = np.unique(np.concatenate([np.unique(docs[i]) for i in have]))
        base = len(alphabet)
        table = np.stack([self.vector(int(c)) for c in alphabet])
        per_doc = []
        for i in have:
            ranks = np.searchsorted(alphabet, docs[i]).astype(np.int64)
            grams = ranks[: len(ranks) - self.order + 1].copy()
            for k in range(1, self.order):
                grams = grams * base + ranks[k : len(ranks) - self.order + 1 + k]
            per_doc.append(np.unique(grams, return_counts=True))
        distinct = np.unique(np.concatenate([g for g, _ in per_doc]))
        # Distinct n-grams go through in slices, so a huge alphabet stays bounded.
        for lo in range(0, len(distinct), 8192):
            part = distinct[lo : lo + 8192]
            bound, rest = None, part.copy()
            for k in range(self.order - 1, -1, -1):
                v = np.roll(table, self.order - 1 - k, axis=1)[rest % base]
                bound = v if bound is None else bound * v
                rest //= base
            counts = np.zeros((len(have), len(part)), np.float32)
            for row, (g, n) in enumerate(per_doc):
                a, b = np.searchsorted(g, part[0]), np.searchsorted(g, part[-1], "right")
                counts[row, np.searchsorted(part, g[a:b])] = n[a:b]
            out[have] += counts @ bound.astype(np.float32)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", dimensions: int = DIMENSIONS, order: int = ORDER) -> dict[str, np.ndarray]:
    """Prototypes by language, bundled over every row with a non-null language.

    What reaches the driver is one vector per language.
    """
    common.short_batches(docs.sparkSession)

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sums = Encoder(dimensions, order), {}
        for batch in batches:
            vectors = encoder.encode(batch.column(0).to_pylist())
            norms = np.linalg.norm(vectors, axis=1)
            vectors = np.rint(vectors * (SCALE / np.where(norms > 0, norms, 1))[:, None].astype(np.float64)).astype(np.int64)
            langs = np.array(batch.column(1).to_pylist(), object)
            for name in set(langs):
                part = vectors[langs == name].sum(axis=0)
                sums[name] = sums[name] + part if name in sums else part
        yield pa.RecordBatch.from_pydict({"lang": pa.array(list(sums), pa.string()), "v": pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))})

    parts = docs.where(F.col(lang).isNotNull()).select(F.col(text), F.col(lang)).mapInArrow(bundle, "lang string, v array<bigint>")
    summed = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    rows = summed.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).limit(MOST_LANGUAGES + 1).collect()
    if len(rows) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    found = {r["lang"]: np.array([p["x"] for p in r["v"]], np.float64) for r in rows}
    return {k: found[k] / n for k in sorted(found) if (n := np.linalg.norm(found[k])) > 0}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], id_cols: list[str], text: str = "text", order: int = ORDER) -> DataFrame:
    """``id_cols`` with ``lang_pred``, ``score`` and ``cosine`` for every row."""
    common.short_batches(docs.sparkSession)
    common.refuse(id_cols, ["lang_pred", "score", "cosine", "__text"])
    names = list(prototypes)
    dimensions = len(prototypes[names[0]]) if names else DIMENSIONS
    matrix = np.stack([prototypes[n] for n in names]).astype(np.float32) if names else np.zeros((0, dimensions), np.float32)
    kept = docs.select(*id_cols, F.col(text).alias("__text"))
    fields = [f for f in kept.schema.fields if f.name != "__text"]

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(dimensions, order)
        for batch in batches:
            vectors = encoder.encode(batch.column("__text").to_pylist()) if names else np.zeros((batch.num_rows, dimensions), np.float32)
            norms = np.linalg.norm(vectors, axis=1)
            some = (norms > 0) & bool(names)
            best, score, cosine = np.zeros(batch.num_rows, int), np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            if names:
                cos = (vectors @ matrix.T) / np.where(norms > 0, norms, 1)[:, None]
                best = cos.argmax(axis=1)
                odds = np.exp(SHARPNESS * (cos - cos.max(axis=1, keepdims=True)))
                score = np.where(some, 1 / odds.sum(axis=1), 0.0)
                cosine = np.where(some, cos.max(axis=1), 0.0)
            labels = [names[b] if s else UNDETERMINED for b, s in zip(best, some, strict=True)]
            columns = [batch.column(f.name) for f in fields]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(labels, pa.string()), pa.array(score, pa.float64()), pa.array(cosine, pa.float64())], names=[*[f.name for f in fields], "lang_pred", "score", "cosine"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["lang_pred string", "score double", "cosine double"])
    return kept.mapInArrow(classify, schema)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learnt from the folds that are not held out."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = common.id_fold(F.col("doc_id"), 3) == 1
    prototypes = fit(docs.where(~held_out))
    rows = docs.select("doc_id", "text", held_out.alias("held_out"))
    return predict(rows, prototypes, ["doc_id", "held_out"])
