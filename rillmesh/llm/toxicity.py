"""Toxicity by compression distance between two zstandard dictionaries.

Both dictionaries are trained by zstandard's dictionary builder.  The ordinary one is trained on windows
of ordinary texts.  The toxic one is trained on those windows of toxic texts that hold something telling, and ends with
the ordinary one's bytes, so that both offer ordinary prose the same nearest matches.
Telling are maximal stretches of byte n-grams, words, beginnings of words and phrases whose share of
toxic texts is many times their share of ordinary ones.  Words, beginnings and phrases that are telling as a
whole, though made of syllables that ordinary words share, are units: each is written as a
code of its own, in windows to train on and to score alike, which no syllable matches in part.
A window of a few words is compressed once with each dictionary (as raw content, so that only what they contain
tells them apart and not their statistics of symbols); the two lengths agree on ordinary
prose, and the bytes saved by the toxic dictionary measure what only it knows.

A text's windows are summarised by its largest savings and by how many windows
pass the calibrated window threshold; a logistic curve over these, calibrated on
training texts that the dictionaries have not seen, gives the score.  The
threshold itself is the smallest saving that at most ``WINDOW_NOISE`` of ordinary
calibration texts reach.

Training reads at most ``max_per_class`` labelled rows of each class (those with the smallest hash of id and text), and
of a text longer than ``max_train_chars`` as many characters in ``STRETCHES`` stretches spread evenly from its beginning
to its end; these bounds, not the corpus, set the size of the model and what the driver holds.
Scoring is a map over all rows and all windows of whole texts, without any shuffle.

Defined results: null and empty texts score 0; repeated rows repeat, and rows that share an id are each scored by
their own text; with one class missing from the labels every score is 0; conflicting labels of one id count as
toxic; null labels and labels of a null id are ignored; a very long text is scored over all of its windows; an empty table
gives no row; columns that are carried along may have any name but those that are made, which is refused.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .simhash import folded_words, hashed

#: Words in a window, and words from one window's start to the next one's.
WINDOW, STEP = 6, 5
#: Length of the byte n-grams that are compared between the classes.
GRAM = 5
LEVEL = 6
ORDINARY_BYTES, TOXIC_BYTES = 100_000, 32_000
#: Bytes of one segment that the dictionary builder picks, and of what it counts in it.
SEGMENT, COUNTED = 256, 8
#: An n-gram is telling if enough toxic texts have it (one in a hundred, within these bounds) and
#: its log ratio passes the other; a passage of telling n-grams has at least so many bytes.
LEAST_TEXTS, LEAST_LOG_RATIO, LEAST_PASSAGE = (4, 8), 3.5, 7
#: Least characters of a word's beginning and most words of a phrase that are weighed as units.
BEGINNING, PHRASE = 4, 3
#: Follows each window: the compressor starts no match in a block's last bytes.
TAIL = b"\x01" * 16
WINDOW_NOISE = 0.02
#: Least hashes of a training text, and how many of them make it a copy.
COPY = (16, 4)
MAX_PER_CLASS, MAX_TRAIN_CHARS, STRETCHES = 3000, 20_000, 10


def flat(text: str | None) -> bytes:
    """Lower-cased words with one space around each."""
    words = (text or "").lower().encode("utf-8", "replace").split()
    return b" " + b" ".join(words) + b" " if words else b""


def code(unit: str) -> bytes:
    """What stands for a telling unit in both windows and the toxic dictionary."""
    return b"\x02" + hashlib.blake2b(unit.encode("utf-8", "replace"), digest_size=5).hexdigest().encode() + b"\x03"


class Units:
    """Telling words, beginnings of words and phrases, looked up word by word."""

    #: Words whose lookup is remembered.
    HELD = 200_000

    def __init__(self, words: set[str], beginnings: set[str], phrases: set[tuple[str, ...]]):
        self.words, self.beginnings, self.phrases = words, beginnings, phrases
        self.lengths = sorted({len(b) for b in beginnings})
        self.ends: dict[str, list[tuple[str, ...]]] = {}
        for p in sorted(phrases):
            self.ends.setdefault(p[-1], []).append(p)
        self.known: dict[str, bytes] = {}

    def names(self) -> list[str]:
        return sorted(self.words) + [f"{b}*" for b in sorted(self.beginnings)] + [" ".join(p) for p in sorted(self.phrases)]

    def _written(self, word: str) -> bytes:
        if word in self.words:
            return code(word)
        for n in self.lengths:
            if n <= len(word) and word[:n] in self.beginnings:
                return code(f"{word[:n]}*")
        return word.encode("utf-8", "replace")

    def coded(self, words: list[str]) -> list[bytes]:
        """One item a word: the code of the unit that it is, or ends, or its bytes."""
        known, out = self.known, []
        for w in words:
            b = known.get(w)
            if b is None:
                if len(known) >= self.HELD:
                    known.clear()
                b = known[w] = self._written(w)
            out.append(b)
        if self.ends:
            for i, w in enumerate(words):
                for p in self.ends.get(w, ()):
                    if i + 1 >= len(p) and tuple(words[i + 1 - len(p) : i + 1]) == p:
                        out[i] = code(" ".join(p))
                        break
        return out


def windows(text: str | None, size: int = WINDOW, step: int = STEP, units: Units | None = None) -> list[bytes]:
    """Overlapping runs of words that together cover the whole text; telling units as codes."""
    words = units.coded((text or "").lower().split()) if units else (text or "").lower().encode("utf-8", "replace").split()
    return [b" " + b" ".join(words[i : i + size]) + b" " for i in range(0, max(1, len(words) - size + step), step)] if words else []


def _lengths(compressor: zstd.ZstdCompressor, data: bytes, segments: bytes, n: int) -> np.ndarray:
    packed = compressor.multi_compress_to_buffer(zstd.BufferWithSegments(data, segments), threads=1)
    return np.fromiter((len(packed[i]) for i in range(n)), np.int64, n)


@dataclass
class Model:
    """Two raw-content dictionaries, the window threshold, the logistic weights and the units."""

    ordinary: bytes
    toxic: bytes
    threshold: int = 2
    weights: list[float] = field(default_factory=list)
    units: Units | None = None

    def compressors(self) -> tuple[zstd.ZstdCompressor, zstd.ZstdCompressor]:
        made = []
        for content in (self.ordinary, self.toxic):
            params = zstd.ZstdCompressionParameters.from_level(LEVEL, format=zstd.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0)
            made.append(zstd.ZstdCompressor(dict_data=zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT), compression_params=params))
        return made[0], made[1]

    def savings(self, compressors: tuple, texts: list[str | None]) -> list[np.ndarray]:
        """Per text, the bytes that the toxic dictionary saves in each window."""
        out: list[np.ndarray] = []
        pending: list[bytes] = []
        counts: list[int] = []
        held = 0

        def flush() -> None:
            nonlocal pending, counts, held
            if pending:
                sizes = np.fromiter(map(len, pending), np.uint64, len(pending)) + np.uint64(len(TAIL))
                segments = np.empty((len(pending), 2), np.uint64)
                segments[:, 1] = sizes
                segments[:, 0] = np.cumsum(sizes) - sizes
                data, place = TAIL.join(pending) + TAIL, segments.tobytes()
                saved = _lengths(compressors[0], data, place, len(pending)) - _lengths(compressors[1], data, place, len(pending))
            else:
                saved = np.empty(0, np.int64)
            out.extend(np.split(saved, np.cumsum(counts)[:-1]) if counts else [])
            pending, counts, held = [], [], 0

        for text in texts:
            own = windows(text, units=self.units)
            pending += own
            counts.append(len(own))
            held += len(own)
            if held >= 20_000:
                flush()
        flush()
        return out

    def features(self, saved: np.ndarray) -> np.ndarray:
        """1, the three largest savings, and log counts of windows past the threshold."""
        top = np.zeros(3)
        best = np.sort(saved)[::-1][:3]
        top[: len(best)] = np.clip(best, 0, 16)
        hits = int((saved >= self.threshold).sum())
        return np.array([1.0, *top, math.log1p(hits), hits / max(1, len(saved)) * 10])

    def score(self, saved: np.ndarray) -> float:
        if not len(saved) or not self.weights:
            return 0.0
        return float(1 / (1 + math.exp(-max(-60.0, min(60.0, float(self.features(saved) @ np.array(self.weights)))))))


def _telling(toxic: list[bytes], ordinary: list[bytes]) -> set[bytes]:
    """N-grams far more common among toxic texts; counted by text."""

    def spread(texts: list[bytes]) -> Counter:
        seen: Counter = Counter()
        for b in texts:
            seen.update({b[i : i + GRAM] for i in range(len(b) - GRAM + 1)})
        return seen

    least = _least(toxic)
    ours = {g: n for g, n in spread(toxic).items() if n >= least}
    return _apart(ours, spread(ordinary), len(toxic), len(ordinary))


def _least(toxic: list) -> int:
    return min(LEAST_TEXTS[1], max(LEAST_TEXTS[0], len(toxic) // 100))


def _apart(ours: dict, theirs: Counter, toxic: int, ordinary: int) -> set:
    """Those of ``ours`` whose log ratio of toxic to ordinary texts passes the bound."""
    base = math.log(ordinary + 1) - math.log(toxic + 1)
    return {g for g, n in ours.items() if math.log(n + 0.5) - math.log(theirs[g] + 0.5) + base > LEAST_LOG_RATIO}


def _units(toxic: list[str], ordinary: list[str]) -> Units:
    """Words, beginnings of words and phrases far more common among toxic texts; counted by text.

    A unit is counted only if what it is made of is in enough toxic texts, so few are held.  A
    phrase with a telling word in it adds nothing and is left to that word."""
    least = _least(toxic)
    split = lambda texts: ((t or "").lower().split() for t in texts)

    def telling(parts: Callable[[list[str]], set]) -> tuple[dict, set]:
        ours: Counter = Counter()
        for words in split(toxic):
            ours.update(parts(words))
        often = {u: n for u, n in ours.items() if n >= least}
        theirs: Counter = Counter()
        for words in split(ordinary):
            theirs.update(parts(words) & often.keys())
        return often, _apart(often, theirs, len(toxic), len(ordinary))

    often, words = telling(set)
    _, beginnings = telling(lambda ws: {w[:n] for w in set(ws) for n in range(BEGINNING, len(w) + 1)})
    # The shortest beginnings stand for the longer ones.
    beginnings = {b for b in beginnings if not any(b[:n] in beginnings for n in range(BEGINNING, len(b)))}
    plain = {w for w in often if w not in words and not any(w[:n] in beginnings for n in range(BEGINNING, len(w) + 1))}
    phrases: set[tuple[str, ...]] = set()
    shorter = {(w,) for w in plain}
    for n in range(2, PHRASE + 1):
        runs = lambda ws, n=n, shorter=shorter: {p for p in zip(*[ws[i:] for i in range(n)], strict=False) if p[:-1] in shorter and p[1:] in shorter}
        often, told = telling(runs)
        phrases |= told
        shorter = often.keys() - told
    return Units(words, beginnings, phrases)


def _passages(texts: list[bytes], telling: set[bytes]) -> Counter:
    """Maximal stretches in which every n-gram is telling."""
    found: Counter = Counter()
    for b in texts:
        i, last = 0, len(b) - GRAM + 1
        while i < last:
            if b[i : i + GRAM] not in telling:
                i += 1
                continue
            j = i
            while j + 1 < last and b[j + 1 : j + 1 + GRAM] in telling:
                j += 1
            if j + GRAM - i >= LEAST_PASSAGE:
                found[b[i : j + GRAM]] += 1
            i = j + GRAM
    return found


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> list[float]:
    """Ridge-penalised logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-3
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w.tolist()


def _trained(samples: list[bytes], size: int) -> bytes:
    """The dictionary that zstandard trains on ``samples``; of too few samples to train on, the samples themselves."""
    try:
        return zstd.train_dictionary(size, samples, k=SEGMENT, d=COUNTED, level=LEVEL).as_bytes()
    except zstd.ZstdError:
        return b"".join(samples)[-size:]


def _originals(texts: list[str]) -> list[str]:
    """``texts`` without near copies of earlier ones: those that share ``COPY[1]`` of their ``COPY[0]`` least
    hashes of five words with one.  Copies would be counted as if they were so many texts, and would
    stand on both sides of the calibration."""
    kept: list[str] = []
    holders: dict[int, list[int]] = {}
    for t in texts:
        least = np.unique(hashed(folded_words(t), 5))[: COPY[0]].tolist()
        votes = Counter(i for h in least for i in holders.get(h, ()))
        if votes and max(votes.values()) >= min(COPY[1], len(least)):
            continue
        for h in least:
            holders.setdefault(h, []).append(len(kept))
        kept.append(t)
    return kept


def train(toxic: list[str], ordinary: list[str]) -> Model:
    """The model of two bounded samples: of their texts that aren't near copies, two thirds make the dictionaries and
    one third calibrates."""
    random.Random(7).shuffle(toxic)
    random.Random(7).shuffle(ordinary)
    toxic, ordinary = _originals(toxic), _originals(ordinary)
    if not toxic or not ordinary:
        return Model(b"", b"")
    cut = lambda xs: max(1, len(xs) * 2 // 3)
    seen_toxic, seen_ordinary = (xs[: cut(xs)] for xs in (toxic, ordinary))
    units = _units(seen_toxic, seen_ordinary)
    bytes_toxic, bytes_ordinary = ([flat(t) for t in xs] for xs in (seen_toxic, seen_ordinary))
    passages = _passages(bytes_toxic, _telling(bytes_toxic, bytes_ordinary))
    ranked = [p for p, n in sorted(passages.items(), key=lambda x: (x[1], x[0])) if n >= 2]
    # A window tells something if it has a unit's code or one of the passages.
    codes = {code(u) for u in units.names()}
    apart = re.compile(b"|".join([b"\x02[0-9a-f]{10}\x03", *(re.escape(p) for p in sorted(ranked, key=lambda p: (-len(p), p)))]))
    del bytes_toxic, bytes_ordinary, passages
    telling: list[bytes] = []
    for t in seen_toxic:
        for w in windows(t, units=units):
            telling += [b" " + m + b" " for m in apart.findall(w)]
    ordinary_content = _trained([w for t in seen_ordinary for w in windows(t, units=units)], ORDINARY_BYTES)
    toxic_content = _trained(telling, TOXIC_BYTES)
    missing = sorted(c for c in codes if c not in toxic_content)
    model = Model(ordinary_content, toxic_content + b" " + b" ".join(missing) + b" " + ordinary_content, units=units)
    held = [(t, 1) for t in toxic[cut(toxic) :] or toxic] + [(t, 0) for t in ordinary[cut(ordinary) :] or ordinary]
    saved = model.savings(model.compressors(), [t for t, _ in held])
    y = np.array([k for _, k in held], float)
    most = np.array([s.max() if len(s) else 0 for s in saved])
    model.threshold = next((t for t in range(2, 12) if (most[y == 0] >= t).mean() <= WINDOW_NOISE), 12)
    model.weights = _logistic(np.stack([model.features(s) for s in saved]), y)
    return model


def spread(text: Column, most: int) -> Column:
    """Of a text of more than ``most`` characters as many, in stretches spread evenly over it."""
    each = max(1, most // STRETCHES)
    step = (F.length(text) - each) / F.lit(STRETCHES - 1)
    parts = [F.substring(text, F.floor(step * i).cast("int") + 1, F.lit(each)) for i in range(STRETCHES)]
    return F.when(F.length(text) > most, F.concat_ws(" ", *parts)).otherwise(text)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", max_per_class: int = MAX_PER_CLASS, max_train_chars: int = MAX_TRAIN_CHARS) -> Model:
    """Trains on the bounded sample of ``labels`` that the caller has already folded."""
    labelled = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max((F.col(label) > 0).cast("int")).alias("y"))
    rows = docs.where(F.col(id_col).isNotNull() & F.col(text).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h"), F.col(text).alias("t"))
    keys = rows.select("id", "h").join(labelled, "id").distinct()
    chosen: dict[tuple[int, int], int] = {}
    for y in (0, 1):
        for row in keys.where(F.col("y") == y).orderBy(F.xxhash64("id", "h"), "id", "h").limit(max_per_class).collect():
            chosen[row["id"], row["h"]] = y
    spark = docs.sparkSession
    # At most 2 * max_per_class keys: a proven bound, so they may be broadcast; a row each comes back.
    wanted = spark.createDataFrame(list(chosen), "id long, h long")
    found = rows.join(F.broadcast(wanted), ["id", "h"], "left_semi").select("id", "h", spread(F.col("t"), max_train_chars).alias("t")).groupBy("id", "h").agg(F.min("t").alias("t"))
    texts: tuple[list[str], list[str]] = ([], [])
    for row in sorted(found.collect()):
        texts[chosen[row["id"], row["h"]]].append(row["t"])
    return train(texts[1], texts[0])


def apply(docs: DataFrame, model: Model, id_cols: list[str], text: str = "text") -> DataFrame:
    """``id_cols`` (the text may be one of them) with ``score``, ``predicted``, ``windows`` and
    ``most_saved`` for every row."""
    common.short_batches(docs.sparkSession)
    common.refuse(id_cols, ["score", "predicted", "windows", "most_saved", "__text"])
    kept = docs.select(*id_cols, F.col(text).alias("__text"))
    fields = [f for f in kept.schema.fields if f.name != "__text"]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = model.compressors() if model.weights else None
        for batch in batches:
            texts = batch.column("__text").to_pylist()
            saved = model.savings(compressors, texts) if compressors else [np.empty(0, int)] * len(texts)
            scores = np.array([model.score(s) for s in saved])
            made = [pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32), pa.int32()), pa.array([len(s) for s in saved], pa.int64()), pa.array([int(s.max()) if len(s) else 0 for s in saved], pa.int64())]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in fields], *made], names=[*[f.name for f in fields], "score", "predicted", "windows", "most_saved"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["score double", "predicted int", "windows long", "most_saved long"])
    return kept.mapInArrow(scored, schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; labels of held-out ids are never read."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = common.table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = fit(docs, labels.where(common.id_fold(F.col("doc_id"), 5) != 0))
    rows = docs.select("doc_id", "text", (common.id_fold(F.col("doc_id"), 5) == 0).alias("held_out"))
    return apply(rows, model, ["doc_id", "held_out"])
