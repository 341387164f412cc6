"""Benchmark decontamination as a prefix-filtered set join.

Each item contributes windows of ``window`` consecutive words (one shorter window if the item
has fewer).  A window is contained in a document only if all of its shingles are, so
a single one of them is a necessary prefix token; shingles are ordered by how often they
occur in the corpus and each window is looked up under its rarest.  A hit of that token
at a place fixes where the window would have to start (positional bound); starts before the
document or windows running past its end are dropped (length bound), and the rest are
verified over the window's own length.

The benchmark's size is measured first.  Up to ``index_bytes`` of text its windows are one
index that every worker holds: the corpus is read twice (once for the exact counts of the items'
shingles over all documents, once to match, word by word), nothing but the counts is shuffled, and
words that occur in no item break a document into runs of integers.  A larger benchmark stays a table: documents' shingles that
occur in it are kept with their places, counted, and joined with the windows' prefix tokens; a candidate is verified by
all of its shingles (64-bit hashes) standing at their places.  Nothing of the benchmark reaches the driver then.

Defined results: null texts have no words; an item without words has no window; items that
share an id count once; a null item id is written as an empty string; repeated documents get
a row each, as do different documents of one id; a document without words is never contaminated; very long
texts are searched whole; a window that occurs several times, or in several items, hits each time; an empty benchmark hits
nothing and an empty table gives no row; columns that are carried along may have any name but those that are made
(``n_words``, ``hits`` and so on), which is refused.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW, SHINGLE = 13, 3
#: Bytes of benchmark text up to which its index is held by the driver and every worker.
INDEX_BYTES = 4 << 20
MADE = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hits", "items"]
_WORD = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
_FOLD = bytes(c if (c := b + 32 if 65 <= b <= 90 else b) in _WORD else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Runs of digits, letters a-z (A-Z folded) and non-ASCII characters."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


@dataclass
class Block:
    """Items by integer: the vocabulary, the windows in one array, and who owns them."""

    vocabulary: dict[bytes, int]
    items: list[str]
    flat: np.ndarray  # words of all items, one after the other
    starts: np.ndarray  # of windows in ``flat``
    sizes: np.ndarray
    owner: np.ndarray  # item of each window

    @classmethod
    def of(cls, items: list[tuple[str, list[bytes]]], window: int) -> Block:
        vocabulary: dict[bytes, int] = {}
        names: dict[str, int] = {}
        flat: list[int] = []
        starts, sizes, owner = [], [], []
        for name, ws in items:
            if not ws:
                continue
            at, size = len(flat), min(window, len(ws))
            flat += [vocabulary.setdefault(w, len(vocabulary)) for w in ws]
            o = names.setdefault(name, len(names))
            for i in range(len(ws) - size + 1):
                starts.append(at + i)
                sizes.append(size)
                owner.append(o)
        return cls(vocabulary, list(names), np.array(flat, np.int64), np.array(starts, np.int64), np.array(sizes, np.int64), np.array(owner, np.int64))

    def tokens_at(self, ids: np.ndarray, n: int) -> np.ndarray:
        """Shingles of ``n`` words as one integer each, -1 where a word is no item word."""
        if len(ids) < n:
            return np.empty(0, np.int64)
        base = len(self.vocabulary) + 1
        out = ids[: len(ids) - n + 1].copy()
        bad = out < 0
        for k in range(1, n):
            part = ids[k : len(ids) - n + 1 + k]
            bad |= part < 0
            out = out * base + part
        out[bad] = -1
        return out

    def shingle(self, size: int) -> int:
        """Words in a shingle of a window of ``size``; its product must fit an integer."""
        fits = max(1, int(62 // max(1.0, np.log2(len(self.vocabulary) + 2))))
        return min(SHINGLE, size, fits)

    def lookup(self, ws: list[bytes]) -> np.ndarray:
        get = self.vocabulary.get
        return np.fromiter((get(w, -1) for w in ws), np.int64, len(ws))


@dataclass
class Index:
    """Windows of a block under their rarest shingle, for one shingle length ``n``."""

    n: int
    keys: np.ndarray  # sorted distinct prefix tokens
    first: np.ndarray  # CSR bounds into the next two
    window: np.ndarray
    offset: np.ndarray  # of the token inside its window


def _rarest(block: Block, n: int, which: np.ndarray, counts: dict[int, int]) -> Index:
    tokens = block.tokens_at(block.flat, n)
    distinct, inverse = np.unique(tokens, return_inverse=True)
    weight = np.array([counts.get(int(t), 0) for t in distinct], np.int64)[inverse] if len(tokens) else np.empty(0, np.int64)
    token, offset = np.empty(len(which), np.int64), np.empty(len(which), np.int64)
    for j, w in enumerate(which):
        a, size = block.starts[w], block.sizes[w]
        k = int(np.argmin(weight[a : a + size - n + 1]))
        token[j], offset[j] = tokens[a + k], k
    order = np.argsort(token, kind="stable")
    keys, first = np.unique(token[order], return_index=True)
    return Index(n, keys, np.append(first, len(order)).astype(np.int64), which[order], offset[order])


def build(block: Block, counts: dict[int, dict[int, int]]) -> list[Index]:
    """One index per shingle length that the block's windows need."""
    lengths = np.array([block.shingle(int(s)) for s in block.sizes], np.int64)
    return [_rarest(block, int(n), np.flatnonzero(lengths == n), counts.get(int(n), {})) for n in np.unique(lengths)]


def matches(block: Block, indexes: list[Index], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts in ``ids`` and windows of all occurrences; ``ids`` may join documents by -1."""
    at, win = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for index in indexes:
        tokens = block.tokens_at(ids, index.n)
        if not len(tokens) or not len(index.keys):
            continue
        places = np.flatnonzero(tokens >= 0)
        slot = np.searchsorted(index.keys, tokens[places])
        slot[slot == len(index.keys)] = 0
        good = index.keys[slot] == tokens[places]
        places, slot = places[good], slot[good]
        # Candidates go through in slices: memory stays bounded on very frequent passages.
        for lo in range(0, len(places), 20_000):
            p, s = places[lo : lo + 20_000], slot[lo : lo + 20_000]
            n = index.first[s + 1] - index.first[s]
            row = np.repeat(np.arange(len(p)), n)
            entry = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(index.first[s], n)
            w = index.window[entry]
            start = p[row] - index.offset[entry]
            keep = (start >= 0) & (start + block.sizes[w] <= len(ids))
            start, w = start[keep], w[keep]
            for size in np.unique(block.sizes[w]):
                own = block.sizes[w] == size
                a, b = start[own], block.starts[w[own]]
                same = np.ones(len(a), bool)
                for k in range(int(size)):
                    live = np.flatnonzero(same)
                    if not len(live):
                        break
                    same[live] = ids[a[live] + k] == block.flat[b[live] + k]
                at.append(a[same])
                win.append(w[own][same])
    return np.concatenate(at), np.concatenate(win)


def _joined(block: Block, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts with -1 between, and where each text's words start."""
    parts, starts, at = [], [], 0
    gap = np.array([-1], np.int64)
    for t in texts:
        ids = block.lookup(words(t))
        starts.append(at)
        parts += [ids, gap]
        at += len(ids) + 1
    return (np.concatenate(parts) if parts else np.empty(0, np.int64)), np.array([*starts, at], np.int64)


def shingle_counts(docs: DataFrame, block: Block, text: str = "text") -> dict[int, dict[int, int]]:
    """How often each shingle of the block occurs in all documents, by shingle length."""
    lengths = sorted({block.shingle(int(s)) for s in np.unique(block.sizes)})
    known = {n: np.unique(block.tokens_at(block.flat, n)) for n in lengths}
    held = docs.sparkSession.sparkContext.broadcast((block, known))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, wanted = held.value
        sums = {n: np.zeros(len(k), np.int64) for n, k in wanted.items()}
        for batch in batches:
            ids, _ = _joined(b, batch.column(0).to_pylist())
            for n, keys in wanted.items():
                tokens = b.tokens_at(ids, n)
                tokens = tokens[tokens >= 0]
                slot = np.searchsorted(keys, tokens)
                slot[slot == len(keys)] = 0
                sums[n] += np.bincount(slot[keys[slot] == tokens], minlength=len(keys)) if len(keys) else 0
        for n, keys in wanted.items():
            some = np.flatnonzero(sums[n])
            yield pa.RecordBatch.from_pydict({"n": pa.array(np.full(len(some), n), pa.int32()), "token": pa.array(keys[some], pa.int64()), "c": pa.array(sums[n][some], pa.int64())})

    found: dict[int, dict[int, int]] = {n: {} for n in lengths}
    # Bounded by the block's own shingles.
    for row in docs.select(text).mapInArrow(count, "n int, token long, c long").groupBy("n", "token").agg(F.sum("c").alias("c")).collect():
        found[row["n"]][row["token"]] = row["c"]
    return found


def _results(batch: pa.RecordBatch, names: list[str], n: list[int], hits: list[list[int]], items: list[list[str]]) -> pa.RecordBatch:
    hit = [sum(h[1::2]) - sum(h[::2]) for h in hits]
    digest = [hashlib.sha256(",".join(sorted(i)).encode()).hexdigest() for i in items]
    bad = [h > 0 and 20 * h >= w for h, w in zip(hit, n, strict=True)]
    made = [pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array([len(i) for i in items], pa.int64()), pa.array(digest, pa.string()), pa.array(bad, pa.bool_()), pa.array(hits, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *made], names=[*names, *MADE])


def _merged(spans: list[tuple[int, int]]) -> list[int]:
    """Start and end of each stretch that sorted spans cover."""
    out: list[int] = []
    for a, z in spans:
        if out and a <= out[-1]:
            out[-1] = max(out[-1], z)
        else:
            out += [a, z]
    return out


def find(docs: DataFrame, benchmark: DataFrame, id_cols: list[str], text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """``id_cols`` with ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated``, ``hits`` (start and
    end word of each merged hit stretch) and ``items`` (ids of the items that occur) for every row."""
    common.short_batches(docs.sparkSession)
    common.refuse(id_cols, [*MADE, "__text", "__row"])
    rows = docs.select(*id_cols, F.col(text).alias("__text"))
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(item_text).alias("text"))
    out = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "__text"] + ["n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, hits array<bigint>, items array<string>"])
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return _by_index(rows, items, id_cols, window, out) if size <= index_bytes else _by_join(rows, items, id_cols, window, out)


def _by_index(rows: DataFrame, items: DataFrame, names: list[str], window: int, out: str) -> DataFrame:
    """Matches against one index of the whole benchmark, whose size the caller has measured."""
    block = Block.of([(r["item"], words(r["text"])) for r in items.toLocalIterator()], window)
    held = rows.sparkSession.sparkContext.broadcast((block, build(block, shingle_counts(rows, block, "__text")) if len(block.starts) else []))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, indexes = held.value
        for batch in batches:
            hits, items = [[] for _ in range(batch.num_rows)], [[] for _ in range(batch.num_rows)]
            ids, starts = _joined(b, batch.column("__text").to_pylist())
            at, win = matches(b, indexes, ids)
            doc = np.searchsorted(starts, at, "right") - 1
            order = np.argsort(doc, kind="stable")
            at, win, doc = at[order], win[order], doc[order]
            found, lo = np.unique(doc, return_index=True)
            for d, i, j in zip(found, lo, np.append(lo, len(doc))[1:], strict=True):
                hits[d] = _merged(sorted({(int(a), int(z)) for a, z in zip(at[i:j] - starts[d], at[i:j] - starts[d] + b.sizes[win[i:j]], strict=True)}))
                items[d] = sorted(b.items[o] for o in np.unique(b.owner[win[i:j]]))
            yield _results(batch, names, (np.diff(starts) - 1).tolist(), hits, items)

    return rows.mapInArrow(match, out)


def _shingles(ws: list[bytes], n: int) -> list[int]:
    """Signed XXH64 of every run of ``n`` words."""
    from xxhash import xxh64_intdigest

    hashed = (xxh64_intdigest(b" ".join(ws[i : i + n]), n) for i in range(len(ws) - n + 1))
    return [h - (1 << 64) if h >= 1 << 63 else h for h in hashed]


def _by_join(rows: DataFrame, items: DataFrame, names: list[str], window: int, out: str) -> DataFrame:
    """The same by joins, for a benchmark of any size."""
    rows = common.written(rows.withColumn("__row", F.monotonically_increasing_id()), "documents")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ws = words(value)
                if not ws:
                    continue
                size = min(window, len(ws))
                n = min(SHINGLE, size)
                tokens, runs = _shingles(ws, n), len(ws) - size + 1
                per = size - n + 1
                yield pa.RecordBatch.from_pydict({"item": pa.array([item] * runs, pa.string()), "size": pa.array([size] * runs, pa.int32()), "n": pa.array([n] * runs, pa.int32()), "tokens": pa.array([tokens[i : i + per] for i in range(runs)], pa.list_(pa.int64()))})

    wins = items.mapInArrow(windows, "item string, size int, n int, tokens array<bigint>")
    # Equal windows of several items are searched once.
    wins = common.written(wins.groupBy("size", "n", "tokens").agg(F.collect_set("item").alias("items")).withColumn("win", F.monotonically_increasing_id()), "windows")
    lengths = sorted(r["n"] for r in wins.select("n").distinct().collect())  # at most SHINGLE of them
    parts = common.written(wins.select("win", "n", F.posexplode("tokens").alias("at", "token")), "parts")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ws = words(value)
                for n in lengths:
                    found = _shingles(ws, n)
                    for lo in range(0, len(found), 20_000):
                        part = found[lo : lo + 20_000]
                        yield pa.RecordBatch.from_pydict({"row": pa.array([row] * len(part), pa.int64()), "n": pa.array([n] * len(part), pa.int32()), "pos": pa.array(range(lo, lo + len(part)), pa.int64()), "token": pa.array(part, pa.int64())})

    known = parts.select("n", "token").distinct()
    met = common.written(rows.select("__row", "__text").mapInArrow(places, "row long, n int, pos long, token long").join(known, ["n", "token"], "left_semi"), "places")
    counts = met.groupBy("n", "token").agg(F.count("*").alias("c"))
    rarest = parts.join(counts, ["n", "token"], "left").groupBy("win").agg(F.min(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "at", "token", "n")).alias("p"), F.count("*").alias("per"))
    prefix = rarest.where("p.c > 0").select("win", "per", F.col("p.at").alias("at"), F.col("p.token").alias("token"), F.col("p.n").alias("n"))
    candidates = met.join(prefix, ["n", "token"]).select("row", (F.col("pos") - F.col("at")).alias("start"), "win", "per").where("start >= 0")
    wanted = common.written(candidates, "candidates").join(parts, "win").select("row", "start", "win", "per", "n", "token", (F.col("start") + F.col("at")).alias("pos"))
    whole = wanted.join(met, ["row", "n", "pos", "token"]).groupBy("row", "start", "win", "per").agg(F.count("*").alias("c")).where("c = per")
    # At most one row a word of the document and length of window.
    found = whole.join(wins.select("win", "size", "items"), "win").groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("size")).alias("end")))).alias("__spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("__items"))
    joined = rows.join(found.withColumnRenamed("row", "__row"), "__row", "left").select(*names, "__text", "__spans", "__items")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [_merged([(s["start"], s["end"]) for s in spans or []]) for spans in batch.column("__spans").to_pylist()]
            yield _results(batch, names, [len(words(t)) for t in batch.column("__text").to_pylist()], hits, [sorted(i or []) for i in batch.column("__items").to_pylist()])

    return joined.mapInArrow(finish, out)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of the benchmark in all documents; spans and item lists stay with the operator."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return find(docs, common.table(spark, sf_dir, "benchmark"), ["doc_id"]).drop("hits", "items")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP7_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, {_WORDS} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark),
sized AS (SELECT item, w, least(len(w), 13) AS n FROM b WHERE len(w) > 0),
win AS (
  SELECT DISTINCT item, n, array_to_string(w[p : p + n - 1], ' ') AS body
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS p FROM sized)
),
kinds AS (SELECT DISTINCT n FROM win),
place AS (
  SELECT rid, n, p, array_to_string(w[p : p + n - 1], ' ') AS body
  FROM (SELECT d.*, kinds.n, unnest(range(1, len(w) - kinds.n + 2)) AS p FROM d, kinds WHERE len(w) >= kinds.n)
),
occ AS (SELECT rid, place.n, p, item FROM place JOIN win USING (n, body)),
hit AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT rid, n, p FROM occ)) GROUP BY rid),
its AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM occ GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN its USING (rid)
"""
