"""Sequence packing by the online sum-of-squares rule.

Texts become token ids plus an end id.  A document's full windows are sequences of
their own; what remains is placed online: for each fill level ``h`` the packer keeps how
many open windows stand at it (the level array ``N``), and a piece of size ``s`` goes to
the level that makes the sum of ``N[h]**2`` over partially filled windows smallest.
Moving a window from ``h`` to ``h + s`` changes that sum by ``2 * (N[h+s] - N[h]) + 2``, by
``1 - 2 * N[h]`` if the window becomes full, and by ``2 * N[s] + 1`` for a new window, so
one vector expression over the array finds the best level.

Each task packs its own stream of rows: no shuffle, no driver state; memory is the open
windows (their number stays small because the rule balances levels, and is also bounded:
past ``max_open`` the fullest windows are handed to the tail).  When the stream
ends, the windows still open are joined and cut again: full windows first, then the
rest into sequences whose lengths are powers of two, which need no padding.  Every id
therefore lies in exactly one piece and no padding is left.

A sequence's id is the task's partition number in the high bits and a counter in the low
33, so a lost task that runs again over the same partition writes the same rows.

How often the bound on open windows is met depends on the task: README gives figures.

Defined results: null text is empty and packs as the end id alone; repeated rows, and rows that share an id or have
none, are packed each by itself; a very long text fills whole sequences as it goes; of equally good levels the fullest
window is taken; an empty table gives no piece; only the id and text columns are read, so other columns may have any names.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CAPACITY, END_ID = 2048, 1
TOKENIZER = "byte_bpe_50k.json"
#: Texts of a worker that both libraries encode, to see that their ids agree.
PROBES = 16
MAX_OPEN = 8192


class ByteBPE:
    """The ids that ``tokenizers`` gives with the file at ``path``, at several times its speed.

    ``tiktoken`` merges any neighbours whose join is in the vocabulary, least id first; the file lists
    the pairs that may merge, in order.  Both do the same if the listed merges' results have ascending ids and every
    vocabulary entry's own letters merge into it: were the two to part at a join ``t`` that isn't listed for its
    neighbours, ``t`` by itself would stop there too.  That is tested on load, entry by entry.  Texts with an added token's
    string, and everything if the test fails or the file isn't a plain byte BPE, go to ``tokenizers`` itself; and each worker
    encodes its first texts with both, as the pattern that splits texts is each library's own.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.added = [t["content"] for t in told["added_tokens"]]
        self.fast = self._same_merges(told)
        self.probes = PROBES

    def _same_merges(self, told: dict):
        """``tiktoken`` over the file's vocabulary, or None if the file asks for more."""
        import tiktoken
        from public_tokenizers import PATTERN

        plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        before, model = told.get("pre_tokenizer") or {}, told["model"]
        if told.get("normalizer") or model["type"] != "BPE" or any(before.get(k) != v for k, v in plain.items()):
            return None
        ids = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if any(a >= b for a, b in zip(ids, ids[1:], strict=False)):
            return None
        if any(len(self.tokenizer.model.tokenize(t)) != 1 for t in model["vocab"] if t not in self.added):
            return None
        # Byte-level vocabularies write each byte as a printable character.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(shown)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(others)}
        ranks = {bytes(byte[c] for c in token): n for token, n in model["vocab"].items() if token not in self.added}
        return tiktoken.Encoding("from_file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is None or any(a in text for a in self.added):
            return np.array(self._plain(text), np.uint32)
        ids = self.fast.encode_ordinary(text)
        if self.probes:
            self.probes -= 1
            if (own := self._plain(text)) != ids:
                ids, self.fast = own, None
        return np.array(ids, np.uint32)


#: Tokenizers of this Python worker, which Spark reuses for many tasks.
_LOADED: dict[str, ByteBPE] = {}


def loaded(path: str) -> ByteBPE:
    if path not in _LOADED:
        _LOADED[path] = ByteBPE(path)
    return _LOADED[path]


def default_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


Piece = tuple[object, int, np.ndarray, int]  # key of the document, start, ids, the document's ids in all


class SumOfSquares:
    """Online packer over windows of ``capacity``; yields (piece, sequence, offset)."""

    def __init__(self, capacity: int = CAPACITY, first: int = 0, max_open: int = MAX_OPEN):
        self.capacity, self.next, self.max_open = capacity, first, max_open
        self.counts = np.zeros(capacity + 1, np.int64)
        self.open: list[list[list[Piece]]] = [[] for _ in range(capacity)]
        self.n_open = 0
        self.tail: list[Piece] = []

    def level(self, size: int) -> int:
        """The fill level to place ``size`` at; 0 opens a window."""
        n, c = self.counts, self.capacity
        h = np.arange(0, c - size + 1)
        change = 2 * (n[size : c + 1] - n[: c - size + 1]) + 2
        change[-1] = 1 - 2 * n[c - size]  # becomes full: leaves the sum
        change[0] = 2 * n[size] + 1 if size < c else 0
        change = np.where((n[: c - size + 1] > 0) | (h == 0), change, np.iinfo(np.int64).max)
        # Of equal changes the fullest window wins, so windows close early.
        return int(len(change) - 1 - np.argmin(change[::-1]))

    def add(self, piece: Piece) -> Iterator[tuple[Piece, int, int]]:
        key, start, ids, total = piece
        full = len(ids) // self.capacity * self.capacity
        for at in range(0, full, self.capacity):
            yield from self._emit([(key, start + at, ids[at : at + self.capacity], total)])
        rest = ids[full:]
        if not len(rest):
            return
        piece = (key, start + full, rest, total)
        h = self.level(len(rest))
        window = self.open[h].pop() if h else []
        if h:
            self.counts[h] -= 1
            self.n_open -= 1
        window.append(piece)
        to = h + len(rest)
        if to == self.capacity:
            yield from self._emit(window)
            return
        self.open[to].append(window)
        self.counts[to] += 1
        self.n_open += 1
        if self.n_open > self.max_open:
            yield from self._close(self.max_open // 2)

    def _emit(self, pieces: list[Piece]) -> Iterator[tuple[Piece, int, int]]:
        offset = 0
        for p in pieces:
            yield p, self.next, offset
            offset += len(p[2])
        self.next += 1

    def _close(self, keep: int) -> Iterator[tuple[Piece, int, int]]:
        """Hands the fullest windows to the tail and cuts its full sequences off."""
        for h in range(self.capacity - 1, 0, -1):
            while self.open[h] and self.n_open > keep:
                self.tail += self.open[h].pop()
                self.counts[h] -= 1
                self.n_open -= 1
        left = sum(len(p[2]) for p in self.tail)
        while left >= self.capacity:
            yield from self._emit(self._cut(self.capacity))
            left -= self.capacity

    def _cut(self, size: int) -> list[Piece]:
        """The first ``size`` ids of the tail."""
        taken: list[Piece] = []
        at = 0
        while size:
            key, start, ids, total = self.tail[at]
            n = min(size, len(ids))
            taken.append((key, start, ids[:n], total))
            size -= n
            if n < len(ids):
                self.tail[at] = (key, start + n, ids[n:], total)
            else:
                at += 1
        del self.tail[:at]
        return taken

    def finish(self) -> Iterator[tuple[Piece, int, int]]:
        """Closes everything: full sequences, then powers of two, so nothing is padded."""
        yield from self._close(0)
        left = sum(len(p[2]) for p in self.tail)
        while left:
            size = 1 << (left.bit_length() - 1)
            yield from self._emit(self._cut(size))
            left -= size


def pack(docs: DataFrame, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: Callable[[], Callable[[str], np.ndarray]] | None = None, path: str | None = None) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids (little-endian uint32 bytes),
    ids_crc32, doc_tokens, sequence_id, offset``."""
    common.short_batches(docs.sparkSession)
    path = path or default_tokenizer_path()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    id_type = {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())
    schema = pa.schema([("doc_id", id_type), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = tokenizer() if tokenizer else loaded(path)
        packer = SumOfSquares(capacity, TaskContext.get().partitionId() << 33)
        end = np.array([end_id], np.uint32)

        def batch(placed: list) -> pa.RecordBatch:
            raw = [p[2].astype("<u4").tobytes() for p, _, _ in placed]
            columns = [[p[0] for p, _, _ in placed], [p[1] for p, _, _ in placed], [len(p[2]) for p, _, _ in placed], raw, [zlib.crc32(r) for r in raw], [p[3] for p, _, _ in placed], [s for _, s, _ in placed], [o for _, _, o in placed]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        placed: list = []
        for rows_in in batches:
            for key, value in zip(rows_in.column(0).to_pylist(), rows_in.column(1).to_pylist(), strict=True):
                ids = np.concatenate([encode(value), end])
                for got in packer.add((key, 0, ids, len(ids))):
                    placed.append(got)
                    if len(placed) >= 2000:
                        yield batch(placed)
                        placed = []
        for got in packer.finish():
            placed.append(got)
            if len(placed) >= 2000:
                yield batch(placed)
                placed = []
        if placed:
            yield batch(placed)

    return rows.mapInArrow(run, f"doc_id {kind}, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed; the ids themselves stay with the operator."""
    return pack(common.table(spark, sf_dir, "documents")).drop("ids")
