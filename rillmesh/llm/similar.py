"""Classes of texts whose sets of word shingles have a Jaccard similarity of at least ``similarity``.

Candidates come two ways, and every candidate is verified on the whole sets.

*SimHash.*  Fingerprints within the covering tables' radius (:func:`simhash.links`) are candidates:
that joins the bulk of lightly edited copies.  A similarity of 0.8 stands for about ten of 64 bits,
which would take thousands of covering tables, so the fingerprints can't carry the rest.

*Bands.*  ``BANDS`` times ``ROWS`` least hashes under different mixings of a set: two sets share one such
hash as often as they are similar, so at 0.8 they share a band but for one pair in five thousand (0.59 ** 16).
Sets of one band are candidates: all pairs in a group of up to ``PAIR_LIMIT`` sets.  In a larger one each set is
first compared with the group's first and with the first that shares one of ``FINER`` other bands with it (another
band in each group), which puts most of them into one class.  A large group that still holds several classes is then
compared whole, block by block: every pair of its sets is in one class or was ruled out, by its sizes, its sketches
or its sets.  Blocks have a bounded number of sets and shingles and give at most one link less than they have
classes, so no table of pairs is made.

Equal word sequences are one set from the start, so a group of copies is one row.  Pairs are thinned before their
sets are compared by 512 parity bits of each set: an odd bit of their difference is at least one shingle that only one has.

Defined results: words are what :mod:`simhash` takes for words (A-Z as a-z); fewer words than ``size`` are
one shingle; texts without words (null, empty, spaces) are equal to each other and like nothing else; very
long texts are read whole; repeated rows are copies; a row whose id is null or repeated is a row like any
other; an empty table gives no row; other columns may have any name that doesn't begin with two underscores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common, graph, simhash

SIZE, SIMILARITY = 5, 0.8
#: Bands, least hashes in one, bands that pick a partner in large groups, and hashes in one of those.
BANDS, ROWS, FINER, FINER_ROWS = 16, 4, 8, 3
#: Largest group whose pairs are all listed; larger ones are compared in blocks of about so many sets and shingles.
PAIR_LIMIT, BLOCK_SETS, BLOCK_SHINGLES = 24, 4096, 1 << 20
#: 64-bit words of a set's parity sketch.
SKETCH = 8


def word_digest(words: list[bytes], key: str = "") -> bytes:
    """128 bits of the word sequence and a key."""
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(key.encode("utf-8", "surrogatepass") + b"\0" + b" ".join(words))


def own_digest(name: str | None, text: str | None) -> bytes:
    """Of the id and the words."""
    return word_digest(simhash.folded_words(text), repr(name))


_MIX = np.random.Generator(np.random.Philox(key=SIZE)).integers(0, 1 << 64, BANDS * ROWS + FINER * FINER_ROWS, np.uint64, endpoint=False) | np.uint64(1)


def bands(hashes: np.ndarray) -> np.ndarray:
    """Hashes of the bands, then of the finer ones; of no shingles none."""
    from xxhash import xxh64_intdigest

    if not len(hashes):
        return np.empty(0, np.int64)
    least = np.full(len(_MIX), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 16_384):  # long texts in slices
        x = hashes[at : at + 16_384].view(np.uint64)
        mixed = (x ^ (x >> np.uint64(31)))[:, None] * _MIX
        least = np.minimum(least, (mixed ^ (mixed >> np.uint64(29))).min(axis=0))
    cuts = [(i * ROWS, (i + 1) * ROWS) for i in range(BANDS)] + [(BANDS * ROWS + i * FINER_ROWS, BANDS * ROWS + (i + 1) * FINER_ROWS) for i in range(FINER)]
    return np.array([xxh64_intdigest(least[a:b].tobytes(), i) for i, (a, b) in enumerate(cuts)], np.uint64).view(np.int64)


def parity(hashes: np.ndarray) -> np.ndarray:
    """Bit ``b`` is the parity of how many hashes fall on it."""
    bits = np.bincount((hashes.view(np.uint64) % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def sets_of(docs: DataFrame, id_col: str, text: str, size: int) -> DataFrame:
    """A row per row of ``docs``, without its text: ``row`` (a number), ``id``, ``digest`` of the words,
    ``own`` (of the id and the words), ``fp``, ``n``, ``sketch`` and ``bands``; written once."""
    common.short_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(id_col).cast("string").alias("name"), F.col(text).alias("text"))
    made = {"digest": pa.binary(), "own": pa.binary(), "fp": pa.int64(), "n": pa.int32(), "sketch": pa.list_(pa.int64()), "bands": pa.list_(pa.int64())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for name, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = simhash.folded_words(t)
                hashes = simhash.hashed(words, size)
                distinct = np.unique(hashes.view(np.int64))
                found.append((word_digest(words), word_digest(words, repr(name)), simhash.signed(simhash.majority(hashes)), len(distinct), parity(distinct), bands(distinct)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(zip(*found, strict=True), made.values(), strict=True)]], names=["id", *made])

    schema = f"id {rows.schema['id'].dataType.simpleString()}, digest binary, own binary, fp long, n int, sketch array<bigint>, bands array<bigint>"
    return common.written(rows.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "marked")


def _grouped(keyed: DataFrame) -> DataFrame:
    """``keyed`` (key, row, n, and hashes of the finer bands) with its group's ``members`` and ``first``, of groups of
    two or more; of the finer bands one, another in each group.

    Groups are sized with partial sums first, so one that a third of all texts share is no hot key; the
    join that follows has plain exchanges, which adaptive execution splits by size."""
    stats = keyed.groupBy("key").agg(F.count("*").alias("members"), F.min("row").alias("first")).where("members > 1")
    finer = F.element_at("finer", (F.pmod(F.col("key"), F.lit(FINER)) + 1).cast("int"))
    return common.written(keyed.withColumn("finer", finer).join(stats, "key"), "groups")


def _pairs(groups: DataFrame) -> DataFrame:
    """All pairs of small groups, and each set of a large one with two of its members; :func:`_across` has the rest."""
    small = groups.where(F.col("members") <= PAIR_LIMIT).select("key", F.col("row").alias("u"))
    found = small.join(small.withColumnRenamed("u", "v"), "key").where("u < v").select("u", "v")
    large = groups.where(F.col("members") > PAIR_LIMIT)
    near = large.groupBy("key", "finer").agg(F.min("row").alias("u"), F.count("*").alias("n")).where("n > 1").drop("n")
    return found.unionByName(large.select(F.col("first").alias("u"), F.col("row").alias("v"))).unionByName(large.join(near, ["key", "finer"]).select("u", F.col("row").alias("v")))


def joining_links(rows: np.ndarray, classes: np.ndarray, blocks: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links between similar sets that join the classes of two blocks (or of one with itself) as all such links would.

    Every pair that isn't in one class by the time it is met is ruled out by its sizes or sketches or compared whole."""
    order = np.argsort([len(x) for x in sets], kind="stable")
    rows, blocks, sets = rows[order], blocks[order], [sets[i] for i in order]
    root = np.unique(classes[order], return_inverse=True)[1]
    n = np.array([len(x) for x in sets], np.int64)
    ends = np.cumsum(n)
    _, shingles = np.unique(np.concatenate(sets), return_inverse=True)
    sketches = np.array([parity(x) for x in sets]).view(np.uint64)  # bits of signed numbers would be counted in their absolute values
    two, mark, found = bool((blocks != blocks[0]).any()), np.zeros(len(shingles), bool), []
    for a in range(len(sets)):
        b = np.arange(a + 1, np.searchsorted(n, n[a] / similarity + 1e-6, "right"))
        b = b[(root[b] != root[a]) & (blocks[b] != blocks[a])] if two else b[root[b] != root[a]]
        if len(b):
            b = b[np.bitwise_count(sketches[b] ^ sketches[a]).sum(axis=1, dtype=np.int64) <= (1 - similarity) / (1 + similarity) * (n[b] + n[a]) + 1e-9]
        mine = shingles[ends[a] - n[a] : ends[a]]
        mark[mine] = True
        while len(b):
            # As many sets at once as a block may hold, one at least.
            many = max(1, int(np.searchsorted(np.cumsum(n[b]), BLOCK_SHINGLES, "right")))
            c, b = b[:many], b[many:]
            starts = np.cumsum(n[c]) - n[c]
            both = np.add.reduceat(mark[shingles[np.repeat(ends[c] - n[c] - starts, n[c]) + np.arange(n[c].sum())]], starts, dtype=np.int64)
            for x in c[both >= similarity * (n[c] + n[a] - both) - 1e-9]:
                if root[x] != root[a]:
                    found.append((int(rows[a]), int(rows[x])))
                    root[root == root[x]] = root[a]
            b = b[root[b] != root[a]]
        mark[mine] = False
    return found


def _across(large: DataFrame, classes: DataFrame, whole: DataFrame, similarity: float) -> DataFrame:
    """Links between the classes within each large group (key, row, n): the exact way for what :func:`_pairs` leaves out.

    A group of several classes is cut into blocks by a hash, each two of which are one task's rows; one class needs no comparison."""
    placed = common.written(large.join(classes.withColumnRenamed("node", "row"), "row", "left").select("key", "row", "n", F.coalesce("component", "row").alias("class")), "placed")
    stats = placed.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.count("*").alias("members"), F.sum("n").alias("shingles")).where("low < high")
    count = F.ceil(F.greatest(F.col("members") / BLOCK_SETS, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    dealt = placed.join(stats.select("key", count.alias("blocks")), "key").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    dealt = dealt.select("key", "row", "class", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    dealt = dealt.select("key", "row", "class", "block", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j")).join(whole, "row")

    def run(group: pa.Table) -> pa.Table:
        at = {c: group.column(c).combine_chunks() for c in ("row", "class", "block", "hashes")}
        sets = [x.values.to_numpy() for x in at["hashes"]]
        found = joining_links(*(at[c].to_numpy(zero_copy_only=False) for c in ("row", "class", "block")), sets, similarity)
        return pa.table({"u": pa.array([u for u, _ in found], pa.int64()), "v": pa.array([v for _, v in found], pa.int64())})

    more = common.written(dealt.groupBy("key", "i", "j").applyInArrow(run, "u long, v long"), "across")
    common.dropped(placed)
    return more


def _may_be(similarity: float) -> Column:
    """Whether two sets of sizes ``nu``, ``nv`` and sketches ``su``, ``sv`` can be similar."""
    odd = F.aggregate(F.zip_with("su", "sv", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, x: a + x)
    both = F.col("nu") + F.col("nv")
    sizes = F.least("nu", "nv") >= F.lit(similarity) * F.greatest("nu", "nv") - 1e-9
    return F.when(sizes, odd <= F.lit((1 - similarity) / (1 + similarity)) * both + 1e-9).otherwise(False)


def _verified(pairs: DataFrame, whole: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` (u, v: rows, each once) that are similar.  ``u`` may be hot: it is joined last,
    when the rows carry the other side's set and adaptive execution splits them by size."""
    a, b = (whole.select(F.col("row").alias(c), F.col("hashes").alias(f"h{c}")) for c in "uv")
    both = F.size(F.array_intersect("hu", "hv"))
    alike = both >= F.lit(similarity) * (F.size("hu") + F.size("hv") - both) - 1e-9
    return pairs.join(b, "v").join(a, "u").where(alike).select("u", "v")


def _whole_sets(docs: DataFrame, id_col: str, text: str, size: int, wanted: DataFrame) -> DataFrame:
    """``row, hashes`` of the sets in ``wanted`` (row, own)."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [own_digest(name, t) for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), batch.column(1)], names=["own", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.unique(simhash.shingle_hashes(t, size).view(np.int64)) for t in batch.column(1).to_pylist()], pa.list_(pa.int64()))], names=["row", "hashes"])

    texts = docs.select(F.col(id_col).cast("string"), F.col(text)).mapInArrow(keyed, "own binary, text string")
    # Rows that repeat an id and its words all meet the wanted row; one of them is enough.
    one = texts.join(wanted, "own").groupBy("row").agg(F.min("text").alias("text"))
    return common.written(one.mapInArrow(run, "row long, hashes array<bigint>"), "sets")


def links(docs: DataFrame, sets: DataFrame, id_col: str, text: str, size: int, similarity: float) -> DataFrame:
    """Links (u, v: rows) whose components are those of all links found between similar sets of ``sets``."""
    groups = _grouped(sets.select("row", "n", F.slice("bands", BANDS + 1, FINER).alias("finer"), F.explode(F.slice("bands", 1, BANDS)).alias("key")))
    prints = common.written(sets.groupBy("fp").agg(F.min("row").alias("first")), "prints")
    same = sets.join(prints, "fp").select(F.col("first").alias("u"), F.col("row").alias("v"))
    named = lambda c: prints.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_row"))
    near = simhash.links(prints.select("fp")).join(named("u"), "u").join(named("v"), "v").select(F.col("u_row").alias("u"), F.col("v_row").alias("v"))
    pairs = common.written(_each_once(_pairs(groups).unionByName(same).unionByName(near)), "candidates")
    likely = common.written(_likely(pairs, sets, similarity), "pairs")
    large = groups.where(F.col("members") > PAIR_LIMIT).select("key", "row", "n")
    # Whole sets are made for texts that may have a partner, and for no others.
    wanted = likely.select(F.col("u").alias("row")).unionByName(likely.select(F.col("v").alias("row"))).unionByName(large.select("row")).distinct()
    whole = _whole_sets(docs, id_col, text, size, sets.select("row", "own").join(wanted, "row", "left_semi"))
    found = common.written(_verified(likely, whole, similarity), "links")
    classes = common.written(graph.components(found), "stars")
    more = _across(large, classes, whole, similarity)
    for t in (groups, prints, pairs, likely, whole, found):
        common.dropped(t)
    return classes.select(F.col("node").alias("u"), F.col("component").alias("v")).where("u <> v").unionByName(more)


def _each_once(pairs: DataFrame) -> DataFrame:
    return pairs.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _likely(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` that sizes and sketches don't rule out."""
    brief = lambda c: sets.select(F.col("row").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    return pairs.join(brief("v"), "v").join(brief("u"), "u").where(_may_be(similarity)).select("u", "v")


def _classes(docs: DataFrame, id_col: str, text: str, size: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """All rows of :func:`sets_of`, and each digest with the first row of its class (``least``)."""
    rows = sets_of(docs, id_col, text, size)
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row", "own")
    copies = common.written(rows.groupBy("digest").agg(F.min(order).alias("first")).select("digest", "first", F.col("first.row").alias("row")), "copies")
    sets = common.written(rows.where("n > 0").drop("id", "digest").join(copies.select("row"), "row", "left_semi"), "distinct")
    classes = graph.components(links(docs, sets, id_col, text, size, similarity)).withColumnRenamed("node", "row")
    named = common.written(copies.join(classes, "row", "left").select("digest", "first", F.coalesce("component", "row").alias("class")), "named")
    least = named.groupBy("class").agg(F.min("first").alias("least"))
    found = common.written(named.join(least, "class").select("digest", "least"), "classes")
    for t in (copies, sets, named):
        common.dropped(t)
    return rows, found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = SIZE, similarity: float = SIMILARITY) -> DataFrame:
    """``id_col`` and ``class_id`` for every row: the smallest id of the class, null if it has none."""
    rows, classes = _classes(docs, id_col, text, size, similarity)
    return rows.select("id", "digest").join(classes, "digest").select(F.col("id").alias(id_col), F.col("least.id").alias("class_id"))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = SIZE, similarity: float = SIMILARITY) -> DataFrame:
    """One row of every class, with the columns of ``docs``: that with the smallest id, null ids last, of
    equal ids and different texts the earliest, of rows equal in both the first by their other columns."""
    common.refuse(docs.columns, ["__own"])
    marked, classes = _classes(docs, id_col, text, size, similarity)
    common.dropped(marked)
    kept = classes.select(F.col("least.own").alias("__own")).distinct()
    at = docs.columns.index(text)
    rows = docs.withColumn("__name", F.col(id_col).cast("string"))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [own_digest(name, t) for name, t in zip(batch.column(batch.num_columns - 1).to_pylist(), batch.column(at).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(own, pa.binary())], names=[*batch.schema.names[:-1], "__own"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields] + ["__own binary"])
    keyed_rows = rows.mapInArrow(keyed, schema).join(kept, "__own", "left_semi")
    # Repeated rows share a key; the window works on the join's partitions.
    first = Window.partitionBy("__own").orderBy(*[F.col(f"`{c}`").asc_nulls_first() for c in docs.columns])
    return keyed_rows.withColumn("__first", F.row_number().over(first)).where("__first = 1").select(*docs.columns)
