"""Document fingerprints from closed syncmers, with DataFrame functions only.

Tokens are runs of non-space characters; a character of an unspaced script (Han,
kana, Hangul, Thai) is a token of its own.  A k-mer is ``k`` consecutive tokens, its inner
substrings are the s-mers (``s`` consecutive tokens) ordered by their hash, and the k-mer
is an anchor if its smallest s-mer is the first or the last one.  That decision sees
nothing outside the k-mer (it is context-free), so equal passages give equal anchors
whatever surrounds them, and an edit disturbs only the anchors that touch it.

A fingerprint is the distinct anchor hashes (32 bits) in order of first occurrence.
The likeness of two fingerprints is the Jaccard share of anchors in common; for aligned
passages :func:`matched_positions` pairs anchors with their places.

Hashes of tokens, s-mers and k-mers are XXH64.  Each array is bound once to a lambda
variable (see :func:`_let`), so nothing is evaluated more than once per position and
the cost is linear in the text's length.

Tokens rather than characters are the letters of a k-mer because the built-in functions cost about as much for every
letter; README gives the measured figures of both.

Defined results: null text counts as empty and gives the empty fingerprint; a text without an anchor (one of
fewer than ``k`` tokens, or a short one whose k-mers have their smallest s-mer inside) has one, its whole token
sequence; two empty fingerprints are alike (1.0), an empty and a non-empty one are not (0.0); null ids come
first; rows of one id are ordered by the hash of their text, then by text; repeated rows repeat and the one follows
the other; a single row follows itself; very long texts are fingerprinted whole; an empty table gives no row; other columns are
not read, or carried along under any names that don't begin with two underscores.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Five words to an anchor, two to an inner substring: half of all places are anchors.
K, S = 5, 2
#: Between tokens: spaces, and any place beside a character of an unspaced script.
_ALONE = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}\p{IsThai}]"
BOUNDARY = rf"\s+|(?<={_ALONE})|(?={_ALONE})"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, BOUNDARY), lambda t: t != "")


def anchors(text: Column, k: int = K, s: int = S, places: bool = False) -> Column:
    """Anchor hashes (int) in order; with ``places`` structs of hash and token index."""
    if not 1 <= s < k:
        raise ValueError("s must be at least 1 and below k")
    gap = k - s

    def of_tokens(words: Column) -> Column:
        hashes = F.transform(words, lambda t: F.xxhash64(t))
        return F.when(F.size(words) == 0, F.array().cast("array<struct<at:int,h:int>>" if places else "array<int>")).when(F.size(words) < k, _whole(words)).otherwise(some(words, _let(hashes, of_hashes)))

    def _whole(words: Column) -> Column:
        h = _short(F.xxhash64(F.array_join(words, " ")))
        return F.array(F.struct(F.lit(0).alias("at"), h.alias("h")) if places else h)

    def of_hashes(h: Column) -> Column:
        smers = F.transform(F.slice(h, 1, F.size(h) - (s - 1)), lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, s)]))
        return _let(smers, lambda m: of_smers(h, m))

    def of_smers(h: Column, m: Column) -> Column:
        def edge(i: Column) -> Column:
            first, last = F.get(m, i), F.get(m, i + gap)
            return F.array_min(F.slice(m, i + 1, gap + 1)) == F.least(first, last)

        def name(i: Column) -> Column:
            # Whole s-mers cover most of the k-mer; the tail is covered by the last one.
            parts = [F.get(m, i + j) for j in range(0, gap, s)] + [F.get(m, i + gap)]
            hashed = _short(F.xxhash64(*parts))
            return F.struct(i.alias("at"), hashed.alias("h")) if places else hashed

        starts = F.sequence(F.lit(0), F.size(m) - gap - 1)
        return F.transform(F.filter(starts, edge), name)

    def some(words: Column, found: Column) -> Column:
        return _let(found, lambda a: F.when(F.size(a) > 0, a).otherwise(_whole(words)))

    return _let(tokens(F.coalesce(text, F.lit(""))), of_tokens)


def _short(hashed: Column) -> Column:
    """The low 32 bits as an int."""
    return (F.shiftright(F.shiftleft(hashed, 32), 32)).cast("int")


def fingerprint(anchor_hashes: Column) -> Column:
    """Printable form: 8 hex digits for each distinct anchor, in order."""
    return F.array_join(F.transform(anchor_hashes, lambda h: F.lpad(F.lower(F.hex(h.cast("long").bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard share of two anchor sets, 0 to 1."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)


def matched_positions(a: Column, b: Column) -> Column:
    """Pairs of token places at which two texts share an anchor (``places=True`` arrays);
    every place of ``a`` is paired with the first such place of ``b``."""
    first = _let(b, lambda bs: F.transform(F.filter(a, lambda x: F.exists(bs, lambda y: y.h == x.h)), lambda x: F.struct(x.at.alias("at"), F.element_at(F.filter(bs, lambda y: y.h == x.h), 1).at.alias("other"))))
    return first


def fingerprints(docs: DataFrame, id_cols: list[str], text: str = "text", k: int = K, s: int = S) -> DataFrame:
    """``id_cols`` with the fingerprint and its distinct anchors, for every row."""
    return docs.select(*id_cols, F.array_distinct(anchors(F.col(text), k, s)).alias("anchors")).withColumn("fingerprint", fingerprint(F.col("anchors")))


#: Rows per range, least number of ranges, and the quantiles that bound the cells they are cut from.
RANGE_ROWS, LEAST_RANGES, CELLS = 2000, 1024, 64
#: An id with more than this share of the rows (and four ranges' worth) has ranges of its own, so there are at most so many.
HOT_SHARE = 1 / 1000
#: Ranges up to which their first ids are broadcast (a few bytes each); they are joined by shuffle beyond.
BROADCAST_RANGES = 65_536
#: Characters of text that a task should get.
TASK_CHARS = 16 << 20


def _place(text: str) -> Column:
    """Order of the rows of one id."""
    return F.xxhash64(text)


def with_next(docs: DataFrame, order: str = "doc_id", text: str = "text", cells: int = CELLS, range_rows: int = RANGE_ROWS, least_ranges: int = LEAST_RANGES, broadcast_ranges: int = BROADCAST_RANGES) -> DataFrame:
    """Copies of each row such that a window over ``__range`` sees every row's successor in
    ascending ``order`` (the last row's: the first).

    Rows are dealt by ranges of ``order`` whose bounds are quantiles, each cut evenly into
    parts, more of them for larger tables.  Rows without an id, and those of an id that many rows share, are cut
    further by the hash of their text.  A range's first row is also sent, as a
    guard, to the range before; texts are shuffled once and nothing is sorted globally.
    ``__kind``: 0 own row, 1 guard, 2 the first row again after the last.
    """
    key, place = F.col(order), _place(text)
    marks = [i / cells for i in range(1, cells)]
    stats = docs.agg(F.min(order).alias("lo"), F.max(order).alias("hi"), F.count("*").alias("n"), F.count(order).alias("named"), F.sum(F.length(text)).alias("chars"), F.percentile_approx(order, marks, 10_000).alias("marks")).first()
    n = stats["n"]
    per_cell = -(-max(least_ranges, n // range_rows) // cells)
    lo, hi = (0, 0) if stats["lo"] is None else (int(stats["lo"]), int(stats["hi"]))
    bounds = sorted({lo, *map(int, stats["marks"] or []), hi + 1})
    starts, ends = (F.array(*[F.lit(x) for x in part]) for part in (bounds[:-1], bounds[1:]))
    cell = F.when(key.isNull(), 1).otherwise(F.greatest(F.lit(1), F.size(F.filter(starts, lambda x: x <= key))))
    a, b = F.element_at(starts, F.col("__cell")), F.element_at(ends, F.col("__cell"))
    part = F.least(F.lit(per_cell - 1), F.floor((key - a).cast("double") * per_cell / (b - a)))
    # Ids that many rows share: at most 1 / HOT_SHARE of them, counted with partial sums.
    hot = {r[order]: r["count"] for r in docs.where(key.isNotNull()).groupBy(order).count().where(F.col("count") > max(4 * range_rows, int(n * HOT_SHARE))).collect()}
    below = F.array_max(F.filter(F.array(*[F.lit(int(x)) for x in sorted(hot)]), lambda x: x <= key)) if hot else F.lit(None)
    pieces = F.lit(1)
    for x, rows in hot.items():
        pieces = F.when(key == int(x), -(-rows // range_rows)).otherwise(pieces)
    pieces = F.when(key.isNull(), max(1, -(-(n - stats["named"]) // range_rows))).otherwise(pieces)
    share = place.cast("double") / F.lit(2.0**64) + F.lit(0.5)
    cut = F.least(pieces - 1, F.floor(share * pieces)).cast("int")
    placed = docs.withColumn("__cell", cell).withColumn("__place", place)
    number = F.when(key.isNull(), -1).otherwise((F.col("__cell") * per_cell + part).cast("int"))
    placed = placed.withColumn("__range", F.struct(number.alias("part"), below.cast("long").alias("below"), F.coalesce((key > below).cast("int"), F.lit(0)).alias("after"), cut.alias("cut"))).drop("__cell")
    # Each range's first row with the range before it: one row a range.
    firsts = placed.groupBy("__range").agg(F.min(F.struct(F.col(order).alias("id"), F.col("__place").alias("place"))).alias("__first"))
    by_range = Window.orderBy("__range")
    last = firsts.agg(F.max("__range").alias("r"), F.count("*").alias("n")).first()
    to = F.lag("__range").over(by_range)
    guards = firsts.withColumn("__g", to).select(F.col("__first.id").alias("__id"), F.col("__first.place").alias("__at"), F.when(F.col("__g").isNull(), 2).otherwise(1).alias("__k"), "__g")
    if last["r"] is not None:
        r = last["r"]
        end = F.struct(F.lit(r["part"]).alias("part"), F.lit(r["below"]).cast("long").alias("below"), F.lit(r["after"]).alias("after"), F.lit(r["cut"]).alias("cut"))
        guards = guards.withColumn("__g", F.coalesce("__g", end))
    if last["n"] <= broadcast_ranges:
        guards = F.broadcast(guards)
    dealt = placed.join(guards, key.eqNullSafe(F.col("__id")) & (F.col("__place") == F.col("__at")), "left")
    own, more = F.struct(F.col("__range").alias("r"), F.lit(0).alias("k")), F.struct(F.col("__g").alias("r"), F.col("__k").alias("k"))
    copies = dealt.select(*docs.columns, "__place", F.explode(F.when(F.col("__g").isNull(), F.array(own)).otherwise(F.array(own, more))).alias("__copy"))
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(stats["chars"] or 0) // TASK_CHARS))
    return copies.select(*docs.columns, "__place", F.col("__copy.r").alias("__range"), F.col("__copy.k").alias("__kind")).repartition(tasks, "__range")


#: Order inside a range: own rows and the next range's guard, the wrapped first row last.
def _in_range(order: str, text: str) -> Window:
    return Window.partitionBy("__range").orderBy(F.expr("__kind = 2").asc(), F.col(order).asc_nulls_first(), F.col("__place").asc(), F.col(text).asc_nulls_first(), F.col("__kind").asc())


def edited(text: Column, following: Column) -> Column:
    """``text`` with its last quarter replaced by as many first characters of ``following``."""
    n = F.length(text)
    cut = F.floor(n / F.lit(4)).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - cut), F.substring(following, F.lit(1), cut))


def op4_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, with likenesses."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(docs)
    rows = rows.withColumn("anchors", F.array_distinct(anchors(F.col("text"))))
    rows = rows.withColumn("next", F.lead(F.struct("text", "anchors")).over(_in_range("doc_id", "text"))).where("__kind = 0")
    rows = rows.withColumn("edited", edited(F.col("text"), F.col("next.text")))
    rows = rows.withColumn("edited_anchors", F.array_distinct(anchors(F.col("edited"))))
    return rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        fingerprint(F.col("anchors")).alias("fingerprint"), fingerprint(F.col("edited_anchors")).alias("edited_fingerprint"),
        likeness(F.col("anchors"), F.col("edited_anchors")).alias("near_edited"), likeness(F.col("anchors"), F.col("next.anchors")).alias("near_next"),
    )
