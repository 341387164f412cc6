import hashlib
import re
import struct

from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from rillmesh.llm import fingerprints as fp

ALONE = r"[぀-ヿ㐀-鿿가-힯฀-๿]"


def chain(values):
    r = 42
    for v in values:
        r = xxh64_intdigest(struct.pack("<q", v), r)
    return r - (1 << 64) if r >> 63 else r


def words(text):
    return [w for w in re.split(rf"\s+|(?<={ALONE})|(?={ALONE})", text or "", flags=re.ASCII) if w]


def signed(x, bits):
    x &= (1 << bits) - 1
    return x - (1 << bits) if x >> (bits - 1) else x


def brute(text, k=fp.K, s=fp.S):
    w = words(text)
    if not w:
        return []
    if len(w) < k:
        return [signed(xxh64_intdigest(" ".join(w).encode(), 42), 32)]
    h = [signed(xxh64_intdigest(x.encode(), 42), 64) for x in w]
    m = [chain(h[i : i + s]) for i in range(len(h) - s + 1)]
    gap, out = k - s, []
    whole = [signed(xxh64_intdigest(" ".join(w).encode(), 42), 32)]
    for i in range(len(m) - gap):
        inside = m[i : i + gap + 1]
        if min(inside) in (inside[0], inside[-1]):
            a = signed(chain([m[i + j] for j in range(0, gap, s)] + [m[i + gap]]), 32)
            if a not in out:
                out.append(a)
    return out or whole


def test_anchors_match_brute_force(spark, odd_docs):
    got = odd_docs.select("text", F.array_distinct(fp.anchors(F.col("text"))).alias("a")).collect()
    assert all(list(r["a"]) == brute(r["text"]) for r in got)


def test_context_free_and_positions(spark):
    a = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen"
    df = spark.createDataFrame([(a, "some other words come first " + a)], "a string, b string")
    r = df.select(fp.anchors(F.col("a"), places=True).alias("x"), fp.anchors(F.col("b"), places=True).alias("y")).select("x", fp.matched_positions(F.col("x"), F.col("y")).alias("m")).first()
    assert len(r["m"]) == len(r["x"]) > 0 and {p["other"] - p["at"] for p in r["m"]} == {5}


def test_likeness(spark):
    df = spark.createDataFrame([([1, 2], [2, 3]), ([], []), ([1], []), ([4], [4])], "a array<int>, b array<int>")
    assert [r[0] for r in df.select(fp.likeness(F.col("a"), F.col("b"))).collect()] == [1 / 3, 1.0, 0.0, 1.0]


def check(spark, docs, monkeypatch, **options):
    """The query over ``docs`` against plain Python."""
    from rillmesh.llm import common

    monkeypatch.setattr(common, "table", lambda s, d, n: docs)
    if options:
        real = fp.with_next
        monkeypatch.setattr(fp, "with_next", lambda d: real(d, **options))
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, signed(xxh64_intdigest(r[1].encode(), 42), 64), r[1].encode()))
    want = []
    for i, (doc, text) in enumerate(rows):
        nxt = rows[(i + 1) % len(rows)][1]
        cut = len(text) // 4
        edit = text[: len(text) - cut] + nxt[:cut]
        like = lambda p, q: 1.0 if not p and not q else len(set(p) & set(q)) / len(set(p) | set(q))
        a, b = brute(text), brute(edit)
        name = lambda p: "".join(f"{x & 0xFFFFFFFF:08x}" for x in p)
        want.append((doc, len(text), hashlib.sha256(edit.encode()).hexdigest(), name(a), name(b), like(a, b), like(a, brute(nxt))))
    key = lambda t: (t[0] is not None, t[0] or 0, t[1:])
    assert sorted((tuple(r) for r in fp.op4_syncmers(spark, "x").collect()), key=key) == sorted(want, key=key)


def test_query_with_odd_rows(spark, odd_docs, monkeypatch):
    check(spark, odd_docs.drop("anchors"), monkeypatch, cells=3, least_ranges=6)


def test_query_with_gaps_and_many_ranges(spark, monkeypatch):
    docs = spark.createDataFrame([(i * i * 7 - 100, f"text number {i} " * (i % 5)) for i in range(60)], "doc_id long, text string")
    check(spark, docs, monkeypatch)


def test_hot_and_null_ids_are_cut(spark, monkeypatch):
    import random

    rng = random.Random(6)
    text = lambda: " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 9)))
    docs = spark.createDataFrame([(i, text()) for i in range(20)] + [(7, text()) for _ in range(40)] + [(None, text()) for _ in range(30)] + [(12, text()) for _ in range(25)] + [(3, "same same")] * 4, "doc_id long, text string")
    got = fp.with_next(docs, cells=2, range_rows=4, least_ranges=2, broadcast_ranges=0)
    own = got.where("__kind = 0")
    assert own.count() == docs.count() and own.where("doc_id = 7").select("__range").distinct().count() >= 5 and own.where("doc_id is null").select("__range").distinct().count() >= 5
    check(spark, docs, monkeypatch, cells=2, range_rows=4, least_ranges=2, broadcast_ranges=0)


def test_every_text_with_a_token_has_an_anchor(spark):
    import random

    rng = random.Random(8)
    rows = [(" ".join(rng.choice("abcdefghijkl") for _ in range(n)),) for n in (1, 4, 5, 5, 5, 5, 6, 6, 6, 7) for _ in range(8)]
    assert spark.createDataFrame(rows, "t string").where(F.size(fp.anchors(F.col("t"))) == 0).count() == 0


def test_single_and_empty_tables(spark, no_docs, monkeypatch):
    check(spark, spark.createDataFrame([(5, "a b c d e f g h")], "doc_id long, text string"), monkeypatch)
    check(spark, spark.createDataFrame([(None, "a b c d e f g h"), (None, "b")], "doc_id long, text string"), monkeypatch)
    check(spark, no_docs.drop("anchors"), monkeypatch)


def test_native_plan(spark, odd_docs):
    plan = odd_docs.select(fp.anchors(F.col("text")))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
