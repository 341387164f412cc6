import hashlib
import random
import re

import pytest

from rillmesh.llm import decontaminate as dc

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
UPPER = {i: i + 32 for i in range(65, 91)}


def split(text):
    return WORD.findall((text or "").translate(UPPER))


def brute(text, items, window=13):
    w = split(text)
    hit, found = set(), set()
    for item, body in items:
        ws = split(body)
        n = min(window, len(ws))
        for i in range(len(ws) - n + 1 if n else 0):
            for p in range(len(w) - n + 1):
                if w[p : p + n] == ws[i : i + n]:
                    hit |= set(range(p, p + n))
                    found.add("" if item is None else str(item))
    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)


def tables(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(12)] + ["É", "ß9"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice((2, 5, 13, 14, 30)))) for i in range(12)] + [(12, None), (13, ""), (13, "W1, w1; w1!"), (None, text(3)), (2, text(20))]
    docs = []
    for i in range(60):
        body = text(rng.randint(0, 80))
        if i % 3 == 0:
            body += " -- " + (items[rng.randrange(12)][1] or "").upper() + ". " + text(4)
        docs.append((i, body))
    docs += [(60, None), (61, ""), (61, ""), (None, items[0][1])]
    return docs, items, spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as n_hit", "2 as items"), spark.createDataFrame(items, "item_id long, text string")


def test_matches_brute_force_by_index_and_by_join(spark):
    docs, items, d, b = tables(spark)
    want = sorted(((i, *brute(t, items)) for i, t in docs), key=str)
    found = []
    for size in (dc.INDEX_BYTES, 0):
        got = dc.find(d, b, ["doc_id"], index_bytes=size)
        found.append(sorted(map(tuple, got.collect()), key=str))
        assert sorted(map(tuple, got.drop("hits", "items").collect()), key=str) == want
    assert str(found[0]) == str(found[1])
    with pytest.raises(ValueError):
        dc.find(d, b, ["doc_id", "items"])


def test_spans_are_merged_word_ranges(spark):
    d = spark.createDataFrame([(1, "a b c d a b x c d")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b"), (2, "b c d")], "item_id long, text string")
    r = dc.find(d, b, ["doc_id"]).first()
    assert list(r["hits"]) == [0, 6] and list(r["items"]) == ["1", "2"] and r["n_hit"] == 6


def test_empty_tables(spark, no_docs, odd_docs):
    _, _, d, b = tables(spark)
    got = dc.find(odd_docs, b.limit(0), ["doc_id"])
    assert got.count() == odd_docs.count() and got.where("contaminated or n_hit > 0").count() == 0
    assert dc.find(no_docs, b, ["doc_id"]).count() == 0 and dc.find(no_docs, b, ["doc_id"], index_bytes=0).count() == 0
    assert dc.find(odd_docs, b, ["doc_id"], index_bytes=0).count() == odd_docs.count()


def test_wide_vocabulary_shortens_shingles():
    block = dc.Block.of([("a", [f"{i}".encode() for i in range(50)])], 13)
    assert block.shingle(13) == 3
    block.vocabulary = {f"{i}".encode(): i for i in range(3_000_000)}
    assert block.shingle(13) == 2
