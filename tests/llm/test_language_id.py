import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillmesh.llm import language_id as lid

from .conftest import sentence

ALPHABETS = {"aa": "aeioumn", "bb": "bcdfgkrt", "cc": "xyzwvqpl"}


def test_vectors_follow_from_code_points_and_order_matters():
    e = lid.Encoder(256)
    assert (e.vector(97) == lid.Encoder(256).vector(97)).all() and set(np.unique(e.vector(97))) == {-1, 1}
    a, b = e.encode(["abc", "cba"])
    assert abs(a @ b) < 0.6 * np.linalg.norm(a) * np.linalg.norm(b)


def test_block_encoding_is_bundling_one_by_one():
    e = lid.Encoder(128)
    text = "Hello, wörld 42 abc"
    codes = e.codes(text)
    assert "".join(map(chr, codes)) == " hello wörld abc "
    want = sum(np.roll(e.vector(int(x)), 2).astype(int) * np.roll(e.vector(int(y)), 1) * e.vector(int(z)) for x, y, z in zip(codes, codes[1:], codes[2:], strict=False))
    assert (e.encode([text])[0] == want).all()


def test_held_out_accuracy(spark):
    rng = random.Random(3)
    rows = [(i, sentence(rng, ALPHABETS[k], rng.randint(1, 40)), k) for i in range(300) for k in [rng.choice(list(ALPHABETS))]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = lid.predict(df.where("doc_id >= 150"), lid.fit(df.where("doc_id < 150")), ["doc_id", "lang"])
    assert got.where("lang = lang_pred").count() >= 148 and got.where("score < 0 or score > 1").count() == 0


def test_odd_rows(spark, odd_docs, no_docs):
    model = lid.fit(odd_docs)
    got = {r["doc_id"]: r for r in lid.predict(odd_docs, model, ["doc_id"]).collect()}
    assert set(model) == {"en", "ja"} and all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (2, 3, 4))
    assert got[8]["lang_pred"] == "ja" and lid.predict(odd_docs, model, ["doc_id"]).count() == odd_docs.count()
    assert lid.fit(no_docs) == {} and lid.predict(no_docs, model, ["doc_id"]).count() == 0
    assert {r["lang_pred"] for r in lid.predict(odd_docs, {}, ["doc_id"]).collect()} == {"und"}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_query(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    got = lid.op1_language_id(spark, d).join(docs.select("doc_id", "lang"), "doc_id")
    assert got.count() == docs.count()
    held = got.where("held_out")
    assert held.where("lang = lang_pred").count() >= 0.95 * held.count()
    assert got.where(F.col("held_out") != (F.crc32(F.col("doc_id").cast("string")) % 3 == 1)).count() == 0

def test_prediction_matches_brute_force(spark, odd_docs):
    """Vectors of n-grams one by one, bundles, prototypes and cosines in plain loops."""
    import math

    encoder = lid.Encoder(64, 3)

    def bundle(text):
        letters = "".join(c if c.isalpha() else " " for c in (text or "").lower())
        if not letters.strip():
            return None
        letters = " " + " ".join(letters.split()) + " "
        out = np.zeros(64)
        for i in range(len(letters) - 2):
            v = np.ones(64)
            for k in range(3):
                v = v * np.roll(encoder.vector(ord(letters[i + k])), 2 - k)
            out += v
        return out

    rng = random.Random(4)
    train = [(i, sentence(rng, "abcde" if i % 2 else "cdefg", 12), "xx" if i % 2 else "yy") for i in range(40)] + [(90, None, "xx"), (91, "12 34", "zz"), (92, "no language", None)]
    sums = {}
    for _, text, lang in train:
        b = bundle(text)
        if lang and b is not None and np.linalg.norm(b):
            sums[lang] = sums.get(lang, 0) + b / np.linalg.norm(b)
    protos = {k: v / np.linalg.norm(v) for k, v in sums.items()}
    found = lid.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"), dimensions=64)
    assert sorted(found) == sorted(protos) == ["xx", "yy"] and all(np.allclose(found[k], protos[k], atol=1e-5) for k in protos)
    docs = spark.createDataFrame([(i, sentence(rng, "abcdefg", 9)) for i in range(40)], "doc_id long, text string").unionByName(odd_docs.select("doc_id", "text"))
    for r in lid.predict(docs, found, ["doc_id", "text"]).collect():
        b = bundle(r["text"])
        if b is None or not np.linalg.norm(b):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        cos = {k: float(b @ p / np.linalg.norm(b)) for k, p in protos.items()}
        best = max(cos.values())
        assert cos[r["lang_pred"]] > best - 1e-4
        assert abs(r["score"] - 1 / sum(math.exp(lid.SHARPNESS * (c - best)) for c in cos.values())) < 1e-3
