import random

from pyspark.sql import functions as F

from rillmesh.llm import common, toxicity as tx

from .conftest import sentence

BAD = ["scoundrel", "blackguard", "nincompoop"]


def corpus(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = sentence(rng, "abcdefghijklmn", rng.randint(20, 120)).split()
        y = int(i % 4 == 0)
        for _ in range(y * rng.randint(1, 4)):
            words.insert(rng.randrange(len(words)), rng.choice(BAD))
        rows.append((i, " ".join(words), y))
    return rows


def test_windows_cover_every_word():
    words = [f"w{i}" for i in range(23)]
    for size, step in ((6, 5), (6, 6), (3, 1)):
        assert {w for x in tx.windows(" ".join(words), size, step) for w in x.decode().split()} == set(words)
    assert tx.windows(None) == [] and tx.windows(" ") == [] and tx.windows("one") == [b" one "]


def test_held_out_texts_are_told_apart(spark):
    rows = corpus(800, 5)
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = tx.fit(df.where("doc_id < 600"), df.where("doc_id < 600").select("doc_id", "toxic"))
    got = tx.apply(df.where("doc_id >= 600"), model, ["doc_id", "toxic"])
    assert got.where("toxic = predicted").count() >= 194
    assert got.where("score < 0 or score > 1 or predicted <> cast(score >= 0.5 as int)").count() == 0


def test_a_long_text_is_scored_to_its_end(spark):
    rows = corpus(400, 6)
    model = tx.train([t for _, t, y in rows if y], [t for _, t, y in rows if not y])
    long = sentence(random.Random(9), "abcdefghijklmn", 30_000)
    saved = model.savings(model.compressors(), [long, long + " scoundrel blackguard", None])
    assert saved[1][-1] >= model.threshold > saved[0][-1] and len(saved[2]) == 0


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (5, 0), (6, None), (None, 1), (7, 0)], "doc_id long, toxic int")
    model = tx.fit(odd_docs, labels)
    got = tx.apply(odd_docs, model, ["doc_id"])
    assert got.count() == odd_docs.count() and {r["score"] for r in got.where("doc_id in (2, 3, 4)").collect()} == {0.0}
    one_class = tx.fit(odd_docs, labels.where("toxic = 0"))
    assert {r["score"] for r in tx.apply(odd_docs, one_class, ["doc_id"]).collect()} == {0.0}
    assert tx.apply(no_docs, model, ["doc_id"]).count() == 0 and tx.fit(no_docs, labels).weights == []


def test_fold(spark):
    df = spark.range(20).select(F.col("id"), common.id_fold(F.col("id"), 5).alias("f"))
    import zlib

    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in df.collect())


def test_whole_words_and_phrases_of_common_syllables_are_told_apart():
    """Every syllable and every word of a phrase is as common in ordinary texts."""
    syllables = ["ach", "lich", "keit", "ver", "schen", "tion", "ment", "eux", "para", "bo"]

    def texts(n, seed, bad):
        rng, out = random.Random(seed), []
        for _ in range(n):
            words = ["".join(rng.choice(syllables) for _ in range(3)) for _ in range(80)]
            words = [w for w in words if not w.startswith("lichkeitver")] + ["achment", "boeux", "achment", "tionpara", "boeux"]
            rng.shuffle(words)
            words = [w for i, w in enumerate(words) if not (w == "boeux" and i and words[i - 1] == "achment")]
            for _ in range(4):
                at = rng.randrange(len(words))
                words[at:at] = {"word": ["lichkeitver" + rng.choice(syllables)], "phrase": ["achment", "boeux"], None: []}[bad]
            out.append(" ".join(words))
        return out

    for bad in ("word", "phrase"):
        model = tx.train(texts(150, 1, bad), texts(600, 2, None))
        scored = lambda ts, m=model: [m.score(s) >= 0.5 for s in m.savings(m.compressors(), ts)]
        assert sum(scored(texts(100, 3, bad))) >= 95 and sum(scored(texts(100, 4, None))) <= 2, bad


def test_scores_match_windows_compressed_one_by_one(spark, odd_docs):
    """Every window of every text by a plain call of the compressor, every text by a plain sum."""
    import math

    import zstandard as zstd

    rows = corpus(300, 7)
    model = tx.train([t for _, t, y in rows if y], [t for _, t, y in rows if not y])
    params = zstd.ZstdCompressionParameters.from_level(tx.LEVEL, format=zstd.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0)
    plain = [zstd.ZstdCompressor(dict_data=zstd.ZstdCompressionDict(d, dict_type=zstd.DICT_TYPE_RAWCONTENT), compression_params=params) for d in (model.ordinary, model.toxic)]

    def brute(text):
        words = [b for b in model.units.coded((text or "").lower().split())]
        if not words:
            return 0.0
        saved = []
        for i in range(0, max(1, len(words) - tx.WINDOW + tx.STEP), tx.STEP):
            w = b" " + b" ".join(words[i : i + tx.WINDOW]) + b" " + tx.TAIL
            saved.append(len(plain[0].compress(w)) - len(plain[1].compress(w)))
        top = [min(16, max(0, s)) for s in sorted(saved, reverse=True)[:3]] + [0] * 3
        hits = sum(s >= model.threshold for s in saved)
        z = sum(a * b for a, b in zip(model.weights, [1, *top[:3], math.log1p(hits), 10 * hits / len(saved)], strict=True))
        return 1 / (1 + math.exp(-max(-60, min(60, z))))

    docs = spark.createDataFrame([(i, t) for i, t, _ in corpus(60, 8)], "doc_id long, text string").unionByName(odd_docs.select("doc_id", "text"))
    for r in tx.apply(docs, model, ["doc_id", "text"]).collect():
        assert abs(r["score"] - brute(r["text"])) < 1e-9 and r["predicted"] == int(r["score"] >= 0.5)


def test_near_copies_count_once_and_long_texts_are_spread(spark):
    rng = random.Random(2)
    base = sentence(rng, "abcdefghij", 200)
    copies = [base + f" end{i}" for i in range(10)]
    other = [sentence(rng, "abcdefghij", 200) for _ in range(5)]
    assert len(tx._originals(copies + other)) == 6
    long = " ".join(f"w{i}" for i in range(9000))
    got = spark.createDataFrame([(long,), ("short",)], "t string").select(tx.spread(F.col("t"), 1000).alias("t")).collect()
    assert got[1]["t"] == "short" and len(got[0]["t"]) <= 1010 and got[0]["t"].startswith("w0 ") and got[0]["t"].endswith("w8999")
