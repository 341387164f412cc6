import random

import pytest

from rillmesh.llm import similar, simhash

from .test_simhash import UPPER


def brute_set(text, size=5):
    import re

    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(UPPER))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute_classes(texts, size=5, similarity=0.8):
    """Index of the first member of each text's class."""
    sets, parent = [brute_set(t, size) for t in texts], list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if (not a and not sets[j]) or (a and 5 * both >= 5 * similarity * (len(a) + len(sets[j]) - both) - 1e-9):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


def corpus(seed, groups=6, copies=14):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5)))
    passage = [word() for _ in range(40)]
    out = []
    for g in range(groups):
        base = [word() for _ in range(rng.choice([3, 5, 6, 9, 12, 30, 80, 200]))]
        for _ in range(copies):
            ws = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5, len(ws) // 12])):
                at = rng.randrange(len(ws))
                ws[at : at + 1] = rng.choice([[word()], [], [word(), word()]])
            out.append(" ".join(ws))
        out.append(" ".join(passage + [word() for _ in range(rng.choice([5, 60]))]))
    rng.shuffle(out)
    return [*out, "", None, "  \n", "Same WORDS here", "same words\there"]


def test_classes_match_brute_force(spark):
    texts = corpus(1)
    want = brute_classes(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["class_id"] for r in similar.near_duplicates(docs).collect()}
    assert [got[i] for i in range(len(texts))] == want
    kept = similar.without_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want))


def test_similar_sets_share_a_band():
    """Of random pairs just at the bound all but a few share one of the bands, and a large group's pairs a finer one."""
    import numpy as np

    rng = np.random.default_rng(5)
    missed = apart = 0
    for _ in range(400):
        x = rng.integers(-(2**63), 2**63, 90)
        y = np.concatenate([x[:80], rng.integers(-(2**63), 2**63, 10)])  # 80 of 100 in common
        a, b = similar.bands(np.unique(x)), similar.bands(np.unique(y))
        missed += not (a[: similar.BANDS] == b[: similar.BANDS]).any()
        apart += not (a[similar.BANDS :] == b[similar.BANDS :]).any()
    assert missed <= 2 and apart <= 10


def test_odd_rows_are_kept_or_copies(spark, odd_docs, no_docs):
    kept = similar.without_near_duplicates(odd_docs)
    ids = sorted(r["doc_id"] or -1 for r in kept.collect())
    # 2, 3 and 4 have no words; rows with id 1 are equal; 5 adds one word to 1.
    assert kept.columns == odd_docs.columns and ids == [-1, 1, 2, 6, 7, 8, 9]
    assert similar.without_near_duplicates(no_docs).count() == 0 and similar.near_duplicates(no_docs).count() == 0
    with pytest.raises(ValueError):
        similar.without_near_duplicates(odd_docs.withColumnRenamed("keep", "__own"))


def test_one_id_with_two_unrelated_texts_keeps_both(spark):
    a, b = " ".join(f"w{i}" for i in range(50)), " ".join(f"v{i}" for i in range(50))
    docs = spark.createDataFrame([(1, a, "x"), (1, b, "x"), (1, a, "y"), (None, a + " end", "z"), (None, "alone", "z"), (None, "apart", "z")], "doc_id long, text string, source string")
    got = sorted((r["doc_id"] or -1, r["text"], r["source"]) for r in similar.without_near_duplicates(docs).collect())
    assert got == sorted([(1, a, "x"), (1, b, "x"), (-1, "alone", "z"), (-1, "apart", "z")])


def test_shared_passages_alone_make_no_class(spark):
    line = " ".join(f"p{i}" for i in range(30))
    docs = spark.createDataFrame([(i, f"{line} " + " ".join(f"u{i}x{j}" for j in range(60))) for i in range(80)], "doc_id long, text string")
    assert similar.without_near_duplicates(docs).count() == 80
    assert simhash.majority(simhash.shingle_hashes(line, 5)) >= 0


def test_large_groups_lose_no_pair(spark):
    """Texts of one template are no near-duplicates of each other, but each of its twin, which no leader or chain joins."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(6))
    shared, texts = [word() for _ in range(64)], []
    for _ in range(250):
        own = [word() for _ in range(3)]
        texts += [" ".join(shared + own + [word() for _ in range(7)]) for _ in range(2)]
    want = brute_classes(texts)
    assert len(set(want)) == 250
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["class_id"] for r in similar.near_duplicates(docs).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_joining_links_match_brute_force():
    import numpy as np

    rng = np.random.default_rng(7)
    base = rng.integers(-(2**63), 2**63, 60)
    sets = [np.unique(np.concatenate([base[: rng.integers(40, 61)], rng.integers(-(2**63), 2**63, rng.integers(0, 12))])) for _ in range(90)]
    rows, classes = np.arange(100, 190), np.array([int(i) // 3 for i in range(90)])
    for blocks in (np.zeros(90, int), np.arange(90) % 2):
        want, got = list(classes), list(classes)
        merge = lambda of, i, j: [of[i] if x == of[j] else x for x in of]
        for i in range(90):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) and (not blocks.any() or blocks[i] != blocks[j]):
                    want = merge(want, i, j)
        found = similar.joining_links(rows, classes, blocks, sets, 0.8)
        for u, v in found:
            got = merge(got, u - 100, v - 100)
        assert [want.index(c) for c in want] == [got.index(c) for c in got] and len(found) == len(set(classes)) - len(set(want))
