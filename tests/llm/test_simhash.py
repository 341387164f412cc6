import random
import re

from xxhash import xxh64_intdigest

from rillmesh.llm import graph
from rillmesh.llm import simhash as sh

UPPER = {i: i + 32 for i in range(65, 91)}


def brute_fp(text):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(UPPER))
    if not words:
        return 0
    h = [xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    """(id, fp) -> id -> smallest reachable id."""
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i][1] ^ fps[j][1]).count("1") <= 2:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(fps):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: least[find(i)] for i, (d, _) in enumerate(fps)}


def test_masks_cover_every_pair():
    for a in range(64):
        for b in range(a, 64):
            assert any(not (m >> a & 1) and not (m >> b & 1) for m in sh.masks())
    assert len(sh.masks()) == 7


def test_fingerprints_with_odd_rows(spark, odd_docs, no_docs):
    got = sorted((r["doc_id"] or -1, r["fp"]) for r in sh.fingerprints(odd_docs).collect())
    assert got == sorted((r["doc_id"] or -1, sh.signed(brute_fp(r["text"]))) for r in odd_docs.collect())
    out = sh.near_duplicates(odd_docs)
    assert out.count() == odd_docs.count()
    comp = {r["doc_id"]: r["component_id"] for r in out.collect()}
    assert comp[2] == comp[3] == comp[4] == 2 and comp[None] is None
    assert sh.near_duplicates(no_docs).count() == 0


def clustered(rng, n):
    centres = [rng.getrandbits(64) for _ in range(5)]
    out = []
    for i in range(n):
        x = rng.choice(centres)
        for _ in range(rng.randint(0, 4)):
            x ^= 1 << rng.randrange(64)
        out.append((i, x))
    return out + [(n + k, rng.getrandbits(64)) for k in range(40)] + [(n + 40, centres[0]), (n + 41, centres[0])]


def test_small_and_large_buckets_find_the_same_classes(spark):
    rows = clustered(random.Random(8), 260)
    want = brute_components(rows)
    prints = spark.createDataFrame([(d, sh.signed(f)) for d, f in rows], "doc_id long, fp long")
    for limit in (1000, 4, 1):
        found = {r["fp"]: r["component_id"] for r in sh.classes(prints, pair_limit=limit).collect()}
        assert {d: found[sh.signed(f)] for d, f in rows} == want


def test_components_of_paths_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 202), (202, 200), (5, 5)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {got[i] for i in range(31)} == {0} and {got[i] for i in range(100, 140)} == {100} and {got[i] for i in (200, 201, 202)} == {200}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0
