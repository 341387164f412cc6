import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from rillmesh.llm import packing as pk


def pack_all(sizes, capacity=64, **options):
    p = pk.SumOfSquares(capacity, **options)
    out = []
    for i, n in enumerate(sizes):
        out += p.add((i, 0, np.full(n, i, np.uint32), n))
    return out + list(p.finish())


@pytest.mark.parametrize("options", [{}, {"max_open": 4}])
def test_every_id_once_gapless_and_without_padding(options):
    rng = random.Random(4)
    sizes = [rng.randint(1, 150) for _ in range(400)] + [64, 128, 1, 1]
    seqs, pieces = defaultdict(list), defaultdict(list)
    for (doc, start, ids, total), seq, offset in pack_all(sizes, **options):
        assert (ids == doc).all() and total == sizes[doc]
        seqs[seq].append((offset, len(ids)))
        pieces[doc].append((start, len(ids)))
    for parts in (seqs, pieces):
        for spans in parts.values():
            at = 0
            for a, n in sorted(spans):
                assert a == at
                at += n
    assert all(sum(n for _, n in pieces[i]) == s for i, s in enumerate(sizes))
    lengths = [sum(n for _, n in s) for s in seqs.values()]
    assert all(n <= 64 and (n == 64 or n & (n - 1) == 0) for n in lengths) and sum(n < 64 for n in lengths) <= 6


def test_level_minimises_the_sum_of_squares():
    rng = random.Random(5)
    p = pk.SumOfSquares(32)
    for i in range(300):
        s = rng.randint(1, 31)

        def cost(h):
            n = p.counts.copy()
            n[h] -= h > 0
            n[h + s] += 1
            return int((n[1:32] ** 2).sum())

        options = {h: cost(h) for h in range(0, 32 - s + 1) if h == 0 or p.counts[h]}
        assert options[p.level(s)] == min(options.values())
        list(p.add((i, 0, np.zeros(s, np.uint32), s)))


def test_ids_equal_those_of_tokenizers():
    b = pk.ByteBPE(pk.default_tokenizer_path())
    rng = random.Random(6)
    parts = ["a", "the", " ", "  ", "\n", "\t", "é", "你", "'s", "!", "..", "\r\n", "\u3000", "<|endoftext|>", "\x1c", "😀", "_", "9"]
    for _ in range(2000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 10)))
        assert list(b(text)) == b.tokenizer.encode(text, add_special_tokens=False).ids


def test_operator_with_odd_rows(spark, odd_docs, no_docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(pk.default_tokenizer_path())
    got = pk.pack(odd_docs).collect()
    want = sorted(tuple(t.encode(r["text"] or "", add_special_tokens=False).ids) + (1,) for r in odd_docs.collect())
    by_doc = defaultdict(list)
    for r in got:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        by_doc[r["doc_id"]].append(r)
    single = {d: tuple(np.frombuffer(b"".join(p["ids"] for p in sorted(ps, key=lambda p: p["start"])), "<u4")) for d, ps in by_doc.items() if d != 1}
    assert all(ids in want for ids in single.values()) and sum(r["length"] for r in got) == sum(map(len, want))
    assert pk.pack(no_docs).count() == 0
