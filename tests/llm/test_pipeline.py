"""The pipeline against plain Python on the smallest tables, and its stages on odd rows."""

import os
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline as cp
from rillmesh.llm import packing, secrets

from .test_decontaminate import brute as contamination
from .test_similar import brute_classes

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@needs_data
def test_stages_match_brute_force(spark):
    from rillmesh.llm import common, toxicity
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    model = toxicity.fit(docs, labels.where(common.id_fold(F.col("doc_id"), 5) != 0))
    compressors = model.compressors()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    left = {i: t for i, t in texts.items() if model.score(model.savings(compressors, [t])[0]) < 0.5}
    ids = sorted(left)
    first = brute_classes([left[i] for i in ids])
    left = {i: left[i] for n, i in enumerate(ids) if first[n] == n}
    left = {i: t for i, t in left.items() if not contamination(t, items)[4]}
    left = {i: secrets.redacted(t, secrets.scan(t)) for i, t in left.items()}
    encode = packing.ByteBPE(packing.default_tokenizer_path())
    got = defaultdict(list)
    for r in cp.run(spark, DATA).collect():
        got[r["doc_id"]].append((r["start"], r["ids"]))
    assert set(got) == set(left)
    for i, t in left.items():
        ids = np.frombuffer(b"".join(x for _, x in sorted(got[i])), "<u4")
        assert list(ids) == [*encode(t or ""), 1]


def test_stage_columns_and_odd_rows(spark, odd_docs, no_docs, tmp_path):
    folder = f"file://{tmp_path}"
    spark.createDataFrame([(1, 1), (5, 0), (None, 1)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "never there at all"), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for docs in (odd_docs, no_docs):
        for name, stage in cp.STAGES[:-1]:
            out = stage(spark, docs, folder)
            assert out.columns == cp.COLUMNS, name
            n = out.count()
            assert n <= docs.count()
            if name in ("decontamination", "secret_scan"):
                assert n == docs.count()
    kept = cp.near_duplicates(spark, odd_docs, folder)
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(1) == 1 and ids.count(None) == 1 and ids.count(2) == 1 and 3 not in ids
    twice = spark.createDataFrame([(1, "one text that stands alone here"), (1, "another that shares only its id")], "doc_id long, text string").selectExpr("*", "'en' lang", "'s' source", "1L n_chars")
    assert cp.near_duplicates(spark, twice, folder).count() == 2


def test_order_of_stages():
    assert [n for n, _ in cp.STAGES] == ["toxicity", "simhash_near_dedup", "decontamination", "secret_scan", "packing"] and cp.ORACLE_SQL is None


@needs_data
def test_queries_with_sql(spark):
    import glob

    import duckdb

    from rillmesh.llm import registry

    duck = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        duck.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    for name, sql in registry.ORACLES.items():
        df = registry.QUERIES[name](spark, DATA)
        ran = duck.execute(sql)
        names = [d[0] for d in ran.description]
        assert sorted(names) == sorted(df.columns), name
        want = sorted((tuple(r) for r in ran.fetchall()), key=str)
        assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=str) == want, name
    assert len(registry.QUERIES) == 10
