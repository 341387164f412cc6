from rillmesh.plans.catalog import Field, Relation, System, TrustCondition, UnsupportedType, spark_type
from rillmesh.plans.rules import parse_tgd
from rillmesh.sources import catalog_xml, delimited
from rillmesh.streaming.epochs import EpochLog, dump, restore

import pytest

from .conftest import rows


def small():
    s = System("demo")
    s.add(Relation("P1", "S1", "R1", (Field("a", "VARCHAR(10)", True), Field("b", "INT"))))
    s.add(Relation("P2", "S2", "R2", (Field("a", "VARCHAR(10)", labeled=False),)))
    s.mappings = [parse_tgd("R2(a) :- R1(a, b), b > 3", "m", bidirectional=True)]
    s.trust = [TrustCondition("P2", "P1.S1.R1", "P1", 5, "b > 3")]
    return s


def test_catalog_round_trip():
    s = small()
    again = catalog_xml.loads(catalog_xml.dumps(s))
    assert again.relations == s.relations and again.trust == s.trust
    assert [str(m.heads[0]) for m in again.mappings] == ["R2(a)"] and again.mappings[0].bidirectional


def test_types():
    assert spark_type("varchar(20)").simpleString() == "string" and spark_type("CLOB(9)").simpleString() == "string"
    with pytest.raises(UnsupportedType):
        spark_type("DECIMAL(3,2)")


def test_delimited_files(spark, tmp_path):
    r = small().relations["P1.S1.R1"]
    (tmp_path / "p1_s1_r1.txt").write_text("x|1|1|1\ny||1|f7\n")
    df = delimited.read(spark, f"file://{tmp_path}", r)
    assert rows(df) == [("x", 1, None, None), ("y", None, None, "f7")]
    delimited.write(df, f"file://{tmp_path}/out", r)
    assert rows(delimited.read(spark, f"file://{tmp_path}/out", r)) == rows(df)
    found, failed = delimited.import_all(spark, f"file://{tmp_path}", small())
    assert list(found) == ["P1.S1.R1"] and failed == ["P2.S2.R2"]


def test_epoch_log_and_stream(spark, tmp_path):
    log = EpochLog(spark, f"file://{tmp_path}/log")
    batch = lambda *v: spark.createDataFrame([(x,) for x in v], "v int")
    assert log.last() == 0 and log.publish(batch(1, 2)) == 1 and log.publish(batch(3)) == 2
    assert rows(log.read(after=1), "v") == [(3,)] and rows(log.read(upto=1), "v") == [(1,), (2,)]
    seen = []
    for _ in range(2):
        log.follow(lambda df, n: seen.append(sorted(r["v"] for r in df.collect())), f"file://{tmp_path}/ckpt", "v int, epoch int").awaitTermination()
    assert sorted(x for s in seen for x in s) == [1, 2, 3]


def test_dump_and_restore(spark, tmp_path):
    a = spark.createDataFrame([(1, None)], "x int, y string")
    dump({"a": a}, f"file://{tmp_path}/d")
    assert rows(restore(spark, f"file://{tmp_path}/d", ["a"])["a"]) == [(1, None)]
