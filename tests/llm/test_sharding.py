import pytest

from rillmesh.llm import common
from rillmesh.llm.sharding import CommitConflict, Manifest, Shard, ShardedTable


def batch(spark, lo, hi):
    return spark.range(lo, hi).selectExpr("id", "if(id % 3 = 0, null, concat('t', id)) as text")


@pytest.fixture
def store(spark):
    return ShardedTable(spark, common.fresh_dir(spark, "t"), batch(spark, 0, 1).schema, target_bytes=1 << 20, fan_in=3)


def test_versions_and_compaction(spark, store):
    for i in range(6):
        store.append(batch(spark, i * 10, i * 10 + 10).coalesce(1))
    before = store.manifest()
    assert before.version == 6 and len(before.shards) == 6
    after = store.compact_all()
    assert len(after.shards) < 6 and store.read().exceptAll(batch(spark, 0, 60)).count() == 0 and store.read().count() == 60
    assert store.read(3).count() == 30  # an older version is still there
    assert store.vacuum() > 0 and store.read().count() == 60
    assert store.compact() is None


def test_repeated_rows_stay(spark, store):
    store.append(batch(spark, 0, 5))
    store.append(batch(spark, 0, 5).selectExpr("*", "1 as extra"))
    store.compact_all()
    assert store.read().count() == 10 and store.read().columns == ["id", "text"]


def test_empty(spark, store):
    assert store.read().count() == 0 and store.compact() is None
    store.append(batch(spark, 0, 0))
    assert store.read().count() == 0


def test_two_writers_of_one_version(spark, store):
    m = store.manifest()
    store._commit(Manifest(m.version + 1, m.schema, []))
    with pytest.raises(CommitConflict):
        store._commit(Manifest(m.version + 1, m.schema, [Shard("data/x", 1, 1)]))
    assert store.manifest().shards == []


def test_tiers_and_runs(store):
    small = [Shard(f"s{i}", 1000, i) for i in range(3)]
    big = [Shard("b", 1 << 20, 9)]
    assert store.runs(small + big) == [small] and store.runs(small[:2] + big) == []
    wide = [Shard(f"m{i}", 600_000, i) for i in range(5)]
    assert all(sum(s.bytes for s in run) <= 2 * store.target_bytes for run in store.runs(wide))


def test_new_table_needs_a_schema(spark):
    with pytest.raises(ValueError):
        ShardedTable(spark, common.fresh_dir(spark, "t"))
