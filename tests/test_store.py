"""Tables of batches: a crash at any step, merging, readers beside a writer, and arriving files enriched once."""

import pytest
from pyspark.sql import functions as F

from storyatlas.sources.store import Store
from storyatlas.streaming.incremental import enrich_kept

SCHEMA = "entry_id string, v long"


class Crash(Exception):
    pass


def batch(spark, n, start=0):
    return spark.range(start, start + n).select(F.col("id").cast("string").alias("entry_id"), F.col("id").alias("v")).coalesce(1)


def held(store):
    return sorted(int(r.entry_id) for r in store.rows(SCHEMA).collect())


@pytest.mark.parametrize("step", ["_write", "_publish", "clear"])
def test_crash_at_any_step(spark, tmp_path, monkeypatch, step):
    """Rows count once their manifest is there; the next write clears what is left over."""
    store = Store(spark, str(tmp_path / "s"))
    assert store.rows(SCHEMA).count() == 0 and store.tables() == []
    store.add(batch(spark, 3))
    inner = getattr(Store, step)
    for after in (False, True):

        def crash(self, *args, **kw):
            if after:
                inner(self, *args, **kw)
            raise Crash

        monkeypatch.setattr(Store, step, crash)
        with pytest.raises(Crash):
            store.add(batch(spark, 2, 10))
        monkeypatch.setattr(Store, step, inner)
        counts = step == "clear" or (step == "_publish" and after)
        assert held(Store(spark, str(tmp_path / "s"))) == [0, 1, 2] + sorted([10, 11] * sum(counts if i == after else step == "clear" for i in (False, True) if i <= after))
    store.add(batch(spark, 1, 20))
    store.add(batch(spark, 1, 21))
    folders = {p.name for p in (tmp_path / "s").iterdir() if p.name.startswith("rows-")}
    assert folders == {t["name"] for t in store.tables()} and len(list((tmp_path / "s" / "_manifests").glob("*.json"))) == 2


def test_merging_bounds_folders(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.add(batch(spark, 1))
    reader = store.rows(SCHEMA)
    for i in range(1, 14):
        store.add(batch(spark, 1, i))
        store.compact(SCHEMA, "entry_id", fan=3)
        if i == 2:
            assert reader.count() == 1  # what was open before the merge can still be read
        levels = [t["level"] for t in store.tables()]
        assert all(levels.count(lv) < 3 for lv in levels)
    assert held(store) == list(range(14)) and sum(t["rows"] for t in store.tables()) == 14
    assert store.add(batch(spark, 0)) == 0 and len(store.tables()) == 4  # 14 = 9 + 3 + 1 + 1
    assert store.compact(SCHEMA, "entry_id", fan=3) == 0


@pytest.mark.parametrize("step", ["add", "compact"])
@pytest.mark.parametrize("after", [False, True])
def test_arrivals_are_enriched_once(spark, tmp_path, monkeypatch, step, after):
    """A stream that dies at a step and is started again keeps each key once."""
    source, store = str(tmp_path / "in"), Store(spark, str(tmp_path / "s"))
    start = lambda: enrich_kept(spark, source, "entry_id string, v long", store, SCHEMA, str(tmp_path / "cp"), lambda d: d.withColumn("v", F.col("v") * 2), fan=2)
    rows = [("1", 1), ("1", 5), ("2", 2), (None, 3)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(source)
    inner = getattr(Store, step)

    def crash(self, *args, **kw):
        if after:
            inner(self, *args, **kw)
        raise Crash

    monkeypatch.setattr(Store, step, crash)
    with pytest.raises(Exception):
        start().awaitTermination()
    monkeypatch.setattr(Store, step, inner)
    start().awaitTermination()
    spark.createDataFrame([("2", 9), ("3", 3)], SCHEMA).write.mode("append").parquet(source)
    start().awaitTermination()
    assert sorted(map(tuple, store.rows(SCHEMA).collect())) == [("1", 2), ("2", 4), ("3", 6)]
