"""Stored tables: repeated batches, parts that stay, readers of older versions, writers at once, streams that start again."""

import glob
import random

import pytest
from pyspark.sql import functions as F

from watchtide.sources import tables
from watchtide.sources.versioned import ConcurrentWrite, VersionedTable, cases, inserts, refreshes, upserts

SCHEMA = "id string, n long, v string"


def rows(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def content(df):
    return sorted(map(tuple, df.collect()))


def test_batches_are_merged_once(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), ["id"], parts=4)
    with pytest.raises(ValueError, match="no rows"):
        t.read()
    assert t.merge(rows(spark, [("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")]), upserts(["id"], ["n"]), "w", 0)
    assert t.merge(rows(spark, [("a", 0, "late"), ("c", 1, None), (None, 1, "null key")]), upserts(["id"], ["n"]), "w", 1)
    want = [("a", 0, "late"), ("b", 1, "z"), ("c", 1, None)]
    assert content(t.read().where("id IS NOT NULL")) == want and t.read().where("id IS NULL").count() == 1
    assert not t.merge(rows(spark, [("a", 9, "again")]), upserts(["id"], ["n"]), "w", 1)
    assert not t.merge(rows(spark, [("a", 9, "older")]), upserts(["id"], ["n"]), "w", 0)
    assert content(t.read().where("id IS NOT NULL")) == want
    assert content(t.read(version=1)) == [("a", 2, "y"), ("b", 1, "z")]
    assert t.merge(rows(spark, [("a", 9, "of another writer")]), inserts(["id"], ["n"]), "x", 0) and content(t.read().where("id IS NOT NULL")) == want
    assert t.merge(rows(spark, []), inserts(["id"], ["n"]), "x", 1) and t.manifest()["batches"] == {"w": 1, "x": 1}
    with pytest.raises(ValueError, match="parts"):
        VersionedTable(spark, str(tmp_path / "t"), ["id"], parts=5).merge(rows(spark, []), inserts(["id"], ["n"]), "w", 2)


def test_untouched_parts_keep_their_files(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), ["id"], parts=16)
    t.merge(rows(spark, [(f"k{i}", i, "x") for i in range(200)]), upserts(["id"], ["n"]), "w", 0)
    before = t.manifest()["parts"]
    t.merge(rows(spark, [("k7", 7, "new")]), upserts(["id"], ["n"]), "w", 1)
    after = t.manifest()["parts"]
    assert len(before) == 16 and sum(before[p] != after[p] for p in before) == 1
    assert t.read().count() == 200 and t.read().where("id = 'k7'").first()["v"] == "new"


def test_failed_batch_leaves_no_trace(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), ["id"], parts=4)
    t.merge(rows(spark, [("a", 1, "x")]), upserts(["id"], ["n"]), "w", 0)

    def slow(have, new):  # another writer comes first
        t.merge(rows(spark, [("b", 1, "other")]), upserts(["id"], ["n"]), "x", 0)
        return upserts(["id"], ["n"])(have, new)

    with pytest.raises(ConcurrentWrite):
        t.merge(rows(spark, [("a", 2, "mine")]), slow, "w", 1)
    assert content(t.read()) == [("a", 1, "x"), ("b", 1, "other")]
    assert t.merge(rows(spark, [("a", 2, "mine")]), upserts(["id"], ["n"]), "w", 1) and content(t.read()) == [("a", 2, "mine"), ("b", 1, "other")]
    for i in range(2, 6):
        t.merge(rows(spark, [("a", i, "more")]), upserts(["id"], ["n"]), "w", i)
    assert len(glob.glob(str(tmp_path / "t/manifests/*.json"))) == 3


def test_stream_starts_again_where_it_was(spark, tmp_path):
    t, folder = VersionedTable(spark, str(tmp_path / "t"), ["id"], parts=4), str(tmp_path / "in")
    for k in range(3):
        rows(spark, [(f"k{i}", 10 * k + i, f"file {k}") for i in range(5)]).coalesce(1).write.mode("append").parquet(folder)
        t.follow(spark.readStream.schema(SCHEMA).parquet(folder), upserts(["id"], ["n"]), "stream", str(tmp_path / "cp")).awaitTermination()
        assert content(t.read()) == [(f"k{i}", 10 * k + i, f"file {k}") for i in range(5)]
    assert t.manifest()["version"] == 3


def test_cases_batch_by_batch_equal_all_at_once(spark, tmp_path):
    r, schema = random.Random(6), "id string, n long, kind string, severity string, severity_rank int, status string, chain string, protocol string"
    log = [(r.choice("abcdef"), i, r.choice(["incident", "alert", "detection"]), r.choice(["high", "low", None]), r.randint(1, 5), r.choice(["open", "closed", None]), r.choice([None, "x", "y"]), r.choice([None, "p", "q"])) for i in range(120)]
    from watchtide.sources.tables import upsert_by_policy

    want = content(upsert_by_policy(spark.createDataFrame(log, schema), "id", ["n"]))
    t = VersionedTable(spark, str(tmp_path / "t"), ["id"], parts=2)
    made = spark.createDataFrame([], "id string, severity_last string, severity_rank_peak int, status string, chain string, protocol string").schema
    for k in range(4):
        assert t.merge(spark.createDataFrame(log[30 * k : 30 * k + 30], schema), cases("id", ["n"]), "w", k, made)
    assert content(t.read()) == want


@pytest.mark.parametrize("seed", [1, 2])
def test_inserts_deal_rows_once(spark, seed):
    """Merges within the table's keys shuffle rows once, and insert what an anti join with the table leaves."""
    r = random.Random(seed)
    some = lambda n, start: rows(spark, [(r.choice([None, *"abcdefgh"]), start + i, "x") for i in range(n)])
    have, new = some(12, 0).dropDuplicates(["id"]), some(30, 100)
    want = have.unionByName(tables.insert_if_absent(have, new, ["id"], ["n"]))
    dealt = lambda df: df.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(3)))
    plain, by_part = inserts(["id"], ["n"])(have, new), inserts(["id"], ["n"])(dealt(have), dealt(new))
    key = lambda df: sorted(map(str, df.select("id", "n", "v").collect()))
    assert key(plain) == key(want) == key(by_part)
    table = spark.createDataFrame(have.collect(), have.schema)
    for how in (inserts(["id"], ["n"]), refreshes(["id"], ["n"], "n")):
        plan = how(dealt(table), dealt(new))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1
