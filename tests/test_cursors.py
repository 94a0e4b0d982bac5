"""Scans that are broken off and started again lose no row and read none twice."""


import pytest
from pyspark.sql import functions as F

from watchtide.sources.cursors import Cursor, confirmed, keyset


def rows(spark, n):
    return spark.range(n).select(F.col("id").alias("k"), F.timestamp_seconds((F.col("id") / 3).cast("long")).cast("timestamp_ntz").alias("ts"))


def test_keyset_goes_on_where_it_was(spark, tmp_path):
    got, root = [], str(tmp_path / "c")
    sink = lambda df, batch: got.append((batch, sorted(r["k"] for r in df.collect())))
    run = lambda n, limit=None: keyset(Cursor(spark, root), rows(spark, n), "ts", "k", sink, limit)
    assert run(0) is None and run(10) == 0 and run(10) is None and run(14) == 1 and run(30, 5) == 2 and run(30, 5) == 3 and run(30) == 4 and run(30) is None
    assert got == [(0, list(range(10))), (1, list(range(10, 14))), (2, list(range(14, 19))), (3, list(range(19, 24))), (4, list(range(24, 30)))]


def test_a_broken_batch_is_the_same_batch_again(spark, tmp_path):
    got, root = [], str(tmp_path / "c")

    def fails(df, batch):
        got.append((batch, df.count()))
        raise InterruptedError

    with pytest.raises(InterruptedError):
        keyset(Cursor(spark, root), rows(spark, 10), "ts", "k", fails)
    # more has come since, but the batch is what was written down
    assert keyset(Cursor(spark, root), rows(spark, 20), "ts", "k", lambda df, batch: got.append((batch, df.count()))) == 0
    assert keyset(Cursor(spark, root), rows(spark, 20), "ts", "k", lambda df, batch: got.append((batch, df.count()))) == 1
    assert got == [(0, 10), (0, 10), (1, 10)]


def test_two_runs_at_once(spark, tmp_path):
    root = str(tmp_path / "c")

    def other(df, batch):
        keyset(Cursor(spark, root), rows(spark, 10), "ts", "k", lambda *_: None)

    with pytest.raises(RuntimeError, match="another run"):
        keyset(Cursor(spark, root), rows(spark, 10), "ts", "k", other)


def test_confirmed_by_chain(spark, tmp_path):
    got, root = [], str(tmp_path / "c")
    event = lambda *rows: spark.createDataFrame(list(rows), "chain string, block_number long")
    run = lambda df: confirmed(Cursor(spark, root), df, 2, lambda x, batch: got.append((batch, sorted(map(tuple, x.collect())))))
    assert run(event(("a", 1))) is None
    assert run(event(*(("a", b) for b in range(1, 6)), ("b", 1))) == 0
    assert run(event(*(("a", b) for b in range(1, 6)), ("b", 1))) is None
    assert run(event(*(("a", b) for b in range(1, 7)), ("b", 1), ("b", 9), ("c", 3), ("c", 1))) == 1
    assert got == [(0, [("a", 1), ("a", 2), ("a", 3)]), (1, [("a", 4), ("b", 1), ("c", 1)])]
