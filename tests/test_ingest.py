"""Metrics that are counted while a batch runs."""

from watchtide.sources.ingest import ingest


def test_metrics_of_a_batch(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", None), (1, "a", None), (2, "b", None), (3, "c", "no price"), (4, "d", "no symbol"), (4, "d", "no symbol")], "k long, v string, parse_error string")
    m = ingest(rows, ["k"], lambda df: df.write.parquet(str(tmp_path / "out")), "b1", "s")
    assert (m.rows_ingested, m.rows_deduped, m.rows_failed, m.status, m.error_summary) == (2, 1, 3, "partial", "no price; no symbol")
    assert m.started_at <= m.ended_at and spark.read.parquet(str(tmp_path / "out")).count() == 2
    m = ingest(rows.where("k < 3"), ["k"], lambda df: df.write.parquet(str(tmp_path / "two")), "b2", "s")
    assert (m.rows_ingested, m.rows_deduped, m.rows_failed, m.status, m.error_summary) == (2, 1, 0, "completed", None)
    m = ingest(rows.limit(0), ["k"], lambda df: df.write.parquet(str(tmp_path / "none")), "b3", "s")
    assert (m.rows_ingested, m.rows_deduped, m.status) == (0, 0, "completed")
    m = ingest(rows, ["k"], lambda df: df.write.parquet(str(tmp_path / "out")), "b4", "s")  # the path is there already
    assert m.status == "failed" and m.rows_ingested == 0 and m.error_summary
