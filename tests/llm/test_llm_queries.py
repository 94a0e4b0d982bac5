"""The registered queries against SQL, and the pipeline against a plain version."""

import hashlib
import os
import re
import sys
from collections import Counter, defaultdict

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle import compare

import corpus_pipeline
from watchtide.llm import quality, queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, sf, name):
    compare(spark, sf, queries.QUERIES[name], queries.ORACLES[name])


def test_all_thirteen():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 14))


def test_pipeline(spark, sf):
    """Each stage on its own input, done plainly."""
    docs, n = spark.read.parquet(f"{sf}/documents.parquet"), None
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        after = stage(spark, docs, sf)
        rows = {r["doc_id"]: r for r in after.collect()}
        if name != "bpe":
            assert after.columns == list(corpus_pipeline.COLUMNS) and len(rows) <= len(before)
        if name == "quality":
            model = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"), quality.in_training)
            assert set(rows) == {r["doc_id"] for r in quality.score_documents(docs, model).where("predicted = 1").collect()}
            assert all(rows[i] == before[i] for i in rows)
        if name == "line_dedup":
            key = lambda x: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x).translate({c: c + 32 for c in range(65, 91)})
            count = Counter(k for r in before.values() for k in {key(x) for x in (r["text"] or "").split("\n")})
            for i, r in before.items():
                assert rows[i]["text"] == "\n".join(x for x in (r["text"] or "").split("\n") if not key(x) or count[key(x)] < 10)
                assert rows[i]["n_chars"] == len(rows[i]["text"])
        if name == "ngram_jaccard":
            shingles = {}
            for i, r in before.items():
                w = re.findall(r"[^\x20\x09-\x0D]+", (r["text"] or "").translate({c: c + 32 for c in range(65, 91)}))
                shingles[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())
            by, parent = defaultdict(set), {i: i for i in before}

            def find(x):
                while parent[x] != x:
                    x = parent[x]
                return x

            for i, s in shingles.items():
                for x in s:
                    by[x].add(i)
            for a, b in {(a, b) for s in by.values() if len(s) > 1 for a in s for b in s if a < b}:
                if 100 * len(shingles[a] & shingles[b]) >= 85 * len(shingles[a] | shingles[b]):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
            assert set(rows) == {i for i in before if find(i) == i}
        if name == "mixing":
            tokens = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
            kept, total = sum(map(tokens, rows.values())), sum(map(tokens, before.values()))
            assert 0.9 * total - 1 <= kept < total
        if name == "bpe":
            assert set(rows) == set(before)
            assert all(r["decoded_sha256"] == hashlib.sha256((before[i]["text"] or "").encode()).hexdigest() for i, r in rows.items())
        docs, n = after, len(rows)
    assert n and corpus_pipeline.run(spark, sf).count() == n


def test_pipeline_on_odd_rows(spark, sf, tmp_path):
    """Nulls, repeats, and an empty table go through every stage."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(None, "a b c", None, None, None), (10_000, None, "en", "src1", 0), (10_001, "", None, "other", 0), (10_002, "x\ny", "en", "src2", 3), (10_002, "x\ny", "en", "src2", 3)], docs.schema)
    for rows in (docs.unionByName(odd), docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            rows = stage(spark, rows, sf)
        assert rows.count() >= 0


def test_pipeline_keeps_one_of_many_copies(spark, sf):
    """Ten or more copies of a text count as one document for their lines; a line of ten other texts goes."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = "A first line of the text that was copied often\nand a second one that belongs to it\n\nand a third one at the end"
    own = [(i, f"{text}\nfooter", "en", "src1", 0) for i in range(100, 125)] + [(i, f"alone number {i} is a text by itself {i * 7}\nfooter", "en", "src1", 0) for i in range(200, 212)]
    rows = spark.createDataFrame(own, docs.schema)
    for name, stage in corpus_pipeline.STAGES[1:3]:
        rows = stage(spark, rows, sf)
        if name == "line_dedup":
            assert {r["text"] for r in rows.collect() if r["doc_id"] < 125} == {text} and not [r for r in rows.collect() if "footer" in r["text"]]
    assert [r["text"] for r in rows.collect() if r["doc_id"] < 125] == [text] and rows.count() == 13


def test_pipeline_keeps_one_row_of_an_id(spark, sf):
    """One fixed row of each component stays, whatever the order of the rows."""
    a, c = (" ".join(f"{w}{i}" for i in range(30)) for w in "ac")
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    rows = [(5, a, "en", "s1", 1), (7, a, "en", "s1", 1), (7, c, "en", "s1", 1), (9, c, "en", "s1", 1), (11, a + " y", "de", "s2", 1), (40, "p q", "en", "s1", 1), (40, "r s", "en", "s1", 1), (41, "t u", "en", "s2", 1), (41, "t u", "en", "s1", 1)]
    got = [sorted(map(tuple, corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(x, schema), sf).collect())) for x in (rows, rows[::-1])]
    assert got[0] == got[1] and [r[0] for r in got[0]] == [5, 40, 41] and got[0][2][3] == "s1"


def test_mixing_stage(spark, sf):
    """The stage keeps the documents that SQL takes for the mixture of one epoch."""
    sql = queries.OP2_SQL.replace("sum(n_tokens) * 2.0::DOUBLE AS capacity", "sum(n_tokens) * 1.0::DOUBLE AS capacity")
    assert sql != queries.OP2_SQL
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = sorted(r[0] for r in con.sql(f"select doc_id from ({sql}) where copies > 0").fetchall())
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert sorted(r["doc_id"] for r in corpus_pipeline.mix_sources(spark, docs, sf).collect()) == want and 0 < len(want) < docs.count()


def test_stages_on_odd_rows(spark, sf):
    """What each stage makes of nulls, empty texts and repeats, whatever the order of the rows."""
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    rows = [(None, "a b c d e", None, None, None), (1, None, "en", "s1", 0), (2, "", None, "other", 0), (3, "x\ny", "en", "s2", 3), (3, "x\ny", "en", "s2", 3), (4, "X Y", "de", None, None), (5, "long " * 40_000, "en", "s1", 0)]
    df, back = (spark.createDataFrame(x, schema) for x in (rows, rows[::-1]))
    key = lambda rows: sorted(map(str, rows))
    stages = dict(corpus_pipeline.STAGES)
    for name in ("quality", "line_dedup", "ngram_jaccard", "mixing", "bpe"):
        one, two = (key(map(tuple, stages[name](spark, x, sf).collect())) for x in (df, back))
        assert one == two, name
    lines = {(r["doc_id"], r["text"]) for r in stages["line_dedup"](spark, df, sf).collect()}
    assert lines == {(i, t or "") for i, t, *_ in rows}
    kept = key((r["doc_id"], r["text"]) for r in stages["ngram_jaccard"](spark, df, sf).collect())
    assert kept == key([(None, "a b c d e"), (1, None), (2, ""), (3, "x\ny"), (5, "long " * 40_000)])  # x y is the same two words
    mixed = stages["mixing"](spark, df, sf).collect()
    assert {r["doc_id"] for r in mixed} <= {None, 3, 4, 5} and all((r["text"] or "").split() for r in mixed)
    tokens = stages["bpe"](spark, df, sf).collect()
    assert len(tokens) == 7 and {r["n_tokens"] for r in tokens if r["doc_id"] in (1, 2)} == {0}
