"""Exact top-k inner-product search with ball trees, one for each shard of the candidates.

Vectors become integers, ``floor(scale * x)`` of each component. Candidates are dealt into shards of bounded
size; each shard builds a ball tree (halves along the direction of largest spread; centre and radius at each
node). Queries come in blocks; a block meets every shard. In a shard, a node is visited with those of the
block's queries whose upper bound ``q . centre + |q| * radius`` reaches their current k-th score, children
with the larger bounds first, so that later nodes are cut off. The k-th score is shared: a block starts with
the scores that its queries get against a bounded sample of candidates, and keeps what it found in the shards
that the same task has searched before (8 KB for each block of 1,024 queries).

All blocks are broadcast if they are small (``BROADCAST`` bytes, checked); otherwise each block is sent once to each
part of the shards, and each part builds its trees once and lets the blocks stream past them.

Rows whose vector is null, empty, or holds null or non-finite components take no part, nor do rows without id;
vectors of different lengths never meet. A query never gets rows with its own id; rows that share an id count once each, and of
query rows that share an id only the one with the smallest vector is used. Ties go to smaller ids. Scores are
exact, however large the components; a score among a query's best that a long can't hold is an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, stored

#: Rows of a shard, queries of a block, rows of a leaf, rows of the sample; bytes of all blocks up to which they are broadcast; shards of a part.
SHARD, BLOCK, LEAF, PILOT = 4096, 1024, 64, 2048
BROADCAST, PART = 64 << 20, 8
_NONE, _HIGH = -(1 << 63), (1 << 63) - 1
_LOW = _NONE + 1  # _LOW and _HIGH stand for all scores from there on


def _largest(x: np.ndarray) -> np.ndarray:
    return np.abs(x).max(axis=1, initial=0.0)


def _product(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of vectors of whole numbers (as doubles)."""
    if not q.size or not x.size:
        return np.zeros((len(q), len(x)), np.int64)
    large_q, large_x, d = _largest(q), _largest(x), q.shape[1]
    if float(large_q.max()) * float(large_x.max()) * d < 1 << 53:
        return np.rint(q @ x.T).astype(np.int64)
    bound = 2.0 ** ((62 - d.bit_length()) // 2)  # components up to here make sums below 2^62
    out, big_q, big_x = np.empty((len(q), len(x)), np.int64), large_q > bound, large_x > bound
    out[np.ix_(~big_q, ~big_x)] = q[~big_q].astype(np.int64) @ x[~big_x].astype(np.int64).T
    whole = np.vectorize(int, otypes=[object])
    for i, j in ((big_q, ~big_x), (np.ones(len(q), bool), big_x)):
        if i.any() and j.any():
            out[np.ix_(i, j)] = np.clip(whole(q[i]) @ whole(x[j]).T, _LOW, _HIGH).astype(np.int64)
    return out


class BallTree:
    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = LEAF):
        self.leaf, self.order = leaf, np.arange(len(ids))
        self.nodes: list[tuple[int, int, int, int]] = []  # from, to, left, right (-1: leaf)
        self.centres, self.radii = [], []
        with np.errstate(over="ignore", invalid="ignore"):
            self._build(x, 0, len(ids))
        self.ids, self.x = ids[self.order], x[self.order]
        self.centres, self.radii = np.array(self.centres), np.array(self.radii)

    def _build(self, x: np.ndarray, a: int, b: int) -> int:
        own = x[self.order[a:b]]
        centre, number = np.nan_to_num(own.mean(axis=0)), len(self.nodes)
        self.nodes.append((a, b, -1, -1))
        self.centres.append(centre)
        self.radii.append(float(np.sqrt(((own - centre) ** 2).sum(axis=1).max())) * (1 + 1e-9) + 1e-6)
        if b - a > self.leaf:
            axis = int(np.argmax(np.nan_to_num(own.var(axis=0), nan=np.inf)))
            half = (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(own[:, axis], half)]
            self.nodes[number] = (a, b, self._build(x, a, a + half), self._build(x, a + half, b))
        return number

    def search(self, query_ids: np.ndarray, q: np.ndarray, best: np.ndarray, who: np.ndarray) -> None:
        """Merge this shard's candidates into ``best`` (scores, descending) and ``who`` (their ids)."""
        self.q, self.query_ids, self.best, self.who = q, query_ids, best, who
        with np.errstate(over="ignore", invalid="ignore"):
            size = np.sqrt((q**2).sum(axis=1))[:, None]
            self.bounds = q @ self.centres.T + size * self.radii
            self.bounds += (size * (np.sqrt((self.centres**2).sum(axis=1)) + self.radii)) * 1e-9 + 1e-3
        self.bounds[np.isnan(self.bounds)] = np.inf  # too large to bound: always visited
        np.maximum(self.bounds, float(_NONE), out=self.bounds)
        self._visit(0, np.arange(len(q)))

    def _visit(self, node: int, live: np.ndarray) -> None:
        live = live[self.bounds[live, node] >= self.best[live, -1]]
        if not len(live):
            return
        a, b, left, right = self.nodes[node]
        if left >= 0:
            for child in sorted((left, right), key=lambda c: -self.bounds[live, c].sum()):
                self._visit(child, live)
            return
        scores = _product(self.q[live], self.x[a:b])
        ids = np.broadcast_to(self.ids[a:b], scores.shape)
        scores = np.where(ids == self.query_ids[live][:, None], _NONE, scores)
        merge(self.best, self.who, live, scores, ids)


def merge(best: np.ndarray, who: np.ndarray, live: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
    some = (scores >= best[live, -1:]).any(axis=1)
    live, scores, ids = live[some], scores[some], ids[some]
    if not len(live):
        return
    scores, ids = np.c_[best[live], scores], np.c_[who[live], ids]
    order = np.lexsort((ids, ~scores), axis=-1)[:, : best.shape[1]]
    best[live], who[live] = np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def whole_numbers(df: DataFrame, vec_id: str, embedding: str, scale: int) -> DataFrame:
    """``id, v array<double>, d`` of the rows that take part: ``floor(scale * x)``, which doubles hold exactly."""
    v = F.col(f"`{embedding}`").cast("array<double>")
    good = df.select(F.col(f"`{vec_id}`").cast("long").alias("id"), v.alias("x")).where(F.col("id").isNotNull() & (F.size("x") > 0))
    good = good.where(F.forall("x", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))))
    # from 2^52 on a double is a whole number; floor() of Spark gives a long
    floor = lambda c: F.when(F.abs(c) < 2.0**52, F.floor(c).cast("double")).when(F.abs(c) < float("inf"), c).otherwise(F.raise_error(F.lit("a scaled component doesn't fit into a double")).cast("double"))
    return good.select("id", F.transform("x", lambda c: floor(c * scale)).alias("v"), F.size("x").alias("d"))


def _matrix(column: pa.ListArray, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


def top_k(df: DataFrame, is_query: Column, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 10, scale: int = 1024, shard: int = SHARD, block: int = BLOCK, pilot: int = PILOT, broadcast: int = BROADCAST) -> DataFrame:
    """The ``k`` highest scores of every row for which ``is_query`` (a condition on ``id``) holds, against
    all other rows: ``query_id, rank, vec_id, score``."""
    points = stored(whole_numbers(df, vec_id, embedding, scale))
    spark = df.sparkSession
    queries = stored(points.where(is_query).groupBy("id", "d").agg(F.min("v").alias("v")))
    sizes = {r["d"]: (r["n"], r["q"]) for r in points.groupBy("d").agg(F.count("*").alias("n"), F.sum(is_query.cast("long")).alias("q")).collect()}
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    of = lambda i, per: F.create_map(*(F.lit(x) for d, nq in sizes.items() for x in (d, max(1, -(-(nq[i] or 0) // per)))))[F.col("d")]
    sample = points.orderBy(F.xxhash64("id"), "id").limit(pilot).toArrow()
    first: dict[int, tuple] = {}
    for d in sizes:
        own = sample.filter(pa.array([n == d for n in sample["d"].to_pylist()], pa.bool_()))
        first[d] = (own["id"].to_numpy(), _matrix(own["v"].combine_chunks(), d))
    first = spark.sparkContext.broadcast(first)

    def pack(group):
        """A group's vectors as one row of bytes."""
        ids = group["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        x = _matrix(group["v"].combine_chunks(), group["d"][0].as_py())[order]
        return pa.table({"d": pa.array([x.shape[1]], pa.int32()), "part": pa.array([group["part"][0].as_py()], pa.int32()), "ids": pa.array([ids[order].astype("<i8").tobytes()], pa.binary()), "data": pa.array([x.astype("<f8").tobytes()], pa.binary())})

    packed = "d int, part int, ids binary, data binary"
    dealt = lambda rows, n: rows.withColumn("part", F.pmod(F.xxhash64("id", F.lit(7)), n).cast("int")).select("id", "v", "d", "part").groupBy("d", "part").applyInArrow(pack, packed)
    shards = dealt(points, of(0, shard)).withColumnRenamed("part", "shard")
    blocks = stored(dealt(queries, of(1, block)).withColumnRenamed("part", "block"))

    def against(trees: list, known: dict, d: int, number: int, q_ids: np.ndarray, q: np.ndarray):
        if (d, number) not in known:
            known[d, number] = _pilot(first.value[d], q_ids, q, k)
        floor = known[d, number]
        best, who = np.repeat(floor[:, None], k, axis=1), np.full((len(q), k), np.iinfo(np.int64).max)
        for tree in trees:
            tree.search(q_ids, q, best, who)
        known[d, number] = np.maximum(floor, best[:, -1])
        at = np.nonzero((who != np.iinfo(np.int64).max) & (best > _NONE))
        return pa.RecordBatch.from_arrays([pa.array(q_ids[at[0]]), pa.array(who[at]), pa.array(best[at])], ["query_id", "vec_id", "score"])

    vectors = lambda ids, data, d: (np.frombuffer(ids, "<i8"), np.frombuffer(data, "<f8").reshape(-1, d))
    found_schema = "query_id long, vec_id long, score long"
    if sum((q or 0) * (8 * d + 8) for d, (_, q) in sizes.items()) <= broadcast:
        own = blocks.toArrow()
        shared = spark.sparkContext.broadcast([(d, number, *vectors(ids, data, d)) for d, number, ids, data in zip(*(own[c].to_pylist() for c in ("d", "block", "ids", "data")), strict=True)])

        def search(batches):
            known: dict = {}
            for batch in batches:
                for r in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                    tree = BallTree(*vectors(r["ids"], r["data"], r["d"]))
                    for d, number, q_ids, q in shared.value:
                        if d == r["d"]:
                            yield against([tree], known, d, number, q_ids, q)

        found = shards.select("d", "shard", "ids", "data").mapInArrow(search, found_schema)
    else:
        parts = of(0, shard * PART)
        held = shards.withColumn("part", F.floor(F.col("shard") / PART).cast("int")).select("d", "part", F.lit(-1).alias("block"), "ids", "data")
        sent = blocks.select("d", F.explode(F.sequence(F.lit(0), (parts - 1).cast("int"))).alias("part"), "block", "ids", "data")
        # a part's shards sort before its blocks, which stream past
        both = held.unionByName(sent).repartition("d", "part").sortWithinPartitions("d", "part", "block")

        def search(batches):
            at, trees, known = None, [], {}
            for batch in batches:
                for r in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                    if at != (r["d"], r["part"]):
                        at, trees = (r["d"], r["part"]), []
                    if r["block"] < 0:
                        trees.append(BallTree(*vectors(r["ids"], r["data"], r["d"])))
                    else:
                        yield against(trees, known, r["d"], r["block"], *vectors(r["ids"], r["data"], r["d"]))

        found = both.mapInArrow(search, found_schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k)
    score = F.when(F.col("score").isin(_LOW, _HIGH), F.raise_error(F.lit("a score doesn't fit into a long")).cast("long")).otherwise(F.col("score"))
    out = stored(best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", score.alias("score")))
    for x in (points, queries, blocks):
        dropped(x)
    return out


def _pilot(sample: tuple, q_ids: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
    """By query, the k-th score in the sample, which the true k-th score can't be below."""
    ids, x = sample
    if len(ids) <= k:
        return np.full(len(q), _NONE)
    scores = np.where(ids == q_ids[:, None], _NONE, _product(q, x))
    return np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k]
