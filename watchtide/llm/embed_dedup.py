"""Near-duplicate embeddings by iterative quantisation and multi-index Hamming tables.

Rotations are learned on a bounded sample so that the signs of a centred, rotated vector make a balanced
binary code with little quantisation error (a few rotations from different fixed starts, one code each).
Every vector is coded. Each code is cut into substrings, one hash table each; a vector probes a table with its
own substring and those that lack one of its set bits, so that of two substrings that differ in a bit one probes the other. Substrings
grow with the logarithm of the number of vectors, so that a table's buckets don't, and there are as many rotations as keep the
expected recall (``RECALL`` at the threshold). A probe carries an id and two codes, however many rotations there are.
Buckets of many rows are cut into shares.

Vectors are sorted by their first code and cut into blocks. Where many vectors of a block share a bucket with many of
another (a dense group of near copies), the two blocks are compared as a whole, once, as a matrix product; out of that come
counts and a few links that hold the found components together, never all pairs. Other pairs are taken from each rotation's
first table that brings them together, if the Hamming distance of its code and of the next one is small. All are compared by the original
vectors: cosine in double precision, so that no pair below the threshold ever links.

Equal vectors are one class, compared once. Vectors that are null, zero, or hold null or non-finite
components link with nothing; vectors of different lengths don't link. A row without id links with nothing
and has no component; rows that share an id share a component. Other columns play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import dropped, stored
from .components import connected

#: Rows to learn from, least bits of a table's substring, distance of two codes up to which pairs are reranked (share of the bits), expected recall at the threshold.
SAMPLE, SUBSTRING, REACH, RECALL = 4096, 16, 0.3, 0.985
#: Vectors of a block, vectors of a block in one bucket from which it is dense there, and rows of a bucket that are a share of their own.
BLOCK, DENSE, SHARE = 256, 8, 1024
#: Buckets hold 2 ** WIDER vectors that have nothing to do with one another: substrings are that much shorter, so that fewer tables do.
WIDER = 3


def tables(n: int, bits: int, least: float, substring: int = SUBSTRING, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a substring and rotations for ``n`` vectors: a bit of two vectors at the threshold's angle differs by
    chance ``p``, and a table finds them if at most one of its bits does. A vector sends half as many probes as a table has
    bits: 108 for 50,000 vectors, 276 for ten million."""
    size = min(bits, max(substring, (n - 1).bit_length() - WIDER))
    p = float(np.arccos(np.clip(least, -1, 1)) / np.pi)
    found = (1 - p) ** size + size * p * (1 - p) ** (size - 1)
    wanted = np.log(1 - recall) / np.log1p(-min(found, 1 - 1e-9))
    return size, max(1, int(np.ceil(wanted / (bits // size))))


@dataclass
class Quantiser:
    mean: np.ndarray
    turns: list[np.ndarray]  # dimension by bit

    @property
    def bits(self) -> int:
        return self.turns[0].shape[1]

    def codes(self, x: np.ndarray) -> np.ndarray:
        """One unsigned 64-bit code for each rotation."""
        x = x / np.linalg.norm(x, axis=1, keepdims=True) - self.mean
        out = np.zeros((len(x), len(self.turns)), np.uint64)
        for i, turn in enumerate(self.turns):
            sign = x @ turn > 0
            for b in range(self.bits):
                out[:, i] |= sign[:, b].astype(np.uint64) << np.uint64(b)
        return out


def learn(x: np.ndarray, rotations: int = 3, rounds: int = 40) -> Quantiser:
    """Principal directions, then alternately the nearest signs and the rotation that fits them best."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    mean = x.mean(axis=0)
    bits = min(64, x.shape[1])
    v = np.linalg.eigh((x - mean).T @ (x - mean))[1][:, ::-1][:, :bits]
    z, turns = (x - mean) @ v, []
    for i in range(rotations):
        r = np.linalg.qr(np.random.default_rng(i).standard_normal((bits, bits)))[0]
        for _ in range(rounds):
            left, _, right = np.linalg.svd(np.where(z @ r > 0, 1.0, -1.0).T @ z)
            r = (left @ right).T
        turns.append(v @ r)
    return Quantiser(mean, turns)


def usable(column: pa.Array) -> np.ndarray:
    """Which vectors are neither null nor zero and hold only finite components."""
    out = np.zeros(len(column), bool)
    for i, x in enumerate(column):
        if x.is_valid and len(x.values):
            v = x.values
            if not v.null_count:
                v = v.to_numpy(zero_copy_only=False).astype(np.float64)
                out[i] = bool(np.isfinite(v).all() and v.any())
    return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors as rows; shorter ones are filled up with zeros, longer ones folded."""
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), column.value_lengths().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out, row = np.zeros((len(sizes), width)), np.repeat(np.arange(len(sizes)), sizes)
    np.add.at(out, (row, (np.arange(len(flat)) - np.repeat(np.r_[0, np.cumsum(sizes)[:-1]], sizes)) % width), flat)
    out[~out.any(axis=1)] = 1.0
    return out


def near_duplicates(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", least: float = 0.9, sample: int = SAMPLE, substring: int = SUBSTRING, reach: float = REACH, dense: int = DENSE) -> DataFrame:
    """Per row ``id, n_links, component_id, kept``; ``least`` is the cosine from which two vectors link."""
    own = df.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{embedding}`").alias("v"))
    kind = own.schema["v"].dataType

    def select(batches):
        for batch in batches:
            yield batch.filter(pa.array(usable(batch.column(1))))

    valid = own.where("id is not null and v is not null").mapInArrow(select, own.schema)
    valid = stored(valid.withColumn("print", F.unhex(F.md5(F.concat_ws(",", F.col("v").cast("array<double>").cast("array<string>"))))))
    nodes = stored(valid.groupBy("print").agg(F.min("id").alias("node"), F.count("*").alias("copies")))
    vectors = stored(valid.join(nodes.withColumnRenamed("node", "id"), ["id", "print"], "left_semi").dropDuplicates(["id", "print"]).select(F.col("id").alias("node"), "v"))
    drawn = vectors.orderBy(F.xxhash64("node"), "node").limit(sample).toArrow()
    copies = stored(nodes.groupBy("node").agg(F.sum("copies").alias("copies")))
    if not drawn.num_rows:
        links, linked = stored(df.sparkSession.createDataFrame([], "a long, b long")), stored(df.sparkSession.createDataFrame([], "node long, linked long"))
    else:
        links, linked = _links(vectors, copies, drawn.column("v").combine_chunks(), kind, least, substring, reach, dense)
    final = connected(links)
    classes = nodes.join(linked, "node", "left").join(final, "node", "left").select(
        "print", F.col("node").alias("node_"), (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component")
    )
    found = valid.select("id", "print").join(classes, "print").select("id", "n_links", "component", F.lit(True).alias("found"))
    others = own.where(F.col("id").isNull() | F.col("v").isNull()).select("id")

    def rest(batches):
        for batch in batches:
            yield batch.select([0]).filter(pa.array(~usable(batch.column(1))))

    others = others.unionByName(own.where("id is not null and v is not null").mapInArrow(rest, T.StructType([own.schema["id"]])))
    out = found.unionByName(others.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"), F.lit(True).alias("found")))
    out = stored(out.select("id", "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("component") == F.col("id"), F.lit(False)).alias("kept")))
    for x in (valid, nodes, vectors, copies, links, linked, final):
        dropped(x)
    return out


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x / np.linalg.norm(x, axis=1)[:, None]) @ (y / np.linalg.norm(y, axis=1)[:, None]).T


def _links(vectors: DataFrame, copies: DataFrame, drawn: pa.Array, kind: T.DataType, least: float, substring: int, reach: float, dense: int) -> tuple[DataFrame, DataFrame]:
    """Links ``a, b`` that hold the components together, and ``node, linked``: copies of others that a node links with."""
    width = int(np.median(drawn.value_lengths().to_numpy()))
    size, rotations = tables(vectors.count(), min(64, width), least, substring)
    model = learn(_matrix(drawn, width), rotations)
    shared = vectors.sparkSession.sparkContext.broadcast(model)
    names = [f"c{i}" for i in range(rotations)]

    def code(batches):
        for batch in batches:
            codes = shared.value.codes(_matrix(batch.column(1), width)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(np.ascontiguousarray(codes[:, i])) for i in range(rotations))], ["node", "v", "copies", *names])

    def place(batches):
        at = 0
        for batch in batches:
            own = (np.arange(at, at + batch.num_rows) // BLOCK).astype(np.int64)
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own)], [*batch.schema.names, "block"])

    coded = vectors.join(copies, "node").select("node", "v", "copies").mapInArrow(code, T.StructType([T.StructField("node", T.LongType()), T.StructField("v", kind), T.StructField("copies", T.LongType()), *(T.StructField(c, T.LongType()) for c in names)]))
    ordered = coded.repartitionByRange("c0", "node").withColumn("part", F.spark_partition_id().cast("long")).sortWithinPartitions("c0", "node")
    placed = stored(ordered.mapInArrow(place, T.StructType([*ordered.schema.fields, T.StructField("block", T.LongType())])).withColumn("block", F.col("part") * (1 << 40) + F.col("block")).drop("part"))

    each = model.bits // size
    part = lambda c, at: F.shiftrightunsigned(c, at).bitwiseAND((1 << size) - 1)
    # a row for each table: the substring, and two codes for the distance (its own rotation's and the next one's)
    own = F.array(*(F.struct(F.lit(i * each + j).alias("t"), part(f"c{i}", j * size).alias("key"), F.col(f"c{i}").alias("code"), F.col(f"c{(i + 1) % rotations}").alias("check")) for i in range(rotations) for j in range(each)))
    entries = placed.select("node", "block", F.explode(own).alias("e")).select("node", "block", "e.*")
    # of two substrings that differ in one bit, the one that has it probes the other
    flips = F.filter(F.array(*(F.lit(1 << b).cast("long") for b in range(size))), lambda f: F.col("key").bitwiseAND(f) != 0)
    probing = lambda rows: rows.withColumn("flip", F.explode(F.concat(F.array(F.lit(0).cast("long")), flips))).withColumn("key", F.col("key").bitwiseXOR(F.col("flip")))
    # blocks that are dense in the same bucket, or in two that differ in a bit
    cells = stored(entries.groupBy("t", "key", "block").agg(F.count("*").alias("n")).where(F.col("n") >= dense).drop("n"))
    opened = cells.join(probing(cells).withColumnRenamed("block", "other"), ["t", "key"]).select(F.least("block", "other").alias("block_a"), F.greatest("block", "other").alias("block_b")).distinct()
    opened = stored(opened)
    marked = stored(entries.join(cells.withColumn("crowded", F.lit(True)), ["t", "key", "block"], "left").withColumn("crowded", F.coalesce("crowded", F.lit(False))))
    # buckets of many rows are cut into shares; who probes them, probes every share
    busy = stored(marked.groupBy("t", "key").agg(F.ceil(F.count("*") / SHARE).alias("shares")).where("shares > 1"))
    shares = F.coalesce("shares", F.lit(1).cast("long"))

    def met_in_buckets(rows: DataFrame, probes: DataFrame) -> DataFrame:
        held = rows.join(busy, ["t", "key"], "left").withColumn("share", F.pmod(F.xxhash64("node"), shares)).drop("shares")
        probes = probing(probes).select("t", "key", F.col("flip") == 0, F.col("node").alias("a"), F.col("block").alias("other"), F.col("code").alias("code_a"), F.col("check").alias("check_a")).toDF("t", "key", "same", "a", "other", "code_a", "check_a")
        return held.join(probes.join(busy, ["t", "key"], "left").withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), shares - 1))).drop("shares"), ["t", "key", "share"])

    apart = F.bit_count(F.col("code").bitwiseXOR(F.col("code_a"))) + F.bit_count(F.col("check").bitwiseXOR(F.col("check_a")))
    # in each rotation, a pair comes from the first table in which it meets
    meets = F.array(*(F.bit_count(part(F.col("code").bitwiseXOR(F.col("code_a")), j * size)) <= 1 for j in range(each)))
    near = (F.col("a") != F.col("node")) & (apart <= int(2 * reach * model.bits)) & (F.array_position(meets, F.lit(True)) == F.col("t") % each + 1)
    in_order = lambda rows: rows.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b"), F.least("block", "other").alias("block_a"), F.greatest("block", "other").alias("block_b"))
    # rows of crowded cells probe those of others only, as blocks that are both crowded are opened
    alike = in_order(met_in_buckets(marked, marked.where("not crowded")).where(near & (~F.col("same") | F.col("crowded") | (F.col("a") < F.col("node")))))
    mixed = in_order(met_in_buckets(marked.where("not crowded"), marked.where("crowded")).where(near & ~F.col("same")))
    pairs = stored(alike.unionByName(mixed).distinct().join(opened, ["block_a", "block_b"], "left_anti").select("a", "b"))
    side = lambda name, v: placed.select(F.col("node").alias(name), F.col("v").alias(v))
    both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y")

    def rerank(batches):
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            same = x.value_lengths().to_numpy() == y.value_lengths().to_numpy()
            batch = batch.filter(pa.array(same))
            keep = np.zeros(batch.num_rows, bool)
            sizes = batch.column(2).value_lengths().to_numpy()
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                p, q = (_matrix(batch.column(i).take(pa.array(at)), int(d)) for i in (2, 3))
                keep[at] = (p * q).sum(axis=1) / np.sqrt((p * p).sum(axis=1) * (q * q).sum(axis=1)) >= least
            yield batch.select([0, 1]).filter(pa.array(keep))

    singly = stored(both.mapInArrow(rerank, "a long, b long"))

    # whole blocks: one row each, with the vectors as bytes, by their length
    as_given = "<f4" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "<f8"

    def pack(group):
        flat = group["v"].combine_chunks()
        ids, copies_, d = group["node"].to_numpy(), group["copies"].to_numpy(), len(flat[0])
        data = flat.flatten().to_numpy(zero_copy_only=False).astype(as_given)
        return pa.table({"block": group["block"].slice(0, 1), "d": pa.array([d], pa.int32()), "ids": pa.array([ids.tobytes()], pa.binary()), "n": pa.array([copies_.tobytes()], pa.binary()), "data": pa.array([data.tobytes()], pa.binary())})

    wanted = opened.select(F.explode(F.array("block_a", "block_b")).alias("block")).distinct()
    packs = placed.join(wanted, "block", "left_semi").select("block", F.size("v").alias("d"), "node", "copies", "v").groupBy("block", "d").applyInArrow(pack, "block long, d int, ids binary, n binary, data binary")
    packs = stored(packs)
    named = lambda k: packs.select(F.col("block").alias(f"block_{k}"), "d", *(F.col(c).alias(f"{c}_{k}") for c in ("ids", "n", "data")))
    met = opened.join(named("a"), "block_a").join(named("b"), ["block_b", "d"]).select("block_a", "block_b", "d", "ids_a", "n_a", "data_a", "ids_b", "n_b", "data_b")

    def compare(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                (ids, n, x), (ids2, n2, y) = ((np.frombuffer(r[f"ids_{k}"], "<i8"), np.frombuffer(r[f"n_{k}"], "<i8"), np.frombuffer(r[f"data_{k}"], as_given).astype(np.float64).reshape(-1, r["d"])) for k in "ab")
                hit = (_cosines(x, y) >= least) & (ids[:, None] != ids2)
                own = r["block_a"] == r["block_b"]
                node, linked = (ids, hit @ n2) if own else (np.r_[ids, ids2], np.r_[hit @ n2, hit.T @ n])
                # labels: the smallest id that can be reached inside the two blocks
                left, right = ids.copy(), ids if own else ids2.copy()
                while True:
                    after = np.minimum(right, np.where(hit, left[:, None], np.iinfo(np.int64).max).min(axis=0, initial=np.iinfo(np.int64).max))
                    before = np.minimum(left, np.where(hit, after[None, :], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max))
                    if own:
                        after = before = np.minimum(after, before)
                    if (after == right).all() and (before == left).all():
                        break
                    left, right = before, after
                label = left if own else np.r_[left, right]
                some = linked > 0
                yield pa.RecordBatch.from_arrays([pa.array(label[some]), pa.array(node[some]), pa.array(linked[some])], ["a", "b", "linked"])

    wholly = stored(met.mapInArrow(compare, "a long, b long, linked long"))
    turned = singly.unionByName(singly.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counted = turned.join(copies.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), F.col("copies").alias("linked")).unionByName(wholly.select(F.col("b").alias("node"), "linked"))
    linked = stored(counted.groupBy("node").agg(F.sum("linked").alias("linked")))
    links = stored(singly.unionByName(wholly.where("a != b").select("a", "b")))
    for x in (placed, cells, opened, marked, busy, pairs, singly, packs, wholly):
        dropped(x)
    return links, linked
