"""Connected components of a link table, and fixed-size sets of bits made from a column."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Components of the graph with the edges ``links``: ``node, component`` (smallest node of the
    component) for every node that isn't the smallest of its own component, as a stored table.

    Alternates large-star and small-star steps, until a round changes nothing: each hangs a node's larger
    (smaller) neighbours on its smallest neighbour. Every step is an aggregation with partial results and a join,
    and each round is cut by a table in the shared folder; nothing but a count and a checksum reaches the driver.
    """
    edges = stored(links.select(F.greatest(a, b).alias("node"), F.least(a, b).alias("component")).where("node != component").distinct())
    mark, before = _mark(edges), None
    while mark[0] and mark != before:
        ends = edges.select(F.col("node").alias("u"), F.col("component").alias("v"))
        both = ends.unionByName(ends.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        after = stored(small.select(F.col("u").alias("node"), F.col("v").alias("component")))
        dropped(edges)
        edges, mark, before = after, _mark(after), mark
    return edges


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("node", "component")), F.sum(F.xxhash64("component", "node").bitwiseAND(0xFFFFFFFF))).first())


#: Bits of a set of bits: at least, at most, and for each row that goes in.
LEAST_BITS, MOST_BITS, BITS_PER_ROW = 20, 28, 8


def bit_sets(df: DataFrame, value: Column, conditions: list[Column], rows: int) -> list[np.ndarray]:
    """For each condition, a set of ``2**bits`` bits, as bytes: bit ``value >>> (64 - bits)`` is set for each (well
    mixed) long where it holds.

    Their size follows from the number of ``rows`` (an upper bound will do), up to 32 MB; beyond that, sets fill up: they
    tell less apart, but miss nothing. Words of 64 bits are or-ed on the executors, so the driver gets at most
    ``2**bits / 64`` rows however many there were.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, (rows * BITS_PER_ROW).bit_length()))
    at = df.select(F.shiftrightunsigned(value, 64 - bits).alias("at"), *(c.alias(f"c{i}") for i, c in enumerate(conditions)))
    bit = F.expr("shiftleft(1L, cast(at % 64 as int))")
    ors = [F.bit_or(F.when(F.col(f"c{i}"), bit).otherwise(F.lit(0).cast("long"))).alias(f"b{i}") for i in range(len(conditions))]
    got, out = at.groupBy(F.shiftrightunsigned("at", 6).cast("int").alias("word")).agg(*ors).toArrow(), []
    for i in range(len(conditions)):
        bitmap = np.zeros(1 << (bits - 6), np.int64)
        bitmap[got["word"].to_numpy()] = got[f"b{i}"].to_numpy()
        out.append(bitmap.view(np.uint8))
    return out


def bit_set(df: DataFrame, value: Column, rows: int) -> np.ndarray:
    return bit_sets(df, value, [F.lit(True)], rows)[0]


def in_set(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = (values.view(np.uint64) >> np.uint64(64 - (len(bitmap).bit_length() + 2))).astype(np.int64)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
