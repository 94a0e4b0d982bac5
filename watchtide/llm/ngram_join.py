"""Exact Jaccard join of documents on word shingles, by a token-group matrix.

Words are lower-cased (A-Z) and split at ASCII white space; a document's set holds its distinct shingles of
``width`` words as 64-bit hashes (a shorter text is one shingle; one without words has an empty set and links
with nothing). Two documents link if ``100 * |intersection| >= percent * |union|``.

1. Equal sets are one class, compared once.
2. Classes that share one of their few smallest shingle hashes are compared with a few leaders per hash (those
   whose own smallest hashes are the most common); the links partition similar documents into groups. A second
   round, once shingles are counted, takes as leaders the documents with the fewest shingles of their own.
3. A global order of shingles puts those that stand in many groups last, by steps. Counted are the shingles that
   can reach the index: first those under the smallest hashes of one document of each group; where busy ones are
   among them, as many more as would take their place. If the sizes are x >= y, sets that link have an overlap
   of at least ``o = ceil(percent * (x + y) / (100 + percent))``, and the first ``OVERLAP`` shingles in common (all, if
   o is less) stand within the first ``x - o + OVERLAP`` of the one and the first ``y - o + OVERLAP`` of the other, so only
   those are indexed.
4. The token-group matrix has a row for each shingle, class of sizes and group: the union over the group's
   documents, with their ranges of sizes. From the place of a shingle in its document follows the largest size
   of a document with which it can be among the first ones in common, and so the classes of sizes where it is
   worth a row. Two groups qualify if their unions overlap in ``OVERLAP`` shingles (or as many as their smallest
   sizes need) and their sizes allow a link. Only qualifying groups are opened, and only pairs of documents of
   different groups are compared that have as many of those shingles in common themselves. Groups of copies are
   thus never expanded into all pairs. Where a row of the matrix would bring together too many documents (families of texts that are
   nearly, but not quite similar enough), they are dealt into blocks, and every two blocks compare their
   documents' sketches as a matrix; only pairs that may link come out.

Before texts are fetched, an odd sketch of each set (parities of 1,024 hashed shingle counts) gives a lower
bound on how many shingles two sets differ in; pairs that differ in too many are dropped with certainty.
Comparisons then use the whole sets.

Null texts have empty sets. A row without id takes no part in links (its component is null). Rows that share
an id are taken as one document and share a component: inside, each text of an id has a key of its own, and
the sets of one id are linked. Other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_windows, dropped, map_texts, released, stored, text_buffer
from .components import bit_set, bit_sets, connected, in_set

WIDTH, PERCENT = 4, 85
#: Smallest hashes by which groups are formed; numbers of groups at which a shingle moves to the next step.
FEW, LEADERS, STEPS = 12, 4, (3, 8, 32, 128, 512, 2048, 8192, 32768)
#: Groups that share a shingle before it is called busy; shingles in common that open a group.
BUSY, OVERLAP = 12, 3
#: Pairs of documents of one matrix row from which it is hot, and documents of a block.
HOT, BLOCK = 1 << 12, 256
SKETCH = 1024

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Shingler:
    """Shingle hashes of many texts at once."""

    def __init__(self, width: int = WIDTH):
        self.width, self.up, self.down = width, _powers(_BASE, 1 << 16), _powers(_INVERSE, 1 << 16)
        self.fold = np.arange(256, dtype=np.uint8)
        self.fold[65:91] += 32
        self.white = np.zeros(256, bool)
        self.white[[32, *range(9, 14)]] = True
        self.place = _mixed(np.arange(1, width + 1, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)

    def words(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and hash of every word."""
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        if len(self.up) <= len(data):
            self.up, self.down = _powers(_BASE, 2 * len(data)), _powers(_INVERSE, 2 * len(data))
        word = ~self.white[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        start = np.flatnonzero(word & (np.r_[True, ~word[:-1]] | edge[:-1]))
        end = np.flatnonzero(word & (np.r_[~word[1:], True] | edge[1:])) + 1
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((self.fold[data].astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=sums[1:])
        value = (sums[end] - sums[start]) * self.down[start]
        return np.searchsorted(offsets, start, "right") - 1, _mixed(value + (end - start).astype(np.uint64))

    def sets(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The sorted distinct shingle hashes of each text."""
        offsets, data = text_buffer(column)
        k = self.width
        for a, b in byte_windows(offsets, 1 << 18):
            row, word = self.words(offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]])
            ends = np.searchsorted(row, np.arange(b - a + 1))
            sums = np.zeros(max(0, len(word) - k + 1), np.uint64)
            for i in range(k):
                sums += word[i : i + len(sums)] * self.place[i]
            whole = _mixed(sums + np.uint64(k))
            for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                if y - x >= k:
                    h = np.sort(whole[x : y - k + 1])
                    yield h[np.r_[True, h[1:] != h[:-1]]]
                elif y > x:
                    yield _mixed((word[x:y] * self.place[: y - x]).sum(keepdims=True) + np.uint64(y - x))
                else:
                    yield np.zeros(0, np.uint64)


def prefix_length(n: int, percent: int, overlap: int = 1) -> int:
    return min(n, n - -(-percent * n // 100) + overlap) if n else 0


def needed(x: Column, y: Column, percent: int) -> Column:
    """The least overlap of linked sets of these sizes."""
    return F.ceil((x + y) * percent / (100 + percent))


def short_prefix(n: Column, percent: int) -> Column:
    """Within so many shingles, a set has the first ones in common with every set that links and isn't smaller."""
    return n - needed(n, n, percent) + OVERLAP


def _sketch(h: np.ndarray) -> bytes:
    return np.packbits(np.bincount((h & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1).tobytes()


def _described(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """By document: size, fingerprint and sketch of its set, and the smallest hashes, as many as an index takes."""

    def scan():
        shingler = Shingler(width)

        def run(column: pa.Array) -> list:
            n, print_, sketch, tokens = [], [], [], []
            for h in shingler.sets(column):
                n.append(len(h))
                print_.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest())
                sketch.append(np.frombuffer(_sketch(h), np.int64))
                tokens.append(h[: prefix_length(len(h), percent)].view(np.int64))
            return [pa.array(n, pa.int64()), pa.array(print_, pa.binary()), _lists(sketch), _lists(tokens)]

        return run

    return map_texts(docs, "text", ["id", "doc"], "n long, print binary, sketch array<long>, tokens array<long>", scan)


def _indexed(docs: DataFrame, width: int, percent: int, steps) -> DataFrame:
    """By document: the first shingles in the order of steps, then hashes, and how many are of the first step."""

    def scan():
        shingler = Shingler(width)
        sets = steps.value

        def run(column: pa.Array) -> list:
            n, light, tokens = [], [], []
            for h in shingler.sets(column):
                step, most = np.zeros(len(h), np.int8), prefix_length(len(h), percent, OVERLAP)
                at = np.arange(len(h))
                for bits in sets:  # each holds the later ones
                    at = at[in_set(bits, h[at])]
                    if not len(at):
                        break
                    step[at] += 1
                first = np.argsort(step, kind="stable")[:most] if step.any() else slice(most)
                n.append(len(h))
                light.append(int((step == 0).sum()) if len(h) else 0)
                tokens.append(h[first].view(np.int64))
            return [pa.array(n, pa.int64()), pa.array(light, pa.int64()), _lists(tokens)]

        return run

    return map_texts(docs, "text", ["id"], "n long, light long, tokens array<long>", scan)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64), pa.int64()))


def _counted(docs: DataFrame, roots: DataFrame, width: int, percent: int) -> DataFrame:
    """``token, groups`` for shingles of the documents ``roots`` that can reach the index, as a stored table."""
    context, least = docs.sparkSession.sparkContext, STEPS[0]
    first = stored(roots.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("groups")).where(F.col("groups") >= least))
    of_busy = first.where(F.col("groups") >= BUSY)
    busy = context.broadcast(bit_set(of_busy, F.col("token"), of_busy.count()))

    def has_busy(batches):
        for batch in batches:
            tokens = batch.column(1)
            hit = np.add.reduceat(np.r_[in_set(busy.value, tokens.flatten().to_numpy()), False].astype(np.int64), np.minimum(np.r_[0, np.cumsum(tokens.value_lengths().to_numpy())[:-1]], len(tokens.flatten()))) if len(tokens) else np.zeros(0)
            yield batch.select([0]).filter(pa.array(hit > 0))

    wanted = context.broadcast(bit_set(roots.select("node", "tokens").mapInArrow(has_busy, "node long"), F.xxhash64("node"), roots.count()))

    def further(h: np.ndarray) -> np.ndarray:
        """The shingles that take the place of busy ones, and of those among them as many again."""
        n = prefix_length(len(h), percent)
        part = in_set(busy.value, h[:n]).sum() / n if n else 0.0
        return h[n : n + (len(h) if part == 1 else 8 + int(1.25 * n * part / (1 - part)))] if part else h[:0]

    def count(batches):
        shingler = Shingler(width)
        for batch in batches:
            texts = batch.column(1).filter(pa.array(in_set(wanted.value, batch.column(0).to_numpy())))
            token, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *map(further, shingler.sets(texts))]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n.astype(np.int64))], ["token", "n"])

    more = docs.where("id IS NOT NULL").select(F.xxhash64("id").alias("h"), "text").mapInArrow(count, "token long, n long")
    out = stored(more.groupBy("token").agg(F.sum("n").alias("groups")).where(F.col("groups") >= least).unionByName(first).groupBy("token").agg(F.sum("groups").alias("groups")))
    dropped(first)
    busy.destroy()
    wanted.destroy()
    return out


def _fits(x: str, y: str, percent: int):
    """Sizes x and y allow a link."""
    return (F.col(x) * 100 >= F.col(y) * percent) & (F.col(y) * 100 >= F.col(x) * percent)


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` of node ids that link, as a stored table."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    apart = F.aggregate(F.zip_with("s_a", "s_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    # 100 i >= percent u with u + i = n_a + n_b allows at most (100 - percent) / (100 + percent) of that sum to differ
    near = stored(both.where(apart * (100 + percent) <= (F.col("n_a") + F.col("n_b")) * (100 - percent)).select("a", "b"))
    ids = stored(near.select(F.col("a").alias("id")).unionByName(near.select(F.col("b").alias("id"))).distinct())
    wanted = docs.sparkSession.sparkContext.broadcast(bit_set(ids, F.xxhash64("id"), ids.count()))

    def preselect(batches):
        for batch in batches:
            keep = in_set(wanted.value, batch.column(2).to_numpy(zero_copy_only=False))
            yield batch.filter(pa.array(keep)).select([0, 1])

    texts = docs.select("id", "text", F.xxhash64("id").alias("h")).mapInArrow(preselect, "id long, text string").join(ids, "id", "left_semi")
    with_texts = near.join(texts.select(F.col("id").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("y")), "b")

    def compare(batches):
        shingler = Shingler(width)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):  # so many pairs have their sets in memory at once
                batch = whole.slice(at, 1024)
                a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                sets = {}
                for ids_, texts_ in ((a, batch.column(2)), (b, batch.column(3))):
                    new = {x: i for i, x in enumerate(ids_.tolist()) if x not in sets}
                    sets.update(zip(new, shingler.sets(texts_.take(pa.array(list(new.values()), pa.int64()))), strict=True))
                keep = []
                for x, y in zip(a.tolist(), b.tolist(), strict=True):
                    x, y = sets[x], sets[y]
                    at_y = np.searchsorted(y, x)
                    common = int((y[np.minimum(at_y, len(y) - 1)] == x).sum()) if len(y) else 0
                    keep.append(100 * common >= percent * (len(x) + len(y) - common) and common > 0)
                yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    out = stored(with_texts.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long"))
    dropped(near)
    dropped(ids)
    wanted.destroy()
    released(docs.sparkSession)
    return out


def _block_pairs(larger: DataFrame, smaller: DataFrame, hot: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """``a, b`` of the hot matrix rows (``token, kind, docs_a, docs_b``) that sizes, places and sketches let link, as a stored table."""
    numbers = ("node", "g", "n", "room")

    def pack(group):
        first, sketch = group.slice(0, 1), group["sketch"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        own = [pa.array([group[c].to_numpy().astype("<i8").tobytes()], pa.binary()) for c in numbers]
        return pa.table([first["token"], first["kind"], *own, pa.array([sketch.astype("<i8").tobytes()], pa.binary())], ["token", "kind", *numbers, "sketch"])

    def packed(rows: DataFrame, side: str) -> DataFrame:
        rows = rows.join(hot, ["token", "kind"]).select("token", "kind", F.col(side).alias("node"), F.col(f"g{side}").alias("g"), F.col(f"n_{side}").alias("n"), F.col(f"room_{side}").alias("room"), F.pmod(F.xxhash64(side), F.ceil(F.col(f"docs_{side}") / BLOCK)).alias("block"))
        rows = rows.join(known.select("node", "sketch"), "node").select("token", "kind", "block", *numbers, "sketch")
        out = rows.groupBy("token", "kind", "block").applyInArrow(pack, "token long, kind long, node binary, g binary, n binary, room binary, sketch binary")
        return out.select("token", "kind", *(F.col(c).alias(f"{c}_{side}") for c in (*numbers, "sketch")))

    def compare(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                (a, ga, n_a, room_a), (b, gb, n_b, room_b) = ([np.frombuffer(r[f"{c}_{k}"], "<i8") for c in numbers] for k in "ab")
                x, y = (np.frombuffer(r[f"sketch_{k}"], "<u8").reshape(-1, SKETCH // 64) for k in "ab")
                ok = (ga[:, None] != gb) & (n_a[:, None] >= n_b) & (n_a[:, None] * percent <= n_b * 100) & (room_a[:, None] >= n_b) & (room_b >= n_a[:, None])
                i, j = np.nonzero(ok)
                apart = np.bitwise_count(x[i] ^ y[j]).sum(axis=1, dtype=np.int64)
                keep = apart * (100 + percent) <= (n_a[i] + n_b[j]) * (100 - percent)
                p, q = a[i[keep]], b[j[keep]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q))], ["a", "b"])

    both = packed(larger, "a").join(packed(smaller, "b"), ["token", "kind"]).drop("token", "kind")
    names = [f"{c}_{k}" for k in "ab" for c in (*numbers, "sketch")]
    return stored(both.select(*names).mapInArrow(compare, "a long, b long").distinct())


def row_key(doc_id: Column, text: Column) -> Column:
    """A row's id and text in 64 bits; null without id."""
    return F.when(doc_id.isNotNull(), F.xxhash64(doc_id.cast("long"), text.cast("string")))


def jaccard_components(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT, few: int = FEW, steps: tuple[int, ...] = STEPS) -> DataFrame:
    """Per row: ``id, n_shingles`` (size of its set), ``component_id`` (smallest id reachable by links), the
    row's ``key`` (``row_key``) and ``kept``: whether the row represents its component (smallest id, then key) or
    has no id."""
    real = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc"), F.col(f"`{text}`").cast("string").alias("text"))
    docs = real.select(row_key(F.col("doc"), F.col("text")).alias("id"), "doc", "text")
    spark = docs.sparkSession
    described = _described(docs, width, percent)
    # empty sets are equal only within an id
    described = stored(described.withColumn("print", F.when(F.col("n") == 0, F.concat(F.lit("id "), F.col("doc").cast("string")).cast("binary")).otherwise(F.col("print"))))
    rows = stored(described.select("id", "doc", "n", "print"))
    some = described.where("n > 0 and id is not null")
    # 1. classes of equal sets, by their smallest key; the classes of one id are linked
    nodes = stored(rows.where("id is not null").groupBy("print", "n").agg(F.min("id").alias("node"), F.min(F.struct("doc", "id")).alias("least")))
    several_sets = rows.where("id is not null").groupBy("doc").agg(F.min("print").alias("p"), F.max("print").alias("q")).where("p != q").select("doc")
    same_id = stored(rows.where("id is not null").join(several_sets, "doc", "left_semi").join(nodes, ["print", "n"]).select("doc", "node").distinct())
    same = same_id.join(same_id.groupBy("doc").agg(F.min("node").alias("a")), "doc").where("a != node").select("a", F.col("node").alias("b"))
    own = some.join(nodes.select("node", "print", "n"), ["print", "n"]).where("id = node").dropDuplicates(["node", "print"])
    known = stored(own.select("node", "n", "sketch", "tokens"))
    dropped(described)
    released(spark)
    # 2. groups of similar documents, by links with leaders
    posts = stored(known.select(F.explode(F.slice("tokens", 1, few)).alias("token"), "node", "n"))
    shared = posts.groupBy("token").agg(F.count("*").alias("docs")).where("docs > 1")
    meeting = posts.join(shared, "token")
    scored = meeting.join(meeting.groupBy("node").agg(F.sum(F.log("docs")).alias("score")), "node")
    best = [F.min(F.struct(-F.col("score"), F.xxhash64("node", F.lit(i)), "node", "n")).alias(f"leader{i}") for i in range(LEADERS)]
    leaders = scored.groupBy("token").agg(*best).select("token", F.explode(F.array_distinct(F.array(*(F.struct(f"leader{i}.node", f"leader{i}.n") for i in range(LEADERS))))).alias("leader"))
    star = meeting.join(leaders, "token").select("node", "n", F.col("leader.node").alias("leader"), F.col("leader.n").alias("leader_n"))
    star = star.where("node != leader").where(_fits("n", "leader_n", percent)).select(F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b")).distinct()
    first = _verified(star, known, docs, width, percent)
    dropped(posts)
    groups = connected(first)
    released(spark)
    # 3. the order, from one document of each group, and the index
    counts = _counted(docs, known.join(groups.select("node"), "node", "left_anti"), width, percent)
    released(spark)
    order = spark.sparkContext.broadcast(bit_sets(counts, F.col("token"), [F.col("groups") >= x for x in steps], counts.count()))
    dropped(counts)
    who = known.select("node", "n").distinct().join(groups.withColumnRenamed("component", "g"), "node", "left").select(F.col("node").alias("id"), "n", F.coalesce("g", "node").alias("g"))
    index = stored(_indexed(docs, width, percent, order).join(who, ["id", "n"]).withColumnRenamed("id", "node"))
    dropped(groups)
    order.destroy()
    released(spark)
    placed = index.select("node", "n", "light", "g", F.posexplode("tokens").alias("at", "token")).withColumn("short", F.col("at") < short_prefix(F.col("n"), percent))
    several = placed.groupBy("token").agg(F.min("g").alias("g0"), F.max("g").alias("g1"), F.max("short").alias("any_short"), F.count("*").alias("docs"), F.min(F.struct("light", "node", "n", "g")).alias("leader"))
    several = stored(several.where("g0 != g1 and any_short").select("token", "docs", "leader"))
    released(spark)
    posts = stored(placed.join(several.select("token"), "token").drop("light", "g"))
    # the document with the fewest shingles of its own links best: a second round of leaders for busy shingles
    again = placed.join(several.where(F.col("docs") >= BUSY), "token").where("g != leader.g").select("node", "n", F.col("leader.node").alias("leader"), F.col("leader.n").alias("leader_n"))
    again = again.where(_fits("n", "leader_n", percent)).select(F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b")).distinct()
    more = _verified(again, known, docs, width, percent)
    dropped(index)
    dropped(several)
    groups = connected(first.unionByName(more))
    # 4. the matrix, and the groups that it opens
    placed = posts.join(groups.withColumnRenamed("component", "g"), "node", "left").withColumn("g", F.coalesce("g", "node"))
    room = F.floor((F.col("n") - F.col("at") + OVERLAP - 1) * (100 + percent) / percent) - F.col("n")  # the largest size that its place allows
    kind = lambda n: F.floor(F.log(n.cast("double")) * (4 / np.log(100 / percent)))
    placed = placed.withColumn("room", room)
    larger = placed.where(F.col("room") * 100 >= F.col("n") * percent)
    larger = larger.withColumn("kind", F.explode(F.sequence(kind(F.ceil(F.col("n") * percent / 100)), kind(F.least("n", "room"))))).select("token", "kind", F.col("g").alias("ga"), F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("room").alias("room_a"))
    smaller = placed.where("short").select("token", kind(F.col("n")).alias("kind"), F.col("g").alias("gb"), F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("room").alias("room_b"))
    all_larger, all_smaller = larger, smaller = stored(larger), stored(smaller)
    dropped(posts)
    dropped(groups)
    released(spark)
    count = lambda rows, name: rows.groupBy("token", "kind").agg(F.count("*").alias(name))
    hot = stored(count(larger, "docs_a").join(count(smaller, "docs_b"), ["token", "kind"]).where(F.col("docs_a") * F.col("docs_b") > HOT))
    in_blocks = _block_pairs(larger, smaller, hot, known, percent)
    larger, smaller = (rows.join(hot.select("token", "kind"), ["token", "kind"], "left_anti") for rows in (all_larger, all_smaller))
    x = larger.groupBy("token", "kind", "ga").agg(*(f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("n_a", "room_a")))
    y = smaller.groupBy("token", "kind", "gb").agg(*(f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("n_b", "room_b")))
    may_link = F.expr(f"ga != gb AND max_n_a >= min_n_b AND max_room_a >= min_n_b AND max_room_b >= min_n_a AND min_n_a * {percent} <= max_n_b * 100")
    opened = stored(x.join(y, ["token", "kind"]).where(may_link).select("token", "kind", "ga", "gb", "min_n_a", "max_n_a", "max_room_a", "min_n_b"))
    enough = lambda a, b: F.col("common") >= F.least(F.lit(OVERLAP), needed(F.col(a), F.col(b), percent))
    qualified = opened.groupBy("kind", "ga", "gb").agg(F.count("*").alias("common"), F.min("min_n_a").alias("a"), F.min("min_n_b").alias("b")).where(enough("a", "b")).select("kind", "ga", "gb")
    bounds = F.expr(f"max_n_a >= n_b AND max_room_a >= n_b AND room_b >= min_n_a AND min_n_a * {percent} <= n_b * 100")
    links = F.expr(f"n_a >= n_b AND n_a * {percent} <= n_b * 100 AND room_a >= n_b AND room_b >= n_a")
    across = opened.drop("min_n_b").join(qualified, ["kind", "ga", "gb"], "left_semi").join(smaller, ["token", "kind", "gb"]).where(bounds).drop("min_n_a", "max_n_a", "max_room_a").join(larger, ["token", "kind", "ga"]).where(links)
    pairs = across.groupBy("a", "b", "n_a", "n_b").agg(F.count("*").alias("common")).where(enough("n_a", "n_b"))
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(in_blocks)
    second = _verified(pairs.distinct(), known, docs, width, percent)
    for x in (opened, all_larger, all_smaller, hot, in_blocks, known):
        dropped(x)
    final = connected(first.unionByName(more).unionByName(second).unionByName(same))
    for x in (first, more, second, same_id):
        dropped(x)
    classes = nodes.join(final, "node", "left").select("print", "n", "least", F.coalesce("component", "node").alias("root"))
    heads = classes.groupBy("root").agg(F.min("least").alias("head"))
    classes = classes.join(heads, "root").select("print", "n", "head")
    has_id = F.col("id").isNotNull()
    out = rows.join(classes, ["print", "n"], "left").select(
        F.col("doc").alias("id"), F.col("n").alias("n_shingles"), F.when(has_id, F.col("head.doc")).alias("component_id"), F.col("id").alias("key"), (~has_id | (F.col("head.id") == F.col("id"))).alias("kept")
    )
    out = stored(out)
    for x in (rows, nodes, final):
        dropped(x)
    released(spark)
    return out
