"""Block finality with reorganisations, in ranges of a chain instead of a fold over the whole of it.

An event (in order of arrival) at a height whose stored block has another hash is a conflict: it rolls back all blocks
from that height on. From the conflicts follows all the rest:

* A conflict needs an earlier event at the height with another hash, the last one there that has a hash. Those
  candidates are found by height. A candidate is none if a conflict between the two events, at a lower height, took the
  stored block away; only candidates whose spans overlap decide each other.
* An event is rolled back by the first later conflict at its height or below: found in ranges of heights.
* The head is the running maximum since the last conflict, from the highest block that the conflict left.
* An event is confirmed by the first event, from itself on and before it is rolled back, whose head less its own
  depth reaches the height: found in stretches of arrivals, then by the stretches' highest.
* A key is provisional with its first event, retracted when any event of it is first rolled back (for good), and
  confirmed before that when any of its events is.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

#: Confirmations by chain; chains that aren't listed need ``DEFAULT_DEPTH`` (fixed values).
DEPTHS, DEFAULT_DEPTH = {"base": 64, "offchain": 1}, 3
#: Heights of a range.
HEIGHTS = 1024
#: How many times as long the ranges of the next level are.
WIDER = 16
#: Arrivals (ids) of a stretch.
ARRIVALS = 1 << 16


def chain_depth(chain: Column, depths: dict[str, int] | None = None, default: int = DEFAULT_DEPTH) -> Column:
    out = F.lit(max(default, 1))
    for k, v in (DEPTHS if depths is None else depths).items():
        out = F.when(chain == k, max(v, 1)).otherwise(out)
    return out.cast("long")


def own_depth(events: DataFrame, depths: dict[str, int] | None = None, default: int = DEFAULT_DEPTH) -> Column:
    """The event's own depth (1 at least) where it requires confirmation, else its chain's."""
    chain = chain_depth(F.col("chain"), depths, default)
    if "requires_confirmation" not in events.columns:
        return chain
    return F.when(F.col("requires_confirmation"), F.greatest(F.coalesce(F.col("confirmation_depth").cast("long"), F.lit(1)), F.lit(1))).otherwise(chain)


def conflicts(events: DataFrame) -> DataFrame:
    """``chain, event_id, block_number`` of the events that roll blocks back."""
    hashed = events.where("block_hash IS NOT NULL").select("chain", "event_id", "block_number", "block_hash")
    at_height = Window.partitionBy("chain", "block_number").orderBy("event_id")
    before = hashed.withColumn("before", F.lag(F.struct("event_id", "block_hash")).over(at_height))
    found = before.where("before.block_hash != block_hash").select("chain", "event_id", "block_number", F.col("before.event_id").alias("since"))
    # candidates whose spans overlap: a new group begins where all earlier spans have ended
    found = found.withColumn("__range", F.floor(F.col("event_id") / ARRIVALS))
    ends = found.groupBy("chain", "__range").agg(F.max("event_id").alias("end"), F.min("since").alias("start"))
    linked = ends.withColumn("__group", F.sum(F.when(F.min("start").over(Window.partitionBy("chain").orderBy("__range").rowsBetween(0, Window.unboundedFollowing)) > F.lag("end").over(Window.partitionBy("chain").orderBy("__range")), 1).otherwise(0)).over(Window.partitionBy("chain").orderBy("__range")))
    grouped = found.join(linked.select("chain", "__range", "__group"), ["chain", "__range"]).select("chain", "__group", "event_id", "block_number", "since")

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, ids, heights = None, [], []  # conflicts so far that no later one at their height or below hides
        for pdf in batches:
            out = []
            for chain, group, event, block, since in pdf.itertuples(index=False):
                if at != (chain, group):
                    at, ids, heights = (chain, group), [], []
                k = bisect_left(heights, block) - 1  # the latest conflict at a lower height
                if k >= 0 and ids[k] > since:
                    continue
                out.append((chain, event, block))
                k = bisect_left(heights, block)
                del ids[k:], heights[k:]
                ids.append(event)
                heights.append(block)
            yield pd.DataFrame(out, columns=["chain", "event_id", "block_number"])

    return grouped.repartition("chain", "__group").sortWithinPartitions("chain", "__group", "event_id").mapInPandas(decide, "chain string, event_id long, block_number long")


def covering(low: int, high: int) -> list[tuple[int, int]]:
    """Ranges ``(level, number)`` that together cover the ranges ``low`` to ``high`` of level 0; each level's are
    ``WIDER`` times as long as those of the level below."""
    out, level = [], 0
    while low <= high:
        while low % WIDER and low <= high:
            out.append((level, low))
            low += 1
        while (high + 1) % WIDER and low <= high:
            out.append((level, high))
            high -= 1
        low, high, level = low // WIDER, (high + 1) // WIDER - 1, level + 1
    return out


def rolled_back(events: DataFrame, found: DataFrame) -> DataFrame:
    """Add ``gone_by, gone_from``: the conflict that rolls the event back, and its height; null if none does.

    A conflict stands in ranges of heights that cover all from its own up to the highest that its chain had by then; the
    higher ones are wider, so that there are few however deep it reaches. Only the events of such ranges are looked
    at one by one, from the last to the first."""
    tops = running_max(events.select("chain", "event_id", F.col("block_number").alias("__v")), "__v", "top")
    spans, heights = found.join(tops.select("chain", "event_id", "top"), ["chain", "event_id"]), HEIGHTS

    def cover(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(c, e, b, *x) for c, e, b, top in pdf.itertuples(index=False) for x in covering(b // heights, top // heights)]
            yield pd.DataFrame(out, columns=["chain", "event_id", "block_number", "level", "part"])

    spans = written(spans.select("chain", "event_id", "block_number", "top").mapInPandas(cover, "chain string, event_id long, block_number long, level int, part long"), "spans")
    key = ["chain", "level", "part"]
    levels = [r[0] for r in spans.select("level").distinct().collect()]  # one for each factor WIDER of the highest height
    places = F.explode(F.array(*(F.struct(F.lit(n).alias("level"), F.floor(F.col("block_number") / (HEIGHTS * WIDER**n)).alias("part")) for n in levels)).cast("array<struct<level:int,part:bigint>>"))
    asked = events.select("chain", "event_id", "block_number", places.alias("p")).select("chain", "p.level", "p.part", "event_id", "block_number", F.lit(False).alias("conflict"))
    rows = asked.join(spans.select(*key).distinct(), key, "left_semi").select(asked.columns).unionByName(spans.withColumn("conflict", F.lit(True)).select(asked.columns))

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, ids, heights = None, [], []  # later conflicts, the nearest and highest last
        for pdf in batches:
            out = []
            for chain, level, part, event, block, conflict in pdf.itertuples(index=False):
                if at != (chain, level, part):
                    at, ids, heights = (chain, level, part), [], []
                if conflict:
                    k = bisect_left(heights, block)
                    del ids[k:], heights[k:]
                    ids.append(event)
                    heights.append(block)
                else:
                    k = bisect_left(heights, block + 1) - 1
                    if k >= 0:
                        out.append((chain, event, ids[k], heights[k]))
            yield pd.DataFrame(out, columns=["chain", "event_id", "gone_by", "gone_from"])

    # an event that is a conflict itself comes before it in this order, as it isn't rolled back by itself
    order = rows.repartition(*key).sortWithinPartitions(*key, F.desc("event_id"), "conflict")
    gone = order.mapInPandas(look, "chain string, event_id long, gone_by long, gone_from long").groupBy("chain", "event_id").agg(F.min(F.struct("gone_by", "gone_from")).alias("g"))
    return events.join(gone.select("chain", "event_id", "g.*"), ["chain", "event_id"], "left")


def running_max(rows: DataFrame, value: str, out: str, keys: tuple[str, ...] = ("chain",)) -> DataFrame:
    """Add the running maximum of a key's rows in order of ``event_id``, by stretches of arrivals."""
    rows = rows.withColumn("__stretch", F.floor(F.col("event_id") / ARRIVALS))
    tops = rows.groupBy(*keys, "__stretch").agg(F.max(value).alias("__top"))
    before = F.max("__top").over(Window.partitionBy(*keys).orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1))
    inner = F.max(value).over(Window.partitionBy(*keys, "__stretch").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0))
    return rows.join(tops.select(*keys, "__stretch", before.alias("__before")), [*keys, "__stretch"]).withColumn(out, F.greatest("__before", inner)).drop("__stretch", "__before")


def remaining_heads(events: DataFrame, found: DataFrame) -> DataFrame:
    """``chain, event_id, left``: the highest block that each conflict leaves, 0 if none.

    It is looked for in the range of heights right below, and for conflicts that find nothing there, in ranges
    sixteen times as long each time."""
    blocks = events.groupBy("chain", "block_number", "gone_by").agg(F.min("event_id").alias("born"))
    todo, out, size = found.select("chain", "event_id", "block_number"), None, HEIGHTS
    while True:
        # the range that the height below is in, and the one before it
        asked = todo.withColumn("__range", F.explode(F.array(F.floor((F.col("block_number") - 1) / size), F.floor((F.col("block_number") - 1) / size) - 1)))
        b = blocks.select("chain", F.col("block_number").alias("height"), "gone_by", "born", F.floor(F.col("block_number") / size).alias("__range"))
        hit = asked.join(b, ["chain", "__range"]).where("height < block_number AND born < event_id AND (gone_by IS NULL OR gone_by > event_id)").groupBy("chain", "event_id").agg(F.max("height").alias("left"))
        both = written(todo.join(hit, ["chain", "event_id"], "left"), "heads")
        done = both.where("left IS NOT NULL").select("chain", "event_id", "left")
        out = done if out is None else out.unionByName(done)
        todo = both.where("left IS NULL").drop("left")
        highest = todo.agg(F.max("block_number")).first()[0]
        if highest is None or size > highest:
            return out.unionByName(todo.select("chain", "event_id", F.lit(0).cast("long").alias("left")))
        size *= 16


def heads(events: DataFrame, found: DataFrame) -> DataFrame:
    """Add ``head`` after each event: the running maximum since the last conflict, from what that left."""
    start = F.lit(True)
    marked = events.join(remaining_heads(events, found).withColumn("__starts", start), ["chain", "event_id"], "left")
    rows = marked.withColumn("__stretch", F.floor(F.col("event_id") / ARRIVALS))
    n = F.sum(F.when(F.col("__starts"), 1).otherwise(0))
    counts = rows.groupBy("chain", "__stretch").agg(n.alias("n"))
    before = counts.select("chain", "__stretch", F.coalesce(F.sum("n").over(Window.partitionBy("chain").orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__earlier"))
    inner = n.over(Window.partitionBy("chain", "__stretch").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.join(before, ["chain", "__stretch"]).withColumn("segment", F.col("__earlier") + inner).drop("__stretch", "__earlier", "__starts")
    return running_max(rows.withColumn("__v", F.greatest("block_number", F.coalesce("left", F.lit(0)))), "__v", "head", ("chain", "segment")).drop("__v", "left", "segment")


def first_reached(rows: DataFrame) -> DataFrame:
    """``chain, event_id, reached_by`` for ``rows`` of ``chain, event_id, block_number, final``: the first event from the row's
    own on whose ``final`` is the row's height or more.

    Within a stretch of arrivals rows are looked at from the last to the first. A row that finds nothing there asks
    for the next stretch whose highest reaches it, and then for the event there."""
    rows = rows.select("chain", "event_id", "block_number", "final", F.floor(F.col("event_id") / ARRIVALS).alias("stretch"))

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, ids, tops = None, [], []  # later events, the nearest and lowest last
        for pdf in batches:
            out = []
            for chain, event, block, final, stretch in pdf.itertuples(index=False):
                if at != (chain, stretch):
                    at, ids, tops = (chain, stretch), [], []
                while tops and -tops[-1] <= final:
                    tops.pop()
                    ids.pop()
                tops.append(-final)
                ids.append(event)
                k = bisect_left(tops, 1 - block) - 1  # the nearest whose final is high enough
                out.append((chain, event, block, stretch, ids[k] if k >= 0 else None))
            yield pd.DataFrame(out, columns=["chain", "event_id", "block_number", "stretch", "reached_by"]).astype({"reached_by": "Int64"})

    key = ["chain", "stretch"]
    near = written(rows.repartition(*key).sortWithinPartitions(*key, F.desc("event_id")).mapInPandas(look, "chain string, event_id long, block_number long, stretch long, reached_by long"), "reached")
    open_ = near.where("reached_by IS NULL").groupBy("chain", "stretch", "block_number").agg(F.lit(False).alias("top"))
    tops = rows.groupBy("chain", "stretch").agg(F.max("final").alias("block_number"), F.lit(True).alias("top"))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, ids, highest = None, [], []
        for pdf in batches:
            out = []
            for chain, stretch, block, top in pdf.itertuples(index=False):
                if at != chain:
                    at, ids, highest = chain, [], []
                if top:
                    while highest and -highest[-1] <= block:
                        highest.pop()
                        ids.pop()
                    highest.append(-block)
                    ids.append(stretch)
                else:
                    k = bisect_left(highest, 1 - block) - 1
                    if k >= 0:
                        out.append((chain, stretch, block, ids[k]))
            yield pd.DataFrame(out, columns=["chain", "stretch", "block_number", "there"])

    # one row for each stretch and each height that is left open at its end; a stretch's own highest comes after its questions
    both = open_.unionByName(tops.select(open_.columns)).repartition("chain").sortWithinPartitions("chain", F.desc("stretch"), "top")
    places = both.mapInPandas(ask, "chain string, stretch long, block_number long, there long")
    rise = F.max("final").over(Window.partitionBy("chain", "stretch").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0))
    rises = rows.withColumn("height", rise).groupBy("chain", F.col("stretch").alias("there"), "height").agg(F.min("event_id").alias("by"))
    asked = places.select("chain", "there", F.col("block_number").alias("height"), F.lit(None).cast("long").alias("by"), "stretch")
    w = Window.partitionBy("chain", "there").orderBy(F.desc("height"), F.col("stretch").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    answers = asked.unionByName(rises.withColumn("stretch", F.lit(None).cast("long")).select(asked.columns)).withColumn("by", F.last("by", ignorenulls=True).over(w)).where("stretch IS NOT NULL")
    answers = answers.select("chain", "stretch", F.col("height").alias("block_number"), F.col("by").alias("__later"))
    return near.join(answers, ["chain", "stretch", "block_number"], "left").select("chain", "event_id", F.coalesce("reached_by", "__later").alias("reached_by"))


def finality(events: DataFrame, depths: dict[str, int] | None = None, default: int = DEFAULT_DEPTH) -> DataFrame:
    """Updates of every chain: ``chain, event_id, event_key, status, orphaned_from``.

    ``status`` is ``provisional, confirmed, retracted`` for a key, or ``reorg`` without key, by the event that brings
    it about; retractions and reorganisations name the height from which blocks are rolled back. Events are in order of
    ``event_id`` (unique in a chain), with ``block_number``, ``block_hash`` (null: unknown), ``event_key``, and, if there,
    ``requires_confirmation`` and ``confirmation_depth``."""
    rows = written(events.select("chain", "event_id", "block_number", "block_hash", "event_key", own_depth(events, depths, default).alias("depth")), "events")
    found = written(conflicts(rows), "conflicts")
    rows = written(rolled_back(rows, found), "rolled")
    rows = heads(rows, found).withColumn("final", F.greatest(F.col("head") - F.col("depth"), F.lit(0)))
    rows = written(rows, "heads")
    reached = rows.join(first_reached(rows), ["chain", "event_id"], "left")
    sure = F.when(F.col("gone_by").isNull() | (F.col("reached_by") < F.col("gone_by")), F.col("reached_by"))
    keys = reached.groupBy("chain", "event_key").agg(F.min("event_id").alias("seen"), F.min(F.when(F.col("gone_by").isNotNull(), F.struct("gone_by", "gone_from"))).alias("gone"), F.min(sure).alias("sure"))
    update = lambda event, key, status, from_: F.struct(event.alias("event_id"), key.alias("event_key"), F.lit(status).alias("status"), from_.alias("orphaned_from"))
    none = F.lit(None).cast("long")
    confirmed = F.when(F.col("sure").isNotNull() & (F.col("gone").isNull() | (F.col("sure") < F.col("gone.gone_by"))), update(F.col("sure"), F.col("event_key"), "confirmed", none))
    retracted = F.when(F.col("gone").isNotNull(), update(F.col("gone.gone_by"), F.col("event_key"), "retracted", F.col("gone.gone_from")))
    updates = keys.select("chain", F.explode(F.array_compact(F.array(update(F.col("seen"), F.col("event_key"), "provisional", none), confirmed, retracted))).alias("u")).select("chain", "u.*")
    return updates.unionByName(found.select("chain", "event_id", F.lit(None).cast("string").alias("event_key"), F.lit("reorg").alias("status"), F.col("block_number").alias("orphaned_from")))


def apply_notices(events: DataFrame, status: DataFrame, notices: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What notices of reorganisations (``chain, orphaned_from, affected``) leave: the events below the lowest height
    that their chain is rolled back to, each chain's head (0 if nothing is left), and ``status`` with the affected keys retracted.

    Keys are retracted once: ``changed`` tells those that weren't before; repeating a notice changes nothing."""
    lowest = notices.groupBy("chain").agg(F.min("orphaned_from").alias("__from"))
    marked = events.join(lowest, "chain", "left")
    left = marked.where("__from IS NULL OR block_number < __from").drop("__from")
    head = marked.groupBy("chain").agg(F.coalesce(F.max(F.when(F.col("__from").isNull() | (F.col("block_number") < F.col("__from")), F.col("block_number"))), F.lit(0)).alias("head"))
    hit = notices.select("chain", F.explode("affected").alias("event_key")).distinct()
    both = status.join(hit.withColumn("__hit", F.lit(True)), ["chain", "event_key"], "left")
    after = both.select("chain", "event_key", F.when(F.col("__hit"), "retracted").otherwise(F.col("status")).alias("status"), (F.col("__hit").isNotNull() & (F.col("status") != "retracted")).alias("changed"))
    return left, head, after
