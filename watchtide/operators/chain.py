"""Chain data: state samples, log binding, flash-loan candidates, finality, reorganisations."""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import hex_words, i256_to_double, scale, u256_to_double
from ..functions.texts import sanitise_protocol

def state_samples(calls: DataFrame) -> DataFrame:
    """Results of state calls as drawdown samples (scaled, times price) and pause states (not zero). A call
    without result keeps its row with ``parse_error``."""
    word = F.get(hex_words(F.col("result")), F.lit(0))
    failed = word.isNull()
    number = u256_to_double(word)
    return calls.select(
        "*",
        F.when(failed, "error").otherwise(F.col("kind")).alias("metric"),
        F.when(~failed & (F.col("kind") == "tvl"), scale(number, F.col("decimals")) * F.col("price_usd")).alias("tvl_usd"),
        F.when(~failed & (F.col("kind") == "pause"), number != 0).alias("paused"),
        F.when(failed, "rpc_state_error").alias("parse_error"),
    )


def bound_answers(logs: DataFrame, bindings: DataFrame) -> DataFrame:
    """One normalised event for each protocol bound to the log's contract and topic; the event key names the
    protocol only where a log has several."""
    rows = logs.join(bindings, ["address", "topic0"])
    n = F.count("*").over(Window.partitionBy("tx_hash", "log_index", "address", "topic0"))
    base = F.concat_ws(":", "chain", "tx_hash", F.col("log_index").cast("string"))
    return rows.withColumn("event_key", F.when(n > 1, F.concat_ws(":", base, "protocol")).otherwise(base)).withColumn("oracle_price", scale(F.col("raw_answer"), F.col("decimals")))


def flash_loan_candidates(logs: DataFrame) -> DataFrame:
    """Decode flash-loan logs by protocol family. The first family has four topics and its fee in word 2 of
    four words or more, else in word 1; the second has three topics and its fee in word 1."""
    protocol = sanitise_protocol(F.col("protocol"))
    words = hex_words(F.col("data"))
    address = lambda t: F.concat(F.lit("0x"), F.right(t, F.lit(40)))
    number = lambda k: u256_to_double(F.get(words, F.lit(k)))
    first = F.contains(protocol, F.lit("aave")) & (F.col("n_topics") >= 4)
    second = ~F.contains(protocol, F.lit("aave")) & F.contains(protocol, F.lit("balancer")) & (F.col("n_topics") >= 3)
    out = logs.where((first | second) & (F.size(words) >= 2))
    fee = F.when(first & (F.size(words) >= 4), number(2)).otherwise(number(1))
    return out.select("*", protocol.alias("protocol_key"), F.when(first, address(F.col("topic3"))).otherwise(address(F.col("topic2"))).alias("asset"), number(0).alias("loan_amount_raw"), fee.alias("fee_raw"), address(F.col("topic1")).alias("borrower"), F.when(first, address(F.col("topic2"))).alias("initiator"))


def deduped_logs(logs: DataFrame) -> DataFrame:
    """First log of each transaction, log index, address and topic."""
    keys = ["tx_hash", "log_index", "address", "topic0"]
    return logs.withColumn("__n", F.row_number().over(Window.partitionBy(*(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys)).orderBy("event_id"))).where("__n = 1").drop("__n")


def unprocessed(events: DataFrame, done: DataFrame, reverted: DataFrame) -> DataFrame:
    return events.join(done.select("event_key"), "event_key", "left_anti").join(reverted.select("event_key"), "event_key", "left_anti")


def running_head(events: DataFrame, width: int = 1 << 20) -> DataFrame:
    """The highest block seen so far on the chain, in order of arrival.

    There are few chains, so arrivals are cut into ranges of ``width`` ids: the maximum of the ranges before is
    a window over one row per range, and rows are only sorted inside their range."""
    rows = events.withColumn("__range", F.floor(F.col("event_id") / width))
    highest = rows.groupBy("chain", "__range").agg(F.max("block_number").alias("__high"))
    before = F.max("__high").over(Window.partitionBy("chain").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    starts = highest.select("chain", "__range", before.alias("__before"))
    inner = F.max("block_number").over(Window.partitionBy("chain", "__range").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0))
    return rows.join(starts, ["chain", "__range"]).withColumn("head", F.greatest("__before", inner)).drop("__range", "__before")


def orphaned(events: DataFrame) -> DataFrame:
    """Reorganisations of stored events: heights with several hashes, and per chain the lowest of them with
    the keys at or above it. Heights are aggregated first; only one row per chain is joined back."""
    heights = events.where("block_hash IS NOT NULL").groupBy("chain", "block_number").agg(F.count_distinct("block_hash").alias("hashes"))
    lowest = heights.where("hashes > 1").groupBy("chain").agg(F.min("block_number").alias("orphaned_from"))
    return events.join(lowest, "chain").where("block_number >= orphaned_from")


def confirmations(events: DataFrame, depth: int) -> DataFrame:
    """Block finality of chains without a reorganisation: an event is confirmed by the first event (in order
    of arrival) whose running head reaches its height plus ``depth``.

    Heads are first reduced to the events that raise them. The event that first reaches a height is the one
    that raised the head to it or to the next head above; those are looked up inside ranges of heights, and
    for the last heights of a range in a window over one row per range."""
    width = 4096
    heads = running_head(events)
    rises = heads.groupBy("chain", "head").agg(F.min("event_id").alias("reached_by")).withColumn("range", F.floor(F.col("head") / width))
    asked = events.select("chain", (F.col("block_number") + depth).alias("head"), "event_key", "block_number", "event_id").withColumn("ask", F.lit(True)).withColumn("range", F.floor(F.col("head") / width))
    both = rises.withColumn("ask", F.lit(False)).unionByName(asked, allowMissingColumns=True)
    w = Window.partitionBy("chain", "range").orderBy(F.desc("head"), "ask").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("here", F.last("reached_by", ignorenulls=True).over(w)).where("ask")
    ranges = asked.select("chain", "range").distinct().join(rises.groupBy("chain", "range").agg(F.min("reached_by").alias("first")), ["chain", "range"], "full")
    later = F.min("first").over(Window.partitionBy("chain").orderBy("range").rowsBetween(1, Window.unboundedFollowing))
    found = found.join(ranges.select("chain", "range", later.alias("later")), ["chain", "range"]).withColumn("by", F.coalesce("here", "later"))
    return found.select("chain", "event_key", "block_number", "event_id", F.when(F.col("by").isNotNull(), F.greatest("by", "event_id")).alias("confirmed_by"))


FINALITY_SCHEMA = "chain string, event_id long, event_key string, status string, orphaned_from long"


def finality_step(state: dict, chain: str, rows, horizon: int | None = None) -> list[tuple]:
    """Fold events of one chain, in order of arrival, over ``state``: ``(event_id, block, hash, key, depth)``.

    With ``horizon``, blocks further below the head are forgotten with their keys, here and there and afterwards: no
    reorganisation may be deeper than that, and no key may come again after it. Heights are kept in order, so a
    reorganisation costs what it takes back, however many blocks there are."""
    out = []
    blocks, status = state["blocks"], state["status"]
    heights = sorted(blocks)

    def forget() -> None:
        old = heights[: bisect_left(heights, state["head"] - horizon)]
        del heights[: len(old)]
        for b in old:
            for k in blocks.pop(b)["keys"]:
                status.pop(k, None)

    for event_id, block, block_hash, key, depth in rows:
        known = blocks.get(block)
        if known and block_hash is not None and known["hash"] is not None and known["hash"] != block_hash:
            first = bisect_left(heights, block)
            gone = heights[first:]
            del heights[first:]
            out.append((chain, event_id, None, "reorg", block))
            for b in gone:
                for k in blocks[b]["keys"]:
                    if status.get(k) != "retracted":
                        status[k] = "retracted"
                        out.append((chain, event_id, k, "retracted", block))
                del blocks[b]
            state["head"] = heights[-1] if heights else 0
            known = None
        if known is None:
            blocks[block] = {"hash": block_hash, "keys": []}
            insort(heights, block)
        entry = blocks[block]
        if entry["hash"] is None:
            entry["hash"] = block_hash
        entry["keys"].append(key)
        state["head"] = max(state["head"], block)
        if key not in status:
            status[key] = "provisional"
            out.append((chain, event_id, key, "provisional", None))
        safe = max(0, state["head"] - depth)
        due = []
        while state["pending"] and state["pending"][0] <= safe:
            due.append(heapq.heappop(state["pending"]))
        if block > safe:
            heapq.heappush(state["pending"], block)
        elif block not in due:
            due.append(block)
        for b in due:
            for k in blocks.get(b, {"keys": []})["keys"]:
                if status[k] == "provisional":
                    status[k] = "confirmed"
                    out.append((chain, event_id, k, "confirmed", None))
        if horizon is not None and state["head"] - heights[0] > 2 * horizon + 2:
            forget()
    if horizon is not None:
        forget()
    return out


def new_state() -> dict:
    return {"head": 0, "blocks": {}, "status": {}, "pending": []}


def answers(logs: DataFrame) -> DataFrame:
    return logs.withColumn("raw_answer", i256_to_double(F.col("topic1")))
