"""Mixing sources to target weights by hierarchical budgeting.

The corpus is a tree of levels, here domain, language and source, whose leaves hold documents. A token budget
is handed down from the root: at each node it is split among the children by weight. A child can't take more
than its capacity (its tokens times the epochs allowed); what it can't take goes to its siblings by weight, and
only what a whole family can't take is left to its ancestors' siblings. Each leaf then takes whole epochs of
its documents, and of the last epoch a prefix up to its budget, in an order that seed, epoch and id decide.

All of it is DataFrame functions: token sums per leaf, the split of every family in closed form by windows over
its children (one row for each node), and prefix sums in two steps, over ordered buckets of each leaf and then
inside each bucket, so that no leaf is gathered in one task however many documents it holds. What comes out is
one row for each leaf: its whole epochs and the last place that the partial epoch takes. Texts are never
shuffled: documents are compared with their leaf's row.

Null level values are values of their own. Null and empty texts have no tokens; they are never taken. Rows that
share an id have the same place in the order; ties go by the hash of the text, and rows equal in both are taken together or not at all. Children whose weight is not
above 0 get nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, stored

LEVELS = ("domain", "lang", "source")
#: Ordered buckets of a leaf, as hexadecimal digits of the order's hash.
DIGITS = 3


def token_count(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def place(seed: str, epoch: Column, doc_id: Column) -> Column:
    """A document's place in the order of an epoch, as hexadecimal text."""
    return F.md5(F.concat_ws(":", F.lit(seed), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def _split(nodes: DataFrame, parent: list[str], budget: Column) -> DataFrame:
    """Split each family's ``budget`` among its children (columns ``weight``, ``capacity``): adds ``share``.

    Children are sorted by capacity per weight. Those that are filled up come first: child i is, as long as
    what is left for it and the later ones, by weight, reaches its capacity.
    """
    ratio = F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight"))
    nodes = nodes.withColumn("ratio", ratio)
    order = Window.partitionBy(*parent).orderBy(F.col("ratio").asc_nulls_last(), *(c for c in nodes.columns if c in LEVEL_COLUMNS))
    live = F.when(F.col("weight") > 0, F.col("capacity")).otherwise(0.0)
    weight = F.when(F.col("weight") > 0, F.col("weight")).otherwise(0.0)
    before = F.coalesce(F.sum(live).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    later = F.sum(weight).over(order.rowsBetween(0, Window.unboundedFollowing))
    level = F.when(later > 0, (budget - before) / later)
    nodes = nodes.withColumn("level", level).withColumn("full", F.coalesce(F.col("ratio") <= F.col("level"), F.lit(False)))
    # the first child that isn't full sets the level of all that aren't
    family = Window.partitionBy(*parent)
    common = F.max(F.when(~F.col("full") & (F.col("weight") > 0), F.struct(-F.col("ratio"), F.col("level")))).over(family)["level"]
    share = F.when(F.coalesce(F.col("weight") <= 0, F.lit(True)), 0.0).when(F.col("full"), F.col("capacity")).otherwise(F.greatest(F.lit(0.0), common) * F.col("weight"))
    return nodes.withColumn("share", share).drop("ratio", "level", "full")


LEVEL_COLUMNS = ("l0", "l1", "l2")


def budgets(leaves: DataFrame, fraction: float, epochs: int, weights: DataFrame | None = None) -> DataFrame:
    """``l0, l1, l2, tokens, share``: the budget of each leaf. The root's budget is ``fraction`` of all
    tokens. ``weights`` has rows ``l0, l1, l2, weight`` with nulls below an inner node; nodes without a row
    weigh 1."""
    leaves = leaves.withColumn("capacity", F.col("tokens").cast("double") * epochs)
    level = {3: leaves}
    for k in (2, 1):
        level[k] = level[k + 1].groupBy(*LEVEL_COLUMNS[:k]).agg(F.sum("tokens").alias("tokens"), F.sum("capacity").alias("capacity"))
    handed = level[1].groupBy().agg(F.sum("tokens").alias("all")).select(F.lit(0).alias("root"), (F.coalesce("all", F.lit(0)) * fraction).alias("budget"))
    parent: list[str] = ["root"]
    for k in (1, 2, 3):
        own = list(LEVEL_COLUMNS[:k])
        nodes = level[k].withColumn("root", F.lit(0))
        if weights is None:
            nodes = nodes.withColumn("weight", F.lit(1.0))
        else:
            at = weights
            for c in LEVEL_COLUMNS[:k]:
                at = at.where(F.col(c).isNotNull())
            for c in LEVEL_COLUMNS[k:]:
                at = at.where(F.col(c).isNull())
            nodes = nodes.join(at.select(*own, F.col("weight").cast("double")), own, "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
        up = handed.select(*(F.col(c).alias(f"p_{c}") for c in parent), "budget")
        match = [F.col(f"p_{c}").eqNullSafe(F.col(c)) for c in parent]
        nodes = nodes.join(up, match).drop(*(f"p_{c}" for c in parent))
        nodes = _split(nodes, parent, F.col("budget"))
        handed = nodes.select(*own, "tokens", F.col("share").alias("budget"))
        parent = own
    return handed.withColumnRenamed("budget", "share")


def mix(df: DataFrame, levels: tuple[Column, Column, Column], fraction: float, epochs: int = 1, seed: str = "mix", doc_id: str = "doc_id", text: str = "text", weights: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row the columns ``keep`` and ``id, l0, l1, l2, tokens, copies``: how often the mixture takes it.

    The last, partial epoch takes documents in order as long as fewer tokens than the budget were taken
    before. ``keep`` columns travel along; one that is named like a column above is replaced by it.
    """
    keep = tuple(c for c in keep if c not in ("id", *LEVEL_COLUMNS, "tokens", "copies"))
    rows = df.select(
        *(F.col(f"`{c}`").alias(f"__keep_{c}") for c in keep),
        F.col(f"`{doc_id}`").alias("id"),
        *(x.cast("string").alias(c) for c, x in zip(LEVEL_COLUMNS, levels, strict=True)),
        token_count(F.col(f"`{text}`")).alias("tokens"),
        F.xxhash64(F.col(f"`{text}`")).alias("tie"),
    )
    narrow = stored(rows.select("id", *LEVEL_COLUMNS, "tokens", "tie").where("tokens > 0"))
    leaves = narrow.groupBy(*LEVEL_COLUMNS).agg(F.sum("tokens").alias("tokens"))
    share = F.col("share") / F.col("tokens")
    plan = budgets(leaves, fraction, epochs, weights).select(
        *(F.col(c).alias(f"s_{c}") for c in LEVEL_COLUMNS),
        F.floor(F.round(share, 12)).cast("long").alias("whole"),
        F.round(F.col("share") - F.floor(F.round(share, 12)) * F.col("tokens"), 6).alias("rest"),
    )
    plan = stored(plan)
    match = [F.col(f"s_{c}").eqNullSafe(F.col(c)) for c in LEVEL_COLUMNS]
    placed = narrow.join(plan.where("rest > 0"), match).withColumn("place", place(seed, F.col("whole") + 1, F.col("id"))).withColumn("bucket", F.substring("place", 1, DIGITS))
    key = [f"s_{c}" for c in LEVEL_COLUMNS]
    sums = placed.groupBy(*key, "bucket").agg(F.sum("tokens").alias("sum"))
    before = F.coalesce(F.sum("sum").over(Window.partitionBy(*key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.withColumn("before", before).select(*(F.col(k).alias(f"b{k}") for k in key), F.col("bucket").alias("b"), "before", "sum")
    # only the bucket in which the budget runs out has to be looked into
    last = placed.join(starts, [*(F.col(f"b{k}").eqNullSafe(F.col(k)) for k in key), F.col("b") == F.col("bucket")]).where("before < rest")
    whole_buckets = last.where("before + sum <= rest").groupBy(*key).agg(F.max(F.struct("place", "id", "tie")).alias("last"))
    inner = Window.partitionBy(*key, "bucket").orderBy("place", "id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    split = last.where("before + sum > rest").withColumn("taken", F.col("before") + F.coalesce(F.sum("tokens").over(inner), F.lit(0))).where("taken < rest")
    cut = whole_buckets.unionByName(split.groupBy(*key).agg(F.max(F.struct("place", "id", "tie")).alias("last"))).groupBy(*key).agg(F.max("last").alias("last"))
    cut = cut.select(*(F.col(k).alias(f"c{k}") for k in key), "last")
    table = stored(plan.join(cut, [F.col(f"c{k}").eqNullSafe(F.col(k)) for k in key], "left").select(*key, "whole", "last"))
    out = rows.join(table, match, "left").withColumn("at", F.struct(place(seed, F.coalesce("whole", F.lit(0)) + 1, F.col("id")).alias("place"), "id", "tie"))
    copies = F.coalesce("whole", F.lit(0)) + F.when(F.col("last").isNotNull() & (F.col("at") <= F.col("last")), 1).otherwise(0)
    dropped(narrow)
    return out.select(*(F.col(f"__keep_{c}").alias(c) for c in keep), "id", *LEVEL_COLUMNS, "tokens", F.when(F.col("tokens") > 0, copies).otherwise(0).cast("long").alias("copies"))
