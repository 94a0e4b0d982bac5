"""Queries on chain data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chain
from ..operators import finality as ranges
from .registry import query, view

DEPTH = 2


@query("c17_bound_answers", """
WITH j AS (SELECT l.*, b.protocol, b.market_key, b.decimals, count(*) OVER (PARTITION BY tx_hash, log_index, address, topic0) AS n FROM chain_positions l JOIN bindings b USING (address, topic0) WHERE topic0 = '0xanswer')
SELECT event_id, protocol, market_key, chain || ':' || tx_hash || ':' || log_index || CASE WHEN n > 1 THEN ':' || protocol ELSE '' END AS event_key, round(CAST(floor(value * 1000) AS BIGINT) / pow(10, decimals), 6) AS oracle_price FROM j""")
def bound_answers(spark, sf_dir):
    logs = view(spark, sf_dir, "chain_positions").where("topic0 = '0xanswer'").withColumn("raw_answer", F.floor(F.col("value") * 1000).cast("double"))
    return chain.bound_answers(logs, view(spark, sf_dir, "bindings")).select("event_id", "protocol", "market_key", "event_key", F.round("oracle_price", 6).alias("oracle_price"))


@query("c18_flash_candidates", """
SELECT event_id, CASE WHEN protocol = 'Aave V3' THEN 'aave_v3' ELSE 'balancer' END AS protocol_key, (1000000 + event_id)::DOUBLE AS loan_amount_raw,
       CASE WHEN protocol = 'Aave V3' AND event_id % 2 = 0 THEN 900 ELSE 250 END::DOUBLE AS fee_raw, '0x' || right(topic1, 40) AS borrower, '0x' || right(CASE WHEN protocol = 'Aave V3' THEN topic3 ELSE topic2 END, 40) AS asset,
       CASE WHEN protocol = 'Aave V3' THEN '0x' || right(topic2, 40) END AS initiator
FROM flash_logs WHERE (protocol = 'Aave V3' AND n_topics >= 4) OR (protocol = 'balancer' AND n_topics >= 3)""")
def flash_candidates(spark, sf_dir):
    return chain.flash_loan_candidates(view(spark, sf_dir, "flash_logs")).select("event_id", "protocol_key", "loan_amount_raw", "fee_raw", "borrower", "asset", "initiator")


@query("d7_unprocessed", "SELECT event_id FROM chain_events WHERE event_id % 3 <> 0 AND event_id % 7 <> 1")
def unprocessed(spark, sf_dir):
    e = view(spark, sf_dir, "chain_events")
    return chain.unprocessed(e, e.where("event_id % 3 = 0"), e.where("event_id % 7 = 1")).select("event_id")


@query("g5_running_head", "SELECT event_id, max(block_number) OVER (PARTITION BY chain ORDER BY event_id) AS head FROM chain_events")
def running_head(spark, sf_dir):
    return chain.running_head(view(spark, sf_dir, "chain_events")).select("event_id", "head")


@query("i3_deduped_logs", "SELECT min(event_id) AS event_id FROM (SELECT *, CASE WHEN event_id % 4 = 0 THEN NULL ELSE log_index END AS li FROM chain_positions) GROUP BY tx_hash, coalesce(CAST(li AS VARCHAR), ''), address, topic0")
def deduped_logs(spark, sf_dir):
    return chain.deduped_logs(view(spark, sf_dir, "chain_positions").withColumn("log_index", F.when(F.col("event_id") % 4 != 0, F.col("log_index")))).select("event_id")


@query("k8_orphaned", """
WITH h AS (SELECT chain, block_number FROM chain_events WHERE block_hash IS NOT NULL GROUP BY ALL HAVING count(DISTINCT block_hash) > 1), l AS (SELECT chain, min(block_number) AS orphaned_from FROM h GROUP BY chain)
SELECT chain, event_key, orphaned_from FROM chain_events JOIN l USING (chain) WHERE block_number >= orphaned_from""")
def orphaned(spark, sf_dir):
    return chain.orphaned(view(spark, sf_dir, "chain_events")).select("chain", "event_key", "orphaned_from")


@query("k7_confirmations", f"""
WITH h AS (SELECT *, max(block_number) OVER (PARTITION BY chain ORDER BY event_id) AS head FROM chain_events),
r AS (SELECT chain, head, min(event_id) AS by FROM h GROUP BY ALL)
SELECT e.chain, e.event_key, min(greatest(r.by, e.event_id)) AS confirmed_by FROM chain_events e JOIN r ON r.chain = e.chain AND r.head >= e.block_number + {DEPTH} GROUP BY ALL""")
def confirmations(spark, sf_dir):
    """Finality without reorganisations, by windows."""
    return chain.confirmations(view(spark, sf_dir, "chain_events"), DEPTH).where("confirmed_by IS NOT NULL").select("chain", "event_key", "confirmed_by")


#: Confirmations by chain in the queries.
DEPTHS = {"ethereum": 2, "base": 5}
_FORKS = """
e AS (SELECT chain, event_id, block_number AS b, block_hash AS h, event_key, CASE WHEN requires_confirmation THEN greatest(confirmation_depth, 1) WHEN chain = 'ethereum' THEN 2 WHEN chain = 'base' THEN 5 ELSE 3 END AS depth FROM chain_events),
cand AS (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY event_id) AS k FROM (SELECT chain, event_id, b, h, lag(event_id) OVER w AS since, lag(h) OVER w AS other FROM e WHERE h IS NOT NULL WINDOW w AS (PARTITION BY chain, b ORDER BY event_id)) WHERE other <> h),
fold AS (
  SELECT DISTINCT chain, 0::BIGINT AS k, []::STRUCT(c BIGINT, q BIGINT)[] AS forks FROM e
  UNION ALL
  SELECT f.chain, n.k, CASE WHEN len(list_filter(f.forks, lambda x: x.c > n.since AND x.q < n.b)) > 0 THEN f.forks ELSE list_append(f.forks, struct_pack(c := n.event_id, q := n.b)) END FROM fold f JOIN cand n ON n.chain = f.chain AND n.k = f.k + 1),
conf AS (SELECT chain, f.c, f.q FROM (SELECT chain, unnest(arg_max(forks, k)) AS f FROM fold GROUP BY chain)),
gone AS (SELECT e.*, (SELECT min(struct_pack(c := x.c, q := x.q)) FROM conf x WHERE x.chain = e.chain AND x.c > e.event_id AND x.q <= e.b) AS g FROM e),
final AS (SELECT a.chain, a.event_id, greatest(max(x.b) - any_value(a.depth), 0) AS final FROM gone a JOIN gone x ON x.chain = a.chain AND x.event_id <= a.event_id AND (x.g IS NULL OR x.g.c > a.event_id) GROUP BY a.chain, a.event_id),
reached AS (SELECT a.*, (SELECT min(f.event_id) FROM final f WHERE f.chain = a.chain AND f.event_id >= a.event_id AND f.final >= a.b) AS r FROM gone a),
keys AS (SELECT chain, event_key, min(event_id) AS seen, min(g) AS g, min(r) FILTER (g IS NULL OR r < g.c) AS sure FROM reached GROUP BY chain, event_key)"""
_FINALITY = f"""WITH RECURSIVE {_FORKS}
SELECT chain, seen AS event_id, event_key, 'provisional' AS status, NULL::BIGINT AS orphaned_from FROM keys
UNION ALL SELECT chain, sure, event_key, 'confirmed', NULL FROM keys WHERE sure IS NOT NULL AND (g IS NULL OR sure < g.c)
UNION ALL SELECT chain, g.c, event_key, 'retracted', g.q FROM keys WHERE g IS NOT NULL
UNION ALL SELECT chain, c, NULL, 'reorg', q FROM conf"""


@query("k7_finality", _FINALITY)
def finality(spark, sf_dir):
    """Finality with reorganisations, depths by event and chain, in ranges of heights and arrivals."""
    return ranges.finality(view(spark, sf_dir, "chain_events"), DEPTHS)


_NOTED = "FROM chain_events WHERE event_id % 4 = 0 AND block_number >= 40"
_STATUS = "CASE WHEN event_id % 5 = 0 THEN 'retracted' ELSE 'provisional' END"


def _noticed(spark, sf_dir):
    e = view(spark, sf_dir, "chain_events")
    status = e.select("chain", "event_key", F.when(F.col("event_id") % 5 == 0, "retracted").otherwise("provisional").alias("status"))
    notice = e.where("event_id % 4 = 0 AND block_number >= 40").groupBy("chain", F.col("block_number").alias("orphaned_from")).agg(F.collect_list("event_key").alias("affected"))
    return ranges.apply_notices(e, status, notice)


@query("k9_notices", f"""SELECT event_key, CASE WHEN event_id % 4 = 0 AND block_number >= 40 THEN 'retracted' ELSE {_STATUS} END AS status, event_id % 4 = 0 AND block_number >= 40 AND event_id % 5 <> 0 AS changed FROM chain_events""")
def notices(spark, sf_dir):
    """Statuses after notices of reorganisations."""
    return _noticed(spark, sf_dir)[2].select("event_key", "status", "changed")


@query("k9_rolled_back", f"""WITH l AS (SELECT chain, min(block_number) AS f {_NOTED} GROUP BY chain)
SELECT e.chain, coalesce(max(block_number) FILTER (f IS NULL OR block_number < f), 0) AS head, CAST(count(*) FILTER (f IS NULL OR block_number < f) AS BIGINT) AS n_left FROM chain_events e LEFT JOIN l USING (chain) GROUP BY e.chain""")
def rolled_back(spark, sf_dir):
    """Heads and blocks after notices of reorganisations have rolled chains back."""
    left, head, _ = _noticed(spark, sf_dir)
    return head.join(left.groupBy("chain").agg(F.count("*").alias("n_left")), "chain", "left").select("chain", "head", F.coalesce("n_left", F.lit(0).cast("long")).alias("n_left"))
