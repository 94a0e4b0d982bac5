"""Configuration readers: tenant policies with defaults, effective streams, tenant sources.

Configuration tables are small by nature, but nothing here forces a broadcast: Spark picks it by size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import let

_BANDS = "struct<medium:double,high:double,critical:double>"
_OVERRIDE = "struct<source_id:string,weight:double,enabled:boolean,stale_timeout_ms:bigint>"
_POLICY = (
    "array<struct<market_key:string,peg_target:double,min_sources:bigint,quorum_pct:double,sustained_window_ms:bigint,cooldown_sec:bigint,stale_timeout_ms:bigint,deescalation_blocks:bigint,resolution_blocks:bigint,"
    f"isolated_floor_pct:double,systemic_floor_pct:double,severity_bands:{_BANDS},severity_bands_isolated:{_BANDS},severity_bands_systemic:{_BANDS},"
    "source_filter:struct<cex_whitelist:array<string>,include_oracles:boolean,include_aggregators:boolean,include_dex:boolean,min_healthy_sources:bigint>,"
    f"toggles:struct<oracle_confirmation:boolean,volume_confirmation:boolean,contagion_detection:boolean>,source_overrides:map<string,{_OVERRIDE}>>>"
)
_FLASH = "struct<rules:array<struct<rule_id:string,enabled:boolean,min_loan_usd:double,min_profit_usd:double,cooldown_sec:bigint>>>"
_TEXTS = lambda *names: ",".join(f"{n}:string" for n in names)
_TVL_NUMBERS = ("fast_drop_pct", "slow_drop_pct", "velocity_critical_pct", "min_tvl_floor_usd", "velocity_critical_minutes", "concurrent_window_minutes", "velocity_window_sec", *(f"{w}_window_{u}" for w in ("fast", "slow") for u in ("minutes", "sec")))
_TVL_SCOPE = ("protocol_id", "chain_slug", "market_id")
_TVL = (
    f"struct<{_TEXTS('rule_id', 'enabled', 'contagion_enabled', 'concurrent_window_sec', *_TVL_SCOPE, *_TVL_NUMBERS)},"
    f"scope:struct<{_TEXTS(*_TVL_SCOPE)}>,thresholds:struct<{_TEXTS(*_TVL_NUMBERS)}>,contagion:struct<{_TEXTS('enabled', 'overlap_window_sec')}>>"
)
#: Defaults of a policy or rule (fixed values).
PEG_DEFAULTS = {"peg_target": 1.0, "min_sources": 3, "quorum_pct": 0.6, "sustained_window_ms": 60_000, "cooldown_sec": 300, "stale_timeout_ms": 30_000, "deescalation_blocks": 5, "resolution_blocks": 30, "isolated_floor_pct": 0.5, "systemic_floor_pct": 0.01}
FLASH_DEFAULTS = {"min_loan_usd": 100_000.0, "min_profit_usd": 1_000.0, "cooldown_sec": 300}
TVL_DEFAULTS = {"fast_drop_pct": 20.0, "slow_drop_pct": 35.0, "velocity_critical_pct": 15.0, "fast_minutes": 10, "slow_minutes": 60, "velocity_minutes": 2, "concurrent_minutes": 5, "min_tvl_floor_usd": 1e6, "protocol_id": "aave_v3", "chain_slug": "base"}


def enabled_configs(tenant_patterns: DataFrame, patterns: DataFrame, pattern: str) -> DataFrame:
    """Configurations of a pattern where both the pattern and the tenant's configuration are enabled."""
    on = patterns.where(F.col("enabled") & (F.col("pattern_id") == pattern)).select("pattern_id")
    return tenant_patterns.where("enabled").join(on, "pattern_id", "left_semi")


#: Configurations that one task reads, about, and parts that they are dealt to at most: Spark writes rows for up to 200 parts
#: straight to files; for more parts it sorts them, and a task holds the texts in memory.
CONFIGS_A_TASK, PARTS_AT_MOST = 5_000, 200


def of_tenants(configs: DataFrame, *rows: DataFrame) -> DataFrame:
    """Configurations of the tenants that the rows are about. What is read from a configuration is far larger than Spark
    can know from the sizes of files, so what no row can use goes before configurations are read and rules are joined."""
    tenants = reduce(DataFrame.unionByName, (r.select("tenant_id").distinct() for r in rows)).distinct()
    return configs.join(tenants, "tenant_id", "left_semi")


def spread(configs: DataFrame, a_task: int = CONFIGS_A_TASK) -> DataFrame:
    """Configurations by tenant in as many parts as their number asks for: a small file is one part otherwise, and one task
    reads all its JSON. Readers take a part row by row, so parts may grow where there are many configurations."""
    n = configs.count()
    return configs if n <= a_task else configs.repartition(min(-(-n // a_task), PARTS_AT_MOST), "tenant_id")


def peg_policies(configs: DataFrame) -> DataFrame:
    """One row per market policy, as ``detectors.peg_evaluations`` takes them; those without market or with settings
    out of range are invalid. Of several for one market, the last one counts. A tenant has one configuration, as the
    reference's table has it, so each is worked through on its own, without a shuffle or sort of policies."""
    setting = lambda p, k: F.coalesce(p[k], F.lit(PEG_DEFAULTS[k]))
    positive = ("peg_target", "min_sources", "sustained_window_ms", "stale_timeout_ms", "isolated_floor_pct", "systemic_floor_pct", "deescalation_blocks", "resolution_blocks")

    def valid(p: Column) -> Column:
        some = F.coalesce(F.trim(p["market_key"]), F.lit("")) != ""
        return reduce(Column.__and__, (setting(p, k) > 0 for k in positive), some) & setting(p, "quorum_pct").between(0, 1) & (setting(p, "cooldown_sec") >= 0)

    def last(policies: Column) -> Column:
        places = F.filter(F.transform(policies, lambda p, i: F.when(valid(p), F.struct(p["market_key"].alias("market_key"), i.alias("i")))), lambda x: x.isNotNull())
        ends = lambda x: F.filter(x, lambda y, j: F.coalesce(F.get(x, j + 1)["market_key"] != y["market_key"], F.lit(True)))
        return F.transform(let(F.sort_array(places), ends), lambda x: F.get(policies, x["i"]))

    rows = configs.select("tenant_id", F.explode(let(F.from_json("config", _POLICY), last)).alias("p"))
    fields = [setting(F.col("p"), k).alias(k) for k in PEG_DEFAULTS]
    wanted = F.coalesce("p.severity_bands_isolated", F.when(F.col("p.severity_bands.medium") > 0, F.col("p.severity_bands")))
    flag = lambda path, name, default: F.coalesce(F.col(f"p.{path}.{name}"), F.lit(default)).alias(name)
    return rows.select(
        "tenant_id", F.col("p.market_key").alias("market_key"), *fields, wanted.alias("severity_bands_isolated"), F.col("p.severity_bands_systemic").alias("severity_bands_systemic"),
        F.col("p.source_filter.cex_whitelist").alias("cex_whitelist"), *(flag("source_filter", k, True) for k in ("include_oracles", "include_aggregators", "include_dex")), flag("source_filter", "min_healthy_sources", 1),
        *(flag("toggles", k, False) for k in ("oracle_confirmation", "volume_confirmation", "contagion_detection")), F.coalesce("p.source_overrides", F.create_map().cast(f"map<string,{_OVERRIDE}>")).alias("overrides"),
    )


def flash_rules(configs: DataFrame) -> DataFrame:
    """Enabled rules with their place in the configuration; an invalid configuration is one default rule."""
    parsed = configs.select("tenant_id", F.from_json("config", _FLASH)["rules"].alias("rules"))
    default = F.array(F.struct(F.lit("default").alias("rule_id"), F.lit(True).alias("enabled"), *(F.lit(v).cast("bigint" if k == "cooldown_sec" else "double").alias(k) for k, v in FLASH_DEFAULTS.items())))
    rows = parsed.select("tenant_id", F.posexplode(F.coalesce("rules", default)).alias("rule_order", "r")).where("coalesce(r.enabled, true)")
    return rows.select("tenant_id", "rule_order", F.col("r.rule_id").alias("rule_id"), *(F.coalesce(F.col(f"r.{k}"), F.lit(v)).alias(k) for k, v in FLASH_DEFAULTS.items()))


def tvl_rules(configs: DataFrame) -> DataFrame:
    """Enabled drawdown rules, each for a protocol on a chain or one of its markets.

    Thresholds stand under ``thresholds`` or at the top of a rule, scopes under ``scope`` or at the top; windows are in
    minutes, or else in seconds that are rounded up to minutes, 1 at least. A rule with a market that isn't ``all`` is about that
    market, unless ``scope`` says ``protocol``. Rules with thresholds of zero or less, a negative floor, or a market
    scope without market are invalid and left out; a tenant without any valid rule, enabled or not, gets the default one."""
    items = F.from_json("config", "struct<rules:array<string>>")["rules"]
    rows = configs.select("tenant_id", F.posexplode_outer(items).alias("rule_order", "r"))
    # Each rule's text is read once, by a generator: nothing above it can repeat the reading. A ``scope`` may also be a text.
    rows = rows.where(F.ltrim("r").startswith("{")).select("tenant_id", "rule_order", F.get_json_object("r", "$.scope").alias("said"), F.inline(F.array(F.from_json("r", _TVL))))
    got = lambda *paths: F.coalesce(*(F.col(p) for p in paths))
    text = lambda k: F.lower(F.coalesce(F.nullif(F.trim(got(f"scope.{k}", k)), F.lit("")), F.lit(TVL_DEFAULTS[k]))).alias(k)
    number = lambda k, *paths: F.coalesce(F.trim(got(*paths)).try_cast("double"), F.lit(TVL_DEFAULTS[k])).alias(k)
    both = lambda k: (f"thresholds.{k}", k)

    def whole(*paths: str) -> Column:
        x = F.trim(got(*paths))
        return F.when(x.rlike("^[+-]?[0-9]+$"), x.try_cast("bigint"))

    def minutes(k: str, own: tuple, sec: tuple) -> Column:
        return F.greatest(F.coalesce(whole(*own), F.floor((whole(*sec) + 59) / 60), F.lit(TVL_DEFAULTS[f"{k}_minutes"])), F.lit(1)).cast("bigint").alias(f"{k}_minutes")

    market = F.lower(F.trim(got("scope.market_id", "market_id")))
    market = F.when(~market.isin("", "all"), market)
    said = F.lower(F.trim("said"))
    of_market = F.when(said.isin("market", "protocol"), said == "market").otherwise(market.isNotNull())
    flag = lambda *paths: F.coalesce(got(*paths).try_cast("boolean"), F.lit(True))
    rules = rows.select(
        "tenant_id", "rule_order", F.coalesce(F.nullif(F.trim(got("rule_id")), F.lit("")), F.concat(F.lit("tvl-rule-"), (F.col("rule_order") + 1).cast("string"))).alias("rule_id"), text("protocol_id"), text("chain_slug"),
        F.when(of_market, market).alias("market_id"), of_market.alias("__of_market"), *(number(k, *both(k)) for k in ("fast_drop_pct", "slow_drop_pct", "velocity_critical_pct")),
        *(minutes(k, both(f"{k}_window_minutes"), both(f"{k}_window_sec")) for k in ("fast", "slow")), minutes("velocity", both("velocity_critical_minutes"), both("velocity_window_sec")),
        minutes("concurrent", ("concurrent_window_minutes", "thresholds.concurrent_window_minutes"), ("contagion.overlap_window_sec", "concurrent_window_sec")),
        flag("contagion.enabled", "contagion_enabled").alias("contagion_enabled"), number("min_tvl_floor_usd", "min_tvl_floor_usd", "thresholds.min_tvl_floor_usd"), flag("enabled").alias("__enabled"),
    )
    valid = rules.where("fast_drop_pct > 0 AND slow_drop_pct > 0 AND velocity_critical_pct > 0 AND min_tvl_floor_usd >= 0 AND (NOT __of_market OR market_id IS NOT NULL)").drop("__of_market")
    default = {"rule_order": F.lit(0), "rule_id": F.lit("tvl-default"), "market_id": F.lit(None).cast("string"), "contagion_enabled": F.lit(True), "__enabled": F.lit(True)}
    without = configs.select("tenant_id").distinct().join(valid.select("tenant_id"), "tenant_id", "left_anti")
    fallen = without.select("tenant_id", *((default[f.name] if f.name in default else F.lit(TVL_DEFAULTS[f.name])).cast(f.dataType).alias(f.name) for f in valid.schema.fields if f.name != "tenant_id"))
    return valid.unionByName(fallen).where("__enabled").drop("__enabled")


def effective_streams(sources: DataFrame, streams: DataFrame, targets: DataFrame) -> DataFrame:
    """Enabled streams of enabled sources that some enabled target takes; overrides win over the source."""
    s = streams.where("enabled").select("stream_id", "source_id", "endpoint_override", "parser_name", "market_key")
    both = s.join(sources.where("enabled").select("source_id", "source_type", "endpoint"), "source_id")
    both = both.withColumn("endpoint", F.coalesce("endpoint_override", "endpoint")).drop("endpoint_override")
    return both.join(targets.where("enabled").select("stream_id"), "stream_id", "left_semi")


def tenant_sources(overrides: DataFrame, sources: DataFrame) -> DataFrame:
    """Each tenant's enabled sources with their override configuration (``{}`` without)."""
    own = overrides.where("enabled").select("tenant_id", "source_id", "override_config")
    return own.join(sources.where("enabled"), "source_id").select("tenant_id", "source_id", "source_type", F.coalesce("override_config", F.lit("{}")).alias("config"))
