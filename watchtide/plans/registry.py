"""Where queries register with their SQL counterparts."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixtures import FIXTURES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` may name fixture views, whose definitions are put in front."""

    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = with_fixtures(sql)
        return f

    return register


def _needed(sql: str, have: set[str]) -> list[str]:
    out = []
    for name in FIXTURES:
        if name not in have and re.search(rf"\b{name}\b", sql):
            have.add(name)
            out += [*_needed(FIXTURES[name], have), name]
    return out


def with_fixtures(sql: str) -> str:
    if any(f"{n} AS (" in sql for n in FIXTURES):
        return sql  # has its fixtures already
    ctes = ",\n".join(f"{n} AS ({FIXTURES[n]})" for n in _needed(sql, set()))
    if not ctes:
        return sql
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes},\n{body[len('WITH RECURSIVE'):]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[len('WITH '):]}"
    return f"WITH {ctes}\n{body}"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view, or a table, of a data directory."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = with_fixtures(f"SELECT * FROM {name}")
    used = [t for t in TABLES if re.search(rf"\bFROM {t}\b", sql)]
    for t in used:
        sql = re.sub(rf"\bFROM {t}\b", f"FROM {{{t}}}", sql)
    if not used:
        return spark.sql(sql)
    sql = _escape(sql, used)
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def _escape(sql: str, used: list[str]) -> str:
    """Double the braces that aren't table references, as spark.sql's formatting asks."""
    marks = {f"{{{t}}}": f"\x00{t}\x01" for t in used}
    for k, v in marks.items():
        sql = sql.replace(k, v)
    sql = sql.replace("{", "{{").replace("}", "}}")
    return sql.replace("\x00", "{").replace("\x01", "}")
