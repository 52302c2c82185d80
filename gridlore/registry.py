"""Registered queries, their SQL, and the views they share."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Views over the given tables in SQL that both engines read: (table, columns).
VIEWS: dict[str, tuple[str, list[str]]] = {
    "games": (
        "orders",
        [
            "o_orderkey AS game_id",
            "CAST(year(o_orderdate) AS INT) AS season",
            "CAST(floor((dayofyear(o_orderdate) - 1) / 7) AS INT) + 1 AS week",
            "CAST(o_orderdate AS DATE) AS game_date",
            "o_orderdate AS kickoff",
            "o_custkey % 25 AS home",
            "(o_custkey + 1 + o_orderkey % 24) % 25 AS away",
            "CAST(floor(o_totalprice) AS BIGINT) % 41 AS home_score",
            "(o_orderkey * 7 + o_custkey) % 38 AS away_score",
            "o_orderkey % 13 = 0 AS neutral",
            "CASE WHEN o_orderpriority LIKE '1%' THEN 'POST' ELSE 'REG' END AS game_type",
            "CASE WHEN CAST(floor(o_totalprice) AS BIGINT) % 41 > (o_orderkey * 7 + o_custkey) % 38 THEN 1e0 WHEN CAST(floor(o_totalprice) AS BIGINT) % 41 = (o_orderkey * 7 + o_custkey) % 38 THEN 5e-1 ELSE 0e0 END AS y",
            "5e-2 + 9e-1 * ((o_orderkey * 37) % 1000) / 1009e0 AS p",
            "1e-1 + 8e-1 * ((o_orderkey * 91) % 500) / 503e0 AS q",
            "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 1e-1 + 8e-1 * ((o_orderkey * 53) % 700) / 701e0 END AS m",
            "(o_orderkey * 11) % 29 / 2e0 - 7e0 AS spread",
            "CASE WHEN o_orderkey % 7 = 0 THEN -150e0 - o_orderkey % 100 ELSE 120e0 + o_orderkey % 80 END AS moneyline",
        ],
    ),
    "plays": (
        "lineitem",
        [
            "l_orderkey AS game_id",
            "CAST(l_linenumber AS BIGINT) AS play_id",
            "CAST(year(l_shipdate) AS INT) AS season",
            "CAST(floor((dayofyear(l_shipdate) - 1) / 7) AS INT) + 1 AS week",
            "l_shipdate AS ts",
            "l_suppkey % 25 AS off",
            "(l_suppkey + 1 + l_partkey % 24) % 25 AS def",
            "l_partkey % 400 AS player",
            "l_suppkey % 60 AS passer",
            "l_extendedprice / l_quantity / 997e0 - 15e-1 AS epa",
            "CAST(floor(l_quantity) AS BIGINT) - 12 AS yards",
            "l_returnflag AS kind",
            "l_linestatus AS status",
            "CASE WHEN l_returnflag = 'N' THEN 0e0 ELSE 1e0 END AS is_pass",
            "CASE WHEN l_discount > 5e-2 THEN 1e0 ELSE 0e0 END AS success",
            "CAST(1 + l_linenumber % 4 AS INT) AS down",
            "1 + CAST(floor(l_quantity) AS BIGINT) % 20 AS togo",
            "1 + l_partkey % 99 AS yardline",
            "(l_partkey * 13) % 1800 AS secs",
            "5e-2 + 9e-1 * ((l_partkey * 31 + l_linenumber * 7) % 997) / 997e0 AS wp",
            "l_tax AS tax",
        ],
    ),
    "teams": ("nation", ["CAST(n_nationkey AS BIGINT) AS team", "n_name AS name", "CAST(n_regionkey AS BIGINT) AS division"]),
    "players": ("part", ["p_partkey AS player", "p_name AS name", "p_brand AS grp", "p_size AS size", "p_retailprice AS price"]),
    "ledger": (
        "orders",
        [
            "o_custkey AS key",
            "o_orderkey AS run_id",
            "o_orderdate AS run_at",
            "CAST('1998-01-01' AS TIMESTAMP) AS deadline",
            "5e-2 + 9e-1 * ((o_orderkey * 37) % 1000) / 1009e0 AS p",
            "o_orderstatus AS source",
        ],
    ),
}


#: Games with a league of their own for each hundred customers, so that leagues grow with the table.
VIEWS["league_games"] = ("orders", [*VIEWS["games"][1], "CAST(floor(o_custkey / 100) AS BIGINT) AS league"])


class Tables:
    """The tables of a folder and the views over them, read on demand."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        table, columns = VIEWS.get(name, (name, ["*"]))
        return self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet").selectExpr(*columns)


def _sql(sql: str, rounded: str) -> str:
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    heads = ", ".join(f"{v} AS (SELECT {', '.join(VIEWS[v][1])} FROM {VIEWS[v][0]})" for v in used)
    if heads:
        sql = re.sub(r"^\s*(WITH(?:\s+RECURSIVE)?)\s+", rf"\1 {heads}, ", sql) if re.match(r"\s*WITH\s", sql) else f"WITH {heads} {sql}"
    if rounded:
        sql = f"SELECT * REPLACE ({', '.join(f'round({c}, 6) + 0e0 AS {c}' for c in rounded.split())}) FROM ({sql})"
    return sql


def tidy(df: DataFrame) -> DataFrame:
    """Doubles to six places, so that the order of a sum does not show."""
    return df.withColumns({f.name: F.round(f.name, 6) + F.lit(0.0) for f in df.schema if isinstance(f.dataType, DoubleType)})


def query(name: str, sql: str | None = None, r: str = "") -> Callable:
    """Register `f(tables)` under `name`; `r` names the doubles of the SQL."""

    def wrap(f: Callable[[Tables], DataFrame]) -> Callable:
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, sf_dir: tidy(f(Tables(spark, sf_dir)))
        if sql:
            ORACLE[name] = _sql(sql, r)
        return f

    return wrap
