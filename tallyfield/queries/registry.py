"""The query registry and the survey-shaped views on the driver tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

# view -> (table, column expressions); the texts run in Spark and DuckDB alike
_PLAIN_VIEWS: dict[str, tuple[str, list[str]]] = {
    "v_checklists": ("events", [
        "event_id",
        "CASE WHEN event_id % 5 = 0 THEN concat('G', CAST(CAST(floor(event_id / 20) AS BIGINT) AS STRING)) END AS group_id",
        "user_id AS observer",
        "CASE WHEN user_id % 3 = 0 THEN 'Stationary' ELSE 'Traveling' END AS protocol",
        "CAST(ts AS DATE) AS obs_date",
        "CAST(regexp_extract(props, '[0-9]+', 0) AS INT) * 5 AS duration",
        "event_id % 4 <> 0 AS complete",
        "CAST(-13500 + user_id * 37 % 4000 AS DOUBLE) / 100 AS lon",
        "CAST(2200 + user_id * 91 % 3500 AS DOUBLE) / 100 AS lat",
    ]),
    "v_observations": ("events", [
        "event_id",
        "event_type AS species",
        "user_id AS observer",
        "CASE WHEN event_id % 11 = 0 THEN 'X' ELSE CAST(CAST(floor(value / 10) AS INT) AS STRING) END AS count_text",
        "CAST(ts AS DATE) AS obs_date",
    ]),
    "v_distance": ("lineitem", [
        "year(l_shipdate) AS yr",
        "l_suppkey AS transect",
        "l_orderkey % 16 AS point",
        "l_quantity * 6.25 AS distance",
        "CASE WHEN l_linenumber = 7 THEN -1 ELSE l_linenumber END AS time_period",
        "1 + l_partkey % 3 AS cnt",
        "l_returnflag AS species",
    ]),
    "v_sites": ("customer", [
        "c_custkey AS site",
        "CAST(-2350000 + (c_custkey * 7919 % 2110) * 1000 AS DOUBLE) AS x",
        "CAST(330000 + (c_custkey * 104729 % 3170) * 1000 AS DOUBLE) AS y",
        "c_mktsegment AS stratum",
        "c_nationkey AS state",
    ]),
    "v_site_year": ("orders", [
        "o_custkey AS site",
        "year(o_orderdate) AS yr",
        "o_orderpriority AS species",
        "CAST(CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_custkey % 4 = 0 THEN 0 ELSE o_orderkey % 4 END AS INT) AS cnt",
        "o_orderkey AS obs_id",
    ]),
    "v_taxa": ("part", [
        "p_partkey AS taxon",
        "concat(p_name, CASE WHEN p_partkey % 6 = 0 THEN ' (form)' ELSE '' END) AS binomial",
        "concat_ws(',', upper(substr(p_name, 1, 4)), upper(substr(p_type, 1, 4))) AS alpha",
        "CAST(p_partkey AS STRING) AS aou",
        "CASE WHEN p_size > 45 THEN 1900 + p_size END AS extinct_year",
    ]),
    "v_draws": ("events", [
        "event_id % 3 AS chain",
        "CAST(floor(event_id / 3) AS BIGINT) AS iter",
        "event_type AS parameter",
        "value",
    ]),
}
_STOPS = (
    "SELECT l_suppkey AS route, year(l_shipdate) AS yr, l_partkey % 20 AS obs_n, l_orderkey % 50 + 1 AS stop, "
    "CAST(sum(l_quantity) AS BIGINT) AS cnt FROM lineitem GROUP BY 1, 2, 3, 4"
)
_POINTS = (
    "SELECT vec_id AS pt, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, label FROM embeddings"
)

VIEW_SQL: dict[str, str] = {
    **{name: f"SELECT {', '.join(cols)} FROM {table}" for name, (table, cols) in _PLAIN_VIEWS.items()},
    "v_stops": _STOPS,
    "v_points": _POINTS,
}

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Driver tables and survey views of one folder, read on demand: ``t.orders``, ``t.v_stops``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name in _PLAIN_VIEWS:
            table, cols = _PLAIN_VIEWS[name]
            return getattr(self, table).selectExpr(*cols)
        if name == "v_stops":
            keys = ["l_suppkey AS route", "year(l_shipdate) AS yr", "l_partkey % 20 AS obs_n", "l_orderkey % 50 + 1 AS stop"]
            rows = self.lineitem.selectExpr(*keys, "l_quantity")
            return rows.groupBy("route", "yr", "obs_n", "stop").agg({"l_quantity": "sum"}).selectExpr(
                "route", "yr", "obs_n", "stop", "CAST(`sum(l_quantity)` AS BIGINT) AS cnt"
            )
        if name == "v_points":
            return self.embeddings.selectExpr(
                "vec_id AS pt", "CAST(embedding[0] AS DOUBLE) AS x", "CAST(embedding[1] AS DOUBLE) AS y", "label"
            )
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def with_views(body: str) -> str:
    """Put the views a SQL text names in front of it."""
    names = [n for n in VIEW_SQL if re.search(rf"\b{n}\b", body)]
    if not names:
        return body.strip()
    views = ", ".join(f"{n} AS ({VIEW_SQL[n]})" for n in names)
    body = body.strip()
    head = re.match(r"WITH( RECURSIVE)?\s+", body)
    if head:
        return f"WITH{head.group(1) or ''} {views}, {body[head.end():]}"
    return f"WITH {views} {body}"


def query(name: str, sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Query]:
    """Register ``fn(tables)`` under ``name`` with the SQL that gives the same rows."""

    def register(fn: Callable[[Tables], DataFrame]) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return run

    return register
