"""Views over the driver tables in the shapes the operators work on, for Spark and as SQL for the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

# name -> (Spark SQL, oracle SQL); {dir} stands for the folder of the tables
_VIEWS: dict[str, tuple[str, str]] = {}


def _view(name: str, spark_sql: str, oracle: str | None = None) -> None:
    _VIEWS[name] = (spark_sql, oracle or spark_sql)


_view(
    "v_points",
    """SELECT point_id, normal_azimuth_deg, x, y, 36.6D + x / 41666.0D AS lon, 43.0D + y / 50000.0D AS lat, 'right' AS sea_side, point_id * 200.0D AS chainage_m
       FROM (SELECT CAST(s_suppkey AS BIGINT) AS point_id, CAST((s_suppkey * 37) % 360 AS DOUBLE) AS normal_azimuth_deg,
                    CAST((CAST(s_suppkey AS BIGINT) * 7919) % 100000 AS DOUBLE) AS x, CAST((CAST(s_suppkey AS BIGINT) * 10473) % 100000 AS DOUBLE) AS y FROM {supplier})""",
    """SELECT point_id, normal_azimuth_deg, x, y, 36.6::DOUBLE + x / 41666.0::DOUBLE AS lon, 43.0::DOUBLE + y / 50000.0::DOUBLE AS lat, 'right' AS sea_side, point_id * 200.0::DOUBLE AS chainage_m
       FROM (SELECT CAST(s_suppkey AS BIGINT) AS point_id, CAST((s_suppkey * 37) % 360 AS DOUBLE) AS normal_azimuth_deg,
                    CAST((CAST(s_suppkey AS BIGINT) * 7919) % 100000 AS DOUBLE) AS x, CAST((CAST(s_suppkey AS BIGINT) * 10473) % 100000 AS DOUBLE) AS y FROM supplier)""",
)
_view(
    "v_wind",
    """SELECT CAST(user_id AS BIGINT) AS point_id, CAST(ts AS DATE) AS date, CAST(value AS DOUBLE) AS ws_kmh,
              CAST((CAST(get_json_object(props, '$.k') AS BIGINT) * 37 + user_id) % 360 AS INT) AS direction FROM {events}""",
    """SELECT CAST(user_id AS BIGINT) AS point_id, CAST(ts AS DATE) AS date, CAST(value AS DOUBLE) AS ws_kmh,
              CAST((CAST(json_extract_string(props, '$.k') AS BIGINT) * 37 + user_id) % 360 AS INTEGER) AS direction FROM events""",
)
_view(
    "v_trace",
    "SELECT CAST(l_suppkey AS BIGINT) AS point_id, CAST(l_partkey % 360 AS INT) AS direction, max(CAST(l_extendedprice AS DOUBLE)) AS fetch_m FROM {lineitem} GROUP BY 1, 2",
    "SELECT CAST(l_suppkey AS BIGINT) AS point_id, CAST(l_partkey % 360 AS INTEGER) AS direction, max(CAST(l_extendedprice AS DOUBLE)) AS fetch_m FROM lineitem GROUP BY 1, 2",
)
_view(
    "v_profile",
    "SELECT CAST(l_orderkey AS BIGINT) AS profile_id, CAST(l_linenumber AS INT) AS step, min(CAST(l_quantity AS DOUBLE) - 25.0D) AS z FROM {lineitem} GROUP BY 1, 2",
    "SELECT CAST(l_orderkey AS BIGINT) AS profile_id, CAST(l_linenumber AS INTEGER) AS step, min(CAST(l_quantity AS DOUBLE) - 25.0::DOUBLE) AS z FROM lineitem GROUP BY 1, 2",
)
_view(
    "v_grid",
    "SELECT a.id AS ix, b.id AS iy, 36.5D + 0.125D * a.id AS lon, 42.9D + 0.125D * b.id AS lat, CAST(-((a.id * 7 + b.id * 11) % 97) AS DOUBLE) AS z FROM range(21) a CROSS JOIN range(21) b",
    "SELECT a.i AS ix, b.i AS iy, 36.5::DOUBLE + 0.125::DOUBLE * a.i AS lon, 42.9::DOUBLE + 0.125::DOUBLE * b.i AS lat, CAST(-((a.i * 7 + b.i * 11) % 97) AS DOUBLE) AS z FROM range(21) a(i) CROSS JOIN range(21) b(i)",
)
_view(
    "v_raster",
    "SELECT CAST((l_orderkey * 31 + l_linenumber * 17) % 101 AS BIGINT) AS ix, CAST((l_partkey + l_suppkey * 7) % 101 AS BIGINT) AS iy, min(20.0D - CAST(l_quantity AS DOUBLE)) AS z FROM {lineitem} GROUP BY 1, 2",
    "SELECT CAST((l_orderkey * 31 + l_linenumber * 17) % 101 AS BIGINT) AS ix, CAST((l_partkey + l_suppkey * 7) % 101 AS BIGINT) AS iy, min(20.0::DOUBLE - CAST(l_quantity AS DOUBLE)) AS z FROM lineitem GROUP BY 1, 2",
)
_view(
    "v_grid_nodes",
    "SELECT CAST(n_nationkey AS BIGINT) AS grid_id, CAST((CAST(n_nationkey AS BIGINT) * 31337) % 100000 AS DOUBLE) AS x, CAST((CAST(n_nationkey AS BIGINT) * 17389) % 100000 AS DOUBLE) AS y FROM {nation}",
    "SELECT CAST(n_nationkey AS BIGINT) AS grid_id, CAST((CAST(n_nationkey AS BIGINT) * 31337) % 100000 AS DOUBLE) AS x, CAST((CAST(n_nationkey AS BIGINT) * 17389) % 100000 AS DOUBLE) AS y FROM nation",
)
_view(
    "v_grid_series",
    "SELECT CAST(o_custkey % 25 AS BIGINT) AS grid_id, CAST(o_orderdate AS DATE) AS date, avg(CAST(o_totalprice AS DOUBLE)) / 10000.0D AS ws, CAST(sum(o_orderkey) % 360 AS DOUBLE) AS wd FROM {orders} GROUP BY 1, 2",
    "SELECT CAST(o_custkey % 25 AS BIGINT) AS grid_id, CAST(o_orderdate AS DATE) AS date, avg(CAST(o_totalprice AS DOUBLE)) / 10000.0::DOUBLE AS ws, CAST(sum(o_orderkey) % 360 AS DOUBLE) AS wd FROM orders GROUP BY 1, 2",
)
_view(
    "v_segments",
    """SELECT seg_id, x0, y0, x0 + size * 10.0D AS x1, y0 + (seg_id % 50) * 10.0D AS y1 FROM (SELECT CAST(p_partkey AS BIGINT) AS seg_id, p_size AS size,
              CAST((CAST(p_partkey AS BIGINT) * 7919) % 100000 AS DOUBLE) AS x0, CAST((CAST(p_partkey AS BIGINT) * 10473) % 100000 AS DOUBLE) AS y0 FROM {part})""",
    """SELECT seg_id, x0, y0, x0 + size * 10.0::DOUBLE AS x1, y0 + (seg_id % 50) * 10.0::DOUBLE AS y1 FROM (SELECT CAST(p_partkey AS BIGINT) AS seg_id, p_size AS size,
              CAST((CAST(p_partkey AS BIGINT) * 7919) % 100000 AS DOUBLE) AS x0, CAST((CAST(p_partkey AS BIGINT) * 10473) % 100000 AS DOUBLE) AS y0 FROM part)""",
)
_view(
    "v_edges",
    "SELECT CAST(l_suppkey AS BIGINT) AS u, CAST(100000 + l_partkey % 500 AS BIGINT) AS v, max(CAST(l_extendedprice AS DOUBLE)) AS weight FROM {lineitem} GROUP BY 1, 2",
    "SELECT CAST(l_suppkey AS BIGINT) AS u, CAST(100000 + l_partkey % 500 AS BIGINT) AS v, max(CAST(l_extendedprice AS DOUBLE)) AS weight FROM lineitem GROUP BY 1, 2",
)
_view(
    "v_cached",
    "SELECT DISTINCT CAST(o_custkey % 20 AS BIGINT) AS point_id, CAST(o_orderdate AS DATE) AS obs_date FROM {orders}",
    "SELECT DISTINCT CAST(o_custkey % 20 AS BIGINT) AS point_id, CAST(o_orderdate AS DATE) AS obs_date FROM orders",
)
_view(
    "v_segments_cache",
    "SELECT CAST(l_suppkey AS BIGINT) AS point_id, CAST(l_shipdate AS DATE) AS obs_date, CAST(l_orderkey AS BIGINT) * 10 + l_linenumber AS path_seq, CAST(l_quantity AS DOUBLE) AS value FROM {lineitem}",
    "SELECT CAST(l_suppkey AS BIGINT) AS point_id, CAST(l_shipdate AS DATE) AS obs_date, CAST(l_orderkey AS BIGINT) * 10 + l_linenumber AS path_seq, CAST(l_quantity AS DOUBLE) AS value FROM lineitem",
)
_view(
    "v_wide",
    "SELECT CAST(vec_id AS BIGINT) AS point_id, transform(embedding, x -> CAST(x AS DOUBLE)) AS wind_speed, transform(sequence(0, size(embedding) - 1), i -> CAST(date_add(DATE'2024-01-01', CAST(i AS INT)) AS STRING)) AS dates FROM {embeddings}",
    "SELECT CAST(vec_id AS BIGINT) AS point_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS wind_speed, list_transform(range(0, len(embedding)), lambda i: CAST(DATE '2024-01-01' + CAST(i AS INTEGER) AS VARCHAR)) AS dates FROM embeddings",
)
_view(
    "v_uv",
    "SELECT CAST(vec_id AS BIGINT) AS id, CAST(embedding[0] AS DOUBLE) AS u, CAST(embedding[1] AS DOUBLE) AS v FROM {embeddings}",
    "SELECT CAST(vec_id AS BIGINT) AS id, CAST(embedding[1] AS DOUBLE) AS u, CAST(embedding[2] AS DOUBLE) AS v FROM embeddings",
)
_view("v_urls", "SELECT page_id, url FROM {pages}", "SELECT page_id, url FROM pages")

_TABLES = ("supplier", "events", "lineitem", "nation", "orders", "part", "embeddings", "pages")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(_VIEWS[name][0].format(**{t: f"parquet.`{sf_dir}/{t}.parquet`" for t in _TABLES}))


def views(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [view(spark, sf_dir, n) for n in names]


def with_views(sql: str, *names: str, **more: str) -> str:
    """sql with the oracle's definitions of the views in front, then further named queries."""
    parts = [f"{n} AS ({_VIEWS[n][1]})" for n in names] + [f"{n} AS ({q})" for n, q in more.items()]
    return f"WITH {', '.join(parts)} {sql}"


class Registry:
    """Queries by identifier, with their SQL."""

    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
        if name in self.queries:
            raise ValueError(f"{name} is there already")
        self.queries[name] = query
        if sql:
            self.sql[name] = sql


def pmod(x: str, m: float | int) -> str:
    return f"(((({x}) % {m}) + {m}) % {m})"
