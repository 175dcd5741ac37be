"""Fixture views over the driver's tables, one text for Spark and DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "obs": """SELECT event_id AS obs_id, user_id AS receiver_id, ts,
       CASE WHEN hour(ts) >= 7 AND hour(ts) < 19 THEN 'D'
            WHEN hour(ts) >= 19 AND hour(ts) < 22 THEN 'E' ELSE 'N' END AS period,
       CASE WHEN event_type = 'click' THEN 'F' WHEN event_type = 'view' THEN 'A' ELSE 'L' END AS cls,
       CAST(35 AS DOUBLE) + CAST(event_id % 400 AS DOUBLE) / CAST(10 AS DOUBLE) AS laeq
FROM events""",
    "pts": """SELECT l_orderkey * 10 + l_linenumber AS pk,
       CAST(352000 + (min(l_partkey) * 53 + l_orderkey * 37 + l_linenumber * 11) % 4000 AS DOUBLE) AS x,
       CAST(3784000 + (min(l_suppkey) * 101 + l_orderkey * 59 + l_linenumber * 7) % 4000 AS DOUBLE) AS y,
       CAST(35 AS DOUBLE) + CAST(l_orderkey % 400 AS DOUBLE) / CAST(10 AS DOUBLE) AS laeq
FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "segs": """SELECT s_suppkey AS seg_id,
       CAST(352000 + (s_suppkey * 7919) % 4000 AS DOUBLE) AS ax,
       CAST(3784000 + (s_suppkey * 104729) % 4000 AS DOUBLE) AS ay,
       CAST(352000 + (s_suppkey * 7919) % 4000 + 50 + (s_suppkey % 7) * 40 AS DOUBLE) AS bx,
       CAST(3784000 + (s_suppkey * 104729) % 4000 + ((s_suppkey % 11) - 5) * 30 AS DOUBLE) AS by_,
       CAST(1000 + s_suppkey % 60 * 500 AS DOUBLE) AS aadt
FROM supplier""",
    "blds": """SELECT p_partkey AS bld_id,
       CAST(352000 + (p_partkey * 7907) % 4000 AS DOUBLE) AS cx,
       CAST(3784000 + (p_partkey * 6271) % 4000 AS DOUBLE) AS cy,
       CAST(6 + p_size % 10 AS DOUBLE) AS half_w, CAST(5 + p_size % 7 AS DOUBLE) AS half_h,
       CASE WHEN p_size % 5 = 0 THEN NULL ELSE CAST(3 + p_size % 20 AS DOUBLE) END AS height_m,
       CASE WHEN p_partkey % 50 = 0 THEN 'fire' WHEN p_partkey % 75 = 1 THEN 'hospital'
            WHEN p_partkey % 20 = 3 THEN 'heliport' ELSE 'house' END AS kind
FROM part""",
    "recs": """SELECT o_orderkey AS edge_id,
       CASE o_orderkey % 7 WHEN 0 THEN 'S1100' WHEN 1 THEN 'S1630' WHEN 2 THEN 'S1200' WHEN 3 THEN 'S1400'
            WHEN 4 THEN 'S1640' WHEN 5 THEN 'S1730' ELSE 'S1740' END AS mtfcc,
       CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(floor(o_totalprice / 10) AS DOUBLE) END AS aadt_record,
       CASE WHEN o_orderkey % 4 = 0 THEN CAST(0.5 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS split
FROM orders""",
    "stops": """SELECT o_orderkey AS trip_id, concat('R', CAST(o_custkey % 6 AS VARCHAR(10))) AS route,
       concat(lpad(CAST(o_orderkey % 28 AS VARCHAR(10)), 2, '0'), ':', lpad(CAST(o_custkey % 60 AS VARCHAR(10)), 2, '0'), ':00') AS clock,
       o_orderkey % 7 AS dow
FROM orders""",
    "trace": """SELECT user_id AS ident, event_id AS pt_id, CAST(event_id * 9 AS DOUBLE) AS t_s,
       CAST(352000 + (event_id * 17 + user_id * 131) % 4000 AS DOUBLE) AS x,
       CAST(3784000 + (event_id * 23 + user_id * 71) % 4000 AS DOUBLE) AS y,
       CASE WHEN event_id % 5 = 0 THEN 'ground' ELSE 'numeric' END AS alt_state,
       CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(200 + event_id % 3000 AS DOUBLE) END AS alt_ft,
       CAST((event_id * 31) % 360 AS DOUBLE) AS track_deg, value AS speed_kt, event_type = 'error' AS stale
FROM events""",
}
_TABLE = re.compile(r"FROM (\w+)")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view in Spark; `by_` is named `by` there."""
    table = _TABLE.search(VIEWS[name])[1]
    df = spark.sql(_TABLE.sub("FROM {source}", VIEWS[name], count=1), source=spark.read.parquet(f"{sf_dir}/{table}.parquet"))
    return df.withColumnRenamed("by_", "by") if "by_" in df.columns else df


def ctes(*names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
