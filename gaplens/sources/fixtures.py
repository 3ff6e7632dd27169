"""Views over the driver tables in which values are missing by rule; the SQL runs in Spark and in DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "orders_gap": "SELECT o_orderkey, o_orderpriority, o_orderstatus, CASE WHEN o_orderkey % 11 = 0 OR (o_orderpriority = '1-URGENT' AND o_orderkey % 3 = 0) THEN NULL ELSE o_totalprice END AS price FROM orders",
    "customer_gap": "SELECT c_custkey, c_nationkey, c_mktsegment, CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_acctbal END AS acctbal FROM customer",
    "lineitem_gap": "SELECT l_orderkey, l_quantity, l_extendedprice, l_tax, CASE WHEN l_quantity > 40 AND l_orderkey % 2 = 0 THEN NULL ELSE l_discount END AS discount FROM lineitem",
    "part_gap": "SELECT p_partkey, p_retailprice, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_type END AS ptype, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_size END AS psize FROM part",
    "customer_comiss": "SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS segment, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal END AS acctbal FROM customer",
    "events_gap": "SELECT event_id, user_id, event_type, CASE WHEN event_id % 10 IN (3, 4, 5) THEN NULL ELSE value END AS value FROM events",
    "events_target": "SELECT event_id, value AS target, CASE WHEN value > 20 AND event_id % 4 <> 0 THEN NULL ELSE CAST(user_id AS DOUBLE) END AS feat FROM events",
    "orders_sparse": "SELECT o_orderkey, o_totalprice AS target, CASE WHEN o_orderkey % 10 <> 0 THEN NULL ELSE o_totalprice END AS sparse FROM orders",
    "doc_labels": "SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the views over the tables of a folder."""
    sql = VIEWS[name]
    tables = re.findall(r"(?:FROM|JOIN) (\w+)", sql)
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
    return spark.sql(re.sub(r"(FROM|JOIN) (\w+)", r"\1 {\2}", sql), **frames)


def with_view(name: str, rest: str) -> str:
    """SQL that can refer to a view by name."""
    return f"WITH {name} AS ({VIEWS[name]}) {rest}" if not rest.lstrip().startswith("WITH ") else f"WITH {name} AS ({VIEWS[name]}), {rest.lstrip()[5:]}"
