"""Registration and the instance views as SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}

EVENTS = "e AS (SELECT user_id % 25 AS project, event_id AS row_id, value AS x0, CAST(json_extract(props, '$.k') AS DOUBLE) AS x1, CAST(hour(ts) AS DOUBLE) AS x2, CAST(dayofweek(ts) AS DOUBLE) AS x3, CAST(event_type = 'error' AS INTEGER) AS y FROM events)"
LINES = "l AS (SELECT CAST(s_nationkey AS BIGINT) AS project, l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax, CAST(p_size AS DOUBLE) AS size, p_retailprice AS retail, s_acctbal AS balance, CAST(l_returnflag = 'R' AS INTEGER) AS y FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey)"
VECTORS = "v AS (SELECT CAST(label AS BIGINT) AS project, vec_id AS row_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"
LINKS = "n AS (SELECT CAST(c_nationkey AS BIGINT) AS a, CAST(s_nationkey AS BIGINT) AS b, count(*) AS w FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL), g AS (SELECT 0 AS project, a AS src, b AS dst FROM n WHERE a <> b AND w > 15e-1 * (SELECT avg(w) FROM n))"


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name, with its SQL."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add
