"""The bundled demonstration project over the star schema, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

from .project import Project

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

MODELS: dict[str, str] = {
    "stg_customer": "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM {{ source('customer') }}",
    "stg_orders": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM {{ source('orders') }}",
    "stg_lineitem": """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,
    l_returnflag, l_linestatus, l_shipdate, CAST(l_extendedprice AS DECIMAL(18, 2)) * (1 - CAST(l_discount AS DECIMAL(4, 2))) AS l_revenue, 'unused' AS l_note
FROM {{ source('lineitem') }}""",
    "stg_part": "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM {{ source('part') }}",
    "stg_nation": """SELECT n.n_nationkey, n.n_name, r.r_name FROM {{ source('nation') }} AS n
JOIN {{ source('region') }} AS r ON n.n_regionkey = r.r_regionkey""",
    "int_order_revenue": """SELECT o.o_orderkey, o.o_custkey, CAST(sum(l.l_revenue) AS DOUBLE) AS revenue, count(*) AS lines
FROM {{ ref('stg_orders') }} AS o JOIN {{ ref('stg_lineitem') }} AS l ON o.o_orderkey = l.l_orderkey
GROUP BY o.o_orderkey, o.o_custkey""",
    "int_customer_geo": """SELECT c.c_custkey, c.c_mktsegment, c.c_acctbal, n.n_name, n.r_name FROM {{ ref('stg_customer') }} AS c
JOIN {{ ref('stg_nation') }} AS n ON c.c_nationkey = n.n_nationkey""",
    "mart_segment_revenue": """SELECT c.c_mktsegment, CAST(count(DISTINCT r.o_custkey) AS BIGINT) AS customers,
    CAST(sum(CAST(r.revenue AS DECIMAL(18, 4))) AS DOUBLE) AS revenue
FROM {{ ref('int_customer_geo') }} AS c JOIN {{ ref('int_order_revenue') }} AS r ON c.c_custkey = r.o_custkey
GROUP BY c.c_mktsegment""",
    "mart_region_revenue": """SELECT c.r_name, CAST(sum(r.lines) AS BIGINT) AS lines, CAST(sum(CAST(r.revenue AS DECIMAL(18, 4))) AS DOUBLE) AS revenue
FROM {{ ref('int_customer_geo') }} AS c JOIN {{ ref('int_order_revenue') }} AS r ON c.c_custkey = r.o_custkey
GROUP BY c.r_name HAVING count(*) > 10""",
    "mart_priority_inline": """SELECT o.o_orderpriority, CAST(sum(l.l_revenue) AS DOUBLE) AS revenue, CAST(count(*) AS BIGINT) AS lines
FROM {{ ref('stg_orders') }} AS o JOIN {{ ref('stg_lineitem') }} AS l ON o.o_orderkey = l.l_orderkey
GROUP BY o.o_orderpriority""",
    "mart_top_orders": """SELECT o_custkey, o_orderkey, revenue, CAST(rk AS BIGINT) AS rk FROM (
    SELECT o_custkey, o_orderkey, revenue,
        row_number() OVER (PARTITION BY o_custkey ORDER BY revenue DESC, o_orderkey) AS rk
    FROM {{ ref('int_order_revenue') }}) AS ranked WHERE rk <= 3""",
    "mart_part_class": """SELECT p_brand, CASE WHEN p_size >= 25 THEN 'large' WHEN p_size >= 10 THEN 'medium' ELSE 'small' END AS class,
    CAST(count(*) AS BIGINT) AS parts, CAST(round(avg(p_retailprice), 4) AS DOUBLE) AS price
FROM {{ ref('stg_part') }} WHERE p_type LIKE '%S%' AND p_brand IS NOT NULL
GROUP BY p_brand, CASE WHEN p_size >= 25 THEN 'large' WHEN p_size >= 10 THEN 'medium' ELSE 'small' END""",
    "mart_ship_quarters": """WITH q AS (SELECT extract(year FROM l_shipdate) AS y, extract(quarter FROM l_shipdate) AS qt, l_quantity FROM {{ ref('stg_lineitem') }}
    WHERE l_returnflag IN ('R', 'A') OR l_discount BETWEEN 0.05 AND 0.07)
SELECT CAST(a.y AS BIGINT) AS y, CAST(a.qt AS BIGINT) AS qt, CAST(count(*) AS BIGINT) AS n, CAST(round(sum(a.l_quantity), 2) AS DOUBLE) AS quantity FROM q AS a GROUP BY a.y, a.qt""",
    "mart_active_union": """SELECT c_custkey AS k, 'customer' AS kind FROM {{ ref('stg_customer') }} WHERE c_acctbal > 9000
UNION ALL SELECT p_partkey, 'part' FROM {{ ref('stg_part') }} WHERE p_size = 1
UNION ALL SELECT o_orderkey, coalesce(o_orderstatus, '?') FROM {{ ref('stg_orders') }} WHERE o_totalprice > 400000""",
    "mart_set_ops": """SELECT o_custkey FROM {{ ref('stg_orders') }} WHERE o_orderstatus = 'O'
INTERSECT SELECT o_custkey FROM {{ ref('stg_orders') }} WHERE o_orderstatus = 'F'
EXCEPT SELECT c_custkey FROM {{ ref('stg_customer') }} WHERE c_acctbal < 0""",
    "mart_left_unused": """SELECT o.o_orderkey, o.o_orderpriority FROM {{ ref('stg_orders') }} AS o
LEFT JOIN {{ ref('stg_customer') }} AS c ON o.o_custkey = c.c_custkey WHERE o.o_totalprice > 300000""",
    "mart_left_fanout": """SELECT o.o_orderpriority, CAST(count(*) AS BIGINT) AS n FROM {{ ref('stg_orders') }} AS o
LEFT JOIN {{ ref('stg_lineitem') }} AS l ON o.o_orderkey = l.l_orderkey AND l.l_quantity > 45 GROUP BY o.o_orderpriority""",
    "mart_inner_fk": """SELECT l.l_returnflag, CAST(round(sum(l.l_quantity), 2) AS DOUBLE) AS quantity FROM {{ ref('stg_lineitem') }} AS l
JOIN {{ ref('stg_part') }} AS p ON l.l_partkey = p.p_partkey GROUP BY l.l_returnflag""",
    "mart_chain_on": """SELECT o.o_orderkey, n.n_name FROM {{ ref('stg_orders') }} AS o
JOIN {{ ref('stg_customer') }} AS c ON o.o_custkey = c.c_custkey
JOIN {{ ref('stg_nation') }} AS n ON c.c_nationkey = n.n_nationkey WHERE o.o_orderpriority = '1-URGENT'""",
    "mart_semi_anti": """SELECT s.s_suppkey, s.s_name || '/' || CAST(s.s_nationkey AS VARCHAR(10)) AS label FROM {{ source('supplier') }} AS s
WHERE EXISTS (SELECT 1 FROM {{ ref('stg_lineitem') }} AS l WHERE l.l_suppkey = s.s_suppkey AND l.l_quantity > 49)
AND s.s_nationkey NOT IN (SELECT n_nationkey FROM {{ ref('stg_nation') }} WHERE r_name = 'ASIA')""",
    "mart_distinct_pairs": """SELECT DISTINCT c.n_name, c.c_mktsegment FROM {{ ref('int_customer_geo') }} AS c
WHERE c.c_acctbal > (SELECT avg(c_acctbal) FROM {{ ref('stg_customer') }})""",
    "mart_event_rollup": """SELECT coalesce(event_type, 'all') AS event_type, CAST(count(*) AS BIGINT) AS n, CAST(round(sum(value), 2) AS DOUBLE) AS total,
    CAST(count(*) FILTER (WHERE value > 50) AS BIGINT) AS high FROM {{ source('events') }} GROUP BY ROLLUP (event_type)""",
    "mart_order_gaps": """SELECT o_custkey, o_orderkey, CAST(round(o_totalprice - prev, 2) AS DOUBLE) AS gap FROM (
    SELECT o_custkey, o_orderkey, o_totalprice, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev
    FROM {{ ref('stg_orders') }} WHERE o_orderdate >= DATE '1996-01-01') AS g
WHERE prev IS NOT NULL""",
    "mart_cross_calendar": """SELECT r.r_name, s.p_size, CAST(count(*) AS BIGINT) AS n FROM {{ source('region') }} AS r
CROSS JOIN (SELECT p_size FROM {{ ref('stg_part') }} WHERE p_size <= 3) AS s GROUP BY r.r_name, s.p_size""",
    "mart_full_outer": """SELECT coalesce(a.k, b.k) AS k, a.n AS suppliers, b.n AS customers
FROM (SELECT s_nationkey AS k, CAST(count(*) AS BIGINT) AS n FROM {{ source('supplier') }} GROUP BY s_nationkey) AS a
FULL JOIN (SELECT c_nationkey AS k, CAST(count(*) AS BIGINT) AS n FROM {{ ref('stg_customer') }} WHERE c_acctbal > 5000 GROUP BY c_nationkey) AS b ON a.k = b.k""",
    "mart_star_using": """SELECT * FROM (SELECT o_orderkey, o_custkey FROM {{ ref('stg_orders') }} WHERE o_totalprice > 350000) AS big
JOIN (SELECT c_custkey AS o_custkey, c_mktsegment FROM {{ ref('stg_customer') }}) AS seg USING (o_custkey)""",
    "mart_right_cube": """SELECT n.r_name, c.c_mktsegment, CAST(count(c.c_custkey) AS BIGINT) AS n FROM {{ ref('stg_customer') }} AS c
RIGHT JOIN {{ ref('stg_nation') }} AS n ON c.c_nationkey = n.n_nationkey AND c.c_acctbal > 9500 GROUP BY CUBE (n.r_name, c.c_mktsegment)""",
    "mart_running": """SELECT o_custkey, o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
    ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DOUBLE) AS running
FROM {{ ref('stg_orders') }} QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
    "mart_named_values": """SELECT v.label, CAST(count(*) AS BIGINT) AS n FROM {{ ref('stg_orders') }} AS o
JOIN (VALUES ('1-URGENT', 'now'), ('2-HIGH', 'soon')) AS v(priority, label) ON o.o_orderpriority = v.priority GROUP BY v.label""",
    "mart_top_parts": """SELECT p_partkey, p_name, p_retailprice FROM {{ ref('stg_part') }} ORDER BY p_retailprice DESC, p_partkey LIMIT 25""",
}


def demo_project() -> Project:
    """All models as views, intermediates stored."""
    return Project.from_sql(MODELS, TABLES, {"int_order_revenue": "table"})
