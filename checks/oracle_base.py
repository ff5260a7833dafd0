"""SQL text shared by the comparison queries."""

from __future__ import annotations

COLUMNS = (
    "order_id, order_date, ship_date, ship_mode, customer_id, customer_name, segment, region, "
    "state, category, sub_category, product_name, sales, quantity, discount, profit"
)

SALES_LINES = """
SELECT CAST(l_orderkey AS VARCHAR) AS order_id,
       CAST(o_orderdate AS DATE) AS order_date,
       CAST(l_shipdate AS DATE) AS ship_date,
       o_orderpriority AS ship_mode,
       CAST(c_custkey AS VARCHAR) AS customer_id,
       c_name AS customer_name,
       c_mktsegment AS segment,
       r_name AS region,
       n_name AS state,
       p_type AS category,
       p_brand AS sub_category,
       p_name AS product_name,
       CAST(ROUND(CAST(l_extendedprice AS DECIMAL(12,2))
            * (1 - 4*CAST(l_discount AS DECIMAL(4,2))), 2) AS DECIMAL(12,2)) AS sales,
       CAST(l_quantity AS INT) AS quantity,
       CAST(4*CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(4,2)) AS discount,
       CAST(ROUND(CAST(l_extendedprice AS DECIMAL(12,2))
            * (CAST(0.30 AS DECIMAL(4,2)) - 4*CAST(l_discount AS DECIMAL(4,2))
               - CAST(l_tax AS DECIMAL(4,2))), 2) AS DECIMAL(12,2)) AS profit,
       l_orderkey AS k
FROM lineitem
JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey
JOIN part ON l_partkey = p_partkey
"""

WITH_SALES = f"WITH b AS ({SALES_LINES}), sales AS (SELECT {COLUMNS} FROM b)"


def half_up(x: str, places: int = 2) -> str:
    return f"CAST(ROUND(CAST({x} AS DECIMAL(38,10)), {places}) AS DOUBLE)"


def ratio(num: str, den: str) -> str:
    return f"(CAST({num} AS DOUBLE) / NULLIF(CAST({den} AS DOUBLE), 0))"


def pct(num: str, den: str, places: int = 2) -> str:
    return half_up(f"{ratio(num, den)} * 100", places)


def mean(x: str, places: int = 2) -> str:
    return half_up(ratio(f"SUM({x})", f"COUNT({x})"), places)


MARGIN = pct("SUM(profit)", "SUM(sales)")
TOTAL_SALES = half_up("SUM(sales)")
TOTAL_PROFIT = half_up("SUM(profit)")
