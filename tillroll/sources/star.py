"""The flat sales table, joined from order-processing tables in Parquet."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.schema import CANONICAL_COLUMNS


# The columns read from each table. Naming them saves a look into every file's footer
# before the query starts.
TABLES = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz, "
    "o_orderpriority string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string",
}


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.schema(TABLES[table]).parquet(f"{folder}/{table}.parquet")


def orders_of_customers(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with their customer and place."""
    places = read(spark, folder, "nation").join(
        read(spark, folder, "region"), F.expr("n_regionkey = r_regionkey")
    )
    customers = read(spark, folder, "customer").join(places, F.expr("c_nationkey = n_nationkey"))
    return read(spark, folder, "orders").join(customers, F.expr("o_custkey = c_custkey"))


def lines_of_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines with their part."""
    return read(spark, folder, "lineitem").join(
        read(spark, folder, "part"), F.expr("l_partkey = p_partkey")
    )


def sales_lines(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order line, plus the numeric order key ``k``.

    Dimensions are joined to each other first, so that the order lines pass
    through two joins only and a dimension too large to broadcast is shuffled at
    its own size. Which side is broadcast is left to Spark's size threshold.
    """
    return joined(lines_of_parts(spark, folder), orders_of_customers(spark, folder))


def joined(
    lines: DataFrame,
    orders: DataFrame,
    on: str = "l_orderkey = o_orderkey",
    order_id: str = "cast(l_orderkey as string)",
) -> DataFrame:
    """The sales columns and ``k`` of lines and the orders they belong to."""
    price = "cast(l_extendedprice as decimal(12,2))"
    discount = "4 * cast(l_discount as decimal(4,2))"
    return lines.join(orders, F.expr(on)).selectExpr(
        f"{order_id} as order_id",
        "cast(o_orderdate as date) as order_date",
        "cast(l_shipdate as date) as ship_date",
        "o_orderpriority as ship_mode",
        "cast(c_custkey as string) as customer_id",
        "c_name as customer_name",
        "c_mktsegment as segment",
        "r_name as region",
        "n_name as state",
        "p_type as category",
        "p_brand as sub_category",
        "p_name as product_name",
        f"cast(round({price} * (1 - {discount}), 2) as decimal(12,2)) as sales",
        "cast(l_quantity as int) as quantity",
        f"cast({discount} as decimal(4,2)) as discount",
        f"cast(round({price} * (cast(0.30 as decimal(4,2)) - {discount}"
        " - cast(l_tax as decimal(4,2))), 2) as decimal(12,2)) as profit",
        "l_orderkey as k",
    )


def sales_table(spark: SparkSession, folder: str) -> DataFrame:
    """The reporting table."""
    return sales_lines(spark, folder).select(*CANONICAL_COLUMNS)


def register_sales(sales: DataFrame, name: str = "sales") -> None:
    """Make the table available to ``spark.sql``."""
    sales.createOrReplaceTempView(name)


MANY = 3_000_000  # lines, from which on their parts are sized here
LINES = 200_000  # to a part

# Which order keys carry which defect: the input of the cleaning operators.
_DEFECTS = {
    "order_date": "case when k % 101 = 0 then null else order_date end",
    "ship_date": "case when k % 103 = 0 then null "
    "when ship_date < order_date and k % 10 <> 0 then order_date else ship_date end",
    "ship_mode": "case when k % 53 = 0 then null else ship_mode end",
    "customer_name": "case when k % 61 = 0 then null else customer_name end",
    "segment": "case when k % 47 = 0 then null "
    "when k % 3 = 0 then concat('  ', lower(segment), ' ') else segment end",
    "region": "case when k % 43 = 0 then null else region end",
    "category": "case when k % 59 = 0 then null "
    "when k % 5 = 0 then upper(category) else lower(category) end",
    "sales": "case when k % 41 = 0 then null when k % 67 = 0 then -cast(sales as double) "
    "when k % 71 = 0 then cast(sales as double) * 50 else cast(sales as double) end",
    "quantity": "case when k % 37 = 0 then null when k % 73 = 0 then -1.0D "
    "when k % 79 = 0 then quantity + 0.5D else cast(quantity as double) end",
    "discount": "case when k % 83 = 0 then null when k % 89 = 0 then 1.5D "
    "else cast(discount as double) end",
    "profit": "case when k % 31 = 0 then null else cast(profit as double) end",
}


def raw_sales(spark: SparkSession, folder: str) -> DataFrame:
    """The same lines with defects written into them: nulls, padding, bad numbers, copies.

    They are joined by the order id that the rows show, so Spark knows that equal rows already
    meet in a task, and steps that group whole rows need no shuffle of them.
    """
    lines = lines_of_parts(spark, folder).withColumn("order_id", F.col("l_orderkey").cast("string"))
    n = read(spark, folder, "lineitem").count()
    if n > MANY:  # parts of even size, however many lines there are: wide rows are grouped in them
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        lines = lines.repartition(max(parts, ceil(n / LINES)), "order_id")
    orders = orders_of_customers(spark, folder).withColumn("_order_id", F.col("o_orderkey").cast("string"))
    dirty = joined(lines, orders, "order_id = _order_id", "order_id").selectExpr(
        *[f"{_DEFECTS.get(c, c)} as {c}" for c in CANONICAL_COLUMNS], "k"
    )
    # Every line once, the lines of some orders twice.
    copies = F.expr("case when k % 50 = 7 then array(1, 2) else array(1) end")
    return dirty.select(*CANONICAL_COLUMNS, F.explode(copies)).select(*CANONICAL_COLUMNS)
