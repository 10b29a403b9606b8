"""The relational vocabulary of analytic workloads as statements on the given tables.

Each statement is plain SQL on the table names and runs through Catalyst. Where an
engine needs another spelling, `CHECK` holds the text for the checking engine.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tunelake.operators.distinct import bitmap_counts, distinct_bitmaps, distinct_counts, merge_bitmaps, value_dictionary
from tunelake.operators.skew import band_join, interval_join, interval_totals, with_group_stats
from tunelake.plans.tables import TABLES, table
from tunelake.session import written

STATEMENTS: dict[str, str] = {
    "q01_scan_projection": "SELECT c_custkey, c_name, c_acctbal FROM customer",
    "q02_inner_join": """
        SELECT p_brand, l_linestatus, ROUND(SUM(l_quantity), 2) AS pieces FROM part JOIN lineitem ON l_partkey = p_partkey
        WHERE p_size <= 10 GROUP BY p_brand, l_linestatus""",
    "q02_three_way_join": """
        SELECT s_nationkey, p_type, COUNT(*) AS shipments, MAX(l_shipdate) AS last_shipped FROM lineitem
        JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
        WHERE l_returnflag = 'R' GROUP BY s_nationkey, p_type""",
    "q03_comma_join": """
        SELECT o_orderpriority, ROUND(SUM(l_extendedprice * l_discount), 4) AS saved
        FROM orders, lineitem WHERE o_orderkey = l_orderkey AND l_quantity < 25 GROUP BY o_orderpriority""",
    "q04_self_join": """
        SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, COUNT(*) AS n_items,
          ROUND(SUM(l.l_extendedprice), 2) AS volume
        FROM lineitem l JOIN supplier s ON s.s_suppkey = l.l_suppkey JOIN orders o ON o.o_orderkey = l.l_orderkey
        JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n1 ON s.s_nationkey = n1.n_nationkey
        JOIN nation n2 ON c.c_nationkey = n2.n_nationkey
        WHERE n1.n_regionkey <> n2.n_regionkey GROUP BY n1.n_name, n2.n_name""",
    "q06_residual_join": """
        SELECT c.c_mktsegment, COUNT(*) AS n_pairs, ROUND(MIN(s.s_acctbal - c.c_acctbal), 2) AS least_lead
        FROM supplier s JOIN customer c ON s.s_nationkey = c.c_nationkey
          AND s.s_acctbal > c.c_acctbal * 2 AND s.s_acctbal - c.c_acctbal < 6000
        GROUP BY c.c_mktsegment""",
    "q07_equality_filters": """
        SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority <> '5-LOW'""",
    "q08_between": """
        SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
        WHERE l_shipdate BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' AND l_discount BETWEEN 0.02 AND 0.04""",
    "q09_in_list": """
        SELECT c_mktsegment, COUNT(*) AS n FROM customer
        WHERE c_mktsegment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') AND c_nationkey IN (1, 4, 7, 12, 21)
        GROUP BY c_mktsegment""",
    "q10_like": """
        SELECT p_partkey, p_name, p_brand FROM part
        WHERE p_name LIKE 'red%' OR p_name LIKE '%ol%' OR p_brand LIKE '%7'""",
    "q11_not_like": "SELECT p_type, COUNT(*) AS n FROM part WHERE p_name NOT LIKE '%ring%' GROUP BY p_type",
    "q12_or_predicates": """
        SELECT COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total FROM orders
        WHERE (o_orderstatus = 'F' AND o_totalprice > 200000) OR o_orderpriority = '1-URGENT'""",
    "q13_null_tests": """
        SELECT l_returnflag, COUNT(*) AS n FROM lineitem
        WHERE NULLIF(l_tax, 0.0) IS NULL AND NULLIF(l_discount, 0.0) IS NOT NULL GROUP BY l_returnflag""",
    "q14_column_comparison": """
        SELECT l_linestatus, COUNT(*) AS n FROM lineitem WHERE l_tax > l_discount GROUP BY l_linestatus""",
    "q15_group_many_keys": """
        SELECT l_returnflag, l_linestatus, l_linenumber, ROUND(SUM(l_quantity), 2) AS sum_qty
        FROM lineitem GROUP BY l_returnflag, l_linestatus, l_linenumber""",
    "q16_group_by_alias": """
        SELECT p_size % 7 AS size_class, MIN(p_retailprice) AS cheapest, COUNT(DISTINCT p_type) AS n_types
        FROM part WHERE p_brand <> 'Brand#11' GROUP BY size_class""",
    "q17_global_aggregate": """
        SELECT COUNT(*) AS n, ROUND(AVG(l_extendedprice), 4) AS avg_price FROM lineitem WHERE l_returnflag = 'R'""",
    "q18_count": "SELECT s_nationkey, COUNT(*) AS n_rows, COUNT(s_acctbal) AS n_balances FROM supplier GROUP BY s_nationkey",
    "q19_count_distinct": """
        SELECT p_type, COUNT(DISTINCT p_brand) AS n_brands, COUNT(DISTINCT p_size) AS n_sizes, COUNT(DISTINCT p_name) AS n_names
        FROM part WHERE p_retailprice BETWEEN 950 AND 1700 GROUP BY p_type""",
    "q20_sum_avg_min_max": """
        SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS sum_qty, ROUND(AVG(l_extendedprice), 4) AS avg_price,
          MIN(l_discount) AS min_discount, MAX(l_extendedprice) AS max_price
        FROM lineitem GROUP BY l_returnflag, l_linestatus""",
    "q21_sum_expression": """
        SELECT l_suppkey, ROUND(SUM(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 6) AS charged
        FROM lineitem GROUP BY l_suppkey""",
    "q22_conditional_sum": """
        SELECT o_orderstatus,
          CAST(SUM(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS high_count,
          CAST(SUM(CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END) AS BIGINT) AS low_count
        FROM orders GROUP BY o_orderstatus""",
    "q23_aggregate_filter": """
        SELECT p_brand, COUNT(*) AS n_parts, COUNT(*) FILTER (WHERE p_size > 25 OR p_type = 'SMALL') AS n_marked
        FROM part GROUP BY p_brand""",
    "q24_having_aggregate": """
        SELECT o_custkey, COUNT(*) AS n_orders, ROUND(SUM(o_totalprice), 2) AS spent
        FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12 AND SUM(o_totalprice) > 1000000""",
    "q24_having_count_distinct": """
        SELECT o_custkey, COUNT(DISTINCT o_orderpriority) AS n_priorities FROM orders
        GROUP BY o_custkey HAVING COUNT(DISTINCT o_orderpriority) >= 5""",
    "q24_having_group_key": """
        SELECT n_regionkey, COUNT(*) AS n FROM nation GROUP BY n_regionkey HAVING n_regionkey IN (0, 2, 3)""",
    "q25_having_scalar_subquery": """
        SELECT l_suppkey, MAX(l_discount) AS top_discount, COUNT(*) AS n_items FROM lineitem GROUP BY l_suppkey
        HAVING COUNT(*) >= (SELECT COUNT(*) * 1.1 / COUNT(DISTINCT l_suppkey) FROM lineitem)""",
    "q26_scalar_subquery": """
        SELECT o_orderkey, o_totalprice FROM orders
        WHERE o_totalprice > (SELECT AVG(o_totalprice) * 1.5 FROM orders)""",
    "q27_correlated_subquery": """
        SELECT p.p_partkey, p.p_type, p.p_size FROM part p
        WHERE p.p_size = (SELECT MAX(other.p_size) FROM part other
          WHERE other.p_type = p.p_type AND other.p_brand = p.p_brand AND other.p_retailprice < 1500)""",
    "q28_between_subqueries": """
        SELECT l_returnflag, COUNT(*) AS n FROM lineitem
        WHERE l_shipdate BETWEEN (SELECT MIN(o_orderdate) FROM orders WHERE o_orderstatus = 'F')
          AND (SELECT MAX(o_orderdate) FROM orders WHERE o_orderstatus = 'P')
        GROUP BY l_returnflag""",
    "q29_in_subquery": """
        SELECT o_orderpriority, COUNT(*) AS n FROM orders
        WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) GROUP BY o_orderpriority""",
    "q30_in_grouped_subquery": """
        SELECT p_brand, COUNT(*) AS num_parts FROM part
        WHERE p_type IN (SELECT p_type FROM part GROUP BY p_type HAVING COUNT(*) > 250) GROUP BY p_brand""",
    "q31_correlated_exists": """
        SELECT c.c_nationkey, COUNT(*) AS n_quiet FROM customer c
        WHERE c.c_acctbal > 0 AND NOT EXISTS
          (SELECT o.o_orderkey FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 150000)
        GROUP BY c.c_nationkey""",
    "q32_derived_table": """
        SELECT o_orderstatus, ROUND(AVG(n_items), 4) AS avg_items FROM
          (SELECT o.o_orderstatus, o.o_orderkey, COUNT(*) AS n_items FROM orders o
           JOIN lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY o.o_orderstatus, o.o_orderkey) AS per_order
        GROUP BY o_orderstatus""",
    "q33_cte": """
        WITH by_segment AS (SELECT c_mktsegment, c_nationkey, COUNT(*) AS n FROM customer GROUP BY c_mktsegment, c_nationkey),
        widest AS (SELECT c_mktsegment, MAX(n) AS most FROM by_segment GROUP BY c_mktsegment)
        SELECT b.c_mktsegment, b.c_nationkey, w.most FROM by_segment b JOIN widest w
          ON b.c_mktsegment = w.c_mktsegment AND b.n = w.most""",
    "q34_union_all": """
        SELECT COUNT(*) AS n_accounts, ROUND(SUM(acctbal), 2) AS balance FROM
          (SELECT c_nationkey AS nationkey, c_acctbal AS acctbal FROM customer
           UNION ALL SELECT s_nationkey, s_acctbal FROM supplier) AS accounts
        WHERE accounts.nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)""",
    "q35_select_distinct": "SELECT DISTINCT p_brand, p_type FROM part",
    "q37_order_by": """
        SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n, ROUND(MAX(o_totalprice), 2) AS top_price FROM orders
        GROUP BY o_orderstatus, o_orderpriority ORDER BY o_orderstatus ASC NULLS LAST, COUNT(*) DESC, o_orderpriority""",
    "q38_topk_revenue": """
        SELECT p_partkey, p_name, SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) * 1000 / COUNT(*) AS returned_per_mille
        FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY p_partkey, p_name
        HAVING COUNT(*) > 20 ORDER BY returned_per_mille DESC, p_partkey LIMIT 25""",
    "q39_extract": """
        SELECT CAST(EXTRACT(YEAR FROM o_orderdate) AS BIGINT) AS order_year,
          CAST(EXTRACT(MONTH FROM o_orderdate) AS BIGINT) AS order_month, COUNT(*) AS n
        FROM orders GROUP BY EXTRACT(YEAR FROM o_orderdate), EXTRACT(MONTH FROM o_orderdate)""",
    "q40_date_interval": """
        SELECT l_returnflag, COUNT(*) AS n, ROUND(SUM(l_quantity), 2) AS qty FROM lineitem
        WHERE l_shipdate < DATE '1998-12-01' - INTERVAL '90' DAY GROUP BY l_returnflag""",
    "q41_date_vs_string": """
        SELECT l_linenumber, MIN(l_shipdate) AS first_shipped, SUM(l_quantity) AS pieces FROM lineitem
        WHERE l_shipdate > '1995-07-04' AND NOT l_shipdate >= '1997-11-11' GROUP BY l_linenumber""",
    "q42_casts": """
        SELECT CAST(p_size AS VARCHAR(10)) AS size_text, p_retailprice::INTEGER - p_size AS price_gap,
          TRY_CAST(p_brand AS INTEGER) AS brand_number, CAST(p_partkey AS DOUBLE) AS key_number FROM part""",
    "q43_to_date": """
        SELECT CAST(EXTRACT(YEAR FROM to_date(date_text, 'yyyyMMdd')) AS BIGINT) AS ship_year,
          CAST(EXTRACT(YEAR FROM timestamp_seconds(epoch)) AS BIGINT) AS epoch_year, COUNT(*) AS n
        FROM (SELECT date_format(l_shipdate, 'yyyyMMdd') AS date_text,
            unix_seconds(CAST(l_shipdate AS TIMESTAMP)) AS epoch FROM lineitem) AS shipped
        GROUP BY ship_year, epoch_year""",
    "q44_round_length": """
        SELECT LENGTH(p_name) AS name_length, ROUND(AVG(p_retailprice), 2) AS avg_price, COUNT(*) AS n
        FROM part GROUP BY LENGTH(p_name)""",
    "q45_ratio": """
        WITH totals AS (SELECT l_suppkey, SUM(l_extendedprice) AS price, SUM(l_quantity) AS qty, COUNT(*) AS n
          FROM lineitem GROUP BY l_suppkey)
        SELECT l_suppkey, ROUND(price / qty, 4) AS unit_price, ROUND(CAST(n AS DOUBLE) / qty, 6) AS items_per_unit FROM totals""",
    "q46_date_arithmetic": """
        SELECT o_orderstatus, CAST(EXTRACT(YEAR FROM DATE '2002-01-01') AS BIGINT) - CAST(MIN(EXTRACT(YEAR FROM o_orderdate)) AS BIGINT) AS oldest_years,
          ROUND(EXTRACT(YEAR FROM DATE '2002-01-01') - AVG(EXTRACT(YEAR FROM o_orderdate)), 4) AS avg_years
        FROM orders GROUP BY o_orderstatus""",
}

CHECK: dict[str, str] = {
    "q19_merged_distinct": """
        SELECT l_returnflag, CAST(EXTRACT(YEAR FROM l_shipdate) AS INTEGER) AS ship_year, COUNT(DISTINCT l_suppkey) AS n_suppliers, COUNT(DISTINCT l_partkey) AS n_parts
        FROM lineitem GROUP BY ALL""",
    "q42_casts": """
        SELECT CAST(p_size AS VARCHAR) AS size_text, trunc(p_retailprice)::INTEGER - p_size AS price_gap,
          TRY_CAST(p_brand AS INTEGER) AS brand_number, CAST(p_partkey AS DOUBLE) AS key_number FROM part""",
    "q43_to_date": """
        SELECT CAST(EXTRACT(YEAR FROM strptime(date_text, '%Y%m%d')) AS BIGINT) AS ship_year,
          CAST(EXTRACT(YEAR FROM make_timestamp(epoch_micros)) AS BIGINT) AS epoch_year, COUNT(*) AS n
        FROM (SELECT strftime(l_shipdate, '%Y%m%d') AS date_text, epoch_us(l_shipdate) AS epoch_micros FROM lineitem)
        GROUP BY ship_year, epoch_year""",
    "q05_band_join": """
        WITH bands AS (SELECT DISTINCT CAST(floor(o_totalprice / 25000) AS BIGINT) AS band, floor(o_totalprice / 25000) * 25000 AS lower,
          floor(o_totalprice / 25000) * 25000 + 24999.995 AS upper FROM orders)
        SELECT band, lower, upper, COUNT(l_orderkey) AS n_items, ROUND(SUM(l_quantity), 2) AS qty
        FROM lineitem JOIN bands ON l_extendedprice BETWEEN lower AND upper GROUP BY band, lower, upper""",
    "q05_interval_join": """
        SELECT s_suppkey, COUNT(l_orderkey) AS n_items, ROUND(COALESCE(SUM(l_quantity), 0), 2) AS qty
        FROM supplier LEFT JOIN lineitem ON l_extendedprice BETWEEN s_acctbal * 10 AND s_acctbal * 10 + (s_suppkey % 14) * (s_suppkey % 14) * (s_suppkey % 14)
        GROUP BY s_suppkey""",
    "q36_window_average": """
        SELECT o_orderkey, o_totalprice, CAST(SUM(CAST(o_totalprice AS DECIMAL(18, 2))) OVER w AS DOUBLE) / COUNT(*) OVER w AS avg_price
        FROM orders WHERE o_orderdate >= DATE '1996-01-01' WINDOW w AS (PARTITION BY o_custkey)""",
}


def run_statement(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A statement on views of the tables it names."""
    for name in TABLES:
        if re.search(rf"\b{name}\b", sql):
            table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(sql)


def q05_band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items per price band; the bands are those the orders fall into."""
    step = F.floor(F.col("o_totalprice") / 25000)
    bands = (
        table(spark, sf_dir, "orders")
        .select(step.cast("long").alias("band"))
        .distinct()
        .select("band", (F.col("band") * 25000.0).alias("lower"), (F.col("band") * 25000 + 24999.995).alias("upper"))
    )
    items = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity"
    )
    joined = band_join(
        items, bands, "l_extendedprice", "lower", "upper", 25000.0, ["l_orderkey", "l_linenumber"]
    )
    return joined.groupBy("band", "lower", "upper").agg(
        F.count("l_orderkey").alias("n_items"), F.round(F.sum("l_quantity"), 2).alias("qty")
    )


def q05_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items in price bands of the suppliers, from single prices to bands of 2,197."""
    third = F.col("s_suppkey") % 14
    bands = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_acctbal") * 10).alias("lower"), (F.col("s_acctbal") * 10 + third * third * third).alias("upper"))
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    totals = {"n_items": F.count("l_orderkey"), "qty": F.sum(F.col("l_quantity").cast("decimal(28,6)"))}
    held = interval_join(items, bands, "l_extendedprice", "lower", "upper", ["l_orderkey", "l_linenumber"], totals=totals)
    found = held.groupBy("s_suppkey").agg(F.sum("n_items").alias("n_items"), F.round(F.sum("qty").cast("double"), 2).alias("qty"))
    return bands.select("s_suppkey").join(found, "s_suppkey", "left").na.fill(0)


def q06_residual_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a supplier and a customer of its nation, counted by the customers' bands of balances.

    A customer of balance c meets the suppliers above 2 c whose difference to c, as a double, is below 6000.
    That is so below c + 6000 less half of the step to the double before 6000, a sum of which the
    rounding errors are kept, so that a supplier on the border is told as by the difference itself.
    """
    balance = F.col("c_acctbal")

    def added(a: Column, b: Column) -> tuple[Column, Column]:
        total = a + b
        rest = total - a
        return total, (a - (total - rest)) + (b - rest)

    near, error = added(balance, F.lit(6000.0))
    upper, beyond = added(near, error - 2.0**-41)
    customers = table(spark, sf_dir, "customer").filter(F.abs(balance) < float("inf")).select(
        F.col("c_nationkey").alias("nation"), "c_mktsegment", "c_acctbal", (balance * 2).alias("lower"), upper.alias("upper"), (beyond > 0).alias("closed")
    )
    bands = customers.groupBy(*customers.columns).agg(F.count(F.lit(1)).alias("weight"))
    suppliers = table(spark, sf_dir, "supplier").filter(F.abs("s_acctbal") < float("inf")).select(F.col("s_nationkey").alias("nation"), "s_acctbal")
    held = interval_totals(
        suppliers, bands, "s_acctbal", "lower", "upper", {"n": F.count(F.lit(1))}, ["nation"], lower_open=True, upper_closed="closed", least="first"
    )
    lead = F.round(F.min(F.col("first") - balance), 2)
    return held.filter("n > 0").groupBy("c_mktsegment").agg(F.sum(F.col("n") * F.col("weight")).alias("n_pairs"), lead.alias("least_lead"))


def q19_count_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three distinct counts without a copy of the rows for each."""
    parts = table(spark, sf_dir, "part").filter(F.col("p_retailprice").between(950, 1700)).select("p_type", "p_brand", "p_size", "p_name")
    return distinct_counts(parts, ["p_type"], {"n_brands": "p_brand", "n_sizes": "p_size", "n_names": "p_name"})


def q19_merged_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and parts per flag and year, merged from the bitmaps of months that came in two increments.

    The second increment extends the dictionary of the first; its rows are coded alone.
    """
    shipped = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_suppkey", "l_partkey", F.trunc("l_shipdate", "month").alias("month"))
    early = F.col("month") < F.lit("1996-01-01").cast("date")
    keys = ["l_returnflag", "month"]

    def merged(column: str, name: str) -> DataFrame:
        first = written(value_dictionary(shipped.filter(early), column), "dictionary")
        second = written(value_dictionary(shipped.filter(~early), column, first), "dictionary")
        months = distinct_bitmaps(shipped.filter(early), keys, column, first, ["l_orderkey"]).unionByName(
            distinct_bitmaps(shipped.filter(~early), keys, column, second, ["l_orderkey"])
        )
        by_year = ["l_returnflag", "ship_year"]
        return bitmap_counts(merge_bitmaps(months.withColumn("ship_year", F.year("month")), by_year), by_year, name)

    return merged("l_suppkey", "n_suppliers").join(merged("l_partkey", "n_parts"), ["l_returnflag", "ship_year"])


def q36_window_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average over a partition next to each row, from partial sums instead of a window buffer.

    Prices are summed as decimals, so the average does not depend on the order of the rows.
    """
    orders = (
        table(spark, sf_dir, "orders")
        .filter(F.col("o_orderdate") >= F.lit("1996-01-01").cast("date"))
        .select("o_orderkey", "o_custkey", "o_totalprice")
    )
    total = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")
    average = (total / F.count(F.lit(1))).alias("avg_price")
    out = with_group_stats(orders, ["o_custkey"], [average], ["o_orderkey"])
    return out.select("o_orderkey", "o_totalprice", "avg_price")


def _statement(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run_statement(spark, sf_dir, sql)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {name: _statement(sql) for name, sql in STATEMENTS.items()}
    out["q05_band_join"] = q05_band_join
    out["q05_interval_join"] = q05_interval_join
    out["q06_residual_join"] = q06_residual_join
    out["q19_count_distinct"] = q19_count_distinct
    out["q19_merged_distinct"] = q19_merged_distinct
    out["q36_window_average"] = q36_window_average
    return out


def oracle_sql() -> dict[str, str]:
    return {**STATEMENTS, **CHECK}
