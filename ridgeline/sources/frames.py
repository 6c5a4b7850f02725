"""Domain frames over the star schema: agencies, monthly facts in long form, versioned readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

METRICS = ("ridership", "farebox_revenue", "operating_expenses", "revenue_service_hours")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def agency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """agency_id, agency_name, subdivision, currency, fye (last month of the fiscal year), population."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return (
        s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey)  # 25 nations, 5 regions: fixed
        .join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
        .select(
            F.col("s_suppkey").alias("agency_id"),
            F.col("s_name").alias("agency_name"),
            F.col("r_name").alias("subdivision"),
            F.when(F.col("s_nationkey") % 2 == 0, "CAD").otherwise("USD").alias("currency"),
            F.when(F.col("s_suppkey") % 8 == 0, 3).when(F.col("s_suppkey") % 8 == 1, 6).when(F.col("s_suppkey") % 8 == 2, 9).otherwise(12).alias("fye"),
            F.when(F.col("s_suppkey") % 10 != 0, 10000 + 1000 * (F.col("s_suppkey") % 50)).alias("population"),
        )
    )


def money(column: str) -> Column:
    return F.col(column).cast("decimal(18,2)")


def monthly(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """One wide row for each agency and month (and `more` lineitem columns): the four base metrics as doubles."""
    rows = table(spark, sf_dir, "lineitem").withColumn("month", F.to_date(F.date_trunc("month", "l_shipdate")))
    net = (money("l_extendedprice") * (1 - F.col("l_discount").cast("decimal(4,2)"))).cast("decimal(22,4)")
    return rows.groupBy(F.col("l_suppkey").alias("agency_id"), "month", *more).agg(
        F.sum(money("l_quantity")).cast("double").alias("ridership"),
        F.sum(net).cast("double").alias("farebox_revenue"),
        F.sum(money("l_extendedprice")).cast("double").alias("operating_expenses"),
        F.count("*").cast("double").alias("revenue_service_hours"),
    )


def long_facts(wide: DataFrame, keys: list[str]) -> DataFrame:
    return wide.unpivot(keys, list(METRICS), "metric", "value")


MONTHLY_SQL = """
    SELECT l_suppkey AS agency_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS month{more},
           CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS ridership,
           CAST(SUM(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(22,4))) AS DOUBLE) AS farebox_revenue,
           CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS operating_expenses,
           CAST(COUNT(*) AS DOUBLE) AS revenue_service_hours
    FROM lineitem GROUP BY ALL"""
AGENCY_SQL = """
    SELECT s_suppkey AS agency_id, s_name AS agency_name, r_name AS subdivision,
           CASE WHEN s_nationkey % 2 = 0 THEN 'CAD' ELSE 'USD' END AS currency,
           CASE s_suppkey % 8 WHEN 0 THEN 3 WHEN 1 THEN 6 WHEN 2 THEN 9 ELSE 12 END AS fye,
           CASE WHEN s_suppkey % 10 <> 0 THEN 10000 + 1000 * (s_suppkey % 50) END AS population
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
