"""Registered queries over the driver's tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline.operators import facts as op
from ridgeline.sources.frames import AGENCY_SQL, METRICS, MONTHLY_SQL, agency, long_facts, monthly, table

M_SQL = MONTHLY_SQL.format(more="")
LONG_SQL = f"SELECT * FROM (UNPIVOT ({M_SQL}) ON {', '.join(METRICS)} INTO NAME metric VALUE value)"
FISCAL_SQL = f"""
    WITH f AS ({LONG_SQL}), a AS ({AGENCY_SQL}),
    r AS (SELECT f.*, fye, year(month) - CASE WHEN month(month) <= fye AND fye <> 12 THEN 1 ELSE 0 END AS start_year,
                 ((month(month) - 1 - fye % 12) % 12 + 12) % 12 + 1 AS idx FROM f JOIN a USING (agency_id)),
    p AS (SELECT *, row_number() OVER (PARTITION BY agency_id, metric, start_year ORDER BY idx) AS pos FROM r)
    SELECT agency_id, metric, CASE WHEN fye = 12 THEN CAST(start_year AS VARCHAR)
             ELSE 'FY' || CAST(start_year AS VARCHAR) || '-' || substr(CAST(start_year + 1 AS VARCHAR), 3, 2) END AS label,
           start_year, CASE WHEN count(*) = 12 THEN 'annual' ELSE 'ytd' END AS period_type, count(*) AS months,
           CAST(sum(CAST(value AS DECIMAL(28,4))) AS DOUBLE) AS value
    FROM p WHERE pos = idx GROUP BY agency_id, metric, start_year, fye"""
ANNUAL_SQL = f"SELECT agency_id, metric, start_year, value FROM ({FISCAL_SQL}) WHERE period_type = 'annual'"


def _facts(spark: SparkSession, d: str) -> DataFrame:
    return long_facts(monthly(spark, d), ["agency_id", "month"])


def _annual(spark: SparkSession, d: str) -> DataFrame:
    return fiscal_rollup(spark, d).filter("period_type = 'annual'").select("agency_id", "metric", "start_year", "value")


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("user_id", "event_type", "ts", "event_id", F.floor(F.col("value") / 25).cast("long").alias("bucket"))


EVENTS_SQL = "SELECT user_id, event_type, ts, event_id, CAST(floor(value / 25) AS BIGINT) AS bucket FROM events"


def agency_directory(spark: SparkSession, d: str) -> DataFrame:
    return agency(spark, d)


def monthly_facts(spark: SparkSession, d: str) -> DataFrame:
    return _facts(spark, d)


def fiscal_rollup(spark: SparkSession, d: str) -> DataFrame:
    return op.fiscal_rollup_wide(monthly(spark, d), agency(spark, d), METRICS)


def calendar_quarters(spark: SparkSession, d: str) -> DataFrame:
    return op.calendar_quarters(_facts(spark, d))


def competition_ranks(spark: SparkSession, d: str) -> DataFrame:
    return op.competition_ranks(_annual(spark, d), agency(spark, d))


def year_over_year(spark: SparkSession, d: str) -> DataFrame:
    return op.year_over_year(_annual(spark, d))


def financial_statement(spark: SparkSession, d: str) -> DataFrame:
    annual = fiscal_rollup(spark, d).filter("period_type = 'annual'")
    return op.statement_grid(annual, op.axis_years(annual))


def derived_metrics(spark: SparkSession, d: str) -> DataFrame:
    return op.solve(monthly(spark, d))


def restatement_chain(spark: SparkSession, d: str) -> DataFrame:
    return op.version_chain(_events(spark, d), ["user_id", "event_type"], ["ts", "event_id"], "bucket")


def change_classes(spark: SparkSession, d: str) -> DataFrame:
    rows, key, newest = _events(spark, d), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]
    current = op.latest(rows.filter("ts < '2024-01-15'"), key, newest)
    incoming = op.latest(rows.filter("ts >= '2024-01-15'"), key, newest)
    return op.classify_changes(incoming, current, key, "bucket")


def feed_freshness(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "events").select(F.col("event_type").alias("feed"), F.when(F.col("event_id") % 7 != 0, F.col("ts")).alias("finished_at"), "event_id", (F.col("event_id") % 4).alias("status"))
    return op.latest(runs.filter("feed <> 'error'"), ["feed"], [F.desc_nulls_last("finished_at"), F.col("event_id")])


def weakest_quality(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("agency_id")).agg(F.max(F.col("l_linenumber") % 4).alias("q"), F.count_distinct("l_orderkey").alias("orders"))
    return rows.select("agency_id", F.element_at(F.array(*map(F.lit, ("verified", "preliminary", "estimated", "imputed"))), F.col("q") + 1).alias("quality"), "orders")


def duplicate_cells(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity")).alias("quantity")).filter("n > 1")


def reconciled_readings(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), F.col("l_extendedprice").alias("value"), F.round(1 - F.col("l_tax") * 5, 2).alias("confidence"))
    return op.reconcile(rows)


def dense_months(spark: SparkSession, d: str) -> DataFrame:
    return op.densify(monthly(spark, d).select("agency_id", "month", "ridership"))


def ridership_trend(spark: SparkSession, d: str) -> DataFrame:
    rows = monthly(spark, d).groupBy("agency_id").agg(F.min_by("ridership", "month").alias("first_value"), F.max_by("ridership", "month").alias("last_value"))
    return rows.withColumn("change_pct", op.percent_change(F.col("last_value"), F.col("first_value")))


def agencies_by_subdivision(spark: SparkSession, d: str) -> DataFrame:
    rows = agency(spark, d).groupBy("subdivision").agg(F.array_join(F.array_sort(F.collect_list("agency_name")), "|").alias("agencies"), F.count("*").alias("n"))
    return rows


def classifier_accuracy(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    rows = docs.join(labels, "doc_id").select((F.col("n_chars") >= 400).alias("guess"), (F.col("quality") == 1).alias("truth"))
    hit, said, true = (F.count_if(c) for c in (F.col("guess") & F.col("truth"), F.col("guess"), F.col("truth")))
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.try_divide(hit, said), F.lit(1.0)).alias("precision"), F.coalesce(F.try_divide(hit, true), F.lit(1.0)).alias("recall"))


def source_routing(spark: SparkSession, d: str) -> DataFrame:
    """Share of pages with hardly any text, by document: mostly scanned ones go another way."""
    rows = table(spark, d, "documents").groupBy("source").agg(F.avg(F.when(F.length(F.trim("text")) < 120, 1.0).otherwise(0.0)).alias("scanned"), F.count("*").alias("pages"))
    return rows.withColumn("route", F.when(F.col("scanned") > 0.5, "vision").otherwise("text"))


def top_pages(spark: SparkSession, d: str) -> DataFrame:
    """The three pages of each source with the best score: keyword hits and, to a limit, numbers."""
    score = 5 * F.regexp_count(F.lower("text"), F.lit("the")) + F.least(F.regexp_count("text", F.lit("[0-9]+")), F.lit(40))
    rows = table(spark, d, "documents").select("source", "doc_id", score.cast("long").alias("score"))
    by = Window.partitionBy("source").orderBy(F.desc("score"), "doc_id")
    return rows.withColumn("nth", F.row_number().over(by)).filter("nth <= 3")


def unreported_agencies(spark: SparkSession, d: str) -> DataFrame:
    late = table(spark, d, "lineitem").filter("l_shipdate >= '2001-11-01'")
    return agency(spark, d).join(late, F.col("agency_id") == F.col("l_suppkey"), "left_anti").select("agency_id", "agency_name")


def hourly_events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.window("ts", "1 hour").start.alias("hour"), "event_type").agg(F.count("*").alias("n"))


SQL = {
    "agency_directory": AGENCY_SQL,
    "monthly_facts": LONG_SQL,
    "fiscal_rollup": FISCAL_SQL,
    "calendar_quarters": f"""SELECT agency_id, metric, CAST(year(month) AS VARCHAR) || '-Q' || CAST(quarter(month) AS VARCHAR) AS label,
        CAST(sum(CAST(value AS DECIMAL(28,4))) AS DOUBLE) AS value FROM ({LONG_SQL}) GROUP BY agency_id, metric, year(month), quarter(month) HAVING count(*) = 3""",
    "competition_ranks": f"""WITH v AS (SELECT v.*, subdivision, CASE WHEN metric IN ('farebox_revenue', 'operating_expenses') AND currency = 'CAD' THEN value * CAST(0.7 AS DOUBLE) ELSE value END AS basis
            FROM ({ANNUAL_SQL}) v JOIN ({AGENCY_SQL}) a USING (agency_id)),
        r AS (SELECT agency_id, metric, start_year, 'all' AS comparison, rank() OVER (PARTITION BY metric, start_year ORDER BY basis DESC) AS rank, count(*) OVER (PARTITION BY metric, start_year) AS "of", basis FROM v
              UNION ALL SELECT agency_id, metric, start_year, 'subdivision', rank() OVER (PARTITION BY metric, start_year, subdivision ORDER BY basis DESC), count(*) OVER (PARTITION BY metric, start_year, subdivision), basis FROM v)
        SELECT * FROM r WHERE "of" >= 5""",
    "year_over_year": f"""WITH v AS ({ANNUAL_SQL}), c AS (SELECT v.agency_id, v.metric, v.start_year, v.value, p.value AS prior,
            CASE WHEN p.value <> 0 THEN floor((v.value - p.value) / abs(p.value) * 1000 + 0.5) / 10 END AS change_pct
            FROM v LEFT JOIN v p ON p.agency_id = v.agency_id AND p.metric = v.metric AND p.start_year = v.start_year - 1)
        SELECT *, CASE WHEN change_pct > 0 THEN 'up' WHEN change_pct < 0 THEN 'down' WHEN change_pct = 0 THEN 'flat' END AS direction FROM c""",
    "financial_statement": f"""WITH v AS ({ANNUAL_SQL}), s AS (SELECT DISTINCT agency_id, metric FROM v), y AS (SELECT DISTINCT start_year FROM v)
        SELECT agency_id, metric, start_year, value FROM s CROSS JOIN y LEFT JOIN v USING (agency_id, metric, start_year)""",
    "derived_metrics": f"""WITH m AS ({M_SQL}) SELECT agency_id, month, 'recovery_ratio' AS metric, farebox_revenue / operating_expenses AS value, 'farebox_revenue / operating_expenses' AS equation FROM m WHERE operating_expenses <> 0
        UNION ALL SELECT agency_id, month, 'cost_per_trip', operating_expenses / ridership, 'operating_expenses / ridership' FROM m WHERE ridership <> 0
        UNION ALL SELECT agency_id, month, 'trips_per_hour', ridership / revenue_service_hours, 'ridership / revenue_service_hours' FROM m
        UNION ALL SELECT agency_id, month, 'operating_deficit', CAST(CAST(operating_expenses AS DECIMAL(28,4)) - CAST(farebox_revenue AS DECIMAL(28,4)) AS DOUBLE), 'operating_expenses - farebox_revenue' FROM m""",
    "restatement_chain": f"""WITH e AS ({EVENTS_SQL}), c AS (SELECT *, lag(bucket) OVER w AS last, row_number() OVER w AS n FROM e WHERE bucket IS NOT NULL WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)),
        k AS (SELECT *, row_number() OVER w AS version, lead(ts) OVER w AS valid_to FROM c WHERE n = 1 OR last IS DISTINCT FROM bucket WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))
        SELECT user_id, event_type, version, ts AS valid_from, valid_to, bucket, valid_to IS NULL AS is_current FROM k""",
    "change_classes": f"""WITH e AS ({EVENTS_SQL}),
        c AS (SELECT * FROM e WHERE ts < TIMESTAMP '2024-01-15' QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1),
        i AS (SELECT * FROM e WHERE ts >= TIMESTAMP '2024-01-15' QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1)
        SELECT i.user_id, i.event_type, i.bucket AS new_value, c.bucket AS old_value, CASE WHEN c.user_id IS NULL THEN 'insert' WHEN c.bucket IS NOT DISTINCT FROM i.bucket THEN 'identical' ELSE 'changed' END AS change
        FROM i LEFT JOIN c ON i.user_id IS NOT DISTINCT FROM c.user_id AND i.event_type IS NOT DISTINCT FROM c.event_type""",
    "feed_freshness": """SELECT event_type AS feed, CASE WHEN event_id % 7 <> 0 THEN ts END AS finished_at, event_id, event_id % 4 AS status FROM events WHERE event_type <> 'error'
        QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY CASE WHEN event_id % 7 <> 0 THEN ts END DESC NULLS LAST, event_id) = 1""",
    "weakest_quality": """SELECT l_suppkey AS agency_id, CASE max(l_linenumber % 4) WHEN 0 THEN 'verified' WHEN 1 THEN 'preliminary' WHEN 2 THEN 'estimated' ELSE 'imputed' END AS quality,
        count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY 1""",
    "duplicate_cells": "SELECT l_orderkey, l_linenumber, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "reconciled_readings": """WITH r AS (SELECT l_orderkey AS order_id, l_linenumber AS line, l_extendedprice AS value, round(1 - l_tax * 5, 2) AS confidence FROM lineitem),
        z AS (SELECT *, CAST(round(value) AS BIGINT) AS whole FROM r WHERE confidence >= 0.3),
        b AS (SELECT *, length(CAST(whole AS VARCHAR)) - length(rtrim(CAST(whole AS VARCHAR), '0')) AS zeros FROM z),
        w AS (SELECT *, row_number() OVER (PARTITION BY order_id, line ORDER BY zeros, confidence DESC, value DESC) AS nth FROM b)
        SELECT order_id, line, max(value) FILTER (nth = 1) AS value, count(*) AS readings, max(value) - min(value) <= 0.005 * greatest(abs(max(value)), abs(min(value))) AS agreed FROM w GROUP BY order_id, line""",
    "dense_months": f"""WITH m AS (SELECT agency_id, month, ridership FROM ({M_SQL})), s AS (SELECT agency_id, unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS month FROM m GROUP BY agency_id)
        SELECT s.agency_id, CAST(s.month AS DATE) AS month, ridership FROM s LEFT JOIN m ON m.agency_id = s.agency_id AND m.month = CAST(s.month AS DATE)""",
    "ridership_trend": f"""WITH m AS ({M_SQL}), t AS (SELECT agency_id, min_by(ridership, month) AS first_value, max_by(ridership, month) AS last_value FROM m GROUP BY agency_id)
        SELECT *, CASE WHEN first_value <> 0 THEN floor((last_value - first_value) / abs(first_value) * 1000 + 0.5) / 10 END AS change_pct FROM t""",
    "agencies_by_subdivision": f"SELECT subdivision, string_agg(agency_name, '|' ORDER BY agency_name) AS agencies, count(*) AS n FROM ({AGENCY_SQL}) GROUP BY subdivision",
    "classifier_accuracy": """SELECT count(*) AS n, coalesce(count(*) FILTER (n_chars >= 400 AND quality = 1) / nullif(count(*) FILTER (n_chars >= 400), 0), 1.0) AS precision,
        coalesce(count(*) FILTER (n_chars >= 400 AND quality = 1) / nullif(count(*) FILTER (quality = 1), 0), 1.0) AS recall FROM documents JOIN labels USING (doc_id)""",
    "source_routing": """WITH s AS (SELECT source, avg(CASE WHEN length(trim(text)) < 120 THEN 1.0 ELSE 0.0 END) AS scanned, count(*) AS pages FROM documents GROUP BY source)
        SELECT *, CASE WHEN scanned > 0.5 THEN 'vision' ELSE 'text' END AS route FROM s""",
    "top_pages": """WITH s AS (SELECT source, doc_id, CAST(5 * len(regexp_extract_all(lower(text), 'the')) + least(len(regexp_extract_all(text, '[0-9]+')), 40) AS BIGINT) AS score FROM documents)
        SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS nth FROM s QUALIFY nth <= 3""",
    "unreported_agencies": f"SELECT agency_id, agency_name FROM ({AGENCY_SQL}) a WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = agency_id AND l_shipdate >= TIMESTAMP '2001-11-01')",
    "hourly_events": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL",
}
QUERIES = {name: globals()[name] for name in SQL}
