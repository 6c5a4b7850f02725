"""More registered queries: lifecycle, solver, checks, readings, text, periods; each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline.functions import text as tx
from ridgeline.functions.periods import close, fiscal_label, fiscal_start_year
from ridgeline.operators import facts as op
from ridgeline.operators import lifecycle as life
from ridgeline.operators import review as rv
from ridgeline.operators import solver
from ridgeline.plans.catalog import AGENCY_SQL, ANNUAL_SQL, EVENTS_SQL, LONG_SQL, M_SQL, SQL as BASE_SQL, _annual, _events, _facts
from ridgeline.plans.catalog import competition_ranks as _ranks
from ridgeline.sources.frames import MONTHLY_SQL, agency, long_facts, monthly, table

KEY = ["user_id", "event_type"]
NEWEST = "ORDER BY ts DESC, event_id DESC"


def _two_loads(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows, newest = _events(spark, d), [F.desc("ts"), F.desc("event_id")]
    sides = (op.latest(rows.filter(c), KEY, newest) for c in ("ts < '2024-01-15'", "ts >= '2024-01-15'"))
    return tuple(s.select(*KEY, F.col("bucket").alias("value"), F.col("ts").alias("at")) for s in sides)


LOADS_SQL = f"""e AS ({EVENTS_SQL}),
    o AS (SELECT * FROM e WHERE ts < TIMESTAMP '2024-01-15' QUALIFY row_number() OVER (PARTITION BY user_id, event_type {NEWEST}) = 1),
    n AS (SELECT * FROM e WHERE ts >= TIMESTAMP '2024-01-15' QUALIFY row_number() OVER (PARTITION BY user_id, event_type {NEWEST}) = 1),
    j AS (SELECT coalesce(o.user_id, n.user_id) AS user_id, coalesce(o.event_type, n.event_type) AS event_type, o.bucket AS ov, n.bucket AS nv, o.ts AS oat, n.ts AS nat,
          o.ts IS NOT NULL AND n.ts IS NOT NULL AND o.bucket IS DISTINCT FROM n.bucket AS changed
          FROM o FULL JOIN n ON o.user_id IS NOT DISTINCT FROM n.user_id AND o.event_type IS NOT DISTINCT FROM n.event_type),
    p AS (SELECT user_id, event_type, ov AS value, oat AS "at", NOT changed AS is_current, CASE WHEN changed THEN 'superseded' ELSE 'kept' END AS action FROM j WHERE oat IS NOT NULL
          UNION ALL SELECT user_id, event_type, nv, nat, true, CASE WHEN changed THEN 'restated' ELSE 'inserted' END FROM j WHERE oat IS NULL OR changed)"""


def promote_diff(spark: SparkSession, d: str) -> DataFrame:
    return life.promote(*_two_loads(spark, d), KEY, "value")


def promote_idempotent(spark: SparkSession, d: str) -> DataFrame:
    """Counts by action of the same load done twice: the second finds nothing to do."""
    current, incoming = _two_loads(spark, d)
    once = life.promote(current, incoming, KEY, "value").filter("is_current").select(*KEY, "value", "at")
    return life.promote(once, incoming, KEY, "value").groupBy("action").agg(F.count("*").alias("n"))


def audit_trail(spark: SparkSession, d: str) -> DataFrame:
    return life.audit_trail(promote_diff(spark, d))


def fill_gaps_promote(spark: SparkSession, d: str) -> DataFrame:
    """Readings of the first day are current; of all later ones the surest fill the keys that these lack."""
    e = table(spark, d, "events").select(*KEY, F.col("event_id").alias("id"), (F.col("event_id") % 11 / 10).alias("confidence"), "ts")
    current, staged = (e.filter(c).drop("ts") for c in ("ts < '2024-01-02'", "ts >= '2024-01-02'"))
    return life.fill_gaps(current, staged, KEY)


def scoped_wipe(spark: SparkSession, d: str) -> DataFrame:
    chain = Window.partitionBy("user_id").orderBy("event_id")
    values = table(spark, d, "events").select("event_id", F.col("event_type").alias("source"), F.lag("event_id").over(chain).alias("restates"))
    return life.scoped_wipe(values, spark.range(1).select(F.lit("error").alias("source")), "event_id", "source", "restates")


def upsert_ignore(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    new = c.select("c_custkey", F.lit("NEW").alias("c_mktsegment"), "c_acctbal")
    return life.upsert(c.filter("c_acctbal >= 0"), new, "c_custkey", update=False)


def coalesce_update(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    new = c.filter("c_custkey % 3 = 0").select("c_custkey", F.when(F.col("c_custkey") % 5 == 0, "NEW").alias("c_mktsegment"), F.lit(None).cast("double").alias("c_acctbal"))
    return life.upsert(c, new, "c_custkey", update=True)


def period_dedupe_min_id(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.to_date(F.date_trunc("month", "o_orderdate")).alias("month"))
    return life.canonical_ids(rows, ["o_custkey", "month"], "o_orderkey")


def conversion_funnel_once(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("ts").alias("first_at"), F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))
    return rows


def _partly_hidden(spark: SparkSession, d: str) -> DataFrame:
    """Monthly rows that lack trips in every third month (cost per trip is there instead) and, where the agency's id is a
    multiple of 4, expenses (fares and deficit are there instead)."""
    m = monthly(spark, d)
    hide = F.month("month") % 3 == 0
    other = (F.col("agency_id") % 4 == 0) & ~hide
    return m.select(
        "agency_id", "month", F.when(~hide, F.col("ridership")).alias("ridership"), "farebox_revenue", "revenue_service_hours",
        F.when(~other, F.col("operating_expenses")).alias("operating_expenses"),
        F.when(hide, F.col("operating_expenses") / F.col("ridership")).alias("cost_per_trip"),
        F.when(other, F.col("operating_expenses") - F.col("farebox_revenue")).alias("operating_deficit"),
    )


def solve_chain_fixpoint(spark: SparkSession, d: str) -> DataFrame:
    return solver.fixpoint(_partly_hidden(spark, d), ["agency_id", "month"]).filter("equation IS NOT NULL").select("agency_id", "month", "metric", "value", "equation")


def cross_check_failures(spark: SparkSession, d: str) -> DataFrame:
    """Printed costs per trip that are 3 per cent too high at every seventh agency are found."""
    printed = F.when(F.col("agency_id") % 7 == 0, 1.03).otherwise(1.0) * F.col("operating_expenses") / F.col("ridership")
    return solver.failed_checks(monthly(spark, d).withColumn("cost_per_trip", printed), ["agency_id", "month"])


def row_flags(spark: SparkSession, d: str) -> DataFrame:
    """Flags of annual values: jumps of over half, a second source over 2 per cent away, currency amounts too small."""
    rows = op.year_over_year(_annual(spark, d)).withColumn("second", F.col("value") * F.when(F.col("agency_id") % 7 == 0, 1.03).otherwise(1.0))
    money = F.col("metric").isin(*op.CURRENCY_METRICS)
    flags = F.array_compact(F.array(
        F.when((F.col("prior") != 0) & (F.abs(F.col("value") - F.col("prior")) > 0.5 * F.abs("prior")), "yoy_spike"),
        F.when(~close(F.col("value"), F.col("second"), 0.02), "cross_source_disagreement"),
        F.when((money & (F.abs("value") > 0) & (F.abs("value") < 10000)) | (~money & (F.col("value") < 0)), "unit_mismatch"),
    ))
    tier = F.when(F.size("flags") == 0, "approved").otherwise("pending")
    return rows.withColumn("flags", flags).select("agency_id", "metric", "start_year", F.array_join("flags", ",").alias("flags"), tier.alias("status"))


def calendar_rollups(spark: SparkSession, d: str) -> DataFrame:
    """Calendar years of months, or of quarters where months are missing; the running year from its unbroken first months.

    Agencies whose id is a multiple of 5 publish quarters as well, but none of their Februaries.
    """
    rows = _facts(spark, d)
    v, q, y = F.col("value").cast("decimal(28,4)"), F.quarter("month"), F.year("month")
    quarterly = rows.filter("agency_id % 5 = 0").groupBy("agency_id", "metric", y.alias("year"), q.alias("q")).agg(F.sum(v).alias("v"), F.count("*").alias("n")).filter("n = 3")
    parts = rows.filter("NOT (agency_id % 5 = 0 AND month(month) = 2)").select("agency_id", "metric", y.alias("year"), F.month("month").alias("m"), v.alias("v"))
    both = parts.withColumn("q", F.lit(None).cast("int")).unionByName(quarterly.select("agency_id", "metric", "year", F.lit(None).cast("int").alias("m"), "v", "q"))
    at = lambda c, k: F.max(F.when(F.col(c) == k, F.col("v"))).alias(f"{c}{k}")
    wide = both.groupBy("agency_id", "metric", "year").agg(*[at("m", k) for k in range(1, 13)], *[at("q", k) for k in range(1, 5)])
    months = [F.col(f"m{k}") for k in range(1, 13)]
    quarters = [F.coalesce(months[3 * k] + months[3 * k + 1] + months[3 * k + 2], F.col(f"q{k + 1}")) for k in range(4)]
    prefix = lambda cells: [(k, sum(cells[1:k], cells[0])) for k in range(len(cells), 0, -1)]
    entry = lambda kind, k, s: F.when(s.isNotNull(), F.struct(F.lit(kind).alias("type"), F.lit(k).alias("parts"), s.cast("double").alias("value")))
    year, first = (prefix(months)[0], prefix(quarters)[0]), (*prefix(months)[1:], *prefix(quarters)[1:])
    best = F.coalesce(*[entry("annual", k, s) for k, s in year], *[entry("ytd", k, s) for k, s in first])
    return wide.select("agency_id", "metric", "year", best.alias("b")).filter("b IS NOT NULL").select("agency_id", "metric", "year", "b.type", "b.parts", "b.value")


def _calendar_sql() -> str:
    plus = lambda cells: " + ".join(cells)
    months = [f"m{k}" for k in range(1, 13)]
    quarters = [f"coalesce(m{3 * k + 1} + m{3 * k + 2} + m{3 * k + 3}, q{k + 1})" for k in range(4)]
    steps = [("annual", 12, plus(months)), ("annual", 4, plus(quarters))] + [("ytd", k, plus(months[:k])) for k in range(11, 0, -1)] + [("ytd", k, plus(quarters[:k])) for k in range(3, 0, -1)]
    pick = lambda i, text: "CASE " + " ".join(f"WHEN {s[2]} IS NOT NULL THEN {text(s)}" for s in steps) + " END"
    cols = ", ".join([f"max(v) FILTER (m = {k}) AS m{k}" for k in range(1, 13)] + [f"max(v) FILTER (q = {k}) AS q{k}" for k in range(1, 5)])
    return f"""WITH f AS (SELECT agency_id, metric, month, CAST(value AS DECIMAL(28,4)) AS v FROM ({LONG_SQL})),
        b AS (SELECT agency_id, metric, year(month) AS year, month(month) AS m, NULL AS q, v FROM f WHERE NOT (agency_id % 5 = 0 AND month(month) = 2)
              UNION ALL SELECT agency_id, metric, year(month), NULL, quarter(month), sum(v) FROM f WHERE agency_id % 5 = 0 GROUP BY agency_id, metric, year(month), quarter(month) HAVING count(*) = 3),
        w AS (SELECT agency_id, metric, year, {cols} FROM b GROUP BY agency_id, metric, year)
        SELECT agency_id, metric, year, {pick(0, lambda s: f"'{s[0]}'")} AS type, {pick(1, lambda s: str(s[1]))} AS parts, CAST({pick(2, lambda s: s[2])} AS DOUBLE) AS value FROM w
        WHERE {' OR '.join(f'({s[2]}) IS NOT NULL' for s in steps)}"""


def series_scope_pick(spark: SparkSession, d: str) -> DataFrame:
    """The latest month of each agency and metric in one scope: total where there is one, else the first by name."""
    scope = F.when(F.col("l_returnflag") == "A", "conventional").when(F.col("l_returnflag") == "N", "total").otherwise("specialized")
    rows = long_facts(monthly(spark, d, "l_returnflag").withColumn("scope", scope), ["agency_id", "month", "scope"])
    best = F.max_by(F.struct("scope", "month", "value"), F.struct((F.col("scope") == "total").cast("int"), (F.col("scope") == "conventional").cast("int"), "month"))
    return rows.groupBy("agency_id", "metric").agg(best.alias("b")).select("agency_id", "metric", "b.*")


def rank_reconcile_status(spark: SparkSession, d: str) -> DataFrame:
    """Each agency's rank of a metric's latest ranked year; without one it missed the period."""
    ranks = _ranks(spark, d).filter("comparison = 'all'").select("agency_id", "metric", "start_year", "rank", F.col("of"))
    last = ranks.groupBy("metric").agg(F.max("start_year").alias("start_year"))
    all_ = agency(spark, d).select("agency_id").crossJoin(F.broadcast(last))  # one row a metric: a fixed few
    out = all_.join(ranks, ["agency_id", "metric", "start_year"], "left")
    status = F.when(F.col("rank").isNull(), "not_ranked_period_miss").when((F.col("of") >= 5) & F.col("rank").between(1, F.col("of")), "ranked").otherwise("not_yet_ranked")
    return out.select("agency_id", "metric", "start_year", status.alias("status"), tx.rank_label(F.col("rank"), F.col("of")).alias("label"))


def merge_readings(spark: SparkSession, d: str) -> DataFrame:
    """Readings of one cell: equal ones keep the best confidence; ones within 0.5 per cent the most precise at the best
    confidence; else the surest at half confidence at most, with a note."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), F.col("l_extendedprice").alias("value"), F.round(1 - F.col("l_tax") * 5, 2).alias("confidence"))
    whole = F.col("value").cast("decimal(18,0)").cast("string")
    zeros = F.length(whole) - F.length(F.rtrim(whole, F.lit("0")))
    out = rows.groupBy("order_id", "line").agg(
        F.max_by("value", F.struct(-zeros, "confidence", "value")).alias("precise"), F.max_by("value", F.struct("confidence", "value")).alias("surest"),
        F.min("value").alias("lo"), F.max("value").alias("hi"), F.max("confidence").alias("best"),
    )
    near = close(F.col("hi"), F.col("lo"), 0.005)
    return out.select(
        "order_id", "line", F.when(near, F.col("precise")).otherwise(F.col("surest")).alias("value"),
        F.when(near, F.col("best")).otherwise(F.least("best", F.lit(0.5))).alias("confidence"), F.when(~near, "readings differ").alias("note"),
    )


def ensemble_reconcile(spark: SparkSession, d: str) -> DataFrame:
    """Two readers of one order: full confidence only where both read and agree."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linestatus", F.floor("l_quantity").alias("q"), F.round(1 - F.col("l_tax") * 5, 2).alias("c"))
    out = rows.groupBy("l_orderkey").agg(F.count_distinct("l_linestatus").alias("readers"), F.min("q").alias("lo"), F.max("q").alias("hi"), F.max("c").alias("best"), F.max_by("q", F.struct("c", "q")).alias("value"))
    agreed = (F.col("readers") > 1) & (F.col("lo") == F.col("hi"))
    return out.select("l_orderkey", "readers", "value", agreed.alias("agreed"), F.when(agreed, F.col("best")).otherwise(F.least("best", F.lit(0.5))).alias("confidence"))


def component_sum(spark: SparkSession, d: str) -> DataFrame:
    """Parts of an order, each label once by its surest reading, added; the printed total wins and is compared."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("decimal(18,2)").alias("v"), F.col("l_tax").alias("t"))
    once = rows.groupBy("l_orderkey", "l_linenumber").agg(F.max_by("v", F.struct(-F.col("t"), "v")).alias("v"))
    parts = once.groupBy("l_orderkey").agg(F.sum("v").cast("double").alias("parts"))
    total = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_totalprice").alias("printed"))
    out = parts.join(total, "l_orderkey", "full_outer")
    return out.select("l_orderkey", F.coalesce("printed", "parts").alias("value"), close(F.col("parts"), F.col("printed"), 0.02).alias("checks"))


def parsed_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Prices printed in three ways and read back."""
    cents = F.col("l_extendedprice").cast("decimal(18,2)").cast("string")
    kind = F.col("l_linenumber") % 3
    printed = F.when(kind == 0, F.concat(F.lit("("), F.format_number(F.col("l_extendedprice").cast("decimal(18,2)"), 2), F.lit(")"))).when(kind == 1, F.replace(cents, F.lit("."), F.lit(","))).otherwise(F.concat(F.lit(" "), cents))
    return table(spark, d, "lineitem").groupBy(kind.alias("kind")).agg(F.sum(tx.parse_number(printed).cast("decimal(18,2)")).cast("double").alias("total"), F.count(tx.parse_number(printed)).alias("n"))


def part_slugs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", tx.slug(F.concat_ws(" / ", "p_name", "p_brand")).alias("slug"), tx.ordinal(F.col("p_partkey")).alias("nth"))


def page_range_label(spark: SparkSession, d: str) -> DataFrame:
    """The pages of each source as runs, one row a run: '1-2', '4'."""
    return rv.page_runs(table(spark, d, "documents"), "source", "doc_id")


def file_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))


def image_batches(spark: SparkSession, d: str) -> DataFrame:
    """Pages with little text in batches of five by source."""
    rows = table(spark, d, "documents").filter(F.length("text") < 400).select("source", "doc_id")
    rows = life.number_in_order(rows, ["source"], F.floor(F.col("doc_id") / 4096), ["doc_id"])
    return rows.withColumn("batch", F.floor((F.col("nth") - 1) / 5).cast("int")).groupBy("source", "batch").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("pages"))


def financials_csv_lines(spark: SparkSession, d: str) -> DataFrame:
    from ridgeline.sources.sinks import csv_lines

    rows = agency(spark, d).select("agency_id", F.concat("agency_name", F.lit(', "'), "subdivision", F.lit('"')).alias("name"), F.col("population").cast("string").alias("population"))
    return csv_lines(rows, ["agency_id", "name", "population"])


def fiscal_period_of_orders(spark: SparkSession, d: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    fye = F.when(F.col("o_custkey") % 2 == 0, 12).otherwise(3)
    start = fiscal_start_year(day, fye)
    begin = F.make_date(start, F.when(fye == 12, 1).otherwise(fye + 1), F.lit(1))
    return table(spark, d, "orders").select("o_orderkey", fiscal_label(start, fye).alias("label"), begin.alias("begin"), F.last_day(F.add_months(begin, 11)).alias("end"))


def fleet_composition(spark: SparkSession, d: str) -> DataFrame:
    """Each agency's latest count by mode, added up by class."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    by = rows.groupBy(F.col("l_suppkey").alias("agency_id"), "p_type", F.to_date(F.date_trunc("month", "l_shipdate")).alias("month")).agg(F.count("*").alias("n"))
    last = by.groupBy("agency_id", "p_type").agg(F.max_by("n", "month").alias("n"))
    return last.groupBy("agency_id", F.substring("p_type", 1, 1).alias("class")).agg(F.sum("n").alias("vehicles"))


def active_last_12_months(spark: SparkSession, d: str) -> DataFrame:
    """Customers with an order in the twelve last months that have orders: the months are ranked, not the orders."""
    rows = table(spark, d, "orders").select("o_custkey", F.to_date(F.date_trunc("month", "o_orderdate")).alias("month"))
    months = rows.select("month").distinct().orderBy(F.desc("month")).limit(12)
    return rows.join(months, "month", "left_semi").groupBy("o_custkey").agg(F.max("month").alias("latest"), F.count("*").alias("orders"))


def flag_totals(spark: SparkSession, d: str) -> DataFrame:
    flags = row_flags(spark, d).filter("flags <> ''").select(F.explode(F.split("flags", ",")).alias("flag"))
    return flags.groupBy("flag").agg(F.count("*").alias("n"))


def mode_set_parity(spark: SparkSession, d: str) -> DataFrame:
    """Agencies whose returned and unreturned lines cover the same statuses."""
    rows = table(spark, d, "lineitem").groupBy("l_suppkey").agg(
        F.array_sort(F.collect_set(F.when(F.col("l_returnflag") == "N", F.col("l_linenumber")))).alias("a"), F.array_sort(F.collect_set(F.when(F.col("l_returnflag") != "N", F.col("l_linenumber")))).alias("b"))
    return rows.select("l_suppkey", F.array_join("a", ",").alias("unreturned"), F.col("a").eqNullSafe(F.col("b")).alias("same"))


_solve = lambda: """SELECT agency_id, month, metric, value, equation FROM (
    SELECT agency_id, month, unnest([{'metric': 'ridership', 'value': CASE WHEN hide THEN trips END, 'equation': 'cost_per_trip'},
        {'metric': 'cost_per_trip', 'value': CASE WHEN NOT hide AND trips <> 0 THEN opex / trips END, 'equation': 'cost_per_trip'},
        {'metric': 'operating_expenses', 'value': CASE WHEN other THEN opex END, 'equation': 'expense_split'},
        {'metric': 'operating_deficit', 'value': CASE WHEN NOT other THEN opex - fares END, 'equation': 'expense_split'},
        {'metric': 'recovery_ratio', 'value': CASE WHEN opex <> 0 THEN fares / opex END, 'equation': 'recovery_ratio'},
        {'metric': 'trips_per_hour', 'value': trips / hours, 'equation': 'trips_per_hour'}], recursive := true)
    FROM (SELECT agency_id, month, hide, other, fares, hours, CASE WHEN hide THEN opex / (opex / trips) ELSE trips END AS trips, CASE WHEN other THEN fares + (opex - fares) ELSE opex END AS opex
    FROM (SELECT agency_id, month, month(month) % 3 = 0 AS hide, agency_id % 4 = 0 AND month(month) % 3 <> 0 AS other, ridership AS trips, farebox_revenue AS fares, operating_expenses AS opex, revenue_service_hours AS hours FROM (""" + M_SQL + ")))) WHERE value IS NOT NULL"  # noqa: E731

SQL = {
    "promote_diff": f"WITH {LOADS_SQL} SELECT * FROM p",
    "promote_idempotent": f"WITH {LOADS_SQL} SELECT 'kept' AS action, count(*) AS n FROM p WHERE is_current",
    "audit_trail": f"""WITH {LOADS_SQL} SELECT user_id, event_type, value, "at", action FROM p WHERE action IN ('inserted', 'restated')""",
    "fill_gaps_promote": """WITH s AS (SELECT user_id, event_type, event_id AS id, event_id % 11 / 10 AS confidence FROM events WHERE ts >= TIMESTAMP '2024-01-02' AND event_id % 11 / 10 >= 0.8
        QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY confidence DESC, event_id DESC) = 1)
        SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM events o WHERE o.ts < TIMESTAMP '2024-01-02' AND o.user_id IS NOT DISTINCT FROM s.user_id AND o.event_type IS NOT DISTINCT FROM s.event_type)""",
    "scoped_wipe": """WITH v AS (SELECT event_id, event_type AS source, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS restates FROM events), k AS (SELECT * FROM v WHERE source <> 'error')
        SELECT event_id, source, CASE WHEN restates IN (SELECT event_id FROM k) THEN restates END AS restates FROM k""",
    "upsert_ignore": "SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_mktsegment ELSE 'NEW' END AS c_mktsegment, c_acctbal FROM customer",
    "coalesce_update": "SELECT c_custkey, CASE WHEN c_custkey % 15 = 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment, c_acctbal FROM customer",
    "period_dedupe_min_id": "SELECT o_orderkey, o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, min(o_orderkey) OVER (PARTITION BY o_custkey, date_trunc('month', o_orderdate)) AS canonical_id FROM orders",
    "conversion_funnel_once": "SELECT user_id, event_type, ts AS first_at, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1",
    "solve_chain_fixpoint": _solve(),
    "cross_check_failures": f"SELECT agency_id, month, 'cost_per_trip' AS equation, 'cross_source_disagreement' AS flag FROM ({M_SQL}) WHERE agency_id % 7 = 0 AND ridership <> 0",
    "row_flags": f"""WITH y AS ({BASE_SQL['year_over_year']}), f AS (SELECT agency_id, metric, start_year, concat_ws(',', CASE WHEN prior <> 0 AND abs(value - prior) > 0.5 * abs(prior) THEN 'yoy_spike' END,
        CASE WHEN agency_id % 7 = 0 AND value <> 0 THEN 'cross_source_disagreement' END,
        CASE WHEN metric IN ('farebox_revenue', 'operating_expenses') AND abs(value) > 0 AND abs(value) < 10000 OR metric NOT IN ('farebox_revenue', 'operating_expenses') AND value < 0 THEN 'unit_mismatch' END) AS flags FROM y)
        SELECT *, CASE WHEN flags = '' THEN 'approved' ELSE 'pending' END AS status FROM f""",
    "calendar_rollups": _calendar_sql(),
    "series_scope_pick": f"""WITH m AS ({MONTHLY_SQL.format(more=", l_returnflag")}), s AS (SELECT * REPLACE (CASE l_returnflag WHEN 'A' THEN 'conventional' WHEN 'N' THEN 'total' ELSE 'specialized' END AS l_returnflag) FROM m),
        u AS (SELECT * FROM (UNPIVOT s ON ridership, farebox_revenue, operating_expenses, revenue_service_hours INTO NAME metric VALUE value))
        SELECT agency_id, metric, l_returnflag AS scope, month, value FROM u QUALIFY row_number() OVER (PARTITION BY agency_id, metric ORDER BY l_returnflag <> 'total', l_returnflag, month DESC) = 1""",
    "rank_reconcile_status": f"""WITH r AS (SELECT * FROM ({BASE_SQL['competition_ranks']}) WHERE comparison = 'all'), l AS (SELECT metric, max(start_year) AS start_year FROM r GROUP BY metric),
        j AS (SELECT a.agency_id, l.metric, l.start_year, r.rank, r."of" FROM ({AGENCY_SQL}) a CROSS JOIN l LEFT JOIN r ON r.agency_id = a.agency_id AND r.metric = l.metric AND r.start_year = l.start_year)
        SELECT agency_id, metric, start_year, CASE WHEN rank IS NULL THEN 'not_ranked_period_miss' ELSE 'ranked' END AS status,
        CASE WHEN rank IS NULL THEN 'not yet ranked' ELSE rank || CASE WHEN rank % 100 BETWEEN 11 AND 13 THEN 'th' WHEN rank % 10 = 1 THEN 'st' WHEN rank % 10 = 2 THEN 'nd' WHEN rank % 10 = 3 THEN 'rd' ELSE 'th' END || ' of ' || "of" END AS label FROM j""",
    "merge_readings": """WITH r AS (SELECT l_orderkey AS order_id, l_linenumber AS line, l_extendedprice AS value, round(1 - l_tax * 5, 2) AS confidence, CAST(CAST(round(l_extendedprice) AS BIGINT) AS VARCHAR) AS w FROM lineitem),
        n AS (SELECT *, row_number() OVER (PARTITION BY order_id, line ORDER BY length(w) - length(rtrim(w, '0')), confidence DESC, value DESC) AS p, row_number() OVER (PARTITION BY order_id, line ORDER BY confidence DESC, value DESC) AS s FROM r),
        g AS (SELECT order_id, line, max(value) FILTER (p = 1) AS precise, max(value) FILTER (s = 1) AS surest, max(confidence) AS best, max(value) - min(value) <= 0.005 * greatest(abs(max(value)), abs(min(value))) AS near FROM n GROUP BY order_id, line)
        SELECT order_id, line, CASE WHEN near THEN precise ELSE surest END AS value, CASE WHEN near THEN best ELSE least(best, 0.5) END AS confidence, CASE WHEN NOT near THEN 'readings differ' END AS note FROM g""",
    "ensemble_reconcile": """WITH r AS (SELECT l_orderkey, l_linestatus, floor(l_quantity) AS q, round(1 - l_tax * 5, 2) AS c FROM lineitem),
        g AS (SELECT l_orderkey, count(DISTINCT l_linestatus) AS readers, min(q) AS lo, max(q) AS hi, max(c) AS best, arg_max(q, c * 1000 + q / 1000) AS value FROM r GROUP BY l_orderkey)
        SELECT l_orderkey, readers, CAST(value AS BIGINT) AS value, readers > 1 AND lo = hi AS agreed, CASE WHEN readers > 1 AND lo = hi THEN best ELSE least(best, 0.5) END AS confidence FROM g""",
    "component_sum": """WITH o AS (SELECT l_orderkey, CAST(l_extendedprice AS DECIMAL(18,2)) AS v FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_tax, l_extendedprice DESC) = 1),
        p AS (SELECT l_orderkey, CAST(sum(v) AS DOUBLE) AS parts FROM o GROUP BY l_orderkey)
        SELECT coalesce(l_orderkey, o_orderkey) AS l_orderkey, coalesce(o_totalprice, parts) AS value, abs(parts - o_totalprice) <= 0.02 * greatest(abs(parts), abs(o_totalprice)) AS checks FROM p FULL JOIN orders ON o_orderkey = l_orderkey""",
    "parsed_numbers": """SELECT l_linenumber % 3 AS kind, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * CASE WHEN l_linenumber % 3 = 0 THEN -1 ELSE 1 END) AS DOUBLE) AS total, count(*) AS n FROM lineitem GROUP BY 1""",
    "part_slugs": """SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' / ' || p_brand), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug,
        p_partkey || CASE WHEN p_partkey % 100 BETWEEN 11 AND 13 THEN 'th' WHEN p_partkey % 10 = 1 THEN 'st' WHEN p_partkey % 10 = 2 THEN 'nd' WHEN p_partkey % 10 = 3 THEN 'rd' ELSE 'th' END AS nth FROM part""",
    "page_range_label": """WITH d AS (SELECT DISTINCT source, doc_id AS p FROM documents), r AS (SELECT source, p, p - row_number() OVER (PARTITION BY source ORDER BY p) AS run FROM d)
        SELECT source, min(p) AS first, max(p) AS last, CASE WHEN min(p) = max(p) THEN CAST(min(p) AS VARCHAR) ELSE min(p) || '-' || max(p) END AS label FROM r GROUP BY source, run""",
    "file_hash": "SELECT doc_id, sha256(coalesce(text, '')) AS sha256 FROM documents",
    "image_batches": """WITH d AS (SELECT source, doc_id, CAST(floor((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) / 5) AS INT) AS batch FROM documents WHERE length(text) < 400)
        SELECT source, batch, min(doc_id) AS first, max(doc_id) AS last, count(*) AS pages FROM d GROUP BY source, batch""",
    "financials_csv_lines": f"""SELECT agency_id || ',"' || agency_name || ', ""' || subdivision || '""' || '",' || coalesce(CAST(population AS VARCHAR), '') AS line FROM ({AGENCY_SQL})""",
    "fiscal_period_of_orders": """WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, o_custkey % 2 = 0 AS cal FROM orders), s AS (SELECT *, year(day) - CASE WHEN NOT cal AND month(day) <= 3 THEN 1 ELSE 0 END AS y FROM o)
        SELECT o_orderkey, CASE WHEN cal THEN CAST(y AS VARCHAR) ELSE 'FY' || y || '-' || substr(CAST(y + 1 AS VARCHAR), 3, 2) END AS label, make_date(y, CASE WHEN cal THEN 1 ELSE 4 END, 1) AS begin,
        CASE WHEN cal THEN make_date(y, 12, 31) ELSE make_date(y + 1, 3, 31) END AS "end" FROM s""",
    "fleet_composition": """WITH b AS (SELECT l_suppkey AS agency_id, p_type, date_trunc('month', l_shipdate) AS month, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
        l AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY agency_id, p_type ORDER BY month DESC) = 1) SELECT agency_id, substr(p_type, 1, 1) AS class, sum(n) AS vehicles FROM l GROUP BY ALL""",
    "active_last_12_months": """WITH o AS (SELECT o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders), r AS (SELECT *, dense_rank() OVER (ORDER BY month DESC) AS k FROM o)
        SELECT o_custkey, max(month) AS latest, count(*) AS orders FROM r WHERE k <= 12 GROUP BY o_custkey""",
    "mode_set_parity": """WITH g AS (SELECT l_suppkey, coalesce(string_agg(DISTINCT CAST(l_linenumber AS VARCHAR), ',' ORDER BY CAST(l_linenumber AS VARCHAR)) FILTER (l_returnflag = 'N'), '') AS a,
        coalesce(string_agg(DISTINCT CAST(l_linenumber AS VARCHAR), ',' ORDER BY CAST(l_linenumber AS VARCHAR)) FILTER (l_returnflag <> 'N'), '') AS b FROM lineitem GROUP BY l_suppkey) SELECT l_suppkey, a AS unreturned, a = b AS same FROM g""",
}
SQL["flag_totals"] = f"SELECT flag, count(*) AS n FROM (SELECT unnest(string_split(flags, ',')) AS flag FROM ({SQL['row_flags']}) WHERE flags <> '') GROUP BY flag"
QUERIES = {name: globals()[name] for name in SQL}
