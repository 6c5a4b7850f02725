"""Queries over whole feeds, reconciled statements and what a page shows, with their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline.functions import text as tx
from ridgeline.operators import checks, readmodels, solver
from ridgeline.plans.figures import _RULES, CELLS, LONG_SQL, YEARS_SQL, _as, _cells, _years
from ridgeline.sources import feeds, sinks
from ridgeline.sources.frames import AGENCY_SQL, agency, long_facts, monthly, table


def statistical_feed_load(spark: SparkSession, d: str) -> DataFrame:
    """Months written as a published CSV file, read back and mapped: values, and rejects with their reason."""
    rows = long_facts(monthly(spark, d), ["agency_id", "month"]).filter("metric <> 'farebox_revenue'").join(agency(spark, d).select("agency_id", "agency_name"), "agency_id")
    k = F.col("agency_id") % 3
    measure = F.when(F.col("metric") == "ridership", "Trips").when(F.col("metric") == "revenue_service_hours", "Hours").otherwise("Cost")
    value = (F.col("value") / F.when(k == 1, 1000).otherwise(1)).cast("decimal(28,6)").cast("string")
    rows = rows.select(
        F.date_format("month", "yyyy-MM").alias("ref_date"), F.concat("agency_name", F.lit(', "city"')).alias("label"), measure.alias("measure"), F.when(k == 0, "units").when(k == 1, "thousands").otherwise("").alias("scale"),
        F.when((F.month("month") == 2) & (F.col("agency_id") % 5 == 0), "").otherwise(value).alias("value"), F.when(F.year("month") >= 1998, "p").otherwise("").alias("status"),
    )
    path = f"{solver.shared_folder(spark)}/feed-{uuid.uuid4().hex}"
    sinks.write_csv(rows, rows.columns, path)
    agencies = agency(spark, d).filter("agency_id % 12 <> 5").select(F.concat("agency_name", F.lit(', "city"')).alias("label"), "agency_id")
    metrics = spark.createDataFrame([("Trips", "ridership"), ("Hours", "revenue_service_hours")], "measure string, metric string")
    good, bad = feeds.statistical_feed(feeds.read_csv(spark, path, rows.columns), agencies, metrics)
    out = good.select(F.col("agency_id").cast("string").alias("who"), F.date_format("month", "yyyy-MM").alias("month"), F.col("metric").alias("what"), "value", F.col("quality").alias("told"))
    return out.unionByName(bad.select(F.col("label").alias("who"), F.col("ref_date").alias("month"), F.col("measure").alias("what"), F.lit(None).cast("double").alias("value"), F.col("reason").alias("told")))


def mode_feed_load(spark: SparkSession, d: str) -> DataFrame:
    """Lines as a feed by mode: full reporters' sums a month, where empty cells are not reported."""
    blank = lambda c, x: F.when(c, "").otherwise(x.cast("string"))
    rows = table(spark, d, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("source_id"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("month"), F.when(F.col("l_suppkey") % 6 == 0, "Reduced Reporter").otherwise("Full Reporter").alias("reporter_type"),
        blank(F.col("l_linenumber") == 7, F.col("l_quantity").cast("int")).alias("trips"), blank(F.col("l_linenumber") > 2, F.round(F.col("l_tax") * 100).cast("int")).alias("miles"), blank(F.col("l_returnflag") == "A", F.lit(1)).alias("hours"),
    )
    agencies = agency(spark, d).filter("agency_id % 11 <> 0").select(F.col("agency_id").cast("string").alias("source_id"), "agency_id")
    return feeds.mode_feed(rows, agencies, since="1995-03")


def epoch_feed_load(spark: SparkSession, d: str) -> DataFrame:
    """Events as a feed of stamps and values, of which some are empty or no numbers."""
    k = F.col("event_id") % 10
    rows = table(spark, d, "events").select(
        F.when(k == 0, "").when(k == 1, "soon").otherwise(F.unix_millis(F.col("ts").cast("timestamp")).cast("string")).alias("stamp"), F.when(k == 2, F.lit(None)).when(k == 3, "n/a").otherwise(F.col("value").cast("decimal(18,4)").cast("string")).alias("value")
    )
    good, bad = feeds.epoch_feed(rows, 3)
    out = good.groupBy("month").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("total")).select(F.date_format("month", "yyyy-MM").alias("what"), "n", "total")
    return out.unionByName(bad.groupBy(F.col("reason").alias("what")).agg(F.count("*").alias("n")).withColumn("total", F.lit(0.0)))


PRINTED = CELLS | {"ridership": "r", "average_fare": "CASE WHEN a % 6 = 0 THEN 1.05 * f / r ELSE f / r END", "other_liabilities": f"CASE WHEN a % 4 <> 1 THEN ({CELLS['other_liabilities']}) END"}


def statement_reconcile(spark: SparkSession, d: str) -> DataFrame:
    """Printed statements with the flags of every rule that a figure breaks, and what the sums give where none was printed."""
    rows = _cells(_years(spark, d), PRINTED, "total", "operating").filter("value IS NOT NULL")
    out = checks.reconcile_statement(rows, ["a", "y"])
    return out.select("a", "y", "scope", "basis", "metric", "value", "kind", "equation", F.array_join("flags", ",").alias("flags"))


_FAR = "abs({a} - ({b})) > 0.02 * greatest(abs({a}), abs({b}))"
_OTHERS = [
    (_FAR.format(a="total_revenue", b="total_revenue_excluding_subsidy + subsidy"), "total_revenue total_revenue_excluding_subsidy subsidy", "sum_mismatch"),
    (_FAR.format(a="average_fare", b="farebox_revenue / ridership"), "average_fare farebox_revenue ridership", "cross_source_disagreement"),
]
RECONCILE_SQL = f"""WITH w AS ({YEARS_SQL}), v AS (SELECT a, y, {_as(PRINTED)} FROM w),
    b AS ({' UNION ALL '.join(f"SELECT a, y, unnest(string_split('{ms}', ' ')) AS metric, '{flag}' AS flag FROM v WHERE {c}" for c, ms, flag in [*((c, ms, 'sum_mismatch') for c, ms in _RULES), *_OTHERS])}),
    f AS (SELECT a, y, metric, string_agg(DISTINCT flag, ',' ORDER BY flag) AS flags FROM b GROUP BY ALL),
    u AS (SELECT a, y, metric, value FROM v UNPIVOT (value FOR metric IN ({', '.join(PRINTED)})))
    SELECT a, y, 'total' AS scope, 'operating' AS basis, metric, value, 'read' AS kind, NULL AS equation, coalesce(flags, '') AS flags FROM u LEFT JOIN f USING (a, y, metric)
    UNION ALL SELECT a, y, 'total', 'operating', 'other_liabilities', total_liabilities - long_term_debt, 'derived', 'liabilities_components', '' FROM v WHERE a % 4 = 1"""


SHOWN = {"ridership": "r", "total_revenue_excluding_subsidy": "f + 1000", "cost_per_rider": "e / r", "average_fare": "f / r", "revenue_service_hours": "h", "cost_per_hour": "e / h"}
UNITS = {"ridership": "count", "total_revenue_excluding_subsidy": "CAD", "cost_per_rider": "CAD", "average_fare": "CAD", "revenue_service_hours": "hours", "cost_per_hour": "CAD/hr"}


def _series(spark: SparkSession, d: str) -> DataFrame:
    """Annual values in one or two scopes, and months of rides; ranks up to 1996 of one metric, and none of some agencies."""
    unit = F.element_at(F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv]), F.col("metric"))
    w = _years(spark, d)
    annual = _cells(w, SHOWN, "conventional", "").unionByName(_cells(w.filter("a % 3 = 0 AND y < 1998"), {m: f"1.1 * ({s})" for m, s in SHOWN.items()}, "total", ""))
    annual = annual.select(F.col("a").alias("agency_id"), "metric", "scope", F.lit("annual_calendar").alias("period_type"), F.col("y").cast("string").alias("period"), F.make_date("y", F.lit(12), F.lit(31)).alias("end_date"), "value")
    months = monthly(spark, d).select("agency_id", F.lit("ridership").alias("metric"), F.lit("conventional").alias("scope"), F.lit("monthly").alias("period_type"), F.date_format("month", "yyyy-MM").alias("period"), F.last_day("month").alias("end_date"), F.col("ridership").alias("value"))
    ranked = annual.filter("scope = 'conventional' AND agency_id % 7 <> 0 AND metric <> 'cost_per_hour' AND NOT (metric = 'average_fare' AND period > '1996')")
    by = Window.partitionBy("metric", "period")
    ranks = ranked.select("agency_id", "metric", "period", "end_date", F.rank().over(by.orderBy(F.desc("value"))).alias("rank"), F.count("*").over(by).alias("of"))
    return readmodels.metric_series(annual.unionByName(months).withColumn("unit", unit), ranks)


def series_models(spark: SparkSession, d: str) -> DataFrame:
    return _series(spark, d).withColumn("n_points", F.size("points").cast("long")).withColumn("first", F.col("points")[0]["period"]).drop("points")


def detail_slots(spark: SparkSession, d: str) -> DataFrame:
    return readmodels.detail_model(_series(spark, d))


_SERIES = f"""w AS ({YEARS_SQL}),
    c AS (SELECT a, y, 'conventional' AS scope, {_as(SHOWN)} FROM w UNION ALL SELECT a, y, 'total', {_as({m: f'1.1 * ({s})' for m, s in SHOWN.items()})} FROM w WHERE a % 3 = 0 AND y < 1998),
    n AS (SELECT a AS agency_id, metric, scope, 'annual_calendar' AS kind, y::VARCHAR AS period, make_date(y, 12, 31) AS end_date, value FROM c UNPIVOT (value FOR metric IN ({', '.join(SHOWN)}))),
    k AS (SELECT agency_id, metric, period, end_date, rank() OVER (PARTITION BY metric, period ORDER BY value DESC) AS rank, count(*) OVER (PARTITION BY metric, period) AS n
          FROM n WHERE scope = 'conventional' AND agency_id % 7 <> 0 AND metric <> 'cost_per_hour' AND NOT (metric = 'average_fare' AND period > '1996')),
    l AS (SELECT metric, max(period) AS latest FROM k GROUP BY metric),
    v AS (SELECT * FROM n UNION ALL SELECT agency_id, metric, 'conventional', 'monthly', strftime(month, '%Y-%m'), last_day(month), value FROM ({LONG_SQL}) WHERE metric = 'ridership'),
    p AS (SELECT *, first_value(scope) OVER (PARTITION BY agency_id, metric ORDER BY scope <> 'total', scope) AS pick FROM v),
    s AS (SELECT agency_id, metric, scope, arg_max(value, (end_date, kind)) AS value, arg_max(period, (end_date, kind)) AS as_of, arg_min(period, (end_date, kind)) AS first, count(*) AS n_points, bool_or(period = latest) AS there, max(latest) AS latest
          FROM p LEFT JOIN l USING (metric) WHERE scope = pick GROUP BY ALL),
    r AS (SELECT s.*, k.rank, k.n, CASE WHEN NOT coalesce(there, false) THEN 'no_comparable_period' WHEN k.rank IS NULL THEN 'pending' WHEN k.n < 5 THEN 'below_min_denominator' END AS suppressed
          FROM s LEFT JOIN k ON k.agency_id = s.agency_id AND k.metric = s.metric AND k.period = s.latest)"""
_UNIT = "CASE metric " + " ".join(f"WHEN '{m}' THEN '{u}'" for m, u in UNITS.items()) + " END"
_SLOTS = ", ".join(f"('{s}', {k}, '{m}')" for s, ms in readmodels.SLOTS.items() for k, m in enumerate(ms, 1))


def formatted_values(spark: SparkSession, d: str) -> DataFrame:
    """Order totals as money, at length and shortened, and as rides, hours and changes."""
    v = F.col("o_totalprice").cast("decimal(18,2)")
    shifted = F.when(F.col("o_orderkey") % 3 == 0, -v).when(F.col("o_orderkey") % 3 == 1, v * 1000).otherwise(F.floor(v))
    rows = table(spark, d, "orders").select("o_orderkey", shifted.cast("double").alias("v"))
    return rows.select(
        "o_orderkey", tx.format_value(F.col("v"), F.lit("CAD")).alias("money"), tx.format_value(F.col("v"), F.lit("USD"), short=True).alias("short"), tx.format_value(F.col("v"), F.lit("hours")).alias("hours"),
        tx.format_value(F.col("v") / 1000, F.lit("%")).alias("percent"), tx.format_value(F.col("v") / 1000, F.lit("years")).alias("years"), tx.format_change(F.col("v") / 10000).alias("change"),
    )


def folded_slugs(spark: SparkSession, d: str) -> DataFrame:
    """The first words of each document as a slug, whatever letters they have."""
    words = F.substring_index(F.substring_index(F.coalesce("text", F.lit("")), "\n", 1), " ", 5)
    return table(spark, d, "documents").select("doc_id", tx.ascii_slug(F.concat(words, F.lit(" – ﬁn № ½ Ⅷ Ø"))).alias("slug"))


QUERIES = {f.__name__: f for f in (statistical_feed_load, mode_feed_load, epoch_feed_load, statement_reconcile, series_models, detail_slots, formatted_values, folded_slugs)}

_GROUPED = "format('{{:,.{n}f}}', round({x}, {n})::DOUBLE)"
_PLAIN2 = lambda x: f"regexp_replace(regexp_replace({_GROUPED.format(n=2, x=x)}, '(\\.[0-9]*[1-9])0+$', '\\1'), '\\.0*$', '')"
_PLAIN1 = lambda x: f"regexp_replace({_GROUPED.format(n=1, x=x)}, '\\.0$', '')"
_SHORT = f"CASE WHEN x >= 999995000 THEN {_PLAIN2('x * 0.000000001')} || 'B' WHEN x >= 999995 THEN {_PLAIN2('x * 0.000001')} || 'M' ELSE {_PLAIN2('x * 0.001')} || 'K' END"
_MONEY = f"CASE WHEN x = floor(x) THEN {_GROUPED.format(n=0, x='x')} ELSE {_GROUPED.format(n=2, x='x')} END"

SQL = {
    "statistical_feed_load": f"""
        WITH r AS (SELECT f.*, agency_name || ', "city"' AS label FROM ({LONG_SQL}) f JOIN ({AGENCY_SQL}) g USING (agency_id) WHERE metric <> 'farebox_revenue')
        SELECT CASE WHEN told IN ('verified', 'preliminary') THEN agency_id::VARCHAR ELSE label END AS who, strftime(month, '%Y-%m') AS month,
               CASE WHEN told IN ('verified', 'preliminary') THEN metric WHEN metric = 'ridership' THEN 'Trips' WHEN metric = 'revenue_service_hours' THEN 'Hours' ELSE 'Cost' END AS what,
               CASE WHEN told IN ('verified', 'preliminary') THEN value END AS value, told
        FROM (SELECT *, CASE WHEN agency_id % 12 = 5 THEN 'unmapped agency' WHEN metric = 'operating_expenses' THEN 'unmapped measure' WHEN month(month) = 2 AND agency_id % 5 = 0 THEN 'no value'
                             WHEN year(month) >= 1998 THEN 'preliminary' ELSE 'verified' END AS told FROM r)""",
    "mode_feed_load": f"""
        WITH r AS (SELECT l_suppkey AS agency_id, date_trunc('month', l_shipdate)::DATE AS month, CASE WHEN l_linenumber <> 7 THEN l_quantity::INT END AS trips,
                          CASE WHEN l_linenumber <= 2 THEN round(l_tax * 100)::INT END AS miles, CASE WHEN l_returnflag <> 'A' THEN 1 END AS hours
                   FROM lineitem WHERE l_suppkey % 6 <> 0 AND l_suppkey % 11 <> 0 AND l_shipdate >= '1995-03-01' AND l_suppkey IN (SELECT agency_id FROM ({AGENCY_SQL})))
        SELECT agency_id, month, 'ridership' AS metric, sum(trips)::DOUBLE AS value FROM r GROUP BY ALL HAVING count(trips) > 0
        UNION ALL SELECT agency_id, month, 'vehicle_km', sum(miles)::DOUBLE * 1.609344::DOUBLE FROM r GROUP BY ALL HAVING count(miles) > 0
        UNION ALL SELECT agency_id, month, 'revenue_service_hours', sum(hours)::DOUBLE FROM r GROUP BY ALL HAVING count(hours) > 0""",
    "epoch_feed_load": """
        WITH r AS (SELECT ts, value, event_id % 10 AS k FROM events)
        SELECT strftime(ts, '%Y-%m') AS what, count(*) AS n, sum(value::DECIMAL(18,4))::DOUBLE AS total FROM r WHERE k > 3 AND value IS NOT NULL GROUP BY ALL
        UNION ALL SELECT CASE WHEN k IN (0, 2) OR (k <> 3 AND value IS NULL) THEN 'empty field' WHEN k = 1 THEN 'bad timestamp' ELSE 'bad value' END, count(*), 0.0 FROM r WHERE k <= 3 OR value IS NULL GROUP BY ALL""",
    "statement_reconcile": RECONCILE_SQL,
    "series_models": f"WITH {_SERIES} SELECT agency_id, metric, scope, {_UNIT} AS unit, value, as_of, CASE WHEN suppressed IS NULL THEN rank END AS rank, CASE WHEN suppressed IS NULL THEN n END AS \"of\", suppressed, n_points, first FROM r",
    "detail_slots": f"""
        WITH {_SERIES}, g AS (SELECT DISTINCT agency_id FROM r), t AS (SELECT * FROM (VALUES {_SLOTS}) AS t(section, slot, metric)),
        y AS (SELECT agency_id, metric, scope, max(period) AS now FROM p WHERE kind = 'annual_calendar' AND scope = pick GROUP BY ALL),
        q AS (SELECT y.*, n.value AS v, b.value AS was, b.period AS vs FROM y JOIN n ON (n.agency_id, n.metric, n.scope, n.period) = (y.agency_id, y.metric, y.scope, y.now)
              LEFT JOIN n b ON (b.agency_id, b.metric, b.scope) = (y.agency_id, y.metric, y.scope) AND b.period = (y.now::INT - 1)::VARCHAR AND b.value <> 0)
        SELECT g.agency_id, section, slot, t.metric, coalesce(q.v, r.value) AS value, coalesce(q.now, r.as_of) AS as_of, {_UNIT.replace('metric', 'r.metric')} AS unit,
               CASE WHEN section = 'hero' AND suppressed IS NULL THEN rank END AS rank, CASE WHEN section = 'hero' AND suppressed IS NULL THEN n END AS "of",
               CASE WHEN section = 'hero' THEN floor((v - was) / abs(was) * 1000 + 0.5) / 10 END AS pct, CASE WHEN section = 'hero' THEN vs END AS vs
        FROM g CROSS JOIN t LEFT JOIN r ON r.agency_id = g.agency_id AND r.metric = t.metric LEFT JOIN q ON q.agency_id = g.agency_id AND q.metric = t.metric""",
    "formatted_values": f"""
        WITH v AS (SELECT o_orderkey, o_totalprice::DECIMAL(18,2) AS p FROM orders), s AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN -p WHEN 1 THEN p * 1000 ELSE floor(p) END AS v FROM v),
        x AS (SELECT *, abs(v) AS x, CASE WHEN v < 0 THEN '-' ELSE '' END AS sign FROM s)
        SELECT o_orderkey, sign || '$' || {_MONEY} AS money, sign || '$' || CASE WHEN x >= 100000 THEN {_SHORT} ELSE {_MONEY} END AS short, sign || {_PLAIN2('x')} || ' hrs' AS hours,
               CASE WHEN round(x * 0.001, 1) = 0 THEN '' ELSE sign END || {_PLAIN1('x * 0.001')} || '%' AS percent, CASE WHEN round(x * 0.001, 1) = 0 THEN '' ELSE sign END || printf('%.1f', round(x * 0.001, 1)::DOUBLE) || ' yrs' AS years, printf('%.1f', round(x * 0.0001, 1)::DOUBLE) || '%' AS change FROM x""",
    "folded_slugs": """
        WITH f AS (SELECT doc_id, array_to_string(string_split(string_split(coalesce(text, ''), chr(10))[1], ' ')[1:5], ' ') AS t FROM documents)
        SELECT doc_id, trim(regexp_replace(lower(replace(strip_accents(t), 'ß', '')) || '-fin-no-12-viii', '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM f""",
}
