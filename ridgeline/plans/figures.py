"""Queries over figures: validation, statements, equations, roll-ups, sheets and releases, with their SQL twins."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline.operators import checks, closures, solver
from ridgeline.operators import validation as vd
from ridgeline.sources import releases, sinks, workbook
from ridgeline.sources.frames import AGENCY_SQL, METRICS, MONTHLY_SQL, agency, long_facts, monthly, table

M_SQL = MONTHLY_SQL.format(more="")
LONG_SQL = f"SELECT agency_id, month, metric, value FROM ({M_SQL}) UNPIVOT (value FOR metric IN (ridership, farebox_revenue, operating_expenses, revenue_service_hours))"
_SUM = "CAST(SUM(CAST({} AS DECIMAL(28,4))) AS DOUBLE)"
_YEARS = {"e": "operating_expenses", "f": "farebox_revenue", "r": "ridership", "h": "revenue_service_hours"}
YEARS_SQL = f"SELECT agency_id AS a, year(month) AS y, {', '.join(f'{_SUM.format(c)} AS {k}' for k, c in _YEARS.items())} FROM ({M_SQL}) GROUP BY ALL"


def _years(spark: SparkSession, d: str) -> DataFrame:
    """One row for each agency and year: expenses, fares, rides and hours."""
    return monthly(spark, d).groupBy(F.col("agency_id").alias("a"), F.year("month").alias("y")).agg(*[F.expr(_SUM.format(c)).alias(k) for k, c in _YEARS.items()])


#: An agency's statements, made of its expenses and fares; each of agencies 1 to 16 (modulo 17) breaks one rule.
CELLS = {
    "operating_expenses": "e", "labour_cost": "CASE WHEN a % 17 = 1 THEN 0.6 * e ELSE 0.5 * e END", "energy_fuel_cost": "0.2 * e", "materials_services_cost": "0.1 * e",
    "amortization": "0.1 * e", "other_operating_expenses": "0.1 * e", "farebox_revenue": "CASE WHEN a % 17 = 11 THEN f + 5000 ELSE f END",
    "other_revenue": "CASE WHEN a % 17 = 7 THEN f WHEN a % 17 = 11 THEN -4000 ELSE 1000 END", "total_revenue_excluding_subsidy": "f + 1000",
    "subsidy": "CASE WHEN a % 17 = 2 THEN e - f + 0.2 * e ELSE e - f - 1000 END", "total_revenue": "e", "total_expenses": "1.1 * e",
    "annual_surplus_deficit": "CASE WHEN a % 17 = 3 THEN 0 * e ELSE e - 1.1 * e END", "cash_and_investments": "CASE WHEN a % 17 = 12 THEN 3 * e ELSE 1.5 * e END",
    "other_financial_assets": "CASE WHEN a % 17 = 8 THEN e WHEN a % 17 = 12 THEN -1 * e ELSE 0.5 * e END", "total_financial_assets": "2 * e",
    "long_term_debt": "CASE WHEN a % 17 = 13 THEN 4 * e ELSE 2 * e END", "other_liabilities": "CASE WHEN a % 17 = 9 THEN 2 * e WHEN a % 17 = 13 THEN -1 * e ELSE e END", "total_liabilities": "3 * e",
    "tangible_capital_assets": "CASE WHEN a % 17 = 14 THEN 6 * e ELSE 4 * e END", "other_non_financial_assets": "CASE WHEN a % 17 = 10 THEN 2 * e WHEN a % 17 = 14 THEN -1 * e ELSE e END",
    "total_non_financial_assets": "5 * e", "total_assets": "CASE WHEN a % 17 = 4 THEN 8 * e ELSE 7 * e END", "accumulated_surplus": "CASE WHEN a % 17 = 5 THEN 5 * e ELSE 4 * e END",
    "net_debt": "CASE WHEN a % 17 = 6 THEN 2 * e ELSE e END",
}
_EXPENSES = ("operating_expenses", "labour_cost", "energy_fuel_cost", "materials_services_cost", "other_operating_expenses", "total_expenses")
_SCOPED = {"total_assets": "7 * e", "total_liabilities": "3 * e", "accumulated_surplus": "5 * e"}


def _cells(rows: DataFrame, cells: dict[str, str], scope: str, basis: str) -> DataFrame:
    wide = rows.selectExpr("a", "y", *[f"CAST({sql} AS DOUBLE) AS {m}" for m, sql in cells.items()])
    return wide.unpivot(["a", "y"], list(cells), "metric", "value").withColumns({"scope": F.lit(scope), "basis": F.lit(basis)})


def cohort_rules(spark: SparkSession, d: str) -> DataFrame:
    """Statements in which every identity, family and bound is broken somewhere; some with expenses on a second basis, or with
    a second scope."""
    w = _years(spark, d)
    rows = _cells(w, CELLS, "total", "operating")
    rows = rows.unionByName(_cells(w.filter("a % 5 = 0"), {m: f"1.2 * ({CELLS[m]})" for m in _EXPENSES}, "total", "psab_total"))
    rows = rows.unionByName(_cells(w.filter("a % 7 = 0"), _SCOPED, "conventional", "operating"))
    return checks.cohort_failures(rows, ["a", "y"])


_RULES = [
    ("abs(labour_cost + energy_fuel_cost + materials_services_cost + amortization + other_operating_expenses - operating_expenses) > 0.02 * abs(operating_expenses)", "operating_expenses labour_cost energy_fuel_cost materials_services_cost amortization other_operating_expenses"),
    ("abs(subsidy - (operating_expenses - total_revenue_excluding_subsidy)) > 0.1 * abs(operating_expenses)", "operating_expenses subsidy total_revenue_excluding_subsidy"),
    ("abs(annual_surplus_deficit - (total_revenue - total_expenses)) > 0.02 * abs(total_revenue)", "total_revenue total_expenses annual_surplus_deficit"),
    ("abs(total_financial_assets + total_non_financial_assets - total_assets) > 0.02 * abs(total_assets)", "total_assets total_financial_assets total_non_financial_assets"),
    ("abs(accumulated_surplus - (total_assets - total_liabilities)) > 0.02 * abs(total_assets)", "total_assets accumulated_surplus total_liabilities"),
    ("abs(net_debt - (total_liabilities - total_financial_assets)) > 0.02 * abs(total_liabilities)", "net_debt total_liabilities total_financial_assets"),
    *[(f"abs({a} + {b} - {t}) > 0.02 * abs({t})", f"{t} {a} {b}") for t, a, b in (
        ("total_revenue_excluding_subsidy", "farebox_revenue", "other_revenue"), ("total_financial_assets", "cash_and_investments", "other_financial_assets"),
        ("total_liabilities", "long_term_debt", "other_liabilities"), ("total_non_financial_assets", "tangible_capital_assets", "other_non_financial_assets"))],
    *[(f"{a} > {t}", f"{t} {a}") for t, a in (("total_revenue_excluding_subsidy", "farebox_revenue"), ("total_financial_assets", "cash_and_investments"),
                                              ("total_liabilities", "long_term_debt"), ("total_non_financial_assets", "tangible_capital_assets"))],
]
_as = lambda cells, own=lambda m, s: s: ", ".join(f"CAST({own(m, s)} AS DOUBLE) AS {m}" for m, s in cells.items())
COHORT_SQL = f"""WITH w AS ({YEARS_SQL}),
    v AS (SELECT a, y, 'total' AS scope, 'operating' AS basis, {_as(CELLS)} FROM w
          UNION ALL SELECT a, y, 'total', 'psab_total', {_as(CELLS, lambda m, s: f'1.2 * ({s})' if m in _EXPENSES else s)} FROM w WHERE a % 5 = 0
          UNION ALL SELECT a, y, 'conventional', 'operating', {_as(CELLS, lambda m, s: _SCOPED.get(m, 'NULL'))} FROM w WHERE a % 7 = 0),
    b AS ({' UNION ALL '.join(f"SELECT a, y, scope, basis, unnest(string_split('{ms}', ' ')) AS metric FROM v WHERE {c}" for c, ms in _RULES)})
    SELECT DISTINCT a, y, scope, basis, metric FROM b"""

#: What is printed, forwards (parts) for even agencies and backwards (totals and some parts) for odd ones.
FORWARDS = {
    "labour_cost": "0.5 * e", "energy_fuel_cost": "0.2 * e", "materials_services_cost": "0.1 * e", "amortization": "0.1 * e", "other_operating_expenses": "0.1 * e",
    "farebox_revenue": "f", "other_revenue": "1000", "total_expenses": "1.1 * e", "ridership": "r", "revenue_service_hours": "h", "service_area_population": "10000 + a",
    "cash_and_investments": "1.5 * e", "other_financial_assets": "0.5 * e", "long_term_debt": "2 * e", "other_liabilities": "e", "tangible_capital_assets": "4 * e", "other_non_financial_assets": "e",
}
BACKWARDS = {
    "operating_expenses": "e", "labour_cost": "0.5 * e", "energy_fuel_cost": "0.2 * e", "materials_services_cost": "0.1 * e", "amortization": "0.1 * e", "subsidy": "e - f", "ridership": "r",
    "average_fare": "0.9 * f / r", "annual_surplus_deficit": "-0.1 * e", "cost_per_hour": "e / h", "service_area_population": "10000 + a", "total_assets": "7 * e", "total_financial_assets": "2 * e",
    "accumulated_surplus": "4 * e", "cash_and_investments": "1.5 * e", "long_term_debt": "2 * e", "tangible_capital_assets": "4 * e",
}
#: In the order in which they are solved: metric, equation, value of the columns before.
SOLVED = {
    "FORWARDS": [
        ("operating_expenses", "expense_components", "labour_cost + energy_fuel_cost + materials_services_cost + amortization + other_operating_expenses"),
        ("total_revenue_excluding_subsidy", "earned_revenue_components", "farebox_revenue + other_revenue"), ("average_fare", "average_fare_def", "farebox_revenue / ridership"),
        ("trips_per_revenue_hour", "trips_per_revenue_hour_def", "ridership / revenue_service_hours"), ("total_financial_assets", "financial_assets_components", "cash_and_investments + other_financial_assets"),
        ("total_liabilities", "liabilities_components", "long_term_debt + other_liabilities"), ("total_non_financial_assets", "non_financial_assets_components", "tangible_capital_assets + other_non_financial_assets"),
        ("subsidy", "expense_revenue_subsidy", "operating_expenses - total_revenue_excluding_subsidy"), ("cost_per_hour", "cost_per_hour_def", "operating_expenses / revenue_service_hours"),
        ("cost_per_rider", "cost_per_rider_def", "operating_expenses / ridership"), ("farebox_recovery_ratio", "farebox_recovery_def", "farebox_revenue / operating_expenses"),
        ("total_assets", "total_assets_identity", "total_financial_assets + total_non_financial_assets"), ("net_debt", "net_debt_def", "total_liabilities - total_financial_assets"),
        ("total_revenue", "total_revenue_def", "total_revenue_excluding_subsidy + subsidy"), ("subsidy_per_rider", "subsidy_per_rider_def", "subsidy / ridership"),
        ("accumulated_surplus", "accumulated_surplus_identity", "total_assets - total_liabilities"), ("debt_to_assets", "debt_to_assets_def", "total_liabilities / total_assets"),
        ("net_debt_per_capita", "net_debt_per_capita_def", "net_debt / service_area_population"), ("annual_surplus_deficit", "annual_surplus_deficit_def", "total_revenue - total_expenses"),
    ],
    "BACKWARDS": [
        ("total_revenue_excluding_subsidy", "expense_revenue_subsidy", "operating_expenses - subsidy"), ("other_operating_expenses", "expense_components", "operating_expenses - labour_cost - energy_fuel_cost - materials_services_cost - amortization"),
        ("farebox_revenue", "average_fare_def", "average_fare * ridership"), ("revenue_service_hours", "cost_per_hour_def", "operating_expenses / cost_per_hour"), ("cost_per_rider", "cost_per_rider_def", "operating_expenses / ridership"),
        ("subsidy_per_rider", "subsidy_per_rider_def", "subsidy / ridership"), ("total_non_financial_assets", "total_assets_identity", "total_assets - total_financial_assets"),
        ("total_liabilities", "accumulated_surplus_identity", "total_assets - accumulated_surplus"), ("other_financial_assets", "financial_assets_components", "total_financial_assets - cash_and_investments"),
        ("other_revenue", "earned_revenue_components", "total_revenue_excluding_subsidy - farebox_revenue"), ("total_revenue", "total_revenue_def", "total_revenue_excluding_subsidy + subsidy"),
        ("farebox_recovery_ratio", "farebox_recovery_def", "farebox_revenue / operating_expenses"), ("trips_per_revenue_hour", "trips_per_revenue_hour_def", "ridership / revenue_service_hours"),
        ("net_debt", "net_debt_def", "total_liabilities - total_financial_assets"), ("other_liabilities", "liabilities_components", "total_liabilities - long_term_debt"),
        ("other_non_financial_assets", "non_financial_assets_components", "total_non_financial_assets - tangible_capital_assets"), ("debt_to_assets", "debt_to_assets_def", "total_liabilities / total_assets"),
        ("total_expenses", "annual_surplus_deficit_def", "total_revenue - annual_surplus_deficit"), ("net_debt_per_capita", "net_debt_per_capita_def", "net_debt / service_area_population"),
    ],
}


def balance_sheet_solve(spark: SparkSession, d: str) -> DataFrame:
    """Whole statements from what is printed: each of the 19 equations is solved, for its total and for one of its parts."""
    w, parts = _years(spark, d), []
    metrics = list(dict.fromkeys([*FORWARDS, *BACKWARDS]))
    for cells, side in ((FORWARDS, "a % 2 = 0"), (BACKWARDS, "a % 2 = 1")):
        parts.append(w.filter(side).selectExpr("a", "y", *[f"CAST({cells.get(m, 'NULL')} AS DOUBLE) AS {m}" for m in metrics]))
    out = solver.solve_all(reduce(DataFrame.unionByName, parts), ["a", "y"])
    return out.filter("equation IS NOT NULL").select("a", "y", "metric", "equation", F.round("value", 6).alias("value"))


def _chain(name: str, cells: dict[str, str], side: str) -> str:
    steps = [f"{name}0 AS (SELECT a, y, {', '.join(f'CAST({s} AS DOUBLE) AS {m}' for m, s in cells.items())} FROM w WHERE {side})"]
    steps += [f"{name}{k} AS (SELECT *, {sql} AS {m} FROM {name}{k - 1})" for k, (m, _, sql) in enumerate(SOLVED[name], 1)]
    return ", ".join(steps)


SOLVE_SQL = f"""WITH w AS ({YEARS_SQL}), {_chain('FORWARDS', FORWARDS, 'a % 2 = 0')}, {_chain('BACKWARDS', BACKWARDS, 'a % 2 = 1')}
    {' UNION ALL '.join(f"SELECT a, y, '{m}' AS metric, '{q}' AS equation, round({m}, 6) AS value FROM {n}{len(s)}" for n, s in SOLVED.items() for m, q, _ in s)}"""


def equation_texts(spark: SparkSession, d: str) -> DataFrame:
    """How often each equation was solved, beside its display."""
    shown = spark.createDataFrame([(e.code, f"{e.total} = {e.display()}") for e in solver.STATEMENT_EQUATIONS], "equation string, display string")
    n = balance_sheet_solve(spark, d).groupBy("equation", "metric").agg(F.count("*").alias("n"))
    return n.join(F.broadcast(shown), "equation")  # 19 equations


_SHOWN = {
    "expense_revenue_subsidy": "operating_expenses = total_revenue_excluding_subsidy + subsidy",
    "expense_components": "operating_expenses = labour_cost + energy_fuel_cost + materials_services_cost + amortization + other_operating_expenses",
    "earned_revenue_components": "total_revenue_excluding_subsidy = farebox_revenue + other_revenue", "total_revenue_def": "total_revenue = total_revenue_excluding_subsidy + subsidy",
    "annual_surplus_deficit_def": "annual_surplus_deficit = total_revenue - total_expenses", "average_fare_def": "average_fare = farebox_revenue / ridership",
    "cost_per_hour_def": "cost_per_hour = operating_expenses / revenue_service_hours", "cost_per_rider_def": "cost_per_rider = operating_expenses / ridership",
    "farebox_recovery_def": "farebox_recovery_ratio = farebox_revenue / operating_expenses", "subsidy_per_rider_def": "subsidy_per_rider = subsidy / ridership",
    "trips_per_revenue_hour_def": "trips_per_revenue_hour = ridership / revenue_service_hours", "net_debt_def": "net_debt = total_liabilities - total_financial_assets",
    "total_assets_identity": "total_assets = total_financial_assets + total_non_financial_assets", "accumulated_surplus_identity": "accumulated_surplus = total_assets - total_liabilities",
    "debt_to_assets_def": "debt_to_assets = total_liabilities / total_assets", "net_debt_per_capita_def": "net_debt_per_capita = net_debt / service_area_population",
    "financial_assets_components": "total_financial_assets = cash_and_investments + other_financial_assets", "liabilities_components": "total_liabilities = long_term_debt + other_liabilities",
    "non_financial_assets_components": "total_non_financial_assets = tangible_capital_assets + other_non_financial_assets",
}


def row_validation(spark: SparkSession, d: str) -> DataFrame:
    """Yearly values with a second source up to 4 per cent off, units in Canadian money throughout, and two tiers."""
    cells = {"ridership": "r", "farebox_revenue": "f", "operating_expenses": "e", "revenue_service_hours": "h", "average_fare": "f / r", "farebox_recovery_ratio": "2000 * f / e", "unheard_of": "e", "fleet_size": "CASE WHEN a % 9 = 0 THEN -1 * r ELSE r END", "subsidy": "CASE WHEN a % 8 = 0 THEN 500 ELSE e - f END"}
    rows = _cells(_years(spark, d), cells, "total", "operating").drop("scope", "basis").withColumn("value", F.col("value").cast("decimal(28,4)"))
    units = {"ridership": "count", "revenue_service_hours": "hours", "farebox_recovery_ratio": "%", "fleet_size": "count"}
    unit = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in units.items() for x in kv]), F.col("metric")), F.lit("CAD"))
    rows = rows.withColumns({"unit": unit, "prior": F.lag("value").over(Window.partitionBy("a", "metric").orderBy("y")), "crosscheck": (F.col("value") * (100 + F.col("a") % 5) / 100).cast("decimal(28,4)")})
    rows = rows.join(agency(spark, d).select(F.col("agency_id").alias("a"), "currency"), "a").withColumn("tier", (F.col("a") % 3 == 0).cast("int"))
    return vd.validate_rows(rows).select("a", "y", "metric", F.array_join("flags", ",").alias("flags"), "status")


VALIDATION_SQL = f"""WITH w AS ({YEARS_SQL}), c AS (SELECT a, y, r AS ridership, f AS farebox_revenue, e AS operating_expenses, h AS revenue_service_hours, f / r AS average_fare, 2000 * f / e AS farebox_recovery_ratio,
        e AS unheard_of, CASE WHEN a % 9 = 0 THEN -1 * r ELSE r END AS fleet_size, CASE WHEN a % 8 = 0 THEN 500 ELSE e - f END AS subsidy FROM w),
    v AS (SELECT a, y, metric, value::DECIMAL(28,4) AS value FROM c UNPIVOT (value FOR metric IN (ridership, farebox_revenue, operating_expenses, revenue_service_hours, average_fare, farebox_recovery_ratio, unheard_of, fleet_size, subsidy))),
    p AS (SELECT v.*, lag(value) OVER (PARTITION BY a, metric ORDER BY y) AS prior, (value * (100 + a % 5) / 100)::DECIMAL(28,4) AS other, currency,
                 metric IN ('farebox_revenue', 'operating_expenses', 'average_fare', 'subsidy') AS money FROM v JOIN ({AGENCY_SQL}) g ON g.agency_id = a),
    f AS (SELECT *, concat_ws(',', CASE WHEN prior <> 0 AND abs(value - prior) > abs(prior) * 0.50 THEN 'yoy_spike' END, CASE WHEN other <> 0 AND abs(value - other) > abs(other) * 0.02 THEN 'cross_source_disagreement' END,
                 CASE WHEN (money AND currency <> 'CAD') OR (metric = 'farebox_recovery_ratio' AND value > 1000) OR (metric IN ('ridership', 'fleet_size') AND value < 0)
                           OR (money AND metric <> 'average_fare' AND value <> 0 AND abs(value) < 10000) THEN 'unit_mismatch' END) AS flags FROM p)
    SELECT a, y, metric, flags, CASE WHEN a % 3 <> 0 AND flags = '' THEN 'approved' ELSE 'pending' END AS status FROM f"""


def statement_lines(spark: SparkSession, d: str) -> DataFrame:
    """Both statements of each agency, 13 and 11 rows, a cell for each of its years; what was never read is an empty cell."""
    cells = {m: s for m, s in CELLS.items() if m not in ("total_assets",)}
    annual = _cells(_years(spark, d), cells, "total", "operating").filter("NOT (metric = 'subsidy' AND a % 8 = 0 AND y = 1996)")
    out = vd.statements(annual, ["a"], "y")
    return out.select("a", "statement", "line", "metric", F.explode("cells").alias("y", "value"))


_LINES = ", ".join(f"('{s}', {k}, '{m}')" for s, ms in (("operations", vd.OPERATIONS), ("position", vd.POSITION)) for k, m in enumerate(ms, 1))
_STATED = [m for m in CELLS if m != "total_assets"]
STATEMENT_SQL = f"""WITH w AS ({YEARS_SQL}), c AS (SELECT a, y, {_as({m: CELLS[m] for m in _STATED})} FROM w),
    v AS (SELECT a, y, metric, value FROM c UNPIVOT (value FOR metric IN ({', '.join(_STATED)})) WHERE NOT (metric = 'subsidy' AND a % 8 = 0 AND y = 1996))
    SELECT w.a, statement, line, l.metric, w.y, v.value FROM w, (VALUES {_LINES}) AS l(statement, line, metric) LEFT JOIN v ON v.a = w.a AND v.y = w.y AND v.metric = l.metric"""


def rollup_promote(spark: SparkSession, d: str) -> DataFrame:
    """Quarters summed from months against quarters that are there: close or off by 5 per cent, derived before, or none."""
    v = F.col("value").cast("decimal(28,4)")
    rolled = long_facts(monthly(spark, d), ["agency_id", "month"]).groupBy("agency_id", "metric", F.year("month").alias("y"), F.quarter("month").alias("q")).agg(F.sum(v).cast("double").alias("value"), F.count("*").alias("n"))
    rolled = rolled.filter("n = 3").drop("n")
    k = F.col("agency_id") % 4
    there = rolled.filter(k < 3).withColumns({"value": F.col("value") * F.when(k == 0, 1.01).when(k == 1, 1.05).otherwise(2.0), "derived": k == 2})
    return vd.promote_rollups(rolled, there, ["agency_id", "metric", "y", "q"])


def scope_values(spark: SparkSession, d: str) -> DataFrame:
    """The latest month of each agency and metric in one scope: total where there is one, else the first of several by name."""
    scope = F.when((F.col("l_returnflag") == "N") & (F.col("agency_id") % 3 == 0), "total").when(F.col("l_returnflag") == "N", "specialized").when(F.col("l_returnflag") == "A", "conventional").otherwise("accessible")
    rows = long_facts(monthly(spark, d, "l_returnflag").withColumn("scope", scope), ["agency_id", "month", "scope"])
    rows = vd.one_scope(rows, ["agency_id", "metric"])
    return rows.groupBy("agency_id", "metric", "scope").agg(F.max("month").alias("month"), F.max_by("value", "month").alias("value"))


def component_quotes(spark: SparkSession, d: str) -> DataFrame:
    """An order's parts by return flag, each by its surest reading, with the least confidence and all quotes."""
    rows = table(spark, d, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("label"), F.col("l_extendedprice").cast("decimal(18,2)").alias("value"), F.round(1 - F.col("l_tax") * 5, 2).alias("confidence"), F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("quote"))
    return vd.component_sums(rows, ["l_orderkey"]).withColumn("value", F.col("value").cast("double"))


def review_report(spark: SparkSession, d: str) -> DataFrame:
    """Values, flagged ones and the review rate by event type and over all, and how often each flag stands."""
    flags = F.array_compact(F.array(F.when(F.col("value") > 80, "high"), F.when(F.col("value") < 10, "low"), F.when(F.col("user_id") % 50 == 7, "known")))
    rows = table(spark, d, "events").select(F.col("event_type").alias("doc"), (F.col("event_id") % 10 / 10).alias("confidence"), flags.alias("flags"))
    out = vd.run_report(rows)
    listed = F.expr("array_join(transform(map_entries(flags), x -> concat(x.key, '=', x.value)), ',')")
    return out.select("total_row", "doc", "values", "flagged", "low_confidence", "review_rate", F.coalesce(listed, F.lit("")).alias("flags"))


def workbook_read(spark: SparkSession, d: str) -> DataFrame:
    """Months written to sheets, a block of 18 columns a year, and read back; one header and some cells cannot be read."""
    rows = long_facts(monthly(spark, d), ["agency_id", "month"]).join(agency(spark, d).select("agency_id", "fye"), "agency_id")
    values = rows.select(F.col("agency_id").cast("string").alias("sheet"), "fye", "metric", F.year("month").alias("year"), F.month("month").alias("month"), F.when((F.month("month") == 5) & (F.col("agency_id") % 10 == 3), F.lit("n/a")).otherwise(F.col("value").cast("string")).alias("value"))
    values = solver.kept(values)  # read by each kind of cell
    years = [r.y for r in values.select(F.col("year").alias("y")).distinct().orderBy("y").collect()]  # one row a year
    label = F.when(F.col("fye") == 12, F.col("year").cast("string")).otherwise(F.concat(F.lit("FY"), F.col("year").cast("string"), F.lit("-"), F.lpad(((F.col("year") + 1) % 100).cast("string"), 2, "0")))
    head = F.when((F.col("year") == years[1]) & (F.col("sheet").cast("int") % 10 == 4), F.lit("next year")).otherwise(label) if len(years) > 1 else label
    cells = workbook.sheet_of(values, head, list(METRICS), years)
    wide = workbook.grid(cells, workbook.FIRST_COLUMN - 1 + workbook.BLOCK * len(years))  # the sparse grid as it is on the sheet
    return workbook.read_grid(solver.kept(workbook.sheet_cells(wide)), list(METRICS), []).withColumn("value", F.round("value", 4))


WORKBOOK_SQL = f"""WITH v AS (SELECT agency_id, agency_id::VARCHAR AS sheet, metric, year(month)::INT AS year, month(month)::INT AS month, value FROM ({LONG_SQL})),
    s AS (SELECT min(year) + 1 AS second FROM v), g AS (SELECT sheet, year FROM v GROUP BY ALL),
    t AS (SELECT sheet, min(k) AS gap FROM (SELECT sheet, k FROM (SELECT DISTINCT sheet FROM g), (SELECT unnest(range((SELECT min(year) FROM v), (SELECT max(year) + 2 FROM v)))::INT AS k)) x
          WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.sheet = x.sheet AND g.year = x.k) GROUP BY sheet),
    r AS (SELECT v.*, year = second AND agency_id % 10 = 4 AS lost, month = 5 AND agency_id % 10 = 3 AS odd FROM v JOIN t USING (sheet), s WHERE year < gap)
    SELECT sheet, metric, year, month, CASE WHEN NOT odd THEN round(value, 4) END AS value, CASE WHEN odd THEN 'non-numeric cell: n/a' END AS problem FROM r WHERE NOT lost
    UNION ALL SELECT DISTINCT sheet, NULL, NULL::INT, NULL::INT, NULL::DOUBLE, 'unreadable year header: next year' FROM r WHERE lost"""


def workbook_formulas(spark: SparkSession, d: str) -> DataFrame:
    """The live cells of each agency's derived metrics in the year's column; where an operand has no row there is none."""
    order = ["ridership", "farebox_revenue", "operating_expenses", "total_revenue_excluding_subsidy", "other_revenue", "average_fare", "cost_per_hour"]
    years = _years(spark, d).select("a", "y", F.dense_rank().over(Window.partitionBy("a").orderBy("y")).alias("k"))
    column = F.element_at(F.array(*[F.lit(sinks.column_letters(workbook.FIRST_COLUMN + workbook.BLOCK * k + workbook.YEAR_AT)) for k in range(60)]), F.col("k"))
    rows = F.create_map(*[x for k, m in enumerate(order) for x in (F.lit(m), F.lit(workbook.FIRST_ROW + k))])
    by = {e.code: e for e in solver.STATEMENT_EQUATIONS}
    told = [("average_fare", "average_fare_def"), ("cost_per_hour", "cost_per_hour_def"), ("other_revenue", "earned_revenue_components")]
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), sinks.equation_formula(by[e], m, rows, column).alias("formula")) for m, e in told])
    out = years.select("a", "y", F.inline(cells))
    first = (workbook.FIRST_COLUMN + workbook.BLOCK * (F.col("k") - 1)).cast("int")
    quarter = F.element_at(F.array(*[sinks.sum_formula(F.lit(workbook.FIRST_ROW), [workbook.FIRST_COLUMN + workbook.BLOCK * k + j for j in range(3)]) for k in range(60)]), F.col("k"))
    return out.unionByName(years.select("a", "y", F.lit("ridership").alias("metric"), F.when(first > 0, quarter).alias("formula")))


_AZ = "CASE WHEN {n} > 26 THEN chr((64 + ({n} - 1) // 26)::INT) ELSE '' END || chr((65 + ({n} - 1) % 26)::INT)"
FORMULA_SQL = f"""WITH k AS (SELECT a, y, dense_rank() OVER (PARTITION BY a ORDER BY y) AS k FROM ({YEARS_SQL})),
    c AS (SELECT a, y, 18 * k + 1 AS n, 18 * k - 16 AS q FROM k), l AS (SELECT a, y, {_AZ.format(n='n')} AS z, {', '.join(f"{_AZ.format(n=f'(q + {j})')} || '3' AS q{j}" for j in range(3))} FROM c)
    SELECT a, y, 'average_fare' AS metric, '=IF(OR(' || z || '4="",' || z || '3="",' || z || '3=0),"",' || z || '4/' || z || '3)' AS formula FROM l
    UNION ALL SELECT a, y, 'cost_per_hour', NULL FROM l
    UNION ALL SELECT a, y, 'other_revenue', '=IF(OR(' || z || '6="",' || z || '4=""),"",' || z || '6-' || z || '4)' FROM l
    UNION ALL SELECT a, y, 'ridership', '=IF(COUNT(' || q0 || ',' || q1 || ',' || q2 || ')=0,"",SUM(' || q0 || ',' || q1 || ',' || q2 || '))' FROM l"""


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """(value_id, input_id): quarters of months, years of quarters, and ratios of years, of which one stands on another."""
    rows = long_facts(solver.kept(monthly(spark, d)), ["agency_id", "month"])  # read by each kind of edge
    name = lambda metric, period: F.concat_ws(":", metric, F.col("agency_id").cast("string"), period)
    m, y = F.date_format("month", "yyyy-MM"), F.year("month").cast("string")
    q = F.concat(y, F.lit("Q"), F.quarter("month").cast("string"))
    out = rows.select(name(F.col("metric"), q).alias("value_id"), name(F.col("metric"), m).alias("input_id"))
    out = out.unionByName(rows.select(name(F.col("metric"), y).alias("value_id"), name(F.col("metric"), q).alias("input_id")).distinct())
    for total, inputs in RATIOS.items():
        for x in inputs:
            out = out.unionByName(rows.select(name(F.lit(total), y).alias("value_id"), name(F.lit(x), y).alias("input_id")).distinct())
    return out


RATIOS = {"cost_per_trip": ("operating_expenses", "ridership"), "recovery_ratio": ("farebox_revenue", "operating_expenses"), "operating_deficit": ("operating_expenses", "recovery_ratio")}


def lineage_closure(spark: SparkSession, d: str) -> DataFrame:
    """Every value that every derived value stands on, and by how many steps at least."""
    return closures.lineage_closure(_edges(spark, d))


_VID = "{m} || ':' || agency_id || ':' || {p}"
_Q = "year(month) || 'Q' || quarter(month)"
EDGES_SQL = f"""SELECT {_VID.format(m='metric', p=f'({_Q})')} AS value_id, {_VID.format(m='metric', p="strftime(month, '%Y-%m')")} AS input_id FROM f
    UNION ALL SELECT DISTINCT {_VID.format(m='metric', p='year(month)')}, {_VID.format(m='metric', p=f'({_Q})')} FROM f
    """ + " ".join(f"UNION ALL SELECT DISTINCT '{t}:' || agency_id || ':' || year(month), '{x}:' || agency_id || ':' || year(month) FROM f" for t, xs in RATIOS.items() for x in xs)


def release_commit(spark: SparkSession, d: str) -> DataFrame:
    """Values and edges published together: a first load, one that fails a check and leaves no trace, a second load, that one
    again, and a snapshot. Rows and totals of each table as readers of each release see them."""
    rows = long_facts(monthly(spark, d), ["agency_id", "month"]).withColumn("value_id", F.concat_ws(":", "metric", F.col("agency_id").cast("string"), F.date_format("month", "yyyy-MM")))
    rows = solver.kept(rows)  # read by each load
    values, edges = rows.select("value_id", "value"), rows.select("value_id", F.concat_ws(":", "metric", F.date_format("month", "yyyy-MM")).alias("cohort"))
    old = rows.filter("month < '1997-01-01'")
    store = releases.Releases(spark, f"{solver.shared_folder(spark)}/releases-{uuid.uuid4().hex}")
    check = {"edges of values": releases.keyed_rows_hold("values", "edges")}
    store.publish("load-1", {"values": old.select(values.columns), "edges": old.select("value_id", F.concat_ws(":", "metric", F.date_format("month", "yyyy-MM")).alias("cohort"))}, check)
    try:
        store.publish("load-broken", {"values": values.limit(0), "edges": edges}, check)
    except ValueError:
        pass
    store.publish("load-2", {"values": values, "edges": edges}, check)
    store.publish("load-2", {"values": values.limit(0), "edges": edges.limit(0)}, check)
    copy = f"{store.root}-snapshot"
    store.snapshot(copy)
    seen = [(n, store, n) for n in store.numbers()] + [(0, releases.Releases(spark, copy), 1)]
    total = F.coalesce(F.sum(F.col("value").cast("decimal(28,4)")).cast("double"), F.lit(0.0))
    out = [s.read("values", k).agg(F.count("*").alias("n"), total.alias("total")).select(F.lit(n).alias("release"), F.lit("values").alias("name"), "n", "total") for n, s, k in seen]
    out += [s.read("edges", k).agg(F.count("*").alias("n")).select(F.lit(n).alias("release"), F.lit("edges").alias("name"), "n", F.lit(0.0).alias("total")) for n, s, k in seen]
    return reduce(DataFrame.unionByName, out)


QUERIES = {f.__name__: f for f in (
    cohort_rules, balance_sheet_solve, equation_texts, row_validation, statement_lines, rollup_promote, scope_values, component_quotes, review_report,
    workbook_read, workbook_formulas, lineage_closure, release_commit,
)}

SQL = {
    "cohort_rules": COHORT_SQL,
    "balance_sheet_solve": SOLVE_SQL,
    "equation_texts": f"""WITH s AS ({SOLVE_SQL}) SELECT equation, metric, count(*) AS n, CASE equation {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _SHOWN.items())} END AS display FROM s GROUP BY equation, metric""",
    "row_validation": VALIDATION_SQL,
    "statement_lines": STATEMENT_SQL,
    "rollup_promote": f"""
        WITH r AS (SELECT agency_id, metric, year(month) AS y, quarter(month) AS q, CAST(sum(CAST(value AS DECIMAL(28,4))) AS DOUBLE) AS s FROM ({LONG_SQL}) GROUP BY ALL HAVING count(*) = 3)
        SELECT agency_id, metric, y, q, CASE agency_id % 4 WHEN 0 THEN s * CAST(1.01 AS DOUBLE) WHEN 1 THEN s * CAST(1.05 AS DOUBLE) WHEN 2 THEN s * 2.0 ELSE s END AS value,
               CASE agency_id % 4 WHEN 3 THEN 'filled' WHEN 1 THEN 'sum_mismatch' ELSE 'kept' END AS action FROM r""",
    "scope_values": f"""
        WITH m AS ({MONTHLY_SQL.format(more=', l_returnflag')}), u AS (SELECT agency_id, month, metric, value, CASE WHEN l_returnflag = 'N' AND agency_id % 3 = 0 THEN 'total' WHEN l_returnflag = 'N' THEN 'specialized' WHEN l_returnflag = 'A' THEN 'conventional' ELSE 'accessible' END AS scope
                   FROM m UNPIVOT (value FOR metric IN (ridership, farebox_revenue, operating_expenses, revenue_service_hours))),
        p AS (SELECT *, first_value(scope) OVER (PARTITION BY agency_id, metric ORDER BY scope <> 'total', scope) AS pick FROM u)
        SELECT agency_id, metric, scope, month, value FROM p WHERE scope = pick QUALIFY row_number() OVER (PARTITION BY agency_id, metric ORDER BY month DESC) = 1""",
    "component_quotes": """
        WITH o AS (SELECT l_orderkey, l_returnflag AS label, l_extendedprice::DECIMAL(18,2) AS v, round(1 - l_tax * 5, 2) AS c, 'line ' || l_linenumber AS quote FROM lineitem
                   QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY round(1 - l_tax * 5, 2) DESC, 'line ' || l_linenumber, l_extendedprice) = 1)
        SELECT l_orderkey, sum(v)::DOUBLE AS value, min(c) AS confidence, string_agg(quote, ' | ' ORDER BY label) AS quotes, count(*) AS n FROM o GROUP BY l_orderkey""",
    "review_report": """
        WITH e AS (SELECT event_type AS doc, event_id % 10 / 10 AS confidence, [x for x in [CASE WHEN value > 80 THEN 'high' END, CASE WHEN value < 10 THEN 'low' END, CASE WHEN user_id % 50 = 7 THEN 'known' END] if x IS NOT NULL] AS flags FROM events),
        b AS (SELECT grouping(doc)::INT AS total_row, doc, count(*) AS values, count(*) FILTER (len(flags) > 0) AS flagged, count(*) FILTER (confidence <= 0.5) AS low_confidence FROM e GROUP BY GROUPING SETS ((doc), ())),
        f AS (SELECT grouping(doc)::INT AS total_row, doc, flag, count(*) AS n FROM (SELECT doc, unnest(flags) AS flag FROM e) GROUP BY GROUPING SETS ((doc, flag), (flag))),
        g AS (SELECT total_row, doc, string_agg(flag || '=' || n, ',' ORDER BY flag) AS flags FROM f GROUP BY ALL)
        SELECT b.total_row, b.doc, values, flagged, low_confidence, flagged / values AS review_rate, coalesce(flags, '') AS flags FROM b LEFT JOIN g ON g.total_row = b.total_row AND g.doc IS NOT DISTINCT FROM b.doc""",
    "workbook_read": WORKBOOK_SQL,
    "workbook_formulas": FORMULA_SQL,
    "lineage_closure": f"""
        WITH RECURSIVE f AS (SELECT agency_id, month, metric FROM ({LONG_SQL})), e AS ({EDGES_SQL}),
        w AS (SELECT value_id, input_id, 1 AS depth FROM e UNION ALL SELECT w.value_id, e.input_id, depth + 1 FROM w JOIN e ON e.value_id = w.input_id)
        SELECT value_id, input_id, min(depth) AS depth FROM w GROUP BY ALL""",
    "release_commit": f"""
        WITH v AS (SELECT month, CAST(value AS DECIMAL(28,4)) AS value FROM ({LONG_SQL})),
        r AS (SELECT 1 AS release, count(*) AS n, CAST(coalesce(sum(value), 0) AS DOUBLE) AS total FROM v WHERE month < '1997-01-01' UNION ALL SELECT unnest([2, 0]), count(*), CAST(sum(value) AS DOUBLE) FROM v)
        SELECT release, 'values' AS name, n, total FROM r UNION ALL SELECT release, 'edges', n, 0.0 FROM r""",
}
