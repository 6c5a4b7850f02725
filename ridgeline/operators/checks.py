"""Checks of staged values: cohorts' identities and bounds, validators, evaluation against known values, replays."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.operators.solver import ATTRIBUTES, STATEMENT_EQUATIONS, Equation, failed_checks, settle, solve_all

#: Fixed values: (anchor, what it should be as added and taken parts, share of the anchor by which it may be off).
IDENTITIES = (
    ("operating_expenses", "operating_expenses", ("labour_cost", "energy_fuel_cost", "materials_services_cost", "amortization", "other_operating_expenses"), (), 0.02),
    ("operating_expenses", "subsidy", ("operating_expenses",), ("total_revenue_excluding_subsidy",), 0.10),
    ("total_revenue", "annual_surplus_deficit", ("total_revenue",), ("total_expenses",), 0.02),
    ("total_assets", "total_assets", ("total_financial_assets", "total_non_financial_assets"), (), 0.02),
    ("total_assets", "accumulated_surplus", ("total_assets",), ("total_liabilities",), 0.02),
    ("total_liabilities", "net_debt", ("total_liabilities",), ("total_financial_assets",), 0.02),
)
#: Totals with a component, which is at most the total, and the rest.
FAMILIES = (
    ("total_revenue_excluding_subsidy", "farebox_revenue", "other_revenue"),
    ("total_financial_assets", "cash_and_investments", "other_financial_assets"),
    ("total_liabilities", "long_term_debt", "other_liabilities"),
    ("total_non_financial_assets", "tangible_capital_assets", "other_non_financial_assets"),
)
#: Metrics whose accounting basis tells cohorts of a scope apart.
EXPENSES = ("operating_expenses", "labour_cost", "energy_fuel_cost", "materials_services_cost", "other_operating_expenses", "total_expenses")


def cohorts(values: DataFrame, keys: list[str]) -> DataFrame:
    """values (keys, scope, basis, metric, value) by cohort: a scope's expenses by their basis, and all its other values in
    each of these; without expenses a scope is one cohort, `operating`."""
    expense = F.col("metric").isin(*EXPENSES)
    bases = values.filter(expense).select(*keys, "scope", "basis").distinct()
    bases = values.select(*keys, "scope").distinct().join(bases, [*keys, "scope"], "left").withColumn("basis", F.coalesce("basis", F.lit("operating")))
    return values.withColumn("_own", F.when(expense, F.col("basis"))).drop("basis").join(bases, [*keys, "scope"]).filter(F.col("_own").isNull() | (F.col("_own") == F.col("basis")))


def cohort_failures(values: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, scope, basis, metric): the values that take part in an identity, family or bound that does not hold.

    values: keys, scope, basis, metric, value. A scope's cohorts are one for each basis of its expense values; its other
    values join each of them. What lacks an operand is not checked.
    """
    rows = cohorts(values, keys)
    metrics = list(dict.fromkeys(m for _, what, parts, less, _ in IDENTITIES for m in (what, *parts, *less))) + [m for f in FAMILIES for m in f]
    by = [*keys, "scope", "basis"]
    wide = rows.groupBy(*by).agg(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in dict.fromkeys(metrics)])
    col, bad = F.col, []
    for anchor, what, parts, less, off in IDENTITIES:
        should = reduce(lambda a, b: a - b, map(col, less), reduce(add, map(col, parts)))
        bad.append(F.when(F.abs(col(what) - should) > F.abs(col(anchor)) * off, F.array(*map(F.lit, dict.fromkeys((anchor, what, *parts, *less))))))
    for total, part, rest in FAMILIES:
        bad.append(F.when(F.abs(col(part) + col(rest) - col(total)) > F.abs(col(total)) * 0.02, F.array(*map(F.lit, (total, part, rest)))))
        bad.append(F.when(col(part) > col(total), F.array(F.lit(total), F.lit(part))))
    return wide.select(*by, F.explode(F.array_distinct(F.flatten(F.array_compact(F.array(*bad))))).alias("metric"))


def reconcile_document(values: DataFrame, keys: list[str], equations: tuple[Equation, ...] = STATEMENT_EQUATIONS) -> DataFrame:
    """(keys, metric, value, kind, equation): a document's readings of each period with `flagged` ones where a ratio or sum
    of only read values fails, and the sums' back-solves as `derived`; ratios are left to the recomputation."""
    metrics = list(dict.fromkeys(m for e in equations for m in e.operands))
    wide = values.groupBy(*keys).agg(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in metrics])
    operands = F.create_map(*[x for e in equations for x in (F.lit(e.code), F.array(*map(F.lit, e.operands)))])
    failed = failed_checks(wide, keys, equations).select(*keys, F.explode(F.element_at(operands, F.col("equation"))).alias("metric"), F.lit(True).alias("_bad")).distinct()
    read = values.join(failed, [*keys, "metric"], "left").select(*keys, "metric", "value", F.when(F.col("_bad"), "flagged").otherwise("read").alias("kind"), F.lit(None).cast("string").alias("equation"))
    solved = solve_all(wide, keys, tuple(e for e in equations if e.kind == "sum")).filter("equation IS NOT NULL")
    return read.unionByName(solved.select(*keys, "metric", "value", F.lit("derived").alias("kind"), "equation"))


#: Equations that the cohorts' identities and families check already.
CHECKED_BY_COHORTS = (
    "expense_components", "expense_revenue_subsidy", "earned_revenue_components", "annual_surplus_deficit_def", "total_assets_identity", "accumulated_surplus_identity",
    "net_debt_def", "financial_assets_components", "liabilities_components", "non_financial_assets_components",
)


def reconcile_statement(values: DataFrame, keys: list[str], equations: tuple[Equation, ...] = STATEMENT_EQUATIONS) -> DataFrame:
    """(keys, scope, basis, metric, value, kind, equation, flags): a document's readings (keys, scope, basis, metric, value),
    each with the flags of what it takes part in, and what the sums determine but nobody printed.

    Readings are `read`, with sum_mismatch from their cohorts' identities and the flags of the other equations that do not
    hold once a cohort is solved. Sums' back-solves are `derived`, with the scope and basis of their cohort; ratios are left
    to the recomputation.
    """
    by = [*keys, "scope", "basis"]
    metrics = list(dict.fromkeys(m for e in equations for m in e.operands))
    rows = cohorts(values, keys)
    wide = rows.groupBy(*by).agg(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in metrics])
    solved = settle(solve_all(wide, by, equations))
    whole = solved.groupBy(*by).agg(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in metrics])
    whole = whole.drop(*ATTRIBUTES).join(wide.select(*by, *ATTRIBUTES), by)
    others = tuple(e for e in equations if e.code not in CHECKED_BY_COHORTS)
    operands = F.create_map(*[x for e in equations for x in (F.lit(e.code), F.array(*map(F.lit, e.operands)))])
    failed = failed_checks(whole, by, others).select(*by, F.explode(F.element_at(operands, F.col("equation"))).alias("metric"), "flag")
    flags = cohort_failures(values, keys).withColumn("flag", F.lit("sum_mismatch")).unionByName(failed)
    # back to the readings of a cohort: expenses have its basis, all others are in each cohort of their scope
    expense = F.col("metric").isin(*EXPENSES)
    flags = flags.withColumn("_basis", F.when(expense, F.col("basis"))).groupBy(*keys, "scope", "_basis", "metric").agg(F.array_sort(F.collect_set("flag")).alias("flags"))
    read = values.withColumn("_basis", F.when(expense, F.coalesce("basis", F.lit("operating"))))
    flags = flags.select(*[F.col(k).alias(f"_{k}") for k in (*keys, "scope", "metric")], F.col("_basis").alias("_of"), "flags")
    same = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_{k}") for k in (*keys, "scope", "metric")], F.col("_basis").eqNullSafe(F.col("_of")))
    read = read.join(flags, same, "left").select(*by, "metric", "value", F.lit("read").alias("kind"), F.lit(None).cast("string").alias("equation"), F.coalesce("flags", F.array().cast("array<string>")).alias("flags"))
    sums = [e.code for e in equations if e.kind == "sum"]
    derived = solved.filter(F.col("equation").isin(*sums)).select(*by, "metric", "value", F.lit("derived").alias("kind"), "equation", F.array().cast("array<string>").alias("flags"))
    return read.unionByName(derived)


def validate(rows: DataFrame, *validators: Callable[[], Column], into: str = "flags") -> DataFrame:
    """Adds the flags that the validators (each a column of one flag or null) find, in their order."""
    return rows.withColumn(into, F.array_distinct(F.array_compact(F.array(*[v() for v in validators]))))


def within(got: Column, true: Column, tolerance: Column) -> Column:
    """Whether a reading is as good as the known value: within a share of it, and exact if that is zero."""
    return F.when(true == 0, got == 0).otherwise(F.abs(got - true) <= tolerance * F.abs(true))


def relative_gap(a: Column, b: Column) -> Column:
    return F.try_divide(F.abs(a - b), F.abs(b))


def assess(pending: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """One row: staged values against known ones by key. A known value is found if a reading is within its tolerance; of those
    meant to be flagged, recall counts the flagged. Nothing to find counts as 1."""
    both = known.join(pending, keys, "left")
    hit = F.coalesce(within(F.col("value"), F.col("true_value"), F.col("tolerance")), F.lit(False))
    read = F.col("value").isNotNull()
    wanted = F.col("should_flag")
    return both.agg(
        F.count("*").alias("known"),
        F.coalesce(F.try_divide(F.count_if(hit), F.count_if(read)), F.lit(1.0)).alias("precision"),
        F.coalesce(F.try_divide(F.count_if(wanted & F.coalesce(F.col("flagged"), F.lit(False))), F.count_if(wanted)), F.lit(1.0)).alias("flag_recall"),
    )


def replay(readings: DataFrame, doc: str, floor: float = 0.5) -> DataFrame:
    """By document: readings, keys whose readings disagree, quotes that support, miss or contradict, and low confidence
    before and after disagreeing readings are capped at `floor`."""
    keys = readings.groupBy(doc, "key").agg(F.count("*").alias("n"), (F.count_distinct("value") > 1).alias("odd"), F.max("confidence").alias("best"))
    after = F.when(F.col("odd"), F.least("best", F.lit(floor))).otherwise(F.col("best"))
    keys = keys.groupBy(doc).agg(F.sum("n").alias("readings"), F.count_if("odd").alias("conflicts"), F.count_if(after <= floor).alias("low_after"))
    quotes = readings.groupBy(doc).agg(F.count_if(F.col("confidence") <= floor).alias("low_before"), *[F.count_if(F.col("support") == s).alias(s) for s in ("supported", "mismatch", "missing")])
    return keys.join(quotes, doc)
