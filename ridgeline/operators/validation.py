"""Validation of staged rows against a catalog of metrics, the tier gate, statements in full, roll-ups that never overwrite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.functions.periods import close

_MONEY, _DERIVED_MONEY = ("CAD", "currency", False), ("CAD", "currency", True)
#: Unit, kind of unit and whether a metric is derived. Money is in the agency's currency in place of CAD.
METRICS = {
    "ridership": ("count", "count", False),
    "revenue_service_hours": ("hours", "time", False),
    "vehicle_revenue_km": ("km", "distance", False),
    "average_fare": _DERIVED_MONEY,
    "trips_per_revenue_hour": ("trips/hr", "ratio", True),
    "on_time_performance": ("%", "ratio", False),
    "total_revenue_excluding_subsidy": _MONEY,
    "operating_expenses": _MONEY,
    "subsidy": _MONEY,
    "labour_cost": _MONEY,
    "energy_fuel_cost": _MONEY,
    "materials_services_cost": _MONEY,
    "farebox_recovery_ratio": ("%", "ratio", True),
    "cost_per_rider": _DERIVED_MONEY,
    "cost_per_hour": ("CAD/hr", "currency", True),
    "subsidy_per_rider": _DERIVED_MONEY,
    "fleet_size": ("count", "count", False),
    "fleet_average_age": ("years", "time", False),
    "accessible_fleet_pct": ("%", "ratio", False),
    "capital_expenditure": _MONEY,
    "total_financial_assets": _MONEY,
    "total_liabilities": _MONEY,
    "total_non_financial_assets": _MONEY,
    "total_assets": _MONEY,
    "tangible_capital_assets": _MONEY,
    "accumulated_surplus": _MONEY,
    "long_term_debt": _MONEY,
    "cash_and_investments": _MONEY,
    "net_debt": _DERIVED_MONEY,
    "debt_to_assets": ("%", "ratio", True),
    "net_debt_per_capita": _DERIVED_MONEY,
    "amortization": _MONEY,
    "other_operating_expenses": _MONEY,
    "total_revenue": _MONEY,
    "farebox_revenue": _MONEY,
    "total_expenses": _MONEY,
    "other_revenue": _DERIVED_MONEY,
    "annual_surplus_deficit": _DERIVED_MONEY,
    "other_financial_assets": _DERIVED_MONEY,
    "other_liabilities": _DERIVED_MONEY,
    "other_non_financial_assets": _DERIVED_MONEY,
}
#: Shares above which a jump or a second source's gap is flagged, the largest percentage, the least money.
YOY_SHARE, SOURCE_SHARE, MOST_PERCENT, LEAST_MONEY = "0.50", "0.02", 1000, 10000
#: The rows of an agency's statement of operations and statement of position, in order.
OPERATIONS = (
    "farebox_revenue", "other_revenue", "subsidy", "total_revenue", "labour_cost", "energy_fuel_cost", "materials_services_cost",
    "other_operating_expenses", "operating_expenses", "amortization", "total_expenses", "annual_surplus_deficit", "capital_expenditure",
)
POSITION = (
    "cash_and_investments", "total_financial_assets", "long_term_debt", "total_liabilities", "net_debt", "tangible_capital_assets",
    "total_non_financial_assets", "total_assets", "accumulated_surplus", "debt_to_assets", "net_debt_per_capita",
)


def metric_catalog(rows: DataFrame) -> DataFrame:
    """(metric, _unit, _kind, _derived) of METRICS, in the session of rows."""
    return rows.sparkSession.createDataFrame([(m, *x) for m, x in METRICS.items()], "metric string, _unit string, _kind string, _derived boolean")


def beyond(value: str, base: str, share: str) -> Column:
    """Whether a value is off its base by strictly more than a share of it; null or zero bases compare with nothing.

    With decimal columns the comparison is exact: a gap of just that share is within it."""
    return F.expr(f"coalesce({base} <> 0 AND abs({value} - {base}) > abs({base}) * {share}BD, false)")


def validate_rows(rows: DataFrame) -> DataFrame:
    """rows (metric, value, unit, currency, prior, crosscheck, tier) with flags and status.

    yoy_spike: over half off the same period a year before; cross_source_disagreement: over 2 per cent off the second
    source; unit_mismatch: another unit than the metric's in that currency, a percentage beyond 1000, a negative count, or
    sourced money other than 0 below 10,000. Metrics that the catalog lacks have no unit to check. A row is approved if it
    is of tier 0 and has no flag, else it is pending.
    """
    out = rows.join(F.broadcast(metric_catalog(rows)), "metric", "left")  # 41 metrics
    expected = F.when(F.col("_kind") == "currency", F.replace("_unit", F.lit("CAD"), F.coalesce("currency", F.lit("CAD")))).otherwise(F.col("_unit"))
    amount = F.abs("value")
    wrong = (
        ~F.col("unit").eqNullSafe(expected)
        | ((F.col("_unit") == "%") & (F.col("_kind") == "ratio") & (F.col("value") > MOST_PERCENT))
        | ((F.col("_kind") == "count") & (F.col("value") < 0))
        | ((F.col("_kind") == "currency") & ~F.col("_derived") & (F.col("value") != 0) & (amount < LEAST_MONEY))
    )
    flags = F.array_compact(F.array(
        F.when(beyond("value", "prior", YOY_SHARE), "yoy_spike"),
        F.when(beyond("value", "crosscheck", SOURCE_SHARE), "cross_source_disagreement"),
        F.when(F.col("_unit").isNotNull() & wrong, "unit_mismatch"),
    ))
    out = out.withColumn("flags", flags)
    return out.withColumn("status", tier_gate(F.col("tier"), F.col("flags"))).drop("_unit", "_kind", "_derived")


def tier_gate(tier: Column, flags: Column) -> Column:
    return F.when((tier == 0) & (F.size(flags) == 0), "approved").otherwise("pending")


def statements(annual: DataFrame, keys: list[str], year: str) -> DataFrame:
    """(keys, statement, line, metric, cells): the 13 rows of operations and the 11 of position of each key, each with a map
    from every year of the key (in which any of these metrics has a value) to its value or null. A row without any value
    is there too, as it is on the printed statement."""
    rows = annual.filter(F.col("metric").isin(*OPERATIONS, *POSITION))
    years = rows.groupBy(*keys).agg(F.array_sort(F.collect_set(year)).alias("_years"))  # a key's years
    lines = [(s, k, m) for s, metrics in (("operations", OPERATIONS), ("position", POSITION)) for k, m in enumerate(metrics, 1)]
    frame = years.select(*keys, "_years", F.inline(F.array(*[F.struct(F.lit(s).alias("statement"), F.lit(k).alias("line"), F.lit(m).alias("metric")) for s, k, m in lines])))
    have = rows.groupBy(*keys, "metric").agg(F.map_from_entries(F.collect_list(F.struct(F.col(year), F.col("value")))).alias("_have"))
    cells = F.map_from_arrays("_years", F.transform("_years", lambda y: F.try_element_at("_have", y)))
    return frame.join(have, [*keys, "metric"], "left").select(*keys, "statement", "line", "metric", cells.alias("cells"))


def promote_rollups(rolled: DataFrame, current: DataFrame, keys: list[str], share: float = 0.02) -> DataFrame:
    """(keys, value, action): what roll-ups do to the current values (keys, value, derived).

    An empty slot takes the roll-up (`filled`); a slot that holds a derived value is left (`kept`); one that holds a sourced
    value is never overwritten, and where the roll-up is off by more than the share it is reported (`sum_mismatch`).
    """
    both = rolled.select(*keys, F.col("value").alias("_sum")).join(current, keys, "left")
    action = F.when(F.col("value").isNull(), "filled").when(F.col("derived") | close(F.col("value"), F.col("_sum"), share), "kept").otherwise("sum_mismatch")
    return both.select(*keys, F.coalesce("value", "_sum").alias("value"), action.alias("action"))


def one_scope(rows: DataFrame, keys: list[str], scope: str = "scope") -> DataFrame:
    """Rows of one scope a key: `total` where it has any, else the first by name. Counts of scopes, not rows, are compared."""
    pick = F.coalesce(F.max(F.when(F.col(scope) == "total", F.col(scope))), F.min(scope))
    picked = rows.groupBy(*keys).agg(pick.alias("_scope"))
    return rows.join(picked, keys).filter(F.col(scope) == F.col("_scope")).drop("_scope")


def component_sums(readings: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """(keys, value, confidence, quotes, n): the parts of a figure added up, each label once, by its surest reading (ties: the
    first quote). A sum is as sure as its least sure part; the quotes of the parts are kept, by label."""
    once = readings.groupBy(*keys, label).agg(F.max("confidence").alias("_top"))
    best = readings.join(once, [*keys, label]).filter(F.col("confidence") == F.col("_top"))
    best = best.groupBy(*keys, label).agg(F.min(F.struct("quote", "value")).alias("r"), F.first("_top").alias("confidence"))
    quotes = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(label).alias("l"), F.col("r.quote").alias("q")))), lambda x: x["q"]), " | ")
    return best.groupBy(*keys).agg(F.sum("r.value").alias("value"), F.min("confidence").alias("confidence"), quotes.alias("quotes"), F.count("*").alias("n"))


def run_report(values: DataFrame, doc: str = "doc", floor: float = 0.5) -> DataFrame:
    """(doc, values, flagged, low_confidence, review_rate, flags): by document, and over all in the row of null.

    values: doc, confidence, flags (a list). flags of the report is a map from each flag to its count."""
    rows = values.select(F.col(doc), F.col("confidence"), F.coalesce("flags", F.array().cast("array<string>")).alias("_f"))
    n = lambda c: F.count_if(c)
    base = rows.groupingSets([[F.col(doc)], []], F.col(doc)).agg(
        F.grouping(doc).cast("int").alias("total_row"), F.count("*").alias("values"), n(F.size("_f") > 0).alias("flagged"), n(F.col("confidence") <= floor).alias("low_confidence"),
    )
    each = rows.select(doc, F.explode("_f").alias("flag")).groupBy(doc, "flag").agg(F.count("*").alias("n"))
    each = each.groupingSets([[F.col(doc), F.col("flag")], [F.col("flag")]], F.col(doc), F.col("flag")).agg(F.grouping(doc).cast("int").alias("_total"), F.sum("n").alias("n"))
    maps = each.groupBy(F.col(doc).alias("_of"), "_total").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("flag", "n")))).alias("flags"))
    out = base.join(maps, F.col(doc).eqNullSafe(F.col("_of")) & (F.col("total_row") == F.col("_total")), "left").drop("_of", "_total")
    return out.withColumn("review_rate", F.coalesce(F.try_divide("flagged", "values"), F.lit(0.0)))

