"""Roll-ups, rankings, statements, versions and reading reconciliation as DataFrame transformations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions.periods import close, fiscal_index, fiscal_label, fiscal_start_year, percent_change

#: Fixed rate that puts Canadian amounts beside American ones for ranking.
CAD_TO_USD = 0.7
CURRENCY_METRICS = ("farebox_revenue", "operating_expenses")
LEAST_COHORT = 5


def fiscal_rollup(facts: DataFrame, agencies: DataFrame) -> DataFrame:
    """Months to fiscal years: 12 months give 'annual', an unbroken run from the first month 'ytd'; gaps are never filled.

    facts: agency_id, month, metric, value.
    """
    rows = facts.join(agencies.select("agency_id", "fye"), "agency_id")
    rows = rows.withColumn("start_year", fiscal_start_year(F.col("month"), F.col("fye"))).withColumn("idx", fiscal_index(F.col("month"), F.col("fye")))
    run = Window.partitionBy("agency_id", "metric", "start_year").orderBy("idx")
    rows = rows.withColumn("pos", F.row_number().over(run)).filter("pos = idx")
    out = rows.groupBy("agency_id", "metric", "start_year", "fye").agg(F.sum(F.col("value").cast("decimal(28,4)")).cast("double").alias("value"), F.count("*").alias("months"))
    kind = F.when(F.col("months") == 12, "annual").otherwise("ytd")
    return out.select("agency_id", "metric", fiscal_label(F.col("start_year"), F.col("fye")).alias("label"), "start_year", kind.alias("period_type"), "months", "value")


def fiscal_rollup_wide(wide: DataFrame, agencies: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """`fiscal_rollup` of months with a column for each metric (null: not published): windows and sums run over a row a month,
    and the years' rows are unpivoted."""
    rows = wide.join(agencies.select("agency_id", "fye"), "agency_id")
    rows = rows.withColumn("start_year", fiscal_start_year(F.col("month"), F.col("fye"))).withColumn("idx", fiscal_index(F.col("month"), F.col("fye")))
    run = Window.partitionBy("agency_id", "start_year").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    in_run = {m: F.when(F.count(m).over(run) == F.col("idx"), F.col(m).cast("decimal(28,4)")).alias(m) for m in metrics}
    rows = rows.select("agency_id", "start_year", "fye", *in_run.values())
    out = rows.groupBy("agency_id", "start_year", "fye").agg(*[f for m in metrics for f in (F.sum(m).cast("double").alias(m), F.count(m).alias(f"n_{m}"))])
    cells = F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.col(f"n_{m}").alias("months")) for m in metrics]))
    kind = F.when(F.col("months") == 12, "annual").otherwise("ytd")
    out = out.select("agency_id", "start_year", "fye", cells).filter("months > 0")
    return out.select("agency_id", "metric", fiscal_label(F.col("start_year"), F.col("fye")).alias("label"), "start_year", kind.alias("period_type"), "months", "value")


def calendar_quarters(facts: DataFrame) -> DataFrame:
    """Quarters of which all three months are there."""
    out = facts.groupBy("agency_id", "metric", F.year("month").alias("year"), F.quarter("month").alias("quarter"))
    out = out.agg(F.sum(F.col("value").cast("decimal(28,4)")).cast("double").alias("value"), F.count("*").alias("months")).filter("months = 3")
    return out.select("agency_id", "metric", F.concat_ws("-Q", "year", "quarter").alias("label"), "value")


def direction(metric: Column, lower: tuple[str, ...] = (), neutral: tuple[str, ...] = ()) -> Column:
    """higher, lower or neutral: which end of a metric's ranking is the better one."""
    return F.when(metric.isin(*neutral), "neutral").when(metric.isin(*lower), "lower").otherwise("higher")


def competition_ranks(annual: DataFrame, agencies: DataFrame, lower: tuple[str, ...] = (), rated: tuple[str, ...] | None = None) -> DataFrame:
    """Ranks (1, 2, 2, 4) within metric and period, among all agencies and within the subdivision, on a USD basis.

    Metrics in `lower` rank upwards from the least value; with `rated`, only these metrics are ranked. Agencies without a
    subdivision are ranked among all only. Cohorts of fewer than LEAST_COHORT are not ranked. Both windows run on one
    partitioning, by metric and period.
    """
    rows = annual if rated is None else annual.filter(F.col("metric").isin(*rated))
    rows = rows.join(agencies.select("agency_id", "subdivision", "currency"), "agency_id")
    convert = F.col("metric").isin(*CURRENCY_METRICS) & (F.coalesce("currency", F.lit("CAD")) == "CAD")
    rows = rows.withColumn("basis", F.when(convert, F.col("value") * CAD_TO_USD).otherwise(F.col("value")))
    rows = rows.withColumn("_order", F.when(F.col("metric").isin(*lower), F.col("basis")).otherwise(-F.col("basis")))
    every, near = Window.partitionBy("metric", "start_year"), Window.partitionBy("metric", "start_year", "subdivision")
    rows = rows.withColumns({"_rank": F.rank().over(every.orderBy("_order")), "_of": F.count("*").over(every)})
    rows = rows.withColumns({"_near": F.rank().over(near.orderBy("_order")), "_near_of": F.count("*").over(near)})
    one = lambda kind, rank, of: F.struct(F.lit(kind).alias("comparison"), F.col(rank).alias("rank"), F.col(of).alias("of"))
    both = F.inline(F.array_compact(F.array(one("all", "_rank", "_of"), F.when(F.col("subdivision").isNotNull(), one("subdivision", "_near", "_near_of")))))
    return rows.select("agency_id", "metric", "start_year", "basis", both).filter(F.col("of") >= LEAST_COHORT)


def year_over_year(annual: DataFrame) -> DataFrame:
    """Each annual value (one a year) against that of the year before; gaps do not match."""
    by = Window.partitionBy("agency_id", "metric").orderBy("start_year")
    prior = F.when(F.lag("start_year").over(by) == F.col("start_year") - 1, F.lag("value").over(by))
    out = annual.withColumn("prior", prior).withColumn("change_pct", percent_change(F.col("value"), F.col("prior")))
    sign = F.when(F.col("change_pct") > 0, "up").when(F.col("change_pct") < 0, "down").when(F.col("change_pct") == 0, "flat")
    return out.select("agency_id", "metric", "start_year", "value", "prior", "change_pct", sign.alias("direction"))


def axis_years(annual: DataFrame) -> DataFrame:
    """The years that a statement shows, with the first label seen of each."""
    return annual.groupBy("start_year").agg(F.min("label").alias("label"))


def statement_grid(annual: DataFrame, years: DataFrame) -> DataFrame:
    """A row for each agency, metric and year of the axis, null where there is no value."""
    slots = annual.select("agency_id", "metric").distinct().crossJoin(F.broadcast(years.select("start_year")))  # some tens of years
    return slots.join(annual.select("agency_id", "metric", "start_year", "value"), ["agency_id", "metric", "start_year"], "left")


def statement(annual: DataFrame, years: list[int] | None = None) -> DataFrame:
    """Long to wide: one row for each agency and metric, one column a year, null where there is no value. Without `years` the
    columns are those of `axis_years`."""
    return annual.groupBy("agency_id", "metric").pivot("start_year", years).agg(F.first("value"))


def solve(wide: DataFrame) -> DataFrame:
    """Derive ratios from base metrics, with the equation each came from; a null operand gives none."""
    ratio = lambda a, b: F.try_divide(F.col(a), F.col(b))
    derived = {
        "recovery_ratio": (ratio("farebox_revenue", "operating_expenses"), "farebox_revenue / operating_expenses"),
        "cost_per_trip": (ratio("operating_expenses", "ridership"), "operating_expenses / ridership"),
        "trips_per_hour": (ratio("ridership", "revenue_service_hours"), "ridership / revenue_service_hours"),
        "operating_deficit": (F.col("operating_expenses").cast("decimal(28,4)") - F.col("farebox_revenue").cast("decimal(28,4)"), "operating_expenses - farebox_revenue"),
    }
    found = F.array(*[F.struct(F.lit(m).alias("metric"), v.cast("double").alias("value"), F.lit(e).alias("equation")) for m, (v, e) in derived.items()])
    return wide.select("agency_id", "month", F.explode(found).alias("d")).select("agency_id", "month", "d.*").filter("value IS NOT NULL")


def version_chain(readings: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """Restatements: only readings that change the value open a version; each ends where the next begins."""
    by = Window.partitionBy(*key).orderBy(*order)
    last = F.lag(value).over(by)
    changed = readings.filter(F.col(value).isNotNull()).withColumn("_new", F.row_number().over(by) == 1).withColumn("_new", F.col("_new") | ~last.eqNullSafe(F.col(value)))
    out = changed.filter("_new").withColumn("version", F.row_number().over(by)).withColumn("valid_to", F.lead(order[0]).over(by))
    return out.select(*key, "version", F.col(order[0]).alias("valid_from"), "valid_to", value, F.col("valid_to").isNull().alias("is_current"))


def classify_changes(incoming: DataFrame, current: DataFrame, key: list[str], value: str) -> DataFrame:
    """insert, changed or identical, by null-safe keys."""
    now = current.select(*[F.col(k).alias(f"_{k}") for k in key], F.col(value).alias("old_value"), F.lit(True).alias("_there"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]
    out = incoming.join(now, same[0] if len(same) == 1 else same[0] & same[1], "left")
    kind = F.when(F.col("_there").isNull(), "insert").when(F.col("old_value").eqNullSafe(F.col(value)), "identical").otherwise("changed")
    return out.select(*key, F.col(value).alias("new_value"), "old_value", kind.alias("change"))


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_nth = 1").drop("_nth")


def reconcile(readings: DataFrame) -> DataFrame:
    """Several readings of one cell: agreed if they lie within 0.5 per cent; the most precise, then surest one is taken."""
    digits = F.col("value").cast("decimal(18,0)").cast("string")
    zeros = F.length(digits) - F.length(F.rtrim(digits, F.lit("0")))
    best = F.max_by("value", F.struct(-zeros, "confidence", "value"))
    out = readings.filter(F.col("confidence") >= 0.3).groupBy("order_id", "line").agg(best.alias("value"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("readings"))
    return out.select("order_id", "line", "value", "readings", close(F.col("hi"), F.col("lo"), 0.005).alias("agreed"))


def densify(values: DataFrame) -> DataFrame:
    """Every month from the first to the last, with null where there is none."""
    span = values.groupBy("agency_id").agg(F.min("month").alias("a"), F.max("month").alias("b"))
    months = span.select("agency_id", F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month"))
    return months.join(values, ["agency_id", "month"], "left")
