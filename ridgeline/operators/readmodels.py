"""What a page shows of an agency: series of each metric with its rank, and the detail view's slots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.operators.facts import LEAST_COHORT
from ridgeline.operators.validation import one_scope

#: The metrics of the detail view by section, in order.
SLOTS = {
    "hero": ("ridership", "total_revenue_excluding_subsidy", "on_time_performance", "cost_per_rider", "subsidy_per_rider"),
    "ratio": ("farebox_recovery_ratio", "cost_per_hour", "trips_per_revenue_hour", "average_fare"),
    "service": ("revenue_service_hours", "vehicle_revenue_km", "fleet_size", "fleet_average_age", "accessible_fleet_pct"),
}
#: The kinds of period that are whole years.
ANNUAL = ("annual_calendar", "annual_fiscal")


def metric_series(values: DataFrame, ranks: DataFrame, least: int = LEAST_COHORT) -> DataFrame:
    """(agency_id, metric, scope, unit, value, as_of, rank, of, suppressed, points) of current values.

    values: agency_id, metric, scope, period_type, period, end_date, value, unit; ranks: agency_id, metric, period, end_date,
    rank, of. A metric has one scope, total or else the first by name; its points are in order of end_date (then type and
    period), and the last gives value, unit and as_of. The rank is that of the metric's latest ranked period (of equal end
    dates the greatest name); it is left out, with why, if the series has no such period, if there is none yet, or if fewer
    than `least` were ranked, in that order.
    """
    rows = one_scope(values, ["agency_id", "metric"])
    latest = ranks.groupBy("metric").agg(F.max_by("period", F.struct("end_date", "period")).alias("_period"))
    rows = rows.join(F.broadcast(latest), "metric", "left")  # one row a metric
    point = F.struct("end_date", "period_type", "period", "value", "unit")
    series = rows.groupBy("agency_id", "metric", "scope").agg(
        F.array_sort(F.collect_list(point)).alias("_points"),  # a series' periods
        F.first("_period").alias("_period"), F.coalesce(F.bool_or(F.col("period") == F.col("_period")), F.lit(False)).alias("_there"),
    )
    own = ranks.select("agency_id", "metric", F.col("period").alias("_period"), F.col("rank").alias("_rank"), F.col("of").alias("_of"))
    series = series.join(own, ["agency_id", "metric", "_period"], "left")
    why = F.when(~F.col("_there"), "no_comparable_period").when(F.col("_rank").isNull() | F.col("_of").isNull(), "pending").when(F.col("_of") < least, "below_min_denominator")
    last = F.element_at("_points", -1)
    return series.select(
        "agency_id", "metric", "scope", last["unit"].alias("unit"), last["value"].alias("value"), last["period"].alias("as_of"),
        F.when(why.isNull(), F.col("_rank")).alias("rank"), F.when(why.isNull(), F.col("_of")).alias("of"), why.alias("suppressed"),
        F.transform("_points", lambda p: F.struct(p["end_date"].alias("end_date"), p["period_type"].alias("period_type"), p["period"].alias("period"), p["value"].alias("value"))).alias("points"),
    )


def detail_model(series: DataFrame) -> DataFrame:
    """(agency_id, section, slot, metric, value, as_of, unit, rank, of, pct, vs): the slots of every agency, filled or not.

    A slot shows the last annual point, or else the last of any kind. A hero has its rank, and its change in per cent (one
    decimal, halves up) against the annual point of the same kind one year before, unless that is absent or zero.
    """
    slots = [(s, k, m) for s, metrics in SLOTS.items() for k, m in enumerate(metrics, 1)]
    slot = F.inline(F.array(*[F.struct(F.lit(s).alias("section"), F.lit(k).alias("slot"), F.lit(m).alias("metric")) for s, k, m in slots]))
    frame = series.select("agency_id").distinct().select("agency_id", slot)
    rows = frame.join(series, ["agency_id", "metric"], "left").withColumn("_annual", F.filter("points", lambda p: p["period_type"].isin(*ANNUAL)))
    rows = rows.withColumn("_now", F.try_element_at("_annual", F.lit(-1))).withColumn("_shown", F.coalesce("_now", F.try_element_at("points", F.lit(-1))))
    before = F.filter("_annual", lambda p: (p["period_type"] == F.col("_now.period_type")) & (F.year(p["end_date"]) == F.year(F.col("_now.end_date")) - 1))
    rows = rows.withColumn("_then", F.when(F.col("section") == "hero", F.get(before, F.lit(0)))).withColumn("_then", F.when(F.col("_then.value") != 0, F.col("_then")))
    change = (F.col("_now.value") - F.col("_then.value")) / F.abs("_then.value")
    hero = F.col("section") == "hero"
    return rows.select(
        "agency_id", "section", "slot", "metric", F.col("_shown.value").alias("value"), F.col("_shown.period").alias("as_of"), "unit",
        F.when(hero, F.col("rank")).alias("rank"), F.when(hero, F.col("of")).alias("of"), (F.floor(change * 1000 + 0.5) / 10).alias("pct"), F.col("_then.period").alias("vs"),
    )
