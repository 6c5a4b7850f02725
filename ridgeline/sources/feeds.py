"""Published feeds as DataFrame transformations: (facts, rejects) of each. Files are read by spark.read with a schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MILES_TO_KM = 1.609344
#: Fixed values of the statistical feed's scale and status columns.
SCALES = {"units": 1, "thousands": 1000, "millions": 1000000}
PRELIMINARY = ("p", "E")


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All columns as strings; a byte order mark in front of the header does no harm, as the schema names the columns; doubled quotes are one."""
    return spark.read.csv(path, header=True, enforceSchema=True, escape='"', schema=", ".join(f"`{c}` string" for c in columns))


def statistical_feed(rows: DataFrame, agencies: DataFrame, metrics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """ref_date (YYYY-MM), label, measure, scale, value, status; agencies: label, agency_id; metrics: measure, metric.

    Unknown labels and measures, missing values and bad months are rejects with a reason; a scale that is neither blank nor
    known stops the load, as any guess would be off by a thousand. The two maps are small by nature,
    and Spark decides on broadcasting them by their size.
    """
    known = F.element_at(F.create_map(*[F.lit(x) for kv in SCALES.items() for x in kv]), F.trim("scale"))
    unknown = F.raise_error(F.concat(F.lit("unknown scale: "), F.col("scale"))).cast("int")
    scale = F.when(F.coalesce(F.trim("scale"), F.lit("")) == "", 1).when(known.isNotNull(), known).otherwise(unknown)
    out = rows.join(agencies, "label", "left").join(metrics, "measure", "left")
    out = out.withColumn("month", F.expr("try_to_date(concat(ref_date, '-01'), 'yyyy-MM-dd')"))
    out = out.withColumn("number", F.expr("try_cast(value AS decimal(28,6))"))
    reason = F.when(F.col("agency_id").isNull(), "unmapped agency").when(F.col("metric").isNull(), "unmapped measure")
    reason = reason.when(F.col("month").isNull(), "bad month").when(F.col("number").isNull(), "no value")
    out = out.withColumn("reason", reason)
    quality = F.when(F.col("status").isin(*PRELIMINARY), "preliminary").otherwise("verified")
    good = out.filter("reason IS NULL").select("agency_id", "month", "metric", (F.col("number") * scale).cast("double").alias("value"), quality.alias("quality"))
    return good, out.filter("reason IS NOT NULL").select(*rows.columns, "reason")


def epoch_feed(rows: DataFrame, agency_id: int, metric: str = "ridership") -> tuple[DataFrame, DataFrame]:
    """stamp (milliseconds since 1970), value, both strings; rejects: empty field, bad timestamp, bad value."""
    stamp, number = F.expr("try_cast(trim(stamp) AS bigint)"), F.expr("try_cast(trim(value) AS decimal(28,6))")
    empty = (F.coalesce(F.trim("stamp"), F.lit("")) == "") | (F.coalesce(F.trim("value"), F.lit("")) == "")
    out = rows.withColumn("reason", F.when(empty, "empty field").when(stamp.isNull(), "bad timestamp").when(number.isNull(), "bad value"))
    month = F.to_date(F.date_trunc("month", F.timestamp_millis(stamp)))
    good = out.filter("reason IS NULL").select(F.lit(agency_id).alias("agency_id"), month.alias("month"), F.lit(metric).alias("metric"), number.cast("double").alias("value"))
    return good, out.filter("reason IS NOT NULL")


def mode_feed(rows: DataFrame, agencies: DataFrame, since: str = "0000-00") -> DataFrame:
    """source_id, month (ISO), reporter_type, trips, miles, hours by mode and type of service: full reporters' sums a month.

    Empty cells are not reported, so no sum of only empty cells is made; miles become kilometres.
    """
    rows = rows.filter((F.col("reporter_type") == "Full Reporter") & (F.substring("month", 1, 7) >= since)).join(agencies, "source_id")
    cells = [("ridership", "trips", 1.0), ("vehicle_km", "miles", MILES_TO_KM), ("revenue_service_hours", "hours", 1.0)]
    found = F.array(*[F.struct(F.lit(m).alias("metric"), F.expr(f"try_cast({c} AS decimal(28,6))").alias("v"), F.lit(k).alias("k")) for m, c, k in cells])
    out = rows.select("agency_id", F.to_date(F.concat(F.substring("month", 1, 7), F.lit("-01"))).alias("month"), F.inline(found)).filter("v IS NOT NULL")
    return out.groupBy("agency_id", "month", "metric", "k").agg(F.sum("v").alias("v")).select("agency_id", "month", "metric", (F.col("v").cast("double") * F.col("k")).alias("value"))


def fiscal_year_of_end(end_year, fye):
    """The start year of the fiscal year that ends in `end_year`."""
    return end_year - (fye != 12).cast("int")


#: The annual feed's measures: metric, column, factor.
ANNUAL_CELLS = (("farebox_revenue", "fares", 1.0), ("operating_expenses", "expenses", 1.0), ("ridership", "trips", 1.0), ("vehicle_km", "miles", MILES_TO_KM), ("revenue_service_hours", "hours", 1.0))


def annual_feed(rows: DataFrame, agencies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """source_id, report_year and the measures as text, by mode and type of service: sums a report year, which names the year
    that a fiscal year ends in. agencies: source_id, agency_id, fye. Empty cells are not reported; the rejects are the ids
    that no agency has, once each."""
    known = rows.join(agencies, "source_id")
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.expr(f"try_cast({c} AS decimal(28,6))").alias("v"), F.lit(k).alias("k")) for m, c, k in ANNUAL_CELLS])
    out = known.select("agency_id", "fye", F.col("report_year").cast("int").alias("report_year"), F.inline(cells)).filter("v IS NOT NULL")
    out = out.groupBy("agency_id", "fye", "report_year", "metric", "k").agg(F.sum("v").alias("v"))
    good = out.select("agency_id", "metric", fiscal_year_of_end(F.col("report_year"), F.col("fye")).alias("start_year"), (F.col("v").cast("double") * F.col("k")).alias("value"))
    return good, rows.join(agencies, "source_id", "left_anti").select("source_id").distinct()


#: Feeds by name: what turns a feed's rows into facts (and, where it has any, rejects).
ADAPTERS = {"statistical": statistical_feed, "epoch": epoch_feed, "mode": mode_feed, "annual": annual_feed}
