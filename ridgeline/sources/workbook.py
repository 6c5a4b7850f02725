"""Sparse sheets: a year is a block of 18 columns under one header cell, of which only some cells are typed in."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.sources.sinks import sum_formula

#: Columns of a year's block: twelve months, four quarters, the year so far, the year; labels stand before it.
BLOCK, MONTHS, YEAR_AT = 18, 12, 17
LABEL_COLUMN, FIRST_COLUMN, HEADER_ROW, FIRST_ROW = 1, 2, 1, 3


def year_header(cell: Column) -> Column:
    """The starting year of a block's header: 2024, or 2024 of FY2024-25; anything else is null."""
    text = F.trim(cell)
    return F.coalesce(F.nullif(F.regexp_extract(text, r"^FY([0-9]{4})-[0-9]{2}$", 1), F.lit("")), F.when(text.rlike(r"^-?[0-9]+([.]0+)?$"), text)).try_cast("double").cast("int")


def sheet_cells(wide: DataFrame, sheet: str = "sheet", row: str = "row") -> DataFrame:
    """(sheet, row, col, cell) of a grid with columns c1, c2, ...; empty cells are no rows."""
    names = [c for c in wide.columns if c not in (sheet, row)]
    out = wide.unpivot([sheet, row], names, "_name", "cell").withColumn("col", F.substring("_name", 2, 9).cast("int"))
    return out.filter(F.trim("cell") != "").select(F.col(sheet).alias("sheet"), F.col(row).alias("row"), "col", "cell")


def read_grid(cells: DataFrame, monthly: list[str], annual: list[str]) -> DataFrame:
    """(sheet, metric, year, month, value, problem) of the cells that are typed in: the months of the monthly metrics and the
    year's cell of the annual ones (month null).

    A block's header stands over its first column and holds for all of them: it is filled forwards along the header row, and
    the blocks of a sheet end at the first that has none. Quarters, the year so far, formulas and labels that are no metric
    are never read. Headers without a year and cells without a number are rows with a problem and no value.
    """
    at = F.col("col") - FIRST_COLUMN
    block, place = F.floor(at / BLOCK), F.pmod(at, F.lit(BLOCK))
    heads = cells.filter((F.col("row") == HEADER_ROW) & (at >= 0) & (place == 0)).select(F.col("sheet").alias("_sheet"), block.alias("_block"), F.col("cell").alias("header"))
    unbroken = F.row_number().over(Window.partitionBy("_sheet").orderBy("_block")) - 1 == F.col("_block")  # a sheet's years
    heads = heads.withColumn("_on", unbroken).filter("_on").select("_sheet", "_block", "header", year_header(F.col("header")).alias("year"))
    labels = cells.filter((F.col("row") >= FIRST_ROW) & (F.col("col") == LABEL_COLUMN)).select(F.col("sheet").alias("_of"), F.col("row").alias("_row"), F.trim("cell").alias("metric"))
    labels = labels.filter(F.col("metric").isin(*monthly, *annual))
    typed = cells.filter((F.col("row") >= FIRST_ROW) & (at >= 0)).select("*", block.alias("_block"), place.alias("_place"))
    rows = typed.join(labels, (F.col("sheet") == F.col("_of")) & (F.col("row") == F.col("_row"))).drop("_of", "_row")
    rows = rows.join(heads.withColumnRenamed("_block", "_b"), (F.col("sheet") == F.col("_sheet")) & (F.col("_block") == F.col("_b")))
    month = F.when(F.col("metric").isin(*monthly), F.col("_place") + 1)
    rows = rows.filter(F.when(F.col("metric").isin(*monthly), F.col("_place") < MONTHS).otherwise(F.col("_place") == YEAR_AT))
    value = F.trim("cell").try_cast("double")
    read = rows.filter("year IS NOT NULL").select("sheet", "metric", "year", month.cast("int").alias("month"), value.alias("value"), F.when(value.isNull(), F.concat(F.lit("non-numeric cell: "), "cell")).alias("problem"))
    none = heads.filter("year IS NULL").select(F.col("_sheet").alias("sheet"), F.lit(None).cast("string").alias("metric"), "year", F.lit(None).cast("int").alias("month"), F.lit(None).cast("double").alias("value"), F.concat(F.lit("unreadable year header: "), "header").alias("problem"))
    return read.unionByName(none)


def grid(cells: DataFrame, columns: int) -> DataFrame:
    """(sheet, row, c1, c2, ...): a sheet's rows from its cells (sheet, row, col, cell)."""
    wide = cells.groupBy("sheet", "row").pivot("col", list(range(1, columns + 1))).agg(F.max("cell"))
    return wide.toDF("sheet", "row", *[f"c{k}" for k in range(1, columns + 1)])


def sheet_of(values: DataFrame, header: Column, order: list[str], years: list[int]) -> DataFrame:
    """(sheet, row, col, cell) of monthly values (sheet, metric, year, month, value): headers, labels in the given order, and
    the months' cells; quarters and the year hold a formula, as they are live on the sheet."""
    first = F.col("_y") * BLOCK + FIRST_COLUMN
    place = F.create_map(*[x for k, y in enumerate(years) for x in (F.lit(y), F.lit(k))])
    line = F.create_map(*[x for k, m in enumerate(order) for x in (F.lit(m), F.lit(FIRST_ROW + k))])
    sheets = values.select("sheet", header.alias("_head"), F.element_at(place, F.col("year")).alias("_y")).distinct()
    heads = sheets.select("sheet", F.lit(HEADER_ROW).alias("row"), first.alias("col"), F.col("_head").alias("cell"))
    rows = values.withColumns({"_y": F.element_at(place, F.col("year")), "row": F.element_at(line, F.col("metric"))})
    labels = rows.select("sheet", "row", F.lit(LABEL_COLUMN).alias("col"), F.col("metric").alias("cell")).distinct()
    months = rows.select("sheet", "row", (first + F.col("month") - 1).alias("col"), F.col("value").cast("string").alias("cell"))
    years_ = [(k * BLOCK + FIRST_COLUMN) for k in range(len(years))]
    total = lambda own: reduce(lambda a, k: F.when(F.col("_y") == k, own(F.col("row"), years_[k])).otherwise(a), range(len(years)), F.lit(None).cast("string"))
    live = rows.select("sheet", "row", "_y").distinct()
    roll = [(MONTHS + q, total(lambda r, c, q=q: sum_formula(r, list(range(c + 3 * q, c + 3 * q + 3))))) for q in range(4)] + [(YEAR_AT, total(lambda r, c: sum_formula(r, list(range(c, c + MONTHS)))))]
    live = live.select("sheet", "row", F.explode(F.array(*[F.struct((first + at).alias("col"), f.alias("cell")) for at, f in roll])).alias("x")).select("sheet", "row", "x.*")
    return heads.unionByName(labels).unionByName(months).unionByName(live)
