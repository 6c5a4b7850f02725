"""Review queues, readings out of scope, known values' candidates, the dictionary's parity, statements as text lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.functions.text import csv_cell
from ridgeline.operators.lifecycle import number_in_order

#: Scopes and bases of which no reading is kept, and those that known values are compared with.
DROPPED_SCOPES, DROPPED_BASES = ("mode_subset", "city_wide"), ("budget", "forecast")
TOTAL_SCOPES, ACTUAL_BASES = ("total",), ("actual",)


def out_of_scope(readings: DataFrame) -> DataFrame:
    """Adds `drop`: scope for a single mode or a whole city, basis for planned figures (a restated one stays), or null."""
    return readings.withColumn("drop", F.when(F.col("scope").isin(*DROPPED_SCOPES), "scope").when(F.col("basis").isin(*DROPPED_BASES), "basis"))


def known_candidates(readings: DataFrame, year: Column, kind: Column) -> DataFrame:
    """Readings that a known value of that year and kind of period can be matched with: of the total scope (or none said) and
    reported as actual (or nothing said), with a value."""
    total = F.coalesce("scope", F.lit(TOTAL_SCOPES[0])).isin(*TOTAL_SCOPES)
    actual = F.coalesce("basis", F.lit(ACTUAL_BASES[0])).isin(*ACTUAL_BASES)
    return readings.filter((F.col("year") == year) & (F.col("period_kind") == kind) & total & actual & F.col("value").isNotNull())


def review_queue(pending: DataFrame, show: str = "all", agency: str | None = None) -> DataFrame:
    """pending (agency, metric, id, flags) of all, flagged or clean rows, of one agency or all, with the place of each in the
    order of agency, metric and id. An agency's rows are numbered together, agencies by their sizes."""
    if show not in ("all", "flagged", "clean"):
        raise ValueError("show all, flagged or clean")
    rows = pending.withColumn("_flagged", F.size(F.coalesce("flags", F.array().cast("array<string>"))) > 0)
    rows = rows if show == "all" else rows.filter(F.col("_flagged") == (show == "flagged"))
    rows = rows if agency is None else rows.filter(F.col("agency") == agency)
    return number_in_order(rows.drop("_flagged"), [], F.col("agency"), ["agency", "metric", "id"])


def dictionary_problems(entries: DataFrame, codes: DataFrame, required: list[str], allowed: dict[str, list[str]]) -> DataFrame:
    """(code, problem): codes without an entry, entries of no code, and of the others each required field that is empty and
    each field with a value that is not among those allowed (null is left to `required`)."""
    both = entries.join(codes.select("code").distinct().withColumn("_known", F.lit(True)), "code", "full_outer").join(entries.select("code").distinct().withColumn("_entry", F.lit(True)), "code", "left")
    empty = [F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "", F.lit(f"missing required field {c}")) for c in required]
    odd = [F.when(~F.col(c).isin(*values), F.concat(F.lit(f"unknown {c}: "), F.col(c))) for c, values in allowed.items()]
    problems = F.when(F.col("_entry").isNull(), F.array(F.lit("missing entry"))).when(F.col("_known").isNull(), F.array(F.lit("not a known metric"))).otherwise(F.array_compact(F.array(*empty, *odd)))
    return both.select("code", F.explode(problems).alias("problem"))


def statement_csv(statements: DataFrame, keys: list[str], labels: dict[str, str]) -> DataFrame:
    """(keys, line_no, text): each key's statements (of `validation.statements`) as lines of a CSV file, a header of the years
    first, cells quoted where they must be and empty where nothing was read. `labels`: statement to its name."""
    label = F.element_at(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]), F.col("statement"))
    order = F.create_map(*[x for k, s in enumerate(labels) for x in (F.lit(s), F.lit(k * 100))])
    cells = F.transform(F.map_entries("cells"), lambda e: csv_cell(e["value"].cast("string")))
    rows = statements.select(*keys, (F.element_at(order, F.col("statement")) + F.col("line")).cast("long").alias("line_no"), F.concat_ws(",", csv_cell(label), csv_cell(F.col("metric")), F.array_join(cells, ",")).alias("text"))
    heads = statements.groupBy(*keys).agg(F.concat(F.lit("Section,Line,"), F.array_join(F.map_keys(F.first("cells")), ",")).alias("text"))  # all rows of a key have its years
    return rows.unionByName(heads.select(*keys, F.lit(0).cast("long").alias("line_no"), "text"))
