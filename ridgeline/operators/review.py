"""Staging and review of readings: sieves, restated figures, verdicts, transitions, code changes, identities, periods."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions import text as tx
from ridgeline.functions.periods import close
from ridgeline.operators.lifecycle import number_in_order, number_sorted

#: Bases that are no actual figures.
PLANNED = ("budget", "forecast")


def sieve(readings: DataFrame, least: float = 0.3) -> DataFrame:
    """Adds `drop`: low_confidence (below `least`; exactly `least` stays), planned (a budget or forecast), or null to keep."""
    return readings.withColumn("drop", F.when(F.col("confidence") < least, "low_confidence").when(F.col("basis").isin(*PLANNED), "planned"))


def prefer_restated(readings: DataFrame, key: list[str]) -> DataFrame:
    """Readings of a key that has restated ones: only those; of other keys all."""
    return readings.withColumn("_any", F.bool_or(F.col("basis") == "restated").over(Window.partitionBy(*key))).filter(~F.col("_any") | (F.col("basis") == "restated")).drop("_any")


def apply_verdicts(readings: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """A second look at readings: unsupported ones go, confidence only falls, a corrected value replaces the first."""
    out = readings.join(verdicts, key, "left").filter(F.coalesce("supported", F.lit(True)))
    return out.withColumns({"confidence": F.least("confidence", "seen_confidence"), "value": F.coalesce("corrected", "value")}).drop("supported", "seen_confidence", "corrected")


def transition(rows: DataFrame, action: Column) -> DataFrame:
    """approve, reject and edit move a row on, unless it is promoted already (then `refused`)."""
    done = F.col("promoted") & action.isNotNull()
    new = F.when(action == "approve", "approved").when(action == "reject", "rejected").when(action == "edit", "needs_edit")
    return rows.withColumns({"refused": F.coalesce(done, F.lit(False)), "status": F.when(done, F.col("status")).otherwise(F.coalesce(new, F.col("status")))})


def remap(rows: DataFrame, codes: DataFrame, key: list[str], code: str) -> DataFrame:
    """Adds new_code and collides. codes: old, new. A row whose new key is held already keeps its code and is reported."""
    moved = rows.join(F.broadcast(codes), F.col(code) == F.col("old"), "left").drop("old")  # a list of renamed codes
    held = rows.select(*[F.col(k).alias(f"_{k}") for k in key], F.col(code).alias("_code")).distinct().withColumn("_held", F.lit(True))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]) & (F.col("new") == F.col("_code"))
    out = moved.join(held, same, "left").withColumn("collides", F.coalesce("_held", F.lit(False)))
    return out.withColumn("new_code", F.when(~F.col("collides") & F.col("new").isNotNull(), F.col("new")).otherwise(F.col(code))).select(*rows.columns, "new_code", "collides")


def identity_failures(wide: DataFrame, keys: list[str], identities: list[tuple[str, str, tuple[str, ...], float]]) -> DataFrame:
    """(keys, identity) of each (name, total, parts, tolerance) that does not add up; a missing operand is no failure."""
    bad = [F.when(~close(F.col(total), reduce(add, map(F.col, parts)), tolerance), name) for name, total, parts, tolerance in identities]
    return wide.select(*keys, F.explode(F.array_compact(F.array(*bad))).alias("identity"))


def code_sets(wanted: DataFrame, got: DataFrame, code: str) -> DataFrame:
    """Every code with its place: missing, extra or both."""
    a = wanted.select(code).distinct().withColumn("_a", F.lit(1))
    b = got.select(code).distinct().withColumn("_b", F.lit(1))
    return a.join(b, code, "full_outer").select(code, F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").otherwise("both").alias("place"))


def get_or_create(have: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """(key, id, created): known keys keep their id, new ones are numbered on from the largest, in key order."""
    top = have.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    new = number_sorted(wanted.select(key).distinct().join(have, key, "left_anti").select(key), [key], "_nth")
    new = new.crossJoin(F.broadcast(top)).select(key, (F.col("_top") + F.col("_nth")).alias("id"), F.lit(True).alias("created"))  # one row
    return have.select(key, "id", F.lit(False).alias("created")).unionByName(new)


def ordered_flags(flags: Column, vocabulary: tuple[str, ...]) -> Column:
    """Distinct flags in the vocabulary's order, then the others by alphabet."""
    known = F.array(*map(F.lit, vocabulary))
    return F.concat(F.filter(known, lambda x: F.array_contains(flags, x)), F.array_sort(F.array_except(flags, known)))


def paragraph_chunks(docs: DataFrame, id_col: str, text_col: str, size: int = 2000) -> DataFrame:
    """(id, chunk, paragraph, body): paragraphs of a text in chunks of about `size` characters, cut at paragraph ends only."""
    rows = docs.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("paragraph", "body"))
    before = F.sum(F.length("body")).over(Window.partitionBy(id_col).orderBy("paragraph").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("chunk", F.floor(F.coalesce(before, F.lit(0)) / size).cast("long"))


def page_runs(pages: DataFrame, by: str, page: str) -> DataFrame:
    """(by, first, last, label): runs of neighbouring page numbers, one row each."""
    rows = pages.select(by, F.col(page).alias("_page")).distinct()
    rows = number_in_order(rows, [by], F.floor(F.col("_page") / 4096), ["_page"], "_nth")
    runs = rows.groupBy(by, (F.col("_page") - F.col("_nth")).alias("_run")).agg(F.min("_page").alias("first"), F.max("_page").alias("last"))
    label = F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(F.concat_ws("-", "first", "last"))
    return runs.select(by, "first", "last", label.alias("label"))


#: What a stated scale multiplies by; any other counts as units.
SCALES = {"thousands": 1000.0, "millions": 1000000.0}


def row_value(printed: Column, scale: Column, negative: Column, quote: Column, confidence: Column) -> list[Column]:
    """value and confidence of a printed row: a quote that contradicts caps the confidence at 0.3, a missing one at 0.5."""
    by = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SCALES.items() for x in kv]), scale), F.lit(1.0))
    value = tx.parse_number(printed) * by * F.when(negative, -1).otherwise(1)
    support = tx.quote_supports(quote, printed)
    sure = F.when(support == "mismatch", F.least(confidence, F.lit(0.3))).when(support == "missing", F.least(confidence, F.lit(0.5))).otherwise(confidence)
    return [value.alias("value"), sure.alias("confidence")]
