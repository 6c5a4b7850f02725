"""Reads of versioned tables: current values, point lookups, queues in their own order, provenance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def system_wide(values: DataFrame) -> DataFrame:
    """Current values that belong to no single mode."""
    return values.filter(F.col("is_current") & F.col("mode").isNull())


def current_of(values: DataFrame, metrics: tuple[str, ...], first: str, last: str) -> DataFrame:
    """Current values of some metrics over a span of days (both included); both filters reach the scan."""
    return values.filter(F.col("is_current") & F.col("metric").isin(*metrics) & F.col("day").between(F.to_date(F.lit(first)), F.to_date(F.lit(last))))


def lookup(values: DataFrame, **cells) -> DataFrame:
    """Current values whose cells equal these; None finds null."""
    return values.filter(reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.lit(v)) for k, v in cells.items()], F.col("is_current")))


def in_status_order(status: str, order: tuple[str, ...]) -> Column:
    """A rank to sort a queue by: the listed statuses in their order, then all others."""
    known = F.create_map(*[x for k, s in enumerate(order) for x in (F.lit(s), F.lit(k))])
    return F.coalesce(F.element_at(known, F.col(status)), F.lit(len(order)))


def provenance(values: DataFrame, sources: DataFrame, documents: DataFrame) -> DataFrame:
    """Values with the documents they came from, by bridge rows (value_id, doc_id), one row a pair."""
    return values.join(sources, "value_id").join(documents, "doc_id")


def search(rows: DataFrame, needle: str, *columns: str) -> DataFrame:
    """Rows of which a column holds the needle, whatever its case; a blank needle finds all."""
    wanted = needle.strip().lower()
    return rows.filter(reduce(lambda a, b: a | b, [F.lower(c).contains(wanted) for c in columns])) if wanted else rows


def feed_log(runs: DataFrame, expected: Column) -> DataFrame:
    """Runs as ok, stalled (nothing came) or schema_break (the fingerprint of its columns is not the expected one)."""
    status = F.when(F.col("fingerprint") != expected, "schema_break").when(F.col("records") == 0, "stalled").otherwise("ok")
    return runs.withColumn("status", status)


class Repository:
    """The tables of one store by name; reading and appending stay with Spark."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def append(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.path}/{name}")

    def replace(self, name: str, rows: DataFrame, by: list[str]) -> None:
        from ridgeline.sources.sinks import replace_cohorts

        replace_cohorts(rows, f"{self.path}/{name}", by)
