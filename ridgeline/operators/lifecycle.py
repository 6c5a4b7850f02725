"""Promotion of staged values into versioned tables, as set-wise transformations of whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.operators.solver import settle


def _same(left: str, right: str, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])


def promote(current: DataFrame, incoming: DataFrame, keys: list[str], value: str, also: tuple[str, ...] = (), id_col: str | None = None) -> DataFrame:
    """The table after a load: identical readings are skipped, changed ones supersede, new ones are inserted.

    current and incoming: keys, value, at and the columns of `also` (such as quality), of which a change supersedes too; one
    row a key. Returns these, is_current and action, and with id_col the id and `restates`, the id of the row superseded. A
    second load of the same readings changes nothing. Whether a side has a row is told by a mark, so null cells are values.
    """
    # Two equi-joins by null-safe keys on one partitioning of each side.
    old, new = (side.withColumn("_there", F.lit(True)).alias(name) for side, name in ((current, "o"), (incoming, "n")))
    joined = old.join(new, _same("o", "n", keys), "full_outer")
    was, comes = (F.col(f"{side}._there").isNotNull() for side in "on")
    same = reduce(lambda a, b: a & b, [F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in ("value", *also)])
    changed = was & comes & ~same

    def row(side: str, live: bool, action: str, restates: Column | None = None) -> Column:
        cells = [F.col(f"{side}.{c}").alias(c) for c in (*keys, "value", "at", *also, *([id_col] if id_col else []))]
        if id_col:
            cells.append((F.lit(None).cast("long") if restates is None else restates).alias("restates"))
        return F.struct(*cells, F.lit(live).alias("is_current"), F.lit(action).alias("action"))

    out = (
        F.when(changed, F.array(row("o", False, "superseded"), row("n", True, "restated", F.col(f"o.{id_col}").cast("long") if id_col else None)))
        .when(was, F.array(row("o", True, "kept")))
        .otherwise(F.array(row("n", True, "inserted")))
    )
    return joined.select(F.inline(out)).withColumnRenamed("value", value)


def load_counts(promoted: DataFrame, incoming: DataFrame) -> DataFrame:
    """One row: inserted, superseded and skipped (identical) readings of a load."""
    done = promoted.agg(F.count_if(F.col("action") == "inserted").alias("inserted"), F.count_if(F.col("action") == "restated").alias("superseded"))
    return done.crossJoin(incoming.agg(F.count("*").alias("_all"))).select("inserted", "superseded", (F.col("_all") - F.col("inserted") - F.col("superseded")).alias("skipped"))


def audit_trail(promoted: DataFrame) -> DataFrame:
    """One row for each insert or restatement."""
    return promoted.filter("action IN ('inserted', 'restated')").drop("is_current")


def fill_gaps(current: DataFrame, staged: DataFrame, keys: list[str], least: float = 0.8) -> DataFrame:
    """Of the staged values sure enough, the surest (then newest) of each key that current lacks."""
    best = Window.partitionBy(*keys).orderBy(F.desc("confidence"), F.desc("id"))
    picked = staged.filter(F.col("confidence") >= least).withColumn("_nth", F.row_number().over(best)).filter("_nth = 1").drop("_nth")
    return picked.alias("s").join(current.alias("c"), _same("s", "c", keys), "left_anti")


def scoped_wipe(values: DataFrame, doomed: DataFrame, id_col: str, source_col: str, parent_col: str) -> DataFrame:
    """The values without those of the doomed sources; links to a wiped value become null."""
    kept = values.join(doomed, source_col, "left_anti")
    alive = kept.select(F.col(id_col).alias(parent_col), F.lit(True).alias("_alive"))
    out = kept.join(alive, parent_col, "left")
    return out.withColumn(parent_col, F.when(F.col("_alive"), F.col(parent_col))).select(*values.columns)


def upsert(table: DataFrame, rows: DataFrame, key: str, update: bool) -> DataFrame:
    """Insert absent keys; with update, non-null cells of rows also overwrite those there (null cells leave them)."""
    if not update:
        return table.unionByName(rows.join(table, key, "left_anti"))
    names = [c for c in table.columns if c != key]
    new = rows.select(key, *[F.col(c).alias(f"_{c}") for c in names])
    return table.join(new, key, "full_outer").select(key, *[F.coalesce(f"_{c}", c).alias(c) for c in names])


def canonical_ids(rows: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """Each row beside the least id of its key: what references to it are repointed to."""
    return rows.withColumn("canonical_id", F.min(id_col).over(Window.partitionBy(*keys)))


def number_in_order(rows: DataFrame, by: list[str], bucket: Column, order: list[str], name: str = "nth") -> DataFrame:
    """Adds the row's place (from 1) within `by` in the given order. `bucket` must not fall in that order and holds few rows
    each: places are counted up within a bucket and from the buckets' sizes, so no task orders a whole group."""
    rows = rows.withColumn("_bucket", bucket)
    sizes = rows.groupBy(*by, "_bucket").agg(F.count("*").alias("_size"))
    first = F.sum("_size").over(Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.col("_bucket").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(*[F.col(k).alias(f"_{k}") for k in by], F.col("_bucket").alias("_of"), F.coalesce(first, F.lit(0)).alias("_before"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in by], F.col("_bucket").eqNullSafe(F.col("_of")))
    nth = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy(*order))
    out = rows.join(sizes, same).withColumn(name, F.col("_before") + nth)
    return out.drop("_bucket", "_of", "_before", *[f"_{k}" for k in by])


def number_sorted(rows: DataFrame, order: list, name: str = "nth") -> DataFrame:
    """Adds the row's place (from 1) in any order: rows are sorted over all tasks in ranges, numbered in each, and moved up by
    the sizes of the ranges before, of which there are as many as tasks. Equal rows are numbered in no particular order."""
    ranged = rows.orderBy(*order).select("*", F.spark_partition_id().alias("_part"), (F.monotonically_increasing_id() % (1 << 33)).alias("_in"))
    ranged = settle(ranged)
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_size"))
    before = F.sum("_size").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # one row a task
    sizes = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    return ranged.join(F.broadcast(sizes), "_part").withColumn(name, (F.col("_before") + F.col("_in") + 1).cast("long")).drop("_part", "_in", "_before")


def stage(pending: DataFrame, rows: DataFrame, bucket: Column, order: list[str], id_col: str = "id") -> DataFrame:
    """Rows to append to pending, with ids that go on from its largest in the given order; their status is pending."""
    top = pending.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("_top"))
    out = number_in_order(rows, [], bucket, order, "_nth").crossJoin(F.broadcast(top))  # one row
    return out.withColumn(id_col, F.col("_top") + F.col("_nth")).withColumn("status", F.lit("pending")).drop("_top", "_nth")


def slow_promote(staged: DataFrame) -> DataFrame:
    """What a row-wise promotion takes up: approved rows without its stamp; they are stamped."""
    return staged.filter((F.col("status") == "approved") & ~F.coalesce("promoted", F.lit(False))).withColumn("promoted", F.lit(True))


def reset_half_done(staged: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Approved rows that never came to a current value wait again, with a note; all others stay as they are."""
    held = current.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct().withColumn("_held", F.lit(True))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    lost = (F.col("status") == "approved") & F.col("_held").isNull()
    out = staged.join(held, same, "left")
    return out.withColumns({"note": F.when(lost, "reset: approved but not promoted"), "status": F.when(lost, "pending").otherwise(F.col("status"))}).drop("_held", *[f"_{k}" for k in keys])


def reclassify(rows: DataFrame, code: str, old: str, by_period: dict[str, str]) -> DataFrame:
    """A code split in several by the period's type; other types and codes stay."""
    new = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in by_period.items() for x in kv]), F.col("period_type")), F.col(code))
    return rows.withColumn(code, F.when(F.col(code) == old, new).otherwise(F.col(code)))


def wipe_counts(values: DataFrame, doomed: DataFrame, source_col: str, parent_col: str, id_col: str) -> DataFrame:
    """What a scoped wipe would do, without doing it: by source, rows that go, and how many kept rows lose their link."""
    gone = values.join(doomed, source_col, "left_semi")
    links = values.join(doomed, source_col, "left_anti").select(F.col(parent_col).alias(id_col)).join(gone.select(id_col, source_col), id_col)
    unlinked = links.groupBy(source_col).agg(F.count("*").alias("unlinked"))
    return gone.groupBy(source_col).agg(F.count("*").alias("deleted")).join(unlinked, source_col, "left").na.fill(0, ["unlinked"])
