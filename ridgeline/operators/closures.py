"""Sets that are walked to their end in rounds: lineage closure, and slugs that collide with none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.operators.solver import kept, settle


def lineage_closure(edges: DataFrame, value: str = "value_id", source: str = "input_id") -> DataFrame:
    """(value, source, depth): every direct and indirect input of every value, with the least number of steps to it.

    Semi-naive: a round joins the pairs found last with the edges, and only pairs not seen before go on. So cycles end; in
    one, a value is an input of itself, which shows it. Edges with a null end are left out, repeated ones count once.
    """
    edge = kept(edges.select(F.col(value).alias("_from"), F.col(source).alias("_to")).dropna().distinct())
    front = edge.withColumn("depth", F.lit(1))
    reached, depth = front, 1
    while True:
        depth += 1
        step = front.select("_from", F.col("_to").alias("_via")).join(edge.select(F.col("_from").alias("_via"), "_to"), "_via").select("_from", "_to").distinct()
        front = kept(step.join(reached, ["_from", "_to"], "left_anti").withColumn("depth", F.lit(depth)))
        if front.limit(1).count() == 0:
            return reached.select(F.col("_from").alias(value), F.col("_to").alias(source), "depth")
        reached = reached.unionByName(front)


def distinct_slugs(rows: DataFrame, taken: DataFrame, id_col: str, base: str = "base") -> DataFrame:
    """rows with `slug`, of which no two are equal and none is in taken (slug).

    By order of id each row takes the first free one of base, base-id, base-id-2, base-id-3 and so on. In rounds: all ask
    for their choice, the least id holds it, the others ask for their next. Ids are distinct and not null.
    """
    n = F.col("_try")
    choice = F.when(n == 0, F.col(base)).when(n == 1, F.concat_ws("-", base, id_col)).otherwise(F.concat_ws("-", base, id_col, n.cast("string")))
    free = taken.select("slug").distinct().withColumn("_taken", F.lit(True))
    state = settle(rows.withColumn("_try", F.lit(0)))
    while True:
        asked = state.withColumn("slug", choice)
        holder = asked.groupBy("slug").agg(F.min(id_col).alias("_holder"))
        asked = asked.join(holder, "slug").join(free, "slug", "left").withColumn("_lost", F.col("_taken").isNotNull() | (F.col(id_col) != F.col("_holder")))
        state = settle(asked.select(*rows.columns, "slug", (n + F.col("_lost").cast("int")).alias("_try"), "_lost"))
        if state.filter("_lost").limit(1).count() == 0:
            return state.select(*rows.columns, "slug")
        state = state.drop("slug", "_lost")
