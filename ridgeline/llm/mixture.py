"""Mixing sources to target weights by capped water-filling, with DataFrame functions only.

Weights are dealt to the sources in code-point order (null last). A source's target is its weighted share of all sizes,
clamped at `max_epochs` times its own size; what is clamped off is dealt again by weight until no source is above its
clamp. The fixpoint has a closed form: with the sources in order of clamp / weight, the level is the first
(total - clamps before) / (weights - weights before) that does not exceed the source's own ratio.

A source takes its documents floor(target / size) times whole, and once more those of a seeded sample: documents in order
of a seeded hash until the next would pass the target, then (`FILLS` times) those that still fit into the rest. The sample
is described by one hash threshold and one size bound for each source and pass, so documents are neither shuffled nor
joined by id; sums run over hash buckets, and only the bucket that holds the threshold is ordered row by row.

Defined cases: null or wordless texts have size 0 and take 0 words; null is a source of its own, apart from ''; a source
of size 0 has target 0; very long texts are counted whole; ties of hash (repeated rows of one doc_id) are taken or left
together; an empty table gives an empty result; extra columns are ignored (`mix_documents` keeps them), whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm.common import WORD, cut, small_broadcast

#: How often a source's rest is offered to the documents that still fit into it.
FILLS = 2
#: Bits of the hash that name a bucket.
BUCKET_BITS = 12


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"{WORD}+")), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A key without nulls, in the order of the sources with null last."""
    return F.coalesce(F.concat(F.lit("0"), source), F.lit("1"))


def water_fill(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_epochs: float = 3) -> DataFrame:
    """(mix_key, source_size) -> with weight and target double; one row for each source."""
    every = Window.partitionBy(F.lit(0))
    by_name = every.orderBy("mix_key")
    by_ratio = every.orderBy("_ratio", "mix_key").rowsBetween(Window.unboundedPreceding, -1)
    dealt = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    s = sizes.withColumn("weight", dealt).withColumn("_cap", F.col("source_size") * float(max_epochs))
    s = s.withColumn("_ratio", F.col("_cap") / F.col("weight"))
    rest = F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(by_ratio), F.lit(0.0))
    weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0.0))
    s = s.withColumn("_level", rest / weight)
    level = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "mix_key", "_level"))).over(every)["_level"]
    return s.select("mix_key", "source_size", "weight", F.least(F.col("_cap"), F.coalesce(level, F.lit(0.0)) * F.col("weight")).alias("target"))


def _threshold(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """For each key the largest hash up to which the sizes' sum stays within the budget, and that sum: mix_key, _cut, _got."""
    per = rows.groupBy("mix_key", "_bucket").agg(F.sum("size").alias("_sum"))
    before = Window.partitionBy("mix_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).join(budgets, "mix_key")
    full = F.col("_before") + F.col("_sum") <= F.col("_budget")
    edge = per.filter((F.col("_before") <= F.col("_budget")) & ~full).groupBy("mix_key").agg(F.min(F.struct("_bucket", "_before", "_budget")).alias("e"))
    edge = edge.select("mix_key", F.col("e._bucket").alias("_bucket"), (F.col("e._budget") - F.col("e._before")).alias("_left"))
    whole = per.filter(full).groupBy("mix_key").agg(F.max("_bucket").alias("_b"), F.sum("_sum").alias("_got"))
    last = F.shiftleft(F.col("_b") + 1, 64 - BUCKET_BITS) - 1  # the bucket's largest hash
    whole = whole.select("mix_key", F.when(F.col("_b") == (1 << (BUCKET_BITS - 1)) - 1, F.lit(2**63 - 1)).otherwise(last).alias("_cut"), "_got")
    within = rows.join(small_broadcast(edge), ["mix_key", "_bucket"])
    running = F.sum("size").over(Window.partitionBy("mix_key").orderBy("_hash").rangeBetween(Window.unboundedPreceding, 0))
    within = within.withColumn("_run", running).filter(F.col("_run") <= F.col("_left"))
    within = within.groupBy("mix_key").agg(F.max("_hash").alias("_cut"), F.max("_run").alias("_got"))
    return whole.unionByName(within).groupBy("mix_key").agg(F.max("_cut").alias("_cut"), F.sum("_got").alias("_got"))


def _sampled(passes: int) -> Column:
    """Whether a row is in the fractional sample, from the columns of `plan`."""
    hit = F.lit(False)
    for p in range(passes):
        hit = hit | F.coalesce((F.col(f"_cut{p}") >= F.col("_hash")) & (F.col("size") <= F.col(f"_most{p}")), F.lit(False))
    return hit


def _slim(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str) -> tuple[Column, ...]:
    h = F.xxhash64(F.lit(seed), F.col(id_col))
    return source_key(F.col(source_col)).alias("mix_key"), word_count(F.col(text_col)).alias("size"), h.alias("_hash"), F.shiftright(h, 64 - BUCKET_BITS).alias("_bucket")


def plan(rows: DataFrame, weights: tuple[float, ...], max_epochs: float) -> DataFrame:
    """One row for each source: sizes, target, whole repetitions and the sample's thresholds."""
    s = cut(water_fill(rows.groupBy("mix_key").agg(F.sum("size").alias("source_size")), weights, max_epochs), "mix-targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-9)).otherwise(F.lit(0)).cast("long")
    s = s.withColumn("_whole", whole)
    s = s.withColumn("_budget", F.greatest(F.col("target") - F.col("_whole") * F.col("source_size"), F.lit(0.0)) + 1e-6)
    rest = rows.filter(F.col("size") > 0)
    for p in range(FILLS + 1):
        if p:
            rest = rows.filter(F.col("size") > 0).join(small_broadcast(s), "mix_key").filter(~_sampled(p) & (F.col("size") <= F.col("_budget"))).select(*rows.columns)
        found = _threshold(rest, s.select("mix_key", "_budget"))
        s = s.withColumn(f"_most{p}", F.col("_budget")).join(found, "mix_key", "left").withColumnRenamed("_cut", f"_cut{p}")
        s = cut(s.withColumn("_budget", F.col("_budget") - F.coalesce(F.col("_got"), F.lit(0))).drop("_got"), "mix-plan")
    return s


def _copies() -> Column:
    return (F.col("_whole") + _sampled(FILLS + 1).cast("long")).cast("long")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_epochs: float = 3, seed: int = 20, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per document: the id, source, size, source_size, weight, target (its source's), copies and taken (words)."""
    rows = cut(docs.select(F.col(id_col), F.col(source_col), *_slim(docs, seed, id_col, text_col, source_col)), "mix-rows")
    s = plan(rows.select("mix_key", "size", "_hash", "_bucket"), weights, max_epochs)
    out = rows.join(small_broadcast(s), "mix_key").withColumn("copies", _copies())
    return out.select(id_col, source_col, "size", "source_size", "weight", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix_documents(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_epochs: float = 3, seed: int = 20, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents as often as the mix takes them, with their own columns. Documents of size 0 go."""
    slim = cut(docs.select(*_slim(docs, seed, id_col, text_col, source_col)), "mix-rows")
    s = plan(slim, weights, max_epochs)
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    out = docs.select(own, *_slim(docs, seed, id_col, text_col, source_col)).join(small_broadcast(s), "mix_key")
    out = out.filter(F.col("size") > 0).withColumn("copies", _copies()).filter(F.col("copies") > 0)
    return out.select("_doc", F.explode(F.expr("sequence(1L, copies)"))).select("_doc.*")
