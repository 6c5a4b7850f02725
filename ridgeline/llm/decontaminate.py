"""Benchmark decontamination: windows of test words as a hash set, broadcast if small; DataFrame functions only.

Texts are lower-cased (A-Z) and cut into words. Each item gives its windows of `size` words, or one of all its words if it
has fewer. Every window of every text is hashed and joined with the set of the items' hashes: a broadcast if the set is
counted to be small, otherwise a shuffle of (row, place, hash). Texts with a hit are then read again and each hit is
verified by its words. A row is known by its id and its text's hash. Which items hold a window is joined last, on distinct
windows of a text, so that a passage of many items costs nothing before.

Defined cases: null and empty texts and items have no words and no window; very long texts are taken whole; overlapping
windows mark a word once; repeated rows get equal results each; items with a null id mark words but are not listed; equal
ids are listed once; empty tables give empty results, an empty benchmark marks nothing; extra columns are ignored by
`contamination` and kept by `decontaminate`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import blank, cut, nested, small_broadcast

A_Z, a_z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words in lower case, and the same runs before A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]++"
ANY_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]++"
SIZE = 10


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(blank(text), A_Z, a_z), F.lit(WORD), F.lit(0))


def item_windows(benchmark: DataFrame, size: int = SIZE, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, k, hash, window): each distinct window of each item, its words joined by a space."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), _words(F.col(text_col)).alias("_w")).filter(F.size("_w") > 0)
    items = items.withColumn("k", F.least(F.size("_w"), F.lit(size)))
    items = items.select("item", "k", F.explode(F.expr("transform(sequence(1, size(_w) - k + 1), i -> slice(_w, i, k))")).alias("_s"))
    return items.select("item", "k", F.xxhash64("_s").alias("hash"), F.array_join("_s", " ").alias("window")).distinct()


def _row(id_col: str, text_col: str) -> list[Column]:
    return [F.col(id_col).alias("_id"), F.xxhash64(blank(F.col(text_col))).alias("_th")]


def _with(rows: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """Rows of _id and _th with the columns of `found` (of other names) for the same row; broadcast if it is small."""
    found = small_broadcast(found.withColumnsRenamed({"_id": "_of", "_th": "_tt"}))
    return rows.join(found, F.col("_id").eqNullSafe(F.col("_of")) & (F.col("_th") == F.col("_tt")), how).drop("_of", "_tt")


def _hits(docs: DataFrame, windows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _th, _at, k, window): verified occurrences of windows, _at their first word's number from 0."""
    grams = cut(windows.select("hash", "k", "window").distinct(), "decontaminate-windows")
    sizes = sorted(r.k for r in grams.select("k").distinct().collect())  # at most SIZE values
    each = [f"if(size(_w) >= {k}, transform(sequence(0, size(_w) - {k}), i -> struct(i as _at, xxhash64(slice(_w, i + 1, {k})) as hash)), array())" for k in sizes]
    each = f"concat({', '.join(each)})" if each else "cast(array() as array<struct<_at:int,hash:bigint>>)"
    words = docs.select(*_row(id_col, text_col), _words(F.col(text_col)).alias("_w"))
    scan = words.select("_id", "_th", F.explode(F.expr(each)).alias("_s")).select("_id", "_th", "_s._at", "_s.hash")
    found = scan.join(small_broadcast(grams.select("hash").distinct()), "hash", "left_semi")
    mine = cut(found.groupBy("_id", "_th").agg(F.collect_set(F.struct("_at", "hash")).alias("_s")), "decontaminate-hits")
    again = _with(words, mine, "inner").select("_id", "_th", "_w", F.explode("_s").alias("_s")).select("_id", "_th", "_w", "_s._at", "_s.hash")
    true = F.array_join(F.slice("_w", F.col("_at") + 1, F.col("k")), " ") == F.col("window")
    return again.join(small_broadcast(grams), "hash").filter(true).select("_id", "_th", "_at", "k", "window").distinct()


def _spans(hits: DataFrame) -> DataFrame:
    """(_id, _th, _spans): the maximal stretches of hit words, [s, e)."""
    own = hits.groupBy("_id", "_th").agg(F.array_sort(F.collect_set(F.struct(F.col("_at").alias("s"), (F.col("_at") + F.col("k")).alias("e")))).alias("_all"))
    last = "element_at(a, -1)"
    merge = f"case when size(a) = 0 or {last}.e < x.s then concat(a, array(x)) when {last}.e >= x.e then a else concat(slice(a, 1, size(a) - 1), array(struct({last}.s as s, x.e as e))) end"
    return own.select("_id", "_th", F.expr(f"aggregate(_all, cast(array() as array<struct<s:int,e:int>>), (a, x) -> {merge})").alias("_spans"))


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_words, n_hit, spans (of hit words, [s, e)), items (ids as sorted strings), contaminated."""
    windows = cut(item_windows(benchmark, size), "decontaminate-items")
    hits = cut(_hits(docs, windows, id_col, text_col), "decontaminate-verified")
    items = hits.select("_id", "_th", "k", "window").distinct().join(small_broadcast(windows.select("k", "window", "item")), ["k", "window"])
    items = items.groupBy("_id", "_th").agg(F.sort_array(F.collect_set("item")).alias("_items"))
    found = cut(_with(_spans(hits), items, "left"), "decontaminate-found")
    rows = docs.select(*_row(id_col, text_col), F.coalesce(F.regexp_count(F.col(text_col), F.lit(ANY_WORD)), F.lit(0)).cast("long").alias("n_words"))
    rows = _with(rows, found, "left")
    n_hit = F.expr("aggregate(coalesce(_spans, array()), 0L, (a, x) -> a + x.e - x.s)")
    return rows.select(
        F.col("_id").alias(id_col), "n_words", n_hit.alias("n_hit"),
        F.expr("coalesce(_spans, array())").alias("spans"), F.expr("coalesce(_items, array())").alias("items"), (n_hit > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without their hit words and what follows each up to the next word ("spans"), or without the documents
    that hold any ("documents")."""
    windows = cut(item_windows(benchmark, size), "decontaminate-items")
    found = cut(_spans(_hits(docs, windows, id_col, text_col)), "decontaminate-found")
    rows = _with(docs.select(nested(docs), *_row(id_col, text_col), F.col(text_col).alias("_text")), found, "left")
    own = lambda c: F.col("_doc").getField(c)
    if remove == "documents":
        return rows.filter("_spans IS NULL").select(*[own(c).alias(c) for c in docs.columns])
    if remove != "spans":
        raise ValueError("remove is spans or documents")
    hit = F.col("_spans").isNotNull()
    rows = rows.withColumn("_pieces", F.when(hit, F.split("_text", ANY_WORD)))
    tokens = F.zip_with(F.regexp_extract_all("_text", F.lit(ANY_WORD), F.lit(0)), F.slice("_pieces", 2, F.size("_pieces")), lambda w, p: F.concat(w, p))
    rows = rows.withColumn("_tokens", F.when(hit, tokens))
    gap = "if(i = 0, 0, element_at(_spans, i).e)"
    kept = f"array_join(transform(_spans, (x, i) -> array_join(slice(_tokens, {gap} + 1, x.s - {gap}), '')), '')"
    clean = F.expr(f"concat(_pieces[0], {kept}, array_join(slice(_tokens, element_at(_spans, -1).e + 1, size(_tokens)), ''))")
    new = F.when(hit, clean).otherwise(F.col("_text"))
    return rows.select(*[new.alias(c) if c == text_col else F.when(hit, F.length(new).cast("long")).otherwise(own(c)).alias(c) if c == "n_chars" else own(c).alias(c) for c in docs.columns])
