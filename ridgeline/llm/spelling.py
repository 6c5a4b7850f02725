"""Spelling variants: words within one edit of another, joined by their three rarest bigrams; DataFrame functions only.

Bigrams are ordered by how many words hold them. One inserted, deleted or replaced letter breaks at most two bigrams of
either word, so the first unbroken one in that order is among the three rarest of both and stands in the same place, or
one further in the longer word behind an insertion. The edit lies wholly before that bigram or wholly behind it, and there
in the nearer or the farther half; so the two words agree outside of one of four stretches, and what is left of them there
is the join's key (with the shorter word's length and the stretch). Words that share a bigram, however common, meet only
if they agree on all but such a stretch. Each pair that meets is verified with `levenshtein`.

A word's form is its near word of most occurrences, if it has at least twice the word's; roots follow forms to the last
by pointer doubling: counts at least double with each step, so there are no cycles and few rounds.

Defined cases: null and empty texts have no words; very long texts and words are taken whole; a null id counts as '' where
words are edited by id; equal counts tie by code points; repeated rows count as often as they stand; empty tables give
empty results; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import blank, cut, small_broadcast

LETTERS = r"[A-Za-zÀ-ÿ]++"
A_Z, a_z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bigrams that one edit can break, and one more.
PREFIX = 3


def word_counts(docs: DataFrame, edit: Callable[[Column, Column], Column] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the letter runs of all texts, A-Z lower-cased; `edit` turns (id, run) into the word that is counted."""
    runs = F.regexp_extract_all(F.translate(blank(F.col(text_col)), A_Z, a_z), F.lit(LETTERS), F.lit(0))
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), F.explode(runs).alias("_run"))
    word = edit(F.col("_id"), F.col("_run")) if edit else F.col("_run")
    return rows.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def rarest_bigrams(words: DataFrame, most: int = PREFIX) -> DataFrame:
    """(word, n, at): the places (from 0) of each word's rarest bigrams, over the words given."""
    held = words.select("word", "n", F.posexplode(F.expr("transform(sequence(1, length(word) - 1), i -> substr(word, i, 2))")).alias("at", "_gram"))
    common = held.groupBy("_gram").agg(F.count("*").alias("_n"))
    ordered = held.join(small_broadcast(common), "_gram").groupBy("word", "n").agg(F.array_sort(F.collect_list(F.struct("_n", "_gram", "at"))).alias("_all"))
    return ordered.select("word", "n", F.explode(F.slice("_all", 1, most)).alias("_g")).select("word", "n", F.col("_g.at").alias("at"))


def _keys(longer: int) -> str:
    """SQL: the keys of a word with a bigram at `at` as the shorter of a pair (longer = 0) or as its longer one (1)."""
    size, before = f"(length(word) - {longer})", f"(at - {longer})"
    behind, split, mid = "(at + 2)", f"(at + 2 + floor(({size} - at - 2) / 2))", f"floor({before} / 2)"
    key = lambda x, y: f"xxhash64({size}, {x}, {y}, left(word, cast({x} as int)), substr(word, cast({y} as int) + 1 + {longer}))"
    after = f"if({behind} <= {size}, array({key(behind, split)}, {key(split, size)}), array())"
    ahead = f"if({before} >= 0, array({key('0', mid)}, {key(mid, before)}), array())"
    return f"array_distinct(concat({after}, {ahead}))"


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): each pair of words one edit apart once. Words have at least four letters, so three bigrams."""
    grams = cut(rarest_bigrams(words), "spelling-grams")
    short = grams.select(F.explode(F.expr(_keys(0))).alias("_key"), F.col("word").alias("a"), F.col("n").alias("n_a")).distinct()
    long = grams.select(F.explode(F.expr(_keys(1))).alias("_key"), F.col("word").alias("b"), F.col("n").alias("n_b"), F.lit(True).alias("_long")).distinct()
    other = short.select("_key", F.col("a").alias("b"), F.col("n_a").alias("n_b"), F.lit(False).alias("_long")).unionByName(long)
    near = (F.col("_long") | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1)
    return short.join(other, "_key").filter(near).select("a", "n_a", "b", "n_b").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form) without nulls: the last word that forms lead to."""
    at = cut(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        at = cut(at.join(on, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "spelling-roots")
        if at.filter("_moved").limit(1).count() == 0:
            return at.drop("_moved")
        at = at.drop("_moved")


def variants(counts: DataFrame, min_length: int = 5, min_count: int = 3, factor: float = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for the words of (word, n) of at least that length and count."""
    if min_length < PREFIX + 1:
        raise ValueError("words need three bigrams, so four letters")
    words = cut(counts.filter((F.length("word") >= min_length) & (F.col("n") >= min_count)).select("word", "n"), "spelling-words")
    pairs = near_pairs(words)
    sides = F.explode(F.array(*[F.struct(F.col(x).alias("word"), F.col(f"n_{x}").alias("_n"), F.col(f"n_{y}").alias("_m"), F.col(y).alias("_near")) for x, y in ("ab", "ba")])).alias("_s")
    near = pairs.select(sides).select("_s.*").groupBy("word", "_n")
    near = near.agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("_m")).alias("less"), "_near")).alias("_top"))
    top = F.when(-F.col("_top.less") >= F.lit(float(factor)) * F.col("_n"), F.struct(F.col("_top._near").alias("form"), (-F.col("_top.less")).alias("form_n")))
    near = cut(near.select("word", "n_near", top.alias("_form")).select("word", "n_near", "_form.form", "_form.form_n"), "spelling-near")
    root = roots(near.filter("form IS NOT NULL").select("word", "form"))
    out = words.join(near, "word", "left").join(root, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
