"""Quality classifier by Bradley-Terry pairwise ranking.

A document's strength is a linear score of features of its whole text (character and word statistics); the probability
that one document is preferred to another is the logistic function of the difference of their strengths. Weights are
learnt from preference pairs (a label-1 and a label-0 document) by Newton steps on the logistic loss of feature
differences. The threshold is the training strengths' quantile at the share of label 0; scores are shifted so that it
falls on `CUT`.

Training uses every labelled row that is not held out: moments, the sums of each Newton step and the counts for the quantile
are made by Spark over all of them. Each row of the larger class meets `EACH` rows of the other (more, up to `PAIRS` pairs,
if the table is small), dealt in turn by place in a seeded order, so each row of either class is in pairs.
Defined cases: null and empty texts have all-zero features and are scored like others; a missing class in the labels
leaves weights of 0 and a score of `CUT` for every row; of repeated labels of a document the least counts, of its texts
that of least hash; equal strengths score
alike, a score of exactly `CUT` is predicted 1; very long texts are taken whole; repeated rows are scored each; extra columns
are ignored (`score` with `keep` keeps them), whatever their names; empty tables give empty results.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.llm.common import SpanHash, cut, ship, small_broadcast, text_slices, words
from ridgeline.operators.lifecycle import number_in_order

#: Partners of each row of the larger class, and pairs that smaller tables are filled up to.
EACH, PAIRS = 4, 60_000
STEPS = 12
#: Values among which an order statistic is looked up at once; more are counted in BINS ranges first.
FEW, BINS = 10_000, 4096
CUT = 0.3
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
N_FEATURES = 14 + len(PUNCTUATION)


def _per_row(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of features for each text of a slice."""
    n_rows = len(offsets) - 1
    out = np.zeros((n_rows, N_FEATURES), np.float32)
    starts, ends, first = words(data, offsets)
    n = np.diff(first)
    rows = np.repeat(np.arange(n_rows), n)
    size = np.maximum(np.diff(offsets), 1)
    many = np.maximum(n, 1)
    total = np.zeros(256, bool)
    kinds = np.zeros((n_rows, 256), np.int64)
    np.add.at(kinds.reshape(-1), np.repeat(np.arange(n_rows), np.diff(offsets)) * 256 + data, 1)
    upper, lower, digits, high = kinds[:, 65:91].sum(1), kinds[:, 97:123].sum(1), kinds[:, 48:58].sum(1), kinds[:, 128:].sum(1)
    hashes = SpanHash(data).of(starts, ends)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
    pair = hashes.copy()
    pair *= np.uint64(31)
    pair[:-1] += np.where(rows[1:] == rows[:-1], hashes[1:], np.uint64(0))  # a row's last word has no follower
    distinct, distinct_pairs = _distinct(rows, hashes, n_rows), _distinct(rows, pair, n_rows)
    is_upper = (data[starts] >= 65) & (data[starts] <= 90)
    tail = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    total[[46, 33, 63]] = True
    inner = np.zeros(len(data), bool)
    if len(data) > 1:
        inner[1:] = (data[1:] >= 65) & (data[1:] <= 90) & (data[:-1] >= 65) & (data[:-1] <= 90)
    inner[offsets[:-1][offsets[:-1] < len(data)]] = False
    out[:, 0] = np.log1p(n) / 10
    out[:, 1] = np.bincount(rows, ends - starts, n_rows) / many / 10
    out[:, 2] = upper / size
    out[:, 3] = lower / size
    out[:, 4] = digits / size
    out[:, 5] = high / size
    out[:, 6] = np.bincount(rows, same, n_rows) / many
    out[:, 7] = distinct / many
    out[:, 8] = np.log1p(distinct) / np.maximum(np.log1p(n), 1)
    out[:, 9] = distinct_pairs / many
    out[:, 10] = np.bincount(rows, is_upper, n_rows) / many
    out[:, 11] = np.bincount(rows, total[tail], n_rows) / many
    out[:, 12] = _per_row(inner, offsets) / size
    out[:, 13] = kinds[:, 10] / size
    out[:, 14:] = np.sqrt(kinds[:, list(PUNCTUATION)] / size[:, None])
    return out


def _distinct(rows: np.ndarray, hashes: np.ndarray, n_rows: int) -> np.ndarray:
    """Number of distinct hashes of each row (40 bits of the hash beside the row)."""
    key = np.sort((rows.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
    if not len(key):
        return np.zeros(n_rows, np.int64)
    new = np.append(True, key[1:] != key[:-1])
    return np.bincount((key[new] >> np.uint64(40)).astype(np.int64), minlength=n_rows)


def _sums(d: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slope and curvature of the logistic loss of the differences d, summed over them."""
    p = 1 / (1 + np.exp(-np.clip(d @ weights, -30, 30)))
    return d.T @ (1 - p), (d * (p * (1 - p))[:, None]).T @ d


def _step(weights: np.ndarray, slope: np.ndarray, curve: np.ndarray, pairs: int) -> np.ndarray:
    """A Newton step from their sums, with a small ridge."""
    return np.linalg.solve(curve / pairs + 1e-3 * np.eye(N_FEATURES), slope / pairs - 1e-3 * weights)


class Ranker:
    """Weights of standardised features, and the strength that scores CUT."""

    @classmethod
    def of(cls, mean: np.ndarray, scale: np.ndarray) -> "Ranker":
        model = cls(np.zeros((0, N_FEATURES)), np.zeros(0))
        model.mean, model.scale = mean, scale
        return model

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 8, pairs: int = PAIRS):
        x = x.astype(np.float64)
        self.mean = x.mean(0) if len(x) else np.zeros(N_FEATURES)
        self.scale = np.maximum(x.std(0), 1e-4) if len(x) else np.ones(N_FEATURES)
        self.weights, self.threshold = np.zeros(N_FEATURES), 0.0
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        if len(good) and len(bad):
            draw = np.random.default_rng(seed)
            z = self._standard(x)
            d = z[draw.choice(good, pairs)] - z[draw.choice(bad, pairs)]
            for _ in range(STEPS):
                self.weights += _step(self.weights, *_sums(d, self.weights), pairs)
            self.threshold = float(np.quantile(self.strength(x), len(bad) / (len(good) + len(bad))))

    def _standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def strength(self, x: np.ndarray) -> np.ndarray:
        return (self._standard(x.astype(np.float64)) * self.weights).sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.strength(x) - self.threshold + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def held_out(key: Column) -> Column:
    """Whether crc32 of the id as text is divisible by 5 (a null id counts as '')."""
    return F.crc32(F.encode(F.coalesce(key.cast("string"), F.lit("")), "UTF-8")) % 5 == 0


def _packed(x: np.ndarray) -> pa.Array:
    """Rows of features as bytes."""
    x = np.ascontiguousarray(x, np.float32)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * N_FEATURES), len(x), [None, pa.py_buffer(x)]).cast(pa.binary())


def _unpacked(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, N_FEATURES)


def _totals(rows: DataFrame, of) -> dict[int, float]:
    """Sums over all rows of the vector that `of` makes of a batch, by place; each task sends one vector."""

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                part = of(batch)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["at", "v"])

    return {r["at"]: r["v"] for r in rows.mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()}  # a few thousand places


def _vector(totals: dict[int, float], size: int) -> np.ndarray:
    return np.array([totals.get(k, 0.0) for k in range(size)])


def order_statistic(values: DataFrame, k: int, few: int = FEW) -> float:
    """The value of place k (from 0) in the order of a column `s`, by counts in ranges that narrow around it."""
    while True:
        n, low, high = values.agg(F.count("s"), F.min("s"), F.max("s")).first()
        if low == high:
            return low
        if n <= few:
            return sorted(r.s for r in values.collect())[k]  # `few` values
        place = F.least(F.floor((F.col("s") - F.lit(low)) / F.lit((high - low) / BINS)), F.lit(BINS - 1))
        before = 0
        for at, size in sorted(tuple(r) for r in values.groupBy(place.alias("at")).count().collect()):  # BINS rows
            if k < before + size:
                break
            before += size
        values, k = values.filter(place == at), k - before


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(id, y, x) of every labelled id that is not held out, x being its features; ids and features travel, no texts."""
    ship(docs.sparkSession)
    some = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col)))
    some = some.groupBy(F.col(id_col).alias("_of")).agg(F.min(label_col).cast("long").alias("y"))
    texts = docs.filter(F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    texts = texts.select(F.col(id_col).alias("id"), F.when(F.col(text_col).isNotNull(), F.xxhash64(text_col)).alias("h"), F.col(text_col).alias("t"))

    def run(batches):
        for batch in batches:
            for i, j, data, offsets in text_slices(batch.column(2)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), _packed(features(data, offsets))], names=["id", "h", "x"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("h", T.LongType()), T.StructField("x", T.BinaryType())])
    rows = texts.mapInArrow(run, schema).join(some, F.col("id") == F.col("_of"))
    return rows.groupBy("id", "y").agg(F.coalesce(F.min_by("x", "h"), F.min("x")).alias("x"))


def differences(rows: DataFrame, model: Ranker, n_good: int, n_bad: int) -> DataFrame:
    """(d): the standardised features of a row of label 1 less those of one of label 0, for every pair that is dealt."""
    many, few, first = max(n_good, n_bad), min(n_good, n_bad), n_good >= n_bad
    each = min(few, max(EACH, math.ceil(PAIRS / many)))
    bits = max(1, math.ceil(math.log2((n_good + n_bad) / 4096 + 1)))
    rows = rows.withColumn("key", F.xxhash64("id", F.lit(8)))
    rows = cut(number_in_order(rows, ["y"], F.shiftright("key", 64 - bits), ["key", "id"], "nth").select("y", F.col("nth") - 1, "x").toDF("y", "nth", "x"), "quality-rows")
    more = rows.filter(F.col("y") == int(first)).select(F.col("x").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(each - 1))).alias("r"), "nth")
    more = more.select("a", F.pmod(F.col("nth") + F.col("r") * max(1, few // each), F.lit(few)).alias("at"))
    less = rows.filter(F.col("y") == int(not first)).select(F.col("nth").alias("at"), F.col("x").alias("b"))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (model._standard(_unpacked(batch.column(k)).astype(np.float64)) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([_packed(a - b if first else b - a)], names=["d"])

    return cut(more.join(small_broadcast(less), "at").select("a", "b").mapInArrow(run, "d binary"), "quality-pairs")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Ranker:
    """Fit on all labelled ids that are not held out. The driver holds sums over the features only.

    Sums differ in their last bits by the order in which tasks end, so moments and weights are rounded: reruns agree."""
    rows = cut(labelled(docs, labels, id_col, text_col, label_col), "quality-features")

    def moments(batch):
        y, x = batch.column(0).to_numpy(), _unpacked(batch.column(1)).astype(np.float64)
        return np.concatenate([[len(y), (y == 1).sum()], x.sum(0), (x * x).sum(0)])

    v = _vector(_totals(rows.select("y", "x"), moments), 2 + 2 * N_FEATURES)
    n, n_good = int(v[0]), int(v[1])
    mean, square = v[2 : 2 + N_FEATURES] / max(n, 1), v[2 + N_FEATURES :] / max(n, 1)
    scale = np.maximum(np.sqrt(np.maximum(square - mean * mean, 0)), 1e-4) if n else np.ones(N_FEATURES)
    model = Ranker.of(np.round(mean, 8), np.round(scale, 8))
    if not 0 < n_good < n:
        return model
    pairs = differences(rows, model, n_good, n - n_good)
    n_pairs = pairs.count()
    for _ in range(STEPS):
        weights = model.weights

        def sums(batch, weights=weights):
            slope, curve = _sums(_unpacked(batch.column(0)).astype(np.float64), weights)
            return np.concatenate([slope, curve.ravel()])

        v = _vector(_totals(pairs, sums), N_FEATURES * (N_FEATURES + 1))
        step = _step(weights, v[:N_FEATURES], v[N_FEATURES:].reshape(N_FEATURES, N_FEATURES), n_pairs)
        model.weights = weights + step
        if np.abs(step).max() < 1e-8:
            break
    model.weights = np.round(model.weights, 6)

    def strengths(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.strength(_unpacked(batch.column(0))))], names=["s"])

    values = cut(rows.select("x").mapInArrow(strengths, "s double"), "quality-strengths")
    at = (n - n_good) / n * (n - 1)
    low = order_statistic(values, math.floor(at))
    high = order_statistic(values, min(math.floor(at) + 1, n - 1))
    model.threshold = float(low + (high - low) * (at - math.floor(at)))
    return model


def score(docs: DataFrame, model: Ranker, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """The id and score of every row; with `keep`, the docs' own columns of the rows that score CUT or more."""
    ship(docs.sparkSession)
    names = list(docs.columns)
    place = names.index(text_col)
    schema = docs.schema if keep else T.StructType([docs.schema[id_col], T.StructField("score", T.DoubleType())])

    def run(batches):
        for batch in batches:
            if keep:
                hits = [model.score(features(data, offsets)) >= CUT for _, _, data, offsets in text_slices(batch.column(place))]
                if hits:
                    yield batch.filter(pa.array(np.concatenate(hits)))
                continue
            for i, j, data, offsets in text_slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(model.score(features(data, offsets)))], names=[id_col, "score"])

    return (docs if keep else docs.select(id_col, text_col)).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: the id, held_out, score and predicted."""
    out = score(docs, train(docs, labels, id_col, text_col), id_col, text_col)
    return out.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
