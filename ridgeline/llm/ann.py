"""Approximate nearest neighbours: an inverted file of coarse centroids with product-quantised residuals.

Coarse centroids and the residuals' codebooks are fitted on a bounded sample (`SAMPLE` vectors of least hash); every valid
row is indexed. A query probes its best lists and those of its k nearest in the sample; in each, the inner product is read
from asymmetric tables (query against codebooks), and the best `RERANK` rows are scored exactly on the original vectors in
double precision, as are all others that may be among the k nearest: the k-th score within the sample is a floor of the true
one, and the tables' largest error on the sample's neighbours is allowed for. So near copies that the tables cannot tell
apart are all scored. A query's lists are merged at last. Lists are dealt in blocks of at most `BLOCK_ROWS` rows and `BLOCK_QUERIES` queries, so a list that holds a
third of all rows is many small groups.

A query whose probed lists hold fewer than k rows asks again in all lists, so k are found wherever there are as many.
Vectors are sent once for each block of queries (a twentieth of the rows ask, so that moves less than sending both vectors
of each reranked pair).

Defined cases: null vectors, null or non-finite components and zero vectors take no part; as vectors of different lengths
have no inner product, each length is a table of its own, indexed one after another, whose queries search its rows; of
repeated query ids one vector (the least) of each length asks; rows of the query's own id are no candidates; ties go to the
smaller id; fewer candidates than k are all returned; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import cut, ship

SAMPLE = 16_384
BLOCK_ROWS = 4096
BLOCK_QUERIES = 2048
RERANK = 60
#: Share of the true neighbours whose lists are probed, measured on the sample.
TARGET = 0.94
CODES = 256


def valid(vec: Column) -> Column:
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(vec, lambda x: x != 0), F.lit(False))


def _kmeans(x: np.ndarray, k: int, rng, rounds: int = 8) -> np.ndarray:
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = (x @ c.T - (c * c).sum(1) / 2).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=len(c))
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


class Index:
    """Coarse centroids, and for each part of the residuals its codebook."""

    def __init__(self, sample: np.ndarray, n_lists: int, parts: int = 16, seed: int = 2):
        rng = np.random.default_rng(seed)
        x = sample.astype(np.float32)
        dim = x.shape[1]
        self.parts = max(p for p in range(1, min(parts, dim) + 1) if dim % p == 0)
        self.coarse = _kmeans(x, min(n_lists, len(x)), rng)
        rest = (x - self.coarse[self.list_of(x)]).reshape(len(x), self.parts, -1)
        #: The largest error of the tables for a query of length 1, measured by `probes_for`.
        self.error = 0.0
        self.books = [_kmeans(np.ascontiguousarray(rest[:, p]), min(CODES, len(x)), rng) for p in range(self.parts)]

    def list_of(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.coarse.T - (self.coarse * self.coarse).sum(1) / 2).argmax(1)

    def encode(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        rest = (x - self.coarse[lists]).reshape(len(x), self.parts, -1)
        return np.stack([(rest[:, p] @ b.T - (b * b).sum(1) / 2).argmax(1) for p, b in enumerate(self.books)], 1).astype(np.uint8)

    def probe(self, q: np.ndarray, n: int) -> np.ndarray:
        return np.argsort(-(q @ self.coarse.T), axis=1, kind="stable")[:, :n]

    def probes(self, q: np.ndarray, n: int, sample: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which query probes which list, and each query's floor: less than that is not among its k nearest (itself aside)."""
        mine = np.zeros((len(q), len(self.coarse)), bool)
        np.put_along_axis(mine, self.probe(q, n), True, 1)
        floor = np.full(len(q), -np.inf)
        if len(sample) > k:
            of = self.list_of(sample)
            for s in range(0, len(q), 256):
                score = q[s : s + 256] @ sample.T
                near = np.argpartition(-score, k, axis=1)[:, : k + 1]  # it may be one of them
                floor[s : s + 256] = np.take_along_axis(score, near, 1).min(1)
                part = mine[s : s + 256]
                np.put_along_axis(part, of[near], True, 1)
        i, at = np.nonzero(mine)
        return i, at, floor - self.error * np.linalg.norm(q, axis=1)

    def probes_for(self, sample: np.ndarray, k: int, target: float = TARGET) -> int:
        """The fewest probes that find `target` of the k nearest within the sample, over 256 of its vectors."""
        x = sample.astype(np.float32)
        q = x[:256]
        score = q @ x.T
        score[np.arange(len(q)), np.arange(len(q))] = -np.inf
        near = np.argsort(-score, axis=1)[:, : min(k, len(x) - 1)]
        if not near.size:
            return len(self.coarse)
        told = self.approximate_pairs(np.repeat(q, near.shape[1], 0), x[near.ravel()])
        size = np.maximum(np.linalg.norm(q, axis=1), 1e-30)[:, None]
        self.error = float(np.abs((np.take_along_axis(score, near, 1) - told.reshape(near.shape)) / size).max())
        rank = np.empty((len(q), len(self.coarse)), int)
        np.put_along_axis(rank, self.probe(q, len(self.coarse)), np.arange(len(self.coarse))[None, :], 1)
        need = np.sort(np.take_along_axis(rank, self.list_of(x)[near], 1).ravel())
        return int(need[min(len(need) - 1, math.ceil(target * len(need)) - 1)]) + 1

    def approximate_pairs(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Inner products of queries with one row each, as the tables tell them."""
        lists = self.list_of(x)
        codes, split = self.encode(x, lists), q.reshape(len(q), self.parts, -1)
        return (q * self.coarse[lists]).sum(1) + sum((split[:, p] * b[codes[:, p]]).sum(1) for p, b in enumerate(self.books))

    def approximate(self, q: np.ndarray, which: int, codes: np.ndarray) -> np.ndarray:
        """Inner products of queries with the coded rows of one list."""
        split = q.reshape(len(q), self.parts, -1)
        out = np.repeat((q @ self.coarse[which])[:, None], len(codes), 1)
        for p, b in enumerate(self.books):
            out += (split[:, p] @ b.T)[:, codes[:, p]]
        return out


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), -1)


#: Pairs of a query and a row that are scored at once.
PAIRS = 1 << 16


def _best(index: Index, which: int, q_ids, q, floor, ids, codes, x, k: int, rerank: int) -> tuple[np.ndarray, ...]:
    """(query's number, id, score), best first, of each query's k best rows of one block (rows in order of id)."""
    approx = index.approximate(q.astype(np.float32), which, codes)
    n = min(rerank, approx.shape[1])
    least = np.partition(approx, approx.shape[1] - n, axis=1)[:, approx.shape[1] - n]
    i, at = np.nonzero(approx >= np.minimum(least, floor)[:, None])
    other = ids[at] != q_ids[i]
    i, at = i[other], at[other]
    score = np.concatenate([np.zeros(0), *((x[at[s : s + PAIRS]] * q[i[s : s + PAIRS]]).sum(axis=1) for s in range(0, len(i), PAIRS))])
    order = np.lexsort([ids[at], -score, i])
    i, at, score = i[order], at[order], score[order]
    top = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[top], ids[at[top]], score[top]


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, n_lists: int | None = None, probes: int | None = 0, rerank: int = RERANK, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query by inner product. probes: 0 as the sample asks, None all."""
    ship(vectors.sparkSession)
    out = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shape = lambda df: df.filter(valid(F.col(vec_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    rows, asks = shape(vectors), shape(queries).groupBy("id", F.size("vec").alias("d")).agg(F.min("vec").alias("vec"))
    for d, n in sorted(tuple(r) for r in rows.groupBy(F.size("vec").alias("d")).count().collect()):  # one row a length
        out = out.unionByName(_search(rows.filter(F.size("vec") == d), asks.filter(F.col("d") == d).select("id", "vec"), n, k, n_lists, probes, rerank))
    return out


def _search(rows: DataFrame, asks: DataFrame, n: int, k: int, n_lists: int | None, probes: int | None, rerank: int) -> DataFrame:
    """`search` over n rows (id, vec) of one length."""
    sample = rows.orderBy(F.xxhash64("id", F.lit(2)), "id").limit(SAMPLE).select("vec").toArrow()
    lists = n_lists or int(min(1024, max(1, math.sqrt(n) / 2)))
    sample = _matrix(sample.column(0).combine_chunks())
    index = Index(sample, lists)
    lists = len(index.coarse)
    fitted = index.probes_for(sample, k)
    n_probes = lists if probes is None else min(lists, probes or fitted)
    sample = sample.astype(np.float32)

    def encode(batches):
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(1))
                at = index.list_of(x.astype(np.float32))
                codes = index.encode(x.astype(np.float32), at)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), b.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), b.column(1)], names=["list", "id", "code", "vec"])

    coded = cut(rows.mapInArrow(encode, "list int, id long, code binary, vec array<double>"), "ann-index")
    own = lambda m: F.pmod(F.xxhash64("id", F.lit(5)), F.col(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
    def group(table: pa.Table) -> pa.Table:
        kind, ids = table.column("kind").to_numpy(), table.column("id").to_numpy()
        x, floor = _matrix(table.column("vec").combine_chunks()), table.column("floor").to_numpy()
        here = np.flatnonzero(kind == 1)
        here = here[np.argsort(ids[here], kind="stable")]
        ask = np.flatnonzero(kind == 0)
        found: list = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(here):
            codes = np.frombuffer(b"".join(table.column("code").take(pa.array(here)).to_pylist()), np.uint8).reshape(len(here), -1)
            for s in range(0, len(ask), 256):
                q = ask[s : s + 256]
                i, best, score = _best(index, table.column("list")[0].as_py(), ids[q], x[q], floor[q], ids[here], codes, x[here], k, rerank)
                found.append((q[i], best, score))
        i, best, score = (np.concatenate(part) for part in zip(*found, strict=True))
        first = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else np.zeros(0, np.int64)
        ends = pa.array(np.append(first, len(i)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(part)) for part in (best.astype(np.int64), score)]
        return pa.table({"query_id": pa.array(ids[i[first]], pa.int64()), "ids": lists[0], "scores": lists[1]})

    def hits(asks: DataFrame, n_probes: int) -> DataFrame:
        """(query_id, hits): the k best rows of each query in its best lists."""

        def probe(batches):
            for b in batches:
                if b.num_rows:
                    i, at, floor = index.probes(_matrix(b.column(1)).astype(np.float32), n_probes, sample, k)
                    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), b.column(0).take(pa.array(i)), b.column(1).take(pa.array(i)), pa.array(floor[i].astype(np.float64))], names=["list", "id", "vec", "floor"])

        probing = cut(asks.mapInArrow(probe, "list int, id long, vec array<double>, floor double"), "ann-probes")
        # at most `lists` rows each
        blocks = coded.groupBy("list").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("_rows"))
        blocks = cut(blocks.join(F.broadcast(probing.groupBy("list").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("_asks"))), "list"), "ann-blocks")
        a = coded.join(F.broadcast(blocks), "list").select("list", own("_rows").alias("block"), every("_asks").alias("part"), F.lit(1).alias("kind"), "id", "code", "vec", F.lit(0.0).alias("floor"))
        b = probing.join(F.broadcast(blocks), "list").select("list", every("_rows").alias("block"), own("_asks").alias("part"), F.lit(0).alias("kind"), "id", F.lit(None).cast("binary").alias("code"), "vec", "floor")
        found = a.unionByName(b).groupBy("list", "block", "part").applyInArrow(group, "query_id long, ids array<long>, scores array<double>")
        found = found.select("query_id", F.expr("transform(arrays_zip(ids, scores), x -> struct(-x.scores as s, x.ids as i))").alias("hits"))
        return found.groupBy("query_id").agg(F.expr(f"slice(array_sort(flatten(collect_list(hits))), 1, {k})").alias("hits"))  # n_probes * blocks * k hits at most

    best = hits(asks, n_probes)
    if n_probes < lists:
        best = cut(best, "ann-best")
        enough = best.filter(F.size("hits") == k)
        short = cut(asks.join(enough.select(F.col("query_id").alias("id")), "id", "left_anti"), "ann-short")
        if short.limit(1).count():
            best = enough.unionByName(hits(short, lists))
    return best.select("query_id", F.posexplode("hits").alias("p", "hit")).select("query_id", (F.col("p") + 1).alias("rank"), F.col("hit.i").alias("vec_id"), (-F.col("hit.s")).alias("score"))


def recall(vectors: DataFrame, queries: DataFrame, found: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, recall): the share of each query's k true nearest among those found, ties at the k-th score counting as
    found. The stated query set is compared with all rows in blocks; for measuring on test tables, not for large ones."""
    dim = queries.filter(F.col(vec_col).isNotNull()).select(F.size(vec_col)).first()
    if dim is None:
        return found.select("query_id", F.lit(1.0).alias("recall")).limit(0)
    shape = lambda df: df.filter((F.size(vec_col) == dim[0]) & valid(F.col(vec_col))).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    asks = shape(queries).toArrow()
    q_ids, q = asks.column("id").to_numpy(), _matrix(asks.column("vec").combine_chunks())

    def run(batches):
        for b in batches:
            if b.num_rows:
                ids, score = b.column(0).to_numpy(), q @ _matrix(b.column(1)).T
                score[q_ids[:, None] == ids[None, :]] = -np.inf
                top = -np.sort(-score, axis=1)[:, :k]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, top.shape[1])), pa.array(top.ravel())], names=["query_id", "score"])

    top = shape(vectors).mapInArrow(run, "query_id long, score double").filter(F.col("score") > float("-inf"))
    nth = top.groupBy("query_id").agg(F.expr(f"slice(array_sort(collect_list(-score)), 1, {k})").alias("s")).select("query_id", (-F.element_at("s", -1)).alias("least"), F.size("s").alias("n"))
    hit = F.when(F.col("score") >= F.col("least") - 1e-9, 1).otherwise(0)
    return nth.join(found, "query_id", "left").groupBy("query_id", "n").agg(F.sum(F.coalesce(hit, F.lit(0))).alias("hit")).select("query_id", (F.col("hit") / F.col("n")).alias("recall"))
