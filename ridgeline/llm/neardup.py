"""MinHash near-dedup by a multi-index Hamming join.

A text's set is its distinct word shingles (64-bit hashes). Equal sets form a class. A class has a signature of COMPONENTS
minima of B bits, split into CHUNKS; by pigeonhole, a pair at a signature distance of at most CHUNKS * (ERRORS + 1) - 1
components has a chunk with at most ERRORS differing ones, so indexing each chunk under every choice of ERRORS components
left out finds all such pairs. (A pair of likeness 0.8 is missed by all chunks with a chance of about 1e-6.) A longer
one-permutation sketch ranks candidates.

Links are confirmed on full sets, in two rounds that lose none: first each class proposes its likeliest partners and the
most central member of its buckets; what is linked becomes one component; then all candidates that are still in different
components are compared. So a group of copies is never expanded into all its pairs. Buckets are streamed, large ones in
blocks; pairs are confirmed grouped by a partner, in blocks too.

Defined cases: null, empty and blank texts have the empty set and are linked with nothing; a text of fewer words than a
shingle is one shingle; equal sets are linked; repeated rows are rows of one class; a null id is never a component's id
unless it is alone; very long texts are taken whole; of equal candidates the smaller class is tried first, which changes
no result; empty tables give empty results; extra columns are ignored (`keep_one` keeps them), whatever their names.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm.common import blank, cut, lower_ascii, mix, nested, shingle_hashes, ship, small_broadcast, text_slices

CHUNKS, WIDTH, ERRORS, B = 8, 4, 1, 16
COMPONENTS = CHUNKS * WIDTH
#: Largest signature distance at which a pair is compared on full sets (beyond the guarantee of 15).
DISTANCE = 19
SKETCH = 256
BLOCK = 8192
CENTER_BLOCK = 256
_rng = np.random.default_rng(10)
_A = _rng.integers(0, 2**63, COMPONENTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_C = _rng.integers(0, 2**63, COMPONENTS, dtype=np.uint64)
#: Places of the components that each key holds, and its salt.
KEYS = [(c * len(list(combinations(range(WIDTH), WIDTH - ERRORS))) + i, [c * WIDTH + j for j in pick]) for c in range(CHUNKS) for i, pick in enumerate(combinations(range(WIDTH), WIDTH - ERRORS))]


def sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct shingle hashes in order, and each row's first one."""
    h, begin = shingle_hashes(lower_ascii(data), offsets, size)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(begin))
    order = np.lexsort([h, row])
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.searchsorted(row[new], np.arange(len(offsets)))


def signatures(h: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signature (uint16) and sketch (uint8) of every row's set; rows must not be empty."""
    sig = np.empty((len(begin) - 1, COMPONENTS), np.uint16)
    for c in range(COMPONENTS):
        x = (h ^ (h >> np.uint64(31))) * _A[c] + _C[c]
        x ^= x >> np.uint64(29)
        sig[:, c] = mix(np.minimum.reduceat(x, begin[:-1])) & np.uint64(0xFFFF)
    low = np.full((len(begin) - 1) * SKETCH, 2**64 - 1, np.uint64)
    x = mix(h.copy())
    np.minimum.at(low, np.repeat(np.arange(len(begin) - 1), np.diff(begin)) * SKETCH + (x >> np.uint64(56)).astype(np.int64), x & np.uint64(2**56 - 1))
    return sig, (mix(low) & np.uint64(255)).astype(np.uint8).reshape(-1, SKETCH)


def _blobs(m: np.ndarray) -> pa.Array:
    width = m.shape[1] * m.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(m), [None, pa.py_buffer(np.ascontiguousarray(m))]).cast(pa.binary())


def _unblob(column, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


def scan(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, th, n, cls, sig, sketch) of every row; cls is null for the empty set."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for i, j, data, offsets in text_slices(batch.column(2)):
                h, begin = sets(data, offsets, size)
                n = np.diff(begin)
                full = np.flatnonzero(n)
                some = np.append(begin[:-1][full], len(h))
                sig, sketch = signatures(h, some) if len(full) else (np.zeros((0, COMPONENTS), np.uint16), np.zeros((0, SKETCH), np.uint8))
                cls = mix(np.add.reduceat(mix(h.copy()), some[:-1]) + n[full].astype(np.uint64)).view(np.int64) if len(full) else np.zeros(0, np.int64)
                where = np.full(len(n), -1)
                where[full] = np.arange(len(full))
                take = pa.array(where, mask=where < 0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(n, pa.int64()), pa.array(cls).take(take), _blobs(sig).take(take), _blobs(sketch).take(take)],
                    names=["id", "th", "n", "cls", "sig", "sketch"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(blank(F.col(text_col))).alias("th"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, "id long, th long, n long, cls long, sig binary, sketch binary")


def _keys_of(sig: np.ndarray, salt: int, places: list[int]) -> np.ndarray:
    packed = np.zeros(len(sig), np.uint64)
    for p in places:
        packed = (packed << np.uint64(B)) | sig[:, p].astype(np.uint64)
    return mix(packed + np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64))


def index(classes: DataFrame) -> DataFrame:
    """(key, cls): every class under all its keys."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = _unblob(batch.column(1), np.uint16)
            keys = np.empty((len(sig), len(KEYS)), np.uint64)
            for k, (salt, places) in enumerate(KEYS):
                keys[:, k] = _keys_of(sig, salt, places)
            for s in range(0, len(sig), 512):
                part = keys[s : s + 512]
                yield pa.RecordBatch.from_arrays([pa.array(part.ravel().view(np.int64)), batch.column(0).take(pa.array(np.repeat(np.arange(s, s + len(part)), len(KEYS))))], names=["key", "cls"])

    return classes.select("cls", "sig").mapInArrow(run, "key long, cls long")


def _groups(batches, least: int = 20_000):
    """Tables of whole buckets (key, lo, hi sorted) of a sorted stream."""
    held: list = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < least:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        key = [t.column(c).to_numpy() for c in ("key", "lo", "hi")]
        same = (key[0] == key[0][-1]) & (key[1] == key[1][-1]) & (key[2] == key[2][-1])
        at = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if at:
            yield t.slice(0, at)
        held, size = t.slice(at).combine_chunks().to_batches(), t.num_rows - at
    if held:
        yield pa.Table.from_batches(held)


def _bounds(t: pa.Table) -> np.ndarray:
    key = [t.column(c).to_numpy() for c in ("key", "lo", "hi")]
    new = np.ones(len(key[0]) + 1, bool)
    new[1:-1] = (key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1]) | (key[2][1:] != key[2][:-1])
    return np.flatnonzero(new)


def _near_pairs(bounds: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i < j) within the groups of at most `most` rows, by offset over all groups at once."""
    n = np.diff(bounds)
    end = np.repeat(np.where(n <= most, bounds[1:], bounds[:-1]), n)
    i, j = [], []
    rows = np.arange(bounds[-1])
    for d in range(1, most):
        a = rows[rows + d < end[: len(rows)]]
        if not len(a):
            break
        i.append(a)
        j.append(a + d)
    none = np.zeros(0, np.int64)
    return np.concatenate(i or [none]), np.concatenate(j or [none])


def _distance(m: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = np.empty(len(i), np.int32)
    for s in range(0, len(i), 1 << 15):
        out[s : s + (1 << 15)] = (m[i[s : s + (1 << 15)]] != m[j[s : s + (1 << 15)]]).sum(1)
    return out


def _possible(sig: np.ndarray, sketch: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Which index pairs may reach the likeness, by signature, set sizes and sketch.

    A sketch bin differs only if an element of the symmetric difference fell into it, so the distance is at most that
    difference, (a + b) (1 - J) / (1 + J), which is compared in integers: a pair at exactly the likeness is possible.
    """
    ok = _distance(sig, i, j) <= DISTANCE
    ok &= 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
    at = np.flatnonzero(ok)
    far = _distance(sketch, i[at], j[at]).astype(np.int64)
    ok[at] = _within(far, n[i[at]] + n[j[at]], percent)
    return ok


def _within(far: np.ndarray, both: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of `both` elements together may reach the likeness with `far` different sketch bins."""
    return (100 + percent) * far <= (100 - percent) * both


def _first_key(sig: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The first of the keys that two rows share (as `index` makes them)."""
    out = np.zeros(len(i), np.uint64)
    open_ = np.ones(len(i), bool)
    for salt, places in KEYS:
        at = np.flatnonzero(open_)
        at = at[(sig[i[at]][:, places] == sig[j[at]][:, places]).all(1)]
        out[at] = _keys_of(sig[i[at]], salt, places)
        open_[at] = False
    return out.view(np.int64)


SMALL = 24
#: Rows of a bucket above which the rest of the signature is indexed too.
LARGE = 512


def _all_pairs(rows: np.ndarray, comp: np.ndarray, n: np.ndarray, sketch: np.ndarray, percent: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of the rows whose components differ and whose sizes and sketches allow the likeness; rows in order of size."""
    rows = rows[np.argsort(n[rows], kind="stable")]
    upto = np.searchsorted(n[rows], 100 * n[rows] // percent, "right")
    found = []
    for k, r in enumerate(rows):
        other = rows[k + 1 : upto[k]]
        other = other[comp[other] != comp[r]]
        if len(other):
            other = other[_within((sketch[other] != sketch[r]).sum(1), n[other] + n[r], percent)]
            found.append((np.full(len(other), r), other))
    return found


def _large_pairs(rows: np.ndarray, sig: np.ndarray, comp: np.ndarray, n: np.ndarray, sketch: np.ndarray, percent: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The same for a large bucket, by pigeonhole over the chunks that its rows do not share anyway.

    A pair that shares less than `held` components in each of these chunks differs in WIDTH - held + 1 or more of each, which
    is beyond DISTANCE if there are enough of them: then all others share `held` components of a chunk."""
    shared = (sig[rows] == sig[rows[0]]).all(0).reshape(CHUNKS, WIDTH).sum(1) >= WIDTH - ERRORS
    chunks = np.flatnonzero(~shared)
    held = next((k for k in (2, 1) if len(chunks) * (WIDTH - k + 1) > DISTANCE), 0)
    if len(rows) <= LARGE or not held:
        return _all_pairs(rows, comp, n, sketch, percent)
    found = []
    for c in chunks:
        for places in combinations(range(c * WIDTH, (c + 1) * WIDTH), held):
            key = _keys_of(sig[rows], 0, list(places))
            order = np.argsort(key, kind="stable")
            bounds = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0, [True]]))
            here = rows[order]
            i, j = _near_pairs(bounds, SMALL)
            found.append((here[i], here[j]))
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                if b - a > SMALL:
                    found += _all_pairs(here[a:b], comp, n, sketch, percent)
    i, j = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    take = comp[i] != comp[j]
    pairs = np.unique(np.stack([np.minimum(i[take], j[take]), np.maximum(i[take], j[take])]), axis=1)
    return [(pairs[0], pairs[1])]


def _propose(batches, percent: int):
    """(x, y, far): each row's two nearest partners of a bucket by sketch, and the bucket's most central row."""
    for t in _groups(batches):
        cls, n, sig, sketch = t.column("cls").to_numpy(), t.column("n").to_numpy(), _unblob(t.column("sig"), np.uint16), _unblob(t.column("sketch"), np.uint8)
        bounds = _bounds(t)
        i, j = _near_pairs(bounds, SMALL)
        found = [np.stack([np.append(i, j), np.append(j, i)])]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a <= SMALL:
                continue
            some = a + np.unique(np.linspace(0, b - a - 1, 128).astype(int))
            mean = np.array([_distance(sketch, np.full(len(some), r), some).mean() for r in range(a, b)])
            hubs = a + np.argsort(mean, kind="stable")[:8]
            rows = np.arange(a, b)
            found += [np.stack([rows, np.full(len(rows), h)]) for h in hubs]
            found += [np.stack([rows[:-d], rows[d:]]) for d in range(1, 9)]
        x, y = np.concatenate(found, 1)
        x, y = x[x != y], y[x != y]
        ok = _possible(sig, sketch, n, x, y, percent)
        x, y = x[ok], y[ok]
        far = _distance(sketch, x, y)
        order = np.lexsort([cls[y], far, x])
        x, y, far = x[order], y[order], far[order]
        nth = np.arange(len(x)) - np.searchsorted(x, x)
        take = nth < 2
        yield pa.RecordBatch.from_arrays([pa.array(cls[x[take]]), pa.array(cls[y[take]]), pa.array(far[take])], names=["x", "y", "far"])


def _across(batches, percent: int):
    """(x, y): the pairs of a bucket that may be linked and whose components differ, each in its first bucket; x < y."""
    for t in _groups(batches):
        cls, comp, half, n, key = (t.column(c).to_numpy() for c in ("cls", "comp", "own", "n", "key"))
        sig, sketch = _unblob(t.column("sig"), np.uint16), _unblob(t.column("sketch"), np.uint8)
        lo, hi = t.column("lo").to_numpy(), t.column("hi").to_numpy()
        bounds = _bounds(t)
        i, j = _near_pairs(bounds, SMALL)
        found = [(i[k], j[k]) for k in [(comp[i] != comp[j])]]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a > SMALL:
                found += _large_pairs(np.arange(a, b), sig, comp, n, sketch, percent)
        i, j = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        i, j = (x[(lo[i] == hi[i]) | (half[i] != half[j])] for x in (i, j))  # pairs of one block are its own group's
        ok = _possible(sig, sketch, n, i, j, percent)
        i, j = i[ok], j[ok]
        ok = _first_key(sig, i, j) == key[i]
        x, y = cls[i[ok]], cls[j[ok]]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["x", "y"])


def _buckets(rows: DataFrame, sizes: DataFrame, crossed: bool) -> DataFrame:
    """Rows of each bucket together; buckets over BLOCK rows in blocks, with `crossed` each block beside each other one."""
    rows = rows.join(sizes, "key").withColumn("_n", F.ceil(F.col("n_rows") / BLOCK).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("cls", F.lit(3)), F.col("_n")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_n") - 1)) if crossed else F.col("own")
    rows = rows.withColumn("_o", other).withColumns({"lo": F.least("own", "_o"), "hi": F.greatest("own", "_o")}).drop("_o", "_n", "n_rows")
    return rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "cls")


def confirm(pairs: DataFrame, reps: DataFrame, docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """The pairs (x, y) of classes with 100 * intersection >= percent * union of their full sets."""
    many = pairs.groupBy("y").agg(F.ceil(F.count("*") / CENTER_BLOCK).cast("int").alias("_n"))
    pairs = cut(pairs.join(many, "y").select("y", F.pmod(F.xxhash64("x", F.lit(4)), F.col("_n")).cast("int").alias("block"), "x"), "neardup-pairs")
    sides = pairs.select("y", "block", F.lit(1).alias("role"), F.col("x").alias("cls")).unionByName(pairs.select("y", "block").distinct().select("y", "block", F.lit(0).alias("role"), F.col("y").alias("cls")))
    need = cut(sides.select("cls").distinct().join(reps, "cls"), "neardup-need")
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(blank(F.col(text_col))).alias("th"), F.col(text_col).alias("t"))
    text = text.join(small_broadcast(need), F.col("rep.id").eqNullSafe(F.col("id")) & (F.col("rep.th") == F.col("th"))).select("cls", "t")
    rows = sides.join(text, "cls").repartition("y", "block").sortWithinPartitions("y", "block", "role", "cls")

    def run(batches):
        center, own = None, None
        for batch in batches:
            y, role, cls = batch.column(1).to_pylist(), batch.column(3).to_pylist(), batch.column(0).to_pylist()
            out: tuple[list, list] = ([], [])
            for i, j, data, offsets in text_slices(batch.column(4)):
                h, begin = sets(data, offsets, size)
                for r in range(i, j):
                    mine = h[begin[r - i] : begin[r - i + 1]]
                    if role[r] == 0:
                        center, own = y[r], mine
                        continue
                    if center != y[r]:
                        raise ValueError("a pair's partner is missing")
                    both = len(np.intersect1d(mine, own, assume_unique=True))
                    if 100 * both >= percent * (len(mine) + len(own) - both):
                        out[0].append(cls[r])
                        out[1].append(center)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["x", "y"])

    return rows.select("cls", "y", "block", "role", "t").mapInArrow(run, "x long, y long")


def components(links: DataFrame) -> DataFrame:
    """(v, label): the least vertex of each linked vertex's component, by neighbours' minima and pointer jumping."""
    edges = cut(links.select("x", "y").union(links.select("y", "x")).distinct(), "neardup-edges")
    labels = cut(edges.groupBy(F.col("x").alias("v")).agg(F.min("y").alias("m")).select("v", F.least("v", "m").alias("label")), "neardup-labels")
    while True:
        near = edges.join(labels.withColumnRenamed("v", "y"), "y").groupBy(F.col("x").alias("v")).agg(F.min("label").alias("m"))
        new = labels.join(near, "v").select("v", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        up = labels.select(F.col("v").alias("label"), F.col("label").alias("up"))
        new = cut(new.join(up, "label").select("v", "old", F.least("label", "up").alias("label")), "neardup-labels")
        labels = new.select("v", "label")
        if new.filter("old <> label").limit(1).count() == 0:
            return labels


def label(docs: DataFrame, size: int = 4, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, n, comp) of every row; comp is null for the empty set. Rows of one comp are linked."""
    seen = cut(scan(docs, id_col, text_col, size), "neardup-scan")
    classes = seen.filter("cls IS NOT NULL")
    reps = classes.groupBy("cls").agg(F.min(F.struct("id", "th")).alias("rep"))
    one = cut(classes.groupBy("cls").agg(F.first("sig").alias("sig"), F.first("sketch").alias("sketch"), F.first("n").alias("n")), "neardup-classes")
    keys = index(one)
    shared = cut(keys.groupBy("key").agg(F.count("*").alias("n_rows")).filter("n_rows > 1"), "neardup-keys")
    near = cut(keys.join(shared.select("key"), "key", "left_semi").join(one, "cls"), "neardup-buckets")
    proposed = _buckets(near, shared, False).mapInArrow(lambda b: _propose(b, percent), "x long, y long, far int").groupBy("x", "y").agg(F.min("far").alias("far"))
    nth = F.row_number().over(Window.partitionBy("x").orderBy("far", "y"))
    proposed = cut(proposed.withColumn("nth", nth).filter("nth <= 3").select("x", "y"), "neardup-proposed")
    links = cut(confirm(proposed, reps, docs, id_col, text_col, size, percent), "neardup-links")
    comp = components(links).withColumnRenamed("v", "cls")
    rest = near.join(comp, "cls", "left").withColumn("comp", F.coalesce("label", "cls")).drop("label")
    mixed = rest.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.count("*").alias("n_rows")).filter("a <> b").select("key", "n_rows")
    across = _buckets(rest, mixed, True).mapInArrow(lambda b: _across(b, percent), "x long, y long").distinct()
    tried = proposed.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    across = cut(across.join(tried, ["x", "y"], "left_anti"), "neardup-across")
    if across.limit(1).count():
        more = cut(confirm(across, reps, docs, id_col, text_col, size, percent), "neardup-links")
        comp = components(links.unionByName(more)).withColumnRenamed("v", "cls")
    return seen.select("id", "th", "n", "cls").join(comp, "cls", "left").select("id", "th", "n", F.coalesce("label", "cls").alias("comp"))


def near_duplicates(docs: DataFrame, size: int = 4, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_shingles, component_id (the smallest id reachable), kept (it is its component's id)."""
    rows = cut(label(docs, size, percent, id_col, text_col), "neardup-rows")
    least = rows.filter("comp IS NOT NULL").groupBy("comp").agg(F.min("id").alias("least"))
    rows = rows.join(cut(least, "neardup-least"), "comp", "left")  # a written side lets Spark split a large component
    first = F.when(F.col("comp").isNull(), F.col("id")).otherwise(F.col("least"))
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), first.alias("component_id"), F.col("id").eqNullSafe(first).alias("kept"))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without all but one of each group: the one of least id (then text hash) stays. Empty sets all stay."""
    rows = cut(label(docs, size, percent, id_col, text_col).filter("comp IS NOT NULL"), "neardup-rows")
    kept = rows.groupBy("comp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("k"))
    rows = rows.join(cut(kept, "neardup-least"), "comp").withColumn("keep", F.col("id").eqNullSafe(F.col("k.id")) & (F.col("th") == F.col("k.th")))
    rows = cut(rows.groupBy("id", "th").agg(F.bool_or("keep").alias("keep"), F.count("*").alias("n")).filter("NOT keep OR n > 1"), "neardup-drop")
    mine = docs.select(nested(docs), F.col(id_col).cast("long").alias("id"), F.xxhash64(blank(F.col(text_col))).alias("th"))
    named = lambda t: small_broadcast(t.select(F.col("id").alias("its_id"), F.col("th").alias("its_th")))
    same = F.col("id").eqNullSafe(F.col("its_id")) & (F.col("th") == F.col("its_th"))
    out = mine.join(named(rows), same, "left_anti")
    twins = rows.filter("keep")  # kept rows that the table repeats
    if twins.limit(1).count():
        out = out.unionByName(mine.join(named(twins), same, "left_semi").dropDuplicates(["id", "th"]))
    return out.select("_doc.*")
