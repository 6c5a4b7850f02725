"""Exact repeats by a common-prefix interval tree over an enhanced sparse suffix array.

Texts are UTF-8 bytes. Of each window of LENGTH bytes the leftmost least hash of its GRAM-byte grams is its anchor: equal
windows choose the same anchor at the same place, so suffixes need be sorted only at anchors, and only those of anchors
that occur twice. A run of windows with one anchor is a context. Equal contexts are one leaf of the tree with all their
occurrences, and repeat wholly. Different ones are gathered by anchor; their right-hand sides are sorted (suffix array) with
their common prefixes, and a stack scan builds the interval tree bottom-up. Joining two intervals at a depth tests
left-extension diversity: the members, held in order of their reversed left-hand sides, gain new neighbours. The members of
an interval of the suffix array that also form an interval in order of their left-hand sides, with such a pair in it, are a
maximal repeat group with all its occurrences, which `repeat_groups` returns; a repeat longer than a context (LENGTH to about
2 LENGTH - GRAM bytes) comes as the chain of its overlapping stretches. `remove_repeats` needs only what the groups cover,
which their new neighbours tell: near copies have groups of all sizes within one another, whose occurrences would be
quadratic.

A group of over MAX_GROUP different contexts is split before it is sorted: LENGTH equal bytes around an anchor hold half of
what the gram leaves on its left or on its right, so the group falls into those of equal bytes on the right and those of
equal bytes on the left, and so on until they are small; one whose whole window is equal is an interval as it stands.
Contexts are pre-aggregated before any of this, so the copies of a passage cost one row.

Defined cases: null and empty texts, and those of fewer than LENGTH bytes, lose nothing; matches never cross texts; a text
may repeat itself, with overlaps; repeated rows are copies of each other; very long texts are taken whole, SEGMENT windows at
a time; empty tables give empty results; extra columns are ignored, whatever their names. Equality of grams, contexts and
rows is that of 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.llm.common import SpanHash, blank, cut, mix, ship, small_broadcast, text_slices

LENGTH = 200
GRAM = 50
MAX_GROUP = 20_000
SEGMENT = 1 << 24
_PLACE = np.uint64(2**28 - 1)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Of each run of windows with one anchor: row, gram hash, context hash, first window, anchor and last window (places in data)."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none, none
    spans = SpanHash(data)
    g = spans.windows(gram)
    least = (g & ~_PLACE) | np.arange(len(g), dtype=np.uint64)
    width, span = length - gram + 1, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if width > span:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    counts = np.maximum(np.diff(offsets) - length + 1, 0)
    row = np.repeat(np.arange(len(counts)), counts)
    begin = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=begin[1:])
    window = np.arange(begin[-1]) - begin[:-1][row] + offsets[:-1][row]
    at = (least[window] & _PLACE).astype(np.int64)
    new = np.ones(len(at) + 1, bool)
    new[1:-1] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
    cutting = np.flatnonzero(new)
    first, last = cutting[:-1], cutting[1:] - 1
    lo, hi, a = window[first], window[last], at[first]
    context = mix(spans.of(lo, hi + length) + (a - lo).astype(np.uint64))
    return row[first], g[a].view(np.int64), context.view(np.int64), lo, a, hi


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = blank(F.col(text_col))
    return docs.select(F.col(id_col), F.xxhash64(F.col(id_col), text).alias("rk"), text.alias("t"))


def _scan(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """(h, c, rk, pk): gram hash, context hash, row, and first window << 16 | anchor's and last window's offsets."""

    def run(batches):
        for batch in batches:
            for i, j, data, offsets in text_slices(batch.column(1)):
                for s in range(0, max(1, len(data)), SEGMENT if j == i + 1 else max(1, len(data))):
                    part = data[s : s + SEGMENT + length - 1] if j == i + 1 else data
                    begin = np.array([0, len(part)]) if j == i + 1 else offsets
                    row, h, c, lo, a, hi = anchors(part, begin, length, gram)
                    if len(row):
                        pk = ((lo - begin[row] + s) << 16) | ((a - lo) << 8) | (hi - lo)
                        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(c), batch.column(0).slice(i, j - i).take(pa.array(row)), pa.array(pk)], names=["h", "c", "rk", "pk"])

    return rows.select("rk", "t").mapInArrow(run, "h long, c long, rk long, pk long")


def interval_tree(rank: list[int], lcp: list[int]):
    """Stack scan of a suffix array: pairs (rank, rank, depth) that become left neighbours as intervals join, and nodes
    (depth, first and last place in suffix order, the ranges of the pairs that its own joins made).

    rank: the members' places in order of their left-hand sides, in suffix order; lcp[i]: of i-1 and i, -1 between groups.
    """
    pairs: list[tuple[int, int, int]] = []
    nodes: list[tuple[int, int, int, list[tuple[int, int]]]] = []
    stack: list[list] = []  # [members in order of rank, depth shared with the interval above, depth and pairs of its own, first place]

    def join(last: int) -> None:
        above = stack.pop()[0]
        below, depth, (own_depth, own), first = stack[-1]
        small, large = (above, below) if len(above) < len(below) else (below, above)
        known = len(pairs)
        for r in small:
            k = bisect_left(large, r)
            if k:
                pairs.append((r, large[k - 1], depth))
            if k < len(large):
                pairs.append((r, large[k], depth))
            large.insert(k, r)
        own = [*(own if own_depth == depth else ()), (known, len(pairs))]
        stack[-1][0], stack[-1][2] = large, (depth, own)
        if len(stack) < 2 or stack[-2][1] < depth:
            nodes.append((depth, first, last, own))

    for i, (r, depth) in enumerate(zip(rank, lcp, strict=True)):
        while len(stack) > 1 and stack[-2][1] >= depth:
            join(i - 1)
        if depth < 0:
            stack.clear()
        elif stack:
            stack[-1][1] = depth
        stack.append([[r], -1, (-1, []), i])
    while len(stack) > 1:
        join(len(rank) - 1)
    return pairs, nodes


def _padded(parts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes plus one, padded by zeros, and the lengths."""
    size = np.array([len(p) for p in parts])
    flat = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint16) + 1
    out = np.zeros((len(parts), width), np.uint16)
    out[np.repeat(np.arange(len(parts)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out, size


def _order(group: np.ndarray, m: np.ndarray) -> np.ndarray:
    key = np.concatenate([group.astype(">u4").view(np.uint8).reshape(-1, 4), m.astype(">u2").view(np.uint8).reshape(len(m), -1)], 1)
    return np.argsort(np.ascontiguousarray(key).view(f"S{key.shape[1]}").ravel(), kind="stable")


def _common(m: np.ndarray, size: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    for s in range(0, len(x), 1 << 14):
        a, b = x[s : s + (1 << 14)], y[s : s + (1 << 14)]
        same = m[a] == m[b]
        out[s : s + (1 << 14)] = np.where(same.all(1), np.minimum(size[a], size[b]), same.argmin(1))
    return out


class _Least:
    """Least values of ranges of an array, by a table of the ranges whose length is a power of two."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while len(self.levels[-1]) > 1 << (len(self.levels) - 1):
            half = 1 << (len(self.levels) - 1)
            last = self.levels[-1]
            self.levels.append(np.minimum(last[: len(last) - half], last[half:]))

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Of each range first..last, none of them empty."""
        out = np.empty(len(first), self.levels[0].dtype)
        level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            row = self.levels[k]
            out[at] = np.minimum(row[first[at]], row[last[at] - (1 << int(k)) + 1])
        return out


def _intervals(common: list[int], least: int):
    """(depth, first, last) of the intervals of at least that depth; common[i]: of i and i+1."""
    stack: list[tuple[int, int]] = []
    for i, depth in enumerate([*common, -1]):
        first = i
        while stack and stack[-1][0] > depth:
            shared, first = stack.pop()
            if shared >= least:
                yield shared, first, i
        if depth >= 0 and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))


class _Tree:
    """The interval tree of contexts of equal anchors, and the pairs that its joins make neighbours.

    left, right: the bytes before each anchor and from it on; group: which anchors are equal (ascending). x, y: the pairs'
    contexts; before, after: what they have in common on both sides of the anchor; long: whether that is `length` together.
    """

    def __init__(self, group: np.ndarray, left: list[bytes], right: list[bytes], length: int):
        r_bytes, r_size = _padded(right, max(map(len, right)))
        l_bytes, l_size = _padded([x[::-1] for x in left], max(1, *map(len, left)))
        order, self.by_left = _order(group, r_bytes), _order(group, l_bytes)
        rank = np.empty(len(order), np.int64)
        rank[self.by_left] = np.arange(len(order))
        self.rank = rank[order]  # of the suffixes in order
        lcp = np.full(len(order), -1)
        lcp[1:] = _common(r_bytes, r_size, order[:-1], order[1:])
        lcp[1:][group[order[1:]] != group[order[:-1]]] = -1
        beside = np.full(len(order), -1)  # what neighbours in order of the left-hand sides have in common
        beside[1:] = _common(l_bytes, l_size, self.by_left[:-1], self.by_left[1:])
        beside[1:][group[self.by_left[1:]] != group[self.by_left[:-1]]] = -1
        self.shared_left = _Least(beside)
        pairs, self.nodes = interval_tree(self.rank.tolist(), lcp.tolist())
        x, y, self.after = np.array(pairs, np.int64).reshape(-1, 3).T
        self.low, self.high = np.minimum(x, y), np.maximum(x, y)
        self.before = self.shared_left.of(self.low + 1, self.high) if len(x) else np.zeros(0, np.int64)
        self.x, self.y, self.long = self.by_left[self.low], self.by_left[self.high], self.before + self.after >= length

    def groups(self, length: int):
        """Maximal repeat groups (left, right, members), which agree in so many bytes before and from the anchor on."""
        long = np.append(0, np.cumsum(self.long))
        for depth, first, last, own in self.nodes:
            if not any(long[hi] > long[lo] for lo, hi in own):  # no pair of its own is a repeat of `length`
                continue
            members = np.sort(self.rank[first : last + 1])
            near = self.shared_left.of(members[:-1] + 1, members[1:])
            mine = np.concatenate([np.arange(lo, hi) for lo, hi in own])
            p, q = np.searchsorted(members, self.low[mine]), np.searchsorted(members, self.high[mine])
            for shared, low, high in _intervals(near.tolist(), length - depth):
                if ((p >= low) & (q <= high)).any():  # members of different intervals of the suffix array
                    yield shared, depth, self.by_left[members[low : high + 1]]


def _whole_groups(batches, least: int = 20_000):
    held: list = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size >= least:
            t = pa.Table.from_batches(held).combine_chunks()
            key = t.column("key").to_numpy()
            at = int(np.searchsorted(key, key[-1]))
            if at:
                yield t.slice(0, at)
            held, size = t.slice(at).combine_chunks().to_batches(), t.num_rows - at
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _contexts(edges: DataFrame, rows: DataFrame, length: int) -> DataFrame:
    """(h, c, n, m, rk, a, left, right): the bytes around the edges' anchors, one row a distinct context."""
    asked = edges.groupBy("rk").agg(F.collect_list(F.struct("h", "c", "n", "m", "pk")).alias("ask"))

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                out: list = []
                for rk, t, ask in zip(*(part.column(c).to_pylist() for c in ("rk", "t", "ask")), strict=True):
                    raw = t.encode()
                    for x in ask:
                        lo = x["pk"] >> 16
                        a, end = lo + (x["pk"] >> 8 & 255), lo + (x["pk"] & 255) + length
                        out.append((x["h"], x["c"], x["n"], x["m"], rk, a, raw[lo:a], raw[a:end]))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["h", "c", "n", "m", "rk", "a", "left", "right"])

    kinds = [pa.int64()] * 6 + [pa.binary()] * 2
    return rows.join(asked, "rk").select("rk", "t", "ask").mapInArrow(run, "h long, c long, n long, m long, rk long, a long, left binary, right binary")


def _split(contexts: DataFrame, length: int, gram: int) -> tuple[DataFrame, DataFrame | None]:
    """Contexts by `key` in groups small enough to sort, and those of larger groups whose window is equal, with the bytes
    `kl` on the left and `kr` after the gram that it holds. A member may be in several groups."""
    contexts = contexts.withColumns({"key": F.col("h"), "kl": F.lit(0), "kr": F.lit(0)})
    small, large, whole = contexts.filter(F.col("m") <= MAX_GROUP), contexts.filter(F.col("m") > MAX_GROUP), None
    while True:
        half = F.ceil((F.lit(length - gram) - F.col("kl") - F.col("kr")) / 2).cast("int")
        large = large.withColumn("half", half)
        right = large.filter(F.octet_length("right") >= F.lit(gram) + F.col("kr") + F.col("half"))
        right = right.withColumns({"key": F.xxhash64("key", F.lit(1), F.substring("right", 1, F.lit(gram) + F.col("kr") + F.col("half"))), "kr": F.col("kr") + F.col("half")})
        left = large.filter(F.octet_length("left") >= F.col("kl") + F.col("half"))
        left = left.withColumns({"key": F.xxhash64("key", F.lit(2), F.substring("left", -(F.col("kl") + F.col("half")), F.col("kl") + F.col("half"))), "kl": F.col("kl") + F.col("half")})
        parts = cut(right.unionByName(left).drop("m", "half"), "repeats-parts")
        hot = parts.groupBy("key").agg(F.count("*").alias("m")).filter(F.col("m") > MAX_GROUP)  # at most a row for MAX_GROUP rows
        parts = parts.join(small_broadcast(cut(hot, "repeats-hot")), "key", "left").withColumn("m", F.coalesce("m", F.lit(1)))
        full = F.col("kl") + F.col("kr") >= length - gram
        small = small.unionByName(parts.filter(F.col("m") <= MAX_GROUP))
        equal = parts.filter((F.col("m") > MAX_GROUP) & full)
        whole = equal if whole is None else whole.unionByName(equal)
        large = parts.filter((F.col("m") > MAX_GROUP) & ~full)
        if large.limit(1).count() == 0:
            return small, whole


def _tree_of(t: pa.Table, length: int) -> _Tree:
    key = t.column("key").to_numpy()
    group = np.cumsum(np.append(0, key[1:] != key[:-1]))
    return _Tree(group, t.column("left").to_pylist(), t.column("right").to_pylist(), length)


def _tree_marks(contexts: DataFrame, length: int) -> DataFrame:
    """(rk, s, e): of each context that occurs once, what its repeats cover. All of them hold its anchor, so that is one stretch,
    from the farthest on the left to the farthest on the right."""

    def run(batches):
        for t in _whole_groups(batches):
            tree = _tree_of(t, length)
            left, right = np.zeros(t.num_rows, np.int64), np.zeros(t.num_rows, np.int64)
            for who in (tree.x[tree.long], tree.y[tree.long]):
                np.maximum.at(left, who, tree.before[tree.long])
                np.maximum.at(right, who, tree.after[tree.long])
            a, rk = t.column("a").to_numpy(), t.column("rk").to_numpy()
            at = np.flatnonzero((left + right > 0) & (t.column("n").to_numpy() == 1))
            yield pa.RecordBatch.from_arrays([pa.array(rk[at]), pa.array(a[at] - left[at]), pa.array(a[at] + right[at])], names=["rk", "s", "e"])

    return contexts.repartition("key").sortWithinPartitions("key").mapInArrow(run, "rk long, s long, e long")


def _prepare(docs: DataFrame, id_col: str, text_col: str, length: int, gram: int):
    """Rows, members of repeated anchors, and their classes."""
    if not gram < length <= gram + 256:
        raise ValueError("length must exceed gram by 1 to 256")
    ship(docs.sparkSession)
    rows = _rows(docs, id_col, text_col)
    found = _scan(rows, length, gram)
    again = cut(found.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "repeats-anchors")  # a written side lets Spark split a hot anchor
    members = cut(found.join(again, "h", "left_semi"), "repeats-members")
    classes = members.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(F.struct("rk", "pk")).alias("rep"))
    return rows, members, cut(classes.select("h", "c", "n", "rep.rk", "rep.pk"), "repeats-classes")


def _mixed(classes: DataFrame, rows: DataFrame, length: int, gram: int, which: str) -> tuple[DataFrame, DataFrame | None]:
    """The contexts of anchors with several ones, in groups small enough to sort, and what is equal in larger ones."""
    mixed = classes.groupBy("h").agg(F.count("*").alias("m"), F.min("n").alias("few")).filter("m > 1").filter(which).select("h", "m")
    mixed = cut(mixed, "repeats-mixed")
    contexts = _contexts(classes.join(mixed, "h").select("h", "c", "n", "m", "rk", "pk"), rows, length)
    if mixed.filter(F.col("m") > MAX_GROUP).limit(1).count() == 0:
        return contexts.withColumn("key", F.col("h")), None
    return _split(cut(contexts, "repeats-contexts"), length, gram)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_bytes, n_removed, n_spans, kept_sha256, without every byte that a repeat of `length` bytes covers."""
    rows, members, classes = _prepare(docs, id_col, text_col, length, gram)
    lo = F.shiftright("pk", 16)
    leaves = members.join(classes.filter("n > 1").select("h", "c"), ["h", "c"]).select("rk", lo.alias("s"), (lo + F.col("pk").bitwiseAND(255) + length).alias("e"))
    contexts, whole = _mixed(classes, rows, length, gram, "few = 1")  # where all contexts recur, the leaves cover everything
    marks = leaves.unionByName(_tree_marks(contexts, length))
    if whole is not None:
        start = F.col("a") - F.col("kl")
        marks = marks.unionByName(whole.filter("n = 1").select("rk", start.alias("s"), (start + length).alias("e")))
    marks = marks.groupBy("rk").agg(F.collect_list("s").alias("s"), F.collect_list("e").alias("e"))
    fields = [docs.schema[id_col], *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType())]

    def run(batches):
        for batch in batches:
            out: list = []
            for t, s, e in zip(*(batch.column(c).to_pylist() for c in ("t", "s", "e")), strict=True):
                raw, kept, end, n = t.encode(), [], 0, 0
                for a, b in sorted(zip(s or (), e or (), strict=True)):
                    if n == 0 or a > end:
                        kept.append(raw[end:a])
                        n, end = n + 1, b
                    elif b > end:
                        end = b
                kept.append(raw[end:])
                rest = b"".join(kept)
                out.append((len(raw), len(raw) - len(rest), n, hashlib.sha256(rest).hexdigest()))
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], names=[f.name for f in fields])

    return rows.join(marks, "rk", "left").select(id_col, "rk", "t", "s", "e").mapInArrow(run, T.StructType(fields))


def repeat_groups(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Maximal repeat groups, one row an occurrence: repeat_id, size (bytes), the id and start (byte). Each window of `length`
    bytes that recurs is within a group that has all of its occurrences; a group's occurrences are equal in all `size` bytes."""
    rows, members, classes = _prepare(docs, id_col, text_col, length, gram)
    contexts, whole = _mixed(classes, rows, length, gram, "true")

    def run(batches):
        for t in _whole_groups(batches):
            h, c, lefts, rights = (t.column(x).to_pylist() for x in ("h", "c", "left", "right"))
            out = []
            for left, right, at in _tree_of(t, length).groups(length):
                one = lefts[at[0]][len(lefts[at[0]]) - left :] + rights[at[0]][:right]
                name = int.from_bytes(hashlib.blake2b(one, digest_size=8).digest(), "little", signed=True)
                out += [(name, left + right, h[i], c[i], left) for i in at]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["repeat_id", "size", "h", "c", "left"])

    found = contexts.repartition("key").sortWithinPartitions("key").mapInArrow(run, "repeat_id long, size long, h long, c long, left long")
    lo, a = F.shiftright("pk", 16), F.shiftright("pk", 8).bitwiseAND(255)
    leaves = classes.filter("n > 1").select(F.col("c").alias("repeat_id"), (F.col("pk").bitwiseAND(255) + length).alias("size"), "h", "c", a.alias("left"))
    found = found.unionByName(leaves)
    if whole is not None:
        found = found.unionByName(whole.select(F.col("key").alias("repeat_id"), F.lit(length).cast("long").alias("size"), "h", "c", F.col("kl").cast("long").alias("left")))
    found = members.join(cut(found, "repeats-groups"), ["h", "c"]).select("repeat_id", "size", "rk", (lo + a - F.col("left")).alias("start"))
    return found.join(rows.select("rk", id_col), "rk").select("repeat_id", "size", id_col, "start").distinct()
