"""Periodic runs of words by probing a harmonic grid: for each period p, whether words jp and (j+1)p are equal.

A run of period p and length at least 2p has p matches in a row (word i equals word i+p), so one of them starts at a
multiple of p: all periods of a text of n words take n ln n probes. Periods are probed in blocks [P, 2P), within which none
divides another. A grid point goes if a run of a divisor of its period, found in an earlier block, holds both of its words
(the run of the larger period there is that same run), or if it has fewer than half of six matches on either side, as no
run has. Of each period the first point left is extended both ways by comparing chunks of doubling length, and the points
within its matches are skipped, until none is left. Of equal stretches the smallest period stays.

Words are compared as 64-bit hashes (`common.SpanHash`). Work is per Arrow batch and in slices of texts; a longer text is
a slice of its own, whose probes are made in parts of bounded size.

Defined cases: null and empty texts have no words and no runs (collapsed: '', by `collapse` null stays null); very long
texts are taken whole; ties of length go to the smaller start, then period; repeated rows get equal results each; empty
tables give empty results; extra columns are ignored by `runs` and kept by `collapse`, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import SpanHash, nested, ship, text_slices, words

MIN_LENGTH = 12
#: Probes that are made at once.
PROBES = 1 << 20
_NONE = np.zeros(0, np.int64)


def _ranges(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The owner and the number within it of each of sum(counts) members."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def _reach(w: np.ndarray, at: np.ndarray, p: np.ndarray, stop: np.ndarray, step: int) -> np.ndarray:
    """How many matches (w[i] equals w[i + p]) follow one another from `at` in direction `step`, `stop` at most."""
    got, open_, chunk = np.zeros(len(at), np.int64), np.flatnonzero(stop > 0), 4
    while len(open_):
        still = []
        for s in range(0, len(open_), max(1, PROBES // chunk)):
            o = open_[s : s + max(1, PROBES // chunk)]
            k = got[o, None] + np.arange(chunk)
            in_ = k < stop[o, None]
            i = at[o, None] + step * np.where(in_, k, 0)
            equal = in_ & (w[i] == w[i + p[o, None]])
            run = np.where(equal.all(1), chunk, np.argmin(equal, 1))
            got[o] += run
            still.append(o[run == chunk])
        open_, chunk = np.concatenate(still), min(2 * chunk, 1 << 14)
    return got


def _probe(w: np.ndarray, begin: np.ndarray, end: np.ndarray, p: np.ndarray, found: list, shortest: int) -> list:
    """Runs of the (text, period) pairs given, which are of one block, as arrays of start, end, period."""
    owner, j = _ranges((end - begin - 1) // p)
    g = begin[owner] + j * p[owner]
    hit = w[g] == w[g + p[owner]]
    g, owner = g[hit], owner[hit]
    half = np.arange(4)  # at least six matches in a row hold three more on one side of any of theirs
    after, before = g[:, None] + half, g[:, None] - half
    pp = p[owner][:, None]
    a = (after + pp < end[owner][:, None]) & (w[np.minimum(after, len(w) - 1)] == w[np.minimum(after + pp, len(w) - 1)])
    b = (before >= begin[owner][:, None]) & (w[np.maximum(before, 0)] == w[np.maximum(before, 0) + pp])
    near = a.all(1) | b.all(1)
    g, owner = g[near], owner[near]
    for q, starts, ends in found:  # runs of a divisor
        if len(g):
            k = np.searchsorted(starts, g, "right") - 1
            g_in = (p[owner] % q == 0) & (k >= 0) & (ends[k] > g + p[owner])
            g, owner = g[~g_in], owner[~g_in]
    out = []
    while len(g):
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        at, of = g[first], owner[first]
        right = _reach(w, at, p[of], end[of] - p[of] - at, 1)
        left = _reach(w, at - 1, p[of], at - begin[of], -1)
        lo, hi = at - left, at + right  # the matches
        long = hi + p[of] - lo >= np.maximum(shortest, 2 * p[of])
        out.append(np.stack([lo, hi + p[of], p[of]])[:, long])
        reach = np.repeat(hi, np.diff(np.r_[first, len(g)]))
        g, owner = g[g >= reach], owner[g >= reach]
    return out


def find_runs(w: np.ndarray, first: np.ndarray, shortest: int = MIN_LENGTH) -> tuple[np.ndarray, ...]:
    """Text number, start (in the text), length and period of each run in texts w[first[k]:first[k + 1]], in order."""
    if shortest < 12:  # a run of period p has max(p, shortest - p) matches, which must be six
        raise ValueError("runs have at least twelve words")
    n = np.diff(first)
    every, found, low = [], [], 1
    while low <= n.max(initial=0) // 2:
        texts = np.flatnonzero((n >= 2 * low) & (n >= shortest))
        counts = np.minimum(n[texts] // 2, 2 * low - 1) - low + 1
        new, take = [], 0
        probes = np.cumsum(counts * (n[texts] // low))
        while take < len(texts):  # texts of about PROBES probes, or the periods of one text in parts
            k = max(take + 1, int(np.searchsorted(probes, (probes[take - 1] if take else 0) + PROBES, "right")))
            owner, more = _ranges(counts[take:k])
            t, p = texts[take:k][owner], low + more
            part = max(1, PROBES // max(1, int(n[t].max(initial=1)) // low)) if k == take + 1 else len(t)
            for s in range(0, len(t), part):
                new += _probe(w, first[:-1][t[s : s + part]], first[1:][t[s : s + part]], p[s : s + part], found, shortest)
            take = k
        if new:
            new = np.concatenate(new, 1)
            every.append(new)
            for q in np.unique(new[2]):
                own = new[:2, new[2] == q]
                own = own[:, np.argsort(own[0])]
                found.append((q, own[0], own[1]))
        low *= 2
    s, e, p = np.concatenate(every, 1) if every else (_NONE, _NONE, _NONE)
    order = np.lexsort((p, e, s))
    s, e, p = s[order], e[order], p[order]
    own = np.r_[True, (s[1:] != s[:-1]) | (e[1:] != e[:-1])] if len(s) else np.zeros(0, bool)
    s, e, p = s[own], e[own], p[own]
    order = np.lexsort((p, s))  # as lists are sorted: by start, then period
    s, e, p = s[order], e[order], p[order]
    text = np.searchsorted(first, s, "right") - 1
    return text, s - first[text], e - s, p


def _kept(first: np.ndarray, text: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which words no run holds after its first `period` words."""
    step = np.zeros(first[-1] + 1, np.int64)
    np.add.at(step, first[text] + start + period, 1)
    np.add.at(step, first[text] + start + length, -1)
    return np.cumsum(step[:-1]) == 0


def _collapsed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, kept: np.ndarray) -> list[bytes]:
    """The kept words of each text, joined by a space."""
    spaced = np.r_[data, np.uint8(32)]
    at = np.flatnonzero(kept)
    size = ends[at] - starts[at] + 1
    owner, k = _ranges(size)
    index = starts[at][owner] + k
    index[np.cumsum(size) - 1] = len(data)  # the space behind each word
    joined = spaced[index].tobytes()
    cuts = np.r_[0, np.cumsum(size)][np.searchsorted(at, first)]
    return [joined[a : max(a, b - 1)] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _runs_of(column, shortest: int):
    """Yield (row, runs, collapsed) of every row of an Arrow column of texts."""
    for i, j, data, offsets in text_slices(column):
        starts, ends, first = words(data, offsets)
        if len(starts):
            runs = find_runs(SpanHash(data).of(starts, ends), first, shortest)
            collapsed = _collapsed(data, starts, ends, first, _kept(first, *runs))
            cuts = np.searchsorted(runs[0], np.arange(j - i + 1))
            lists = np.stack(runs[1:], 1).tolist()
        else:
            collapsed, cuts, lists = [b""] * (j - i), np.zeros(j - i + 1, np.int64), []
        for k in range(j - i):
            yield i + k, lists[cuts[k] : cuts[k + 1]], collapsed[k]


def _applied(rows: DataFrame, schema: str, shortest: int) -> DataFrame:
    """Rows of _own and _text -> _own, _runs, _collapsed."""
    ship(rows.sparkSession)
    own = rows.schema["_own"].dataType.simpleString() if schema == "" else schema
    run = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def apply(batches):
        for batch in batches:
            runs, collapsed = [], []
            for _, found, text in _runs_of(batch.column("_text"), shortest):
                runs.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                collapsed.append(text)
            texts = pa.array(collapsed, pa.large_binary()).cast(pa.large_string())
            yield pa.RecordBatch.from_arrays([batch.column("_own"), pa.array(runs, run), texts], ["_own", "_runs", "_collapsed"])

    return rows.mapInArrow(apply, f"_own {own}, _runs array<struct<start:bigint,length:bigint,period:bigint>>, _collapsed string")


def runs(docs: DataFrame, min_length: int = MIN_LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, runs (by start, then period; in words from 0) and collapsed, the text that each run leaves one period of."""
    rows = docs.select(F.struct(F.col(id_col).alias("id")).alias("_own"), F.col(text_col).alias("_text"))
    out = _applied(rows, f"struct<id:{docs.schema[id_col].dataType.simpleString()}>", min_length)
    return out.select(F.col("_own.id").alias(id_col), F.col("_runs").alias("runs"), F.col("_collapsed").alias("collapsed"))


def collapse(docs: DataFrame, min_length: int = MIN_LENGTH, text_col: str = "text") -> DataFrame:
    """The documents with the repetitions of their runs removed; a text without runs stays as it is."""
    rows = docs.select(nested(docs, "_own"), F.col(text_col).alias("_text"))
    out = _applied(rows, "", min_length)
    own = lambda c: F.col("_own").getField(c)
    new = F.when(F.size("_runs") > 0, F.col("_collapsed")).otherwise(own(text_col))
    return out.select(*[new.alias(c) if c == text_col else F.when(F.size("_runs") > 0, F.length(new).cast("long")).otherwise(own(c)).alias(c) if c == "n_chars" else own(c).alias(c) for c in docs.columns])
