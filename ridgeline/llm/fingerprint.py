"""Document fingerprints by one-permutation MinHash.

Each five-word shingle is hashed once; the top bits of its hash name one of BINS bins, the rest competes for the bin's
minimum. Empty bins take the value of a bin found by repeated universal hashing of (bin, attempt) (optimal
densification). The low B bits of each bin, packed as hex, are the fingerprint; the share of equal bins, corrected for
2**-B chance matches, estimates the Jaccard likeness.

Defined cases: null counts as empty; a text of one to four words is one shingle; a text without words has the empty
fingerprint '', likeness 1 to its like and 0 to others; equal texts have equal fingerprints; repeated ids follow one
another by text; rows with a null id come last; of a single document the next is itself; very long texts are taken whole;
empty tables give empty results; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.llm.common import blank, cut, mix, ship, shingle_hashes, small_broadcast, text_slices

BINS = 256
B = 8
WORDS = 5
#: Documents in a range of ids that one task orders at a time.
RANGE_ROWS = 1024
#: Most quantiles of the ids.
COARSE = 10_000
_EMPTY = np.uint64(2**64 - 1)
_TRIES = mix((np.arange(BINS, dtype=np.uint64)[:, None] + np.arange(4096, dtype=np.uint64)[None, :] * np.uint64(BINS)) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(BINS)


def signatures(data: np.ndarray, offsets: np.ndarray, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """B-bit values of all bins of each row, and whether the row has any shingle."""
    h, begin = shingle_hashes(data, offsets, size)
    n = len(offsets) - 1
    count = np.diff(begin)
    low = np.full(n * BINS, _EMPTY, np.uint64)
    place = np.repeat(np.arange(n), count) * BINS + (h >> np.uint64(56)).astype(np.int64)
    np.minimum.at(low, place, h & np.uint64(2**56 - 1))
    low = low.reshape(n, BINS)
    out = low.copy()
    row, hole = np.nonzero((low == _EMPTY) & (count > 0)[:, None])
    attempt = 0
    while len(row):
        source = _TRIES[hole, attempt % 4096].astype(np.int64)
        found = low[row, source] != _EMPTY
        out[row[found], hole[found]] = low[row[found], source[found]]
        row, hole, attempt = row[~found], hole[~found], attempt + 1
    out += np.arange(BINS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)  # copies of one value agree by chance in each bin anew
    return (mix(out) & np.uint64(2**B - 1)).astype(np.uint8), count > 0


def likeness(a: np.ndarray, has_a: np.ndarray, b: np.ndarray, has_b: np.ndarray) -> np.ndarray:
    chance = 2.0**-B
    est = np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0, 1)
    return np.where(has_a & has_b, est, (~has_a & ~has_b).astype(float))


def text_signatures(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    parts = [signatures(data, offsets) for _, _, data, offsets in text_slices(pa.array(texts, pa.large_string()))]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _ranges(ids: DataFrame) -> Column:
    """The number of the range of ids that `_id` falls in, ascending with it; -1 for null ids.

    Quantiles of the ids, COARSE at most, cut them into parts of like size, whatever the ids; each part is cut evenly between
    its own least and greatest id into ranges of about RANGE_ROWS. So an id far from all others widens one part's ranges only.
    """
    n = ids.agg(F.count("_id")).first()[0]
    parts = max(1, min(COARSE, n // RANGE_ROWS))
    cuts = np.unique(np.array(ids.agg(F.percentile_approx("_id", [k / parts for k in range(1, parts)], 2 * COARSE)).first()[0] if parts > 1 and n else [], np.int64))
    id_ = F.coalesce(F.col("_id").cast("long"), F.lit(0))
    long = F.pandas_udf(lambda x: pd.Series(np.searchsorted(cuts, x.to_numpy(np.int64), "right").astype(np.int64)), T.LongType())
    found = sorted(ids.filter("_id IS NOT NULL").groupBy(long(id_).alias("part")).agg(F.min("_id"), F.max("_id"), F.count("*")).collect())  # a row a part
    if not found:
        return F.lit(-1).cast("long")
    low = np.array([int(r[1]) % 2**64 for r in found], np.uint64)
    wide = [min(-(-(int(r[2]) - int(r[1]) + 1) * RANGE_ROWS // r[3]), int(r[2]) - int(r[1]) + 1, 2**64 - 1) for r in found]
    first = np.cumsum([0, *((int(r[2]) - int(r[1])) // w + 1 for r, w in zip(found, wide, strict=True))])[:-1].astype(np.int64)
    step, have = np.array(wide, np.uint64), np.array([r[0] for r in found])

    def place(x: pd.Series) -> pd.Series:
        x = x.to_numpy(np.int64)
        k = np.minimum(np.searchsorted(have, np.searchsorted(cuts, x, "right")), len(have) - 1)  # nulls may be in none
        return pd.Series(first[k] + ((x.astype(np.uint64) - low[k]) // step[k]).astype(np.int64))

    return F.when(F.col("_id").isNull(), F.lit(-1).cast("long")).otherwise(F.pandas_udf(place, T.LongType())(id_))


def _in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_range, _tail, id, text): documents in ranges of descending ids, each followed by the next range's first one."""
    docs = docs.select(F.col(id_col).alias("_id"), blank(F.col(text_col)).alias("_text"))
    docs = docs.withColumn("_range", _ranges(docs.select("_id")))
    heads = docs.groupBy("_range").agg(F.max("_id").alias("_head")).withColumn("_block", F.floor(F.col("_range") / RANGE_ROWS))
    heads = cut(heads, "fingerprint-heads")  # one row for each range
    # the next range below: within blocks of ranges, and for a block's last one the first of the next block
    blocks = heads.groupBy("_block").agg(F.max(F.struct("_range", "_head")).alias("_top"))
    down = Window.partitionBy(F.lit(0)).orderBy(F.desc("_block"))  # one row for RANGE_ROWS ** 2 documents
    blocks = blocks.select("_block", F.coalesce(F.lead("_top").over(down), F.first("_top").over(down)).alias("_below"))
    inner = F.lead(F.struct("_range", "_head")).over(Window.partitionBy("_block").orderBy(F.desc("_range")))
    links = heads.select("_block", "_range", inner.alias("_n")).join(small_broadcast(cut(blocks, "fingerprint-blocks")), "_block")
    links = links.select(F.col("_range").alias("_to"), F.coalesce("_n", "_below").alias("_n")).select("_to", F.col("_n._range").alias("_range"), F.col("_n._head").alias("_head"))
    links = cut(links, "fingerprint-links")
    first = docs.join(small_broadcast(links), ["_range"]).filter(F.col("_id").eqNullSafe(F.col("_head")))
    first = first.groupBy("_to").agg(F.max("_text").alias("_text"), F.max("_id").alias("_id"))
    rows = docs.select("_range", F.lit(0).alias("_tail"), "_id", "_text").unionByName(first.select(F.col("_to").alias("_range"), F.lit(1).alias("_tail"), "_id", "_text"))
    return rows.repartition("_range").sortWithinPartitions("_range", "_tail", F.desc("_id"), F.desc("_text"))


def fingerprint_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every document and of its edited text, and likenesses to that and to the next document.

    The edited text: the last floor(n / 2) code points replaced by the first as many (or all) of the next document by
    descending id; after the last comes the first.
    """
    ship(docs.sparkSession)
    kinds = (("n_chars", T.LongType()), ("edited_sha256", T.StringType()), ("fingerprint", T.StringType()), ("edited_fingerprint", T.StringType()), ("near_edited", T.DoubleType()), ("near_next", T.DoubleType()))
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(*k) for k in kinds)])
    id_type = pa.int32() if docs.schema[id_col].dataType == T.IntegerType() else pa.int64()

    def emit(ranges, tails, ids, texts):
        sig, has = text_signatures(texts)
        own = [i for i in range(len(ids) - 1) if not tails[i]]
        if not own:
            return None
        at = np.array(own)
        edited = [texts[i][: len(texts[i]) - len(texts[i]) // 2] + texts[i + 1][: len(texts[i]) // 2] for i in own]
        e_sig, e_has = text_signatures(edited)
        hexes = lambda s, h: [x.tobytes().hex() if y else "" for x, y in zip(s, h, strict=True)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([ids[i] for i in own], id_type),
                pa.array([len(texts[i]) for i in own], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
                pa.array(hexes(sig[at], has[at])),
                pa.array(hexes(e_sig, e_has)),
                pa.array(likeness(sig[at], has[at], e_sig, e_has)),
                pa.array(likeness(sig[at], has[at], sig[at + 1], has[at + 1])),
            ],
            names=schema.fieldNames(),
        )

    def run(batches):
        held: tuple[list, ...] = ([], [], [], [])  # the last row waits for the next one
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = [batch.column(c).slice(i, 512).to_pylist() for c in range(4)]
                rows = [a + b for a, b in zip(held, part, strict=True)]
                if len(rows[0]) > 1 and (out := emit(*rows)) is not None:
                    yield out
                held = tuple([x[-1]] for x in rows)

    return _in_order(docs, id_col, text_col).mapInArrow(run, schema)
