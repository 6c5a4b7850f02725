"""Shared helpers of the corpus operators: shared-folder tables, shipping the package, hashing of byte spans.

Everything numpy here works on one Arrow batch inside a task; Spark partitions and shuffles the work.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass holds at once (a longer document is one pass of its own).
SLICE_BYTES = 1 << 18
#: Bytes of an Arrow batch sent to Python, of which a task's JVM and worker hold several copies; Spark's own default is 64 MB.
BATCH_BYTES, _BATCH, _SPARKS_OWN = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
WHITE = "\\x20\\x09-\\x0D"
WORD = f"[^{WHITE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, on local masters only, one of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-ridgeline-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: later stages outlive lost executors."""
    path = f"{shared_dir(df.sparkSession)}/ridgeline/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers that do not have it on their path (once per context), and let batches
    on their way there be of BATCH_BYTES, unless the caller has set a size: rows and results are the same."""
    sc = spark.sparkContext
    if not sc.getConf().contains(_BATCH) and spark.conf.get(_BATCH) == _SPARKS_OWN:
        spark.conf.set(_BATCH, BATCH_BYTES)
    if getattr(sc, "_ridgeline_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    to = os.path.join(tempfile.mkdtemp(prefix="spark-ridgeline-"), "ridgeline_pkg.zip")
    with zipfile.ZipFile(to, "w") as z:
        for d, _, names in os.walk(os.path.join(top, "ridgeline")):
            for x in sorted(names):
                if x.endswith(".py"):
                    z.write(os.path.join(d, x), os.path.relpath(os.path.join(d, x), top))
    sc.addPyFile(to)
    sc._ridgeline_shipped = True


def blank(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def text_slices(column, limit: int = SLICE_BYTES):
    """Yield (first row, end row, uint8 bytes, row offsets into them) over an Arrow string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.cast(pc.fill_null(pc.cast(column, pa.large_string()), ""), pa.large_binary())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


#: Values that are mixed at a time, in buffers that stay in the cache.
_STEP = 1 << 14
_SPARE = np.empty(_STEP, np.uint64)
_M1, _M2, _M3 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser of 64-bit integers (in place)."""
    flat = h.reshape(-1)
    for s in range(0, len(flat), _STEP):
        x = flat[s : s + _STEP]
        spare = _SPARE[: len(x)]
        for shift, factor in ((32, _M1), (29, _M2), (32, None)):
            np.right_shift(x, np.uint64(shift), out=spare)
            x ^= spare
            if factor is not None:
                x *= factor
    return h


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = np.empty(len(a), np.uint64)
    for s in range(0, len(h), _STEP):
        x = h[s : s + _STEP]
        spare = _SPARE[: len(x)]
        np.multiply(a[s : s + _STEP], _M3, out=x)
        x += b[s : s + _STEP]
        np.right_shift(x, np.uint64(32), out=spare)
        x ^= spare
        x *= _M1
        np.right_shift(x, np.uint64(29), out=spare)
        x ^= spare
    return h


_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(8)], np.uint64)


class SpanHash:
    """64-bit hashes of spans of a sequence of bytes (uint8) or of integers.

    Level k holds a hash of every stretch of 2**k values, joined from its halves' hashes; a span's hash joins those of its
    first and its last stretch of the largest level that fits, and its length. As each level mixes anew, regular sequences
    (such as Thue-Morse words, of which polynomials modulo 2**64 cannot tell one from its complement) are told apart.
    Bytes begin at level 3 with eight of them as one integer; a shorter span of them is hashed as the integer it is.
    """

    def __init__(self, values: np.ndarray):
        self.bytes = values.dtype == np.uint8
        if self.bytes:
            held = np.zeros(len(values) + 8, np.uint8)
            held[: len(values)] = values
            values = np.ndarray(len(values), "<u8", held, strides=(1,))
        self.values = values
        self._start()

    def _start(self) -> None:
        self.power = 3 if self.bytes else 0
        self.level = mix(self.values[: max(0, len(self.values) - 7)].copy() if self.bytes else self.values.astype(np.uint64) + np.uint64(1))

    def _at(self, power: int) -> np.ndarray:
        if power < self.power:
            self._start()
        while self.power < power:  # only the last level is held
            half = 1 << self.power
            self.level, self.power = _join(self.level[:-half], self.level[half:]), self.power + 1
        return self.level

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the spans [start, end), none of them empty."""
        size = np.asarray(end) - np.asarray(start)
        power = np.frexp(size.astype(np.float64))[1] - 1
        out = size.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
        if self.bytes:
            at = np.flatnonzero(power < 3)
            out[at] += self.values[start[at]] & _LOW_BYTES[size[at]]
        for k in range(3 if self.bytes else 0, int(power.max(initial=-1)) + 1):
            at = np.flatnonzero(power == k)
            if len(at):
                level = self._at(k)
                out[at] += _join(level[start[at]], level[end[at] - (1 << k)])
        return mix(out)

    def windows(self, size: int) -> np.ndarray:
        """Of every window of `size` values (eight or more bytes), by its start."""
        power = size.bit_length() - 1
        level = self._at(power)
        last = size - (1 << power)
        return mix(_join(level[: len(level) - last], level[last:]))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (maximal runs of bytes other than 0x20 and 0x09-0x0D) and each row's first word."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data).astype(np.uint8)


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of `size` words of each row, in order, and each row's first shingle.

    A row of fewer words (but some) has its whole sequence as its one shingle; a row without words has none.
    """
    starts, ends, first = words(data, offsets)
    word = SpanHash(data).of(starts, ends)
    counts = np.diff(first)
    n_shingles = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    begin = np.zeros(len(offsets), np.int64)
    np.cumsum(n_shingles, out=begin[1:])
    row = np.repeat(np.arange(len(counts)), n_shingles)
    at = first[:-1][row] + np.arange(begin[-1]) - begin[:-1][row]
    return SpanHash(word).of(at, at + np.minimum(counts, size)[row]), begin


def small_broadcast(df: DataFrame, max_rows: int = 100_000, max_bytes: int = 16 << 20) -> DataFrame:
    """Hint a broadcast only if df is counted to hold few rows and few bytes; else leave the join to Spark's skew handling."""
    width = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    n, size = df.limit(max_rows + 1).agg(F.count("*"), F.sum(width)).first()
    return F.broadcast(df) if n <= max_rows and (size or 0) <= max_bytes else df


def nested(df: DataFrame, name: str = "_doc") -> Column:
    """All columns of df as one struct, beside which working columns clash with none of them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name)
