"""Byte-level BPE encoding and decoding on length-bucketed, padded numpy matrices.

Texts are cut into pieces by whole-array rules on Unicode classes (the published split pattern, see `split_pieces`).
Each distinct piece is merged once while a worker remembers it: pieces of like length form one padded matrix, and in
every round each row merges its leftmost pair of minimum rank, found through a hashed pair table, and closes the gap
(compaction). A piece of over `LONG_PIECE` bytes is a matrix of one row, whose round merges the minimum rank at all of its
places, as long as none of these merges makes a pair of lower rank: the same merges in fewer rounds.

Pieces are told apart by their bytes: hashes only gather the like ones of a slice, and each is compared with its group's
first. Defined cases: null and empty texts have no tokens; the digest of no ids is that of empty bytes; very long texts and
very long pieces are handled whole; of ties of rank the leftmost pair is merged; repeated rows keep one result row each;
empty tables give empty results; extra columns are ignored; names of other columns never clash as only the id and the text
are read.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.llm.common import SpanHash, ship, text_slices

LONG_PIECE = 512
#: Lengths in bytes up to which pieces share a matrix.
WIDTHS = (4, 6, 8, 11, 16, 32, 64, 128, 256)
#: Pieces (of up to KEPT_BYTES) in each of the two generations that a worker remembers, and bytes of text that it encodes at
#: once: they bound its memory.
MAX_CACHED = 120_000
KEPT_BYTES = 64
SLICE = 1 << 19
NONE = np.int32(2**31 - 1)
LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: The code points of Unicode's White_Space property.
WHITE_SPACE = (
    9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007, 0x2008,
    0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)


def classes() -> np.ndarray:
    """The class of every code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = LETTER
        elif kind == "N":
            out[c] = NUMBER
    out[list(WHITE_SPACE)] = SPACE
    return out


class PairTable:
    """(left id, right id) -> id of the merged token, by open addressing."""

    def __init__(self, left: np.ndarray, right: np.ndarray, value: np.ndarray):
        self.mask = np.uint64((1 << max(4, int(len(value) * 2).bit_length())) - 1)
        self.keys = np.zeros(int(self.mask) + 1, np.uint64)
        self.values = np.full(int(self.mask) + 1, NONE, np.int32)
        key, slot = self._key(left, right)
        value = value.astype(np.int32)
        while len(key):
            _, first = np.unique(slot, return_index=True)
            take = first[self.keys[slot[first]] == 0]
            self.keys[slot[take]], self.values[slot[take]] = key[take], value[take]
            rest = np.ones(len(key), bool)
            rest[take] = False
            key, value = key[rest], value[rest]
            slot = ((slot[rest] + np.uint64(1)) & self.mask).astype(np.uint64)

    def _key(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = ((left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)) + np.uint64(1)
        h = key * np.uint64(0x9E3779B97F4A7C15)
        return key, ((h ^ (h >> np.uint64(29))) >> np.uint64(13)) & self.mask

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs, NONE where there is none (negative ids are padding)."""
        out = np.full(left.shape, NONE, np.int32)
        at = np.flatnonzero((left >= 0) & (right >= 0))
        key, slot = self._key(left.ravel()[at], right.ravel()[at])
        flat = out.reshape(-1)
        while len(at):
            held = self.keys[slot]
            hit = held == key
            flat[at[hit]] = self.values[slot[hit]]
            go = ~hit & (held != 0)
            at, key, slot = at[go], key[go], (slot[go] + np.uint64(1)) & self.mask
        return out


class Tables:
    """What encoding and decoding need of a rank file, and the tokens (as bytes) of pieces seen lately."""

    def __init__(self, file: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in file.splitlines() if x)}
        pairs = [
            (self.ranks[t[:i]], self.ranks[t[i:]], r)
            for t, r in self.ranks.items()
            for i in range(1, len(t))
            if t[:i] in self.ranks and t[i:] in self.ranks
        ]
        self.pairs = PairTable(*np.array(pairs, np.int64).reshape(-1, 3).T)
        self.byte = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        if (self.byte < 0).any():
            raise ValueError("the rank file lacks single bytes")
        known = sorted((r, t) for t, r in self.ranks.items())
        size = np.zeros(known[-1][0] + 1, np.int64)
        size[[r for r, _ in known]] = [len(t) for _, t in known]
        self.token_size = size
        self.token_at = np.concatenate([[0], np.cumsum(size)[:-1]])
        self.token_bytes = np.frombuffer(b"".join(t for _, t in known), np.uint8)
        self.classes = classes()
        self.whole = {t: np.int32(r).tobytes() for t, r in self.ranks.items()}
        self.recent: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def tokens(self, pieces: list[bytes]) -> list[bytes]:
        """The token ids of each piece, as bytes of int32."""
        out = [self.whole.get(p) or self.recent.get(p) for p in pieces]
        fresh = []
        for i, (p, x) in enumerate(zip(pieces, out, strict=True)):
            if x is None and (x := self.older.get(p)) is None:
                fresh.append(i)
            else:
                out[i] = x
        for i, ids in zip(fresh, encode_pieces(self, [pieces[i] for i in fresh]), strict=True):
            out[i] = ids
        self.recent.update((p, x) for p, x in zip(pieces, out, strict=True) if 4 < len(x) and len(p) <= KEPT_BYTES)
        if len(self.recent) > MAX_CACHED:
            self.recent, self.older = {}, self.recent
        return out


def split_pieces(points: np.ndarray, starts: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Starts of the pieces that the split pattern finds, for code points of texts that begin at `starts`.

    A run of one class is a piece; a single space before a run of another class joins it; of a longer run of white space
    the last character stands apart from the rest; contractions split off an apostrophe with their letters.
    """
    n = len(points)
    begins = np.zeros(n + 1, bool)
    begins[starts[starts < n]] = True
    begins[n] = True
    if not n:
        return np.zeros(0, np.int64)
    kind = table[points]
    run = begins[:-1].copy()
    run[1:] |= kind[1:] != kind[:-1]
    run[0] = True
    out = run.copy()
    at = np.flatnonzero(run)
    end = np.append(at[1:], n)
    white = (kind[at] == SPACE) & ~begins[end]  # ends before another run of the same text
    last = end[white] - 1
    out[last] = True
    joined = last[points[last] == 32]
    out[joined + 1] = False
    lone = at[(points[at] == 39) & (end - at == 1) & ~begins[end]]
    lone = lone[(begins[lone] | (points[np.maximum(lone - 1, 0)] != 32))]
    lone = lone[kind[lone + 1] == LETTER]
    if len(lone):
        a = points[lone + 1]
        one = np.isin(a, [ord(c) for c in "stmd"])
        there = lone + 2 < n
        b = np.where(there & ~begins[np.minimum(lone + 2, n)], points[np.minimum(lone + 2, n - 1)], 0)
        two = ~one & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
        out[lone[one | two] + 1] = False
        after = np.concatenate([lone[one] + 2, lone[two] + 3])
        out[after[after < n]] = True
    return np.flatnonzero(out)


def merge_matrix(t: Tables, pieces: list[bytes]) -> list[bytes]:
    """Token ids (as bytes of int32) of pieces of like length: all rows merge one pair a round."""
    size = np.array([len(p) for p in pieces])
    width = int(size.max())
    cols = np.arange(width)
    ids = np.full((len(pieces), width), -1, np.int32)
    ids[cols < size[:, None]] = t.byte[np.frombuffer(b"".join(pieces), np.uint8)]
    rank = np.full((len(pieces), width), NONE, np.int32)
    rank[:, :-1] = t.pairs.get(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(pieces), width - 1)
    out: list = [None] * len(pieces)
    rows = np.arange(len(pieces))
    while len(rows):
        j = rank.argmin(axis=1)
        k = np.arange(len(rows))
        best = rank[k, j]
        done = best == NONE
        if done.any():
            raw = ids[done][cols < size[done][:, None]].tobytes()
            end = 4 * np.cumsum(size[done])
            for i, a, b in zip(rows[done].tolist(), (end - 4 * size[done]).tolist(), end.tolist(), strict=True):
                out[i] = raw[a:b]
            go = ~done
            rows, ids, rank, size, j, best = rows[go], ids[go], rank[go], size[go], j[go], best[go]
            if not len(rows):
                break
            k = np.arange(len(rows))
        ids[k, j] = best
        shift = cols[None, :-1] > j[:, None]  # compaction: what stands right of the pair moves left by one
        ids[:, :-1] = np.where(shift, ids[:, 1:], ids[:, :-1])
        ids[:, -1] = -1
        shift = cols[None, :-1] >= j[:, None]
        rank[:, :-1] = np.where(shift, rank[:, 1:], rank[:, :-1])
        rank[:, -1] = NONE
        size -= 1
        right = np.where(j + 1 < width, ids[k, np.minimum(j + 1, width - 1)], -1)
        has = np.flatnonzero(j > 0)
        new = t.pairs.get(np.append(best, ids[has, j[has] - 1]), np.append(right, best[has]))
        rank[k, j] = new[: len(k)]
        rank[has, j[has] - 1] = new[len(k) :]
    return out


def merge_row(t: Tables, piece: bytes) -> np.ndarray:
    """The same for one long piece. A round merges the minimum rank at its places from the left, neighbours without overlap,
    up to the first merge that makes a pair of lower rank, which must come before the places to the right of it."""
    ids = t.byte[np.frombuffer(piece, np.uint8)]
    rank = np.append(t.pairs.get(ids[:-1], ids[1:]), NONE)
    while (best := rank.min()) != NONE:
        at = np.flatnonzero(rank == best)
        nth = np.arange(len(at))
        first = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) > 1, nth, 0))
        at = at[(nth - first) % 2 == 0]
        merged = np.diff(at, prepend=-2) == 2  # right after another merge
        left = np.where(merged, best, np.where(at > 0, ids[at - 1], -1))
        right = np.where(at + 2 < len(ids), ids[np.minimum(at + 2, len(ids) - 1)], -1)
        here = np.full(len(at), best, np.int32)
        lower = np.minimum(t.pairs.get(left, here), t.pairs.get(here, right)) < best
        if lower.any():
            at = at[: int(lower.argmax()) + 1]
        ids[at] = best
        ids, rank = np.delete(ids, at + 1), np.delete(rank, at + 1)
        at = at - np.arange(len(at))
        at = np.unique(np.concatenate([at, at[at > 0] - 1]))
        rank[at] = t.pairs.get(ids[at], np.append(ids, np.int32(-1))[at + 1])
    return ids


def encode_pieces(t: Tables, pieces: list[bytes]) -> list[bytes]:
    out: list = [None] * len(pieces)
    buckets: dict[int, list[int]] = {}
    for i, p in enumerate(pieces):
        whole = t.whole.get(p)
        if whole is not None:
            out[i] = whole
        elif len(p) > LONG_PIECE:
            out[i] = merge_row(t, p).tobytes()
        else:
            buckets.setdefault(next((w for w in WIDTHS if len(p) <= w), LONG_PIECE), []).append(i)
    for width, rows in buckets.items():
        step = max(1, (1 << 18) // width)
        for k in range(0, len(rows), step):
            part = rows[k : k + step]
            for i, ids in zip(part, merge_matrix(t, [pieces[i] for i in part]), strict=True):
                out[i] = ids
    return out


def encode_slice(t: Tables, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all rows of a slice and each row's first token."""
    raw = data.tobytes()
    points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
    if not len(points):
        return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
    place = np.zeros(len(points) + 1, np.int64)
    np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000), out=place[1:])
    starts = split_pieces(points, np.searchsorted(place, offsets[:-1]), t.classes)
    begin = place[starts]
    end = np.append(begin[1:], len(data))
    _, first, inverse = np.unique(SpanHash(data).of(begin, end), return_index=True, return_inverse=True)
    size = end - begin
    like = np.minimum(np.repeat(begin[first[inverse]] - begin, size) + np.arange(len(data)), len(data) - 1)
    other = np.flatnonzero(np.logical_or.reduceat(data[like] != data, begin) | (size != size[first[inverse]]))
    inverse[other] = len(first) + np.arange(len(other))  # equal in hash alone
    first = np.append(first, other)
    found = t.tokens([raw[a:b] for a, b in zip(begin[first].tolist(), end[first].tolist(), strict=True)])
    sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
    arena, place = np.frombuffer(b"".join(found), np.int32), np.cumsum(sizes) - sizes
    count = sizes[inverse]
    total = np.zeros(len(count) + 1, np.int64)
    np.cumsum(count, out=total[1:])
    ids = arena[np.repeat(place[inverse] - total[:-1], count) + np.arange(total[-1])]
    return ids, total[np.searchsorted(begin, offsets)]


def decode_slice(t: Tables, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the ids and each row's first byte."""
    size = t.token_size[ids]
    total = np.zeros(len(ids) + 1, np.int64)
    np.cumsum(size, out=total[1:])
    return t.token_bytes[np.repeat(t.token_at[ids] - total[:-1], size) + np.arange(total[-1])], total[first]


_TABLES: dict[bytes, Tables] = {}


def tables_of(file: bytes) -> Tables:
    """One set of tables for each Python worker and rank file."""
    name = hashlib.sha256(file).digest()
    if name not in _TABLES:
        _TABLES[name] = Tables(file)
    return _TABLES[name]


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def encode_decode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank_path: str | None = None, ids: bool = True, decoded: bool = True, digests: bool = False) -> DataFrame:
    """Encode every whole text and decode it again.

    Returns the id column, n_tokens long, with `ids` the ids array<int>, with `decoded` the decoded bytes, with `digests` ids_sha256 and
    decoded_sha256 (lowercase hex; ids as little-endian unsigned 32-bit integers). The rank file (about 1 MB, a fixed
    vocabulary) is read by the driver and broadcast.
    """
    spark = df.sparkSession
    ship(spark)
    with open(rank_path or default_ranks(), "rb") as f:
        file = spark.sparkContext.broadcast(f.read())
    fields = [df.schema[id_col], T.StructField("n_tokens", T.LongType())]
    if ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    if decoded:
        fields.append(T.StructField("decoded", T.BinaryType()))
    if digests:
        fields += [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]

    def run(batches):
        t = tables_of(file.value)
        for batch in batches:
            for i, j, data, offsets in text_slices(batch.column(1), SLICE):
                got, first = encode_slice(t, data, offsets)
                back, place = decode_slice(t, got, first)
                columns = [batch.column(0).slice(i, j - i), pa.array(np.diff(first), pa.int64())]
                if ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(got, pa.int32())))
                if decoded:
                    raw = back.tobytes()
                    columns.append(pa.array([raw[a:b] for a, b in zip(place[:-1], place[1:], strict=True)], pa.binary()))
                if digests:
                    wide = got.astype("<u4")
                    columns.append(pa.array([hashlib.sha256(wide[a:b]).hexdigest() for a, b in zip(first[:-1], first[1:], strict=True)], pa.string()))
                    columns.append(pa.array([hashlib.sha256(back[a:b]).hexdigest() for a, b in zip(place[:-1], place[1:], strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, T.StructType(fields))
