"""Shared pieces: tables, checkpoints, and vectorised words and hashes over Arrow string buffers."""

from __future__ import annotations

import ctypes
import functools

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vertebra.tables import saved, shared_dir

__all__ = ["saved", "shared_dir"]

#: A word is a longest run of bytes outside this set (space, tab, LF, VT, FF, CR). All are ASCII, so UTF-8 bytes can be split directly.
WORD = r"[^\x20\x09-\x0D]+"
WORD_GAPS = " \t\n\x0b\x0c\r"
_IS_GAP = np.zeros(256, dtype=bool)
_IS_GAP[[0x20, *range(0x09, 0x0E)]] = True

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = {k: int(b) * 2 + 1 for k, b in enumerate(_rng.integers(2**40, 2**62, size=4, dtype=np.uint64))}
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(key: Column) -> Column:
    """True for the fifth of documents whose label is never learned from; false for a null id."""
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))


def learnable(key: Column) -> Column:
    """True for the documents whose labels may be learned from. A null id is in neither part."""
    return F.coalesce(F.crc32(key.cast("string")) % 5 != 0, F.lit(False))


def with_fields(df: DataFrame, ddl: str) -> StructType:
    """The table's schema and more columns."""
    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])


def beside(uses: tuple[str, ...], ours: tuple[str, ...]):
    """A decorator for operators on a table: it sees only the columns that it uses, and one struct with all others.

    So no column of the caller's can clash with an operator's own, of whatever name. Names are compared as Spark does,
    without case; columns that the operator adds (ours) replace the caller's of those names, the others come back as
    they were, in their order, before those added.
    """

    def wrap(operator):
        @functools.wraps(operator)
        def run(docs: DataFrame, *args, **options) -> DataFrame:
            known = {c.lower() for c in (*uses, *ours)}
            spelled = {c.lower(): c for c in docs.columns}
            rest = [c for c in docs.columns if c.lower() not in known]
            column = lambda c: F.col("`" + c.replace("`", "``") + "`")
            packed = [F.struct(*[column(c) for c in rest]).alias("__rest")] if rest else []
            out = operator(docs.select(*[column(spelled[u]).alias(u) for u in uses if u in spelled], *packed), *args, **options)
            given = [c for c in docs.columns if c in rest or c.lower() in uses and c.lower() not in ours]
            back = [F.col("__rest").getField(c).alias(c) if c in rest else F.col(c.lower()).alias(c) for c in given]
            return out.select(*back, *[c for c in out.columns if c not in ("__rest", *[g.lower() for g in given if g not in rest])])

        return run

    return wrap


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose bits all depend on each other."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2**64, and of its inverse."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        n = max(n, 1 << 16)
        out = []
        for b in (_BASE[base], pow(_BASE[base], -1, 2**64)):
            p = np.full(n, b, dtype=np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = _powers[base] = (out[0], out[1])
    return have[0][:n], have[1][:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """A 64-bit hash of values[starts[i]:ends[i]] for every i, from one prefix sum."""
    up, down = powers(len(values) + 1, base)
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts])


class Words:
    """The words of several texts.

    data, offsets: UTF-8 bytes of all texts, text i being data[offsets[i]:offsets[i + 1]].
    start, end: bytes of each word. first: index of each text's first word (one more entry than texts).
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        ink = ~_IS_GAP[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        before = np.empty_like(ink)
        before[:1] = False
        before[1:] = ink[:-1]
        self.start = np.flatnonzero(ink & (~before | edge[:-1]))
        after = np.empty_like(ink)
        after[-1:] = False
        after[:-1] = ink[1:]
        self.end = np.flatnonzero(ink & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)

    def hashes(self) -> np.ndarray:
        return span_hashes(_BYTE[self.data], self.start, self.end, 0)

    def of(self, i: int) -> slice:
        return slice(self.first[i], self.first[i + 1])


def grams(hashes: np.ndarray, first: np.ndarray, k: int, base: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words inside one text, and the index of each run's first word."""
    last = np.repeat(first[1:], np.diff(first))
    at = np.flatnonzero(np.arange(len(hashes)) + k <= last)
    return span_hashes(hashes, at, at + k, base), at


def slices(batches, column: int = 0, most_bytes: int = 1 << 20):
    """Arrow batches cut so that each holds about most_bytes of the text column, or one longer text."""
    for batch in batches:
        text = batch.column(column)
        if not len(text):
            continue
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(text), 0), dtype=np.int64))
        at = 0
        while at < len(text):
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + most_bytes, side="right")))
            yield batch.slice(at, to - at)
            at = to


def buffers(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null is empty."""
    if text.null_count:
        text = pc.fill_null(text, "")
    wide = pa.types.is_large_string(text.type)
    _, offsets, data = text.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def give_back() -> None:
    """Forgets the powers, and hands memory that this process no longer uses back to the system, where its C library can."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run):
    """The same function for mapInArrow, giving memory back at its end: Python workers outlive their tasks and wait idle."""

    @functools.wraps(run)
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def few_or_plain(df: DataFrame, rows: int, most: int = 100_000) -> DataFrame:
    """Marks a table for broadcast only if it has at most `most` rows."""
    return F.broadcast(df) if rows <= most else df


class Bloom:
    """A set of 64-bit integers in a bitmap of fixed size: says yes to all of them and to few others.

    However many keys there are, the bitmap is 2**bits bits; past its capacity it lets more through and drops nothing.
    """

    CHUNK = 20

    def __init__(self, keys: DataFrame, bits: int = 27):
        """keys: one column of longs. Tasks send the bits that they set, chunk by chunk; chunks are merged apart."""
        self.bits = bits

        def mark(batches):
            at = [np.concatenate(self._places(b.column(0).to_numpy(zero_copy_only=False))) for b in batches if len(b)]
            at = np.unique(np.concatenate(at)) if at else np.zeros(0, dtype=np.uint64)
            chunk = (at >> np.uint64(self.CHUNK)).astype(np.int32)
            cut = np.flatnonzero(np.diff(chunk)) + 1
            for part in np.split(at, cut):
                if len(part):
                    low = (part & np.uint64((1 << self.CHUNK) - 1)).astype("<u4")
                    yield pa.record_batch([pa.array([int(part[0]) >> self.CHUNK], pa.int32()), pa.array([low.tobytes()], pa.binary())], names=["chunk", "at"])

        def merge(batches):
            sums: dict[int, np.ndarray] = {}
            for b in batches:
                for c, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    sums.setdefault(c, np.zeros(1 << self.CHUNK, dtype=bool))[np.frombuffer(at, "<u4")] = True
            for c, x in sums.items():
                yield pa.record_batch([pa.array([c], pa.int32()), pa.array([np.packbits(x).tobytes()], pa.binary())], names=["chunk", "at"])

        parts = keys.mapInArrow(lean(mark), "chunk int, at binary").repartition(16, "chunk").mapInArrow(lean(merge), "chunk int, at binary").collect()
        self.map = np.zeros(1 << (bits - 3), dtype=np.uint8)
        size = 1 << (self.CHUNK - 3)
        for r in parts:
            self.map[r.chunk * size : (r.chunk + 1) * size] = np.frombuffer(r["at"], dtype=np.uint8)

    def __getstate__(self):
        return {"bits": self.bits, "map": getattr(self, "map", None)}

    def __setstate__(self, state):
        self.__dict__.update(state)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = mixed(keys.view(np.uint64))
        return x >> np.uint64(64 - self.bits), mixed(x + np.uint64(1)) >> np.uint64(64 - self.bits)

    def has(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), dtype=bool)
        for at in self._places(keys):
            found &= (self.map[(at >> np.uint64(3)).astype(np.int64)] >> (7 - (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
        return found

    def test(self, key: Column) -> Column:
        """has() of a column of longs."""
        shared = SparkSession.active().sparkContext.broadcast(self)
        return F.pandas_udf(lambda s: pd.Series(shared.value.has(s.to_numpy())), "boolean")(key)
