"""Groups of candidates: connected components, and their members brought together in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertebra.llm.common import lean, saved

#: Rows and bytes of a block, about; and rows that tasks take together when places are small.
BLOCK_ROWS, BLOCK_BYTES, BATCH_ROWS = 1024, 8 << 20, 2048


def components(links: DataFrame) -> DataFrame:
    """(key, root): each linked key and the smallest key that it is connected with.

    Every round, each key takes the smallest root among its own and its neighbours', then its root's root; the tables of
    links and roots stay distributed, and each round's is written, so that no lineage grows.
    """
    both = saved(links.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("l")).select("l.a", "l.b").distinct())
    roots = saved(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "key"))
    while True:
        near = both.join(roots, both["b"] == roots["key"]).groupBy("a").agg(F.min("root").alias("near"))
        step = roots.join(near, roots["key"] == near["a"]).select("key", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        up = roots.select(F.col("key").alias("root"), F.col("root").alias("up"))
        done = saved(step.join(up, "root").select("key", "was", F.col("up").alias("root")))
        changed = done.where("was <> root").limit(1).count()
        roots = done.select("key", "root")
        if not changed:
            return roots


def merged(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after the pairs (i, j) are joined, in place: each component has its smallest index as label."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def together(items: DataFrame, sizes: DataFrame, parts: int) -> DataFrame:
    """Adds place, lo, hi and own to items, once per place; rows of a place are then sorted behind each other.

    items has key and group, sizes a row (group, size in bytes) for each row of items, without the rest. A group's rows are dealt to blocks by key, and each pair of blocks
    (lo <= hi) is a place that holds both blocks' rows; own is the row's block. So any two rows of a group share the place
    (lo, hi) of their blocks. No place holds more than about 2 BLOCK_ROWS rows or 2 BLOCK_BYTES bytes (or two rows, if they
    are longer), and what is sent of a group of n rows is n times its blocks.
    """
    sizes = sizes.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_ROWS), F.ceil(F.col("total") / BLOCK_BYTES), F.lit(1)).cast("int")
    large = saved(sizes.select("group", blocks.alias("blocks")).where("blocks > 1"))
    df = items.join(large, "group", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    df = df.withColumn("own", F.pmod(F.xxhash64(F.lit(5), "key"), F.col("blocks")).cast("int"))
    df = df.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    df = df.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")}).withColumn("place", F.xxhash64("group", "lo", "hi")).drop("blocks", "other")
    return df.repartition(parts, "place").sortWithinPartitions("place", "group", "lo", "hi")


def starts(t: pa.Table) -> np.ndarray:
    """Where the rows of each place begin in a sorted table or batch, and its length."""
    new = np.zeros(len(t), dtype=bool)
    for c in ("place", "group", "lo", "hi"):
        v = t.column(c).to_numpy(zero_copy_only=False) if isinstance(t, pa.RecordBatch) else t.column(c).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.concatenate([[0], np.flatnonzero(new), [len(t)]]).astype(np.int64)


def places(batches) -> Iterator[pa.Table]:
    """Tables of whole places from sorted batches: at least BATCH_ROWS rows each, but no more than one place beyond it."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not len(b):
            continue
        held.append(b)
        t = pa.Table.from_batches(held).combine_chunks()
        cut = starts(t)
        at = 0
        for end in cut[1:-1].tolist():
            if end - at >= BATCH_ROWS:
                yield t.slice(at, end - at).combine_chunks()
                at = end
        held = t.slice(at).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def pairs_of(cut: np.ndarray, least: int = 2, most: int = 1 << 30) -> tuple[np.ndarray, np.ndarray]:
    """All pairs i < j of rows of one place, for places of least to most rows."""
    sizes = np.diff(cut)
    sizes = np.where((sizes >= least) & (sizes <= most), sizes, 0)
    end = np.repeat(cut[:-1] + sizes, np.diff(cut))
    many = np.maximum(end - np.arange(cut[-1]) - 1, 0)
    i = np.repeat(np.arange(cut[-1]), many)
    return i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)


def in_common(first: np.ndarray, values: np.ndarray, i: np.ndarray, j: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """How many values the rows i[k] and j[k] share. Row r holds values[first[r]:first[r + 1]], all different."""
    _, ids = np.unique(values, return_inverse=True)
    wide = int(ids.max(initial=0)) + 1
    size = np.diff(first)
    held = np.sort(np.repeat(np.arange(len(size)), size) * wide + ids)
    out, cuts, at = np.zeros(len(i), dtype=np.int64), np.cumsum(size[i]), 0
    while at < len(i):
        to = max(at + 1, int(np.searchsorted(cuts, (cuts[at - 1] if at else 0) + most, side="right")))
        m = size[i[at:to]]
        pair = np.repeat(np.arange(to - at), m)
        asked = j[at:to][pair] * wide + ids[np.repeat(first[i[at:to]], m) + np.arange(len(pair)) - np.repeat(np.cumsum(m) - m, m)]
        found = held[np.minimum(np.searchsorted(held, asked), len(held) - 1)] == asked if len(held) else np.zeros(len(asked), dtype=bool)
        out[at:to] = np.bincount(pair[found], minlength=to - at)
        at = to
    return out


def here(t: pa.Table, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether this is the one place where the rows i and j of one place count as a pair.

    Rows of one block count where the block is alone; rows that share several groups (column groups) count in the least.
    """
    lo, hi, own = (t.column(c).to_numpy() for c in ("lo", "hi", "own"))
    ok = (lo[i] == hi[i]) | (own[i] != own[j])
    lists = t.column("groups").combine_chunks()
    size = np.diff(lists.offsets.to_numpy())
    if len(size) and size.max(initial=0) > 1:
        group, flat = t.column("group").to_numpy(), lists.flatten().to_numpy()
        row = np.repeat(np.arange(len(size)), size)
        less = flat < group[row]
        first = np.searchsorted(row[less], np.arange(len(size) + 1))
        many = np.flatnonzero(ok & (np.diff(first)[i] > 0) & (np.diff(first)[j] > 0))
        if len(many):
            ok[many] = in_common(first, flat[less], i[many], j[many]) == 0
    return ok


def handled(items: DataFrame, sizes: DataFrame, work: Callable[[pa.Table, np.ndarray], pa.RecordBatch], schema: str, parts: int) -> DataFrame:
    """work(rows of some whole places, where those begin) for all places of items' groups, in tasks; rows of what it returns."""

    def run(batches):
        for t in places(batches):
            r = work(t, starts(t))
            if len(r):
                yield r

    return together(items, sizes, parts).mapInArrow(lean(run), schema)
