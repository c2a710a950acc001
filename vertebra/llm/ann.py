"""Approximate nearest neighbours: a hierarchical k-means tree searched best bin first."""

from __future__ import annotations

import hashlib
import heapq
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vertebra.llm.common import few_or_plain, lean


@dataclass
class Tree:
    """centres: one row per node but the root. children[node]: (first, past the last) row of its children's centres; leaves have none."""

    centres: np.ndarray
    children: dict[int, tuple[int, int]]
    leaves: int
    leaf_of: dict[int, int]

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each unit vector, by descent to the nearest centre at each level."""
        node = np.full(len(x), -1)
        todo = np.ones(len(x), dtype=bool)
        while todo.any():
            for n in np.unique(node[todo]):
                if int(n) not in self.children:
                    todo &= node != n
                    continue
                a, b = self.children[int(n)]
                mine = todo & (node == n)
                node[mine] = a + (x[mine] @ self.centres[a:b].T).argmax(axis=1)
        return np.array([self.leaf_of[int(n)] for n in node], dtype=np.int64)

    def nearest_leaves(self, q: np.ndarray, n: int, rows: np.ndarray | None = None, least: int = 0) -> list[int]:
        """The first n leaves that best-bin-first traversal visits for a unit vector, and more until they hold `least` rows."""
        near, out, heap, held = self.centres @ q, [], [(0.0, -1)], 0
        while heap and (len(out) < n or held < least):
            _, node = heapq.heappop(heap)
            if node in self.children:
                a, b = self.children[node]
                for c in range(a, b):
                    heapq.heappush(heap, (-float(near[c]), c))
            else:
                out.append(self.leaf_of[node])
                held += 0 if rows is None else int(rows[out[-1]])
        return out


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means; (centres, cluster of each row). Equal rows may leave fewer than k centres."""
    x = x[:]
    c = np.unique(x[rng.permutation(len(x))[: 4 * k]], axis=0)
    c = c[rng.permutation(len(c))[:k]]
    for _ in range(rounds):
        at = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), c)
    return c, (x @ c.T).argmax(axis=1)


def grow(sample: np.ndarray, branches: int, leaf_rows: int, most_leaves: int, seed: int = 3) -> Tree:
    """A tree over a sample of unit vectors; nodes with more than leaf_rows sample rows are split while leaves remain."""
    rng = np.random.default_rng(seed)
    centres: list[np.ndarray] = []
    children: dict[int, tuple[int, int]] = {}
    heap, leaves = [(-len(sample), -1, np.arange(len(sample)))], 1
    done = []
    while heap:
        n, node, rows = heapq.heappop(heap)
        if -n > leaf_rows and leaves + branches - 1 <= most_leaves:
            c, at = kmeans(sample[rows], branches, rng)
            if len(c) > 1:
                a = sum(len(x) for x in centres)
                centres.append(c)
                children[node] = (a, a + len(c))
                leaves += len(c) - 1
                for i in range(len(c)):
                    heapq.heappush(heap, (-int((at == i).sum()), a + i, rows[at == i]))
                continue
        done.append(node)
    every = np.concatenate(centres) if centres else np.zeros((0, sample.shape[1]))
    return Tree(every, children, len(done), {n: i for i, n in enumerate(sorted(done))})


def calibrate(tree: Tree, sample: np.ndarray, k: int, recall: float, queries: int = 256) -> int:
    """How many leaves to visit so that the sample's own k nearest are found with this recall, against brute force."""
    n = min(queries, len(sample))
    sim = sample[:n] @ sample.T
    sim[np.arange(n), np.arange(n)] = -9
    k = min(k, len(sample) - 1)
    if k < 1:
        return tree.leaves
    best = np.argpartition(-sim, k - 1, axis=1)[:, :k]
    leaf = tree.assign(sample)
    needed = np.zeros(tree.leaves + 1)
    for i in range(n):
        place = {x: r for r, x in enumerate(tree.nearest_leaves(sample[i], tree.leaves))}
        for j in best[i]:
            needed[place[int(leaf[j])] + 1] += 1
    found = np.cumsum(needed) / needed.sum()
    return int(min(np.searchsorted(found, recall - 1e-12), tree.leaves))


def usable(vectors: DataFrame, column: str) -> DataFrame:
    """Rows (vec_id, v) that take part: v not null, of the commonest length, finite, not zero."""
    v = F.col(column).cast("array<double>")
    fine = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(fine)
    common = rows.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "n").limit(1).collect()
    return rows.where(F.size("v") == (common[0].n if common else 0))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, first by the largest component so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def search(vectors: DataFrame, column: str = "embedding", every: int = 50, k: int = 5, recall: float = 0.97, sample_rows: int = 8192, branches: int = 8, leaf_rows: int = 64, most_leaves: int = 128, block_rows: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest by cosine of each row whose vec_id is divisible by `every`.

    The tree is grown from about sample_rows rows chosen by a hash of the row, and the number of leaves to visit is set on
    that sample, but a query goes on until its leaves hold k rows besides those of its own vec_id; all rows are indexed. A leaf's rows are dealt to blocks of about block_rows, so that a vector that holds
    a third of all rows is many blocks; queries meet a block together, as one product of matrices. Candidates that tie
    with a block's k-th are all scored again, row by row in double precision, so equal vectors get equal scores and ties
    go to the smaller vec_id. Vectors that are null, zero, of another than the commonest length or not finite take no
    part; fewer than k candidates are all returned; no vectors give no rows. A row of the query's own vec_id is no candidate.
    Rows that share a query's vec_id are one query, near to a candidate as the nearest of them is. Each row is a candidate
    once, so repeated rows are returned as often as they stand in the table.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, column)
    total = rows.count()
    pick = F.pmod(F.xxhash64(F.lit(11), "vec_id", "v"), F.lit(1 << 30)) < sample_rows / max(total, 1) * (1 << 30)
    taken = rows.where(pick).select("v").distinct().toArrow()["v"].to_pylist()
    schema = "query_id long, rank int, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], schema)
    sample = unit(np.array(taken or rows.select("v").limit(1).toArrow()["v"].to_pylist(), dtype=np.float64))
    sample = sample[np.lexsort(sample.T)]
    sample = sample[np.random.default_rng(1).permutation(len(sample))]
    tree = grow(sample, branches, leaf_rows, most_leaves)

    def count(batches):
        for b in batches:
            if len(b):
                leaf, n = np.unique(tree.assign(unit(np.array(b.column(0).flatten()).reshape(len(b), -1))), return_counts=True)
                yield pa.record_batch([pa.array(leaf), pa.array(n)], names=["leaf", "n"])

    held = np.zeros(tree.leaves, dtype=np.int64)
    for r in rows.select("v").mapInArrow(lean(count), "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).collect():
        held[r.leaf] = r.n
    shared = spark.sparkContext.broadcast((tree, calibrate(tree, sample, k, recall), held))
    packed = "leaf long, vec_id long, v binary"

    def index(batches):
        tree = shared.value[0]
        for b in batches:
            if len(b):
                x = np.array(b.column(1).flatten()).reshape(len(b), -1)
                yield pa.record_batch([pa.array(tree.assign(unit(x))), b.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["leaf", "vec_id", "v"])

    def visits(batches):
        tree, n, held = shared.value
        for b in batches:
            if len(b):
                x = np.array(b.column(1).flatten()).reshape(len(b), -1)
                lists = [tree.nearest_leaves(q, n, held, k + own) for q, own in zip(unit(x), b.column(2).to_pylist(), strict=True)]
                which = np.repeat(np.arange(len(b)), [len(y) for y in lists])
                raw = [r.tobytes() for r in x]
                yield pa.record_batch([pa.array([z for y in lists for z in y], pa.int64()), b.column(0).take(pa.array(which)), pa.array([raw[i] for i in which], pa.binary())], names=["leaf", "vec_id", "v"])

    def blocks(df: DataFrame) -> DataFrame:
        """(leaf, part, ids, vs) with about block_rows rows each; the counts are one row per leaf."""
        sizes = df.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("parts"))
        part = F.pmod(F.xxhash64(F.lit(7), "vec_id", "v"), F.col("parts")).cast("int")
        dealt = df.join(few_or_plain(sizes, most_leaves), "leaf").withColumn("part", part)
        return dealt.groupBy("leaf", "part").agg(F.collect_list(F.struct("vec_id", "v")).alias("rows"))

    indexed = blocks(rows.mapInArrow(lean(index), packed))
    queries = rows.where(F.col("vec_id") % every == 0)
    own = queries.groupBy("vec_id").agg(F.count(F.lit(1)).alias("own")).where("own > 1")
    queries = queries.dropDuplicates(["vec_id", "v"]).join(own, "vec_id", "left").select("vec_id", "v", F.coalesce("own", F.lit(1)).alias("own"))
    asked = blocks(queries.mapInArrow(lean(visits), packed))
    pairs = indexed.select("leaf", F.col("rows").alias("c")).join(asked.select("leaf", F.col("rows").alias("q")), "leaf")

    def compare(frames):
        for f in frames:
            for cs, qs in zip(f["c"], f["q"], strict=True):
                ids, x = np.array([r["vec_id"] for r in cs]), np.array([np.frombuffer(r["v"]) for r in cs])
                qids, q = np.array([r["vec_id"] for r in qs]), np.array([np.frombuffer(r["v"]) for r in qs])
                marks = [int.from_bytes(hashlib.blake2b(r["v"], digest_size=8).digest(), "little", signed=True) for r in cs]
                times: Counter = Counter()
                copy = []
                for z in zip(ids.tolist(), marks, strict=True):  # equal rows share a block
                    copy.append(times[z])
                    times[z] += 1
                ux, uq = unit(x), unit(q)
                sim = uq @ ux.T
                sim[qids[:, None] == ids[None, :]] = -9
                out: list[tuple] = []
                for i in range(len(qids)):
                    s = sim[i]
                    least = np.partition(s, -k)[-k] - 1e-9 if len(s) > k else -2
                    near = np.flatnonzero((s >= least) & (s > -9))
                    exact = (ux[near] * uq[i]).sum(axis=1)
                    order = np.lexsort((ids[near], -exact))[:k]
                    out += zip([qids[i]] * len(order), [marks[x] for x in near[order]], [copy[x] for x in near[order]], ids[near][order], exact[order], strict=True)
                yield pd.DataFrame(out, columns=["query_id", "mark", "copy", "vec_id", "score"])

    found = pairs.mapInPandas(compare, "query_id long, mark long, copy int, vec_id long, score double")
    found = found.repartition("query_id").groupBy("query_id", "vec_id", "mark", "copy").agg(F.max("score").alias("score"))
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
