"""Removal of repeated passages by relative Lempel-Ziv parsing against an index of all documents."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertebra.llm.common import WORD, Bloom, Words, beside, buffers, grams, lean, saved, slices


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Smallest value of each run of n values, by doubling run lengths."""
    size, out = 1, x
    while size < n:
        step = min(size, n - size)
        out = np.minimum(out[:-step], out[step:])
        size += step
    return out


def anchors(runs: np.ndarray, at: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """Indexes of the runs that are the smallest of any n consecutive ones of a text (all runs of fewer).

    Which runs of a passage are chosen depends on its words alone: each passage of n + k - 1 words has an anchor, the
    same one wherever the passage stands.
    """
    chosen = []
    cuts = np.searchsorted(at, first)
    for i in range(len(first) - 1):
        own = runs[cuts[i] : cuts[i + 1]]
        if not len(own):
            continue
        w = min(n, len(own))
        low = sliding_min(own, w)
        pad = np.zeros(w - 1, dtype=np.uint64)
        high = ~sliding_min(~np.concatenate([pad, low, pad]), w)
        chosen.append(cuts[i] + np.flatnonzero(high == own))
    return np.concatenate(chosen) if chosen else np.zeros(0, dtype=np.int64)


def factors(found: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Greedy parse: (start, end) in words of each factor, from the sorted starts of windows that the index holds.

    A factor takes in the next window while that too is in the index; where it ends, the next one starts at the next
    window found, which may lie inside it: windows across factor boundaries have been looked up like all others.
    """
    if not len(found):
        return []
    cut = np.flatnonzero(np.diff(found) > 1) + 1
    return [(int(p[0]), int(p[-1]) + window) for p in np.split(found, cut)]


@beside(("doc_id", "text"), ("n_words", "n_removed", "kept_sha256", "spans", "kept_text"))
def parse(docs: DataFrame, window: int = 35, run: int = 8, with_text: bool = False) -> DataFrame:
    """Adds n_words, n_removed, kept_sha256, spans (array of [start, end) in words) and, if asked, kept_text to each row.

    A word is removed if a window of `window` words over it also starts anywhere else in all documents.

    1. Equal texts become one text with a count; in a text found twice each window is repeated.
    2. The reference index: anchors, runs of `run` words that are locally smallest by hash, of every text. Only anchors
       found twice can lie in a repeated window, and each repeated window has one.
    3. Windows over such anchors are looked up, by 80-bit fingerprints, among all such windows of all texts.
    4. Each text is parsed greedily into factors made of windows found. The text's own fingerprints at those places must
       add up to those that were found, or its 64-bit id was another text's too and it keeps its words.
    Hot passages are counted before shuffles, never gathered. Rows of null or blank texts have no words and keep none.
    """
    ours = ["n_words", "n_removed", "kept_sha256", "spans", "kept_text"]
    docs = docs.select(*[c for c in docs.columns if c not in ours])
    key = F.when(F.col("text").rlike(WORD), F.unhex(F.md5("text")))
    texts = docs.select(key.alias("key"), "text").where("key is not null").groupBy("key").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    texts = texts.select("text", F.xxhash64("key").alias("id"), "key", "copies")
    reach = window - run + 1
    # Each step below takes all columns of texts, so that they share one shuffle of the texts.

    def find_anchors(batches, wanted=None):
        for part in slices(batches, 0):
            words = Words(*buffers(part.column(0)))
            runs, at = grams(words.hashes(), words.first, run)
            chosen = anchors(runs, at, words.first, reach)
            if wanted is not None:
                chosen = chosen[wanted.value.has(runs[chosen].view(np.int64))]
            text = np.searchsorted(words.first, at[chosen], side="right") - 1
            ids = part.column(1).to_numpy()[text]
            yield pa.record_batch([pa.array(runs[chosen].view(np.int64)), pa.array(ids), pa.array((at[chosen] - words.first[text]).astype(np.int32))], names=["anchor", "id", "at"])

    schema = "anchor long, id long, at int"
    twice = saved(texts.mapInArrow(lean(find_anchors), schema).groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"))
    likely = docs.sparkSession.sparkContext.broadcast(Bloom(twice))
    anchored = texts.mapInArrow(lean(lambda batches: find_anchors(batches, likely)), schema)
    open_ = anchored.join(twice, "anchor").groupBy("id").agg(F.collect_list("at").alias("at"))

    def find_windows(batches):
        for part in slices(batches, 0):
            words = Words(*buffers(part.column(0)))
            hashes = words.hashes()
            one, at = grams(hashes, words.first, window)
            two, _ = grams(hashes, words.first, window, 2)
            text = np.searchsorted(words.first, at, side="right") - 1
            rel = at - words.first[text]
            marks = np.zeros(len(hashes) + 1, dtype=np.int32)
            lists = part.column(2)
            spots = np.asarray(lists.flatten(), dtype=np.int64) + np.repeat(words.first[:-1], np.asarray(pc.list_value_length(lists), dtype=np.int64))
            marks[spots + 1] = 1
            held = np.cumsum(marks)
            ok = held[np.minimum(at + reach, len(hashes))] > held[at]
            ids = part.column(1).to_numpy()[text[ok]]
            yield pa.record_batch([pa.array(one[ok].view(np.int64)), pa.array((two[ok] >> np.uint64(48)).astype(np.int32)), pa.array(ids), pa.array(rel[ok].astype(np.int32))], names=["w1", "w2", "id", "at"])

    by_id = texts.select("id", "key").join(open_, "id").select("key", F.col("at").alias("spots"))
    windows = texts.join(by_id, "key").select("text", "id", "spots", "copies").mapInArrow(lean(find_windows), "w1 long, w2 int, id long, at int")
    again = windows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("w1", "w2")
    repeated = windows.join(again, ["w1", "w2"]).groupBy("id").agg(F.sort_array(F.collect_list("at")).alias("found"), F.bit_xor("w1").alias("proof"))
    found = texts.select("id", "key").join(repeated, "id").select("key", "found", "proof")
    results = texts.join(found, "key", "left").select("text", "key", "copies", "found", "proof", "id")

    def finish(batches):
        for part in slices(batches, 0):
            data, offsets = buffers(part.column(0))
            words = Words(data, offsets)
            one, at = grams(words.hashes(), words.first, window)
            sets, copies, proofs = part.column(3), part.column(2).to_pylist(), part.column(4).to_pylist()
            n_words = np.diff(words.first)
            removed, sha, spans, texts = [], [], [], []
            for i, n in enumerate(n_words.tolist()):
                cuts: list[tuple[int, int]] = []
                if n >= window and copies[i] > 1:
                    cuts = [(0, n)]
                elif sets[i].is_valid:
                    starts = sets[i].values.to_numpy()
                    own = one[np.searchsorted(at, words.first[i]) :]
                    if starts[-1] + window <= n and int(np.bitwise_xor.reduce(own[starts].view(np.int64))) == proofs[i]:
                        cuts = factors(starts, window)
                gone = np.zeros(n, dtype=bool)
                for a, b in cuts:
                    gone[a:b] = True
                w = words.first[i] + np.flatnonzero(~gone)
                raw = data.data
                kept = b" ".join([raw[s:e] for s, e in zip(words.start[w].tolist(), words.end[w].tolist(), strict=True)])
                removed.append(int(gone.sum()))
                sha.append(hashlib.sha256(kept).hexdigest())
                spans.append([list(c) for c in cuts])
                if with_text:
                    texts.append(kept.decode())
            arrays = [part.column(1), pa.array(n_words.astype(np.int64)), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(spans, pa.list_(pa.list_(pa.int32())))]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(texts, pa.string())] * with_text, names=["__key", *ours[: 4 + with_text]])

    done = results.mapInArrow(lean(finish), "__key binary, n_words long, n_removed long, kept_sha256 string, spans array<array<int>>" + ", kept_text string" * with_text)
    out = docs.withColumn("__key", key).join(done, "__key", "left").drop("__key")
    empty = hashlib.sha256(b"").hexdigest()
    none = {"n_words": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long"), "kept_sha256": F.lit(empty), "spans": F.array().cast("array<array<int>>")}
    if with_text:
        none["kept_text"] = F.lit("")
    return out.withColumns({c: F.coalesce(F.col(c), v) for c, v in none.items()})
