"""Near-duplicate documents by Order MinHash, verified by banded alignment."""

from __future__ import annotations

from bisect import bisect_left
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertebra.llm.common import WORD, Bloom, Words, buffers, grams, lean, mixed, saved, slices
from vertebra.llm.groups import components, handled, here

#: Longs of a text's parity bits.
PARITY_WORDS = 8
#: Pairs that are aligned before those that links have connected are left out again.
BATCH = 64

_SEEDS = np.random.default_rng(77).integers(1, 2**63, size=64, dtype=np.uint64)


def labelled(hashes: np.ndarray) -> np.ndarray:
    """Each k-mer's hash mixed with how often it came before in the text, so that all are different."""
    order = np.argsort(hashes, kind="stable")
    s = hashes[order]
    if not len(s) or not (s[1:] == s[:-1]).any():
        return hashes
    start = np.concatenate([[True], s[1:] != s[:-1]])
    first = np.maximum.accumulate(np.where(start, np.arange(len(s)), 0))
    times = np.empty(len(s), dtype=np.uint64)
    times[order] = (np.arange(len(s)) - first).astype(np.uint64)
    return np.where(times > 0, mixed(hashes + times * np.uint64(0x9E3779B97F4A7C15)), hashes)


def shingles(words: Words, k: int):
    """For each text, the labelled hashes of its runs of k words; a text with fewer words is one run."""
    hashes = words.hashes()
    runs, at = grams(hashes, words.first, k)
    first = np.searchsorted(at, words.first)
    for i in range(len(words.first) - 1):
        own = runs[first[i] : first[i + 1]]
        if not len(own) and words.first[i + 1] > words.first[i]:
            own = mixed(np.array([np.bitwise_xor.reduce(mixed(hashes[words.of(i)] + np.arange(words.first[i + 1] - words.first[i], dtype=np.uint64)))], dtype=np.uint64))
        yield labelled(own)


def sketches(own: np.ndarray, m: int, l: int) -> np.ndarray:
    """m hashes, each of the l k-mers with the smallest values under one seed, in text order (all k-mers, if fewer).

    Texts of many k-mers first leave out those whose values can't be among the smallest, seed by seed.
    """
    out = np.arange(1, m + 1, dtype=np.uint64)
    if len(own) > l:
        chosen = np.empty((m, l), dtype=np.uint64)
        for r in range(m):
            x = (own ^ _SEEDS[r]) * np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(32)
            x *= np.uint64(0xD6E8FEB86659FD93)
            if len(x) > 64 * l:
                low = np.flatnonzero(x < np.uint64(2**63 // len(x) * 8 * l))
                at = low[np.argpartition(x[low], l - 1)[:l]] if len(low) > l else np.argpartition(x, l - 1)[:l]
            else:
                at = np.argpartition(x, l - 1)[:l]
            at.sort()
            chosen[r] = own[at]
    else:
        chosen = np.broadcast_to(own, (m, len(own)))
    for c in range(chosen.shape[1]):
        out = mixed(out ^ chosen[:, c])
    return out


def shortened(own: np.ndarray, least: float) -> tuple[list[int], list[int]]:
    """Hashes of the sequence of k-mers with every few of them left out, and how many those are.

    Of a text's n k-mers at most n (1 - least) are unmatched in a pair of that similarity. So such a pair has a hash in
    common: that of the matched k-mers.
    """
    out, gone = [], []
    for d in range(int(len(own) * (1 - least) + 1e-9) + 1):
        for kept in combinations(own, len(own) - d):
            h = np.uint64(0)
            for v in kept:
                h = mixed_one(h ^ v)
            out.append(int(h.view(np.int64)))
            gone.append(d)
    return out, gone


def mixed_one(x: np.uint64) -> np.uint64:
    y = int(x)
    y = (y ^ (y >> 30)) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
    y = (y ^ (y >> 27)) * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF
    return np.uint64(y ^ (y >> 31))


def parities(own: np.ndarray) -> np.ndarray:
    """PARITY_WORDS longs: a bit flipped for each k-mer. Two texts differ in at least as many k-mers as these do in bits."""
    flips = np.bincount((own & np.uint64(64 * PARITY_WORDS - 1)).astype(np.int64), minlength=64 * PARITY_WORDS) & 1
    return np.packbits(flips.astype(np.uint8)).view(np.int64)


def aligned(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """Similarity of two sequences of labelled k-mers: matches of the best alignment by those in either.

    k-mers of a text are all different, so the best alignment is the longest run of matches that rises in both texts.
    The band holds what any alignment of at least this similarity can reach: its path leaves the diagonal by unmatched
    k-mers only, and they can be so many at most. Returns 0 where the similarity is surely below.
    """
    n, m = len(a), len(b)
    if not n or not m or min(n, m) < least * max(n, m):
        return 0.0
    band = int((n + m) * (1 - least) / (1 + least)) + 1
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    near = np.abs(i - j) <= band
    i, j = i[near], j[near]
    if len(i) < least * (n + m - len(i)):
        return 0.0
    j = j[np.argsort(i)]
    if (j[1:] > j[:-1]).all():
        best = len(j)
    else:
        tails: list[int] = []
        for y in j.tolist():
            p = bisect_left(tails, y)
            if p == len(tails):
                tails.append(y)
            else:
                tails[p] = y
        best = len(tails)
    return best / (n + m - best)


def verified(texts: DataFrame, sizes: DataFrame, k: int, least: float, parts: int) -> DataFrame:
    """(a, b): links that connect the texts (group, groups, key, text) of each group that align with this similarity.

    A place's texts meet in rounds: pairs whose counts and parities of runs show that they can't be similar enough are
    dropped by an exact bound; of the others, those with the fewest bits apart are aligned first, and pairs that links
    have connected by then are left out. So many copies of one text take about one alignment each.
    """

    def work(t: pa.Table, cut: np.ndarray) -> pa.RecordBatch:
        runs: list[np.ndarray] = []
        for part in slices(t.select(["text"]).to_batches(), 0):
            runs += list(shingles(Words(*buffers(part.column(0))), k))
        n = np.array([len(x) for x in runs])
        bits = np.stack([parities(x) for x in runs]).view(np.uint64)
        label = np.arange(len(n))
        a: list[int] = []
        b: list[int] = []
        for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            i, j, far = possible(n[x:y], bits[x:y], least)
            if not len(i):
                continue
            ok = here(t, i + x, j + x)
            i, j, far = i[ok] + x, j[ok] + x, far[ok]
            order = np.argsort(far, kind="stable")
            i, j = i[order], j[order]
            while len(i):
                apart = label[i] != label[j]
                i, j = i[apart], j[apart]
                for u, v in zip(i[:BATCH].tolist(), j[:BATCH].tolist(), strict=True):
                    if label[u] != label[v] and aligned(runs[u], runs[v], least) >= least:
                        a.append(u)
                        b.append(v)
                        low, high = sorted((label[u], label[v]))
                        label[x:y][label[x:y] == high] = low
                i, j = i[BATCH:], j[BATCH:]
        keys = t.column("key").combine_chunks()
        return pa.record_batch([keys.take(pa.array(z, pa.int64())) for z in (a, b)], names=["a", "b"])

    return handled(texts, sizes, work, "a binary, b binary", parts)


def possible(n: np.ndarray, bits: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs i < j of texts that can be that similar by counts and parities of their runs, and how many bits are apart.

    With matches / (n + m - matches) >= least, at most (n + m) (1 - least) / (1 + least) runs are unmatched.
    """
    out = []
    for i in range(len(n) - 1):
        m = n[i + 1 :]
        far = np.bitwise_count(bits[i] ^ bits[i + 1 :]).sum(axis=1)
        j = np.flatnonzero((np.minimum(n[i], m) >= np.maximum(n[i], m) * least - 1e-6) & (far <= (n[i] + m) * ((1 - least) / (1 + least)) + 1e-6))
        if len(j):
            out.append((np.full(len(j), i), j + i + 1, far[j].astype(np.int64)))
    return tuple(np.concatenate([o[c] for o in out]) if out else np.zeros(0, dtype=np.int64) for c in range(3))


def grouped(docs: DataFrame, k: int = 5, least: float = 0.8, m: int = 24, l: int = 5) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """For near_duplicates(): rows (doc_id, text, key), texts (key, first_id, ...), roots (key, root) of linked texts, links (a, b)."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", "text").withColumn("key", F.when(F.col("text").rlike(WORD), F.unhex(F.md5("text"))))

    def sketch(batches):
        for part in slices(batches, 0):
            words = Words(*buffers(part.column(0)))
            out, sizes, short = [], [], []
            for s in shingles(words, k):
                # a text similar to one of at most 2 l * least runs has at most 2 l, so it is met exactly
                out.append(sketches(s, m, l).view(np.int64) if len(s) > 2 * l * least + 1e-9 else [])
                short.append(shortened(s, least) if len(s) <= 2 * l else ([], []))
                sizes.append(len(s))
            less = [pa.array([x[i] for x in short], pa.list_(t)) for i, t in enumerate((pa.int64(), pa.int32()))]
            size = pa.array(np.diff(words.offsets), pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array(out, pa.list_(pa.int64())), *less, pa.array(sizes, pa.int32()), size], names=["key", "doc_id", "sketch", "short", "gone", "n", "size"])

    made = rows.where("key is not null").select("text", "key", F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(lean(sketch), "key binary, doc_id long, sketch array<long>, short array<long>, gone array<int>, n int, size long")
    firsts = [F.first(c).alias(c) for c in ("sketch", "short", "gone", "n", "size")]
    texts = saved(made.groupBy("key").agg(F.min("doc_id").alias("first_id"), *firsts))
    listed = texts.select("key", F.posexplode("sketch").alias("r", "h")).select("key", F.xxhash64("r", "h").alias("list"))
    heads = listed.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("head")).where("n > 1")
    less = texts.select("key", "n", F.explode(F.arrays_zip("short", "gone")).alias("x")).select("key", F.col("x.short").alias("h"), F.col("x.gone").alias("d"), (F.col("n") - F.col("x.gone")).alias("left"))
    spare = F.floor(F.col("left") * ((1 - least) / least) + 1e-9)
    fewest = less.groupBy("h", "left").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("d", "key")).alias("head")).where((F.col("n") > 1) & (2 * F.col("head.d") <= spare))
    met = less.join(saved(fewest.select("h", "left", "head")), ["h", "left"]).where((F.col("key") != F.col("head.key")) & (F.col("d") + F.col("head.d") <= spare))
    short = met.select(F.explode(F.array("key", "head.key")).alias("key"), F.col("head.key").alias("group"))
    led = saved(listed.join(saved(heads), "list").select("key", F.col("head").alias("group")).union(short).distinct())
    low = led.groupBy("key").agg(F.min("group").alias("least"))
    names = led.join(low, "key").groupBy("group").agg(F.min("least").alias("name"))
    led = saved(led.join(names, "group").select("key", F.col("name").alias("group")).distinct())

    wanted = led.groupBy("key").agg(F.collect_set(F.xxhash64("group")).alias("groups"))
    wanted = saved(wanted.join(texts.select("key", "first_id", "size"), "key").select("key", "groups", "size", F.coalesce("first_id", F.lit(-(2**63))).alias("id")))
    source = rows.where("key is not null").select("key", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("id"), "text")
    source = source.where(Bloom(wanted.select(F.xxhash64("key", "id"))).test(F.xxhash64("key", "id")))
    members = source.join(wanted.select("key", "id", "groups"), ["key", "id"]).dropDuplicates(["key"])
    members = members.select(F.explode("groups").alias("group"), "groups", "key", "text")
    links = saved(verified(members, wanted.select(F.explode("groups").alias("group"), "size"), k, least, parts))
    return rows, texts, components(links), links


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, class_id, n_links, n_texts), one row per document: class_id is the smallest doc_id of its class.

    Documents with equal texts are one text from the start. Each text has m sketches of its l smallest labelled runs of k
    words, in text order; texts that share a sketch are candidates, and candidates whose runs align with a similarity of
    at least `least` are linked. Texts of at most 2 l runs also meet exactly, by what is left without the few runs that such
    a similarity spares; who is similar enough to anyone there is so to the text with the fewest left out, and meets that one. A class is what links connect; n_links counts verified links of the document's text that
    the search needed, n_texts the different texts of its class.

    No list of a sketch is expanded into pairs. A list goes by its smallest text, or by the smallest of any that its texts'
    lists go by; under that name its texts are sent once, in blocks of bounded size of which any two meet, and are compared
    there until links connect all that are similar. So no link between classes is left out, whatever the list's size.

    Texts without a word (null too) are classes of their own. A null doc_id is the smallest of its class only if all are.
    Columns but doc_id and text are not looked at; repeated rows come back as often; an empty table gives none.
    """
    rows, texts, roots, links = grouped(docs, **options)
    degree = links.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n_links"))
    member = texts.join(roots, "key").select("key", "root", "first_id")
    classes = member.groupBy("root").agg(F.min("first_id").alias("class_id"), F.count(F.lit(1)).alias("n_texts"))
    by_text = texts.select("key", "first_id").join(roots, "key", "left").join(classes, "root", "left").join(degree, "key", "left")
    by_text = by_text.select("key", F.coalesce("class_id", "first_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_texts", F.lit(1)).alias("n_texts"))
    out = rows.select("doc_id", "key").join(by_text, "key", "left")
    return out.select("doc_id", F.coalesce("class_id", F.col("doc_id").cast("long")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_texts", F.lit(1)).cast("long").alias("n_texts"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that lead their class: of its texts the one with the smallest doc_id (null last, then by the
    text's hash), in the row with that doc_id; of equal such rows, one.

    Rows without a word are all kept. A row with a null doc_id is kept unless its class has an id or another leader. Only
    rows whose ids and texts a bitmap of fixed size can't clear of being removed or repeated are shuffled.
    """
    rows, texts, roots, _ = grouped(docs, **options)
    member = texts.select("key", "first_id").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    leaders = member.groupBy("root").agg(F.min(F.struct(F.col("first_id").isNull().alias("late"), "first_id", "key")).alias("one"))
    leaders = saved(leaders.select(F.col("one.key").alias("__key"), F.col("one.first_id").alias("__id")))
    every = rows.where("key is not null").groupBy("key", F.col("doc_id").cast("long").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    leads = F.col("__key").isNotNull() & F.col("id").eqNullSafe(F.col("__id"))
    doubtful = every.join(leaders, F.col("key") == F.col("__key"), "left").where(~leads | (F.col("n") > 1)).select(F.xxhash64("id", "key"))
    inked = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    marked = docs.withColumn("__text", F.unhex(F.md5("text"))).withColumn("__own", F.col("doc_id").cast("long"))
    marked = marked.withColumn("__open", inked & Bloom(doubtful).test(F.xxhash64("__own", "__text")))
    same = (F.col("__text") == F.col("__key")) & F.col("__own").eqNullSafe(F.col("__id"))
    kept = marked.where("__open").join(leaders, same, "left_semi").dropDuplicates(["__text"])
    return marked.where("not __open").unionByName(kept).select(*docs.columns)
