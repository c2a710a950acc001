"""Line deduplication by an exact set-similarity join with prefix, positional, length and bitmap filters."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertebra.llm.common import WORD, Bloom, Words, beside, buffers, lean, mixed, saved, slices
from vertebra.llm.groups import components, handled, here, in_common, merged, pairs_of

#: Words are counted in 2**21 hash buckets, in chunks of 2**16: the table of counts is 8 MB for any corpus.
BUCKET_BITS, CHUNK_BITS = 21, 16
#: A word in more lines than this is dealt to blocks of about so many.
BLOCK_LINES = 1 << 17
#: Columns of a set's parities, 64 words' bits each; a power of two of them. In 64 bits alone, lines of over 100 words can't be told apart.
#: ROW: columns of prefix rows as they are sent. token is 32 bits of a word's hash, so that few words may meet as one; n and at
#: stop at MANY, and sets of that size pass all filters that they could spoil.
BITS = ["bits0", "bits1"]
ROW = {"token": "<u4", "sig": "<u8", **dict.fromkeys(BITS, "<u8"), "n": "<u2", "at": "<u2"}
MANY = 2**16 - 1
#: Lists of removed lines up to this length are looked up line by line.
FEW_REMOVED = 64
#: Bytes of a word's hash in sets that are verified.
WORD_BYTES = 6


def by_line(line: np.ndarray, *keys: tuple[np.ndarray, int]) -> np.ndarray:
    """An order by line, then by keys: one sort of integers, and a second one of the few places that tie there.

    keys: values and their bits, the last one's values with all 64, of which the first sort takes what is left of 64.
    """
    left = 64 - int(line.max(initial=0)).bit_length()
    code = np.zeros(len(line), dtype=np.uint64) if left == 64 else line.astype(np.uint64) << np.uint64(left)
    for values, bits in keys[:-1]:
        left -= bits
        code |= values.astype(np.uint64) << np.uint64(left)
    code |= keys[-1][0] >> np.uint64(64 - left)
    order = np.argsort(code)
    sorted_, last = code[order], keys[-1][0][order]
    tied = np.unique(sorted_[1:][(sorted_[1:] == sorted_[:-1]) & (last[1:] != last[:-1])])
    if len(tied):
        at = np.flatnonzero(np.isin(sorted_, tied))
        order[at] = order[at][np.lexsort((last[at], sorted_[at]))]
    return order


class Lines:
    """Lines with a word, of several texts, as sets of word hashes.

    text, number: the text of each line and its number there, blank lines counted. tokens[first[i]:first[i + 1]] are the
    line's different words by hash, sig its set's hash.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.words = words = Words(data, offsets)
        breaks = np.flatnonzero(data == 10)
        global_line = np.searchsorted(breaks, words.start)
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(words.first))
        new = np.ones(len(text), dtype=bool)
        new[1:] = (global_line[1:] != global_line[:-1]) | (text[1:] != text[:-1])
        starts = np.flatnonzero(new)
        self.text, self.number = text[starts], global_line[starts] - np.searchsorted(breaks, offsets[text[starts]])
        line = np.cumsum(new) - 1
        hashes = words.hashes()
        order = by_line(line, (hashes, 64))
        h, ln = hashes[order], line[order]
        keep = np.ones(len(h), dtype=bool)
        keep[1:] = (h[1:] != h[:-1]) | (ln[1:] != ln[:-1])
        self.tokens, self.line = h[keep], ln[keep]
        self.first = np.searchsorted(self.line, np.arange(len(starts) + 1))
        sums = np.add.reduceat(mixed(self.tokens), self.first[:-1]) if len(starts) else np.zeros(0, dtype=np.uint64)
        self.n = np.diff(self.first)
        self.sig = mixed(sums + self.n.astype(np.uint64))


def bucket(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def surveyed(rows: DataFrame) -> DataFrame:
    """One pass over all texts, written: each row's lines, and each task's counts of words by bucket.

    Lines: id, row, numbers, sigs (arrays, lines with a word). Counts: chunk, at (buckets within it), n, with the others null.
    """
    schema = "id long, row long, numbers array<int>, sigs array<long>, chunk int, at binary, n binary"
    names = ["id", "row", "numbers", "sigs", "chunk", "at", "n"]
    types = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.int32(), pa.binary(), pa.binary()]

    def record(columns: list, size: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.nulls(size, t) if c is None else c for c, t in zip(columns, types, strict=True)], names=names)

    def run(batches):
        total = np.zeros(1 << BUCKET_BITS, dtype=np.int64)
        for part in slices(batches, 0):
            lines = Lines(*buffers(part.column(0)))
            total += np.bincount(bucket(lines.tokens), minlength=len(total))
            cut = pa.array(np.searchsorted(lines.text, np.arange(len(part) + 1)).astype(np.int32))
            numbers = pa.ListArray.from_arrays(cut, pa.array(lines.number.astype(np.int32)))
            yield record([part.column(1), part.column(2), numbers, pa.ListArray.from_arrays(cut, pa.array(lines.sig.view(np.int64))), None, None, None], len(part))
        for c in range(len(total) >> CHUNK_BITS):
            own = total[c << CHUNK_BITS : (c + 1) << CHUNK_BITS]
            at = np.flatnonzero(own)
            if len(at):
                yield record([None] * 4 + [pa.array([c], pa.int32()), pa.array([at.astype("<u2").tobytes()], pa.binary()), pa.array([own[at].astype("<i8").tobytes()], pa.binary())], 1)

    return saved(rows.select("text", "id", "row").mapInArrow(lean(run), schema))


def word_counts(survey: DataFrame) -> np.ndarray:
    """In how many lines the words of each bucket occur, in all texts. Chunks are summed apart; the table has a fixed size."""

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for c, at, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                sums.setdefault(c, np.zeros(1 << CHUNK_BITS, dtype=np.int64))[np.frombuffer(at, "<u2")] += np.frombuffer(n, "<i8")
        for c, s in sums.items():
            yield pa.record_batch([pa.array([c], pa.int32()), pa.array([np.minimum(s, 2**31 - 1).astype("<i4").tobytes()], pa.binary())], names=["chunk", "n"])

    own = survey.where("chunk is not null").select("chunk", "at", "n")
    parts = own.repartition(1 << (BUCKET_BITS - CHUNK_BITS), "chunk").mapInArrow(lean(add), "chunk int, n binary").collect()
    out = np.zeros(1 << BUCKET_BITS, dtype=np.int32)
    for r in parts:
        out[r.chunk << CHUNK_BITS : (r.chunk + 1) << CHUNK_BITS] = np.frombuffer(r.n, "<i4")
    return out


def rarity(often: np.ndarray) -> np.ndarray:
    """Counts in 14 bits, exact up to 2**10, then to one part in 2**9: the upper bits of a float, so the same everywhere."""
    return np.maximum((often.astype(np.float64).view(np.int64) >> 43) - (1023 << 9), 0)


def dealt(token: np.ndarray, sig: np.ndarray, often: np.ndarray, lines: int) -> tuple[np.ndarray, np.ndarray]:
    """(which row, word hash) as sent: rows of a word in more than `lines` lines go once to each pair of blocks that theirs is in.

    A word's rows are in ceil(often / lines) blocks by set. Any two rows are together under the hash of their blocks' pair.
    """
    blocks = np.maximum(-(-often.astype(np.int64) // lines), 1)
    at = np.repeat(np.arange(len(token)), blocks)
    own, n = (mixed(sig) % blocks.astype(np.uint64)).astype(np.int64)[at], blocks[at]
    other = np.arange(len(at)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    pair = (np.minimum(own, other) * n + np.maximum(own, other)).astype(np.uint64)
    return at, np.where(n > 1, mixed(token[at] + mixed(pair + np.uint64(1))), token[at])


def prefixes(lines: Lines, which: np.ndarray, counts: np.ndarray, p: int, q: int, block_lines: int = BLOCK_LINES) -> dict[str, np.ndarray]:
    """Prefix rows of the chosen lines: words by rarity (of the bucket count, then hash), the first n - ceil(n p / q) + 1.

    Words found once in all texts keep their place but are left out, since no other line has them. Each word flips one of
    the bits, 64 to a column of BITS, so that two sets differ in at least as many words as their bits do.
    """
    chosen = np.zeros(len(lines.n), dtype=bool)
    chosen[which] = True
    mine = chosen[lines.line]
    tokens, line = lines.tokens[mine], lines.line[mine]
    often = counts[bucket(tokens)]
    order = by_line(line, (rarity(often), 14), (tokens, 64))
    tokens, line, often = tokens[order], line[order], often[order]
    n = lines.n[line]
    begin = np.searchsorted(line, line)
    at = np.arange(len(line)) - begin
    flips = np.left_shift(np.uint64(1), tokens >> np.uint64(13) & np.uint64(63))
    column = tokens >> np.uint64(19) & np.uint64(len(BITS) - 1)
    heads = np.flatnonzero(at == 0)
    use = (at < n - -(-n * p // q) + 1) & (often > 1)
    bits = {}
    for k, c in enumerate(BITS):
        own = np.where(column == k, flips, np.uint64(0))
        of_line = np.bitwise_xor.reduceat(own, heads) if len(heads) else own
        bits[c] = np.repeat(of_line, np.diff(np.append(heads, len(line))))[use]
    sig = lines.sig[line[use]]
    row, token = dealt(tokens[use], sig, often[use], block_lines)
    few = lambda x: np.minimum(x[use][row], MANY).astype("<u2")
    return {"token": (token >> np.uint64(32)).astype("<u4"), "sig": sig[row], **{c: b[row] for c, b in bits.items()}, "n": few(n), "at": few(at)}


def grouped(rows: dict[str, np.ndarray], p: int, q: int, most: int = 1 << 17) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sig, root, n): the sets among prefix rows that have a candidate there, the smallest set hash they lead to, and sizes.

    Rows are sorted by word and size. A row within its index prefix meets the larger rows of its word up to q / p times
    its size (length filter); what may still match after both positions must suffice (positional filter), and the bits
    may not differ more than the sets could. Candidates are joined at once and never listed: near neighbours in the order
    are tried first, and of a word's rows only those outside its commonest group then meet the others.

    A task's memory is mostly this: columns are taken out of rows as they are sorted, and kept in 32 bits where they fit.
    """
    order = np.lexsort((rows["sig"], rows["n"], rows["token"])).astype(np.int32 if len(rows["n"]) < 2**31 else np.int64)
    token, sig = rows.pop("token")[order], rows.pop("sig")[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (token[1:] != token[:-1]) | (sig[1:] != sig[:-1])
    order, token, sig = order[new], token[new], sig[new]
    n, place, bits = rows.pop("n")[order].astype(np.int32), rows.pop("at")[order].astype(np.int32), [rows.pop(c)[order] for c in BITS]
    sets, own = np.unique(sig, return_inverse=True)
    own = own.astype(order.dtype)
    label = np.arange(len(sets), dtype=order.dtype)
    del order, sig, new
    if not len(sets):
        return sets, sets, n

    def meet(i: np.ndarray, j: np.ndarray) -> None:
        apart = label[own[i]] != label[own[j]]
        i, j = i[apart], j[apart]
        need = -(-(n[i] + n[j]).astype(np.int64) * p // (p + q))
        differ = sum(np.bitwise_count(b[i] ^ b[j]).astype(np.int16) for b in bits)
        ok = (np.minimum(n[i] - place[i], n[j] - place[j]) >= need) & (differ <= n[i] + n[j] - 2 * need)
        ok |= (n[i] == MANY) | (n[j] == MANY)
        merged(label, own[i[ok]], own[j[ok]])

    for d in (1, 2, 3, 5, 8, 13):
        k = np.arange(d, len(token))
        k = k[token[k] == token[k - d]]
        meet(k - d, k)
    group = np.cumsum(np.concatenate([[0], token[1:] != token[:-1]]), dtype=label.dtype)
    now = label[own]
    by = np.lexsort((now, group))
    cut = np.concatenate([[0], np.flatnonzero((np.diff(group[by]) != 0) | (np.diff(now[by]) != 0)) + 1])
    sizes = np.diff(np.append(cut, len(by)))
    largest = cut[np.lexsort((-sizes, group[by[cut]]))]
    commonest = np.empty(group[-1] + 1, dtype=label.dtype)
    heads = np.unique(group[by[largest]], return_index=True)[1]
    commonest[group[by[largest[heads]]]] = now[by[largest[heads]]]
    outside = now != commonest[group]
    del now, by, cut, sizes, largest, commonest, heads
    long = n.astype(np.int64)
    index = (place < long - -(-2 * long * p // (p + q)) + 1) | (n == MANY)
    wide = int(n.max(initial=1)) * q // p + 2
    code = group.astype(np.int64) * wide + n
    del long

    def sweep(left: np.ndarray, right: np.ndarray) -> None:
        """Rows left meet those of right that stand after them, a bounded number of tries at a time."""
        begin = np.searchsorted(right, left, side="right")
        many = np.searchsorted(code[right], group[left].astype(np.int64) * wide + n[left].astype(np.int64) * q // p, side="right") - begin
        left, begin, many = left[many > 0], begin[many > 0], many[many > 0]
        for at in range(0, int(many.max(initial=0)), most):  # a row with more partners than `most` takes several turns
            few = np.minimum(many - at, most)
            some = np.flatnonzero(few > 0)
            cuts = np.cumsum(few[some])
            k = 0
            while k < len(some):
                to = max(k + 1, int(np.searchsorted(cuts, (cuts[k - 1] if k else 0) + most, side="right")))
                m = few[some[k:to]]
                i = np.repeat(left[some[k:to]], m)
                j = np.repeat(begin[some[k:to]] + at, m) + np.arange(len(i)) - np.repeat(np.cumsum(m) - m, m)
                meet(i, right[j])
                k = to

    every, out = np.arange(len(token)), np.flatnonzero(outside)
    sweep(np.flatnonzero(index & outside), every)
    sweep(np.flatnonzero(index & ~outside), out)
    some = np.bincount(label, minlength=len(label))[label] > 1
    size = np.zeros(len(sets), dtype=np.int64)
    size[own] = n
    return sets[some], sets[label[some]], size[some]


def candidates(rows: DataFrame, counts: np.ndarray, p: int, q: int, parts: int) -> DataFrame:
    """(sig, group, n), written: sets (of n words) that have a candidate, and the smallest set hash that they lead to by candidates of one
    task. Two sets that are candidates share a group, at least.

    A task keeps one line of each set and sends its prefix rows in one block per part of the word hashes. Lines of fewer
    than q / (q - p) words can only match their equals and have no rows.
    """
    shared = rows.sparkSession.sparkContext.broadcast(counts)

    def emit(batches):
        seen = np.zeros(0, dtype=np.uint64)
        held: list[dict[str, np.ndarray]] = []

        def blocks():
            every = {c: np.concatenate([h[c] for h in held]) for c in ROW}
            part = (mixed(every["token"].astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            cut = np.searchsorted(part[order], np.arange(parts + 1))
            own = [i for i in range(parts) if cut[i + 1] > cut[i]]
            sent = {c: every[c][order] for c in ROW}
            raw = [pa.array([sent[c][cut[i] : cut[i + 1]].tobytes() for i in own], pa.binary()) for c in ROW]
            return pa.record_batch([pa.array(own, pa.int32()), *raw], names=["part", *ROW])

        for piece in slices(batches, 0):
            lines = Lines(*buffers(piece.column(0)))
            sets, at = np.unique(lines.sig, return_index=True)
            known = seen[np.minimum(np.searchsorted(seen, sets), len(seen) - 1)] == sets if len(seen) else np.zeros(len(sets), dtype=bool)
            new = at[~known]
            if len(seen) > 1_000_000:
                seen = seen[:0]
            seen = np.union1d(seen, sets[~known])
            new = np.sort(new[lines.n[new] * (q - p) >= p])
            if len(new):
                held.append(prefixes(lines, new, shared.value, p, q))
            if sum(len(h["n"]) for h in held) > 200_000:
                yield blocks()
                held.clear()
        if held:
            yield blocks()

    def meet(batches):
        held: dict[str, list[np.ndarray]] = {c: [] for c in ROW}
        for b in batches:
            for c in ROW:
                held[c] += [np.frombuffer(raw, ROW[c]) for raw in b.column(c).to_pylist()]
        b = None
        if held["n"]:
            a, b, n = grouped({c: np.concatenate(held.pop(c)) for c in ROW}, p, q)
            yield pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(n)], names=["sig", "group", "n"])

    blocks = rows.select("text").mapInArrow(lean(emit), "part int, " + ", ".join(f"{c} binary" for c in ROW)).repartition(parts, "part")
    return saved(blocks.mapInArrow(lean(meet), "sig long, group long, n long").distinct())


def fewer(led: DataFrame) -> DataFrame:
    """(sig, group, n), written: each group goes by the least group of any of its sets, so that sets are in fewer groups.

    Sets that share a group still do. This is one step, not closure: chains of candidates don't grow into one group.
    """
    least = led.groupBy("sig").agg(F.min("group").alias("least"))
    names = led.join(least, "sig").groupBy("group").agg(F.min("least").alias("name"))
    return saved(led.join(names, "group").select("sig", F.col("name").alias("group"), "n").distinct())


def tokens_of(rows: DataFrame, wanted: Bloom, held: Bloom) -> DataFrame:
    """(sig, tokens): the word hashes of sets in wanted, and of few others, from rows in held (and few others); some twice."""
    shared = rows.sparkSession.sparkContext.broadcast((wanted, held))

    def run(batches):
        wanted, held = shared.value
        for batch in batches:
            some = batch.filter(pa.array(held.has(batch.column(1).to_numpy())))
            for part in slices([some], 0):
                lines = Lines(*buffers(part.column(0)))
                _, at = np.unique(lines.sig, return_index=True)
                at = at[wanted.has(lines.sig[at])]
                words = np.ascontiguousarray(lines.tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - WORD_BYTES :])
                raw = [words[lines.first[i] : lines.first[i + 1]].tobytes() for i in at.tolist()]
                yield pa.record_batch([pa.array(lines.sig[at].view(np.int64)), pa.array(raw, pa.binary())], names=["sig", "tokens"])

    return rows.select("text", "row").mapInArrow(lean(run), "sig long, tokens binary")


def overlaps(first: np.ndarray, words: np.ndarray, step: int = 4096) -> np.ndarray:
    """How many words any two sets have in common: products of 0/1 matrices, some thousand words at a time."""
    n = len(first) - 1
    _, column, often = np.unique(words, return_inverse=True, return_counts=True)
    place = np.cumsum(often > 1) - 1
    row = np.repeat(np.arange(n), np.diff(first))
    use = often[column] > 1
    row, column = row[use], place[column[use]]
    wide = int(place[-1]) + 1 if len(place) else 0
    common = np.zeros((n, n), dtype=np.float32)
    for at in range(0, wide, step):
        own = (column >= at) & (column < at + step)
        m = np.zeros((n, min(step, wide - at)), dtype=np.float32)
        m[row[own], column[own] - at] = 1
        common += m @ m.T
    return common


def linked(members: DataFrame, sizes: DataFrame, p: int, q: int, parts: int, few: int = 48) -> DataFrame:
    """(sig, n, near, a, b): for sets (group, groups, key, tokens, first) how many of their group they are similar to,
    the earliest first place of those, and rows that this connects: the set's first one, and that of the set that its links
    lead to. A set is returned once per place where it has links; each link counts in one.
    """

    def work(t: pa.Table, cut: np.ndarray) -> pa.RecordBatch:
        raw = t.column("tokens").combine_chunks()
        ends = np.frombuffer(raw.buffers()[1], dtype=np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
        words = np.zeros(((ends[-1] - ends[0]) // WORD_BYTES, 8), dtype=np.uint8)
        words[:, :WORD_BYTES] = np.frombuffer(raw.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]].reshape(-1, WORD_BYTES)
        words, first = words.view("<u8").ravel(), (ends - ends[0]) // WORD_BYTES
        n = np.diff(first)
        i, j = pairs_of(cut, most=few)
        small = in_common(first, words, i, j) * (p + q) >= p * (n[i] + n[j])
        found = [(i[small], j[small])]
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if b - a > few:
                common = overlaps(first[a : b + 1] - first[a], words[first[a] : first[b]])
                near = np.triu(common * (p + q) >= p * (n[a:b, None] + n[None, a:b]), 1)
                x, y = np.nonzero(near)
                found.append((x + a, y + a))
        i, j = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        ok = here(t, i, j)
        i, j = i[ok], j[ok]
        degree = np.bincount(i, minlength=len(n)) + np.bincount(j, minlength=len(n))
        label = merged(np.arange(len(n)), i, j)
        firsts = t.column("first").combine_chunks()
        order = np.lexsort([firsts.field(c).to_numpy() for c in ("number", "row", "id")])
        rank = np.empty(len(n), dtype=np.int64)
        rank[order] = np.arange(len(n))
        best = np.full(len(n), len(n))
        np.minimum.at(best, i, rank[j])
        np.minimum.at(best, j, rank[i])
        some = np.flatnonzero(degree)
        keys, rows = t.column("key").combine_chunks(), firsts.field("row")
        return pa.record_batch([keys.take(pa.array(some)), pa.array(degree[some].astype(np.int64)), firsts.take(pa.array(order[best[some]])), rows.take(pa.array(some)), rows.take(pa.array(label[some]))], names=["sig", "n", "near", "a", "b"])

    return handled(members, sizes, work, "sig long, n long, near struct<id: long, row: long, number: int>, a long, b long", parts)


def remaining(text: pd.Series, removed: pd.Series) -> pd.Series:
    """The text without the lines of these numbers; null stays null."""
    out = []
    for t, r in zip(text, removed, strict=True):
        gone = set() if r is None else set(r.tolist())
        out.append(None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone))
    return pd.Series(out, dtype=object)


@beside(("doc_id", "text"), ("n_lines", "n_removed", "n_links", "class_id", "kept_sha256", "kept_text"))
def dedup(docs: DataFrame, least: float = 0.8, with_text: bool = False, with_links: bool = True) -> DataFrame:
    """Adds n_lines, n_removed, kept_sha256 and, if asked, kept_text, n_links and class_id to every row.

    Lines are \\n-separated and compared as sets of words; a line is removed if an earlier line of any document (by
    doc_id, null last, then a hash of the row, then line number) has a Jaccard similarity of at least `least` with it,
    judged on the input. Blank lines have no set, are not counted and stay. n_links counts the links to different sets of
    all the document's lines; class_id is the smallest doc_id of the documents that equal or linked lines connect with it, by
    any number of steps. Equal rows fare alike.

    Candidates of the prefix join are joined to groups where they are found, without being listed; then each group's sets
    meet, once, in blocks of bounded size that count links and pass on one row per set. So what is sent grows with the
    lines; what is compared grows with the square of a group's different lines, as exact counts of links need.

    Empty tables give no rows, null texts have no lines and keep "". Only texts that lose lines are shuffled. They, and those whose words verification needs, are picked by bitmaps of
    fixed size, which let a few others through and hold none back.
    """
    spark = docs.sparkSession
    ratio = Fraction(least).limit_denominator(1000)
    p, q = ratio.numerator, ratio.denominator
    docs = docs.withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1))).withColumn("__row", F.xxhash64("__id", "text"))
    rows = docs.where(F.col("text").rlike(WORD)).select(F.col("__id").alias("id"), F.col("__row").alias("row"), "text")
    parts = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))

    survey = surveyed(rows)
    each = survey.where("chunk is null").select("id", "row", F.explode(F.arrays_zip("numbers", "sigs")).alias("l")).select("id", "row", F.col("l.numbers").alias("number"), F.col("l.sigs").alias("sig"))
    led = fewer(candidates(rows, word_counts(survey), p, q, parts))
    met = led.groupBy("sig").agg(F.collect_set("group").alias("groups"))
    firsts = each.groupBy("sig").agg(F.min(F.struct("id", "row", "number")).alias("first"), F.count(F.lit(1)).alias("times"))
    firsts = saved(firsts.join(met, "sig", "left").where("times > 1 or groups is not null"))
    wanted = firsts.where("groups is not null")
    tokens = tokens_of(rows, Bloom(wanted.select("sig")), Bloom(wanted.select("first.row")))
    members = tokens.join(wanted, "sig").dropDuplicates(["sig"]).select(F.explode("groups").alias("group"), "groups", F.col("sig").alias("key"), "first", "tokens")
    links = saved(linked(members, led.select("group", (F.col("n") * WORD_BYTES).alias("size")), p, q, parts))

    near = links.groupBy("sig").agg(F.min("near").alias("near"), F.sum("n").alias("n"))
    known = saved(firsts.join(near, "sig", "left").where("times > 1 or n is not null").select("sig", F.least("first", "near").alias("first"), F.coalesce("n", F.lit(0)).alias("n")))
    hits = each.join(known, "sig").select("id", "row", "number", "n", F.col("first.row").alias("head"), (F.col("first") < F.struct("id", "row", "number")).alias("later"))
    hits = saved(hits.groupBy("id", "row").agg(F.collect_set(F.when(F.col("later"), F.col("number"))).alias("removed"), F.collect_set(F.struct("number", "n")).alias("lines"), F.collect_set("head").alias("heads")))
    hits = hits.select(F.col("id").alias("__id"), F.col("row").alias("__row"), F.col("removed").alias("__removed"), F.aggregate("lines", F.lit(0).cast("long"), lambda s, x: s + x["n"]).alias("__links"), F.col("heads").alias("__heads"))

    text = F.coalesce("text", F.lit(""))
    inked = F.size(F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))).cast("long")
    losing = hits.where(F.size("__removed") > 0)
    docs = docs.withColumn("n_lines", inked).withColumn("__open", Bloom(losing.select("__row")).test(F.col("__row")))
    same = docs.where("not __open").withColumn("n_removed", F.lit(0).cast("long")).withColumn("kept_text", text)
    cut = docs.where("__open").join(losing.select("__id", "__row", "__removed"), ["__id", "__row"], "left")
    gone = F.size("__removed")
    few = F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains("__removed", i)), "\n")
    many = F.when(gone > FEW_REMOVED, text)  # a look-up in a short list costs nothing; only texts with long ones go to Python
    rest = F.when(gone <= FEW_REMOVED, few).otherwise(F.pandas_udf(remaining, "string")(many, F.when(gone > FEW_REMOVED, F.col("__removed"))))
    cut = cut.withColumn("n_removed", F.coalesce(F.when(gone > 0, gone), F.lit(0)).cast("long")).withColumn("kept_text", F.when(gone > 0, rest).otherwise(text))
    out = same.unionByName(cut.select(*same.columns)).drop("__open").withColumn("kept_sha256", F.sha2("kept_text", 256))
    if not with_text:
        out = out.drop("kept_text")
    if with_links:
        held = hits.select(F.col("__row").alias("a"), F.explode("__heads").alias("b")).where("a <> b")
        roots = components(links.select("a", "b").where("a <> b").unionByName(held))
        member = saved(hits.select("__id", "__row", "__links").join(roots, F.col("__row") == F.col("key"), "left").select("__id", "__row", "__links", F.coalesce("root", "__row").alias("root")))
        heads = saved(member.groupBy("root").agg(F.min("__id").alias("__head")))
        out = out.join(member.join(heads, "root").select("__id", "__row", "__links", "__head"), ["__id", "__row"], "left")
        head = F.when(F.col("__head") < 2**63 - 1, F.least(F.col("doc_id").cast("long"), F.col("__head")))
        out = out.withColumn("n_links", F.coalesce("__links", F.lit(0)).cast("long")).withColumn("class_id", F.coalesce(head, F.col("doc_id").cast("long")))
    return out.drop("__id", "__row", "__links", "__head")
