"""Substring, line and near-duplicate dedup against brute force."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from vertebra.llm import linededup, ordermh, substring

from .conftest import WORD


def passages(rows, window):
    words = {k: WORD.findall(t or "") for k, t in rows}
    seen = Counter(tuple(w[i : i + window]) for w in words.values() for i in range(len(w) - window + 1))
    out = {}
    for k, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[k] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_substring(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.parse(docs).collect()}
    assert got == passages(rows, 35)


def test_substring_random(spark):
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in rng.integers(0, 40, 400)]
    rows = []
    for k in range(60):
        w = []
        while len(w) < rng.integers(5, 160):
            a = int(rng.integers(0, 390))
            w += base[a : a + int(rng.integers(1, 60))] if rng.random() < 0.6 else [f"x{rng.integers(0, 5)}"] * int(rng.integers(1, 12))
        rows.append((k, " \n".join(w)))
    rows += [(60, "a " * 200), (61, rows[0][1]), (62, None), (63, "")]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.parse(spark.createDataFrame(rows, "doc_id long, text string"), window=12, run=4).collect()}
    assert got == passages(rows, 12)


def test_substring_odd(odd, none):
    out = substring.parse(odd, with_text=True)
    rows = {(r.doc_id, r.text): r for r in out.collect()}
    assert out.count() == 10 and substring.parse(none).count() == 0
    assert all(r.n_removed == 30_000 and r.kept_text == "" for k, r in rows.items() if k[0] in (4, 5))
    assert rows[1, None].n_words == 0 and rows[7, "one two\none two\r\nthree"].n_removed == 0


def test_anchors_cover_every_passage():
    rng = np.random.default_rng(1)
    for n in (1, 5, 30, 200):
        runs = rng.integers(0, 9, n).astype(np.uint64)
        got = set(substring.anchors(runs, np.arange(n), np.array([0, n]), 7).tolist())
        for i in range(n - 6):
            low = runs[i : i + 7].min()
            assert all(i + j in got for j in range(7) if runs[i + j] == low)


def lines_wanted(rows):
    first, order = {}, []
    rows = sorted(rows, key=lambda r: r[0])
    for k, t in rows:
        for n, line in enumerate((t or "").split("\n")):
            s = frozenset(WORD.findall(line))
            if s and s not in first:
                first[s] = (k, n)
                order.append(s)
    links = defaultdict(set)
    for i, s in enumerate(order):
        for x in order[:i]:
            if 9 * len(s & x) >= 4 * (len(s) + len(x)):
                links[s].add(x)
                links[x].add(s)
    out = {}
    for k, t in rows:
        kept, gone, inked, n_links = [], 0, 0, 0
        for n, line in enumerate((t or "").split("\n")):
            s = frozenset(WORD.findall(line))
            if s:
                inked, n_links = inked + 1, n_links + len(links[s])
                if min(first[x] for x in (s, *links[s])) < (k, n):
                    gone += 1
                    continue
            kept.append(line)
        out[k] = (inked, gone, n_links, hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def test_lines(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: (r.n_lines, r.n_removed, r.n_links, r.kept_sha256) for r in linededup.dedup(docs).collect()}
    assert got == lines_wanted(rows)


def test_lines_random(spark):
    rng = np.random.default_rng(8)
    base = [[f"v{j}" for j in rng.integers(0, 60, int(rng.integers(1, 25)))] for _ in range(30)]
    rows = []
    for k in range(40):
        lines = []
        for _ in range(int(rng.integers(0, 12))):
            w = list(base[int(rng.integers(0, 30))])
            for _ in range(int(rng.integers(0, 4))):
                w[int(rng.integers(0, len(w)))] = f"v{rng.integers(0, 60)}"
            lines.append(" ".join(w) if rng.random() > 0.1 else " ")
        rows.append((k, "\n".join(lines)))
    got = {r.doc_id: (r.n_lines, r.n_removed, r.n_links, r.kept_sha256) for r in linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == lines_wanted(rows)


def test_line_classes(spark):
    """On a chain of similar lines, and through documents that hold lines of two chains, all have one class."""
    w = [f"c{i}" for i in range(20)]
    chain = [" ".join(w[:10]), " ".join([*w[:9], "x"]), " ".join([*w[:8], "x", "y"]), " ".join([*w[:7], "x", "y", "z"])]
    rows = [(5, chain[0]), (4, chain[1]), (3, chain[2]), (2, chain[3] + "\nbridge of words"), (9, "bridge of words"), (7, "all alone"), (None, chain[0]), (None, "nobody else"), (11, "only null"), (None, "only null")]
    out = linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), least=0.8).select("doc_id", "class_id", "n_links").collect()
    assert sorted((r.doc_id or 0, r.class_id or 0) for r in out) == [(0, 0), (0, 2), (0, 11), (2, 2), (3, 2), (4, 2), (5, 2), (7, 7), (9, 2), (11, 11)]


def test_rarity_and_blocks():
    n = np.unique(np.concatenate([np.arange(3000), np.logspace(1, 9.3, 4000).astype(np.int64)]))
    r = linededup.rarity(n)
    assert (np.diff(r) >= 0).all() and r.max() < 1 << 14 and len(set(r[1:1024].tolist())) == 1023 and linededup.rarity(np.array([20_000]))[0] < linededup.rarity(np.array([10**6]))[0]
    sig = np.random.default_rng(2).integers(0, 2**63, 60, dtype=np.uint64)
    row, token = linededup.dealt(np.full(60, 77, dtype=np.uint64), sig, np.full(60, 60), 9)
    tasks = defaultdict(set)
    for i, t in zip(row.tolist(), token.tolist(), strict=True):
        tasks[t].add(i)
    assert len(tasks) > 20 and max(map(len, tasks.values())) < 40 and all(any({i, j} <= x for x in tasks.values()) for i in range(60) for j in range(i))


def test_lines_odd(odd, none):
    out = linededup.dedup(odd, with_text=True)
    rows = {(r.doc_id, r.text): r for r in out.collect()}
    assert out.count() == 10 and linededup.dedup(none).count() == 0
    assert rows[7, "one two\none two\r\nthree"].kept_text == "one two\nthree" and rows[3, " \n\t "].kept_text == " \n\t "
    same = [r for r in linededup.dedup(odd).collect() if r.doc_id == 6]
    assert len(same) == 2 and all(r.n_removed == 0 for r in same)


def runs_of(text, k=5):
    w, c, out = WORD.findall(text), Counter(), []
    for i in range(max(1, len(w) - k + 1)):
        g = tuple(w[i : i + k])
        out.append((g, c[g]))
        c[g] += 1
    return out


def similarity(a, b):
    """Longest common subsequence by the full table."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1] / (len(a) + len(b) - row[-1])


def test_near_duplicates(spark):
    rng = np.random.default_rng(2)
    rows = []
    for g in range(6):
        base = [f"g{g}w{rng.integers(0, 500)}" for _ in range(150)]
        for v in range(12):
            w = list(base)
            for _ in range(v % 6):
                w[int(rng.integers(0, 150))] = f"e{rng.integers(0, 10**6)}"
            if v == 11:
                w = w[75:] + w[:75]
            rows.append((100 * g + v, " ".join(w)))
    rows += [(9000, rows[0][1]), (9001, "short one"), (9002, "short one"), (9003, "short two")]
    got = {r.doc_id: r.class_id for r in ordermh.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    runs, parent = {k: runs_of(t) for k, t in rows}, {k: k for k, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, _) in enumerate(rows):
        for b, _ in rows[:i]:
            if a // 100 == b // 100 or 9000 in (a, b):
                if similarity(runs[a], runs[b]) >= 0.8:
                    x, y = sorted((root(a), root(b)))
                    parent[y] = x
    assert got == {k: root(k) for k, _ in rows}


def test_alignment():
    rng = np.random.default_rng(3)
    for _ in range(60):
        a = rng.permutation(50).astype(np.uint64)
        b = np.delete(a, rng.integers(0, 50, 3))
        if rng.random() < 0.5:
            i, j = rng.integers(0, len(b), 2)
            b[i], b[j] = b[j], b[i]
        want = similarity(a.tolist(), b.tolist())
        got = ordermh.aligned(a, b, 0.8)
        assert (got >= 0.8) == (want >= 0.8) and (want < 0.8 or abs(got - want) < 1e-12)


def test_parities_lose_no_link():
    """Texts at least 0.8 similar never differ in more parity bits than the bound allows."""
    rng = np.random.default_rng(5)
    for _ in range(300):
        a = np.unique(rng.integers(0, 2**63, int(rng.integers(1, 900)), dtype=np.uint64))
        a = rng.permutation(a)
        b = np.concatenate([np.delete(a, rng.integers(0, len(a), len(a) // 9)), rng.integers(0, 2**63, int(rng.integers(0, len(a) // 9 + 1)), dtype=np.uint64)])
        apart = int(np.bitwise_count((ordermh.parities(a) ^ ordermh.parities(b)).view(np.uint64)).sum())
        if ordermh.aligned(a, b, 0.8) >= 0.8:
            assert apart <= (len(a) + len(b)) * 0.2 / 1.8 + 1e-6


def test_hot_group_and_odd(spark, odd, none):
    """A third of the rows are copies, another third near copies of one text."""
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(base)) for i in range(100)] + [(i, " ".join([*base[: i % 100], f"y{i}", *base[i % 100 + 1 :]])) for i in range(100, 200)] + [(i, " ".join(f"z{i}q{j}" for j in range(60))) for i in range(200, 300)]
    got = {r.doc_id: r for r in ordermh.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i].class_id == 0 for i in range(200)) and all(got[i].class_id == i for i in range(200, 300)) and got[150].n_texts == 101
    out = ordermh.near_duplicates(odd)
    assert out.count() == 10 and ordermh.near_duplicates(none).count() == 0
    assert {r.doc_id: r.class_id for r in out.collect() if r.doc_id in (4, 5)} == {4: 4, 5: 4}
    kept = ordermh.one_of_each(odd)
    assert kept.where("doc_id = 6").count() == 1 and kept.where("doc_id in (4, 5)").count() == 1 and kept.where(F.col("text").isNull()).count() == 2 and kept.where("text = 'alpha beta gamma'").count() == 1


def test_one_of_each_null_and_shared_ids(spark):
    """A class's leader is a row and its text: different texts without an id, or with the same one, all stay."""
    text = {c: " ".join(f"{c}{i}" for i in range(60)) for c in "abcdef"}
    rows = [(None, text["a"]), (None, text["b"]), (None, text["b"]), (7, text["c"]), (7, text["d"]), (7, text["d"]), (9, text["e"]), (None, text["e"] + " more"), (8, text["f"]), (3, text["f"])]
    kept = ordermh.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(None, text["a"]), (None, text["b"]), (7, text["c"]), (7, text["d"]), (9, text["e"]), (3, text["f"])]
    assert sorted(kept, key=lambda r: r.text) == sorted(want, key=lambda r: r[1])


def test_short_texts_meet_exactly(spark):
    """8 words against 9, where no sketch of 5 runs can meet, and all pairs of texts of at most 10 runs."""
    rng = np.random.default_rng(6)
    rows = []
    for g in range(40):
        w = [f"s{g}x{i}" for i in range(int(rng.integers(8, 15)))]
        rows += [(10 * g, " ".join(w)), (10 * g + 1, " ".join([*w, "end"][: 14])), (10 * g + 2, " ".join(["front", *w][: 14])), (10 * g + 3, " ".join([*w[:-1], "other"]))]
    runs, parent = {k: runs_of(t) for k, t in rows}, {k: k for k, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, _) in enumerate(rows):
        for b, _ in rows[:i]:
            if a // 10 == b // 10 and similarity(runs[a], runs[b]) >= 0.8:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    eight = "one two three four five six seven eight"
    rows += [(1000, eight), (1001, eight + " nine"), (1002, "zero " + eight), (1003, eight + " nine ten")]
    got = {r.doc_id: r.class_id for r in ordermh.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: root(k) for k in parent} | {k: 1000 for k in range(1000, 1004)}


def test_lines_in_many_blocks(spark, monkeypatch):
    """Groups dealt to several blocks count each link once, and a third of the rows may be variants of one line."""
    from vertebra.llm import groups

    for name, n in (("BLOCK_ROWS", 5), ("BATCH_ROWS", 30)):
        monkeypatch.setattr(groups, name, n)
    rng = np.random.default_rng(12)
    base = [f"v{j}" for j in range(30)]
    rows = []
    for k in range(120):
        lines = []
        for _ in range(3):
            w = list(base)
            for _ in range(int(rng.integers(0, 5))):
                w[int(rng.integers(0, 30))] = f"e{rng.integers(0, 400)}"
            lines.append(" ".join(w))
        lines.append(" ".join(f"u{k}x{j}" for j in range(int(rng.integers(1, 9)))))
        rows.append((k, "\n".join(lines)))
    got = {r.doc_id: (r.n_lines, r.n_removed, r.n_links, r.kept_sha256) for r in linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == lines_wanted(rows)


def test_line_order_is_exact():
    """Hashes that agree in their upper bits stay in order behind many lines."""
    rng = np.random.default_rng(3)
    line = rng.integers(0, 1 << 20, 5000)
    value = rng.integers(0, 4, 5000).astype(np.uint64) << np.uint64(62) | rng.integers(0, 50, 5000).astype(np.uint64)
    rare = rng.integers(0, 3, 5000)
    o = linededup.by_line(line, (rare, 14), (value, 64))
    assert list(zip(line[o], rare[o], value[o], strict=True)) == sorted(zip(line, rare, value, strict=True))


def test_clashing_names(spark):
    """Whatever the caller's columns are called, they come back, and the operator's own replace those of its names."""
    rows = [(k, f"line {k} of many words here\nshared line with several words in it", k * 10, "kept", 1.5) for k in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __row long, N_Links string, `a.b` double")
    out = linededup.dedup(df)
    assert out.columns == ["doc_id", "text", "__row", "a.b", "n_lines", "n_removed", "kept_sha256", "n_links", "class_id"]
    assert sorted((r["doc_id"], r["__row"], r["a.b"]) for r in out.collect()) == [(k, k * 10, 1.5) for k in range(8)]


def test_one_long_text_of_lines(spark):
    """Linear in removed lines: a text of 200,000 equal lines."""
    out = linededup.dedup(spark.createDataFrame([(1, "the same words again\n" * 200_000 + "and another ending")], "doc_id long, text string")).first()
    assert (out.n_lines, out.n_removed) == (200_001, 199_999)
