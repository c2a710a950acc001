"""BPE, mixing, nearest neighbours, the pipeline and the driver's contract."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vertebra.llm import ann, bpe, langid, mixing, queries

from .conftest import WORD


@pytest.fixture(scope="module")
def public():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary())


def test_bpe_equals_library(spark, docs, public):
    for r in bpe.encode(docs, queries.vocabulary()).collect():
        want = public.encode(r.text, add_special_tokens=False).ids
        assert r.ids == want and r.n_tokens == len(want)


def test_bpe_random(public):
    own = bpe.Tokenizer(queries.vocabulary(), most_pieces=50)
    rng = random.Random(7)
    parts = ["aaaa", "  ", "\n", "　", "\x85", "\x1c", "é", "日本語", "🚀", "<|endoftext|>", "'s", "'ll", "123", "½", "ab", "the ", " un", "\t", "--", "\xa0", "İ", "\x00", "ing"]
    for _ in range(3000):
        s = "".join(rng.choice(parts) if rng.random() < 0.8 else chr(rng.choice([rng.randint(32, 126), rng.randint(0xA0, 0x2FFF)])) for _ in range(rng.randint(0, 14)))
        got, want = own.encode(s), public.encode(s, add_special_tokens=False).ids
        assert got.tolist() == want and own.decode(got) == public.decode(want, skip_special_tokens=False)


def test_bpe_odd(odd, none):
    rows = bpe.encode(odd, queries.vocabulary()).collect()
    assert len(rows) == 10 and all((r.n_tokens == 0) == (not r.text) for r in rows) and bpe.encode(none, queries.vocabulary()).count() == 0


def targets(sizes, weights=(1, 2, 3), cap=3):
    """Sources' targets by the rule's own words: share by weight, cut, share the excess again."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight, total, out = {s: weights[i % 3] for i, s in enumerate(order)}, sum(sizes.values()), dict.fromkeys(order, 0.0)
    full, left = set(), float(total)
    while left > 1e-9 and len(full) < len(order):
        w = sum(weight[s] for s in order if s not in full)
        over = [s for s in order if s not in full and out[s] + left * weight[s] / w >= cap * sizes[s]]
        if not over:
            for s in order:
                if s not in full:
                    out[s] += left * weight[s] / w
            break
        for s in over:
            out[s] = cap * sizes[s]
        full |= set(over)
        left = total - sum(out[s] for s in full)
        for s in order:
            if s not in full:
                out[s] = 0.0
    return out


def test_targets(spark):
    rng = random.Random(3)
    for n in (1, 2, 7, 30):
        sizes = {f"s{i}": rng.choice([0, 1, 5, 100, 10_000]) for i in range(n)} | {None: 50}
        rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.source_targets(rows).collect()}
        assert got == pytest.approx(targets(sizes), abs=1e-6)


def test_apportion_is_highest_quotients(spark):
    rng = random.Random(5)
    for seats in (0, 1, 7, 100, 1234):
        weights = [(i, float(rng.choice([0, 1, 3, 50, 999]))) for i in range(12)]
        weights[3] = (3, 77.0)
        got = {r.i: r.n for r in mixing.apportion(spark.createDataFrame([(*w, seats) for w in weights], "i int, w double, seats long"), [], "w", "seats", "i", "n").collect()}
        best = sorted(((-w / (2 * k + 1), i) for i, w in weights for k in range(seats) if w), key=lambda x: x)[:seats]
        assert got == {i: sum(j == i for _, j in best) for i, _ in weights}


def test_mixing(spark, sf_dir, docs, odd, none):
    rows = queries.op9_mixing(spark, sf_dir).collect()
    texts = {r.doc_id: r for r in docs.collect()}
    sizes: dict = {}
    for r in texts.values():
        sizes[r.source] = sizes.get(r.source, 0) + len(WORD.findall(r.text))
    want, taken = targets(sizes), dict.fromkeys(sizes, 0)
    for r in rows:
        s = texts[r.doc_id].source
        assert r.size == len(WORD.findall(texts[r.doc_id].text)) and r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 100 + 0.02 * want[s] for s in sizes)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, queries.op9_mixing(spark, sf_dir).collect()))
    out = mixing.mix(odd).collect()
    assert len(out) == 10 and mixing.mix(none).count() == 0 and all(r.taken <= 3 * r.size for r in out)


def test_whole_documents(spark, docs):
    mixed = mixing.mix(docs)
    out = mixing.whole_documents(mixed, docs.columns)
    assert out.columns == docs.columns
    words = lambda df: {r.source: r.n for r in df.groupBy("source").agg(F.sum(mixing.n_words(F.col("text"))).alias("n")).collect()}
    got = words(out)
    for r in mixed.groupBy("source").agg(F.sum("taken").alias("n"), F.max("size").alias("most")).collect():
        assert abs(got.get(r.source, 0) - r.n) <= 2 * r.most


def test_neighbours(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in v]), np.array([r.embedding for r in v], dtype=float)
    u = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    rows = queries.op10_neighbours(spark, sf_dir).collect()
    hit = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        s = (u * u[q]).sum(axis=1)
        own = sorted((r for r in rows if r.query_id == ids[q]), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == [1, 2, 3, 4, 5] and own == sorted(own, key=lambda r: (-r.score, r.vec_id))
        assert all(r.score == pytest.approx(s[np.flatnonzero(ids == r.vec_id)[0]], abs=1e-12) for r in own)
        s[q] = -9
        hit, total = hit + len({r.vec_id for r in own} & set(ids[np.lexsort((ids, -s))[:5]])), total + 5
    assert hit / total >= 0.9


def test_neighbours_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [1.0, None]), (7, [inf, 1.0]), (8, [1.0, 2.0, 3.0]), (9, [1.0, 0.0]), (None, [1.0, 0.0]), (50, [0.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r.query_id, r["rank"], r.vec_id) for r in ann.search(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 9), (0, 3, 2), (0, 4, 50), (50, 1, 2), (50, 2, 0), (50, 3, 1), (50, 4, 9)]
    assert ann.search(df.where("false")).count() == 0
    same = spark.range(3000).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0)).cast("array<float>").alias("embedding"))
    best = ann.search(same).where("query_id = 2950").orderBy("rank").collect()
    assert [r.vec_id for r in best] == [0, 1, 2, 3, 4]


def test_neighbours_of_an_outlier(spark):
    """A leaf with fewer than k other rows is not the end: each query has k neighbours."""
    rng = np.random.default_rng(1)
    centres = np.eye(8)
    rows = [(100 * g + i, (centres[g] + rng.normal(0, 1e-3, 8)).tolist()) for g in range(7) for i in range(1, 60)]
    rows += [(800, centres[7].tolist()), (801, (centres[7] * 2).tolist()), (802, (centres[7] + 1e-3).tolist()), (800, (centres[7] * 3).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(df).where("query_id = 800").orderBy("rank").collect()
    assert [r["rank"] for r in got] == [1, 2, 3, 4, 5] and 800 not in {r.vec_id for r in got}


def test_pipeline(spark, sf_dir, docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "encoding"]
    now, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        now = corpus_pipeline.saved(stage(spark, now, sf_dir))
        kept[name] = now.count()
        if name != "encoding":
            assert now.columns == docs.columns
    assert docs.count() >= kept["toxicity"] >= kept["line_dedup"] >= kept["near_dedup"] > 0 and kept["mixing"] == kept["encoding"] > 0
    none = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf_dir).count() == 0


def test_all_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {f"op{n}" for n in range(1, 11)} == {n.split("_")[0] for n in names if n.startswith("op")} and "pipeline" in names


def test_language_of_long_texts(spark):
    """A language that has only long texts is learned, and so is a model when there are no others."""
    words = {"xx": ["alpha", "beta", "gamma"], "yy": ["uno", "dos", "tres"]}
    rows = [(i, " ".join(words[g][(i * 7 + j * j) % 3] for j in range(15_000)), g) for i, g in enumerate(["xx", "yy"] * 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = langid.predict(df.withColumn("Score", F.lit("theirs")), langid.fit(df)).collect()
    assert all(r.lang_pred == r.lang for r in out) and "Score" not in out[0].asDict()


def test_code_lengths_against_plain_ppm(spark):
    """Frozen PPM of order 3 with method C escapes, coded again with dictionaries."""
    from collections import Counter, defaultdict
    from math import log2

    train = {"a": "the cat and the hat", "b": "der hut und der hund"}
    rows = [(i, t, g) for g, t in train.items() for i in range(20)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").where("crc32(cast(doc_id as string)) % 5 != 0").limit(0).unionByName(spark.createDataFrame([(1, t, g) for g, t in train.items()], "doc_id long, text string, lang string")))
    text = b"the hund and thx"
    codes = langid.codes_of(np.frombuffer(text, np.uint8), np.array([0, len(text)]), 3)
    got = model.bits(codes).sum(axis=0)
    for n, lang in enumerate(model.langs):
        seen = defaultdict(Counter)
        padded = b"\0\0\0" + train[lang].encode()
        for at in range(3, len(padded)):
            for k in range(4):
                seen[padded[at - k : at]][padded[at]] += 1
        total, whole = 0.0, b"\0\0\0" + text
        for at in range(3, len(whole)):
            for k in (3, 2, 1, 0):
                c = seen.get(whole[at - k : at], Counter())
                if c[whole[at]]:
                    total -= log2(c[whole[at]] / (sum(c.values()) + len([x for x in c.values() if x])))
                    break
                if sum(c.values()):
                    total -= log2(len([x for x in c.values() if x]) / (sum(c.values()) + len([x for x in c.values() if x])))
            else:
                total += 8
        assert got[n] == pytest.approx(total)


def test_small_sources_come_near_their_targets(spark):
    rows = [(i, f"s{i:02d}", " ".join(f"w{j}" for j in range(60))) for i in range(12)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    assert all(abs(r.taken - r.target) <= 2 and r.taken <= 3 * r.size for r in out)
    mixed = [*rows, *((100 + i, "huge", " ".join(["v"] * 900)) for i in range(40))]
    got = mixing.mix(spark.createDataFrame(mixed, "doc_id long, source string, text string")).groupBy("source").agg(F.sum("taken").alias("n"), F.max("target").alias("t")).collect()
    assert all(abs(r.n - r.t) <= 0.1 * r.t + 1 for r in got)


def test_repeated_queries(spark):
    """Rows of one vec_id are one query; every candidate row counts once, repeated ones as often as they stand there."""
    rows = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (50, [1.0, 0.0]), (1, [1.0, 0.1]), (1, [1.0, 0.1]), (2, [0.3, 1.0]), (3, [1.0, 0.5]), (4, [1.0, 1.0])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in got] == [(50, 1, 1), (50, 2, 1), (50, 3, 2), (50, 4, 3), (50, 5, 4)]


def test_line_dedup_stage_cuts_texts_once(spark):
    """One Python worker per task cuts texts; documents go exactly when no word is left."""
    rows = [(1, "one two three four five\nsix"), (2, "one two three four five\n\n \nsix"), (3, "one two three four five\nseven"), (4, " \n"), (5, None)]
    out = corpus_pipeline.line_dedup_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [remaining") == 1
    assert sorted(map(tuple, out.collect())) == [(1, rows[0][1]), (3, "seven"), (4, " \n"), (5, None)]


def test_bpe_memory_is_bounded(public):
    """Each worker of an executor has a tokenizer, so its tables and what it remembers of texts are counted here in bytes."""
    import tracemalloc

    queries.vocabulary()
    tracemalloc.start()
    own = bpe.Tokenizer(queries.vocabulary())
    tables = tracemalloc.get_traced_memory()[0]
    rng = random.Random(8)
    for i in range(400):
        own.encode(" ".join("".join(rng.choices("abcdefghijklmnop", k=8)) for _ in range(1000)))
    texts = tracemalloc.get_traced_memory()[0] - tables
    own.forget()
    left = tracemalloc.get_traced_memory()[0] - tables
    tracemalloc.stop()
    assert tables < 15e6 and texts < 35e6 and abs(left) < 1e6
    again = " ".join("".join(rng.choices("abcdefghijklmnop", k=8)) for _ in range(1000))
    ids = own.encode(again)
    assert ids.tolist() == public.encode(again, add_special_tokens=False).ids and own.decode(ids, most=7) == own.decode(ids) == again


def test_tasks_forget_powers():
    from vertebra.llm import common

    def run(batches):
        for b in batches:
            yield common.powers(b, 0)[0][1]

    assert len(list(common.lean(run)([1 << 17]))) == 1 and not common._powers
