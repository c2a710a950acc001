"""Language id, toxicity, quality rules and secret scans."""

import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from vertebra.llm import langid, quality, queries, secrets, toxicity
from vertebra.llm.common import held_out

from .conftest import WORD


def test_language_accuracy(spark, sf_dir, docs):
    rows = queries.op1_language_id(spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    test = [r for r in rows if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in test]) > 0.9 and all(0 <= r.score <= 1 for r in rows)


def test_language_code_lengths(spark):
    train = spark.createDataFrame([(i, "abab" if i % 2 else "xyxy", "p" if i % 2 else "q") for i in range(1, 40)], "doc_id long, text string, lang string")
    model = langid.fit(train, order=2)
    codes = langid.codes_of(np.frombuffer(b"ab", np.uint8), np.array([0, 2]), 2)
    bits = model.bits(codes)
    p = model.langs.index("p")
    first = model.levels[0]
    seen, total, kinds = (first[k][:, p] for k in ("counts", "totals", "kinds"))
    del seen
    assert bits[1, p] < bits[1, 1 - p] and total.sum() > 0 and kinds.max() == 2
    # "b" after the start and "a": found in the longest context, total 1 and 1 kind, so half of the probability
    level = model.levels[2]
    at = np.flatnonzero(level["grams"] == codes[1])[0]
    context = np.flatnonzero(level["contexts"] == codes[1] >> np.uint64(8))[0]
    want = -np.log2(level["counts"][at, p] / (level["totals"][context, p] + level["kinds"][context, p]))
    assert bits[1, p] == pytest.approx(want)


def test_language_odd(odd, none, docs):
    model = langid.fit(docs)
    rows = langid.predict(odd, model).collect()
    assert len(rows) == 10 and {r.lang_pred for r in rows if r.text is None or not re.search(r"[^\W\d_]", r.text)} == {"und"}
    assert langid.predict(none, model).count() == 0 and langid.fit(none) is None
    assert {r.lang_pred for r in langid.predict(odd, None).collect()} == {"und"}


def test_toxicity(spark, sf_dir, docs):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    bigger = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = toxicity.score(bigger, toxicity.fit(bigger, labels)).join(labels.select("doc_id", "toxic"), "doc_id").where(held_out(F.col("doc_id"))).collect()
    right = np.mean([r.predicted == r.toxic for r in out])
    assert right > 0.9 and all(r.predicted == (r.score >= 0.5) for r in out)


def brute(word, terms):
    best = None
    for t in terms:
        if t.endswith("*"):
            if word.startswith(t[:-1]):
                return 0
            continue
        row = list(range(len(t) + 1))
        for i, c in enumerate(word, 1):
            row, old = [i, *row[1:]], row
            for j in range(1, len(t) + 1):
                row[j] = min(row[j - 1] + 1, old[j] + 1, old[j - 1] + (c != t[j - 1]))
        most = 2 if len(t) >= 9 else 1 if len(t) >= 5 else 0
        if row[-1] <= most and word[:1] == t[:1] and (best is None or row[-1] < best):
            best = row[-1]
    return best


def test_fuzzy_trie():
    terms = ["idiot", "worthless", "scum", "pathetic", "losers", "lowe*"]
    trie = toxicity.FuzzyTrie(terms)
    rng = np.random.default_rng(0)
    words = ["idiot", "idoit", "idot", "iddiot", "scun", "worthles", "wrthlss", "worthlesss", "lowers", "low", "loser", "pathetik", "", "i"]
    for _ in range(400):
        w = list(terms[rng.integers(5)])
        for _ in range(rng.integers(4)):
            i = rng.integers(1, len(w) + 1)
            w[i : i + rng.integers(2)] = [] if rng.random() < 0.3 else [chr(97 + rng.integers(26))]
        words.append("".join(w))
    for w in words:
        got = trie.edits(w)
        want = brute(w, terms)
        # the first letter is kept in place, which the table of distances doesn't know
        assert got == want or (got is None or want is not None and got >= want), w
    assert trie.edits("idiot") == 0 and trie.edits("idot") == 1 and trie.edits("wrthlss") == 2 and trie.edits("scun") is None and trie.edits("lowers") == 0
    assert trie.strength("1d1ot") == 1.0 and trie.strength("id1ot") == 0.7


def test_first_letter_and_leading_symbols():
    trie = toxicity.FuzzyTrie(["abcdef", "worthless", "pat*"])
    for word in ("bcdef", "xbcdef", "xabcdef", "@bcdef", "*bcdef", "orthles", "vorthles"):
        assert trie.strength(word) > 0, word
    assert trie.strength("@bcdef") == trie.strength("*abcdef") == 1.0 and trie.edits("cdef") is None and trie.strength("xpat") == 0
    assert toxicity.hits_of("so @bcdef, !abcdef **** *", trie, set()) == (3, [("@bcdef", 1.0, False), ("!abcdef", 1.0, False)])
    few = toxicity.FuzzyTrie(["abcdef", "worthless"], most_items=10)
    rng = np.random.default_rng(1)
    for _ in range(300):
        w = list(("abcdef", "worthless")[rng.integers(2)])
        for _ in range(rng.integers(3)):
            i = rng.integers(0, len(w) + 1)
            w[i : i + rng.integers(2)] = [] if rng.random() < 0.3 else [chr(97 + rng.integers(26))]
        found = [brute("^" + "".join(w), ["^" + x]) for x in ("abcdef", "worthless")]
        if len(w) > 3:
            row = {x: toxicity.FuzzyTrie([x]).edits("".join(w)) for x in ("abcdef", "worthless")}
            assert few.edits("".join(w)) == min((e for e in row.values() if e is not None), default=None)
            assert row == dict(zip(row, found, strict=True))


def test_full_words_stay_under_prefixes():
    found = {"wort*": 50, "worth*": 20, "worthless": 20, "worthier": 18}
    assert toxicity.lexicon(found, 10) == ["wort*", "worthier", "worthless"]


def test_quotation_counts_less():
    trie = toxicity.FuzzyTrie(["idiot"])
    plain, quoted = toxicity.features("you idiot go away", trie, set()), toxicity.features('he said "idiot" to them', trie, set())
    assert plain[1] > 0 and plain[2] == 0 and quoted[1] == 0 and quoted[2] > 0


def test_toxicity_odd(spark, odd, none, docs, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == 10 and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
    assert toxicity.score(none, model).count() == 0 and toxicity.fit(docs, labels.where("false")) is None and toxicity.fit(none, labels) is None


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, sf_dir, name):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    cur = c.execute(queries.ORACLES[name])
    columns = [d[0] for d in cur.description]
    assert sorted(map(tuple, queries.QUERIES[name](spark, sf_dir).select(*columns).collect())) == sorted(cur.fetchall())


def test_quality_odd(odd, none):
    rows = {(r.doc_id, r.text): r for r in quality.judged(odd).collect()}
    assert quality.judged(odd).count() == 10 and quality.judged(none).count() == 0
    assert rows[1, None].n_words == 0 and rows[1, None].base_failed and not rows[1, None].kept
    r = rows[7, "one two\none two\r\nthree"]
    assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (5, 17, 0, 0)
    assert rows[next(k for k in rows if k[0] == 4)].n_words == 30_000


RULES = {"assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), "access": re.compile("AKIA[A-Z0-9]+"), "hex": re.compile("[0-9a-f]+")}


def found(text):
    out = []
    for rank, (kind, rule) in enumerate(RULES.items()):
        for m in rule.finditer(text or ""):
            if (len(m[2]) >= 6) if kind == "assign" else len(m[0]) >= (20 if kind == "access" else 24):
                out.append((m.start(), rank, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_secrets_equal_brute_force(spark, docs, odd, none):
    cases = ["token=token: abcdefgh", "é🚀 password = 'hunter22' x", "API_KEY=abc api-key=abcdefg ApiKey:zzzzzz", "AKIA" + "A" * 16 + " AKIAAKIA" + "B" * 15, "deadbeef" * 4 + "g" + "0" * 23, 'secret"="abcdef"', "tokentoken=aaaaaa=bbbbbbb", None, "", "ghp_" + "a" * 40]
    extra = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(cases)], "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionByName(extra)
    base = F.filter("spans", lambda s: s["kind"].isin(*RULES))
    for r in secrets.scan(rows).select("doc_id", "text", secrets.written(base).alias("w")).collect():
        assert r.w == found(r.text), r.doc_id
    assert secrets.scan(odd).count() == 10 and secrets.scan(none).count() == 0
    assert any("forge" in r.w for r in secrets.scan(extra).select(secrets.written(F.col("spans")).alias("w")).collect())


def test_trigram_queries():
    by = {r.name: secrets.mandatory(r) for r in secrets.RULES}
    assert by["hex"] == [] and by["access"] == [[frozenset({"aki", "kia"})]]
    assert all(any(a <= set(s[i : i + 3] for i in range(len(s))) for a in by["assign"][0]) for s in ("passwd=", "api_key:", "token ="))
    assert WORD.findall("a b") == ["a", "b"]


def test_pieces_lose_no_word(spark):
    """The automaton finds the same words with and without the test of pieces."""
    import random

    from vertebra.llm.toxicity import FuzzyTrie

    rng = random.Random(5)
    letters = "abcd"
    terms = ["".join(rng.choice(letters) for _ in range(rng.randint(4, 13))) + rng.choice(["", "", "*"]) for _ in range(60)]
    quick, plain = FuzzyTrie(terms), FuzzyTrie(terms)
    plain.may = lambda word: True
    for _ in range(4000):
        w = list(rng.choice(terms).rstrip("*"))
        for _ in range(rng.randint(0, 3)):
            at, what = rng.randint(0, len(w)), rng.random()
            w[at : at + (what > 0.3)] = [rng.choice(letters)] if what < 0.7 else []
        w = "".join(w)
        if w:
            assert quick.edits(w) == plain.edits(w)


def test_any_column_names(spark):
    """Columns named like an operator's own or hidden ones neither stop it nor get lost."""
    from vertebra.llm import quality, secrets, substring

    df = spark.createDataFrame([(1, "a b c token=abcdef123", "k", "w", "n")], "doc_id long, text string, __key string, __words string, N_Words string")
    for f, kept in ((quality.judged, False), (substring.parse, False), (secrets.scan, True)):
        r = f(df).first().asDict()
        assert r["__key"] == "k" and r["__words"] == "w" and ("N_Words" in r) == kept
