"""Toxicity: a lexicon trie crossed with Levenshtein automata, and context windows that tell quotation from abuse."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertebra.llm.common import beside, few_or_plain, lean, learnable, saved, slices, with_fields

# A word may start with symbols that stand for letters; their run is read once, so that long rows of them cost no more.
LEADS = "@$*!"
TOKEN = re.compile(r"(?:(?<![@$*!])[@$*!]++)?[^\W_](?:[\w@$*!]*[^\W_])?|[\"“”„«»]")
LEET = str.maketrans("013457@$!", "oieastasi")
# Marks and verbs that announce a quotation.
QUOTE_MARKS = {'"', "“", "”", "„", "«", "»"}
REPORTING = {"said", "says", "wrote", "quoted", "quote", "called", "reported", "sagte", "schrieb", "zitat", "écrit", "déclaré", "citation", "dijo", "escribió", "cita"}


class FuzzyTrie:
    """Words and prefixes (ending in *) within a few edits, as one automaton made on demand.

    A state is a set of (trie node, edits so far); reading a character keeps it, changes it, skips it or skips a trie
    character, as the Levenshtein automaton of each term would. Sets and moves are remembered, so a word costs one look-up
    per character. Edits may be anywhere, the first character included; prefixes must fit exactly; words of at least 5 (9)
    characters may have 1 (2) edits. What is remembered is bounded, and then made anew.

    A term cut into one piece more than the edits it allows keeps a piece whole in each word that it fits: the first one at
    the start, the last one at the end, one between near its place. Words without such a piece don't enter the automaton.
    """

    def __init__(self, terms: list[str], most_words: int = 200_000, most_items: int = 200_000):
        self.children: list[dict[str, int]] = [{}]
        self.ends: dict[int, int] = {}
        self.stars: set[int] = set()
        self.most_words, self.most_items = most_words, most_items
        for term in sorted(terms):
            node = 0
            for c in term.rstrip("*"):
                if c not in self.children[node]:
                    self.children.append({})
                    self.children[node][c] = len(self.children) - 1
                node = self.children[node][c]
            if term.endswith("*"):
                self.stars.add(node)
            else:
                self.ends[node] = 2 if len(term) >= 9 else 1 if len(term) >= 5 else 0
        self.pieces: set[tuple[str, int, int, str]] = set()
        self.cuts: set[tuple[str, int, int, bool]] = set()
        for term in terms:
            self._cut(term)
        self.deepest = self._deepest()
        first: dict[int, int] = {}
        self._add(first, 0, 0)
        self.first = frozenset(first.items())
        self._forget()
        self.known: dict[str, float] = {}

    def _cut(self, term: str) -> None:
        """Pieces: (where, place, size of the word or 0 for any, piece)."""
        if term.endswith("*"):
            self._piece("start", 0, range(1), term.rstrip("*"))
            return
        e = 2 if len(term) >= 9 else 1 if len(term) >= 5 else 0
        sizes = range(len(term) - e, len(term) + e + 1)
        at = [len(term) * i // (e + 1) for i in range(e + 2)]
        for i, (a, b) in enumerate(zip(at, at[1:], strict=False)):
            if i in (0, e):
                self._piece("start" if i == 0 else "end", 0, sizes, term[a:b])
            else:
                for place in range(max(0, a - e), a + e + 1):
                    self._piece("middle", place, sizes, term[a:b])

    def _piece(self, where: str, place: int, sizes: range, piece: str) -> None:
        self.cuts.add((where, place, len(piece), not sizes[-1]))
        self.pieces.update((where, place, n, piece) for n in sizes)

    def may(self, word: str) -> bool:
        """Whether a piece of some term is where edits would have left it."""
        size, pieces = len(word), self.pieces
        for where, place, k, any_size in self.cuts:
            piece = word[place : place + k] if where != "end" else word[-k:]
            if (where, place, 0 if any_size else size, piece) in pieces:
                return True
        return False

    def _forget(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.starred: list[bool] = []
        self.accepted: list[int | None] = []
        self.items = 0
        self.start = self._state(self.first)

    def _deepest(self) -> list[int]:
        """The most edits that any word below a node allows."""
        most = [-1] * len(self.children)
        for node in range(len(self.children) - 1, -1, -1):
            most[node] = max([self.ends.get(node, 0), *(most[c] for c in self.children[node].values())])
        return most

    def _state(self, items: frozenset) -> int:
        if items not in self.states:
            self.states[items] = len(self.sets)
            self.sets.append(items)
            self.moves.append({})
            self.starred.append(any(e == 0 and n in self.stars for n, e in items))
            self.accepted.append(min((e for n, e in items if e <= self.ends.get(n, -1)), default=None))
            self.items += len(items) + 1
        return self.states[items]

    def _add(self, out: dict[int, int], node: int, edits: int) -> None:
        """A node reached with so many edits, and those that skipping trie characters reaches from there."""
        if edits <= self.deepest[node] and edits < out.get(node, 99):
            out[node] = edits
            for child in self.children[node].values():
                self._add(out, child, edits + 1)

    def _step(self, state: int, c: str) -> int:
        out: dict[int, int] = {}
        for node, edits in self.sets[state]:
            if c in self.children[node]:
                self._add(out, self.children[node][c], edits)
            if edits < self.deepest[node]:
                self._add(out, node, edits + 1)
                for child in self.children[node].values():
                    self._add(out, child, edits + 1)
        to = self._state(frozenset(out.items()))
        self.moves[state][c] = to
        return to

    def edits(self, word: str) -> int | None:
        """Fewest edits to a term that allows them; None if there is none."""
        if not self.may(word):
            return None
        if self.items > self.most_items:
            self._forget()
        state = self.start
        for c in word:
            to = self.moves[state].get(c)
            state = self._step(state, c) if to is None else to
            if self.starred[state]:
                return 0
            if not self.sets[state]:
                return None
        return self.accepted[state]

    def strength(self, word: str) -> float:
        """1 for a term, 0.7 and 0.5 for one and two edits, else 0; leading symbols count as letters or not at all."""
        got = self.known.get(word)
        if got is None:
            bare = word.lstrip(LEADS)
            e = self.edits(bare)
            if e is None and not bare.isalpha():
                e = self.edits(bare.translate(LEET))
            if bare != word and e != 0:
                e = min((x for x in (e, self.edits(word), self.edits(word.translate(LEET))) if x is not None), default=None)
            got = 0.0 if e is None else (1.0, 0.7, 0.5)[e]
            if len(self.known) >= self.most_words:
                self.known.clear()
            self.known[word] = got
        return got


@dataclass
class Model:
    terms: list[str]
    exceptions: set[str] = field(default_factory=set)
    weights: list[float] = field(default_factory=lambda: [0.0, 0.0, 0.0, 0.0])


def hits_of(text: str, trie: FuzzyTrie, exceptions: set[str], window: int = 6) -> tuple[int, list[tuple[str, float, bool]]]:
    """Number of tokens, and each hit's token, strength and whether its window of tokens reports or quotes."""
    tokens = TOKEN.findall(text.lower())
    known, strength = trie.known, trie.strength
    found = [i for i, w in enumerate(tokens) if (known[w] if w in known else strength(w))]
    out = []
    for i in found:
        w = tokens[i]
        s = strength(w)
        if s < 1 and (w in exceptions or w.lstrip(LEADS) in exceptions):
            continue
        near = tokens[max(0, i - window) : i + window + 1]
        out.append((w, s, any(x in QUOTE_MARKS or x.lstrip(LEADS) in REPORTING for x in near)))
    return len(tokens), out


def features(text: str, trie: FuzzyTrie, exceptions: set[str]) -> list[float]:
    n, hits = hits_of(text, trie, exceptions)
    abuse, quoted = sum(s for _, s, q in hits if not q), sum(s for _, s, q in hits if q)
    return [1.0, float(np.log1p(abuse)), float(np.log1p(quoted)), min(1.0, 10 * (abuse + quoted) / max(n, 1))]


def fit(docs: DataFrame, labels: DataFrame, rows_per_class: int = 4096, most_bytes: int = 1 << 16, most_terms: int = 2000, least_rows: int = 3, purity: float = 0.8) -> Model | None:
    """Lexicon, exceptions and weights from labelled documents that may be learned from; None without both classes.

    The sample: whole texts of at most most_bytes bytes, about rows_per_class different ones per class, by a hash of the
    id. Terms are words, or prefixes of 3 to 8 characters, found in at least least_rows toxic texts and at least `purity`
    toxic after weighing classes by their true sizes, and beyond
    what chance gives any of the many candidates (a likelihood-ratio bound). A prefix gives way to a longer term that finds nearly as many.
    Conflicting labels of one id count as toxic.
    """
    spark = docs.sparkSession
    marked = labels.where(F.col("toxic").isNotNull() & learnable(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r.toxic: r.n for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).where("toxic in (0, 1)").collect()}
    if len(sizes) < 2:
        return None
    rate = F.when(F.col("toxic") == 1, F.lit(rows_per_class / sizes[1])).otherwise(F.lit(rows_per_class / sizes[0]))
    chosen = marked.where(F.col("toxic").isin(0, 1) & (F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 30)) < rate * (1 << 30)))
    chosen = few_or_plain(chosen, 2 * rows_per_class if sum(sizes.values()) > 2 * rows_per_class else sum(sizes.values()))
    sample = docs.select("doc_id", "text").where(F.col("text").isNotNull() & (F.octet_length("text") <= most_bytes)).join(chosen, "doc_id").select("toxic", "text").distinct()

    def terms(batches):
        for part in slices(batches, 1, 1 << 20):
            seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for y, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                words = {w.translate(LEET) if not w.isalpha() else w for w in (x.lstrip(LEADS) for x in TOKEN.findall(text.lower()))}
                words = {w for w in words if 4 <= len(w) <= 40}
                seen[y].update(words)
                seen[y].update({w[:n] + "*" for w in words for n in range(3, min(9, len(w)))})
            for y, c in seen.items():
                yield pa.record_batch([pa.array(c.keys(), pa.string()), pa.array([y * n for n in c.values()], pa.int64()), pa.array([(1 - y) * n for n in c.values()], pa.int64())], names=["term", "bad", "good"])

    got = sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()
    n = {r.toxic: r.n for r in got}
    if len(n) < 2:
        return None
    weigh = {y: sizes[y] / n[y] for y in n}
    counted = sample.mapInArrow(lean(terms), "term string, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    pure = weigh[1] * F.col("bad") / (weigh[1] * F.col("bad") + weigh[0] * F.col("good"))
    prior = n[1] / (n[0] + n[1])
    share = F.col("bad") / (F.col("bad") + F.col("good"))
    other = F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - prior))).otherwise(F.lit(0.0))
    gain = (F.col("bad") + F.col("good")) * (share * F.log(share / prior) + other)
    counted = saved(counted.where(F.col("bad") >= least_rows))
    sure = float(np.log(max(counted.count(), 1))) + 3.0
    best = counted.where((gain >= sure) & (pure >= purity)).orderBy(F.desc("bad"), "term").limit(20 * most_terms).collect()
    model = Model(lexicon({r.term: r.bad for r in best}, most_terms))
    shared = spark.sparkContext.broadcast(model)

    def fuzzy(batches):
        trie = FuzzyTrie(shared.value.terms)
        for part in slices(batches, 1, 1 << 20):
            c: Counter = Counter()
            for y, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                c.update({(w, y) for w, s, _ in hits_of(text, trie, set())[1] if s < 1})
            yield pa.record_batch([pa.array([w for w, _ in c], pa.string()), pa.array([n if y else 0 for (_, y), n in c.items()], pa.int64()), pa.array([0 if y else n for (_, y), n in c.items()], pa.int64())], names=["word", "bad", "good"])

    forms = sample.mapInArrow(lean(fuzzy), "word string, bad long, good long").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    model.exceptions = {r.word for r in forms.where((pure < purity) & (F.col("good") > 0)).orderBy(F.desc("good"), "word").limit(20 * most_terms).collect()}
    shared = spark.sparkContext.broadcast(model)

    def measure(batches):
        m = shared.value
        trie = FuzzyTrie(m.terms)
        for part in slices(batches, 1, 1 << 20):
            rows = [features(t, trie, m.exceptions) for t in part.column(1).to_pylist()]
            yield pa.record_batch([part.column(0), *[pa.array([r[i] for r in rows], pa.float64()) for i in range(4)]], names=["toxic", "f0", "f1", "f2", "f3"])

    table = sample.mapInArrow(lean(measure), "toxic int, f0 double, f1 double, f2 double, f3 double").toArrow()
    x = np.column_stack([table[f"f{i}"].to_numpy() for i in range(4)])
    y = table["toxic"].to_numpy()
    order = np.lexsort((*x.T, y))
    model.weights = logistic(x[order], y[order], np.array([weigh[int(v)] for v in y[order]]))
    return model


def lexicon(found: dict[str, int], most: int) -> list[str]:
    """Of the terms and the number of texts with each, those that no other makes needless.

    Full words under a prefix stay for their misspellings, up to `most` besides the others.
    """
    longer: Counter = Counter()
    for term, n in found.items():
        stem = term.rstrip("*")
        parent = stem[:-1] + "*"
        longer[parent] = max(longer[parent], n)
    stars = {t for t, n in found.items() if t.endswith("*") and longer[t] < 0.8 * n}
    keep, under = [], []
    for term in sorted(found, key=lambda t: (-found[t], t)):
        if term.endswith("*") and term not in stars:
            continue
        stem = term.rstrip("*")
        if not any(stem[:k] + "*" in stars for k in range(3, len(stem) if term.endswith("*") else len(stem))):
            keep.append(term)
        elif not term.endswith("*"):
            under.append(term)
    return sorted(keep[:most] + under[:most])


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 0.05, steps: int = 50) -> list[float]:
    """Weighted logistic regression by Newton steps; the constant is not shrunk."""
    beta, w = np.zeros(x.shape[1]), w / w.sum() * len(w)
    shrink = np.full(x.shape[1], ridge * np.sqrt(len(y)))
    shrink[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + np.diag(shrink + 1e-9), x.T @ (w * (y - p)) - shrink * beta)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return [float(b) for b in beta]


@beside(("text",), ("score", "predicted", "n_terms"))
def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """Adds score (0 to 1), predicted (1 if score >= 0.5) and n_terms to every row; columns so named are replaced.

    Null and empty texts have no terms and get the score of such a text. Without a model the score is 0. Equal texts, and so
    repeated rows, get equal scores; a score of exactly 0.5 counts as toxic; an empty table gives no rows.
    """
    if model is None:
        return docs.select("*", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.lit(0).alias("n_terms"))
    shared, columns = docs.sparkSession.sparkContext.broadcast(model), docs.columns
    schema = with_fields(docs, "score double, predicted int, n_terms int")

    def run(batches):
        m, at = shared.value, columns.index("text")
        trie, w = FuzzyTrie(m.terms), np.array(m.weights)
        for part in slices(batches, at, 1 << 20):
            x = [features(t or "", trie, m.exceptions) for t in part.column(at).to_pylist()]
            s = 1 / (1 + np.exp(-np.clip(np.array(x) @ w, -30, 30)))
            terms = [int(np.ceil(np.expm1(r[1]) + np.expm1(r[2]) - 1e-9)) for r in x]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(terms, pa.int32())], names=[*columns, "score", "predicted", "n_terms"])

    return docs.mapInArrow(lean(run), schema)
