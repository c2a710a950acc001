"""Secret scans through a trigram inverted index, in DataFrame functions only."""

from __future__ import annotations

import re._constants as op
import re._parser as pattern_parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertebra.llm.common import beside


@dataclass(frozen=True)
class Rule:
    """regex: what to find, leftmost and without overlaps; group `checked` needs `least` characters, other matches are dropped."""

    name: str
    regex: str
    checked: int = 0
    least: int = 1
    any_case: bool = False


# The three kinds that every scan reports.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Further kinds, each of a form that prose does not take.
MORE_RULES = (
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[baprs]-[A-Za-z0-9-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE_RULES + MORE_RULES


def mandatory(rule: Rule, most: int = 32) -> list[list[frozenset[str]]]:
    """The rule's trigrams as a conjunction of disjunctions of trigram sets, in lower case.

    Walks the parsed regex. Literals, small branches and optional literals extend a set of strings that must occur as one
    run; anything else closes the run. Each run of which every string has a trigram demands that, for one of its strings,
    all trigrams occur. No runs: the rule has no mandatory trigram.
    """
    runs: list[set[str]] = []

    def strings(items) -> set[str] | None:
        """All strings that the items can match, if they are few."""
        out = {""}
        for kind, arg in items:
            if kind is op.LITERAL:
                more: set[str] | None = {chr(arg).lower()}
            elif kind is op.SUBPATTERN:
                more = strings(arg[3])
            elif kind is op.BRANCH:
                parts = [strings(x) for x in arg[1]]
                more = None if None in parts else set().union(*parts)
            elif kind is op.MAX_REPEAT and arg[1] == 1:
                once = strings(arg[2])
                more = None if once is None else once | ({""} if arg[0] == 0 else set())
            elif kind is op.IN and all(k is op.LITERAL for k, _ in arg):
                more = {chr(c).lower() for _, c in arg}
            else:
                return None
            if more is None or len(out) * len(more) > most:
                return None
            out = {a + b for a in out for b in more}
        return out

    now = {""}
    for item in pattern_parser.parse(rule.regex):
        more = strings([item])
        if more is None or len(now) * len(more) > most:
            runs.append(now)
            now = {""} if more is None else more
        else:
            now = {a + b for a in now for b in more}
    runs.append(now)
    return [sorted((frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run), key=sorted) for run in runs if all(len(s) >= 3 for s in run)]


def key_of(docs: DataFrame) -> Column:
    """A key for the index. Rows that share one share their postings, which can only add candidates."""
    return F.xxhash64(F.col("doc_id"), F.col("text"))


def postings(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The inverted index (trigram, doc_key) of the trigrams that rules ask for, over the whole texts of all documents."""
    asked = sorted({t for r in rules for run in mandatory(r) for alternative in run for t in alternative})
    low = docs.select(key_of(docs).alias("doc_key"), F.lower("text").alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in asked]))
    return low.select("doc_key", F.explode(held).alias("trigram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_key, rules): the rules whose trigram queries a document's postings satisfy."""
    hits = index.groupBy("doc_key").agg(F.collect_set("trigram").alias("held"))
    wanted = []
    for r in rules:
        query = mandatory(r)
        if query:
            every = F.lit(True)
            for run in query:
                some = F.lit(False)
                for alternative in run:
                    some = some | (F.size(F.array_intersect("held", F.array(*[F.lit(t) for t in sorted(alternative)]))) == len(alternative))
                every = every & some
            wanted.append(F.when(every, F.lit(r.name)))
    found = hits.select("doc_key", F.array_compact(F.array(*wanted)).alias("rules"))
    return found.where(F.size("rules") > 0)


def matches(text: Column, rule: Rule, rank: int) -> Column:
    """The rule's matches as an array of structs (start, rank, end, kind), in code points.

    Splitting at the pattern gives the gaps before each match, so positions are running sums of lengths.
    """
    regex = ("(?i)" if rule.any_case else "") + rule.regex
    found, gaps = F.regexp_extract_all(text, F.lit(regex), F.lit(0)), F.split(text, regex, -1)
    checked = F.regexp_extract_all(text, F.lit(regex), F.lit(rule.checked)) if rule.checked else found
    zipped = F.arrays_zip(found.alias("found"), checked.alias("checked"), F.slice(gaps, 1, F.size(found)).alias("gap"))
    kind = f"struct<start:int,rank:int,end:int,kind:string>"
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("spans"))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.char_length(x["gap"])
        end = start + F.char_length(x["found"])
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.name).alias("kind"))
        return F.struct(end.alias("at"), F.when(F.char_length(x["checked"]) >= rule.least, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(zipped, empty, step, lambda state: state["spans"])


@beside(("doc_id", "text"), ("spans",))
def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds spans, an array of (start, rank, end, kind) by start and then by the rules' order, to every row.

    Rules with trigram queries run only over the documents that the index gives as candidates; the others over all.
    Positions are code points, ends exclusive. A null text counts as empty. Equal rows are all returned.
    """
    docs = docs.select(*[c for c in docs.columns if c != "spans"])
    text = F.coalesce(F.col("text"), F.lit(""))
    found = candidates(postings(docs, rules), rules).withColumnRenamed("doc_key", "__key").withColumnRenamed("rules", "__rules")
    df = docs.withColumn("__key", key_of(docs)).join(found, "__key", "left")
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    parts = []
    for rank, r in enumerate(rules):
        guard = F.array_contains("__rules", r.name) if mandatory(r) else text.rlike(r.regex)
        parts.append(F.when(guard, matches(text, r, rank)).otherwise(none))
    return df.withColumn("spans", F.sort_array(F.concat(*parts))).drop("__key", "__rules")


def written(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
