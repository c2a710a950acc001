"""Quality rules: a table of thresholds compiled into one projection of built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertebra.llm.common import WORD, WORD_GAPS, beside

# Frequent words of the four languages, in natural order.
STOP_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "on", "was", "be", "with", "as", "at", "by", "this", "have", "from"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par", "plus", "pas", "au", "sur"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para", "es", "al"],
}
SYMBOLS = "#*$%&|<>"

#: (rule, measure, least, most): a text fails a rule if the measure is below least or above most; None is no bound.
RULES = [
    ("length", "n_words", 50, None),
    ("repeated_words", "repeat_ratio", None, 0.5),
    ("symbols", "symbol_ratio", None, 0.3),
    ("word_length", "mean_word", 1.5, 20.0),
    ("duplicate_lines", "dup_line_ratio", None, 0.5),
    ("stop_words", "n_stop_words", 2, None),
    ("ellipsis_lines", "ellipsis_ratio", None, 0.5),
]
BASE_RULES = ("length", "repeated_words")


def measured(docs: DataFrame) -> DataFrame:
    """Adds the measures to every row; input columns so named are replaced. A null text counts as empty.

    Three-word windows are compared by sorting a text's windows: n log n in its length, whatever it repeats.
    """
    ours = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_ellipsis"]
    keep = [c for c in docs.columns if c not in ours]
    text = F.coalesce(F.col("text"), F.lit(""))
    stop = sorted({w for ws in STOP_WORDS.values() for w in ws})
    df = docs.select(*keep, F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("__words"), F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD)).alias("__lines"))
    words, n = F.col("__words"), F.size("__words")
    gone = lambda chars: F.char_length(F.translate(text, chars, ""))
    df = df.select(
        *keep, n.cast("long").alias("n_words"), gone(WORD_GAPS).cast("long").alias("word_chars"), (F.char_length(text) - gone(SYMBOLS)).cast("long").alias("n_symbols"),
        F.size("__lines").cast("long").alias("n_lines"), (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_intersect(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), F.array(*[F.lit(w) for w in stop]))).cast("long").alias("n_stop_words"),
        F.size(F.filter("__lines", lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))).cast("long").alias("n_ellipsis"),
        F.when(n >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.concat_ws(" ", words[i], words[i + 1], words[i + 2]).alias("w"), i.alias("at"))))).alias("__windows"),
    )
    w = F.col("__windows")
    twice = lambda i: (F.get(w, i - 1)["w"] == w[i]["w"]) | (F.get(w, i + 1)["w"] == w[i]["w"])
    found = F.array_compact(F.transform(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.when(F.coalesce(twice(i), F.lit(False)), w[i]["at"])))
    df = df.select(*keep, *ours[:5], F.sort_array(found).alias("__at"), "n_stop_words", "n_ellipsis")
    at = F.col("__at")
    covered = F.aggregate(F.sequence(F.lit(0), F.size(at) - 1), F.lit(0).cast("long"), lambda s, i: s + F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - at[i], F.lit(3))))
    return df.select(*keep, *ours[:5], F.when(F.size(at) > 0, covered).otherwise(F.lit(0).cast("long")).alias("n_repeat_words"), "n_stop_words", "n_ellipsis")


def ratios() -> dict[str, Column]:
    safe = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return {
        "n_words": F.col("n_words"), "n_stop_words": F.col("n_stop_words"), "repeat_ratio": safe("n_repeat_words", "n_words"), "symbol_ratio": safe("n_symbols", "word_chars"),
        "mean_word": safe("word_chars", "n_words"), "dup_line_ratio": safe("n_dup_lines", "n_lines"), "ellipsis_ratio": safe("n_ellipsis", "n_lines"),
    }


def failures(rules: list[tuple] = RULES) -> dict[str, Column]:
    """One Boolean expression per rule of the table, over the columns of measured()."""
    values, out = ratios(), {}
    for name, measure, least, most in rules:
        bad = F.lit(False)
        if least is not None:
            bad = bad | (values[measure] < least)
        if most is not None:
            bad = bad | (values[measure] > most)
        out[name] = bad
    return out


@beside(("doc_id", "text"), ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_ellipsis", "failed", "base_failed", "kept"))
def judged(docs: DataFrame, rules: list[tuple] = RULES) -> DataFrame:
    """Adds the measures, failed (names of the failed rules), base_failed and kept to every row.

    An empty or null text fails the length rule. Every row of the input is returned, repeated rows too.
    """
    bad = failures(rules)
    df = measured(docs.select(*[c for c in docs.columns if c not in ("failed", "base_failed", "kept")]))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    failed = F.array_compact(F.array(*[F.when(b, F.lit(name)) for name, b in bad.items()]))
    return df.withColumn("failed", failed).withColumn("base_failed", base).withColumn("kept", ~base & (F.size("failed") == 0))
