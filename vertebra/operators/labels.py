"""The algebra of structural labels. A label's path is an array of tokens that starts with the root "_"."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROOT = "_"


def _texts(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def matches_all(labels: DataFrame, wanted: list[str]) -> DataFrame:
    """Primary labels whose path has all tokens, in any order. Nulls in the list are skipped; an empty list is an error."""
    return labels.where(F.col("is_primary") & F.forall(_texts(checked(wanted)), lambda x: F.array_contains("tokens", x)))


def matches_any(labels: DataFrame, wanted: list[str]) -> DataFrame:
    """Primary labels whose path has any of the tokens."""
    return labels.where(F.col("is_primary") & F.arrays_overlap("tokens", _texts(checked(wanted))))


def checked(wanted: list[str] | None) -> list[str]:
    if wanted is None:
        raise ValueError("label array must not be NULL")
    out = [w for w in wanted if w is not None]
    if not out:
        raise ValueError("label array must not be empty")
    return out


def merged_tokens(parent: Column, child: Column) -> Column:
    """Root, the parent's tokens, the child's tokens."""
    tail = lambda t: F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0)))
    return F.concat(F.array(F.lit(ROOT)), tail(parent), tail(child))


def merged_map(parent: Column, child: Column) -> Column:
    """The parent's annotations, then those only the child has."""
    none = F.array().cast("array<string>")
    return F.array_union(F.coalesce(parent, none), F.coalesce(child, none))


def without_first(tokens: Column, token: str) -> Column:
    """The path without the token's first occurrence; the root alone if nothing is left."""
    at = F.array_position(tokens, F.lit(token)).cast("int")
    rest = F.concat(F.slice(tokens, F.lit(1), at - 1), F.slice(tokens, at + 1, F.size(tokens)))
    return F.when(at > 0, F.when(F.size(rest) == 0, F.array(F.lit(ROOT))).otherwise(rest)).otherwise(tokens)


def dropped(labels: DataFrame, token: str) -> DataFrame:
    """Labels after a token is dropped: only paths change, and a label whose last token went is no longer primary."""
    if token == ROOT:
        raise ValueError("the root label cannot be dropped")
    last = F.array_position("tokens", F.lit(token)) == F.size("tokens")
    had = F.array_contains("tokens", token)
    return labels.withColumns({"is_primary": F.col("is_primary") & ~(had & last), "tokens": without_first(F.col("tokens"), token)})


def renamed(labels: DataFrame, old: str, new: str) -> DataFrame:
    """Every occurrence of a token, in every label, primary or not."""
    return labels.withColumn("tokens", F.transform("tokens", lambda x: F.when(x == old, F.lit(new)).otherwise(x)))


def descends(tokens: Column, ancestor: list[str]) -> Column:
    """Whether the path starts with the ancestor's path (or is it)."""
    return F.slice(tokens, 1, len(ancestor)) == _texts(ancestor)


def by_path(labels: DataFrame, path: str) -> DataFrame:
    """The first label whose path without the root is this one; the empty path is the root."""
    tokens = [ROOT, *[t for t in path.split(".") if t]]
    return labels.where(F.col("tokens") == _texts(tokens)).groupBy().agg(F.min("label_id").alias("label_id")).where("label_id is not null")
