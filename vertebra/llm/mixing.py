"""Mixing sources to target weights by Sainte-Laguë apportionment of equal blocks of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vertebra.llm.common import WORD, few_or_plain

#: Primes above the block count of any shard, for the seeded orders of blocks.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """Adds target to (source, source_size): all words shared out by weight, none above cap times its source's size.

    Sources weigh weights[0], weights[1], ... in code-point order, null last, over and over. What a source can't take
    is shared among the others by weight again; with sources ordered by cap * size / weight that is one water level.
    One row per source passes through one task here.
    """
    order, level = W.orderBy(F.col("source").asc_nulls_last()), W.orderBy("__full", "__rank")
    all_rows = W.partitionBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("__rank") - 1) % len(weights) + 1).cast("int"))
    df = sources.withColumn("__rank", F.row_number().over(order)).withColumn("__weight", weight)
    df = df.withColumn("__full", cap * F.col("source_size") / F.col("__weight")).withColumn("__total", F.sum("source_size").over(all_rows))
    filled = F.coalesce(F.sum(cap * F.col("source_size")).over(level.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    df = df.withColumn("__level", (F.col("__total") - filled) / F.sum("__weight").over(level.rowsBetween(0, W.unboundedFollowing)))
    fits = F.when(F.col("__level") <= F.col("__full"), F.struct("__full", "__rank", "__level"))
    df = df.withColumn("__level", F.coalesce(F.min(fits).over(all_rows)["__level"], F.lit(0.0)))
    return df.select(*sources.columns, F.col("__rank").alias("source_rank"), F.least(F.col("__level") * F.col("__weight"), cap * F.col("source_size")).alias("target"))


def apportion(parties: DataFrame, group: list[str], weight: str, seats: str, tie: str, out: str) -> DataFrame:
    """Adds a whole number of seats to each party: the highest quotients weight / (2k + 1) of its group win.

    seats is the group's number of seats, equal in all its rows. A divisor a little too large gives each party seats
    that are surely its own, one a little too small those it can have at most; only the quotients between are ranked,
    a few per party whatever the number of seats.
    """
    whole = W.partitionBy(*[F.col(g) for g in group]) if group else W.partitionBy(F.lit(0))
    df = parties.withColumn("__sum", F.sum(weight).over(whole)).withColumn("__n", F.count(F.lit(1)).over(whole))
    ratio = F.when(F.col("__sum") > 0, F.col(weight) / F.col("__sum")).otherwise(F.lit(0.0))
    df = df.withColumn("__low", F.greatest(F.lit(0), F.floor(ratio * (F.col(seats) - F.col("__n") / 2) + 0.5) - 1).cast("long"))
    df = df.withColumn("__high", (F.floor(ratio * (F.col(seats) + F.col("__n") / 2) + 0.5) + 1).cast("long"))
    df = df.withColumn("__left", F.col(seats) - F.sum("__low").over(whole)).withColumn("__party", F.struct(*[F.col(c) for c in parties.columns]))
    tries = df.select(*group, "__party", "__low", "__left", F.col(tie).alias("__tie"), F.col(weight).alias("__w"), F.explode(F.sequence("__low", "__high")).alias("__k"))
    tries = tries.withColumn("__quotient", F.col("__w") / (2 * F.col("__k") + 1))
    best = (W.partitionBy(*[F.col(g) for g in group]) if group else W.partitionBy(F.lit(0))).orderBy(F.desc("__quotient"), "__tie", "__k")
    tries = tries.withColumn("__won", (F.row_number().over(best) <= F.col("__left")) & (F.col("__w") > 0))
    got = tries.groupBy("__party").agg((F.first("__low") + F.sum(F.col("__won").cast("long"))).alias(out))
    return got.select("__party.*", out)


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, block_words: int = 64, shard_rows: int = 4096, seed: int = 17) -> DataFrame:
    """Adds size, source_size, target, taken, __source, __shard and __order to every row; input columns so named are replaced.

    A source's documents are dealt by hash to shards of about shard_rows rows; a shard's documents, in seeded order, form
    a stream of words that is cut into blocks: of block_words words, or fewer in all sources if the smallest target is
    under 64 such blocks (a 64th of it, at least a word), so that rounding to blocks stays small against any target. Sainte-Laguë gives each source blocks by its target, then
    each shard of the source blocks by its size. A shard with n blocks and quota q takes every block q div n times and
    q mod n blocks, chosen by a seeded order, once more. taken counts the words of a document in the blocks so taken.

    A null text or a text of gaps has size 0 and takes 0. A null source is a source of its own, last in order. Equal rows
    share a shard; which of them a block falls on is not fixed, the rows' taken values as a whole are. No rows give no rows.
    """
    ours = {"size", "source_size", "target", "taken"}
    docs = docs.select(*[c for c in docs.columns if c not in ours])
    key = F.struct(F.col("source").isNull().alias("none"), F.coalesce(F.col("source"), F.lit("")).alias("name"))
    rows = docs.groupBy(key.alias("__source")).agg(F.count(F.lit(1)).alias("__rows"))
    n_sources = rows.count()
    per = few_or_plain(rows.select("__source", F.ceil(F.col("__rows") / shard_rows).cast("int").alias("__shards")), n_sources)
    sized = docs.withColumn("__source", key).join(per, "__source").withColumn("size", n_words(F.col("text")))
    sized = sized.withColumn("__order", F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size"), F.xxhash64("text")))
    sized = sized.withColumn("__shard", F.pmod(F.xxhash64(F.lit(seed + 1), F.col("__order")), F.col("__shards")).cast("int")).drop("__shards")

    shards = sized.groupBy("__source", "__shard").agg(F.sum("size").alias("shard_size"))
    sources = shards.groupBy("__source").agg(F.sum("shard_size").alias("source_size"))
    sources = source_targets(sources.select(F.when(~F.col("__source.none"), F.col("__source.name")).alias("source"), "__source", "source_size"), weights, cap)
    total = F.sum("source_size").over(W.partitionBy(F.lit(0)))
    least = F.min(F.when(F.col("target") > 0, F.col("target"))).over(W.partitionBy(F.lit(0)))
    block = F.coalesce(F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(least / 64))), F.lit(block_words)).cast("long")
    sources = sources.withColumn("__block", block).withColumn("__blocks", F.round(total / F.col("__block")).cast("long"))
    sources = apportion(sources, [], "target", "__blocks", "source_rank", "source_quota")
    shards = shards.join(few_or_plain(sources.select("__source", "source_size", "target", "source_quota", "__block"), n_sources), "__source")
    shards = apportion(shards, ["__source"], "shard_size", "source_quota", "__shard", "quota")
    n = F.ceil(F.col("shard_size") / F.col("__block")).cast("long")
    shards = shards.withColumn("__n", n).withColumn("quota", F.least(F.col("quota"), cap * n))

    stream = W.partitionBy("__source", "__shard").orderBy("__order").rowsBetween(W.unboundedPreceding, W.currentRow)
    df = sized.withColumn("__to", F.sum("size").over(stream)).join(shards.select("__source", "__shard", "source_size", "target", "quota", "__n", "__block"), ["__source", "__shard"])
    shard_seed = F.xxhash64(F.lit(seed), F.col("__source"), F.col("__shard"))
    times, at = F.element_at(F.array(*[F.lit(p) for p in PRIMES]), (F.pmod(shard_seed, F.lit(len(PRIMES))) + 1).cast("int")), F.col("__to") - F.col("size")
    df = df.withColumn("__times", times).withColumn("__shift", F.pmod(shard_seed, F.greatest(F.col("__n"), F.lit(1)))).withColumn("__from", at)

    def words_of(block: Column) -> Column:
        more = F.pmod(F.col("__times") * block + F.col("__shift"), F.col("__n")) < F.col("quota") % F.col("__n")
        inside = F.least(F.col("__to"), (block + 1) * F.col("__block")) - F.greatest(F.col("__from"), block * F.col("__block"))
        return (F.floor(F.col("quota") / F.col("__n")) + more.cast("long")) * inside

    blocks = F.sequence(F.floor(F.col("__from") / F.col("__block")), F.floor((F.col("__to") - 1) / F.col("__block")))
    taken = F.when(F.col("size") > 0, F.aggregate(blocks, F.lit(0).cast("long"), lambda total, b: total + words_of(b))).otherwise(F.lit(0).cast("long"))
    return df.withColumn("taken", taken).select(*docs.columns, "size", "source_size", "target", "taken", "__source", "__shard", "__order")


def whole_documents(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of mix() as whole documents, each as often as its share says.

    Documents of a shard are run through by size with a running sum of taken / size; a document is returned once for each
    whole number that the sum passes on it. So a shard's words stay within about one document of what its blocks take.
    """
    share = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(F.lit(0.0))
    run = W.partitionBy("__source", "__shard").orderBy("size", "__order").rowsBetween(W.unboundedPreceding, W.currentRow)
    df = mixed.withColumn("__share", share).withColumn("__sum", F.sum("__share").over(run))
    copies = (F.floor(F.col("__sum") + 0.5) - F.floor(F.col("__sum") - F.col("__share") + 0.5)).cast("int")
    return df.withColumn("__copies", copies).where("__copies > 0").select(*columns, F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias("__copy")).drop("__copy")
