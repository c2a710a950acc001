"""Language identification by prediction by partial matching (PPM) over bytes, with frozen statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertebra.llm.common import beside, buffers, lean, learnable, slices, with_fields


@dataclass
class Model:
    """Context trees of all languages, level by level.

    levels[n]: for contexts of n bytes, sorted codes of context + next byte with counts [code, language], and sorted
    codes of the contexts with totals and numbers of different next bytes [code, language].
    """

    langs: list[str]
    order: int
    levels: list[dict[str, np.ndarray]]

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each code (order + 1 bytes) in each language, as an array [code, language].

        From the longest context down: a context that has seen the byte codes it with count / (total + different); one
        that has not codes an escape with different / (total + different) (method C); one never seen costs nothing.
        Below order 0 the 256 bytes are alike.
        """
        n = len(self.langs)
        cost, todo = np.zeros((len(codes), n)), np.ones((len(codes), n), dtype=bool)
        for k in range(self.order, -1, -1):
            level = self.levels[k]
            seen = find(level["grams"], codes & np.uint64((1 << 8 * (k + 1)) - 1), level["counts"])
            context = (codes >> np.uint64(8)) & np.uint64((1 << 8 * k) - 1)
            total, kinds = find(level["contexts"], context, level["totals"]), find(level["contexts"], context, level["kinds"])
            both = np.maximum(total + kinds, 1)
            hit, escape = todo & (seen > 0), todo & (seen == 0) & (total > 0)
            cost -= np.log2(np.where(hit, seen, 1) / np.where(hit, both, 1)) + np.log2(np.where(escape, kinds, 1) / np.where(escape, both, 1))
            todo &= seen == 0
        return cost + 8.0 * todo


def find(keys: np.ndarray, wanted: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where((keys[at] == wanted)[:, None], values[at], 0)


def codes_of(data: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """For each byte, the code of it and the `order` bytes before it in the same text (zero bytes before the start)."""
    codes, left = np.zeros(len(data), dtype=np.uint64), np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    for back in range(order + 1):
        part = np.zeros(len(data), dtype=np.uint64)
        part[back:] = data[: len(data) - back]
        part[left < back] = 0
        codes |= part << np.uint64(8 * back)
    return codes


def fit(docs: DataFrame, order: int = 3, rows_per_lang: int = 400, most_chars: int = 1 << 16) -> Model | None:
    """Context statistics of each language in `lang`, from documents that may be learned from; None if there are none.

    The sample: rows chosen by a hash so that about rows_per_lang different ones per language are expected, all of a
    language that has fewer; of a text longer than most_chars characters that many in a row, from a place set by the hash.
    Counting is a grouped sum on Spark; what the driver gets is bounded by the sample, that is by languages x
    rows_per_lang x most_chars.
    """
    rows = docs.where(learnable(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    share = F.coalesce(F.lit(rows_per_lang) / F.col("n"), F.lit(1.0))
    chosen = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < share * (1 << 30)
    spare = F.greatest(F.char_length("text") - most_chars, F.lit(0))
    slice_ = F.when(spare > 0, F.substring(F.col("text"), (F.pmod(F.xxhash64("text"), spare + 1) + 1).cast("int"), F.lit(most_chars))).otherwise(F.col("text"))
    langs = {r.lang: r.n for r in sizes.collect()}
    if not langs:
        return None
    rate = F.create_map(*[x for lang, n in sorted(langs.items()) for x in (F.lit(lang), F.lit(n))])
    sample = rows.withColumn("n", F.element_at(rate, F.col("lang"))).where(chosen).select("lang", slice_.alias("text")).distinct()

    def count(batches):
        for part in slices(batches, 1):
            data, offsets = buffers(part.column(1))
            codes, names = codes_of(data, offsets, order), part.column(0).to_pylist()
            for lang in sorted(set(names)):
                mine = np.repeat(np.array([x == lang for x in names]), np.diff(offsets))
                grams, n = np.unique(codes[mine], return_counts=True)
                yield pa.record_batch([pa.array([lang] * len(grams)), pa.array(grams.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    counted = sample.mapInArrow(lean(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(counted["lang"].to_pylist()))
    if not names:
        return None
    index = {x: i for i, x in enumerate(names)}
    which = np.array([index[x] for x in counted["lang"].to_pylist()])
    grams, n = counted["gram"].to_numpy().astype(np.uint64), counted["n"].to_numpy()
    levels = []
    for k in range(order + 1):
        part, at = np.unique(grams & np.uint64((1 << 8 * (k + 1)) - 1), return_inverse=True)
        counts = np.zeros((len(part), len(names)))
        np.add.at(counts, (at, which), n)
        contexts, at = np.unique(part >> np.uint64(8), return_inverse=True)
        totals, kinds = np.zeros((len(contexts), len(names))), np.zeros((len(contexts), len(names)))
        np.add.at(totals, at, counts)
        np.add.at(kinds, at, counts > 0)
        levels.append({"grams": part, "counts": counts, "contexts": contexts, "totals": totals, "kinds": kinds})
    return Model(names, order, levels)


@beside(("text",), ("lang_pred", "score"))
def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """Adds lang_pred and score to every row; columns so named are replaced.

    Each language codes the whole text; the shortest code wins (ties: the first by name). score is the winner's share of
    probability when a code counts per byte of text, 2 ** -bits / bytes. A text that is null, has no letter, or meets no
    model is `und` with score 0. Repeated rows come back as often, with equal results; an empty table gives no rows.
    """
    if model is None:
        return docs.withColumn("lang_pred", F.lit("und")).withColumn("score", F.lit(0.0))
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    columns = docs.columns
    has_letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    schema = with_fields(docs, "__letter boolean, lang_pred string, score double")

    def run(batches):
        model, at = shared.value, columns.index("text")
        for part in slices(batches, at):
            data, offsets = buffers(part.column(at))
            sizes = np.diff(offsets)
            total = np.zeros((len(sizes), len(model.langs)))
            if len(data):
                unique, where = np.unique(codes_of(data, offsets, model.order), return_inverse=True)
                bits = model.bits(unique)
                sums = np.add.reduceat(bits[where], offsets[:-1][sizes > 0], axis=0)
                total[sizes > 0] = sums
            best = total.argmin(axis=1)
            weight = np.exp2(-(total - total.min(axis=1, keepdims=True)) / np.maximum(sizes, 1)[:, None])
            ok = np.asarray(part.column(len(columns)).to_numpy(zero_copy_only=False), dtype=bool) & (sizes > 0)
            score = np.where(ok, 1 / weight.sum(axis=1), 0.0)
            names = [model.langs[b] if y else "und" for b, y in zip(best, ok, strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(score)], names=[*columns, "__letter", "lang_pred", "score"])

    return docs.withColumn("__letter", has_letter).mapInArrow(lean(run), schema).drop("__letter")
