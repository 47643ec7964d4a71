"""Language identification with bit-sliced Bloom filters.

One array of slots serves all languages: bit L of a slot belongs to the filter of
language L, so the slots of an n-gram, combined by AND, give every language that
contains it. Per language, the n-grams found are counted, the number expected from
false positives is taken off, and the largest corrected count decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ._util import materialize, small_batches

#: Characters per n-gram.
N = 4
#: Labelled documents per language that the filters are fitted on at most (the documented bound of the sample).
SAMPLE_PER_LANG = 400
#: A language holds an n-gram if its rate is at least this share of the highest rate in any language.
SHARE = 0.25
#: Hashes per n-gram, slots per n-gram of the largest language at least, and the bounds of the slots as powers of two;
#: beyond the upper one, filters fill up more, which the correction takes off.
HASHES, SLOTS_PER_GRAM, SLOT_BITS = 2, 8, (12, 21)

_MUL = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point: the lower-case letter, or a blank for anything else."""
    out = np.full(0x110000, 32, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def ngram_hashes(text: str | None) -> np.ndarray | None:
    """Hashes of all n-grams of the whole text, letters only, single blanks between words; None without a letter."""
    if not text:
        return None
    c = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    c = np.concatenate([np.array([32], np.uint32), c, np.array([32], np.uint32)])
    c = c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])]
    if len(c) < 2 or not (c != 32).any():
        return None
    if len(c) < N:
        c = np.concatenate([c, np.full(N - len(c), 32, np.uint32)])
    m = len(c) - N + 1
    h = np.zeros(m, np.uint64)
    for j in range(N):
        h = h * np.uint64(0x100000001B3) + c[j : j + m]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _slots(h: np.ndarray, i: int, bits: int) -> np.ndarray:
    return (h * _MUL[i % 2] + np.uint64(i)) >> np.uint64(64 - bits)


@dataclass
class LanguageModel:
    langs: list[str]
    slots: np.ndarray  # (words, slots) of uint64: a bit per language; a power of two of slots
    false_rate: np.ndarray
    default: int

    def predict(self, text: str | None) -> tuple[str, float]:
        h = ngram_hashes(text)
        if h is None or not self.langs:
            return "und", 0.0
        counts = np.zeros(len(self.langs))
        bits = self.slots.shape[1].bit_length() - 1
        at = [_slots(h, i, bits) for i in range(HASHES)]
        for w, words in enumerate(self.slots):
            mask = words[at[0]]
            for a in at[1:]:
                mask = mask & words[a]
            for bit in range(min(64, len(self.langs) - 64 * w)):
                counts[64 * w + bit] = np.count_nonzero(mask & np.uint64(1 << bit))
        share = np.clip((counts / len(h) - self.false_rate) / (1 - self.false_rate), 0, 1)
        best = int(np.argmax(share))
        return self.langs[best if share[best] > 0 else self.default], float(share[best])


def train(labelled: DataFrame, sample_per_lang: int = SAMPLE_PER_LANG) -> LanguageModel:
    """Fits the filters on (doc_id, text, lang); nulls take no part, repeated rows count each.

    The sample holds up to ``sample_per_lang`` whole texts of each language, those with
    the smallest hashes; the n-grams are counted, and set in slots, on the executors. All
    n-grams of a language in the sample count, and the slots follow their number; only
    the words of slots that are set come to the driver, within ``SLOT_BITS``.
    """
    spark = labelled.sparkSession
    small_batches(spark)
    rows = labelled.select("doc_id", "text", "lang").where("text is not null and lang is not null")
    counts = rows.groupBy("lang").count()
    h = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    picked = rows.withColumn("h", h).join(F.broadcast(counts) if counts.count() < 10_000 else counts, "lang").where(F.col("h") * F.col("count") < 1.5 * sample_per_lang + 20)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", F.xxhash64("text")))
    picked = picked.withColumn("n", rank).where(F.col("n") <= sample_per_lang).select("lang", "text")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, dict] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if (x := ngram_hashes(text)) is None:
                    continue
                sums.setdefault(lang, []).append(x)
                if sum(map(len, sums[lang])) > 5_000_000:
                    yield from flush(lang, sums.pop(lang))
        for lang, xs in sums.items():
            yield from flush(lang, xs)

    def flush(lang: str, xs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        g, n = np.unique(np.concatenate(xs), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(n, pa.int64())], names=["lang", "g", "n"])

    seen = materialize(picked.mapInArrow(grams, "lang string, g bigint, n bigint").groupBy("lang", "g").agg(F.sum("n").alias("n")))
    totals = {r.lang: r.n for r in seen.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    if not totals:
        return LanguageModel([], np.zeros((1, 1), np.uint64), np.zeros(0), 0)
    langs = sorted(totals)
    known = spark.createDataFrame([(x, i, totals[x]) for i, x in enumerate(langs)], "lang string, place int, total bigint")
    rated = seen.join(known, "lang").withColumn("rate", F.col("n") / F.col("total"))
    held = rated.withColumn("most", F.max("rate").over(Window.partitionBy("g"))).where(F.col("rate") >= SHARE * F.col("most")).select("place", "g")
    held = materialize(held)
    largest = held.groupBy("place").count().agg(F.max("count")).first()[0]
    bits = min(SLOT_BITS[1], max(SLOT_BITS[0], (largest * SLOTS_PER_GRAM - 1).bit_length()))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, g = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)
            at = np.concatenate([_slots(g, k, bits) for k in range(HASHES)]).astype(np.int64)
            mask = np.tile(np.uint64(1) << (lang % 64).astype(np.uint64), HASHES)
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(lang // 64, HASHES).astype(np.int32)), pa.array(at), pa.array(mask.view(np.int64))], names=["word", "slot", "mask"])

    filled = held.mapInArrow(place, "word int, slot bigint, mask bigint").groupBy("word", "slot").agg(F.bit_or("mask").alias("mask")).toPandas()
    slots = np.zeros(((len(langs) + 63) // 64, 1 << bits), np.uint64)
    slots[filled.word.to_numpy(np.int64), filled.slot.to_numpy(np.int64)] = filled["mask"].to_numpy(np.int64).view(np.uint64)
    rates = [(np.count_nonzero(slots[i // 64] & np.uint64(1 << (i % 64))) / (1 << bits)) ** HASHES for i in range(len(langs))]
    return LanguageModel(langs, slots, np.array(rates), max(range(len(langs)), key=lambda i: (totals[langs[i]], -i)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame, model: LanguageModel, column: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``lang_pred`` and ``lang_score`` (the corrected share of n-grams, 0 to 1).

    Null texts and texts without a letter are ``und`` with score 0; ties go to the
    smaller language; whole texts are read; existing columns of the two names are replaced.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "lang_score")
    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("lang_score", DoubleType())])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            got = [model.predict(t.as_py()) for t in b.column(b.schema.get_field_index(column))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], names=[*b.schema.names, "lang_pred", "lang_score"])

    return docs.mapInArrow(predict, schema)


def identify_by_own_labels(docs: DataFrame) -> DataFrame:
    """Trains on the rows of ``docs`` that are not held out, and predicts every row."""
    model = train(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    return identify(docs, model)


