"""Substring deduplication by prefix-partitioned suffix trees.

Suffixes of a document's word sequence are cut at ``WINDOW`` words. Winnowed hashes of
short runs of words tell which suffixes can repeat at all; these are dealt into groups
by a prefix of variable length (a prefix-free code: it ends at the first place, from
``MIN_PREFIX`` words on, that its own hash marks). In a group, the sorted suffixes are
the leaves of a subtree; leaves with one path label down to depth ``WINDOW`` hang below
a deep internal node, a repeat, and all but the first of them are marked. Path labels
are compared by 128 bits of hash (prefix and whole). Adjacent marks make up the maximal repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import drop, materialize, small_batches
from ._words import MUL, MUL2, WORD, WordHashes, mixed, rolling

WINDOW = 20
#: Words of a winnowed run; every window of WINDOW words has one, chosen by its content alone.
RUN = 6
MIN_PREFIX = 6
#: A run that occurs more often is dealt out over SALTS groups, whose firsts meet once more.
HOT, SALTS = 500, 32


def _order(doc_id: Column) -> Column:
    """Place of a document: its doc_id; without one, after all others (below 2**62), by a hash of its text."""
    return F.coalesce(doc_id.cast("bigint"), F.lit(1 << 62) + F.xxhash64("text").bitwiseAND(F.lit((1 << 61) - 1)))




def _window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each window of ``width`` hashes, by doubling."""
    step = 1
    while 2 * step <= width:
        h = np.minimum(h[: len(h) - step], h[step:])
        step *= 2
    rest = width - step
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest else h


def _chosen(runs: np.ndarray) -> np.ndarray:
    """For each window of ``WINDOW`` words, the hash of its winnowed run."""
    return _window_minima(runs, WINDOW - RUN + 1)


def _labels(h: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix hash and path label of the suffixes at ``pos``: 128 bits in all."""
    x = np.zeros(len(pos), np.uint64)
    y = np.zeros(len(pos), np.uint64)
    out = np.zeros(len(pos), np.uint64)
    open_ = np.ones(len(pos), bool)
    for j in range(WINDOW):
        word = h[pos + j]
        y = y * MUL2 + word
        if j + 1 < MIN_PREFIX:
            x = x * MUL + word
        elif open_.any():
            x = x * MUL + word
            new = open_ & (((x >> np.uint64(40)) & np.uint64(3)) == 0) if j + 1 < WINDOW else open_
            out[new] = x[new]
            open_ &= ~new
    return out, mixed(y)


def repeated_windows(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Marks (d, pos) of windows that also start earlier, and copies (d, th) of earlier texts.

    ``d`` is the place of a document (:func:`_order`); rows of one doc_id and text are one
    document, and a later text that is equal to an earlier one is a copy as a whole.
    """
    spark = docs.sparkSession
    small_batches(spark)
    d = docs.where("text is not null").select(_order(F.col("doc_id")).alias("d"), F.xxhash64("text").alias("th"), F.xxhash64(F.lit(7), F.col("text")).alias("th2"), "text")
    ids = d.select("d", "th", "th2")
    firsts = ids.groupBy("th", "th2").agg(F.min("d").alias("first"), F.max("d").alias("last")).where("first < last").drop("last")
    copies = materialize(ids.join(firsts, ["th", "th2"]).where("d > first").select("d", "th").distinct())

    def winnow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for b in batches:
            ds, hs, ns = [], [], []
            for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                w = WORD.findall(t.as_py())
                if len(w) >= WINDOW:
                    runs = rolling(cache.of(w), RUN)
                    chosen = np.unique(_chosen(runs))
                    runs.sort()  # a run may stand more than once in one document
                    hs.append(chosen)
                    ns.append(np.searchsorted(runs, chosen, "right") - np.searchsorted(runs, chosen, "left"))
                    ds.append(np.full(len(chosen), d, np.int64))
            if hs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ds)), pa.array(np.concatenate(hs).view(np.int64)), pa.array(np.concatenate(ns).astype(np.int32))], names=["d", "h", "n"])

    seeds = materialize(d.select("d", "text").mapInArrow(winnow, "d bigint, h bigint, n int"))
    counts = seeds.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h", (F.col("n") > HOT).alias("hot"))
    of_doc = seeds.select("d", "h").join(counts, "h").groupBy("d").agg(F.collect_list(F.when(~F.col("hot"), F.col("h"))).alias("cold"), F.collect_list(F.when(F.col("hot"), F.col("h"))).alias("hot"))
    of_doc = materialize(of_doc, clean=True)
    drop(seeds)

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for b in batches:
            parts = []
            for d, t, cold, hot in zip(b.column(0).to_pylist(), b.column(1), b.column(2), b.column(3), strict=True):
                h = cache.of(WORD.findall(t.as_py()))
                if len(h) < WINDOW:
                    continue
                chosen = _chosen(rolling(h, RUN))
                is_hot = np.isin(chosen, np.asarray(hot.values).view(np.uint64))
                pos = np.flatnonzero(is_hot | np.isin(chosen, np.asarray(cold.values).view(np.uint64)))
                salt = np.where(is_hot[pos], d % SALTS + 1, 0)
                parts.append((*_labels(h, pos), salt, np.full(len(pos), d, np.int64), pos))
                if sum(len(p[0]) for p in parts) > 200_000:
                    yield _batch(parts)
                    parts = []
            if parts:
                yield _batch(parts)

    names = ["prefix", "label", "salt", "d", "pos"]

    def _batch(parts: list[tuple]) -> pa.RecordBatch:
        cols = [np.concatenate([p[k] for p in parts]) for k in range(5)]
        kinds = (np.int64, np.int64, np.int8, np.int64, np.int32)
        return pa.RecordBatch.from_arrays([pa.array(c.view(k) if c.dtype == np.uint64 else c.astype(k)) for c, k in zip(cols, kinds, strict=True)], names=names)

    def subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label_of, first_of = None, (0, 0)
        for b in batches:
            if not b.num_rows:
                continue
            prefix, label, salt, d, pos = (b.column(k).to_numpy() for k in range(5))
            new = np.ones(len(label), bool)
            new[1:] = (prefix[1:] != prefix[:-1]) | (label[1:] != label[:-1]) | (salt[1:] != salt[:-1])
            new[0] = label_of != (prefix[0], label[0], salt[0])
            at = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
            d0, pos0 = np.where(at < 0, first_of[0], d[at]), np.where(at < 0, first_of[1], pos[at])
            label_of, first_of = (prefix[-1], label[-1], salt[-1]), (d0[-1], pos0[-1])
            same = (d != d0) | (pos != pos0)  # rows that repeat are one document
            keep = same | (salt > 0)
            first = (salt > 0) & ~same  # the label is needed once more for these alone
            out = [np.where(first, prefix, 0), np.where(first, label, 0), np.where(first, salt, 0).astype(np.int8), d, pos]
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in out], names=names)

    rows = "prefix bigint, label bigint, salt tinyint, d bigint, pos int"
    texts = d.join(copies, ["d", "th"], "left_anti").select("d", "text").join(of_doc, "d").select("d", "text", "cold", "hot")
    leaves = texts.mapInArrow(suffixes, rows)
    by_label = ("prefix", "salt", "label", "d", "pos")
    found = leaves.repartition("prefix", "salt").sortWithinPartitions(*by_label).mapInArrow(subtrees, rows)
    found = materialize(found, clean=True)
    drop(of_doc)
    # Firsts of the salted groups of hot windows meet here, SALTS of a window at most.
    again = found.where("salt > 0").select("prefix", "label", F.lit(0).cast("tinyint").alias("salt"), "d", "pos").repartition("prefix").sortWithinPartitions(*by_label).mapInArrow(subtrees, rows)
    return found.where("salt = 0").select("d", "pos").union(again.select("d", "pos")), copies


def _covered(n: int, marks: np.ndarray) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, marks, 1)
    np.add.at(edge, marks + WINDOW, -1)
    return np.cumsum(edge[:n]) > 0


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, spans, kept), one row per row of ``docs`` (doc_id, text).

    ``spans`` are the maximal runs of removed words (start, end; exclusive), ``kept`` the
    words that stay, joined by blanks. A null text and one without a word have none and
    keep ''. Texts under ``WINDOW`` words lose nothing. Rows of one doc_id and text are
    one document and keep the same words; null doc_ids come last. An empty table stays empty.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    marks, copies = repeated_windows(docs)
    gone = marks.groupBy("d").agg(F.collect_list("pos").alias("marks"))
    x = docs.select("doc_id", "text", _order(F.col("doc_id")).alias("d"), F.xxhash64("text").alias("th"))
    x = x.join(copies.withColumn("copy", F.lit(True)), ["d", "th"], "left").join(gone, "d", "left").select("doc_id", "text", "marks", "copy")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ns, spans, kept = [], [], []
            for t, m, copy in zip(b.column(1), b.column(2), b.column(3).to_pylist(), strict=True):
                w = WORD.findall(t.as_py() or "")
                ns.append(len(w))
                if copy and len(w) >= WINDOW:
                    spans.append([{"start": 0, "end": len(w)}])
                    kept.append("")
                elif m.is_valid and not copy:
                    at = np.asarray(m.values, np.int64)
                    gone = _covered(len(w), at[at + WINDOW <= len(w)])
                    turn = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                    spans.append([{"start": int(a), "end": int(z)} for a, z in turn.reshape(-1, 2)])
                    kept.append(" ".join([w[i] for i in np.flatnonzero(~gone)]))
                else:
                    spans.append([])
                    kept.append(" ".join(w))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ns, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.string())], names=["doc_id", "n_words", "spans", "kept"])

    return x.mapInArrow(keep, f"doc_id {kind}, n_words bigint, spans array<struct<start:bigint,end:bigint>>, kept string")


def dedup_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the kept words, from :func:`dedup_substrings`."""
    out = dedup_substrings(docs)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
