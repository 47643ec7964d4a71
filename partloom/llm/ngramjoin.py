"""Documents whose sets of word 5-grams have a Jaccard similarity of 0.8 or more.

Documents with equal sets form a class. Classes are banded by MinHash, and those that
meet in a band are verified on the full sets, first with the band's hub, then with all
others of the band that verified links have not joined to them. Distributed union-find
over verified links alone makes the groups, in which every pair is then verified for
the number of links. Groups of any size are cut into blocks, and a task takes a pair of
blocks, so no group is gathered whole and no pair is emitted.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._pairs import linked_pairs
from ._util import drop, materialize, small_batches
from ._words import WORD, WordHashes, mixed, rolling
from .linedup import similar_components

N, THRESHOLD, RECALL = 5, 0.8, 0.999
#: Classes and characters of a block on average.
BLOCK_CLASSES, BLOCK_CHARS = 512, 8_000_000


def band_plan(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = 100) -> tuple[int, int]:
    """(bands, rows): most rows a band for which ``hashes`` suffice to find a pair at ``threshold`` with ``recall``."""
    best = (math.ceil(math.log(1 - recall) / math.log(1 - threshold)), 1)
    for rows in range(2, 20):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= hashes:
            best = (bands, rows)
    return best


def shingles(text: str | None, cache: WordHashes, n: int = N) -> np.ndarray:
    """Sorted hashes of the distinct word n-grams, lower-cased; fewer words form one n-gram; no word, none."""
    w = WORD.findall(text.lower()) if text else []
    if not w:
        return np.zeros(0, np.uint64)
    h = cache.of(w)
    if len(w) < n:
        return mixed(rolling(h, len(w)) + np.uint64(len(w)))
    return np.unique(rolling(h, n))


class MinHash:
    def __init__(self, bands: int, rows: int, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.c = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)

    def __call__(self, sets: list[np.ndarray]) -> np.ndarray:
        """Band hashes, one row per (non-empty) set."""
        starts = np.cumsum([0, *map(len, sets)])[:-1]
        flat = np.concatenate(sets)
        out = np.zeros((len(sets), self.bands), np.uint64)
        for k, (a, c) in enumerate(zip(self.a, self.c, strict=True)):
            x = flat * a
            x += c
            x ^= x >> np.uint64(31)
            m = np.minimum.reduceat(x, starts)
            b = k // self.rows
            out[:, b] = mixed((out[:, b] + np.uint64(b + 1)) * np.uint64(0x100000001B3) + m)
        return out


def _sets() -> Callable[[str], np.ndarray]:
    cache = WordHashes()
    return lambda text: shingles(text, cache)


def similar_documents(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(doc_id, class_id, n_links, n_copies), one row per row of ``docs`` (doc_id, text).

    ``class_id`` is the smallest doc_id that links reach, ``n_links`` the number of
    other documents at or over ``threshold``, ``n_copies`` that of documents with the
    same set of n-grams. A text of under five words is one n-gram; a null text or one
    without a word is linked to nothing. Rows that repeat are documents of their own;
    a null doc_id is linked, but gives no class_id unless all of its class are null.
    An empty table stays empty.
    """
    spark = docs.sparkSession
    small_batches(spark)
    bands, rows = band_plan(threshold, recall)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhash, cache = MinHash(bands, rows), WordHashes()
        for b in batches:
            sets = [shingles(t.as_py(), cache) for t in b.column(1)]
            keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            full = [i for i, s in enumerate(sets) if len(s)]
            signed: list[list[int] | None] = [None] * len(sets)
            part: list[int] = []
            size = 0
            for i in [*full, -1]:
                if part and (i < 0 or size + len(sets[i]) > 60_000):
                    for k, row in zip(part, minhash([sets[p] for p in part]).view(np.int64), strict=True):
                        signed[k] = row
                    part, size = [], 0
                if i >= 0:
                    part.append(i)
                    size += len(sets[i])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(keys, pa.binary()), pa.array([len(t.as_py() or "") for t in b.column(1)], pa.int64()), pa.array(signed, pa.list_(pa.int64()))],
                names=["doc_id", "th", "key", "n_chars", "bands"],
            )

    signed = materialize(docs.select("doc_id", "text", F.xxhash64("text").alias("th")).mapInArrow(sign, f"doc_id {kind}, th bigint, key binary, n_chars bigint, bands array<bigint>"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")).alias("first")
    grouped = signed.where("key is not null").groupBy("key").agg(first, F.count("*").alias("n_copies"), F.max("n_chars").alias("n_chars"), F.first("bands").alias("bands"))
    classes = materialize(grouped.select("key", "first.doc_id", "first.th", "n_copies", "n_chars", "bands", F.monotonically_increasing_id().alias("cid")))
    banded = classes.select("cid", F.explode("bands").alias("band"))
    # A band's hub is the class of most copies, as an original has more than its variants.
    hubs = classes.select("cid", "n_copies", F.explode("bands").alias("band")).groupBy("band").agg(F.max(F.struct("n_copies", "cid"))["cid"].alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    members = materialize(banded.join(hubs.hint("shuffle_hash"), "band").select("band", "hub", F.col("cid").alias("lid")), clean=True)
    texts = materialize(_texts(docs, classes.join(members.select(F.col("lid").alias("cid")).distinct(), "cid", "left_semi")))
    groups = similar_components(members, texts, threshold, _sets).withColumnRenamed("lid", "cid")
    drop(members)
    links = _verify(texts, classes, groups, threshold)
    joined = groups.withColumnRenamed("component", "comp")
    c = classes.select("cid", "key", "doc_id", "n_copies").join(joined, "cid", "left").join(links, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    comps = c.where("comp <> cid or n_links is not null").groupBy("comp").agg(F.min("doc_id").alias("class_id"))
    c = c.join(comps, "comp", "left").select("key", F.coalesce("class_id", "doc_id").alias("class_id"), (F.coalesce("n_links", F.lit(0)) + F.col("n_copies") - 1).alias("n_links"), "n_copies")
    out = signed.select("doc_id", "key").join(c, "key", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"))


def _texts(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(lid, line): the text of each of the classes."""
    wanted = classes.select(F.col("cid").alias("lid"), F.col("doc_id").alias("d"), "th")
    texts = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("h"), F.col("text").alias("line"))
    # Repeated rows of one document give a text each.
    return texts.join(wanted.hint("shuffle_hash"), (F.col("th") == F.col("h")) & F.col("doc_id").eqNullSafe(F.col("d"))).select("lid", "line").dropDuplicates(["lid"])


def _verify(texts: DataFrame, classes: DataFrame, groups: DataFrame, threshold: float) -> DataFrame:
    """(cid, n_links) of the classes in ``groups`` (cid, component), counting the copies of the others."""
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK_CLASSES, F.sum("n_chars") / BLOCK_CHARS)).cast("int").alias("blocks")
    member = groups.join(classes.select("cid", "n_copies", "n_chars"), "cid")
    sizes = member.groupBy("component").agg(blocks)
    member = member.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    rows = member.join(texts.select(F.col("lid").alias("cid"), F.col("line").alias("text")), "cid")
    i, j = F.least("block", "other"), F.greatest("block", "other")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": i, "j": j})
    rows = rows.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "cid")
    rows = rows.select("component", "i", "j", "cid", "n_copies", "block", "text")

    def check(key: tuple, group: dict[int, tuple]) -> list[tuple[int, int]]:
        ids = sorted(group)
        sets = [group[c][0] for c in ids]
        copies = np.array([group[c][1] for c in ids])
        blocks = np.array([group[c][2] for c in ids])
        left, right = np.flatnonzero(blocks == key[1]), np.flatnonzero(blocks == key[2])
        pairs = linked_pairs(sets, left, right, threshold)
        if not len(pairs):
            return []
        n = np.bincount(pairs[:, 0], copies[pairs[:, 1]], len(ids))
        if key[1] != key[2]:
            n += np.bincount(pairs[:, 1], copies[pairs[:, 0]], len(ids))
        return [(ids[k], int(n[k])) for k in np.flatnonzero(n)]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        key, group, out = None, {}, []

        def batch() -> pa.RecordBatch:
            rows = out[:]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(2)], names=["cid", "n_links"])

        for b in batches:
            cols = [b.column(k).to_pylist() for k in range(6)]
            for r, (comp, i, j, cid, copies, block) in enumerate(zip(*cols, strict=True)):
                if (comp, i, j) != key:
                    if key and len(group) > 1:
                        out += check(key, group)
                    key, group = (comp, i, j), {}
                group[cid] = (shingles(b.column(6)[r].as_py(), cache), copies, block)
            if out:
                yield batch()
        if key and len(group) > 1:
            out += check(key, group)
        if out:
            yield batch()

    checked = materialize(rows.mapInArrow(verify, "cid bigint, n_links bigint"), clean=True)
    return checked.groupBy("cid").agg(F.sum("n_links").alias("n_links"))
