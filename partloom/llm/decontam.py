"""Benchmark decontamination by spaced-seed hashing.

A mask names the token positions that a hash covers; the others may differ. Hashes of
the benchmark are joined with those of the corpus, and around each hit the two texts
are aligned word by word: a stretch counts if it is long and at most every fifth
word differs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import small_batches

#: Fixed masks: 1 is a position that must agree. Wherever a fifth of the words differs, one of them fits: in
#: each item of 6 to 11 words, and in each stretch of 12 to 23 (tests try all cases). A longer stretch
#: that counts has a half that counts.
MASKS = ("1111", "11101", "11011")
#: Items of fewer words are found word for word only.
MIN_ITEM = 6
#: Words compared at once along the alignments of a document.
SLICE_WORDS = 4_000_000
#: A stretch of so many words counts (all words of a shorter item), if this share of them agrees.
MIN_WORDS, MIN_SHARE = 12, 0.8
#: Benchmark words up to which its hashes are sent to every executor (some 8 bytes a mask and word).
BROADCAST_WORDS = 2_000_000

TOKENS = re.compile(r"[^\W_]+")


def tokens(text: str | None) -> list[str]:
    return TOKENS.findall(text.lower()) if text else []


def _mixed(ids: np.ndarray) -> np.ndarray:
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(31)
    return h * np.uint64(0xBF58476D1CE4E5B9)


def seed_hashes(h: np.ndarray, known: np.ndarray | None, mask: str, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of one mask over word hashes; with ``known``, only where all covered words are known."""
    m = len(h) - len(mask) + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    ok = np.ones(m, bool)
    at = [i for i, c in enumerate(mask) if c == "1"]
    if known is not None:
        for i in at:
            ok &= known[i : i + m]
        pos = np.flatnonzero(ok)
    else:
        pos = np.arange(m)
    out = np.full(len(pos), salt + 1, np.uint64)
    for i in at:
        out = out * np.uint64(0x100000001B3) + h[pos + i]
        out ^= out >> np.uint64(33)
    return pos, out


def best_stretch(a: list, b: list, min_words: int = MIN_WORDS, min_share: float = MIN_SHARE) -> tuple[int, int, int] | None:
    """The stretch (start, end, agreeing words) of two aligned word lists with most agreeing words
    among those of at least ``min_words`` words whose share of agreeing words is ``min_share`` or more."""
    same = [x == y for x, y in zip(a, b, strict=True)]
    n = len(same)
    gain = [0.0]
    total = [0]
    for s in same:
        gain.append(gain[-1] + (1 - min_share if s else -min_share))
        total.append(total[-1] + s)
    best = None
    # A stretch holds the share if gain does not fall over it; only new lows of gain can start the longest ones.
    lows: list[int] = []
    for i in range(n + 1):
        if not lows or gain[i] < gain[lows[-1]] - 1e-9:
            lows.append(i)
    for i in lows:
        j = n
        while j - i >= min_words:
            if gain[j] >= gain[i] - 1e-9:
                start, end = i, j
                # Ends that differ are left out as long as enough words remain.
                while not same[start] and end - start > min_words:
                    start += 1
                while not same[end - 1] and end - start > min_words:
                    end -= 1
                got = (start, end, total[end] - total[start])
                if best is None or got[2] > best[2]:
                    best = got
                break
            j -= 1
    return best


class BenchmarkIndex:
    """Seed hashes of all benchmark items with their places."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.items = {}
        self.vocab: dict[str, int] = {}
        for item_id, text in items:
            if item_id is not None and (w := tokens(text)):
                self.items.setdefault(item_id, []).append(w)
        self.flat = [(i, w) for i, ws in sorted(self.items.items()) for w in ws]
        for _, w in self.flat:
            for x in w:
                self.vocab.setdefault(x, len(self.vocab) + 1)
        hs, ks, ps = [], [], []
        for k, (_, w) in enumerate(self.flat):
            h = _mixed(np.array([self.vocab[x] for x in w if len(w) >= MIN_ITEM], np.int64))
            for salt, mask in enumerate(MASKS):
                pos, out = seed_hashes(h, None, mask, salt)
                hs.append(out)
                ks.append(np.full(len(pos), k))
                ps.append(pos)
        h = np.concatenate([*hs, np.zeros(0, np.uint64)])
        order = np.argsort(h, kind="stable")
        self.h, self.k, self.p = h[order], np.concatenate([*ks, np.zeros(0, np.int64)])[order], np.concatenate([*ps, np.zeros(0, np.int64)])[order]
        self.ids = np.array([self.vocab[x] for _, w in self.flat for x in w], np.int64)
        self.sizes = np.array([len(w) for _, w in self.flat], np.int64)
        self.at = np.cumsum(self.sizes) - self.sizes
        self.short = [k for k, (_, w) in enumerate(self.flat) if len(w) < MIN_ITEM]
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.h >> np.uint64(44)).astype(np.int64)] = True

    def overlaps(self, text: str | None) -> list[tuple[int, int, int, int, int]]:
        """(item, start in the text, start in the item, words, agreeing words): the best of each item."""
        w = tokens(text)
        if not w or not self.flat:
            return []
        ids = np.fromiter(map(self.vocab.get, w, [0] * len(w)), np.int64, len(w))
        h, known = _mixed(ids), ids > 0
        seen: list[np.ndarray] = []
        for salt, mask in enumerate(MASKS):
            pos, out = seed_hashes(h, known, mask, salt)
            keep = self.bits[(out >> np.uint64(44)).astype(np.int64)]
            pos, out = pos[keep], out[keep]
            lo = np.searchsorted(self.h, out, "left")
            n = np.searchsorted(self.h, out, "right") - lo
            hit = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            seen.append(self.k[hit] << 32 | np.repeat(pos, n) - self.p[hit] + (1 << 31))
        found: dict[int, tuple] = {}
        for k, shift in self._agreeing(ids, np.unique(np.concatenate(seen))):
            self._verify(w, k, shift, found)
        for k in self.short:
            item = self.flat[k][1]
            n = len(item)
            for p in np.flatnonzero(ids[: len(w) - n + 1] == self.vocab[item[0]]) if len(w) >= n else ():
                if w[p : p + n] == item:
                    found.setdefault(self.flat[k][0], (int(p), 0, n, n))
        return [(k, *v) for k, v in sorted(found.items())]

    def _agreeing(self, ids: np.ndarray, codes: np.ndarray) -> Iterator[tuple[int, int]]:
        """(item, shift) of those alignments along which enough words agree for a stretch that counts."""
        k, shift = codes >> 32, (codes & ((1 << 32) - 1)) - (1 << 31)
        size = self.sizes[k]
        lo, hi = np.maximum(0, -shift), np.minimum(size, len(ids) - shift)
        need = np.minimum(MIN_WORDS, size)
        long = hi - lo >= need
        k, shift, lo, hi, need = k[long], shift[long], lo[long], hi[long], need[long]
        end = np.cumsum(hi - lo)
        i = 0
        while i < len(k):
            j = max(i + 1, int(np.searchsorted(end, (end[i - 1] if i else 0) + SLICE_WORDS, "right")))
            n = (hi - lo)[i:j]
            first = np.cumsum(n) - n
            x = np.arange(n.sum()) + np.repeat(lo[i:j] - first, n)
            same = self.ids[x + np.repeat(self.at[k[i:j]], n)] == ids[x + np.repeat(shift[i:j], n)]
            enough = np.add.reduceat(same, first, dtype=np.int64) >= MIN_SHARE * need[i:j] - 1e-9
            yield from zip(k[i:j][enough].tolist(), shift[i:j][enough].tolist(), strict=True)
            i = j

    def _verify(self, w: list[str], k: int, shift: int, found: dict[int, tuple]) -> None:
        item_id, item = self.flat[k]
        lo, hi = max(0, -shift), min(len(item), len(w) - shift)
        need = min(MIN_WORDS, len(item))
        if hi - lo < need:
            return
        got = best_stretch(item[lo:hi], w[lo + shift : hi + shift], need)
        if got:
            new = (lo + got[0] + shift, lo + got[0], got[1] - got[0], got[2])
            if item_id not in found or (new[3], -new[0]) > (found[item_id][3], -found[item_id][0]):
                found[item_id] = new


SCHEMA = "item_id bigint, doc_start bigint, item_start bigint, n_words bigint, n_same bigint"


def find_contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, doc_start, item_start, n_words, n_same): documents that hold a passage of an item.

    Words are runs of letters and digits, lower-cased; starts count words from 0. Null
    and empty texts hold nothing; null item_ids and items without a word take no part;
    items under six words count where they stand word for word; repeated rows are
    reported each. Without items or documents the result is empty. The hashes of the
    benchmark reach the executors while it has ``BROADCAST_WORDS`` words at most;
    beyond, it is dealt out in parts of that size, and the documents are read once a part.
    """
    spark = docs.sparkSession
    small_batches(spark)
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\s]+")), F.lit(0))
    total = benchmark.agg(F.sum(size)).first()[0] or 0
    parts = -(-total // BROADCAST_WORDS) or 1
    key = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, "
    out = None
    for i in range(parts):
        part = benchmark if parts == 1 else benchmark.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == i)
        shared = spark.sparkContext.broadcast(BenchmarkIndex([(r.item_id, r.text) for r in part.select("item_id", "text").toLocalIterator()]))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for b in batches:
                ids, rows = [], []
                for d, t in zip(b.column(0), b.column(1), strict=True):
                    for x in index.overlaps(t.as_py()):
                        ids.append(d.as_py())
                        rows.append(x)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), *[pa.array([r[j] for r in rows], pa.int64()) for j in range(5)]], names=["doc_id", "item_id", "doc_start", "item_start", "n_words", "n_same"])

        got = docs.select("doc_id", "text").mapInArrow(scan, key + SCHEMA)
        out = got if out is None else out.union(got)
    return out
