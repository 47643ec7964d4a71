"""Fuzzy line deduplication by MinHash over character shingles (DataFrame functions only).

Each distinct line gets a signature of minima over its shingles of eight characters, one
from each character. Lines that agree in a band are compared with a hub of the band by
the exact Jaccard similarity of their shingle sets, then all lines of a band that still
lie in several components with each other, in blocks inside a row. Links are joined by
distributed union-find, and one line of each component stays: its first occurrence.

A line is cut into pieces of ``PIECE`` shingles, and the minima of a piece are written out
inside the grouped minima of its line: compiled code without a row, or a call of an
interpreted function, for each shingle. Only lines that meet others in a band have their sets made.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._pairs import linked_pairs
from ._util import connected_components, drop, materialize
from ._words import mixed

#: Characters of a shingle (a power of two) and the least similarity of a link.
SHINGLE, THRESHOLD = 8, 0.8
#: 10 bands of 3 rows find a pair at the threshold with probability 0.9992.
BANDS, ROWS = 10, 3
#: Shingles of a piece of a line.
PIECE = 32
#: 64-bit words of the marks of a line, which rule out pairs before their sets are made (a power of two). Marks that most
#: bits are set in rule out nothing, so there are more bits than shingles in nearly all lines.
MARKS = 32
#: Lines and characters of a block of a band on average, when all its pairs are compared.
BLOCK_LINES, BLOCK_CHARS = 1024, 1_000_000
#: Pairs a line of a row that are taken out of it, to be compared once for all bands.
PAIRS = 4
#: Lines that a copy of their hub's text serves on average.
HUB_LINES = 1024
#: At most so many lines have more than this share of all occurrences; they are sent to every executor.
FREQUENT_LINES = 10_000
#: White space around a line that does not count.
SPACE = " \t\n\x0b\f\r"
#: Bits of a line's number; those above them in a rank are its occurrences.
LID_BITS = 43

_LAST = (1 << 63) - 1
_rng = np.random.default_rng(8)
_MUL = _rng.integers(0, 1 << 30, (BANDS, ROWS), dtype=np.int32) * np.int32(2) + np.int32(1)
_XOR = _rng.integers(-(1 << 31), 1 << 31, (BANDS, ROWS), dtype=np.int32)


def _murmur(words: list[np.ndarray]) -> np.ndarray:
    """Spark's ``hash`` of the bytes of 32-bit words."""
    turn = lambda x, k: (x << np.uint32(k)) | (x >> np.uint32(32 - k))
    h = np.full(len(words[0]), 42, np.uint32)
    for w in words:
        h = turn(h ^ (turn(w * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)), 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(4 * len(words))
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return h ^ (h >> np.uint32(16))


def signatures(lines: list[str]) -> np.ndarray:
    """What agrees where the bands of :func:`_bands` agree, from minima made in numpy; zeros for a line shorter than a
    shingle, which resembles no other."""
    out = np.zeros((len(lines), BANDS), np.uint64)
    for k, line in enumerate(lines):
        if len(line) >= SHINGLE:
            u = np.frombuffer(line.encode("utf-32-be", "surrogatepass"), np.uint32)
            n = len(u) - SHINGLE + 1
            h = _murmur([u[i : i + n] for i in range(SHINGLE)]).view(np.int32)
            for b in range(BANDS):
                key = np.uint64(b + 1)
                for r in range(ROWS):
                    least = (h * _MUL[b, r] ^ _XOR[b, r]).min().astype(np.uint64)
                    key = mixed(np.array([key]) * np.uint64(0x100000001B3) + least)[0]
                out[k, b] = key | np.uint64(1)
    return out


def _units(line: Column) -> Column:
    """Four bytes a character, so that a shingle is cut without reading the line up to it."""
    return F.encode(line, "UTF-32")


def _shingle(units: Column, i: Column) -> Column:
    return F.substring(units, 4 * i + 1, F.lit(4 * SHINGLE))


def shingle_set(line: Column) -> Column:
    """64-bit hashes of all shingles; a shorter line is one shingle."""
    starts = lambda u: F.sequence(F.lit(1), F.greatest(F.octet_length(u) - (4 * SHINGLE - 1), F.lit(1)), F.lit(4))
    # The units are an element of an array, or each shingle would encode the line again.
    return F.array_distinct(F.transform(F.array(_units(line)), lambda u: F.transform(starts(u), lambda i: F.xxhash64(F.substring(u, i, F.lit(4 * SHINGLE)))))[0])


def _linked(a: Column, b: Column, threshold: float) -> Column:
    """Whether two sets are at or over the threshold; their intersection is the last to be looked at."""
    near = F.least(F.size(a), F.size(b)) >= threshold * F.greatest(F.size(a), F.size(b)) - 1e-9
    return near & (F.size(F.array_intersect(a, b)) * (1 + threshold) >= threshold * (F.size(a) + F.size(b)) - 1e-9)


def _linked_pairs(pairs: DataFrame, threshold: float) -> DataFrame:
    """Those of ``pairs`` (la, lb, ...) whose lines are at or over the threshold, by their whole sets."""
    sets = pairs.withColumns({"la": shingle_set(F.col("la")), "lb": shingle_set(F.col("lb"))})
    return sets.where(_linked(F.col("la"), F.col("lb"), threshold)).drop("la", "lb")


def _marks(texts: DataFrame) -> DataFrame:
    """(lid, n, marks) of ``texts`` (lid, line): the places of shingles, and a bitmap in which each shingle sets a bit.

    Shingles are rows of one task a line, in which they meet in the words of their bits."""
    at = texts.repartition("lid").select("lid", _units(F.col("line")).alias("u"))
    at = at.withColumn("last", F.greatest(F.floor(F.octet_length("u") / 4).cast("int") - SHINGLE, F.lit(0)))
    at = at.select("lid", "last", "u", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("i")).select("lid", "last", F.hash(_shingle(F.col("u"), F.col("i"))).alias("c"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("c"))
    at = at.groupBy("lid", F.shiftright("c", 6).bitwiseAND(F.lit(MARKS - 1)).alias("w")).agg(F.max("last").alias("last"), F.bit_or(bit).alias("bits"))
    words = [F.bit_or(F.when(F.col("w") == w, F.col("bits")).otherwise(F.lit(0).cast("long"))).alias(f"w{w}") for w in range(MARKS)]
    return at.groupBy("lid").agg((F.max("last") + 1).alias("n"), *words).select("lid", "n", F.struct(*[f"w{w}" for w in range(MARKS)]).alias("marks"))


def _may_link(na: Column, a: Column, nb: Column, b: Column, threshold: float) -> Column:
    """False only for lines under the threshold: a bit that one line alone has set is a shingle that the other lacks, and
    linked sets differ in (1 - t) / (1 + t) of their sizes at most, which the places of shingles bound. Half of
    the words are enough for most pairs, as they count no more than all do."""
    apart = lambda k: reduce(Column.__add__, [F.bit_count(a[f"w{w}"].bitwiseXOR(b[f"w{w}"])) for w in range(k)])
    most = (1 - threshold) / (1 + threshold) * (na + nb) + 1e-6
    return reduce(Column.__and__, [apart(k) <= most for k in (MARKS // 2, MARKS)])


def _occurrences(docs: DataFrame) -> DataFrame:
    """(d, th, pos, line, h1, h2) of the lines of ``docs`` (d, th, text); blank ones have a null line."""
    each = docs.select("d", "th", F.posexplode(F.split("text", "\n", -1)).alias("pos", "raw"))
    # A trim reads its text by characters, so it is for those that have something to lose.
    outer = reduce(Column.__or__, [F.startswith("raw", F.lit(c)) | F.endswith("raw", F.lit(c)) for c in SPACE])
    each = each.select("d", "th", "pos", F.nullif(F.when(outer, F.trim("raw", F.lit(SPACE))).otherwise(F.col("raw")), F.lit("")).alias("line"))
    return each.select("*", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), F.col("line")).alias("h2"))


def _distinct_lines(docs: DataFrame) -> DataFrame:
    """(lid, h1, h2, n, d, bands) of the distinct lines of ``docs`` (d, th, text): occurrences, the smallest ``d`` of
    them, and hashes of the bands of the signature (null for a line shorter than a shingle).

    Minima combine before the shuffle, so a line is sent once a task, however often it stands there, and without its text.
    """
    at = _occurrences(docs).select("d", "h1", "h2", _units(F.col("line")).alias("u"))
    at = at.withColumn("last", F.floor(F.octet_length("u") / 4).cast("int") - SHINGLE)
    # An empty piece list for blank lines, and one piece for lines shorter than a shingle.
    at = at.select("d", "h1", "h2", "u", "last", F.explode(F.when(F.col("u").isNotNull(), F.sequence(F.lit(0), F.greatest("last", F.lit(0)), F.lit(PIECE)))).alias("i"))
    # The last shingle fills up its piece, which changes no minimum.
    code = lambda j: F.hash(_shingle(F.col("u"), F.greatest(F.least(F.col("i") + j, F.col("last")), F.lit(0))))
    at = at.select("d", "h1", "h2", "last", F.when(F.col("i") == 0, 1).otherwise(0).alias("one"), *[code(j).alias(f"c{j}") for j in range(PIECE)])

    def least(b: int, r: int) -> Column:
        return F.min(F.least(*[(F.col(f"c{j}") * F.lit(int(_MUL[b, r]))).bitwiseXOR(F.lit(int(_XOR[b, r]))) for j in range(PIECE)])).alias(f"m{b}_{r}")

    with _wrapping(docs.sparkSession):
        lines = at.groupBy("h1", "h2").agg(F.sum("one").alias("n"), F.min("d").alias("d"), F.max("last").alias("last"), *[least(b, r) for b in range(BANDS) for r in range(ROWS)])
    number = F.monotonically_increasing_id()  # the partition above 33 bits
    return lines.select(number.alias("number"), "*").select(_lid(F.col("number")).alias("lid"), "h1", "h2", "n", "d", F.when(F.col("last") >= 0, _bands()).alias("bands"))


@contextmanager
def _wrapping(spark: SparkSession) -> Iterator[None]:
    """Products of integers made here keep their low bits; what a product does is settled when its column joins a plan."""
    ansi = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", ansi)


def _bands() -> Column:
    return F.array(*[F.xxhash64(F.lit(b), *[f"m{b}_{r}" for r in range(ROWS)]) for b in range(BANDS)])


def _lid(number: Column) -> Column:
    """A line's number in ``LID_BITS``: 27 for its place in a partition, 16 for the partition."""
    place, part = number.bitwiseAND(F.lit((1 << 33) - 1)), F.shiftright(number, 33)
    fits = (place < 1 << 27) & (part < 1 << 16)
    return F.when(fits, F.shiftleft(part, 27).bitwiseOR(place)).otherwise(F.raise_error(F.lit("too many lines in a partition")).cast("long"))


def _members(lines: DataFrame) -> DataFrame:
    """(band, hub, lid) of the bands in which several lines meet. The hub is the line of most occurrences, as an original
    has more than its variants."""
    rank = F.shiftleft(F.least("n", F.lit((1 << 19) - 1)).cast("long"), LID_BITS).bitwiseOR(F.col("lid"))
    banded = lines.where("bands is not null").select(rank.alias("rank"), F.explode("bands").alias("band"))
    hubs = banded.groupBy("band").agg(F.max("rank").alias("most"), F.count("*").alias("k")).where("k > 1").select("band", "most")
    number = lambda c: F.col(c).bitwiseAND(F.lit((1 << LID_BITS) - 1))
    return banded.join(hubs.hint("shuffle_hash"), "band").select("band", number("most").alias("hub"), number("rank").alias("lid"))


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(lid, line) of ``wanted`` (lid, h1, h2, d) from ``docs`` (d, th, text)."""
    some = docs.join(wanted.select("d").distinct().hint("shuffle_hash"), "d", "left_semi")
    found = _occurrences(some).where("line is not null").select("d", "h1", "h2", "line").join(wanted.hint("shuffle_hash"), ["d", "h1", "h2"])
    # A line can stand several times in its first document.
    return found.select("lid", "line").dropDuplicates(["lid"])


def is_linked(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    lo, hi = sorted((len(a), len(b)))
    if lo < threshold * hi - 1e-9:
        return False
    both = len(a) + len(b) - len(np.unique(np.concatenate([a, b])))
    return both * (1 + threshold) >= threshold * (len(a) + len(b)) - 1e-9


def _compare_with_hub(batches: Iterator[pa.RecordBatch], threshold: float, set_of: Callable[[str], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Those of the pairs (a, b, la, lb) at or over the threshold."""
    sets: dict[int, np.ndarray] = {}
    held = 0
    for batch in batches:
        ids, texts = [batch.column(i).to_pylist() for i in range(2)], [batch.column(i) for i in (2, 3)]
        keep = []
        for i in range(batch.num_rows):
            pair = []
            for side in range(2):
                k = ids[side][i]
                if k not in sets:
                    if held > 2_000_000:
                        sets.clear()
                        held = 0
                    sets[k] = set_of(texts[side][i].as_py())
                    held += len(sets[k])
                pair.append(sets[k])
            if is_linked(*pair, threshold):
                keep.append(i)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), batch.column(1).take(pa.array(keep, pa.int64()))], names=["a", "b"])


def _compare_units(batches: Iterator[pa.RecordBatch], threshold: float, set_of: Callable[[str], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) between components from units (i, j, lines): lines in one band and of different components
    are compared, unless links of the unit join their components already. A unit gives a spanning
    forest of what it finds, so at most one row a line."""
    for batch in batches:
        links: list[tuple[int, int]] = []
        for i, j, xs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            links += _unit_links(i, j, xs.as_py(), threshold, set_of)
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in range(2)], names=["a", "b"])


def _unit_links(i: int, j: int, xs: list[dict], threshold: float, set_of: Callable[[str], np.ndarray]) -> list[tuple[int, int]]:
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while (up := root.setdefault(c, c)) != c:
            root[c] = root[up]
            c = up
        return c

    links: list[tuple[int, int]] = []

    def join(p: int, q: int) -> None:
        a, b = find(comp[p]), find(comp[q])
        if a != b:
            root[max(a, b)] = min(a, b)
            links.append((comp[p], comp[q]))

    comp = [x["component"] for x in xs]
    sets = [set_of(x["line"]) for x in xs]
    bands: dict[int, list[tuple[int, int]]] = {}
    for k, x in enumerate(xs):
        for t in x["tags"]:
            bands.setdefault(t["band"], []).append((k, t["block"]))
    seen: set[tuple[int, int]] = set()
    for members in bands.values():
        left, right = [k for k, block in members if block == i], [k for k, block in members if block == j]
        if len(left) * len(right) > 1024:
            for p, q in linked_pairs(sets, np.array(left), np.array(right), threshold).tolist():
                join(p, q)
            continue
        for p in left:
            for q in right:
                pair = (p, q) if p < q else (q, p)
                if comp[p] != comp[q] and pair not in seen:
                    seen.add(pair)
                    if find(comp[p]) != find(comp[q]) and is_linked(sets[p], sets[q], threshold):
                        join(p, q)
    return links


def similar_components(members: DataFrame, texts: DataFrame, threshold: float = THRESHOLD, make: Callable[[], Callable[[str], np.ndarray]] | None = None) -> DataFrame:
    """(lid, component) of the lines that links join, from ``members`` (band, hub, lid) and ``texts`` (lid, line).

    Sets are those of :func:`shingle_set`, compared by DataFrame functions; where others are asked for, ``make`` gives
    each task the function from a text to its sorted set of hashes, and Python compares them. Every line is compared with the hub that it shares most bands with; then all pairs of a
    band that lie in different components are, so that no link between lines of a band is left out.
    """
    if make is None:
        texts = materialize(texts.join(_marks(texts), "lid").select("lid", "line", "n", "marks"))
    extra = [] if make else ["n", "marks"]
    side = lambda k: [F.col("lid").alias(k), F.col("line").alias(f"l{k}"), *[F.col(c).alias(f"{c}_{k}") for c in extra]]
    shared = members.where("lid <> hub").groupBy("lid", "hub").agg(F.count("*").alias("k"))
    tried = shared.groupBy(F.col("lid").alias("b")).agg(F.max(F.struct("k", "hub")).alias("x")).select(F.col("x.hub").alias("a"), "b")
    tried = materialize(tried)
    # A hub of very many lines is copied, so that they do not meet in one task.
    copies = tried.groupBy("a").agg(F.ceil(F.count("*") / HUB_LINES).cast("int").alias("copies"))
    hubs = copies.join(texts.select(*side("a")), "a").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    tried = tried.join(copies, "a").select("a", "b", F.pmod(F.xxhash64("b"), "copies").cast("int").alias("copy"))
    pairs = tried.join(texts.select(*side("b")), "b").join(hubs.drop("copies"), ["a", "copy"])
    if make is None:
        near = pairs.where(_may_link(F.col("n_a"), F.col("marks_a"), F.col("n_b"), F.col("marks_b"), threshold))
        links = materialize(_linked_pairs(near.select("a", "b", "la", "lb"), threshold))
    else:
        links = materialize(pairs.select("a", "b", "la", "lb").mapInArrow(lambda bs: _compare_with_hub(bs, threshold, make()), "a bigint, b bigint"))
    comps = connected_components(links, "a", "b").withColumnRenamed("node", "lid")
    more = materialize(_across(members, comps, texts, threshold, make))
    if more.isEmpty():
        return comps
    joined = connected_components(comps.withColumnsRenamed({"lid": "a", "component": "b"}).union(more), "a", "b")
    return joined.withColumnRenamed("node", "lid")


def _across(members: DataFrame, comps: DataFrame, texts: DataFrame, threshold: float, make: Callable[[], Callable[[str], np.ndarray]] | None) -> DataFrame:
    """Links (a, b) between components that have similar lines in one band.

    Bands of the same lines are compared once. Bands of one largest component share units, to
    each of which a line is sent once, and a unit's bands have a bounded number of lines on
    average. The lines of a larger band are cut into blocks; those of its largest component
    meet the others only. A unit takes a pair of blocks, so no band is gathered whole.
    """
    m = members.select("band", "lid").distinct().join(comps, "lid", "left").withColumn("component", F.coalesce("component", "lid"))
    m = m.join(texts.select("lid", F.length("line").alias("n_chars")), "lid")
    same = [F.bit_xor(F.xxhash64(F.lit(k), "lid")).alias(f"x{k}") for k in range(2)]
    parts = m.groupBy("band", "component").agg(F.count("*").alias("k"), F.sum("n_chars").alias("c"), *same)
    bands = parts.groupBy("band").agg(F.count("*").alias("n_parts"), F.max(F.struct("k", "component", "c")).alias("most"), F.sum("k").alias("k"), F.sum("c").alias("c"), *[F.bit_xor(f"x{k}").alias(f"x{k}") for k in range(2)])
    bands = bands.where("n_parts > 1").groupBy("k", "x0", "x1").agg(F.min(F.struct("band", "most", "c")).alias("b"))
    blocks = lambda k, c: F.greatest(F.lit(1), F.ceil(F.greatest(k / BLOCK_LINES, c / BLOCK_CHARS))).cast("int")
    bands = bands.select("b.band", F.col("b.most.component").alias("largest"), "k", "b.c", F.col("b.most.k").alias("most_k"), F.col("b.most.c").alias("most_c"), blocks(F.col("k"), F.col("b.c")).alias("n_all"))
    bands = materialize(bands.withColumns({"n_most": blocks(F.col("most_k"), F.col("most_c")), "n_rest": blocks(F.col("k") - F.col("most_k"), F.col("c") - F.col("most_c"))}))
    if make is None:
        return _across_in_rows(m, bands, texts, threshold)
    small = bands.where("n_all = 1")
    shares = small.groupBy("largest").agg(blocks(F.sum("k") / 4, F.sum("c") / 4).alias("n_units"))
    small = small.join(shares, "largest").select("band", F.struct(F.lit(0).alias("kind"), F.col("largest").alias("of"), F.pmod(F.xxhash64("band"), "n_units").cast("int").alias("i"), F.lit(0).alias("j")).alias("unit"))
    tag = lambda block: F.struct("band", block.cast("int").alias("block")).alias("tag")
    inside = m.join(small, "band").select("unit", "lid", "component", tag(F.lit(0)))
    big = _blocks(m.join(bands.where("n_all > 1"), "band"))
    between = big.select(F.struct(F.lit(1).alias("kind"), F.col("band").alias("of"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).alias("unit"), "lid", "component", tag(F.col("block")))
    rows = inside.union(between).groupBy("unit", "lid").agg(F.first("component").alias("component"), F.collect_list("tag").alias("tags"))
    rows = rows.join(texts, "lid").groupBy("unit").agg(F.collect_list(F.struct("lid", "component", "line", "tags")).alias("xs"))
    side = lambda c: F.when(F.col("unit.kind") == 0, 0).otherwise(F.col(f"unit.{c}")).alias(c)
    return rows.select(side("i"), side("j"), "xs").mapInArrow(lambda bs: _compare_units(bs, threshold, make()), "a bigint, b bigint").distinct()


def _blocks(big: DataFrame) -> DataFrame:
    """Each member with its ``block`` and each ``other`` block it meets; those of the largest component meet not each other."""
    h, of_most = F.xxhash64("lid"), F.col("component") == F.col("largest")
    big = big.withColumn("block", F.when(of_most, F.pmod(h, F.col("n_most"))).otherwise(F.col("n_most") + F.pmod(h, F.col("n_rest"))).cast("int"))
    last = F.col("n_most") + F.col("n_rest") - 1
    return big.withColumn("other", F.explode(F.when(of_most, F.sequence(F.col("n_most"), last)).otherwise(F.sequence(F.lit(0), last))))


def _across_in_rows(m: DataFrame, bands: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The links of :func:`_across` by DataFrame functions: a row takes a small band, or a pair of blocks of a larger one.

    A pair is compared in one of its bands. Marks leave few pairs of most rows; where they leave more than ``PAIRS`` a
    line, the pairs are compared inside the row, so that pairs as rows stay in proportion to the lines.
    """
    zero = F.lit(0)
    rest = (F.col("component") != F.col("largest")).alias("rest")
    at = materialize(m.join(bands, "band").select("band", "lid", "component", "largest", "n_all", "n_most", "n_rest"))
    inside = at.where("n_all = 1").select("band", zero.alias("i"), zero.alias("j"), zero.alias("block"), "lid", "component", rest)
    between = _blocks(at.where("n_all > 1")).select("band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "lid", "component", rest)
    unit = ("band", "i", "j")
    held = ("block", "lid", "component", "rest", "shared", "n", "marks")
    # Lines of the largest component meet the others only, and two others once.
    outer = lambda a: (a["block"] == F.col("i")) & (a["rest"] | (F.col("i") < F.col("j")))
    once = lambda a, b: (a["component"] != b["component"]) & (b["block"] == F.col("j")) & (~b["rest"] | (a["lid"] < b["lid"]) | (F.col("i") < F.col("j")))
    # A pair that meets in several bands is compared in the first of them.
    first = lambda a, b: F.array_min(F.array_intersect(a["shared"], b["shared"])) == F.col("band")
    near = lambda a, b: _may_link(a["n"], a["marks"], b["n"], b["marks"], threshold) & first(a, b)

    def of_all(meets: Callable[[Column, Column], Column], found: Callable[[Column, Column], Column], xs: Column) -> Column:
        of = lambda a: F.transform(F.filter(xs, lambda b: meets(a, b)), lambda b: found(a, b))
        return F.flatten(F.transform(F.filter(xs, outer), of))

    def gathered(of: DataFrame, *more: str) -> DataFrame:
        # So many partitions as asked for: units are few and small for the work in them, and would be put together.
        at = of.join(texts.select("lid", *more), "lid").repartition(int(m.sparkSession.conf.get("spark.sql.shuffle.partitions")), *unit)
        return at.groupBy(*unit).agg(F.collect_list(F.struct(*held, *[c for c in more if c not in held])).alias("xs"))

    members = inside.union(between).join(at.groupBy("lid").agg(F.collect_list("band").alias("shared")), "lid")
    both = lambda a, b: F.struct(a["lid"].alias("a"), b["lid"].alias("b"), a["component"].alias("ca"), b["component"].alias("cb"))
    pairs = of_all(lambda a, b: once(a, b) & near(a, b), both, F.col("xs"))
    rows = gathered(members, "n", "marks")
    rows = materialize(rows.select(*unit, (F.size("xs") * PAIRS).alias("most"), F.slice(pairs, F.lit(1), F.size("xs") * PAIRS + 1).alias("pairs")).where(F.size("pairs") > 0))
    few = rows.where(F.size("pairs") <= F.col("most")).select(F.explode("pairs").alias("x")).select("x.*")
    few = few.join(texts.select(F.col("lid").alias("a"), F.col("line").alias("la")), "a").join(texts.select(F.col("lid").alias("b"), F.col("line").alias("lb")), "b")
    few = _linked_pairs(few, threshold).select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    # Of the other rows, lines that marks allow a link at all; sets are made of these only.
    full = rows.where(F.size("pairs") > F.col("most")).select(*unit)
    if full.isEmpty():
        return few.distinct()
    rows = gathered(members.join(full, list(unit)), "n", "marks")
    lids = F.array_distinct(F.flatten(of_all(lambda a, b: once(a, b) & near(a, b), lambda a, b: F.array(a["lid"], b["lid"]), F.col("xs"))))
    # What is an element of an array is made once a row, and not for each line or pair.
    some = F.transform(F.array(lids), lambda ids: F.filter("xs", lambda x: F.array_contains(ids, x["lid"])))[0]
    rows = gathered(rows.select(*unit, F.explode(some).alias("x")).select(*unit, "x.*"), "line")
    made = F.transform("xs", lambda x: F.struct(*[x[c].alias(c) for c in held], shingle_set(x["line"]).alias("s")))
    link = lambda a, b: F.struct(a["component"].alias("a"), b["component"].alias("b"))
    links = lambda xs: of_all(lambda a, b: once(a, b) & near(a, b) & _linked(a["s"], b["s"], threshold), link, xs)
    found = F.transform(F.array(made), links)[0]
    return few.union(rows.select(F.explode(found).alias("x")).select("x.a", "x.b")).distinct()


def _fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores in front until no column of ``df`` has them."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name in taken:
            name = f"_{name}"
        out.append(name)
    return out


def dedup_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs`` (doc_id, text, ...) with ``n_lines`` and ``n_kept``; ``text`` holds the lines that stay.

    Lines are parts of the text between line feeds, compared without the white space
    around them; blank lines always stay. Lines of under eight characters resemble only equal ones.
    Of each component of similar lines, the first stays: smallest doc_id (null last), then
    position, then a hash of the text. A null text stays null with no line; a text all of
    whose lines go becomes empty. Rows of one doc_id and text are one document and keep
    the same lines. Existing columns of the two names are replaced, any others are
    kept whatever their names; whole texts and whole lines of any length are read; an empty table stays empty.
    """
    docs = docs.drop("n_lines", "n_kept")
    d, th = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST)).alias("d"), F.xxhash64("text").alias("th")
    own = docs.where("text is not null").select(d, th, "text")
    lines = materialize(_distinct_lines(own), clean=True)
    members = materialize(_members(lines), clean=True)
    wanted = lines.join(members.select("lid").distinct().hint("shuffle_hash"), "lid", "left_semi").select("lid", "h1", "h2", "d")
    texts = materialize(_texts(own, materialize(wanted)), clean=True)
    comps = similar_components(members, texts, threshold)
    drop(members)
    drop(texts)
    lines = lines.select("lid", "h1", "h2", "n", "d")
    fuzzy = lines.join(comps, "lid")
    keep = fuzzy.groupBy("component").agg(F.min("d").alias("keep"))
    decided = fuzzy.join(keep, "component").select("h1", "h2", "n", "component", "keep")
    exact = lines.where("n > 1").join(comps.select("lid"), "lid", "left_anti").select("h1", "h2", "n", F.col("lid").alias("component"), F.col("d").alias("keep"))
    decided = materialize(decided.union(exact), clean=True)
    gone = materialize(_gone(_occurrences(own).where("line is not null").drop("line"), decided), clean=True)
    x_d, x_th, x_gone, x_parts, x_kept = _fresh(docs, "d", "th", "gone", "parts", "kept")
    x = docs.withColumns({x_d: d, x_th: th}).join(gone.toDF(x_d, x_th, x_gone).hint("shuffle_hash"), [x_d, x_th], "left")
    x = x.withColumn(x_parts, F.split("text", "\n", -1))
    left = F.array_except(F.sequence(F.lit(0), F.size(x_parts) - 1), x_gone)
    x = x.withColumn(x_kept, F.when(F.col(x_gone).isNotNull(), F.transform(left, lambda i: F.get(F.col(x_parts), i))))
    n_lines = F.coalesce(F.when(F.col("text").isNotNull(), F.size(x_parts)), F.lit(0)).cast("long")
    x = x.withColumns({"n_lines": n_lines, "n_kept": F.coalesce(F.when(F.col(x_kept).isNotNull(), F.size(x_kept)).cast("long"), n_lines)})
    return x.withColumn("text", F.coalesce(F.array_join(x_kept, "\n"), "text")).select(*docs.columns, "n_lines", "n_kept")


def _gone(each: DataFrame, decided: DataFrame) -> DataFrame:
    """(d, th, positions) of the lines that go, from all occurrences ``each`` (d, th, pos, h1, h2): those of a component but the first."""
    total = decided.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    frequent = decided.where(F.col("n") > max(100_000, total // FREQUENT_LINES))
    decided = decided.drop("n")
    if frequent.isEmpty():
        at = each.join(decided.hint("shuffle_hash"), ["h1", "h2"])
    else:
        # At most FREQUENT_LINES rows, by the choice of the bound; their occurrences do not meet in one task.
        rare = each.join(F.broadcast(frequent.select("h1", "h2")), ["h1", "h2"], "left_anti").join(decided.hint("shuffle_hash"), ["h1", "h2"])
        at = rare.unionByName(each.join(F.broadcast(frequent.drop("n")), ["h1", "h2"]))
    # Rows that repeat share a rank.
    first = F.rank().over(Window.partitionBy("component", "d").orderBy("pos", "th"))
    at = at.withColumn("k", first).where("d <> keep or k > 1")
    return at.groupBy("d", "th").agg(F.collect_set("pos").alias("gone"))
