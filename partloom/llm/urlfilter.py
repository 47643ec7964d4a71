"""URL filter by a cascade of Bloom filters (DataFrame functions only).

Even levels hold listed keys, odd levels hold those keys of the corpus that the level
above takes by mistake, and so on until no mistake is left. Over the complete set of
keys of the corpus, membership is exact, and a page is judged by bit tests alone.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import materialize

#: Fixed rules of the contract: key (host and path) and verdict.
RULES = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}

#: Fixed list of hosts that are blocked with their subdomains where no rule fits.
BLOCKED_HOSTS = ["adult-x.example.net", "cheap-pills.example.com", "free-bets.example.com", "spam-farm.example.org"]

#: A level of more bits than this is not sent to executors; see :func:`build_cascade`.
MAX_BITS = 1 << 24

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty where the url is null or has no ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def candidate_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Every suffix of the host at a dot, with each listed length of the path: the keys that could fit."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    hosts = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), "."))
    ends = F.filter(F.lit(sorted(lengths)), lambda k: k <= F.length(path))
    return F.flatten(F.transform(hosts, lambda h: F.transform(ends, lambda k: F.concat(h, F.substring(path, F.lit(1), k)))))


@dataclass
class Level:
    bits: int
    hashes: int
    salt: int
    words: list[int]

    def positions(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(F.lit(self.salt * 64 + i), key), F.lit(self.bits)) for i in range(self.hashes)]

    def holds(self, key: Column) -> Column:
        words = F.from_json(F.lit(json.dumps(self.words)), "array<bigint>")
        out = F.lit(True)
        for p in self.positions(key):
            word = F.element_at(words, (F.shiftright(p, 6) + 1).cast("int"))
            out = out & (F.call_function("shiftright", word, (p % 64).cast("int")).bitwiseAND(F.lit(1)) == 1)
        return out


@dataclass
class Cascade:
    levels: list[Level]

    def contains(self, key: Column) -> Column:
        """Exact for listed keys and keys of the universe the cascade was built on."""
        if not self.levels:
            return F.lit(False)
        out = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            out = F.when(~self.levels[i].holds(key), F.lit(i % 2 == 1)).otherwise(out)
        return out


def _level(keys: DataFrame, n: int, bits_per_key: float, salt: int) -> Level:
    bits = max(64, math.ceil(n * bits_per_key / 64) * 64)
    if bits > MAX_BITS:
        raise ValueError(f"a level would take {bits} bits; lists of over {MAX_BITS} bits go through a semi-join")
    level = Level(bits, max(1, min(8, round(bits / n * 0.69))), salt, [])
    at = F.explode(F.array(*level.positions(F.col("key")))).alias("p")
    rows = keys.select(at).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int"))).alias("x")).collect()
    level.words = [0] * (bits // 64)
    for w, x in rows:
        level.words[w] = x
    return level


def build_cascade(listed: DataFrame, universe: DataFrame, max_levels: int = 40) -> Cascade:
    """``listed`` and ``universe`` have a column ``key``; nulls and repeated keys count once or not at all.

    The bits of a level follow the number of listed keys (and the logarithm of the
    universe); they reach the executors inside the expression, behind ``MAX_BITS``.
    """
    listed = listed.where("key is not null").distinct()
    n = listed.count()
    if not n:
        return Cascade([])
    others = universe.where("key is not null").join(F.broadcast(listed) if n <= 10_000 else listed, "key", "left_anti").distinct()
    size = others.agg(F.approx_count_distinct("key")).first()[0]
    first = min(32.0, max(8.0, 1.45 * math.log2(max(2.0, size / n)) + 2))
    levels: list[Level] = []
    inside, outside = listed, others
    while n and len(levels) < max_levels:
        levels.append(level := _level(inside, n, first if not levels else 6.0, len(levels) + 1))
        wrong = materialize(outside.where(level.holds(F.col("key"))).select("key").distinct())
        inside, outside, n = wrong, inside, wrong.count()
    if n:
        raise RuntimeError("the cascade did not end")
    return Cascade(levels)


def judge_urls(pages: DataFrame, rules: dict[str, str], blocked_hosts: list[str], url: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict`` (existing columns of these names are replaced).

    The longest fitting rule decides; else a listed host or a subdomain of one is
    blocked, and anything else is allowed. A null url has empty host and path and is
    allowed; repeated rows are judged alike; an empty table gives an empty table.
    """
    spark: SparkSession = pages.sparkSession
    if sum(map(len, [*rules, *blocked_hosts])) * 32 > MAX_BITS * 8:
        return _judge_by_join(pages, rules, blocked_hosts, url)
    lengths = sorted({len(k) - len(k.partition("/")[0]) for k in rules} | {0})
    host, path = host_path(F.col(url))
    keyed = pages.withColumns({"host": host, "path": path})
    keys = candidate_keys(F.col("host"), F.col("path"), lengths)
    universe = materialize(keyed.select("host", "path").distinct().select(F.explode(keys).alias("key")).distinct())
    lists = {"allow": [k for k, v in rules.items() if v == "allow"], "block": [k for k, v in rules.items() if v != "allow"], "hosts": blocked_hosts}
    cascades = {k: build_cascade(spark.createDataFrame([(x,) for x in v], "key string"), universe) for k, v in lists.items()}
    longest = lambda xs: F.element_at(F.array_sort(F.transform(xs, lambda k: F.struct((-F.length(k)).alias("n"), k.alias("key")))), 1)["key"]
    fit = F.filter(F.col("_keys"), lambda k: cascades["allow"].contains(k) | cascades["block"].contains(k))
    out = keyed.withColumn("_keys", keys).withColumn("rule", F.when(F.size(fit) > 0, longest(fit)))
    by_host = F.exists(F.col("_keys"), lambda k: cascades["hosts"].contains(k))
    verdict = F.when(F.col("rule").isNotNull(), F.when(cascades["allow"].contains(F.col("rule")), F.lit("allow")).otherwise(F.lit("block"))).when(by_host, F.lit("block")).otherwise(F.lit("allow"))
    return out.withColumn("verdict", verdict).drop("_keys")


def _judge_by_join(pages: DataFrame, rules: dict[str, str], blocked_hosts: list[str], url: str) -> DataFrame:
    """The same result by a shuffled join, for lists too large for a filter on every executor."""
    spark = pages.sparkSession
    entries = [(k, v, len(k)) for k, v in rules.items()] + [(h, "block", -1) for h in blocked_hosts]
    listed = spark.createDataFrame(entries, "key string, v string, n int")
    lengths = sorted({len(k) - len(k.partition("/")[0]) for k in rules} | {0})
    host, path = host_path(F.col(url))
    keyed = pages.withColumns({"host": host, "path": path})
    each = keyed.select("host", "path").distinct().withColumn("key", F.explode(candidate_keys(F.col("host"), F.col("path"), lengths)))
    best = each.join(listed, "key").groupBy("host", "path").agg(F.max(F.struct("n", "key", "v")).alias("best"))
    out = keyed.join(best, ["host", "path"], "left")
    return out.withColumn("rule", F.when(F.col("best.n") >= 0, F.col("best.key"))).withColumn("verdict", F.coalesce(F.col("best.v"), F.lit("allow"))).drop("best")
