"""Nearest neighbours by largest inner product with a forest of random-projection trees.

The trees are fitted on a bounded sample and sent to the executors; every vector is
routed to one leaf of each tree. A query descends all trees through one shared priority
queue, ordered by the margin to the nearest plane crossed, until the leaves it has
reached hold the wanted share of vectors. Queries and members meet per leaf, where
products are exact in double precision, and the best of all leaves are merged.
Inner products are turned into distances by one more coordinate, sqrt(M^2 - |x|^2).
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import materialize, small_batches

TREES = 8
#: Vectors that the trees are fitted on at most, those with the smallest hashes (the documented bound of the sample).
SAMPLE = 32_768
#: Vectors a leaf, and leaves a tree at most.
LEAF, MAX_LEAVES = 800, 4096
#: Vectors, counted once for each tree, that the leaves reached by a query hold, as a share of all.
VISIT = 1.1
#: Members and queries of a task on average.
BLOCK_MEMBERS, BLOCK_QUERIES = 4096, 20_000


@dataclass
class Tree:
    planes: np.ndarray
    offsets: np.ndarray
    children: np.ndarray  # (inner nodes, 2): an inner node, or ~leaf
    shares: np.ndarray  # of the sample in each leaf

    @staticmethod
    def fit(x: np.ndarray, leaves: int, rng: np.random.Generator) -> Tree:
        planes, offsets, children, sizes = [], [], [], []

        def build(idx: np.ndarray, leaves: int) -> int:
            if leaves <= 1 or len(idx) < 2:
                sizes.append(len(idx))
                return ~(len(sizes) - 1)
            a, b = x[rng.choice(idx, 2, replace=False)]
            d = a - b
            norm = np.linalg.norm(d)
            d = d / norm if norm else rng.normal(size=len(d)).astype(x.dtype)
            p = x[idx] @ d
            t = float(np.median(p))
            low = p <= t
            if low.all():
                low = p < t
            k = len(planes)
            planes.append(d)
            offsets.append(t)
            children.append([0, 0])
            children[k] = [build(idx[low], leaves // 2), build(idx[~low], leaves - leaves // 2)]
            return k

        root = build(np.arange(len(x)), leaves)
        if root < 0:
            return Tree(np.zeros((0, x.shape[1]), np.float32), np.zeros(0), np.zeros((0, 2), np.int64), np.ones(1))
        return Tree(np.array(planes, np.float32), np.array(offsets), np.array(children), np.array(sizes) / max(1, len(x)))

    def route(self, x: np.ndarray) -> np.ndarray:
        if not len(self.children):
            return np.zeros(len(x), np.int32)
        high = x @ self.planes.T > self.offsets
        at = np.zeros(len(x), np.int64)
        inner = np.ones(len(x), bool)
        while inner.any():
            k = np.flatnonzero(inner)
            at[k] = self.children[at[k], high[k, at[k]].astype(np.int64)]
            inner = at >= 0
        return (~at).astype(np.int32)


class Forest:
    def __init__(self, x: np.ndarray, trees: int, leaves: int, top: float, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.top = top
        self.trees = [Tree.fit(self.lifted(x), leaves, rng) for _ in range(trees)]

    def lifted(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, self.top**2 - (x.astype(np.float64) ** 2).sum(1)))
        return np.concatenate([x, rest[:, None]], 1).astype(np.float32)

    def reach(self, x: np.ndarray, visit: float) -> Iterator[list[tuple[int, int]]]:
        """For each query, (tree, leaf) in the order of one queue over all trees."""
        x = self.lifted(x, query=True)
        margins = [(x @ t.planes.T - t.offsets).tolist() for t in self.trees]
        children = [t.children.tolist() for t in self.trees]
        for i in range(len(x)):
            queue = [(-np.inf, k, 0 if children[k] else -1) for k in range(len(self.trees))]
            heapq.heapify(queue)
            out, held = [], 0.0
            while queue and held < visit:
                m, k, node = heapq.heappop(queue)
                row, kids = margins[k][i], children[k]
                while node >= 0:
                    z = row[node]
                    near, far = kids[node][z > 0], kids[node][z <= 0]
                    heapq.heappush(queue, (max(m, abs(z)), k, far))
                    node = near
                out.append((k, ~node))
                held += self.trees[k].shares[~node]
            yield out


def best_of(s: np.ndarray, keep: int) -> np.ndarray:
    """Columns of the ``keep`` largest of each row, in no order; of equal ones at the cut, those of the smallest columns."""
    at = np.argpartition(-s, keep - 1, axis=1)[:, :keep]
    cut = np.take_along_axis(s, at, 1).min(1)
    for i in np.flatnonzero((s >= cut[:, None]).sum(1) > keep):
        at[i] = np.argsort(-s[i], kind="stable")[:keep]
    return at


def _matrix(col: pd.Series, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(col), np.float64).reshape(-1, dim)


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, trees: int = TREES, visit: float = VISIT) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each query, best first.

    Both tables have vec_id and embedding; queries are rows of ``vectors``, and a row
    is no neighbour of itself. Vectors that are null, zero, of another length than most,
    or hold null or non-finite components take no part, nor do rows without vec_id; rows
    with one vec_id and vector count once. Equal vectors are searched once, and their
    ``k`` + 1 smallest ids stand for them, which loses nothing from ``k`` results. Ties
    go to the smaller vec_id. With few vectors all are compared; without any, the result is empty.
    """
    spark = vectors.sparkSession
    small_batches(spark)

    def usable(df: DataFrame) -> DataFrame:
        e = F.col("embedding").cast("array<double>")
        good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
        df = df.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("bigint"), e.alias("e"))
        return df.where(F.forall("e", good) & F.exists("e", lambda x: x != 0)).distinct()

    v = usable(vectors)
    lengths = v.groupBy(F.size("e").alias("n")).count().orderBy(F.desc("count"), "n").first()
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if lengths is None:
        return spark.createDataFrame([], schema)
    dim = lengths.n
    v = v.where(F.size("e") == dim)
    # Ids of equal vectors: first within SALTS parts, so that no vector's rows meet in one task.
    some = lambda c: F.slice(F.array_sort(c), 1, k + 1)
    part = v.groupBy("e", F.pmod("vec_id", F.lit(64)).alias("salt")).agg(some(F.collect_list("vec_id")).alias("ids"))
    distinct = part.groupBy("e").agg(some(F.flatten(F.collect_list("ids"))).alias("ids"))
    distinct = distinct.select(F.element_at("ids", 1).alias("vid"), "ids", "e")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.asarray(b.column(2).flatten(), np.float64).reshape(-1, dim)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in x], pa.binary()), pa.array((x * x).sum(1))], names=["vid", "ids", "x", "norm2"])

    distinct = materialize(distinct.mapInArrow(packed, "vid bigint, ids array<bigint>, x binary, norm2 double"))
    n, top = distinct.agg(F.count("*"), F.sqrt(F.max("norm2"))).first()
    sample = distinct.orderBy(F.xxhash64("vid")).limit(SAMPLE).select("x").toPandas()
    leaves = int(min(MAX_LEAVES, max(1, n // LEAF), max(1, len(sample) // 8)))
    forest = spark.sparkContext.broadcast(Forest(_matrix(sample.x, dim), trees if leaves > 1 else 1, leaves, top))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = forest.value
        for b in batches:
            x = f.lifted(np.frombuffer(b"".join(b.column(1).to_pylist()), np.float64).reshape(-1, dim))
            for t, tree in enumerate(f.trees):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(tree.route(x)), b.column(0), b.column(1)], names=["tree", "leaf", "vid", "x"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = forest.value
        for b in batches:
            x = np.frombuffer(b"".join(b.column(1).to_pylist()), np.float64).reshape(-1, dim)
            for lo in range(0, len(x), 64):
                cells = list(f.reach(x[lo : lo + 64], visit))
                own = pa.array(np.repeat(np.arange(lo, lo + len(cells)), [len(c) for c in cells]))
                flat = np.array([c for cs in cells for c in cs], np.int32).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1]), b.column(0).take(own), b.column(1).take(own)], names=["tree", "leaf", "qid", "q"])

    members = distinct.select("vid", "x").mapInArrow(place, "tree int, leaf int, vid bigint, x binary")
    wanted = usable(queries).where(F.size("e") == dim).select("vec_id", "e")
    firsts = v.groupBy("e").agg(F.min("vec_id").alias("vid"))
    asked = materialize(wanted.join(firsts, "e").select(F.col("vec_id").alias("query_id"), "vid"))
    n_asked = asked.select("vid").distinct().count()
    probes = distinct.select("vid", "x").join(asked.select("vid").distinct(), "vid", "left_semi").mapInArrow(probe, "tree int, leaf int, qid bigint, q binary")
    # A leaf is cut into blocks of members; queries are dealt into parts that each meet all blocks.
    parts = -(-n_asked // BLOCK_QUERIES) or 1
    sizes = materialize(members.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / BLOCK_MEMBERS).cast("int").alias("blocks")))
    cut = members.join(sizes, ["tree", "leaf"]).withColumn("block", F.pmod(F.xxhash64("vid"), F.col("blocks")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).drop("blocks")
    sent = probes.join(sizes, ["tree", "leaf"]).withColumn("part", F.pmod(F.xxhash64("qid"), F.lit(parts)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    key = ["tree", "leaf", "block", "part"]

    def score(q: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        """The best members of the block for each query: one row a query, ids and scores packed."""
        if not len(q) or not len(m):
            return pd.DataFrame({"qid": pd.Series(dtype="int64"), "vids": pd.Series(dtype="object"), "scores": pd.Series(dtype="object")})
        x, vid = _matrix(m.x, dim), m.vid.to_numpy()
        order = np.argsort(vid)
        x, vid = x[order], vid[order]
        ids, scores = [], []
        for lo in range(0, len(q), 1024):
            s = _matrix(q.q[lo : lo + 1024], dim) @ x.T
            keep = min(k + 1, len(vid))
            at = best_of(s, keep)
            ids += [r.tobytes() for r in vid[at]]
            scores += [r.tobytes() for r in np.take_along_axis(s, at, 1)]
        return pd.DataFrame({"qid": q.qid.to_numpy(), "vids": ids, "scores": scores})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The best of all blocks for each query; a vector met in several trees counts once."""
        for b in batches:
            qs, vs, ss = [], [], []
            for q, vids, scores in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                v, s = np.frombuffer(b"".join(vids), np.int64), np.frombuffer(b"".join(scores), np.float64)
                order = np.lexsort((v, -s))
                _, first = np.unique(v[order], return_index=True)
                top = order[np.sort(first)[: k + 1]]
                qs.append(np.full(len(top), q, np.int64))
                vs.append(v[top])
                ss.append(s[top])
            if qs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (qs, vs, ss)], names=["qid", "vid", "score"])

    scored = sent.groupBy(key).cogroup(cut.groupBy(key)).applyInPandas(score, "qid bigint, vids binary, scores binary")
    best = scored.groupBy("qid").agg(F.collect_list("vids").alias("vids"), F.collect_list("scores").alias("scores")).mapInArrow(merge, "qid bigint, vid bigint, score double")
    each = best.join(distinct.select("vid", "ids"), "vid").select("qid", F.struct((-F.col("score")).alias("s"), "ids").alias("c"))
    near = each.groupBy("qid").agg(F.array_sort(F.flatten(F.transform(F.collect_list("c"), lambda c: F.transform(c["ids"], lambda i: F.struct(c["s"].alias("s"), i.alias("vec_id")))))).alias("near"))
    out = asked.join(near.withColumnRenamed("qid", "vid"), "vid")
    others = F.slice(F.filter("near", lambda c: c["vec_id"] != F.col("query_id")), 1, k)
    out = out.select("query_id", F.posexplode(others).alias("at", "c"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("c.vec_id").alias("vec_id"), (-F.col("c.s")).alias("score"))
