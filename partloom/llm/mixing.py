"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._util import materialize, unit

#: No source and no document is taken more often than this.
MAX_EPOCHS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row per source.

    Sources in order of their code points, null last, weigh ``weights``, repeating.
    Each gets min(max_epochs * size, level * weight), at the level where the targets sum
    up to all sizes. In order of max_epochs * size / weight, those that stop come first;
    the level is that of the first that does not, over what the ones before it leave.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.lit(list(weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = materialize(sizes.withColumn("w", w.cast("double")).withColumn("cap", F.col("source_size").cast("double") * max_epochs))
    by = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source"))
    before = F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("w").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    total = s.agg(F.sum("source_size")).first()[0] or 0
    levels = s.select("cap", "w", F.row_number().over(by).alias("place"), ((F.lit(float(total)) - before) / left).alias("level"))
    level = levels.where("level * w <= cap").agg(F.min_by("level", "place")).first()[0]
    level = float("inf") if level is None else level
    return s.select("source", "source_size", F.least(F.lit(level) * F.col("w"), F.col("cap")).alias("target"))


def mix_sources(docs: DataFrame, quality: DataFrame | None = None, seed: int = 17, weights: tuple[float, ...] = (1.0, 2.0, 3.0), max_epochs: int = MAX_EPOCHS, buckets: int = 4096) -> DataFrame:
    """(doc_id, source, size, source_size, target, epochs, taken), one row per row of ``docs``.

    ``docs`` has doc_id, source and text; ``quality`` (doc_id, weight > 0) favours
    documents in the fractional part. A source's target is made of complete epochs and
    a rest; for the rest, documents are sorted by -ln(u)/weight and taken while the
    middle of a document lies within the budget, so a source misses its target by half
    a document at most. The keys are cut into ``buckets`` ranges whose sums are added
    up first, and only the range that holds the end of the budget is sorted, so no
    source is gathered in one task. Null texts have size 0 and nothing is taken of
    them; null doc_ids and repeated rows are rows of their own; an empty table gives
    an empty table.
    """
    d = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("tie"))
    if quality is not None:
        q = quality.where("doc_id is not null and weight > 0").groupBy("doc_id").agg(F.max("weight").alias("weight"))
        d = d.join(q, "doc_id", "left")
    else:
        d = d.withColumn("weight", F.lit(None).cast("double"))
    key = -F.log(unit(F.lit(seed), F.col("doc_id"))) / F.coalesce(F.col("weight"), F.lit(1.0))
    d = materialize(d.withColumn("key", key).drop("weight").withColumn("bucket", F.floor((F.lit(1.0) - F.exp(-F.col("key"))) * buckets).cast("int")))
    sums = materialize(d.groupBy("source", "bucket").agg(F.sum("size").alias("s")))
    targets = materialize(source_targets(sums.groupBy("source").agg(F.sum("s").alias("source_size")), weights, max_epochs))
    plan = targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_epochs))).otherwise(0).cast("long"))
    plan = plan.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    s, p = sums.alias("s"), plan.select("source", "rest").alias("p")
    run = Window.partitionBy("s.source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = s.join(p, F.col("s.source").eqNullSafe(F.col("p.source"))).select(F.col("s.source").alias("source"), "bucket", "s", "rest", (F.sum("s").over(run) - F.col("s")).alias("before"))
    edge = runs.groupBy("source").agg(F.max(F.when(F.col("before") < F.col("rest"), F.struct("bucket", "before"))).alias("edge"))
    e = edge.alias("e")
    plan = materialize(plan.alias("p").join(e, F.col("p.source").eqNullSafe(F.col("e.source")), "left").select("p.*", F.col("edge.bucket").alias("edge"), F.col("edge.before").alias("before")))
    x = d.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source"))).select("d.*", "source_size", "target", "epochs", "rest", "edge", "before")
    at_edge = x.where("bucket = edge")
    order = Window.partitionBy("source").orderBy("key", "doc_id", "tie", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at_edge = at_edge.withColumn("more", (F.col("before") + F.sum("size").over(order) - F.col("size") / 2 < F.col("rest")).cast("long"))
    apart = x.where("edge is null or bucket <> edge").withColumn("more", F.when(F.col("bucket") < F.col("edge"), 1).otherwise(0).cast("long"))
    out = apart.unionByName(at_edge)
    n = F.least(F.col("epochs") + F.col("more"), F.lit(max_epochs))
    return out.select("doc_id", "source", "size", "source_size", "target", n.cast("long").alias("epochs"), (n * F.col("size")).cast("long").alias("taken"))
