"""Queries whose semantics SQL cannot express: folds, alignments, Unicode forms, fuzzy scores, state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as fn
from ..functions import udfs
from ..functions.dialect import SPARK
from ..operators import align, layout, schema, transform
from ..session import ship, table
from ..streaming import feeds
from . import bom, relations

# Centres of the columns of the projected pages.
CENTRES = {"Pos": ("POS", 30.0), "Benennung": ("BENENNUNG", 120.0), "Menge": ("STK", 260.0), "Werkstoff": ("WERKSTOFF", 340.0)}
ROWS_PER_PAGE = 30


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part lists as positioned words: a header line and thirty rows a page."""
    wide = bom.source(spark, sf_dir)
    row = F.col("row_index") % ROWS_PER_PAGE
    y = 50.0 + 20.0 * row
    page = F.floor(F.col("row_index") / ROWS_PER_PAGE).cast("int")
    cells = F.array(*[F.struct(F.lit(c).alias("centre"), y.alias("y"), F.col(k).alias("text")) for k, (_, c) in CENTRES.items()])
    # Rows are numbered without gaps, so that a page's header goes with its first row.
    heads = F.array(*[F.struct(F.lit(c).alias("centre"), F.lit(20.0).alias("y"), F.lit(n).alias("text")) for n, c in CENTRES.values()])
    data = wide.select("doc_id", page.alias("page"), F.explode(F.when(row == 0, F.concat(heads, cells)).otherwise(cells)).alias("c")).where("trim(c.text) <> ''")
    return data.select("doc_id", "page", (F.col("c.centre") - 20.0).alias("x0"), F.col("c.y").alias("y0"), (F.col("c.centre") + 20.0).alias("x1"), (F.col("c.y") + 8.0).alias("y1"), F.col("c.text").alias("text"), F.lit(842.0).alias("page_height"))


def layout_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.reconstruct_cells(words(spark, sf_dir))


def layout_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.fold_wrapped(layout.reconstruct_cells(words(spark, sf_dir)))


def layout_spatial_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.spatial_rows(words(spark, sf_dir))


def dual_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two extractions of each document: the second lacks rows and differs in some cells."""
    cells = bom.cells(bom.source(spark, sf_dir)).where("field in ('Detail Number', 'Design Count', 'Material')").select("doc_id", "row_index", "source_column", F.col("raw_value").alias("value"))
    second = cells.where("(doc_id + row_index) % 7 <> 0").withColumn("value", F.when((F.col("row_index") % 4 == 1) & (F.col("source_column") == "Menge"), "7").otherwise(F.col("value")))
    return align.align_extractions(cells, second, "Pos")


def json_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers built from events: fenced, with trailing commas, truncated or sound."""
    e = table(spark, sf_dir, "events")
    k = F.col("event_id") % 4
    body = F.concat(F.lit('{"rows": ['), F.col("props"), F.lit(', {"pos": "'), F.col("user_id").cast("string"), F.lit('"}'))
    text = F.when(k == 0, F.concat(F.lit("```json\n"), body, F.lit("]}\n```"))).when(k == 1, F.concat(body, F.lit(",]}"))).when(k == 2, F.concat(body, F.lit(', {"pos": "9'))).otherwise(F.concat(body, F.lit("]}")))
    return align.salvage_rows(e.select(F.col("event_id").alias("id"), text.alias("text")))


def position_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    position = F.expr(fn.position(SPARK, "Pos"))
    return align.position_scan(bom.source(spark, sf_dir).select(F.col("doc_id").alias("id"), F.concat_ws(" ", position, "Benennung", "Menge").alias("text")))


def fuzzy_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coatings by exact alias, else by the best alias at 85 or more; scored once for each distinct value."""
    ship(spark)
    wide = bom.source(spark, sf_dir).select("doc_id", "row_index", F.expr(fn.catalog_key(SPARK, "Beschichtung")).alias("key")).where("key <> ''")
    best = udfs.fuzzy_best(schema.alias_rows("coating"), 85.0)
    scored = wide.select("key").distinct().withColumn("b", best("key")).select("key", "b.canonical", "b.score")
    conf = F.when(F.col("score") >= 97, 0.98).when(F.col("score") >= 93, 0.95).when(F.col("score") >= 90, 0.92).otherwise(0.88)
    exact = F.broadcast(schema.alias_table(spark, "coating").withColumnsRenamed({"alias": "key", "canonical": "exact"}))
    out = wide.join(scored, "key").join(exact, "key", "left")
    return out.select("doc_id", "row_index", "key", F.coalesce("exact", "canonical").alias("canonical"), F.when(F.col("exact").isNotNull(), 1.0).when(F.col("canonical").isNotNull(), conf).otherwise(0.0).alias("confidence"))


def unicode_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NFKC, folded and bare forms of material texts, computed once for each distinct value."""
    ship(spark)
    wide = bom.source(spark, sf_dir).select("doc_id", "row_index", F.col("Werkstoff").alias("raw"))
    forms = wide.select("raw").distinct().select("raw", udfs.nfkc("raw").alias("nfkc"), udfs.fold("raw").alias("folded"), udfs.nfkd_ascii("raw").alias("bare"))
    return wide.join(forms, "raw")


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("us"), "event_id", "event_type").select("key", (F.col("us") / 1e6).alias("ts"), "event_id", (F.col("event_type") != "error").alias("success"))


def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.rate_limit(_attempts(spark, sf_dir), window=3600.0, limit=2)


def login_lockout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.lockout(_attempts(spark, sf_dir), max_failures=2, lock_seconds=86400.0)


def pivot_to_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a source row with a column a target field, straight from the staged columns."""
    return transform.transform_wide(bom.source(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (layout_cells, layout_rows, layout_spatial_rows, dual_alignment, json_salvage, position_scan, fuzzy_alias, unicode_forms, rate_limit, login_lockout, pivot_to_target)}

#: The pivot as DuckDB makes it of the cells.
ORACLE_SQL: dict[str, str] = {
    "pivot_to_target": f"WITH {relations.duck_with(('cells',))} SELECT doc_id, row_index, "
    + ", ".join(f"max(CASE WHEN field_ord = {i} THEN value END) AS c{i:02d}" for i in range(len(schema.TARGET_FIELDS)))
    + " FROM cells GROUP BY doc_id, row_index"
}
