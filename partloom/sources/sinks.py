"""Sinks: guarded export of target cells, audit output and the correction log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import schema


class DataLossError(RuntimeError):
    """A row of the document is neither written nor excluded."""


def missing_rows(expected: DataFrame, written: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Expected (doc_id, row_id) that are neither written nor excluded."""
    left = expected.join(written, ["doc_id", "row_id"], "left_anti")
    return left if excluded is None else left.join(excluded, ["doc_id", "row_id"], "left_anti")


def export_target(cells: DataFrame, path: str, expected: DataFrame | None = None, excluded: DataFrame | None = None) -> DataFrame:
    """Writes one row a document row with a column a target field; nothing is written if a row is missing.

    Counts and sizes keep their text and get a typed column beside it, null where the text is no number.
    """
    if expected is not None:
        written = cells.select("doc_id", F.col("row_index").cast("string").alias("row_id")).distinct()
        lost = missing_rows(expected, written, excluded).limit(10).collect()
        if lost:
            raise DataLossError(f"rows missing from the export: {[tuple(r) for r in lost]}")
    names = [f for f, _, _ in schema.TARGET_FIELDS]
    wide = cells.groupBy("doc_id", "row_index").pivot("field", names).agg(F.first("value", ignorenulls=True))
    for f, kind, _ in schema.TARGET_FIELDS:
        if kind != "string":
            number = F.replace(F.col(f"`{f}`"), F.lit(","), F.lit("."))
            wide = wide.withColumn(f"{f} ({kind})", number.try_cast("int" if kind == "integer" else "double"))
    wide.write.mode("overwrite").parquet(path)
    return wide


def export_audit(audit: DataFrame, path: str) -> None:
    """Audit cells as JSON lines, long texts cut to 300 characters, scores rounded to three places."""
    cut = [F.substring(c, 1, 300).alias(c) if t == "string" else F.round(c, 3).alias(c) if t == "double" else F.col(c) for c, t in audit.dtypes]
    audit.select(*cut).write.mode("overwrite").json(path)


def append_corrections(corrections: DataFrame, path: str) -> None:
    corrections.write.mode("append").json(path)
