"""Files of part lists: format detection, workbooks and delimited text, one row a cell.

Files are read through Spark's ``binaryFile`` source, so any file system works; the
parsers take bytes and use the standard library alone.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship

CELLS = "path string, sheet string, sheet_ord int, row int, col int, value string, kind string, error string"
# Keywords of header rows and of sheets with part lists.
HEADER_KEYWORDS = ("pos", "position", "benennung", "bezeichnung", "description", "stk", "stück", "menge", "qty", "werkstoff", "material", "zeichn")
SHEET_KEYWORDS = ("stückliste", "stueckliste", "bom", "parts")
_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def file_format(path: Column, content: Column) -> Column:
    """excel, csv, pdf or unknown: by extension, else by the first bytes."""
    p = F.lower(path)
    by_name = F.when(p.rlike(r"\.(xlsx|xls|xlsm)$"), "excel").when(p.endswith(".csv"), "csv").when(p.endswith(".pdf"), "pdf")
    head = F.hex(F.substring(content, 1, 5))
    return F.coalesce(by_name, F.when(head.startswith("504B0304"), "excel").when(head == "255044462D", "pdf"), F.lit("unknown"))


def upload_problem(path: Column, content: Column) -> Column:
    """Why a file is refused, or null: extension, size, emptiness, first bytes, NUL in text."""
    p, n, head = F.lower(path), F.octet_length(content), F.hex(F.substring(content, 1, 5))
    return (
        F.when(~p.rlike(r"\.(xlsx|xls|xlsm|csv|pdf)$"), "extension")
        .when(n > 50 * 1024 * 1024, "too large")
        .when(n == 0, "empty")
        .when(p.endswith(".pdf") & (head != "255044462D"), "not a pdf")
        .when(p.rlike(r"\.(xlsx|xlsm)$") & ~head.startswith("504B0304"), "not a workbook")
        .when(p.endswith(".csv") & F.hex(F.substring(content, 1, 1024)).rlike("^(..)*?00"), "binary")
    )


def customer_of(path: Column, marker: str = "input") -> Column:
    """The folder below ``marker``; else the file's own folder, unless it has a generic name."""
    parts = F.split(path, "/")
    at = F.array_position(parts, marker)
    own = F.get(parts, F.size(parts) - 2)
    return F.when((at > 0) & (at < F.size(parts) - 1), F.get(parts, at.cast("int"))).when(F.lower(own).isin("data", "input", "uploads", "tmp", ""), "").otherwise(F.coalesce(own, F.lit("")))


def safe_name(name: Column) -> Column:
    base = F.element_at(F.split(F.regexp_replace(name, r"\\", "/"), "/"), -1)
    return F.when(base.isin(".", ".."), "").otherwise(base)


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n


def workbook_cells(data: bytes) -> Iterator[tuple[str, int, int, int, str | None, str]]:
    """(sheet, order, row, column, value, kind) of a workbook; merged ranges repeat their first cell."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
        rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for order, s in enumerate(ElementTree.fromstring(z.read("xl/workbook.xml")).find("m:sheets", _NS)):
            target = rels[s.get(_REL)].lstrip("/")
            root = ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
            cells: dict[tuple[int, int], tuple[str | None, str]] = {}
            for c in root.iter(f"{{{_NS['m']}}}c"):
                kind, v = c.get("t", "n"), c.find("m:v", _NS)
                if kind == "s":
                    value = shared[int(v.text)] if v is not None else None
                elif kind == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
                else:
                    value = v.text if v is not None else None
                if value is not None and value.strip():
                    cells[int(re.search(r"\d+", c.get("r"))[0]), _column(c.get("r"))] = (value.strip(), "number" if kind == "n" else "string")
            for m in root.iter(f"{{{_NS['m']}}}mergeCell"):
                a, _, b = m.get("ref").partition(":")
                r0, c0, r1, c1 = int(re.search(r"\d+", a)[0]), _column(a), int(re.search(r"\d+", b)[0]), _column(b)
                if (r0, c0) in cells:
                    cells.update({(r, c): cells[r0, c0] for r in range(r0, r1 + 1) for c in range(c0, c1 + 1)})
            for (r, c), (value, kind) in sorted(cells.items()):
                yield s.get("name"), order, r, c, value, kind


def csv_cells(data: bytes) -> Iterator[tuple[str, int, int, int, str | None, str]]:
    """Cells of a delimited text of unknown encoding and delimiter; all are strings."""
    for encoding in ("utf-8-sig", "cp1252"):
        try:
            text = data.decode(encoding)
            break
        except UnicodeDecodeError:
            continue
    else:
        text = data.decode("utf-8", "replace")
    try:
        dialect = csv.Sniffer().sniff(text[:4096], ";,\t|")
        delimiter = dialect.delimiter
    except csv.Error:
        delimiter = ";" if ";" in text[:4096] else ","
    for r, row in enumerate(csv.reader(io.StringIO(text), delimiter=delimiter), 1):
        for c, v in enumerate(row, 1):
            if v.strip():
                yield "csv", 0, r, c, v.strip(), "string"


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """Cells of all workbooks and delimited texts below ``path``; a file that cannot be read gives one row with its error."""
    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.select("path", "content", file_format(F.col("path"), F.col("content")).alias("format")).where("format in ('excel', 'csv')")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, content, kind in zip(pdf.path, pdf.content, pdf.format, strict=True):
                try:
                    rows = [(p, *c, None) for c in (workbook_cells if kind == "excel" else csv_cells)(content)]
                except Exception as e:  # a broken file must not end the job; it is reported as a row
                    rows = [(p, None, None, None, None, None, None, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in CELLS.split(", ")]).astype({"sheet_ord": "Int32", "row": "Int32", "col": "Int32"})

    return files.mapInPandas(parse, CELLS)


def select_sheet(cells: DataFrame) -> DataFrame:
    """The cells of the best sheet of each file: name, header keywords in its first 20 rows, more than five rows; ties to the first."""
    word = F.lower("value")
    named = F.lit(False)
    for k in SHEET_KEYWORDS:
        named = named | F.contains(F.lower("sheet"), F.lit(k))
    hits = [F.max(((F.col("row") <= 20) & F.contains(word, F.lit(k))).cast("int")) for k in HEADER_KEYWORDS]
    score = F.max(named.cast("int")) * 3 + F.least(F.lit(8), sum(hits[1:], hits[0])) + (F.countDistinct("row") > 5).cast("int")
    best = cells.where("error is null").groupBy("path", "sheet", "sheet_ord").agg(score.alias("score"))
    best = best.withColumn("k", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("score"), "sheet_ord"))).where("k = 1")
    return cells.join(best.select("path", "sheet"), ["path", "sheet"], "left_semi")


def table_rows(cells: DataFrame) -> DataFrame:
    """(path, row_index, source_column, value): header found among the first 20 rows, blank names and repeats made unique."""
    word = F.lower("value")
    keyword = F.lit(False)
    for k in HEADER_KEYWORDS:
        keyword = keyword | F.contains(word, F.lit(k))
    weight = F.sum(((F.col("kind") == "string") & (F.length("value") > 1)).cast("int") + 3 * keyword.cast("int"))
    head = cells.where("row <= 20").groupBy("path", "row").agg(weight.alias("weight"))
    head = head.withColumn("k", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("weight"), "row"))).where("k = 1").select("path", F.col("row").alias("header_row"))
    c = cells.join(head, "path")
    columns = c.groupBy("path", "col").agg(F.max(F.when(F.col("row") == F.col("header_row"), F.regexp_replace("value", r"\s+", " "))).alias("name"))
    columns = columns.withColumn("name", F.coalesce("name", F.concat(F.lit("_col_"), (F.col("col") - 1).cast("string"))))
    n = F.row_number().over(Window.partitionBy("path", "name").orderBy("col")) - 1
    columns = columns.withColumn("n", n).select("path", "col", F.when(F.col("n") > 0, F.concat("name", F.lit("_"), F.col("n").cast("string"))).otherwise(F.col("name")).alias("source_column"))
    data = c.where("row > header_row").join(columns, ["path", "col"])
    index = F.dense_rank().over(Window.partitionBy("path").orderBy("row")) - 1
    return data.select("path", index.cast("int").alias("row_index"), "source_column", "value")
