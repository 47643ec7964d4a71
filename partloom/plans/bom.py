"""Part lists projected from the order tables: one document an order, one row a line item.

The cells are written the way different suppliers would: several spellings of positions,
quantities, dimensions, materials and so on, chosen by the part key. All expressions
read alike in Spark and DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import table

_S = "CAST({} AS STRING)"
LN, K, Q, SZ = (_S.format(x) for x in ("l_linenumber", "l_partkey", "CAST(l_quantity AS INT)", "p_size"))
PK = "l_partkey"

#: Source columns: name, target field and expression.
CELLS = {
    "Pos": ("Detail Number", f"CASE {PK} % 7 WHEN 0 THEN '00' || {LN} WHEN 1 THEN {LN} || '.0' WHEN 2 THEN ' ' || {LN} || ' - ' || {_S.format(f'({PK} % 9)')} WHEN 3 THEN 'K-' || {LN} WHEN 4 THEN '' WHEN 5 THEN {LN} || '.1' ELSE {LN} END"),
    "Menge": ("Design Count", f"CASE {PK} % 6 WHEN 0 THEN {Q} || ',0' WHEN 1 THEN {Q} || ' Stk' WHEN 2 THEN '4x' || {Q} WHEN 3 THEN ' ' || {Q} || ' ' WHEN 4 THEN {Q} ELSE '0' END"),
    "Reserve": ("Spare Count", f"CASE {PK} % 4 WHEN 0 THEN '1' WHEN 1 THEN '' WHEN 2 THEN '-1' ELSE 'keine' END"),
    "Benennung": ("Description", "CASE WHEN l_partkey % 11 = 0 THEN '' WHEN l_partkey % 3 = 0 THEN p_name ELSE p_name || '  ' || p_type END"),
    "Masse": ("Dimensions X/D", f"CASE {PK} % 8 WHEN 0 THEN {SZ} || ' x ' || {Q} || ' x 12,5' WHEN 1 THEN {SZ} || 'X' || {Q} WHEN 2 THEN 'Ø' || {SZ} || ',5' WHEN 3 THEN {SZ} || '\" x ' || {Q} WHEN 4 THEN 'M12' WHEN 5 THEN {SZ} || '*' || {Q} || '*8 mm' WHEN 6 THEN '' ELSE 'siehe Zeichnung' END"),
    "Laenge": ("Dimensions Z", f"CASE {PK} % 5 WHEN 0 THEN '1.' || {_S.format(f'(100 + {PK} % 900)')} || ',5' WHEN 1 THEN '12345,67' WHEN 2 THEN {SZ} WHEN 3 THEN 'ca. 10' ELSE {SZ} || '.0' END"),
    "Werkstoff": ("Material", f"CASE {PK} % 9 WHEN 0 THEN '1.2343' WHEN 1 THEN '1-2343 ESU' WHEN 2 THEN 'STAHL DIN 4957- 1.2344 V=43.5+2HRC' WHEN 3 THEN '12343' WHEN 4 THEN 'h13' WHEN 5 THEN 'Aluminium' WHEN 6 THEN '1.0037' WHEN 7 THEN '' ELSE 'Stahl  blank' END"),
    "Haerte": ("Hardness", f"CASE {PK} % 8 WHEN 0 THEN '44-46 HRC' WHEN 1 THEN '45±1' WHEN 2 THEN '43+3 HRC' WHEN 3 THEN 'HRC 31-35' WHEN 4 THEN '48HRC' WHEN 5 THEN '' WHEN 6 THEN '180-200 HB' ELSE 'weich' END"),
    "Nitriert": ("Nitriding", f"CASE {PK} % 5 WHEN 0 THEN 'ja' WHEN 1 THEN 'Nein' WHEN 2 THEN 'X' WHEN 3 THEN '' ELSE 'evtl.' END"),
    "Nitriertyp": ("Nitriding type", f"CASE {PK} % 5 WHEN 0 THEN 'Gas  Nitriding' WHEN 1 THEN 'QPQ' WHEN 2 THEN 'unbekannt' WHEN 3 THEN 'plasmanitrided' ELSE '' END"),
    "Nitriertiefe": ("Nitriding depth", f"CASE {PK} % 5 WHEN 0 THEN '0,3 mm' WHEN 1 THEN '0,1-0,2 mm' WHEN 2 THEN '.004\"' WHEN 3 THEN '' ELSE 'nach Zeichnung' END"),
    "Beschichtung": ("Coating", f"CASE {PK} % 6 WHEN 0 THEN 'Balinit' WHEN 1 THEN 'TIN' WHEN 2 THEN 'Chromnitrid' WHEN 3 THEN 'lackiert' WHEN 4 THEN 'tigral duplex' ELSE '' END"),
    "Gruppe": ("Parts Group", f"CASE {PK} % 5 WHEN 0 THEN 'k1' WHEN 1 THEN 'D2 ' WHEN 2 THEN 'ZZ' WHEN 3 THEN '' ELSE 'sts' END"),
    "Hersteller": ("Manufacturer", "CASE WHEN l_suppkey % 4 = 0 THEN upper(s_name) WHEN l_suppkey % 4 = 1 THEN '  ' || s_name ELSE s_name END"),
}
ROW_KEYS = "CAST(l_orderkey AS BIGINT) AS doc_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS BIGINT) AS row_index"

#: The wide table in DuckDB.
SOURCE_SQL = (
    f"SELECT {ROW_KEYS}, l_partkey, l_suppkey, p_type, "
    + ", ".join(f"{e} AS {c}" for c, (_, e) in CELLS.items())
    + " FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey"
)


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide table: doc_id, row_index and one string column a source column."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    j = li.join(part, F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    j = j.withColumn("row_index", (F.row_number().over(order) - 1).cast("bigint"))
    return j.select(F.col("l_orderkey").cast("bigint").alias("doc_id"), "row_index", "l_partkey", "l_suppkey", "p_type", *[F.expr(e).alias(c) for c, (_, e) in CELLS.items()])


def cells(wide: DataFrame) -> DataFrame:
    """The long table: one row a document, row and target field, with the raw value."""
    pairs = F.array(*[F.struct(F.lit(c).alias("source_column"), F.lit(f).alias("field"), F.col(c).alias("raw_value")) for c, (f, _) in CELLS.items()])
    return wide.select("doc_id", "row_index", F.explode(pairs).alias("c")).select("doc_id", "row_index", "c.*")


CELLS_SQL = f"WITH src AS ({SOURCE_SQL}) " + " UNION ALL ".join(f"SELECT doc_id, row_index, '{c}' AS source_column, '{f}' AS field, {c} AS raw_value FROM src" for c, (f, _) in CELLS.items())
