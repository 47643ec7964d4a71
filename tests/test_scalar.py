"""Table-driven cases of scalar functions and comparators, in Spark and in DuckDB."""

import duckdb
import pytest
from pyspark.sql import functions as F

from partloom.functions import scalar as fn
from partloom.functions.dialect import DUCK, SPARK
from partloom.operators import compare, transform

CASES = {
    "position": [("1.0", "1"), ("12.00", "12"), ("1.2", "1.2"), ("1.10", "1.10"), ("007", "7"), ("0", "0"), ("00.0", "0"), ("k-3", "K-3"), (" 1 - 2 ", "1-2"), (None, "")],
    "hardness": [("44-46 HRC", "44-46 HRC"), ("45±1", "44-46 HRC"), ("43+3 HRC", "43-46 HRC"), ("46+2 HRc", "46-48 HRC"), ("48HRC", "48 HRC"), ("180-200 HB", "180-200 HB"), ("200 HBW", "200 HB"), ("weich", "weich"), ("  ", None), ("42,5-44", "42.5-44 HRC")],
    "coerce_integer": [("2.0", "2"), ("1,0", "1"), ("1.234", "1"), ("-3,7", "-3"), ("12d", None), ("", None), ("4 Stk", None), (" 7 ", "7")],
    "coerce_decimal": [("832,5", "832.5"), ("1.234,5", "1234.5"), ("1,234.5", "1234.5"), ("12345,67", "12345.7"), ("12", "12"), ("12.0", "12"), ("abc", None)],
    "yes_no": [("Ja", "Yes"), ("x", "Yes"), ("NEIN", "No"), ("-", "No"), ("evtl.", None)],
    "material_number": [("STAHL DIN 4957- 1.2343 ESU V=43.5+2HRC", "1.2343 ESU"), ("1-2343", "1.2343"), ("Stahl", None)],
    "stripped_material_number": [("12343", "1.2343"), ("10116G", "1.0116"), ("STAHL EN 10088-2-", None), ("-", None)],
    "hardness_in_material": [("STAHL 1.2343 ESU V=43.5+2HRC", "43.5+2 HRC"), ("x 44-46 HB", "44-46 HB"), ("none", None)],
    "nitriding_depth": [("0,3 mm", "0.3 mm"), ("0,1-0,2 mm", "0.1-0.2 mm"), ('.004"', "0.1016 mm"), ("", None)],
    "inch_to_mm": [("1", "25.4"), ("10", "254"), ("0,5", "12.7"), ("x", "x")],
    "quantity": [("4 Stk", 4), ("2,0", 2), ("-3", 3), ("4x10", None), ("M12", None)],
    "comparable_decimal": [("4,5", 4.5), ("45", 45.0), ("-3", -3.0), ("4mm", None), ("1-2", None)],
    "clean_text": [("  a   b ", "a b"), (None, "")],
}
DIMENSIONS = [("832 x 950 x 527", "832", "950", "527"), ("Ø260 x 150", "260", "150", None), ("Ø22.2", "22.2", None, None), ("150*200*12,5", "150", "200", "12.5"), ("", None, None, None), ("siehe", None, None, None)]


def both(spark, f, values):
    """Results of an expression over a column x in both dialects."""
    rows = [(i, v) for i, v in enumerate(values)]
    got = [r.y for r in spark.createDataFrame(rows, "i int, x string").select("i", F.expr(f(SPARK, "x")).alias("y")).orderBy("i").collect()]
    c = duckdb.connect()
    c.execute("create table t(i int, x varchar)")
    c.executemany("insert into t values (?, ?)", rows)
    return got, [r[0] for r in c.execute(f"select {f(DUCK, 'x')} from t order by i").fetchall()]


@pytest.mark.parametrize("name", CASES)
def test_scalar(spark, name):
    spark_got, duck_got = both(spark, getattr(fn, name), [x for x, _ in CASES[name]])
    want = [y for _, y in CASES[name]]
    assert spark_got == want
    assert duck_got == want


@pytest.mark.parametrize("axis", "xyz")
def test_dimension(spark, axis):
    got = both(spark, lambda d, x: fn.dimension(d, x, axis), [c[0] for c in DIMENSIONS])
    want = [c["xyz".index(axis) + 1] for c in DIMENSIONS]
    assert got == (want, want)


PAIRS = [
    ("Dimensions Y/L", "2080", "2300x2080x563", 0.95, "MATCH"),
    ("Dimensions X/D", "2300", "2300x2080x563", 0.95, "MATCH"),
    ("Dimensions Y/L", "999", "2300x2080x563", 0.95, "MISMATCH"),
    ("Dimensions Z", "563", "999", 0.95, "MISMATCH"),
    ("Dimensions Y/L", "450,0", "761,0x450,0x100,0", 0.95, "MATCH"),
    ("Hardness", "31-35 HRC", "HRC 31-35", 0.95, "MATCH"),
    ("Hardness", "48 HRC", "48", 0.95, "MATCH"),
    ("Hardness", "31-35 HRC", "40-44 HRC", 0.95, "MISMATCH"),
    ("Material", "1.2343 ESU", "STAHL 1.2343 +N", 0.95, "MATCH"),
    ("Material", "1.2343 ESU", "1.2344", 0.95, "MISMATCH"),
    ("Detail Number", "007", "7-2", 0.95, "MATCH"),
    ("Design Count", "4", "4 Stk", 0.95, "MATCH"),
    ("Design Count", "4", "5", 0.95, "MISMATCH"),
    ("Coating", "balinit alcrona pro", "balinit", 0.5, "MATCH"),
    ("Description", "formplatte links", "formplatte-links din 912", 0.95, "MATCH"),
    ("Nitriding", "ja", "yes", 0.5, "MATCH"),
    ("Manufacturer", "", "", 0.5, "NOT_APPLICABLE"),
    ("Manufacturer", "abc", "", 0.5, "UNCERTAIN"),
]


def test_comparators(spark):
    rows = [(i, f, m, e, c, "column_corridor") for i, (f, m, e, c, _) in enumerate(PAIRS)]
    df = spark.createDataFrame(rows, "i int, field string, value string, extracted string, extraction_confidence double, match_type string")
    got = [r.result for r in transform.staged(df, compare.compared_stages(SPARK)).orderBy("i").collect()]
    assert got == [p[4] for p in PAIRS]


def test_row_text_never_contradicts(spark):
    rows = [("Manufacturer", "meusburger", "zeile 3 | meusburger | 4"), ("Design Count", "9", "zeile 3 | 4"), ("Design Count", "4", "zeile 3 | 4")]
    df = spark.createDataFrame([(*r, 0.8, "row_fallback") for r in rows], "field string, value string, extracted string, extraction_confidence double, match_type string")
    assert [r.result for r in transform.staged(df, compare.compared_stages(SPARK)).collect()] == ["MATCH", "UNCERTAIN", "UNCERTAIN"]
