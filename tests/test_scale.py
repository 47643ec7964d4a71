"""Plans that must not do work once a document or once a use: what made queries fail by time on larger tables."""

import io
from contextlib import redirect_stdout

import pytest

from partloom import catalog


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_layout_cells_fold_many_documents_a_batch(spark, sf_dir):
    text = plan(catalog.QUERIES["layout_cells"](spark, sf_dir))
    assert "FlatMapGroups" not in text and text.count("MapInArrow") == 1
    # The words come from one reading of the tables, dealt by document once.
    assert text.count("Exchange hashpartitioning(l_orderkey") == 1 and "Union" not in text


def test_layout_rows_make_the_cells_once(spark, sf_dir):
    text = plan(catalog.QUERIES["layout_rows"](spark, sf_dir))
    assert text.count("MapInArrow") == 1 and text.count("FileScan") == 3


def test_wrapped_rows_in_one_pass(spark):
    """Descriptions alone are folded into the row before, several of them too; a first row stays; gaps in row numbers do not matter."""
    from pyspark.sql import functions as F

    from partloom.operators import layout

    cells = [("d", 0, "Benennung", "lone"), ("d", 2, "Pos", "1"), ("d", 2, "Benennung", "Platte"), ("d", 5, "Benennung", "lang"), ("d", 9, "Benennung", "breit"), ("d", 10, "Pos", "2"), ("e", 0, "Pos", "1")]
    df = spark.createDataFrame(cells, "doc_id string, row_index int, source_column string, value string").select("*", F.concat(F.lit("p0:b"), "row_index").alias("band_id"), F.when(F.col("source_column") == "Pos", 0).otherwise(1).alias("col_ord"), F.lit(1).alias("page"), *[F.col("row_index").cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")], F.lit("column_corridor").alias("match_type"), F.lit(True).alias("reliable"))
    got = {(r.doc_id, r.row_index, r.source_column): (r.value, r.band_id, r.y0, r.y1) for r in layout.fold_wrapped(df).collect()}
    assert got == {
        ("d", 0, "Benennung"): ("lone", "p0:b0", 0.0, 0.0), ("d", 1, "Pos"): ("1", "p0:b2", 2.0, 2.0), ("d", 1, "Benennung"): ("Platte lang breit", "p0:b2", 2.0, 9.0),
        ("d", 2, "Pos"): ("2", "p0:b10", 10.0, 10.0), ("e", 0, "Pos"): ("1", "p0:b0", 0.0, 0.0),
    }


def test_dual_alignment_folds_many_documents_a_batch(spark, sf_dir):
    text = plan(catalog.QUERIES["dual_alignment"](spark, sf_dir))
    assert "FlatMapCoGroups" not in text and text.count("MapInArrow") == 1


def test_alignment_of_documents_with_one_side(spark):
    """A document that one extraction lacks is missing row by row; one that only the second has gives nothing."""
    from partloom.operators import align

    kind = "doc_id bigint, row_index int, source_column string, value string"
    a = spark.createDataFrame([(1, 0, "Pos", "1"), (1, 0, "Stk", None), (2, 1, "Pos", "7"), (2, 0, "Pos", "5")], kind)
    b = spark.createDataFrame([(2, 0, "Pos", "5"), (3, 0, "Pos", "9")], kind)
    got = sorted(tuple(r) for r in align.align_extractions(a, b, "Pos").collect())
    assert got == [("1", 0, "Pos", "1", "MISSING_ROW"), ("2", 1, "Pos", "7", "MISSING_ROW")]


def test_plausibility_flags_read_a_name_once(spark, sf_dir):
    out = io.StringIO()
    with redirect_stdout(out):
        catalog.QUERIES["plausibility_flags"](spark, sf_dir).explain("formatted")
    assert out.getvalue().count("regexp_replace(lower(trim(source_column") == 1


def test_evidence_is_made_for_fields_that_can_have_a_value(spark, sf_dir):
    for name in ("cell_scores", "worst_class_per_row"):
        out = io.StringIO()
        with redirect_stdout(out):
            catalog.QUERIES[name](spark, sf_dir).explain("formatted")
        assert out.getvalue().count("struct(field_ord, ") == 15


def test_white_space_without_patterns(spark):
    """Stripping and single blanks give what the patterns give, for every kind of white space and in any mix."""
    from partloom.functions import scalar as fn
    from partloom.functions.dialect import SPARK

    ws = [" ", "\t", "\n", "\x0b", "\x0c", "\r"]
    texts = ["", "a", "a b", " a  b ", " a ", "Ø 12 x", None, *ws, *[f"{x}{y}a{x}b{y}{x}c{y}" for x in ws for y in ws]]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    pattern = r"regexp_replace(v, r'^\s+|\s+\z', '')", r"coalesce(nullif(trim(regexp_replace(v, r'\s+', ' ')), ''), '')", "regexp_replace(lower(coalesce(v, '')), '[^a-z0-9]', '')"
    for r in df.selectExpr(f"{fn.strip(SPARK, 'v')} AS a", f"{fn.clean_text(SPARK, 'v')} AS b", f"{fn.alnum(SPARK, 'v')} AS c", *[f"{p} AS {n}" for p, n in zip(pattern, "xyz", strict=True)]).collect():
        assert (r.a, r.b, r.c) == (r.x, r.y, r.z)


@pytest.mark.parametrize("name", ["cell_scores", "worst_class_per_row", "mapped_cells", "plausibility_flags"])
def test_same_as_duckdb(spark, sf_dir, name):
    import duckdb

    from test_queries import TABLES, plain

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    assert plain(catalog.QUERIES[name](spark, sf_dir).toPandas()) == plain(c.execute(catalog.ORACLE_SQL[name]).df())


def test_mapped_cells_make_no_cells_of_unmapped_fields(spark, sf_dir):
    out = io.StringIO()
    with redirect_stdout(out):
        catalog.QUERIES["mapped_cells"](spark, sf_dir).explain("formatted")
    assert 0 < out.getvalue().count("struct(field_ord, ") < 30
