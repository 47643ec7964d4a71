"""Registered queries against their DuckDB form on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from partloom import catalog
from partloom.operators import transform
from partloom.plans import functional

TABLES = "region nation customer supplier part orders lineitem events documents".split()
SAMPLE = os.environ.get("ALL_QUERIES") and sorted(catalog.ORACLE_SQL) or [
    "cells_by_method", "document_audit", "apply_row_exclusions", "mapped_cells", "mapping_evidence_boost", "mapping_consensus", "plausibility_flags", "non_data_rows", "sheet_header", "source_locations", "values_equivalent",
    "text_confirms_value", "counter_check_verdicts", "master_data_import", "pivot_to_target", "cv_counts", "cv_duplicate_positions", "mapping_type_check", "mapping_duplicate_targets",
    "reconcile_positions", "reconcile_multiset", "export_guard", "stats_overview", "stats_by_week", "stats_by_customer", "learned_corrections", "column_jaccard", "hard_vetoes",
]


def plain(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NaT or (not isinstance(v, (list, str)) and pd.isna(v)):
            return "NULL"
        if isinstance(v, (bool, str)) or type(v).__name__ == "bool":
            return str(v)
        try:
            return f"{float(v):.5f}"
        except (TypeError, ValueError):
            return str(v)

    df = df[sorted(df.columns)]
    return sorted(tuple(cell(v) for v in r) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_same_as_duckdb(spark, sf_dir, duck, name):
    got = catalog.QUERIES[name](spark, sf_dir).toPandas()
    want = duck.execute(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(functional.QUERIES))
def test_functional_queries_run(spark, sf_dir, name):
    assert functional.QUERIES[name](spark, sf_dir).limit(5).count() > 0


def test_any_columns_and_mapping(spark):
    """Another header set, with two mappings of a field, an unmapped dimension column and a field without a source."""
    rows = [(1, i, c, name, v) for i in range(4) for c, (name, v) in enumerate((("Teil Nr", f"0{i}"), ("Größe", f"{10 + i}x20x30" if i else "12 x 5"), ("Mat.", "1.2343"), ("Mat. alt", "H13"), ("Stück", " 4 ")))]
    cells = spark.createDataFrame(rows, "doc_id bigint, row_index bigint, col_ord int, source_column string, raw_value string")
    mapping = spark.createDataFrame([(1, 0, "Teil Nr", "Detail Number"), (1, 1, "Mat.", "Material"), (1, 2, "Mat. alt", "Material"), (1, 3, "Stück", "Design Count"), (1, 4, "Größe", None)], "doc_id bigint, map_ord int, source_column string, target_field string")
    got = {(r.row_index, r.field): (r.value, r.method) for r in transform.transform_bound(transform.bind(cells, mapping)).collect()}
    assert len(got) == 4 * 30
    assert got[1, "Material"] == ("1.2344 (X40CrMoV5-1)", "master_data:exact_alias")
    assert [got[1, f][0] for f in ("Dimensions X/D", "Dimensions Y/L", "Dimensions Z")] == ["11", "20", "30"]
    assert got[0, "Dimensions Z"] == (None, "empty") and got[0, "Hardness"] == (None, "empty")
    assert got[2, "Design Count"] == ("4", "integer_coerce")


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(catalog.ORACLE_SQL) <= set(e.oracle_sql()) <= set(e.queries())
