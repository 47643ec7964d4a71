"""Base relations of the queries: each as a DataFrame builder and as DuckDB SQL of the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..functions import scalar as fn
from ..functions.dialect import DUCK, SPARK, Spark, lit
from ..operators import schema, transform
from ..session import split_methods, table
from . import bom

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations")


@dataclass(frozen=True)
class Base:
    spark: Callable[[SparkSession, str], DataFrame]
    duck: str
    needs: tuple[str, ...] = ()


def _sql(text: str, *needs: str) -> Base:
    """A relation whose SQL reads alike in both dialects."""
    return Base(lambda s, d: view(s, d, text, needs), text, needs)


# Independent evidence for a cell: another rendering, a contradiction, a whole row or nothing.
N = "((doc_id * 31 + row_index * 7 + field_ord) % 11)"
EVIDENCE = f"""
    SELECT doc_id, row_index, field_ord, field, kind, raw_value, value, confidence, method,
           CASE WHEN value IS NULL THEN NULL
                WHEN {N} = 0 THEN NULL
                WHEN {N} = 1 THEN '999'
                WHEN {N} = 2 THEN upper(raw_value)
                WHEN {N} = 3 THEN 'Zeile ' || coalesce(raw_value, '') || ' | ' || value || ' | Stk'
                WHEN {N} = 4 THEN value || ' mm'
                WHEN {N} = 5 THEN value
                ELSE raw_value END AS extracted,
           CASE WHEN {N} = 3 THEN 'row_fallback' WHEN {N} = 4 THEN 'column_estimate' ELSE 'column_corridor' END AS match_type,
           CAST(CASE WHEN {N} = 3 THEN 0.82 WHEN {N} = 4 THEN 0.88 WHEN {N} = 6 THEN 0.65 ELSE 0.98 END AS DOUBLE) AS extraction_confidence,
           CASE WHEN {N} = 7 THEN 'global_text_row_anchor' ELSE 'text_layer_direct' END AS reason,
           CAST(CASE WHEN field_ord % 5 = 4 THEN 0.5 WHEN field_ord % 7 = 0 THEN 0.8 ELSE 0.95 END AS DOUBLE) AS mapping_confidence
    FROM cells
"""
JOB = """
    SELECT CAST(o_orderkey AS BIGINT) AS job_id, 'bom_' || CAST(o_orderkey AS STRING) || '.pdf' AS filename,
           CASE WHEN o_custkey % 50 = 0 THEN '' ELSE c_mktsegment END AS customer,
           CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'processing' ELSE CASE WHEN o_orderkey % 3 = 0 THEN 'failed' ELSE 'pending' END END AS status,
           o_orderdate AS created_at, o_orderkey % 13 = 0 AS archived,
           CAST(coalesce(n_rows, 0) AS BIGINT) AS total_rows, CAST(coalesce(n_rows, 0) * 30 AS BIGINT) AS total_cells,
           CAST(coalesce(green, 0) AS BIGINT) AS green_count, CAST(coalesce(yellow, 0) AS BIGINT) AS yellow_count, CAST(coalesce(red, 0) AS BIGINT) AS red_count,
           CAST(coalesce(neutral, 0) AS BIGINT) AS neutral_count
    FROM orders JOIN customer ON o_custkey = c_custkey
    LEFT JOIN (SELECT l_orderkey, count(*) AS n_rows,
                      sum(CASE WHEN l_returnflag = 'N' THEN 20 ELSE 8 END) AS green, sum(CASE WHEN l_returnflag = 'A' THEN 9 ELSE 3 END) AS yellow,
                      sum(CASE WHEN l_returnflag = 'R' THEN 5 ELSE 0 END) AS red, sum(CASE WHEN l_linestatus = 'F' THEN 4 ELSE 6 END) AS neutral
               FROM lineitem GROUP BY l_orderkey) x ON o_orderkey = l_orderkey
"""
CORRECTION = """
    SELECT CAST(event_id AS BIGINT) AS event_id, ts, CASE WHEN user_id % 9 = 0 THEN '' ELSE c_mktsegment END AS customer, event_type AS target_field,
           CAST(user_id % 40 AS BIGINT) AS row_index, CAST(value AS DOUBLE) AS original_score, props AS raw_value
    FROM events JOIN customer ON user_id = c_custkey
"""
# Part lists of three column layouts, cell by cell: other headers, another order, one combined dimension, an unmapped column.
LAYOUTS: list[list[tuple[str, str, str | None, float]]] = [
    [("Pos.", "Pos", "Detail Number", 0.98), ("Menge", "Menge", "Design Count", 0.95), ("Reserve", "Reserve", "Spare Count", 0.9), ("Benennung", "Benennung", "Description", 0.97), ("Masse", "Masse", "Dimensions X/D", 0.85), ("Laenge", "Laenge", "Dimensions Z", 0.6), ("Werkstoff", "Werkstoff", "Material", 0.8), ("Haerte", "Haerte", "Hardness", 0.9), ("Nitriert", "Nitriert", "Nitriding", 0.9), ("Nitriertyp", "Nitriertyp", "Nitriding type", 0.9), ("Beschichtung", "Beschichtung", "Coating", 0.9), ("Gruppe", "Gruppe", "Parts Group", 0.9), ("Hersteller", "Hersteller", "Manufacturer", 0.9)],
    [("Manufacturer", "Hersteller", "Customer Part Number", 0.7), ("Qty", "Menge", "Design Count", 0.9), ("Spare qty", "Reserve", None, 0.2), ("Description", "Benennung", "Description", 0.99), ("Size", "Masse", "Dimensions X/D", 0.86), ("Material", "Werkstoff", "Material", 0.7), ("Hardness", "Haerte", "Hardness", 0.25), ("Item no", "Pos", "Detail Number", 0.97), ("Customer ref", "Gruppe", "Manufacturer part no.", 0.5), ("Coating", "Beschichtung", "Coating", 0.9)],
    [("No", "Pos", "Detail Number", 0.9), ("Bezeichnung", "Benennung", "Description", 0.9), ("Stk", "Menge", "Design Count", 0.9), ("Ersatz", "Reserve", "Spare Count", 0.9), ("Fertigmass", "Masse", None, 0.1), ("Laenge", "Laenge", "Dimensions Z", 0.9), ("Rohmass X", "Laenge", "Dimensions X/D", 0.4), ("Material", "Werkstoff", "Material", 0.9), ("Alt Material", "Hersteller", "Material", 0.4), ("Nitrierung", "Nitriert", "Nitriding", 0.9), ("Tiefe", "Nitriertiefe", "Nitriding depth", 0.9)],
]


def raw_cell_sql(d: Spark) -> str:
    names = ("source_column", "raw_value")
    of = "CASE doc_id % 3 " + " ".join(f"WHEN {k} THEN {_structs(d, [(str(i), lit(c[0]), c[1]) for i, c in enumerate(layout)], ('col_ord', *names))}" for k, layout in enumerate(LAYOUTS)) + " END"
    if d.name == "spark":
        return f"SELECT doc_id, row_index, inline({of}) FROM bom_src"
    return f"SELECT doc_id, row_index, c.* FROM (SELECT doc_id, row_index, unnest({of}) AS c FROM bom_src) u"


#: Target fields that some layout maps.
PRESENT = tuple(dict.fromkeys(c[2] for layout in LAYOUTS for c in layout if c[2]))


def _structs(d: Spark, rows: list[tuple[str, ...]], names: tuple[str, ...]) -> str:
    if d.name == "spark":
        return "array(" + ", ".join("struct(" + ", ".join(f"{v} AS {n}" for n, v in zip(names, r, strict=True)) + ")" for r in rows) + ")"
    return "[" + ", ".join("{" + ", ".join(f"'{n}': {v}" for n, v in zip(names, r, strict=True)) + "}" for r in rows) + "]"


def mapping_sql(d: Spark) -> str:
    rows = [f"({k}, {i}, {lit(c[0])}, {lit(c[2]) if c[2] else 'NULL'}, CAST({c[3]} AS DOUBLE))" for k, layout in enumerate(LAYOUTS) for i, c in enumerate(layout)]
    return f"SELECT doc_id, CAST(map_ord AS BIGINT) AS map_ord, source_column, target_field, confidence, 'by header ' || source_column AS reasoning FROM (SELECT DISTINCT CAST(l_orderkey AS BIGINT) AS doc_id FROM lineitem) q JOIN (VALUES {', '.join(rows)}) AS t(layout, map_ord, source_column, target_field, confidence) ON doc_id % 3 = layout"


DIMS = ", ".join(map(lit, schema.DIMENSION_FIELDS))
#: The bound form of the three layouts in DuckDB, written beside ``transform.bind`` and not from it.
BOUND_DUCK = f"""
    WITH last AS (SELECT doc_id, target_field, arg_max(source_column, map_ord) AS source_column FROM mapping WHERE target_field IS NOT NULL AND source_column <> '' GROUP BY ALL),
    cols AS (SELECT doc_id, source_column, min(col_ord) AS col_ord, count(*) FILTER (NOT {fn.blank(DUCK, 'raw_value')}) AS n, count(*) FILTER ({fn.is_pure_dimension(DUCK, 'raw_value')}) AS pure FROM raw_cell GROUP BY ALL),
    taken AS (SELECT doc_id, source_column, bool_or(target_field IN ({DIMS})) AS is_dim FROM last GROUP BY ALL),
    nd AS (SELECT doc_id, count(DISTINCT source_column) AS n_dims FROM last WHERE target_field IN ({DIMS}) GROUP BY ALL),
    tiers AS (SELECT c.doc_id, c.source_column, c.col_ord, CASE WHEN n_dims = 1 THEN CASE WHEN is_dim THEN 0 END WHEN coalesce(is_dim, true) AND pure >= 2 AND pure * 2 >= n THEN 1 WHEN NOT is_dim AND pure >= 3 AND pure * 10 >= n * 7 THEN 2 END AS tier
              FROM cols c LEFT JOIN taken t ON c.doc_id = t.doc_id AND c.source_column = t.source_column LEFT JOIN nd ON c.doc_id = nd.doc_id),
    dim AS (SELECT doc_id, arg_min(source_column, tier * 10000 + col_ord) AS dim_column FROM tiers WHERE tier IS NOT NULL GROUP BY ALL),
    v AS (SELECT r.doc_id, r.row_index, l.target_field, r.raw_value, NULL AS dim_src FROM raw_cell r JOIN last l ON r.doc_id = l.doc_id AND r.source_column = l.source_column
          UNION ALL SELECT r.doc_id, r.row_index, NULL, NULL, r.raw_value FROM raw_cell r JOIN dim ON r.doc_id = dim.doc_id AND r.source_column = dim.dim_column)
    SELECT doc_id, row_index, {", ".join(f"max(CASE WHEN target_field = {lit(f)} THEN raw_value END) AS {transform.column_of(f)}" for f, _, _ in schema.TARGET_FIELDS)}, max(dim_src) AS dim_src FROM v GROUP BY ALL
"""
# Facts of a document: what it is, and the anchor of its completeness.
DOCUMENT_FACTS = f"""
    SELECT doc_id, doc_id % 9 <> 0 AS is_pdf, doc_id % 8 <> 0 AS has_text_layer, doc_id % 17 = 1 AS vision_fallback,
           CASE WHEN doc_id % 5 = 0 THEN 'row_band_set' WHEN count(DISTINCT nullif(pos, '')) > 0 THEN 'position_set' WHEN count(*) > 0 THEN 'row_count_fallback' ELSE 'none' END AS guard_basis,
           CASE WHEN doc_id % 5 = 0 THEN count(*) WHEN count(DISTINCT nullif(pos, '')) > 0 THEN count(DISTINCT nullif(pos, '')) ELSE count(*) END AS expected
    FROM (SELECT doc_id, {{pos}} AS pos FROM bom_src) p GROUP BY doc_id
"""
EDIT = """
    SELECT doc_id, row_index, field, 'E' || CAST(edit_ord AS STRING) AS new_value, edit_ord
    FROM bom_src CROSS JOIN (VALUES ('Material', 0), ('Design Count', 1), ('Special Notes', 2), ('Material', 3)) AS e(field, edit_ord) WHERE (doc_id + row_index) % 5 = edit_ord % 2
"""
EXCLUSION = """
    SELECT doc_id, row_index + shift AS row_index, request_ord, request_ord = 0 AS excluded, 'excluded by user' AS reason
    FROM bom_src CROSS JOIN (VALUES (0, 0), (1, 0), (0, 1000)) AS r(request_ord, shift) WHERE (doc_id * 3 + row_index) % 7 = 0 AND (request_ord = 0 OR row_index % 2 = 0)
"""
LOCATION = """
    SELECT doc_id, row_index, CASE WHEN (doc_id + row_index) % 4 = 0 THEN upper(source_column) ELSE source_column END AS source_column,
           CASE WHEN (row_index + col_ord) % 6 = 5 THEN '' ELSE coalesce(raw_value, '') END AS text,
           CASE (doc_id + col_ord) % 5 WHEN 0 THEN 'column_estimate' WHEN 1 THEN 'row_fallback' WHEN 2 THEN 'column_boundary' ELSE 'column_corridor' END AS match_type, CAST(floor(row_index / 3) + 1 AS BIGINT) AS page
    FROM raw_cell WHERE (doc_id + row_index + col_ord) % 7 <> 3
"""
LINE = "SELECT doc_id, row_index AS line_index, trim(coalesce(trim(Pos), '') || ' ' || Benennung || ' ' || coalesce(trim(Menge), '')) AS line FROM bom_src"


def _pruned(fields: tuple[str, ...]) -> Base:
    """Cells of some fields; nothing else of a row is computed."""
    return Base(lambda s, d: transform.transform(bom.source(s, d), fields=fields), f"SELECT * FROM cells WHERE field IN ({', '.join(map(lit, fields))})", ("cells",))


def _both(sql: Callable[[Spark], str], *needs: str) -> Base:
    return Base(lambda s, d: view(s, d, sql(SPARK), needs), sql(DUCK), needs)


BASES: dict[str, Base] = {
    "bom_src": Base(bom.source, bom.SOURCE_SQL),
    "cells": Base(lambda s, d: transform.transform(bom.source(s, d)), transform.transform_sql(DUCK), ("bom_src",)),
    "cells_positions": _pruned(("Detail Number",)),
    "cells_dimensions": _pruned(tuple(schema.DIMENSION_FIELDS)),
    "cells_counts": _pruned(("Design Count", "Spare Count")),
    "cells_hardness": _pruned(("Material", "Hardness")),
    "cells_required": _pruned(tuple(f for f, _, need in schema.TARGET_FIELDS if need)),
    "cells_valued": _pruned(tuple(f for f, _, _ in schema.TARGET_FIELDS if f in transform.MAPPING or f in schema.DIMENSION_FIELDS)),
    "raw_cell": _both(raw_cell_sql, "bom_src"),
    "mapping": _both(mapping_sql, "lineitem"),
    "bound": Base(lambda s, d: transform.bind(BASES["raw_cell"].spark(s, d), BASES["mapping"].spark(s, d)), BOUND_DUCK, ("raw_cell", "mapping")),
    "mapped": Base(lambda s, d: transform.transform_bound(BASES["bound"].spark(s, d), present=PRESENT), transform.transform_sql(DUCK, "SELECT * FROM bound", PRESENT), ("bound",)),
    # Without the fields that no layout maps and no dimension fills: their cells are empty.
    "mapped_filled": Base(lambda s, d: transform.transform_bound(BASES["bound"].spark(s, d), tuple(f for f, _, _ in schema.TARGET_FIELDS if f in PRESENT or f in schema.DIMENSION_FIELDS), PRESENT), "SELECT * FROM mapped WHERE method <> 'empty'", ("mapped",)),
    "document_facts": _both(lambda d: DOCUMENT_FACTS.format(pos=fn.position(d, "Pos")), "bom_src"),
    "cell_edit": _sql(EDIT, "bom_src"),
    "row_exclusion": _sql(EXCLUSION, "bom_src"),
    "location": _sql(LOCATION, "raw_cell"),
    "doc_line": _sql(LINE, "bom_src"),
    # Evidence of cells that can have a value: every query over it asks for one, and other fields have none anywhere.
    "ev": Base(lambda s, d: view(s, d, EVIDENCE.replace("FROM cells", "FROM cells_valued"), ("cells_valued",)), EVIDENCE, ("cells",)),
    "job": _sql(JOB, "orders", "customer", "lineitem"),
    "correction": _sql(CORRECTION, "events", "customer"),
}


def view(spark: SparkSession, sf_dir: str, sql: str, needs: tuple[str, ...], lean: dict[str, str] | None = None) -> DataFrame:
    """Runs Spark SQL over the named relations (``lean``: others in their place), under view names of this call's own; the plan is bound at once."""
    own = {n: f"{n}_{uuid.uuid4().hex}" for n in needs}
    for n, name in own.items():
        base = (lean or {}).get(n, n)
        df = BASES[base].spark(spark, sf_dir) if base in BASES else table(spark, sf_dir, base)
        df.createOrReplaceTempView(name)
    body = sql.strip()
    rest = f", {body[5:]}" if body[:5].upper() == "WITH " else f" {body}"
    try:
        return spark.sql("WITH " + ", ".join(f"{n} AS (SELECT * FROM {name})" for n, name in own.items()) + rest)
    finally:
        for name in own.values():
            spark.catalog.dropTempView(name)


def duck_with(needs: tuple[str, ...]) -> str:
    """WITH list of the relations that are no tables, in order of need."""
    order: list[str] = []

    def add(n: str) -> None:
        if n in BASES and n not in order:
            for m in BASES[n].needs:
                add(m)
            order.append(n)

    for n in needs:
        add(n)
    return ", ".join(f"{n} AS ({BASES[n].duck})" for n in order)


@dataclass(frozen=True)
class Query:
    """A query written once for both dialects, over named relations."""

    sql: Callable[[object], str]
    needs: tuple[str, ...]
    #: Relations that Spark reads instead, as the query drops what they lack.
    lean: dict[str, str] | None = None

    def spark(self, session: SparkSession, sf_dir: str) -> DataFrame:
        if "ev" in self.needs:
            split_methods(session)
        return view(session, sf_dir, self.sql(SPARK), self.needs, self.lean)

    def duck(self) -> str:
        w, body = duck_with(self.needs), self.sql(DUCK).strip()
        if not w:
            return body
        if body.upper().startswith("WITH "):
            return f"WITH {w}, {body[5:]}"
        return f"WITH {w} {body}"
