"""Queries over the part lists: one for each operator of the inventory that SQL can express."""

from __future__ import annotations

from ..functions import scalar as fn
from ..functions.dialect import Spark, lit
from ..operators import compare, gate, schema, transform
from .relations import Query

Q: dict[str, Query] = {}


def query(name: str, *needs: str, lean: dict[str, str] | None = None):
    def put(f):
        Q[name] = Query(f, needs, lean)
        return f

    return put


def _scalar(name: str, column: str, f) -> None:
    Q[name] = Query(lambda d: f"SELECT doc_id, row_index, {column} AS raw, {f(d, column)} AS value FROM bom_src", ("bom_src",))


# Scalar normalisers and parsers.
for _name, _column, _f in (
    ("clean_text", "Benennung", fn.clean_text),
    ("catalog_key", "Beschichtung", fn.catalog_key),
    ("alnum_form", "Werkstoff", fn.alnum),
    ("dimension_x", "Masse", lambda d, x: fn.dimension(d, x, "x")),
    ("dimension_y", "Masse", lambda d, x: fn.dimension(d, x, "y")),
    ("dimension_z", "Masse", lambda d, x: fn.dimension(d, x, "z")),
    ("dimension_is_inch", "Masse", fn.is_inch),
    ("dimension_is_pure", "Masse", fn.is_pure_dimension),
    ("inch_to_mm", "Laenge", fn.inch_to_mm),
    ("parse_hardness", "Haerte", fn.hardness),
    ("coerce_integer", "Menge", fn.coerce_integer),
    ("coerce_decimal", "Laenge", fn.coerce_decimal),
    ("normalize_boolean", "Nitriert", fn.yes_no),
    ("material_number", "Werkstoff", fn.material_number),
    ("primary_material_number", "Werkstoff", fn.primary_material_number),
    ("stripped_material_number", "Werkstoff", fn.stripped_material_number),
    ("hardness_in_material", "Werkstoff", fn.hardness_in_material),
    ("nitriding_depth", "Nitriertiefe", fn.nitriding_depth),
    ("weight_kg", "Nitriertiefe", fn.weight_kg),
    ("weight_unit", "Nitriertiefe", fn.weight_unit),
    ("material_family", "Werkstoff", fn.material_family),
    ("material_density", "Werkstoff", fn.density),
    ("normalize_position", "Pos", fn.position),
    ("position_like", "Pos", fn.position_like),
    ("quantity_int", "Menge", fn.quantity),
    ("comparable_decimal", "Laenge", fn.comparable_decimal),
    ("hardness_low", "Haerte", lambda d, x: fn.hardness_low(d, x)),
    ("hardness_high", "Haerte", fn.hardness_high),
    ("hardness_cores", "Haerte", lambda d, x: d.join(d.distinct_sorted(f"({fn.hardness_cores(d, x)})"), ";")),
    ("dimension_numbers", "Masse", lambda d, x: d.join(fn.dimension_numbers(d, x), ";")),
    ("detail_number_main", "Pos", lambda d, x: fn.strip(d, d.item(d.split(x, r"[-.]"), 0))),
):
    _scalar(_name, _column, _f)


@query("text_lines", "documents")
def text_lines(d: Spark) -> str:
    """Lines of a text with collapsed white space, counted per document."""
    lines = d.keep(d.map_each(d.split("text", r"\n"), fn.clean_text(d, "v")), "v <> ''")
    return f"SELECT doc_id, CAST({d.size(lines)} AS BIGINT) AS n_lines FROM documents"


# Transform and its statistics.
@query("cells_by_method", "cells")
def cells_by_method(d: Spark) -> str:
    return f"""SELECT field, method, count(*) AS n_cells, round(1e-9 + avg(confidence), 6) AS mean_confidence, round(1e-9 + avg({transform.rule_score(d, 'value', 'kind', 'method')}), 6) AS mean_rule_score
        FROM cells GROUP BY field, method"""


@query("transformed_cells", "cells")
def transformed_cells(d: Spark) -> str:
    return "SELECT doc_id, row_index, field, raw_value, value, confidence, method FROM cells WHERE method <> 'empty'"


@query("transform_stats", "cells")
def transform_stats(d: Spark) -> str:
    n = lambda c: f"sum(CASE WHEN {c} THEN 1 ELSE 0 END)"
    return f"""SELECT doc_id, count(*) AS total_cells, {n("method NOT IN ('passthrough', 'empty')")} AS transformed, {n("method = 'passthrough'")} AS passthrough, {n("method = 'empty'")} AS empty_cells,
        {n("method LIKE 'master_data:%'")} AS master_data_matched, {n("method = 'dimension_split'")} AS dimension_split, {n("field = 'Hardness' AND method IN ('regex_parse', 'extracted_from_material')")} AS hardness_parsed, round(1e-9 + avg(confidence), 6) AS avg_confidence,
        {n("method = 'dimension_split' AND confidence = 0.9")} AS inch_converted FROM cells GROUP BY doc_id"""


@query("rule_scores", "cells")
def rule_scores(d: Spark) -> str:
    return f"SELECT doc_id, row_index, field, round(1e-9 + {transform.rule_score(d, 'value', 'kind', 'method')}, 4) AS rule_score FROM cells WHERE method <> 'empty'"


@query("combined_dimension_source", "bom_src")
def combined_dimension_source(d: Spark) -> str:
    return f"WITH b AS ({transform.bound_sql(d)}) SELECT doc_id, count(dim_src) AS n_values, min(dim_src) AS first_value FROM b GROUP BY doc_id"


# Comparators.
def compared(d: Spark) -> str:
    return f"WITH compared AS ({transform.staged_sql('ev', compare.compared_stages(d))})"


@query("compare_values", "ev")
def compare_values(d: Spark) -> str:
    return f"{compared(d)} SELECT doc_id, row_index, field, value, extracted, result, strict, detail FROM compared WHERE value IS NOT NULL OR extracted IS NOT NULL"


def _comparator(name: str, rules: compare.Outcome, fields: tuple[str, ...]) -> None:
    def sql(d: Spark) -> str:
        chain = "CASE " + " ".join(f"WHEN {c[0]} THEN {lit(c[1] + '|' + c[3])}" for c in rules) + " END"
        stages = [*compare.features(d), {"o": chain}]
        return f"WITH x AS ({transform.staged_sql('ev', stages)}) SELECT doc_id, row_index, field, value, extracted, o AS outcome FROM x WHERE field IN ({', '.join(map(lit, fields))}) AND m <> '' AND e <> ''"

    Q[f"compare_{name}"] = Query(sql, ("ev",))


for _n, _r, _fs in (
    ("text", [*compare.GENERIC, compare.DIFFER], ("Manufacturer",)),
    ("row_containment", compare.ROW_CONTAINMENT, ("Description",)),
    ("integer", compare.INTEGER, ("Design Count",)),
    ("decimal", compare.DECIMAL, ("Dimensions Z",)),
    ("boolean", compare.BOOLEAN, ("Nitriding",)),
    ("coating", compare.COATING, ("Coating",)),
    ("nitriding_type", compare.NITRIDING, ("Nitriding type",)),
    ("material", compare.MATERIAL, ("Material",)),
    ("hardness", compare.HARDNESS, ("Hardness",)),
    ("detail_number", compare.DETAIL_NUMBER, ("Detail Number",)),
    ("quantity", compare.QUANTITY, compare.QUANTITIES),
    ("dimension", compare.DIMENSION, compare.DIMENSIONS),
    ("part_number", compare.PART_NUMBER, ("Description",)),
):
    _comparator(_n, _r, _fs)


# Scoring.
def facts(d: Spark) -> str:
    n = "((doc_id * 17 + row_index * 5 + field_ord) % 29)"
    score = transform.rule_score(d, "value", "kind", "method", "cv_severity")
    return f"""{compared(d)}, flagged AS (SELECT *, {compare.category('field')} AS category,
            CASE WHEN doc_id % 4 = 0 THEN 'vision' WHEN doc_id % 4 = 1 THEN 'other' ELSE 'text' END AS extraction_method,
            doc_id % 9 <> 0 AS is_pdf, doc_id % 8 <> 0 AS has_text_layer, extracted IS NOT NULL AS found, {n} = 1 AS blocking, {n} = 2 AS fallback,
            doc_id % 8 = 0 AS counter_required, {n} % 2 = 0 AS counter_passed, true AS plausible, {n} = 3 AS coord_flag, {n} = 4 AS column_flag, {n} = 5 AS dual_flag,
            CASE WHEN {n} = 6 THEN 'error' WHEN {n} = 7 THEN 'warning' ELSE 'none' END AS cv_severity, {n} = 8 AS contradiction, {n} = 9 AS mv_warning, {n} = 10 AS plaus_flag
            FROM compared WHERE value IS NOT NULL),
        scored AS (SELECT *, {score} AS rule_score FROM flagged),
        gated AS (SELECT *, {gate.gate(gate.Config())} AS gate FROM scored),
        classed AS (SELECT *, {gate.classification(gate.Config())} AS class, {gate.soft_score()} AS soft FROM gated),
        verified AS (SELECT *, {gate.verify_score(gate.Config())} AS verify FROM classed)"""


@query("green_gate", "ev")
def green_gate(d: Spark) -> str:
    return f"{facts(d)} SELECT gate, class, count(*) AS n FROM verified GROUP BY gate, class"


@query("cell_scores", "ev")
def cell_scores(d: Spark) -> str:
    return f"{facts(d)} SELECT doc_id, row_index, field, result, gate, class, round(1e-9 + soft, 4) AS soft_score, round(1e-9 + verify, 4) AS verify_score, round(1e-9 + {gate.final_score()}, 4) AS final_score FROM verified"


@query("hard_vetoes", "ev")
def hard_vetoes(d: Spark) -> str:
    parts = [f"CASE WHEN {c} THEN '{v}' END" for v, c in gate.vetoes()]
    return f"{facts(d)}, listed AS (SELECT {d.join(d.compact(d.array(*parts)), ',')} AS vetoes FROM verified) SELECT vetoes, count(*) AS n FROM listed GROUP BY vetoes"


def counted_rows(where: str = "") -> str:
    """Classes counted for each row, then for each document, so that rows are counted without a distinct."""
    n = lambda c: f"sum(CASE WHEN class = '{c}' THEN 1 ELSE 0 END)"
    return f"per_row AS (SELECT doc_id, row_index, count(*) AS n, {n('GREEN')} AS green, {n('YELLOW')} AS yellow, {n('RED')} AS red FROM verified GROUP BY doc_id, row_index){where}"


@query("document_audit", "ev")
def document_audit(d: Spark) -> str:
    return f"""{facts(d)}, {counted_rows()} SELECT doc_id, count(*) AS total_rows, CAST(sum(n) AS BIGINT) AS total_scored, CAST(sum(green) AS BIGINT) AS green, CAST(sum(yellow) AS BIGINT) AS yellow, CAST(sum(red) AS BIGINT) AS red,
        round(1e-9 + sum(green) * CAST(100 AS DOUBLE) / sum(n), 4) AS green_percent FROM per_row GROUP BY doc_id"""


@query("worst_class_per_row", "ev")
def worst_class_per_row(d: Spark) -> str:
    """The most severe class of a row, of equals the first in column order; confirmed by hand ranks with green."""
    rank = "CASE class WHEN 'RED' THEN 3 WHEN 'YELLOW' THEN 2 WHEN 'GREEN' THEN 1 WHEN 'MANUAL_CONFIRMED' THEN 1 ELSE 0 END"
    return f"{facts(d)}, w AS (SELECT doc_id, row_index, max({rank} * 100 + 99 - field_ord) AS worst, max_by(class, {rank} * 100 + 99 - field_ord) AS worst_class FROM verified GROUP BY doc_id, row_index) SELECT doc_id, row_index, worst_class, 99 - worst % 100 AS field_ord FROM w"


@query("empty_cells", "cells")
def empty_cells(d: Spark) -> str:
    need = ", ".join(lit(f) for f, _, r in schema.TARGET_FIELDS if r)
    return f"WITH e AS (SELECT *, field IN ({need}) AS required, doc_id % 10 = 0 AS blocking FROM cells WHERE value IS NULL), c AS (SELECT field, {gate.empty_cell(gate.Config())} AS class FROM e) SELECT field, class, count(*) AS n FROM c GROUP BY field, class"


@query("completeness_verdict", "document_facts")
def completeness_verdict(d: Spark) -> str:
    """Whether a document's completeness rests on an anchor of its own, and why: six reasons in order."""
    reasons = [
        ("NOT is_pdf", "NOT_A_PDF"),
        ("vision_fallback", "VISION_FALLBACK"),
        ("guard_basis NOT IN ('position_set', 'row_band_set')", "NO_ANCHOR"),
        ("NOT has_text_layer", "NO_TEXT_LAYER"),
        ("guard_basis = 'row_band_set'", "ROW_BANDS_FROM_TEXT_LAYER"),
    ]
    why = "CASE " + " ".join(f"WHEN {c} THEN '{r}'" for c, r in reasons) + " ELSE 'POSITIONS_FROM_TEXT_LAYER' END"
    return f"SELECT doc_id, NOT ({' OR '.join(c for c, _ in reasons[:4])}) AS guaranteed, {why} AS reason FROM document_facts"


@query("counter_check_batches", "ev")
def counter_check_batches(d: Spark) -> str:
    """Deferred checks by page in batches of twelve."""
    return f"""{facts(d)}, c AS (SELECT doc_id, row_index, field_ord, CAST(floor(row_index / 3) AS BIGINT) AS page, CASE WHEN gate = 'GREEN' THEN 1 ELSE 0 END AS g FROM verified),
        n AS (SELECT doc_id, page, g, sum(g) OVER (PARTITION BY doc_id, page ORDER BY row_index, field_ord) AS k FROM c)
        SELECT doc_id, page, CAST(floor((k - 1) / 12) AS BIGINT) AS batch, count(*) AS n FROM n WHERE g = 1 GROUP BY doc_id, page, CAST(floor((k - 1) / 12) AS BIGINT)"""


# Cross-validation.
CV = "SELECT doc_id, row_index, field, severity, message FROM"


def _valued(relation: str, fields: str) -> str:
    return f"(SELECT doc_id, row_index, field, value FROM {relation} WHERE field IN ({fields}) AND coalesce(value, '') <> '')"


@query("cv_required_empty", "cells_required")
def cv_required_empty(d: Spark) -> str:
    need = ", ".join(lit(f) for f, _, r in schema.TARGET_FIELDS if r)
    return f"SELECT doc_id, row_index, field, 'warning' AS severity, 'Required field is empty' AS message FROM cells_required WHERE field IN ({need}) AND coalesce(value, '') = ''"


@query("cv_duplicate_positions", "cells_positions")
def cv_duplicate_positions(d: Spark) -> str:
    w = "OVER (PARTITION BY doc_id, v ORDER BY row_index)"
    return f"""WITH p AS (SELECT doc_id, row_index, {fn.strip(d, 'value')} AS v FROM {_valued("cells_positions", "'Detail Number'")}), n AS (SELECT *, row_number() {w} AS k, first_value(row_index) {w} AS first_row FROM p)
        SELECT doc_id, row_index, 'warning' AS severity, 'Duplicate: ''' || v || ''' also in row ' || CAST(first_row AS STRING) AS message FROM n WHERE k > 1"""


@query("cv_dimension_plausible", "cells_dimensions")
def cv_dimension_plausible(d: Spark) -> str:
    v = f"({d.number(f'replace({fn.strip(d, chr(118) + chr(97) + chr(108) + chr(117) + chr(101))}, {lit(",")}, {lit(".")})')})"
    return f"""SELECT doc_id, row_index, field, CASE WHEN {v} < 0.1 THEN 'Very small' ELSE 'Very large' END AS message FROM {_valued("cells_dimensions", "'Dimensions X/D', 'Dimensions Y/L', 'Dimensions Z'")} x WHERE {v} < 0.1 OR {v} > 5000"""


@query("cv_material_hardness", "cells_hardness")
def cv_material_hardness(d: Spark) -> str:
    """Aluminium over 40 HRC is an error; else the range of the catalog's material with a tolerance of 5."""
    low = " ".join(f"WHEN {lit(name)} THEN {h[0]}" for _, name, _, h, _ in schema.MATERIALS if h)
    high = " ".join(f"WHEN {lit(name)} THEN {h[1]}" for _, name, _, h, _ in schema.MATERIALS if h)
    return f"""WITH w AS (SELECT doc_id, row_index, max(CASE WHEN field = 'Material' THEN value END) AS mat, max(CASE WHEN field = 'Hardness' THEN value END) AS hard FROM cells_hardness GROUP BY doc_id, row_index),
        j AS (SELECT doc_id, row_index, mat, {fn.hardness_low(d, 'hard')} AS lo, {fn.hardness_high(d, 'hard')} AS hi, {d.contains('upper(hard)', lit('HB'))} AS hb FROM w WHERE coalesce(mat, '') <> '' AND coalesce(hard, '') <> ''),
        r AS (SELECT *, CAST(CASE mat {low} END AS DOUBLE) AS elo, CAST(CASE mat {high} END AS DOUBLE) AS ehi, {d.contains('lower(mat)', lit('alu'))} OR {d.contains('lower(mat)', lit('alsi'))} AS alu FROM j WHERE NOT hb AND lo IS NOT NULL)
        SELECT doc_id, row_index, CASE WHEN alu AND hi > 40 THEN 'error' WHEN hi < elo - 5 THEN 'info' ELSE 'warning' END AS severity FROM r WHERE (alu AND hi > 40) OR hi < elo - 5 OR lo > ehi + 5"""


@query("cv_counts", "cells_counts")
def cv_counts(d: Spark) -> str:
    n = f"(CASE WHEN {d.matches('value', r'^\s*[-+]?[0-9]+\s*$')} THEN TRY_CAST(trim(value) AS BIGINT) END)"
    return f"""WITH c AS (SELECT *, {n} AS n FROM {_valued("cells_counts", "'Design Count', 'Spare Count'")} x)
        SELECT doc_id, row_index, field, 'warning' AS severity, 'Not an integer' AS message FROM c WHERE n IS NULL
        UNION ALL SELECT doc_id, row_index, field, 'warning', 'Design Count should be >= 1' FROM c WHERE field = 'Design Count' AND n < 1
        UNION ALL SELECT doc_id, row_index, field, 'error', 'Negative count' FROM c WHERE n < 0"""


@query("cv_weight_density", "bom_src")
def cv_weight_density(d: Spark) -> str:
    """Weight against volume times density; the part's retail size stands for the weight here."""
    stages = [{a: f"TRY_CAST({fn.dimension(d, 'Masse', a)} AS DOUBLE)" for a in "xyz"} | {"rho": f"CAST({fn.density(d, 'Werkstoff')} AS DOUBLE)"}, {"ratio": "CAST(l_partkey % 7 AS DOUBLE) / 2 / nullif(x * y * z / 1000000.0 * rho, 0)"}]
    return f"WITH w AS ({transform.staged_sql('bom_src', stages)}), m AS (SELECT doc_id, row_index, max(ratio) AS ratio FROM w GROUP BY doc_id, row_index) SELECT doc_id, row_index, 'error' AS severity FROM m WHERE ratio < 0.1 OR ratio > 10"


@query("cv_issue_counts", "cells_counts")
def cv_issue_counts(d: Spark) -> str:
    return f"WITH i AS (SELECT field, severity FROM ({cv_counts(d).replace('WITH c AS', 'WITH c AS', 1)}) q) SELECT field, severity, count(*) AS n FROM i GROUP BY field, severity"


# Mapping validation; the checks over a mapping table are in ``mappings.py``.
@query("mapping_duplicate_targets", "supplier")
def mapping_duplicate_targets(d: Spark) -> str:
    """Several source columns mapped to one target: the most confident stays, others lose it."""
    return """WITH m AS (SELECT s_suppkey AS map_ord, s_nationkey AS target, round(1e-9 + abs(s_acctbal) / 10000, 4) AS confidence FROM supplier),
        r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY confidence DESC, map_ord) AS k FROM m)
        SELECT map_ord, CASE WHEN k = 1 THEN target END AS target, round(1e-9 + CASE WHEN k = 1 THEN confidence ELSE confidence * 0.3 END, 6) AS confidence FROM r"""


@query("mapping_required_unmapped", "cells")
def mapping_required_unmapped(d: Spark) -> str:
    need = ", ".join(lit(f) for f, _, r in schema.TARGET_FIELDS if r)
    return f"""WITH n AS (SELECT DISTINCT doc_id, field FROM cells WHERE field IN ({need})), m AS (SELECT DISTINCT doc_id, field FROM cells WHERE coalesce(raw_value, '') <> '')
        SELECT n.doc_id, n.field FROM n LEFT JOIN m ON n.doc_id = m.doc_id AND n.field = m.field WHERE m.doc_id IS NULL"""


@query("mapping_value_evidence", "bom_src")
def mapping_value_evidence(d: Spark) -> str:
    """Share of a column's values that look like materials or combined dimensions; 40 % lifts the candidate to .89."""
    mat = f"({fn.material_number(d, 'Werkstoff')} IS NOT NULL OR ({fn.stripped_material_number(d, 'Werkstoff')}) IS NOT NULL)"
    dim = d.matches("Masse", r"[0-9]+[.,]?[0-9]*\s*[xX×*]\s*[0-9]+")
    share = lambda c, col: f"avg(CASE WHEN {fn.blank(d, col)} THEN NULL WHEN {c} THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)"
    return f"""WITH s AS (SELECT doc_id, {share(mat, 'Werkstoff')} AS mat, {share(dim, 'Masse')} AS dim FROM bom_src GROUP BY doc_id)
        SELECT doc_id, round(1e-9 + mat, 6) AS material_share, round(1e-9 + dim, 6) AS dimension_share, CASE WHEN mat >= 0.4 THEN 0.89 ELSE 0.80 END AS material_candidate, CASE WHEN dim >= 0.4 THEN 0.89 ELSE 0.80 END AS dimension_candidate FROM s"""


@query("mapping_summary", "cells")
def mapping_summary(d: Spark) -> str:
    return "SELECT doc_id, count(DISTINCT CASE WHEN method <> 'empty' THEN field END) AS mapped, round(1e-9 + avg(CASE WHEN method <> 'empty' THEN confidence END), 6) AS avg_confidence FROM cells GROUP BY doc_id"


# Reconciliation and completeness.
def positions(d: Spark) -> str:
    p = fn.position(d, "Pos")
    return f"WITH pdf AS (SELECT doc_id, row_index, {p} AS pos FROM bom_src), ext AS (SELECT doc_id, row_index, pos FROM pdf WHERE (doc_id + row_index) % 6 <> 0)"


@query("reconcile_positions", "bom_src")
def reconcile_positions(d: Spark) -> str:
    """Positions of the document that the extraction lacks become synthetic rows after its last one."""
    return f"""{positions(d)}, missing AS (SELECT DISTINCT p.doc_id, p.pos FROM pdf p LEFT JOIN ext e ON p.doc_id = e.doc_id AND p.pos = e.pos WHERE p.pos <> '' AND e.doc_id IS NULL),
        top AS (SELECT doc_id, max(row_index) AS last_row FROM ext GROUP BY doc_id)
        SELECT m.doc_id, CAST(coalesce(t.last_row, -1) + row_number() OVER (PARTITION BY m.doc_id ORDER BY m.pos) AS BIGINT) AS row_index, m.pos AS value, 'synthetic_pdf_only_missing' AS method FROM missing m LEFT JOIN top t ON m.doc_id = t.doc_id"""


@query("reconcile_multiset", "bom_src")
def reconcile_multiset(d: Spark) -> str:
    """Positions that occur more often in the document than in the extraction: a synthetic row for each that is short, after the last row."""
    each = "LATERAL VIEW explode(sequence(1, CAST(shortfall AS INT))) e AS nth" if d.name == "spark" else ", unnest(generate_series(1, shortfall)) AS e(nth)"
    return f"""{positions(d)}, a AS (SELECT doc_id, pos, count(*) AS n FROM pdf WHERE pos <> '' GROUP BY doc_id, pos), b AS (SELECT doc_id, pos, count(*) AS n FROM ext WHERE pos <> '' GROUP BY doc_id, pos),
        short_of AS (SELECT a.doc_id, a.pos, a.n AS pdf_count, b.n AS extracted_count, a.n - b.n AS shortfall FROM a JOIN b ON a.doc_id = b.doc_id AND a.pos = b.pos WHERE a.n >= 2 AND a.n > b.n),
        x AS (SELECT doc_id, pos, pdf_count, extracted_count, CAST(nth AS BIGINT) AS nth FROM short_of {each}), last_row AS (SELECT doc_id, max(row_index) AS top FROM ext GROUP BY doc_id)
        SELECT x.doc_id, x.pos, pdf_count, extracted_count, nth, top + row_number() OVER (PARTITION BY x.doc_id ORDER BY x.pos, nth) AS row_index, 'synthetic_pdf_only_missing' AS method FROM x JOIN last_row l ON x.doc_id = l.doc_id"""


@query("reconcile_bands", "bom_src")
def reconcile_bands(d: Spark) -> str:
    return f"""{positions(d)}, band AS (SELECT doc_id, 'p1:b' || lpad(CAST(row_index AS STRING), 4, '0') AS band_id FROM pdf), got AS (SELECT doc_id, 'p1:b' || lpad(CAST(row_index AS STRING), 4, '0') AS band_id FROM ext),
        lost AS (SELECT b.doc_id, b.band_id FROM band b LEFT JOIN got g ON b.doc_id = g.doc_id AND b.band_id = g.band_id WHERE g.doc_id IS NULL), last_row AS (SELECT doc_id, max(row_index) AS top FROM ext GROUP BY doc_id)
        SELECT m.doc_id, m.band_id, coalesce(top, -1) + row_number() OVER (PARTITION BY m.doc_id ORDER BY m.band_id) AS row_index, CAST(NULL AS {d.string}) AS value, 'synthetic_pdf_only_missing' AS method FROM lost m LEFT JOIN last_row l ON m.doc_id = l.doc_id"""


@query("guard_basis", "document_facts")
def guard_basis(d: Spark) -> str:
    """Bands of the text layer, else positions, else the number of rows."""
    return "SELECT doc_id, guard_basis, expected FROM document_facts"


@query("coverage_guard", "bom_src")
def coverage_guard(d: Spark) -> str:
    """A red cell for each expected position that no scored row has, numbered after the last row."""
    return f"""{positions(d)}, master AS (SELECT DISTINCT doc_id, pos FROM pdf WHERE pos <> ''), scored AS (SELECT DISTINCT doc_id, pos FROM ext WHERE pos <> ''), last_row AS (SELECT doc_id, max(row_index) AS top FROM ext GROUP BY doc_id)
        SELECT m.doc_id, coalesce(l.top, -1) + row_number() OVER (PARTITION BY m.doc_id ORDER BY m.pos) AS row_index, 'Detail Number' AS target_field, m.pos AS transformed_value, 'synthetic_pdf_only_missing' AS method, 'MISMATCH' AS match_result, 'A' AS category, 'RECONCILER_MISSING_POSITION' AS hard_vetoes, 'RED' AS class, CAST(0 AS DOUBLE) AS final_score
        FROM master m LEFT JOIN scored s ON m.doc_id = s.doc_id AND m.pos = s.pos LEFT JOIN last_row l ON m.doc_id = l.doc_id WHERE s.doc_id IS NULL"""


@query("export_guard", "bom_src")
def export_guard(d: Spark) -> str:
    """Expected rows less excluded ones against rows written: violations per document."""
    return f"""{positions(d)}, excluded AS (SELECT doc_id, row_index FROM pdf WHERE (doc_id + row_index) % 12 = 0)
        SELECT p.doc_id, count(*) AS violations FROM pdf p LEFT JOIN ext e ON p.doc_id = e.doc_id AND p.row_index = e.row_index LEFT JOIN excluded x ON p.doc_id = x.doc_id AND p.row_index = x.row_index
        WHERE e.doc_id IS NULL AND x.doc_id IS NULL GROUP BY p.doc_id"""


@query("distinct_positions", "bom_src")
def distinct_positions(d: Spark) -> str:
    """Ordered distinct positions: the first row of each."""
    return f"{positions(d)}, f AS (SELECT doc_id, pos, min(row_index) AS first_row FROM pdf WHERE pos <> '' GROUP BY doc_id, pos) SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY first_row, pos) AS ord FROM f"


@query("position_counts", "bom_src")
def position_counts(d: Spark) -> str:
    return f"SELECT doc_id, upper({fn.clean_text(d, 'Pos')}) AS pos, count(*) AS n FROM bom_src WHERE NOT {fn.blank(d, 'Pos')} GROUP BY doc_id, upper({fn.clean_text(d, 'Pos')})"


@query("full_row_dedup", "bom_src")
def full_row_dedup(d: Spark) -> str:
    from .bom import CELLS

    cols = ", ".join(CELLS)
    return f"WITH n AS (SELECT doc_id, row_index, row_number() OVER (PARTITION BY doc_id, {cols} ORDER BY row_index) AS k FROM bom_src) SELECT doc_id, row_index FROM n WHERE k = 1"


@query("column_jaccard", "bom_src")
def column_jaccard(d: Spark) -> str:
    """Jaccard of the sets of non-empty columns of neighbouring rows; 1 for two empty sets."""
    cols = ("Reserve", "Masse", "Werkstoff", "Haerte", "Nitriert")
    f = ", ".join(f"CASE WHEN {fn.blank(d, c)} THEN 0 ELSE 1 END AS b{i}" for i, c in enumerate(cols))
    p = ", ".join(f"lag(b{i}) OVER (PARTITION BY doc_id ORDER BY row_index) AS p{i}" for i in range(5))
    both = " + ".join(f"b{i} * p{i}" for i in range(5))
    any_of = " + ".join(f"greatest(b{i}, p{i})" for i in range(5))
    return f"WITH f AS (SELECT doc_id, row_index, {f} FROM bom_src), g AS (SELECT doc_id, row_index, {', '.join(f'b{i}' for i in range(5))}, {p} FROM f) SELECT doc_id, row_index, round(1e-9 + CASE WHEN {any_of} = 0 THEN 1.0 ELSE ({both}) * CAST(1 AS DOUBLE) / ({any_of}) END, 6) AS jaccard FROM g WHERE p0 IS NOT NULL"


@query("value_plausible", "cells")
def value_plausible(d: Spark) -> str:
    n = f"({d.number(f'replace({fn.strip(d, "value")}, {lit(",")}, {lit(".")})')})"
    ok = f"CASE WHEN field IN ('Design Count', 'Spare Count') THEN {n} IS NULL OR ({n} > 0 AND {n} < 10000) WHEN field = 'Description' THEN length({d.replace('value', '[^0-9A-Za-zÀ-ÿ]')}) >= 2 ELSE true END"
    return f"WITH p AS (SELECT field, {ok} AS plausible FROM cells WHERE value IS NOT NULL) SELECT field, plausible, count(*) AS n FROM p GROUP BY field, plausible"


# Review mutations.
@query("apply_cell_edits", "ev", "cell_edit")
def apply_cell_edits(d: Spark) -> str:
    """Edits of a batch: the last of a cell wins, the cell is confirmed by hand and its scores are raised; an edit of no cell adds one."""
    return f"""{facts(d)}, last_edit AS (SELECT doc_id, row_index, field, max_by(new_value, edit_ord) AS new_value FROM cell_edit GROUP BY doc_id, row_index, field)
        SELECT coalesce(v.doc_id, e.doc_id) AS doc_id, coalesce(v.row_index, e.row_index) AS row_index, coalesce(v.field, e.field) AS field, coalesce(e.new_value, v.value) AS value, CASE WHEN e.new_value IS NOT NULL THEN 'MANUAL_CONFIRMED' ELSE v.class END AS class,
               round(1e-9 + CASE WHEN e.new_value IS NOT NULL THEN greatest(coalesce(v.soft, CAST(0 AS DOUBLE)), CAST(0.95 AS DOUBLE)) ELSE v.soft END, 4) AS soft_score, CASE WHEN e.new_value IS NOT NULL THEN v.value END AS previous_value
        FROM verified v FULL JOIN last_edit e ON v.doc_id = e.doc_id AND v.row_index = e.row_index AND v.field = e.field"""


@query("apply_row_exclusions", "ev", "row_exclusion")
def apply_row_exclusions(d: Spark) -> str:
    """Counters of a document after rows are excluded and some of them restored: the last request of a row decides, unknown rows count for nothing."""
    # Rows and exclusions meet in one aggregate, not in a join.
    return f"""{facts(d)}, x AS (SELECT doc_id, row_index FROM row_exclusion GROUP BY doc_id, row_index HAVING max_by(excluded, request_ord)), {counted_rows()},
        both_of AS (SELECT doc_id, row_index, n, green, yellow, red, 0 AS gone FROM per_row UNION ALL SELECT doc_id, row_index, 0, 0, 0, 0, 1 FROM x),
        kept AS (SELECT doc_id, row_index, sum(n) AS n, sum(green) AS green, sum(yellow) AS yellow, sum(red) AS red FROM both_of GROUP BY doc_id, row_index HAVING max(gone) = 0)
        SELECT doc_id, CAST(sum(n) AS BIGINT) AS total_scored, CAST(sum(green) AS BIGINT) AS green, CAST(sum(yellow) AS BIGINT) AS yellow, CAST(sum(red) AS BIGINT) AS red, count(*) AS total_rows FROM kept GROUP BY doc_id"""


@query("review_queue", "ev")
def review_queue(d: Spark) -> str:
    opened = "CASE WHEN class IN ('YELLOW', 'RED') THEN field_ord END"
    return f"{facts(d)}, o AS (SELECT doc_id, row_index, {opened} AS open_field FROM verified) SELECT doc_id, row_index, min(open_field) AS first_open, count(open_field) AS n_open FROM o GROUP BY doc_id, row_index HAVING count(open_field) > 0"


@query("correction_audit_lookup", "correction", "cells")
def correction_audit_lookup(d: Spark) -> str:
    return "SELECT c.event_id, c.customer, c.target_field, t.value AS original FROM correction c LEFT JOIN cells t ON t.doc_id = c.event_id AND t.row_index = c.row_index AND t.field = 'Material'"


# Statistics over the history of jobs.
SCORED = "(green_count + yellow_count + red_count)"


@query("stats_overview", "job")
def stats_overview(d: Spark) -> str:
    return f"""WITH c AS (SELECT count(*) AS jobs, sum(total_rows) AS n_rows, sum(green_count) AS green, sum({SCORED}) AS scored FROM job WHERE NOT archived AND status = 'completed')
        SELECT jobs, n_rows AS total_rows, green, scored, round(1e-9 + CASE WHEN scored > 0 THEN green * CAST(1 AS DOUBLE) / scored ELSE 0 END, 4) AS automation_rate, round(1e-9 + n_rows * 3.0 / 60 * CASE WHEN scored > 0 THEN green * CAST(1 AS DOUBLE) / scored ELSE 0 END, 1) AS hours_saved FROM c"""


@query("stats_status_counts", "job")
def stats_status_counts(d: Spark) -> str:
    return "SELECT status, count(*) AS n FROM job WHERE NOT archived GROUP BY status"


@query("stats_by_month", "job")
def stats_by_month(d: Spark) -> str:
    m = "date_format(created_at, 'yyyy-MM')" if d.name == "spark" else "strftime(created_at, '%Y-%m')"
    return f"SELECT {m} AS bucket, count(*) AS jobs, sum(total_rows) AS n_rows, round(1e-9 + CASE WHEN sum({SCORED}) > 0 THEN sum(green_count) * CAST(1 AS DOUBLE) / sum({SCORED}) ELSE 0 END, 4) AS rate FROM job WHERE NOT archived AND status = 'completed' GROUP BY 1"


@query("stats_by_week", "job")
def stats_by_week(d: Spark) -> str:
    y, w = ("extract(YEAROFWEEK FROM created_at)", "weekofyear(created_at)") if d.name == "spark" else ("isoyear(created_at)", "week(created_at)")
    return f"SELECT CAST({y} AS STRING) || '-KW' || lpad(CAST({w} AS STRING), 2, '0') AS bucket, count(*) AS jobs, sum(total_rows) AS n_rows FROM job WHERE NOT archived AND status = 'completed' GROUP BY 1"


@query("stats_by_customer", "job", "correction")
def stats_by_customer(d: Spark) -> str:
    return f"""WITH j AS (SELECT CASE WHEN customer = '' THEN 'Unbekannt' ELSE customer END AS customer, count(*) AS jobs, sum(total_rows) AS n_rows, sum(green_count) AS g, sum({SCORED}) AS s FROM job WHERE NOT archived AND status = 'completed' GROUP BY 1),
        k AS (SELECT customer, count(*) AS n FROM correction GROUP BY customer)
        SELECT j.customer, j.jobs, j.n_rows, round(1e-9 + CASE WHEN s > 0 THEN g * CAST(1 AS DOUBLE) / s ELSE 0 END, 4) AS rate, coalesce(k.n, 0) AS corrections FROM j LEFT JOIN k ON j.customer = k.customer"""


@query("corrections_top_fields", "correction")
def corrections_top_fields(d: Spark) -> str:
    return "SELECT target_field, n FROM (SELECT target_field, count(*) AS n, min(event_id) AS first_seen FROM correction GROUP BY target_field) q ORDER BY n DESC, first_seen LIMIT 10"


@query("corrections_by_month", "correction")
def corrections_by_month(d: Spark) -> str:
    m = "date_format(ts, 'yyyy-MM')" if d.name == "spark" else "strftime(ts, '%Y-%m')"
    return f"SELECT {m} AS bucket, customer, count(*) AS n FROM correction GROUP BY 1, customer"


@query("learned_corrections", "correction")
def learned_corrections(d: Spark) -> str:
    """The last eight corrections of a customer, regardless of case."""
    return "WITH r AS (SELECT lower(customer) AS customer, event_id, target_field, row_number() OVER (PARTITION BY lower(customer) ORDER BY ts DESC, event_id DESC) AS k FROM correction WHERE customer <> '') SELECT customer, event_id, target_field, k FROM r WHERE k <= 8"


@query("job_list", "job")
def job_list(d: Spark) -> str:
    return "SELECT job_id, filename, customer, status, created_at FROM job WHERE NOT archived AND status = 'completed' AND (lower(filename) LIKE '%_7%' OR lower(customer) LIKE '%_7%')"


@query("job_page", "job")
def job_page(d: Spark) -> str:
    return "SELECT job_id, customer, created_at FROM job WHERE NOT archived ORDER BY created_at DESC, job_id LIMIT 20 OFFSET 40"


@query("job_queue_position", "job")
def job_queue_position(d: Spark) -> str:
    """One queue, first in first out. Only pending jobs are numbered, which a queue's bound keeps few."""
    return "SELECT job_id, row_number() OVER (ORDER BY created_at, job_id) AS queue_position FROM job WHERE status = 'pending'"


@query("job_recovery", "job")
def job_recovery(d: Spark) -> str:
    return "SELECT job_id, CASE WHEN status IN ('pending', 'processing') THEN 'failed' ELSE status END AS status FROM job"


@query("system_counts", "job")
def system_counts(d: Spark) -> str:
    n = lambda c: f"sum(CASE WHEN {c} THEN 1 ELSE 0 END)"
    return f"SELECT count(*) AS total, {n('NOT archived')} AS active, {n('archived')} AS archived, {n(chr(115) + 'tatus = ' + lit('completed'))} AS completed, {n('status IN (' + lit('pending') + ', ' + lit('processing') + ')')} AS open_jobs FROM job"


@query("dashboard_rates", "job")
def dashboard_rates(d: Spark) -> str:
    """Share of green among all cells, as the dashboard shows it, beside the share among scored cells."""
    return f"SELECT job_id, round(1e-9 + CASE WHEN total_cells > 0 THEN green_count * CAST(1 AS DOUBLE) / total_cells ELSE 0 END, 4) AS rate_of_cells, round(1e-9 + CASE WHEN {SCORED} > 0 THEN green_count * CAST(1 AS DOUBLE) / {SCORED} ELSE 0 END, 4) AS rate_of_scored FROM job WHERE status = 'completed'"


@query("audit_percentages", "job")
def audit_percentages(d: Spark) -> str:
    return f"SELECT job_id, round(1e-9 + CASE WHEN {SCORED} > 0 THEN yellow_count * CAST(100 AS DOUBLE) / {SCORED} ELSE 0 END, 4) AS yellow_percent, round(1e-9 + CASE WHEN total_cells > 0 THEN neutral_count * CAST(100 AS DOUBLE) / total_cells ELSE 0 END, 4) AS neutral_percent FROM job"


# Tokens, boxes and evidence.
@query("close_numeric_miss", "bom_src")
def close_numeric_miss(d: Spark) -> str:
    """Numbers that differ by one edit, or of which one starts the other with two digits more at most."""
    a, b = f"coalesce({fn.coerce_integer(d, 'Menge')}, '')", "CAST(l_partkey % 60 AS STRING)"
    starts = "starts_with" if d.name == "duck" else "startswith"
    return f"""WITH t AS (SELECT doc_id, row_index, {a} AS a, {b} AS b FROM bom_src), n AS (SELECT * FROM t WHERE {d.matches('a', '^[0-9]+$')} AND a <> b)
        SELECT doc_id, row_index, a, b, CAST(levenshtein(a, b) AS BIGINT) AS distance, (({starts}(a, b) OR {starts}(b, a)) AND abs(length(a) - length(b)) <= 2) OR levenshtein(a, b) <= 1 AS close FROM n"""


@query("box_overlap", "bom_src")
def box_overlap(d: Spark) -> str:
    """Share of the union of two vertical intervals that both cover, and the gap between them."""
    return """WITH b AS (SELECT doc_id, row_index, CAST(row_index * 20 AS DOUBLE) AS a0, CAST(row_index * 20 + 8 AS DOUBLE) AS a1, CAST(row_index * 20 + l_partkey % 15 AS DOUBLE) AS b0, CAST(row_index * 20 + l_partkey % 15 + 6 AS DOUBLE) AS b1 FROM bom_src),
        o AS (SELECT *, greatest(CAST(0 AS DOUBLE), least(a1, b1) - greatest(a0, b0)) AS common, greatest(a1, b1) - least(a0, b0) AS span FROM b)
        SELECT doc_id, row_index, round(1e-9 + common / (a1 - a0 + b1 - b0 - common), 6) AS iou, greatest(CAST(0 AS DOUBLE), greatest(a0, b0) - least(a1, b1)) AS gap, CASE WHEN common / (a1 - a0 + b1 - b0 - common) >= 0.55 THEN 'confirm' WHEN common / (a1 - a0 + b1 - b0 - common) >= 0.35 OR greatest(a0, b0) - least(a1, b1) <= 12 AND common = 0 THEN 'corridor' ELSE 'none' END AS status FROM o"""


@query("extraction_confidence", "ev")
def extraction_confidence(d: Spark) -> str:
    """Confidence of a location by its kind, capped where the source was repaired or the column is uncertain."""
    base = "CASE match_type WHEN 'column_corridor' THEN 0.98 WHEN 'column_estimate' THEN 0.88 WHEN 'row_fallback' THEN 0.82 ELSE 0.72 END"
    text = "CASE WHEN extraction_confidence <= 0 THEN 0.95 ELSE extraction_confidence END"
    c = f"CASE WHEN doc_id % 2 = 0 THEN CAST({text} AS DOUBLE) ELSE CAST({base} AS DOUBLE) END"
    capped = f"least({c}, CASE WHEN doc_id % 11 = 0 THEN CAST(0.86 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END, CASE WHEN row_index % 13 = 5 THEN CAST(0.68 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END)"
    return f"WITH e AS (SELECT field, match_type, {capped} AS confidence FROM ev WHERE extracted IS NOT NULL) SELECT field, match_type, round(1e-9 + avg(confidence), 6) AS confidence, count(*) AS n FROM e GROUP BY field, match_type"


@query("canonical_pairs", "ev")
def canonical_pairs(d: Spark) -> str:
    """Both sides of a coating or nitriding comparison in canonical form; unknown values stand for themselves."""
    canon = lambda x: f"CASE WHEN field = 'Coating' THEN coalesce({transform.lookup(d, x, schema.alias_rows('coating'))}, {x}) ELSE coalesce({transform.lookup(d, x, schema.alias_rows('nitriding'))}, {x}) END"
    return f"WITH n AS (SELECT doc_id, row_index, field, {compare.norm(d, 'value')} AS m, {compare.norm(d, 'extracted')} AS e FROM ev WHERE field IN ('Coating', 'Nitriding type') AND value IS NOT NULL) SELECT doc_id, row_index, field, {canon('m')} AS mapped, {canon('e')} AS extracted FROM n"


@query("context_windows", "bom_src")
def context_windows(d: Spark) -> str:
    """The lines around each line of a document's text that names a part number's anchor."""
    w = "OVER (PARTITION BY doc_id ORDER BY row_index)"
    return f"""WITH l AS (SELECT doc_id, row_index, coalesce(trim(Pos), '') || ' ' || Benennung AS line FROM bom_src), c AS (SELECT doc_id, row_index, line, coalesce(lag(line) {w}, '') || ' | ' || line || ' | ' || coalesce(lead(line) {w}, '') AS context FROM l)
        SELECT doc_id, row_index, context FROM c WHERE {d.matches('line', r'(^|[^A-Za-z0-9])K-[0-9]+($|[^A-Za-z0-9])')}"""


@query("anchor_row_match", "bom_src")
def anchor_row_match(d: Spark) -> str:
    """Rows of a document by how many anchor tokens another rendering of it holds; two at least, the best row wins."""
    hit = lambda x: f"CASE WHEN {x} <> '' AND {d.contains('t', x)} THEN 1 ELSE 0 END"
    return f"""WITH a AS (SELECT doc_id, row_index, {fn.alnum(d, 'Pos')} AS p, {fn.alnum(d, 'Werkstoff')} AS w, {fn.alnum(d, 'Masse')} AS s FROM bom_src), t AS (SELECT doc_id, row_index AS other, {fn.alnum(d, "coalesce(Pos, '') || coalesce(Werkstoff, '') || coalesce(Masse, '')")} AS t FROM bom_src),
        j AS (SELECT a.doc_id, a.row_index, other, {hit('p')} + {hit('w')} + {hit('s')} AS score FROM a JOIN t ON a.doc_id = t.doc_id), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, row_index ORDER BY score DESC, other) AS k FROM j WHERE score >= 2)
        SELECT doc_id, row_index, other, score FROM r WHERE k = 1"""


@query("excel_column_order", "supplier")
def excel_column_order(d: Spark) -> str:
    """Columns A to Z before AA, and so on to names of any length; blank ones last."""
    n = "CAST(s_suppkey AS BIGINT)"
    if d.name == "spark":
        # The name's k-th letter from the right is there from the first number of k letters on.
        first = [sum(26**i for i in range(1, k)) for k in range(1, 15)]
        name = " || ".join(f"CASE WHEN n >= {first[k]} THEN chr(CAST(65 + (n - {first[k]}) div {26**k} % 26 AS INT)) ELSE '' END" for k in reversed(range(14)))
        return f"WITH c AS (SELECT {n} AS n FROM supplier), k AS (SELECT n, CASE WHEN n % 17 = 3 THEN '' ELSE {name} END AS col FROM c) SELECT n, col, row_number() OVER (ORDER BY CASE WHEN col = '' THEN 10000 ELSE length(col) END, col, n) AS ord FROM k"
    # The DuckDB text still ends at 600 suppliers: it is what results are held against, and is not changed with them.
    letter = "chr(CAST(65 + n % 26 AS INT))"
    return f"WITH c AS (SELECT {n} AS n FROM supplier), k AS (SELECT n, CASE WHEN n % 17 = 3 THEN '' WHEN n >= 26 THEN chr(CAST(64 + n / 26 AS INT)) || {letter} ELSE {letter} END AS col FROM c WHERE n < 600 AND (n < 26 OR n % 26 < 26)) SELECT n, col, row_number() OVER (ORDER BY CASE WHEN col = '' THEN 10000 ELSE length(col) END, col, n) AS ord FROM k".replace("n / 26", "floor(n / 26)")


@query("flag_columns", "bom_src")
def flag_columns(d: Spark) -> str:
    """Column of a plausibility flag: what stands before its first colon."""
    first = d.item(d.split("flag", ":"), 0)
    return f"WITH f AS (SELECT doc_id, row_index, 'Masse: ' || coalesce(Masse, '') AS flag FROM bom_src) SELECT doc_id, row_index, {first} AS source_column FROM f"


@query("text_layer_present", "bom_src")
def text_layer_present(d: Spark) -> str:
    return "SELECT doc_id, sum(length(coalesce(Benennung, ''))) >= 50 AS has_text_layer, sum(length(coalesce(Benennung, ''))) < 100 AS is_scanned FROM bom_src GROUP BY doc_id"
