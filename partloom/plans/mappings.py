"""Queries over mappings and raw cells of documents with any columns: mapping checks, evidence, cells under a mapping table."""

from __future__ import annotations

from ..functions import scalar as fn
from ..functions.dialect import Spark, lit
from ..operators import schema
from .queries import query

# Hints in headers, evidence thresholds, keywords of columns and rules of their cells.
SPARE, QUANTITY = r"(?i)spare|ersatz|reserve|backup", r"(?i)qty|quantity|anzahl|menge|stk|stck|count"
CUSTOMER, MAKER = r"(?i)customer|kunden|cust|client", r"(?i)manufacturer|hersteller|supplier|lieferant|vendor"
NUMERIC, WHOLE, COMBINED, CODE = r"^[0-9.,\s\-+±/xX×Øø°]+$", r"^[0-9]+$", r"[0-9]+[.,]?[0-9]*\s*[xX×*]\s*[0-9]+", r"\b[0-9]\.[0-9]{4}\b"
MIN_EVIDENCE, BOOST, CONSENSUS_CAP = 0.4, 0.89, 0.85
ANCHOR_WORDS = ("pos", "position", "detail", "nr", "no", "num", "pozice", "index", "序号", "图号", "n°")
POSITION_WORDS = ("pos", "position", "nr")
HEADER_WORDS = ("pos", "position", "benennung", "bezeichnung", "description", "stk", "stück", "menge", "qty", "werkstoff", "material", "zeichn")
TYPE_EXCLUSIONS = ("artikelnr", "artikelnummer", "sachnummer", "sachnr", "part no", "teilename", "teil", "teilenr", "bauteilnr")
TYPE_WORDS = {
    "position": ("pos", "position", "no", "num", "detail", "pozice"),
    "quantity": ("stk", "stück", "stck", "qty", "quantity", "anzahl", "menge", "množství", "pcs", "count"),
    "material": ("werkst", "werkstoff", "material", "matériau", "materiale", "norma"),
    "dimensions": ("fertigma", "fertigmaß", "dimension", "maße", "masse", "rohmass", "rohma", "finish", "abmaß", "rozměr"),
    "hardness": ("härte", "hardness", "hrc", "hrb", "durezza", "tepelzprac"),
    "description": ("benennung", "bezeichnung", "description", "popis", "name", "teilename", "teil", "denominazione"),
}
FORBIDDEN = {"position": ("-", "x", ".", "Ø", "_", "/"), "quantity": ("-", "x", ".", "Ø", "_"), "material": (" x ", "×", "HRC", "HB"), "dimensions": ("ESU", "HRC", "VGN")}
EXPECTED = {
    "material": r"^1[.\-][0-9]{4}|^[A-Z]{1,4}[0-9]|^(blank|VGN|VGT|DIN)|^[A-Za-z]{2,}",
    "dimensions": r"[0-9]+[.,]?[0-9]*\s*[xX×*]\s*[0-9]+|[ØD]\s*[0-9]+|^[0-9]+[.,][0-9]+$",
    "hardness": r"[0-9]+.*HRC|[0-9]+.*HB|[0-9]+.*N/mm|[0-9]+\s*±|^[0-9]+[.,]?[0-9]*$|^[0-9]+\s*-\s*[0-9]+",
}
RANGES = {"position": (1, 9999, 4), "quantity": (1, 999, None)}
FOOTERS = (
    r"(?i)(seite|page|p[áa]g|页|blatt|feuille)\s*\.?\s*[0-9]+",
    r"(?i)(©|copyright|all rights reserved|confidential|vertraulich)",
    r"(?i)(gedruckt|printed|imprim|powered by|notta\.ai)",
    r"(?i)\brev(ision)?\.?\s*[:#]?\s*[A-Za-z0-9]",
    r"\b[0-9]{1,2}[.\-/][0-9]{1,2}[.\-/][0-9]{2,4}\b",
    r"(?i)(unkontrolliert|uncontrolled|kontrollierte kopie|controlled|受控|副本)",
)
PAGE_RATIO = r"(?i)[0-9]+\s*(/|von|of|aus|sur)\s*[0-9]+\b"
DIMENSIONS = ", ".join(map(lit, schema.DIMENSION_FIELDS))


def _any_word(d: Spark, x: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(d.contains(x, lit(w)) for w in words) + ")"


def _share(d: Spark, condition: str) -> str:
    return f"avg(CASE WHEN {condition} THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)"


# Cells under a mapping table.
@query("mapped_cells", "mapped", lean={"mapped": "mapped_filled"})
def mapped_cells(d: Spark) -> str:
    """Documents of several column layouts, transformed under a mapping table."""
    return "SELECT doc_id, row_index, field, raw_value, value, confidence, method FROM mapped WHERE method <> 'empty'"


@query("mapped_cell_counts", "mapped")
def mapped_cell_counts(d: Spark) -> str:
    return "SELECT doc_id, field, method, count(*) AS n, round(1e-9 + avg(confidence), 6) AS confidence FROM mapped GROUP BY doc_id, field, method"


@query("mapping_lookup", "mapping")
def mapping_lookup(d: Spark) -> str:
    """Source column, confidence and reasoning of each target field: the last mapping wins."""
    return "SELECT doc_id, target_field, max_by(source_column, map_ord) AS source_column, max_by(confidence, map_ord) AS confidence, max_by(reasoning, map_ord) AS reasoning FROM mapping WHERE target_field IS NOT NULL GROUP BY doc_id, target_field"


# Checks of a mapping: duplicates are demoted first, then each check adds issues.
def adjusted(d: Spark) -> str:
    """Mappings after demotion and type penalties, with what their samples look like; ``adj``."""
    kinds = " ".join(f"WHEN {lit(f)} THEN {lit(k)}" for f, k, _ in schema.TARGET_FIELDS)
    blank = fn.blank(d, "raw_value")
    sample = fn.strip(d, "raw_value")
    share = lambda p: f"coalesce(avg(CASE WHEN row_index >= 10 OR {blank} THEN NULL WHEN {d.matches(sample, p)} THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 0) >= 0.6"
    return f"""WITH kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id, coalesce(target_field, 'none ' || source_column) ORDER BY confidence DESC, map_ord) AS nth FROM mapping),
        one AS (SELECT doc_id, map_ord, source_column, CASE WHEN nth = 1 THEN target_field END AS target_field, CASE WHEN nth = 1 THEN confidence ELSE confidence * 0.3 END AS confidence FROM kept),
        look AS (SELECT doc_id, source_column, count(CASE WHEN row_index < 10 THEN raw_value END) AS n_samples,
                     {share(NUMERIC)} AS looks_numeric, {share(WHOLE)} AS looks_whole,
                     coalesce(max(CASE WHEN row_index < 10 AND {d.matches('raw_value', COMBINED)} THEN 1 ELSE 0 END), 0) = 1 AS any_combined
                 FROM raw_cell GROUP BY doc_id, source_column),
        typed AS (SELECT o.*, CASE target_field {kinds} END AS kind, coalesce(n_samples, 0) AS n_samples, coalesce(looks_numeric, false) AS looks_numeric, coalesce(looks_whole, false) AS looks_whole, coalesce(any_combined, false) AS any_combined
                  FROM one o LEFT JOIN look l ON o.doc_id = l.doc_id AND o.source_column = l.source_column),
        adj AS (SELECT *, kind = 'integer' AND n_samples > 0 AND NOT looks_whole AND NOT looks_numeric AS bad_integer, kind = 'decimal' AND n_samples > 0 AND NOT looks_numeric AND NOT (target_field IN ({DIMENSIONS}) AND any_combined) AS bad_decimal FROM typed),
        scored AS (SELECT *, greatest(confidence - CASE WHEN bad_integer THEN 0.15 WHEN bad_decimal THEN 0.1 ELSE 0.0 END, CAST(0 AS DOUBLE)) AS checked FROM adj)"""


@query("mapping_type_check", "mapping", "raw_cell")
def mapping_type_check(d: Spark) -> str:
    """Integer and decimal fields whose samples do not look it; a combined dimension is no type error."""
    return f"{adjusted(d)} SELECT doc_id, source_column, target_field, 'error' AS severity, looks_numeric, looks_whole, round(1e-9 + checked, 6) AS confidence FROM scored WHERE bad_integer OR bad_decimal"


@query("mapping_low_confidence", "mapping", "raw_cell")
def mapping_low_confidence(d: Spark) -> str:
    return f"{adjusted(d)} SELECT doc_id, source_column, target_field, 'warning' AS severity, round(1e-9 + checked, 6) AS confidence FROM scored WHERE target_field IS NOT NULL AND checked < 0.3"


@query("mapping_single_dimension", "mapping", "raw_cell")
def mapping_single_dimension(d: Spark) -> str:
    """One dimension mapped with confidence: its source holds all of them, most likely."""
    return f"{adjusted(d)} SELECT doc_id, min(source_column) AS source_column, min(target_field) AS target_field, 'warning' AS severity FROM scored WHERE target_field IN ({DIMENSIONS}) GROUP BY doc_id HAVING count(*) = 1 AND min(checked) > 0.8"


@query("mapping_count_ambiguity", "mapping", "raw_cell")
def mapping_count_ambiguity(d: Spark) -> str:
    """Design Count from a quantity column while a header speaks of spares and Spare Count is unmapped."""
    design = "CASE WHEN target_field = 'Design Count' THEN source_column END"
    return f"""WITH h AS (SELECT doc_id, max(CASE WHEN {d.matches('source_column', SPARE)} THEN 1 ELSE 0 END) AS spare_like, max({design}) AS source_column, max(CASE WHEN target_field = 'Spare Count' THEN 1 ELSE 0 END) AS spare_mapped FROM mapping GROUP BY doc_id)
        SELECT doc_id, source_column, 'Design Count' AS target_field, 'error' AS severity FROM h WHERE spare_like = 1 AND spare_mapped = 0 AND {d.matches('source_column', QUANTITY)}"""


@query("mapping_part_number_swap", "mapping")
def mapping_part_number_swap(d: Spark) -> str:
    return f"""SELECT doc_id, source_column, target_field, 'error' AS severity FROM mapping
        WHERE (target_field = 'Customer Part Number' AND {d.matches('source_column', MAKER)}) OR (target_field = 'Manufacturer part no.' AND {d.matches('source_column', CUSTOMER)})"""


@query("mapping_material_codes", "mapping", "raw_cell")
def mapping_material_codes(d: Spark) -> str:
    """Two material numbers or more in the first twenty rows of the material's column: worth a note."""
    each = "LATERAL VIEW explode(codes) e AS code" if d.name == "spark" else ", unnest(codes) AS e(code)"
    return f"""WITH s AS (SELECT r.doc_id, r.source_column, {d.all('raw_value', CODE)} AS codes FROM raw_cell r JOIN mapping m ON r.doc_id = m.doc_id AND r.source_column = m.source_column WHERE target_field = 'Material' AND row_index < 20 AND raw_value IS NOT NULL)
        SELECT doc_id, source_column, 'info' AS severity, count(DISTINCT code) AS n_codes FROM s {each} GROUP BY doc_id, source_column HAVING count(DISTINCT code) >= 2"""


@query("mapping_evidence_boost", "mapping", "raw_cell")
def mapping_evidence_boost(d: Spark) -> str:
    """Confidence lifted where the values prove the field; a lone combined dimension also serves the axes that lack a source."""
    names = ", ".join(lit(k) for k, _ in schema.alias_rows("material"))
    material = f"(lower({fn.clean_text(d, 'raw_value')}) IN ({names}) OR {fn.material_number(d, 'raw_value')} IS NOT NULL OR ({fn.stripped_material_number(d, 'raw_value')}) IS NOT NULL)"
    axes = ", ".join(f"({lit(f)})" for f in schema.DIMENSION_FIELDS)
    filled = f"NOT {fn.blank(d, 'raw_value')}"
    return f"""WITH s AS (SELECT doc_id, source_column, {_share(d, f'coalesce({material}, false)')} AS material_share, {_share(d, d.matches('raw_value', COMBINED))} AS dimension_share FROM raw_cell WHERE {filled} GROUP BY doc_id, source_column),
        m AS (SELECT g.doc_id, map_ord, g.source_column, target_field, confidence, coalesce(CASE WHEN target_field = 'Material' THEN material_share WHEN target_field IN ({DIMENSIONS}) THEN dimension_share END, 0) AS evidence FROM mapping g LEFT JOIN s ON g.doc_id = s.doc_id AND g.source_column = s.source_column),
        b AS (SELECT *, CASE WHEN evidence >= {MIN_EVIDENCE} THEN greatest(confidence, CAST({BOOST} AS DOUBLE)) ELSE confidence END AS boosted FROM m),
        lone AS (SELECT doc_id, max(source_column) AS source_column, max(target_field) AS has, max(boosted) AS boosted FROM b WHERE target_field IN ({DIMENSIONS}) GROUP BY doc_id HAVING count(DISTINCT target_field) = 1 AND max(evidence) >= {MIN_EVIDENCE})
        SELECT doc_id, source_column, target_field, round(1e-9 + boosted, 6) AS confidence, round(1e-9 + evidence, 6) AS evidence, 'mapped' AS origin FROM b
        UNION ALL SELECT doc_id, source_column, axis, round(1e-9 + boosted, 6), CAST(0 AS DOUBLE), 'dimension split component' FROM lone CROSS JOIN (VALUES {axes}) AS a(axis) WHERE axis <> has"""


@query("mapping_consensus", "mapping")
def mapping_consensus(d: Spark) -> str:
    """A second opinion: an unknown field is ignored, another one or none caps the confidence and is noted."""
    known = ", ".join(lit(f) for f, _, _ in schema.TARGET_FIELDS)
    other = "CASE (doc_id + map_ord) % 6 WHEN 0 THEN 'Special Notes' WHEN 1 THEN 'No such field' WHEN 2 THEN NULL ELSE target_field END"
    differs = f"(other IS NULL OR (other IN ({known}) AND other <> target_field))"
    return f"""WITH o AS (SELECT *, {other} AS other FROM mapping), x AS (SELECT *, target_field IS NOT NULL AND {differs} AS differs FROM o)
        SELECT doc_id, source_column, target_field, CASE WHEN differs THEN least(confidence, CAST({CONSENSUS_CAP} AS DOUBLE)) ELSE confidence END AS confidence,
               reasoning || CASE WHEN NOT differs THEN '' WHEN other IS NULL THEN ' [second opinion: none]' ELSE ' [second opinion: ' || other || ']' END AS reasoning, sum(CASE WHEN differs THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id) AS n_differ FROM x"""


@query("mapping_samples", "raw_cell")
def mapping_samples(d: Spark) -> str:
    """What a mapper is shown of a column: its first five values, a hundred characters each."""
    cut = f"substr({fn.strip(d, 'raw_value')}, 1, 100)"
    rows = f"SELECT doc_id, source_column, col_ord, row_index, {cut} AS v FROM raw_cell WHERE row_index < 5 AND NOT {fn.blank(d, 'raw_value')}"
    ordered = "array_join(transform(array_sort(collect_list(struct(row_index, v))), x -> x.v), ' | ')" if d.name == "spark" else "string_agg(v, ' | ' ORDER BY row_index)"
    return f"SELECT doc_id, source_column, min(col_ord) AS col_ord, {ordered} AS samples FROM ({rows}) r GROUP BY doc_id, source_column"


# Columns by name, and rows and cells judged by their columns' kinds.
@query("column_roles", "mapping")
def column_roles(d: Spark) -> str:
    """The document's anchor and position column (the first that fits), and whether any is there."""
    bare, low = d.replace("lower(source_column)", r"\s+"), "lower(source_column)"
    anchor, position = _any_word(d, "bare", ANCHOR_WORDS), _any_word(d, "low", POSITION_WORDS)
    return f"""WITH h AS (SELECT doc_id, map_ord, source_column, {bare} AS bare, {low} AS low FROM mapping)
        SELECT doc_id, min_by(source_column, CASE WHEN {anchor} THEN map_ord END) AS anchor_column, min_by(source_column, CASE WHEN {position} THEN map_ord END) AS position_column FROM h GROUP BY doc_id"""


def bare_name(d: Spark, x: str) -> str:
    return d.replace(f"lower(trim({x}))", r"\.+$")


def column_kind(d: Spark, x: str, bare: str | None = None) -> str:
    """Semantic type of a column by its name, or by its bare name where that is a column already; the first that fits."""
    name = bare or bare_name(d, x)
    fits = " ".join(f"WHEN {_any_word(d, name, words)} THEN '{kind}'" for kind, words in TYPE_WORDS.items())
    return f"(CASE WHEN {name} IN ({', '.join(map(lit, TYPE_EXCLUSIONS))}) THEN NULL {fits} END)"


@query("column_types", "mapping")
def column_types(d: Spark) -> str:
    """Types of columns, and whether a column can be verified: typed, or with a digit in its name."""
    kind = column_kind(d, "source_column")
    return f"SELECT DISTINCT source_column, {kind} AS kind, {kind} IS NOT NULL OR {d.matches('source_column', '[0-9]')} AS verifiable FROM mapping"


@query("plausibility_flags", "raw_cell")
def plausibility_flags(d: Spark) -> str:
    """Each finding about a cell of a typed column: range, length, forbidden text, pattern, digits of a dimension's parts."""
    v = fn.strip(d, "raw_value")
    whole = d.matches("v", r"^[-+]?[0-9]{1,18}$")
    n = f"CASE WHEN {whole} THEN TRY_CAST(v AS BIGINT) END"
    flags = []
    for kind, (low, high, length) in RANGES.items():
        flags += [(kind, "n IS NULL", "not an integer"), (kind, f"n < {low}", f"below {low}"), (kind, f"n > {high}", f"above {high}")]
        if length:
            flags.append((kind, f"length(v) > {length}", f"longer than {length}"))
    for kind, parts in FORBIDDEN.items():
        flags.append((kind, _any_word(d, "v", parts), "text of another column"))
    for kind, pattern in EXPECTED.items():
        flags.append((kind, f"NOT {d.matches('v', pattern)}", "no expected pattern"))
    flags.append(("dimensions", "n_parts >= 2 AND (most - least >= 2 OR (most >= 3 AND least <= 2 AND n_long >= 2))", "digits of the parts differ"))
    digits = d.keep(d.map_each(d.split("v", r"[xX×*]"), f"length({d.extract(fn.strip(d, 'v'), '^[0-9]+', 0)})"), "v > 0")
    if d.name == "spark":
        # Names, kinds and flags are columns that later ones read. There is no filter on the kind and no inner explode:
        # both would be pushed down with a second copy of all that they rest on.
        kinds = " ".join(f"WHEN '{kind}' THEN {d.compact(d.array(*[f'CASE WHEN {c} THEN {lit(m)} END' for k, c, m in flags if k == kind]))}" for kind in dict.fromkeys(k for k, _, _ in flags))
        return f"""WITH c AS (SELECT doc_id, row_index, source_column, {bare_name(d, 'source_column')} AS bare, {v} AS v FROM raw_cell WHERE NOT {fn.blank(d, 'raw_value')}),
            k AS (SELECT *, {column_kind(d, 'source_column', 'bare')} AS kind FROM c),
            t AS (SELECT *, CASE WHEN kind IN ({', '.join(map(lit, RANGES))}) THEN {n} END AS n, CASE WHEN kind = 'dimensions' THEN {digits} END AS parts FROM k),
            x AS (SELECT *, {d.size('parts')} AS n_parts, array_min(parts) AS least, array_max(parts) AS most, {d.size(d.keep('parts', 'v >= 3'))} AS n_long FROM t),
            f AS (SELECT doc_id, row_index, source_column, CASE kind {kinds} END AS flags FROM x)
            SELECT doc_id, row_index, 'PLAUS:' || source_column || ': ' || flag AS flag FROM f LATERAL VIEW OUTER explode(flags) e AS flag WHERE flag IS NOT NULL"""
    each = [f"CASE WHEN kind = '{k}' AND ({c}) THEN {lit(m)} END" for k, c, m in flags]
    low, high = "list_min(parts)", "list_max(parts)"
    out = ", unnest(flags) AS e(flag)"
    return f"""WITH c AS (SELECT doc_id, row_index, source_column, {column_kind(d, 'source_column')} AS kind, {v} AS v FROM raw_cell WHERE NOT {fn.blank(d, 'raw_value')}),
        t AS (SELECT *, {n} AS n, {digits} AS parts FROM c WHERE kind IS NOT NULL),
        x AS (SELECT *, {d.size('parts')} AS n_parts, {low} AS least, {high} AS most, {d.size(d.keep('parts', 'v >= 3'))} AS n_long FROM t),
        f AS (SELECT doc_id, row_index, source_column, {d.compact(d.array(*each))} AS flags FROM x)
        SELECT doc_id, row_index, 'PLAUS:' || source_column || ': ' || flag AS flag FROM f {out}"""


@query("non_data_rows", "raw_cell")
def non_data_rows(d: Spark) -> str:
    """Tags of rows that hold no part: the anchor holds no position, and the text is a footer's or the row is nearly empty. Rows are never dropped."""
    filled = f"NOT {fn.blank(d, 'raw_value')}"
    anchor = _any_word(d, d.replace("lower(source_column)", r"\s+"), ANCHOR_WORDS)
    v = f"CASE WHEN {filled} THEN {fn.strip(d, 'raw_value')} END"
    ordered = "array_join(transform(array_sort(collect_list(CASE WHEN v IS NOT NULL THEN struct(col_ord, v) END)), x -> x.v), ' ')" if d.name == "spark" else "coalesce(string_agg(v, ' ' ORDER BY col_ord), '')"
    footer = " OR ".join(d.matches("joined", p) for p in FOOTERS)
    return f"""WITH c AS (SELECT doc_id, row_index, col_ord, raw_value, {v} AS v, {anchor} AS is_anchor FROM raw_cell),
        r AS (SELECT doc_id, row_index, {ordered} AS joined, count(v) AS n_filled, max(CASE WHEN is_anchor THEN 1 ELSE 0 END) = 1 AS has_anchor, min_by(raw_value, CASE WHEN is_anchor THEN col_ord END) AS anchor FROM c GROUP BY doc_id, row_index),
        t AS (SELECT doc_id, row_index, joined <> '' AND ({footer} OR (n_filled <= 1 AND {d.matches('joined', PAGE_RATIO)})) AS footer, has_anchor AND n_filled <= 1 AS sparse FROM r WHERE NOT (has_anchor AND coalesce({fn.position_like(d, 'anchor')}, false)))
        SELECT doc_id, row_index, 'NO_POSITION' || CASE WHEN footer THEN ',FOOTER_OR_HEADER_TEXT' ELSE '' END || CASE WHEN sparse THEN ',SPARSE_ROW' ELSE '' END AS flags FROM t WHERE footer OR sparse"""


@query("page_anomalies", "raw_cell")
def page_anomalies(d: Spark) -> str:
    """Pages of thirty rows of which more than half lack more than half of the columns."""
    return f"""WITH r AS (SELECT doc_id, row_index, sum(CASE WHEN {fn.blank(d, 'raw_value')} THEN 1 ELSE 0 END) * 2 > count(*) AS poor FROM raw_cell GROUP BY doc_id, row_index)
        SELECT doc_id, CAST(floor(row_index / 30) AS BIGINT) AS page, sum(CASE WHEN poor THEN 1 ELSE 0 END) AS poor_rows, sum(CASE WHEN poor THEN 1 ELSE 0 END) * 2 > count(*) AS anomalous FROM r GROUP BY doc_id, CAST(floor(row_index / 30) AS BIGINT)"""


# Sheets: a title, a header row and data, cell by cell.
SHEET = """sheet AS (SELECT doc_id, CAST(0 AS BIGINT) AS r, CAST(0 AS BIGINT) AS c, 'Projekt ' || CAST(doc_id AS {string}) AS text, false AS is_number FROM (SELECT DISTINCT doc_id FROM mapping) q
        UNION ALL SELECT doc_id, CAST(1 + doc_id % 2 AS BIGINT), map_ord, source_column, false FROM mapping
        UNION ALL SELECT doc_id, row_index + 2 + doc_id % 2, CAST(col_ord AS BIGINT), raw_value, {whole} FROM raw_cell)"""


@query("sheet_header", "mapping", "raw_cell")
def sheet_header(d: Spark) -> str:
    """Header row of a sheet (most texts, three more for each header word, in the first twenty rows; the first of equals) and the row where data starts."""
    whole = f"coalesce({d.matches('raw_value', '^[0-9]+$')}, false)"
    return f"""WITH {SHEET.format(string=d.string, whole=whole)},
        s AS (SELECT doc_id, r, sum(CASE WHEN NOT is_number AND length(trim(text)) > 1 THEN 1 ELSE 0 END) + 3 * sum(CASE WHEN {_any_word(d, 'lower(text)', HEADER_WORDS)} THEN 1 ELSE 0 END) AS score, max(CASE WHEN is_number THEN 1 ELSE 0 END) AS numbers, count(text) AS n FROM sheet WHERE r < 40 GROUP BY doc_id, r),
        h AS (SELECT doc_id, max_by(r, score * 100 - r) AS header_row FROM s WHERE r < 20 GROUP BY doc_id)
        SELECT h.doc_id, header_row + 1 AS header_row, coalesce(min(CASE WHEN s.r > header_row AND s.r <= header_row + 5 AND numbers = 1 AND n >= 2 THEN s.r END), header_row + 1) + 1 AS data_start FROM h JOIN s ON h.doc_id = s.doc_id GROUP BY h.doc_id, header_row"""


@query("text_columns", "doc_line")
def text_columns(d: Spark) -> str:
    """Text without a table: the first line that two blanks or more cut into several parts names the columns of the lines after it."""
    parts = d.keep(d.map_each(d.split(d.replace("line", r"([a-z]) ([a-z])", "#1  #2"), r"\s{2,}"), "trim(v)"), "v <> ''")
    each = "LATERAL VIEW posexplode(names) e AS k, name" if d.name == "spark" else ", (SELECT unnest(range(100)) AS k) e"
    name, value = ("name", "get(p, k)") if d.name == "spark" else ("list_extract(names, k + 1)", "list_extract(p, k + 1)")
    more = "" if d.name == "spark" else "AND k < len(names)"
    return f"""WITH p AS (SELECT doc_id, line_index, {parts} AS p FROM doc_line WHERE line <> ''), h AS (SELECT doc_id, min(line_index) AS head, min_by(p, line_index) AS names FROM p WHERE {d.size('p')} >= 2 GROUP BY doc_id),
        j AS (SELECT p.doc_id, line_index, p, names FROM p JOIN h ON p.doc_id = h.doc_id AND line_index > head)
        SELECT doc_id, line_index, CAST(k AS BIGINT) AS col, {name} AS header, {value} AS value FROM j {each} WHERE {value} IS NOT NULL {more}"""
