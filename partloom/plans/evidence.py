"""Queries over evidence: locations, tokens, counter-checks, two extractions, text layers."""

from __future__ import annotations

from ..functions import scalar as fn
from ..functions.dialect import Spark, lit
from .queries import query

QUANTITIES = "'Design Count', 'Spare Count'"


# Locations and what is extracted there.
@query("source_locations", "mapping", "raw_cell", "location")
def source_locations(d: Spark) -> str:
    """Extraction for each mapped cell: the location of its column, by exact name or else regardless of case; confidence by kind and path."""
    uncertain = "l.match_type = 'column_boundary'"
    base = "CASE l.match_type WHEN 'column_corridor' THEN 0.98 WHEN 'column_estimate' THEN 0.88 WHEN 'row_fallback' THEN 0.82 ELSE 0.72 END"
    text_path = f"least(CAST(CASE WHEN r.doc_id % 10 = 4 THEN 0.86 ELSE 0.95 END AS DOUBLE), CAST(CASE WHEN {uncertain} THEN 0.68 ELSE 1.0 END AS DOUBLE))"
    none = "CASE WHEN r.doc_id % 9 = 0 THEN 'no_pdf_source' WHEN r.doc_id % 8 = 0 THEN 'no_pdf_text_layer' WHEN l.text IS NULL OR trim(l.text) = '' THEN 'no_coordinate_match' END"
    return f"""WITH lower_first AS (SELECT doc_id, row_index, lower(source_column) AS low, min_by(text, source_column) AS text, min_by(match_type, source_column) AS match_type, min_by(page, source_column) AS page FROM location GROUP BY doc_id, row_index, lower(source_column)),
        l0 AS (SELECT r.doc_id, r.row_index, m.target_field, r.source_column, lower(r.source_column) AS low FROM raw_cell r JOIN mapping m ON r.doc_id = m.doc_id AND r.source_column = m.source_column WHERE m.target_field IS NOT NULL),
        l1 AS (SELECT a.*, e.text AS t1, e.match_type AS k1, e.page AS p1 FROM l0 a LEFT JOIN location e ON a.doc_id = e.doc_id AND a.row_index = e.row_index AND a.source_column = e.source_column),
        l AS (SELECT a.doc_id, a.row_index, a.target_field, a.source_column, coalesce(t1, f.text) AS text, coalesce(k1, f.match_type) AS match_type, coalesce(p1, f.page) AS page FROM l1 a LEFT JOIN lower_first f ON a.doc_id = f.doc_id AND a.row_index = f.row_index AND a.low = f.low),
        x AS (SELECT r.*, {none.replace('l.', 'r.')} AS why, CASE WHEN r.doc_id % 2 = 0 THEN {text_path.replace('l.', 'r.')} ELSE CAST({base.replace('l.', 'r.')} AS DOUBLE) END AS sure, {uncertain.replace('l.', 'r.')} AS is_uncertain FROM l r)
        SELECT doc_id, row_index, target_field, why IS NULL AS found, CASE WHEN why IS NULL THEN trim(text) END AS extracted, CASE WHEN why IS NULL THEN sure ELSE CAST(0 AS DOUBLE) END AS confidence,
               coalesce(why, CASE WHEN doc_id % 2 = 1 THEN 'ok' WHEN is_uncertain THEN 'llm_uncertain_field' WHEN doc_id % 10 = 4 THEN 'json_repaired' ELSE 'text_layer_direct' END) AS reason, CASE WHEN why IS NULL THEN page END AS page FROM x"""


@query("counter_check_page", "location")
def counter_check_page(d: Spark) -> str:
    """Page for a counter-check: that of the location, or else what the extraction's description names."""
    described = "'document;page=' || CAST(page + 1 AS STRING) || ';x'"
    return f"WITH l AS (SELECT doc_id, row_index, source_column, CASE WHEN row_index % 3 = 1 THEN NULL ELSE page END AS page, {described} AS described FROM location) SELECT doc_id, row_index, source_column, coalesce(page, TRY_CAST({d.extract('described', r'(^|;)page=([0-9]+)', 2)} AS BIGINT)) AS page FROM l"


@query("anchor_contexts", "bom_src", "doc_line")
def anchor_contexts(d: Spark) -> str:
    """For each row, the line of its document that names its position and description as whole tokens, with the lines around it."""
    w = "OVER (PARTITION BY doc_id ORDER BY line_index)"
    core = lambda x: fn.alnum(d, f"lower({x})")
    return f"""WITH l AS (SELECT doc_id, line_index, line, trim(coalesce(lag(line) {w}, '') || ' ' || line || ' ' || coalesce(lead(line) {w}, '')) AS context FROM doc_line),
        a AS (SELECT doc_id, row_index, trim(coalesce(Pos, '') || ' ' || Benennung) AS anchor FROM bom_src WHERE Benennung <> ''), p AS (SELECT *, {fn.anchor_pattern(d, 'anchor')} AS pattern, length({core('anchor')}) AS size FROM a),
        j AS (SELECT p.doc_id, p.row_index, size, line_index, context FROM p JOIN l ON p.doc_id = l.doc_id WHERE {fn.found(d, 'l.line', 'p.pattern')})
        SELECT doc_id, row_index, max(size) AS anchor_length, min(line_index) AS line_index, min_by(context, line_index) AS context FROM j GROUP BY doc_id, row_index"""


@query("text_confirms_value", "bom_src")
def text_confirms_value(d: Spark) -> str:
    """Whether a row's text holds a value as whole tokens; digits alone confirm from four on."""
    core = fn.alnum(d, "lower(v)")
    return f"""WITH v AS (SELECT doc_id, row_index, trim(Werkstoff) AS v, coalesce(Pos, '') || ' | ' || coalesce(Werkstoff, '') || ' | ' || coalesce(Haerte, '') AS text FROM bom_src WHERE NOT {fn.blank(d, 'Werkstoff')}
            UNION ALL SELECT doc_id, row_index, trim(Menge), coalesce(Pos, '') || ' ' || coalesce(Masse, '') FROM bom_src WHERE NOT {fn.blank(d, 'Menge')}),
        p AS (SELECT *, {core} AS core, {fn.anchor_pattern(d, 'v')} AS pattern FROM v)
        SELECT doc_id, row_index, v, core <> '' AND NOT ({d.matches('core', '^[0-9]{1,3}$')}) AND coalesce({fn.found(d, 'text', 'pattern')}, false) AS confirmed, length(core) >= 6 AS strong FROM p"""


@query("quantity_after_anchor", "bom_src")
def quantity_after_anchor(d: Spark) -> str:
    """Quantity in the text after a row's anchor: only if one distinct candidate beside the anchor is there."""
    tokens = d.split("rest", r"[\s|]+")
    numbers = d.compact(d.map_each(tokens, fn.quantity(d, "v")))
    one = d.distinct_sorted(d.keep("numbers", "anchor IS NULL OR v <> anchor"))
    return f"""WITH t AS (SELECT doc_id, row_index, {fn.quantity(d, 'Pos')} AS anchor, Benennung || ' ' || coalesce(Menge, '') || ' | ' || coalesce(Reserve, '') AS rest FROM bom_src), n AS (SELECT doc_id, row_index, anchor, {numbers} AS numbers FROM t), o AS (SELECT doc_id, row_index, numbers, {one} AS kept FROM n)
        SELECT doc_id, row_index, {d.size('numbers')} AS n_candidates, CASE WHEN {d.size('kept')} = 1 THEN {d.item('kept', 0)} END AS quantity FROM o"""


# Tokens and forms of values.
@query("numeric_tokens", "bom_src")
def numeric_tokens(d: Spark) -> str:
    return f"SELECT doc_id, row_index, Laenge AS raw, {fn.numeric_token(d, 'Laenge')} AS value, {fn.page_quantity(d, 'Menge')} AS page_quantity FROM bom_src"


@query("verification_tokens", "raw_cell")
def verification_tokens(d: Spark) -> str:
    """Tokens by which a cell is looked for: numbers of positions, quantities and dimensions, else words of two characters or more; the text itself if there are none."""
    from .mappings import column_kind

    numbers, words = d.all("v", r"[0-9]+(?:[.,][0-9]+)?"), d.keep(d.all("t", r"[A-Za-z0-9.\-]+"), "length(v) >= 2")
    return f"""WITH c AS (SELECT doc_id, row_index, source_column, {column_kind(d, 'source_column')} AS kind, {fn.strip(d, 'raw_value')} AS v, {fn.strip(d, 'raw_value')} AS t FROM raw_cell WHERE NOT {fn.blank(d, 'raw_value')}),
        k AS (SELECT *, CASE WHEN kind IN ('position', 'quantity', 'dimensions') THEN {numbers} ELSE {words} END AS tokens FROM c)
        SELECT doc_id, row_index, source_column, CASE WHEN {d.size('tokens')} = 0 THEN t ELSE {d.join('tokens', ';')} END AS tokens FROM k"""


@query("header_variants", "mapping")
def header_variants(d: Spark) -> str:
    """Bare forms under which a header is recognised: of the whole name and of its parts of two characters or more."""
    bare = d.replace("lower(trim(v))", "[^a-z0-9]")
    parts = d.keep(d.map_each(d.split("source_column", "[^A-Za-z0-9]+"), bare), "length(v) >= 2")
    whole = d.replace("lower(trim(source_column))", "[^a-z0-9]")
    both = f"concat(array({whole}), {parts})" if d.name == "spark" else f"list_concat([{whole}], {parts})"
    return f"SELECT DISTINCT source_column, {d.join(d.distinct_sorted(d.keep(both, chr(118) + ' <> ' + lit(''))), ';')} AS variants FROM mapping"


@query("detail_number_in_row", "bom_src")
def detail_number_in_row(d: Spark) -> str:
    """Whether a row's text proves a position: without separators, by its digits, or by all of its parts."""
    bare = lambda x: d.replace(f"lower({x})", r"[_\-.\s]")
    parts = d.keep(d.map_each(d.split("p", r"[_\-.\s]+"), "lower(v)"), "v <> ''")
    missing = d.size(d.keep("parts", f"NOT {d.contains('row_bare', 'v')}"))
    return f"""WITH t AS (SELECT doc_id, row_index, Pos AS p, Benennung || ' ' || coalesce(Masse, '') || ' ' || coalesce(Menge, '') AS text FROM bom_src WHERE NOT {fn.blank(d, 'Pos')}),
        b AS (SELECT *, {bare('p')} AS bare, {bare('text')} AS row_bare, {d.replace('p', '[^0-9]')} AS digits, {d.replace('text', '[^0-9]')} AS row_digits, {parts} AS parts FROM t)
        SELECT doc_id, row_index, p, (bare <> '' AND {d.contains('row_bare', 'bare')}) OR (digits <> '' AND {d.contains('row_digits', 'digits')}) OR ({d.size('parts')} >= 2 AND {missing} = 0) AS proven FROM b"""


@query("values_equivalent", "ev")
def values_equivalent(d: Spark) -> str:
    """Whether two extractions of a cell agree: equal forms, equal numbers, and outside critical columns long bare forms or four fifths of the tokens."""
    words = lambda x: d.distinct_sorted(d.all(x, "[a-z0-9]+"))
    number = lambda x: f"CASE WHEN {d.matches(x, r'^[-+]?[0-9]+([.][0-9]+)?$')} THEN TRY_CAST({x} AS DOUBLE) END"
    common = d.size("array_intersect(wa, wb)" if d.name == "spark" else "list_intersect(wa, wb)")
    long = "(length(la) >= 6 AND length(lb) >= 6 AND (" + d.contains("la", "lb") + " OR " + d.contains("lb", "la") + "))"
    near = f"({d.size('wa')} > 0 AND {d.size('wb')} > 0 AND {common} * 5 >= greatest({d.size('wa')}, {d.size('wb')}) * 4)"
    return f"""WITH f AS (SELECT doc_id, row_index, field, {fn.dual_form(d, "coalesce(value, '')")} AS a, {fn.dual_form(d, "coalesce(extracted, '')")} AS b, field IN ('Detail Number', {QUANTITIES}) AS critical FROM ev WHERE field IN ('Detail Number', 'Design Count', 'Description', 'Material')),
        w AS (SELECT *, {words('a')} AS wa, {words('b')} AS wb, {fn.alnum(d, 'a')} AS la, {fn.alnum(d, 'b')} AS lb, {number('a')} AS na, {number('b')} AS nb FROM f)
        SELECT doc_id, row_index, field, a, b, CASE WHEN a = b THEN true WHEN a = '' OR b = '' THEN false WHEN na IS NOT NULL AND nb IS NOT NULL THEN abs(na - nb) <= 1e-6 WHEN critical THEN false ELSE {long} OR {near} END AS equivalent FROM w"""


# Text layers.
@query("layout_scaffold", "doc_line")
def layout_scaffold(d: Spark) -> str:
    """Lines of a layout-aware text layer without the marks of rows and columns; empty ones and page breaks go."""
    marked = "CASE line_index % 5 WHEN 4 THEN '--- PAGE BREAK ---' ELSE 'ROW ' || CAST(100 + line_index AS STRING) || ': [x=10-' || CAST(line_index AS STRING) || '] ' || line || ' || [x=90-120]  -' END"
    bare = f"trim({d.replace('replace(' + d.replace(d.replace('m', r'(?i)^ROW\s+[0-9]+\s*:\s*'), r'\[\s*x\s*=\s*-?[0-9]+\s*-\s*-?[0-9]+\s*\]', ' ') + ', ' + lit('||') + ', ' + lit(' ') + ')', r'\s+', ' ')})"
    return f"WITH l AS (SELECT doc_id, line_index, {marked} AS m FROM doc_line), b AS (SELECT doc_id, line_index, {bare} AS line FROM l WHERE m <> '--- PAGE BREAK ---') SELECT doc_id, line_index, line FROM b WHERE line <> ''"


@query("text_layer_pages", "doc_line")
def text_layer_pages(d: Spark) -> str:
    """The text of a document as one layer with page breaks, and the pages it falls into again; blank pages count for nothing."""
    broken = "line || CASE WHEN line_index % 3 = 2 THEN chr(10) || '--- PAGE BREAK ---' ELSE '' END"
    layer = f"array_join(transform(array_sort(collect_list(struct(line_index, {broken} AS t))), x -> x.t), chr(10))" if d.name == "spark" else f"string_agg({broken}, chr(10) ORDER BY line_index)"
    pages = d.keep(d.map_each(d.split("layer || chr(10)", r"\n\s*--- PAGE BREAK ---\s*\n"), "trim(v)"), "trim(replace(v, chr(10), '')) <> ''")
    return f"WITH t AS (SELECT doc_id, {layer} AS layer FROM doc_line GROUP BY doc_id) SELECT doc_id, {d.size(pages)} AS n_pages, length(layer) AS n_chars FROM t"


@query("block_text", "doc_line")
def block_text(d: Spark) -> str:
    """A block's lines with single blanks, lines equal to the one before left out, joined by slashes."""
    marked = "line || chr(10) || '  ' || line || chr(10) || chr(10) || upper(line)"
    lines = d.keep(d.map_each(d.split("block", r"\n"), f"trim({d.replace('v', r'\s+', ' ')})"), "v <> ''")
    if d.name == "spark":
        once = "filter(lines, (v, i) -> i = 0 OR v <> get(lines, i - 1))"
    else:
        once = "list_filter(lines, lambda v, i: i = 1 OR v <> list_extract(lines, i - 1))"
    return f"WITH b AS (SELECT doc_id, line_index, {marked} AS block FROM doc_line), l AS (SELECT doc_id, line_index, {lines} AS lines FROM b) SELECT doc_id, line_index, {d.join(once, ' / ')} AS text FROM l"


# Counter-checks and reasons.
@query("counter_check_verdicts", "ev")
def counter_check_verdicts(d: Spark) -> str:
    """Answers of a counter-check as JSON, parsed and compared; what is no JSON or has an unknown status is ambiguous."""
    n = "((doc_id + row_index + field_ord) % 6)"
    seen = "CASE WHEN extracted IS NULL THEN 'null' ELSE '\"' || replace(replace(extracted, '\\\\', ''), '\"', '') || '\"' END" if d.name == "spark" else "CASE WHEN extracted IS NULL THEN 'null' ELSE '\"' || replace(replace(extracted, '\\', ''), '\"', '') || '\"' END"
    answer = f"CASE {n} WHEN 0 THEN 'no json' WHEN 1 THEN '{{\"status\": \"odd\", \"observed_value\": ' || {seen} || '}}' WHEN 2 THEN '{{\"status\": \"not_found\"}}' ELSE '{{\"status\": \" Found \", \"observed_value\": ' || {seen} || ', \"confidence\": 1.5}}' END"
    get = (lambda k: f"get_json_object(answer, '$.{k}')") if d.name == "spark" else (lambda k: f"CASE WHEN json_valid(answer) THEN json_extract_string(answer, '$.{k}') END")
    status = f"lower(trim(coalesce({get('status')}, 'ambiguous')))"
    return f"""WITH a AS (SELECT doc_id, row_index, field, value, {answer} AS answer FROM ev WHERE field IN ('Design Count', 'Material') AND value IS NOT NULL),
        p AS (SELECT doc_id, row_index, field, value, CASE WHEN {status} IN ('found', 'ambiguous', 'not_found') THEN {status} ELSE 'ambiguous' END AS status, nullif(trim({get('observed_value')}), '') AS observed, coalesce(greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), TRY_CAST({get('confidence')} AS DOUBLE))), CAST(0 AS DOUBLE)) AS confidence FROM a)
        SELECT doc_id, row_index, field, status, observed, confidence, status = 'found' AND coalesce({fn.counter_form(d, 'observed')} = {fn.counter_form(d, 'value')}, false) AND value <> '' AS passed FROM p"""


@query("finish_against_rough", "bom_src")
def finish_against_rough(d: Spark) -> str:
    """A finished dimension larger than the rough one of its axis contradicts engineering."""
    axis = lambda a: f"SELECT doc_id, row_index, '{a}' AS axis, {d.number(fn.dimension(d, 'Masse', a))} AS finish, CAST(l_partkey % 60 AS DOUBLE) AS rough FROM bom_src"
    return f"WITH d AS ({' UNION ALL '.join(axis(a) for a in 'xyz')}) SELECT doc_id, row_index, axis, finish, rough, 'error' AS severity FROM d WHERE finish > rough"


@query("row_positions", "raw_cell", "mapping")
def row_positions(d: Spark) -> str:
    """Position of a row: of the fields that may carry one, the first that is not empty."""
    p = fn.position(d, "raw_value")
    return f"""WITH c AS (SELECT r.doc_id, r.row_index, m.target_field, {p} AS p FROM raw_cell r JOIN mapping m ON r.doc_id = m.doc_id AND r.source_column = m.source_column WHERE m.target_field IN ('Detail Number', 'Position'))
        SELECT doc_id, row_index, coalesce(max(CASE WHEN target_field = 'Detail Number' THEN nullif(p, '') END), max(CASE WHEN target_field = 'Position' THEN nullif(p, '') END), '') AS position FROM c GROUP BY doc_id, row_index"""


@query("cell_reasoning", "ev")
def cell_reasoning(d: Spark) -> str:
    """The decision about a cell in one line."""
    from .queries import facts

    two = (lambda x: f"format_string('%.2f', {x})") if d.name == "spark" else (lambda x: f"printf('%.2f', {x})")
    return f"""{facts(d)} SELECT doc_id, row_index, field, 'Decision=' || class || ' | CHECK3=' || result || ' | Detail=' || detail || ' | Check2Conf=' || {two('extraction_confidence')} || ' | Check2Reason=' || reason || ' | CandidateConf=' || {two('mapping_confidence')} || CASE WHEN blocking THEN ' | Blocking=1' ELSE '' END AS reasoning FROM verified WHERE field = 'Material'"""
