"""Comparators of mapped values with independently extracted ones.

Result, strictness and detail of a comparison are one chain of conditions per field
group; the first that holds decides. Inputs are in comparison form (:func:`norm`).
"""

from __future__ import annotations

from ..functions import scalar as fn
from ..functions.dialect import Spark, lit
from . import schema
from .transform import lookup

Outcome = list[tuple[str, str, bool, str]]  # condition, result, strict, detail

DIMENSIONS = tuple(schema.DIMENSION_FIELDS)
QUANTITIES = ("Design Count", "Spare Count")
TRUE_WORDS = ("yes", "ja", "si", "oui", "ano", "1", "true", "x")
FALSE_WORDS = ("no", "nein", "non", "ne", "0", "false", "-", "")
Stage = dict[str, str]


def norm(d: Spark, x: str) -> str:
    """Comparison form: single blanks, lower case; no value is ''. Input is in NFKC form, see ``udfs.fold``."""
    return f"lower({fn.clean_text(d, x)})"


def _words(d: Spark, x: str) -> str:
    return d.replace(d.replace(x, r"[\s\-_/]+", " "), "[^a-z0-9 .,]", " ")


def features(d: Spark) -> list[Stage]:
    """Columns that the comparators read, in stages, from value, extracted, field and extraction_confidence; each only for its fields."""
    only = lambda fields, e: f"CASE WHEN field IN ({', '.join(map(lit, fields))}) THEN {e} END"
    sizes = (*DIMENSIONS, "Nitriding depth")
    out: list[Stage] = [{"m": norm(d, "value"), "e": norm(d, "extracted")}]
    two: Stage = {}
    for k in ("m", "e"):
        two |= {
            f"{k}_alnum": fn.alnum(d, k),
            f"{k}_words": f"CASE WHEN match_type = 'row_fallback' OR field IN ('Customer Part Number', 'Description') THEN {_words(d, k)} END",
            f"{k}_int": only(QUANTITIES, f"(CASE WHEN {d.matches(f'replace({k}, {lit(" ")}, {lit("")})', r'^[-+]?[0-9]+$')} THEN TRY_CAST(replace({k}, ' ', '') AS BIGINT) END)"),
            f"{k}_dec": only(sizes, fn.comparable_decimal(d, k)),
            f"{k}_core": only(DIMENSIONS, d.replace(d.replace(d.replace(k, "[ø⌀]"), r"\b(mm|zu)\b"), r"[^0-9,.\-+]")),
            f"{k}_qty": only(QUANTITIES, fn.quantity(d, k)),
            f"{k}_main": only(("Detail Number",), fn.strip(d, d.item(d.split(k, r"[-.]"), 0))),
            f"{k}_hard": only(("Hardness",), fn.hardness_cores(d, k)),
            f"{k}_nr": only(("Material",), f"nullif({d.extract(k, r'([0-9])[.-]([0-9]{4})', 1)} || '.' || {d.extract(k, r'([0-9])[.-]([0-9]{4})', 2)}, '.')"),
            f"{k}_desc": only(("Description",), d.replace(d.replace(k, r"\bdin\s*[-_/]*\s*", "din"), "[^a-z0-9]")),
            f"{k}_bool": only(schema.BOOLEAN_FIELDS, f"(CASE WHEN {k} IN ({', '.join(map(lit, TRUE_WORDS))}) THEN 1 WHEN {k} IN ({', '.join(map(lit, FALSE_WORDS))}) THEN 0 END)"),
            f"{k}_coat": only(("Coating",), f"coalesce({lookup(d, k, _low('coating'))}, {k})"),
            f"{k}_nit": only(("Nitriding type",), f"coalesce({lookup(d, k, _low('nitriding'))}, {k})"),
            f"{k}_maker": only(("Manufacturer",), f"coalesce({lookup(d, k, _low('manufacturer'))}, {k})"),
            f"{k}_grp": only(("Parts Group",), f"coalesce({lookup(d, k, [(g.lower(), g.lower()) for g in schema.PART_GROUPS])}, {k})"),
        }
    two["nums"] = only(DIMENSIONS, fn.dimension_numbers(d, "e"))
    out.append(two)
    at = " ".join(f"WHEN {lit(f)} THEN {d.item('nums', i)}" for i, f in enumerate(DIMENSIONS))
    number = lambda k: f"CASE WHEN {d.matches(k, r'^[-+]?[0-9]+$')} THEN CAST(TRY_CAST({k} AS BIGINT) AS STRING) ELSE {k} END"
    out.append({
        "m_cdec": fn.comparable_decimal(d, "m_core"), "e_cdec": fn.comparable_decimal(d, "e_core"), "at_place": f"TRY_CAST(CASE field {at} END AS DOUBLE)", "many": f"{d.size('nums')} >= 2",
        "in_row": d.contains("(' ' || e_words || ' ')", "(' ' || m_words || ' ')"), "m_no": number("m_main"), "e_no": number("e_main"), "same_hard": f"coalesce({d.overlap('m_hard', 'e_hard')}, false)", "sure": "extraction_confidence >= 0.9",
    })
    return out


def _low(catalog: str) -> list[tuple[str, str]]:
    return [(k, v.lower()) for k, v in schema.alias_rows(catalog)]


GENERIC: Outcome = [("m = e", "MATCH", True, "exact normalized match"), ("m_alnum = e_alnum", "MATCH", False, "semantic equivalent (format normalization)")]
DIFFER = ("true", "MISMATCH", False, "normalized values differ")

# Comparators: conditions over the feature columns in order.
ROW_CONTAINMENT: Outcome = [
    ("m = e", "MATCH", True, "exact normalized match"),
    ("e = ''", "UNCERTAIN", False, "row text empty"),
    ("in_row AND length(m_alnum) >= 6", "MATCH", True, "value confirmed within its row"),
    ("in_row", "UNCERTAIN", False, "present but too weak to confirm"),
    ("true", "UNCERTAIN", False, "not confirmable in row text"),
]
INTEGER: Outcome = [("m_int IS NULL OR e_int IS NULL", "UNCERTAIN", False, "integer not parseable"), ("m_int = e_int", "MATCH", True, "integer match"), ("true", "MISMATCH", False, "integer mismatch")]
DECIMAL: Outcome = [("m_dec IS NULL OR e_dec IS NULL", "UNCERTAIN", False, "decimal not parseable"), ("abs(m_dec - e_dec) <= 0.001", "MATCH", True, "decimal match"), ("true", "MISMATCH", False, "decimal mismatch")]
BOOLEAN: Outcome = [("m_bool IS NULL OR e_bool IS NULL", "UNCERTAIN", False, "boolean not parseable"), ("m_bool = e_bool", "MATCH", True, "boolean match"), ("true", "MISMATCH", False, "boolean mismatch")]
COATING: Outcome = [("m_coat = e_coat AND m = e", "MATCH", True, "alias match"), ("m_coat = e_coat", "MATCH", False, "alias match"), *GENERIC, DIFFER]
NITRIDING: Outcome = [("m_nit = e_nit AND m = e", "MATCH", True, "alias match"), ("m_nit = e_nit", "MATCH", False, "alias match"), *GENERIC, DIFFER]
MANUFACTURER: Outcome = [("m_maker = e_maker AND m = e", "MATCH", True, "alias match"), ("m_maker = e_maker", "MATCH", False, "alias match"), *GENERIC, DIFFER]
PARTS_GROUP: Outcome = [("m_grp = e_grp AND m = e", "MATCH", True, "alias match"), ("m_grp = e_grp", "MATCH", False, "alias match"), *GENERIC, DIFFER]
MATERIAL: Outcome = [*GENERIC, ("coalesce(m_nr = e_nr, false)", "MATCH", True, "same material number"), DIFFER]
HARDNESS: Outcome = [*GENERIC, ("same_hard", "MATCH", True, "same hardness value"), DIFFER]
DETAIL_NUMBER: Outcome = [*GENERIC, ("sure AND m_main <> '' AND e_main <> '' AND m_no = e_no", "MATCH", True, "main position match"), DIFFER]
QUANTITY: Outcome = [*GENERIC, ("sure AND m_qty = e_qty", "MATCH", True, "quantity match"), ("sure AND m_qty IS NOT NULL AND e_qty IS NOT NULL", "MISMATCH", False, "quantity mismatch"), DIFFER]
DIMENSION: Outcome = [
    ("coalesce(abs(m_dec - e_dec) <= 0.001, false)", "MATCH", True, "decimal match"),
    ("coalesce(abs(m_cdec - e_cdec) <= 0.001, false) AND sure", "MATCH", True, "dimension match"),
    ("coalesce(abs(m_cdec - e_cdec) > 0.001, false) AND NOT many", "MISMATCH", False, "dimension mismatch"),
    ("many AND coalesce(abs(m_dec - at_place) > 0.001, false)", "MISMATCH", False, "component contradicts its place"),
    ("many AND coalesce(abs(m_dec - at_place) <= 0.001, false) AND sure", "MATCH", True, "component matches its place"),
    ("m_dec IS NULL OR e_dec IS NULL", "UNCERTAIN", False, "decimal not parseable"),
    ("true", "MISMATCH", False, "decimal mismatch"),
]


def description(d: Spark) -> Outcome:
    near = f"(m_desc = e_desc OR (length(m_desc) >= 12 AND {d.contains('e_desc', 'm_desc')}) OR (length(e_desc) >= 12 AND {d.contains('m_desc', 'e_desc')}))"
    return [*GENERIC, (f"sure AND m_desc <> '' AND e_desc <> '' AND {near}", "MATCH", True, "description core match"), DIFFER]


PART_NUMBER: Outcome = [("in_row AND sure AND length(m_alnum) >= 6 AND m <> e", "MATCH", False, "verified in the document's text"), *GENERIC, DIFFER]


def rules(d: Spark) -> list[tuple[tuple[str, ...], Outcome]]:
    """(fields, comparator); any other field is compared as text."""
    return [
        (("Detail Number",), DETAIL_NUMBER),
        (DIMENSIONS, DIMENSION),
        (("Description",), description(d)),
        (QUANTITIES, QUANTITY),
        (("Nitriding depth",), DECIMAL),
        (schema.BOOLEAN_FIELDS, BOOLEAN),
        (("Coating",), COATING),
        (("Nitriding type",), NITRIDING),
        (("Manufacturer",), MANUFACTURER),
        (("Parts Group",), PARTS_GROUP),
        (("Material",), MATERIAL),
        (("Hardness",), HARDNESS),
        (("Customer Part Number",), PART_NUMBER),
    ]


def outcome(d: Spark) -> str:
    """'RESULT|strict|detail' of a comparison over the feature columns: the common cases, then the field's comparator."""
    text = lambda c: lit(f"{c[1]}|{str(c[2]).lower()}|{c[3]}")
    chain = lambda cs: "CASE " + " ".join(f"WHEN {c[0]} THEN {text(c)}" for c in cs) + " END"
    fields = " ".join(f"WHEN field IN ({', '.join(map(lit, fs))}) THEN {chain(cs)}" for fs, cs in rules(d))
    return (
        f"CASE WHEN m = '' AND e = '' THEN 'NOT_APPLICABLE|false|both values empty' WHEN match_type = 'row_fallback' AND m <> '' THEN {chain(ROW_CONTAINMENT)} "
        f"WHEN e = '' THEN 'UNCERTAIN|false|missing independent extraction' WHEN m = '' THEN 'MISMATCH|false|mapped value empty but value present' {fields} ELSE {chain([*GENERIC, DIFFER])} END"
    )


def compared_stages(d: Spark) -> list[Stage]:
    if d.name == "spark":
        parted = {"result": "substring_index(o, '|', 1)", "strict": d.contains("o", lit("|true|")), "detail": "substring_index(o, '|', -1)"}
    else:
        parts = d.split("o", r"[|]")
        parted = {"result": d.item(parts, 0), "strict": f"{d.item(parts, 1)} = 'true'", "detail": d.item(parts, 2)}
    return [*features(d), {"o": outcome(d)}, parted]


def category(field: str) -> str:
    values = lambda xs: ", ".join(map(lit, xs))
    return f"CASE WHEN {field} IN ({values(schema.CATEGORY_A)}) THEN 'A' WHEN {field} IN ({values(schema.CATEGORY_B)}) THEN 'B' ELSE 'C' END"
