"""Scalar normalisers and parsers for cells of part lists, as SQL expressions.

Each function takes a dialect and the SQL of its input, and returns the SQL of its
result. Null, empty and blank inputs are "no value" and give null unless said otherwise.
"""

from __future__ import annotations

from .dialect import Spark, lit

# Number pattern, dimension separators, units and yes/no words of the data model.
NUM = r"[0-9]+(?:[.,][0-9]+)?"
SEP = r"\s*[xX×*/]\s*"
DIM3 = rf"[Øø]?\s*({NUM}){SEP}({NUM}){SEP}({NUM})"
DIM2 = rf"[Øø]?\s*({NUM}){SEP}({NUM})"
DIAMETER = rf"[Øø]\s*({NUM})"
PURE_DIM = rf"^\s*[Øø]?\s*{NUM}{SEP}{NUM}(?:{SEP}{NUM})?\s*(?:mm|MM)?\s*$"
INCH = r"(?i)[\"”]|inch|in\b|zoll"
UNIT = r"HRC|HRc|Hrc|hrc|HB|HBW|HV|Hv|N/mm[²2]|MPa"
TRUE_WORDS = ("yes", "ja", "si", "oui", "ano", "1", "true", "x", "y")
FALSE_WORDS = ("no", "nein", "non", "ne", "0", "false", "-", "n")
DASH_NUMBER, MATERIAL_NUMBER = r"([0-9])[–-]([0-9]{4})", r"(?i)([0-9]\.[0-9]{4})\s*(ESU|ESR)?"
STRICT_DASH, STRICT_NUMBER = r"\b([0-9])[–-]([0-9]{4})\b", r"\b[0-9]\.[0-9]{4}\b"
STRIPPED_NUMBER = r"^([12])([0-9]{4})[A-Za-z]?$"
WEIGHT_FACTORS = {"kg": 1.0, "g": 0.001, "lbs": 0.453592, "lb": 0.453592, "oz": 0.0283495}


def _in(x: str, words: tuple[str, ...]) -> str:
    return f"({x} IN ({', '.join(map(lit, words))}))"


def strip(d: Spark, x: str) -> str:
    return d.strip(x)


def blank(d: Spark, x: str) -> str:
    return f"(coalesce({strip(d, x)}, '') = '')"


def collapse(d: Spark, x: str) -> str:
    """White space to single blanks, trimmed; blank to null."""
    return f"nullif(trim({d.single_blanks(x)}), '')"


def clean_text(d: Spark, x: str) -> str:
    """White space to single blanks, trimmed; no value to ''. Input is in NFKC form (see ``udfs.nfkc``)."""
    return f"coalesce({collapse(d, x)}, '')"


def catalog_key(d: Spark, x: str) -> str:
    return f"lower({clean_text(d, x)})"


def alnum(d: Spark, x: str) -> str:
    """Lower-case a-z and digits only; letters outside a-z vanish."""
    return d.only(f"lower(coalesce({x}, ''))", "a-z0-9")


def decimal_point(d: Spark, x: str) -> str:
    return f"replace({strip(d, x)}, ',', '.')"


def _first(d: Spark, x: str, p: str, group: int) -> str:
    return f"nullif({d.extract(x, p, group)}, '')"


def dimension(d: Spark, x: str, axis: str) -> str:
    """Component x, y or z of a dimension text as a number with a point."""
    three, two = d.matches(x, DIM3), d.matches(x, DIM2)
    g = "xyz".index(axis) + 1
    cases = f"WHEN {three} THEN {d.extract(x, DIM3, g)} "
    if axis != "z":
        cases += f"WHEN {two} THEN {d.extract(x, DIM2, g)} "
    if axis == "x":
        cases += f"WHEN {d.matches(x, DIAMETER)} THEN {d.extract(x, DIAMETER, 1)} WHEN {d.matches(x, NUM)} THEN {d.extract(x, NUM, 0)} "
    return f"replace(CASE {cases}END, ',', '.')"


def is_inch(d: Spark, x: str) -> str:
    return f"coalesce({d.matches(x, INCH)} AND NOT {blank(d, x)}, false)"


def is_pure_dimension(d: Spark, x: str) -> str:
    return f"coalesce({d.matches(x, PURE_DIM)}, false)"


def inch_to_mm(d: Spark, x: str) -> str:
    """A number of inches in millimetres, one decimal unless integral; another text unchanged."""
    n = d.number(decimal_point(d, x))
    mm = f"(({n}) * 25.4)"
    one = f"format('{{:.1f}}', {mm})" if d.name == "duck" else f"format_string('%.1f', {mm})"
    return f"CASE WHEN ({n}) IS NULL THEN {x} WHEN {mm} = floor({mm}) THEN {d.whole(mm)} ELSE {one} END"


def fmt_num(d: Spark, x: str) -> str:
    return f"CASE WHEN {x} = floor({x}) THEN {d.whole(x)} ELSE {d.fmt_g(x)} END"


def hardness(d: Spark, x: str) -> str:
    """Canonical hardness: a+-b and a+b as a range, a-b, a single value with its unit; else the text."""
    x = strip(d, x)
    unit = f"CASE WHEN {d.matches(x, UNIT)} THEN CASE WHEN upper({d.extract(x, UNIT, 0)}) = 'HBW' THEN 'HB' ELSE upper({d.extract(x, UNIT, 0)}) END ELSE 'HRC' END"
    num = lambda p, g: f"CAST(replace(nullif({d.extract(x, p, g)}, ''), ',', '.') AS DOUBLE)"
    pm, plus, rng, one = (rf"({NUM})\s*{s}\s*({NUM})" for s in ("[±]", "[+]", "[-–]", ""))
    one = rf"({NUM})\s*(?:{UNIT})"
    a, b = num(pm, 1), num(pm, 2)
    c, e = num(plus, 1), num(plus, 2)
    first = rf"({NUM})\s*({UNIT})"
    own = f"upper({d.extract(x, first, 2)})"
    return (
        f"CASE WHEN {blank(d, x)} THEN NULL "
        f"WHEN {d.matches(x, pm)} THEN {fmt_num(d, f'({a} - {b})')} || '-' || {fmt_num(d, f'({a} + {b})')} || ' ' || {unit} "
        f"WHEN {d.matches(x, plus)} THEN {fmt_num(d, c)} || '-' || {fmt_num(d, f'({c} + {e})')} || ' ' || {unit} "
        f"WHEN {d.matches(x, rng)} THEN {fmt_num(d, num(rng, 1))} || '-' || {fmt_num(d, num(rng, 2))} || ' ' || {unit} "
        f"WHEN {d.matches(x, one)} THEN {fmt_num(d, num(one, 1))} || ' ' || {own} "
        f"ELSE {x} END"
    )


def hardness_stages(d: Spark, x: str, name: str) -> list[dict[str, str]]:
    """:func:`hardness` of a column without outer white space, as stages of columns that end in ``{name}_v``."""
    sign = lambda s: rf"{NUM}\s*{s}\s*{NUM}"
    single = rf"{NUM}\s*(?:{UNIT})"
    part = " ".join(f"WHEN {d.matches(x, p)} THEN {d.extract(x, p, 0)}" for p in (sign("[±]"), sign("[+]"), sign("[-–]"), single))
    t, num = f"{name}_t", lambda p: f"CAST(replace(nullif({d.extract(f'{name}_t', p, 1)}, ''), ',', '.') AS DOUBLE)"
    unit = f"upper({d.extract(x, UNIT, 0)})"
    one = {t: f"CASE {part} END", f"{name}_u": f"CASE WHEN {unit} = '' THEN 'HRC' WHEN {unit} = 'HBW' THEN 'HB' ELSE {unit} END"}
    two = {f"{name}_a": num(rf"^({NUM})"), f"{name}_op": d.extract(t, rf"^{NUM}\s*([±+–-])", 1), f"{name}_b": num(rf"[±+–-]\s*({NUM})$"), f"{name}_own": f"upper({d.extract(t, UNIT, 0)})"}
    a, b = f"{name}_a", f"{name}_b"
    three = {f"{name}_lo": f"CASE WHEN {name}_op = '±' THEN {a} - {b} ELSE {a} END", f"{name}_hi": f"CASE WHEN {name}_op IN ('±', '+') THEN {a} + {b} ELSE {b} END"}
    lo, hi = fmt_num(d, f"{name}_lo"), fmt_num(d, f"{name}_hi")
    value = f"CASE WHEN coalesce({x}, '') = '' THEN NULL WHEN {t} IS NULL THEN {x} WHEN {name}_op = '' THEN {lo} || ' ' || {name}_own ELSE {lo} || '-' || {hi} || ' ' || {name}_u END"
    return [one, two, three, {f"{name}_v": value}]


def coerce_integer(d: Spark, x: str) -> str:
    """Number with point or comma, blanks dropped, cut toward zero."""
    n = d.number(f"replace(replace({strip(d, x)}, ',', '.'), ' ', '')")
    return f"CASE WHEN ({n}) IS NOT NULL THEN {d.whole(d.trunc(f'({n})'))} END"


def coerce_decimal(d: Spark, x: str) -> str:
    """Decimal text with a point: of two kinds of separators the last is the decimal one."""
    t = f"replace({strip(d, x)}, ' ', '')"
    last_comma = d.matches(t, r",[^.]*$")
    both = f"({d.contains(t, lit(','))} AND {d.contains(t, lit('.'))})"
    c = f"CASE WHEN {both} AND {last_comma} THEN replace(replace({t}, '.', ''), ',', '.') WHEN {both} THEN replace({t}, ',', '') ELSE replace({t}, ',', '.') END"
    n = f"({d.number(f'({c})')})"
    return f"CASE WHEN {n} IS NULL THEN NULL WHEN {n} = floor({n}) AND NOT {d.contains(x, lit('.'))} AND NOT {d.contains(x, lit(','))} THEN {d.whole(n)} ELSE {d.fmt_g(n)} END"


def yes_no(d: Spark, x: str) -> str:
    low = f"lower({strip(d, x)})"
    return f"CASE WHEN {_in(low, TRUE_WORDS)} THEN 'Yes' WHEN {_in(low, FALSE_WORDS)} THEN 'No' END"


def material_number(d: Spark, x: str) -> str:
    """First number such as 1.2343, or 1-2343, with its suffix ESU or ESR."""
    t = d.replace(x, DASH_NUMBER, "#1.#2")
    return f"nullif(trim({d.extract(t, MATERIAL_NUMBER, 1)} || ' ' || {d.extract(t, MATERIAL_NUMBER, 2)}), '')"


def primary_material_number(d: Spark, x: str) -> str:
    return f"nullif({d.extract(d.replace(x, STRICT_DASH, '#1.#2'), STRICT_NUMBER, 0)}, '')"


def stripped_material_number(d: Spark, x: str) -> str:
    t = strip(d, x)
    return f"CASE WHEN {d.matches(t, STRIPPED_NUMBER)} THEN {d.extract(t, STRIPPED_NUMBER, 1)} || '.' || {d.extract(t, STRIPPED_NUMBER, 2)} END"


def hardness_in_material(d: Spark, x: str) -> str:
    p1, p2 = rf"(?i)({NUM})\s*([+±])\s*({NUM})\s*(HRC|HB|HBW)", rf"(?i)({NUM})\s*[-–]\s*({NUM})\s*(HRC|HB|HBW)"
    e = lambda p, g: d.extract(x, p, g)
    return f"CASE WHEN {d.matches(x, p1)} THEN {e(p1, 1)} || {e(p1, 2)} || {e(p1, 3)} || ' ' || upper({e(p1, 4)}) WHEN {d.matches(x, p2)} THEN {e(p2, 1)} || '-' || {e(p2, 2)} || ' ' || upper({e(p2, 3)}) END"


def nitriding_depth(d: Spark, x: str) -> str:
    t = strip(d, x)
    rng, one = r"([0-9]+[.,]?[0-9]*)\s*[-–]\s*([0-9]+[.,]?[0-9]*)", r"\.?[0-9]+[.,]?[0-9]*"
    f = f"CASE WHEN {d.matches(t, r'(?i)[\"”]|inch')} THEN 25.4 ELSE 1.0 END"
    n = lambda p, g: f"(CAST(replace(nullif({d.extract(t, p, g)}, ''), ',', '.') AS DOUBLE) * CAST({f} AS DOUBLE))"
    return f"CASE WHEN {blank(d, x)} THEN NULL WHEN {d.matches(t, rng)} THEN {d.fmt_g(n(rng, 1))} || '-' || {d.fmt_g(n(rng, 2))} || ' mm' WHEN {d.matches(t, one)} THEN {d.fmt_g(n(one, 0))} || ' mm' ELSE {t} END"


def weight_unit(d: Spark, x: str) -> str:
    low = f"lower({x})"
    has = lambda s: d.contains(low, lit(s))
    return f"CASE WHEN {blank(d, x)} THEN NULL WHEN {has('lb')} THEN 'lbs' WHEN {has('oz')} THEN 'oz' WHEN {has('g')} AND NOT {has('kg')} THEN 'g' ELSE 'kg' END"


def weight_kg(d: Spark, x: str) -> str:
    n = f"CAST(replace(nullif({d.extract(x, r'[0-9]+[.,]?[0-9]*', 0)}, ''), ',', '.') AS DOUBLE)"
    factor = " ".join(f"WHEN '{u}' THEN {f}" for u, f in WEIGHT_FACTORS.items())
    return f"CASE WHEN ({n}) IS NOT NULL THEN {d.fmt_g(f'({n} * CAST(CASE {weight_unit(d, x)} {factor} ELSE 1.0 END AS DOUBLE))')} END"


def position(d: Spark, x: str) -> str:
    """Canonical position: upper case, tight dashes, no leading zeros, no .0; no value gives ''."""
    t = f"upper(trim({d.replace(f'coalesce({x}, {lit("")})', r'\s+', ' ')}))"
    t = d.replace(t, r"\s*-\s*", "-")
    t = d.replace(t, r"^([0-9]+)\.0+$", "#1")
    return d.replace(t, r"^0+([0-9]+)$", "#1")


def quantity(d: Spark, x: str) -> str:
    """Whole quantity of a text that is nothing else, its sign dropped."""
    p = r"(?i)^\s*[-+]?([0-9]{1,4})(?:[.,]0+)?(?:\s*(?:stk|stck|pcs|pc|ea|x))?\s*$"
    return f"TRY_CAST(nullif({d.extract(x, p, 1)}, '') AS INTEGER)"


def comparable_decimal(d: Spark, x: str) -> str:
    t = f"replace(replace({strip(d, x)}, ' ', ''), ',', '.')"
    return f"CASE WHEN {d.matches(t, r'^[-+]?[0-9]*\.?[0-9]+$')} THEN TRY_CAST({t} AS DOUBLE) END"


def material_family(d: Spark, x: str) -> str:
    t = catalog_key(d, x)
    any_of = lambda *ks: "(" + " OR ".join(d.contains(t, lit(k)) for k in ks) + ")"
    number = d.matches(d.replace(t, STRICT_DASH, "#1.#2"), STRICT_NUMBER)
    return f"CASE WHEN {any_of('stahl', 'steel')} OR {number} THEN 'steel' WHEN {any_of('aluminium', 'aluminum', 'alu', 'alsi')} THEN 'aluminium' WHEN {any_of('kunststoff', 'plastic', 'polymer', 'pa6', 'pom', 'peek')} THEN 'plastic' WHEN {any_of('kupfer', 'copper', 'cube', 'ampcoloy')} THEN 'copper' ELSE '' END"


def density(d: Spark, x: str) -> str:
    low = f"lower({x})"
    any_of = lambda *ks: "(" + " OR ".join(d.contains(low, lit(k)) for k in ks) + ")"
    return f"CASE WHEN {any_of('alu', 'alsi')} THEN 2.7 WHEN {any_of('cu', 'kupfer', 'copper', 'be-cu', 'beryllium')} THEN 8.9 WHEN {any_of('stahl', 'steel', 'h13', 'p20', '1.', 'dievar')} THEN 7.8 END"


def first_number(d: Spark, x: str) -> str:
    return f"CAST(replace(nullif({d.extract(x, NUM, 0)}, ''), ',', '.') AS DOUBLE)"


def hardness_low(d: Spark, x: str, group: int = 1) -> str:
    p = rf"({NUM})\s*[-–]\s*({NUM})"
    return f"CASE WHEN {d.matches(x, p)} THEN CAST(replace(nullif({d.extract(x, p, group)}, ''), ',', '.') AS DOUBLE) ELSE {first_number(d, x)} END"


def hardness_high(d: Spark, x: str) -> str:
    return hardness_low(d, x, 2)


def hardness_cores(d: Spark, x: str) -> str:
    """Ranges of a hardness text without units; else its numbers."""
    t = d.replace(f"replace(coalesce({x}, ''), ',', '.')", r"(?i)\b(hrc|hrb|hb|hv|rc|n\s*/?\s*mm.?|rm)\b|±|\+/-", " ")
    ranges = d.all(t, r"[0-9]+(?:\.[0-9]+)?\s*[-–]\s*[0-9]+(?:\.[0-9]+)?")
    tight = d.map_each(ranges, d.replace("v", r"\s+"))
    return f"CASE WHEN {d.size(ranges)} > 0 THEN {tight} ELSE {d.all(t, r'[0-9]+(?:\.[0-9]+)?')} END"


def dimension_numbers(d: Spark, x: str) -> str:
    return d.all(f"replace(coalesce({x}, ''), ',', '.')", r"[0-9]+(?:\.[0-9]+)?")


def position_like(d: Spark, x: str) -> str:
    return f"coalesce({d.matches(strip(d, x), r'^[A-Za-z]?[0-9]+(?:[.\-/_][0-9]+)*[A-Za-z]?$')}, false)"


def clamp(x: str) -> str:
    return f"greatest(0.0, least(1.0, coalesce({x}, 0.0)))"


def anchor_pattern(d: Spark, x: str) -> str:
    """A pattern that finds a value as whole tokens, whatever separates its parts; nothing but separators gives null."""
    parts = f"trim({d.replace(x, r'[-_/\s]+', ' ')})"
    escaped = d.replace(parts, r"([.^$|()\[\]{}*+?\\#&~])", r"\\#1")
    body = f"replace({escaped}, ' ', {d.pattern(r'[\s\-_/]*')})"
    return f"(CASE WHEN {parts} <> '' THEN {d.pattern(r'(?i)(^|[^A-Za-z0-9])')} || {body} || {d.pattern(r'($|[^A-Za-z0-9])')} END)"


def found(d: Spark, text: str, pattern: str) -> str:
    """Whether a pattern that is a value of the row stands in a text."""
    return f"({text} RLIKE {pattern})" if d.name == "spark" else f"regexp_matches({text}, {pattern})"


def numeric_token(d: Spark, x: str) -> str:
    """A plain number with a point; anything else is null."""
    v = strip(d, x)
    return f"(CASE WHEN {d.matches(v, r'^[-+]?[0-9]+([.,][0-9]+)?$')} THEN replace({v}, ',', '.') END)"


def counter_form(d: Spark, x: str) -> str:
    """Form in which a counter-check compares: lower case, single blanks, a lone number with a point."""
    v = f"lower({d.replace(strip(d, x), r'\s+', ' ')})"
    return f"(CASE WHEN {d.matches(v, r'^[-+]?[0-9]+([.,][0-9]+)?$')} THEN replace({v}, ',', '.') ELSE {v} END)"


def page_quantity(d: Spark, x: str) -> str:
    """Whole quantity of a page's text: zeros after a point go, other decimals are none, only digits count."""
    v = d.replace(f"trim({x})", r"([.,])0+\b")
    digits = d.replace(v, r"[^0-9]+")
    return f"(CASE WHEN {d.matches(v, r'[.,][0-9]')} THEN NULL WHEN length({digits}) BETWEEN 1 AND 18 THEN TRY_CAST({digits} AS BIGINT) END)"


def dual_form(d: Spark, x: str) -> str:
    """Form in which two extractions are compared; input without combining marks."""
    v = f"replace({d.replace(f'lower({strip(d, x)})', r'\s+', ' ')}, '×', 'x')"
    return f"(CASE WHEN {d.matches(v, r'^[0-9.,\s+-]+$')} THEN replace({v}, ',', '.') ELSE coalesce({v}, '') END)"
