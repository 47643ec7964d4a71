"""Per-field transform of source cells into the target schema, and its rule score.

Every target field is one CASE over the row's source columns, giving value, confidence
and method, so that a document's thirty cells a row come from one projection without
any join; catalogs are small and folded into the expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as fn
from ..functions.dialect import SPARK, Spark, lit
from . import schema

#: The mapping of the projected part lists: target field to source column. Any other is passed to :func:`transform`, or as a table to :func:`bind`.
MAPPING = {
    "Detail Number": "Pos", "Design Count": "Menge", "Spare Count": "Reserve", "Description": "Benennung", "Dimensions X/D": "Masse", "Dimensions Z": "Laenge",
    "Material": "Werkstoff", "Hardness": "Haerte", "Nitriding": "Nitriert", "Nitriding type": "Nitriertyp", "Nitriding depth": "Nitriertiefe",
    "Coating": "Beschichtung", "Parts Group": "Gruppe", "Manufacturer": "Hersteller",
}
#: Source columns of the projected part lists, in order.
COLUMNS = ("Pos", "Menge", "Reserve", "Benennung", "Masse", "Laenge", "Werkstoff", "Haerte", "Nitriert", "Nitriertyp", "Nitriertiefe", "Beschichtung", "Gruppe", "Hersteller")
FIELD_ORDER = {f: i for i, (f, _, _) in enumerate(schema.TARGET_FIELDS)}
#: Fields that the stages read beside their own columns.
CATALOGED = ("Material", "Hardness", "Nitriding", "Nitriding type", "Nitriding depth", "Coating", "Manufacturer", "Parts Group")
Cell = tuple[str, str, str]
Stage = dict[str, str]


def lookup(d: Spark, key: str, rows: list[tuple[str, str]]) -> str:
    """Canonical form of a key from a catalog of bounded size, else null."""
    by: dict[str, list[str]] = {}
    for k, v in rows:
        by.setdefault(v, []).append(k)
    return "CASE " + " ".join(f"WHEN {key} IN ({', '.join(map(lit, ks))}) THEN {lit(v)}" for v, ks in by.items()) + " END"


def column_of(field: str) -> str:
    """The column of a bound table that holds a target field's source text."""
    return f"f{FIELD_ORDER[field]:02d}"


def bound_columns(mapping: dict[str, str]) -> Stage:
    """Columns f00 to f29 from a wide table: the source text of each target field, null where it is unmapped."""
    return {column_of(f): (quoted(mapping[f]) if f in mapping else "CAST(NULL AS STRING)") for f, _, _ in schema.TARGET_FIELDS}


def quoted(column: str) -> str:
    return column if column.isidentifier() and column.isascii() else f"`{column}`"


def combined_source(d: Spark, mapping: dict[str, str], columns: list[str]) -> list[Stage]:
    """Stages that give ``dim_src``, the text of a document's column of whole dimensions.

    If all mapped dimension fields share one source, that is it. Else the values decide: the
    first column that is unmapped or a dimension's, of whose values two and half are whole
    dimensions, or else the first other one with three and seven tenths.
    """
    sources = {mapping[f] for f in schema.DIMENSION_FIELDS if f in mapping}
    if len(sources) == 1:
        return [{"dim_src": quoted(sources.pop())}]
    over = "OVER (PARTITION BY doc_id)"
    counts: Stage = {}
    for i, c in enumerate(columns):
        pure = fn.is_pure_dimension(d, quoted(c))
        counts |= {f"n_{i}": f"sum(CASE WHEN NOT {fn.blank(d, quoted(c))} THEN 1 ELSE 0 END) {over}", f"p_{i}": f"sum(CASE WHEN {pure} THEN 1 ELSE 0 END) {over}"}
    taken = set(mapping.values())
    low = [i for i, c in enumerate(columns) if c not in taken or c in sources]
    pick = [f"WHEN p_{i} >= 2 AND p_{i} * 2 >= n_{i} THEN {quoted(columns[i])}" for i in low]
    pick += [f"WHEN p_{i} >= 3 AND p_{i} * 10 >= n_{i} * 7 THEN {quoted(columns[i])}" for i in range(len(columns)) if i not in low]
    return [counts, {"dim_src": f"CASE {' '.join(pick)} END"}]


def stages(d: Spark, present: tuple[str, ...] = tuple(FIELD_ORDER)) -> list[Stage]:
    """Intermediate columns of a bound row, in stages, so that no expression is written out twice. Fields that
    are not ``present`` have no source in any row."""
    one: Stage = {"dim_s": fn.strip(d, "dim_src")}
    for field in present:
        k = column_of(field)
        one |= {f"{k}_s": fn.strip(d, k), f"{k}_c": fn.clean_text(d, k)}
    one |= {f"{column_of(f)}_{x}": "CAST(NULL AS STRING)" for f in CATALOGED if f not in present for x in "sc"}
    material, hardness, nitriding, nit_type, depth = (column_of(f) for f in ("Material", "Hardness", "Nitriding", "Nitriding type", "Nitriding depth"))
    one |= {
        "mat_no": fn.primary_material_number(d, material), "mat_any": fn.material_number(d, material), "mat_stripped": fn.stripped_material_number(d, material), "hard_in": fn.hardness_in_material(d, material),
        "dx": fn.dimension(d, "dim_src", "x"), "dy": fn.dimension(d, "dim_src", "y"), "dz": fn.dimension(d, "dim_src", "z"), "inch": fn.is_inch(d, "dim_src"), "hard_unit": d.matches(hardness, fn.UNIT),
        "nit_v": fn.yes_no(d, nitriding), "depth_v": fn.nitriding_depth(d, depth),
    }
    one |= {f"{column_of(f)}_i": fn.coerce_integer(d, column_of(f)) for f, kind, _ in schema.TARGET_FIELDS if kind == "integer" and f in present}
    one |= {f"{column_of(f)}_d": fn.coerce_decimal(d, column_of(f)) for f, kind, _ in schema.TARGET_FIELDS if kind == "decimal" and f in present}
    numbers = [(n, name) for n, name, _, _, _ in schema.MATERIALS if n]
    hard = fn.hardness_stages(d, f"{hardness}_s", "hard") + [{"hard_in0": "coalesce(hard_in, '')"}] + fn.hardness_stages(d, "hard_in0", "hard_i")
    two: Stage = {
        "mat_exact": lookup(d, f"lower({material}_c)", schema.alias_rows("material")), "mat_by_no": lookup(d, "mat_no", numbers), "mat_by_any": lookup(d, d.extract("coalesce(mat_any, '')", "^[0-9.]+", 0), numbers),
        "nit_type": lookup(d, f"lower({nit_type}_c)", schema.alias_rows("nitriding")), "coat": lookup(d, f"lower({column_of('Coating')}_c)", schema.alias_rows("coating")),
        "maker": lookup(d, f"lower({column_of('Manufacturer')}_c)", schema.alias_rows("manufacturer")),
        "grp": lookup(d, f"upper({column_of('Parts Group')}_s)", [(g, g) for g in schema.PART_GROUPS]), "depth_p": f"nullif(depth_v, {depth}_s)",
    } | {f"{a}_mm": f"CASE WHEN inch THEN {fn.inch_to_mm(d, a)} ELSE {a} END" for a in ("dx", "dy", "dz")}
    return [one, two, *hard]


def _first(steps: list[tuple[str, str, str, str]], last: Cell) -> Cell:
    case = lambda i, e: "CASE " + " ".join(f"WHEN {s[0]} THEN {s[i]}" for s in steps) + f" ELSE {e} END"
    return case(1, last[0]), case(2, last[1]), case(3, last[2])


def _hit(column: str, conf: str, method: str, value: str | None = None) -> tuple[str, str, str, str]:
    return f"{column} IS NOT NULL", value or column, conf, lit(method)


def field_cell(field: str, kind: str) -> Cell:
    """Value, confidence and method of a field whose source is not blank."""
    k = column_of(field)
    rest = lambda conf: (f"{k}_c", conf, "'passthrough'")
    kept = (f"{k}_s", "0.3", "'passthrough'")
    if field == "Material":
        # Exact alias; number of the catalog; any well-formed number; a number without its point; else the text.
        return _first([_hit("mat_exact", "1.0", "master_data:exact_alias"), _hit("mat_by_no", "1.0", "master_data:werkstoff_nr_extract"), _hit("mat_by_any", "1.0", "master_data:werkstoff_nr_base"), _hit("mat_no", "0.92", "master_data:werkstoff_nr_format"), _hit("mat_stripped", "0.85", "master_data:werkstoff_nr_stripped")], rest("0.5"))
    if field == "Hardness":
        return _first([(f"hard_unit OR hard_v <> {k}_s", "hard_v", "0.9", "'regex_parse'"), _hit("hard_i_v", "0.7", "extracted_from_material")], rest("0.6"))
    if field == "Nitriding":
        return _first([_hit("nit_v", "0.95", "boolean_normalize")], rest("0.5"))
    if field == "Nitriding type":
        return _first([_hit("nit_type", "1.0", "master_data:exact_alias")], rest("0.4"))
    if field == "Nitriding depth":
        return _first([_hit("depth_p", "0.85", "regex_parse")], rest("0.5"))
    if field == "Coating":
        return _first([_hit("coat", "1.0", "master_data:exact_alias")], rest("0.5"))
    if field == "Parts Group":
        return _first([_hit("grp", "1.0", "master_data:exact")], rest("0.4"))
    if field == "Manufacturer":
        return _first([_hit("maker", "1.0", "master_data:exact_alias")], rest("0.5"))
    if kind == "integer":
        return _first([_hit(f"{k}_i", "0.95", "integer_coerce")], kept)
    if kind == "decimal":
        return _first([_hit(f"{k}_d", "0.9", "decimal_coerce")], kept)
    return f"{k}_c", "0.95", f"CASE WHEN {k}_c <> {k}_s THEN 'text_cleanup' ELSE 'passthrough' END"


def cell(field: str, kind: str, present: bool = True) -> tuple[str, str, str, str]:
    """Raw value, transformed value, confidence and method of a target field over the staged columns."""
    k = column_of(field)
    raw_out, value, conf, method = "CAST(NULL AS STRING)", "CAST(NULL AS STRING)", "0.0", "'empty'"
    if present:
        value, conf, method = field_cell(field, kind)
        gone = f"coalesce({k}_s, '') = ''"
        raw_out, value, conf, method = k, f"CASE WHEN {gone} THEN NULL ELSE {value} END", f"CASE WHEN {gone} THEN 0.0 ELSE {conf} END", f"CASE WHEN {gone} THEN 'empty' ELSE {method} END"
    axis = schema.DIMENSION_FIELDS.get(field)
    if axis:
        split = f"coalesce(dim_s, '') <> '' AND d{axis} IS NOT NULL"
        raw_out = f"CASE WHEN {split} THEN dim_src ELSE {raw_out} END"
        value = f"CASE WHEN {split} THEN d{axis}_mm ELSE {value} END"
        conf = f"CASE WHEN {split} THEN CASE WHEN inch THEN 0.9 ELSE 0.95 END ELSE {conf} END"
        method = f"CASE WHEN {split} THEN 'dimension_split' ELSE {method} END"
    return raw_out, value, f"CAST({conf} AS DOUBLE)", method


def rule_score(d: Spark, value: str, kind: str, method: str, severity: str = "'none'") -> str:
    """Rule score of a cell: non-empty .30, type .30, method .25 times its quality, cross-validation up to .15."""
    filled = f"coalesce({d.matches(value, chr(92) + 'S')}, false)"
    whole, real = d.matches(value, r"^\s*[-+]?[0-9]+\s*$"), d.matches(f"replace({value}, {lit(',')}, {lit('.')})", r"^\s*[-+]?[0-9]*\.?[0-9]+\s*$")
    typed = {"'integer'": f"coalesce({whole}, false)", "'decimal'": f"coalesce({real}, false)"}.get(kind, "true")
    if not kind.startswith("'"):
        typed = f"CASE WHEN {kind} = 'integer' THEN coalesce({whole}, false) WHEN {kind} = 'decimal' THEN coalesce({real}, false) ELSE true END"
    quality = f"CASE {method} " + " ".join(f"WHEN {lit(m)} THEN {q}" for m, q in schema.METHOD_QUALITY.items()) + " ELSE 0.5 END"
    cv = f"CASE {severity} WHEN 'error' THEN 0.0 WHEN 'warning' THEN 0.05 ELSE 0.15 END"
    score = f"CAST(CASE WHEN {filled} THEN 0.3 ELSE 0.0 END AS DOUBLE) + CAST(CASE WHEN {typed} THEN 0.3 ELSE 0.0 END AS DOUBLE) + 0.25 * CAST({quality} AS DOUBLE) + CAST({cv} AS DOUBLE)"
    return f"greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), {score}))"


def staged(df: DataFrame, steps: list[Stage]) -> DataFrame:
    for s in steps:
        df = df.withColumns({k: F.expr(e) for k, e in s.items()})
    return df


def staged_sql(relation: str, steps: list[Stage]) -> str:
    sql = f"SELECT * FROM {relation}"
    for s in steps:
        sql = f"SELECT *, {', '.join(f'{e} AS {k}' for k, e in s.items())} FROM ({sql}) s"
    return sql


PARTS = ("field_ord", "field", "kind", "raw_value", "value", "confidence", "method")


def _cells_of(d: Spark, fields: tuple[str, ...] | None, present: tuple[str, ...]) -> list[dict[str, str]]:
    out = []
    for i, (field, kind, _) in enumerate(schema.TARGET_FIELDS):
        if fields is None or field in fields:
            out.append(dict(zip(PARTS, (str(i), lit(field), lit(kind), *cell(field, kind, field in present)), strict=True)))
    return out


def transform_bound(bound: DataFrame, fields: tuple[str, ...] | None = None, present: tuple[str, ...] = tuple(FIELD_ORDER)) -> DataFrame:
    """The target cells of a bound table (doc_id, row_index, f00 to f29, dim_src) in long form; with
    ``fields``, of these alone, and nothing else is computed. Fields that are not ``present`` have no source anywhere."""
    structs = [F.struct(*[F.expr(e).alias(k) for k, e in c.items()]) for c in _cells_of(SPARK, fields, present)]
    return staged(bound, stages(SPARK, present)).select("doc_id", "row_index", F.explode(F.array(*structs)).alias("c")).select("doc_id", "row_index", "c.*")


def transform(wide: DataFrame, mapping: dict[str, str] = MAPPING, fields: tuple[str, ...] | None = None) -> DataFrame:
    """The target cells of a wide table under one mapping of target fields to its columns: thirty a row."""
    columns = [c for c in wide.columns if c in COLUMNS or c in mapping.values()]
    return transform_bound(staged(wide, [bound_columns(mapping), *combined_source(SPARK, mapping, columns)]), fields, tuple(mapping))


def transform_wide(wide: DataFrame, mapping: dict[str, str] = MAPPING) -> DataFrame:
    """One row a source row with the value of each target field (c00 to c29): the pivot, which needs neither cells nor a shuffle."""
    columns = [c for c in wide.columns if c in COLUMNS or c in mapping.values()]
    present = tuple(mapping)
    bound = staged(wide, [bound_columns(mapping), *combined_source(SPARK, mapping, columns)])
    return staged(bound, stages(SPARK, present)).select("doc_id", "row_index", *[F.expr(c["value"]).alias(f"c{i:02d}") for i, c in enumerate(_cells_of(SPARK, None, present))])


def bind(raw_cells: DataFrame, mapping: DataFrame) -> DataFrame:
    """A bound table of documents with any columns: (doc_id, row_index, f00 to f29, dim_src).

    ``raw_cells`` has (doc_id, row_index, col_ord, source_column, raw_value), ``mapping`` (doc_id,
    map_ord, source_column, target_field). The last mapping of a field wins; a field without one is
    null. The combined dimension column follows the rules of :func:`combined_source`.
    """
    last = mapping.where("target_field IS NOT NULL AND coalesce(source_column, '') <> ''").groupBy("doc_id", "target_field").agg(F.max_by("source_column", "map_ord").alias("source_column"))
    dims = tuple(schema.DIMENSION_FIELDS)
    of_doc = last.where(F.col("target_field").isin(*dims)).groupBy("doc_id").agg(F.collect_set("source_column").alias("dims"))
    # A column's values are counted once; documents and their columns are few beside the cells.
    pure = F.expr(fn.is_pure_dimension(SPARK, "raw_value"))
    cols = raw_cells.groupBy("doc_id", "source_column").agg(F.min("col_ord").alias("col_ord"), F.count_if(~F.expr(fn.blank(SPARK, "raw_value"))).alias("n"), F.count_if(pure).alias("pure"))
    taken = last.groupBy("doc_id", "source_column").agg(F.bool_or(F.col("target_field").isin(*dims)).alias("is_dim"), F.lit(True).alias("mapped"))
    cols = cols.join(taken, ["doc_id", "source_column"], "left").join(of_doc, "doc_id", "left")
    free_to_take = F.col("mapped").isNull() | F.col("is_dim")
    tier = F.when((F.size("dims") == 1) & F.col("is_dim"), 0).when((F.coalesce(F.size("dims"), F.lit(0)) == 1), None)
    tier = tier.when(free_to_take & (F.col("pure") >= 2) & (F.col("pure") * 2 >= F.col("n")), 1).when(~free_to_take & (F.col("pure") >= 3) & (F.col("pure") * 10 >= F.col("n") * 7), 2)
    combined = cols.withColumn("tier", tier).where("tier IS NOT NULL").groupBy("doc_id").agg(F.min_by("source_column", F.struct("tier", "col_ord")).alias("dim_column"))
    fields = last.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("target_field", "source_column"))).alias("by_field")).join(combined, "doc_id", "left")
    rows = raw_cells.groupBy("doc_id", "row_index").agg(F.map_from_entries(F.collect_list(F.struct("source_column", "raw_value"))).alias("by_column"))
    x = rows.join(fields, "doc_id", "left")
    got = lambda field: F.try_element_at("by_column", F.try_element_at("by_field", F.lit(field)))
    return x.select("doc_id", "row_index", *[got(f).alias(column_of(f)) for f, _, _ in schema.TARGET_FIELDS], F.try_element_at("by_column", F.col("dim_column")).alias("dim_src"))


def bound_sql(d: Spark, mapping: dict[str, str] = MAPPING, columns: tuple[str, ...] | None = None) -> str:
    """The bound form of ``bom_src`` as SQL."""
    return staged_sql("bom_src", [bound_columns(mapping), *combined_source(d, mapping, list(columns or COLUMNS))])


def transform_sql(d: Spark, bound: str | None = None, present: tuple[str, ...] = tuple(MAPPING)) -> str:
    """The same cells as SQL over ``bom_src`` or a bound relation, for DuckDB."""
    marked = staged_sql(f"({bound or bound_sql(d)}) b", stages(d, present))
    rows = ", ".join("{" + ", ".join(f"'{k}': {e}" for k, e in c.items()) + "}" for c in _cells_of(d, None, present))
    return f"SELECT doc_id, row_index, c.* FROM (SELECT doc_id, row_index, unnest([{rows}]) AS c FROM ({marked}) m) u"
