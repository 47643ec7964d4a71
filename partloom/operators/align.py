"""Order-dependent operators on two extractions, broken JSON and free text."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

FLAGS = "doc_id string, row_index int, source_column string, a string, b string"


def _key(cells: dict[str, str | None], anchor: str | None) -> str:
    text = cells.get(anchor) if anchor else None
    if not text:
        text = "|".join([v for v in cells.values() if v][:2])
    return re.sub("[^a-z0-9]", "", (text or "").lower())


def same_value(a: str | None, b: str | None) -> bool:
    """Equal without white space and case, as numbers, or in letters and digits alone."""
    if a == b:
        return True
    x, y = (" ".join((v or "").lower().replace("×", "x").split()) for v in (a, b))
    if x == y:
        return True
    if not x or not y:
        return False
    try:
        return abs(float(x.replace(",", ".")) - float(y.replace(",", "."))) <= 1e-6
    except ValueError:
        p, q = (re.sub("[^a-z0-9]", "", v) for v in (x, y))
        return p == q


def align_rows(a: list[dict], b: list[dict], anchor: str | None) -> list[tuple[int, str, str | None, str | None]]:
    """(row of a, column, value in a, value in b) where two extractions of a table disagree; rows pair up in order by their keys."""
    ka, kb = [_key(r, anchor) for r in a], [_key(r, anchor) for r in b]
    out, met = [], set()
    blocks = [(0, 0, len(ka))] if ka == kb else SequenceMatcher(None, ka, kb, autojunk=False).get_matching_blocks()
    for at_a, at_b, size in blocks:
        for k in range(size):
            i, j = at_a + k, at_b + k
            met.add(i)
            out += [(i, c, a[i][c], b[j].get(c)) for c in a[i] if not same_value(a[i][c], b[j].get(c))]
    for i in range(len(a)):
        if i not in met:
            out += [(i, c, v, "MISSING_ROW") for c, v in a[i].items() if v]
    return sorted(out, key=lambda x: (x[0], x[1]))


def align_extractions(a: DataFrame, b: DataFrame, anchor: str) -> DataFrame:
    """Disagreements of two long tables (doc_id, row_index, source_column, value), document by document."""
    ship(a.sparkSession)

    def rows(cells: pa.Array) -> list[list[dict]]:
        """The rows of each document in order, from its list of (row_index, source_column, value)."""
        each = list(zip(*[c.to_pylist() for c in cells.flatten().flatten()], strict=True))
        out, at = [], 0
        for n in cells.value_lengths().to_pylist():
            by_row: dict[int, dict] = {}
            for r, c, v in sorted(each[at : at + (n or 0)], key=lambda x: (x[0], x[1] is None, x[1] or "")):
                by_row.setdefault(r, {})[c] = v
            out.append(list(by_row.values()))
            at += n or 0
        return out

    def flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(i, *r) for i, x, y in zip(b.column(0).to_pylist(), rows(b.column(1)), rows(b.column(2)), strict=True) for r in align_rows(x, y, anchor)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()), strict=True)], names=["doc_id", "row_index", "source_column", "a", "b"])

    # A document is one row a side, many to a batch. Keys of one type stay as they are, so that tables already dealt by document are not dealt again.
    same = a.schema["doc_id"].dataType == b.schema["doc_id"].dataType
    key = F.col("doc_id") if same else F.col("doc_id").cast("string")
    cells = F.collect_list(F.struct(F.col("row_index").cast("int"), F.col("source_column").cast("string"), F.col("value").cast("string")))
    side = lambda df, name: df.where("row_index is not null").groupBy(key.alias("doc_id")).agg(cells.alias(name))
    # Documents that only the second extraction has give nothing.
    both = side(a, "a").join(side(b, "b").withColumnRenamed("doc_id", "doc_id_b"), F.col("doc_id").eqNullSafe(F.col("doc_id_b")), "left")
    return both.select(F.col("doc_id").cast("string").alias("doc_id"), "a", "b").mapInArrow(flags, FLAGS)


def salvage_json(text: str | None) -> tuple[list[dict], str]:
    """Row objects of a model's answer, and how they were got: ok, repaired, partial or none.

    Fences and chatter around the payload are cut off, trailing commas dropped, and of
    a truncated answer all complete objects are kept.
    """
    if not text or not text.strip():
        return [], "none"
    body = re.sub(r"```(?:json)?", "", text).strip()
    lo = min((i for i in (body.find("{"), body.find("[")) if i >= 0), default=-1)
    if lo < 0:
        return [], "none"
    hi = max(body.rfind("}"), body.rfind("]"))
    for cut, how in ((body, "ok"), (body[lo : hi + 1], "ok"), (re.sub(r",\s*([}\]])", r"\1", body[lo : hi + 1]), "repaired")):
        try:
            return _rows(json.loads(cut)), how
        except ValueError:
            continue
    at = body.find('"rows"')
    start = body.find("[", at) + 1 if at >= 0 else lo
    out, decoder = [], json.JSONDecoder()
    while (start := body.find("{", start)) >= 0:
        try:
            obj, start = decoder.raw_decode(body, start)
            out.append(obj)
        except ValueError:
            start += 1
    return [o for o in out if isinstance(o, dict)], "partial" if out else "none"


def _rows(value: object) -> list[dict]:
    if isinstance(value, dict):
        value = value["rows"] if isinstance(value.get("rows"), list) else [value]
    return [v for v in value if isinstance(v, dict)] if isinstance(value, list) else []


def salvage_rows(answers: DataFrame) -> DataFrame:
    """(id, how, row_index, cells) of ``answers`` (id, text): one row an object; cells are strings, blank ones null."""
    ship(answers.sparkSession)

    def each(batches):
        for pdf in batches:
            out = []
            for i, t in zip(pdf.id, pdf.text, strict=True):
                rows, how = salvage_json(t)
                for k, r in enumerate(rows):
                    cells = {str(c): (str(v).strip() or None) if v is not None else None for c, v in r.items()}
                    if any(cells.values()):
                        out.append((i, how, k, cells))
            yield pd.DataFrame(out, columns=["id", "how", "row_index", "cells"])

    return answers.select(F.col("id").cast("string"), "text").mapInPandas(each, "id string, how string, row_index int, cells map<string,string>")


# Fixed patterns of positions, in order of priority.
POSITIONS = (r"\d+-\d+", r"K-\d+", r"[A-Z]-\d+")
PART_NUMBER = re.compile(r"\b(?:[A-Z][A-Z0-9._/-]*\d[A-Z0-9._/-]*|\d[A-Z0-9._/-]*[A-Z][A-Z0-9._/-]*)\b")


def scan_positions(line: str) -> list[tuple[str, str | None, int | None, str]]:
    """(position, part number, count, description) of each position in a line; the text up to the next belongs to it."""
    at: list[tuple[int, int]] = []
    for p in POSITIONS:
        for m in re.finditer(rf"(?:\b|\s)({p})\b", line):
            if all(m.start(1) >= e or m.end(1) <= s for s, e in at):
                at.append(m.span(1))
    at.sort()
    if not at:
        return []
    out = []
    for (s, e), nxt in zip(at, [*at[1:], (len(line), 0)], strict=True):
        rest = line[e : nxt[0]].strip(" |;,\t")
        part = PART_NUMBER.search(rest)
        left = rest.replace(part[0], " ", 1) if part else rest
        counts = re.findall(r"(?<![A-Za-z0-9.,])\d{1,4}(?![A-Za-z0-9]|[.,]\d)", left)
        text = re.sub(r"\s+", " ", re.sub(rf"\b{counts[-1]}\b", " ", left, count=1) if counts else left).strip()
        out.append((line[s:e], part[0] if part else None, int(counts[-1]) if counts else None, text))
    return out


def position_scan(lines: DataFrame) -> DataFrame:
    """Matches of :func:`scan_positions` in ``lines`` (id, text)."""
    ship(lines.sparkSession)

    def each(batches):
        for pdf in batches:
            yield pd.DataFrame([(i, k, *m) for i, t in zip(pdf.id, pdf.text, strict=True) if isinstance(t, str) for k, m in enumerate(x for line in t.split("\n") for x in scan_positions(line))], columns=["id", "ord", "pos", "part_number", "quantity", "description"]).astype({"quantity": "Int32"})

    return lines.select("id", "text").mapInPandas(each, f"id {lines.schema['id'].dataType.simpleString()}, ord int, pos string, part_number string, quantity int, description string")
