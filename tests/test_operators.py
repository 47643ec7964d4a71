"""Layout, alignment, JSON, positions, files, sinks and feeds on small fixtures."""

import zipfile

import pytest
from pyspark.sql import functions as F

from partloom.functions import udfs
from partloom.operators import align, layout
from partloom.sources import files, sinks
from partloom.streaming import feeds

CENTRES = {"POS": 30.0, "BENENNUNG": 120.0, "STK": 260.0, "WERKSTOFF": 340.0}


def page(rows, header=True, page=0):
    line = lambda y, cells: [("d", page, CENTRES[k] - 20, y, CENTRES[k] + 20, y + 8, v) for k, v in cells.items() if v]
    out = line(10.0, {k: k for k in CENTRES}) if header else []
    for i, r in enumerate(rows):
        out += line(30.0 + 20 * i, r)
    return out


def table(spark, words):
    df = spark.createDataFrame(words, "doc_id string, page int, x0 double, y0 double, x1 double, y1 double, text string").withColumn("page_height", F.lit(400.0))
    cells = layout.fold_wrapped(layout.reconstruct_cells(df))
    rows: dict[int, dict] = {}
    for r in cells.collect():
        rows.setdefault(r.row_index, {})[r.source_column] = r.value
    return [rows[k] for k in sorted(rows)], cells


def test_rows_are_bands_not_positions(spark):
    rows, cells = table(spark, page([{"POS": "10", "BENENNUNG": f"Teil {i}", "STK": str(i), "WERKSTOFF": "1.2343"} for i in range(5)]))
    assert [r["STK"] for r in rows] == list("01234")
    assert cells.select("band_id").distinct().count() == 5


def test_wrapped_description_is_folded_and_nameless_rows_stay(spark):
    rows, _ = table(spark, page([{"POS": "1", "BENENNUNG": "Platte", "STK": "2"}, {"BENENNUNG": "lang"}, {"STK": "3", "WERKSTOFF": "1.2344"}]))
    assert rows[0]["BENENNUNG"] == "Platte lang"
    assert rows[1] == {"STK": "3", "WERKSTOFF": "1.2344"}


def test_page_marker_and_continuation_page(spark):
    words = page([{"POS": "1", "BENENNUNG": "Platte", "STK": "2"}]) + [("d", 0, 100.0, 200.0, 140.0, 208.0, "Seite 1")] + page([{"POS": "2", "BENENNUNG": "Bolzen", "STK": "1"}], header=False, page=1)
    rows, _ = table(spark, words)
    assert [r["POS"] for r in rows] == ["1", "2"]


def test_alignment_flags_missing_rows_and_cells():
    row = lambda p, s: {"POS": p, "DESC": f"Teil {p}", "STK": s}
    a = [row("1", "1"), row("2", "1"), row("3", "1")]
    assert {x[0] for x in align.align_rows(a, [a[0], a[2]], "POS")} == {1}
    assert align.align_rows(a, [a[0], row("2", "7"), a[2]], "POS") == [(1, "STK", "1", "7")]


@pytest.mark.parametrize(
    ("text", "rows", "how"),
    [('{"rows": [{"a": 1}]}', 1, "ok"), ('```json\n{"rows": [{"a": 1},]}\n```', 1, "repaired"), ('Here: {"rows": [{"a": 1}, {"a": "x}"}, {"a', 2, "partial"), ("", 0, "none"), ("no json", 0, "none")],
)
def test_salvage(text, rows, how):
    got, kind = align.salvage_json(text)
    assert (len(got), kind) == (rows, how)


def test_position_scan():
    assert [m[0] for m in align.scan_positions("1-1 Einsatz 2 K-5 Kern 10-20 Schieber A-12 Buchse")] == ["1-1", "K-5", "10-20", "A-12"]
    assert align.scan_positions("1-1 Einsatz AB123 4 Stk")[0][:3] == ("1-1", "AB123", 4)


def test_fuzzy_and_unicode(spark):
    assert udfs.similarity("balinit alcrona", "balinit alcrona") == 100
    assert udfs.similarity("balinit alcronna", "balinit alcrona") > 90 > udfs.similarity("lackiert", "balinit")
    r = spark.createDataFrame([("Ⅳ Straße  ×",), (None,)], "v string").select(udfs.fold("v").alias("f"), udfs.nfkc("v").alias("n")).collect()
    assert (r[0].f, r[0].n, r[1].f) == ("iv strasse ×", "IV Straße  ×", None)


def workbook(path):
    cell = lambda r, c, v: f'<c r="{c}{r}" t="inlineStr"><is><t>{v}</t></is></c>'
    row = lambda r, vs: f'<row r="{r}">' + "".join(cell(r, c, v) for c, v in zip("ABC", vs, strict=False) if v) + "</row>"
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Deckblatt" sheetId="1" r:id="r1"/><sheet name="Teile" sheetId="2" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/s1.xml"/><Relationship Id="r2" Target="worksheets/s2.xml"/></Relationships>')
        z.writestr("xl/worksheets/s1.xml", f"<worksheet {ns}><sheetData>{''.join(row(i, [f'Text {i}']) for i in range(1, 12))}</sheetData></worksheet>")
        rows = row(1, ["Projekt X"]) + row(3, ["Pos", "Benennung", "Menge"]) + row(4, ["10", "Platte", "2"]) + row(5, ["", "Bolzen", "4"]) + row(6, ["20", "Kern", "1"])
        z.writestr("xl/worksheets/s2.xml", f'<worksheet {ns}><sheetData>{rows}</sheetData><mergeCells><mergeCell ref="A4:A5"/></mergeCells></worksheet>')


def test_files(spark, tmp_path):
    workbook(tmp_path / "a.xlsx")
    (tmp_path / "b.csv").write_text("Pos;Benennung;Stk;Werkstoff\n1;Formplatte;2;1.2343\n2;Kern;1;\n", encoding="cp1252")
    (tmp_path / "c.xlsx").write_bytes(b"PK\x03\x04broken")
    (tmp_path / "d.csv").write_bytes(b"")
    cells = files.read_cells(spark, str(tmp_path))
    assert cells.where("error is not null").count() == 1
    rows = files.table_rows(files.select_sheet(cells)).select(F.element_at(F.split("path", "/"), -1).alias("f"), "row_index", "source_column", "value").collect()
    got = {(r.f, r.row_index, r.source_column): r.value for r in rows}
    assert got["a.xlsx", 1, "Pos"] == "10" and got["a.xlsx", 1, "Benennung"] == "Bolzen" and got["a.xlsx", 2, "Pos"] == "20"
    assert got["b.csv", 0, "Werkstoff"] == "1.2343" and ("b.csv", 1, "Werkstoff") not in got


def test_export_guard(spark, tmp_path):
    cells = spark.createDataFrame([("d", 0, "Detail Number", "1"), ("d", 0, "Design Count", "2,0"), ("d", 1, "Detail Number", "2")], "doc_id string, row_index int, field string, value string")
    expected = spark.createDataFrame([("d", "0"), ("d", "1"), ("d", "2")], "doc_id string, row_id string")
    with pytest.raises(sinks.DataLossError):
        sinks.export_target(cells, str(tmp_path / "x"), expected)
    assert not (tmp_path / "x").exists()
    sinks.export_target(cells, str(tmp_path / "x"), expected, spark.createDataFrame([("d", "2")], "doc_id string, row_id string"))
    assert spark.read.parquet(str(tmp_path / "x")).count() == 2


def test_rate_limit_batch_equals_stream(spark, tmp_path):
    rows = [("k" + str(i % 3), float(i * 7 % 50 + i), i) for i in range(60)]
    df = spark.createDataFrame(rows, "key string, ts double, event_id long")
    batch = {r.event_id: r.allowed for r in feeds.rate_limit(df, 10.0, 2).collect()}
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = feeds.rate_limit_stream(stream, 10.0, 2).writeStream.format("memory").queryName("limited").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {r.event_id: r.allowed for r in spark.table("limited").collect()} == batch
    assert feeds.allow([0, 1, 2, 11], 10, 2)[0] == [True, True, False, True]


def test_lockout(spark):
    rows = [("u", float(t), i, ok) for i, (t, ok) in enumerate([(0, False), (1, False), (2, True), (400, False), (401, True)])]
    got = feeds.lockout(spark.createDataFrame(rows, "key string, ts double, event_id long, success boolean"), 2, 300.0)
    assert [r.locked for r in got.orderBy("ts").collect()] == [False, False, True, False, False]
