"""The worksheet source on workbooks that the test writes."""

import zipfile

import pytest

from lumenfold.sources import worksheets
from lumenfold.sources.worksheets import Worksheets

SPREAD = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def workbook(path, sheets, shared=()):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        tags = "".join(f'<sheet name="{name}" sheetId="{i}" r:id="rId{i}"{state}/>' for i, (name, state, _) in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{SPREAD}" xmlns:r="{REL}"><sheets>{tags}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="rId{i}" Target="worksheets/part{len(sheets) - i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        if shared:
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{SPREAD}">' + "".join(f"<si>{s}</si>" for s in shared) + "</sst>")
        for i, (_, _, xml) in enumerate(sheets, 1):
            z.writestr(f"xl/worksheets/part{len(sheets) - i}.xml", f'<worksheet xmlns="{SPREAD}" xmlns:r="{REL}">{xml}</worksheet>')


FIRST = """<cols><col min="3" max="4" hidden="1"/></cols><sheetData>
<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="D1" t="inlineStr"><is><t>in &amp; line</t></is></c><c r="E1"/></row>
<row r="3" hidden="1"><c r="A3"><f>1+1</f><v>2</v></c><c r="B3" t="b"><v>1</v></c></row><row r="4"><c><f>A3*2</f><v>4</v></c><c t="str"><v>x</v></c></row></sheetData>
<mergeCells count="2"><mergeCell ref="A1:B1"/><mergeCell ref="C2:C9"/></mergeCells><hyperlinks><hyperlink ref="A1" r:id="rId9"/></hyperlinks>"""


@pytest.fixture
def books(tmp_path):
    rows = "".join(f'<row r="{i}"><c r="AA{i}"><v>{i}</v></c></row>' for i in range(1, 2001))
    workbook(tmp_path / "one.xlsx", [("First", "", FIRST), ("Second &amp; long", ' state="hidden"', f"<sheetData>{rows}</sheetData>")], ["<t>head</t>", "<r><t>rich </t></r><r><t>text</t></r><rPh><t>no</t></rPh>"])
    workbook(tmp_path / "two.xlsx", [("Only", "", "<sheetData/>")])
    (tmp_path / "note.txt").write_text("no workbook")
    return str(tmp_path)


def test_rows(spark, books):
    spark.dataSource.register(Worksheets)
    read = spark.read.format("worksheets").load(books)
    assert read.rdd.getNumPartitions() == 3
    found = [tuple(r)[1:] for r in read.where("sheet = 'First'").orderBy("row_no").collect()]
    assert found == [("First", 1, ["head", "rich text", "", "in & line"], False, 0), ("First", 3, ["2", "TRUE"], True, 1), ("First", 4, ["4", "x"], False, 1)]
    second = read.where("sheet = 'Second & long'").selectExpr("count(*)", "sum(cells[26])", "max(size(cells))").first()
    assert tuple(second) == (2000, 2001000.0, 27)


def test_sheets(spark, books):
    spark.dataSource.register(Worksheets)
    found = {r.sheet: tuple(r)[2:] for r in spark.read.format("worksheets").option("what", "sheets").load(books).collect()}
    assert found == {
        "First": ("visible", 3, 4, 2, 1, 2, "A1:B1;C2:C9", "3", "C;D"),
        "Second & long": ("hidden", 2000, 27, 0, 0, 0, "", "", ""),
        "Only": ("visible", 0, 0, 0, 0, 0, "", "", ""),
    }
    assert spark.read.format("worksheets").load(f"{books}/two.xlsx").count() == 0


def test_empty_folder_and_letters(spark, tmp_path):
    spark.dataSource.register(Worksheets)
    assert spark.read.format("worksheets").load(str(tmp_path)).count() == 0
    assert [worksheets.column_letters(worksheets.column_number(x)) for x in ("A", "Z", "AA", "AZ", "ZZ", "AAA")] == ["A", "Z", "AA", "AZ", "ZZ", "AAA"]
