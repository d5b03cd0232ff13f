"""Sources, sinks and streams on small files."""

import base64
import io
import json
import uuid
import zipfile

import pytest
from pyspark.sql import functions as F

from lumenfold.operators import integrate
from lumenfold.sources import files, sinks
from lumenfold.streaming import jobs


def office(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def test_csv_repair(spark, tmp_path):
    (tmp_path / "one.csv").write_text('"a,b\\n1,\\"x, y\\"\\n2,z,extra"')
    lines = files.csv_lines(spark, str(tmp_path / "one.csv"))
    rows = files.ragged_rows(lines).orderBy("row_no").collect()
    assert [r.cells for r in rows] == [["a", "b", "__unnamed_2"], ["1", "x, y", None], ["2", "z", "extra"]]
    assert {r.flag for r in rows} == {"RAGGED_ROWS_WIDER_THAN_HEADER"}


def test_office(spark, tmp_path):
    docx = "<w:document><w:body><w:p ><w:r><w:t>Hello &amp; bye</w:t></w:r></w:p><w:tbl><w:tr ><w:tc ><w:t>a</w:t></w:tc><w:tc ><w:t>b</w:t></w:tc></w:tr></w:tbl></w:body></w:document>"
    (tmp_path / "a.docx").write_bytes(office({"word/document.xml": docx}))
    xlsx = {
        "xl/workbook.xml": '<workbook><sheets><sheet name="Tools" sheetId="1"/></sheets></workbook>',
        "xl/sharedStrings.xml": "<sst><si><t>drill</t></si></sst>",
        "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>7</v></c></row></sheetData></worksheet>',
    }
    (tmp_path / "b.xlsx").write_bytes(office(xlsx))
    (tmp_path / "c.docx").write_bytes(b"broken")
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    got = {r["name"]: (r["text"], r["status"]) for r in files.documents(spark, str(tmp_path)).collect()}
    assert got["a.docx"] == ("Hello & bye\na | b", "ok")
    assert got["b.xlsx"] == ("Sheet: Tools\ndrill |  | 7", "ok")
    assert got["c.docx"][1].startswith("error")
    assert got["d.pdf"][1] == "unavailable"
    assert files.inventory(spark, [str(tmp_path)]).count() == 4


def test_chunks_and_uploads(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text(json.dumps({"chunk_id": "1", "page_start": "3", "page_end": ""}) + "\n")
    row = files.json_chunks(spark, str(tmp_path / "c.jsonl")).first()
    assert (row.page_start, row.page_end) == (3, None)
    rows = [("../x y.txt", base64.b64encode(b"hi").decode()), ("x.exe", ""), ("x.txt", "***")]
    found = files.uploads(spark.createDataFrame(rows, "name string, data string")).collect()
    assert [(r["name"], r["refused"]) for r in found] == [("x_y.txt", ""), ("x.exe", "EXTENSION"), ("x.txt", "ENCODING")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "12"), (2, None, "x")], "id int, a string, n string")
    sinks.write_csv(df, str(tmp_path / "out"), ["a", "missing", "id"])
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert "a,missing,id" in text and "missing" not in df.columns
    assert [r.n for r in sinks.numeric_or_null(df, {"n": "int"}).orderBy("id").collect()] == [12, None]
    assert sinks.normalised_copy(df, {"id": "x", "a": "x"}).columns == ["x", "x__2", "n"]
    assert "id integer PRIMARY KEY" in sinks.ddl("t", df.schema, "id")
    assert sinks.manifest({"t": df}) == [("t", 3, 2)]
    sinks.write_jsonl(df, str(tmp_path / "j"))
    sinks.write_table(df, str(tmp_path / "t"), ["id"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_uuid5(spark):
    got = spark.range(1).select(integrate.point_id(F.lit("c1"), "ns:")).first()[0]
    assert got == str(uuid.uuid5(uuid.NAMESPACE_URL, "ns:c1"))


def test_mint_ids_many_partitions(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), F.format_string("%05d", F.col("id"))).alias("k"))
    rows = integrate.mint_ids(keys, "k", "X").orderBy("key").collect()
    assert [r.id for r in rows] == [f"X-{i:05d}" for i in range(1, 5001)]


def test_stream_merge(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    events.repartition(3).write.parquet(source)
    stream = jobs.files(spark, source, events.schema, per_trigger=1)
    jobs.run_available(stream, str(tmp_path / "cp"), jobs.merge_into(target, "event_id", "ts"))
    assert jobs.merged(spark, target).count() == events.select("event_id").distinct().count()


def test_stream_windows(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    source, rows = str(tmp_path / "in"), []
    events.coalesce(1).write.parquet(source)
    counts = jobs.windowed_counts(jobs.files(spark, source, events.schema), late="10000 days")
    q = counts.writeStream.outputMode("complete").foreachBatch(lambda df, i: rows.append(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(r.n for r in rows[-1]) == events.count()


def test_csv_records(spark, tmp_path):
    (tmp_path / "many.csv").write_bytes(b'\xef\xbb\xbfid,text\r\n1,"two\r\nlines, ""quoted"""\r\n2,plain\r\n\r\n')
    lines = files.csv_lines(spark, str(tmp_path / "many.csv"))
    rows = files.ragged_rows(lines).orderBy("row_no").collect()
    assert [(r.row_no, r.cells) for r in rows] == [(1, ["id", "text"]), (2, ["1", 'two\nlines, "quoted"']), (3, ["2", "plain"])]
    table = files.csv_table(spark, str(tmp_path / "many.csv"))
    assert table.columns == ["id", "text"] and table.where("id = '2'").first().text == "plain"


def test_sheets_follow_relations():
    book = {
        "xl/workbook.xml": '<workbook><sheets><sheet name="First" sheetId="3" r:id="rId2"/><sheet name="Second" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="worksheets/sheet3.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row r="1"><c r="A1"><v>1</v></c></row></sheetData></worksheet>',
        "xl/worksheets/sheet3.xml": '<worksheet><sheetData><row r="2"><c r="A2"><v>3</v></c></row></sheetData></worksheet>',
    }
    assert files.xlsx_rows(office(book)) == [("First", 2, ["3"]), ("Second", 1, ["1"])]


def test_the_newest_row_stays(spark, tmp_path):
    at = str(tmp_path / "t")
    merge = jobs.merge_into(at, "k", "at", buckets=4)
    make = lambda rows: spark.createDataFrame(rows, "k int, at int, v string")
    got = lambda: {(r.k, r.v) for r in jobs.merged(spark, at).collect()}
    for i, rows in enumerate([[(1, 1, "a"), (1, 3, "b"), (2, 1, "c")], [(1, 2, "late"), (3, 1, "d")], [(2, 5, "e")]]):
        merge(make(rows), i)
        merge(make(rows), i)  # a batch that runs again
    assert got() == {(1, "b"), (2, "e"), (3, "d")}
    versions = jobs._versions(spark, at)
    assert all(len(v) <= 2 for b, v in versions.items()) and versions[-1] == [1, 2]
    before = {b: v for b, v in versions.items() if b >= 0}
    merge(make([(2, 9, "f")]), 3)
    after = {b: v for b, v in jobs._versions(spark, at).items() if b >= 0}
    assert sum(before[b] != after[b] for b in before) == 1  # one key, one bucket
    (tmp_path / "t" / "done" / "3").unlink()  # as if the batch had been cut off before its end
    assert got() == {(1, "b"), (2, "e"), (3, "d")}
    merge(make([(2, 9, "f")]), 3)
    assert got() == {(1, "b"), (2, "f"), (3, "d")}


def test_long_lists_are_cut(spark):
    masters = spark.createDataFrame([(1,), (2,)], "k int")
    edges = spark.range(3000).select(F.lit(1).alias("k"), F.format_string("v%05d", "id").alias("v"))
    row = integrate.with_aspects(masters, "k", {"x": (edges, "k", "v")}, chars=50).where("k = 1").first()
    assert row.x_count == 3000 and row.x_list == "v00000 | v00001 | v00002 | v00003 | v00004 | +2995 more"


def test_audits_are_kept(spark, tmp_path):
    made = spark.createDataFrame([("REQ-1", "PASS"), ("REQ-2", "GAP")], "requirement_id string, decision string")
    sinks.save_audit(made, str(tmp_path), "a1")
    sinks.save_audit(made.where("decision = 'GAP'"), str(tmp_path), "a2")
    sinks.save_audit(made.limit(1), str(tmp_path), "a2")
    schema = made.schema
    assert sinks.load_audits(spark, str(tmp_path), schema).count() == 3
    assert [r.requirement_id for r in sinks.load_audits(spark, str(tmp_path), schema, "a2").collect()] == ["REQ-1"]


def test_ddl_types(spark):
    schema = spark.createDataFrame([], "a decimal(10,2), b date, c timestamp, d array<int>, e struct<x: int>, f string").schema
    text = sinks.ddl("t", schema)
    assert [line.split(" ", 1)[1] for line in text.replace(",\n", "\n").split("\n  ")[1:]] == ["numeric(10, 2)", "date", "timestamptz", "integer[]", "jsonb", "text\n);"]


def test_tables_are_swapped_after_their_checks(spark, tmp_path):
    at = str(tmp_path / "t")
    make = lambda parts, items: {"part": spark.createDataFrame(parts, "id int, name string"), "item": spark.createDataFrame(items, "item int, part int")}
    keys, refs = {"part": "id", "item": "item"}, [("item", "part", "part")]
    sinks.load_tables(make([(1, "a"), (2, " ")], [(7, 1), (8, None)]), at, keys, refs)
    assert sorted(map(tuple, sinks.loaded(spark, at, "part").collect())) == [(1, "a"), (2, None)]
    with pytest.raises(ValueError, match="item.part: 1 rows point to nothing; part.id: 0 blank, 1 repeated"):
        sinks.load_tables(make([(1, "a"), (1, "b")], [(7, 9)]), at, keys, refs)
    assert sinks.loaded(spark, at, "part").count() == 2  # the version that stood
    for n in (3, 4):
        sinks.load_tables(make([(i, "x") for i in range(n)], [(7, 1)]), at, keys, refs)
    assert sinks.loaded(spark, at, "part").count() == 4 and sinks.current_version(spark, at) == "00000003"
    assert sorted(p.name for p in (tmp_path / "t" / "versions").iterdir()) == ["00000002", "00000003"]
    assert "FOREIGN KEY (part) REFERENCES part (id)" in sinks.ddl("item", sinks.loaded(spark, at, "item").schema, "item", {"part": ("part", "id")})
