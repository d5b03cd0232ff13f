"""Encodings, and CSV records over blocks of files."""

import codecs
import csv
import io
import random

import pytest

from lumenfold.sources import encodings, files

TEXTS = {
    "cp1252": "Le garçon était déjà là, près de la forêt. Über die Straße läuft ein größeres Mädchen; mañana será otro día.",
    "cp1250": "Příliš žluťoučký kůň úpěl ďábelské ódy. Zażółć gęślą jaźń, chrząszcz brzmi w trzcinie.",
    "cp1251": "Съешь же ещё этих мягких французских булок, да выпей чаю. Москва является столицей.",
    "koi8-r": "Съешь же ещё этих мягких французских булок, да выпей чаю. Москва является столицей.",
    "cp1253": "Η γρήγορη αλεπού πηδά πάνω από τον τεμπέλη σκύλο. Καλημέρα σας, τι κάνετε;",
    "utf-8": "Ελλάδα, Москва, naïve, 漢字 and plain words",
}


@pytest.mark.parametrize("name", TEXTS)
def test_detect(name):
    data = TEXTS[name].encode(name)
    assert encodings.detect(data) == name
    assert encodings.detect(data + b" plain words that say nothing" * 20) == name


def test_detect_marks_and_edges():
    assert encodings.detect(codecs.BOM_UTF8 + b"abc") == "utf-8-sig"
    assert encodings.detect("naïve".encode("utf-16")) == "utf-16"
    assert encodings.detect("naïve words".encode("utf-16-le")) == "utf-16-le"
    assert encodings.detect("naïve words".encode("utf-16-be")) == "utf-16-be"
    assert encodings.detect(b"") == encodings.detect(b"plain") == "utf-8"
    assert encodings.detect("漢字".encode()[:-1], whole=False) == "utf-8"
    assert encodings.detect(b"\xe9") == "cp1252"


def test_lines_of_every_encoding(spark, tmp_path):
    for i, (name, text) in enumerate([*TEXTS.items(), ("utf-16", TEXTS["utf-8"]), ("utf-8-sig", TEXTS["utf-8"])]):
        (tmp_path / f"{i}.txt").write_bytes(f"{text}\r\nsecond {text}\n".encode(name))
    found = encodings.decoded_lines(spark, str(tmp_path)).collect()
    lines = {}
    for r in sorted(found, key=lambda r: (r.block, r.at)):
        lines.setdefault(r.path.rsplit("/")[-1], []).append(r.line)
    for i, text in enumerate([*TEXTS.values(), TEXTS["utf-8"], TEXTS["utf-8"]]):
        assert [x for x in lines[f"{i}.txt"] if x] == [text, f"second {text}"]


def test_records_over_blocks(spark, tmp_path):
    draw = random.Random(4)
    word = lambda: draw.choice(["plain", "with, comma", 'with "quotes"', "two\nlines", "a\n\nb", "", "é"])
    rows = [[str(i), word(), word()] for i in range(600)]
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows(rows)
    (tmp_path / "a.csv").write_text(out.getvalue())
    (tmp_path / "open.csv").write_text('x,y\n1,"two\nlines"\n2,"never closed\n3,plain\n4,last\n')
    (tmp_path / "one.csv").write_text('"a,b\\n1,\\"x\\"\\n"')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        found = files.csv_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    by = {}
    for r in sorted(found, key=lambda r: r.row_no):
        by.setdefault(r.path.rsplit("/")[-1], []).append((r.line, r.flag))
    assert [next(csv.reader(io.StringIO(line))) for line, _ in by["a.csv"]] == rows and {f for _, f in by["a.csv"]} == {""}
    assert by["open.csv"] == [("x,y", ""), ('1,"two\nlines"', ""), ('2,"never closed', "UNCLOSED_QUOTE"), ("3,plain", "UNCLOSED_QUOTE"), ("4,last", "UNCLOSED_QUOTE")]
    assert by["one.csv"] == [("a,b", "SINGLE_LINE_ESCAPED_CSV"), ('1,"x"', "SINGLE_LINE_ESCAPED_CSV")]
