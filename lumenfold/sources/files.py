"""File sources: an inventory of binary files, repaired CSV, JSON lines, text of office documents.

Office files are zipped XML, which the standard library reads; each file is one row of a binary scan, so
files are read where the rows are. PDF and image text needs libraries that may be missing: such files
get the status ``unavailable``.
"""

from __future__ import annotations

import html
import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfold.sources.encodings import decoded_lines
from lumenfold.storage import bounded, written

ALLOWED_UPLOADS = ["pdf", "docx", "xlsx", "txt", "png", "jpg", "jpeg"]
MAX_UPLOAD_BYTES = 20 << 20


def inventory(spark: SparkSession, roots: list[str], pattern: str = "*") -> DataFrame:
    """(path, name, extension, bytes, modified, sha256) of the files directly in ``roots``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "false").load(roots)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("name"), F.lower(F.regexp_extract(name, "\\.([^.]+)$", 1)).alias("extension"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))


def _carried(blocks: DataFrame, what: str) -> Column:
    """The sum of ``what`` over the blocks of a file that lie before: a row a block."""
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(what).over(before), F.lit(0))


def csv_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, row_no, line, flag): the records of CSV files; a quoted line break stays inside its record.

    Files are read in blocks. Whether a line begins inside quotes is the parity of the quotes before it,
    summed in its block and carried over the blocks before; so is the number of its record. No task has
    a whole file, and encodings are detected. Where quotes don't close at the end of a file, the lines
    from the last that opens are records of their own with the flag UNCLOSED_QUOTE. A file of one line
    with literal ``\\n`` is unescaped and flagged.
    """
    read = written(decoded_lines(spark, path).select("path", "block", "at", F.col("line").alias("t")), "lines")
    filled = read.where("trim(t) <> ''").groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("block", "at")).alias("last"))
    # a row a file; empty lines at the end of a file are no records
    lines = read.join(filled, "path").where(F.struct("block", "at") <= F.col("last"))
    one = (F.col("n") == 1) & F.col("t").contains("\\n")
    inner = F.regexp_replace(F.trim("t"), '^"|"$', "")
    repaired = F.regexp_replace(F.replace(F.replace(inner, F.lit("\\n"), F.lit("\n")), F.lit('\\"'), F.lit('"')), "\n+$", "")
    parts = lines.withColumn("one", one).select("path", "block", "at", "one", F.posexplode(F.when(F.col("one"), F.split(repaired, "\n")).otherwise(F.array("t"))).alias("pos", "line"))
    quotes = (F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))) % 2
    order = Window.partitionBy("path", "block").orderBy("at", "pos")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    counted = written(parts.withColumn("odd", quotes).withColumn("here", F.coalesce(F.sum("odd").over(before), F.lit(0))), "quotes")
    blocks = counted.groupBy("path", "block").agg(F.sum("odd").alias("odd"))
    carried = blocks.select("path", "block", _carried(blocks, "odd").alias("carried"))
    open_ = (F.col("carried") + F.col("here")) % 2 == 1
    known = counted.join(bounded(carried, 128), ["path", "block"]).select("path", "block", "at", "pos", "one", "line", "odd", open_.alias("open"))
    place = F.struct("block", "at", "pos")
    unclosed = known.groupBy("path").agg(F.sum("odd").alias("odd"), F.max(F.when(~F.col("open") & (F.col("odd") == 1), place)).alias("from")).where("odd % 2 = 1").select("path", "from")
    marked = known.join(bounded(unclosed, 128), "path", "left")
    loose = F.coalesce(place >= F.col("from"), F.lit(False))
    placed = written(marked.select("path", "block", "at", "pos", "one", "line", loose.alias("loose"), (loose | ~F.col("open")).cast("int").alias("starts")), "records")
    starts = placed.groupBy("path", "block").agg(F.sum("starts").alias("starts"))
    offset = starts.select("path", "block", _carried(starts, "starts").alias("offset"))
    numbered = placed.withColumn("nth", F.sum("starts").over(order)).join(bounded(offset, 128), ["path", "block"])
    flag = F.when(F.max("loose"), "UNCLOSED_QUOTE").when(F.max("one"), "SINGLE_LINE_ESCAPED_CSV").otherwise("")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "at", "pos", "line"))), lambda x: x["line"]), "\n")
    return numbered.withColumn("row_no", F.col("offset") + F.col("nth")).groupBy("path", "row_no").agg(whole.alias("line"), flag.alias("flag"))


def csv_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header as a table of texts; missing cells are empty."""
    read = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8").csv(path)
    names = [c.removeprefix("\ufeff") for c in read.columns]
    return read.toDF(*names).na.fill("")


def split_csv(line: Column) -> Column:
    """The cells of a CSV line with double quotes."""
    cells = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(',("(?:[^"]|"")*"|[^,]*)'), F.lit(1))
    return F.transform(cells, lambda c: F.when(c.startswith('"'), F.replace(F.regexp_replace(c, '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(c))


def ragged_rows(lines: DataFrame) -> DataFrame:
    """(path, row_no, cells, flag): all rows as wide as the widest of their file; wider rows than the header flag the file."""
    cells = lines.withColumn("cells", split_csv(F.col("line")))
    widths = cells.groupBy("path").agg(F.max(F.size("cells")).alias("width"), F.max(F.when(F.col("row_no") == 1, F.size("cells"))).alias("header_width"))
    # a row a file
    joined = cells.join(widths, "path")
    padded = F.concat("cells", F.array_repeat(F.lit(None).cast("string"), F.col("width") - F.size("cells")))
    names = F.transform(padded, lambda c, i: F.coalesce(c, F.concat(F.lit("__unnamed_"), i.cast("string"))))
    flag = F.when(F.col("width") > F.col("header_width"), "RAGGED_ROWS_WIDER_THAN_HEADER").otherwise(F.col("flag"))
    return joined.select("path", "row_no", F.when(F.col("row_no") == 1, names).otherwise(padded).alias("cells"), flag.alias("flag"))


def json_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks from JSON lines; page numbers are integers or null, a missing chunk_id is fatal."""
    text = ["chunk_id", "document_id", "is_id", "canonical_is_number", "document_type", "title", "section", "clause", "breadcrumb", "content", "source_url", "version", "effective_date", "sha256"]
    raw = spark.read.schema(", ".join(f"{c} string" for c in [*text, "page_start", "page_end"])).json(path)
    sure = raw.where(F.coalesce(F.assert_true(F.coalesce(F.col("chunk_id"), F.lit("")) != "", "chunk without chunk_id"), F.lit(True)).cast("boolean"))
    return sure.select(*text, *[F.expr(f"try_cast(nullif({c}, '') AS int)").alias(c) for c in ("page_start", "page_end")])


_TEXT = re.compile(r"<(?:w:t|t)(?:\s[^>]*)?>(.*?)</(?:w:t|t)>", re.DOTALL)


def _inner(xml: str) -> str:
    return html.unescape("".join(_TEXT.findall(xml)))


def docx_text(content: bytes) -> str:
    """Paragraphs outside tables, then the rows of tables with cells joined by `` | ``."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        xml = z.read("word/document.xml").decode("utf-8", "replace")
    tables = re.findall(r"<w:tbl>.*?</w:tbl>", xml, re.DOTALL)
    outside = re.sub(r"<w:tbl>.*?</w:tbl>", "", xml, flags=re.DOTALL)
    lines = [_inner(p) for p in re.findall(r"<w:p[ >].*?</w:p>", outside, re.DOTALL)]
    for t in tables:
        for row in re.findall(r"<w:tr[ >].*?</w:tr>", t, re.DOTALL):
            lines.append(" | ".join(_inner(c) for c in re.findall(r"<w:tc[ >].*?</w:tc>", row, re.DOTALL)))
    return "\n".join(x for x in lines if x.strip())


def xlsx_rows(content: bytes) -> list[tuple[str, int, list[str]]]:
    """(sheet, row number, cells) of every worksheet, trailing empty cells left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = re.findall(r"<si>(.*?)</si>", z.read("xl/sharedStrings.xml").decode("utf-8", "replace"), re.DOTALL) if "xl/sharedStrings.xml" in names else []
        shared = [_inner(s) for s in shared]
        tags = re.findall(r"<sheet [^>]*>", z.read("xl/workbook.xml").decode("utf-8", "replace"))
        field = lambda tag, name: (re.search(rf'[ :]{name}="([^"]*)"', tag) or ["", ""])[1]
        # which part holds a sheet is what the workbook's relations say, not its place in the list
        parts = {}
        if "xl/_rels/workbook.xml.rels" in names:
            relations = re.findall(r"<Relationship [^>]*>", z.read("xl/_rels/workbook.xml.rels").decode("utf-8", "replace"))
            parts = {field(r, "Id"): field(r, "Target").removeprefix("/xl/") for r in relations}
        out = []
        for i, tag in enumerate(tags, 1):
            sheet, part = field(tag, "name"), parts.get(field(tag, "r:id") or field(tag, "id"), f"worksheets/sheet{i}.xml")
            xml = z.read(f"xl/{part}").decode("utf-8", "replace")
            for number, row in re.findall(r'<row [^>]*?r="(\d+)"[^>]*>(.*?)</row>', xml, re.DOTALL):
                cells: dict[int, str] = {}
                for ref, attrs, body in re.findall(r'<c r="([A-Z]+)\d+"([^>]*?)(?:/>|>(.*?)</c>)', row, re.DOTALL):
                    at = 0
                    for ch in ref:
                        at = at * 26 + ord(ch) - 64
                    value = re.search(r"<v>(.*?)</v>", body or "", re.DOTALL)
                    cells[at - 1] = shared[int(value[1])] if value and 't="s"' in attrs else html.unescape(value[1]) if value else _inner(body or "")
                width = max((k for k, v in cells.items() if v != ""), default=-1) + 1
                out.append((html.unescape(sheet), int(number), [cells.get(k, "") for k in range(width)]))
    return out


def extract_text(name: str, content: bytes) -> tuple[str, str]:
    """(text, status) of a file by its extension; it never raises."""
    kind = name.rpartition(".")[2].lower()
    try:
        if kind == "docx":
            return docx_text(content), "ok"
        if kind == "xlsx":
            lines, last = [], None
            for sheet, _, cells in xlsx_rows(content):
                if sheet != last:
                    lines.append(f"Sheet: {sheet}")
                    last = sheet
                lines.append(" | ".join(cells))
            return "\n".join(lines), "ok"
        if kind in ("txt", "csv", "md"):
            return content.decode("utf-8", "replace"), "ok"
        return "", "unavailable"
    except Exception as e:  # a broken file is a result
        return "", f"error: {type(e).__name__}"


def _extract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        got = [extract_text(n, bytes(c)) for n, c in zip(pdf["name"], pdf["content"], strict=True)]
        yield pd.DataFrame({"path": pdf["path"], "name": pdf["name"], "text": [g[0] for g in got], "status": [g[1] for g in got]})


def documents(spark: SparkSession, path: str, least: int = 10) -> DataFrame:
    """(path, name, text, status, chars) of office and text files; fewer than ``least`` characters are an error."""
    files = spark.read.format("binaryFile").load(path).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    out = files.mapInPandas(_extract, "path string, name string, text string, status string")
    return out.withColumn("chars", F.length("text")).withColumn("status", F.when((F.col("status") == "ok") & (F.col("chars") < least), "too_short").otherwise(F.col("status")))


def uploads(df: DataFrame, name: str = "name", data: str = "data") -> DataFrame:
    """Uploads (name, base64 data): decoded, their names made safe, with the reason why one is refused."""
    kind = F.lower(F.regexp_extract(F.col(name), "\\.([^.]+)$", 1))
    content = F.expr(f"try_to_binary({data}, 'base64')")
    reason = F.when(~kind.isin(ALLOWED_UPLOADS), "EXTENSION").when(content.isNull(), "ENCODING").when(F.length(content) > MAX_UPLOAD_BYTES, "TOO_LARGE").otherwise("")
    safe = F.regexp_replace(F.element_at(F.split(F.col(name), "[/\\\\]"), -1), "[^A-Za-z0-9._-]+", "_")
    return df.select(safe.alias("name"), content.alias("content"), reason.alias("refused"))
