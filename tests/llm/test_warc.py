"""Round trips through archives, and archives that other tools have written."""

import base64
import gzip
import hashlib
import json
from pathlib import Path

import pytest

from lumenfold.llm.warc import Inflated, archived, normalise, normalised, read_member, read_records, records, revisits, write_pages

PAGES = "page_id long, url string, html string"
ROWS = [
    (1, "http://a/1", "<p>same</p>"), (2, "http://a/2", "<p>same</p>"), (9, "http://a/9 with blank\r\nand é", "<p>same</p>"), (3, None, "alone é 漢"),
    (4, "http://b", None), (5, "http://b", ""), (None, "http://n", "<p>same</p>"), (None, None, "null id"), (None, None, "null id"),
    (7, "http://c", "WARC/1.1\r\n\r\n in a page\r\n\r\n"), (7, "http://c", "WARC/1.1\r\n\r\n in a page\r\n\r\n"), (8, "http://long", "long " * 700_000),
]


def plain(rows, least=0):
    top = {}
    for i, (page, _, html) in enumerate(rows):
        key = (page is not None, page or 0, i)
        top[html or ""] = max(top.get(html or "", key), key)
    out = []
    for i, (page, _, html) in enumerate(rows):
        data = (html or "").encode()
        first = top[html or ""][2] == i or len(data) < least
        to = rows[top[html or ""][2]][0]
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if first else "revisit", None if first else to))
    return sorted(out, key=str)


def number(x):
    return None if x is None else int(x)


def found(df):
    return sorted(((number(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, number(r.refers_to)) for r in df.collect()), key=str)


@pytest.mark.parametrize("least", [0, 8])
def test_round_trip(least, spark, tmp_path):
    pages = spark.createDataFrame(ROWS, PAGES).selectExpr("*", "url AS archive", "page_id AS nth").repartition(3)
    index = archived(pages, f"{tmp_path}/w", least)
    back = read_records(index)
    assert found(back) == plain(ROWS, least)
    texts = {r.payload.decode() for r in back.collect() if r.record_type == "response"}
    assert texts == {h or "" for _, _, h in ROWS}
    assert found(read_records(archived(pages.limit(0), f"{tmp_path}/none"))) == []


def test_members_and_sidecar(spark, tmp_path):
    log = write_pages(spark.createDataFrame(ROWS, PAGES).coalesce(1), f"{tmp_path}/whole", most_records=5)
    assert sorted(r["count"] for r in log.groupBy("archive").count().collect()) == [2, 5, 5]
    index = normalised(log, f"{tmp_path}/members", revisits(log)).collect()
    for path in {r.archive for r in index}:
        own = sorted((r for r in index if r.archive == path), key=lambda r: r.offset)
        data = Path(path).read_bytes()
        side = [json.loads(x) for x in Path(path.replace(".warc.gz", ".index.jsonl")).read_text().splitlines()]
        assert [(r["offset"], r["length"], r["record_type"]) for r in side] == [(r.offset, r.length, r.record_type) for r in own]
        assert sum(r.length for r in own) == len(data)
        for r in own:
            assert read_member(data[r.offset : r.offset + r.length])["record_id"] == r.record_id
        with open(path, "rb") as file:  # the whole file reads as one stream too
            stream = Inflated(file)
            kinds = []
            for _, fields in records(stream):
                kinds.append(fields["warc-type"])
                assert sum(map(len, stream.pieces(int(fields["content-length"]))))
            assert kinds == [r.record_type for r in own]


def made(kind, block, **more):
    fields = {"WARC-Type": kind, "WARC-Record-ID": "<urn:x>", "WARC-Date": "2020-01-01T00:00:00Z"} | more
    return ("WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + f"Content-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"


def test_other_archives(tmp_path):
    whole = made("warcinfo", b"software: x\r\n") + made("response", b"HTTP/1.1 200 OK\r\n\r\nbody" + b"\0" * 3_000_000, Note="folded\r\n  line") + made("metadata", b"")
    cases = {"one": gzip.compress(whole), "two": gzip.compress(whole[:70]) + gzip.compress(whole[70:]), "padded": gzip.compress(whole) + b"\0" * 9}
    for name, data in cases.items():
        (tmp_path / f"{name}.gz").write_bytes(data)
        rows = list(normalise(f"{tmp_path}/{name}.gz", {}, f"{tmp_path}/out"))
        assert [r["record_type"] for r in rows] == ["warcinfo", "response", "metadata"]
        assert gzip.decompress(Path(rows[0]["archive"]).read_bytes()) == whole
    for name, data in {"cut": gzip.compress(whole)[:-2000], "short": gzip.compress(whole[:-700])}.items():
        (tmp_path / name).write_bytes(data)
        with pytest.raises(ValueError, match="cut off"):
            list(normalise(f"{tmp_path}/{name}", {}, f"{tmp_path}/out"))
    (tmp_path / "other").write_bytes(gzip.compress(b"no archive\r\n\r\n"))
    with pytest.raises(ValueError, match="no record"):
        list(normalise(f"{tmp_path}/other", {}, f"{tmp_path}/out"))
    wrong = made("response", b"HTTP/1.1 200 OK\r\n\r\nbody", **{"WARC-Payload-Digest": "sha1:" + "A" * 32})
    with pytest.raises(ValueError, match="digest"):
        read_member(gzip.compress(wrong))
