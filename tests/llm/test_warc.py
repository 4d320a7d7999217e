"""WARC: exact round trips, magic inside payloads, records over many parts, broken and truncated files."""

import hashlib
import random
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from cadastre.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, least long, size int, value string, file string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "d", 1, 2, "v", "f") for i, u, h in rows], SCHEMA)


def fake(payload, ending="\r\n\r\n"):
    return f"\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\nContent-Type: text/plain\r\nContent-Length: {len(payload)}\r\n\r\n{payload}{ending}"


def expected(rows):
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        same = [j for j, _, h in rows if (h or "").encode() == body and j is not None]
        revisit = len(body) >= 100 and bool(same) and i != min(same)
        out.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", min(same) if revisit else None))
    return sorted(out, key=repr)


def rows_of(spark, tmp_path, rows, part_bytes, parts=1, name="a"):
    path = f"file://{tmp_path}/{name}"
    warc.write_warc(pages(spark, rows).repartition(parts), path)
    read = warc.read_warc(spark, path, True, part_bytes)
    revisit = warc.field("header", "WARC-Type") == "revisit"
    got = read.select(
        warc.page_of(warc.field("header", "WARC-Record-ID")).cast("long").alias("i"), F.when(revisit, F.col("stated_bytes")).otherwise(F.col("payload_bytes")).alias("n"),
        F.when(revisit, F.substring_index(warc.field("header", "WARC-Payload-Digest"), ":", -1)).otherwise(F.col("payload_digest")).alias("digest"),
        warc.field("header", "WARC-Type").alias("type"), F.when(revisit, warc.page_of(warc.field("header", "WARC-Refers-To")).cast("long")).alias("of"),
    )
    return sorted([tuple(r) for r in got.collect()], key=repr), read


def corpus(seed, n):
    draw = random.Random(seed)
    letters = "abc é日\r\n\t<>"
    rows = [(0, None, None), (1, "http://x/\r\nWARC/1.1\r\n", ""), (2, "u", "\n"), (None, "n", "null id"), (None, "n", "z" * 120)]
    for i in range(3, n):
        body = "".join(draw.choice(letters) for _ in range(draw.choice([0, 5, 99, 100, 400, 3000])))
        for _ in range(draw.choice([0, 0, 1, 3])):
            inner = "".join(draw.choice(letters[:3]) for _ in range(draw.choice([0, 3, 50, 700])))
            body += draw.choice([fake(inner), fake(inner, ""), "\nWARC/1.", "\r\n\r\n\r\nWARC/1.1\r\nContent-Length: 9999999999999\r\n\r\n", "\r\nWARC/1.0\r\nContent-Length: 1\r\n\r\n", "WARC/1.1\r\n"])
            body += draw.choice(["", "tail\r\n\r\n", "\r\n"])
        rows.append((i, f"http://h/{i}?é", draw.choice([body, body, "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc", "same page " * 20, "x" * 99])))
    return rows


@pytest.mark.parametrize(("seed", "part_bytes", "parts"), [(1, 2003, 1), (2, 8192, 2), (3, 1 << 20, 3)])
def test_archives_are_read_back_whole(spark, tmp_path, seed, part_bytes, parts):
    rows = corpus(seed, 40)
    got, read = rows_of(spark, tmp_path, rows, part_bytes, parts)
    assert got == expected(rows)
    bodies = {r["i"]: bytes(r["payload"]).decode() for r in read.filter("header LIKE '%Type: response%'").select(warc.page_of(warc.field("header", "WARC-Record-ID")).alias("i"), "payload").collect()}
    assert all(bodies[str(i)] == (h or "") for i, _, h in rows if i is not None and str(i) in bodies)
    plain = warc.read_warc(spark, f"file://{tmp_path}/a", False, part_bytes)
    columns = ["file", "offset", "header", "payload_bytes", "payload_digest", "stated_bytes"]
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, read.select(*columns).collect()))


def test_offsets_name_the_bytes_of_records(spark, tmp_path):
    rows = corpus(4, 12)
    _, read = rows_of(spark, tmp_path, rows, 900, 1)
    for r in read.collect():
        data = open(urlparse(r["file"]).path, "rb").read()
        assert data[r["offset"] : r["offset"] + 10] == b"WARC/1.1\r\n" and data[r["offset"] :].startswith(r["header"].rstrip("\r\n").encode())


def test_what_follows_a_broken_record_and_a_truncated_end_are_left_out(spark, tmp_path):
    record = lambda i, body, n=None: f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{i}>\r\ncontent-length:{len(body) if n is None else n}\r\n\r\n{body}\r\n\r\n".encode()
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "broken.warc").write_bytes(record(1, "one") + record(2, "two", 5) + record(3, "three"))
    (tmp_path / "b" / "cut.warc").write_bytes(record(4, "four") + record(5, "five" * 50)[:-10])
    (tmp_path / "b" / "not.warc").write_bytes(b"no archive\n" + record(6, "six"))
    (tmp_path / "b" / "empty.warc").write_bytes(b"")
    (tmp_path / "b" / "bytes.warc").write_bytes(b"WARC/1.1\r\nContent-Length: 6\r\n\r\n\xff\xfe\x00\n\r\n\r\n\r\n")
    got = warc.read_warc(spark, f"file://{tmp_path}/b", True, 64)
    found = sorted((warc_id or "", bytes(p)) for warc_id, p in got.select(warc.page_of(warc.field("header", "WARC-Record-ID")), "payload").collect())
    assert found == [("", b"\xff\xfe\x00\n\r\n"), ("1", b"one"), ("2", b"two\r\n"), ("4", b"four")]


def test_compressed_archives_and_empty_tables(spark, tmp_path):
    import gzip

    rows = corpus(5, 20)
    got, _ = rows_of(spark, tmp_path, rows, 1 << 20, 1, "c")
    whole = b"".join(p.read_bytes() for p in (tmp_path / "c").glob("part-*"))
    (tmp_path / "z").mkdir()
    (tmp_path / "z" / "all.warc.gz").write_bytes(gzip.compress(whole[:5000]) + gzip.compress(whole[5000:]))
    assert warc.read_warc(spark, f"file://{tmp_path}/z").count() == len(rows)
    none, _ = rows_of(spark, tmp_path, [], 1 << 20, 1, "d")
    assert none == [] and got == expected(rows)
