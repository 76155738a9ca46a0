import base64
import gzip
import hashlib

import duckdb
from conftest import SMALL
from helpers import rows_of, same

from stackyard.llm import warc
from stackyard.llm.queries import ORACLES, QUERIES
from stackyard.session import scratch_path

SCHEMA = "page_id bigint, url string, html string, id string, sha string, top int, shared int, file string, `a.b` int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1, 2, "f", 3) for r in rows], SCHEMA)


def b32(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def expected(rows, min_bytes=0):
    out = []
    for key, url, html in rows:
        n = len((html or "").encode())
        ids = [k for k, _, h in rows if (h or "") == (html or "") and k is not None]
        top = max(ids, default=None)
        revisit = n >= min_bytes and top is not None and key != top
        out.append((key, url, n, b32(html), "revisit" if revisit else "response", top if revisit else None, True))
    return ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact"], out


EDGE = [(1, "http://a/?q=100%25 x", "same"), (2, "http://b/", "same"), (3, None, "same"), (4, "http://é/日本\r\nX: y", None),
        (5, "", ""), (6, "http://c/", "Grüße 😀\u0000 \r\n\r\nWARC/1.1\r\n"), (None, "http://n/", "same"),
        (None, "http://m/", "alone"), (None, "http://m/", "alone"), (7, "http://t/", "tie"), (7, "http://u/", "tie"),
        (8, "http://d/", "a longer payload"), (9, "http://d/", "a longer payload")]


def test_warc_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SMALL}/pages.parquet'")
    cur = con.execute(ORACLES["op11_warc"])
    assert same(QUERIES["op11_warc"](spark, SMALL), ([d[0] for d in cur.description], cur.fetchall()))


def test_warc_edge_rows(spark):
    for least in (0, 5):
        got = warc.archive_roundtrip(pages(spark, EDGE), min_bytes=least)
        cols, rows = expected(EDGE, least)
        assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(cols, rows)


def test_warc_sql_agrees_on_repeated_payloads(spark, tmp_dir):
    rows = [(i, f"http://h/{i}", None if i % 7 == 0 else f"page {i % 5}") for i in range(40)]
    pages(spark, rows).select("page_id", "url", "html").write.parquet(f"{tmp_dir}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_dir}/pages.parquet/*.parquet'")
    cur = con.execute(ORACLES["op11_warc"])
    assert same(QUERIES["op11_warc"](spark, tmp_dir), ([d[0] for d in cur.description], cur.fetchall()))


def test_warc_empty_table(spark):
    got = warc.archive_roundtrip(pages(spark, []))
    assert got.columns == expected([])[0] and got.count() == 0


def test_warc_files_are_gzip_members_at_the_indexed_places(spark):
    root = scratch_path(spark, "warc-test")
    index = warc.write_archive(pages(spark, EDGE), root).collect()
    fs, base = warc.filesystem(root)
    for name in {r.file for r in index}:
        data = fs.open_input_file(f"{base}/{name}").read()
        places = sorted((r.offset, r.length) for r in index if r.file == name)
        assert places[0][0] == 0 and places[-1][0] + places[-1][1] == len(data)
        assert all(a + n == b for (a, n), (b, _) in zip(places, places[1:]))
        assert gzip.decompress(data).count(b"WARC-Type: ") == len(places)


def test_warc_selected_records_and_small_files(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2000)
    monkeypatch.setattr(warc, "RANGE", 1500)
    rows = [(i, f"http://h/{i}", f"page {i} " + "word " * (i % 90)) for i in range(200)]
    root = scratch_path(spark, "warc-test")
    index = warc.write_archive(pages(spark, rows), root)
    assert index.select("file").distinct().count() > 5
    picked = index.where("id % 3 = 1")
    got = {r.id: (r.url, bytes(r.payload).decode(), r.intact) for r in warc.read_records(picked, root).collect()}
    assert got == {i: (u, h, True) for i, u, h in rows if i % 3 == 1}


def test_warc_one_hot_payload_and_a_long_one(spark):
    rows = [(i, "http://h/", "hot") for i in range(600)] + [(1000 + i, None, str(i)) for i in range(600)]
    rows.append((5000, "http://long/", "long " * 1_000_000))
    got = warc.archive_roundtrip(pages(spark, rows))
    assert got.where("record_type = 'revisit' AND refers_to = 599 AND payload_bytes = 3").count() == 599
    assert got.where("record_type = 'response' AND intact").count() == 602
    assert got.where("payload_bytes = 5000000").count() == 1


def test_warc_ranges_join_neighbours_only():
    places = [(0, 10), (10, 10), (20 + warc.GAP, 5), (26 + 3 * warc.GAP, 5), (26 + 3 * warc.GAP + 5, warc.RANGE)]
    assert warc.ranges(places) == [(0, 3, 0, 25 + warc.GAP), (3, 4, 26 + 3 * warc.GAP, 31 + 3 * warc.GAP),
                                   (4, 5, 31 + 3 * warc.GAP, 31 + 3 * warc.GAP + warc.RANGE)]
