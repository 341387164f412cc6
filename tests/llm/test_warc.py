import base64
import gzip
import hashlib
import os
from urllib.parse import urlparse

from rillmesh.llm import common, warc

PAGES = [(1, "http://a/", "<p>same</p>"), (2, "http://b/\r\n x", "<p>same</p>"), (3, None, None), (4, "http://d/", ""), (5, "http://e/", "é" * 1000), (6, "http://f/", "\r\n\r\nWARC/1.1\r\n"), (7, "http://g/", "solo"), (7, "http://g/", "solo"), (None, "http://n/", "<p>same</p>"), (None, "http://m/", "only null")]


def table(spark, rows=PAGES):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as payload", "0 as keeper")


def brute(rows, least=0):
    out = []
    for page, _, html in rows:
        body = (html or "").encode()
        ids = [p for p, _, h in rows if (h or "").encode() == body and p is not None]
        keeper = max(ids, default=None)
        again = len(body) >= least and keeper is not None and keeper != page
        out.append((page, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", keeper if again else None))
    return sorted(out, key=str)


def read(spark, rows=PAGES, **options):
    folder = common.fresh_dir(spark, "warc")
    index = warc.write(table(spark, rows), folder, **options)
    got = warc.read(index, folder)
    return folder, index, got


def test_round_trip_with_odd_rows(spark):
    for options in ({}, {"broadcast_rows": 0}, {"roll_bytes": 1}, {"least_bytes": 5}):
        _, _, got = read(spark, **options)
        assert sorted(map(tuple, got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str) == brute(PAGES, options.get("least_bytes", 0))
    bodies = {r["page_id"]: r["payload"] for r in got.collect()}
    assert bytes(bodies[5]) == ("é" * 1000).encode() and bytes(bodies[6]) == b"\r\n\r\nWARC/1.1\r\n"


def test_files_are_plain_multi_member_gzip(spark):
    folder, index, _ = read(spark)
    base = urlparse(folder).path + "/archive"
    data = b"".join(gzip.decompress(open(f"{base}/{f}", "rb").read()) for f in sorted(os.listdir(base)) if f.endswith(".gz"))
    assert data.count(b"WARC/1.1\r\nWARC-Type: ") == len(PAGES)
    rows = index.orderBy("file", "offset").collect()
    assert all(a["file"] != b["file"] or a["offset"] + a["length"] == b["offset"] for a, b in zip(rows, rows[1:], strict=False))


def test_selected_records_only(spark):
    folder, index, _ = read(spark)
    got = warc.read(index.where("page_id in (5, 6)"), folder, range_bytes=64, gap_bytes=0)
    assert sorted(r["page_id"] for r in got.collect()) == [5, 6]


def test_a_lost_attempt_is_not_read(spark):
    folder, index, _ = read(spark)
    base = urlparse(folder).path + "/archive"
    with open(f"{base}/part-99999-0000-dead.warc.gz", "wb") as f:
        f.write(b"half a member")
    assert warc.read(index, folder).count() == len(PAGES)


def test_empty_table(spark):
    folder, index, got = read(spark, [])
    assert index.count() == 0 and got.count() == 0
