import base64
import hashlib

import pytest

from postloom.llm.warc import archive_round_trip, read_archives, write_archives
from postloom.session import scratch_path

FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77:X>\r\nContent-Length: 20\r\n\r\n0123456789ABCDEFGHIJ\r\n\r\n"


def brute(rows, min_bytes=0):
    payload = [(p, (h or "").encode()) for p, _, h in rows]
    last = {}
    for p, b in payload:
        last[b] = max((x for x in (p, last.get(b)) if x is not None), default=None)
    out = []
    for p, b in payload:
        response = p == last[b] or len(b) < min_bytes
        out.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if response else "revisit", None if response else last[b]))
    return sorted(out, key=str)


def rows():
    out = [(i, f"http://h{i % 3}.example.org/{i} x\n", f"<p>{'é' * (i % 50)} page {i % 20}</p>" * (i % 9)) for i in range(200)]
    out += [(300 + i, None, FAKE * (i + 1) + "WARC/1.1\r\n") for i in range(6)]
    out += [(400, "u", "WARC/1.1\r\n"), (401, "u", FAKE[:9] + FAKE), (402, "u", "\r\n\r\n\r\n"), (403, "u", "x" * 60_000 + FAKE + "y" * 60_000 + FAKE + "WARC/1.1\r\n" * 3)]
    out += [(None, None, None), (None, "u", "only a null has this"), (500, "u", ""), (501, "u", None), (501, "u", None)]
    return out


@pytest.mark.parametrize("split", ["128m", "7k", "20k"])
@pytest.mark.parametrize("min_bytes", [0, 25])
def test_round_trip(spark, split, min_bytes):
    if split == "7k" and min_bytes:
        pytest.skip("once is enough")
    keys = {"spark.sql.files.maxPartitionBytes": split, "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        df = spark.createDataFrame([(*r, 1) for r in rows()], "page_id bigint, url string, html string, digest int").coalesce(2)
        got = archive_round_trip(df, min_bytes).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(map(tuple, got), key=str) == brute(rows(), min_bytes)


def test_payloads_and_a_broken_chain(spark):
    path = scratch_path(spark, "warc-test")
    df = spark.createDataFrame([(1, "u", "first"), (2, "u", FAKE + "second"), (3, "u", "third")], "page_id bigint, url string, html string")
    write_archives(df.coalesce(1), path)
    got = {r.page_id: bytes(r.payload) for r in read_archives(spark, path, with_payload=True).collect()}
    assert got == {1: b"first", 2: (FAKE + "second").encode(), 3: b"third"}
    text = "".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    for name, broken in (("cut", text[:-12]), ("gap", "x" + text), ("long", text.replace("Content-Length: ", "Content-Length: 9", 1))):
        spark.createDataFrame([(broken,)], "value string").write.option("lineSep", " ").text(f"{path}-{name}")
    ids = lambda name: sorted(r.page_id for r in read_archives(spark, f"{path}-{name}").collect())
    assert len(ids("cut")) == 2 and ids("gap") == [] and ids("long") == []


def test_no_pages(spark):
    assert archive_round_trip(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0
