from __future__ import annotations

import base64
import gzip
import hashlib
import re

import pytest

from framewright.llm import warc as W
from framewright.llm.q07_warc import ORACLE_SQL, op7_warc
from tests.compare import canonical, duck

SF = "/root/testdata/sf0.001"


def test_query_agrees_with_sql(spark):
    assert canonical(op7_warc(spark, SF).toPandas()) == canonical(duck(SF, ORACLE_SQL["op7_warc"]))


@pytest.mark.parametrize("most", [W.BROADCAST_ROWS, 0])
def test_revisits_and_edge_cases(spark, monkeypatch, most):
    monkeypatch.setattr(W, "BROADCAST_ROWS", most)
    long, other = "é" * 500, "x" * 5_000_000
    rows = [(1, "u", long), (7, "u\nv", long), (3, None, long), (2, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (8, "u", other), (9, "u", other), (9, "u", other), (None, "u", long)]
    pages = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, original string").repartition(3)
    got = sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to, r.payload_digest) for r in W.report(pages).collect())
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        target = {long: 7, other: 9}.get(html)
        revisit = target is not None and i != target
        want.append((i or 0, len(data), "revisit" if revisit else "response", target if revisit else None, hashlib.sha1(data).hexdigest()))
    assert got == sorted(want, key=str) or sorted(got, key=str) == sorted(want, key=str)
    assert W.report(pages.limit(0)).count() == 0


def test_records_round_trip_and_revisits_hold_no_payload(spark, tmp_path):
    body = b"<html>\r\n\r\nWARC/1.1\r\n</html>"
    data = W.record(5, "http://a/ b", "response", None, "d", body)
    (one,) = W.members(data)
    head, block = W.parse(one)
    assert head["warc-type"] == "response" and head["warc-target-uri"] == "http://a/ b" and block.partition(b"\r\n\r\n")[2] == body
    revisit = W.record(4, "u", "revisit", 5, "d", body)
    head, block = W.parse(next(W.members(revisit)))
    assert head["x-refers-to-page"] == "5" and body not in block and head["warc-profile"] == W.PROFILE
    assert len(list(W.members(data + revisit))) == 2
    archives = W.deduplicate(spark.createDataFrame([(1, "u", "a"), (2, "u", "b")], "page_id long, url string, html string").coalesce(1))
    W.export_files(archives, str(tmp_path))
    assert sum(len(list(W.members(p.read_bytes()))) for p in tmp_path.iterdir()) == 2


def test_payloads_are_not_shuffled(spark):
    """No exchange holds payloads: headers alone are gathered by digest, and revisits are written without."""
    pages = spark.createDataFrame([(i, "u", "x" * 1000 if i % 2 else f"{i}" * 500) for i in range(50)], "page_id long, url string, html string").repartition(3)
    pages = W.saved(pages, "pages")
    plan = W.settled(W.crawl_records(pages))._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():
        assert not re.search(r"\bExchange\b", line) or "html" not in line and "payload#" not in line
    assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") <= 1  # keys of revisits, made distinct
    rows = W.settled(W.crawl_records(pages)).collect()
    assert sorted(r.page_id for r in rows) == list(range(50)) and all((r.payload is None) == (r.record_type == "revisit") for r in rows)


def test_archives_of_other_writers(spark):
    """warcinfo and requests are passed over, a revisit is resolved by the record that it names, else by its digest, in hex or base 32."""
    body = b"hello world"
    sha = hashlib.sha1(body)

    def one(kind, block, **fields):
        lines = ["WARC/1.0", f"WARC-Type: {kind}", *(f"{k.replace('_', '-')}: {v}" for k, v in fields.items()), f"Content-Length: {len(block)}"]
        return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")

    http = b"HTTP/1.1 200 OK\r\n\r\n"
    records = [
        one("warcinfo", b"software: x", WARC_Record_ID="<w>"),
        one("request", b"GET / HTTP/1.1\r\n\r\n", WARC_Target_URI="u", WARC_Record_ID="<q>"),
        one("response", http + body, WARC_Target_URI="u", WARC_Record_ID="<a>", Content_Type="application/http;msgtype=response"),
        one("resource", b"plain\r\n\r\ntext", WARC_Target_URI="r", WARC_Record_ID="<b>", Content_Type="text/plain"),
        one("revisit", http, WARC_Target_URI="v", WARC_Refers_To="<b>", WARC_Payload_Digest="sha1:" + "0" * 40),
        one("revisit", http, WARC_Target_URI="h", WARC_Payload_Digest="sha1:" + sha.hexdigest().upper()),
        one("revisit", http, WARC_Target_URI="i", WARC_Refers_To="<gone>", WARC_Payload_Digest="sha1:" + base64.b32encode(sha.digest()).decode()),
        one("revisit", http, WARC_Target_URI="n"),
    ]
    archives = spark.createDataFrame([("x", b"".join(records))], "archive string, content binary")
    found = {r.url: r for r in W.resolve(W.read_archives(archives)).collect()}
    assert {u: (r.record_type, r.payload_bytes) for u, r in found.items()} == {"u": ("response", 11), "r": ("resource", 13), "v": ("revisit", 13), "h": ("revisit", 11), "i": ("revisit", 11), "n": ("revisit", None)}
    assert found["i"].payload_digest == found["u"].payload_digest == sha.hexdigest() and found["u"].page_id is None
