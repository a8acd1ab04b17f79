import gzip
import html
import json
import random
import re
import time

from ironquill.llm import warc as W

PAGE = """<html><head><title>A &amp; B</title><script>no()</script></head><body><h1>Head</h1><p>One <b>two</b><br>three &eacute;</p>
<a href="/x?a=1&amp;b=2">go</a><img src='i.png'><!-- <a href="no">no</a> --></body></html>"""


def pages(spark):
    return spark.createDataFrame([(1, "http://e.example/1", PAGE, "c"), (2, None, None, "c"), (None, "u", "", "c"), (3, "u", "plain", "c"), (3, "u", "plain", "c")],
                                 "page_id long, url string, html string, type string")


def test_links_and_digests(spark):
    responses = {r["record_id"]: r for r in W.responses_of_pages(pages(spark)).collect()}
    rows = W.derivatives(W.responses_of_pages(pages(spark))).collect()
    assert len(rows) == 10 and len(responses) == 4
    by_id = {r["record_id"]: r for r in rows}
    for r in rows:
        source, other = responses[r["refers_to"]], by_id[r["concurrent_to"]]
        assert other["type"] != r["type"] and other["concurrent_to"] == r["record_id"] and other["refers_to"] == r["refers_to"]
        assert r["source_digest"] == W.digest(bytes(source["payload"])) and r["block_digest"] == W.digest(r["block"].encode())
        assert r["content_length"] == len(r["block"].encode()) and r["date"] == source["date"] and (r["target_uri"] or "") == (source["target_uri"] or "")
    one = {r["type"]: r for r in rows if r["target_uri"] == "http://e.example/1"}
    assert one["conversion"]["block"] == "A & B\nHead\nOne two\nthree é\ngo"
    facts = json.loads(one["metadata"]["block"])
    assert facts["html"]["title"] == "A & B" and [x["url"] for x in facts["html"]["links"]][:2] == ["/x?a=1&b=2", "i.png"]
    assert facts["source"]["WARC-Record-ID"] == one["metadata"]["refers_to"] and facts["http"]["headers"]["Content-Type"] == ["text/html; charset=utf-8"]


def test_records_round_trip(spark, tmp_path):
    rows = W.derivatives(W.responses_of_pages(pages(spark))).collect()
    data = b"".join(W.record_bytes(r["headers"], r["block"].encode()) for r in rows)
    back = list(W.split_records(data))
    assert [(f["WARC-Record-ID"][0], f["WARC-Refers-To"][0], b.decode()) for f, b in back] == [(r["record_id"], r["refers_to"], r["block"]) for r in rows]


def test_responses_from_a_file(spark, tmp_path):
    source = W.responses_of_pages(pages(spark)).collect()
    records = []
    for r in source:
        block = r["http_headers"].encode() + b"\r\n" + bytes(r["payload"])
        head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: {r['record_id']}\r\nWARC-Target-URI: {r['target_uri'] or ''}\r\nWARC-Date: {r['date']}\r\nContent-Length: {len(block)}\r\n"
        records.append(W.record_bytes(head, block))
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    read = W.read_responses(spark, str(tmp_path))
    assert sorted((r["record_id"], bytes(r["payload"])) for r in read.collect()) == sorted((r["record_id"], bytes(r["payload"])) for r in source)
    assert sorted(r["block"] for r in W.derivatives(read).collect() if r["type"] == "conversion") == sorted(
        r["block"] for r in W.derivatives(W.responses_of_pages(pages(spark))).collect() if r["type"] == "conversion")


def test_header_lines():
    assert W.header_fields("HTTP/1.1 200 OK\r\nSet-Cookie: a\r\nSet-Cookie: b\r\nX: 1\r\n  2\r\nbad line") == {"Set-Cookie": ["a", "b"], "X": ["1 2"]}
    assert W.decode_payload("é".encode("latin-1"), {"content-type": ["text/html; charset=ISO-8859-1"]}) == "é"
    assert W.decode_payload(b"\xff", {"Content-Type": ["text/html; charset=no-such"]}) == "�"
    assert W.plain_text("a<script>x") == "a" and W.plain_text("1 < 2 <b>and</b> 3") == "1 < 2 and 3"


def test_bad_records_are_rejects(spark, tmp_path):
    good = lambda i: W.record_bytes(f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: {i}\r\nContent-Length: 6\r\n", b"A\r\n\r\nxy"[:6])
    bad = [b"WARC/1.1\r\nWARC-Record-ID: none\r\n\r\nblock\r\n\r\n", b"WARC/1.1\r\nWARC-Record-ID: word\r\nContent-Length: x\r\n\r\nblock\r\n\r\n",
           b"WARC/1.1\r\nWARC-Record-ID: long\r\nContent-Length: 99999\r\n\r\nblock\r\n\r\n"]
    plain = good(1) + bad[0] + good(2) + bad[1] + bad[2] + good(3)
    (tmp_path / "a.warc").write_bytes(plain)
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(x) for x in (good(4), bad[1], good(5))) + b"\x1f\x8bdamaged")
    (tmp_path / "empty.warc").write_bytes(b"")
    assert sorted(r["record_id"] for r in W.read_responses(spark, str(tmp_path)).collect()) == list("12345")
    found = sorted(json.loads(r["headers"]).get("WARC-Record-ID", [""])[0] for r in W.read_rejects(spark, str(tmp_path)).collect())
    assert found == ["", "long", "none", "word", "word"]


def test_empty_table(spark):
    assert W.derivatives(W.responses_of_pages(pages(spark).limit(0))).count() == 0


def test_tags_and_links_against_plain_patterns():
    """The linear scanners find what one pattern over the whole page does, broken markup included."""
    link = re.compile(r"""<(a|area|link|img|iframe|script|source)\b[^>]*?\b(href|src)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
    title = re.compile(r"<title\b[^>]*>(.*?)</title", re.S | re.I)
    rng = random.Random(4)
    parts = ["<a ", "<A", "<img", "<area", "<abbr ", "href", "src", "=", " = ", '"', "'", ">", "<", "x", " ", "&amp;", "<title>", "<title", "</title", "</p>", "<p", "data-href=y", "href=z", "src='q>r'", 'href="u">']
    for _ in range(20_000):
        page = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        facts = W.page_facts(page)
        assert [(x["path"], x["url"]) for x in facts["links"]] == [
            (f"{m[1].lower()}@{m[2].lower()}", html.unescape(m[3] or m[4] or m[5] or "")) for m in link.finditer(page)], page
        want = title.search(page)
        assert facts["title"] == (" ".join(html.unescape(want[1]).split()) if want else None), page
        assert W._without(W._TAG, "", page) == W._TAG.sub("", page) and W._without(W._BREAK, "\n", page) == W._BREAK.sub("\n", page)


def test_long_runs_of_open_tags_take_linear_time():
    start = time.perf_counter()
    for run in ("<a ", "<a href ", "<p ", "<title>", "<title ", "href=x ", "<a x='", "</"):
        page = run * (1_000_000 // len(run))
        W.page_facts(page)
        W.plain_text(page)
    assert time.perf_counter() - start < 30
