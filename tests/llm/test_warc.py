import base64
import hashlib

from ticketloom.llm import warc

PAGE = (
    '<!DOCTYPE html><html><head><title>A &amp; B\n</title><style>p{}</style><script>var t="</p>";</script></head><body><!-- x > y -->'
    '<p>One <b>two</b>&nbsp;three<br>four</p><a href="/q?a=1&amp;b=2">link</a><img src=pic.png alt="a > b"><div>é &lt;tag&gt;</div></body>'
)


def named(row):
    return {h.name: h.value for h in row.headers}


def test_page_text_and_links():
    title, text, links = warc.read_html(PAGE)
    assert title == "A & B" and links == ["/q?a=1&b=2", "pic.png"]
    assert text == "A & B\nOne two three\nfour\nlink\né <tag>"
    assert warc.read_html("") == ("", "", []) and warc.read_html("a <!-- open") == ("", "a", [])
    assert warc.read_html("<script>x" + "<a " * 2000)[1] == "" and warc.read_html("1 < 2 <") == ("", "1 < 2 <", [])


def test_derivatives_refer_to_their_response(spark):
    pages = spark.createDataFrame(
        [(1, "http://x.org/a/b", PAGE, 1), (1, "http://x.org/a/b", PAGE, 1), (2, None, None, 1), (None, "http://[bad", "plain", 1)],
        "page_id long, url string, html string, block int",
    )
    source = warc.responses(pages, "2024-01-01T00:00:00Z")
    found = warc.derivatives(source)
    assert source.count() == 4 and found.count() == 8
    ids = {r.record_id: r for r in source.collect()}
    for r in found.collect():
        origin, fields = ids[named(r)["WARC-Refers-To"]], named(r)
        assert (r.target_uri, r.warc_date) == (origin.target_uri, origin.warc_date)
        assert fields["WARC-Block-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(r.block).digest()).decode()
        assert fields["WARC-Source-Payload-Digest"] == named(origin)["WARC-Payload-Digest"]
    of = {(r.warc_type, r.target_uri): r for r in found.collect()}
    text, info = of["conversion", "http://x.org/a/b"], of["metadata", "http://x.org/a/b"]
    assert text.block.decode().endswith("é <tag>") and text.content_type == "text/plain; charset=utf-8"
    assert named(text)["WARC-Concurrent-To"] == info.record_id and named(info)["WARC-Concurrent-To"] == text.record_id
    lines = info.block.decode().split("\r\n")
    assert "outlink: http://x.org/q?a=1&b=2" in lines and "source-header: Content-Type: text/html; charset=utf-8" in lines
    assert of["conversion", None].block == b""
    assert warc.derivatives(source.limit(0)).count() == 0 and warc.derivatives(found).count() == 0


def test_other_payloads(spark):
    def response(head, body):
        return {"record_id": "<urn:x>", "warc_type": "response", "target_uri": "http://x/", "warc_date": "d", "content_type": "", "headers": None, "block": head + b"\r\n\r\n" + body}

    kinds = lambda r: [(x["warc_type"], x["block"]) for x in warc.derive(r)]
    image = kinds(response(b"HTTP/1.1 200 OK\r\nContent-Type: image/png", b"\x89"))
    assert [k for k, _ in image] == ["metadata"]
    latin = kinds(response(b"HTTP/1.1 200 OK\r\nContent-Type: text/plain; charset=iso-8859-1", b"\xe9<b>"))
    assert latin[1] == ("conversion", "é<b>".encode())
    odd = kinds(response(b"HTTP/1.1 404 Not Found\r\nContent-Type: text/html; charset=no-such", b"<p>gone"))
    assert odd[1] == ("conversion", b"gone") and b"source-status: HTTP/1.1 404 Not Found" in odd[0][1]
    assert warc.derive({**response(b"", b""), "block": None})[1]["block"] == b""


def test_records_survive_their_file_form(spark):
    pages = spark.createDataFrame([(1, "http://x.org/é", PAGE), (2, None, None)], "page_id long, url string, html string")
    source = warc.responses(pages, "2024-01-01T00:00:00Z")
    records = source.union(warc.derivatives(source))
    again = warc.parse(warc.serialize(records))
    show = lambda df: sorted(str(r.asDict(True)) for r in df.collect())
    assert show(again) == show(records)
    raw = warc.serialize(source).first().record
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and raw.endswith(b"\r\n\r\n")
