"""WARC derivatives: a metadata and a plain-text conversion record for each response record.

Records are rows: record_id, warc_type, target_uri, warc_date, content_type, headers (further named
fields, in order) and block. Derivatives keep the response's identifier (WARC-Refers-To), target and
date, its HTTP header lines and its payload digest; the two are linked by WARC-Concurrent-To.
Each response is read once and makes two rows in the same task; nothing is shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RECORD = (
    "record_id string, warc_type string, target_uri string, warc_date string, content_type string, "
    "headers array<struct<name:string,value:string>>, block binary"
)
_ARROW = pa.schema(
    [
        *[(n, pa.string()) for n in ("record_id", "warc_type", "target_uri", "warc_date", "content_type")],
        ("headers", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))),
        ("block", pa.binary()),
    ]
)
_ROWS = 256

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template)\b.*?(?:</\1\s*>|\Z)"
    r"""|<(/?)([a-z][^\s/<>]*)((?:"[^"]*"|'[^']*'|[^<>"'])*+)>"""
    r"|<[!?][^>]*>",
    re.S | re.I,
)
_LINK = re.compile(r"""(?:^|\s)(?:href|src)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_CHARSET = re.compile(rb"""charset\s*=\s*["']?([a-z0-9_.:-]+)""", re.I)
#: Elements that end a line of text; fixed values.
_BLOCKS = frozenset(
    "address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head "
    "header hr html li main nav ol p pre section table tbody td tfoot th thead title tr ul".split()
)
_LINKED = frozenset(["a", "area", "frame", "iframe", "img", "link"])


def digest(data: bytes) -> str:
    """A labelled digest as WARC writers put it: SHA-1 in base 32."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    """An identifier that follows from its parts."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256('|'.join(parts).encode()).digest()[:16], version=5)}>"


def read_html(text: str) -> tuple[str, str, list[str]]:
    """(title, plain text, link targets) of a page. Scripts, styles and comments are left out.

    A line of text ends at block elements; blanks inside a line are one; empty lines are dropped.
    """
    parts, links, title, at, begin = [], [], "", 0, None
    for m in _MARKUP.finditer(text):
        parts.append(text[at : m.start()])
        at = m.end()
        name = (m[3] or "").lower()
        if name == "title" and not title:
            if not m[2]:
                begin = at
            elif begin is not None:
                title = " ".join(html.unescape(text[begin : m.start()]).split())
        if name in _BLOCKS:
            parts.append("\n")
        if name in _LINKED and not m[2]:
            links += [html.unescape(a or b or c).strip() for a, b, c in _LINK.findall(m[4])]
    parts.append(text[at:])
    lines = (" ".join(x.split()) for x in html.unescape("".join(parts)).split("\n"))
    return title, "\n".join(x for x in lines if x), links


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """(status line, header fields, payload) of an HTTP message; without a head all is payload."""
    head, gap, payload = block.partition(b"\r\n\r\n")
    if not block.startswith(b"HTTP/") or not gap:
        return "", [], block
    status, *lines = head.decode("latin-1").split("\r\n")
    fields = [tuple(x.strip() for x in line.split(":", 1)) for line in lines if ":" in line]
    return status, fields, payload


def _decode(payload: bytes, content_type: str) -> tuple[str, str]:
    found = _CHARSET.search(content_type.encode()) or _CHARSET.search(payload[:2048])
    name = found[1].decode().lower() if found else "utf-8"
    try:
        return name, payload.decode(name, "replace")
    except LookupError:
        return "utf-8", payload.decode("utf-8", "replace")


def _absolute(base: str | None, link: str) -> str:
    try:
        return urljoin(base or "", link)
    except ValueError:
        return link


def _line(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value)


def derive(row: dict) -> list[dict]:
    """The metadata and the conversion record of a response."""
    status, fields, payload = split_http(row["block"] or b"")
    content_type = next((v for n, v in fields if n.lower() == "content-type"), "")
    named = {h["name"].lower(): h["value"] for h in row["headers"] or []}
    source = named.get("warc-payload-digest") or digest(payload)
    charset, text = _decode(payload, content_type)
    if "html" in content_type.lower() or not content_type:
        title, plain, links = read_html(text)
    elif content_type.lower().startswith("text/"):
        title, plain, links = "", text, []
    else:
        title, plain, links = "", None, []  # nothing to convert
    origin = row["record_id"] or ""
    ids = {kind: record_id(kind, origin, source) for kind in ("metadata", "conversion")}
    info = [("source-status", status)] + [("source-header", f"{n}: {v}") for n, v in fields]
    info += [("source-payload-digest", source), ("charset", charset), ("title", title)]
    info += [("outlink", _absolute(row["target_uri"], x)) for x in links]
    lines = "".join(f"{n}: {_line(v)}\r\n" for n, v in info if v).encode()
    out = [("metadata", "application/warc-fields", lines, "conversion" if plain is not None else None)]
    if plain is not None:
        out.append(("conversion", "text/plain; charset=utf-8", plain.encode("utf-8", "replace"), "metadata"))
    records = []
    for kind, form, block, other in out:
        more = [("WARC-Refers-To", origin), ("WARC-Refers-To-Target-URI", row["target_uri"]), ("WARC-Refers-To-Date", row["warc_date"])]
        more += [("WARC-Concurrent-To", ids.get(other)), ("WARC-Block-Digest", digest(block)), ("WARC-Source-Payload-Digest", source)]
        headers = [{"name": n, "value": v} for n, v in more if v]
        records.append(
            {"record_id": ids[kind], "warc_type": kind, "target_uri": row["target_uri"], "warc_date": row["warc_date"]}
            | {"content_type": form, "headers": headers, "block": block}
        )
    return records


def _by_rows(df: DataFrame, make, schema: str, arrow: pa.Schema) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, _ROWS):
                rows = [x for row in batch.slice(i, _ROWS).to_pylist() for x in make(row)]
                yield pa.RecordBatch.from_pylist(rows, arrow)

    return df.mapInArrow(run, schema)


def responses(pages: DataFrame, warc_date: str) -> DataFrame:
    """Response records of fetched pages (page_id, url, html), all of one date.

    A null page is an empty payload, a null URL a record without target. Equal rows give equal
    records, which are all kept. Other columns are ignored.
    """

    def make(row: dict) -> list[dict]:
        payload = (row["html"] or "").encode("utf-8", "replace")
        fields = f"Content-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n"
        block = f"HTTP/1.1 200 OK\r\n{fields}\r\n".encode() + payload
        named = [("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(block))]
        name = record_id("response", str(row["page_id"]), row["url"] or "", warc_date, named[0][1])
        return [
            {"record_id": name, "warc_type": "response", "target_uri": row["url"], "warc_date": warc_date}
            | {"content_type": "application/http; msgtype=response", "block": block}
            | {"headers": [{"name": n, "value": v} for n, v in named]}
        ]

    return _by_rows(pages.select("page_id", "url", "html"), make, RECORD, _ARROW)


def derivatives(records: DataFrame) -> DataFrame:
    """Metadata and conversion records of all response records; records of other types are skipped.

    A payload that is neither HTML nor text has a metadata record only. An empty or missing block
    gives an empty conversion. Repeated responses give repeated derivatives with the same ids. An
    HTTP message without content type is read as HTML.
    """
    names = [f.name for f in records.sparkSession.createDataFrame([], RECORD).schema]
    return _by_rows(records.where("warc_type = 'response'").select(*names), derive, RECORD, _ARROW)


def to_bytes(row: dict) -> bytes:
    """A record as it stands in a file."""
    block = row["block"] or b""
    head = [("WARC-Type", row["warc_type"]), ("WARC-Record-ID", row["record_id"]), ("WARC-Date", row["warc_date"])]
    head += [("WARC-Target-URI", row["target_uri"]), *((h["name"], h["value"]) for h in row["headers"] or [])]
    head += [("Content-Type", row["content_type"]), ("Content-Length", str(len(block)))]
    lines = "".join(f"{n}: {_line(v)}\r\n" for n, v in head if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def from_bytes(record: bytes) -> dict:
    """The row of a record's bytes."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = [tuple(x.strip() for x in line.split(":", 1)) for line in lines if ":" in line]
    first = {}
    for n, v in fields:
        first.setdefault(n.lower(), v)
    own = {"warc-type", "warc-record-id", "warc-date", "warc-target-uri", "content-type", "content-length"}
    return {
        "record_id": first.get("warc-record-id"),
        "warc_type": first.get("warc-type"),
        "target_uri": first.get("warc-target-uri"),
        "warc_date": first.get("warc-date"),
        "content_type": first.get("content-type"),
        "headers": [{"name": n, "value": v} for n, v in fields if n.lower() not in own],
        "block": rest[: int(first.get("content-length", len(rest)))],
    }


def serialize(records: DataFrame) -> DataFrame:
    """``record``: the bytes of each record. Concatenated they are a WARC file."""
    return _by_rows(records, lambda row: [{"record": to_bytes(row)}], "record binary", pa.schema([("record", pa.binary())]))


def parse(files: DataFrame) -> DataFrame:
    """Records of a column ``record`` with the bytes of one record each; null is skipped."""
    return _by_rows(files.where("record is not null").select("record"), lambda r: [from_bytes(r["record"])], RECORD, _ARROW)


def field(name: str):
    """The first of the further named fields of that name."""
    return F.filter("headers", lambda h: h["name"] == name)[0]["value"]
