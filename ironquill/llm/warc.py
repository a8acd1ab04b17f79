"""Derivatives of WARC responses: a metadata and a plain-text conversion record of each.

Both name the response that they refer to, carry its target, date and digest,
and name each other. Identifiers follow from what a record says, so that a
task that runs twice makes the same records.
"""

from __future__ import annotations

import base64
import hashlib
import html as entities
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ironquill.llm.html_blocks import BLOCK

END = "\r\n"
#: Names under which identifiers are made.
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_SILENT = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)
_BREAK = re.compile(r"</?(?:" + "|".join(sorted(BLOCK | {"br", "title", "head"})) + r")\b[^>]*>", re.I)
_TAG = re.compile(r"<[/!?a-zA-Z][^>]*>")
_TITLE, _TITLE_END = re.compile(r"<title\b[^>]*>", re.I), re.compile("</title", re.I)
_LINKING = re.compile(r"<(a|area|link|img|iframe|script|source)\b", re.I)
_ADDRESS = re.compile(r"""\b(href|src)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
RESPONSE = "record_id string, target_uri string, date string, http_headers string, payload binary"
DERIVED = ("record_id string, type string, refers_to string, concurrent_to string, target_uri string, date string, content_type string, "
           "content_length long, block_digest string, source_digest string, headers string, block string")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, chr(31).join(parts))}>"


def _without(tags: re.Pattern[str], by: str, page: str) -> str:
    """The page with each of these tags replaced; no tag ends behind the last ``>``, so none is looked for there."""
    end = page.rfind(">") + 1
    return tags.sub(by, page[:end]) + page[end:]


def plain_text(page: str) -> str:
    """Visible text, one line for each block."""
    page = _without(_TAG, "", _without(_BREAK, "\n", _SILENT.sub(" ", page)))
    lines = (" ".join(x.split()) for x in entities.unescape(page).split("\n"))
    return "\n".join(x for x in lines if x)


def _links(page: str) -> Iterator[tuple[str, str, str]]:
    """Element, attribute and address of each link: one pass over elements and one over addresses, side by side."""
    address = _ADDRESS.search(page)
    element = _LINKING.search(page)
    while element and address:
        if address.start() < element.end():
            address = _ADDRESS.search(page, element.end())
            continue
        close = page.find(">", element.end())
        if close < 0 or address.start() < close:
            yield element[1].lower(), address[1].lower(), next((g for g in address.groups()[1:] if g), "")
            close = address.end()
        element = _LINKING.search(page, close)


def page_facts(page: str) -> dict:
    """Title and links, in page order."""
    opened = _TITLE.search(page, 0, page.rfind(">") + 1)
    closed = opened and _TITLE_END.search(page, opened.end())
    title = " ".join(entities.unescape(page[opened.end() : closed.start()]).split()) if opened and closed else None
    return {"title": title, "links": [{"path": f"{tag}@{name}", "url": entities.unescape(url)} for tag, name, url in _links(page)]}


def header_fields(block: str) -> dict[str, list[str]]:
    """Header lines by name; a name that repeats keeps all its values, and folded lines are joined."""
    out: dict[str, list[str]] = {}
    last = None
    for line in block.splitlines()[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last][-1] += " " + line.strip()
        elif ":" in line:
            last, value = line.split(":", 1)
            last = last.strip()
            out.setdefault(last, []).append(value.strip())
    return out


def decode_payload(payload: bytes, headers: dict[str, list[str]]) -> str:
    kind = " ".join(v for k, vs in headers.items() if k.lower() == "content-type" for v in vs)
    named = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", kind, re.I)
    try:
        return payload.decode(named[1] if named else "utf-8", "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def derive(source: dict) -> list[dict]:
    """The metadata and the conversion record of one response."""
    payload, headers = source["payload"] or b"", header_fields(source["http_headers"] or "")
    uri, of, date = source["target_uri"] or "", source["record_id"] or "", source["date"] or ""
    page, found = decode_payload(payload, headers), digest(payload)
    ids = {kind: record_id(kind, of, uri, date, found) for kind in ("metadata", "conversion")}
    facts = {"source": {"WARC-Record-ID": of, "WARC-Target-URI": uri, "WARC-Date": date, "WARC-Payload-Digest": found, "Content-Length": len(payload)},
             "http": {"status": (source["http_headers"] or "").split(END, 1)[0].split("\n", 1)[0], "headers": headers}, "html": page_facts(page)}
    blocks = {"metadata": ("application/json", json.dumps(facts, ensure_ascii=False, sort_keys=True)), "conversion": ("text/plain; charset=utf-8", plain_text(page))}
    out = []
    for kind, other in (("metadata", "conversion"), ("conversion", "metadata")):
        content_type, block = blocks[kind]
        data = block.encode("utf-8", "replace")
        fields = {"WARC-Type": kind, "WARC-Record-ID": ids[kind], "WARC-Refers-To": of, "WARC-Refers-To-Target-URI": uri, "WARC-Refers-To-Date": date,
                  "WARC-Concurrent-To": ids[other], "WARC-Target-URI": uri, "WARC-Date": date, "WARC-Source-Payload-Digest": found,
                  "WARC-Block-Digest": digest(data), "Content-Type": content_type, "Content-Length": str(len(data))}
        head = "WARC/1.1" + END + "".join(f"{k}: {' '.join(v.split())}{END}" for k, v in fields.items())
        out.append({"record_id": ids[kind], "type": kind, "refers_to": of, "concurrent_to": ids[other], "target_uri": uri, "date": date,
                    "content_type": content_type, "content_length": len(data), "block_digest": fields["WARC-Block-Digest"], "source_digest": found,
                    "headers": head, "block": block})
    return out


def responses_of_pages(pages: DataFrame, date: str = "2000-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Response records of a table of pages, which keeps no headers: they are those of a plain answer. A null page is empty."""
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    digest_of = F.md5(F.concat_ws("\x1f", F.lit("response"), F.col(id_col).cast("string"), F.coalesce(F.col(url_col), F.lit("")), F.lit(date)))
    parts = [F.substring(digest_of, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.octet_length(payload).cast("string"), F.lit(END))
    return pages.select(F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">")).alias("record_id"), F.col(url_col).alias("target_uri"),
                        F.lit(date).alias("date"), head.alias("http_headers"), payload.alias("payload"))


def derivatives(responses: DataFrame) -> DataFrame:
    """Two rows, as in ``DERIVED``, for each row of ``RESPONSE``; rows that repeat give records that repeat."""
    names = [c.split()[0] for c in DERIVED.split(", ")]
    columns = [c.split()[0] for c in RESPONSE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = [r for x in batch.slice(at, 256).to_pylist() for r in derive(x)]
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], pa.int64() if n == "content_length" else pa.string()) for n in names], names)

    return responses.select(*columns).mapInArrow(run, DERIVED)


def record_bytes(headers: str, block: bytes) -> bytes:
    """A record as it stands in a file."""
    return headers.encode() + END.encode() + block + 2 * END.encode()


def members(data: bytes) -> Iterator[bytes]:
    """An uncompressed file as it is, a compressed one gzip member by member; a damaged member reads as a record without a header."""
    while data[:2] == b"\x1f\x8b":
        one = zlib.decompressobj(31)
        try:
            yield one.decompress(data) + one.flush()
        except zlib.error:
            yield b"WARC/"
            return
        data = one.unused_data
    if data:
        yield data


def split_records(data: bytes) -> Iterator[tuple[dict[str, list[str]], bytes | None]]:
    """Header fields and block of each record; the block is null where the record has no usable length, or ends before it.

    After such a record the next one is looked for behind its header.
    """
    at = 0
    while (start := data.find(b"WARC/", at)) >= 0:
        stop = data.find(b"\r\n\r\n", start)
        if stop < 0:
            yield header_fields(data[start:].decode("utf-8", "replace")), None
            return
        fields = header_fields(data[start:stop].decode("utf-8", "replace"))
        length = next((v[0].strip() for k, v in fields.items() if k.lower() == "content-length"), "")
        at = stop + 4
        if not (length.isascii() and length.isdigit()) or at + int(length) > len(data):
            yield fields, None
            continue
        yield fields, data[at : at + int(length)]
        at += int(length)


def _read(spark: SparkSession, path: str, rejects: bool) -> DataFrame:
    schema = "path string, headers string" if rejects else RESPONSE
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for part in members(content.as_py()):
                    rows = []
                    for fields, block in split_records(part):
                        one = lambda k, fields=fields: fields.get(k, [""])[0]
                        if rejects and block is None:
                            rows.append((file, json.dumps(fields)))
                        elif not rejects and block is not None and one("WARC-Type") == "response":
                            head, _, payload = block.partition(b"\r\n\r\n")
                            rows.append((one("WARC-Record-ID"), one("WARC-Target-URI"), one("WARC-Date"), head.decode("latin-1") + END, payload))
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.binary() if n == "payload" else pa.string()) for i, n in enumerate(names)], names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Responses of the WARC files at ``path``, plain or as gzip members, one task for each file (of at most 2 GB)."""
    return _read(spark, path, rejects=False)


def read_rejects(spark: SparkSession, path: str) -> DataFrame:
    """``path, headers`` (JSON) of the records that :func:`read_responses` cannot use: no length, or cut short."""
    return _read(spark, path, rejects=True)
