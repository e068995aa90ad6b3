"""WARC derivatives: from response records, linked metadata and plain-text conversion records.

Both derived records name their response in WARC-Refers-To and keep its target URI, date and payload digest (in the
extension field WARC-Refers-To-Payload-Digest); the metadata record also keeps the response's HTTP headers, title, language and links as warc-fields lines.
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

DATE = "2024-01-01T00:00:00Z"
COLUMNS = (
    "warc_type string, record_id string, refers_to string, target_uri string, date string, content_type string, "
    "block_digest string, refers_to_payload_digest string, content_length long, content string, record binary"
)
#: What these hold is not seen; what these begin or end stands on lines of its own.
_UNSEEN = {x: re.compile(rf"</{x}\s*>", re.I) for x in ("script", "style", "noscript", "template")}
_BLOCKS = frozenset(
    "address article aside blockquote body br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main "
    "nav ol option p pre section select table tbody td tfoot th thead title tr ul".split()
)
_EDGES = _BLOCKS | {f"/{x}" for x in _BLOCKS}
_NAME = re.compile(r"[A-Za-z][A-Za-z0-9]*")
_LANG = re.compile(r"\slang\s*=\s*[\"']?([A-Za-z0-9-]+)", re.I)
_HREF = re.compile(r"\shref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w-]+)", re.I)


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def _events(markup: str) -> Iterator[tuple[str, str]]:
    """("", text), and (name, attributes) of each tag that is seen, in one pass; /name where an element ends.

    A comment, script or the like that doesn't end hides the rest; a tag that doesn't end is text.
    """
    at, find, named = 0, markup.find, _NAME.match
    while (begin := find("<", at)) >= 0:
        if begin > at:
            yield "", markup[at:begin]
        first = begin + 1 + markup.startswith("/", begin + 1)
        name = named(markup, first)
        if not name:
            if markup.startswith("<!--", begin):
                end = find("-->", begin + 4)
                if end < 0:
                    return
                at = end + 3
                continue
            if markup[first : first + 1] not in ("!", "?") or first >= len(markup):
                yield "", markup[begin:first]
                at = first
                continue
        end = markup.find(">", first)
        if end < 0:
            yield "", markup[begin:]
            return
        at = end + 1
        if name:
            kind = name[0].lower()
            if first == begin + 1 and kind in _UNSEEN:
                closing = _UNSEEN[kind].search(markup, at)
                if not closing:
                    return
                at = closing.end()
                yield "", " "
            else:
                yield "/" * (first - begin - 1) + kind, markup[name.end() : end]
    if at < len(markup):
        yield "", markup[at:]


def page_parts(markup: str) -> tuple[str, str | None, str | None, list[str]]:
    """The text (one line for each block with words, its white space made single spaces), title, language and links."""
    out, links, titles, title, lang = [], [], [], None, None
    in_title = False
    for name, rest in _events(markup):
        if not name:
            out.append(rest.replace("\n", " "))
            if in_title:
                titles.append(rest)
            continue
        if name in _EDGES:
            out.append("\n")
        if name == "title" and title is None and not in_title:
            in_title, titles = True, []
        elif name == "/title" and in_title:
            in_title, title = False, _one_line("".join(titles))
        elif name == "html" and lang is None and (m := _LANG.search(rest)):
            lang = m[1]
        elif name == "a" and (m := _HREF.search(rest)):
            links.append(_one_line(m[1] or m[2] or m[3] or ""))
    lines = (_one_line(line) for line in "".join(out).split("\n"))
    return "\n".join(line for line in lines if line), title, lang, links


def page_text(markup: str) -> str:
    """What a reader sees."""
    return page_parts(markup)[0]


def _decoded(payload: bytes, headers: str) -> tuple[str, str]:
    named = _CHARSET.search(headers) or _CHARSET.search(payload[:1024].decode("latin-1"))
    for charset in (named and named[1], "utf-8"):
        try:
            return payload.decode(charset), charset.lower()
        except (LookupError, UnicodeDecodeError, TypeError):
            continue
    return payload.decode("latin-1"), "latin-1"


def _record(row: dict, block: bytes) -> bytes:
    named = (
        ("WARC-Type", row["warc_type"]), ("WARC-Record-ID", row["record_id"]), ("WARC-Date", row["date"]),
        ("WARC-Refers-To", row["refers_to"]), ("WARC-Refers-To-Target-URI", row["target_uri"]),
        ("WARC-Refers-To-Date", row["date"]), ("WARC-Target-URI", row["target_uri"]),
        ("WARC-Refers-To-Payload-Digest", row["refers_to_payload_digest"]),
        ("WARC-Block-Digest", row["block_digest"]), ("Content-Type", row["content_type"]), ("Content-Length", len(block)),
    )
    head = "".join(f"{k}: {re.sub(r'[\r\n]+', ' ', str(v))}\r\n" for k, v in named if v is not None)
    return f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def _one_line(text: str) -> str:
    return " ".join(html.unescape(text).split())


def derive(response: dict, with_record: bool = True) -> Iterator[dict]:
    """The metadata and the conversion record of one response."""
    payload, headers = bytes(response["payload"] or b""), response["http_headers"] or ""
    markup, charset = _decoded(payload, headers)
    uri, source = response["target_uri"], digest(payload)
    fields = [("payloadDigest", source), ("charset", charset), ("payloadLength", len(payload))]
    status, *lines = headers.splitlines() or [""]
    fields += [("http-status", status)] if status else []
    fields += [(f"http-header-{k.strip().lower()}", v.strip()) for k, _, v in (x.partition(":") for x in lines if ":" in x)]
    text, title, lang, links = page_parts(markup)
    fields += [(k, v) for k, v in (("title", title), ("lang", lang)) if v is not None]
    for href in links:
        try:
            fields.append(("outlink", urljoin(uri or "", href)))
        except ValueError:
            fields.append(("outlink", href))
    contents = (
        ("metadata", "application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in fields)),
        ("conversion", "text/plain; charset=utf-8", text),
    )
    for kind, content_type, content in contents:
        block = content.encode("utf-8", "replace")
        row = {
            "warc_type": kind, "record_id": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{response['record_id']} {kind}')}>",
            "refers_to": response["record_id"], "target_uri": uri, "date": response["date"], "content_type": content_type,
            "block_digest": digest(block), "refers_to_payload_digest": source, "content_length": len(block),
            "content": block.decode(),
        }
        yield row | {"record": _record(row, block)} if with_record else row


def responses_of(pages: DataFrame, date: str = DATE) -> DataFrame:
    """pages (page_id, url, html) as response records: record_id, target_uri, date, http_headers, payload, page_id."""
    hashed = F.md5(F.concat_ws("\n", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit(""))))
    part = lambda a, n: F.substring(hashed, a, n)
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    return pages.select(
        "page_id",
        F.concat(
            F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-"), part(13, 4), F.lit("-"), part(17, 4),
            F.lit("-"), part(21, 12), F.lit(">"),
        ).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(date).alias("date"),
        F.concat(
            F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
            F.length(payload).cast("string"),
        ).alias("http_headers"),
        payload.alias("payload"),
    )


def derivatives(responses: DataFrame, key: str = "page_id", with_record: bool = True) -> DataFrame:
    """Two rows for each row of responses (key, record_id, target_uri, date, http_headers, payload).

    ``content`` is the record's block as text and ``record`` the whole WARC/1.1 record; ids and digests depend on the
    response alone, so reruns agree. A null payload counts as empty and a null URI is left out of the headers; an empty
    page has an empty conversion record. Repeated responses give repeated records; other columns are not carried.
    """
    kind = responses.schema[key].dataType.simpleString()
    names = [key, *(x.split()[0] for x in COLUMNS.split(", "))]
    columns = COLUMNS if with_record else COLUMNS.removesuffix(", record binary")
    names = names if with_record else names[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256).to_pylist()
                out = [{key: r[key]} | d for r in rows for d in derive(r, with_record)]
                types = {"binary": pa.binary(), "long": pa.int64()}
                fields = {c: types.get(t, pa.string()) for c, t in (x.split() for x in columns.split(", "))}
                key_type = batch.schema.field(key).type
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[c] for r in out], fields.get(c, key_type)) for c in names], names=names
                )

    needed = responses.select(key, "record_id", "target_uri", "date", "http_headers", "payload")
    return needed.mapInArrow(run, f"{key} {kind}, {columns}")
