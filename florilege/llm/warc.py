"""WARC derivatives: metadata and plain-text conversion records of response records."""

from __future__ import annotations

import base64
import gzip
import hashlib
import html as entities
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CRLF = b"\r\n"
#: Record ids are name-based, so that a job run again after a lost executor names the same records.
SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "florilege/warc")

_dropped = re.compile(r"<!--|<(script|style|noscript|template|head)\b", re.I)
_ends = {None: re.compile("-->")} | {k: re.compile(rf"</{k}\s*>", re.I) for k in ("script", "style", "noscript", "template", "head", "title")}
_title = re.compile(r"<title\b[^>]*>", re.I)
_html = re.compile(r"<html\b([^>]*)>", re.I)
_lang = re.compile(r"\blang\s*=\s*[\"']?([A-Za-z-]+)", re.I)
_break = re.compile(r"</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|nav|header|footer|blockquote|pre|hr|title|body|html)\b[^>]*>", re.I)
_tag = re.compile(r"<[A-Za-z/!?][^>]*>")
_link = re.compile(r"<a\b([^>]*)>", re.I)
_href = re.compile(r"\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_blank = re.compile(r"[ \t\r\f\v]+")
_number = re.compile(r"&#(?:0*[1-9][0-9]{7,}|[xX]0*[1-9a-fA-F][0-9a-fA-F]{6,});?")


def _tags(page: str) -> str:
    """The page up to its last >. No tag is complete after it, and before it a search for a tag's end never runs to the page's end in vain."""
    return page[: page.rfind(">") + 1]


def without_hidden(page: str) -> str:
    """The page with a space for each comment, script, style, noscript, template and head; one that isn't closed stays.

    One pass: where an element's end is missing, it is missing for all later ones of its kind, which aren't searched again.
    """
    out, at, look, unclosed = [], 0, 0, set()
    while m := _dropped.search(page, look):
        kind = m[1].lower() if m[1] else None
        look = m.end()
        begin = look if kind is None else page.find(">", look) + 1
        if kind in unclosed or not begin:
            continue
        end = _ends[kind].search(page, begin)
        if not end:
            unclosed.add(kind)
            continue
        out += [page[at : m.start()], " "]
        at = look = end.end()
    return "".join((*out, page[at:]))


def unescape(text: str) -> str:
    """Entities resolved; numbers beyond Unicode become U+FFFD, however long."""
    return entities.unescape(_number.sub("\ufffd", text))


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, '|'.join(parts))}>"


def plain_text(page: str) -> str:
    """Visible text: no scripts, styles, head or comments; block tags end lines; entities resolved; white space collapsed."""
    text = without_hidden(page)
    tags = _tags(text)
    text = _tag.sub("", _break.sub("\n", tags)) + text[len(tags) :]
    lines = (_blank.sub(" ", x).strip() for x in unescape(text).split("\n"))
    return "\n".join(x for x in lines if x)


def serialise(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A WARC/1.1 record. A header's line breaks become spaces: they would end it."""
    head = [b"WARC/1.1", *(f"{k}: {re.sub(r'[\r\n]+', ' ', v)}".encode("utf-8", "replace") for k, v in headers), f"Content-Length: {len(block)}".encode()]
    return CRLF.join(head) + CRLF * 2 + block + CRLF * 2


#: The names that derive() looks for, as the standard spells them; in archives they may be in any case of letters.
NAMES = {n.lower(): n for n in ("WARC-Type", "WARC-Record-ID", "WARC-Target-URI", "WARC-Date", "WARC-Payload-Digest", "WARC-Block-Digest", "Content-Length", "Content-Type")}


def _headers(lines: list[str]) -> dict[str, str]:
    """Values by name. A line that starts with white space goes on with the one before; a line without a colon is left out."""
    out: dict[str, str] = {}
    name = None
    for line in lines:
        if line[:1] in (" ", "\t") and name is not None:
            out[name] = f"{out[name]} {line.strip()}".strip()
            continue
        key, colon, value = line.partition(":")
        if colon:
            name = NAMES.get(key.strip().lower(), key.strip())
            out[name] = value.strip()
    return out


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a WARC file, plain or gzipped, one at a time: what is unpacked isn't held. Bytes that are no whole record raise one of DAMAGE."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data))) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    while first := stream.readline():
        if not first.strip():  # the lines that end a record
            continue
        if not first.startswith(b"WARC/"):
            raise ValueError("no record where one should start")
        lines = []
        while line := stream.readline().rstrip(b"\r\n"):
            lines.append(line.decode("utf-8", "replace"))
        headers = _headers(lines)
        if not re.fullmatch("[0-9]{1,18}", headers.get("Content-Length", "")):
            raise ValueError("a record without a length")
        n = int(headers["Content-Length"])
        block = stream.read(n)
        if len(block) < n:
            raise ValueError("a record that ends too early")
        yield headers, block


#: What parse() raises on bytes that are no whole record.
DAMAGE = (ValueError, EOFError, OSError, zlib.error)

_chunked = re.compile(rb"^transfer-encoding[ \t]*:[^\r\n]*\bchunked", re.I | re.M)
_coded = re.compile(rb"^content-encoding[ \t]*:([^\r\n]*)", re.I | re.M)
_charset = re.compile(rb"^content-type[ \t]*:[^\r\n]*\bcharset[ \t]*=[ \t]*[\"']?([\w.:-]+)", re.I | re.M)
_chunk = re.compile(rb"([0-9A-Fa-f]{1,15})[^\r\n]*\r\n")


def _joined(body: bytes) -> bytes:
    """The chunks of a body joined; the body itself where it isn't made of chunks, as when they were joined before it was stored."""
    out, at = [], 0
    while at < len(body) and (m := _chunk.match(body, at)):
        n = int(m[1], 16)
        if not n:
            return b"".join(out)
        out.append(body[m.end() : m.end() + n])
        at = m.end() + n + 2
    return b"".join(out) if at >= len(body) else body


def _inflated(body: bytes, coding: str) -> bytes:
    """The body without its gzip or deflate coding, as far as it can be read; nothing where the coding is another."""
    if coding in ("", "identity"):
        return body
    if coding not in ("gzip", "x-gzip", "deflate"):
        return b""
    out = []
    while body:
        plain = coding == "deflate" and (len(body) < 2 or body[0] & 15 != 8 or (body[0] << 8 | body[1]) % 31)
        reader, at = zlib.decompressobj(-15 if plain else 47), 0
        try:
            while at < len(body) and not reader.eof:
                out.append(reader.decompress(body[at : at + 65_536]))
                at += 65_536
        except zlib.error:
            break
        body = reader.unused_data + body[at:] if reader.eof else b""
    return b"".join(out)


def page_text(http: bytes, body: bytes) -> str:
    """The page of an HTTP message: chunks joined, codings undone from the last on, decoded by the stated character set, else as UTF-8."""
    if _chunked.search(http):
        body = _joined(body)
    if m := _coded.search(http):
        for coding in reversed(m[1].decode("latin-1").lower().split(",")):
            body = _inflated(body, coding.strip())
    if m := _charset.search(http):
        try:
            return body.decode(m[1].decode("ascii"), "replace")
        except (LookupError, ValueError):  # no such set, or none for text
            pass
    return body.decode("utf-8", "replace")


def response(key: str, url: str | None, page: str | None, date: str) -> tuple[list[tuple[str, str]], bytes]:
    """The source record of a stored page: an HTTP response with its payload."""
    body = (page or "").encode("utf-8", "replace")
    block = CRLF.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}".encode()]) + CRLF * 2 + body
    return [
        ("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", key, url or "", digest(body))), ("WARC-Target-URI", url or "urn:unknown"), ("WARC-Date", date),
        ("WARC-Payload-Digest", digest(body)), ("WARC-Block-Digest", digest(block)), ("Content-Type", "application/http; msgtype=response"),
    ], block


def derive(headers: list[tuple[str, str]], block: bytes) -> list[tuple[list[tuple[str, str]], bytes]]:
    """The metadata record and the conversion record of a response record; both refer to it and carry its headers.

    A source without a target counts as urn:unknown, one without a date as of 1970, one without an id is named by its digest.
    """
    source = dict(headers)
    http, _, body = block.partition(CRLF * 2)
    page = page_text(http, body)
    origin, date = source.get("WARC-Record-ID") or record_id("unnamed", digest(block)), source.get("WARC-Date") or "1970-01-01T00:00:00Z"
    text = plain_text(page)
    tags = _tags(page)
    title = (m := _title.search(tags)) and (end := _ends["title"].search(tags, m.end())) and tags[m.end() : end.start()]
    lang = (m := _html.search(tags)) and _lang.search(m[1])
    found = [_href.findall(m[1]) for m in _link.finditer(tags)]
    links = [unescape(next(x for x in every[-1] if x)) for every in found if every and any(every[-1])]
    kept = [("Source-Headers", " | ".join(http.decode("latin-1").split("\r\n"))), ("Source-Payload-Digest", source.get("WARC-Payload-Digest") or digest(body)), ("Source-Block-Digest", source.get("WARC-Block-Digest") or digest(block))]
    fields = [(k.lower(), v) for k, v in kept]
    fields += [("title", " ".join(plain_text(title).split()))] if title is not None else []
    fields += [("language", lang[1].lower())] if lang else []
    fields += [("outlink", " ".join(x.split())) for x in links]
    meta = "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "replace")
    plain = text.encode("utf-8", "replace")
    out = []
    for kind, mime, new in (("metadata", "application/warc-fields", meta), ("conversion", "text/plain; charset=utf-8", plain)):
        out.append(
            (
                [
                    ("WARC-Type", kind), ("WARC-Record-ID", record_id(kind, origin)), ("WARC-Refers-To", origin), ("WARC-Target-URI", source.get("WARC-Target-URI") or "urn:unknown"),
                    ("WARC-Date", date), ("WARC-Refers-To-Date", date), ("WARC-Block-Digest", digest(new)), ("Content-Type", mime), *((f"X-{k}", v) for k, v in kept),
                ],
                new,
            )
        )
    return out


def archive_derivatives(archives: DataFrame, path_col: str = "path", content_col: str = "content", damaged: str = "report") -> DataFrame:
    """(path, warc_type, record_id, refers_to, record) of the metadata and conversion records of each response record of whole WARC files, plain or gzipped, as spark.read.format("binaryFile") gives them.

    A file is held in one task as it is stored, and of what it unpacks to one record. Other records give nothing; null or empty content neither.
    Where bytes are no whole record the file's reading ends: with a row of warc_type `damaged`, whose record states why, or, with
    damaged="raise", with an error.
    """
    if damaged not in ("report", "raise"):
        raise ValueError(f"damaged: {damaged}")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "warc_type", "record_id", "refers_to", "record"]
        for batch in batches:
            for path, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    for headers, block in parse(data or b""):
                        if headers.get("WARC-Type", "").lower() == "response":
                            made = [(dict(h), serialise(h, new)) for h, new in derive(list(headers.items()), block)]
                            yield pa.RecordBatch.from_arrays([pa.array([path] * 2), *(pa.array([h[k] for h, _ in made]) for k in ("WARC-Type", "WARC-Record-ID", "WARC-Refers-To")), pa.array([r for _, r in made], pa.binary())], names=names)
                except DAMAGE as e:
                    if damaged == "raise":
                        raise
                    none = pa.array([None], pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array(["damaged"]), none, none, pa.array([str(e).encode()], pa.binary())], names=names)

    return archives.select(F.col(path_col).cast("string").alias("path"), F.col(content_col).alias("content")).mapInArrow(build, "path string, warc_type string, record_id string, refers_to string, record binary")


def derivatives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Three rows per page (response, metadata, conversion): id, warc_type, record_id, refers_to, target_uri, content_type,
    block_digest, payload_digest, source_digest (of the response's payload), n_bytes (of the block) and record, the WARC/1.1 bytes.

    Each page is handled on its own in a map over Arrow batches: nothing is shuffled and no group can be hot. `date` is the
    time of capture where the table has none. Null HTML counts as an empty body; a null URL as urn:unknown; a null id is
    kept. Repeated rows give records with equal ids: they are the same capture. A page of any length is read in linear time
    and held once or twice. Other columns don't matter.
    """
    schema = f"{id_col} {dict(pages.dtypes)[id_col]}, warc_type string, record_id string, refers_to string, target_uri string, content_type string, block_digest string, payload_digest string, source_digest string, n_bytes long, record binary"
    names = [x.split()[0] for x in schema.split(", ")]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = None
        for batch in batches:
            kind = batch.schema.field(0).type
            arrow = arrow or pa.schema([(n, kind if n == id_col else pa.int64() if n == "n_bytes" else pa.binary() if n == "record" else pa.string()) for n in names])
            for at in range(0, len(batch), 256):
                rows: list[tuple] = []
                for key, url, page in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                    source = response(str(key), url, page, date)
                    payload = dict(source[0])["WARC-Payload-Digest"]
                    for headers, block in [source, *derive(*source)]:
                        h = dict(headers)
                        rows.append((key, h["WARC-Type"], h["WARC-Record-ID"], h.get("WARC-Refers-To"), h["WARC-Target-URI"], h["Content-Type"], h["WARC-Block-Digest"], h.get("WARC-Payload-Digest"), payload, len(block), serialise(headers, block)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return pages.select(id_col, url_col, html_col).mapInArrow(build, schema)
