"""WARC derivatives: metadata and plain-text conversion records of web responses.

Each page is a response record. From it come a ``metadata`` record (JSON: the
source's WARC and HTTP headers, title, links) and a ``conversion`` record (plain
text), both with the response's id in ``WARC-Refers-To``, its target, its date
and digests of their own blocks; the source's digests are kept in the metadata.
Ids are name-based, so that a task that runs again makes the same records.
Records are made where the pages are read; nothing is shuffled.

Defined cases: a null page is an empty payload and still gives both records; a
null address gives no ``WARC-Target-URI``; line ends in header values are
percent-encoded; a hidden element that is never closed ends with the page (a head is
none: its end tag is optional, and text that stands in it belongs to the body); a tag that
is not finished before the next ``<`` is text; pages of any length and of any unfinished
tags are read once from front to back; repeated rows give repeated records; an empty table gives an empty table; columns other than
the three are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import html
import json
import re
import uuid
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ectolog.llm.rows import pieces

VERSION = "WARC/1.1"
#: Elements whose content is no text, and elements that end a line.
HIDDEN = ("script", "style", "noscript", "template", "title")
BLOCKS = (
    "address article aside blockquote body br caption dd details div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section "
    "select table tbody td tfoot th thead title tr ul"
).split()

_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
# A hidden element's start tag ends at the next ">". Without one, the match takes the rest of
# the page and stays as it is, so that no character is looked at from a second start.
_HIDDEN = re.compile(
    rf"<({'|'.join(HIDDEN)})(?![a-z0-9-])[^>]*+(?:(>).*?(?:</\1\s*>|\Z)|\Z)", re.S | re.I
)
# A tag ends at ">", or unfinished before the next "<" or a quote that is never closed. Unfinished
# ones are matched too: the search goes on behind them, so that a page is scanned once.
_TAG = re.compile(
    r"<(?:/?([a-zA-Z][a-zA-Z0-9-]*+)|[/!?])(?:\"[^\"]*+\"|'[^']*+'|[^<>\"'])*+(>?)"
)
_TITLE = re.compile(r"<title\b[^<>]*+>(.*?)(?:</title\s*>|\Z)", re.S | re.I)
_LINKING = {"a", "area", "link", "img", "script", "iframe"}
_ADDRESS = re.compile(r"\s(href|src)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_ENDS_LINE = frozenset(BLOCKS)
_SPACES = re.compile(r"[ \t\r\f\v\xa0]+")

SCHEMA = (
    "page_id long, type string, record_id string, refers_to string, target_uri string, "
    "content_type string, content_length long, block_digest string, payload_digest string, "
    "header string, block string"
)
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def digest(data: bytes) -> str:
    """Labelled digest as WARC files write it: SHA-1 in base 32."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(kind: str, *parts) -> str:
    name = json.dumps([kind, *parts], ensure_ascii=False)
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def _in_place_of(tag: re.Match) -> str:
    """Nothing or a line end for a tag; an unfinished one is text."""
    if not tag[2]:
        return tag[0]
    return "\n" if tag[1] and tag[1].lower() in _ENDS_LINE else ""


def plain_text(page: str) -> str:
    """Text of a page, a line for each block with text in it."""
    page = _HIDDEN.sub(lambda m: "\n" if m[2] else m[0], _COMMENT.sub("", page))
    page = html.unescape(_TAG.sub(_in_place_of, page))
    lines = (_SPACES.sub(" ", line).strip() for line in page.split("\n"))
    return "\n".join(line for line in lines if line)


def links_of(page: str, base: str) -> list[dict[str, str]]:
    """Element, attribute and absolute address of each link, in order."""
    out = []
    for tag in _TAG.finditer(_COMMENT.sub("", page)):
        element = (tag[1] or "").lower()
        m = _ADDRESS.search(tag[0]) if element in _LINKING and tag[0][1] != "/" else None
        if m is None:
            continue
        address = html.unescape(m[2] or m[3] or m[4] or "").strip()
        try:
            address = urljoin(base, address)
        except ValueError:
            pass
        out.append({"path": f"{element}@/{m[1].lower()}", "url": address})
    return out


def _clean(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def header(kind: str, fields: list[tuple[str, str | None]]) -> str:
    lines = [VERSION, f"WARC-Type: {kind}"]
    lines += [f"{name}: {_clean(value)}" for name, value in fields if value]
    return "\r\n".join(lines) + "\r\n\r\n"


def _record(page_id, kind, own_id, refers_to, url, date, content_type, block, payload_digest=None):
    data = block.encode("utf-8", "surrogatepass")
    block_digest = digest(data)
    fields = [
        ("WARC-Record-ID", own_id),
        ("WARC-Refers-To", refers_to),
        ("WARC-Target-URI", url),
        ("WARC-Date", date),
        ("WARC-Block-Digest", block_digest),
        ("WARC-Payload-Digest", payload_digest),
        ("Content-Type", content_type),
        ("Content-Length", str(len(data))),
    ]
    return (page_id, kind, own_id, refers_to, url, content_type, len(data), block_digest) + (
        payload_digest,
        header(kind, fields),
        block,
    )


def response(page_id, url: str, page: str, date: str):
    """The response record of a page."""
    payload = page.encode("utf-8", "surrogatepass")
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    )
    payload_digest = digest(payload)
    own_id = record_id("response", page_id, url, payload_digest)
    kind = "application/http; msgtype=response"
    return _record(page_id, "response", own_id, None, url, date, kind, http + page, payload_digest)


def derived(source, page: str, date: str) -> list[tuple]:
    """Metadata and conversion records of a response record."""
    page_id, _, source_id, _, url, _, _, block_digest, payload_digest, head, block = source
    title = _TITLE.search(_COMMENT.sub("", page))
    http = block[: len(block) - len(page)].strip().split("\r\n")
    about = {
        "Envelope": {
            "WARC-Header-Metadata": dict(
                line.split(": ", 1) for line in head.strip().split("\r\n")[1:]
            ),
            "Payload-Metadata": {
                "HTTP-Response-Metadata": {
                    "Response-Message": {"Status-Line": http[0]},
                    "Headers": dict(line.split(": ", 1) for line in http[1:]),
                    "HTML-Metadata": {
                        "Head": {
                            "Title": _SPACES.sub(" ", html.unescape(title[1])).strip() if title else None
                        },
                        "Links": links_of(page, url or ""),
                    },
                }
            },
        }
    }
    text = plain_text(page)
    return [
        _record(
            page_id,
            "metadata",
            record_id("metadata", source_id),
            source_id,
            url,
            date,
            "application/json",
            json.dumps(about, ensure_ascii=False),
        ),
        _record(
            page_id,
            "conversion",
            record_id("conversion", source_id),
            source_id,
            url,
            date,
            "text/plain",
            text,
            digest(text.encode("utf-8", "surrogatepass")),
        ),
    ]


def derivatives(
    pages: DataFrame, date: str = "1970-01-01T00:00:00Z", responses: bool = False
) -> DataFrame:
    """Records (``SCHEMA``) of pages with ``page_id``, ``url``, ``html``.

    ``date`` is when the pages were fetched. With ``responses`` the source
    records are given too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string()] * len(_NAMES)
        types[0] = types[6] = pa.int64()
        for batch in batches:
            for part in pieces(batch, 4 << 20):
                out = []
                for page_id, url, page in zip(*(c.to_pylist() for c in part.columns)):
                    source = response(page_id, url, page, date)
                    out += ([source] if responses else []) + derived(source, page, date)
                columns = [pa.array(c, t) for c, t in zip(zip(*out), types)]
                yield pa.record_batch(columns, _NAMES)

    rows = pages.select(
        F.col("page_id").cast("long"), F.col("url"), F.coalesce("html", F.lit("")).alias("html")
    )
    return rows.mapInArrow(run, SCHEMA)


def write(records: DataFrame, path: str) -> None:
    """Records as WARC files, compressed; each ends with the two empty lines of the format."""
    whole = records.select(F.concat("header", "block", F.lit("\r\n")).alias("value"))
    whole.write.option("lineSep", "\r\n").option("compression", "gzip").text(path)
