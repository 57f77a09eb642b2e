"""Text and links of pages against a plain scanner, and pages of unfinished tags."""

import html
import json
import random
import time

import pytest

from ectolog.llm import warc

LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


def without_comments(page):
    out, i = [], 0
    while i < len(page):
        if page.startswith("<!--", i):
            end = page.find("-->", i + 4)
            i = len(page) if end < 0 else end + 3
        else:
            out.append(page[i])
            i += 1
    return "".join(out)


def without_hidden(page):
    out, i, low = [], 0, page.lower()
    while i < len(page):
        name = next((n for n in warc.HIDDEN if low.startswith("<" + n, i)), None)
        after = page[i + 1 + len(name or "") :][:1].lower()
        if name is None or (after and after in LETTERS.lower() + "0123456789-"):
            out.append(page[i])
            i += 1
            continue
        start = page.find(">", i)
        if start < 0:
            out.append(page[i:])
            break
        j = start + 1
        while j < len(page):
            if low.startswith(f"</{name}", j):
                k = j + 2 + len(name)
                while k < len(page) and page[k].isspace():
                    k += 1
                if page[k : k + 1] == ">":
                    j = k + 1
                    break
            j += 1
        out.append("\n")
        i = j
    return "".join(out)


def tags(page):
    """(start, end, name, finished) of each tag, letter by letter."""
    i = 0
    while i < len(page):
        after = page[i + 1 : i + 2]
        if page[i] != "<" or not after or after not in LETTERS + "/!?":
            i += 1
            continue
        at = i + 1 + (page[i + 1] == "/" and page[i + 2 : i + 3] != "" and page[i + 2] in LETTERS)
        j = at
        while j < len(page) and page[at] in LETTERS and page[j] in LETTERS + "0123456789-":
            j += 1
        name = page[at:j].lower()
        j = max(j, at + 1)
        while j < len(page) and page[j] not in "<>":
            if page[j] in "\"'":
                end = page.find(page[j], j + 1)
                if end < 0:
                    break
                j = end
            j += 1
        finished = page[j : j + 1] == ">"
        j += finished
        yield i, j, name, finished
        i = j


def text_of(page):
    page = without_hidden(without_comments(page))
    out, done = [], 0
    for start, end, name, finished in tags(page):
        out.append(page[done:start])
        out.append(("\n" if name in warc.BLOCKS else "") if finished else page[start:end])
        done = end
    lines = html.unescape("".join(out) + page[done:]).split("\n")
    lines = [" ".join(x for x in warc._SPACES.sub(" ", line).split(" ") if x).strip() for line in lines]
    return "\n".join(line for line in lines if line)


PARTS = [
    "<p>", "</p>", "<P class='x'>", "<a href='/u'>", "<a\nHREF=v >", "<img src=\"w\" alt='>'>", "<br/>", "<b", "<a ", "'", '"',
    ">", "<", "text", " ", "\n", "&amp;", "&lt;p&gt;", "<script>", "</script >", "<scripts>", "<style", "</style>", "<!--",
    "-->", "<title>", "</title>", "<!doctype html>", "<?x", "</ p>", "</", "<1", "<p-x>", "<h1>", "<head>", "é", "<a href=\"",
    "<body title=\"a<b>c\">", "<template>", "</template>",
]


@pytest.mark.parametrize("seed", range(8))
def test_text_as_a_plain_scanner_has_it(seed):
    rng = random.Random(seed)
    for _ in range(1_500):
        page = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 25)))
        assert warc.plain_text(page) == text_of(page), page


def test_links_as_a_plain_scanner_has_them():
    rng = random.Random(11)
    for _ in range(4_000):
        page = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 20)))
        bare = without_comments(page)
        want = []
        for start, end, name, _ in tags(bare):
            found = warc._ADDRESS.search(bare[start:end])
            if found and name in warc._LINKING and bare[start + 1] != "/":
                want.append(f"{name}@/{found[1].lower()}")
        assert [x["path"] for x in warc.links_of(page, "http://h/")] == want, page


UNFINISHED = ["<a ", "<p", "<script ", "<title ", '<a href=" ', '<a "<a" ', "<a '\" ", "<", "<!-- ", "<style>a</style ", "<a\"'"]


def test_long_pages_of_unfinished_tags(spark):
    """A megabyte of what is never closed takes time in proportion to its length."""
    pages = [(k, "http://h/", part * (1_000_000 // len(part))) for k, part in enumerate(UNFINISHED)]
    began = time.monotonic()
    got = warc.derivatives(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert time.monotonic() - began < 60
    assert len(got) == 2 * len(pages)


def test_every_page_of_the_table(spark, sf_dir):
    """Conversion and metadata records of the whole table, row by row."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    want = {r["page_id"]: r for r in pages.collect()}
    records = warc.derivatives(pages, responses=True).collect()
    by = {(r["page_id"], r["type"]): r for r in records}
    assert len(by) == len(records) == 3 * len(want)
    for page_id, row in want.items():
        source, text, about = (by[page_id, t] for t in ("response", "conversion", "metadata"))
        assert text["block"] == text_of(row["html"] or "")
        assert text["refers_to"] == about["refers_to"] == source["record_id"]
        payload = json.loads(about["block"])["Envelope"]
        assert payload["WARC-Header-Metadata"]["WARC-Payload-Digest"] == source["payload_digest"]
        for r in (source, text, about):
            data = r["block"].encode()
            assert r["block_digest"] == warc.digest(data) and r["content_length"] == len(data)
            assert f"Content-Length: {len(data)}\r\n" in r["header"]
