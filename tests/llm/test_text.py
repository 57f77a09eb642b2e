"""Tokens, secrets, licences, WARC records, models and decontamination."""

import base64
import gzip
import hashlib
import json
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from ectolog.llm import bpe, decontaminate, licences, quality, registry, secret_scan, toxicity, warc
from ectolog.llm import kneser_ney as kn

ODD = [
    (1, None),
    (2, ""),
    (3, " "),
    (4, "a  b\n\n c\t d\r\n e \x0b f\xa0g　h\x1ci\x85j "),
    (5, "aaaaaaaaaaaaaaaaaaaaaaa 00000000000000000000 ----------"),
    (6, "don't it's we'LL 日本語テキスト привет мир ñandú 🙂🙂👍🏽"),
    (7, "x" * 50_000),
    (7, "x" * 50_000),
    (8, "the quick brown fox " * 5_000),
    (None, "<|endoftext|> ​﻿"),
]


@pytest.fixture(scope="module")
def encoding():
    with open(registry.MULTI, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


def test_bpe_is_tiktoken(make, documents, encoding, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 100_000)
    rng = random.Random(1)
    mixed = [(100 + k, "".join(rng.choice("ab \n\t\xa0the日é!'s0 ") for _ in range(400))) for k in range(60)]
    for docs in (make(ODD + mixed), documents):
        ids = bpe.encode(docs, registry.MULTI, public_tokenizers.PATTERN)
        found = bpe.decode(ids, registry.MULTI).collect()
        want = Counter((r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect())
        assert Counter((r["doc_id"], bytes(r["decoded"]).decode()) for r in found) == want
        for r in found:
            text = bytes(r["decoded"]).decode()
            assert np.frombuffer(r["ids"], "<u4").tolist() == encoding.encode_ordinary(text)


def test_secret_spans(make):
    rows = [
        (1, 'Password: "abc123" token=short then API_KEY = abcdefgh'),
        (2, "AKIA" + "A" * 16 + " AKIAB " + "0123456789abcdef" * 2 + " deadbeef"),
        (3, None),
        (4, "toKen=abcdefgh paſſword=abcdefgh"),  # letters that fold into ASCII ones
        (5, "id 123e4567-e89b-42d3-a456-426614174000 key zX9fQ2kLm8Pq7Rt3Vb1Nw5Yc0Ae4Hj6D end"),
        (6, "x" * 1000 + " https://example.com/aaaa_bbbb-cccc_dddd-eeee"),
    ]
    found = {r["doc_id"]: r for r in secret_scan.scan(make(rows), registry.PLAIN, public_tokenizers.PATTERN).collect()}
    assert found[1]["base"] == "assign:0:17,assign:36:54"
    assert found[2]["base"] == "access:0:20,hex:27:59" and found[2]["n_hex"] == 1
    assert found[3]["spans"] == found[4]["spans"] == found[6]["spans"] == ""
    assert found[5]["spans"] == "random:44:76" and found[5]["base"] == ""


def test_secret_base_by_plain_rules(documents):
    """The rules word for word: greedy runs, then those too short are dropped."""
    for r in documents.select("text").collect():
        t = r["text"] or ""
        want = [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        pattern = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
        want += [(m.start(), 0, m.end()) for m in re.finditer(pattern, t) if len(m[2]) >= 6]
        assert secret_scan.stated(t) == sorted(want)


def test_licences(spark, make):
    rows = [
        (1, "Text.\nreleased under the mit licence\nmore"),
        (2, "Copyright (c) 2020 Someone\nReleased under the MIT License."),
        (3, "This work is LICENSED under the GPL, version 3!"),
        (4, None),
        (5, "Released under the MIT License. And more."),
        (6, "...\n\n"),
    ]
    found = licences.scan(make(rows), licences.known_notices(spark)).collect()
    got = {(r["doc_id"], r["scope"], r["line"], r["licence"]) for r in found}
    assert got == {
        (1, "line", 1, "MIT"),
        (2, "text", None, "MIT"),
        (2, "line", 1, "MIT"),
        (3, "text", None, "GPL-3.0"),
        (3, "line", 0, "GPL-3.0"),
    }
    assert licences.scan(make(rows), licences.known_notices(spark).limit(0)).collect() == []


def test_warc_records(spark, tmp_path):
    page = (
        "<html><head><title>A &amp; B</title><style>p{}</style></head><body><p>One<b>two</b> &lt;x&gt;"
        "<script>var t='</p>';</script><br>three <a href='/q?a=1&amp;b=2'>link</a><!-- no -->"
    )
    rows = [(1, "http://e.com/d/", page, "x"), (2, None, None, "x"), (3, "http://e.com/\r\nX: y", "<p", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, block string")
    out = warc.derivatives(pages, responses=True)
    records = out.collect()
    assert len(records) == 9
    by = {(r["page_id"], r["type"]): r for r in records}
    assert by[1, "conversion"]["block"] == "Onetwo <x>\nthree link"
    about = json.loads(by[1, "metadata"]["block"])["Envelope"]
    assert about["WARC-Header-Metadata"]["WARC-Record-ID"] == by[1, "response"]["record_id"]
    assert about["WARC-Header-Metadata"]["WARC-Payload-Digest"] == by[1, "response"]["payload_digest"]
    head = about["Payload-Metadata"]["HTTP-Response-Metadata"]["HTML-Metadata"]
    assert head["Head"]["Title"] == "A & B" and head["Links"][0]["url"] == "http://e.com/q?a=1&b=2"
    for (page_id, kind), r in by.items():
        data = r["block"].encode()
        sha = "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert (r["content_length"], r["block_digest"]) == (len(data), sha)
        if kind != "response":
            assert r["refers_to"] == by[page_id, "response"]["record_id"]
    assert by[2, "conversion"]["block"] == "" and by[2, "metadata"]["target_uri"] is None
    assert "\r\nX: y" not in by[3, "metadata"]["header"]
    # What is written reads as records by their lengths.
    warc.write(out.coalesce(1), str(tmp_path / "w"))
    data = gzip.decompress(next((tmp_path / "w").glob("part-*")).read_bytes())
    n = 0
    while data:
        head, data = data.split(b"\r\n\r\n", 1)
        length = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert data[length : length + 4] == b"\r\n\r\n"
        data, n = data[length + 4 :], n + 1
    assert n == 9


def kneser_ney_by_hand(texts, order):
    """Interpolated modified Kneser-Ney by definition, on dictionaries."""
    top = Counter(g for t in texts for w in kn.words_of(t) for g in kn.grams_of(w, order))
    counts = {order: {g: n for g, n in top.items() if len(g) == order}}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
        if k > 1:
            counts[k].update({g: n for g, n in top.items() if len(g) == k and g[0] == kn.BEGIN})
    letters = len(counts[1]) + 1
    discount = {}
    for k, c in counts.items():
        n = [sum(v == i for v in c.values()) for i in range(1, 5)]
        if min(n) <= 0:
            discount[k] = (0.75,) * 3
            continue
        y = n[0] / (n[0] + 2 * n[1])
        d = (1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2])
        discount[k] = tuple(min(max(x, 0.1), i + 0.9) for i, x in enumerate(d))

    def p(h, c):
        k = len(h) + 1
        below = p(h[1:], c) if h else 1 / letters
        with_h = {g: n for g, n in counts[k].items() if g[:-1] == h}
        total = sum(with_h.values())
        if not total:
            return below
        d = discount[k]
        off = lambda n: max(n - d[min(n, 3) - 1], 0)
        rest = sum(n - off(n) for n in with_h.values()) / total
        n = with_h.get(h + c, 0)
        return (off(n) if n else 0) / total + rest * below

    return lambda g: p(g[:-1], g[-1])


@pytest.mark.parametrize("shard_rows", [40, 1_000_000])
def test_perplexity_by_definition(spark, make, shard_rows):
    rng = random.Random(3)
    words = ["thing", "then", "anthem", "at", "tin", "in", "hat", "hint"]
    good = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(3, 30)))) for k in range(25)]
    other = [(100, "zzz thing"), (101, None), (102, ""), (103, "then then 日本"), (None, "hat"), (104, "a" * 600)]
    docs = make(good + other)
    ids = spark.createDataFrame([(k,) for k, _ in good], "doc_id long")
    found = {r["doc_id"]: r for r in quality.classify(docs, ids, 3, shard_rows).collect()}
    p = kneser_ney_by_hand([t for _, t in good], 3)
    for k, text in good[:8] + other:
        logs = [math.log(p(g)) for w in kn.words_of(text or "") for g in kn.grams_of(w, 3)]
        if not logs:
            assert found[k]["perplexity"] is None and found[k]["accepted"]
        else:
            assert math.isclose(found[k]["perplexity"], math.exp(-sum(logs) / len(logs)), rel_tol=1e-4)
    kept = quality.kept_rows(docs, ids, 3, shard_rows)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r["accepted"] for r in found.values())
    assert quality.classify(docs, ids.limit(0), 3).where("NOT accepted").count() == 0


def test_toxicity_held_out(spark, make):
    rng = random.Random(6)
    syllables = ["an", "the", "in", "or", "ed", "st", "re", "ou"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    rows, labels = [], []
    for k in range(600):
        toxic = int(k % 4 == 0)
        text = [word() for _ in range(60)]
        for _ in range(2 * toxic):
            text[rng.randrange(60)] = "vequ" + word()
        rows.append((k, " ".join(text)))
        labels.append((k, 1, toxic))
    labels += [(1, 1, None), (9999, 0, 1)]
    docs = make(rows + [(1000, None), (1001, "")])
    table = spark.createDataFrame(labels, "doc_id long, quality long, toxic long")
    found = {r["doc_id"]: r for r in toxicity.score(docs, table).collect()}
    truth = {k: t for k, _, t in labels[:600]}
    held = [k for k in truth if found[k]["held_out"]]
    assert 60 < len(held) < 180
    assert sum(found[k]["predicted"] == truth[k] for k in held) / len(held) > 0.95
    assert found[1000]["score"] == found[1001]["score"]
    assert all(0 <= r["score"] <= 1 for r in found.values())
    none = toxicity.score(docs, table.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}


def matches_by_hand(docs, items):
    def words(t):
        return re.sub(r"[\W_]+", " ", (t or "").lower()).split()

    def shingles(w, k):
        return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]

    out = {}
    for d, text, *_ in docs:
        w = words(text)
        for i, item in items:
            v = words(item)
            k = min(5, len(v))
            if not v:
                continue
            want = Counter(shingles(v, k))
            for s in range(max(1, len(w) - len(v) + 1)):
                have = Counter(shingles(w[s : s + len(v)], k))
                union = sum((want | have).values())
                value = sum((want & have).values()) / union if union else 0
                out[d, i] = max(value, out.get((d, i), 0))
    return out


def test_decontamination(spark, make):
    rng = random.Random(8)
    text = lambda n: [rng.choice("abcdefghij") + rng.choice("klmnopqrst") * 2 for _ in range(n)]
    items = [(k, text(rng.randint(6, 50))) for k in range(25)] + [(90, ["two", "words"]), (91, []), (92, text(7) * 6)]
    docs = []
    for k in range(160):
        body = text(rng.randint(0, 120))
        if k % 3 == 0:
            item = list(rng.choice(items)[1])
            if k % 2 and len(item) > 30:
                item[len(item) // 2] = "changed"
            at = rng.randint(0, len(body))
            body = body[:at] + item + body[at:]
        docs.append((k, (" " if k % 4 else ", ").join(body).upper() if k % 5 == 0 else " ".join(body)))
    docs += [(200, None), (201, ""), (202, "Two words!"), (None, " ".join(items[0][1])), (203, " ".join(items[1][1][:-1]))]
    bench = [(i, " ".join(w)) for i, w in items] + [(93, None)]
    table = spark.createDataFrame(bench, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.matches(make(docs), table).collect()}
    want = matches_by_hand(docs, bench)
    clear = {k for k, v in want.items() if v >= 0.8}
    assert len(clear) > 30
    # The radius and the placing of windows may miss only what is close to the threshold.
    assert {k for k in clear if want[k] >= 0.85} <= set(found) <= clear
    for k, v in found.items():
        assert v <= want[k] + 1e-12 and (want[k] < 1 or v == 1)
    plan = decontaminate.matches(make(docs), table)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "InArrow" not in plan
    docs = make(docs)
    kept = decontaminate.kept_rows(docs, table)
    assert kept.columns == docs.columns and kept.where("doc_id IN (202)").count() == 0
    assert decontaminate.matches(docs, table.limit(0)).collect() == []
    assert decontaminate.matches(docs.limit(0), table).collect() == []
