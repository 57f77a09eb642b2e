"""Licences of many lines, whatever their case, punctuation, wrapping and copyright lines."""

import hashlib
import os
import random
import re
import textwrap

import pytest

from ectolog.llm import licences

FILES = "/usr/share/common-licenses"
MIT = licences.NOTICES["MIT"][1]
APACHE = licences.NOTICES["Apache-2.0"][1]


def plain_words(line):
    """The canonical form as the docstring says it, with other means."""
    words = re.findall(r"[a-z0-9\u0080-\U0010FFFF]+", line.lower())
    return [w for word in words for w in licences.SPELLINGS.get(word, word).split()]


def brute(text, table):
    """Every run of lines of the text, compared with every known text."""
    lines = [[] if licences.COPYRIGHT.fullmatch(x.lower()) else plain_words(x) for x in text.split("\n")]
    full = [k for k, x in enumerate(lines) if x]
    runs = {("text", None, None): [w for x in lines for w in x]}
    for i, a in enumerate(full):
        for b in full[i:]:
            runs["line" if a == b else "lines", a, b] = [w for x in lines[a : b + 1] for w in x]
    found = set()
    for place, words in runs.items():
        sha = hashlib.sha256(" ".join(words).encode()).hexdigest()
        found |= {(*place, name) for name, _, _, known in table if known == sha}
    return found


def got(df):
    rows = df.collect()
    found = {}
    for r in rows:
        found.setdefault(r["doc_id"], set()).add((r["scope"], r["line"], r["last_line"], r["licence"]))
    return found


def changed(text, rng):
    """The same licence in another dress."""
    paragraphs = []
    for paragraph in re.split(r"\n\s*\n", text):
        for width in rng.sample(range(40, 120), 80):
            lines = textwrap.wrap(paragraph, width)
            if any(licences.COPYRIGHT.fullmatch(x.lower()) for x in paragraph.split("\n")):
                paragraphs.append(paragraph)
                break
            # Another wrapping must not make a copyright line of a sentence.
            if not any(licences.COPYRIGHT.fullmatch(x.lower()) for x in lines):
                paragraphs.append("\n".join(lines))
                break
    text = "\n\n".join(paragraphs)
    text = text.replace('"', rng.choice(["''", "“", ""])) if rng.random() < 0.5 else text
    text = text.upper() if rng.random() < 0.5 else text
    return re.sub(r"\blicense\b", "licence", text) if rng.random() < 0.5 else text


def test_runs_of_lines_by_brute_force(spark, make):
    rng = random.Random(2)
    known = licences.known_licences(spark)
    table = [tuple(r) for r in known.collect()]
    short = [t for texts in licences.NOTICES.values() for t in texts]
    rows = [
        (1, f"Copyright (c) 2020 Some One\n\n{MIT}"),
        (2, f"Intro.\nCopyright law is a matter of its own.\n{APACHE}\nThe end."),
        (3, "Copyright law\nReleased under the MIT License."),
        (4, "No licence here, and released under\nthe mit licence\nin two lines that are three."),
        (5, None),
        (6, "Released under\nthe MIT\n\n(License)"),
    ]
    for k in range(40):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            parts.append(changed(rng.choice(short), rng))
            parts.append(rng.choice(["", "words in between", "Copyright (C) 2001-2020, A. B.\nAll rights reserved.", "© 1999 me"]))
        rows.append((100 + k, "\n".join(parts)))
    found = got(licences.scan(make(rows), known))
    want = {i: brute(t or "", table) for i, t in rows}
    assert found == {i: x for i, x in want.items() if x}
    assert ("text", None, None, "MIT") in found[1] and ("lines", 0, 3, "MIT") in found[6]
    assert {x[3] for x in found[2]} == {"Apache-2.0"} and found[3] == {("line", 1, 1, "MIT")}
    # Any number of known texts, in slices.
    assert got(licences.scan(make(rows), known, slice_rows=5)) == found


@pytest.mark.skipif(not os.path.isdir(FILES), reason="no licence texts on this machine")
def test_whole_licences(spark, make):
    names = {"Apache-2.0": "Apache-2.0", "GPL-3": "GPL-3.0", "GPL-2": "GPL-2.0", "MPL-2.0": "MPL-2.0", "BSD": "BSD-3-Clause", "LGPL-2.1": "LGPL-2.1"}
    rng, rows = random.Random(1), []
    for k, name in enumerate(names):
        with open(f"{FILES}/{name}", encoding="utf-8") as f:
            text = f.read()
        rows.append((k, text))
        rows.append((100 + k, f"Our own words.\n\n{changed(text, random.Random(k)).lower()}\n\nOurs again. {rng.random()}"))
    found = got(licences.scan(make(rows), licences.known_licences(spark)))
    for k, licence in enumerate(names.values()):
        assert ("text", None, None, licence) in found[k]
        assert any(x[0] == "lines" and x[3] == licence for x in found[100 + k])


def test_texts_of_ones_own(spark, make):
    own = spark.createDataFrame([("X", "My own\nlicence."), ("Y", None), ("Z", "...")], "licence string, text string")
    found = got(licences.scan(make([(1, "a\nMy OWN license"), (2, ""), (3, "...")]), own))
    assert found == {1: {("line", 1, 1, "X")}}
    assert licences.scan(make([]), own).collect() == []
