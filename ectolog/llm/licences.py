"""Licence scan by canonical digest lookup.

A text is normalised (lower case, copyright lines out, equivalent spellings made
one, punctuation and white space out) and its SHA-256 is joined with the digests
of known licences, normalised the same way. Besides the whole text, every run of
its lines that has the number of words and the first words of a known text is
looked up, however it is wrapped: a notice on a line of its own, or a licence of
many lines inside of a longer text. Only digests of such runs are joined; the
texts stay where they are.

Each text is read once. The known first words and lengths go to the tasks in
slices of at most ``SLICE`` known texts, one pass each, so that any number of
known texts can be looked up.

Defined cases: null texts count as empty; texts and lines without letters or
digits are never looked up; a text that equals several known ones gives each;
a run of a single line has the scope ``line``, of more lines ``lines``, and a
text that is known as a whole has the scope ``text`` besides; repeated rows give
repeated results; without known licences, or with an empty table, the result is
empty; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ectolog.llm.rows import id_and_text, pieces

#: Equivalent spellings, as words after normalisation.
SPELLINGS = {
    "licence": "license",
    "licenced": "licensed",
    "licencing": "licensing",
    "sublicence": "sublicense",
    "acknowledgement": "acknowledgment",
    "judgement": "judgment",
    "favour": "favor",
    "fulfilment": "fulfillment",
    "organisation": "organization",
    "merchantibility": "merchantability",
    "noninfringement": "non infringement",
    "copyholder": "copyright holder",
    "https": "http",
    "v2": "version 2",
    "v3": "version 3",
    "gpl": "gnu general public license",
    "cc": "creative commons",
}

#: Notices that licences ask to be put on a work, and short licences.
NOTICES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
        "in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be "
        "included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", "
        "WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS "
        "OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
        "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR "
        "OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This work is licensed under the GPL, version 3.",
    ),
    "GPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, "
        "or (at your option) any later version. This program is distributed in the hope that it will be useful, "
        "but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a "
        "copy of the GNU General Public License along with this program. If not, see "
        "<https://www.gnu.org/licenses/>.",
    ),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.",),
    "BSD-3-Clause": ("Released under the BSD 3-Clause License.",),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the "
        "MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all "
        "copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS "
        "SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR "
        "BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER "
        "RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER "
        "TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
}

#: Licence, number of words, first words and digest of the canonical form of whole licences.
DIGESTS: tuple[tuple[str, int, str, str], ...] = (
    ("Apache-2.0", 1431, "apache license version 2", "f45538b138cf9aea39fa205de037a0bede8305e68281650e7ab809a8b3ebb2f0"),
    ("Apache-2.0", 1602, "apache license version 2", "e87dea5078ce2faaea46d3475af18d30a5c0ac0f09425b60b3e0c6569f72f8d2"),
    ("Artistic-1.0-Perl", 983, "the artistic license preamble", "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2"),
    ("BSD-2-Clause", 186, "redistribution and use in", "a56fee4b2f66331ed54da4950ef9c9391453fd1490b4d8ea202bc29683bcbd30"),
    ("BSD-3-Clause", 214, "redistribution and use in", "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651"),
    ("BSD-3-Clause", 217, "redistribution and use in", "9b83d3dee0616d07b82a272dd9bf5134a9f402b750f5ee6188458073b0a32ff2"),
    ("CC0-1.0", 1088, "creative commons legal code", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", 3315, "gnu free documentation license", "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60"),
    ("GFDL-1.3", 3734, "gnu free documentation license", "0518ec8a3f6d28aea5944931ad2a84e0e6c26046e233400e2b84c4ab3d76d0bf"),
    ("GPL-1.0", 2067, "gnu general public license", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0", 2975, "gnu general public license", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0", 5705, "gnu general public license", "8219c96910d0b89921ad79ea880af2dab0ae29ea290968138c8358b18b69cff6"),
    ("LGPL-2.0", 4206, "gnu library general public", "ef41ee09d8aa8771b7e357e916630e2a3c47e12518e13badeab697b8caa28812"),
    ("LGPL-2.1", 4404, "gnu lesser general public", "f920b7f157c3c3764246eab6e78c087f9a160d61050b2eb4c717003890a2d562"),
    ("LGPL-3.0", 1261, "gnu lesser general public", "3ede7494a82fe6f9c1d0a28646ae309d51b9cc301b39d60d0de3be5c1869bd38"),
    ("MPL-1.1", 3786, "mozilla public license version", "cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6"),
    ("MPL-2.0", 2426, "mozilla public license version", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
)

#: A line that says whose the work is: the word or sign, then a year, a sign, a blank to fill in or a name.
COPYRIGHT = re.compile(
    r"^[^a-z0-9\n©]*(?:copyright\b[^a-z0-9\n]*(?:\(c\)|©|[0-9]{4}|[<\[{]|by\b|$)|\(c\)[^a-z0-9\n]*[0-9]{4}|©|all rights reserved\b)[^\n]*$",
    re.ASCII | re.MULTILINE,
)
#: Words by which a run of lines is found before its digest is taken.
FIRST_WORDS = 4
#: Known texts that go to the tasks at once.
SLICE = 20_000

_APART = bytes(
    c if c >= 128 or chr(c).isalnum() or c == 10 else 32 for c in range(256)
)
_EQUAL = {a.encode(): b.encode().split() for a, b in SPELLINGS.items()}


def line_words(text: str) -> list[list[bytes]]:
    """The canonical words of each line."""
    text = text.lower()
    if "copyright" in text or "(c)" in text or "©" in text or "all rights reserved" in text:
        text = COPYRIGHT.sub("", text)
    out = []
    for line in text.encode().translate(_APART).split(b"\n"):
        words = line.split()
        if not _EQUAL.keys().isdisjoint(words):
            words = [w for word in words for w in _EQUAL.get(word, (word,))]
        out.append(words)
    return out


def digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def canonical_row(licence: str, text: str) -> tuple[str, int, str, str]:
    """``licence``, ``n_words``, ``first``, ``digest`` of a known text."""
    words = [w for line in line_words(text) for w in line]
    return licence, len(words), b" ".join(words[:FIRST_WORDS]).decode(), digest(words)


KNOWN = "licence string, n_words long, first string, digest string"


def known_licences(spark: SparkSession) -> DataFrame:
    """The table of known texts: notices, short licences, and digests of whole licences."""
    rows = [canonical_row(name, text) for name, texts in NOTICES.items() for text in texts]
    return spark.createDataFrame([*rows, *DIGESTS], KNOWN).distinct()


def known_notices(spark: SparkSession) -> DataFrame:
    """``licence``, ``text`` of the notices stated here."""
    rows = [(name, text) for name, texts in NOTICES.items() for text in texts]
    return spark.createDataFrame(rows, "licence string, text string")


def known_texts(texts: DataFrame) -> DataFrame:
    """The same table of texts of one's own: ``licence``, ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns))
            rows = [canonical_row(licence, text) for licence, text in rows if text is not None]
            yield _batch([r for r in rows if r[1]], KNOWN)

    return texts.select(F.col("licence").cast("string"), F.col("text").cast("string")).mapInArrow(run, KNOWN).distinct()


FOUND = "doc_id long, scope string, line int, last_line int, digest string"
_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names = [c.split() for c in schema.split(", ")]
    columns = zip(*rows) if rows else [()] * len(names)
    return pa.record_batch([pa.array(c, _KINDS[k]) for c, (_, k) in zip(columns, names)], [n for n, _ in names])


def runs_of(text: str, starts: dict[bytes, list[tuple[list[bytes], int]]], sizes: set[int]):
    """(scope, first line, last line, digest) of what may be known.

    ``starts`` has, by the first word, the first words and numbers of words of
    known texts; ``sizes`` all numbers of words.
    """
    lines = line_words(text)
    total = sum(map(len, lines))
    if total in sizes:
        yield "text", None, None, digest([w for line in lines for w in line])
    every, ends, borders = None, None, None
    for at, line in enumerate(lines):
        hits = starts.get(line[0]) if line else None
        if not hits:
            continue
        if every is None:
            every, ends, borders = [], {}, []
            for k, words in enumerate(lines):
                borders.append(len(every))
                every += words
                if words:
                    ends[len(every)] = k
        begin = borders[at]
        for first, size in hits:
            last = ends.get(begin + size)
            if last is not None and every[begin : begin + len(first)] == first:
                yield "line" if last == at else "lines", at, last, digest(every[begin : begin + size])


def candidates(docs: DataFrame, first: list[tuple[str, int]]) -> DataFrame:
    """``FOUND`` of each run of lines and whole text that begins and is as long as a known one."""
    starts: dict[bytes, list[tuple[list[bytes], int]]] = {}
    for text, size in sorted(set(first)):
        words = text.encode().split()
        starts.setdefault(words[0], []).append((words, size))
    sizes = {size for _, size in first}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 4 << 20):
                out = [
                    (doc_id, *found)
                    for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist())
                    for found in runs_of(text, starts, sizes)
                ]
                yield _batch(out, FOUND)

    return id_and_text(docs).mapInArrow(run, FOUND)


def scan(docs: DataFrame, known: DataFrame, slice_rows: int = SLICE) -> DataFrame:
    """``doc_id``, ``scope``, ``line``, ``last_line``, ``licence``, ``digest`` of what is known.

    ``known`` has the columns of ``known_licences`` or ``licence`` and ``text``; lines
    count from 0 and are null for a whole text.
    """
    if "text" in known.columns:
        known = known_texts(known)
    slices = max(1, -(-known.count() // slice_rows))
    found = None
    for k in range(slices):
        some = known.where(F.pmod(F.xxhash64("licence", "digest"), F.lit(slices)) == k)
        first = [(r["first"], r["n_words"]) for r in some.select("first", "n_words").distinct().collect()]
        part = candidates(docs, first).join(F.broadcast(some.select("licence", "digest")), "digest")
        found = part if found is None else found.union(part)
    return found.select("doc_id", "scope", "line", "last_line", "licence", "digest")
