"""Secret scan: stated patterns, and random strings found by their token efficiency.

A tokenizer's vocabulary writes words in few tokens and random strings in many.
A run of key characters with few characters per token is reported as ``random``
unless it is a known kind of digest or identifier, or a stated pattern already
covers it.

Defined cases: null texts count as empty and have no spans; texts are scanned
whole, in code points; repeated rows give repeated results; an empty table gives
an empty table; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from ectolog.llm.rows import id_and_text, pieces

#: In the order in which spans that begin together are listed.
KINDS = ("assign", "access", "hex", "random")

#: Letters of ASCII only in either case: no other letter folds into them.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.ASCII | re.IGNORECASE,
)
ASSIGN_LEAST = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_LEAST = 20
HEX = re.compile(r"[0-9a-f]+")
HEX_LONG = re.compile(r"[0-9a-f]{24,}")
HEX_LEAST = 24

#: Runs that could be a key.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Known digests (MD5, SHA-1, SHA-2 in either case of hex) and identifiers (UUID, decimal numbers).
KNOWN = re.compile(
    r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})"
    r"|(?:[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{56}|[0-9A-F]{64}|[0-9A-F]{96}|[0-9A-F]{128})"
    r"|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"
    r"|[0-9+-]+"
)
#: Marks between the words of paths and identifiers. A run without digits is tested by what
#: stands between them, so that marks don't make words look random.
BETWEEN = re.compile(r"[_/+=-]+")
DIGIT = re.compile(r"[0-9]")
#: Fewer characters per token than this is no language.
MOST_CHARS_PER_TOKEN = 2.2


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(
        "scan", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}
    )


def stated(text: str) -> list[tuple[int, int, str]]:
    """Spans (start, kind number, end) of the stated patterns."""
    found = [
        (m.start(), 0, m.end())
        for m in ASSIGN.finditer(text)
        if m.end(2) - m.start(2) >= ASSIGN_LEAST
    ]
    if "AKIA" in text:
        found += [
            (m.start(), 1, m.end())
            for m in ACCESS.finditer(text)
            if m.end() - m.start() >= ACCESS_LEAST
        ]
    # A long run is what a greedy run of any length gives once the short ones are dropped.
    found += [(m.start(), 2, m.end()) for m in HEX_LONG.finditer(text)]
    return sorted(found)


def inefficient(text: str, tokens, most: float = MOST_CHARS_PER_TOKEN) -> list[tuple[int, int]]:
    """Runs with at most ``most`` characters per token that are no known digest or identifier."""
    found = []
    for m in RUN.finditer(text):
        if KNOWN.fullmatch(m[0]):
            continue
        parts = [m[0]] if DIGIT.search(m[0]) else BETWEEN.split(m[0])
        n = sum(map(len, parts))
        if n and n <= most * sum(len(tokens(part)) for part in parts):
            found.append((m.start(), m.end()))
    return found


def spans_of(text: str, tokens, most: float = MOST_CHARS_PER_TOKEN) -> list[tuple[int, int, str]]:
    base = stated(text)
    added = [
        (a, 3, b)
        for a, b in inefficient(text, tokens, most)
        if not any(a < y and x < b for x, _, y in base)
    ]
    return sorted(base + added)


def joined(spans) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in spans)


SCHEMA = (
    "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base string, spans string"
)


def scan(
    docs: DataFrame,
    path: str,
    pattern: str,
    most: float = MOST_CHARS_PER_TOKEN,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Spans of each text: counts by kind, ``base`` (stated kinds) and ``spans`` (all), as
    ``kind:start:end`` joined by commas. ``path`` is a tiktoken rank file on every worker."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoding(path, pattern).encode_ordinary
        for batch in batches:
            for part in pieces(batch):
                out = []
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    spans = spans_of(text, tokens, most)
                    kinds = [s[1] for s in spans]
                    out.append(
                        (key, *(kinds.count(k) for k in range(4)))
                        + (joined([s for s in spans if s[1] < 3]), joined(spans))
                    )
                kinds = [pa.int64()] * 5 + [pa.string()] * 2
                columns = zip(*out)
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)
