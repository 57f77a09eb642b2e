"""Quality rules: stated counts of each text, and lines labelled by a conditional random field.

Each line of a document gets measures (length, kinds of characters, repetition,
ending), coded in steps. A linear-chain field over the codes marks lines as
content or boilerplate by Viterbi decoding of the whole text; a document stays
if enough of its words stand in content.

Training: labels say only which documents are good. Lines of good documents are
content; those of bad ones begin as boilerplate, and rounds of training and
decoding move lines that look like content over, as long as half of the words of
the document stay boilerplate. The field is fitted in one task on at most
``SAMPLE`` different texts of each label (those of the smallest hashes, with at
most ``MOST_LINES`` lines); every document is then labelled.

Defined cases: null texts count as empty: no words, ``base_failed``, not kept; a
text without line breaks is one line; blank lines are labelled like others, but
hold no words; ids labelled in both ways aren't trained on; unless there are
texts of both labels every line is content; repeated rows give repeated results;
an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ectolog.llm import crf
from ectolog.llm.rows import SPACES, bounded, id_and_text, pieces, stored

#: Base rules of the contract.
LEAST_WORDS = 20
WINDOW = 8
MOST_REPEATED_PERCENT = 30
SYMBOLS = "#*$%&|<>"

#: Texts of each label in the sample, and lines of one of them at most.
SAMPLE = 2000
MOST_LINES = 100
ROUNDS = 3
#: A line of a bad document is content once the field is that sure.
SURE = 0.9
#: Least share of the words in content lines.
CONTENT_SHARE = 0.5

#: Upper bounds of the steps of each measure of a line.
STEPS = {
    "words": (0.5, 2.5, 7.5, 19.5),
    "symbols": (0.0, 0.01, 0.04, 0.1, 0.2),
    "marks": (0.0, 0.03, 0.08, 0.15, 0.3),
    "bangs": (0.0, 0.02, 0.06),
    "uppers": (0.0, 0.08, 0.25, 0.6),
    "digits": (0.0, 0.05, 0.2),
    "word_length": (2.0, 3.5, 6.0, 8.0, 12.0),
    "distinct": (0.35, 0.6, 0.85),
    "repeated": (0.0, 0.3, 0.8),
    "echoes": (0.0, 0.1, 0.4),
    "double": (0.5,),
    "sentence": (0.5,),
}
OFFSETS = np.cumsum([0] + [len(s) + 1 for s in STEPS.values()])
N_CODES = int(OFFSETS[-1])
PIECE_BYTES = 4 << 20

_SPACE, _UPPER, _LETTER, _DIGIT, _SYMBOL, _END, _BANG = (1 << k for k in range(7))


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """Kinds of each character of the basic plane; those beyond have none."""
    out = np.zeros(1 << 16, np.uint8)
    for code in range(1 << 16):
        c = chr(code)
        out[code] = _UPPER * c.isupper() + _LETTER * c.isalpha() + _DIGIT * c.isdigit()
    for kind, chars in ((_SPACE, SPACES), (_SYMBOL, SYMBOLS), (_END, ".!?"), (_BANG, "!")):
        for c in chars:
            out[ord(c)] |= kind
    return out


def repeated_words(words: np.ndarray, doc: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Which words stand in windows found twice or more in their document. Exact, by ranks of pairs.

    ``words`` are numbers of the words of all documents in order, ``doc`` their
    documents; ``window`` is a power of two.
    """
    n = len(words)
    out = np.zeros(n, bool)
    rank, size = words.astype(np.int64), 1
    while size < window:
        if len(rank) <= size:
            return out
        pair = rank[:-size] * (int(rank.max()) + 1) + rank[size:]
        rank, size = np.unique(pair, return_inverse=True)[1].astype(np.int64), 2 * size
    starts = np.flatnonzero(doc[: n - window + 1] == doc[window - 1 :])
    key = rank[starts] * (int(doc.max(initial=0)) + 1) + doc[starts]
    _, at, count = np.unique(key, return_inverse=True, return_counts=True)
    found = starts[count[at] > 1]
    edge = np.zeros(n + 1, np.int64)
    edge[found] += 1
    edge[found + window] -= 1  # starts differ, so no place is written twice
    return np.cumsum(edge)[:n] > 0


class Measured:
    """Counts of texts and codes of their lines; lines of all texts stand behind each other."""

    def __init__(self, texts: list[str]):
        n = len(texts)
        joined = "\n".join(texts)
        self.lines_of = np.array([t.count("\n") + 1 for t in texts], np.int64)
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        kinds = np.where(codes < 1 << 16, _kinds()[codes & 0xFFFF], 0).astype(np.uint8)
        breaks = np.flatnonzero(codes == 10)
        starts = np.concatenate([[0], breaks + 1])
        ends = np.concatenate([breaks, [len(codes)]])
        first_line = np.concatenate([[0], np.cumsum(self.lines_of)])
        by_doc = lambda v: np.add.reduceat(v, first_line[:-1]) if n else v[:0]

        def count(of: np.ndarray) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(of, dtype=np.int64)])
            return sums[ends] - sums[starts]

        inside = (kinds & _SPACE) == 0
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        chars, line_words = count(inside), count(begins)
        symbols, letters = count((kinds & _SYMBOL) > 0), count((kinds & _LETTER) > 0)
        uppers, digits = count((kinds & _UPPER) > 0), count((kinds & _DIGIT) > 0)
        bangs = count((kinds & _BANG) > 0)
        shown = np.concatenate([[-1], np.flatnonzero(inside)])
        last = shown[np.searchsorted(shown, ends) - 1]
        sentence = (last >= starts) & ((kinds[np.maximum(last, 0)] & _END) > 0) if len(codes) else last >= starts

        number: dict[bytes, int] = {}
        words = np.array([number.setdefault(w, len(number)) for w in joined.encode().split()], np.int64)
        line = np.repeat(np.arange(len(starts)), line_words)
        doc_of_line = np.repeat(np.arange(n), self.lines_of)
        repeated = repeated_words(words, doc_of_line[line])
        different = np.unique(line * (len(number) + 1) + words) // (len(number) + 1)
        echo = np.flatnonzero((words[1:] == words[:-1]) & (line[1:] == line[:-1]))
        per_line = lambda of: np.bincount(of, minlength=len(starts))
        double = self._doubles(texts, line_words)

        self.line_words = line_words
        self.n_words, self.word_chars, self.n_symbols = by_doc(line_words), by_doc(chars), by_doc(symbols)
        self.n_dup_lines = by_doc(double.astype(np.int64))
        self.n_repeat_words = by_doc(per_line(line[repeated]))
        c, w = np.maximum(chars, 1), np.maximum(line_words, 1)
        values = {
            "words": line_words,
            "symbols": symbols / c,
            "marks": (chars - letters - digits) / c,
            "bangs": bangs / c,
            "uppers": uppers / np.maximum(letters, 1),
            "digits": digits / c,
            "word_length": chars / w,
            "distinct": per_line(different) / w,
            "repeated": per_line(line[repeated]) / w,
            "echoes": per_line(line[echo]) / w,
            "double": double,
            "sentence": sentence,
        }
        self.codes = np.stack(
            [np.searchsorted(steps, values[name]) + at for (name, steps), at in zip(STEPS.items(), OFFSETS)], axis=1
        ).astype(np.uint8)

    @staticmethod
    def _doubles(texts: list[str], line_words: np.ndarray) -> np.ndarray:
        out, at = np.zeros(len(line_words), bool), 0
        full = (line_words > 0).tolist()
        for text in texts:
            seen: set[str] = set()
            for line in text.split("\n"):
                if full[at]:
                    out[at] = line in seen
                    seen.add(line)
                at += 1
        return out

    def chains(self) -> list[np.ndarray]:
        return np.split(self.codes, np.cumsum(self.lines_of)[:-1])


def _sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """``row``, ``quality`` of the sampled texts, ``row`` a hash of id and text."""
    row = F.xxhash64("doc_id", "text").alias("row")
    rows = id_and_text(docs).where("doc_id IS NOT NULL").select("doc_id", row).distinct()
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id")
    known = known.agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other")
    found = stored(rows.join(known.select("doc_id", "quality"), "doc_id").select("row", "quality"))
    part = lambda q: found.where(f"quality = {q}").orderBy("row").limit(most)
    return stored(part(0).union(part(1)))


def _coded(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """``row``, ``quality``, ``codes``, ``words`` (bytes) of the sampled texts."""
    schema = "row long, quality int, codes binary, words binary"
    rows = id_and_text(docs).select(F.xxhash64("doc_id", "text").alias("row"), "text")
    rows = rows.join(F.broadcast(sample), "row").select("row", "quality", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, PIECE_BYTES):
                found = Measured(part.column(2).to_pylist())
                words = np.split(found.line_words, np.cumsum(found.lines_of)[:-1])
                out = [
                    (row, quality, codes.tobytes(), n.astype("<i8").tobytes())
                    for row, quality, codes, n in zip(
                        part.column(0).to_pylist(), part.column(1).to_pylist(), found.chains(), words
                    )
                    if len(codes) <= MOST_LINES
                ]
                columns = list(zip(*out)) or [()] * 4
                kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
                yield pa.record_batch(arrays, ["row", "quality", "codes", "words"])

    return rows.mapInArrow(run, schema).dropDuplicates(["row"])


def learn(chains: list[np.ndarray], words: list[np.ndarray], good: list[bool], rounds: int = ROUNDS) -> crf.Field:
    """The field of coded documents of which it is known whether they are good."""
    field = crf.Field.flat(N_CODES)
    if not chains or all(good) or not any(good):
        return field
    side = crf.Chains(chains)
    sizes = np.array([len(chains[i]) for i in side.order])
    bad = np.repeat([not good[i] for i in side.order], sizes)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    n = np.concatenate([words[i] for i in side.order])
    labels = np.where(bad, crf.BOILERPLATE, crf.CONTENT)
    field = crf.Field(np.zeros((N_CODES, 2)), np.zeros((2, 2)), np.zeros(2))
    for k in range(rounds):
        field = crf.fit(field, side, labels)
        if k == rounds - 1:
            break
        sure = side.marginals(field)[0][:, crf.CONTENT] > SURE
        moved = np.bincount(doc, n * sure, len(sizes)) * 2 <= np.bincount(doc, n, len(sizes))
        labels = np.where(bad & ~(sure & moved[doc]), crf.BOILERPLATE, crf.CONTENT)
    return field


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> crf.Field:
    """The field of the sampled texts, fitted in one task."""
    width = len(STEPS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        chains = [np.frombuffer(r[2], np.uint8).reshape(-1, width) for r in rows]
        words = [np.frombuffer(r[3], "<i8") for r in rows]
        data = learn(chains, words, [r[1] == 1 for r in rows]).packed()
        yield pa.record_batch([pa.array([data.tolist()], pa.list_(pa.float64()))], ["data"])

    coded = _coded(docs, _sample(docs, labels, most))
    return crf.Field.unpacked(np.array(coded.coalesce(1).mapInArrow(run, "data array<double>").first()["data"]))


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, n_lines long, n_content_lines long, n_content_words long"
)


def apply_rules(docs: DataFrame, field: crf.Field, share: float = CONTENT_SHARE) -> DataFrame:
    """Counts, ``base_failed`` and ``kept`` of each document, and what is content of it."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, PIECE_BYTES):
                found = Measured(part.column(1).to_pylist())
                scores = field.scores(found.codes)
                border = np.concatenate([[0], np.cumsum(found.lines_of)])
                marks = [crf.viterbi(scores[a:b], field.turns, field.start) for a, b in zip(border, border[1:])]
                content = np.concatenate(marks).astype(np.int64)
                n_content = np.add.reduceat(content, border[:-1])
                in_content = np.add.reduceat(content * found.line_words, border[:-1])
                failed = (found.n_words < LEAST_WORDS) | (
                    100 * found.n_repeat_words > MOST_REPEATED_PERCENT * found.n_words
                )
                kept = ~failed & (in_content >= share * found.n_words)
                columns = [found.n_words, found.word_chars, found.n_symbols, found.n_dup_lines, found.n_repeat_words]
                columns += [failed, kept, found.lines_of, n_content, in_content]
                yield pa.record_batch([part.column(0), *map(pa.array, columns)], names)

    return id_and_text(docs).mapInArrow(run, SCHEMA)


def lines(docs: DataFrame, field: crf.Field) -> DataFrame:
    """``doc_id``, ``line`` (from 0), ``content``, ``text`` of every line."""
    schema = "doc_id long, line long, content boolean, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, PIECE_BYTES):
                texts = part.column(1).to_pylist()
                out = []
                for doc_id, text, codes in zip(part.column(0).to_pylist(), texts, Measured(texts).chains()):
                    labels = crf.viterbi(field.scores(codes), field.turns, field.start)
                    out += [(doc_id, k, bool(c), t) for k, (c, t) in enumerate(zip(labels, text.split("\n")))]
                kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.string())
                yield pa.record_batch(
                    [pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["doc_id", "line", "content", "text"]
                )

    return id_and_text(docs).mapInArrow(run, schema)


def judge(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, share: float = CONTENT_SHARE) -> DataFrame:
    """What ``apply_rules`` returns, under a field trained on labelled documents."""
    return apply_rules(docs, train(docs, labels, most), share)
