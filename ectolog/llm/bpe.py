"""Byte-level BPE encoding and decoding by corpus-level merge replay.

A task gathers its documents into blocks of bounded size and lists the
distinct pieces of a block once. An inverted index from rank to the positions
of its token pair then replays the merges in rank order over all pieces at
once; a merge touches the two neighbours of each position and nothing else.
Documents are written down as runs of piece numbers, so a piece is encoded once
however often it occurs. No rows are shuffled.

Defined cases: null and empty texts have no tokens; texts of any length
are cut whole; repeated rows give repeated results; an empty
table gives an empty table; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from ectolog.llm.rows import id_and_text, pieces, releasing

#: Text of one block; memory in a task is a small multiple of it.
BLOCK_BYTES = 1 << 20
#: Ranks that share one list of waiting positions.
RANKS_PER_BUCKET = 64
#: Positions that are ranked at a time before the first merge.
RANKED_AT_ONCE = 1 << 17


class Vocabulary:
    """Ranks of a tiktoken file, and every pair of tokens that forms another token."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.size = max(ranks.values()) + 1
        self.token = [b""] * self.size
        for token, rank in ranks.items():
            self.token[rank] = token
        self.byte_rank = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * self.size + right] = rank
        self.pair_key = np.fromiter(sorted(pairs), np.int64, len(pairs))
        self.pair_value = np.array([pairs[k] for k in self.pair_key.tolist()], np.int32)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where the pair forms no token."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[at] == key, self.pair_value[at], np.int32(-1))

    def one_rank(self, left: int, right: int) -> int:
        key = left * self.size + right
        at = int(np.searchsorted(self.pair_key, key))
        return int(self.pair_value[at]) if at < len(self.pair_key) and self.pair_key[at] == key else -1


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode_one(v: Vocabulary, piece: bytes) -> np.ndarray:
    """The merges of one piece, lowest rank and leftmost first, by a heap over linked positions."""
    ids = v.byte_rank[np.frombuffer(piece, np.uint8)]
    n = len(ids)
    ranks = v.rank_of(ids[:-1], ids[1:])
    token, rank = ids.tolist(), [*ranks.tolist(), -1]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    waiting = [(r, at) for at, r in enumerate(rank) if r >= 0]
    heapq.heapify(waiting)
    while waiting:
        r, at = heapq.heappop(waiting)
        if rank[at] != r:
            continue
        gone = after[at]
        token[at], token[gone], rank[gone] = r, -1, -1
        after[at] = after[gone]
        if after[at] < n:
            before[after[at]] = at
        for left in (before[at], at):
            if left < 0:
                continue
            right = after[left]
            rank[left] = v.one_rank(token[left], token[right]) if right < n else -1
            if rank[left] >= 0:
                heapq.heappush(waiting, (rank[left], left))
    return np.array([t for t in token if t >= 0], np.int32)


class Replay:
    """Merges in rank order over the distinct pieces of a block."""

    def __init__(self, v: Vocabulary, words: list[bytes]):
        self.v, self.words = v, words
        length = np.fromiter(map(len, words), np.int64, len(words))
        self.start = np.concatenate([[0], np.cumsum(length)])
        n = int(self.start[-1])
        raw = np.frombuffer(b"".join(words), np.uint8)
        self.token = v.byte_rank[raw]
        # Position n stands for "no neighbour".
        self.next = np.arange(1, n + 2, dtype=np.int32)
        self.last = np.arange(-1, n, dtype=np.int32)
        ends = self.start[1:][length > 0] - 1
        self.next[ends] = n
        self.last[self.start[:-1][length > 0]] = n
        self.token = np.append(self.token, np.int32(0))
        self.rank = np.full(n + 1, -1, np.int32)
        self.alive = np.ones(n, bool)
        self.n = n
        self.waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.odd: set[int] = set()

    def note(self, at: np.ndarray, lowest: int = 0) -> None:
        """Rank the pairs that begin at these positions and put them in the index."""
        right = self.next[at]
        found = np.where(
            right < self.n, self.v.rank_of(self.token[at], self.token[right]), np.int32(-1)
        )
        self.rank[at] = found
        some = found >= 0
        at, found = at[some], found[some]
        if len(at) == 0:
            return
        if lowest and (early := found < lowest).any():
            # A pair of a lower rank than its parent: leave the piece to encode_one().
            self.odd.update(
                (np.searchsorted(self.start, at[early], side="right") - 1).tolist()
            )
        bucket = found // RANKS_PER_BUCKET
        if len(at) > 1:
            order = np.argsort(bucket, kind="stable")
            at, found, bucket = at[order], found[order], bucket[order]
        cuts = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
        edges = [0, *cuts.tolist(), len(at)]
        for a, b in zip(edges, edges[1:]):
            name = int(bucket[a])
            if name not in self.waiting:
                self.waiting[name] = []
                heapq.heappush(self.order, name)
            self.waiting[name].append((found[a:b], at[a:b]))

    def merge(self, rank: int, at: np.ndarray) -> None:
        at = at[self.rank[at] == rank]
        if len(at) == 0:
            return
        if len(at) > 1:
            at = np.sort(at)
            if (same := at[1:] == at[:-1]).any():
                at = at[np.concatenate([[True], ~same])]
        if len(at) > 1 and (touch := self.next[at[:-1]] == at[1:]).any():
            # Of pairs that overlap in a row, every second one from the left.
            first = np.concatenate([[True], ~touch])
            begin = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - begin) % 2 == 0]
        gone = self.next[at]
        after = self.next[gone]
        self.token[at] = rank
        self.next[at] = after
        self.last[after] = at  # position n takes what points nowhere
        self.alive[gone] = False
        self.rank[gone] = -1
        before = self.last[at]
        self.note(np.concatenate([at, before[before < self.n]]), rank)

    def run(self) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all pieces one after the other, and where each piece begins."""
        self.order: list[int] = []
        for a in range(0, self.n, RANKED_AT_ONCE):
            self.note(np.arange(a, min(self.n, a + RANKED_AT_ONCE), dtype=np.int32))
        while self.order:
            bucket = self.order[0]
            here = self.waiting[bucket]
            ranks = np.concatenate([x[0] for x in here])
            ats = np.concatenate([x[1] for x in here])
            # The lowest rank first; whatever it leads to in this bucket is looked at again.
            order = np.argsort(ranks, kind="stable")
            ranks, ats = ranks[order], ats[order]
            here.clear()
            cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                self.merge(int(ranks[a]), ats[a:b])
                if self.order[0] != bucket or here:
                    if b < len(ranks):
                        here.append((ranks[b:], ats[b:]))
                    break
            if not here and self.order[0] == bucket:
                heapq.heappop(self.order)
                del self.waiting[bucket]
        kept = np.flatnonzero(self.alive)
        ids = self.token[:-1][kept]
        begin = np.searchsorted(kept, self.start)
        if self.odd:
            parts = np.split(ids, begin[1:-1])
            for k in self.odd:
                parts[k] = encode_one(self.v, self.words[k])
            ids = np.concatenate(parts)
            begin = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        return ids, begin


class _Numbers(dict):
    """Gives each new unit the next number."""

    def __missing__(self, unit: str) -> int:
        number = self[unit] = len(self)
        return number


#: A unit: the white space before a word and the word. A byte-level pattern ends a piece before
#: white space that follows other characters, so no piece reaches over the edge of a unit,
#: unless the unit ends in white space of another kind.
_UNIT = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
_OTHER_SPACE = re.compile(r"[\s\x1c-\x1f\x85]\Z")


def _even(text: str) -> bool:
    """Whether one space stands between words, so that a text can be cut at every space."""
    return not (
        text[:1] in ("", " ", "\n") or text[-1] == " " or "  " in text or " \n" in text
    )


def _units(texts: list[str]) -> tuple[list[np.ndarray], list[str]]:
    """Each text as a run of unit numbers, and the distinct units."""
    bare = _Numbers()
    docs: list[np.ndarray | None] = [None] * len(texts)
    plain = [k for k, t in enumerate(texts) if _even(t)]
    cut = pc.split_pattern(pa.array([texts[k] for k in plain], pa.large_string()), " ")
    words = cut.flatten().dictionary_encode()
    units = [" " + x for x in words.dictionary.to_pylist()]
    number = words.indices.to_numpy(zero_copy_only=False).astype(np.int32)
    edge = cut.offsets.to_numpy()
    for k, a, b in zip(plain, edge, edge[1:]):
        docs[k] = number[a:b]
        # The first word of a text has no space before it.
        docs[k][0] = len(units) + bare[texts[k][: max(0, texts[k].find(" "))] or texts[k]]
    for k, t in enumerate(texts):
        if docs[k] is None:
            found = map(bare.__getitem__, _UNIT.findall(t))
            docs[k] = np.fromiter(found, np.int32) + np.int32(len(units))
    return docs, units + list(bare)


def encode_texts(v: Vocabulary, find, texts: list[str]) -> Iterator[bytes]:
    """Ids of each text as little-endian unsigned 32-bit integers.

    ``find`` lists the pieces of a text; it is asked once for each distinct unit.
    """
    docs, units = _units(texts)
    words: list[bytes] = []
    first = np.zeros(len(units) + 1, np.int64)
    unsafe = []
    for k, unit in enumerate(units):
        if unit[1:].isalpha() and unit[0] == " ":
            words.append(unit.encode())
        else:
            if _OTHER_SPACE.search(unit):
                unsafe.append(k)
            words += [x.encode() for x in find(unit)]
        first[k + 1] = len(words)
    # Texts with a unit that a piece may reach over are cut whole; their pieces are replayed with the rest.
    wrong = np.zeros(len(units) + 1, bool)
    wrong[unsafe] = True
    n_units = len(units)
    whole = _Numbers()
    for k, text in enumerate(texts):
        if unsafe and wrong[docs[k]].any():
            docs[k] = np.array([n_units + whole[x] for x in find(text)], np.int32)
    words += [x.encode() for x in whole]
    first = np.concatenate([first, first[-1] + 1 + np.arange(len(whole))])
    ids, begin = Replay(v, words).run()
    ids = ids.astype("<u4")
    begin = begin[first].astype(np.int32)
    size = np.diff(begin).astype(np.int32)
    for doc in docs:
        count = size[doc]
        end = np.cumsum(count, dtype=np.int32)
        total = int(end[-1]) if len(end) else 0
        at = np.arange(total, dtype=np.int32) + np.repeat(begin[doc] - end + count, count)
        yield ids[at].tobytes()


def encode(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id``, ``ids`` (binary, little-endian unsigned 32-bit) of every text.

    ``path`` is a tiktoken rank file that every worker can read, ``pattern``
    what cuts a text before the merges; each of its matches must end before white
    space that follows other characters, and keep letters and one space before them together. Special tokens are plain text.
    """
    schema = "doc_id long, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, find = vocabulary(path), regex.compile(pattern).findall

        def flush(keys, texts):
            out, held = [], 0
            for ids in encode_texts(v, find, texts):
                out.append(ids)
                held += len(ids)
                if held > 2 << 20:
                    yield _ids_batch(keys[: len(out)], out)
                    keys, out, held = keys[len(out) :], [], 0
            if out:
                yield _ids_batch(keys, out)

        keys: list = []
        texts: list[str] = []
        held = 0
        for batch in batches:
            for part in pieces(batch, BLOCK_BYTES):
                keys += part.column(0).to_pylist()
                texts += part.column(1).to_pylist()
                held += part.column(1).nbytes
                if held >= BLOCK_BYTES:
                    yield from flush(keys, texts)
                    keys, texts, held = [], [], 0
        if keys:
            yield from flush(keys, texts)

    return id_and_text(docs, id_col, text_col).mapInArrow(releasing(run), schema)


def _ids_batch(keys: list, ids: list[bytes]) -> pa.RecordBatch:
    return pa.record_batch(
        [pa.array(keys, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "ids"]
    )


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``ids`` and ``decoded`` (binary): the bytes of the tokens one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = vocabulary(path).token
        for batch in batches:
            for part in pieces(batch, BLOCK_BYTES):
                out = [
                    b"".join(map(token.__getitem__, np.frombuffer(x, "<u4").tolist()))
                    for x in part.column(1).to_pylist()
                ]
                yield pa.record_batch(
                    [part.column(0), part.column(1), pa.array(out, pa.binary())],
                    ["doc_id", "ids", "decoded"],
                )

    return encoded.select("doc_id", "ids").mapInArrow(
        releasing(run), "doc_id long, ids binary, decoded binary"
    )
