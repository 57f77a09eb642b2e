"""SimHash near-duplicates by Golay-code fuzzy hashing.

Fingerprints of 64 bits link at ``RADIUS`` = 3 or fewer differing bits. They are
cut into three segments of 22, 21 and 21 bits, each read as a word of the binary
Golay code (23, 12, 7). Every such word lies within three bits of exactly one
codeword, so the codewords of a segment and of its one-bit neighbours (one or
six of them) include that of any segment one bit away: these are its keys. Of
three errors over three segments, either one segment has none and another at
most one, or each has exactly one. A pair within the radius therefore meets

* under an exact segment with a key of another segment (six such choices), or
* under a key of each of the three segments,

and no pair is lost. One side of the join sends its own codewords, the other all
keys; the distance is verified in the join, and only links leave it. Equal
fingerprints are one node, so that the links of a node are bounded by the 43,744
fingerprints within three bits, however many copies there are. Components come from alternating star steps over the links, each cut by a
reliable checkpoint.

Defined cases: null texts and texts without words have fingerprint zero, which
links like any other; rows without ``doc_id`` take part in links, and get the
smallest id of their component, null if it has none; repeated rows give repeated
results; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ectolog.llm.rows import bounded, id_and_text, pieces
from ectolog.session import settle

SHINGLE_WORDS = 3
SEED = 42
RADIUS = 3
#: First bit and width of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Shingles whose bits are counted at once, and nodes whose keys are listed at once.
SHINGLES_AT_ONCE = 1 << 16
NODES_AT_ONCE = 1000
#: Edges that a task keeps of a star step; there are at least as many tasks as cores.
EDGES_OF_A_TASK = 1_000_000


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have, as a signed long; 0 of none."""
    counts = np.zeros(64, np.int64)
    for a in range(0, len(hashes), SHINGLES_AT_ONCE):
        part = hashes[a : a + SHINGLES_AT_ONCE].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint(text: str) -> int:
    """Majority of the bits of the XXH64 of all word shingles, repeats included."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    last = max(1, len(words) - SHINGLE_WORDS + 1)
    counts = np.zeros(64, np.int64)
    for a in range(0, last, SHINGLES_AT_ONCE):
        b = min(a + SHINGLES_AT_ONCE, last)
        hashes = np.fromiter(
            (
                xxhash.xxh64_intdigest(b" ".join(words[i : i + SHINGLE_WORDS]), SEED)
                for i in range(a, b)
            ),
            np.uint64,
            b - a,
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    set_bits = np.packbits(2 * counts > last, bitorder="little")
    return int(set_bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``fp`` (64 bits as a signed long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                fps = [fingerprint(t) for t in part.column(1).to_pylist()]
                yield pa.record_batch([part.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


#: Generator polynomial of the binary Golay code of length 23 (fixed value).
GOLAY = 0b101011100011


@lru_cache(maxsize=1)
def _syndromes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the lower 12 and the upper 11 bits, and the error of each syndrome."""

    def rest(x: int) -> int:
        for bit in range(22, 10, -1):
            if x >> bit & 1:
                x ^= GOLAY << (bit - 11)
        return x

    low = np.array([rest(x) for x in range(1 << 12)], np.int64)
    high = np.array([rest(x << 12) for x in range(1 << 11)], np.int64)
    error = np.zeros(1 << 11, np.int64)
    one = [1 << b for b in range(23)]
    for a in range(23):
        error[rest(one[a])] = one[a]
        for b in range(a):
            error[rest(one[a] | one[b])] = one[a] | one[b]
            for c in range(b):
                error[rest(one[a] | one[b] | one[c])] = one[a] | one[b] | one[c]
    return low, high, error


def codeword(x: np.ndarray) -> np.ndarray:
    """Number (12 bits) of the only codeword within three bits of each 23-bit word."""
    low, high, error = _syndromes()
    return (x ^ error[low[x & 0xFFF] ^ high[x >> 12]]) >> 11


def keys_of(x: np.ndarray, width: int) -> np.ndarray:
    """Codewords of words of ``width`` bits and of their one-bit neighbours, six columns, -1: none."""
    flips = np.array([0] + [1 << b for b in range(width)], np.int64)
    found = np.sort(codeword(x[:, None] ^ flips[None, :]), axis=1)
    new = np.concatenate([np.ones((len(x), 1), bool), found[:, 1:] != found[:, :-1]], axis=1)
    out = np.full((len(x), 6), -1, np.int64)
    row, column = np.nonzero(new)
    place = (np.cumsum(new, axis=1) - 1)[row, column]
    out[row, place] = found[row, column]
    return out


def _segments(fp: np.ndarray) -> list[np.ndarray]:
    u = fp.view(np.uint64)
    return [
        ((u >> np.uint64(first)) & np.uint64((1 << width) - 1)).astype(np.int64)
        for first, width in SEGMENTS
    ]


#: Choices of an exact segment and one with at most one error; the last choice is all three.
CHOICES = [(i, j) for i in range(3) for j in range(3) if i != j]


def own_keys(fp: np.ndarray) -> np.ndarray:
    """Seven keys by row: what a fingerprint is filed under."""
    exact = _segments(fp)
    word = [codeword(x) for x in exact]
    keys = [(c << 36) | (exact[i] << 12) | word[j] for c, (i, j) in enumerate(CHOICES)]
    keys.append((len(CHOICES) << 36) | (word[0] << 24) | (word[1] << 12) | word[2])
    return np.stack(keys, axis=1)


def near_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and keys under which all fingerprints within the radius are filed."""
    exact = _segments(fp)
    near = [keys_of(x, width) for x, (_, width) in zip(exact, SEGMENTS)]
    rows, keys = [], []
    for c, (i, j) in enumerate(CHOICES):
        row, column = np.nonzero(near[j] >= 0)
        rows.append(row)
        keys.append((c << 36) | (exact[i][row] << 12) | near[j][row, column])
    a, b, c = near[0][:, :, None, None], near[1][:, None, :, None], near[2][:, None, None, :]
    row, x, y, z = np.nonzero((a >= 0) & (b >= 0) & (c >= 0))
    rows.append(row)
    words = (near[0][row, x] << 24) | (near[1][row, y] << 12) | near[2][row, z]
    keys.append((len(CHOICES) << 36) | words)
    return np.concatenate(rows), np.concatenate(keys)


def links(nodes: DataFrame) -> DataFrame:
    """``a`` < ``b``: all pairs of the distinct ``fp`` of ``nodes`` within the radius."""

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy()
            keys = own_keys(fp)
            yield pa.record_batch(
                [pa.array(keys.ravel()), pa.array(np.repeat(fp, keys.shape[1]))], ["key", "b"]
            )

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy()
            for at in range(0, len(fp), NODES_AT_ONCE):
                part = fp[at : at + NODES_AT_ONCE]
                row, keys = near_keys(part)
                yield pa.record_batch([pa.array(keys), pa.array(part[row])], ["key", "a"])

    fps = nodes.select("fp")
    right = fps.mapInArrow(filed, "key long, b long")
    left = fps.mapInArrow(asked, "key long, a long")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS
    met = left.hint("merge").join(
        right, (left["key"] == right["key"]) & (F.col("a") < F.col("b")) & near
    )
    return met.select("a", "b").distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node has one smaller neighbour and no other, or only larger ones."""
    a, b = F.col("a").alias("node"), F.col("b").alias("node")
    ends = edges.select(F.inline(F.array(F.struct(a, F.lit(1).alias("up")), F.struct(b, F.lit(0).alias("up")))))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.count("*").alias("n"))
    return nodes.where("up > 0 AND n > 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` of links ``a``, ``b``: the smallest node each can reach.

    Alternating star steps: every node's larger neighbours move to the smallest
    node it knows, then its smaller ones do, until all are stars. The smallest
    neighbour is an aggregate, and no step collects a neighbourhood.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = settle(edges.where("a <> b"))
    # No step makes more edges than it gets.
    tasks = max(edges.sparkSession.sparkContext.defaultParallelism, math.ceil(edges.count() / EDGES_OF_A_TASK))
    link = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    while not _are_stars(edges):
        both = edges.select(F.inline(F.array(link("a", "b"), link("b", "a"))))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # Large star: larger neighbours of a node go to its smallest.
        larger = edges.select(F.col("b").alias("a"), F.col("a").alias("larger"))
        large = larger.join(least, "a").select(F.col("larger").alias("a"), F.col("m").alias("b"))
        large = settle(large.distinct().coalesce(tasks))
        # Small star: a node and its smaller neighbours go to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.inline(F.array(link("b", "m"), link("a", "m"))))
        edges = settle(small.where("a <> b").distinct().coalesce(tasks))
    roots = edges.select("b").distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        roots.select("b", "b")
    )


def groups(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``fp``, ``component_id`` (smallest ``doc_id`` reachable) of each row."""
    rows = settle(fingerprints(docs))
    nodes = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = settle(components(links(nodes)))
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = named.join(names, "root").select("fp", "component_id")
    return rows.join(labels, "fp").select("doc_id", "fp", "component_id")


def kept_rows(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that give their component its id, with all their columns.

    Rows that repeat a ``doc_id`` are one document, and go only if all of them do.
    """
    found = groups(docs)
    stays = F.col("doc_id").eqNullSafe(F.col("component_id"))
    gone = found.groupBy(F.col("doc_id").alias("__doc_id")).agg(F.max(stays).alias("stays"))
    gone = settle(gone.where("NOT stays").select("__doc_id"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__doc_id"))
    return docs.join(bounded(gone), same, "left_anti")
