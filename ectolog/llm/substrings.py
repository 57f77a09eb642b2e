"""Substring deduplication: windows of words that an earlier document also has.

A window is ``WINDOW`` words in a row. Every word covered by a window whose word
sequence also starts in a document with a smaller ``doc_id`` is removed; windows
are judged on the input.

An FM-index of every shard searched by every document would do quadratic work,
so the passages are routed: each window goes to the shard of its minimizer, the
smallest hash among its runs of ``GRAM`` words, which equal windows share.
Windows in a row with the same minimizer travel as one passage.

1. Minimizers that two documents share are found by one shuffle of minimizers; a
   minimizer in a third of all documents sends one row a batch to its key.
2. Passages of shared minimizers are written out; equal passages become one,
   owned by the smallest ``doc_id``. A minimizer with more than
   ``PASSAGES_OF_A_KEY`` different passages is split into its windows, each
   routed by its own hash, so that no shard depends on how common a phrase is.
3. A task builds the FM-index (``fm_index``) of a shard of passages of bounded
   size and streams their windows through it: backward search gives matching
   statistics; windows matched whole get the smallest owner in their interval.
4. Windows with a smaller owner are reported to their documents.

Defined cases: null and empty texts have no words; documents shorter than a
window lose nothing; a row without ``doc_id`` neither removes words from others
nor loses any; repeated rows are one document and don't remove each other's
words; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ectolog.llm.fm_index import FmIndex
from ectolog.llm.rows import bounded, id_and_text, pieces, releasing, stored

WINDOW = 13
#: Words of the runs among which a window's minimizer is chosen: enough that different texts
#: seldom share one by chance.
GRAM = 7
#: Windows of one passage.
PASSAGE_WINDOWS = 64
#: Different passages of a minimizer that stay together.
PASSAGES_OF_A_KEY = 500
#: Text of a shard.
SHARD_BYTES = 2 << 20
#: Ids that are broadcast to choose documents (8 bytes each); beyond it texts are shuffled.
BROADCAST_IDS = 500_000
_WORDS_HELD = 300_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def minimizers(h: np.ndarray) -> np.ndarray:
    """The minimizer of each window of word hashes."""
    if len(h) < WINDOW:
        return np.zeros(0, np.uint64)
    runs = len(h) - GRAM + 1
    g = np.zeros(runs, np.uint64)
    for k in range(GRAM):
        g = g * np.uint64(0xD6E8FEB86659FD93) + h[k : k + runs]
        g ^= g >> np.uint64(29)
    g *= np.uint64(0x9E3779B97F4A7C15)
    g ^= g >> np.uint64(32)
    windows = len(h) - WINDOW + 1
    least = g[:windows].copy()
    for k in range(1, WINDOW - GRAM + 1):
        np.minimum(least, g[k : k + windows], out=least)
    return least


def _hash_all(hashes: _Hashes, words: list[bytes]) -> np.ndarray:
    if len(hashes) > _WORDS_HELD:
        hashes.clear()
    return np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(31))


def anchors(rows: DataFrame) -> DataFrame:
    """``key``, ``mini``, ``doc_id``, ``known``: the different minimizers of each document.

    A minimizer that several documents of one batch have is known to be shared:
    one row of it goes out under the minimizer, to tell other tasks, and the rows
    of the documents under keys of their own. So a minimizer of a third of all
    documents sends one row a batch to where it is counted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            for part in pieces(batch, 4 << 20):
                texts = [text.encode().split() for text in part.column(1).to_pylist()]
                # All texts of a piece at once; windows over the edge of a text don't count.
                h = _hash_all(hashes, [w for words in texts for w in words])
                of = np.repeat(np.arange(len(texts)), [len(words) for words in texts])
                least, doc = minimizers(h), part.column(0).to_numpy()[of]
                doc = doc[: len(least)]
                inside = of[: len(least)] == of[len(of) - len(least) :]
                mini, doc = least[inside], doc[inside]
                change = (mini[1:] != mini[:-1]) | (doc[1:] != doc[:-1])
                mini, doc = (x[np.append(True, change)[: len(x)]] for x in (mini, doc))
                order = np.lexsort((doc, mini))
                mini, doc = mini[order], doc[order]
                change = (mini[1:] != mini[:-1]) | (doc[1:] != doc[:-1])
                mini, doc = (x[np.append(True, change)[: len(x)]] for x in (mini, doc))
                new = np.concatenate([[True], mini[1:] != mini[:-1]])[: len(mini)]
                group = np.cumsum(new) - 1
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(mini))[: len(first)] - 1
                several = doc[first] < doc[last]
                known = several[group] if len(group) else np.zeros(0, bool)
                key = np.where(known, _mixed(mini ^ _mixed(doc.view(np.uint64))), mini)
                told = first[several]
                yield pa.record_batch(
                    [
                        pa.array(np.append(key, mini[told]).view(np.int64)),
                        pa.array(np.append(mini, mini[told]).view(np.int64)),
                        pa.array(np.append(doc, doc[told])),
                        pa.array(np.append(known, np.ones(len(told), bool))),
                    ],
                    ["key", "mini", "doc_id", "known"],
                )

    schema = "key long, mini long, doc_id long, known boolean"
    return rows.select("doc_id", "text").mapInArrow(releasing(run), schema)


def shared_minis(rows: DataFrame) -> DataFrame:
    """``doc_id``, ``minis``, ``known``: of each document the minimizers that another one has too."""
    # Dealt out once: the counts and the rows they choose read the same shuffle. For that both
    # ask for every column, so ``mini`` (never null) is named here and ``known`` there.
    dealt = anchors(rows).repartition("key")
    shared = dealt.groupBy("key").agg(
        F.min("doc_id").alias("lo"),
        F.max("doc_id").alias("hi"),
        F.max("known").alias("told"),
        F.max("mini").alias("mini"),
    )
    several = (F.col("lo") < F.col("hi")) | F.col("told") | F.col("mini").isNull()
    # An inner join, as a semi-join would be moved in front of the shuffle.
    chosen = dealt.join(shared.where(several).select("key"), "key")
    return chosen.groupBy("doc_id").agg(F.collect_set("mini").alias("minis"), F.max("known").alias("known"))


PASSAGE = "mini long, seg long, row long, doc_id long, start int, passage binary"
_PASSAGE_NAMES = [c.split()[0] for c in PASSAGE.split(", ")]


def passages(rows: DataFrame) -> DataFrame:
    """Passages (``PASSAGE``) of rows with ``doc_id``, ``row``, ``text`` and shared ``minis``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            for part in pieces(batch, 4 << 20):
                # All texts of a piece at once; windows over the edge of a text don't count.
                texts = [text.encode().split() for text in part.column(2).to_pylist()]
                words = [w for x in texts for w in x]
                size = np.fromiter(map(len, texts), np.int64, len(texts))
                of = np.repeat(np.arange(len(texts)), size)
                least = minimizers(_hash_all(hashes, words))
                doc = of[: len(least)]
                inside = doc == of[len(of) - len(least) :]
                change = np.ones(len(least), bool)
                change[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1]) | (inside[1:] != inside[:-1])
                begin = np.flatnonzero(change)
                stop = np.append(begin[1:], len(least))[: len(begin)]
                # A minimizer is shared in a document; where marks meet by chance, a passage more is searched.
                minis = part.column(3)
                marks = minis.flatten().to_numpy().view(np.uint64) ^ _mixed(
                    np.repeat(np.arange(len(texts), dtype=np.uint64), minis.value_lengths().to_numpy())
                )
                shared = inside[begin] & np.isin(least[begin] ^ _mixed(doc[begin].astype(np.uint64)), marks)
                begin, stop = begin[shared], stop[shared]
                cuts = -(-(stop - begin) // PASSAGE_WINDOWS)
                at = np.arange(int(cuts.sum())) - np.repeat(np.cumsum(cuts) - cuts, cuts)
                at = np.repeat(begin, cuts) + PASSAGE_WINDOWS * at
                end = np.minimum(at + PASSAGE_WINDOWS, np.repeat(stop, cuts))
                # Words joined by one space, and where each of them begins.
                joined = b" ".join(words)
                place = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)])
                edges = zip(place[at].tolist(), (place[end + WINDOW - 1] - 1).tolist())
                found = [joined[a:b] for a, b in edges]
                seg = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
                doc = doc[at]
                yield pa.record_batch(
                    [
                        pa.array(least[at].view(np.int64)),
                        pa.array((seg ^ np.uint64(1 << 63)).view(np.int64)),
                        part.column(1).take(pa.array(doc)),
                        part.column(0).take(pa.array(doc)),
                        pa.array((at - (np.cumsum(size) - size)[doc]).astype(np.int32)),
                        pa.array(found, pa.binary()),
                    ],
                    _PASSAGE_NAMES,
                )

    return rows.select("doc_id", "row", "text", "minis").mapInArrow(releasing(run), PASSAGE)


def windows_of(passages: DataFrame) -> DataFrame:
    """``mini``, ``seg``, ``at``, ``window``, ``owner``: the windows of passages one by one."""
    names = ["mini", "seg", "at", "window", "owner"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1 << 20):
                out = []
                for mini, seg, passage, owner in zip(*(c.to_pylist() for c in part.columns)):
                    words = passage.split()
                    for at in range(len(words) - WINDOW + 1):
                        out.append((mini, seg, at, b" ".join(words[at : at + WINDOW]), owner))
                types = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    schema = "mini long, seg long, at int, window binary, owner long"
    return passages.select("mini", "seg", "passage", "owner").mapInArrow(run, schema)


def least_owners(texts: list[bytes], owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest owner of each window of the passages, by an index of them all, and how many windows each has."""
    numbered = pa.array(b" ".join(texts).split(), pa.binary()).dictionary_encode()
    size = np.fromiter((t.count(b" ") + 1 for t in texts), np.int64, len(texts))
    end = np.cumsum(size + 1) - 1
    words = np.zeros(int(end[-1]) + 1, np.int32)
    owner = np.repeat(owners, size + 1)
    words[np.arange(len(words)) != np.repeat(end, size + 1)] = numbered.indices.to_numpy() + 1
    index = FmIndex(words, len(numbered.dictionary), WINDOW)
    count = size - WINDOW + 1
    begin = np.repeat(end - size, count)
    inside = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    low, high, matched = index.search(words, begin + inside + WINDOW, WINDOW)
    assert (matched == WINDOW).all()  # each window occurs at least in its own passage
    # Intervals of different windows don't overlap: one pass gives all their minima.
    by_order = owner[index.order]
    starts, which = np.unique(low, return_inverse=True)
    stops = np.zeros(len(starts), np.int64)
    stops[which] = high
    edges = np.stack([starts, stops], axis=1).ravel()
    minima = np.minimum.reduceat(np.append(by_order, np.iinfo(np.int64).max), edges)[::2]
    return minima[which], count


def _distinct(passages: DataFrame) -> DataFrame:
    """Equal passages as one, owned by the smallest ``doc_id``."""
    return passages.groupBy("mini", "seg").agg(
        F.min("doc_id").alias("owner"), F.max("passage").alias("passage")
    )


def searched(passages: DataFrame) -> DataFrame:
    """``mini``, ``seg``, ``least`` (an owner for each window) of each distinct passage."""
    total = passages.agg(F.sum(F.length("passage") + 1)).first()[0] or 0
    shards = max(1, math.ceil(total / SHARD_BYTES))

    def run(table: pa.Table) -> pa.Table:
        owners = table["owner"].to_numpy()
        least, count = least_owners(table["passage"].to_pylist(), owners)
        edges = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
        return pa.table(
            [
                table["mini"],
                table["seg"],
                pa.ListArray.from_arrays(pa.array(edges), pa.array(least)),
            ],
            ["mini", "seg", "least"],
        )

    routed = _distinct(passages).select(
        F.pmod(F.xxhash64("mini"), F.lit(shards)).alias("shard"), "mini", "seg", "passage", "owner"
    )
    return routed.groupBy("shard").applyInArrow(run, "mini long, seg long, least array<long>")


def _by_window(hot: DataFrame) -> DataFrame:
    """The same as ``searched`` for passages of very common minimizers, window by window."""
    windows = windows_of(hot).withColumn("key", F.xxhash64("window"))
    distinct = windows.groupBy("key", "window").agg(F.min("owner").alias("owner"))
    distinct = stored(
        distinct.select(
            F.col("key").alias("mini"), F.col("key").alias("seg"), F.col("window").alias("passage"), F.col("owner").alias("doc_id")
        )
    )
    found = stored(searched(distinct)).select(
        F.col("mini").alias("key"), F.col("least")[0].alias("one")
    )
    joined = windows.select("mini", "seg", "at", "key").join(found, "key")
    # The windows of a passage, in order: at most PASSAGE_WINDOWS.
    lists = joined.groupBy("mini", "seg").agg(
        F.sort_array(F.collect_list(F.struct("at", "one"))).alias("all")
    )
    return lists.select("mini", "seg", F.col("all.one").alias("least"))


def covered(rows: DataFrame) -> DataFrame:
    """``row``, ``starts``: the windows of each row that an earlier document has too."""
    known = rows.where("doc_id IS NOT NULL")
    by_doc = stored(shared_minis(known))
    chosen = known
    if by_doc.count() <= BROADCAST_IDS:
        chosen = known.join(F.broadcast(by_doc.select("doc_id")), "doc_id", "left_semi")
    all_passages = stored(passages(chosen.join(by_doc, "doc_id")))
    # Different passages: copies of one passage are no crowd.
    different = all_passages.groupBy("mini", "seg").agg(F.count("*").alias("copies"))
    crowds = different.groupBy("mini").agg(F.count("*").alias("n"))
    crowds = stored(crowds.where(F.col("n") > PASSAGES_OF_A_KEY).select("mini"))
    if crowds.isEmpty():
        least = stored(searched(all_passages))
    else:
        few = bounded(crowds)
        least = stored(searched(all_passages.join(few, "mini", "left_anti"))).union(
            stored(_by_window(stored(_distinct(all_passages.join(few, "mini", "left_semi")))))
        )
    met = all_passages.select("mini", "seg", "row", "doc_id", "start").join(least, ["mini", "seg"])
    starts = F.filter(
        F.transform("least", lambda x, i: F.when(x < F.col("doc_id"), F.col("start") + i)),
        lambda x: x.isNotNull(),
    )
    return (
        met.select("row", starts.alias("starts"))
        .where(F.size("starts") > 0)
        .groupBy("row")
        .agg(F.flatten(F.collect_list("starts")).alias("starts"))
    )


def remove(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed``, ``kept`` (words joined by one space) of each row."""
    rows = id_and_text(docs).select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))
    found = stored(covered(rows))
    names = ["doc_id", "n_words", "n_removed", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 4 << 20):
                sizes, gone, kept = [], [], []
                for text, starts in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    words = text.encode().split()
                    left = words
                    if starts:
                        change = np.zeros(len(words) + 1, np.int64)
                        starts = np.unique(starts)
                        np.add.at(change, starts, 1)
                        np.add.at(change, starts + WINDOW, -1)
                        out = np.cumsum(change)[:-1] > 0
                        left = [w for w, o in zip(words, out.tolist()) if not o]
                    sizes.append(len(words))
                    gone.append(len(words) - len(left))
                    kept.append(b" ".join(left).decode())
                yield pa.record_batch(
                    [
                        part.column(0),
                        pa.array(sizes, pa.int64()),
                        pa.array(gone, pa.int64()),
                        pa.array(kept, pa.string()),
                    ],
                    names,
                )

    schema = "doc_id long, n_words long, n_removed long, kept string"
    if found.count() <= BROADCAST_IDS:
        # Only rows that lose words need their windows: the others stay where they are.
        some = F.broadcast(found.select("row"))
        changed = rows.join(some, "row", "left_semi").join(found, "row")
        same = rows.join(some, "row", "left_anti").withColumn(
            "starts", F.array().cast("array<int>")
        )
        parts = [x.select("doc_id", "text", "starts").mapInArrow(run, schema) for x in (changed, same)]
        return parts[0].union(parts[1])
    joined = rows.join(found, "row", "left").select("doc_id", "text", "starts")
    return joined.mapInArrow(run, schema)
