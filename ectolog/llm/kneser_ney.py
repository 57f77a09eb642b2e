"""Interpolated modified Kneser-Ney models of the letters within words, as Spark tables.

A word is read letter by letter between a begin mark and an end mark; the
history of a letter is what stands before it in the word, at most ``order - 1``
letters. Every letter of a text gives one *top* gram: its history and itself.

Counts: each task counts its distinct words, then the grams of those words, so
what is shuffled is one row for each gram a task has seen. Lower orders count
the different letters that stand before a gram (grams that begin a word have no
such letter and keep their plain counts). All levels are tables joined on the
gram; nothing of the corpus is collected.

Scoring: the finished model is split by the hash of a gram into shards of
bounded size, which are broadcast. A task lists the distinct words of a block of
documents and joins their grams with one shard after the other, so that it holds
one shard and one block at a time; no document is shuffled. A model of more rows
than ``most_rows`` stays a table and is joined on Spark (``_sums_joined``): the
values are the same, and there is no size that is refused.
"""

from __future__ import annotations

import itertools
import math
import operator
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ectolog.llm.rows import pieces, releasing, stored
from ectolog.operators.joins import attach

BEGIN, END, AGAIN = "\x02", "\x03", "\x04"
#: Rows of a model (12 bytes each) that one task holds at a time.
SHARD_ROWS = 6_000_000
#: Rows of a model that may be broadcast, shard by shard (0.3 GB); beyond it the model is joined.
MOST_ROWS = 24_000_000
#: Distinct words whose grams are looked up together where the model is joined.
WORDS_JOINED = 2_000
#: Text, and words among it, that are scored together.
BLOCK_BYTES = 4 << 20
WORDS_AT_ONCE = 50_000
#: Distinct words counted or scored before a task hands them on and begins anew.
WORDS_HELD = 250_000
#: Letters of a word that are read one by one; longer words are cut into words of this size.
WORD_LETTERS = 256


def words_of(text: str) -> list[str]:
    """Words between white space; overlong ones in sections, so that no letter is left out.

    A word that says the one before it again stands as ``AGAIN``, so that a model
    learns how rare that is.
    """
    words = text.split()
    if any(map(operator.eq, words, words[1:])):
        words[1:] = [AGAIN if a == b else b for a, b in zip(words, words[1:])]
    if len(text) > WORD_LETTERS and any(len(w) > WORD_LETTERS for w in words):
        words = [
            w[a : a + WORD_LETTERS] for w in words for a in range(0, len(w), WORD_LETTERS)
        ]
    return words


def grams_of(word: str, order: int) -> list[str]:
    """The top gram of each letter and of the word's end."""
    s = BEGIN + word + END
    return [s[max(0, i - order + 1) : i + 1] for i in range(1, len(s))]


def top_counts(texts: DataFrame, order: int) -> DataFrame:
    """``kind``, ``gram``, ``n`` of ``kind`` (int) and ``text`` rows, summed over all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[int, Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for kind, counted in words.items():
                grams: Counter = Counter()
                for word, n in counted.items():
                    for gram in grams_of(word, order):
                        grams[gram] += n
                names, counts = list(grams), list(grams.values())
                for a in range(0, len(names), 200_000):
                    part = names[a : a + 200_000]
                    yield pa.record_batch(
                        [
                            pa.array([kind] * len(part), pa.int32()),
                            pa.array(part, pa.string()),
                            pa.array(counts[a : a + 200_000], pa.int64()),
                        ],
                        ["kind", "gram", "n"],
                    )
            words.clear()

        for batch in batches:
            for part in pieces(batch):
                for kind, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    words.setdefault(kind, Counter()).update(words_of(text))
                if sum(map(len, words.values())) > WORDS_HELD:
                    yield from flush()
        yield from flush()

    counted = texts.select(F.col("kind").cast("int"), "text").mapInArrow(
        run, "kind int, gram string, n long"
    )
    return counted.groupBy("kind", "gram").agg(F.sum("n").alias("n"))


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the counts of counts; 0.75 where they say nothing."""
    row = counts.agg(*(F.sum((F.col("n") == k).cast("long")).alias(f"n{k}") for k in range(1, 5)))
    n = [float(x or 0) for x in row.first()]
    if min(n) <= 0:
        return (0.75, 0.75, 0.75)
    y = n[0] / (n[0] + 2 * n[1])
    found = (1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2])
    return tuple(min(max(d, 0.1), k + 0.9) for k, d in enumerate(found))


def _discounted(d: tuple[float, float, float]) -> Column:
    n = F.col("n")
    return F.greatest(
        n - F.when(n == 1, d[0]).when(n == 2, d[1]).otherwise(d[2]), F.lit(0.0)
    )


def history(gram: Column) -> Column:
    return F.substring(gram, 1, F.length(gram) - 1)


def shorter(gram: Column) -> Column:
    return F.substring(gram, 2, F.length(gram))


def level(counts: DataFrame, lower: DataFrame | None, n_letters: int) -> DataFrame:
    """``gram``, ``p``, ``h``, ``back``: the interpolated probability and its history's weight.

    ``lower`` has ``gram`` and ``p`` of the level below; a gram that it lacks
    has probability 1 / ``n_letters`` there.
    """
    d = discounts(counts)
    n = F.col("n")
    own = counts.withColumn("h", history(F.col("gram")))
    sums = own.groupBy("h").agg(
        F.sum("n").alias("total"),
        (F.sum(n - _discounted(d)) / F.sum("n")).alias("back"),
    )
    own = own.join(sums, "h").withColumn("own", _discounted(d) / F.col("total"))
    if lower is None:
        below = F.lit(1.0 / n_letters)
    else:
        own = own.withColumn("s", shorter(F.col("gram"))).join(
            lower.select(F.col("gram").alias("s"), F.col("p").alias("q")), "s", "left"
        )
        below = F.coalesce("q", F.lit(1.0 / n_letters))
    return own.select("gram", (F.col("own") + F.col("back") * below).alias("p"), "h", "back")


def lower_counts(top: DataFrame, order: int) -> list[DataFrame]:
    """Counts of the orders 1 to ``order`` - 1 below the top grams.

    A gram at the beginning of a word is a top gram at its own length and keeps its count.
    """
    begins = F.substring("gram", 1, 1) == BEGIN
    out: list[DataFrame] = []
    above = top.where(F.length("gram") == order).select("gram")
    for k in range(order - 1, 0, -1):
        here = above.groupBy(shorter(F.col("gram")).alias("gram")).agg(F.count("*").alias("n"))
        if k > 1:
            here = here.union(top.where((F.length("gram") == k) & begins).select("gram", "n"))
        out.append(here)
        above = here.select("gram")
    return out[::-1]


def shared_levels(top: DataFrame, order: int) -> tuple[list[DataFrame], int]:
    """Levels 1 to ``order`` - 1 from ``gram``, ``n``, and the number of letters plus one."""
    counts = [stored(c) for c in lower_counts(top, order)]
    n_letters = counts[0].count() + 1
    levels: list[DataFrame] = []
    for c in counts:
        levels.append(stored(level(c, levels[-1] if levels else None, n_letters)))
    return levels, n_letters


def pooled_model(top: DataFrame, order: int) -> tuple[DataFrame, int]:
    """``gram``, ``p``, ``h``, ``back`` of every level, and the number of letters plus one.

    ``top`` has ``gram`` and ``n``, one row for each gram.
    """
    levels, n_letters = shared_levels(top, order)
    longest = top.where(F.length("gram") == order).select("gram", "n")
    levels.append(level(longest, levels[-1] if levels else None, n_letters))
    whole = levels[0]
    for one in levels[1:]:
        whole = whole.union(one)
    return whole, n_letters


_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_HISTORY = np.uint64(0xA0761D6478BD642F)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Letters:
    """The letters of words one after the other, and 64-bit keys of the grams that end at each."""

    def __init__(self, words: list[str], order: int):
        size = np.fromiter(map(len, words), np.int64, len(words))
        text = "".join(words).encode("utf-32-le", "surrogatepass")
        code = np.frombuffer(text, np.uint32)
        start = np.cumsum(size) - size
        self.word = np.repeat(np.arange(len(words)), size)
        self.place = np.arange(len(code)) - np.repeat(start, size)
        letter = _mixed(code.astype(np.uint64) + _MIX)
        self.by_length = [np.zeros(len(code), np.uint64)]
        weight = np.uint64(1)
        for k in range(order):
            moved = np.zeros(len(code), np.uint64)
            moved[k:] = letter[: max(0, len(code) - k)]
            with np.errstate(over="ignore"):
                self.by_length.append(self.by_length[-1] + moved * weight)
                weight = weight * _STEP

    def gram(self, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        return self._key(at, length, np.uint64(0))

    def history(self, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Key of the history of the gram of this length that ends here."""
        return self._key(at - 1, length - 1, _HISTORY)

    def _key(self, at: np.ndarray, length: np.ndarray, mark: np.uint64) -> np.ndarray:
        out = np.zeros(len(at), np.uint64)
        for k in np.unique(length).tolist():
            some = length == k
            with np.errstate(over="ignore"):
                out[some] = _mixed(self.by_length[k][at[some]] + mark + np.uint64(k) * _MIX)
        return out


class Tables:
    """The shards of a model as a task sees them, one in memory at a time."""

    def __init__(self, sent: list):
        self.sent = sent
        self.held = None
        self.number = -1

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Value of each key, NaN where the model has none."""
        out = np.full(len(keys), np.nan)
        shard = (keys >> np.uint64(33)) % np.uint64(len(self.sent))
        for number in range(len(self.sent)):
            own = np.flatnonzero(shard == number) if len(self.sent) > 1 else slice(None)
            wanted = keys[own]
            if self.number != number:
                self.held = None
                self.held, self.number = self.sent[number]._value_of_file(), number
            known, value = self.held
            if len(known) and len(wanted):
                at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
                out[own] = np.where(known[at] == wanted, value[at], np.nan)
        return out


class _Sent:
    """A broadcast that is read anew each time, so that a worker doesn't keep every shard."""

    def __init__(self, broadcast):
        self.broadcast = broadcast

    def _value_of_file(self) -> tuple[np.ndarray, np.ndarray]:
        value = self.broadcast.value
        key, v = np.frombuffer(value[0], np.uint64), np.frombuffer(value[1], np.float32)
        del self.broadcast._value
        return key, v


class _Block:
    """The rows of a model that one block of words asks for."""

    def __init__(self, key: np.ndarray, value: np.ndarray):
        by = np.argsort(key)
        self.held = key[by], value[by]

    def _value_of_file(self) -> tuple[np.ndarray, np.ndarray]:
        return self.held


class _Asked:
    """Stands for a model without rows and notes every key that a scorer looks for in it."""

    def __init__(self):
        self.keys: list[np.ndarray] = []

    def find(self, keys: np.ndarray) -> np.ndarray:
        self.keys.append(keys)
        return np.full(len(keys), np.nan)


def send(
    model: DataFrame, order: int, shard_rows: int = SHARD_ROWS, most_rows: int = MOST_ROWS
) -> list[_Sent] | DataFrame:
    """Broadcast a model (``what`` 0 gram or 1 history, ``gram``, ``v``) shard by shard.

    A model of more than ``most_rows`` rows comes back as a stored table of ``key`` and ``v``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            what = batch.column(0).to_numpy()
            grams = batch.column(1).to_pylist()
            # A mark after each gram stands for the letter that a history precedes.
            letters = Letters([g + END for g in grams], order + 1)
            size = np.fromiter(map(len, grams), np.int64, len(grams))
            end = np.cumsum(size + 1) - 1
            keys = np.where(
                what == 0, letters.gram(end - 1, size), letters.history(end, size + 1)
            )
            yield pa.record_batch(
                [pa.array(keys.view(np.int64)), batch.column(2).cast(pa.float32())], ["key", "v"]
            )

    spark = model.sparkSession
    keyed = stored(
        model.where("v IS NOT NULL").select("what", "gram", F.col("v").cast("double")).mapInArrow(
            run, "key long, v float"
        )
    )
    rows = keyed.count()
    if rows > most_rows:
        return keyed
    shards = max(1, math.ceil(rows / shard_rows))
    shard = F.shiftrightunsigned(F.col("key"), 33) % shards
    sent = []
    for number in range(shards):
        found = keyed.where(shard == number).toArrow()
        key = found["key"].to_numpy().view(np.uint64)
        by = np.argsort(key)
        v = found["v"].to_numpy()[by].astype(np.float32)
        sent.append(_Sent(spark.sparkContext.broadcast((key[by].tobytes(), v.tobytes()))))
    return sent


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


def sums_over(
    docs: DataFrame,
    sent: list[_Sent] | DataFrame,
    order: int,
    score: Callable[[Letters, Tables], tuple[np.ndarray, np.ndarray]],
    keep: str,
) -> DataFrame:
    """Columns of ``keep``, ``total`` and ``n``: sums over the words of each row of ``docs``.

    ``score(letters, tables)`` gives the value and the size of each word of a
    block, marks included. ``docs`` has the columns of the schema ``keep``, and
    ``text`` last. A word is scored once in a block of documents. ``sent`` is
    what :func:`send` returned.
    """
    if isinstance(sent, DataFrame):
        return _sums_joined(docs, sent, order, score, keep)
    kept = [c.split()[0] for c in keep.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Tables(sent)
        numbers = _Numbers()
        value, size = np.zeros(0), np.zeros(0, np.int64)
        for batch in batches:
            for part in pieces(batch, BLOCK_BYTES):
                if len(numbers) > WORDS_HELD:
                    numbers.clear()
                    value, size = np.zeros(0), np.zeros(0, np.int64)
                docs = [
                    np.fromiter(map(numbers.__getitem__, words_of(text)), np.int64)
                    for text in part.column(part.num_columns - 1).to_pylist()
                ]
                fresh = list(itertools.islice(numbers, len(value), None))
                for a in range(0, len(fresh), WORDS_AT_ONCE):
                    words = [BEGIN + w + END for w in fresh[a : a + WORDS_AT_ONCE]]
                    v, n = score(Letters(words, order), tables)
                    value, size = np.append(value, v), np.append(size, n)
                sums = [float(value[d].sum()) for d in docs]
                sizes = [int(size[d].sum()) for d in docs]
                yield pa.record_batch(
                    [*part.columns[:-1], pa.array(sums, pa.float64()), pa.array(sizes, pa.int64())],
                    [*kept, "total", "n"],
                )

    return docs.mapInArrow(releasing(run), f"{keep}, total double, n long")


def _word_counts(docs: DataFrame, keep: str) -> DataFrame:
    """Columns of ``keep``, ``same``, ``word``, ``times``: how often a row says each word.

    Rows that say the same share ``same``, a digest of the text. Each row has one
    line more, without a word, so that empty texts are kept and equal rows can be counted.
    """
    kept = [c.split()[0] for c in keep.split(", ")]
    rows = docs.select(*kept, F.unhex(F.sha2("text", 256)).alias("same"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, BLOCK_BYTES):
                at, words, times = [], [], []
                for i, text in enumerate(part.column(part.num_columns - 1).to_pylist()):
                    counted = Counter(words_of(text))
                    at += [i] * (len(counted) + 1)
                    words += [None, *counted]
                    times += [1, *counted.values()]
                for a in range(0, len(at), WORDS_HELD):
                    some = slice(a, a + WORDS_HELD)
                    rest = [c.take(pa.array(at[some], pa.int64())) for c in part.columns[:-1]]
                    yield pa.record_batch(
                        [*rest, pa.array(words[some], pa.string()), pa.array(times[some], pa.int64())],
                        [*kept, "same", "word", "times"],
                    )

    return rows.mapInArrow(releasing(run), f"{keep}, same binary, word string, times long")


def _word_values(words: DataFrame, model: DataFrame, order: int, score: Callable) -> DataFrame:
    """``word``, ``value``, ``size`` of distinct words, by a join of their grams with the model.

    Words are dealt into blocks of about ``WORDS_JOINED`` by hash. A block asks for
    each of its keys once, so that a gram of every word is one row a block; the rows
    found come back to the block's words, which are scored as with a broadcast model.
    """
    blocks = max(1, math.ceil(words.count() / WORDS_JOINED))
    words = words.withColumn("block", F.pmod(F.xxhash64("word", F.lit(7)), F.lit(blocks)))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1 << 17):
                block = part.column(1).to_numpy()
                named = np.array(part.column(0).to_pylist(), object)
                for b in np.unique(block).tolist():
                    asked = _Asked()
                    score(Letters([BEGIN + w + END for w in named[block == b]], order), asked)
                    keys = np.unique(np.concatenate(asked.keys)).view(np.int64)
                    yield pa.record_batch(
                        [pa.array(np.full(len(keys), b, np.int64)), pa.array(keys)], ["block", "key"]
                    )

    def judge(key, words, found):
        names = words["word"].tolist()
        held = _Block(found["key"].to_numpy(np.int64).view(np.uint64), found["v"].to_numpy(np.float32))
        v, n = score(Letters([BEGIN + w + END for w in names], order), Tables([held]))
        return words[["word"]].assign(value=v, size=n)

    ordered = words.repartition("block").sortWithinPartitions("block")
    keys = ordered.mapInArrow(releasing(ask), "block long, key long").distinct()
    found = keys.join(model, "key").select("block", "key", "v")
    return (
        words.groupBy("block")
        .cogroup(found.groupBy("block"))
        .applyInPandas(judge, "word string, value double, size long")
    )


def _sums_joined(
    docs: DataFrame, model: DataFrame, order: int, score: Callable, keep: str
) -> DataFrame:
    """:func:`sums_over` for a model that is joined: by word, then by document.

    A word that all documents say is one row a document; such words are counted as
    hot and salted by ``attach``.
    """
    kept = [c.split()[0] for c in keep.split(", ")]
    counted = stored(_word_counts(docs, keep))
    words = stored(counted.where("word IS NOT NULL").select("word").distinct())
    values = stored(_word_values(words, model, order, score))
    said = attach(counted, values, ["word"], "left")
    sums = said.groupBy(*kept, "same").agg(
        F.sum(F.when(F.col("word").isNull(), F.col("times"))).alias("rows"),
        F.sum(F.col("times") * F.coalesce("value", F.lit(0.0))).alias("total"),
        F.sum(F.col("times") * F.coalesce("size", F.lit(0))).alias("n"),
    )
    rows = F.col("rows")
    each = sums.withColumn("_each", F.explode(F.sequence(F.lit(1).cast("long"), rows)))
    return each.select(
        *kept, (F.col("total") / rows).alias("total"), (F.col("n") / rows).cast("long").alias("n")
    )
