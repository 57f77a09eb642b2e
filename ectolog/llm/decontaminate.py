"""Benchmark decontamination by SimHash over windows as long as the items.

Text is lower-cased and cut into words of letters and digits; a shingle is
``SHINGLE_WORDS`` words (all of them in an item that has fewer). A window as
similar as ``SIMILARITY`` shares shingles with its item, so windows are placed
where a shingle of an item occurs: at the word where the item would begin, as
long as the item, pushed back inside the document at its edges. That loses no
window that begins in step with one of the shingles it shares. Windows of the
same words are one content, however many documents hold them.

Contents and items get a 64-bit SimHash of their shingles, weighted by how often
they occur. Of four blocks of 16 bits, one differs in at most three bits when
the whole differs in at most ``RADIUS`` = 15: items are filed under the values
within two bits of each block, contents ask under the values within one bit, so
the join meets every fingerprint of the same length within the radius. Weighted
shingle similarity (sum of smaller counts over sum of larger counts) then
verifies each candidate.

Everything is DataFrame expressions; no Python runs on the executors.

Defined cases: null texts count as empty; items without words match nothing;
documents shorter than an item are compared whole; rows that repeat an id are
reported once, at the most similar place; rows without ``doc_id`` are matched
and reported under a null id; items that repeat an ``item_id`` each count; empty
tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ectolog.llm.rows import bounded, id_and_text
from ectolog.session import settle

SHINGLE_WORDS = 5
SIMILARITY = 0.8
RADIUS = 15
BLOCK_BITS = 16

def words(text: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def shingles(w: Column, k: int) -> Column:
    """Hashes of the shingles of ``k`` words, in order; none where there are fewer words."""
    hashes = F.transform(
        F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(k)))
    )
    return F.when(F.size(w) >= k, hashes).otherwise(F.array().cast("array<bigint>"))


def simhash(counts: DataFrame, key: list[str]) -> DataFrame:
    """``key`` and ``fp`` from rows with ``h`` and its count ``c``, and ``size``, the sum of counts.

    Two bits of a hash are summed in the halves of one long.
    """
    pair = F.lit((1 << 32) | 1)
    sums = counts.groupBy(*key).agg(
        *(
            F.sum(F.shiftrightunsigned("h", b).bitwiseAND(pair) * F.col("c")).alias(f"s{b}")
            for b in range(32)
        ),
        F.sum("c").alias("size"),
    )
    bits = []
    for b in range(32):
        low, high = F.col(f"s{b}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f"s{b}", 32)
        for value, place in ((low, b), (high, b + 32)):
            bit = F.lit((1 << place) - ((1 << 64) if place == 63 else 0))
            bits.append(F.when(2 * value > F.col("size"), bit).otherwise(F.lit(0).cast("long")))
    # A balanced tree of additions: the bits don't overlap.
    while len(bits) > 1:
        bits = [bits[i].bitwiseOR(bits[i + 1]) for i in range(0, len(bits), 2)]
    return sums.select(*key, "size", bits[0].alias("fp"))


def _masks(flips: int) -> list[int]:
    """Block values that differ from 0 in at most this many bits."""
    return [
        sum(1 << b for b in some) for n in range(flips + 1) for some in combinations(range(BLOCK_BITS), n)
    ]


def _blocks(df: DataFrame, flips: int) -> DataFrame:
    """A row for each block and value within ``flips`` bits of it: ``block``, ``value``."""
    each = F.array(
        *(
            F.struct(
                F.lit(b).alias("block"),
                F.shiftrightunsigned("fp", b * BLOCK_BITS).bitwiseAND(F.lit(0xFFFF)).alias("own"),
            )
            for b in range(64 // BLOCK_BITS)
        )
    )
    masks = F.array(*(F.lit(m).cast("long") for m in _masks(flips)))
    out = df.withColumn("at", F.explode(each)).withColumn("mask", F.explode(masks))
    return out.withColumn("block", F.col("at.block")).withColumn(
        "value", F.col("at.own").bitwiseXOR(F.col("mask"))
    ).drop("at", "mask")


def candidates(contents: DataFrame, items: DataFrame) -> DataFrame:
    """``cid``, ``iid`` of every content and item of the same length within the radius."""
    asked = _blocks(contents.select("cid", "length", F.col("fp")), 1)
    filed = _blocks(items.select("iid", F.col("length"), F.col("fp")), 2)
    filed = filed.withColumnRenamed("fp", "item_fp")
    met = asked.join(filed, ["length", "block", "value"])
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS
    return met.where(near).select("cid", "iid").distinct()


def _matches(docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """Matches of items that have shingles of ``k`` words: ``row``, ``doc_id``, ``item_id``, place, similarity.

    ``docs``: ``row``, ``doc_id``, ``text``; ``items``: ``iid``, ``item_id``, ``w``, ``length``.
    """
    item_rows = items.select("iid", "length", F.posexplode(shingles(F.col("w"), k)).alias("o", "h"))
    item_rows = settle(item_rows)
    places = settle(item_rows.select("h", "length", "o").distinct())
    hashes = settle(places.select("h").distinct())
    placed = docs.select("row", words(F.col("text")).alias("w"))
    seen = placed.select("row", F.size("w").alias("n"), shingles(F.col("w"), k).alias("hs"))
    # An outer explode: a filter inferred from an inner one would be pushed below the words
    # and cut the text anew for each shingle.
    hits = seen.select("row", "n", F.posexplode_outer("hs").alias("p", "h"))
    hits = hits.join(bounded(hashes), "h", "left_semi").join(bounded(places), "h")
    # Inside the document; a shorter document is its own window.
    start = F.greatest(F.lit(0), F.least(F.col("p") - F.col("o"), F.col("n") - F.col("length")))
    windows = settle(hits.select("row", start.alias("start"), "length").distinct())
    by_row = settle(windows.groupBy("row").agg(F.collect_list(F.struct("start", "length")).alias("ws")))
    held = docs.join(bounded(by_row), "row").select("row", "doc_id", "ws", words(F.col("text")).alias("w"))
    held = held.select("row", "doc_id", "ws", shingles(F.col("w"), k).alias("hs"))
    cut = F.transform(
        "ws",
        lambda x: F.struct(
            x["start"].alias("start"),
            x["length"].alias("length"),
            F.slice("hs", x["start"] + 1, x["length"] - (k - 1)).alias("part"),
        ),
    )
    held = held.select("row", "doc_id", F.explode_outer(cut).alias("x")).select(
        "row",
        "doc_id",
        "x.start",
        "x.length",
        "x.part",
        F.xxhash64("x.length", "x.part").alias("cid"),
    )
    held = settle(held.where(F.size("part") > 0))
    contents = held.groupBy("cid", "length").agg(F.any_value("part").alias("part"))
    content_rows = contents.select("cid", "length", F.explode("part").alias("h"))
    own = settle(content_rows.groupBy("cid", "length", "h").agg(F.count("*").alias("c")))
    of_items = settle(item_rows.groupBy("iid", "length", "h").agg(F.count("*").alias("c")))
    content_fp = settle(simhash(own, ["cid", "length"]))
    item_fp = settle(simhash(of_items, ["iid", "length"]))
    met = candidates(content_fp, item_fp)
    both = (
        met.join(own.select("cid", "h", "c"), "cid")
        .join(of_items.select("iid", "h", F.col("c").alias("d")), ["iid", "h"])
        .groupBy("cid", "iid")
        .agg(F.sum(F.least("c", "d")).alias("shared"))
    )
    sizes = both.join(content_fp.select("cid", F.col("size").alias("m")), "cid").join(
        item_fp.select("iid", F.col("size").alias("n")), "iid"
    )
    similarity = F.col("shared") / (F.col("m") + F.col("n") - F.col("shared"))
    good = sizes.withColumn("similarity", similarity).where(F.col("similarity") >= SIMILARITY)
    named = good.join(items.select("iid", "item_id"), "iid").select("cid", "item_id", "similarity")
    return held.select("row", "doc_id", "start", "length", "cid").join(named, "cid")


def _found(docs: DataFrame, items: DataFrame) -> DataFrame:
    """A row for each window that holds an item: ``row``, ``doc_id``, ``item_id``, place, similarity."""
    # What a row says names it, so that rows without an id or with the same one stay apart.
    rows = id_and_text(docs).select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text")
    rows = rows.where("text <> ''")
    listed = id_and_text(items, "item_id").withColumnRenamed("doc_id", "item_id")
    listed = listed.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    listed = settle(
        listed.distinct().select(
            F.xxhash64("item_id", "w").alias("iid"), "item_id", "w", F.size("w").alias("length")
        )
    )
    lengths = [r["k"] for r in listed.select(F.least("length", F.lit(SHINGLE_WORDS)).alias("k")).distinct().collect()]
    parts = [
        _matches(rows, listed.where(F.least("length", F.lit(SHINGLE_WORDS)) == k), k)
        for k in sorted(lengths) or [SHINGLE_WORDS]
    ]
    return reduce(DataFrame.union, parts)


def matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id``, ``item_id``, ``similarity``, ``start``, ``length`` (words), ``windows``.

    One row for each document and item that it holds, at the most similar window
    and the first of equals.
    """
    found = _found(docs, items)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("start"), "length")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best, F.count("*").alias("windows")).select(
        "doc_id",
        "item_id",
        F.col("best.similarity").alias("similarity"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        "windows",
    )


def kept_rows(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns.

    Rows that hold one are named by what they say, so that clean rows without an
    id or with the same one stay.
    """
    bad = settle(_found(docs, items).select(F.col("row").alias("__row")).distinct())
    row = F.xxhash64(docs["doc_id"].cast("long"), F.coalesce(docs["text"], F.lit("")))
    return docs.join(bounded(bad), row == F.col("__row"), "left_anti")
