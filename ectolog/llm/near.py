"""Near-duplicates by word shingles: every pair with a Jaccard similarity of at least 4/5.

Two texts are near when the sets of their ``SHINGLE_WORDS``-word shingles are (a
text with fewer words is one shingle). A 64-bit fingerprint can't promise that:
pairs at 0.8 differ in about 10 bits and often in more, and a radius that loses
none of them makes nearly every pair of a large corpus a candidate. Here, shingles have one order for all
texts, and a set with n of them is filed under its first n - ceil(4n/5) + 1: two
sets that are near share one of these, whatever the order, so no pair is lost.
The order puts crowded shingles last, the most crowded at the end, so that lists of texts
under a shingle stay short. The place of a shingle in a set bounds what comes after it: at
the first shingle that two near sets share, the shorter rest holds all they share.

Texts with the same set are one node. Each set also has a SimHash fingerprint, and nodes
whose fingerprints link by Golay keys (``simhash.links``) are candidates first; the
prefixes then find what a fingerprint can't promise. Under each shingle, neighbours in node order
are compared and what is near is joined into components; then all pairs under a
shingle that are still in different components are compared. Places and sketches are
judged where such pairs meet, so that only what passes leaves the join; long lists are
dealt in blocks, each pair of blocks by itself. Each comparison is
of whole sets, by their 64-bit hashes; only pairs go that far whose sketches (the
parity of the hashes in each of ``SKETCH_BITS`` buckets) differ in no more bits
than near sets can. That many buckets say nothing of long texts, so these have a
wide sketch too, of two to four buckets a shingle, for the pairs that pass. Whole sets
are sent in parts of a bounded size, one after the other. Components are those of all
near pairs.

Defined cases: null texts count as empty; texts without words are one node; of a
component the row with the smallest ``doc_id`` stays (rows without one come last,
then the smallest hash of id and text); rows that repeat both id and text stay or
go together; an empty table gives an empty table; other columns are kept.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ectolog.llm.rows import bounded, pieces, releasing, stored
from ectolog.llm.simhash import components, links, majority
from ectolog.session import settle

SHINGLE_WORDS = 5
#: Least similarity, as a fraction of two integers.
SIMILARITY = (4, 5)
#: Texts filed under a shingle that make it crowded, as counted on one text of ``SAMPLE``, and most
#: shingles put last for it. These set the order only; no pair depends on them.
CROWD = 100
SAMPLE = 8
MOST_CROWDED = 1_000_000
SKETCH_BITS = 1024
#: Buckets of a wide sketch for each shingle, at least.
WIDE_BITS = 2
#: Shingles that a part of the comparisons may send if its sets have no more.
SENT_AT_ONCE = 16_000_000
#: Texts under a shingle that meet in one task; longer lists are dealt in blocks.
BLOCK = 2_000
#: Rounds in which each text is compared with one other, before all that is left.
ROUNDS = 2
#: Distinct words whose hashes a task remembers.
WORDS_HELD = 50_000

_STEP = np.uint64(0xD6E8FEB86659FD93)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_HELD:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: str, words: _Words) -> np.ndarray:
    """Hashes of the different shingles of a text, in order."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    h = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    k = min(SHINGLE_WORDS, len(h))
    if not k:
        return h.view(np.int64)
    n = len(h) - k + 1
    x = np.full(n, k, np.uint64)
    for j in range(k):
        x = (x ^ h[j : j + n]) * _STEP
        x ^= x >> np.uint64(32)
    return np.unique(x.view(np.int64))


def node_of(hashes: np.ndarray) -> int:
    """A name (signed 64 bits) for a set of shingles."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes())).view(np.int64))


def sketch_of(hashes: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """Parities of the buckets; two sketches differ in no more bits than their sets in shingles."""
    odd = np.bincount(hashes & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def wide_sketch_of(hashes: np.ndarray) -> np.ndarray | None:
    """A sketch with a power of two of buckets, for sets that ``SKETCH_BITS`` are too few for.

    The exclusive or of its halves is the sketch with half the buckets.
    """
    bits = 1 << max(0, WIDE_BITS * len(hashes) - 1).bit_length()
    return sketch_of(hashes, bits) if bits > SKETCH_BITS else None


def prefix(hashes: np.ndarray, crowded: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The shingles a set is filed under, in the order of all: crowded ones last, by their counts."""
    up, down = SIMILARITY
    n = len(hashes)
    if len(crowded):
        at = np.minimum(np.searchsorted(crowded, hashes), len(crowded) - 1)
        crowd = np.where(crowded[at] == hashes, counts[at], 0)
        hashes = hashes[np.argsort(crowd, kind="stable")]
    return hashes[: n - -(-n * up // down) + 1]


def _row(docs: DataFrame) -> Column:
    """A name for what a row says."""
    return F.xxhash64(docs["doc_id"].cast("long"), F.coalesce(docs["text"], F.lit("")))


def _sets(texts: DataFrame, emit: Callable[[np.ndarray], tuple], schema: str) -> DataFrame:
    """Rows of ``schema`` that ``emit`` makes of the node and hashes of each text (the last column).

    The other column of ``texts``, ``row``, comes first.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            for part in pieces(batch, 4 << 20):
                out = [
                    emit(row, shingles(text, words))
                    for row, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist())
                ]
                columns = [pa.concat_arrays(c) for c in zip(*out)]
                yield pa.record_batch(columns, names)

    return texts.mapInArrow(releasing(run), schema)


def _crowded(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Crowded shingles, sorted, and how many texts of a sample have them.

    All shingles are counted: those put last bring others into the prefixes.
    """
    some = texts.where(F.pmod("row", F.lit(SAMPLE)) == 0)
    crowds = _sets(some, lambda row, hashes: (pa.array(hashes),), "key long").groupBy("key").agg(F.count("*").alias("n"))
    crowds = crowds.where(F.col("n") * SAMPLE > CROWD).orderBy(F.desc("n"), "key").limit(MOST_CROWDED).toArrow()
    key, n = crowds["key"].to_numpy(), crowds["n"].to_numpy()
    order = np.argsort(key)
    return key[order], n[order]


def _filed(texts: DataFrame, crowded: np.ndarray, counts: np.ndarray) -> DataFrame:
    """``key``, ``node``, ``size``, ``place``: a row for each shingle that a text is filed under.

    ``place`` is that of the shingle in the order, from 0.
    """

    def emit(row, hashes):
        keys = prefix(hashes, crowded, counts) if len(hashes) else hashes
        n = len(keys)
        node, size = np.full(n, node_of(hashes), np.int64), np.full(n, len(hashes), np.int32)
        return pa.array(keys), pa.array(node), pa.array(size), pa.array(np.arange(n, dtype=np.int32))

    return _sets(texts, emit, "key long, node long, size int, place int")


def _apart(x: str, y: str) -> Column:
    """Bits in which two sketches differ; one with twice the buckets is folded first."""
    n = F.least(F.size(x), F.size(y))

    def folded(c: str, i: Column) -> Column:
        return F.get(c, i).bitwiseXOR(F.coalesce(F.get(c, i + n), F.lit(0)))

    bits = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.bit_count(folded(x, i).bitwiseXOR(folded(y, i))))
    return F.aggregate(bits, F.lit(0), lambda all_, one: all_ + one)


def _sketches(rows: DataFrame) -> DataFrame:
    """``node``, ``s``, ``n``: sketch and size of each node."""
    return rows.groupBy("node").agg(F.any_value("sketch").alias("s"), F.any_value("size").alias("n"))


def _sketched(x: str, y: str, sizes: Column) -> Column:
    """Sketches that near sets of ``sizes`` shingles together can have."""
    up, down = SIMILARITY
    apart = sum(
        (F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))) for i in range(SKETCH_BITS // 64)),
        F.lit(0),
    )
    # What near sets don't share is at most (down - up) / (down + up) of their sizes.
    return apart * (down + up) <= sizes * (down - up)


def _alike(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs ``a`` < ``b`` of nodes whose sketches are as close as those of near sets.

    ``sent`` is the number of shingles that comparing them sends.
    """
    up, down = SIMILARITY
    sketches = _sketches(rows)
    pairs = pairs.join(sketches.select(F.col("node").alias("a"), F.col("s").alias("x"), F.col("n").alias("m")), "a")
    pairs = pairs.join(sketches.select(F.col("node").alias("b"), F.col("s").alias("y"), "n"), "b")
    sent = (F.col("m") + F.col("n")).cast("long")
    pairs = pairs.where(_sized("m", "n") & _sketched("x", "y", sent))
    pairs = stored(pairs.select("a", "b", sent.alias("sent")))

    # Sizes of near sets are close: of two wide sketches, one has twice the buckets at most.
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wide = rows.where("wide IS NOT NULL").select("node", "wide").join(nodes, "node")
    wide = stored(wide.groupBy("node").agg(F.any_value("wide").alias("wide")))
    both = pairs.join(wide.select(F.col("node").alias("a"), F.col("wide").alias("x")), "a", "left")
    both = both.join(wide.select(F.col("node").alias("b"), F.col("wide").alias("y")), "b", "left")
    may = F.col("x").isNull() | F.col("y").isNull() | (_apart("x", "y") * (down + up) <= F.col("sent") * (down - up))
    return stored(both.where(may).select("a", "b", "sent"))


def _whole_sets(pairs: DataFrame, rows: DataFrame, texts: DataFrame) -> DataFrame:
    """``node``, ``hs``: the shingles of each node of a pair."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = stored(rows.join(nodes, "node").groupBy("node").agg(F.min("row").alias("row")).select("row"))

    def emit(row, hashes):
        held = pa.ListArray.from_arrays(pa.array([0, len(hashes)], pa.int32()), pa.array(hashes))
        return pa.array([node_of(hashes)], pa.int64()), held

    sets = _sets(texts.join(bounded(wanted), "row", "left_semi"), emit, "node long, hs array<long>")
    return stored(sets.dropDuplicates(["node"]))


def _compared(pairs: DataFrame, sets: DataFrame, most: int) -> DataFrame:
    """The pairs whose sets are near; the sets of about ``most`` shingles are sent at a time."""
    up, down = SIMILARITY
    parts = max(1, math.ceil((pairs.agg(F.sum("sent")).first()[0] or 0) / most))
    found = None
    for part in range(parts):
        some = pairs.where(F.pmod(F.xxhash64("a", "b"), F.lit(parts)) == part) if parts > 1 else pairs
        both = some.select("a", "b").join(sets.select(F.col("node").alias("a"), F.col("hs").alias("x")), "a")
        both = both.join(sets.select(F.col("node").alias("b"), F.col("hs").alias("y")), "b")
        shared = F.size(F.array_intersect("x", "y"))
        # shared / (x + y - shared) >= up / down
        near = shared * (up + down) >= up * (F.size("x") + F.size("y"))
        more = stored(both.where(near).select("a", "b"))
        found = more if found is None else found.union(more)
    return found


def _near_pairs(pairs: DataFrame, rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Near pairs that have the components of all near pairs among ``pairs``.

    Sets are sent once for each pair they are compared in. So first each node is
    compared with one other only; what this joins need not be compared again.
    Whatever is still apart after ``ROUNDS`` is compared as a whole.
    """
    rest = _alike(pairs, rows)
    sets = _whole_sets(rest, rows, texts)
    most = max(SENT_AT_ONCE, sets.agg(F.sum(F.size("hs"))).first()[0] or 0)
    found = rest.select("a", "b").where("false")
    for number in range(ROUNDS + 1):
        some = rest
        if number < ROUNDS:
            some = rest.groupBy("b").agg(F.min(F.struct("a", "sent")).alias("least")).select("least.a", "b", "least.sent")
        found = found.union(_compared(some, sets, most))
        if number == ROUNDS or rest.isEmpty():
            return found
        roots = settle(components(found))
        of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))  # noqa: E731, B023
        apart = rest.join(some.select("a", "b"), ["a", "b"], "left_anti").join(of("a"), "a", "left").join(of("b"), "b", "left")
        rest = stored(apart.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b", "sent"))


def _sized(a: str, b: str) -> Column:
    """Sizes that near sets can have."""
    up, down = SIMILARITY
    return F.least(a, b) * down >= F.greatest(a, b) * up


def _placed(m: str, i: str, n: str, j: str) -> Column:
    """Sizes and places that near sets can have at the first shingle they share."""
    up, down = SIMILARITY
    rest = F.least(F.col(m) - F.col(i), F.col(n) - F.col(j))
    return rest * (up + down) >= (F.col(m) + F.col(n)) * up


def _under_one_key(rooted: DataFrame, rows: DataFrame) -> DataFrame:
    """Pairs ``a`` < ``b`` of different roots under one key that may be near; a pair may repeat.

    ``rooted`` has ``key``, ``node``, ``size``, ``place``, ``root`` and ``blocks``, the number of
    blocks of its key; each two blocks of a key meet by themselves.
    """
    with_sketch = rooted.join(_sketches(rows).select("node", "s"), "node")
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))

    def side(df, blocks, names):
        columns = zip(("node", "size", "place", "root", "s"), names)
        return df.select("key", *blocks, *(F.col(c).alias(name) for c, name in columns))

    def meet(x, y, on):
        may = (F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & _placed("m", "i", "n", "j")
        return x.join(y, on).where(may & _sketched("x", "y", F.col("m") + F.col("n"))).select("a", "b")

    left, right = ("a", "m", "i", "ra", "x"), ("b", "n", "j", "rb", "y")
    few, many = with_sketch.where("blocks = 1"), with_sketch.where("blocks > 1")
    of_few = meet(side(few, [], left), side(few, [], right), ["key"])
    x = side(many, [own.alias("p"), every.alias("q")], left)
    y = side(many, [every.alias("p"), own.alias("q")], right)
    return of_few.union(meet(x, y, ["key", "p", "q"]))


def linked(rows: DataFrame) -> DataFrame:
    """Candidates ``a`` < ``b`` whose fingerprints link: the first node of each of two, or of the same one."""
    first = settle(rows.groupBy("fp").agg(F.min("node").alias("first")))
    met = stored(links(first))
    for c in ("a", "b"):
        met = met.join(first.select(F.col("fp").alias(c), F.col("first").alias(f"first_{c}")), c)
    across = met.select(F.least("first_a", "first_b").alias("a"), F.greatest("first_a", "first_b").alias("b"))
    same = rows.join(first, "fp").where("first < node").select(F.col("first").alias("a"), F.col("node").alias("b"))
    return stored(across.union(same).distinct())


def groups(docs: DataFrame) -> DataFrame:
    """``row``, ``doc_id``, ``root``: the component of each row of ``docs``."""
    texts = docs.select(_row(docs).alias("row"), F.coalesce("text", F.lit("")).alias("text"))

    def emit(row, hashes):
        held = pa.ListArray.from_arrays(pa.array([0, SKETCH_BITS // 64], pa.int32()), pa.array(sketch_of(hashes)))
        node, n = node_of(hashes), len(hashes)
        fp, wide = pa.array([majority(hashes)], pa.int64()), pa.array([wide_sketch_of(hashes)], pa.list_(pa.int64()))
        return pa.array([row], pa.int64()), pa.array([node], pa.int64()), pa.array([n], pa.int32()), held, fp, wide

    ids = docs.select(_row(docs).alias("row"), F.col("doc_id").cast("long").alias("doc_id"))
    schema = "row long, node long, size int, sketch array<long>, fp long, wide array<long>"
    rows = stored(_sets(texts, emit, schema).dropDuplicates(["row"]))
    first = rows.groupBy("node").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    first = settle(first.where("n > 1").select("node", "first"))
    others = settle(rows.join(bounded(first), "node").where("row <> first").select("row"))
    once = texts.join(bounded(others), "row", "left_anti")

    under = Window.partitionBy("key")
    met = _filed(once, *_crowded(once)).withColumn("n", F.count("*").over(under))
    met = stored(met.where("n > 1").select("key", "node", "size", "place"))
    before = {c: F.lag(c).over(under.orderBy("node")).alias(f"last_{c}") for c in ("node", "size")}
    beside = met.select("node", "size", *before.values()).where(
        (F.col("last_node") < F.col("node")) & _sized("size", "last_size")
    )
    beside = beside.select(F.col("last_node").alias("a"), F.col("node").alias("b"))
    beside = beside.union(linked(rows)).distinct()
    roots = settle(components(_near_pairs(beside, rows, texts)))

    rooted = met.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    blocks = F.ceil(F.count("*") / BLOCK).alias("blocks")
    apart = rooted.groupBy("key").agg((F.min("root") < F.max("root")).alias("apart"), blocks).where("apart")
    rooted = stored(rooted.join(apart.select("key", "blocks"), "key"))
    rest = stored(_under_one_key(rooted, rows).distinct())
    rest = _near_pairs(rest.join(beside, ["a", "b"], "left_anti"), rows, texts)

    root_of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    more = rest.join(root_of("a"), "a", "left").join(root_of("b"), "b", "left")
    more = more.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).distinct()
    joined = settle(components(more).select(F.col("node").alias("root"), F.col("root").alias("top")))
    whole = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    whole = whole.join(joined, "root", "left").select("row", F.coalesce("top", "root").alias("root"))
    return whole.join(ids.distinct(), "row").select("row", "doc_id", "root")


def kept_rows(docs: DataFrame) -> DataFrame:
    """The first row of each component, with all its columns."""
    found = stored(groups(docs))
    first = F.min(F.struct(F.isnull("doc_id"), "doc_id", "row"))["row"].alias("first")
    best = found.groupBy("root").agg(first, F.count("*").alias("n")).where("n > 1")
    gone = found.join(bounded(settle(best.select("root", "first"))), "root").where("row <> first")
    gone = settle(gone.select(F.col("row").alias("__row")))
    return docs.join(bounded(gone), _row(docs) == F.col("__row"), "left_anti")
