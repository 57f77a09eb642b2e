"""Exact, near and substring deduplication against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ectolog.llm import exact, fm_index, simhash, substrings
from ectolog.session import settle

EDGES = [
    (5, None),
    (6, ""),
    (7, " \t\n"),
    (1, "same  text\nhere"),
    (2, "same text here"),
    (3, "same text here"),
    (None, "same text here"),
    (None, "no id"),
    (9, "word"),
    (9, "word"),
    (10, "long " * 30_000),
]


def exact_by_hand(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t, *_ in rows]
    out = []
    for (i, *_), t in zip(rows, norm):
        ids = [r[0] for r, u in zip(rows, norm) if u == t]
        keep = min((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_exact_edges(spark, make):
    assert got(exact.dedup(spark, make(EDGES))) == exact_by_hand(EDGES)
    assert got(exact.dedup(spark, make([]))) == []


def test_exact_compares_bytes(spark, make):
    """A digest of one letter: what only shares it is told apart by the whole text."""
    rows = [(i, f"{'ab'[i % 2]}{i % 5}") for i in range(40)] + EDGES
    weak = exact.dedup(spark, make(rows), digest=lambda t: F.substring(t, 1, 1))
    assert [r[:4] for r in got(weak.drop("digest"))] == [r[:4] for r in exact_by_hand(rows)]


def test_exact_state_goes_on(spark, make, tmp_path):
    """A second run of the stream adds to the state of the first."""
    feed, to, at = (str(tmp_path / x) for x in ("feed", "to", "at"))
    for rows, want in (([(3, "a"), (4, "b")], {3: 1, 4: 1}), ([(1, "a"), (9, "b")], {1: 2, 4: 2})):
        exact.records(make(rows)).coalesce(2).write.mode("append").parquet(feed)
        stream = spark.readStream.schema(exact.RECORD).option("maxFilesPerTrigger", 1).parquet(feed)
        state = exact.run_stream(spark, stream, to, at)
        assert {r["keep_id"]: r["n"] for r in state.collect()} == want


def test_kept_rows_keep_columns(spark, make):
    docs = make(EDGES)
    for kept in (exact.kept_rows(spark, docs), simhash.kept_rows(docs)):
        assert kept.columns == docs.columns
        ids = [r["doc_id"] for r in kept.collect()]
        assert 1 in ids and 2 not in ids and ids.count(9) == 2


def fingerprint_by_hand(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    shingles = shingles or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(make):
    rows = [r for r in EDGES if len(r[1] or "") < 1000] + [(20, "ÀB É c d"), (21, "a b c a b c a b c")]
    found = simhash.fingerprints(make(rows)).collect()
    want = sorted((fingerprint_by_hand(t) for _, t, *_ in rows))
    assert sorted(r["fp"] % 2**64 for r in found) == want


def test_golay_keys_meet():
    rng = np.random.default_rng(1)
    for _, width in simhash.SEGMENTS:
        x = rng.integers(0, 1 << width, 2000)
        keys = simhash.keys_of(x, width)
        for b in range(width):
            near = simhash.codeword(x ^ (1 << b))
            assert (keys == near[:, None]).any(axis=1).all()


def test_links_and_components(spark):
    """A dense cluster and noise: every pair within three bits, and what they connect."""
    rng = np.random.default_rng(2)
    centre = rng.integers(-(2**62), 2**62, 12)
    fps = set(centre.tolist()) | {0, -1, 1}
    for c in centre.tolist():
        for _ in range(60):
            flips = rng.choice(64, rng.integers(1, 5), replace=False)
            fps.add(int(np.uint64(c % 2**64 ^ sum(1 << int(b) for b in flips)).view(np.int64)))
    u = np.array(sorted(fps), np.int64)
    near = np.bitwise_count(u.view(np.uint64)[:, None] ^ u.view(np.uint64)[None, :]) <= 3
    want = {(int(u[a]), int(u[b])) for a, b in zip(*np.nonzero(near)) if a < b}
    nodes = spark.createDataFrame([(int(x),) for x in u], "fp long").repartition(4)
    edges = simhash.links(nodes)
    assert {(r["a"], r["b"]) for r in edges.collect()} == want
    root = np.arange(len(u))
    while True:
        new = np.where(near, root[None, :], len(u)).min(axis=1)
        if (new == root).all():
            break
        root = new
    found = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    linked = near.sum(axis=1) > 1
    assert found == {int(u[i]): int(u[root[i]]) for i in np.flatnonzero(linked)}


def test_near_groups(make):
    rows = EDGES + [(30, "w " * 50 + "x"), (31, "w " * 50 + "x")]
    found = {(r["doc_id"], r["component_id"]) for r in simhash.groups(make(rows)).collect()}
    assert {(6, 5), (7, 5), (5, 5), (2, 1), (None, 1), (9, 9), (31, 30)} <= found
    assert simhash.groups(make([])).collect() == []


def substrings_by_hand(rows):
    first = {}
    split = [(t or "").encode().split() for _, t, *_ in rows]
    size = substrings.WINDOW
    for (i, *_), w in zip(rows, split):
        for a in range(len(w) - size + 1) if i is not None else ():
            k = tuple(w[a : a + size])
            first[k] = min(first.get(k, i), i)
    out = []
    for (i, *_), w in zip(rows, split):
        gone = set()
        for a in range(len(w) - size + 1) if i is not None else ():
            if first[tuple(w[a : a + size])] < i:
                gone.update(range(a, a + size))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone).decode()
        out.append((i, len(w), len(gone), kept))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def passages():
    rng = random.Random(4)
    word = lambda: rng.choice("abcdefgh") * rng.randint(1, 3)
    text = lambda n: " ".join(word() for _ in range(n))
    common, line = text(60), text(14)
    rows = []
    for i in range(40):
        parts = [text(rng.randint(0, 40))]
        if i % 3 == 0:
            parts += [common[rng.randint(0, 9) :], text(9)]
        if i % 2 == 0:
            parts += [line, text(5)]
        rows.append((100 - i, "\n".join(parts)))
    return rows + EDGES + [(200, "again " * 300), (201, "again " * 290 + "end"), (1, common)]


@pytest.mark.parametrize("together", [3, 500])
def test_substrings(spark, make, passages, monkeypatch, together):
    """With few passages of a key together, common minimizers go window by window."""
    monkeypatch.setattr(substrings, "PASSAGES_OF_A_KEY", together)
    assert got(substrings.remove(spark, make(passages))) == substrings_by_hand(passages)


def test_substrings_without_broadcast(spark, make, passages, monkeypatch):
    monkeypatch.setattr(substrings, "BROADCAST_IDS", 0)
    assert got(substrings.remove(spark, make(passages))) == substrings_by_hand(passages)
    assert got(substrings.remove(spark, make([]))) == []


@pytest.mark.parametrize("at_once", [7, 1 << 13])
def test_fm_index_ranks_two_places_a_level(monkeypatch, at_once):
    """Counts of all windows by hand; a window's extension looks up its two ends only, not where its word begins too."""
    rng = np.random.default_rng(8)
    words = np.append(rng.integers(1, 30, 999), 0).astype(np.int32)
    looked, ones = [], fm_index.Bits.ones
    monkeypatch.setattr(fm_index, "WINDOWS_AT_ONCE", at_once, raising=False)
    index = fm_index.FmIndex(words, 29, 3)
    monkeypatch.setattr(fm_index.Bits, "ones", lambda self, at: (looked.append(at.size), ones(self, at))[1])
    ends = np.arange(3, len(words))
    low, high, matched = index.search(words, ends, 3)
    windows = [tuple(words[e - 3 : e].tolist()) for e in ends]
    assert (matched == 3).all()
    assert (high - low).tolist() == [windows.count(w) for w in windows]
    assert sum(looked) <= 2 * 3 * index.wavelet.bits * len(ends)


def test_fm_index_matching_statistics():
    rng = np.random.default_rng(5)
    texts = [rng.integers(1, 5, rng.integers(13, 40)) for _ in range(30)]
    words = np.concatenate([np.append(t, 0) for t in texts]).astype(np.int32)
    index = fm_index.FmIndex(words, 4, 13)
    query = rng.integers(1, 5, 200).astype(np.int32)
    ends = np.arange(8, 200)
    low, high, matched = index.search(query, ends, 8)
    joined = ["".join(map(str, t)) for t in texts]
    for e, a, b, m in zip(ends, low, high, matched):
        best = max((k for k in range(9) if any("".join(map(str, query[e - k : e])) in t for t in joined)), default=0)
        assert m == best
        if m == 8:
            w = "".join(map(str, query[e - 8 : e]))
            assert b - a == sum(t.startswith(w, k) for t in joined for k in range(len(t)))


def test_minimizers_are_dealt_out_once(spark, documents):
    from ectolog.llm import substrings
    from ectolog.llm.rows import id_and_text

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = substrings.shared_minis(id_and_text(documents).where("doc_id IS NOT NULL"))
        assert found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("MapInArrow") == 1 and plan.count("ReusedExchange") == 1


def test_star_steps_end_at_stars_and_have_few_tasks(spark, monkeypatch):
    parts = []

    def noted(df):
        out = settle(df)
        parts.append(out.rdd.getNumPartitions())
        return out

    monkeypatch.setattr(simhash, "settle", noted)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "61")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        stars = [(k, k % 3) for k in range(3, 60)]
        edges = spark.createDataFrame([*stars, (7, 7)], "a long, b long")
        found = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
        assert found == {k: k % 3 for k in range(60)} and len(parts) == 1
        # A chain, a pair given both ways and one that hangs on itself.
        edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(90, 80), (80, 90), (99, 99)], "a long, b long")
        rows = simhash.components(edges).collect()
        assert sorted(map(tuple, rows)) == [(k, 0) for k in range(41)] + [(80, 80), (90, 80)]
        assert len(parts) > 3 and max(parts[2:]) <= spark.sparkContext.defaultParallelism
        assert simhash.components(edges.where("a > 99")).collect() == []
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
