"""Near-duplicates of the pipeline against all pairs."""

import random

import corpus_pipeline
import pytest

from ectolog.llm import near


def sets_by_hand(text):
    w = (text or "").encode().lower().split()
    k = min(5, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if k else frozenset()


def kept_by_hand(rows):
    sets = [sets_by_hand(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            shared, both = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if shared * 5 >= both * 4:
                root[find(i)] = find(j)
    best = {}
    for i, (doc_id, _) in enumerate(rows):
        r = find(i)
        if r not in best or doc_id < best[r]:
            best[r] = doc_id
    return sorted(best.values())


@pytest.mark.parametrize("crowd", [100, 3])
def test_near_stage_finds_all_pairs(spark, make, sf_dir, monkeypatch, crowd):
    monkeypatch.setattr(near, "CROWD", crowd)
    rng = random.Random(4)
    word = [f"w{i}" for i in range(3000)]
    line = " ".join(word[:12])
    rows, doc_id = [], 0
    for n in [3, 5, 9, 30, 60, 120, 300] * 3:
        base = [rng.choice(word) for _ in range(n)]
        for edits in (0, 1, 1, 2, 3, 4, 6, 8):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(n)] = rng.choice(word)
            rows.append((doc_id := doc_id + 1, " ".join(copy) + rng.choice(["", " " + line])))
    rows += [(900, ""), (901, None), (902, " \n"), (903, line), (904, line.upper() + " ")]
    rng.shuffle(rows)
    got = corpus_pipeline.near_stage(spark, make(rows), sf_dir)
    assert got.columns == make([]).columns
    assert sorted(r["doc_id"] for r in got.collect()) == kept_by_hand(rows)


def test_near_stage_links_at_four_fifths(spark, make, sf_dir):
    """Ten of 110 words changed at one end: 96 of 116 shingles, 0.83, far beyond three bits."""
    rng = random.Random(5)
    base = [f"v{rng.randrange(10**6)}" for _ in range(110)]
    rows = [(1, " ".join(base)), (2, " ".join(base[:100] + [f"u{i}" for i in range(10)])), (3, "other words")]
    got = corpus_pipeline.near_stage(spark, make(rows), sf_dir)
    assert sorted(r["doc_id"] for r in got.collect()) == [1, 3]


def test_near_stage_without_ids(spark, make, sf_dir):
    base = " ".join(f"v{i}" for i in range(200))
    rows = [(None, base), (None, base + " end"), (None, "other words"), (None, "other words"), (4, base + " fin")]
    got = corpus_pipeline.near_stage(spark, make(rows), sf_dir)
    kept = sorted(map(repr, ((r["doc_id"], r["text"][-5:]) for r in got.collect())))
    assert kept == ["(4, '9 fin')", "(None, 'words')", "(None, 'words')"]
    assert corpus_pipeline.near_stage(spark, make([]), sf_dir).collect() == []


def test_words_held_by_a_task_are_few():
    """Three tasks of an executor with half a million words each don't fit beside its heap."""
    words = near._Words()
    for a in range(0, 200_000, 1000):
        near.shingles(" ".join(f"w{i}" for i in range(a, a + 1000)), words)
    assert 0 < len(words) <= 50_000
    assert (near.shingles("w1 w2 w3 w4 w5", words) == near.shingles("w1 w2 w3 w4 w5", near._Words())).all()


def test_fingerprints_propose_pairs_first(make, monkeypatch):
    """The stage takes its candidates from SimHash links as well; what they propose is verified."""
    words = [f"v{i}" for i in range(400)]
    other = [*words[:399], "other"]
    docs = make([(1, " ".join(words)), (2, " ".join(other)), (3, "quite another text of a few words")])
    seen, links = [], near.links
    monkeypatch.setattr(near, "links", lambda nodes: (seen.append(nodes.count()), links(nodes))[1])
    kept = sorted(r["doc_id"] for r in near.kept_rows(docs).select("doc_id").collect())
    assert seen and kept == [1, 3]


def long_sets():
    """Sets of 1,500 to 5,000 shingles around the sizes where wide sketches double, near and not."""
    rng = random.Random(6)
    rows, doc_id = [], 0
    for n in (1500, 2040, 2300, 4090, 4700):
        base = [f"v{rng.randrange(10**6)}" for _ in range(n)]
        for cut in (0.0, 0.09, 0.12, 0.24, 0.5):
            kept = base[: round(n * (1 - cut))]
            rows.append((doc_id := doc_id + 1, " ".join(kept)))
            rows.append((doc_id := doc_id + 1, " ".join(kept + [f"u{rng.randrange(10**6)}" for _ in range(n // 20)])))
    return rows


def nodes_and_pairs(spark, rows):
    """What ``_alike`` reads, and all pairs of nodes with whether they are near by hand."""
    words = near._Words()
    hashes = [near.shingles(t, words) for _, t in rows]
    node = [near.node_of(h) for h in hashes]
    table = [
        (d, x, len(h), near.sketch_of(h).tolist(), None if (w := near.wide_sketch_of(h)) is None else w.tolist())
        for (d, _), x, h in zip(rows, node, hashes)
    ]
    schema = "row long, node long, size int, sketch array<long>, wide array<long>"
    pairs = {}
    for i, h in enumerate(hashes):
        for j in range(i):
            a, b = sorted([node[i], node[j]])
            shared = len(set(h.tolist()) & set(hashes[j].tolist()))
            both = len(h) + len(hashes[j])
            pairs[a, b] = shared / (both - shared)
    return spark.createDataFrame(table, schema), spark.createDataFrame(list(pairs), "a long, b long"), pairs


def test_sketches_tell_long_texts_apart(spark):
    """Whole sets were sent for every pair of long texts, as 1,024 buckets fill up."""
    rows, pairs, similar = nodes_and_pairs(spark, long_sets())
    left = {(r["a"], r["b"]) for r in near._alike(pairs, rows).collect()}
    assert {p for p, s in similar.items() if s >= 0.8} <= left
    assert all(similar[p] > 0.65 for p in left)


@pytest.mark.parametrize("most", [16_000_000, 40_000])
def test_near_stage_on_long_texts(spark, make, sf_dir, monkeypatch, most):
    """Also when whole sets are sent in several parts."""
    rows, parts, compared = long_sets(), [], near._compared
    monkeypatch.setattr(near, "SENT_AT_ONCE", 1)
    monkeypatch.setattr(near, "_compared", lambda pairs, sets, _: (parts.append(most), compared(pairs, sets, most))[1])
    got = corpus_pipeline.near_stage(spark, make(rows), sf_dir)
    assert parts and sorted(r["doc_id"] for r in got.collect()) == kept_by_hand(rows)


def family(n, changed, size=150):
    """A text, and copies with other words at ``changed`` places: each two of them are less than near."""
    rng = random.Random(7)
    base = [f"v{i}" for i in range(size)]
    rows = []
    for doc_id in range(1, n + 1):
        copy = list(base)
        for at in rng.sample(range(size), changed):
            copy[at] = f"u{doc_id}x{at}"
        rows.append((doc_id, " ".join(copy)))
    return rows


def test_pairs_of_a_large_family_stay_few(make, monkeypatch):
    """Each two of 120 texts, 7,140 pairs under many shingles, left the join before any was judged."""
    rows = family(120, 4)
    seen, near_pairs = [], near._near_pairs
    monkeypatch.setattr(near, "CROWD", 10)
    monkeypatch.setattr(near, "linked", lambda rows: rows.select("node", "node").where("false").toDF("a", "b"))
    monkeypatch.setattr(near, "_near_pairs", lambda pairs, *more: (seen.append(pairs.count()), near_pairs(pairs, *more))[1])
    kept = sorted(r["doc_id"] for r in near.kept_rows(make(rows)).select("doc_id").collect())
    assert kept == kept_by_hand(rows)
    assert seen[-1] < 500


@pytest.mark.parametrize("block", [2000, 7])
def test_blocks_of_a_family_lose_no_pair(make, monkeypatch, block):
    """Some pairs are near, most aren't; lists under a shingle in one task and in blocks."""
    rows = family(60, 3)
    rows += [(1000 + d, t + f" end{d}") for d, t in rows[::5]]
    monkeypatch.setattr(near, "CROWD", 10)
    monkeypatch.setattr(near, "BLOCK", block)
    monkeypatch.setattr(near, "linked", lambda rows: rows.select("node", "node").where("false").toDF("a", "b"))
    kept = sorted(r["doc_id"] for r in near.kept_rows(make(rows)).select("doc_id").collect())
    assert kept == kept_by_hand(rows)


def test_all_shingles_of_the_sample_are_counted(spark, monkeypatch):
    """A common shingle that no text of the sample was filed under was filed as a rare one."""
    monkeypatch.setattr(near, "SAMPLE", 1)
    monkeypatch.setattr(near, "CROWD", 20)
    line = [f"c{i}" for i in range(30)]
    rows = [(d, " ".join(line + [f"t{d}x{i}" for i in range(40)])) for d in range(30)]
    crowded, counts = near._crowded(spark.createDataFrame(rows, "row long, text string"))
    assert crowded.tolist() == near.shingles(" ".join(line), near._Words()).tolist()
    assert counts.tolist() == [30] * 26
