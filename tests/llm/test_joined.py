"""Models beyond the broadcast bound: joined on Spark, with the same values as a broadcast one."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ectolog.llm import kneser_ney as kn
from ectolog.llm import quality, toxicity


def texts_of(seed, n, extra=""):
    rng = random.Random(seed)
    parts = ["an", "the", "in", "or", "ed", "st", "re", "ou", "é", "日本"]
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))
    return [" ".join([word() for _ in range(rng.randint(1, 40))] + [extra] * (k % 4 == 0)) for k in range(n)]


ODD = [(900, None), (901, ""), (902, "  \t\n "), (903, "x" * 5000), (904, "zzz zzz zzz"), (None, "anthe in"), (905, "qu-x\x00")]


def close(a, b):
    return a is None and b is None or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)


@pytest.mark.parametrize("words_joined", [30])
def test_quality_joined(spark, make, monkeypatch, words_joined):
    monkeypatch.setattr(kn, "WORDS_JOINED", words_joined)
    good = list(enumerate(texts_of(1, 60)))
    # A repeated row, and rows that share a text or an id but not both.
    docs = make(good + ODD + [good[3], good[3], (3, "other text"), (950, good[3][1])])
    ids = spark.createDataFrame([(k,) for k, _ in good], "doc_id long")

    def rows(**bound):
        got = quality.classify(docs, ids, 4, **bound).collect()
        return sorted(
            ((r["doc_id"] is None, r["doc_id"] or 0, r["perplexity"] or 0.0, r["accepted"], r["limit"]) for r in got)
        )

    sent, joined = rows(), rows(most_rows=0)
    assert len(sent) == len(joined) == docs.count()
    for a, b in zip(sent, joined, strict=True):
        assert a[:2] == b[:2] and a[3] == b[3] and close(a[2], b[2]) and close(a[4], b[4])
    kept = quality.kept_rows(docs, ids, 4, most_rows=0)
    assert kept.columns == docs.columns
    assert kept.count() == quality.kept_rows(docs, ids, 4).count()


def test_toxicity_joined(spark, make):
    rows = list(enumerate(texts_of(2, 200, "vequou")))
    docs = make(rows + ODD)
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k, _ in rows], "doc_id long, toxic int")

    def scores(**bound):
        return {r["doc_id"]: r for r in toxicity.score(docs, labels, 5, **bound).collect()}

    sent, joined = scores(), scores(most_rows=0)
    assert sent.keys() == joined.keys()
    for k in sent:
        assert close(sent[k]["value"], joined[k]["value"]) and close(sent[k]["score"], joined[k]["score"])
    assert len({round(r["value"], 6) for r in joined.values()}) > 50


def test_nothing_to_score(spark, make):
    docs, ids = make([]), spark.createDataFrame([], "doc_id long")
    assert quality.classify(docs, ids, 3, most_rows=-1).collect() == []
    only_empty = make([(1, None), (2, "")])
    got = quality.classify(only_empty, ids, 3, most_rows=-1).collect()
    assert len(got) == 2 and all(r["perplexity"] is None and r["accepted"] for r in got)


def test_blocks_of_many_words(spark, make, monkeypatch):
    """Each distinct word is judged once, whatever the number of blocks; unknown grams included."""
    monkeypatch.setattr(kn, "WORDS_JOINED", 100)
    words = [f"{k:x}" for k in range(3_000)]
    docs = make([(k, " ".join(words[k::50])) for k in range(50)])

    def score(letters, tables):
        at = np.flatnonzero(letters.place > 0)
        v = tables.find(letters.gram(at, np.ones(len(at), np.int64)))
        return np.bincount(letters.word[at], weights=np.isnan(v)), np.bincount(letters.word[at])

    model = spark.createDataFrame([], "key long, v float")
    counted = kn._word_counts(docs.select("doc_id", "text"), "doc_id long")
    distinct = counted.where("word IS NOT NULL").select("word").distinct()
    found = kn._word_values(distinct, model, 1, score)
    letters = sum(map(len, words)) + len(words)
    assert found.count() == found.select("word").distinct().count() == 3_000
    assert found.agg(F.sum("value"), F.sum("size")).first() == (letters, letters)
