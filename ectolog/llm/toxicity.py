"""Toxicity: class-conditional Kneser-Ney models with a shared backoff.

Letters within words are counted for toxic and for ordinary labelled texts.
Each class discounts its own counts and hands the rest to the model of both
together, which backs off to shorter histories (``kneser_ney``): a rare spelling
is judged by what it shares with others. A document's value is the difference of
the two log-likelihoods per word. Rows of one fold are left out of the counts;
on them a logistic curve from value to score is fitted.

Learning uses rows whose ``crc32(doc_id as text) % 5`` is not 0: remainders 1 to
3 for the counts, 4 for the curve. No label, language, source or id enters a
score.

Defined cases: null and empty texts have value 0; without labels of both classes
every score is the share of toxic rows, or 0.5 without any; a null label is no
label; several labels of a document count each; repeated rows give repeated
results.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ectolog.llm import kneser_ney as kn
from ectolog.llm.rows import bounded, id_and_text, stored

ORDER = 7
#: Counts' worth of trust that a class gives the model of both classes, besides the discounts.
TRUST = 10.0
#: Share of toxic words in a toxic text; the rest of its words are ordinary.
SHARE = 0.01
FOLDS = 5
CURVE_FOLD = 4
#: Bins of the value in which the curve's rows are counted before the curve is fitted.
BIN = 0.001


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def train(labelled: DataFrame, order: int = ORDER) -> DataFrame:
    """Model rows (``what``, ``gram``, ``v``) of rows with ``kind`` (1 toxic) and ``text``.

    ``v`` is the difference of the log probabilities. Histories that only one
    class has seen tell nothing and have no rows.
    """
    counts = stored(kn.top_counts(labelled, order))
    n = [F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in (0, 1)]
    both = stored(counts.groupBy("gram").agg(*n))
    pooled, _ = kn.pooled_model(both.select("gram", (F.col("n0") + F.col("n1")).alias("n")), order)
    own = both.withColumn("h", kn.history(F.col("gram")))
    rest = {}
    for k in (0, 1):
        d = kn.discounts(counts.where(F.col("kind") == k))
        c = F.col(f"n{k}")
        cut = F.when(c == 0, 0.0).when(c == 1, d[0]).when(c == 2, d[1]).otherwise(d[2])
        rest[k] = F.greatest(c - cut, F.lit(0.0))
    sums = (
        own.groupBy("h")
        .agg(
            *(F.sum(f"n{k}").alias(f"t{k}") for k in (0, 1)),
            *(F.sum(rest[k]).alias(f"r{k}") for k in (0, 1)),
        )
        .where("t0 > 0 AND t1 > 0")
    )
    whole = {k: F.col(f"t{k}") + TRUST for k in (0, 1)}
    back = {k: (F.col(f"t{k}") - F.col(f"r{k}") + TRUST) / whole[k] for k in (0, 1)}
    joined = own.join(sums, "h").join(pooled.select("gram", "p"), "gram")
    p = {k: rest[k] / whole[k] + back[k] * F.col("p") for k in (0, 1)}
    grams = joined.select(F.lit(0).alias("what"), "gram", (F.log(p[1]) - F.log(p[0])).alias("v"))
    weight = F.log(back[1]) - F.log(back[0])
    histories = sums.select(F.lit(1).alias("what"), F.col("h").alias("gram"), weight.alias("v"))
    return stored(grams.union(histories))


def _scorer(order: int):
    def score(letters: kn.Letters, tables: kn.Tables) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(letters.place > 0)
        length = np.minimum(letters.place[at] + 1, order)
        v = tables.find(letters.gram(at, length))
        unknown = np.flatnonzero(np.isnan(v))
        v[unknown] = np.nan_to_num(
            tables.find(letters.history(at[unknown], length[unknown])), nan=0.0
        )
        words = int(letters.word[-1]) + 1 if len(letters.word) else 0
        ratio = np.bincount(letters.word[at], weights=v, minlength=words)
        return np.logaddexp(math.log1p(-SHARE), math.log(SHARE) + ratio), np.ones(words, np.int64)

    return score


def values(
    docs: DataFrame, model: DataFrame, order: int = ORDER, shard_rows: int = kn.SHARD_ROWS,
    most_rows: int = kn.MOST_ROWS,
) -> DataFrame:
    """``doc_id`` and ``value``: toxic minus ordinary log-likelihood per word.

    A toxic text draws a share of its words from the toxic model and the others
    from the ordinary one, so that its ordinary words weigh next to nothing.
    """
    sent = kn.send(model, order, shard_rows, most_rows)
    sums = kn.sums_over(id_and_text(docs), sent, order, _scorer(order), "doc_id long")
    return sums.select(
        "doc_id", F.when(F.col("n") > 0, F.col("total") / F.col("n")).otherwise(0.0).alias("value")
    )


def curve(scored: DataFrame) -> tuple[float, float]:
    """Intercept and slope of a logistic curve for rows with ``value`` and ``kind``.

    The rows are counted by bins of the value; the classes weigh the same.
    """
    one = scored.groupBy(F.round(F.col("value") / BIN).cast("long").alias("bin")).agg(
        F.sum((F.col("kind") == 1).cast("long")).alias("toxic"), F.count("*").alias("n")
    )
    bins = [(r["bin"] * BIN, r["toxic"], r["n"] - r["toxic"]) for r in one.collect()]
    toxic, plain = sum(b[1] for b in bins), sum(b[2] for b in bins)
    if not toxic or not plain:
        share = 0.5 if not toxic + plain else toxic / (toxic + plain)
        share = min(max(share, 1e-6), 1 - 1e-6)
        return math.log(share / (1 - share)), 0.0
    mean = sum(x * (t + o) for x, t, o in bins) / (toxic + plain)
    spread = math.sqrt(sum((x - mean) ** 2 * (t + o) for x, t, o in bins) / (toxic + plain)) or 1.0
    a = b = 0.0
    for _ in range(100):
        g0 = g1 = h00 = h01 = h11 = 0.0
        for x, t, o in bins:
            z = (x - mean) / spread
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * z))))
            g0 += t - (t + o) * p
            g1 += (t - (t + o) * p) * z
            w = (t + o) * p * (1 - p)
            h00, h01, h11 = h00 + w, h01 + w * z, h11 + w * z * z
        g1 -= 1e-3 * b
        h00, h11 = h00 + 1e-9, h11 + 1e-3
        det = h00 * h11 - h01 * h01
        da, db = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        scale = min(1.0, 5.0 / max(abs(da), abs(db), 1e-12))
        a, b = a + scale * da, b + scale * db
        if max(abs(da), abs(db)) < 1e-9:
            break
    return a - b * mean / spread, b / spread


def score(
    docs: DataFrame, labels: DataFrame, order: int = ORDER, shard_rows: int = kn.SHARD_ROWS,
    most_rows: int = kn.MOST_ROWS,
) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted``, ``value`` of each document.

    ``labels`` has ``doc_id`` and ``toxic`` (0 or 1) of some of them.
    """
    known = labels.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("kind")
    ).where("kind IN (0, 1)")
    learnt = stored(known.where(~fold(F.col("doc_id")).isin(0, CURVE_FOLD)))
    texts = id_and_text(docs)
    model = train(texts.join(bounded(learnt), "doc_id").select("kind", "text"), order)
    scored = stored(values(docs, model, order, shard_rows, most_rows))
    shown = known.where(fold(F.col("doc_id")) == CURVE_FOLD)
    a, b = curve(scored.join(shown, "doc_id").select("value", "kind"))
    p = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.col("value"))))
    return scored.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
        p.alias("score"),
        (p >= 0.5).cast("int").alias("predicted"),
        "value",
    )
