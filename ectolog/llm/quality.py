"""Quality classifier: perplexity under a Kneser-Ney model of trusted text.

The model (``kneser_ney``) is trained on every trusted row. Each document gets
its perplexity per letter, and is rejected when that exceeds the threshold of
its language. A threshold comes from quantiles of the trusted documents of that
language: the median of the log perplexity plus ``spread`` times the distance
from the median to the upper quantile, so that it lies well outside of what
trusted text shows, whatever the language. As means of few letters scatter, a
slack that shrinks with the root of the length is added.

Defined cases: null and empty texts have a null perplexity and are accepted
(nothing speaks against them); a language without trusted documents, null
included, uses the quantiles of all languages; without any trusted text
everything is accepted. Repeated rows give repeated results; a trusted id that
occurs in several rows counts each of them.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ectolog.llm import kneser_ney as kn
from ectolog.llm.rows import bounded, stored

ORDER = 5
#: Upper quantile of trusted documents, and how many times its distance from the median counts.
UPPER = 0.9
SPREAD = 5.0
#: Least distance of a threshold from the median, as a log perplexity.
LEAST = 0.15
#: A short text may exceed the threshold by this much, divided by the root of its letters.
SLACK = 4.0
#: Accuracy of the quantiles (percentile_approx).
QUANTILE_ACCURACY = 10_000

_KEEP = "row long, doc_id long, lang string"


def _row(docs: DataFrame) -> Column:
    """A name for what a row says."""
    doc_id, lang = docs["doc_id"].cast("long"), docs["lang"].cast("string")
    return F.xxhash64(doc_id, lang, F.coalesce(docs["text"], F.lit("")))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(
        _row(docs).alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("lang").cast("string").alias("lang"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )


def train(trusted: DataFrame, order: int = ORDER) -> tuple[DataFrame, int]:
    """Model rows (``what``, ``gram``, ``v``) of rows with ``text``, and the number of letters."""
    kind = trusted.select(F.lit(0).alias("kind"), F.coalesce("text", F.lit("")).alias("text"))
    top = stored(kn.top_counts(kind, order).select("gram", "n"))
    whole, n_letters = kn.pooled_model(top, order)
    whole = stored(whole)
    grams = whole.select(F.lit(0).alias("what"), "gram", F.log("p").alias("v"))
    weights = whole.groupBy("h").agg(F.max("back").alias("back"))
    histories = weights.where("back > 0").select(
        F.lit(1).alias("what"), F.col("h").alias("gram"), F.log("back").alias("v")
    )
    return stored(grams.union(histories)), n_letters


def _scorer(order: int, n_letters: int):
    def score(letters: kn.Letters, tables: kn.Tables) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(letters.place > 0)
        total = np.zeros(len(letters.place))
        length = np.minimum(letters.place[at] + 1, order)
        while len(at):
            p = tables.find(letters.gram(at, length))
            known = ~np.isnan(p)
            total[at[known]] += p[known]
            at, length = at[~known], length[~known]
            back = tables.find(letters.history(at, length))
            total[at] += np.nan_to_num(back, nan=0.0)
            total[at[length == 1]] -= math.log(n_letters)
            at, length = at[length > 1], length[length > 1] - 1
        words = int(letters.word[-1]) + 1 if len(letters.word) else 0
        size = np.bincount(letters.word, minlength=words) - 1
        return np.bincount(letters.word, weights=total, minlength=words), size

    return score


def thresholds(scored: DataFrame, upper: float = UPPER, spread: float = SPREAD) -> DataFrame:
    """``lang``, ``limit`` from rows of trusted documents; the row of all has ``every`` true."""
    q = lambda p: F.percentile_approx("log_perplexity", F.lit(p), F.lit(QUANTILE_ACCURACY))
    limit = q(0.5) + F.greatest(spread * (q(upper) - q(0.5)), F.lit(LEAST))
    some = scored.where("log_perplexity IS NOT NULL")
    by = some.where("lang IS NOT NULL").groupBy("lang").agg(limit.alias("limit"))
    return by.select("lang", "limit", F.lit(False).alias("every")).union(
        some.agg(limit.alias("limit")).select(
            F.lit(None).cast("string"), "limit", F.lit(True)
        )
    )


def _judged(
    docs: DataFrame, trusted_ids: DataFrame, order: int, shard_rows: int, most_rows: int
) -> DataFrame:
    """``row``, ``doc_id``, ``lang``, ``n``, ``log_perplexity``, ``own_limit``, ``accepted``.

    Everything is scored once; the limits come from the trusted ones among it.
    """
    ids = stored(trusted_ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct())
    rows = _rows(docs)
    model, n_letters = train(rows.join(bounded(ids), "doc_id", "left_semi"), order)
    sent = kn.send(model, order, shard_rows, most_rows)
    sums = kn.sums_over(rows, sent, order, _scorer(order, n_letters), _KEEP)
    mean = F.when(F.col("n") > 0, -F.col("total") / F.col("n"))
    scored = stored(sums.select("row", "doc_id", "lang", "n", mean.alias("log_perplexity")))
    limits = stored(thresholds(scored.join(ids, "doc_id", "left_semi")))
    every = limits.where("every").first()["limit"]
    joined = scored.join(limits.where("NOT every").select("lang", "limit"), "lang", "left")
    limit = F.coalesce("limit", F.lit(every).cast("double"))
    limit = limit + SLACK / F.sqrt(F.greatest("n", F.lit(1)))
    accepted = F.coalesce(F.col("log_perplexity") <= limit, F.lit(True))
    return joined.select(*scored.columns, limit.alias("own_limit"), accepted.alias("accepted"))


def classify(
    docs: DataFrame, trusted_ids: DataFrame, order: int = ORDER, shard_rows: int = kn.SHARD_ROWS,
    most_rows: int = kn.MOST_ROWS,
) -> DataFrame:
    """``doc_id``, ``lang``, ``perplexity``, ``limit``, ``accepted`` of each document.

    ``trusted_ids`` has the ``doc_id`` of trusted documents among ``docs``.
    """
    return _judged(docs, trusted_ids, order, shard_rows, most_rows).select(
        "doc_id",
        "lang",
        F.exp("log_perplexity").alias("perplexity"),
        F.exp("own_limit").alias("limit"),
        "accepted",
    )


def kept_rows(
    docs: DataFrame, trusted_ids: DataFrame, order: int = ORDER, shard_rows: int = kn.SHARD_ROWS,
    most_rows: int = kn.MOST_ROWS,
) -> DataFrame:
    """The rows of ``docs`` that are accepted, with all their columns.

    Rejected rows are named by what they say, so that rows without an id or with
    the same one are told apart.
    """
    judged = _judged(docs, trusted_ids, order, shard_rows, most_rows)
    bad = stored(judged.where("NOT accepted").select(F.col("row").alias("__row")).distinct())
    return docs.join(bounded(bad), _row(docs) == F.col("__row"), "left_anti")
