"""Soft-membership mixing of documents to target weights of domains.

A naive Bayes classifier of a labelled table gives each document a posterior over the domains. Rates
of 0 or more are then fitted by projected gradient least squares, so that the expected token totals of
the domains are in the proportion of the targets. Column expressions only; the driver sees one model of
fixed size and, for each step, one row of sums.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.columns import packed, unpacked
from tessera.llm.quality_rules import words_of
from tessera.session import cut, fenced

DOMAINS = ("high", "low", "toxic")
#: Target shares of tokens by domain: little toxic text, and one plain document in eight.
TARGETS = {"high": 0.85, "low": 0.12, "toxic": 0.03}

#: Labelled rows that the classifier is fitted on at most: those whose ids hash lowest.
TRAIN_ROWS = 4000
#: Hashed word features, and whole steps of a weight per natural logarithm.
FEATURES, STEPS = 4096, 1024
SMOOTHING = 0.5

#: Gradient steps at most, and the largest error of a share at which they end.
ROUNDS, TOLERANCE = 30, 1e-4
#: Ridge of the metric in which steps are taken, and decimals of a step (so that sums in another order give the same step).
RIDGE, DECIMALS = 1e-4, 9
SEED = 20240229


def _features(text: Column) -> Column:
    """Hashed distinct words of a text, as 0-based numbers."""
    return F.transform(F.array_distinct(words_of(F.lower(F.coalesce(text, F.lit(""))))), lambda w: F.pmod(F.xxhash64(w), F.lit(FEATURES)).cast("int"))


def domain_of(quality: Column, toxic: Column) -> Column:
    """Number of the domain of a labelled row; null labels count as 0."""
    return F.when(F.coalesce(toxic, F.lit(0)) == 1, 2).when(F.coalesce(quality, F.lit(0)) == 1, 0).otherwise(1)


class Model:
    """Weights of domains against the first, in whole steps: by feature, and of the domain itself."""

    def __init__(self, words: np.ndarray, rows: np.ndarray) -> None:
        log = np.log((words + SMOOTHING) / (words.sum(1, keepdims=True) + SMOOTHING * FEATURES))
        self.weights = np.rint((log[1:] - log[0]) * STEPS).astype(int)
        prior = np.log((rows + 1) / (rows.sum() + len(rows)))
        self.prior = np.rint((prior[1:] - prior[0]) * STEPS).astype(int)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The classifier, from documents that labels has (doc_id, quality, toxic). Without any all domains are alike."""
    named = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(domain_of(F.col("quality"), F.col("toxic"))).alias("_domain"))
    named = named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    known = docs.select("doc_id", "text").join(F.broadcast(named), "doc_id").groupBy("doc_id", "_domain").agg(F.min("text").alias("text"))  # TRAIN_ROWS rows at most
    known = cut(known.select("_domain", _features(F.col("text")).alias("_f")))
    rows, words = np.zeros(len(DOMAINS)), np.zeros((len(DOMAINS), FEATURES))
    for r in known.groupBy("_domain").count().collect():
        rows[r._domain] = r["count"]
    for r in known.select("_domain", F.explode("_f").alias("f")).groupBy("_domain", "f").count().collect():  # DOMAINS x FEATURES rows at most
        words[r._domain, r.f] = r["count"]
    return Model(words, rows)


def _sum_of(table: Column, numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, i: a + F.get(table, i))


def _scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs with _n (words) and the posteriors _p0, _p1 ...

    The evidence of a text of m distinct words is divided by the fourth root of m, which keeps the
    posteriors of long texts soft.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.withColumns({"_n": F.size(words_of(text)).cast("long"), "_f": _features(text)})
    # A text literal keeps the plan small; it is turned into an array once, when the plan is optimised.
    table = [F.split(F.lit(",".join(map(str, w))), ",").cast("array<int>") for w in model.weights]
    sums = [_sum_of(t, F.col("_f")) for t in table]
    evidence = [F.exp(F.greatest(F.lit(-50.0), F.least(F.lit(50.0), (p + s / F.greatest(F.lit(1.0), F.pow(F.size("_f"), F.lit(0.25)))) / STEPS))) for p, s in zip(model.prior.tolist(), sums, strict=True)]
    df = df.withColumns({f"_e{k + 1}": e for k, e in enumerate(evidence)}).withColumn("_e0", F.lit(1.0))
    every = [F.col(f"_e{k}") for k in range(len(DOMAINS))]
    return df.withColumns({f"_p{k}": e / sum(every[1:], every[0]) for k, e in enumerate(every)}).drop("_f", *[f"_e{k}" for k in range(len(DOMAINS))])


def _rate(steps: list[np.ndarray]) -> Column:
    """The rate of a row after these steps from 1."""
    rate = F.lit(1.0)
    for step in steps:
        rate = F.greatest(F.lit(0.0), rate - sum((F.col(f"_p{k}") * float(x) for k, x in enumerate(step)), F.lit(0.0)))
    return rate


def fit_rates(scored: DataFrame, targets: dict[str, float], relative: bool = False) -> list[np.ndarray]:
    """Projected gradient steps on the squared errors of the domains' shares, all documents at once.

    With w the share of a document's tokens, p its posterior and r its rate, the shares are s = sum w r p.
    A step takes p . (G^-1 e) off each rate, e being s less the target and G the sum of w p p' over
    documents with a rate over 0: the gradient in the metric of the documents that can move. Rates
    stay at 0 or above. Each step is one aggregate over a table of numbers. Relative targets are factors
    of the shares that the documents have as they are.
    """
    K = range(len(DOMAINS))
    goal = np.array([targets.get(d, 1.0 if relative else 0.0) for d in DOMAINS])
    total = scored.agg(F.sum("_n")).first()[0] or 0
    steps: list[np.ndarray] = []
    if not total:
        return steps
    for _ in range(ROUNDS):
        df = scored.withColumn("_r", _rate(steps))
        w = F.col("_n") / F.lit(float(total))
        shares = [F.sum(w * F.col("_r") * F.col(f"_p{k}")).alias(f"s{k}") for k in K]
        metric = [F.sum(F.when(F.col("_r") > 0, w * F.col(f"_p{j}") * F.col(f"_p{k}"))).alias(f"g{j}{k}") for j in K for k in K]
        row = df.agg(*shares, *metric).first()
        if not steps:
            goal = goal * np.array([row[f"s{k}"] for k in K]) if relative else goal
            goal = goal / goal.sum()
        e = np.array([row[f"s{k}"] for k in K]) - goal
        if np.abs(e).max() < TOLERANCE:
            break
        g = np.array([[row[f"g{j}{k}"] or 0.0 for k in K] for j in K])
        steps.append(np.round(np.linalg.solve(g + RIDGE * np.eye(len(DOMAINS)), e), DECIMALS))
    return steps


def _copies(rate: Column, doc_id: Column) -> Column:
    """The rate, rounded up or down so that it holds on average; by the document's id alone."""
    return F.floor(rate + F.pmod(F.xxhash64(doc_id, F.lit(SEED)), F.lit(1 << 20)) / F.lit(float(1 << 20))).cast("long")


#: Columns that the operator adds; columns of the input with these names are replaced.
ADDED = ("n_words", *(f"p_{d}" for d in DOMAINS), "rate", "copies")


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, relative: bool = False) -> DataFrame:
    """One row per row of docs: its columns but text, with ADDED (words, posteriors, rate, and copies to take).

    Null and empty texts have no words, the posterior of the labels alone, and a rate like any other.
    Repeated rows have the same rate and copies. An empty table gives no rows. Domains that no document
    can belong to are left short. Copies depend on doc_id alone beside the rate; null ids are one id.
    """
    names = [c for c in docs.columns if c != "text" and c not in ADDED]
    scored = cut(_scored(packed(docs, "doc_id", "text", without=("text", *ADDED)), fit(docs, labels)).drop("text"))
    steps = fit_rates(scored, targets or TARGETS, relative)
    out = scored.withColumn("rate", F.round(_rate(steps), 6)).withColumn("copies", _copies(F.col("rate"), F.col("doc_id")))
    return unpacked(out, names, F.col("_n").alias("n_words"), *[F.col(f"_p{k}").alias(f"p_{d}") for k, d in enumerate(DOMAINS)], "rate", "copies")


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, relative: bool = False) -> DataFrame:
    """The rows of docs, each as often as its copies say; columns are those of docs, whatever their names.

    Null and empty texts are copied by the rate of the labels' shares; repeated rows have the same copies
    each; an empty table gives no rows. Rows of one doc_id but different texts have rates of their own.
    """
    model = fit(docs, labels)
    scored = cut(_scored(docs.select("doc_id", "text"), model).select("_n", *[f"_p{k}" for k in range(len(DOMAINS))]))
    steps = fit_rates(scored, targets or TARGETS, relative)
    again = fenced(_scored(packed(docs, "doc_id", "text"), model))
    many = fenced(again.withColumn("_copies", _copies(F.round(_rate(steps), 6), F.col("doc_id"))), "_fence2").where("_copies > 0 AND _fence >= 0 AND _fence2 >= 0")
    return unpacked(many.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("_copies").cast("int")))), docs.columns)
