"""Toxicity by non-negative positive-unlabelled learning (Kiryo et al. 2017).

The learner sees confirmed toxic texts P and unlabelled texts U (any text, toxic or not) and minimises

    prior * E_P[loss(+)] + max(0, E_U[loss(-)] - prior * E_P[loss(-)])

with the logistic loss: the class prior corrects U for the toxic texts hidden in it, and a negative corrected
risk (the sign of overfitting) is not followed below zero but pushed back. The classifier is linear over the
presence of words and of word beginnings, fitted in numpy on the driver from a bounded sample
(``max_positive`` and ``max_unlabelled`` documents, ``max_features`` features, at most four per positive); scoring reads every whole text
in Arrow batches.

Edge cases. Null and empty texts are scored by the bias alone. A document labelled twice is toxic if one of
its labels says so; null labels say nothing. Labels without document and documents without label are fine.
No confirmed toxic text: every score is the prior, 0. Repeated rows keep their rows; a null id is scored,
never learned from. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelens.llm.common import bounded_batches, cut

WORD = re.compile(r"\w+")
BEGINNINGS = (4, 5)


@dataclass(frozen=True)
class ToxicityModel:
    weights: dict[str, float]
    bias: float
    prior: float

    def score(self, text: str | None) -> float:
        if not self.weights:
            return self.prior
        z = self.bias + sum(self.weights[f] for f in features(text) & self.weights.keys())
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def features(text: str | None) -> set[str]:
    """Words of the whole text, and their beginnings marked by a leading caret."""
    words = set(WORD.findall((text or "").lower()))
    return words.union(*({"^" + w[:n] for w in words if len(w) >= n} for n in BEGINNINGS))


def nnpu_fit(pos: np.ndarray, unl: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05,
             l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear logistic model of least non-negative PU risk (full-batch Adam)."""
    w = np.zeros(pos.shape[1] + 1, np.float64)
    w[-1] = math.log(prior / (1 - prior))
    first, second = np.zeros_like(w), np.zeros_like(w)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    softplus = lambda z: np.logaddexp(0, z)

    def grad(x: np.ndarray, d: np.ndarray) -> np.ndarray:
        return np.append(d.astype(np.float32) @ x, d.sum()) / len(x)

    for t in range(1, steps + 1):
        zp, zu = (x @ w[:-1].astype(np.float32) + w[-1] for x in (pos, unl))
        sp, su = sigmoid(zp), sigmoid(zu)
        negative = softplus(zu).mean() - prior * softplus(zp).mean()
        g_neg = grad(unl, su) - prior * grad(pos, sp)
        g = prior * grad(pos, sp - 1) + g_neg if negative >= 0 else -g_neg
        g[:-1] += l2 * w[:-1]
        first = 0.9 * first + 0.1 * g
        second = 0.999 * second + 0.001 * g * g
        w -= rate * (first / (1 - 0.9 ** t)) / (np.sqrt(second / (1 - 0.999 ** t)) + 1e-8)
    return w[:-1], float(w[-1])


def _share(h: Column, bound: int, n: int) -> Column:
    """About ``bound`` of n rows, the same ones at every run."""
    return F.pmod(h, F.lit(1_000_000)) < math.ceil(1e6 * min(1.0, bound / max(n, 1)))


def fit(docs: DataFrame, toxic_ids: DataFrame, known_ids: DataFrame, learnable: Column, max_positive: int = 3000,
        max_unlabelled: int = 9000, max_features: int = 512, prior: float | None = None) -> ToxicityModel:
    """Learn from ``docs`` (doc_id, text) where ``learnable``.

    ``toxic_ids`` (doc_id) are the confirmed ones, ``known_ids`` all labelled ones; their ratio is the class
    prior unless one is given.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    toxic = toxic_ids.select("doc_id").distinct()
    n_pos = toxic.count()
    if not n_pos:
        return ToxicityModel({}, 0.0, 0.0)
    prior = prior or min(0.9, n_pos / max(known_ids.select("doc_id").distinct().count(), n_pos))
    n_unl = docs.where(learnable).count()
    mark = F.xxhash64(F.col("doc_id"), F.lit("pu"))
    chosen = toxic.where(_share(mark, max_positive, n_pos)).withColumn("_pos", F.lit(True))  # a bounded number of ids
    train = docs.where(learnable).join(F.broadcast(chosen), "doc_id", "left").where(
        F.col("_pos") | _share(F.xxhash64(F.col("doc_id"), F.lit("unl")), max_unlabelled, n_unl))
    sample = cut(train.select("text", F.coalesce("_pos", F.lit(False)).alias("pos"),
                              _share(F.xxhash64(F.col("doc_id"), F.lit("unl")), max_unlabelled, n_unl).alias("unl")), "pu-sample")

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p, u = Counter(), Counter()
        for b in batches:
            for text, is_p, is_u in zip(b["text"], b["pos"], b["unl"], strict=True):
                found = features(text)
                if is_p:
                    p.update(found)
                if is_u:
                    u.update(found)
        names = list(p)  # a feature that no toxic text has can't be chosen as a sign of toxicity
        # typed, for a partition may hold no toxic text
        yield pd.DataFrame({"f": pd.Series(names, dtype=object), "p": np.array([p[x] for x in names], np.int64), "u": np.array([u[x] for x in names], np.int64)})

    size = sample.agg(F.count_if("pos").alias("p"), F.count_if("unl").alias("u")).first()
    if not size.p or not size.u:
        return ToxicityModel({}, 0.0, 0.0)
    a, b = (F.col("p") + 0.5) / (size.p + 1), (F.col("u") + 0.5) / (size.u + 1)
    z = (a - b) / F.sqrt(a * (1 - a) / size.p + b * (1 - b) / size.u)
    best = (sample.mapInPandas(tally, "f string, p long, u long").groupBy("f").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
            .where(F.col("p") >= min(5, size.p)).orderBy(F.abs(z).desc(), "f").limit(min(max_features, 4 * size.p)).select("f").collect())
    names = [r.f for r in best]
    index = {f: k for k, f in enumerate(names)}

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"pos": b["pos"], "unl": b["unl"],
                                "on": [sorted(index[f] for f in features(t) & index.keys()) for t in b["text"]]})

    seen = sample.mapInPandas(rows, "pos boolean, unl boolean, on array<int>").collect()  # the bounded sample

    def matrix(chosen: list) -> np.ndarray:
        x = np.zeros((len(chosen), len(names)), np.float32)
        for k, r in enumerate(chosen):
            x[k, r.on] = 1
        return x

    w, bias = nnpu_fit(matrix([r for r in seen if r.pos]), matrix([r for r in seen if r.unl]), prior)
    return ToxicityModel({f: float(v) for f, v in zip(names, w, strict=True) if v}, bias, prior)


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score) for every row; reads doc_id and the whole text only."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": [model.score(t) for t in b["text"]]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInPandas(run, "doc_id long, score double")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, **bounds) -> ToxicityModel:
    """Fit on the rows that are not held out."""
    usable = labels.select("doc_id", "toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    return fit(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"),
               usable.where("toxic = 1"), usable, F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")), **bounds)


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; every column is kept."""
    model = train(docs, labels)
    bounded_batches(docs.sparkSession)
    names = docs.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[[model.score(t) < threshold for t in b["text"]]]

    return docs.mapInPandas(run, docs.schema).select(*names)
