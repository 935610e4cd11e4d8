"""Multinomial naive Bayes over word counts, fitted and applied as DataFrame aggregates (no Python worker).

Fitting counts words per label over all rows: one (token, label) aggregate with map-side combine. The model is a
table of one row a token, with its counts in all labels, and a class table of one row a label. Scoring joins a text's
(token, tf) rows to the token table once, so a token's rows are not multiplied by the labels, and sums per text:

    ln P(label) + sum tf * ln(count + 1) - length * ln(words of the label + vocabulary)

which is the Laplace-smoothed log likelihood with the smoothing of unseen words taken out of the sum. Labels are a
vocabulary (the class table comes to the driver to name the columns); tokens and texts stay distributed. A hot token is a
hot key of that join only, which the adaptive skew join splits, since its row in the model is one.

Rows with a null label or id are not learned from. Null and empty texts have the prior alone. Scores are rounded to 6
places before the best is taken (ties: the lesser label), so the order of sums decides nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelens.functions.text import tokens
from framelens.session import checkpoint_dir


@dataclass(frozen=True)
class Bayes:
    """``words``: (token, n array<long>: counts in the labels' order), stored; per label: texts and words."""

    words: DataFrame
    labels: list[str]
    texts: list[int]
    lengths: list[int]
    vocabulary: int


def _counts(rows: DataFrame, text_col: str, *keys: str) -> DataFrame:
    return rows.select(*keys, F.explode(tokens(text_col)).alias("token")).groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("tf"))


def fit_bayes(rows: DataFrame, label_col: str = "label", text_col: str = "text") -> Bayes:
    """Learn from every row of ``rows`` that has a label."""
    checkpoint_dir(rows.sparkSession)
    known = rows.where(F.col(label_col).isNotNull()).select(F.col(label_col).cast("string").alias("label"), F.col(text_col).alias("text"))
    per = _counts(known, "text", "label").checkpoint()
    sizes = {r.label: r.n for r in per.groupBy("label").agg(F.sum("tf").alias("n")).collect()}  # a row a label
    classes = {r.label: r.n for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    labels = sorted(classes)
    counts = [F.coalesce(F.sum(F.when(F.col("label") == F.lit(x), F.col("tf"))), F.lit(0)) for x in labels]
    words = per.groupBy("token").agg(F.array(*counts).alias("n") if labels else F.array().cast("array<long>").alias("n")).checkpoint()
    return Bayes(words, labels, [classes[x] for x in labels], [sizes.get(x, 0) for x in labels], words.count())


def score_bayes(rows: DataFrame, model: Bayes, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, label, score, margin) for every row with a distinct id: the best label, its log score and its lead over the next (null if there is none)."""
    if not model.labels:
        return rows.select(F.col(id_col).alias("id"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("double").alias("score"),
                           F.lit(None).cast("double").alias("margin"))
    own = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    tf = _counts(own, "text", "id")
    met = tf.join(model.words, "token", "left")
    sums = met.groupBy("id").agg(F.sum("tf").alias("length"), *[
        F.sum(F.col("tf") * F.log(F.coalesce(F.col("n")[k], F.lit(0)) + F.lit(1.0))).alias(f"s{k}") for k in range(len(model.labels))])
    total = sum(model.texts)
    log = lambda x: F.log(F.lit(float(x)))
    scores = [F.struct(F.round(log(model.texts[k] / total) + F.coalesce(f"s{k}", F.lit(0.0))
                               - F.coalesce("length", F.lit(0)) * log(max(model.lengths[k] + model.vocabulary, 1)), 6).alias("score"),
                       F.lit(x).alias("label")) for k, x in enumerate(model.labels)]
    ranked = own.select("id").join(sums, "id", "left").select("id", F.array_sort(F.transform(
        F.array(*scores), lambda s: F.struct((-s["score"]).alias("less"), s["label"].alias("label")))).alias("r"))
    lead = F.round(F.get("r", F.lit(1))["less"] - F.col("r")[0]["less"], 6) if len(model.labels) > 1 else F.lit(None).cast("double")
    return ranked.select("id", F.col("r")[0]["label"].alias("label"), (-F.col("r")[0]["less"]).alias("score"), lead.alias("margin"))
