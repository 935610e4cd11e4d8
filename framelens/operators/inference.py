"""Batched tactic inference: batches, pluggable model calls with retries and
quarantine, answer cleaning/parsing, last-answer-wins merge, quota cut.

* Batches: batch_index = row_idx div 5, key route = batch_index mod n_keys;
  payload = JSON array of {id, text} in id order. A batch holds at
  most 5 rows, so the groupBy collects bounded groups only.
* Calls: ``run_batches`` is a ``mapInPandas`` over payload rows; each task
  calls ``model(payload, attempt) -> text`` up to 3 times (empty answer, bad
  JSON or an exception retry; a quota error stops retrying) and emits
  (batch_index, attempts, status, answer, error). The model is any Python
  callable; the built-in offline one is the weighted-lexicon scorer.
* Parsing: native columns only — Python-compatible strip, fence cleanup,
  ``try_parse_json`` to VARIANT, only a top-level array is used; per item a
  missing key takes its default while an explicit JSON null stays null;
  non-integer or out-of-range ids and unreadable confidences are quarantined.
* Merge: per row id the last answer (batch order, then array order) wins;
  rows without a label are dropped.
* Quota: the first QUOTA_EXHAUSTED batch ends the run; only earlier batches
  keep their answers.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelens.functions.text import cap, py_strip
from framelens.schema import (BATCH_SIZE, DEFAULT_LABEL, DEFAULT_TECHNIQUE, INFERENCE_TEXT_CAP as REMOTE_TEXT_CHARS,
                              MAX_ATTEMPTS, TACTIC_LABELS)

SUCCESS, FAILED, QUOTA = "SUCCESS", "FAILED", "QUOTA_EXHAUSTED"
INT_TYPES = ["BIGINT", "INT", "SMALLINT", "TINYINT"]


# ---------------------------------------------------------------------------
# batches
# ---------------------------------------------------------------------------
def batch_items(rows: DataFrame, n_keys: int = 1, text_col: str = "full_text", max_chars: int | None = None) -> DataFrame:
    """(batch_index, key_route, n_items, first_id, last_id, text_chars, payload).

    Whole texts, or their first ``max_chars`` characters for a remote model that takes no more
    (``REMOTE_TEXT_CHARS`` is what the analysed service was sent).
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    text = text if max_chars is None else cap(text, max_chars)
    items = rows.select(F.floor(F.col("row_idx") / BATCH_SIZE).cast("long").alias("batch_index"),
                        F.struct(F.col("row_idx").alias("id"), text.alias("text")).alias("item"))
    b = items.groupBy("batch_index").agg(F.array_sort(F.collect_list("item")).alias("items"))
    return b.select(
        "batch_index",
        F.pmod(F.col("batch_index"), F.lit(n_keys)).alias("key_route"),
        F.size("items").cast("long").alias("n_items"),
        F.col("items")[0]["id"].alias("first_id"),
        F.element_at("items", -1)["id"].alias("last_id"),
        F.aggregate("items", F.lit(0).cast("long"), lambda acc, x: acc + F.length(x["text"])).alias("text_chars"),
        F.to_json("items").alias("payload"))


class QuotaExhausted(Exception):
    """Raised by a model when its daily quota is spent."""


def _typed_quota(e: Exception) -> bool:
    return isinstance(e, QuotaExhausted)


_FENCED = re.compile(r"\s*```(?:json)?(?P<body>.*?)(?:```\s*)?", re.DOTALL)


def answer_json(answer: str) -> object:
    """The JSON value of an answer, which may stand in a code fence; raises ValueError if there is none."""
    fenced = _FENCED.fullmatch(answer)
    return json.loads(fenced["body"] if fenced else answer)


def call_with_retries(model: Callable[[str, int], str], payload: str, attempts: int = MAX_ATTEMPTS,
                      is_quota: Callable[[Exception], bool] = _typed_quota) -> tuple[int, str, str | None, str | None]:
    """(attempts_used, status, answer, error). The model receives the attempt number (0, 1, 2). ``is_quota`` tells
    the errors of a spent quota; by default a model raises QuotaExhausted. Import errors fail the job."""
    err = None
    for a in range(attempts):
        try:
            ans = model(payload, a)
            answer_json(ans or "")
            return a + 1, SUCCESS, ans, None
        except ImportError:
            raise
        except Exception as e:  # noqa: BLE001 - every failure is retried or reported
            if is_quota(e):
                return a + 1, QUOTA, None, str(e)
            err = f"{type(e).__name__}: {e}"
    return attempts, FAILED, None, err


RUN_SCHEMA = "batch_index long, key_route long, attempts int, status string, answer string, error string"


def run_batches(batches: DataFrame, model: Callable[[str, int], str] | Sequence[Callable[[str, int], str]]) -> DataFrame:
    """Call ``model`` for every batch inside executors (mapInPandas). Of several models (one for each key), a batch
    goes to the one of its ``key_route``."""
    models = [model] if callable(model) else list(model)

    def fn(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = [call_with_retries(models[r % len(models)], p) for r, p in zip(pdf["key_route"], pdf["payload"])]
            yield pd.DataFrame({
                "batch_index": pdf["batch_index"].astype("int64"),
                "key_route": pdf["key_route"].astype("int64"),
                "attempts": [o[0] for o in out],
                "status": [o[1] for o in out],
                "answer": [o[2] for o in out],
                "error": [o[3] for o in out]})
    # spread batches over tasks: at most a few batches per Arrow batch
    return batches.repartition("batch_index").mapInPandas(fn, RUN_SCHEMA)


# ---------------------------------------------------------------------------
# parsing
# ---------------------------------------------------------------------------
def clean_answer(c: Column) -> Column:
    """strip(); if fenced: strip backticks at both ends, drop the FIRST 'json'
    anywhere, strip again (kept literally, damage included)."""
    s = py_strip(c)
    fenced = py_strip(F.regexp_replace(F.regexp_replace(s, "^`+|`+$", ""), "(?s)^(.*?)json", "$1"))
    return F.when(s.startswith("```"), fenced).otherwise(s)


def parse_answers(answers: DataFrame, n_rows: int) -> DataFrame:
    """answers: (batch_index, status, answer) -> one row per answer item:
    (batch_index, pos, id, tactic_label, specific_technique, confidence,
    reasoning, quarantine). ``quarantine`` is null for usable items."""
    ok = answers.where(F.col("status") == SUCCESS)
    v = ok.select("batch_index", F.try_parse_json(clean_answer(F.col("answer"))).alias("v"))
    arr = v.select("batch_index", F.try_variant_get("v", "$", "array<variant>").alias("arr"))
    items = arr.select("batch_index", F.posexplode("arr").alias("pos", "item"))

    def get(k: str) -> Column:
        return F.variant_get("item", f"$.{k}", "variant")

    def text(k: str, default: str) -> Column:
        return (F.when(get(k).isNull(), F.lit(default))
                .when(F.is_variant_null(get(k)), F.lit(None).cast("string"))
                .otherwise(F.try_variant_get("item", f"$.{k}", "string")))

    id_type = F.schema_of_variant(get("id"))
    id_ok = id_type.isin(INT_TYPES)
    idv = F.when(id_ok, F.try_variant_get("item", "$.id", "long"))
    conf = (F.when(get("confidence").isNull(), F.lit(0.0))
            .otherwise(F.try_variant_get("item", "$.confidence", "double")))
    quarantine = (F.when(~F.schema_of_variant("item").startswith("OBJECT"), F.lit("item_not_object"))
                  .when(get("id").isNull() | F.is_variant_null(get("id")), F.lit("no_id"))
                  .when(~id_ok, F.lit("id_not_integer"))
                  .when((idv < 0) | (idv >= n_rows), F.lit("id_out_of_range"))
                  .when(conf.isNull(), F.lit("bad_confidence")))
    return items.select(
        "batch_index", F.col("pos").cast("long").alias("pos"), idv.alias("id"),
        text("tactic_label", DEFAULT_LABEL).alias("tactic_label"),
        text("specific_technique", DEFAULT_TECHNIQUE).alias("specific_technique"),
        conf.alias("confidence"),
        text("reasoning", "").alias("reasoning"),
        quarantine.alias("quarantine"))


def quota_cut(answers: DataFrame) -> DataFrame:
    """Keep batches before the first QUOTA_EXHAUSTED one (all if none).
    The stop index is one global min; a left-anti range test against a
    one-row frame would be a cross product, so it is read as a scalar."""
    first = answers.where(F.col("status") == QUOTA).agg(F.min("batch_index")).first()[0]
    return answers if first is None else answers.where(F.col("batch_index") < F.lit(first))


def merge_answers(rows: DataFrame, parsed: DataFrame) -> DataFrame:
    """Attach the last usable answer per row id (batch order, then position);
    drop rows left without a label. ``max_by`` over (batch_index, pos) is a
    partial aggregate, so an id named by many answers is combined map-side."""
    good = parsed.where(F.col("quarantine").isNull())
    ans = F.struct("tactic_label", "specific_technique", "confidence", "reasoning")
    last = good.groupBy("id").agg(F.max_by(ans, F.struct("batch_index", "pos")).alias("a")).select(
        F.col("id").alias("row_idx"), F.col("a.tactic_label").alias("tactic_label"),
        F.col("a.specific_technique").alias("specific_technique"),
        F.col("a.confidence").alias("tactic_confidence"), F.col("a.reasoning").alias("llm_reasoning"))
    base = rows.drop("tactic_label", "specific_technique", "tactic_confidence", "llm_reasoning")
    return base.join(last, "row_idx", "left").where(F.col("tactic_label").isNotNull())


# ---------------------------------------------------------------------------
# built-in offline model: weighted lexicon
# ---------------------------------------------------------------------------
# FIXED VALUES: the offline scorer's lexicon (token, label, weight), chosen
# from frequent words of the test corpus in its four languages.
LEXICON: list[tuple[str, str, int]] = [
    ("the", "Neutral Reporting", 1), ("and", "Neutral Reporting", 1), ("of", "Neutral Reporting", 1),
    ("to", "Selective Framing / Bias", 2), ("is", "False Authority / Unverified Claims", 2),
    ("was", "Disinformation", 3), ("that", "Selective Framing / Bias", 2), ("by", "False Authority / Unverified Claims", 3),
    ("for", "Nationalism / Pride", 2), ("with", "Emotional Manipulation", 2), ("as", "Ridicule / Delegitimization", 2),
    ("are", "Anti-Establishment", 3), ("this", "Fear-Mongering / Alarmism", 3), ("on", "Justification of Violence", 2),
    ("le", "Nationalism / Pride", 2), ("la", "Emotional Manipulation", 2), ("les", "Othering / Scapegoating", 3),
    ("des", "Othering / Scapegoating", 2), ("de", "Neutral Reporting", 1), ("et", "Moral / Religious Framing", 2),
    ("en", "Victim-Blaming", 2), ("du", "Anti-Establishment", 2), ("un", "Fear-Mongering / Alarmism", 2),
    ("qui", "Ridicule / Delegitimization", 3), ("pour", "Justification of Violence", 3), ("par", "Disinformation", 2),
    ("der", "Nationalism / Pride", 3), ("die", "Fear-Mongering / Alarmism", 2), ("und", "Neutral Reporting", 1),
    ("das", "Victim-Blaming", 3), ("ist", "Disinformation", 2), ("sch", "Moral / Religious Framing", 3),
    ("für", "Justification of Violence", 2), ("el", "Emotional Manipulation", 3), ("los", "Othering / Scapegoating", 2),
    ("las", "Victim-Blaming", 2), ("que", "Selective Framing / Bias", 3), ("para", "Anti-Establishment", 2),
    ("co", "Ridicule / Delegitimization", 2), ("se", "Moral / Religious Framing", 2),
]
LABEL_ORDER = {k: i for i, k in enumerate(TACTIC_LABELS)}


def lexicon_table(spark) -> DataFrame:
    """(token, tactic_label, weight, label_idx) — 40 rows; broadcast side."""
    return spark.createDataFrame([(t, l, w, LABEL_ORDER[l]) for t, l, w in LEXICON],
                                 "token string, tactic_label string, weight int, label_idx int")


def lexicon_tactics(spark, rows: DataFrame, text_col: str = "text", id_col: str = "row_idx") -> DataFrame:
    """Offline classifier as a Spark job: tokens of the whole text joined
    to the (broadcast, 40-row) lexicon, weights summed per (row, label), best
    label by (score desc, catalogue order); rows with no lexicon token are
    'Neutral Reporting' with score 0. confidence = best / total, in
    thousandths (exact integer rounding)."""
    from framelens.functions.text import ratio_milli, tokens
    toks = rows.select(F.col(id_col).alias("id"),
                       F.explode(tokens(F.col(text_col))).alias("token"))
    hits = toks.join(F.broadcast(lexicon_table(spark)), "token")
    per = hits.groupBy("id", "tactic_label", "label_idx").agg(F.sum("weight").alias("score"))
    best = per.groupBy("id").agg(
        F.max_by("tactic_label", F.struct(F.col("score"), -F.col("label_idx"))).alias("tactic_label"),
        F.max("score").alias("score"), F.sum("score").alias("total"))
    ids = rows.select(F.col(id_col).alias("id"))
    out = ids.join(best, "id", "left")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("tactic_label", F.lit(DEFAULT_LABEL)).alias("tactic_label"),
        F.coalesce("score", F.lit(0)).cast("long").alias("score"),
        F.when(F.col("total") > 0, ratio_milli(F.col("score"), F.col("total")) / F.lit(1000.0))
        .otherwise(F.lit(0.0)).alias("confidence"))


def lexicon_model(payload: str, attempt: int = 0) -> str:
    """The same scorer as a per-batch Python model: JSON answer text for a
    payload of {id, text} items (a small helper run inside executors)."""
    lex: dict[str, list[tuple[str, int]]] = {}
    for t, l, w in LEXICON:
        lex.setdefault(t, []).append((l, w))
    out = []
    for item in json.loads(payload):
        scores: dict[str, int] = {}
        for tok in re.findall(r"[^\W_]+", (item["text"] or "").lower()):
            for l, w in lex.get(tok, ()):
                scores[l] = scores.get(l, 0) + w
        if scores:
            best = max(scores, key=lambda k: (scores[k], -LABEL_ORDER[k]))
            tot = sum(scores.values())
            conf = ((2000 * scores[best] + tot) // (2 * tot)) / 1000.0
        else:
            best, conf = DEFAULT_LABEL, 0.0
        out.append({"id": item["id"], "tactic_label": best, "specific_technique": "lexicon match",
                    "confidence": conf, "reasoning": "weighted lexicon score"})
    return json.dumps(out)
