"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

The token counts of all documents form a table of cells (source, language, topic). A sample that holds the
share ``share`` of all tokens is wanted, its tokens distributed over sources, languages and topics as the
targets say. Raking starts from that share of every cell and multiplies the cells by one factor per source,
then per language, then per topic, so that each marginal meets its target in turn; ``rounds`` sweeps of the
three bring all close together. No cell can give more tokens than it has: one that would have to is taken
whole, and the following factors make the rest of its marginal up from other cells. Where a whole marginal
falls short of its target (all its cells taken whole), the sample is smaller by that much. A document's
sampling probability is its cell's fitted tokens over its own tokens, so the expected tokens of the sample are the
fitted ones. The draw is a hash of the doc_id: the same at every run and on every executor.

Only the cells (distinct combinations, aggregated before the shuffle) are iterated on. They are stored after
every factor, so plans stay small and Spark knows the cells' size: it broadcasts them to the documents only
below its broadcast threshold; beyond it the join is shuffled and its skew split.

Edge cases. A null source, language or topic is a category of its own. Null and empty texts have no tokens:
they are sampled as the others of their cell, and not at all if their cell has no tokens. Targets for
categories that the corpus lacks are left out and the others scaled up; categories without target get none.
Repeated rows count again and are drawn alike; a null doc_id draws as the empty string. An empty table gives
an empty result. Extra columns are carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelens.llm.common import cut, packed, unpacked

DIMS = ("source", "lang", "topic")
ROUNDS = 8
SHARE = 0.7
WORDS = r"[^ \t\n\x0B\f\r]+"
#: Topics by what a text holds, first that fits (fixed values).
TOPICS = (("legal", r"[Ll]icen[sc]e|[Rr]ights reserved"), ("contact", "[a-z]@[a-z]"), ("shout", "!!"), ("record", "[0-9][0-9][0-9]"))


def topic(text: Column) -> Column:
    out = F.lit("prose")
    for name, pattern in reversed(TOPICS):
        out = F.when(F.coalesce(text, F.lit("")).rlike(pattern), name).otherwise(out)
    return out


def rake(cells: DataFrame, targets: dict[str, DataFrame] | None = None, share: float = SHARE, rounds: int = ROUNDS) -> DataFrame:
    """(source, lang, topic, rate) of the stored ``cells`` (source, lang, topic, tokens).

    ``targets[dim]`` has (dim, target) rows; a dimension without them is tempered: the square root of its own
    token counts. Targets need not add up to anything.
    """
    wanted = share * float(cells.agg(F.sum("tokens")).first()[0] or 0)
    now = cells.withColumn("y", F.col("tokens") * share)
    for d in DIMS:
        own = cells.groupBy(d).agg(F.sum("tokens").alias("own"))
        if targets and d in targets:
            given = targets[d].select(F.coalesce(F.col(d).cast("string"), F.lit("(null)")).alias(d), F.col("target").cast("double").alias("target"))
            own = own.join(given, d, "left").select(d, F.when(F.col("own") > 0, F.coalesce("target", F.lit(0.0))).otherwise(0.0).alias("target"))
        else:
            own = own.select(d, F.sqrt("own").alias("target"))
        own = cut(own, f"target-{d}")
        total = own.agg(F.sum("target")).first()[0] or 1.0
        now = now.join(own.select(d, (F.col("target") / total).alias(f"t_{d}")), d)
    now = cut(now, "targets")
    for _ in range(rounds):
        for d in DIMS:
            m, t = F.sum("y"), F.first(f"t_{d}")
            factor = now.groupBy(d).agg(F.when(m > 0, t * F.lit(wanted) / m).otherwise(0.0).alias("f"))
            fitted = F.least(F.col("tokens").cast("double"), F.col("y") * F.col("f"))
            now = cut(now.join(factor, d).select(*DIMS, "tokens", fitted.alias("y"), *[f"t_{x}" for x in DIMS]), "raked")
    return now.select(*DIMS, F.when(F.col("tokens") > 0, F.col("y") / F.col("tokens")).otherwise(0.0).alias("rate"))


def _drawn(docs: DataFrame, targets: dict[str, DataFrame] | None = None, share: float = SHARE, rounds: int = ROUNDS) -> DataFrame:
    """(row, tokens, rate, sampled) for every row of ``docs``."""
    row = lambda c: F.col("row").getField(c)
    part = lambda c: F.coalesce(row(c).cast("string"), F.lit("(null)"))
    tokens = F.coalesce(F.regexp_count(row("text"), F.lit(WORDS)), F.lit(0)).cast("long")
    named = packed(docs).select("row", part("source").alias("c_source"), part("lang").alias("c_lang"), topic(row("text")).alias("c_topic"), tokens.alias("tokens"))
    own = [f"c_{d}" for d in DIMS]
    cells = cut(named.groupBy(*own).agg(F.sum("tokens").alias("n")).toDF(*DIMS, "tokens"), "cells")
    rates = rake(cells, targets, share, rounds).toDF(*own, "rate")
    draw = F.conv(F.substring(F.md5(F.coalesce(row("doc_id").cast("string"), F.lit(""))), 1, 12), 16, 10).cast("double") / F.lit(float(16 ** 12))
    return named.join(rates, own).select("row", "tokens", "rate", (draw < F.col("rate")).alias("sampled"))


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, share: float = SHARE, rounds: int = ROUNDS) -> DataFrame:
    """``docs`` with _tokens, _rate (the sampling probability) and _sampled (boolean), which replace columns of those names."""
    return unpacked(_drawn(docs, targets, share, rounds), docs.columns, _tokens=F.col("tokens"), _rate=F.col("rate"), _sampled=F.col("sampled"))


def keep_sampled(docs: DataFrame) -> DataFrame:
    """The sampled documents with their columns and their sampling probability, mix_rate."""
    return unpacked(_drawn(docs).where("sampled"), docs.columns, mix_rate=F.round("rate", 6))


def sql() -> str:
    """The tempered mixture in DuckDB, its sweeps written out."""
    ws = r"'[^ \t\n\x0B\f\r]+'"
    cases = " ".join(f"WHEN regexp_matches(coalesce(text, ''), '{p}') THEN '{n}'" for n, p in TOPICS)
    parts = [f"""d AS MATERIALIZED (SELECT doc_id, coalesce(source, '(null)') AS source, coalesce(lang, '(null)') AS lang,
  CASE {cases} ELSE 'prose' END AS topic, len(regexp_extract_all(coalesce(text, ''), {ws})) AS tokens FROM documents),
c AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens FROM d GROUP BY ALL),
s0 AS MATERIALIZED (SELECT source, lang, topic, tokens, tokens * {SHARE} AS y FROM c)"""]
    for x in DIMS:
        parts.append(f"t_{x} AS MATERIALIZED (SELECT {x}, target / sum(target) OVER () AS target FROM (SELECT {x}, sqrt(sum(tokens)) AS target FROM c GROUP BY {x}))")
    last = "s0"
    for k in range(ROUNDS):
        for x in DIMS:
            new = f"s{k}_{x}"
            parts.append(f"{new} AS MATERIALIZED (SELECT s.source, s.lang, s.topic, s.tokens, "
                         f"least(s.tokens, s.y * CASE WHEN m.m > 0 THEN t.target * (SELECT {SHARE} * sum(tokens) FROM c) / m.m ELSE 0 END) AS y "
                         f"FROM {last} s JOIN (SELECT {x}, sum(y) AS m FROM {last} GROUP BY {x}) m ON s.{x} = m.{x} JOIN t_{x} t ON s.{x} = t.{x})")
            last = new
    parts.append(f"r AS (SELECT source, lang, topic, CASE WHEN tokens > 0 THEN y / tokens ELSE 0 END AS rate FROM {last})")
    return "WITH " + ",\n".join(parts) + """
SELECT d.doc_id, d.tokens, round(r.rate, 6) AS rate, CAST(('0x' || md5(coalesce(d.doc_id::VARCHAR, ''))[1:12]) AS BIGINT) / 281474976710656.0 < r.rate AS sampled
FROM d JOIN r USING (source, lang, topic)"""
