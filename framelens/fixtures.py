"""Article-shaped tables derived from the driver tables (see FIXTURES.md).

Every derivation is a deterministic column expression over ``documents`` so
the same rows can be written in the DuckDB oracle. The injected nulls, blanks
and markers exercise the cleaning filters and fallbacks; all rows are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelens.functions.text import cap, first_line
from framelens.schema import NO_LINK, TACTIC_LABELS

# FIXED VALUES: fixture constants (mirrored in plans/oracle.py).
FIXTURE_DATE = "Mon, 01 Dec 2025 08:00:00 GMT"
FIXTURE_UNLISTED = "Unlisted Label"
FIXTURE_LANGS = ["en", "fr", "de", "es"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def source_number(c: Column | str = "source") -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.regexp_extract(col, "[0-9]+", 0).cast("int")


def perspective_of(c: Column | str = "source") -> Column:
    return F.concat(F.lit("P"), (source_number(c) % 7).cast("string"))


def _m(k: int) -> Column:
    return (F.col("doc_id") % k) == 0


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classified-article rows (row_idx = doc_id) with injected damage."""
    d = table(spark, sf_dir, "documents")
    line1 = first_line("text")
    raw_title = F.when(_m(83), F.lit("")).otherwise(line1)
    title = (F.when(_m(89), F.lit(None).cast("string"))
             .when(_m(97), F.concat(raw_title, F.lit(" =======")))
             .otherwise(raw_title))
    full_text = (F.when(_m(29), F.lit(None).cast("string"))
                 .when(_m(31), F.lit(""))
                 .otherwise(F.col("text")))
    link = (F.when(_m(17), F.lit(""))
            .when(_m(19), F.lit(NO_LINK))
            .otherwise(F.concat(F.lit("https://"), F.col("source"), F.lit("/"),
                                F.col("doc_id").cast("string"))))
    idx = ((F.col("doc_id") * 7 + F.col("n_chars")) % 15).cast("int")
    labels = F.array(*[F.lit(x) for x in TACTIC_LABELS + [FIXTURE_UNLISTED]])
    return d.select(
        F.col("doc_id").alias("row_idx"),
        F.col("source"),
        F.when(_m(101), F.lit(None).cast("string")).otherwise(perspective_of()).alias("perspective"),
        F.col("lang").alias("original_language"),
        raw_title.alias("raw_title"),
        title.alias("title"),
        full_text.alias("full_text"),
        F.when(_m(10), F.lit(None).cast("string")).otherwise(F.lit(FIXTURE_DATE)).alias("published_date"),
        link.alias("link"),
        F.when(idx < 14, F.try_element_at(labels, idx + 1)).alias("tactic_label"),
    )


def feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed registry: one row per documents.source (source, url, perspective, lang)."""
    src = table(spark, sf_dir, "documents").select("source").distinct()
    langs = F.array(*[F.lit(x) for x in FIXTURE_LANGS])
    return src.select(
        "source",
        F.concat(F.lit("https://"), F.col("source"), F.lit("/rss.xml")).alias("url"),
        perspective_of().alias("perspective"),
        F.element_at(langs, (source_number() % 4) + 1).alias("lang"),
    )


def feed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed feed entries: (source, pos, title, summary, link, published, body).

    pos = order of the entry within its feed (doc_id order). Titles carry
    white-space padding (every 13th) or are blank (every 83rd); summary is the
    second line; body is the scraped page text stand-in (rest of the text),
    only present when the link is usable.
    """
    d = table(spark, sf_dir, "documents")
    line1 = first_line("text")
    line2 = F.split_part(F.col("text"), F.lit("\n"), F.lit(2))
    rest = F.substring(F.col("text"), F.length(line1) + F.length(line2) + 3, 1 << 30)
    title = (F.when(_m(83), F.lit("  "))
             .when(_m(13), F.concat(F.lit("　 "), line1, F.lit("\t\n")))
             .otherwise(line1))
    link = (F.when(_m(17), F.lit(None).cast("string"))
            .when(_m(19), F.lit(NO_LINK))
            .otherwise(F.concat(F.lit("https://"), F.col("source"), F.lit("/"),
                                F.col("doc_id").cast("string"))))
    return d.select(
        "source",
        F.col("doc_id").alias("pos"),
        title.alias("title"),
        F.when(_m(7), F.lit(None).cast("string")).otherwise(line2).alias("summary"),
        link.alias("link"),
        F.when(_m(10), F.lit(None).cast("string")).otherwise(F.lit(FIXTURE_DATE)).alias("published"),
        rest.alias("body_text"),
    )


FIXTURE_FETCHED = "2025-12-01 08:00:00"
REPEATS = 50


def raw_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw (unclassified) article rows with their doc_id as the write order."""
    a = articles(spark, sf_dir)
    return a.select(F.col("row_idx").alias("doc_id"), "source", "perspective", "original_language",
                    "raw_title", "title", "full_text", "published_date", "link",
                    F.lit(FIXTURE_FETCHED).alias("fetch_timestamp"))


def land_raw_files(spark: SparkSession, sf_dir: str) -> str:
    """Write three landed CSV tables under a fresh folder of the shared
    checkpoint dir and return that folder:

    A: doc_id % 3 = 0, all columns; B: % 3 = 1, no full_text;
    C: % 3 = 2 plus the first 50 A rows again (same title/source, new
    full_text), columns in another order. Each is written in doc_id order.
    """
    from framelens.session import staging_path
    from framelens.sources.landed import write_csv

    root = staging_path(spark, "raw")
    r = raw_articles(spark, sf_dir)
    cols = [c for c in r.columns if c != "doc_id"]
    a = r.where(F.col("doc_id") % 3 == 0)
    b = r.where(F.col("doc_id") % 3 == 1)
    c = r.where(F.col("doc_id") % 3 == 2)
    rep = (a.where(F.col("doc_id") < 3 * REPEATS)
           .withColumn("full_text", F.concat(F.lit("repeat "), F.col("doc_id").cast("string"))))
    c = c.unionByName(rep)
    write_csv(a.orderBy("doc_id").select(*cols), f"{root}/A")
    write_csv(b.orderBy("doc_id").select(*[x for x in cols if x != "full_text"]), f"{root}/B")
    write_csv(c.orderBy("doc_id").select(*reversed(cols)), f"{root}/C")
    return root


OUT_OF_RANGE_ID = 99_999_999
QUOTA_FROM_BATCH = 150


def llm_answers(spark: SparkSession, sf_dir: str, with_quota: bool = False) -> DataFrame:
    """One model answer text per batch of five article rows, with its status.

    Items: {"id": r, "tactic_label": <fixture label or null>,
    "specific_technique": "tech <r%7>", "confidence": 0.<(r*37)%100>,
    "reasoning": "row <r>"}. The answer shape is chosen by batch_index % 11:
    0 fenced with a language tag, 1 fenced without, 2 object not array,
    3 truncated, 4 empty, 5 only ids (missing keys), 6 explicit null labels,
    7 duplicate id (last says Disinformation), 8 extra out-of-range and
    negative ids, 9 confidence as text, 10 plain. Status FAILED for 3 and 4;
    with ``with_quota`` QUOTA_EXHAUSTED from batch 150 on.
    """
    a = articles(spark, sf_dir)
    r = F.col("row_idx")
    b = F.floor(r / 5).cast("long")
    shape = (b % 11).cast("int")
    conf = F.concat(F.lit("0."), F.lpad(((r * 37) % 100).cast("string"), 2, "0"))
    label = F.when(F.col("tactic_label").isNull() | (shape == 6), F.lit("null")) \
        .otherwise(F.concat(F.lit('"'), F.col("tactic_label"), F.lit('"')))
    rid = r.cast("string")
    full = F.concat(F.lit('{"id": '), rid, F.lit(', "tactic_label": '), label,
                    F.lit(', "specific_technique": "tech '), (r % 7).cast("string"),
                    F.lit('", "confidence": '),
                    F.when(shape == 9, F.concat(F.lit('"'), conf, F.lit('"'))).otherwise(conf),
                    F.lit(', "reasoning": "row '), rid, F.lit('"}'))
    item = F.when(shape == 5, F.concat(F.lit('{"id": '), rid, F.lit("}"))).otherwise(full)
    per = a.select(b.alias("batch_index"), r.alias("r"), item.alias("item"))
    g = per.groupBy("batch_index").agg(
        F.array_sort(F.collect_list(F.struct("r", "item"))).alias("xs"))
    body = F.array_join(F.transform("xs", lambda x: x["item"]), ", ")
    first_id = F.col("xs")[0]["r"].cast("string")
    shp = (F.col("batch_index") % 11).cast("int")
    extra = (F.when(shp == 7, F.concat(F.lit(', {"id": '), first_id,
                                       F.lit(', "tactic_label": "Disinformation", "specific_technique": "dup", '
                                             '"confidence": 0.99, "reasoning": "second answer"}')))
             .when(shp == 8, F.lit(', {"id": ' + str(OUT_OF_RANGE_ID) + ', "tactic_label": "Disinformation"}, '
                                   '{"id": -1, "tactic_label": "Disinformation"}'))
             .otherwise(F.lit("")))
    arr = F.concat(F.lit("["), body, extra, F.lit("]"))
    answer = (F.when(shp == 0, F.concat(F.lit("```json\n"), arr, F.lit("\n```")))
              .when(shp == 1, F.concat(F.lit("```\n"), arr, F.lit("\n```")))
              .when(shp == 2, F.element_at(F.transform("xs", lambda x: x["item"]), 1))
              .when(shp == 3, F.substring(arr, 1, F.floor(F.length(arr) / 2).cast("int")))
              .when(shp == 4, F.lit(""))
              .otherwise(arr))
    status = F.when(shp.isin(3, 4), F.lit("FAILED")).otherwise(F.lit("SUCCESS"))
    if with_quota:
        status = F.when(F.col("batch_index") >= QUOTA_FROM_BATCH, F.lit("QUOTA_EXHAUSTED")).otherwise(status)
    return g.select("batch_index", status.alias("status"),
                    F.when(status == "SUCCESS", answer).alias("answer"))


def flaky_model(payload: str, attempt: int = 0) -> str:
    """The lexicon model with the faults of a remote one, by batch number: an unreadable first answer (number % 7
    is 3), no answer at all (% 11 is 5), a spent quota (from 150 on)."""
    import json

    from framelens.operators.inference import QuotaExhausted, lexicon_model
    from framelens.schema import BATCH_SIZE

    batch = json.loads(payload)[0]["id"] // BATCH_SIZE
    if batch >= QUOTA_FROM_BATCH:
        raise QuotaExhausted("tokens per day")
    if batch % 11 == 5:
        raise TimeoutError("no answer")
    return "not JSON" if batch % 7 == 3 and attempt == 0 else lexicon_model(payload)
