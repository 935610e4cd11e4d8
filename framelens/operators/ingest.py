"""Ingest: keep-first dedupe, cleaning, per-feed top-N, feed enrichment,
article assembly, renumbering and the served table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelens.functions.text import cap, collapse_ws, join_nonempty, py_strip
from framelens.operators.indexing import dense_index
from framelens.schema import CONFLICT_MARKERS, ENTRIES_PER_FEED, NO_DATE, NO_LINK, SERVED_NA, TRANSLATE_CAP

BROADCAST_MAX_ROWS = 100_000
BROADCAST_MAX_BYTES = 32 << 20


def checked_broadcast(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Broadcast ``df`` only if it has at most ``max_rows`` rows of together at most
    ``max_bytes`` as JSON text (one job over at most ``max_rows`` + 1 rows);
    otherwise return it as is for a shuffle join."""
    size = F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))
    rows, size = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.coalesce(size, F.lit(0))).first()
    return F.broadcast(df) if rows <= max_rows and size <= max_bytes else df


def dedupe_first(df: DataFrame, keys: list[str], order: str = "_order") -> DataFrame:
    """``drop_duplicates(subset=keys)``: keep the first row per key (null equals
    null) in ``order``, a unique integer. A hash aggregate of the least order
    per key (a hot key's copies collapse map-side), then a semi-join on it:
    whole rows are neither sorted nor aggregated. ``df`` is read twice, the
    first time only its keys and order: hand in a stored table."""
    firsts = df.groupBy(*keys).agg(F.min(order).alias("_first")).select("_first")
    return df.join(firsts, df[order] == firsts["_first"], "left_semi")


def drop_conflicted(df: DataFrame, col: str = "title") -> DataFrame:
    """Drop rows whose title holds a merge-conflict marker; null titles stay."""
    return df.where(~F.coalesce(F.col(col).rlike(CONFLICT_MARKERS), F.lit(False)))


def full_text_fallback(df: DataFrame) -> DataFrame:
    """full_text: absent -> title; null -> title; '' -> title (blank kept)."""
    if "full_text" not in df.columns:
        return df.withColumn("full_text", F.col("title"))
    return df.withColumn("full_text", F.coalesce(F.nullif(F.col("full_text"), F.lit("")), F.col("title")))


def clean_articles(df: DataFrame, order: str = "_order") -> DataFrame:
    """Union output -> dedupe on (title, source) -> conflict filter -> full_text
    fallback -> dense row_idx in original order."""
    d = dedupe_first(df, ["title", "source"], order)
    d = full_text_fallback(drop_conflicted(d))
    return dense_index(d, order, "row_idx")


def feed_topk(entries: DataFrame, n: int = ENTRIES_PER_FEED) -> DataFrame:
    """First ``n`` entries of each feed by ``pos``; then entries whose stripped
    title is blank are skipped (after the cut, as the reference does).
    ``row_number() <= n`` is planned as a partial WindowGroupLimit before the
    shuffle, so a huge feed sends at most n rows per map task."""
    w = Window.partitionBy("source").orderBy("pos")
    return titled(entries.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn"))


def titled(entries: DataFrame) -> DataFrame:
    """All entries whose stripped title is not blank."""
    return entries.where(F.coalesce(py_strip("title"), F.lit("")) != "")


def feed_enrich(df: DataFrame, feeds: DataFrame) -> DataFrame:
    """Attach perspective and language from the feed registry (equi-join on
    source). The registry is broadcast after a bounded size check."""
    reg = feeds.select("source", "perspective", F.col("lang").alias("original_language"))
    return df.join(checked_broadcast(reg), "source", "inner")


def translate_route(text: Column, lang: Column, translator=None) -> Column:
    """English and empty text pass through; other text is sent to ``translator``
    (a Column -> Column function; default identity) in pieces of at most 800
    characters, the most that one request takes, and the answers are joined."""
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{TRANSLATE_CAP}}}"), 0)
    translated = F.array_join(F.transform(pieces, translator), "") if translator else text
    return F.when((lang == "en") | text.isNull() | (text == ""), text).otherwise(translated)


def usable_link(link: Column) -> Column:
    return link.isNotNull() & (link != "") & (link != NO_LINK)


def article_build(entries: DataFrame, translator=None, body_chars: int | None = None,
                  text_chars: int | None = None) -> DataFrame:
    """Feed entry (+ scraped body text) -> raw article row.

    entries: source, perspective, original_language, pos, title, summary,
    link, published, body_text. The body is used only for a usable link,
    whitespace-collapsed; full_text = non-empty parts of (title, summary,
    body) joined by one space. Both are whole unless ``body_chars`` or
    ``text_chars`` cut them.
    """
    def most(c: Column, n: int | None) -> Column:
        return c if n is None else cap(c, n)

    lang = F.col("original_language")
    raw_title = py_strip(F.coalesce(F.col("title"), F.lit("")))
    raw_summary = py_strip(F.coalesce(F.col("summary"), F.lit("")))
    body = F.when(usable_link(F.col("link")), most(collapse_ws(F.coalesce(F.col("body_text"), F.lit(""))), body_chars)) \
        .otherwise(F.lit(""))
    t = entries.select(
        "source", "perspective", "original_language", "pos",
        raw_title.alias("raw_title"),
        translate_route(raw_title, lang, translator).alias("title"),
        translate_route(raw_summary, lang, translator).alias("_summary"),
        translate_route(body, lang, translator).alias("_body"),
        F.coalesce(F.col("published"), F.lit(NO_DATE)).alias("published_date"),
        F.coalesce(F.col("link"), F.lit("")).alias("link"),
    )
    return t.select(
        "source", "perspective", "original_language", "pos", "raw_title", "title",
        most(join_nonempty(F.col("title"), F.col("_summary"), F.col("_body")), text_chars).alias("full_text"),
        "published_date", "link")


def load_classified(df: DataFrame, order: str = "row_idx") -> DataFrame:
    """Drop rows without title or label, renumber densely in file order."""
    kept = df.na.drop(subset=["title", "tactic_label"])
    if order == "row_idx":
        kept = kept.withColumnRenamed("row_idx", "_src_idx")
        order = "_src_idx"
    return dense_index(kept, order, "row_idx")


def served_table(df: DataFrame) -> DataFrame:
    """The API's view: every column as text, every null or NaN as 'N/A'.
    (``na.fill`` alone touches string columns only, so cast first.)"""
    def text(name: str, kind: str) -> Column:
        c = F.nanvl(F.col(name), F.lit(None).cast(kind)) if kind in ("double", "float") else F.col(name)
        return F.coalesce(c.cast("string"), F.lit(SERVED_NA)).alias(name)
    return df.select(*[text(n, k) for n, k in df.dtypes])


def headlines_page(df: DataFrame, limit: int = 100, order: str = "row_idx") -> DataFrame:
    """``head(limit)`` of the served table in file order; 1 <= limit <= 1000."""
    if not isinstance(limit, int) or not 1 <= limit <= 1000:
        raise ValueError("limit must be an integer in 1..1000")
    return served_table(df.orderBy(order).limit(limit))
