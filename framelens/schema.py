"""Data model: fixed vocabularies, severity table, response schemas.

Values marked FIXED VALUES must equal the ones the analysed system uses for
results to agree; they are stated plainly, in their natural order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# FIXED VALUES: the 13 broad tactic labels, in catalogue order.
# ---------------------------------------------------------------------------
TACTIC_LABELS: list[str] = [
    "Fear-Mongering / Alarmism",
    "Emotional Manipulation",
    "Nationalism / Pride",
    "Othering / Scapegoating",
    "Anti-Establishment",
    "Moral / Religious Framing",
    "Victim-Blaming",
    "Justification of Violence",
    "Disinformation",
    "Selective Framing / Bias",
    "Ridicule / Delegitimization",
    "False Authority / Unverified Claims",
    "Neutral Reporting",
]

# FIXED VALUES: severity per label (0.0..1.0), unknown labels score 0.0.
# Kept in integer hundredths so sums are exact and order-independent.
SEVERITY_HUNDREDTHS: dict[str, int] = {
    "Disinformation": 100,
    "Justification of Violence": 95,
    "Fear-Mongering / Alarmism": 90,
    "Othering / Scapegoating": 88,
    "Victim-Blaming": 85,
    "Emotional Manipulation": 72,
    "Ridicule / Delegitimization": 68,
    "Selective Framing / Bias": 60,
    "Nationalism / Pride": 55,
    "Moral / Religious Framing": 50,
    "Anti-Establishment": 45,
    "False Authority / Unverified Claims": 40,
    "Neutral Reporting": 5,
    "ERROR": 0,
}

# FIXED VALUES: defaults and markers.
DEFAULT_LABEL = "Neutral Reporting"      # answer without a label key
DEFAULT_TECHNIQUE = "None"               # answer without a technique key
NO_DATE = "No Date"                      # entry without a published date
NO_LINK = "No Link"                      # link marker meaning "no page"
SERVED_NA = "N/A"                        # every null in the served table
UNKNOWN_PERSPECTIVE = "Unknown"          # missing perspective
CONFLICT_MARKERS = "<<<<<<|>>>>>>|======="  # titles dropped by the cleaner

# FIXED VALUES: caps, in characters (code points).
TRANSLATE_CAP = 800
BODY_CAP = 1500
FULL_TEXT_CAP = 2000
INFERENCE_TEXT_CAP = 1500
BATCH_SIZE = 5
MAX_ATTEMPTS = 3
ENTRIES_PER_FEED = 40
DBSCAN_EPS = 0.40
DBSCAN_MIN_SAMPLES = 2
CONTESTED_DELTA_MILLI = 500
HEADLINES_DEFAULT_LIMIT = 100
HEADLINES_MAX_LIMIT = 1000

# FIXED VALUES: the 29 code points Python's str.split()/str.strip() treat as
# white space, as one regex class usable by both Java regex and RE2.
PY_WS_CLASS = ("[\\x09-\\x0D\\x1C-\\x20\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}"
               "\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]")

# FIXED VALUES: the text tokens pandas.read_csv reads as missing by default.
PANDAS_NA_TOKENS: list[str] = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# ---------------------------------------------------------------------------
# Schemas
# ---------------------------------------------------------------------------
RAW_ARTICLE_COLUMNS = ["source", "perspective", "original_language", "raw_title", "title",
                       "full_text", "published_date", "link", "fetch_timestamp"]

RAW_ARTICLE_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True)
                                   for c in RAW_ARTICLE_COLUMNS])

CLASSIFIED_EXTRA = T.StructType([
    T.StructField("tactic_label", T.StringType(), True),
    T.StructField("specific_technique", T.StringType(), True),
    T.StructField("tactic_confidence", T.DoubleType(), True),
    T.StructField("llm_reasoning", T.StringType(), True),
])

HEADLINE_SCHEMA = T.StructType([
    T.StructField("title", T.StringType(), False),
    T.StructField("source", T.StringType(), False),
    T.StructField("perspective", T.StringType(), False),
    T.StructField("tactic_label", T.StringType(), False),
    T.StructField("x", T.DoubleType(), False),
    T.StructField("y", T.DoubleType(), False),
    T.StructField("z", T.DoubleType(), False),
])

NARRATIVE_DELTA_SCHEMA = T.StructType([
    T.StructField("dominant_tactic", T.StringType(), False),
    T.StructField("agreement_score", T.DoubleType(), False),
    T.StructField("delta_score", T.DoubleType(), False),
    T.StructField("severity_score", T.DoubleType(), False),
    T.StructField("unique_tactics", T.ArrayType(T.StringType()), False),
    T.StructField("framing_map", T.MapType(T.StringType(), T.ArrayType(T.StringType())), False),
])

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.StringType(), False),
    T.StructField("is_event_cluster", T.BooleanType(), False),
    T.StructField("headline_count", T.LongType(), False),
    T.StructField("representative_title", T.StringType(), False),
    T.StructField("sources", T.ArrayType(T.StringType()), False),
    T.StructField("perspectives", T.ArrayType(T.StringType()), False),
    T.StructField("headlines", T.ArrayType(HEADLINE_SCHEMA), False),
    T.StructField("narrative_delta", NARRATIVE_DELTA_SCHEMA, False),
    T.StructField("timestamp", T.StringType(), False),
])

META_SCHEMA = T.StructType([
    T.StructField("total_headlines", T.LongType(), False),
    T.StructField("total_sources", T.LongType(), False),
    T.StructField("total_tactics", T.LongType(), False),
    T.StructField("total_event_clusters", T.LongType(), False),
    T.StructField("contested_events", T.LongType(), False),
    T.StructField("avg_severity", T.DoubleType(), False),
    T.StructField("tactic_distribution", T.MapType(T.StringType(), T.LongType()), False),
    T.StructField("source_distribution", T.MapType(T.StringType(), T.LongType()), False),
    T.StructField("run_timestamp", T.StringType(), False),
])


def severity_table(spark: SparkSession) -> DataFrame:
    """(tactic_label, severity_h) — 14 rows; a proven-small broadcast side."""
    rows = [(k, v) for k, v in SEVERITY_HUNDREDTHS.items()]
    return spark.createDataFrame(rows, "tactic_label string, severity_h int")


def assert_schema(df: DataFrame, schema: T.StructType, check_nulls: bool = True) -> DataFrame:
    """Check names and types against a response schema; count rows that break
    a non-null field in ONE aggregate. Raises on any violation."""
    got = {f.name: f.dataType for f in df.schema.fields}
    for f in schema.fields:
        if f.name not in got:
            raise ValueError(f"missing field {f.name}")
        if got[f.name] != f.dataType:
            raise ValueError(f"field {f.name}: {got[f.name].simpleString()} != {f.dataType.simpleString()}")
    required = [f.name for f in schema.fields if not f.nullable]
    if check_nulls and required:
        bad = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required]).first()
        broken = {c: bad[c] for c in required if bad[c]}
        if broken:
            raise ValueError(f"null values in required fields: {broken}")
    return df
