"""Line dedup by a log-template tree of fixed depth, in DataFrame operations only.

Every line falls through a tree: first by its number of tokens, then by its leading ``depth`` tokens. Tokens
with digits are variable fields (``<*>``) from the start. In a leaf, the tokens behind the leading ones are cut
into five runs by position, and a line belongs to itself, to the five templates with one run generalised to ``<*>``,
and, with ``TWO_FIELDS`` or more tokens, to the ten with two open runs. So the variable fields of two lines that share a
template lie within two runs, and at least three fifths of their positions agree. A template is recurring if
``min_docs`` documents have it. Short lines (fewer than ``min_tokens`` tokens) and long ones (``LONG`` or more) also
have their literal text as template, where digits stand for themselves; a long line recurs from ``LONG_DOCS``
documents on. Of a recurring template's lines all but the first (smallest doc_id, then position) are dropped; the first
keeps the content in the corpus.

Only hashes are shuffled for this: node counts first, then the templates of lines in nodes with enough lines,
then one join of documents and positions to drop. Hot templates are counted by partial aggregation and joined
through a broadcast of the provably few keys with more than a thousandth of the rows.

Edge cases. Null and empty texts have one blank line, which is kept (null stays null). Lines of fewer than
five tokens have only themselves as template, so they recur word for word (fields with digits aside). A document's own repeats
count once towards ``min_docs`` but are dropped with the rest. Repeated rows (same doc_id and text) count as
one document and get the same result; a null doc_id counts as an id that comes first. A text whose lines all
go becomes empty, its row stays. Extra columns are carried. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelens.llm.common import attach, cut, packed, unpacked

RUNS = 5
#: an exact passage of so many tokens is no chance: it recurs if so many documents have it
LONG, LONG_DOCS = 20, 2
#: from so many tokens on two runs may be open at once: at least six tokens, the leading ones among them, still agree
TWO_FIELDS = 10
BLANK = r"[ \t\x0B\f\r]+"
#: from a token's first character on, possessively: linear also in lines that are one long token
FIELD = r"(?<![^ \t\x0B\f\r])[^ \t\x0B\f\r0-9]*+[0-9][^ \t\x0B\f\r]*"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def parsed_lines(docs: DataFrame, depth: int, min_tokens: int) -> DataFrame:
    """(doc_id, h, pos, node, runs, n_tokens, exact): the tree node of every line, the hashes of its five runs and of all of it.
    Lines of fewer than ``min_tokens`` tokens have no node."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("h"), F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    tokens = lines.select("doc_id", "h", "pos", F.array_remove(F.split(F.regexp_replace("line", FIELD, "<*>"), BLANK), "").alias("t"),
                          F.xxhash64(F.btrim("line", F.lit(" \t\x0b\f\r")), F.lit("exact")).alias("exact"))
    n = F.size("t")
    edge = lambda k: F.floor(n * k / RUNS).cast("int")
    run = lambda k: F.xxhash64(F.concat_ws(" ", F.slice("t", edge(k) + 1, edge(k + 1) - edge(k))))
    lead = F.concat_ws(" ", F.slice("t", 1, depth))
    return tokens.where(n >= 1).select("doc_id", "h", "pos", F.when(n >= min_tokens, F.xxhash64(n, lead)).alias("node"), (n >= RUNS).alias("long"),
                                       *[run(k).alias(f"r{k}") for k in range(RUNS)], n.alias("n_tokens"), "exact")


def _templates() -> Column:
    runs = [F.col(f"r{k}") for k in range(RUNS)]
    own = F.xxhash64("node", *runs)
    open_ = [F.xxhash64("node", F.lit(k), *runs[:k], *runs[k + 1:]) for k in range(RUNS)]
    two = [F.xxhash64("node", F.lit(j), F.lit(k), *[r for i, r in enumerate(runs) if i not in (j, k)]) for j, k in combinations(range(RUNS), 2)]
    return (F.when(F.col("n_tokens") >= TWO_FIELDS, F.array(own, *open_, *two))
            .when(F.col("long"), F.array(own, *open_)).otherwise(F.array(own)))


def recurring_lines(docs: DataFrame, min_docs: int = 8, depth: int = 3, min_tokens: int = 3) -> DataFrame:
    """(doc_id, h, drop): the positions to drop of each document that has any; h is the hash of its text."""
    lines = cut(parsed_lines(docs, depth, min_tokens), "lines")
    nodes = cut(lines.where("node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).withColumn("busy", F.lit(True)), "nodes")
    total = lines.count()
    busy = attach(lines, nodes, "node", "n", total).where("busy")
    general = busy.select("doc_id", "h", "pos", F.explode(_templates()).alias("key"), F.lit(min_docs).alias("least"))
    least = F.when(F.col("n_tokens") >= LONG, LONG_DOCS).otherwise(min_docs)
    literal = (lines.where((F.col("n_tokens") < min_tokens) | (F.col("n_tokens") >= LONG))
               .select("doc_id", "h", "pos", F.col("exact").alias("key"), least.alias("least")))
    keys = cut(general.unionByName(literal), "templates")
    per_doc = keys.groupBy("key", "doc_id", "h").agg(F.min("pos").alias("pos"), F.count(F.lit(1)).alias("n"), F.min("least").alias("least"))
    found = cut(per_doc.groupBy("key").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("n"), F.min("least").alias("least"),
                                           F.min(F.struct("doc_id", "h", "pos")).alias("first"))
                .where(F.col("docs") >= F.col("least")).drop("docs", "least"), "recurring")
    again = attach(keys, found, "key", "n", total).where("first is not null").where(
        ~F.struct("doc_id", "h", "pos").eqNullSafe(F.col("first")))
    return again.groupBy("doc_id", "h").agg(F.collect_set("pos").alias("drop"))


def _thinned(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **limits) -> DataFrame:
    """(row, left, n_lines, n_dropped) for every row of ``docs``: its text without recurring lines."""
    row = lambda c: F.col("row").getField(c)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    drops = recurring_lines(own, **limits).select(F.col("doc_id").alias("of"), "h", "drop")
    joined = packed(docs).join(drops, row(id_col).cast("long").eqNullSafe(F.col("of")) & (F.xxhash64(row(text_col)) == F.col("h")), "left")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drop")), lambda i: F.get("lines", i))
    left = F.when(F.col("drop").isNull(), row(text_col)).otherwise(F.array_join(kept, "\n"))
    return joined.withColumn("lines", _lines(row(text_col))).select(
        "row", left.alias("left"), F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"))


def drop_recurring(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **limits) -> DataFrame:
    """``docs`` with recurring lines taken out of ``text_col``, and the columns _lines and _dropped (counts), which
    replace columns of those names."""
    return unpacked(_thinned(docs, text_col, id_col, **limits), docs.columns,
                    **{text_col: F.col("left"), "_lines": F.col("n_lines"), "_dropped": F.col("n_dropped")})


def keep_new_lines(docs: DataFrame, **limits) -> DataFrame:
    """``docs`` without recurring lines, n_chars counted anew; all rows and columns stay."""
    values = {"text": F.col("left")}
    if "n_chars" in docs.columns:
        values["n_chars"] = F.coalesce(F.length("left").cast(docs.schema["n_chars"].dataType), F.col("row").getField("n_chars"))
    return unpacked(_thinned(docs, **limits), docs.columns, **values)


#: The same in DuckDB, on strings instead of hashes.
SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos FROM documents),
tok AS (
  SELECT doc_id, pos, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line, regexp_extract_all(regexp_replace(line, '(^|[ \t\x0B\f\r])[^ \t\x0B\f\r0-9]*[0-9][^ \t\x0B\f\r]*', '\1<*>', 'g'), '[^ \t\x0B\f\r]+') AS t FROM lines),
node AS (SELECT doc_id, pos, t, len(t) AS n, len(t) || '|' || array_to_string(t[1:3], ' ') AS node FROM tok WHERE len(t) >= 3),
ks AS (
  SELECT doc_id, pos, 'exact|' || line AS k, CASE WHEN len(t) >= 20 THEN 2 ELSE 8 END AS least FROM tok WHERE len(t) IN (1, 2) OR len(t) >= 20
  UNION ALL
  SELECT doc_id, pos, node || '|own|' || array_to_string(t, ' '), 8 FROM node
  UNION ALL
  SELECT doc_id, pos, node || '|' || g || '|' || array_to_string(t[1:(n * g) // 5], ' ') || ' <*> ' || array_to_string(t[(n * (g + 1)) // 5 + 1:], ' '), 8
  FROM node, range(5) AS r(g) WHERE n >= 5
  UNION ALL
  SELECT doc_id, pos, node || '|' || g || '|' || h || '|' || array_to_string(t[1:(n * g) // 5], ' ') || ' <*> '
    || array_to_string(t[(n * (g + 1)) // 5 + 1:(n * h) // 5], ' ') || ' <*> ' || array_to_string(t[(n * (h + 1)) // 5 + 1:], ' '), 8
  FROM node, range(5) AS r(g), range(5) AS s(h) WHERE n >= 10 AND g < h),
rec AS (SELECT k, min(row(doc_id, pos)) AS first FROM ks GROUP BY k HAVING count(DISTINCT doc_id) >= min(least)),
gone AS (SELECT DISTINCT doc_id, pos FROM ks JOIN rec USING (k) WHERE row(doc_id, pos) <> first)
SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_dropped,
  coalesce(string_agg(CASE WHEN g.pos IS NULL THEN line END, chr(10) ORDER BY l.pos), '') AS text
FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id
"""
