"""Chat formatting from reply trees.

Messages (tree, node, parent, role, text, score) form trees. Pointer doubling by iterative self-joins gives
every node its depth and the sum of the scores above it, in as many rounds as the depth has binary digits; the
same jump tables then enumerate the paths from the chosen leaves to their roots. Branches are ranked per tree
by mean score, ties to the smaller leaf; the ``best`` ones are formatted, each path as one conversation.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn. Control strings inside texts and roles, of this template and
of other common ones, are broken by a backslash after their first character, and backslashes are doubled: the
reverse is exact, and no text can end a turn or open another. The loss mask is a list of character ranges of
the output, one per assistant text (escaped, without the turn marks).

Edge cases. Null texts and roles are empty. A parent that does not exist makes its node a root. Nodes on a
cycle, or below one, have no root and are left out. Rows without tree belong to one tree of their own, named
null. Rows without node id are left out. Repeated (tree, node) rows keep the smallest (parent, role, text, score). Null scores are 0.
An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framelens.llm.common import bounded_batches, cut

START, MIDDLE, END = "<|im_start|>", "\n", "<|im_end|>\n"
#: Control strings of common templates (fixed values), each broken after its first character.
CONTROL = ("<|", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]")
TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.DOTALL)
SPANS = "array<struct<start: long, end: long>>"


def escape(text: str) -> str:
    text = text.replace("\\", "\\\\")
    for c in CONTROL:
        text = text.replace(c, c[0] + "\\" + c[1:])
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.DOTALL)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def jump_tables(messages: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(tree, node, depth, total) of the nodes that have a root, and the ancestors 1, 2, 4, ... steps up."""
    nodes = messages.select("tree", "node", "parent", "score")
    there = nodes.select(F.col("tree").alias("t"), F.col("node").alias("p"))
    now = cut(nodes.join(there, (F.col("tree") == F.col("t")) & (F.col("parent") == F.col("p")), "left")
              .select("tree", "node", F.col("p").alias("up"), F.when(F.col("p").isNotNull(), 1).otherwise(0).cast("long").alias("depth"),
                      F.col("score").alias("total")), "jump-0")
    limit = max(1, now.count()).bit_length() + 1
    closed, ups = now.where("up is null"), []
    now = now.where("up is not null")
    while len(ups) <= limit and now.limit(1).count():
        ups.append(now.select("tree", "node", "up"))
        above = closed.unionByName(now).select(F.col("tree").alias("t"), F.col("node").alias("u"), F.col("up").alias("far"),
                                               F.col("depth").alias("more"), F.col("total").alias("plus"))
        step = cut(now.join(above, (F.col("tree") == F.col("t")) & (F.col("up") == F.col("u")))
                   .select("tree", "node", F.col("far").alias("up"), (F.col("depth") + F.col("more")).alias("depth"),
                           (F.col("total") + F.col("plus")).alias("total")), f"jump-{len(ups)}")
        closed, now = closed.unionByName(step.where("up is null")), step.where("up is not null")
    return closed.drop("up"), ups  # what still has an ancestor after so many steps goes round


def best_paths(messages: DataFrame, best: int = 1) -> DataFrame:
    """(tree, leaf, rank, depth, role, text): the messages of the ``best`` branches of every tree, root at depth 0."""
    kept = cut(messages.where("node is not null").select("tree", "node", F.struct("parent", "role", "text", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")).alias("m"))
               .groupBy("tree", "node").agg(F.min("m").alias("m")).select("tree", "node", "m.*"), "messages")
    rooted, ups = jump_tables(kept)
    parents = kept.select(F.col("tree").alias("t"), F.col("parent").alias("p")).where("p is not null")
    leaves = rooted.join(parents, (F.col("tree") == F.col("t")) & (F.col("node") == F.col("p")), "left_anti")
    rank = F.row_number().over(W.partitionBy("tree").orderBy((F.col("total") / (F.col("depth") + 1)).desc(), "node"))
    on = leaves.withColumn("rank", rank).where(F.col("rank") <= best).select("tree", F.col("node").alias("leaf"), "rank", "node", "depth")
    for k, up in enumerate(ups):
        step = up.select(F.col("tree").alias("t"), F.col("node").alias("n"), "up")
        higher = on.join(step, (F.col("tree") == F.col("t")) & (F.col("node") == F.col("n")))
        on = cut(on.unionByName(higher.select("tree", "leaf", "rank", F.col("up").alias("node"), (F.col("depth") - (1 << k)).alias("depth"))), f"paths-{k}")
    return on.join(kept.select("tree", "node", "role", "text"), ["tree", "node"]).select("tree", "leaf", "rank", "depth", "role", "text")


def format_paths(paths: DataFrame) -> DataFrame:
    """(tree, leaf, formatted, mask): a row per path, written turn by turn from its sorted messages."""
    bounded_batches(paths.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, parts, size, mask = None, [], 0, []
        done = []

        def close() -> None:
            if key is not None:
                done.append((*key, "".join(parts), mask))

        for b in batches:
            for tree, leaf, role, text in zip(b["tree"], b["leaf"], b["role"], b["text"], strict=True):
                if (tree, leaf) != key:
                    close()
                    key, parts, size, mask = (tree, leaf), [], 0, []
                head, body = START + escape_role(role or "") + MIDDLE, escape(text or "")
                if role == "assistant":
                    mask.append({"start": size + len(head), "end": size + len(head) + len(body)})
                parts += [head, body, END]
                size += len(head) + len(body) + len(END)
            yield pd.DataFrame(done, columns=["tree", "leaf", "formatted", "mask"])
            done.clear()
        close()
        yield pd.DataFrame(done, columns=["tree", "leaf", "formatted", "mask"])

    rows = paths.select("tree", "leaf", "depth", "role", "text").repartition("tree", "leaf").sortWithinPartitions("tree", "leaf", "depth")
    return rows.mapInPandas(run, f"tree string, leaf long, formatted string, mask {SPANS}")


def read_back(formatted: DataFrame) -> DataFrame:
    """``formatted`` with ``turns`` (role, text) and ``loss`` (the unescaped text under the mask) parsed from the output."""
    bounded_batches(formatted.sparkSession)
    schema = f"tree string, leaf long, formatted string, mask {SPANS}, turns array<struct<role: string, text: string>>, loss string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            turns = [[{"role": unescape(m[1]), "text": unescape(m[2])} for m in TURN.finditer(s)] for s in b["formatted"]]
            loss = ["".join(unescape(s[x["start"]:x["end"]]) for x in m) for s, m in zip(b["formatted"], b["mask"], strict=True)]
            yield b.assign(turns=turns, loss=loss)

    return formatted.mapInPandas(run, schema)


def as_trees(conversations: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as trees without branches: every row replies to the one before.

    Rows of the same turn follow each other by role and text. Null turns come first.
    """
    order = W.partitionBy("conv_id").orderBy("turn", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    rows = conversations.withColumn("node", F.row_number().over(order).cast("long"))
    return rows.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("null")).alias("tree"), "node", (F.col("node") - 1).alias("parent"),
                       "role", "text", F.lit(0.0).alias("score"))


def digest(conversations: DataFrame) -> DataFrame:
    """What the formatted conversations hold, read back from the output."""
    back = read_back(format_paths(best_paths(as_trees(conversations))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(F.col("tree").try_cast("long").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


def _sql_escaped(c: str) -> str:
    out = f"replace({c}, '\\', '\\\\')"
    for x in CONTROL:
        out = f"replace({out}, '{x}', '{x[0]}\\{x[1:]}')"
    return out


#: The digest in DuckDB; the fixed characters of a turn are the two marks and the line breaks.
SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY k), '')) AS loss_sha256,
  CAST(sum({len(START) + len(MIDDLE) + len(END)} + length(replace({_sql_escaped("role")}, chr(10), '\\n')) + length({_sql_escaped("text")})) AS BIGINT) AS formatted_chars
FROM o GROUP BY conv_id
"""
