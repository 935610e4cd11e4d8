"""Batched translation with a stored memo.

``translate_texts`` cuts texts into pieces of at most ``TRANSLATE_CAP``
characters (what one request takes), looks the distinct pieces up in the memo
table by language and a 128-bit hash, sends only those that no run has had
translated, ``batch`` of one language at a time, from ``mapInPandas`` tasks,
stores the answers as a new version of the memo, and puts the texts together
again in order. So a piece is sent once, however many rows and days hold it
(a task that is lost and run again sends its own once more).

A call has ``attempts`` tries. A batch that fails in all of them, or answers
with another number of pieces or with nulls, is sent piece by piece, once; a
piece that fails there too keeps its own text, counts in ``n_failed`` and is
not stored, so that the next run tries it again.

Defined results: English, null and empty texts pass through; a null language
is sent as ''; rows keep their repeats (rows of one id must be of one text);
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelens.schema import MAX_ATTEMPTS, TRANSLATE_CAP
from framelens.session import checkpoint_dir, ship_package
from framelens.sources.snapshots import Snapshots

MEMO = "lang string, k1 long, k2 long, answer string"
KEY = ["lang", "k1", "k2"]
Translator = Callable[[list[str], str], list[str]]


def _asked(translator: Translator, pieces: list[str], lang: str, attempts: int) -> list[str] | None:
    for _ in range(attempts):
        try:
            got = list(translator(pieces, lang))
        except ImportError:
            raise
        except Exception:  # noqa: BLE001 - a failed call is tried again, then falls back
            continue
        if len(got) == len(pieces) and all(isinstance(x, str) for x in got):
            return got
    return None


def translated_pieces(pieces: DataFrame, translator: Translator, batch: int, attempts: int) -> DataFrame:
    """(lang, k1, k2, answer) of distinct (lang, k1, k2, piece); a failed piece has a null answer."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for lang, some in pdf.groupby("lang"):
                for at in range(0, len(some), batch):
                    part = some.iloc[at:at + batch]
                    texts = part["piece"].tolist()
                    answers = _asked(translator, texts, lang, attempts)
                    if answers is None:
                        answers = [(_asked(translator, [t], lang, 1) or [None])[0] for t in texts] if len(texts) > 1 else [None]
                    yield part[KEY].assign(answer=pd.Series(answers, index=part.index, dtype=object))
    return pieces.repartition(*KEY).mapInPandas(run, MEMO)


def translate_texts(texts: DataFrame, translator: Translator, memo: Snapshots, id_col: str = "id", text_col: str = "text",
                    lang_col: str = "lang", batch: int = 32, attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """(id_col, text_col translated, n_failed) for every row of ``texts``."""
    spark = texts.sparkSession
    checkpoint_dir(spark)
    ship_package(spark)
    rows = texts.select(F.col(id_col).alias("id"), F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.col(text_col).alias("text"))
    foreign = (F.col("lang") != "en") & (F.col("text") != "")
    cut = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{TRANSLATE_CAP}}}"), 0)
    keys = [F.xxhash64("piece", F.lit(s)).alias(f"k{s}") for s in (1, 2)]
    # pieces by text, not by row: repeated rows would double them
    whole = F.sha2("text", 256).alias("own")
    pieces = (rows.where(foreign).select("lang", "text", whole).dropDuplicates(["lang", "own"])
              .select("lang", "own", F.posexplode(cut).alias("pos", "piece")).select("*", *keys).checkpoint())
    version = memo.latest()
    known = memo.read("memo", version) if version else spark.createDataFrame([], MEMO)
    fresh = pieces.groupBy(KEY).agg(F.min("piece").alias("piece")).join(known, KEY, "left_anti")
    # stored before use: each piece is sent by one pass
    answers = translated_pieces(fresh, translator, batch, attempts).checkpoint()
    memo.publish(append={"memo": answers.where("answer is not null")})
    put = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("answer", "piece").alias("t")))), lambda x: x["t"]), "")
    done = (pieces.join(memo.read("memo"), KEY, "left").groupBy("lang", "own")
            .agg(put.alias("new"), F.count_if(F.col("answer").isNull()).alias("n_failed")))
    # rows that pass through have no key and stay out of the join, where they would all meet in one task
    sent = F.coalesce(foreign, F.lit(False))
    out = rows.where(sent).withColumn("own", whole).join(done, ["lang", "own"], "left").select("id", "text", "new", "n_failed")
    out = out.unionByName(rows.where(~sent).select("id", "text"), allowMissingColumns=True)
    return out.select(F.col("id").alias(id_col), F.coalesce("new", "text").alias(text_col), F.coalesce("n_failed", F.lit(0)).cast("long").alias("n_failed"))
