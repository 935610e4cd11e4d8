"""Micro-tactic phrase stand-in (M6): the best TF-IDF 2-4-gram per article.

n-grams are runs of consecutive tokens of the whole text; of those with the best score an article's smallest gram text wins.

As in ``tfidf``, texts are dealt into parts by id, and a part is one bounded group: there grams are numbered exactly, from
the numbers of their tokens, and counted in numpy. For the df a part sends the 96-bit keys of its distinct grams, packed by
ranges of the key, one row a range; a range adds them up and sends back only those that two or more articles have, which
are few: a gram without an answer has df 1.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelens.functions.text import tokens
from framelens.operators.tfidf import binary_lists, of_binary

#: Articles of one part, and grams of one range of keys, about.
PART_DOCS = 1000
RANGE_DOCS = 1500
_ODD = np.uint64(0x9E3779B97F4A7C15)


def ngrams(tok, n: int):
    idx = F.sequence(F.lit(1), F.size(tok) - n + 1)
    grams = F.transform(idx, lambda i: F.array_join(F.slice(tok, i, n), " "))
    return F.when(F.size(tok) >= n, grams).otherwise(F.array().cast("array<string>"))


def _mix(x: np.ndarray) -> np.ndarray:
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(31))


class _Grams:
    """The distinct grams of a part's rows (id, tok): ``ids``, the texts ``names`` in order, the token numbers ``parts`` of
    every gram (-1 behind its end), and by article (``doc``, in order) its grams ``gram`` with their ``tf``."""

    def __init__(self, docs: pa.Table, n_min: int, n_max: int):
        ids = docs["id"].combine_chunks().dictionary_encode(null_encoding="encode")
        self.ids, row_doc = ids.dictionary, ids.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        lists = docs["tok"].combine_chunks()
        lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        words = lists.flatten().dictionary_encode()
        names = np.array(words.dictionary.to_pylist(), dtype=object)
        order = np.argsort(names, kind="stable")
        self.names, rank = names[order], np.empty(len(names), np.int64)
        rank[order] = np.arange(len(names))
        token = rank[words.indices.to_numpy(zero_copy_only=False)] if len(names) else np.zeros(0, np.int64)
        row = np.repeat(np.arange(len(lengths)), lengths)
        u, code, parts = max(len(names), 1), token, np.arange(len(names))[:, None]
        doc, gram, found, total = [], [], [], 0
        for n in range(2, n_max + 1):
            # the gram of n tokens at a place: that of n - 1 and the next token, in one row
            m = max(len(token) - n + 1, 0)
            here = np.flatnonzero(row[:m] == row[n - 1:n - 1 + m])
            number, known = pd.factorize(code[here] * u + token[here + n - 1])
            parts = np.hstack([parts[known // u], (known % u)[:, None]])
            code = np.zeros(len(token), np.int64)
            code[here] = number
            if n >= n_min:
                doc.append(row_doc[row[here]])
                gram.append(number + total)
                found.append(np.pad(parts, ((0, 0), (0, n_max - n)), constant_values=-1))
                total += len(known)
        self.parts = np.vstack(found)
        both = np.sort(np.concatenate(doc) * max(total, 1) + np.concatenate(gram))
        first = np.flatnonzero(np.diff(both, prepend=-1))
        self.doc, self.gram = np.divmod(both[first], max(total, 1))
        self.tf = np.diff(first, append=len(both))

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """64 and 32 bits of a hash of every gram."""
        out = []
        for secret in ("framelens-key-01", "framelens-key-02"):
            h = np.append(pd.util.hash_array(self.names, hash_key=secret), np.uint64(0)) if len(self.names) else np.zeros(1, np.uint64)
            x = np.zeros(len(self.parts), np.uint64)
            for c in self.parts.T:
                x = _mix(x * _ODD + h[c] + np.uint64(1))
            out.append(x)
        return out[0], out[1].astype(np.uint32)


def key_phrases(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                n_min: int = 2, n_max: int = 4, n_docs: int | None = None) -> DataFrame:
    """(id, phrase, tf, df) — one row per document that has a 2-gram."""
    n = docs.count() if n_docs is None else n_docs
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = max(2 * parts, -(-n // PART_DOCS))
    ranges = max(2 * parts, -(-n // RANGE_DOCS))
    part = F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("_part")
    dealt = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).select("id", "text", part).repartition(parts, "_part")
    split = dealt.select("_part", "id", tokens("text").alias("tok")).groupBy("_part")

    def send(key: tuple, docs: pa.Table) -> pa.Table:
        g = _Grams(docs, n_min, n_max)
        k, more = g.keys()
        count = np.bincount(g.gram, minlength=len(k)).astype(np.int32)
        at = (k >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
        order = np.argsort(at, kind="stable")
        ends = np.searchsorted(at[order], np.arange(ranges + 1))
        return pa.table({"_range": np.arange(ranges, dtype=np.int32), "_part": np.full(ranges, key[0].as_py(), np.int32),
                         **{c: binary_lists(x[order], ends) for c, x in (("k", k), ("more", more), ("n", count))}}).filter(pa.array(np.diff(ends) > 0))

    def add(table: pa.Table) -> pa.Table:
        (k, ends), (more, _), (count, _) = (of_binary(table[c], x) for c, x in (("k", np.uint64), ("more", np.uint32), ("n", np.int32)))
        to = np.repeat(table["_part"].to_numpy(), np.diff(ends))
        order = np.argsort(k, kind="stable")
        same = k[order][1:] == k[order][:-1]
        if (same & (more[order][1:] != more[order][:-1])).any():
            order = np.lexsort((more, k))
        k, more, count, to = k[order], more[order], count[order], to[order]
        first = np.flatnonzero(np.concatenate([np.ones(min(len(k), 1), bool), (k[1:] != k[:-1]) | (more[1:] != more[:-1])]))
        df = np.repeat(np.add.reduceat(count, first), np.diff(first, append=len(k))) if len(first) else count
        some = np.flatnonzero(df > 1)
        some = some[np.argsort(to[some], kind="stable")]
        told, ends = np.unique(to[some], return_index=True)
        ends = np.append(ends, len(some))
        return pa.table({"_part": told.astype(np.int32), **{c: binary_lists(x[some], ends) for c, x in (("k", k), ("more", more), ("df", df.astype(np.int32)))}})

    keys = split.applyInArrow(send, "_range int, _part int, k binary, more binary, n binary")
    dfs = keys.repartition(parts, "_range").groupBy("_range").applyInArrow(add, "_part int, k binary, more binary, df binary").repartition(parts, "_part")

    def judge(docs: pa.Table, dfs: pa.Table) -> pa.Table:
        g = _Grams(docs, n_min, n_max)
        k, more = g.keys()
        told, told_more, found = (of_binary(dfs[c], x)[0] for c, x in (("k", np.uint64), ("more", np.uint32), ("df", np.int32)))
        df = np.ones(len(k), np.int64)
        if len(told):
            order = np.lexsort((told_more, told))
            told, told_more, found = told[order], told_more[order], found[order]
            at = np.searchsorted(told, k)
            # keys that differ in their last bits only stand beside each other
            for _ in range(1 + int((told[1:] == told[:-1]).sum())):
                place = np.minimum(at, len(told) - 1)
                hit = (told[place] == k) & (told_more[place] == more)
                df[hit] = found[place[hit]]
                at = at + 1
        score = g.tf * np.log(float(n + 1) / (df[g.gram] + 1.0))
        doc, gram, tf = g.doc, g.gram, g.tf
        left = np.arange(len(doc))
        # the best score of an article, and of its grams with it the smallest text: token by token, a shorter gram first
        for worth in (-score, *(g.parts[:, c][g.gram] for c in range(n_max))):
            if not len(doc):
                break
            worth = worth[left]
            start = np.flatnonzero(np.diff(doc, prepend=-1))
            best = np.repeat(np.minimum.reduceat(worth, start), np.diff(start, append=len(doc)))
            some = np.flatnonzero(worth == best)
            left, doc, gram, tf = left[some], doc[some], gram[some], tf[some]
        phrase = [" ".join(g.names[p[p >= 0]]) for p in g.parts[gram]]
        return pa.table({"id": g.ids.take(pa.array(doc)), "phrase": pa.array(phrase, pa.string()), "tf": tf.astype(np.int64), "df": df[gram]})

    ids = docs.select(F.col(id_col).alias("id")).schema[0].dataType.simpleString()
    return split.cogroup(dfs.groupBy("_part")).applyInArrow(judge, f"id {ids}, phrase string, tf bigint, df bigint")
