"""Language of a text by cross-parsing against suffix automata (Ziv and Merhav 1993).

A suffix automaton of a language's labelled text has a path from its root for every substring of it. A text is
read along the paths of all languages at once: each phrase is the longest run that still occurs in the language's
text, and where it ends the next one starts. Few phrases mean that the text is made of that language's pieces.
Phrases are normalised to the cross-parsing entropy, phrases * log2(length of the labelled text) / symbols, and the
least one wins (ties: the lesser language name).

Symbols are lower-case letters; all else between two letters is one space. Parsing starts anew every SEGMENT symbols,
so texts of any length are read whole and many at once, by numpy in Arrow batches. The automata are fitted on the
driver on a bounded sample: pieces of PIECE characters, drawn by hash from every part of all labelled texts,
``max_chars`` characters together in equal shares of at most ``max_languages`` languages (those with most text), over
the ``max_symbols`` most frequent symbols of the sample. Every other count covers all rows.

Edge cases. Null, empty and letterless texts give ``und`` with score 0, and so do all texts if nothing was learned.
A letter that no sample has is a phrase of its own in every language. One language only: score 1. Repeated rows keep
their rows; a null id is predicted, never learned from. An empty table gives an empty result. A text must fit in
a worker's memory. Extra columns are ignored.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framelens.llm.common import bounded_batches, cut

SEGMENT, PIECE = 1024, 512
#: Characters that are parsed together, which bounds a worker's arrays (a longer text is parsed alone).
TOGETHER = 2_000_000
SPACE = 1


@cache
def _letters() -> np.ndarray:
    """Whether a code point is a letter (general category L)."""
    return np.fromiter((unicodedata.category(chr(k))[0] == "L" for k in range(0x110000)), bool, 0x110000)


def _spaced(points: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points with every run of other characters made one space (0), none at a text's beginning; the texts' starts after that.

    ``first`` are the texts' starts. Every text ends in a line feed, so one with letters ends in a space, and one
    without is empty.
    """
    out = np.where(_letters()[points], points, 0)
    keep = out != 0
    keep[1:] |= out[:-1] != 0
    keep[first] = out[first] != 0
    at = np.concatenate(([0], np.cumsum(keep)))
    return out[keep], at[first]


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, each followed by a line feed, and their starts."""
    low = [t.lower() + "\n" for t in texts]
    first = np.cumsum([0] + [len(t) for t in low])[:-1]
    return np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64), first


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of each state; state 0 is the root (Blumer et al. 1985, built online)."""
    go: list[dict[int, int]] = [{}]
    link, longest = [-1], [0]
    last = 0
    for c in symbols:
        new = len(go)
        go.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if longest[q] == longest[p] + 1:
                link[new] = q
            else:
                twin = len(go)
                go.append(go[q].copy())
                longest.append(longest[p] + 1)
                link.append(link[q])
                link[q] = link[new] = twin
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = twin
                    p = link[p]
        last = new
    return go


def _together(texts: list[str]) -> Iterator[list[str]]:
    """The texts in turn, in lists of about TOGETHER characters."""
    some: list[str] = []
    size = 0
    for t in texts:
        if some and size + len(t) > TOGETHER:
            yield some
            some, size = [], 0
        some.append(t)
        size += len(t)
    if some:
        yield some


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    #: Symbols of each language's sample, and the code points that have a symbol (2, 3, ... in this order).
    lengths: list[int]
    alphabet: list[int]
    #: Transitions of all automata: state, symbol, next state; the states at which the automata start.
    edges: np.ndarray
    roots: list[int]


class Parser:
    """The automata as one table, walked by all segments of many texts at once."""

    def __init__(self, model: LanguageModel):
        self.model, self.width = model, len(model.alphabet) + 2
        states = int(model.edges[:, [0, 2]].max(initial=max(model.roots, default=0))) + 1
        table = np.zeros((states, self.width), np.int32 if states * self.width < 2 ** 31 else np.int64)
        table[model.edges[:, 0], model.edges[:, 1]] = model.edges[:, 2] * self.width
        self.table = table.ravel()
        self.root = np.array(model.roots, np.int64)[:, None] * self.width
        first = table[model.roots]
        self.first = np.where(first == 0, self.root, first)  # where a phrase that starts with a symbol stands
        self.symbol = np.zeros(0x110000, np.int64)
        self.symbol[model.alphabet] = np.arange(2, self.width)
        self.symbol[0] = SPACE

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each text in each language (languages x texts), and the texts' numbers of symbols."""
        points, start = _spaced(*_points(texts))
        size = np.diff(np.append(start, len(points)))
        codes = self.symbol[points]
        parts = -(-size // SEGMENT)
        text = np.repeat(np.arange(len(texts)), parts)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = start[text] + nth * SEGMENT
        length = np.minimum(SEGMENT, size[text] - nth * SEGMENT)
        order = np.argsort(-length, kind="stable")
        text, begin, length = text[order], begin[order], length[order]
        total = np.zeros((len(self.root), len(text)), np.int64)
        state = np.repeat(self.root, len(text), axis=1)
        for t in range(int(length.max(initial=0))):
            n = int(np.searchsorted(-length, -t, side="left"))  # segments longer than t
            c = codes[begin[:n] + t]
            here = state[:, :n]
            on = self.table.take(here + c)
            ended = on == 0
            total[:, :n] += ended | (here == self.root)
            state[:, :n] = np.where(ended, self.first[:, c], on)
        out = np.zeros((len(self.root), len(texts)), np.int64)
        for k in range(len(out)):
            out[k] = np.bincount(text, total[k], len(texts)).astype(np.int64)
        return out, size

    def predict(self, texts: list[str]) -> Iterator[tuple[str, float]]:
        counts, size = self.phrases(texts)
        bits = counts * np.log2(np.maximum(self.model.lengths, 2))[:, None] / np.maximum(size, 1)
        for k, n in enumerate(size.tolist()):
            if not n or not len(bits):
                yield "und", 0.0
                continue
            best = int(np.argmin(bits[:, k]))  # languages are in order of their names
            rest = np.delete(bits[:, k], best)
            yield self.model.languages[best], float(1 - bits[best, k] / rest.min()) if len(rest) else 1.0


def _pieces(docs: DataFrame, learnable: Column, max_chars: int, max_languages: int) -> list:
    """(lang, piece): about max_chars characters in equal shares of the languages, drawn from every part of all texts."""
    parts = F.ceil(F.length("text") / F.lit(PIECE)).cast("int")
    rows = docs.where(learnable & F.col("lang").isNotNull() & (F.length("text") > 0)).select("doc_id", "lang", "text")
    sizes = rows.groupBy("lang").agg(F.sum(parts).alias("n")).orderBy(F.col("n").desc(), "lang").limit(max_languages).collect()
    if not sizes:
        return []
    each = max(1, max_chars // PIECE // len(sizes))
    # twice the share by a bound on the hash, then exactly the share: no row but those goes anywhere
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r.lang, min(1 << 30, math.ceil((1 << 30) * 2 * each / r.n)))])
    mark = lambda k: F.xxhash64(F.col("doc_id"), k, F.lit("lang"))
    some = lambda k: F.pmod(mark(k), F.lit(1 << 30)) < F.element_at(share, F.col("lang"))
    drawn = (rows.where(F.col("lang").isin([r.lang for r in sizes]))
             .withColumn("picks", F.filter(F.sequence(F.lit(0), parts - 1), some)).where(F.size("picks") > 0)
             .select("doc_id", "lang", "text", F.explode("picks").alias("k")))
    texts = drawn.select("lang", F.substring("text", F.col("k") * PIECE + 1, F.lit(PIECE)).alias("piece"),
                         F.row_number().over(W.partitionBy("lang").orderBy(mark(F.col("k")), "doc_id", "k")).alias("r"))
    return cut(texts.where(F.col("r") <= each), "language-pieces").orderBy("lang", "r").collect()  # the bounded sample


def fit(docs: DataFrame, learnable: Column, max_chars: int = 131_072, max_languages: int = 128, max_symbols: int = 160) -> LanguageModel:
    """Learn from the rows (doc_id, text, lang) where ``learnable``, of a bounded sample (see above)."""
    texts: dict[str, list[str]] = {}
    for r in _pieces(docs, learnable, max_chars, max_languages):
        texts.setdefault(r.lang, []).append(r.piece)
    cleaned = {}
    for lang in sorted(texts):
        points, start = _spaced(*_points(texts[lang]))
        cleaned[lang] = np.split(points, start[1:])
    seen = Counter()
    for parts in cleaned.values():
        seen.update(np.concatenate(parts).tolist())
    seen.pop(0, None)
    alphabet = [p for p, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:max_symbols]]
    symbol = {p: k + 2 for k, p in enumerate(alphabet)} | {0: SPACE}
    names, lengths, roots, edges, states = [], [], [], [], 0
    for lang, parts in cleaned.items():
        # symbol 0 parts the pieces; no text has it, so no phrase runs over a seam
        line = [s for p in parts for s in (*(symbol.get(x, 0) for x in p.tolist()), 0)]
        if max(line, default=0) <= SPACE:
            continue
        go = suffix_automaton(line)
        edges += [(a + states, c, b + states) for a, row in enumerate(go) for c, b in row.items() if c]
        names.append(lang)
        lengths.append(len(line))
        roots.append(states)
        states += len(go)
    return LanguageModel(names, lengths, alphabet, np.array(edges, np.int64).reshape(-1, 3), roots)


def predict(docs: DataFrame, model: LanguageModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns of every row with lang_pred and score; reads those and the whole text only."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parser = Parser(model)
        for b in batches:
            texts = [t if isinstance(t, str) else "" for t in b["_whole"]]
            found = [x for some in _together(texts) for x in parser.predict(some)]
            out = b[list(keep)].copy()
            out["lang_pred"], out["score"] = [x[0] for x in found], np.array([x[1] for x in found], np.float64)
            yield out

    rows = docs.select(*keep, F.col("text").alias("_whole"))
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInPandas(run, f"{fields}, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, **bounds) -> LanguageModel:
    """Fit on the rows that are not held out."""
    return fit(docs.select("doc_id", "text", "lang"), F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")), **bounds)
