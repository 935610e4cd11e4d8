"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

A benchmark item is found in a document when some run of the document's words is within
floor((1 - similarity) * words) word edits of the item (insert, delete, replace; ASCII case and punctuation
aside).

The CGK embedding (Chakraborty, Goldenberg, Koucky 2016) walks over a word sequence: at step j it writes the
word it stands on and moves on if a random bit, a function of j and that word, says so. Two sequences at small
edit distance fall into step again and so get embeddings of small Hamming distance. The walk from a document
word is the embedding of the window that starts there, for windows of any length; so each start is walked
once per repetition, and ``samples`` sampled positions of the embedding are its LSH key (bit sampling). Items
are keyed in the same way, from their beginning and again after every ``stride`` words, so an edit spoils only
the pieces around it; ``repetitions`` independent walks bring the recall to its target. The keys of a bounded
chunk of items go to every task (``chunk`` items a pass; a larger benchmark takes more passes over the
documents), and a start is dropped as soon as its first sampled words are no item's. What collides is verified
by the exact edit distance between the whole item and the document words around the window.

Recall: pairs at word similarity 0.8 to 1 are found with probability above 0.9 (measured in the tests on random
edits; exact copies always). No pair below the similarity is returned.

Edge cases. Null, empty or wordless texts hit nothing, and no item that has no words is ever hit. Items shorter
than a walk are keyed over their own length. Repeated benchmark items each count; repeated documents each get
their rows. Null doc_id or item_id are carried as null. An empty table gives an empty result. Extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby, pairwise
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelens.llm.common import bounded_batches, cut, packed, unpacked

WALK, STRIDE, SAMPLES, REPETITIONS = 16, 8, 4, 12
GROUP_BYTES = 1 << 21
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)
MIX = np.uint64(0xD6E8FEB86659FD93)

#: byte -> lower-case word byte, 0 for separators; bytes of non-ASCII characters belong to words
_FOLD = np.zeros(256, np.uint64)
for _c in [*range(48, 58), *range(97, 123), *range(128, 256)]:
    _FOLD[_c] = _c
for _c in range(65, 91):
    _FOLD[_c] = _c + 32
_POWERS: dict[str, np.ndarray] = {}


def _powers(name: str, base: int, n: int) -> np.ndarray:
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        size = max(n, GROUP_BYTES + 1)
        _POWERS[name] = have = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, base, np.uint64)]))
    return have[:n]


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of a byte string, and the byte offset of each."""
    low = _FOLD[np.frombuffer(raw, np.uint8)]
    edge = np.diff(np.concatenate([[0], (low != 0).view(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(low * _powers("up", BASE, len(low)))])
    h = (total[end] - total[start]) * _powers("down", BASE_INV, len(low) + 1)[start]
    h = (h ^ (h >> np.uint64(32))) * MIX
    return (h ^ (h >> np.uint64(29))) * MIX | np.uint64(1), start


@dataclass
class Plan:
    """One repetition for items of one walk length: the sampled steps and the random bits of the walk."""

    steps: np.ndarray
    bits: np.ndarray
    salt: int

    @staticmethod
    def make(walk: int, rep: int) -> Plan:
        rng = np.random.default_rng([walk, rep])
        steps = np.sort(rng.choice(walk, size=min(SAMPLES, walk), replace=False))
        return Plan(steps, rng.integers(0, 1 << 63, walk, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rep)


def _mix(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    key = (key ^ word) * MIX
    return key ^ (key >> np.uint64(31))


def _bit(words: np.ndarray, by: np.uint64) -> np.ndarray:
    return ((words * by) >> np.uint64(63)).astype(np.int32)


class Index:
    """Keys of a chunk of items, by walk length and repetition."""

    def __init__(self, items: list[np.ndarray], repetitions: int = REPETITIONS):
        self.items, self.lists = items, [x.tolist() for x in items]
        self.plans = []
        lengths = np.array([len(x) for x in items])
        for walk in sorted({min(WALK, n) for n in lengths.tolist()} - {0}):
            own = [k for k in range(len(items)) if min(WALK, lengths[k]) == walk]
            pieces = [(k, o) for k in own for o in range(0, max(1, lengths[k] - walk + 1), STRIDE)]
            if lengths[own].max(initial=0) > walk:
                pieces += [(k, int(lengths[k]) - walk) for k in own if (lengths[k] - walk) % STRIDE]
            for rep in range(repetitions):
                plan = Plan.make(walk, rep)
                entries: list[tuple[list[int], int, int]] = []
                for k, o in pieces:
                    words, at, seen = items[k][o:], 0, []
                    for j in range(int(plan.steps[-1]) + 1):
                        if j in plan.steps:
                            seen.append(int(words[at]))
                        at += int(_bit(words[at:at + 1], plan.bits[j])[0])
                        if at >= len(words):
                            break
                    if len(seen) == len(plan.steps):
                        entries.append((seen, k, o))
                if entries:
                    self.plans.append((plan, *self._tables(plan, entries)))

    @staticmethod
    def _tables(plan: Plan, entries: list) -> tuple:
        words = np.array([e[0] for e in entries], np.uint64)
        key, filters = np.full(len(words), plan.salt, np.uint64), []
        for c in range(words.shape[1]):
            key = _mix(key, words[:, c])
            bitmap = np.zeros(1 << 16, bool)
            bitmap[(words[:, 0] if c == 0 else key) >> np.uint64(48)] = True  # the first sample is looked up unmixed
            filters.append(bitmap)
        order = np.argsort(key, kind="stable")
        return filters, key[order], np.array([e[1] for e in entries])[order], np.array([e[2] for e in entries])[order]

    def collisions(self, words: np.ndarray) -> np.ndarray:
        """Rows (item, where the item would start in ``words``), without repeats; starts may be negative."""
        n, found = len(words), []
        padded = np.concatenate([words, np.zeros(WALK, np.uint64)])
        high = (padded >> np.uint64(48)).astype(np.intp)
        for plan, filters, keys, item, offset in self.plans:
            # the walk backwards, from the places that hold a first sample of an item to the starts that lead there
            first = int(plan.steps[0])
            turns = [(padded * plan.bits[j]).view(np.int64) < 0 for j in range(first)]
            leads = filters[0][high]
            for turn in turns[::-1]:
                leads[:-1] ^= turn[:-1] & (leads[:-1] ^ leads[1:])
            start = at = np.flatnonzero(leads[:n])
            for turn in turns:
                at = at + turn[at]
            key, step = _mix(np.full(len(start), plan.salt, np.uint64), padded[at]), first
            for c, s in enumerate(plan.steps.tolist()[1:], 1):
                for j in range(step, s):
                    at = at + _bit(padded[at], plan.bits[j])
                step = s
                key = _mix(key, padded[at])
                on = filters[c][key >> np.uint64(48)]
                start, at, key = start[on], at[on], key[on]
            lo, hi = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
            times = hi - lo
            if times.any():
                entry = np.repeat(lo, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                found.append(np.stack([item[entry], np.repeat(start, times) - offset[entry]], axis=1))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)


def best_run(item: np.ndarray, words: np.ndarray) -> tuple[int, int]:
    """(edits, end) of the run of ``words`` closest to ``item``; of equals the first."""
    j = np.arange(len(words) + 1)
    row = np.zeros(len(words) + 1, np.int64)
    for i, w in enumerate(item, 1):
        new = np.minimum(row + 1, np.concatenate([[i], row[:-1] + (words != w)]))
        row = np.minimum.accumulate(new - j) + j
    return int(row.min()), int(row.argmin())


def hits(index: Index, words: np.ndarray, lo: int, hi: int, cands: np.ndarray, similarity: float) -> dict[int, tuple[int, int]]:
    """item -> (edits, first word in the document) for one document, which has the words [lo, hi)."""
    out: dict[int, tuple[int, int]] = {}
    for k, mine in groupby(sorted(cands.tolist()), key=itemgetter(0)):
        item, allowed = index.items[k], int((1 - similarity) * len(index.items[k]) + 1e-9)
        starts = [c[1] for c in mine]
        breaks = [0, *(n for n in range(1, len(starts)) if starts[n] - starts[n - 1] > allowed + 1), len(starts)]
        for n, m in pairwise(breaks):
            a, b = max(lo, starts[n] - allowed), min(hi, starts[m - 1] + len(item) + allowed)
            near = words[a:b]
            if sum(map(set(near.tolist()).__contains__, index.lists[k])) < len(item) - allowed:
                continue
            edits, end = best_run(item, near)
            if edits <= allowed:
                back, first = best_run(item[::-1], near[:end][::-1])  # ends here, so it starts where this ends
                got = (edits, a + end - first - lo)
                out[k] = min(out.get(k, got), got)
    return out


def _groups(texts: list[str | None]) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """Consecutive texts as byte strings of about GROUP_BYTES; a longer text is a group of its own, whole."""
    first, size, parts = 0, 0, []
    for k, t in enumerate([*texts, None]):
        raw = (t or "").encode("utf-8", "surrogatepass")
        if parts and (k == len(texts) or size + len(raw) > GROUP_BYTES):
            yield first, k, b" ".join(parts), np.cumsum([0] + [len(p) + 1 for p in parts])
            first, size, parts = k, 0, []
        parts.append(raw)
        size += len(raw) + 1


def row_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8,
             repetitions: int = REPETITIONS, chunk: int = 20_000) -> DataFrame:
    """``find_hits`` with h, the hash of the text that was hit; the id is named id."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    passes = max(1, -(-items.count() // chunk))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(passes))
    out = None
    for k in range(passes):
        got = items.where(part == k).collect()  # about ``chunk`` items
        index = Index([word_hashes((r.text or "").encode("utf-8", "surrogatepass"))[0] for r in got], repetitions)
        shared = spark.sparkContext.broadcast((index, [r.item_id for r in got]))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            index, names = shared.value
            for b in batches:
                ids, hashes, found = b["id"].tolist(), b["h"].tolist(), []
                for first, last, raw, ends in _groups(b["text"].tolist()):
                    if last == first:
                        continue
                    words, at = word_hashes(raw)
                    cands = index.collisions(words)
                    bound = np.searchsorted(at, ends)  # the word each text begins with
                    span = np.array([len(x) for x in index.items])[cands[:, 0]]
                    doc = np.searchsorted(bound, cands[:, 1] + span // 2, "right") - 1
                    for d in np.unique(doc[(doc >= 0) & (doc < last - first)]).tolist():
                        mine = hits(index, words, int(bound[d]), int(bound[d + 1]), cands[doc == d], similarity)
                        found += [(ids[first + d], hashes[first + d], names[i], e, s) for i, (e, s) in mine.items()]
                yield pd.DataFrame(found, columns=["id", "h", "item_id", "edits", "start"]).astype({"id": "Int64", "item_id": "Int64"})

        hit = rows.mapInPandas(run, "id long, h long, item_id long, edits long, start long")
        out = hit if out is None else out.unionByName(hit)
    return out


def find_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8,
              repetitions: int = REPETITIONS, chunk: int = 20_000) -> DataFrame:
    """(id_col, item_id, edits, start): the closest run of each item within the similarity in each document;
    ``start`` counts the document's words from 0."""
    return row_hits(docs, benchmark, id_col, text_col, similarity, repetitions, chunk).select(F.col("id").alias(id_col), "item_id", "edits", "start")


def keep_clean(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item. Rows are told apart by doc_id and text, so rows without
    doc_id, or of one doc_id with unlike texts, are judged each by its own text."""
    found = cut(row_hits(docs, benchmark, similarity=similarity).select(F.col("id").alias("hit"), "h").distinct(), "contaminated")
    row = lambda c: F.col("row").getField(c)
    clean = packed(docs).join(found, row("doc_id").cast("long").eqNullSafe(F.col("hit")) & (F.xxhash64(row("text")) == F.col("h")), "left_anti")
    return unpacked(clean, docs.columns)
