"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints: 64-bit majority vote over the XXH64 hashes (seed 42) of a text's word shingles.

Index: the distinct fingerprints are sorted by Gray rank (neighbours in that order share long runs of bits)
and range-partitioned into blocks. Every node of the index, from single fingerprints through groups inside a
block and blocks up to the root, keeps the AND and the OR of its fingerprints. Bits where both agree are the
node's shared masked pattern; two nodes whose patterns differ in d commonly shared bits hold no pair closer
than d, so a whole pair of groups falls as soon as its accumulated differences pass the limit. The node pairs
are followed from the root downwards: above the blocks as equi-joins of (parent, child) tables, below them in
numpy, one task per block pair that is left.

A block pair emits a spanning forest of its links (at most one row per fingerprint), never all pairs, and the
components of these links are the components of all links. Copies are collapsed before anything is compared.

Edge cases. Null, empty or blank texts have fingerprint zero and are linked like any other text. Fewer words
than a shingle: the whole sequence is the one shingle. Repeated rows keep their rows and share a component.
A null id keeps its row; it never names a component unless no id of the component is known (then null).
An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framelens.llm.common import attach, bounded_batches, cut, packed, unpacked
from framelens.operators.components import connected_components

BLOCK = 1 << 14
FAN_BITS = 4
CHUNK = 1 << 15


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The unsigned 64-bit fingerprint of a whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and blanks only
    if not words:
        return 0
    if len(words) < shingle:
        pieces: Iterator[bytes] = iter([b" ".join(words)])
        n = 1
    else:
        n = len(words) - shingle + 1
        pieces = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=42), pieces), dtype="<u8", count=n)
    votes = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, h, fp): h is the hash of the text, fp holds the 64 bits as a signed long."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fps = np.fromiter((fingerprint(t, shingle) for t in b["text"]), dtype=np.uint64, count=len(b))
            yield pd.DataFrame({"id": b["id"], "h": b["h"], "fp": fps.view(np.int64)})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    return rows.mapInPandas(run, "id long, h long, fp long")


def gray_rank(fp: Column) -> Column:
    """Position of a 64-bit word in the Gray-code sequence, ordered as a signed long."""
    for s in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, s))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


def _levels(leaves: np.ndarray, height: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(AND, OR) of the index nodes below a block, leaves first, fan-out 4."""
    out = [(leaves, leaves)]
    for _ in range(height):
        a, o = out[-1]
        at = np.arange(0, len(a), 4)
        out.append((np.bitwise_and.reduceat(a, at), np.bitwise_or.reduceat(o, at)))
    return out


def _union(lab: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the sets of i and j; lab always points to a smaller or the same member."""
    while True:
        a, b = lab[i], lab[j]
        open_ = a != b
        if not open_.any():
            return
        np.minimum.at(lab, np.maximum(a, b)[open_], np.minimum(a, b)[open_])
        while not np.array_equal(nxt := lab[lab], lab):
            lab[:] = nxt


def block_links(x: np.ndarray, y: np.ndarray, same: bool, limit: int) -> np.ndarray:
    """Labels (indices into x followed by y) after joining all pairs within ``limit`` bits."""
    height = 0
    while 4 ** height < max(len(x), len(y)):
        height += 1
    lx, ly = _levels(x, height), _levels(y, height)
    lab = np.arange(len(x) if same else len(x) + len(y))
    stack = [(height, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    kids = np.arange(4)
    while stack:
        lev, i, j = stack.pop()
        if lev == 0:
            keep = i != j if same else slice(None)
            _union(lab, i[keep], j[keep] + (0 if same else len(x)))
            continue
        if len(i) > CHUNK:
            stack += [(lev, i[k:k + CHUNK], j[k:k + CHUNK]) for k in range(0, len(i), CHUNK)]
            continue
        lev -= 1
        (ax, ox), (ay, oy) = lx[lev], ly[lev]
        ci = np.repeat((i[:, None] * 4 + kids).ravel(), 4)
        cj = np.repeat(j[:, None] * 4 + kids, 4, axis=0).ravel()
        ok = (ci < len(ax)) & (cj < len(ay))
        if same:
            ok &= ci <= cj
        ci, cj = ci[ok], cj[ok]
        shared = ~(ax[ci] ^ ox[ci]) & ~(ay[cj] ^ oy[cj])
        ok = np.bitwise_count((ax[ci] ^ ay[cj]) & shared) <= limit
        if ok.any():
            stack.append((lev, ci[ok], cj[ok]))
    return lab


def hamming_links(unique: DataFrame, n: int, limit: int) -> DataFrame:
    """(src, dst): a spanning forest, per block pair, of the distinct fingerprints within ``limit`` bits."""
    blocks_n = max(1, -(-n // BLOCK))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [b["fp"].to_numpy() for b in batches]
        fps = np.concatenate(got).view(np.uint64) if got else np.zeros(0, np.uint64)
        if len(fps):
            both = [int(f.reduce(fps).view(np.int64)) for f in (np.bitwise_and, np.bitwise_or)]
            yield pd.DataFrame({"node": [TaskContext.get().partitionId()], "a": both[:1], "o": both[1:], "fps": [fps.tobytes()]})

    ranked = unique.select("fp", gray_rank(F.col("fp")).alias("rank"))
    blocks = cut(ranked.repartitionByRange(blocks_n, "rank").sortWithinPartitions("rank").select("fp")
                 .mapInPandas(pack, "node long, a long, o long, fps binary"), "gray-blocks")
    # the index above the blocks: one table per level, the root last
    levels = [blocks.select("node", "a", "o")]
    top = blocks.agg(F.max("node")).first()[0] or 0
    while top:
        top >>= FAN_BITS
        levels.append(levels[-1].groupBy(F.shiftright("node", FAN_BITS).alias("node"))
                      .agg(F.bit_and("a").alias("a"), F.bit_or("o").alias("o")))
    pairs = levels[-1].select(F.col("node").alias("i"), F.col("node").alias("j"))
    for level in reversed(levels[:-1]):
        side = lambda s: level.select(F.shiftright("node", FAN_BITS).alias(f"p{s}"), F.col("node").alias(f"n{s}"),
                                      F.col("a").alias(f"a{s}"), F.bitwise_not(F.col("a").bitwiseXOR(F.col("o"))).alias(f"m{s}"))
        differ = F.bit_count(F.col("a1").bitwiseXOR(F.col("a2")).bitwiseAND(F.col("m1")).bitwiseAND(F.col("m2")))
        pairs = (pairs.join(side(1), F.col("i") == F.col("p1")).join(side(2), F.col("j") == F.col("p2"))
                 .where((F.col("n1") <= F.col("n2")) & (differ <= limit))
                 .select(F.col("n1").alias("i"), F.col("n2").alias("j")))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, j, fx, fy in zip(b["i"], b["j"], b["fx"], b["fy"], strict=True):
                x, y = np.frombuffer(fx, np.uint64), np.frombuffer(fy, np.uint64)
                lab = block_links(x, y, i == j, limit)
                fps = (x if i == j else np.concatenate([x, y])).view(np.int64)
                own = np.flatnonzero(lab != np.arange(len(lab)))
                yield pd.DataFrame({"src": fps[own], "dst": fps[lab[own]]})

    held = lambda s, f: blocks.select(F.col("node").alias(s), F.col("fps").alias(f))
    work = pairs.join(held("i", "fx"), "i").join(held("j", "fy"), "j").select("i", "j", "fx", "fy")
    return work.repartition(max(blocks_n, work.sparkSession.sparkContext.defaultParallelism)).mapInPandas(compare, "src long, dst long")


def groups_of(docs: DataFrame, id_col: str, text_col: str, shingle: int, max_bits: int) -> DataFrame:
    """(id, h, fp, component_id, group) for every row; ``group`` tells components apart whatever ids they hold."""
    fps = cut(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    unique = cut(fps.groupBy("fp").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")), "unique-fps")
    sizes = unique.agg(F.count(F.lit(1)).alias("u"), F.coalesce(F.sum("n"), F.lit(0)).alias("t")).first()
    links = hamming_links(unique, sizes.u, max_bits)
    comps = connected_components(links, "src", "dst")
    linked = unique.join(comps.withColumnRenamed("vertex", "fp"), "fp", "left")
    least = linked.where("comp is not null").groupBy("comp").agg(F.min("rep").alias("least"))
    groups = cut(linked.where("comp is not null or n > 1").join(least, "comp", "left")
                 .select("fp", "n", F.coalesce("least", "rep").alias("component_id"), F.coalesce("comp", "fp").alias("group")), "simhash-groups")
    return attach(fps, groups, "fp", "n", sizes.t).select("id", "h", "fp", F.coalesce("component_id", "id").alias("component_id"),
                                                          F.coalesce("group", "fp").alias("group"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                    max_bits: int = 2) -> DataFrame:
    """(id_col, fingerprint, component_id) for every row of ``docs``."""
    out = groups_of(docs, id_col, text_col, shingle, max_bits)
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that of the smallest doc_id, rows without one last.

    Rows are told apart by doc_id and text: rows of one doc_id with unlike texts are judged each by its own group.
    """
    rows = cut(groups_of(docs, "doc_id", "text", shingle, max_bits).select("group", F.struct(F.col("id").isNull().alias("last"), "id", "h").alias("r")), "simhash-rows")
    stays = rows.groupBy("group").agg(F.min("r").alias("r")).select("r").distinct()
    gone = rows.select("r").distinct().join(stays, "r", "left_anti").select(F.col("r.id").alias("out"), F.col("r.h").alias("h"))
    own = packed(docs).withColumns({"doc": F.col("row").getField("doc_id"), "own": F.xxhash64(F.col("row").getField("text"))})
    kept = own.join(gone, F.col("doc").cast("long").eqNullSafe(F.col("out")) & (F.col("own") == F.col("h")), "left_anti")
    nth = F.row_number().over(W.partitionBy("doc", "own").orderBy("doc"))
    return unpacked(kept.withColumn("nth", nth).where(F.col("nth") == 1), docs.columns)
