"""Exact cosine similarity joins: all pairs with 1 - cos <= eps.

Sparse (TF-IDF, long form) — prefix filtering (Chaudhuri et al. 2006; Bayardo
et al. 2007), with no Cartesian product:

* Order tokens globally rarest first, by (df, token). The *suffix norm* of a
  unit vector x at a token is the norm of x from that token on, inclusive. The
  *prefix* of x is the run of tokens whose suffix norm is >= s.
* All that x and y have in common from token k on is at most the product of
  their suffix norms at k, and that product only falls along the order. A pair
  with cos >= t has a product >= t >= s at its first common token. So prefixes
  are joined on token, and of the matches only those with a product >= s are
  kept: a leading run of the pair's common tokens.
* Summing w_x*w_y over them gives a partial dot ``pd``. What the pair has in
  common behind the last of them is at most the product of the norms behind
  it, and less than s. Pairs with pd + that bound < t are dropped; survivors
  get the exact dot by a long-form join and the final test 1 - dot <= eps.

The candidate join is an equi-join on token; a token with more than
``cell_rows`` prefix rows is dealt into parts and joined part by part, so no
key yields more than cell_rows^2 candidates. The partial dots are a (src, dst)
hash aggregate with map-side combine. Copies are collapsed before the join
(``vector_classes``): it runs on one vector per class, and links between
copies are never enumerated.

That plan's matches grow with the square of a token's prefix rows, and all of
them are shuffled. By default (``packed_similarity_join``) pairs of blocks of
vectors meet in bounded groups instead, and nothing that is shuffled or stored
grows with the number of candidates. Tokens are parted into rare and common ones
by their df. The dot of two vectors is at most that of their rare terms plus the
product of the norms of their common ones (Cauchy and Schwarz):

* Where that product is less than ``least`` (somewhat under t), the rare terms
  must give the rest. They are matched token by token inside the group, so its
  work is the matches of rare tokens, few a pair (``rare_pairs``).
* The other pairs have mostly common tokens. An upper bound of their dot, from
  vectors folded into a fixed number of columns, is computed as a matrix product
  (``folded_pairs``). Blocks are ranges of the common norm, and only pairs of
  blocks that can hold such a pair meet.

``token_split`` chooses where rare ends from the matches and pairs that each df
would leave. Both parts are quadratic, the first with a small factor. A call with
``s``, ``use_maxw`` or ``cell_rows`` takes prefix filtering.

Dense (float arrays) — exact blocked join: rows hash into B blocks, each
vector is replicated to the B block pairs it belongs to, and each block pair
is one bounded applyInArrow group where numpy computes the block's cosines
by products of a bounded size and emits only pairs within eps (never all pairs).
A block holds as many vectors as some MB do, so B, a vector's copies, stays small. Work is O(n^2 d / tasks) — exact dense similarity
has no index that helps on near-orthogonal data; the LSH mode below is the
sub-quadratic, recall-tunable alternative (exact verify, so precision 1).
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from framelens.operators.tfidf import binary_lists, of_binary
from framelens.session import checkpoint_dir, stored

SLACK = 1e-9
#: Prefix rows of one token that meet in one key of the candidate join.
CELL_ROWS = 2000


def vector_classes(vec: DataFrame) -> DataFrame:
    """(id, rep, n): every vector's class of equal vectors, named by its least
    id, and the class size. Vectors are told apart by a 128-bit hash of their
    (token, tf) rows, folded per id without gathering them."""
    fold = lambda seed: F.bit_xor(F.xxhash64("token", "tf", F.lit(seed)))
    return _classes(vec.groupBy("id").agg(fold(3).alias("k1"), fold(4).alias("k2"), F.count(F.lit(1)).alias("k3")))


def _classes(keys: DataFrame) -> DataFrame:
    classes = keys.groupBy("k1", "k2", "k3").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    return keys.join(classes, ["k1", "k2", "k3"]).select("id", "rep", "n")


def representatives(vec: DataFrame, classes: DataFrame) -> DataFrame:
    """The vectors that name a class."""
    return vec.join(classes.where("id = rep").select("id"), "id", "left_semi")


def _cells(prefix: DataFrame, cell_rows: int) -> DataFrame:
    """Prefix rows with the part of their token they fall in, and its number of parts."""
    hot = (prefix.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / cell_rows).alias("parts"))
           .where(F.col("parts") > 1))
    dealt = prefix.join(hot, "token", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    return dealt.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))


def prefix_entries(vec: DataFrame, s: float, use_maxw: bool = False) -> DataFrame:
    """The prefix rows (id, token, w, suf, after) of unit vectors (id, token,
    df, w): ``suf`` is the norm from the token on, ``after`` that behind it.

    The suffix bound of x from token k on is
    min(||x_>=k||, sum_{j>=k} x_j * maxw_j) with maxw_j the largest weight of
    token j in any vector: no partner can beat either. It only decreases along
    the order, so the prefix (bound >= s) is a leading run of tokens. The
    max-weight term costs one token aggregate and join; it pays off on corpora
    whose frequent tokens have uniformly low weight (``use_maxw``).
    """
    w_desc = Window.partitionBy("id").orderBy(F.desc("df"), F.desc("token")) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    square = F.col("w") * F.col("w")
    v = vec.withColumn("_suf2", F.sum(square).over(w_desc)).withColumn("suf", F.sqrt("_suf2"))
    bound = F.col("suf")
    if use_maxw:
        maxw = vec.groupBy("token").agg(F.max("w").alias("_mw"))
        v = v.join(maxw, "token").withColumn("_sufm", F.sum(F.col("w") * F.col("_mw")).over(w_desc))
        bound = F.least("suf", "_sufm")
    after = F.sqrt(F.greatest(F.col("_suf2") - square, F.lit(0.0))).alias("after")
    # stored: read three times (hot tokens, both sides of the join)
    return v.where(bound >= F.lit(s - SLACK)).select("id", "token", "w", "suf", after).checkpoint()


#: Terms of one block of vectors, and rows of one matrix product.
BLOCK_TERMS = 8_000_000
CHUNK_ROWS = 2048
#: Columns that a term is kept in; the products fold them further.
FINE = 1 << 16
#: For the rounding of float32 sums.
FOLD_SLACK = 1e-4


def packed_vectors(vec: DataFrame) -> DataFrame:
    """(id, k, w, df): a vector's terms (64-bit key of the token, weight, df) in one row, as binary lists."""
    import pyarrow as pa

    term = F.struct(F.xxhash64("token").alias("k"), "w", F.col("df").cast("int").alias("df"))
    lists = vec.groupBy("id").agg(F.collect_list(term).alias("t")).select("id", "t.k", "t.w", "t.df")

    def pack(batches):
        for b in batches:
            flat = {c: (b[c].flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(b[c].value_lengths().to_numpy())])) for c in ("k", "w", "df")}
            yield pa.RecordBatch.from_pydict({"id": b["id"], **{c: binary_lists(*x) for c, x in flat.items()}})

    return lists.mapInArrow(pack, f"id {vec.schema['id'].dataType.simpleString()}, k binary, w binary, df binary")


def packed_classes(packed: DataFrame) -> DataFrame:
    """``vector_classes`` of packed vectors that carry their hashes (``tfidf.packed_tfidf``)."""
    return _classes(packed.select("id", F.col("h1").alias("k1"), F.col("h2").alias("k2"), F.length("k").alias("k3")))


def _folds(k: int) -> int:
    """Columns of the product of vectors of about ``k`` terms: enough that few of them share one."""
    return min(4096, max(256, 1 << math.ceil(math.log2(2 * max(k, 1)))))


#: Ranges of the common norm that vectors of the folded join are dealt into.
RANGES = 6


def folded_pairs(packed: DataFrame, t: float, block_terms: int = BLOCK_TERMS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(src, dst), src < dst: pairs of unit vectors with an upper bound of their dot of t or more; all pairs with
    dot >= t are among them.

    Terms are dealt into columns by a hash, and a column holds the norm of its terms: by Cauchy and Schwarz the dot of
    two vectors is at most that of their folded ones. A term travels as four bytes, its column of ``FINE`` and its
    weight rounded up. Each pair of blocks is one bounded group; it multiplies chunks of vectors, folded
    to a few hundred or thousand columns, and holds the pairs that are left against the fine columns (unless most of a
    sample of them pass).
    """
    every = coded_vectors(packed, 0, 0.0).select("id", F.lit(1.0).alias("c"), "codes")
    return _folded(every, t, 0.0, block_terms, chunk_rows)


def _folded_meet(t: float, over: float, chunk_rows: int):
    """The pairs of one group of ``_folded``."""
    import pyarrow as pa

    least = t - FOLD_SLACK

    def side(ids: np.ndarray, c: np.ndarray, lengths: np.ndarray, starts: np.ndarray, flat: np.ndarray, at: np.ndarray) -> tuple:
        """(ids, starts, lengths, columns, weights, c) of the rows ``at``, the largest c and then the shortest first."""
        at = at[np.lexsort((lengths[at], -c[at]))]
        m = lengths[at]
        ends = np.cumsum(m)
        take = np.repeat(starts[at] - (ends - m), m) + np.arange(ends[-1])
        codes = flat[take]
        return ids[at], ends - m, m, (codes >> 16) + FINE // 2, (codes & (FINE - 1)).astype(np.float32) / np.float32(FINE - 1), c[at]

    def dense(s: tuple, a: int, b: int, d: int) -> np.ndarray:
        _, start, m, col, w, _ = s
        lo, hi = start[a], start[b - 1] + m[b - 1]
        place = np.repeat(np.arange(b - a), m[a:b]) * d + (col[lo:hi] & (d - 1))
        squares = np.bincount(place, w[lo:hi] * w[lo:hi], minlength=(b - a) * d)
        return np.sqrt(squares.astype(np.float32)).reshape(b - a, d)

    def fine(left: tuple, right: tuple, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which of the pairs (sorted by i) reach t by their fine columns."""
        keep = np.zeros(len(i), bool)
        x = np.zeros(FINE, np.float32)
        edges = np.nonzero(np.diff(i, prepend=-1, append=-1))[0]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            own = slice(left[1][i[a]], left[1][i[a]] + left[2][i[a]])
            np.add.at(x, left[3][own], left[4][own] ** 2)
            x[left[3][own]] = np.sqrt(x[left[3][own]])
            for c in range(a, b, 1024):
                some = j[c:min(b, c + 1024)]
                m = right[2][some]
                ends = np.cumsum(m)
                take = np.repeat(right[1][some] - (ends - m), m) + np.arange(ends[-1])
                keep[c:c + len(some)] = np.add.reduceat(x[right[3][take]] * right[4][take], ends - m) >= least
            x[left[3][own]] = 0
        return keep

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        lo, hi = key[0].as_py(), key[1].as_py()
        blk = table["blk"].to_numpy()
        flat, offsets = of_binary(table["codes"], np.int32)
        args = table["id"].to_numpy(), table["c"].to_numpy(), np.diff(offsets), offsets[:-1], flat
        some = np.nonzero(args[2] > 0)[0]
        out = [np.zeros((2, 0), np.int64)]
        ats = [some[blk[some] == q] for q in (lo, hi)]
        if len(ats[0]) and len(ats[1]):
            left = side(*args, ats[0])
            right = left if lo == hi else side(*args, ats[1])
            for a in range(0, len(left[0]), chunk_rows):
                to, folded = min(a + chunk_rows, len(left[0])), {}
                for b in range(a if lo == hi else 0, len(right[0]), chunk_rows):
                    end = min(b + chunk_rows, len(right[0]))
                    if left[5][a] * right[5][b] < over:
                        break
                    d = _folds(math.isqrt(int(np.median(left[2][a:to])) * int(np.median(right[2][b:end]))))
                    if d not in folded:
                        folded[d] = dense(left, a, to, d)
                    i, j = np.nonzero(folded[d] @ dense(right, b, end, d).T >= least)
                    i, j = i + a, j + b
                    some = left[5][i] * right[5][j] >= over
                    if lo == hi:
                        some &= i < j
                    i, j = i[some], j[some]
                    if len(i):
                        # where most pairs are near, as among near copies, their exact dots are all that is left to do
                        some = slice(None, None, -(-len(i) // 128))
                        if len(i) < 256 or fine(left, right, i[some], j[some]).mean() < 0.5:
                            sure = fine(left, right, i, j)
                            i, j = i[sure], j[sure]
                        out.append(np.stack([left[0][i], right[0][j]]))
        pairs = np.concatenate(out, axis=1)
        return pa.table({"src": pairs.min(axis=0), "dst": pairs.max(axis=0)})

    return meet


def _folded(rows: DataFrame, t: float, over: float, block_terms: int = BLOCK_TERMS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``folded_pairs`` of rows (id, c, codes); with ``over``, of the pairs whose product of c is that or more.

    Vectors are dealt into ranges of c, even in its logarithm, and those into blocks. A range meets the ranges with which
    a product can reach ``over``: a vector of small c goes to the few vectors of large c only.
    """
    ranges, deep = (RANGES, -math.log(over)) if over else (1, 1.0)
    # a little low, so that two ranges whose numbers add up to RANGES can't hold a pair
    at = F.least(F.greatest(F.floor(F.lit(float(ranges)) * F.log("c") / F.lit(-deep) - F.lit(1e-6)), F.lit(0)), F.lit(ranges - 1)).cast("int")
    rows = rows.where(F.col("c") >= F.lit(over)).withColumn("rg", at)
    size = {r.rg: (r.n, r.terms) for r in rows.groupBy("rg").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("codes") / 4).alias("terms")).collect()}
    n = max(1, sum(x for x, _ in size.values()))
    spread = math.ceil(math.sqrt(4 * rows.sparkSession.sparkContext.defaultParallelism))
    blocks = [max(1, math.ceil(size[r][1] / block_terms), min(size[r][0], math.ceil(spread * size[r][0] / n))) if r in size else 0 for r in range(ranges)]
    first = np.concatenate([[0], np.cumsum(blocks)])
    last = [int(first[ranges - r]) for r in range(ranges)]
    groups = max(1, sum(blocks[r] * blocks[q] for r in range(ranges) for q in range(ranges - r)) // 2)
    of = lambda x: F.element_at(F.array(*[F.lit(int(v)) for v in x]), F.col("rg") + 1)
    dealt = rows.select("id", "c", "codes", "rg", (of(first[:-1]) + F.pmod(F.xxhash64("id"), F.greatest(of(blocks), F.lit(1)))).cast("int").alias("blk"))
    rep = dealt.select("*", F.explode(F.sequence(F.lit(0), of(last) - 1)).alias("other"))
    rep = rep.select("id", "c", "codes", "blk", F.least("blk", "other").alias("lo"), F.greatest("blk", "other").alias("hi"))
    # as many parts as groups: the groups are few and small, but work
    return rep.repartition(groups, "lo", "hi").groupBy("lo", "hi").applyInArrow(_folded_meet(t, over, chunk_rows), "src long, dst long")


#: Shares of the documents up to which a token may count as rare, and by how much less than t the product of common norms must be.
RARE_SHARES = [2.0 ** -k for k in range(3, 13)]
LEAST_REST = 0.05
#: About what a match of rare terms and a folded product take, of what a pair's cell takes.
MATCH_COST, FOLD_COST = 3.0, 20.0
NORM_BINS = 64


def token_split(packed: DataFrame, t: float) -> tuple[int, float]:
    """(df up to which a token is rare, ``least``) for the vectors (id, k, w, df), by an estimate of the work."""
    import pyarrow as pa

    least = max(t - LEAST_REST, t / 2)
    n = packed.count()
    tops = [max(1, int(n * s)) for s in RARE_SHARES] + [1]

    def count(batches):
        for b in batches:
            (w, ends), (df, _) = of_binary(b["w"], float), of_binary(b["df"], np.int32)
            row = np.repeat(np.arange(len(b)), np.diff(ends))
            out = np.zeros((len(tops), NORM_BINS + 1))
            for s, top in enumerate(tops):
                common = df > top
                c = np.sqrt(np.bincount(row[common], w[common] ** 2, minlength=len(b)))
                out[s, :-1] = np.bincount(np.minimum(c * NORM_BINS, NORM_BINS - 1).astype(int), minlength=NORM_BINS)
                out[s, -1] = (df[~common] - 1.0).sum() / 2
            yield pa.RecordBatch.from_pydict({"i": np.arange(out.size, dtype=np.int32), "x": out.ravel()})

    found = np.zeros((len(tops), NORM_BINS + 1))
    for r in packed.mapInArrow(count, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():
        found[divmod(r.i, NORM_BINS + 1)] = r.x
    up = (np.arange(NORM_BINS) + 1) / NORM_BINS
    over = np.outer(up, up) >= least
    cost = [f[-1] * MATCH_COST + (np.outer(f[:-1], f[:-1]) * over).sum() / 2 * FOLD_COST for f in found]
    return tops[int(np.argmin(cost))], least


#: Bits of a rare term's column and of its weight's logarithm; levels of weight to a power of two.
COLUMN_BITS, WEIGHT_BITS, LEVELS = 22, 10, 64


def coded_vectors(packed: DataFrame, top: int, least: float) -> DataFrame:
    """(id, c, rare, codes): the norm of a vector's terms of df > ``top``; the others that a second vector may have, four
    bytes a term with the weight rounded up; and, of vectors whose c is ``least`` or more, all terms as ``folded_pairs`` codes them."""
    import pyarrow as pa

    def code(batches):
        for b in batches:
            (k, ends), (w, _), (df, _) = (of_binary(b[c], x) for c, x in (("k", np.int64), ("w", float), ("df", np.int32)))
            row = np.repeat(np.arange(len(b)), np.diff(ends))
            w = np.abs(w)
            common = df > top
            c = np.sqrt(np.bincount(row[common], w[common] ** 2, minlength=len(b)))
            lists = lambda some, x: binary_lists(x, np.concatenate([[0], np.cumsum(np.bincount(row[some], minlength=len(b)))]))
            rare = ~common & (df > 1) & (w > 0)
            level = np.clip(np.floor(-LEVELS * np.log2(np.minimum(w[rare], 1.0)) - 1e-9), 0, (1 << WEIGHT_BITS) - 1).astype(np.uint32)
            column = (k[rare].view(np.uint64) >> np.uint64(64 - COLUMN_BITS)).astype(np.uint32)
            every = (c >= least)[row] & (w > 0)
            codes = ((k[every] % FINE - FINE // 2) * FINE + np.minimum(np.ceil(w[every] * (FINE - 1)), FINE - 1)).astype(np.int32)
            yield pa.RecordBatch.from_pydict({"id": b["id"], "c": c, "rare": lists(rare, (column << np.uint32(WEIGHT_BITS) | level).view(np.int32)), "codes": lists(every, codes)})

    return packed.mapInArrow(code, "id long, c double, rare binary, codes binary")


#: Vectors of the two sides of one product of rare terms, and blocks whose pairs are made at once where there are many.
TILE_ROWS, ROWS = 16384, 64
STRIP_BLOCKS, WHOLE_BLOCKS = 4, 8


def _rare_meet(t: float, least: float, tile_rows: int, chunk_rows: int):
    """The pairs of one group of ``rare_pairs``."""
    import pyarrow as pa

    reach = t - FOLD_SLACK
    weight_of = np.exp2(-np.arange(1 << WEIGHT_BITS) / LEVELS)

    def side(at: np.ndarray, offsets: np.ndarray, flat: np.ndarray) -> tuple:
        """(first terms of the rows, columns, weights) of the rows ``at``."""
        m = offsets[at + 1] - offsets[at]
        ends = np.concatenate([[0], np.cumsum(m)])
        codes = flat[np.repeat(offsets[at] - ends[:-1], m) + np.arange(ends[-1])]
        return ends, (codes >> np.uint32(WEIGHT_BITS)).astype(np.int32), weight_of[codes & np.uint32((1 << WEIGHT_BITS) - 1)].astype(np.float32)

    def of_both(ends: np.ndarray, column: np.ndarray, w: np.ndarray, number: np.ndarray) -> tuple:
        """A side without the terms of columns that meet none, the others numbered."""
        place = number[column]
        some = place >= 0
        return np.concatenate([[0], np.cumsum(some)])[ends], place[some], w[some]

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        lo, hi = key[0].as_py(), key[1].as_py()
        ids, blk, c = (table[x].to_numpy() for x in ("id", "blk", "c"))
        flat, offsets = of_binary(table["rare"], np.uint32)
        order = np.argsort(-c, kind="stable")
        at = [order[blk[order] == q] for q in (lo, hi)]
        out = [np.zeros((2, 0), np.int64)]
        if len(at[0]) and len(at[1]):
            sides = [side(at[0], offsets, flat)]
            sides.append(sides[0] if lo == hi else side(at[1], offsets, flat))
            size = 1 << COLUMN_BITS
            count = [np.bincount(s[1], minlength=size) for s in sides[:1 if lo == hi else 2]]
            meets = count[0] > 1 if lo == hi else (count[0] > 0) & (count[1] > 0)
            number = np.where(meets, np.cumsum(meets) - 1, -1).astype(np.int32)
            columns = int(meets.sum())
            del count, meets
            left = of_both(*sides[0], number)
            right = left if lo == hi else of_both(*sides[1], number)
            del sides, number
            cl, cr = c[at[0]], c[at[1]]
            for b in range(0, len(cr), tile_rows):
                end = min(b + tile_rows, len(cr))
                wide = -(-(end - b) // 8) * 8
                own = slice(right[0][b], right[0][end])
                by = np.argsort(right[1][own], kind="stable")
                # a posting: its row of the tile and its weight, in one word
                posting = np.empty((len(by), 2), np.int32)
                posting[:, 0] = np.repeat(np.arange(end - b, dtype=np.int32), np.diff(right[0][b:end + 1]))[by]
                posting[:, 1] = right[2][own][by].view(np.int32)
                posting = posting.view(np.int64).ravel()
                start = np.concatenate([[0], np.cumsum(np.bincount(right[1][own], minlength=columns))])
                rest = np.full(wide, -np.inf)
                for a in range(0, end if lo == hi else len(cl), chunk_rows):
                    to = min(a + chunk_rows, len(cl))
                    mine = slice(left[0][a], left[0][to])
                    first, m = start[left[1][mine]], start[left[1][mine] + 1]
                    m -= first
                    some = np.flatnonzero(m)
                    if not len(some):
                        continue
                    m, first = m[some], first[some]
                    row = np.repeat(np.arange(to - a), np.diff(left[0][a:to + 1]))[some]
                    take = np.arange(m.sum())
                    take += np.repeat(first - (np.cumsum(m) - m), m)
                    met = posting[take].view(np.int32)
                    cell = np.repeat(row * wide, m)
                    cell += met[::2]
                    product = np.repeat(left[2][mine][some], m)
                    product *= met[1::2].view(np.float32)
                    dots = np.bincount(cell, product, minlength=(to - a) * wide).reshape(to - a, wide)
                    # no row of the chunk has a larger c than its first
                    rest[:end - b] = np.minimum(cl[a] * cr[b:end], least)
                    hit = dots >= reach - rest
                    # eight cells at a time: few are hit
                    words = np.flatnonzero(hit.reshape(-1).view(np.int64))
                    if not len(words):
                        continue
                    word, bit = np.nonzero(hit.reshape(-1, 8)[words])
                    i, j = np.divmod(words[word] * 8 + bit, wide)
                    both = cl[a + i] * cr[b + j]
                    near = (both < least) & (dots[i, j] + both >= reach)
                    i, j = i[near] + a, j[near] + b
                    if lo == hi:
                        i, j = i[i < j], j[i < j]
                    out.append(np.stack([ids[at[0][i]], ids[at[1][j]]]))
        pairs = np.concatenate(out, axis=1)
        return pa.table({"src": pairs.min(axis=0), "dst": pairs.max(axis=0)})

    return meet


def rare_pairs(rows: DataFrame, t: float, least: float, block_terms: int = BLOCK_TERMS, tile_rows: int = TILE_ROWS, chunk_rows: int = ROWS) -> list[DataFrame]:
    """[(src, dst)], src < dst: the pairs of rows (id, c, rare) whose product of c is less than ``least`` and comes to t or more
    with the dot of their rare terms, in strips. A strip holds the pairs of a few blocks with all: what is shuffled at a time is
    bounded by a multiple of the rows."""
    n, terms = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("rare") / 4), F.lit(0))).first()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    nb = max(1, math.ceil(terms / block_terms), min(n, math.ceil(math.sqrt(4 * cores))))
    step = nb if nb <= max(WHOLE_BLOCKS, math.ceil(math.sqrt(4 * cores))) else STRIP_BLOCKS
    meet = _rare_meet(t, least, tile_rows, chunk_rows)
    dealt = rows.select("id", "c", "rare", F.pmod(F.xxhash64("id"), F.lit(nb)).cast("int").alias("blk"))
    strips = []
    for s in range(0, nb, step):
        # the blocks lo of the strip meet the blocks hi >= lo
        last = min(s + step, nb) - 1
        others = F.when(F.col("blk") <= last, F.sequence(F.lit(s), F.lit(nb - 1))).otherwise(F.sequence(F.lit(s), F.lit(last)))
        rep = dealt.where(F.col("blk") >= s).select("*", F.explode(others).alias("other"))
        rep = rep.select("id", "c", "rare", "blk", F.least("blk", "other").alias("lo"), F.greatest("blk", "other").alias("hi"))
        groups = sum(nb - lo for lo in range(s, last + 1))
        strips.append(rep.repartition(groups, "lo", "hi").groupBy("lo", "hi").applyInArrow(meet, "src long, dst long"))
    return strips


def near_pairs(packed: DataFrame, t: float, ids: DataFrame | None = None, **sizes) -> DataFrame:
    """(src, dst), stored: pairs with an upper bound of their dot of t or more, all pairs with dot >= t among them."""
    top, least = token_split(packed, t)
    coded = stored(coded_vectors(packed if ids is None else packed.join(ids, "id", "left_semi"), top, least), "coded-vectors")
    # stored one by one: the groups' work is done once, and a strip's shuffle goes before the next
    found = [stored(p, "rare-pairs") for p in rare_pairs(coded.select("id", "c", "rare"), t, least, **sizes)]
    found.append(stored(_folded(coded.select("id", "c", "codes").where(F.length("codes") > 0), t, least, chunk_rows=512), "near-pairs"))
    return reduce(DataFrame.unionByName, found)


def packed_similarity_join(packed: DataFrame, eps: float, ids: DataFrame | None = None) -> DataFrame:
    """``sparse_similarity_join`` of packed vectors (id, k, w, df), stored; of ``ids`` (id), if given."""
    t = 1.0 - eps
    if t <= 0:
        raise ValueError("eps >= 1 admits orthogonal pairs; use the dense join")
    pairs = near_pairs(packed, t, ids)
    dist = F.least(F.greatest(F.lit(1.0) - F.col("dot"), F.lit(0.0)), F.lit(2.0))
    return packed_dots(pairs, packed).withColumn("dist", dist).where(F.col("dist") <= F.lit(eps))


#: Vectors of one near group that meet in one cell, and terms of the cells of one task.
CELL_VECTORS = 500
GROUP_TERMS = 2_000_000


def packed_dots(pairs: DataFrame, packed: DataFrame, cell_vectors: int = CELL_VECTORS, group_terms: int = GROUP_TERMS) -> DataFrame:
    """(src, dst, dot): the exact dots of stored ``pairs``.

    Pairs are dealt by the least neighbour of their src, so that those of a group of near copies meet, and a vector
    goes once to each place where it has pairs, not once a pair. A neighbour of very many is dealt into cells of at
    most about ``cell_vectors`` vectors a side. A cell most of whose vectors pair is one matrix product.
    """
    import pandas as pd
    import pyarrow as pa

    near = pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    root = near.groupBy("src").agg(F.least("src", F.min("dst")).alias("root"))
    rooted = stored(pairs.join(root, "src"), "rooted-pairs")
    sizes = rooted.groupBy("root").agg(F.ceil(F.greatest(F.countDistinct("src"), F.countDistinct("dst")) / cell_vectors).alias("cells")).where("cells > 1")
    cell = lambda end: F.pmod(F.xxhash64(end), F.coalesce("cells", F.lit(1)))
    ends = lambda df: df.select("at", F.explode(F.array("src", "dst")).alias("id")).distinct()
    placed = rooted.join(sizes, "root", "left").select("src", "dst", F.xxhash64("root", cell("src"), cell("dst")).alias("cell")).withColumn("at", F.col("cell"))
    terms = ends(placed).join(packed.select("id", (F.length("k") / 8).alias("m")), "id").agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    groups = max(packed.sparkSession.sparkContext.defaultParallelism, math.ceil(terms / group_terms))
    placed = placed.withColumn("at", F.pmod("at", F.lit(groups)).cast("int"))
    vectors = ends(placed).withColumnRenamed("at", "to").join(packed.select("id", "k", "w"), "id")

    def dots(some: pa.Table, vectors: pa.Table) -> pa.Table:
        ids = vectors["id"].to_numpy()
        order = np.argsort(ids)
        (keys, offsets), (w, _) = of_binary(vectors["k"], np.int64), of_binary(vectors["w"], float)
        starts, m = offsets[:-1], np.diff(offsets)
        key, names = pd.factorize(keys)
        src, dst, cells = (some[c].to_numpy() for c in ("src", "dst", "cell"))
        by = np.lexsort((src, cells))
        src, dst, cells = src[by], dst[by], cells[by]
        i, j = (order[np.searchsorted(ids, x, sorter=order)] for x in (src, dst))
        x, out = np.zeros(len(names)), np.zeros(len(i))

        def terms(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """(row's number, term's place) of the terms of vectors."""
            ends = np.cumsum(m[rows])
            return np.repeat(np.arange(len(rows)), m[rows]), np.repeat(starts[rows] - (ends - m[rows]), m[rows]) + np.arange(ends[-1])

        def product(i: np.ndarray, j: np.ndarray) -> np.ndarray | None:
            """The dots by a matrix product, if that is less work."""
            (si, i), (sj, j) = np.unique(i, return_inverse=True), np.unique(j, return_inverse=True)
            work = m[sj][j].sum() * 50.0
            if len(si) * len(sj) * m[si].max() > work:
                return None
            (ri, ti), (rj, tj) = terms(si), terms(sj)
            columns, ci = np.unique(key[ti], return_inverse=True)
            if len(si) * len(sj) * len(columns) > work:
                return None
            cj = np.minimum(np.searchsorted(columns, key[tj]), len(columns) - 1)
            both = columns[cj] == key[tj]
            rj, tj, cj = rj[both], tj[both], cj[both]
            total = np.zeros((len(si), len(sj)))
            for c in range(0, len(columns), 4096):
                wide = min(4096, len(columns) - c)
                sides = []
                for n, row, place, col in ((len(si), ri, ti, ci), (len(sj), rj, tj, cj)):
                    own = (col >= c) & (col < c + wide)
                    side = np.zeros((n, wide))
                    side[row[own], col[own] - c] = w[place[own]]
                    sides.append(side)
                total += sides[0] @ sides[1].T
            return total[i, j]

        limits = np.flatnonzero(np.diff(cells, prepend=cells[0] - 1, append=cells[-1] + 1)) if len(cells) else np.zeros(1, int)
        for first, last in zip(limits[:-1], limits[1:], strict=True):
            found = product(i[first:last], j[first:last]) if last - first >= 256 else None
            if found is not None:
                out[first:last] = found
                continue
            edges = first + np.flatnonzero(np.diff(src[first:last], prepend=src[first] - 1, append=src[last - 1] + 1))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                own = slice(starts[i[a]], starts[i[a]] + m[i[a]])
                x[key[own]] = w[own]
                for c in range(a, b, 1024):
                    part = j[c:min(b, c + 1024)]
                    ends = np.cumsum(m[part])
                    take = np.repeat(starts[part] - (ends - m[part]), m[part]) + np.arange(ends[-1])
                    out[c:c + len(part)] = np.add.reduceat(x[key[take]] * w[take], ends - m[part])
                x[key[own]] = 0
        return pa.table({"src": src, "dst": dst, "dot": out})

    dealt = lambda df, key: df.repartition(groups, key).groupBy(key)
    return dealt(placed, "at").cogroup(dealt(vectors, "to")).applyInArrow(dots, "src long, dst long, dot double")


def sparse_similarity_join(vec: DataFrame, eps: float, s: float | None = None, use_maxw: bool = False,
                           cell_rows: int | None = None, ids: DataFrame | None = None) -> DataFrame:
    """(src, dst, dot, dist) for src < dst with dist = clip(1 - dot, 0, 2) <= eps.

    ``vec``: (id, token, df, w), unit norm per id; of ``ids`` (id), if given. ``s`` in (0, t], ``use_maxw`` or
    ``cell_rows`` ask for prefix filtering; s trades candidate-join size (larger s, shorter prefixes) against pruning power.
    """
    checkpoint_dir(vec.sparkSession)
    t = 1.0 - eps
    if t <= 0:
        raise ValueError("eps >= 1 admits orthogonal pairs; use the dense join")
    if s is None and not use_maxw and cell_rows is None:
        packed = packed_vectors(vec)
        return packed_similarity_join(stored(packed if ids is None else packed.join(ids, "id", "left_semi"), "packed-vectors"), eps)
    if ids is not None:
        vec = vec.join(ids, "id", "left_semi")
    cell_rows = cell_rows or CELL_ROWS
    s = max(t - 0.1, t / 2) if s is None else min(s, t)
    cells = _cells(prefix_entries(vec, s, use_maxw), cell_rows)
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    side = lambda x: [F.col("w").alias(f"w{x}"), F.col("suf").alias(f"suf{x}"), F.col("after").alias(f"after{x}")]
    a = cells.select(F.col("id").alias("src"), "token", *side("a"), F.col("part").alias("ca"), every.alias("cb"))
    b = cells.select(F.col("id").alias("dst"), "token", *side("b"), every.alias("ca"), F.col("part").alias("cb"))
    near = (F.col("src") < F.col("dst")) & (F.col("sufa") * F.col("sufb") >= F.lit(s - SLACK))
    keep = (a.join(b, ["token", "ca", "cb"]).where(near).groupBy("src", "dst")
            .agg(F.sum(F.col("wa") * F.col("wb")).alias("pd"), F.min(F.col("aftera") * F.col("afterb")).alias("rest"))
            .where(F.col("pd") + F.least("rest", F.lit(s)) >= F.lit(t - SLACK)).select("src", "dst"))
    va = vec.select(F.col("id").alias("src"), "token", F.col("w").alias("wa"))
    vb = vec.select(F.col("id").alias("dst"), "token", F.col("w").alias("wb"))
    dots = (keep.join(va, "src").join(vb, ["dst", "token"])
            .groupBy("src", "dst").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot")))
    dist = F.least(F.greatest(F.lit(1.0) - F.col("dot"), F.lit(0.0)), F.lit(2.0))
    return dots.withColumn("dist", dist).where(F.col("dist") <= F.lit(eps))


# ---------------------------------------------------------------------------
# Dense vectors
# ---------------------------------------------------------------------------
PAIR_SCHEMA = "src long, dst long, dot double, dist double"


def sound_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of the rows with an id and a vector of one or more components, all finite. Others take no part in any
    dense operator; vectors are compared with those of their own length."""
    v = F.col(vec_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(F.col(id_col).isNotNull() & (F.size(vec_col) > 0) & finite).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


#: Bytes of the vectors of one block of the dense joins, and cells of one product.
DENSE_BYTES = 16 << 20
PRODUCT_CELLS = 1 << 21


def _n_blocks(df: DataFrame, n: int, block_rows: int) -> int:
    """Blocks of at most about ``block_rows`` rows, and enough of them that
    their pairs give every core two tasks, also on small tables."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return max(1, math.ceil(n / block_rows), min(n, math.ceil(math.sqrt(4 * cores))))


def _block_pairs(df: DataFrame, id_col: str, vec_col: str, n: int, block_rows: int | None):
    """The vectors grouped by (dim, lo, hi): each goes to the pairs of blocks lo <= hi that its own, blk, is in. Blocks have
    at most about ``block_rows`` rows, by default as many as ``DENSE_BYTES`` hold, so that a vector's copies stay few. Floats
    travel as floats. The groups are dealt to as many tasks (to 2,000): they are small, but work."""
    rows = sound_vectors(df, id_col, vec_col)
    if block_rows is None:
        wide = rows.agg(F.coalesce(F.max(F.size("v")), F.lit(1))).first()[0]
        block_rows = max(1, DENSE_BYTES // (8 * wide))
    nb = _n_blocks(rows, n, block_rows)
    given = df.select(vec_col).schema[0].dataType
    narrow = isinstance(given, ArrayType) and isinstance(given.elementType, FloatType)
    v = F.col("v").cast("array<float>") if narrow else F.col("v")
    base = rows.select("id", v.alias("v"), F.size("v").alias("dim"), F.pmod(F.xxhash64("id"), F.lit(nb)).cast("int").alias("blk"))
    rep = base.select("id", "v", "dim", "blk", F.explode(F.sequence(F.lit(0), F.lit(nb - 1))).alias("other"))
    rep = rep.select("id", "v", "dim", "blk", F.least("blk", "other").alias("lo"), F.greatest("blk", "other").alias("hi"))
    return rep.repartition(min(2000, nb * (nb + 1) // 2), "dim", "lo", "hi").groupBy("dim", "lo", "hi")


def _of_group(key: tuple, table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool]:
    """(ids, vectors, rows of block lo, rows of block hi, whether they are one block) of a group of ``_block_pairs``."""
    dim, lo, hi = (x.as_py() for x in key)
    x = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table["v"].chunks]).astype(np.float64).reshape(-1, dim)
    blk = table["blk"].to_numpy()
    return table["id"].to_numpy(), x, np.flatnonzero(blk == lo), np.flatnonzero(blk == hi), lo == hi


def _chunks(left: np.ndarray, right: np.ndarray):
    """Parts of ``left`` whose products with ``right`` are bounded."""
    step = max(1, PRODUCT_CELLS // max(1, len(right)))
    return (left[a:a + step] for a in range(0, len(left), step))


def _units(x: np.ndarray) -> np.ndarray:
    """The vectors at length 1, or 0: a zero vector's dots are 0."""
    norms = np.linalg.norm(x, axis=1)
    return x / np.where(norms > 0, norms, 1.0)[:, None]


def _near_table(found: list):
    """Pairs, of which each is (ids a, ids b, dots), as rows src < dst."""
    import pyarrow as pa

    a, b, dots = (np.concatenate(x) for x in zip(*found, strict=True))
    return pa.table({"src": np.minimum(a, b), "dst": np.maximum(a, b), "dot": dots, "dist": np.clip(1.0 - dots, 0.0, 2.0)})


_NONE = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def dense_similarity_join(df: DataFrame, eps: float, id_col: str = "vec_id",
                          vec_col: str = "embedding", block_rows: int | None = None,
                          n_rows: int | None = None) -> DataFrame:
    """Exact (src, dst, dot, dist), src < dst, cosine distance <= eps."""
    import pyarrow as pa

    n = df.count() if n_rows is None else n_rows

    def block_pair(key: tuple, table: pa.Table) -> pa.Table:
        ids, x, left, right, same = _of_group(key, table)
        u = _units(x)
        found, told = [_NONE], u[right].T
        for some in _chunks(left, right):
            dots = u[some] @ told
            i, j = np.nonzero(np.clip(1.0 - dots, 0.0, 2.0) <= eps)
            a, b, near = ids[some][i], ids[right][j], dots[i, j]
            keep = a < b if same else slice(None)
            found.append((a[keep], b[keep], near[keep]))
        return _near_table(found)

    return _block_pairs(df, id_col, vec_col, n, block_rows).applyInArrow(block_pair, PAIR_SCHEMA)


def knn_blocked(df: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding",
                block_rows: int | None = None, n_rows: int | None = None,
                metric: str = "euclidean") -> DataFrame:
    """Exact k nearest neighbours (the point itself counts, as in UMAP's graph):
    (id, nbr, dist, rank). Per block pair keep each row's k best, then a
    global row_number <= k per id (planned with a partial group limit)."""
    import pyarrow as pa

    n = df.count() if n_rows is None else n_rows

    def block_pair(key: tuple, table: pa.Table) -> pa.Table:
        ids, m, lo, hi, same = _of_group(key, table)
        out = [_NONE]
        for q, d in ([(lo, hi)] if same else [(lo, hi), (hi, lo)]):
            if len(q) == 0 or len(d) == 0:
                continue
            kk = min(k, len(d))
            told = m[d]
            size, length = (told ** 2).sum(1), np.linalg.norm(told, axis=1)
            for some in _chunks(q, d):
                if metric == "euclidean":
                    sq = (m[some] ** 2).sum(1)[:, None] + size[None, :] - 2 * m[some] @ told.T
                    dist = np.sqrt(np.maximum(sq, 0.0))
                    if same or len(np.intersect1d(ids[some], ids[d])):
                        dist[ids[some][:, None] == ids[d][None, :]] = 0.0
                else:
                    nq = np.linalg.norm(m[some], axis=1)
                    cos = (m[some] @ told.T) / np.outer(np.where(nq > 0, nq, 1), np.where(length > 0, length, 1))
                    dist = np.clip(1.0 - cos, 0.0, 2.0)
                # the k nearest and what ties with the last of them, then order by (dist, id) and keep k per query row
                worst = np.partition(dist, kk - 1, axis=1)[:, kk - 1:kk]
                rows, cols = np.nonzero(~(dist > worst))
                order = np.lexsort((ids[d][cols], dist[rows, cols], rows))
                rows, cols = rows[order], cols[order]
                first = np.searchsorted(rows, np.arange(len(some)))
                best = np.arange(len(rows)) - first[rows] < kk
                rows, cols = rows[best], cols[best]
                out.append((ids[some][rows], ids[d][cols], dist[rows, cols]))
        a, b, dist = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"id": a, "nbr": b, "dist": dist})

    cand = _block_pairs(df, id_col, vec_col, n, block_rows).applyInArrow(block_pair, "id long, nbr long, dist double")
    w = Window.partitionBy("id").orderBy("dist", "nbr")
    return (cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k))


def lsh_plan(n: int, eps: float, recall: float = 0.98, max_bits: int = 16) -> tuple[int, int]:
    """(bands, bits a band): bits grow with log n, so a band's buckets stay
    small; then as many bands as a pair at distance ``eps`` needs to share one
    with probability ``recall``."""
    bits = max(4, min(max_bits, round(math.log2(max(n, 2))) - 5))
    agree = 1 - math.acos(max(-1.0, min(1.0, 1 - eps))) / math.pi
    return max(1, math.ceil(math.log(1 - recall) / math.log1p(-agree ** bits))), bits


def lsh_candidates(df: DataFrame, eps: float, id_col: str = "vec_id", vec_col: str = "embedding",
                   bands: int | None = None, rows_per_band: int | None = None, seed: int = 42, block_rows: int | None = None) -> DataFrame:
    """Approximate mode: random-hyperplane signatures, pairs that agree in a
    band, exact cosine verification (precision 1). ``lsh_plan`` sets the bands
    unless they are given. Each pair of blocks is one bounded group, which
    computes its signatures, meets their bands and verifies there: neither the
    bands of a vector nor the candidates, of which a pair of vectors can be one
    in many bands, are shuffled."""
    import pyarrow as pa

    n = sound_vectors(df, id_col, vec_col).count()
    if bands is None or rows_per_band is None:
        bands, rows_per_band = lsh_plan(n, eps)
    place = 1 << np.arange(rows_per_band, dtype=np.int64)

    def keys(x: np.ndarray, planes: np.ndarray) -> np.ndarray:
        return np.concatenate([((x[k:k + 256] @ planes) >= 0).reshape(-1, bands, rows_per_band) @ place for k in range(0, len(x), 256)]).astype(np.int32)

    def block_pair(key: tuple, table: pa.Table) -> pa.Table:
        ids, x, left, right, same = _of_group(key, table)
        found = [_NONE]
        if len(left) and len(right):
            dim = x.shape[1]
            sig = keys(x, np.random.default_rng([seed, dim]).standard_normal((dim, bands * rows_per_band)))
            u = _units(x)
            orders = [np.argsort(sig[right, b], kind="stable") for b in range(bands)]
            sorted_keys = [sig[right, b][orders[b]] for b in range(bands)]
            told = u[right].T
            for some in _chunks(left, right):
                met = np.zeros((len(some), len(right)), bool)
                for b in range(bands):
                    mine = sig[some, b]
                    start, end = (np.searchsorted(sorted_keys[b], mine, to) for to in ("left", "right"))
                    m = end - start
                    met[np.repeat(np.arange(len(some)), m), orders[b][np.repeat(end - np.cumsum(m), m) + np.arange(m.sum())]] = True
                dots = u[some] @ told
                i, j = np.nonzero(met & (np.clip(1.0 - dots, 0.0, 2.0) <= eps))
                a, c, near = ids[some][i], ids[right][j], dots[i, j]
                keep = a < c if same else slice(None)
                found.append((a[keep], c[keep], near[keep]))
        return _near_table(found)

    return _block_pairs(df, id_col, vec_col, n, block_rows).applyInArrow(block_pair, PAIR_SCHEMA)
