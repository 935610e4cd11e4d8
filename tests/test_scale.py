"""What is shuffled and stored must grow no faster than the input: plan shapes, and the rewritten steps held against the plain ones."""
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelens.operators import similarity, tfidf


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def texts(spark):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(240):
        words = [f"w{int(w)}" for w in rng.zipf(1.4, rng.integers(3, 60)) % 500]
        rows.append((i, " ".join(words)))
        if i % 4 == 0:  # near copies
            rows.append((1000 + i, " ".join(words[:-1] + ["changed"])))
    rows += [(2000, rows[0][1]), (2001, ""), (2002, None), (1, "a second row of id 1")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_term_weights_equal_plain_joins(spark, texts):
    """the same rows as by joins, and no shuffle of the (id, token) rows but for the (part, token) ones."""
    tf = tfidf.term_counts(texts)
    plain = tf.join(tf.groupBy("token").agg(F.count(F.lit(1)).alias("df")), "token")
    want = {(r.id, r.token): (r.tf, r.df) for r in plain.collect()}
    vec = tfidf.tfidf(texts, hashed=False)
    assert {(r.id, r.token): (r.tf, r.df) for r in vec.collect()} == want
    norms = vec.groupBy("id").agg(F.sum(F.col("w") * F.col("w")).alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-9 for r in norms)
    keys = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", _plan(vec))
    assert keys and not any("id#" in k for k in keys)


@pytest.mark.parametrize("t", [0.3, 0.6, 0.9])
def test_folded_join_equals_prefix_join(spark, texts, t):
    """Blocks and chunks of any size give the pairs of the prefix join, with their dots."""
    vec = tfidf.tfidf(texts).checkpoint()
    near = lambda df: {(r.src, r.dst): round(r.dist, 9) for r in df.collect()}
    want = near(similarity.sparse_similarity_join(vec, 1 - t, s=t))
    assert len(want) > 20 and near(similarity.sparse_similarity_join(vec, 1 - t)) == want
    packed = similarity.packed_vectors(vec).checkpoint()
    pairs = similarity.folded_pairs(packed, t, block_terms=900, chunk_rows=7).checkpoint()
    assert set(want) <= {(r.src, r.dst) for r in pairs.collect()} and pairs.count() == pairs.distinct().count()
    dots = similarity.packed_dots(pairs, packed, cell_vectors=3, group_terms=300).where(F.col("dot") >= t)
    assert {(r.src, r.dst): round(1 - r.dot, 9) for r in dots.collect()} == want


def test_folded_join_has_no_candidate_shuffle(spark, texts):
    """No join on tokens and no aggregate per candidate pair is left: only bounds of t or more leave a group."""
    packed = similarity.packed_vectors(tfidf.tfidf(texts)).checkpoint()
    p = _plan(similarity.folded_pairs(packed, 0.6))
    assert "FlatMapGroupsInArrow" in p and "Join" not in p and "src" not in p.split("FlatMapGroupsInArrow")[0].replace("src#", "")


def test_folded_join_of_nothing(spark):
    none = spark.createDataFrame([], "id long, token string, df long, w double")
    assert similarity.sparse_similarity_join(none, 0.4).count() == 0
    one = spark.createDataFrame([(1, "a", 1, 1.0)], none.schema)
    assert similarity.sparse_similarity_join(one, 0.4).count() == 0


def test_phrase_df_without_gram_shuffle(spark, texts):
    """df as counted plainly, and grams themselves are not shuffled."""
    from framelens.functions.text import tokens
    from framelens.operators import phrases
    t = texts.select(F.col("doc_id").alias("id"), tokens("text").alias("tok"))
    g = t.select("id", F.explode(F.concat(*[phrases.ngrams(F.col("tok"), k) for k in (2, 3, 4)])).alias("gram"))
    tf = g.groupBy("id", "gram").agg(F.count(F.lit(1)).alias("tf"))
    sc = tf.join(tf.groupBy("gram").agg(F.count(F.lit(1)).alias("df")), "gram")
    best, n = {}, texts.count()
    for r in sc.collect():
        k = (-(r.tf * np.log((n + 1.0) / (r.df + 1.0))).round(9), r.gram)
        best[r.id] = min(best.get(r.id, ((1.0,), ())), (k, (r.gram, r.tf, r.df)))
    found = phrases.key_phrases(texts)
    assert {r.id: (r.phrase, r.tf, r.df) for r in found.collect()} == {i: b[1] for i, b in best.items()}
    keys = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", _plan(found))
    assert keys and not any("gram#" in k or "id#" in k for k in keys)


def test_translated_rows_that_pass_through_share_no_key(spark, tmp_path):
    """English, null and empty texts met under one null key of a join, in one task."""
    from framelens.operators.translate import translate_texts
    from framelens.sources.snapshots import Snapshots
    rows = [(i, "en" if i % 3 else "fr", f"text {i % 7}") for i in range(60)] + [(60, "fr", ""), (61, "fr", None), (62, None, "x"), (62, None, "x")]
    df = spark.createDataFrame(rows, "id long, lang string, text string")
    out = translate_texts(df, lambda pieces, lang: [f"<{lang}>{p}" for p in pieces], Snapshots(spark, str(tmp_path)))
    want = sorted((i, t if lang == "en" or not t else f"<{lang or ''}>{t}") for i, lang, t in rows if t is not None)
    got = out.collect()
    assert sorted((r.id, r.text) for r in got if r.text is not None) == want and len(got) == len(rows)
    p = _plan(out)
    assert "Union" in p.split("Join")[0]


def test_landed_batches_grow_in_files(spark):
    """a landed batch was four files whatever its size."""
    from framelens.plans import catalog
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "37")
        assert catalog._landed_files(spark) == 37
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_knn_ties_and_lsh_in_blocks(spark):
    """ties at the last place go to the smaller id. F9, F11: the LSH mode in blocks gives the pairs of its bands, copies of ids as before."""
    rng = np.random.default_rng(4)
    x = np.vstack([np.repeat(rng.integers(-1, 2, (12, 3)), 6, axis=0), rng.standard_normal((40, 3))]).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(500, [0.0, 0.0])], "vec_id long, embedding array<double>")
    got = {}
    for r in similarity.knn_blocked(df.where("vec_id < 500"), 5, block_rows=20).collect():
        got[r.id, r.rank] = r.nbr
    d = np.sqrt(np.maximum((x ** 2).sum(1)[:, None] + (x ** 2).sum(1)[None, :] - 2 * x @ x.T, 0)).round(6)
    for i in range(60):
        dist = [0.0 if j == i else d[i, j] for j in range(len(x))]
        assert sorted(round(dist[got[i, r]], 6) for r in range(1, 6)) == sorted(dist)[:5]
    y = rng.standard_normal((90, 8))
    vec = spark.createDataFrame([(i, (y[i % 30] + 0.1 * y[i]).tolist()) for i in range(90)], "vec_id long, embedding array<double>")
    pairs = [{(r.src, r.dst) for r in similarity.lsh_candidates(vec, 0.2, bands=8, rows_per_band=4, block_rows=b).collect()} for b in (7, 4096)]
    exact = {(r.src, r.dst) for r in similarity.dense_similarity_join(vec, 0.2).collect()}
    assert pairs[0] == pairs[1] <= exact and len(pairs[0]) > 0.8 * len(exact)
    p = _plan(similarity.lsh_candidates(vec, 0.2))
    assert "Join" not in p


@pytest.mark.parametrize("t,share", [(0.3, 0.02), (0.6, 0.3)])
def test_rare_and_folded_pairs_hold_all_near_pairs(spark, texts, t, share, monkeypatch):
    """Rare terms in strips and folded ranges give each near pair once, wherever rare ends."""
    packed = tfidf.packed_tfidf(texts).checkpoint()
    vec = tfidf.tfidf(texts).checkpoint()
    want = {(r.src, r.dst): round(r.dist, 9) for r in similarity.sparse_similarity_join(vec, 1 - t, s=t).collect()}
    monkeypatch.setattr(similarity, "RARE_SHARES", [share])
    monkeypatch.setattr(similarity, "FOLD_COST", 1e9)
    monkeypatch.setattr(similarity, "WHOLE_BLOCKS", 0)
    monkeypatch.setattr(similarity, "STRIP_BLOCKS", 2)
    w = tfidf.weighted(packed)
    pairs = similarity.near_pairs(w, t, block_terms=250, tile_rows=20, chunk_rows=7).checkpoint()
    assert set(want) <= {(r.src, r.dst) for r in pairs.collect()} and pairs.count() == pairs.distinct().count()
    got = {(r.src, r.dst): round(r.dist, 9) for r in similarity.packed_similarity_join(w, 1 - t).collect()}
    assert got == want
    coded = similarity.coded_vectors(w, 4, 0.5).checkpoint()
    strips = similarity.rare_pairs(coded, t, 0.5, block_terms=60)
    assert len(strips) > 1 and "Join" not in _plan(strips[0])


def test_packed_terms_equal_long_ones(spark, texts):
    """One row per id holds the rows of ``tfidf``, rows of one id or of a null id together; classes and hashed slots too."""
    from framelens.operators import projection
    more = texts.unionByName(spark.createDataFrame([(None, "w1 w2 w2"), (None, "w3 own"), (5000, "w2 w1 w2")], texts.schema))
    vec = tfidf.tfidf(more).select("*", F.xxhash64("token").alias("k")).checkpoint()
    packed = tfidf.packed_tfidf(more, slots=16).checkpoint()
    got = {}
    for r in packed.collect():
        for k, tf, df in zip(np.frombuffer(r.k, np.int64), np.frombuffer(r.tf, np.int32), np.frombuffer(r.df, np.int32), strict=True):
            got[r.id, int(k)] = (int(tf), int(df), round(float(tf * np.log((r.n + 1) / (df + 1.0)) / r.norm), 9))
    assert got == {(r.id, r.k): (r.tf, r.df, round(r.w, 9)) for r in vec.collect()}
    plain = {tuple(r) for r in similarity.vector_classes(vec).collect()}
    assert {tuple(r) for r in similarity.packed_classes(packed).collect()} == plain
    dense = {r.id: np.round(r.v, 9).tolist() for r in projection.hashed_dense(vec, 16).collect()}
    assert {r.id: np.round(r.v, 9).tolist() for r in packed.collect()} == dense
    assert not any("token" in k for k in re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", _plan(tfidf.packed_tfidf(more))))


def test_stored_tables_leave_no_shuffle_files(spark):
    """The shuffle files of a stored step stayed until the driver collected its garbage."""
    from framelens import session
    seen = []
    class Spy:
        def __init__(self, df):
            self.df = df
        def __getattr__(self, name):
            seen.append((name, spark.conf.get(session.CLEANUP, None)))
            return getattr(self.df, name)
    before = spark.conf.get(session.CLEANUP, None)
    out = session.stored(Spy(spark.range(50).repartition(3, "id")), "spied")
    assert out.count() == 50 and ("write", "true") in seen and spark.conf.get(session.CLEANUP, None) == before


def test_phrases_make_no_row_a_gram(spark):
    """grams were exploded into rows and sorted; a part counts them at once. Ties go to the smallest text, a shorter gram first."""
    from framelens.operators import phrases
    rows = [(1, "b a c"), (2, "b a"), (2, "z b a"), (3, "one"), (4, ""), (None, "n n n"), (5, "ab c abd e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = phrases.key_phrases(docs)
    assert "Generate" not in _plan(found)
    assert {r.id: (r.phrase, r.tf, r.df) for r in found.collect()} == {
        1: ("a c", 1, 1), 2: ("b a", 2, 2), None: ("n n", 2, 1), 5: ("ab c", 1, 1)}


@pytest.mark.parametrize("join", ["dense_similarity_join", "lsh_candidates", "knn_blocked"])
def test_dense_copies_stay_few(spark, join):
    """Blocks of 4,096 rows made a vector go to 176 groups of 720,000 vectors."""
    assert similarity.DENSE_BYTES // (8 * 64) > 30_000
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "vec_id long, embedding array<float>")
    more = {"n_rows": 720_000} if join != "lsh_candidates" else {}
    p = _plan(getattr(similarity, join)(df, 0.5 if join != "knn_blocked" else 2, **more))
    assert "FlatMapGroupsInArrow" in p and "array<float>" in p
    groups = max(int(x) for x in re.findall(r"hashpartitioning\(dim#\d+, lo#\d+L?, hi#\d+L?, (\d+)\)", p))
    assert groups < 200


def test_descent_blocks_fit_a_worker(spark):
    """What the vectors of a block's places may come to, and vectors that come in several batches."""
    import pyarrow as pa

    from framelens.operators import nndescent
    blocks = nndescent._blocks(spark.range(1), 720_000, 30, 64 * 4 + 40)
    assert 720_000 / blocks * 60 * (64 * 4 + 40) <= 50 << 20
    part = lambda ids: pa.table({"vec": ids, "v": [[float(i), 0.0] for i in ids], "worst": [float(i) for i in ids]})
    ids, x, worst = nndescent._sides(pa.concat_tables([part([5, 1]), part([3]), part([0, 9])]))
    assert ids.tolist() == [0, 1, 3, 5, 9] == x[:, 0].tolist() == worst.tolist()
