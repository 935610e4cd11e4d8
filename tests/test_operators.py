"""Unit, property and plan tests: one per hazard of the survey (H1-H9),
brute-force checks of the custom algorithms, and plan-shape checks."""
import json
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framelens.functions.text import collapse_ws, mean_hundredths_milli, py_strip, ratio_milli
from framelens.operators import components, inference, ingest, narrative, similarity
from framelens.operators.indexing import dense_index
from framelens.sources.pages import extract_body

WS = [chr(c) for c in list(range(0x09, 0x0E)) + list(range(0x1C, 0x21)) +
      [0x85, 0xA0, 0x1680] + list(range(0x2000, 0x200B)) + [0x2028, 0x2029, 0x202F, 0x205F, 0x3000]]


# --- H3 white space ------------------------------------------------------------
def test_python_whitespace_class(spark):
    assert len(WS) == 29 and all(("a" + w + "b").split() == ["a", "b"] for w in WS)
    samples = ["".join(WS) + "a" + w + w + "b" + "".join(WS) for w in WS] + ["  x  ", "", "​z​"]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    got = df.select(py_strip("s").alias("p"), collapse_ws("s").alias("c")).collect()
    for s, r in zip(samples, got):
        assert r.p == s.strip()
        assert r.c == " ".join(s.split())


# --- H2 rounding ----------------------------------------------------------------
def test_integer_rounding_matches_half_up(spark):
    pairs = [(a, n) for n in range(1, 60) for a in range(0, n + 1)]
    df = spark.createDataFrame(pairs, "a long, n long")
    got = df.select("a", "n", ratio_milli(F.col("a"), F.col("n")).alias("m")).collect()
    for r in got:
        exact = (2000 * r.a + r.n) // (2 * r.n)
        assert r.m == exact
        # differs from Python's round only on exact decimal ties
        if (r.a * 10000) % r.n or (r.a * 10000 // r.n) % 10 != 5:
            assert abs(r.m / 1000 - round(r.a / r.n, 3)) < 1e-9
    sev = spark.createDataFrame([(95 + 5, 2)], "s long, n long").select(
        mean_hundredths_milli(F.col("s"), F.col("n")).alias("m")).first().m
    assert sev == 500


# --- H1 dense index ---------------------------------------------------------------
@pytest.mark.parametrize("buckets", [1, 3, 16])
def test_dense_index_is_0_to_n_in_order(spark, buckets):
    rng = random.Random(buckets)
    keys = rng.sample(range(10 ** 9), 500) + [2 ** 40 + 7, 2 ** 40 + 3]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    got = sorted((r.k, r.row_idx) for r in dense_index(df, "k", "row_idx", n_buckets=buckets).collect())
    assert [i for _, i in got] == list(range(len(keys)))


# --- A8 mode tie goes to the first seen -------------------------------------------
def test_dominant_tactic_first_seen_on_tie(spark):
    rows = spark.createDataFrame(
        [(0, "t", "s", "P1", "b"), (1, "t", "s", "P1", "a"), (2, "t", "s", "P2", "a"), (3, "t", "s", None, "b")],
        "row_idx long, title string, source string, perspective string, tactic_label string")
    labels = spark.createDataFrame([(i, 0) for i in range(4)], "id long, label long")
    d = narrative.narrative_delta(narrative.event_rows(rows, labels)).first()
    assert d.dominant_tactic == "b" and d.agreement_score == 0.5 and d.delta_score == 0.5
    fm = {r.perspective: r.tactics for r in narrative.framing_map(narrative.event_rows(rows, labels)).collect()}
    assert fm == {"P1": ["a", "b"], "P2": ["a"], "Unknown": ["b"]}


# --- connected components and DBSCAN vs brute force --------------------------------
def _components_py(n, edges):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for a, b in edges:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    comp = {}
    for v in {x for e in edges for x in e}:
        r = find(v)
        comp.setdefault(r, []).append(v)
    return {v: min(vs) for vs in comp.values() for v in vs}


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), min_size=1, max_size=60))
def test_components_equal_union_find(spark, edges):
    edges = [(a, b) for a, b in edges if a != b]
    if not edges:
        return
    df = spark.createDataFrame(edges, "src long, dst long")
    got = {r.vertex: r.comp for r in components.connected_components(df).collect()}
    assert got == _components_py(41, edges)


def test_components_long_chain(spark):
    n = 300
    perm = list(range(n))
    random.Random(7).shuffle(perm)
    edges = [(perm[i], perm[i + 1]) for i in range(n - 1)]
    log = []
    got = components.connected_components(spark.createDataFrame(edges, "src long, dst long"), log=log)
    assert {r.comp for r in got.collect()} == {0}
    assert len(log) < 20


def _dbscan_py(n, edges, min_samples):
    nb = {i: set() for i in range(n)}
    for a, b in edges:
        if a != b:
            nb[a].add(b)
            nb[b].add(a)
    core = [len(nb[i]) + 1 >= min_samples for i in range(n)]
    labels = [-1] * n
    k = 0
    for i in range(n):
        if labels[i] != -1 or not core[i]:
            continue
        stack = [i]
        labels[i] = k
        while stack:
            p = stack.pop()
            if not core[p]:
                continue
            for q in nb[p]:
                if labels[q] == -1:
                    labels[q] = k
                    stack.append(q)
        k += 1
    return labels


@pytest.mark.parametrize("min_samples", [2, 3, 4])
def test_dbscan_equals_sequential_algorithm(spark, min_samples):
    rng = random.Random(min_samples)
    n = 80
    edges = sorted({(min(a, b), max(a, b)) for a, b in
                    ((rng.randrange(n), rng.randrange(n)) for _ in range(90)) if a != b})
    pts = spark.createDataFrame([(i,) for i in range(n)], "id long")
    got = components.dbscan(pts, spark.createDataFrame(edges, "src long, dst long"), min_samples)
    got = dict((r.id, r.label) for r in got.collect())
    assert [got[i] for i in range(n)] == _dbscan_py(n, edges, min_samples)


# --- exact similarity joins vs brute force -------------------------------------------
@pytest.mark.parametrize("s", [0.3, 0.5, 0.6])
def test_prefix_join_equals_brute_force(spark, s):
    rng = np.random.default_rng(3)
    n, vocab = 120, 40
    rows, dense = [], np.zeros((n, vocab))
    for i in range(n):
        toks = rng.choice(vocab, size=rng.integers(1, 8), replace=False)
        w = rng.random(len(toks)) + 0.05
        w /= np.linalg.norm(w)
        dense[i, toks] = w
    df_tok = (dense > 0).sum(0)
    for i in range(n):
        for t in np.nonzero(dense[i])[0]:
            rows.append((i, f"t{t:03d}", int(df_tok[t]), float(dense[i, t])))
    vec = spark.createDataFrame(rows, "id long, token string, df long, w double")
    eps = 0.4
    got = {(r.src, r.dst) for r in similarity.sparse_similarity_join(vec, eps, s).collect()}
    cos = dense @ dense.T
    want = {(i, j) for i in range(n) for j in range(i + 1, n) if min(max(1 - cos[i, j], 0), 2) <= eps}
    assert got == want and len(want) > 0


def test_dense_join_and_knn_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((150, 8))
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(150)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = u @ u.T
    want = {(i, j) for i in range(150) for j in range(i + 1, 150) if 1 - cos[i, j] <= 0.5}
    got = {(r.src, r.dst) for r in similarity.dense_similarity_join(df, 0.5, block_rows=40).collect()}
    assert got == want
    knn = similarity.knn_blocked(df, 5, block_rows=40).collect()
    d = np.linalg.norm(x[:, None, :] - x[None, :, :], axis=2)
    for r in knn:
        order = sorted(range(150), key=lambda j: (d[r.id, j] if j != r.id else 0.0, j))
        assert r.nbr == order[r.rank - 1]


def test_lsh_precision_one_and_recall(spark):
    rng = np.random.default_rng(9)
    base = rng.standard_normal((40, 16))
    x = np.vstack([base + 0.05 * rng.standard_normal((40, 16)) for _ in range(3)])
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(len(x))], "vec_id long, embedding array<double>")
    exact = {(r.src, r.dst) for r in similarity.dense_similarity_join(df, 0.1).collect()}
    approx = {(r.src, r.dst) for r in similarity.lsh_candidates(df, 0.1, bands=12, rows_per_band=4).collect()}
    assert approx <= exact and len(approx) >= 0.9 * len(exact)


# --- answers: the parser table ----------------------------------------------------------
def test_answer_parser_table(spark):
    cases = [
        (0, '```json\n[{"id": 0, "tactic_label": "Disinformation", "confidence": 0.5}]\n```'),
        (1, '```[{"id": 1, "reasoning": "a json x"}]```'),
        (2, '{"id": 2, "tactic_label": "Disinformation"}'),
        (3, '[{"id": 3}]'),
        (4, '[{"id": 4, "tactic_label": null, "specific_technique": null}]'),
        (5, '[{"id": 0, "tactic_label": "Victim-Blaming"}]'),
        (6, '[{"id": -1}, {"id": 99}, {"id": 2.0}, {"id": "3"}, {"id": 7, "confidence": "x"}, 5]'),
        (7, '[{"id": 1, "t'),
        (8, ''),
        (9, '[{"id": 8, "confidence": "0.25"}]'),
    ]
    ans = spark.createDataFrame([(b, "SUCCESS", a) for b, a in cases], "batch_index long, status string, answer string")
    p = {(r.batch_index, r.pos): r for r in inference.parse_answers(ans, 10).collect()}
    assert p[(0, 0)].tactic_label == "Disinformation" and p[(0, 0)].confidence == 0.5
    assert p[(1, 0)].reasoning == "a  x"  # first 'json' removed anywhere, kept literally
    assert not any(b == 2 for b, _ in p)  # object, not array: ignored
    r3 = p[(3, 0)]
    assert (r3.tactic_label, r3.specific_technique, r3.confidence, r3.reasoning) == \
        ("Neutral Reporting", "None", 0.0, "")
    assert p[(4, 0)].tactic_label is None and p[(4, 0)].specific_technique is None
    q = [p[(6, i)].quarantine for i in range(6)]
    assert q == ["id_out_of_range", "id_out_of_range", "id_not_integer", "id_not_integer",
                 "bad_confidence", "item_not_object"]
    assert not any(b in (7, 8) for b, _ in p)
    assert p[(9, 0)].confidence == 0.25
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(10)], "row_idx long, title string")
    merged = {r.row_idx: r.tactic_label for r in inference.merge_answers(rows, inference.parse_answers(ans, 10)).collect()}
    assert merged[0] == "Victim-Blaming"  # a later batch's answer wins
    assert 4 not in merged  # explicit null label dropped
    assert inference.answer_json('```json\n[1]\n```') == inference.answer_json("[1]") == [1]


def test_retries_and_quota():
    calls = []

    def flaky(payload, attempt):
        calls.append(attempt)
        return "" if attempt < 2 else json.dumps([{"id": 0}])
    assert inference.call_with_retries(flaky, "[]")[:2] == (3, "SUCCESS")

    def broken(payload, attempt):
        return "[{"
    assert inference.call_with_retries(broken, "[]")[1] == "FAILED"

    def quota(payload, attempt):
        raise inference.QuotaExhausted("spent")
    assert inference.call_with_retries(quota, "[]")[:2] == (1, "QUOTA_EXHAUSTED")


# --- H4 HTML -----------------------------------------------------------------------------
@pytest.mark.parametrize("html,want", [
    ("<p>one</p><div><p>two <b>b</b></p></div>", "one twob"),                     # no <article>
    ("<article><p>first</p></article><article><p>second</p></article>", "first"),  # first article only
    ("<article><nav><p>menu</p></nav><p>ok</p><figure><p>cap</p></figure></article>", "ok"),  # junk inside
    ("<article><p>a<p>b</p></article>", "ab b"),                                   # nested p repeats
    ("", ""),                                                                      # empty page
    ("<article><p>x &amp; y<!-- c --></p><script>var a='<p>s</p>'</script></article>", "x & y"),
])
def test_html_extraction(html, want):
    assert extract_body(html) == want


def test_html_cap_and_job(spark):
    html = "<article><p>" + "word " * 1000 + "</p></article>"
    assert len(extract_body(html)) == 1500
    from framelens.sources.pages import page_bodies
    df = spark.createDataFrame([(1, html, 200), (2, html, 404)], "page_id long, html string, status int")
    got = {r.page_id: r.body for r in page_bodies(df, status_col="status").collect()}
    assert len(got[1]) == 1500 and got[2] == ""


def test_page_bodies_query_keeps_whole_bodies(spark, tmp_path):
    from framelens.plans.catalog import QUERIES
    html = "<article><p>" + "word " * 1000 + "</p></article>"
    spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert QUERIES["page_bodies"](spark, str(tmp_path)).first().body == " ".join(["word"] * 1000)


# --- ingest semantics --------------------------------------------------------------------
def test_keep_first_dedupe_and_conflicts(spark):
    df = spark.createDataFrame(
        [(0, None, "s", "a"), (1, None, "s", "b"), (2, "x", "s", "c"), (3, "x", "s", "d"),
         (4, "y <<<<<<< HEAD", "s", "e"), (5, "z", "s", "")],
        "_order long, title string, source string, full_text string")
    out = ingest.clean_articles(df).orderBy("row_idx").collect()
    assert [(r.title, r.full_text, r.row_idx) for r in out] == [(None, "a", 0), ("x", "c", 1), ("z", "z", 2)]


def test_feed_topk_cuts_before_blank_filter(spark):
    rows = [("f", i, " " if i == 0 else f"t{i}") for i in range(45)]
    df = spark.createDataFrame(rows, "source string, pos long, title string")
    got = [r.pos for r in ingest.feed_topk(df, 40).orderBy("pos").collect()]
    assert got == list(range(1, 40))


# --- plans ---------------------------------------------------------------------------------
def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_have_no_cartesian_and_use_bounded_broadcasts(spark):
    from framelens import fixtures as fx
    from framelens.operators import tfidf
    sf = "/root/testdata/sf0.001"
    vec = tfidf.tfidf(fx.table(spark, sf, "documents"), "doc_id", "text", n_docs=200)
    p = _plan(similarity.sparse_similarity_join(vec, 0.4))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    rows = fx.articles(spark, sf)
    labels = spark.createDataFrame([(0, 0)], "id long, label long")
    assert "BroadcastHashJoin" in _plan(narrative.event_rows(rows, labels))
    top = ingest.feed_topk(fx.feed_entries(spark, sf))
    assert "WindowGroupLimit" in _plan(top)


def test_partition_count_invariance(spark):
    import __spark_entry__ as E
    q = E.queries()["event_labels"]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    res = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        res.append(sorted(tuple(r) for r in q(spark, "/root/testdata/sf0.001").collect()))
    spark.conf.set("spark.sql.shuffle.partitions", old)
    assert res[0] == res[1]


# --- 3D map and fuzzy graph properties ------------------------------------------------------
def test_pca_axes_and_fuzzy_graph(spark):
    from framelens.operators import projection
    rng = np.random.default_rng(2)
    x = rng.standard_normal((200, 6)) * np.array([5, 3, 2, 0.5, 0.2, 0.1])
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(200)], "vec_id long, embedding array<double>")
    coords, axes = projection.pca_coordinates(df, "vec_id", "embedding")
    assert np.allclose(axes.T @ axes, np.eye(3), atol=1e-8)
    c = np.array([[r.x, r.y, r.z] for r in coords.collect()])
    v = c.var(axis=0)
    assert v[0] >= v[1] >= v[2] and abs(c.mean(axis=0)).max() < 1e-8
    knn = similarity.knn_blocked(df, 10)
    g = projection.fuzzy_graph(knn, 10).collect()
    w = np.array([r.w for r in g])
    assert len(g) > 0 and (w > 0).all() and (w <= 1 + 1e-12).all()
    assert all(r.src < r.dst for r in g)


def test_sigma_solves_log2k():
    from framelens.operators.projection import _smooth_knn
    d = np.sort(np.random.default_rng(1).random((5, 9)), axis=1) + 0.1
    rho, sigma = _smooth_knn(d, 10)
    s = np.exp(-np.maximum(d - rho[:, None], 0) / sigma[:, None]).sum(axis=1)
    assert np.allclose(s, math.log2(10), atol=1e-6)


def test_report_round_trip_with_coords_and_maps(spark):
    from framelens.plans import catalog
    from framelens.session import staging_path
    from framelens.sources import report
    from framelens.schema import META_SCHEMA, assert_schema
    path = staging_path(spark, "report-test")
    catalog.write_report(spark, "/root/testdata/sf0.001", path)
    meta, events, heads = report.narratives(spark, path)
    m = assert_schema(meta, META_SCHEMA).first()
    assert m.total_headlines == sum(m.tactic_distribution.values()) == sum(m.source_distribution.values())
    assert events.count() == heads.select("event_id").distinct().count()
    assert heads.where("x IS NULL OR y IS NULL OR z IS NULL").count() == 0
    one = events.orderBy("rank").first().event_id
    d = report.event_detail(events, heads, one).first()
    assert len(d.headlines) == d.headline_count
    with pytest.raises(FileNotFoundError):
        report.narratives(spark, path + "-missing")


def test_hot_tokens_split_and_copies_collapsed(spark):
    from framelens.operators import components, similarity, tfidf
    words = ["alpha", "beta", "gamma", "delta", "omega"]
    rows = [(k, " ".join(["common", "shared", *words[:k % 4], f"own{k // 3}"])) for k in range(60)] + [(99, ""), (100, None)]
    docs = spark.createDataFrame(rows, "id long, text string")
    vec = tfidf.tfidf(docs, "id", "text").checkpoint()
    pairs = lambda **kw: {(r.src, r.dst): round(r.dist, 6) for r in similarity.sparse_similarity_join(vec, 0.4, **kw).collect()}
    whole = pairs(cell_rows=10_000)
    assert whole and pairs(cell_rows=3) == whole
    again = spark.createDataFrame([(i + 1000 * c, t) for c in range(3) for i, t in rows], "id long, text string")
    vec = tfidf.tfidf(again, "id", "text").checkpoint()
    classes = similarity.vector_classes(vec).checkpoint()
    assert all(r.n >= 3 and r.rep <= r.id for r in classes.collect())
    every = similarity.sparse_similarity_join(vec, 0.4).select("src", "dst").checkpoint()
    reps = similarity.sparse_similarity_join(similarity.representatives(vec, classes), 0.4).select("src", "dst").checkpoint()
    assert reps.count() < every.count() / 4
    for least in (2, 8, 30):
        plain = {tuple(r) for r in components.dbscan(again, every, least).collect()}
        assert {tuple(r) for r in components.dbscan(again, reps, least, members=classes).collect()} == plain


def test_translation_in_pieces_loses_nothing(spark):
    from framelens.operators import ingest
    text = "".join(chr(97 + k % 26) + ("\n" if k % 97 == 0 else "é") for k in range(1500))
    df = spark.createDataFrame([("fr", text), ("en", text), ("fr", ""), ("fr", None)], "lang string, text string")
    got = df.select("lang", ingest.translate_route(F.col("text"), F.col("lang"), lambda p: F.concat(p, F.lit("|"))).alias("t")).collect()
    assert got[0].t.replace("|", "") == text and got[0].t.count("|") == -(-len(text) // 800)
    assert got[1].t == text and got[2].t == "" and got[3].t is None


def test_fuzzy_weights_do_not_depend_on_other_rows_of_the_batch(spark):
    from framelens.operators import projection
    short = [(1, 2, 0.5, 2), (1, 3, 0.9, 3)]
    full = [(10, 20 + k, 0.1 * (k + 1), k + 2) for k in range(9)]
    graph = lambda rows: {(r.src, r.dst): round(r.w, 9) for r in projection.fuzzy_graph(
        spark.createDataFrame(rows, "id long, nbr long, dist double, rank int").coalesce(1), 10).collect()}
    alone = graph(short)
    assert {k: v for k, v in graph(short + full).items() if k[0] == 1} == alone
