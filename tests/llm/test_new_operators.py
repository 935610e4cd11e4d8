"""Operators 11 to 13 against brute force, held-out labels, and on odd tables."""
import hashlib
import itertools
import math
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from framelens.llm import hardnegatives, langid, queries, toxicity, vafile
from tests.conftest import SF_MID
from tests.conftest import SF_SMALL as SMALL


# 11
def _clean(text):
    low = "".join(c if unicodedata.category(c)[0] == "L" else " " for c in (text or "").lower())
    return " ".join(low.split())


def _greedy(text, known):
    """Phrases of one segment by substring search."""
    n, at = 0, 0
    while at < len(text):
        end = at + 1
        while end < len(text) and any(text[at:end + 1] in k for k in known):
            end += 1
        n, at = n + 1, end
    return n


def test_langid_phrases_against_substring_search():
    rng = random.Random(3)
    known = {k: ["".join(rng.choices(letters, k=80)) for _ in range(3)] for k, letters in (("a", "abc de"), ("b", "abxy z"), ("c", "éü a"))}
    seen = sorted({c for parts in known.values() for p in parts for c in _clean(p)} - {" "})
    edges, roots, lengths, states = [], [], [], 0
    symbol = {c: k + 2 for k, c in enumerate(seen)} | {" ": langid.SPACE}
    for parts in known.values():
        line = [s for p in parts for s in (*(symbol[c] for c in _clean(p)), langid.SPACE, 0)]
        go = langid.suffix_automaton(line)
        edges += [(a + states, c, b + states) for a, row in enumerate(go) for c, b in row.items() if c]
        roots.append(states)
        lengths.append(len(line))
        states += len(go)
    model = langid.LanguageModel(list(known), lengths, [ord(c) for c in seen], np.array(edges), roots)
    texts = ["".join(rng.choices("abc dexyzéüQß!1\n", k=rng.choice([0, 1, 5, 200, 2500]))) for _ in range(60)] + ["", "12 !", "   abc", "QQQ"]
    got, size = langid.Parser(model).phrases(texts)
    for n, t in enumerate(texts):
        line = _clean(t) + " " if _clean(t) else ""
        assert size[n] == len(line)
        segments = [line[a:a + langid.SEGMENT] for a in range(0, len(line), langid.SEGMENT)]
        for k, parts in enumerate(known.values()):
            assert got[k, n] == sum(_greedy(s, [_clean(p) + " " for p in parts]) for s in segments)


def test_langid_held_out(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    got = queries.op11_langid(spark, SF_MID)
    rows = got.join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    tested = [r.lang_pred == r.lang for r in rows if r.held_out]
    assert len(tested) > 100 and sum(tested) / len(tested) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_langid_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, _whole string, lang_pred string, score int"
    rows = [(k, "the cat and the dog " * 5, "en", "s", "x", "y", 1) for k in range(20)] + [(100 + k, "der hund und die katze " * 5, "de", "s", None, "y", 1) for k in range(20)]
    odd = [(None, "the dog", "de", None, "x", "y", 1), (200, None, "en", "s", "x", "y", 1), (201, "", "de", "s", "x", "y", 1), (202, " 12, !\n", "de", "s", "x", "y", 1),
           (203, "der hund " * 60_000, None, "s", "x", "y", 1), (3, "the cat", "en", "s", "x", "y", 1), (204, "日本語", None, "s", "x", "y", 1), (205, "İ the cat", None, "s", "x", "y", 1)]
    docs = spark.createDataFrame(rows + odd, schema).repartition(5)
    model = langid.train(docs)
    assert model.languages == ["de", "en"]
    got = langid.predict(docs, model).collect()
    assert len(got) == len(rows + odd)
    by = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert by[None][0] == "en" and by[203][0] == "de" and by[205][0] == "en"
    assert by[200] == by[201] == by[202] == ("und", 0.0)
    assert by[204][0] in ("de", "en")
    none = langid.train(docs.where("doc_id < 0"))
    assert {(r.lang_pred, r.score) for r in langid.predict(docs, none).collect()} == {("und", 0.0)}
    one = langid.train(docs.where("lang = 'en'"))
    assert {r.score for r in langid.predict(docs.where("doc_id < 20"), one).collect()} == {1.0}
    assert langid.predict(docs.limit(0), model).collect() == []
    # the same whatever the partitioning
    again = langid.train(docs.repartition(1))
    assert again.languages == model.languages and again.lengths == model.lengths and (again.edges == model.edges).all()


def test_langid_sample_is_bounded_and_from_all_parts(spark):
    docs = spark.createDataFrame([(k, "".join(chr(97 + (k + j // 512) % 26) for j in range(20_000)), "en") for k in range(30)], "doc_id long, text string, lang string")
    found = langid._pieces(docs, F.lit(True), 16 * langid.PIECE, 5)
    assert 8 <= len(found) <= 16 and len({r.piece[0] for r in found}) > 5


# 12
def _floor(v, factor=256):
    return [math.floor(factor * float(x)) for x in v]


def _lloyd(rows, k, rounds, mark=None):
    """rows: (id, vector as whole numbers); start centroids are the first k by ``mark``, by default the sorted hashes."""
    mark = mark or (lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[0] or 0, r[1]))
    centroids = [r[1] for r in sorted(rows, key=mark)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, v in rows:
            groups.setdefault(near(v)[1], []).append(v)
        for n, vs in groups.items():
            centroids[n] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    return sorted(((i, near(v)[1], near(v)[0]) for i, v in rows), key=str), centroids


EMB = "vec_id long, embedding array<float>, label int, key int, cells string, cluster int, id string, v int"


def _order():
    return F.sha2(F.concat(F.lit("2:"), F.col("id").cast("string")), 256)


def test_centroids_odd_rows(spark):
    rng = random.Random(5)
    vec = lambda: [rng.gauss(0, 0.3) for _ in range(4)]
    good = [(k, vec()) for k in range(60)] + [(3, vec()), (7, [0.0] * 4), (8, [0.0] * 4), (None, vec()), (None, vec())]
    good += [good[5], good[6]]
    bad = [(90, None), (91, [1.0, 2.0]), (92, []), (93, [1.0, float("nan"), 0.0, 0.0]), (94, [float("inf")] * 4), (95, [None, 1.0, 1.0, 1.0]), (96, [3e38, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1, 2, "c", 3, "i", 4) for i, v in good + bad], EMB).repartition(7)
    for bits, k, rounds in ((2, 6, 4), (6, 6, 0), (8, 100, 2)):
        found = vafile.k_means(df, k=k, rounds=rounds, order=_order(), dim=4, bits=bits, sample_rows=30)
        want, centroids = _lloyd([(i, _floor(np.float32(v))) for i, v in good], k, rounds)
        assert sorted(((r.id, r.cluster, r.distance) for r in found.rows.collect()), key=str) == want
        assert found.centroids.tolist() == centroids
    rows = vafile.digest(found).collect()
    assert len(rows) == len(good) and {r.inertia for r in rows} == {sum(w[2] for w in want)}
    empty = vafile.k_means(df.limit(0), k=3, rounds=2, order=_order(), dim=4)
    assert vafile.digest(empty).collect() == []


def test_centroids_fetch_only_open_vectors(spark):
    """Of well separated groups, the cells settle nearly all vectors."""
    rng = np.random.default_rng(1)
    middle = rng.normal(0, 1, (8, 16))
    rows = [(k, (middle[k % 8] + rng.normal(0, 0.05, 16)).tolist()) for k in range(2000)]
    found = vafile.k_means(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=8, rounds=4, order=F.col("id"), dim=16)
    assert max(found.fetched) < 50  # one start in each group
    want, centroids = _lloyd([(i, _floor(v)) for i, v in rows], 8, 4, lambda r: r[0])
    assert found.centroids.tolist() == centroids


# 13
def _mine(rows, is_anchor, n, k, low, high):
    rows = sorted({(i, lab, tuple(_floor(v))) for i, lab, v in rows})
    out = []
    for i, lab, v in rows:
        if not is_anchor(i):
            continue
        score = [(-sum(a * b for a, b in zip(v, w, strict=True)), j, m) for j, m, w in rows if j != i and len(w) == len(v)]
        for s, j, _ in sorted(x for x in score if x[2] == lab)[:n]:
            inside = sorted(x for x in score if x[2] != lab and low * -s <= 100 * -x[0] <= high * -s)[:k]
            out += [(i, j, r + 1, x[1], -s, -x[0]) for r, x in enumerate(inside)]
    return sorted(out)


def test_hard_negatives_odd_rows(spark):
    rng = random.Random(9)
    rows = [(k, rng.choice([0, 0, 0, 1, 2]), [rng.choice([-0.5, 0.0, 0.25, 0.3, 0.5]) for _ in range(3)]) for k in range(150)]  # many ties, a hot label
    rows += rows[:5] + [(7, 1, [0.1, 0.2, 0.3]), (200, 0, [1.0, 2.0]), (201, 0, [1.5, 2.0]), (202, 1, [0.8, 1.0])]
    bad = [(None, 1, [0.1] * 3), (300, None, [0.1] * 3), (301, 1, None), (302, 1, []), (303, 1, [0.1, None, 0.1]), (304, 1, [float("nan"), 0.0, 0.0]), (305, 1, [float("inf"), 0.0, 0.0]), (306, 1, [1e30, 0.0, 0.0])]
    schema = "vec_id long, label int, embedding array<double>, id string, key int, v string, slot int, score int, scores int"
    df = spark.createDataFrame([(*r, "x", 1, "y", 2, 3, 4) for r in rows + bad], schema).repartition(4)
    for n, k, low, high in ((5, 3, 50, 95), (2, 1, 0, 100), (4, 10, 80, 90)):
        got = hardnegatives.mine(df, F.col("id") % 5 == 0, F.col("label"), n, k, low, high)
        assert sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in got.collect()) == \
            _mine(rows, lambda i: i % 5 == 0, n, k, low, high)
    assert hardnegatives.mine(df.limit(0), F.col("id") % 5 == 0, F.col("label")).collect() == []
    assert hardnegatives.mine(df, F.lit(False), F.col("label")).collect() == []


def test_hard_negative_grid(spark, monkeypatch):
    """Several anchor groups and row groups give what one cell gives."""
    monkeypatch.setattr(hardnegatives, "ANCHORS", 7)
    monkeypatch.setattr(hardnegatives, "ROWS", 20)
    monkeypatch.setattr(hardnegatives, "STEP", 6)
    rng = random.Random(2)
    rows = [(k, rng.randrange(3), [rng.uniform(-1, 1) for _ in range(5)]) for k in range(120)]
    got = hardnegatives.mine(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), F.col("id") % 4 == 0, F.col("label"))
    assert sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in got.collect()) == \
        _mine(rows, lambda i: i % 4 == 0, 5, 3, 50, 95)


def test_slots_are_disjoint_and_cover_the_windows():
    rng = random.Random(4)
    for _ in range(200):
        p = np.array([rng.randrange(-50, 200) for _ in range(rng.randrange(0, 6))])
        slots = hardnegatives.Slots(p, 50, 95)
        score = np.arange(-60, 210)
        got = slots.of(score)
        kept = sorted((int(x) for x in p if x >= 0), reverse=True)
        for s, j in zip(score.tolist(), got.tolist(), strict=True):
            asking = [n for n, x in enumerate(kept) if 50 * x <= 100 * s <= 95 * x]
            if asking:
                assert j >= max(asking)
            if j >= 0:
                assert 100 * s <= 95 * kept[j] and (j + 1 == len(kept) or 100 * s > 95 * kept[j + 1])


@pytest.mark.parametrize("name", ["op12_centroids", "op13_hard_negatives"])
def test_all_rows_take_part(spark, name):
    got = queries.QUERIES[name](spark, SF_MID)
    n = spark.read.parquet(f"{SF_MID}/embeddings.parquet").count()
    rows = got.select(got.columns[0]).collect()
    assert len({r[0] for r in rows}) == (n if name == "op12_centroids" else len(range(0, n, 50)))
    assert len(list(itertools.chain(rows))) == len(rows)


# extra columns named like what the operators use inside
CLASHING = ["_rate", "_sampled", "_tokens", "_source", "_lang", "_topic", "mix_rate", "tokens", "rate", "sampled", "c_source", "row", "of", "h", "_id", "_h", "_drop", "_all", "_lines", "_dropped", "lines",
            "drop", "left", "_out", "_text", "_seen", "out", "own", "nth", "doc", "_hit", "hit", "id", "fp", "group", "key", "n", "pos", "score"]


def test_stages_with_clashing_columns(spark):
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    plain = spark.read.parquet(f"{SMALL}/documents.parquet").select(*names)
    wide = plain.select("*", *[F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string")).alias(c) for c in CLASHING])
    for name, stage in corpus_pipeline.STAGES:
        want = sorted(map(str, stage(spark, plain, SMALL).select(*names).collect()))
        got = stage(spark, wide, SMALL)
        assert sorted(map(str, got.select(*names).collect())) == want, name
        last = name == "mixing"
        assert set(got.columns) >= set(wide.columns)
        for r in got.collect():
            assert all(r[c] == f"{c} of {r.doc_id}" for c in CLASHING if not (last and c == "mix_rate")), (name, r.doc_id)


def test_toxicity_partitions_without_toxic_texts(spark):
    """Most partitions hold no positive text, some hold no row."""
    docs = spark.createDataFrame([(k, "you vile clown" if k < 6 else f"a calm text {k}") for k in range(40)], "doc_id long, text string").repartition(6, "doc_id")
    labels = spark.createDataFrame([(k, 1, int(k < 6)) for k in range(20)], "doc_id long, quality int, toxic int")
    for parts in (6, 200):
        model = toxicity.train(docs.repartition(parts), labels)
        got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
        assert len(got) == 40 and min(got[k] for k in range(6)) > max(got[k] for k in range(6, 40))


@pytest.mark.parametrize("parts", ["8", "200"])
def test_toxicity_at_other_partitionings(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert queries.op2_toxicity(spark, SF_MID).count() == spark.read.parquet(f"{SF_MID}/documents.parquet").count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
