"""Naive Bayes by aggregates against a plain computation."""
import math
import random
from collections import Counter

from framelens.operators import bayes


def _plain(train, text):
    labels = sorted({x for x, _ in train if x is not None})
    counts = {x: Counter(w for lab, t in train if lab == x for w in (t or "").lower().split()) for x in labels}
    vocabulary = len(set().union(*counts.values()))
    texts = Counter(lab for lab, _ in train if lab is not None)
    words = (text or "").lower().split()
    score = {x: math.log(texts[x] / sum(texts.values())) + sum(math.log((counts[x][w] + 1) / (sum(counts[x].values()) + vocabulary)) for w in words) for x in labels}
    return min(labels, key=lambda x: (-round(score[x], 6), x)), score


def test_scores_against_a_plain_computation(spark):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(30)]
    train = [(rng.choice(["a", "b", "c", None]), " ".join(rng.choices(words[(k % 3) * 5:], k=rng.randrange(0, 12)))) for k in range(60)]
    train += [("a", None), ("b", "")]
    model = bayes.fit_bayes(spark.createDataFrame(train, "label string, text string").repartition(5))
    texts = [(k, " ".join(rng.choices([*words, "never seen"], k=rng.randrange(0, 15)))) for k in range(40)] + [(90, None), (91, ""), (92, "Ω unseen")]
    got = bayes.score_bayes(spark.createDataFrame(texts, "id long, text string").repartition(3), model).collect()
    assert len(got) == len(texts)
    by = {r.id: r for r in got}
    for k, t in texts:
        label, score = _plain(train, t)
        best = sorted(score.values(), reverse=True)
        assert by[k].label == label
        assert abs(by[k].score - best[0]) < 1e-5 and abs(by[k].margin - (best[0] - best[1])) < 1e-5


def test_empty_and_single_label(spark):
    frame = lambda rows: spark.createDataFrame(rows, "label string, text string")
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "id long, text string")
    none = bayes.fit_bayes(frame([(None, "a")]))
    assert [(r.label, r.score) for r in bayes.score_bayes(docs, none).collect()] == [(None, None)] * 2
    one = bayes.fit_bayes(frame([("x", "a a b")]))
    assert {(r.id, r.label, r.margin) for r in bayes.score_bayes(docs, one).collect()} == {(1, "x", None), (2, "x", None)}
    assert bayes.score_bayes(docs.limit(0), one).collect() == []
