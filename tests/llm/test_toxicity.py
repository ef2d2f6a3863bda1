from __future__ import annotations

import random

import numpy as np

from framewright.llm import toxicity as X

DOCS = "doc_id long, text string, grade string"


def corpus(n=600, seed=5):
    draw, docs, labels = random.Random(seed), [], []
    for i in range(n):
        words = [draw.choice("abcdefghij") + draw.choice(["er", "on", "is", "ta"]) for _ in range(draw.randint(5, 40))]
        bad = i % 6 == 0
        for _ in range(draw.randint(1, 6) if bad else 0):
            words.insert(draw.randrange(len(words)), draw.choice(["Scum!", "vileness", "vilely"]))
        docs.append((i, " ".join(words), "own"))
        labels.append((i, int(bad)))
    return docs, labels


def test_held_out_texts_are_told_apart(spark):
    docs, labels = corpus()
    everything = spark.createDataFrame(docs, DOCS)
    model = X.fit(everything, spark.createDataFrame([x for x in labels if x[0] < 400], "doc_id long, toxic int"))
    out = {r.doc_id: r for r in X.score(everything.filter("doc_id >= 400"), model).collect()}
    truth = dict(labels)
    assert all(out[i].toxic == bool(truth[i]) for i in out)
    assert list(model.cuts) == sorted(model.cuts) and {r.grade for r in out.values()} == {0, 1, 2}
    assert X.score(everything, model).columns == ["doc_id", "text", "severity", "grade", "toxic"]


def test_more_toxic_words_are_more_severe(spark):
    docs, labels = corpus()
    model = X.fit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int"))
    rows = spark.createDataFrame([(i, "er on " + "scum vilely " * i, None) for i in (0, 1, 4)], DOCS)
    s = {r.doc_id: r.severity for r in X.score(rows, model).collect()}
    assert s[0] < s[1] < s[4]


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, None), (2, "", None), (2, "", None), (None, "scum " * 3000, None)], DOCS)
    labels = spark.createDataFrame([(1, None), (2, 1), (9, 1), (None, 1)], "doc_id long, toxic int")
    model = X.fit(docs, labels)
    assert model.weights == {} and [r.toxic for r in X.score(docs, model).collect()] == [False] * 4
    assert X.score(docs.limit(0), model).count() == 0 and X.fit(docs.limit(0), labels.limit(0)).weights == {}
    several = spark.createDataFrame([*corpus()[0], *[(0, "zzz", None)] * 50], DOCS)
    sample = X._sample(several, spark.createDataFrame(corpus()[1], "doc_id long, toxic int"), 40)
    assert sample.count() == sample.select("doc_id").distinct().count() == 40
    bad = X.Model({"scum": 9.0}, (1.0, 5.0), 0.5)
    assert [r.toxic for r in X.score(docs, bad).collect()] == [False, False, False, True]


def test_gradient_is_that_of_the_likelihood():
    """The fit's likelihood is no worse than at nearby parameters."""
    draw = np.random.default_rng(2)
    n, f = 300, 4
    x = draw.poisson(0.7, (n, f)).astype(float)
    y = np.clip((x @ np.array([1.0, 0.5, 0.0, -1.0]) + draw.logistic(size=n)).astype(int), 0, 2)
    row, col = np.nonzero(x)

    def loss(w, c):
        s = 1 / (1 + np.exp(-(x @ w)[:, None] + c[None, :]))
        p = np.hstack([np.ones((n, 1)), s])[np.arange(n), y] - np.hstack([s, np.zeros((n, 1))])[np.arange(n), y]
        return -np.log(p).mean() + 0.5 * 5e-5 * (w @ w)

    w, c = X.ordinal_fit(row, col, x[row, col], y, f, steps=2000)
    for k in range(f):
        for d in (-0.02, 0.02):
            assert loss(w, c) <= loss(w + d * np.eye(f)[k], c) + 1e-6
    assert loss(w, c) <= min(loss(w, c + 0.02), loss(w, c - 0.02)) + 1e-6
