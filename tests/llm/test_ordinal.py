"""Ordinal regression: held-out accuracy, and its likelihood against a plain version."""

import numpy as np
import pyarrow as pa
import pytest

from pagelake.llm import ordinal


def corpus(n, seed):
    rng = np.random.default_rng(seed)
    texts, grades = [], []
    for _ in range(n):
        grade = int(rng.integers(0, 3))
        words = [f"w{int(x)}" for x in rng.zipf(1.4, rng.integers(20, 200)) if x < 10**6] + ["and"]
        for _ in range(rng.integers(1, 4) if grade < 2 else 0):
            words.insert(rng.integers(0, len(words)), ["scum", "trash", "moron"][rng.integers(0, 3)] + ".")
        if grade == 0:
            words += ["###"] * 3
        texts.append(" ".join(words).capitalize())
        grades.append(grade)
    return texts, grades


def test_held_out_grades(spark):
    texts, grades = corpus(1200, 0)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, kept string")
    ratings = spark.createDataFrame([(i, g) for i, g in enumerate(grades)] + [(3, None), (None, 1)], "doc_id long, grade int")
    model = ordinal.fit(docs, ratings, least_texts=5)
    again = ordinal.fit(docs.repartition(7), ratings.repartition(3), least_texts=5)
    assert np.allclose(model.weights, again.weights) and (np.diff(model.thresholds) > 0).all()
    held, want = corpus(400, 1)
    new = spark.createDataFrame([(i, t) for i, t in enumerate([*held, None, "", "moron " * 50000])], "doc_id long, text string")
    rows = sorted(ordinal.score(new, model, ["doc_id"], 2).collect(), key=lambda r: r.doc_id)
    assert np.mean([round(r.expected_grade) == g for r, g in zip(rows, want)]) > 0.9
    assert np.mean([r.kept == (g == 2) for r, g in zip(rows, want)]) > 0.95
    for r in rows:
        assert r.tails[0] >= r.tails[1] and r.expected_grade == pytest.approx(sum(r.tails))
    assert rows[400].tails == rows[401].tails == pytest.approx(list(1 / (1 + np.exp(np.clip(model.thresholds, -30, 30)))), abs=1e-6)
    assert not rows[402].kept
    assert ordinal.score(new.limit(0), model, ["doc_id"]).count() == 0


def test_few_grades_or_none(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    of = lambda *grades: spark.createDataFrame([(1, g) for g in grades], "doc_id long, grade int")
    tails = lambda *grades, levels=3: [list(r.tails) for r in ordinal.score(docs, ordinal.fit(docs, of(*grades), levels=levels), ["doc_id"]).collect()]
    assert tails() == tails(None, -1) == [[0.5, 0.5]] * 2
    assert tails(1) == [pytest.approx([1, 0])] * 2 and tails(3) == [pytest.approx([1, 1, 1])] * 2
    assert ordinal.score(docs.limit(0), ordinal.fit(docs.limit(0), of(0, 1)), ["doc_id"]).count() == 0
    assert len(tails(0, 2)[0]) == 2


def test_gradient_reaches_a_better_likelihood():
    texts, grades = corpus(300, 2)
    row, place, value, n = ordinal.features(pa.array(texts))
    grades = np.array(grades)

    def loss(model):
        score = np.bincount(row, value * model.weights[place], n)
        below = np.concatenate([np.zeros((n, 1)), 1 / (1 + np.exp(score[:, None] - model.thresholds)), np.ones((n, 1))], 1)
        return -np.log(below[np.arange(n), grades + 1] - below[np.arange(n), grades]).mean()

    losses = [loss(ordinal.fit_rows(row, place, value, grades, steps=s, least_texts=3)) for s in (1, 20, 200)]
    assert losses[0] > losses[1] > losses[2]
