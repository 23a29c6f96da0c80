"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight vector over hashed words is shared by all grades, and ordered thresholds part the grades:
P(grade > j) = sigmoid(x . w - t_j). A document's features are 1 + log(count) of its words, hashed to DIM places and
divided by the square root of their norm, so that a few telling words still count in a long text. The result per document
is the expected grade and the tail probability of each grade, by which documents are selected.

The model is fitted on a bounded sample: the SAMPLE labelled rows that come first by a hash of doc_id, whole texts, in
one task; the weights (DIM numbers, whatever the corpus) go to all tasks that score. Every document is scored.

Defined results: a null or empty text has no features and is graded by the thresholds alone. Ratings that are null are
left out, as are negative ones; several ratings of one document count each. With one grade only, every document gets it;
without any rating, every tail probability is a half.
Repeated rows get equal rows; extra columns are ignored; an empty table of documents gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import extended, only
from .words import Texts, chunks, hash_runs, unit_runs

BITS = 20
DIM = 1 << BITS
#: Labelled rows that a model is fitted on, at most.
SAMPLE = 12_000


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Rows, places and values of the features of a chunk of whole texts, and the number of texts."""
    texts = Texts(column, lower=True)
    data, ends, counts = unit_runs(texts, spaces=False)
    place = (hash_runs(data, ends) >> np.uint64(64 - BITS)).astype(np.int64)
    key, count = np.unique(np.repeat(np.arange(texts.n), counts) << BITS | place, return_counts=True)
    row, value = key >> BITS, 1 + np.log(count)
    norm = np.sqrt(np.bincount(row, value * value, texts.n))
    return row, key & (DIM - 1), value / np.sqrt(norm[row]), texts.n


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, row: np.ndarray, place: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        """P(grade > j) of each text, for every threshold j."""
        score = np.bincount(row, value * self.weights[place], n)
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds, -30, 30)))


def fit_rows(row: np.ndarray, place: np.ndarray, value: np.ndarray, grades: np.ndarray, steps: int = 600, lasso: float = 1e-4, least_texts: int = 5, balance: float = 0.5, levels: int = 2) -> Model:
    """Accelerated proximal descent on the cumulative-link likelihood; thresholds stay ordered by construction.

    Grades are weighted by their share to the power -balance. The lasso leaves most words without a weight.
    Places that fewer than `least_texts` texts have get no weight: they could only be learned by heart."""
    n, levels = len(grades), max(levels, int(grades.max()) + 1)
    texts = np.bincount(place, minlength=DIM)
    used = np.flatnonzero(texts >= least_texts)
    known = texts[place] >= least_texts
    row, value, at = row[known], value[known], np.searchsorted(used, place[known])
    share = np.bincount(grades, minlength=levels) / n
    weight = (1 / np.maximum(share, 1e-9) ** balance)[grades]
    weight /= weight.sum()
    w, free = np.zeros(len(used)), np.concatenate([[0.0], np.zeros(levels - 2)])
    free[0] = -np.log(levels - 1)
    # Steps in each coordinate are bounded by the curvature there and by what moves with it, so the loss can't run away.
    along = 0.3 * weight * (1 + np.bincount(row, value, n))
    bound = np.bincount(at, value * along[row], len(used)) + 1e-12
    bound_f = 4 * along.sum()
    seen_w, seen_f = w, free
    for k in range(steps):
        pull = k / (k + 3)
        look_w, look_f = w + pull * (w - seen_w), free + pull * (free - seen_f)
        thresholds = look_f[0] + np.concatenate([[0], np.cumsum(np.exp(look_f[1:]))])
        score = np.bincount(row, value * look_w[at], n)
        below = 1 / (1 + np.exp(-np.clip(thresholds - score[:, None], -30, 30)))
        below = np.concatenate([np.zeros((n, 1)), below, np.ones((n, 1))], 1)
        own = np.arange(n)
        p = np.maximum(below[own, grades + 1] - below[own, grades], 1e-12)
        slope = below * (1 - below)
        upper, lower = weight * slope[own, grades + 1] / p, weight * slope[own, grades] / p
        d_w = np.bincount(at, value * (upper - lower)[row], len(used))
        d_t = np.bincount(grades + 1, -upper, levels + 1)[1:-1] + np.bincount(grades, lower, levels + 1)[1:-1]
        d_free = np.concatenate([[d_t.sum()], np.exp(look_f[1:]) * np.cumsum(d_t[::-1])[::-1][1:]])
        seen_w, seen_f = w, free
        w, free = look_w - d_w / bound, look_f - d_free / bound_f
        w = np.sign(w) * np.maximum(np.abs(w) - lasso / bound, 0)
    out = np.zeros(DIM)
    out[used] = w
    return Model(out, free[0] + np.concatenate([[0], np.cumsum(np.exp(free[1:]))]))


def fit(docs: DataFrame, ratings: DataFrame, sample: int = SAMPLE, levels: int = 2, **options) -> Model:
    """docs(doc_id, text), ratings(doc_id, grade: 0, 1, ...) -> a model of so many grades at least."""
    rated = only(ratings, "doc_id", "grade").where("grade >= 0 AND doc_id IS NOT NULL")
    chosen = rated.orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(sample)
    # The sample is of bounded size, so it may be broadcast; no text of an unrated document is shuffled.
    labelled = only(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "grade")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                row, place, value, n = features(part["text"])
                ends = pa.array(np.searchsorted(row, np.arange(n + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays([part["doc_id"].cast(pa.int64()), part["grade"].cast(pa.int32()), pa.ListArray.from_arrays(ends, pa.array(place.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(value.astype(np.float32)))], ["doc_id", "grade", "places", "features"])

    vectors = labelled.mapInArrow(run, "doc_id long, grade int, places array<int>, features array<float>").withColumn("all", F.lit(0))

    def train(held: pd.DataFrame) -> pd.DataFrame:
        held = held.sort_values(["doc_id", "grade"], kind="stable")
        grades = held["grade"].to_numpy(np.int64)
        if len(np.unique(grades)) < 2:
            only_one = np.where(np.arange(max(levels, grades[0] + 1) - 1) < grades[0], -30.0, 30.0)
            return pd.DataFrame({"weights": [np.zeros(DIM, np.float32).tobytes()], "thresholds": [only_one.tobytes()]})
        sizes = held["places"].map(len).to_numpy()
        model = fit_rows(np.repeat(np.arange(len(held)), sizes), np.concatenate(held["places"].to_list()).astype(np.int64), np.concatenate(held["features"].to_list()).astype(float), grades, levels=levels, **options)
        return pd.DataFrame({"weights": [model.weights.astype(np.float32).tobytes()], "thresholds": [model.thresholds.tobytes()]})

    found = vectors.groupBy("all").applyInPandas(train, "weights binary, thresholds binary").first()
    if found is None:
        return Model(np.zeros(DIM), np.zeros(levels - 1))
    return Model(np.frombuffer(found["weights"], np.float32).astype(float), np.frombuffer(found["thresholds"]))


def score(docs: DataFrame, model: Model, keep: list[str], least_grade: int = 1, least: float = 0.5) -> DataFrame:
    """docs(text, ...) -> the columns `keep`, expected_grade, tails (P(grade >= 1), P(grade >= 2), ...) and kept: P(grade >= least_grade) >= least."""
    ready = only(docs, *dict.fromkeys([*keep, "text"]))
    model = Model(model.weights.astype(np.float32), model.thresholds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                tails = model.tails(*features(part["text"]))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(tails) + 1) * tails.shape[1], pa.int32()), pa.array(tails.ravel()))
                yield pa.RecordBatch.from_arrays([*[part[c] for c in keep], pa.array(tails.sum(1)), flat, pa.array(tails[:, least_grade - 1] >= least)], [*keep, "expected_grade", "tails", "kept"])

    return ready.mapInArrow(run, extended(ready, keep, {"expected_grade": "double", "tails": "array<double>", "kept": "boolean"}))
