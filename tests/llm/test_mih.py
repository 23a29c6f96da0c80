"""Multi-index hashing against brute force."""

import numpy as np
from pyspark.sql import functions as F

from pagelake.llm import mih

SCHEMA = "vec_id long, embedding array<float>, entry int, v string"


def brute(rows, k):
    good = {i: np.array(v, np.float32).astype(float) for i, v in rows if v is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    ids = np.array(sorted(good))
    x = np.stack([good[i] for i in ids])
    out = {}
    for i in ids:
        if i % 20 == 0:
            score = np.einsum("ij,j->i", x, good[i])
            order = [j for j in np.lexsort((ids, -score)) if ids[j] != i][:k]
            out[int(i)] = [(int(ids[j]), score[j]) for j in order]
    return out


def run(spark, rows, k=20):
    df = spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1, "x") for i, v in rows], SCHEMA).repartition(4)
    got = {}
    for r in sorted(mih.nearest(df, F.col("vec_id") % 20 == 0, k).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    return got


def test_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(mih, "SHARD", 700)
    monkeypatch.setattr(mih, "BLOCK", 60)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 32))
    x[:900] = np.repeat(x[:9], 100, 0) + 0.05 * rng.normal(size=(900, 32))
    x[100:400] = x[100]
    rows = [(i, v) for i, v in enumerate(x)]
    got, want = run(spark, rows), brute(rows, 20)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    right = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want]
    assert np.mean(right) >= 0.9 * 20
    scores = dict(rows)
    for q in got:
        assert [i for i, s in sorted(got[q], key=lambda p: (-p[1], p[0]))] == [i for i, _ in got[q]]
        for i, s in got[q]:
            assert abs(s - np.dot(np.float32(scores[q]).astype(float), np.float32(scores[i]).astype(float))) < 1e-9
    assert got[120] == want[120]  # one of 300 equal vectors


def test_odd_vectors(spark):
    rows = [(0, [1, 0]), (20, [1, 0]), (20, [1, 0]), (3, [1, 0]), (4, None), (5, [0, 0]), (6, [float("nan"), 1]), (7, [None, 1]), (8, [float("inf"), 1]), (9, [1, 2, 3]), (40, [0, 1]), (60, [0, 0]), (11, [-0.0, 2])]
    got = run(spark, rows)
    assert got == {0: [(3, 1.0), (20, 1.0), (11, 0.0), (40, 0.0)], 20: [(0, 1.0), (3, 1.0), (11, 0.0), (40, 0.0)], 40: [(11, 2.0), (0, 0.0), (3, 0.0), (20, 0.0)]}
    assert run(spark, rows[:1]) == {} and run(spark, []) == {} and run(spark, rows[4:6]) == {}


def test_probing_finds_every_code_within_the_radius():
    """Narrow balls are looked up in the tables, wide ones make the tables' own values gone through; nothing passes the tables by."""
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 2**16, (3000, 8)).astype(np.uint16)
    codes[:40] = codes[0]
    asked = codes[:30] ^ (1 << rng.integers(0, 16, (30, 8))).astype(np.uint16)
    index = mih.Index(codes)
    probes = []
    original = mih.Index._probe
    for radius in (0, 7, 8, 15, 40, 60):
        for code in asked:
            mih.Index._probe = lambda self, c, w: probes.append(w) or original(self, c, w)
            try:
                found = index.within(code, radius, 1)
            finally:
                mih.Index._probe = original
            away = mih.distances(codes, code)
            wide = radius
            while (away <= wide).sum() < 1:
                wide += 8
            assert sorted(found) == np.flatnonzero(away <= wide).tolist()
    assert len(probes) >= 6 * 30 and min(probes) == 0 and max(probes) >= 7


def test_recall_of_the_registered_query(spark):
    """Every query of a small table against brute force: 0.9 on the mean."""
    from pagelake.llm import queries

    folder = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    want, got = brute(rows, 20), {}
    for r in queries.op5_multi_index_hashing(spark, folder).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got.keys() == want.keys()
    assert np.mean([len(set(got[q]) & {i for i, _ in want[q]}) / len(want[q]) for q in want]) >= 0.9
