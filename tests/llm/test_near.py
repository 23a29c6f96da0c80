"""Min-max near duplicates and mixing against plain versions."""

import random
import re

import numpy as np
import pytest

from pagelake.llm import minmax, mixing
from pagelake.llm.components import components
from pagelake.llm.shared import Scratch

DOCS = "doc_id long, text string, source string, n_shingles int, component_id string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text, k):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in words(text)]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def plain_components(texts, k, percent):
    sets = [shingles(t, k) for t in texts]
    label = list(range(len(texts)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return [root(i) for i in range(len(texts))], list(map(len, sets))


def edited(text, n, rng):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"w{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("k,percent,bands,rows", [(3, 85, 24, 6), (5, 80, 30, 5)])
def test_components_equal_brute_force(spark, k, percent, bands, rows):
    rng = random.Random(k)
    base = [" ".join(f"t{rng.randrange(400)}" for _ in range(rng.randint(30, 200))) for _ in range(25)]
    texts = [None, "", " \n", "one", "One", "one two", "x " * 9000, *base]
    for t in base:
        chain = t
        for _ in range(6):
            chain = edited(chain, rng.choice([0, 1, 2, 3]), rng)  # chains whose ends are not alike
            texts.append(chain)
        texts.append(t.upper())
    texts += [base[0]] * 5 + [edited(base[1], 2, rng) for _ in range(40)]
    df = spark.createDataFrame([(i, t, None, 1, "x") for i, t in enumerate(texts)], DOCS).repartition(6)
    got = {r.doc_id: r for r in minmax.near_duplicates(df, k, percent, bands, rows).collect()}
    label, sizes = plain_components(texts, k, percent)
    assert [got[i].component_id for i in range(len(texts))] == label
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert all(got[i].kept == (label[i] == i) for i in range(len(texts)))
    left = minmax.deduplicate(df, k=k, percent=percent, bands=bands, rows=rows)
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == sorted(set(label))


@pytest.mark.parametrize("big,block", [(3, 500), (32, 400_000)])
def test_strays_of_a_large_group(spark, monkeypatch, big, block):
    """Copies edited so much that many are linked with some of the group but not with its smallest id."""
    monkeypatch.setattr(minmax, "BIG", big)
    monkeypatch.setattr(minmax, "BLOCK", block)
    rng = random.Random(big)
    base = " ".join(f"t{i}" for i in range(150))
    texts = [edited(base, rng.randint(0, 9), rng) for _ in range(130)] + [edited(base.replace("t1", "s1"), rng.randint(0, 5), rng) for _ in range(40)]
    rng.shuffle(texts)
    df = spark.createDataFrame([(i, t, None, 1, "x") for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r.component_id for r in minmax.near_duplicates(df, 3, 85, 24, 6).collect()}
    label, _ = plain_components(texts, 3, 85)
    assert len(set(label)) > 5 and [got[i] for i in range(len(texts))] == label


def test_near_duplicates_of_odd_tables(spark):
    df = spark.createDataFrame([(None, "a b c d e", "s", 1, "x"), (None, "a b c d e", "s", 1, "x"), (4, "q r s t u v", "s", 1, "x"), (4, "q r s t u v", "s", 1, "x")], DOCS)
    rows = minmax.near_duplicates(df).collect()
    assert sorted((r.doc_id is None, r.component_id, r.kept) for r in rows if r.doc_id) == [(False, 4, True)] * 2 and all(r.kept for r in rows)
    assert minmax.near_duplicates(df.limit(0)).count() == 0


def test_minmax_estimates_similarity():
    rng = np.random.default_rng(0)
    family = minmax.MinMax(60, 5)
    x = rng.integers(0, 2**64, 300, dtype=np.uint64)
    y = np.concatenate([x[:240], rng.integers(0, 2**64, 60, dtype=np.uint64)])
    agree = np.concatenate([a == b for a, b in zip(family.signature(x), family.signature(y))])
    assert abs(agree.mean() - 240 / 360) < 0.08


def test_components_of_long_paths(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + j) for j in range(1, 50)] + [(7, 7)]
    rng.shuffle(edges)
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()))
    assert got == {i: 0 for i in range(61)} | {100 + j: 100 for j in range(50)}


def plain_targets(sizes, weights, share, cap):
    total = share * sum(sizes)
    target, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    while True:
        rest = total - sum(target[i] for i in range(len(sizes)) if i not in open_)
        for i in open_:
            target[i] = rest * weights[i % len(weights)] / sum(weights[j % len(weights)] for j in open_)
        above = [i for i in open_ if target[i] > cap * sizes[i]]
        if not above:
            return target
        for i in above:
            target[i] = float(cap * sizes[i])
        open_ -= set(above)


def test_mix_meets_targets(spark):
    rng = random.Random(4)
    rows = []
    for s, n in (("b", 900), ("a", 200), ("é", 150), (None, 120), ("zero", 3), ("c", 1)):
        for _ in range(n):
            rows.append((len(rows), None if s == "zero" else "w " * rng.randint(0, 60), s, 1, "x"))
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.mix_report(df).collect()
    again = mixing.mix_report(df.repartition(3)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)
    names = ["a", "b", "c", "zero", "é", None]
    sizes = [sum(len(words(r[1])) for r in rows if r[2] == s) for s in names]
    target = plain_targets(sizes, (3, 1, 2), 1.5, 2)
    for s, size, t in zip(names, sizes, target):
        own = [r for r in got if r.source == s]
        assert all(r.source_size == size and r.target == pytest.approx(t) for r in own)
        assert abs(sum(r.taken for r in own) - t) <= 31 or size == own[0].size
        assert all(r.taken <= 2 * r.size and r.size == len(words(rows[r.doc_id][1])) for r in own)
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    assert sorted(r.doc_id for r in mixed.collect()) == sorted(r.doc_id for r in got for _ in range(r.copies))
    assert mixing.mix_report(df.limit(0)).count() == 0


def test_mix_with_unequal_weights(spark):
    """Inclusion follows the weights, and the target is met although the largest weights are cut off."""
    df = spark.createDataFrame([(i, "w " * 10, "s", (1 if i % 3 else 4), "x") for i in range(3000)] + [(9000 + i, "w " * 10, "t", 1, "x") for i in range(3000)], DOCS)
    got = mixing.mix_report(df, weights=(1, 3), weight_column="n_shingles").collect()
    own = [r for r in got if r.source == "s"]
    assert abs(sum(r.taken for r in own) - own[0].target) <= 10
    heavy, light = ([r.copies for r in own if (r.doc_id % 3 == 0) == h] for h in (True, False))
    assert max(heavy) <= 2 and np.mean(heavy) > 2.5 * np.mean(light)
