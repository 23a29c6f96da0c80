"""Line dedup against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from pagelake.llm import line_dedup, words


def sets_of(text):
    lower = {c: c + 32 for c in range(65, 91)}
    return [set(x.translate(lower) for x in re.findall(r"[^\x20\x09-\x0D]+", line)) for line in text.split("\n")] if text is not None else []


def plain(rows, percent):
    """Texts after dedup, for rows (doc_id, text)."""
    order = sorted({d: t for d, t in rows}.items())
    seen, gone = [], set()
    for d, t in order:
        for i, s in enumerate(sets_of(t)):
            if s and any(100 * len(s & o) >= percent * len(s | o) for o in seen):
                gone.add((d, i))
            if s:
                seen.append(s)
    return {d: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in order}


@pytest.mark.parametrize("small,frequent", [(512, 50_000), (3, 50_000), (4, 30)])
@pytest.mark.parametrize("percent", [80, 60])
def test_equals_brute_force(spark, monkeypatch, small, frequent, percent):
    monkeypatch.setattr(line_dedup, "SMALL", small)
    monkeypatch.setattr(line_dedup, "FREQUENT", frequent)
    monkeypatch.setattr(line_dedup, "TIMES_MEAN", 0)
    monkeypatch.setattr(line_dedup, "FIRST", 1 if percent == 60 else 4)
    monkeypatch.setattr(line_dedup, "ROWS", 50 * small)
    rng = random.Random(small * percent)
    vocab = [f"w{int(rng.paretovariate(0.6))}" for _ in range(500)]
    pool = [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 40))) for _ in range(60)]
    template = [f"t{i}" for i in range(20)]

    def line():
        kind = rng.random()
        if kind < 0.3:
            return rng.choice(pool)
        if kind < 0.6:
            w = rng.choice(pool).split()
            for _ in range(rng.randint(1, 3)):
                w[rng.randrange(len(w))] = f"n{rng.randrange(9999)}"
            return " ".join(w)
        if kind < 0.75:
            w = list(template)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(20)] = f"v{rng.randrange(9999)}"
            return " ".join(w).upper()
        return rng.choice(["", "  ", "the of", "\t", f"u{rng.random()} a b c d e f g"])

    texts = [None, "", "\n\n", "x " * 20000, *["\n".join(line() for _ in range(rng.randint(1, 12))) for _ in range(120)]]
    rows = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(d, t, len(t or ""), "x") for d, t in rows], "doc_id long, text string, n_chars long, lines string").repartition(5)
    out = line_dedup.dedup_lines(df, percent)
    want = plain(rows, percent)
    got = {r.doc_id: r for r in out.collect()}
    assert {d: r.text for d, r in got.items()} == want
    assert all(r.n_chars == len(r.text or "") and r.lines == "x" for r in got.values())


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c"), (3, "a b c"), (3, "a b c"), (5, "a b C\nq")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.text, r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(df).collect())
    assert got == [("3", "a b c", 1, 0), ("3", "a b c", 1, 0), ("5", "q", 2, 1), ("None", "", 1, 1)]
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


@pytest.mark.parametrize("classes,copies", [(3, 10), (5, 7), (8, 4), (9, 1), (9, 3), (10, 1), (30, 5)])
def test_groups_across_settle_boundaries(monkeypatch, classes, copies):
    """Classes that recur in many batches: every pair of a word group is a candidate or left to the join of large groups."""
    monkeypatch.setattr(line_dedup, "SMALL", 8)
    monkeypatch.setattr(line_dedup, "ROWS", 10)
    rows = [(word, 10, word * 1000 + k, doc) for word in (5, 6) for k in range(classes) for doc in range(k, k + 100 * copies, 100)]
    batches = []
    for at in range(0, len(rows), 5):
        word, n, digest, doc = map(np.array, zip(*rows[at : at + 5]))
        zero = np.zeros(len(word), np.int64)
        batches.append(pa.RecordBatch.from_pydict({"word": word, "sized": n << 32, "digest": digest, "m1": zero, "m2": zero, "doc": doc, "line": zero}))
    out = [r for b in line_dedup._in_groups(80, 1 << 16)(iter(batches)) for r in b.to_pylist()]
    pairs = {(r["a"], r["b"]) for r in out if r["a"] is not None}
    for word in (5, 6):
        big = {r["digest"]: r["more"] for r in out if r["a"] is None and r["word"] == word}
        assert all((a, b) in pairs or a in big and big.get(b) for b in range(word * 1000, word * 1000 + classes) for a in range(word * 1000, b))


@pytest.mark.parametrize("percent", [80, 60])
def test_null_and_repeated_ids_with_different_texts(spark, percent):
    rng = random.Random(percent)
    pool = [" ".join(f"w{rng.randrange(60)}" for _ in range(rng.randint(4, 25))) for _ in range(40)]

    def line():
        w = rng.choice(pool).split()
        for _ in range(rng.choice([0, 1, 1, 2])):
            w[rng.randrange(len(w))] = f"n{rng.randrange(9999)}"
        return " ".join(w) if rng.random() < 0.7 else f"u{rng.random()} a b c d e f g"

    rows = [(1, "x y z v w"), (None, "a b c\nx y z v w"), (None, "d e f\ng h i j k"), (None, None), (2, "p q r s\nx y z v w"), (2, "t u\nk l m n o")]
    rows += [(rng.choice([None, 3, 4, 5, 6]), "\n".join(line() for _ in range(rng.randint(1, 8)))) for _ in range(80)]
    seen = [(9 if d is None else d, i, s) for d, t in rows for i, s in enumerate(sets_of(t)) if s]
    want = []
    for d, t in rows:
        gone = {i for i, s in enumerate(sets_of(t)) if s and any((e, j) < (9 if d is None else d, i) and 100 * len(s & o) >= percent * len(s | o) for e, j, o in seen)}
        want.append((d, None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone), len(gone)))
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), percent).collect()
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.text, r.n_removed)) for r in out)
    assert (None, "d e f\ng h i j k", 0) in want and (2, "t u\nk l m n o", 0) in want


def test_spare_drops_memos_and_keeps_results(spark):
    memo = words.Memo(lambda strings: [s.encode() for s in strings])
    memo(["a", "b"])
    run = lambda batches: iter([len(memo.young), *batches])
    assert list(words.tidy(run, spare=False)(iter([1]))) == [2, 1]
    assert list(words.tidy(run)(iter([1]))) == [0, 1] and memo(["a"]) == [b"a"]
    df = spark.createDataFrame([(1, "a b c d e\nq"), (2, "A b c d e\nr"), (3, None)], "doc_id long, text string")
    rows = lambda spare: sorted(map(tuple, line_dedup.dedup_lines(df, spare=spare).collect()))
    assert rows(True) == rows(False) == [(1, "a b c d e\nq", 2, 0), (2, "r", 2, 1), (3, None, 0, 0)]
