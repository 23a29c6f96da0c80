"""The pipeline's stages against plain versions, on a small corpus."""

import random

import public_tokenizers
from test_lines import plain
from test_near import plain_components
from test_tokens import check_packing, plain_counts

import corpus_pipeline


def test_stages(spark, tmp_path):
    rng = random.Random(0)
    vocab = [f"{rng.choice('abcdefgh')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.choice(['', 'ing', 'er', 'al'])}" for _ in range(400)]
    line = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    texts = [None, "", "too short", "loop " * 300]
    for _ in range(40):
        texts.append("\n".join(line(rng.randint(5, 40)) for _ in range(6)))
    texts += [texts[10], texts[11] + " more", "\n".join([line(30), texts[12].split("\n")[0], line(40)])]
    # Near copies whose lines all differ: a word is new in every line.
    base = [line(12) for _ in range(8)]
    texts += ["\n".join(base), " ".join(base)]
    rows = [(i, t, "en", rng.choice(["s1", "s2", None]), len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)

    kept = stages["quality rules"](spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    have = {r.doc_id: r.text for r in kept.collect()}
    assert have == {i: t for i, t in enumerate(texts) if not plain_counts(t)[-1]}

    cut = stages["line dedup"](spark, kept, str(tmp_path))
    assert cut.columns == docs.columns
    after = {r.doc_id: r.text for r in cut.collect()}
    assert after == {i: t for i, t in plain(list(have.items()), 80).items() if t.split()}

    single = stages["near dedup"](spark, cut, str(tmp_path))
    ids = sorted(after)
    label, _ = plain_components([after[i] for i in ids], 5, 80)
    assert sorted(r.doc_id for r in single.collect()) == [i for n, i in enumerate(ids) if label[n] == n]

    mixed = stages["mix sources"](spark, single, str(tmp_path))
    assert mixed.columns == docs.columns
    total = sum(len(r.text.split()) for r in single.collect())
    assert abs(sum(len(r.text.split()) for r in mixed.collect()) - 1.5 * total) < 3 * 250

    packed = stages["pack sequences"](spark, single, str(tmp_path)).collect()
    left = {r.doc_id: r.text for r in single.collect()}
    number = {d: n for n, d in enumerate(sorted(left))}
    rows = [type("Piece", (), r.asDict() | {"doc_id": number[r.doc_id]})() for r in packed]
    used, least = check_packing(rows, [left[d] for d in sorted(left)], 4096, public_tokenizers.path("word_bpe_49k.json"))
    assert used <= least + 1

    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(stages["pack sequences"](spark, mixed, str(tmp_path)).collect())
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, str(tmp_path))
    assert empty.count() == 0
