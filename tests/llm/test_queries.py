"""The registered queries, with their own parameters, over a small table against plain versions."""

import public_tokenizers
import pytest
from test_lines import plain, sets_of
from test_near import plain_components
from test_tokens import check_packing, plain_counts
from tokenizers import Tokenizer

from pagelake.llm import fertility, queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return sorted((r.asDict() for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()), key=lambda r: r["doc_id"])


def run(spark, name):
    return queries.queries()[name](spark, FOLDER).collect()


def test_fertility(spark, docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = {r.doc_id: r for r in run(spark, "op3_fertility")}
    assert rows.keys() == {d["doc_id"] for d in docs}
    for d in docs:
        r = rows[d["doc_id"]]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_counts(d["text"])
        ids = [i for w in (d["text"] or "").split() for i in model.encode(w)]
        if ids and d["lang"] in fertility.BANDS:
            least, most, share, bits = fertility.BANDS[d["lang"]]
            in_band = least <= r.word_chars / len(ids) <= most and sum(map(model.is_byte, ids)) <= share * len(ids) and r.token_entropy >= bits
            assert r.kept == (in_band and not r.base_failed)


def test_minmax(spark, docs):
    label, _ = plain_components([d["text"] for d in docs], 3, 85)
    want = {d["doc_id"]: docs[label[n]]["doc_id"] for n, d in enumerate(docs)}
    rows = run(spark, "op6_minmax")
    assert {r.doc_id: r.component_id for r in rows} == want and all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_packing(spark, docs):
    number = {d["doc_id"]: n for n, d in enumerate(docs)}
    rows = [type("Piece", (), r.asDict() | {"doc_id": number[r.doc_id]})() for r in run(spark, "op7_packing")]
    used, least = check_packing(rows, [d["text"] for d in docs], 4096, public_tokenizers.path("word_bpe_49k.json"))
    assert used <= least + 1


def test_token_counts(spark, docs):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = {r.doc_id: r for r in run(spark, "op8_token_counts")}
    for d in docs:
        n = len(library.encode(d["text"] or "", add_special_tokens=False).ids)
        assert (rows[d["doc_id"]].n_bytes, rows[d["doc_id"]].n_tokens, rows[d["doc_id"]].over_limit) == (len((d["text"] or "").encode()), n, n > 512)


def test_line_dedup(spark, docs):
    import hashlib

    want = plain([(d["doc_id"], d["text"]) for d in docs], 80)
    for r in run(spark, "op9_line_dedup"):
        text = want[r.doc_id]
        assert r.kept_md5 == (None if text is None else hashlib.md5(text.encode()).hexdigest())
        assert r.n_lines - r.n_removed == sum(map(bool, sets_of(text)))


def test_mixing(spark, docs):
    rows = run(spark, "op10_mixing")
    sources = sorted({d["source"] for d in docs}, key=lambda s: (s is None, s))
    size = {s: sum(len((d["text"] or "").split()) for d in docs if d["source"] == s) for s in sources}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    target, open_, left = {}, set(sources), 1.5 * sum(size.values())
    while open_:
        full = {s for s in open_ if left * weight[s] / sum(weight[o] for o in open_) >= 2 * size[s]}
        target |= {s: 2.0 * size[s] if full else left * weight[s] / sum(weight[o] for o in open_) for s in (full or open_)}
        left -= sum(target[s] for s in full)
        open_ -= full or open_
    of = {d["doc_id"]: d["source"] for d in docs}
    taken = dict.fromkeys(sources, 0)
    for r in rows:
        assert r.source_size == size[of[r.doc_id]] and r.target == pytest.approx(target[of[r.doc_id]]) and r.taken <= 2 * r.size
        taken[of[r.doc_id]] += r.taken
    longest = max(r.size for r in rows)
    assert all(abs(taken[s] - target[s]) <= longest for s in sources)
    assert sorted(rows) == sorted(run(spark, "op10_mixing"))


def test_every_query_gives_its_rows(spark, docs):
    n = {"op1_url_filters": spark.read.parquet(f"{FOLDER}/pages.parquet").count(), "op4_ordinal": len(docs)}
    n["op2_warc"] = 2 * n["op1_url_filters"]
    for name, rows in n.items():
        assert queries.queries()[name](spark, FOLDER).count() == rows
