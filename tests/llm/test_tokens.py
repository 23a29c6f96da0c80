"""URL filter, fertility, token counts and packing against plain versions."""

import fnmatch
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pagelake.llm import fertility, packing, token_counts, url_filters

DOCS = "doc_id long, text string, lang string, source string, extra int"
AWKWARD = [None, "", " ", "\n\n", "a", "word " * 3000, "Shti " * 400, "x" * 50_000, "it's <|endoftext|> 'Re  é日本 ́a\x01b!!", "same text here", "same text here", "line one two\nline one two\n\nline"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, None if i % 3 else "en", None, i) for i, t in enumerate(AWKWARD)], DOCS)


def test_automaton_fits_like_fnmatch():
    random.seed(5)
    globs = ["*a*b", "ab?c*", "*", "", "*.com/*", "a" * 70 + "*z", "?*?", "*abcabc*abd*"] + ["".join(random.choice("ab*?c") for _ in range(9)) for _ in range(30)]
    urls = ["".join(random.choice("abc.com/z") for _ in range(random.randint(0, 40))) for _ in range(200)] + ["a" * 90 + "z", ""]
    machine = url_filters.Automaton(globs)
    assert machine.words > 3
    got = machine.fits([u.encode() for u in urls])
    for u, row in zip(urls, got):
        assert row.tolist() == [fnmatch.fnmatchcase(u, g) for g in globs]
        state = machine.run(u.encode())
        assert [bool(state >> f & 1) for f in machine.final] == row.tolist()


def test_url_filter_rows(spark):
    rules = [url_filters.site_rule(*r) for r in (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"))]
    urls = [None, "", "no scheme", "http://EXAMPLE.com/en/x?y", "https://www.example.com/en/#t", "http://a.example.com/de/", "http://notexample.com/en/", "http://x.net/es/", "http://x.net", "http://u@x.com:80/", "http://x.com?q=/en/", "http://x.com/" + "a" * 20000, "http://x.net/es/", "http://a.org/b\nc?d"]
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.filter_urls(df, rules, "allow", [url_filters.Rule("*notex*", "n", "block")]).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("example.com", "/en/x", "example.com/en/", "block")
    assert got[4][2:] == ("www.example.com/en/", "allow") and got[5][2:] == ("com/", "allow") and got[6][2:] == ("com/", "allow")
    assert got[7][2:] == got[12][2:] == ("net/es/", "block") and got[8] == ("x.net", "", None, "allow")
    assert got[9] == ("u@x.com:80", "/", None, "allow") and got[10][:3] == ("x.com", "", None) and len(got[11][1]) == 20001
    assert got[13][:2] == ("a.org", "/b\nc")
    assert url_filters.filter_urls(df.limit(0), rules).count() == 0


def test_site_rules_fit_no_host_names_inside_paths(spark):
    sites = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"))
    parts = ["example.com", "www.example.com", "x.net", "net", "a.org", "com", "en", "es", "spam-farm", "a#b.com"]
    rng = random.Random(8)
    urls = ["https://a.org/www.example.com/en/x", "http://a.org/go/y.net/es/z", "http://spam-farm.org/x.com/", "http://a.org/.com/", "http://a.org/com", "http://a.com.org/en/"]
    urls += ["http://" + rng.choice(["", "www.", "a."]) + "/".join(rng.choice(parts) for _ in range(rng.randint(1, 5))) + rng.choice(["", "/", "?x.net/es/"]) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    junk = [url_filters.Rule("*spam-farm*", "*spam-farm*", "block"), url_filters.Rule("*.org/go/*", "go", "block")]
    rows = url_filters.filter_urls(df, [url_filters.site_rule(*s) for s in sites], "allow", junk).collect()
    for r in rows:
        fit = [(host + path, verdict) for host, path, verdict in sites if f".{r.host}".endswith(f".{host}") and r.path.startswith(path)]
        label, verdict = max(fit, key=lambda x: len(x[0]), default=(None, None))
        pattern = None if label else "*spam-farm*" if "spam-farm" in r.host + r.path else "go" if fnmatch.fnmatchcase(r.host + r.path, "*.org/go/*") else None
        assert (r.rule, r.pattern, r.verdict) == (label, pattern, verdict or ("block" if pattern else "allow")), r.url
    assert [(r.rule, r.verdict) for r in sorted(rows)[:3]] == [(None, "allow"), (None, "block"), (None, "block")]


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    hit = set()
    for i, w in enumerate(zip(words, words[1:], words[2:])):
        if windows[w] > 1:
            hit |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit), len(words) < 50 or 100 * len(hit) > 50 * len(words)


def test_fertility_counts_and_measures(spark, docs):
    random.seed(3)
    texts = AWKWARD + ["".join(random.choice(["a", "b", "é", " ", "\n", "#", "a b c "]) for _ in range(random.randint(0, 300))) for _ in range(150)]
    df = spark.createDataFrame([(i, t, "en", "s", i) for i, t in enumerate(texts)], DOCS)
    rows = {r.doc_id: r for r in fertility.quality(df, public_tokenizers.path("piece_bpe_32k.model"), ["doc_id"]).collect()}
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for i, t in enumerate(texts):
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_counts(t), t
        ids = [x for w in re.findall(r"[^\x20\x09-\x0D]+", t or "") for x in sp.encode(w)]
        assert r.n_tokens == len(ids)
        if ids:
            share = np.array(list(Counter(ids).values())) / len(ids)
            assert r.token_entropy == pytest.approx(-(share * np.log2(share)).sum())
            assert r.fallback_share == pytest.approx(sum(map(sp.is_byte, ids)) / len(ids))
        else:
            assert r.chars_per_token is None and not r.kept
    assert fertility.quality(docs.limit(0), public_tokenizers.path("piece_bpe_32k.model"), ["doc_id"]).count() == 0
    assert not rows[6].kept and fertility.quality(df, public_tokenizers.path("piece_bpe_32k.model"), df.columns, drop=True).columns == df.columns


def test_fertility_bands_reject_junk_that_passes_the_base_rules(spark):
    rng = random.Random(4)
    vocab = [f"{rng.choice('abcdefgh')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.choice(['', 'ing', 'er', 'al'])}" for _ in range(400)]
    texts = []
    for _ in range(20):
        words = [rng.choice(vocab) for _ in range(200)]
        texts += [" ".join(words), " ".join(w + "".join(rng.choice("#$%&*") for _ in range(3)) for w in words)]
    df = spark.createDataFrame([(i, t, lang, "s", i) for i, t in enumerate(texts) for lang in ("en", "de", "fr", "es", None)], DOCS)
    rows = fertility.quality(df, public_tokenizers.path("piece_bpe_32k.model"), ["doc_id", "lang"]).collect()
    assert all(r.kept for r in rows if r.doc_id % 2 == 0)
    assert not any(r.base_failed or r.kept for r in rows if r.doc_id % 2)


def test_prefix_counts_equal_the_library(spark, docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), token_counts.counter(path)
    count = lambda s: len(library.encode(s, add_special_tokens=False).ids)
    random.seed(1)
    parts = ["a", "e", "the", "'", "'s", "'re", " ", "  ", "\n", "\t", "23", "!", "é", " ", " ", "日本", "😀", "<|endoftext|>", "<|end", "ing", "|", ">", "\x1c", "\u0085", "A"]
    for _ in range(300):
        s = "".join(random.choice(parts) for _ in range(random.randint(0, 14)))
        counts = own.prefix_counts(s)
        assert counts.tolist() == [count(s[:p]) for p in range(len(s) + 1)], s
        cut = own.truncate(s, 3)
        assert count(cut) <= 3 and (cut == s or all(count(s[:p]) > 3 for p in range(len(cut) + 1, len(s) + 1)))
    got = {r.doc_id: r for r in token_counts.token_counts(docs, path, ["doc_id"]).collect()}
    for i, t in enumerate(AWKWARD):
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), count(t or ""), count(t or "") > 512)
    assert token_counts.token_counts(docs.limit(0), path, ["doc_id"], with_prefixes=True).count() == 0


def check_packing(rows, texts, capacity, path):
    library = Tokenizer.from_file(path)
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    total = 0
    for i, t in enumerate(texts):
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        total += len(ids)
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(-(-len(ids) // capacity)))
        for r in pieces:
            part = ids[r.start : r.start + r.length]
            assert r.start == r.piece * capacity and r.length == min(capacity, len(ids) - r.start) and r.ids_crc32 == zlib.crc32(part.tobytes())
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_sequence), -(-total // capacity)


@pytest.mark.parametrize("block", [packing.BLOCK, 7])
def test_packing_round_trip(spark, docs, monkeypatch, block):
    path = public_tokenizers.path("word_bpe_49k.json")
    monkeypatch.setattr(packing, "FAN_IN", 8)
    monkeypatch.setattr(packing, "BLOCK", block)
    random.seed(9)
    texts = AWKWARD + ["".join(random.choice(["Ab", "cd.", "'S", "É", " ", "\n", "12", "<|startoftext|>", "<|ENDOFTEXT|>", "é"]) for _ in range(random.randint(0, 90))) for _ in range(200)]
    df = spark.createDataFrame([(i, t, None, None, 1) for i, t in enumerate(texts)], DOCS).repartition(5)
    used, least = check_packing(packing.pack(df, path, 64, 1).collect(), texts, 64, path)
    assert used <= 1.05 * least + 3
    assert packing.pack(docs.limit(0), path).count() == 0


def test_best_fit_is_close_to_the_bound():
    sizes = np.random.default_rng(0).integers(1, 3000, 5000)
    bins, offsets, n = packing.best_fit(sizes, 4096)
    assert np.bincount(bins, sizes).max() <= 4096 and n <= 1.03 * sizes.sum() / 4096


@pytest.mark.parametrize("text", [" " * 20_000, "a" + "\n \t" * 7_000 + "b", "<|endoftext|>" * 1_500, "x <|endoftext|>" * 700, "'" * 20_000, " '" * 9_000])
def test_prefix_counts_in_linear_time(text):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), token_counts.counter(path)
    began = time.time()
    counts = own.prefix_counts(text)
    assert time.time() - began < 3
    for p in random.Random(1).sample(range(len(text) + 1), 12):
        assert counts[p] == len(library.encode(text[:p], add_special_tokens=False).ids)


def test_packing_keeps_null_and_large_ids(spark, monkeypatch):
    monkeypatch.setattr(packing, "FAN_IN", 4)
    ids = [None, -1, 0, 2**62 + 1, 2**53 + 1] * 12
    df = spark.createDataFrame([(i, "some words here") for i in ids], "doc_id long, text string").repartition(6)
    got = Counter(r.doc_id for r in packing.pack(df, public_tokenizers.path("word_bpe_49k.json"), 64, 1).collect())
    assert got == Counter(ids)
