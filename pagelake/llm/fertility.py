"""Quality rules: counts of words, lines and signs, and tokeniser fertility.

A public vocabulary encodes every whole text, word by word. Its characters per token, share of byte-fallback tokens and
entropy of the token distribution (bits) must lie in a band, chosen by the row's language if BANDS names it, else by the
script that most of its letters belong to. Junk that a vocabulary wasn't made for, and loops of few words, fall outside.

Defined results: a null or empty text has no words, all its counts are 0 and its measures null; it fails the base rules.
A null language counts as unknown. Repeated rows get equal rows; extra columns are carried by `keep`; empty gives empty.
Each text is measured whole; a word's ids are kept for a while in each worker, which changes no result.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .shared import extended, only
from .words import CHUNK_BYTES, Memo, Texts, Words, chunks, give_back, ragged

#: (least, most) characters per token, most share of byte-fallback tokens, least entropy in bits of a token.
#: Languages come before scripts. For en, de, fr and es the least characters per token are the 5 % quantile and the least
#: entropy the 0.5 % quantile (both rounded down) of all rows of that language in sf0.1 that pass the base rules; latin
#: has the lowest of the four. Junk has few characters per token, so that the upper side is wide. No row of sf0.1 has a
#: fallback token, nor another script: these bounds are set by hand, and wide.
BANDS: dict[str, tuple[float, float, float, float]] = {
    "en": (2.031, 8.0, 0.10, 5.429),
    "de": (2.074, 8.0, 0.10, 5.473),
    "fr": (1.882, 8.0, 0.10, 5.513),
    "es": (1.856, 8.0, 0.10, 5.377),
    "latin": (1.856, 8.0, 0.10, 5.377),
    "greek": (0.4, 6.0, 0.50, 3.0),
    "cyrillic": (0.6, 8.0, 0.30, 3.0),
    "semitic": (0.3, 6.0, 0.60, 3.0),
    "indic": (0.2, 6.0, 0.95, 3.0),
    "cjk": (0.2, 4.0, 0.95, 3.0),
    "hangul": (0.2, 4.0, 0.95, 3.0),
    "none": (0.2, 12.0, 0.95, 0.0),
}
#: Words of which a worker keeps the ids, in each of two generations.
MEMO = 150_000
SCRIPTS = ("none", "latin", "greek", "cyrillic", "semitic", "indic", "cjk", "hangul")

#: The script of a letter by the first byte of its UTF-8 form.
_SCRIPT = np.zeros(256, np.uint8)
_SCRIPT[ord("A") : ord("Z") + 1] = _SCRIPT[ord("a") : ord("z") + 1] = 1
for _range, _k in (((0xC3, 0xCA), 1), ((0xCD, 0xD0), 2), ((0xD0, 0xD4), 3), ((0xD6, 0xDC), 4), ((0xE0, 0xE2), 5), ((0xE3, 0xEA), 6), ((0xEA, 0xEE), 7)):
    _SCRIPT[slice(*_range)] = _k
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in "#*$%&|<>"]] = True

MEASURES = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean", "n_tokens": "long", "chars_per_token": "double", "fallback_share": "double", "token_entropy": "double", "band": "string", "kept": "boolean"}


class Vocabulary:
    """Ids of words under a sentencepiece model (byte fallback: its byte pieces) or a byte-level BPE file (its bare non-ASCII bytes)."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.size = model.get_piece_size()
            self.fallback = np.array([model.is_byte(i) or model.is_unknown(i) for i in range(self.size)])
            encode = lambda words: model.encode(words, num_threads=1)
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.encode_special_tokens = True
            self.size = model.get_vocab_size()
            self.fallback = np.zeros(self.size, bool)
            self.fallback[[i for t, i in model.get_vocab().items() if len(t.removesuffix("</w>")) == 1 and not t[0].isascii()]] = True
            encode = lambda words: [e.ids for e in map(lambda w: model.encode(w, add_special_tokens=False), words)]
        self.ids = Memo(lambda words: [array("i", x).tobytes() for x in encode(words)], MEMO)


_OPEN: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _OPEN:
        _OPEN[path] = Vocabulary(path)
    return _OPEN[path]


def _repeats(words: Words, codes: np.ndarray, n_codes: int) -> np.ndarray:
    """Per text: words inside a 3-word window that the text has twice or more."""
    n = words.n
    if n < 3:
        return np.zeros(words.texts.n, np.int64)
    whole = words.text[2:] == words.text[:-2]
    at = np.flatnonzero(whole)
    key = codes[at].astype(np.int64)
    for more in (codes[at + 1], codes[at + 2], words.text[at]):
        size = int(more.max(initial=0)) + 1
        if key.max(initial=0) >= 2**62 // size:
            key = pd.factorize(key)[0]
        key = key * size + more
    twice = at[pd.Series(key).duplicated(keep=False).to_numpy()]
    hit = np.zeros(n, bool)
    for j in range(3):
        hit[twice + j] = True
    return np.bincount(words.text[hit], minlength=words.texts.n)


def _dup_lines(texts: Texts, words: Words) -> np.ndarray:
    """Per text: lines with a word that equal an earlier line."""
    breaks = texts.bytes == 10
    begin = np.zeros(len(breaks) + 1, bool)
    begin[1:] = breaks
    begin[texts.offsets[:-1]] = True
    begin = np.flatnonzero(begin[:-1])
    if not len(begin) or not words.n:
        return np.zeros(texts.n, np.int64)
    end = np.append(begin[1:], len(breaks))
    end = end - (breaks[end - 1] & (end > begin))
    wordy = np.diff(np.append(np.searchsorted(words.starts, begin), words.n)) > 0
    begin, end = begin[wordy], end[wordy]
    text = np.searchsorted(texts.offsets, begin, "right") - 1
    raw = memoryview(np.ascontiguousarray(texts.bytes))
    lines = pd.factorize(np.array([bytes(raw[a:b]) for a, b in zip(begin, end)] + [None], object)[:-1])[0]
    again = pd.Series(lines * np.int64(texts.n) + text).duplicated().to_numpy()
    return np.bincount(text[again], minlength=texts.n)


def measure(column: pa.Array, langs: list[str | None], path: str, bands: dict[str, tuple[float, float, float, float]]) -> dict[str, np.ndarray | list]:
    """The measures of a chunk of whole texts."""
    texts = Texts(column)
    words = Words(texts)
    coded = words.strings().dictionary_encode()
    codes = coded.indices.to_numpy()
    n_words = words.counts
    chars = texts.per_text(words.solid & (texts.bytes & 0xC0 != 0x80))
    repeats = _repeats(words, codes, len(coded.dictionary))
    failed = (n_words < 50) | (100 * repeats > 50 * n_words)

    vocab = vocabulary(path)
    ids, per_word = ragged(vocab.ids(coded.dictionary.to_pylist()), codes)
    token_ends = np.concatenate([[0], np.cumsum(per_word)])[words.bounds]
    n_tokens = np.diff(token_ends)
    text_of = np.repeat(np.arange(texts.n), n_tokens)
    fallback = np.bincount(text_of, vocab.fallback[ids], texts.n)
    entropy = np.zeros(texts.n)
    for at in range(0, texts.n, 64):
        to = min(at + 64, texts.n)
        own = slice(token_ends[at], token_ends[to])
        counts = np.bincount((text_of[own] - at) * vocab.size + ids[own], minlength=(to - at) * vocab.size)
        used = np.flatnonzero(counts)
        share = counts[used] / n_tokens[at + used // vocab.size]
        entropy[at:to] = np.bincount(used // vocab.size, -share * np.log2(share), to - at)

    script = np.stack([texts.per_text(_SCRIPT[texts.bytes] == k) for k in range(1, len(SCRIPTS))])
    main = np.where(script.any(0), 1 + script.argmax(0), 0)
    band = [lang if lang in bands else SCRIPTS[k] for lang, k in zip(langs, main)]
    least, most, bytes_most, bits = np.array([bands.get(b, (0, np.inf, 1, 0)) for b in band], float).reshape(-1, 4).T
    with np.errstate(all="ignore"):
        per_token, share = chars / n_tokens, fallback / n_tokens
    fits = (per_token >= least) & (per_token <= most) & (share <= bytes_most) & (entropy >= bits)
    none = n_tokens == 0
    return {"n_words": n_words, "word_chars": chars, "n_symbols": texts.per_text(_SIGN[texts.bytes]), "n_dup_lines": _dup_lines(texts, words), "n_repeat_words": repeats, "base_failed": failed, "n_tokens": n_tokens} | {
        k: pa.array(v, pa.float64(), mask=none) for k, v in (("chars_per_token", per_token), ("fallback_share", share), ("token_entropy", entropy))
    } | {"band": band, "kept": ~failed & fits & ~none}


def quality(docs: DataFrame, vocab_path: str, keep: list[str], bands: dict = BANDS, drop: bool = False, chunk: int = CHUNK_BYTES, memo: int = MEMO) -> DataFrame:
    """docs(text, lang, ...) -> the columns `keep` and MEASURES; with drop: only the rows kept, with the columns `keep` alone.

    chunk: bytes of whole texts that a worker measures at once; memo: words whose ids a worker keeps. Fewer take less memory and more time."""
    need = list(dict.fromkeys([*keep, "text", *(["lang"] if "lang" in docs.columns else [])]))
    ready = only(docs, *need)
    schema = extended(ready, keep, {} if drop else MEASURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary(vocab_path).ids.size = memo
        for batch in batches:
            for part in chunks(batch, "text", chunk):
                langs = part["lang"].to_pylist() if "lang" in part.schema.names else [None] * part.num_rows
                found = measure(part["text"], langs, vocab_path, bands)
                own = [part[c] for c in keep]
                if drop:
                    yield pa.RecordBatch.from_arrays(own, keep).filter(pa.array(found["kept"]))
                else:
                    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "string": pa.string()}
                    yield pa.RecordBatch.from_arrays([*own, *[v if isinstance(v := found[k], pa.Array) else pa.array(v, kinds[t]) for k, t in MEASURES.items()]], [*keep, *MEASURES])
            give_back()

    return ready.mapInArrow(run, schema)
