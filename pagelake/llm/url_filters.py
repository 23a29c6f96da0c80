"""URL filter: a bit-parallel wildcard automaton over canonical URLs.

All glob rules are packed one after another into one long bit vector. A rule of m symbols owns m + 1 bits, the states
"so many symbols read". Reading character c turns the set S of active states into ((S << 1) & M[c]) | (S & L): M[c] has
the states that c may enter, L those with a star, which may stay. The first state of a rule is in no M[c], so nothing
carries over from one rule to the next. A rule fits if its last state is active at the end. All rules and, in the
batched form, all URLs of an Arrow batch move together; the vector spans as many 64-bit words as the rules need.

Defined results: a null URL, or one without "://", has empty host and path, fits no rule and is judged by the default.
Repeated rows are judged alike; extra columns are kept, but for any named as a result, which the result replaces; an empty
table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import extended, only


@dataclass(frozen=True)
class Rule:
    """A glob (`*` any run, `?` one byte, `\\` quotes) over the canonical URL, its label and verdict. The longest label that fits wins.

    The canonical URL is `.host/path`. For a rule that is `split`, it is `.host#/path`: neither part can hold a `#`, so
    what stands before it in the glob fits the host alone."""

    glob: str
    label: str
    verdict: str
    split: bool = False


def site_rule(host: str, path: str, verdict: str) -> Rule:
    """Fits the host and its subdomains where the path starts with `path`."""
    quote = lambda s: "".join("\\" + c if c in "*?\\" else c for c in s)
    return Rule(f"*.{quote(host)}#{quote(path)}*", host + path, verdict, split=True)


class Automaton:
    """Shift-And masks of many globs."""

    def __init__(self, globs: Iterable[str]):
        chars = [0] * 256
        loop = start = at = 0
        self.final: list[int] = []
        for glob in globs:
            start |= 1 << at
            raw, i = glob.encode(), 0
            while i < len(raw):
                c = raw[i]
                if c == ord("*"):
                    loop |= 1 << at
                else:
                    any_byte = c == ord("?")
                    if c == ord("\\") and i + 1 < len(raw):
                        i += 1
                        c = raw[i]
                    at += 1
                    for b in range(256) if any_byte else (c,):
                        chars[b] |= 1 << at
                i += 1
            self.final.append(at)
            at += 1
        self.words = max(1, -(-at // 64))
        self.chars, self.loop, self.start = chars, loop, start
        split = lambda x: [(x >> (64 * w)) & (2**64 - 1) for w in range(self.words)]
        self._chars = np.array([split(x) for x in chars], np.uint64)
        self._loop, self._start = np.array(split(loop), np.uint64), np.array(split(start), np.uint64)

    def run(self, url: bytes) -> int:
        """The active states after one URL."""
        s, chars, loop = self.start, self.chars, self.loop
        for c in url:
            s = (s << 1) & chars[c] | s & loop
        return s

    def fits(self, urls: list[bytes]) -> np.ndarray:
        """A row of booleans, one for each glob, for each URL. URLs advance in step; the few longest go on alone."""
        n = np.array([len(u) for u in urls], np.int64)
        order = np.argsort(-n, kind="stable")
        data = np.frombuffer(b"".join(urls[i] for i in order), np.uint8)
        size = n[order]
        begin = np.cumsum(size) - size
        state = np.repeat(self._start[None], len(urls), 0)
        out = np.empty((len(urls), len(self.final)), bool)
        step, alive = 0, int((size > 0).sum())
        while alive > 8:
            s = state[:alive]
            moved = s << np.uint64(1)
            moved[:, 1:] |= s[:, :-1] >> np.uint64(63)
            state[:alive] = moved & self._chars[data[begin[:alive] + step]] | s & self._loop
            step += 1
            alive = int(np.searchsorted(-size, -step, "left"))
        for i in range(alive):
            value = sum(int(w) << (64 * k) for k, w in enumerate(state[i]))
            for c in data[begin[i] + step : begin[i] + size[i]].tobytes():
                value = (value << 1) & self.chars[c] | value & self.loop
            state[i] = [(value >> (64 * w)) & (2**64 - 1) for w in range(self.words)]
        for k, f in enumerate(self.final):
            out[order, k] = (state[:, f // 64] >> np.uint64(f % 64)) & np.uint64(1) == 1
        return out


def canonical(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host (A-Z lower-cased) and path of a URL column."""
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.locate("://", url) > 0, url.substr(F.locate("://", url) + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(F.regexp_replace(rest, r"^[^/?#]*", ""), r"(?s)^[^?#]*", 0)
    return host, path


def filter_urls(pages: DataFrame, rules: list[Rule], default: str = "allow", fallback: list[Rule] = ()) -> DataFrame:
    """Adds host, path, rule, pattern and verdict to pages(url, ...).

    rule: label of the longest of `rules` that fits (then the one named first). Where none fits, the longest of
    `fallback` decides and its label is in `pattern`; where none of these fits either, `default` does."""
    every = [*rules, *fallback]
    rank = sorted(range(len(every)), key=lambda k: (k >= len(rules), -len(every[k].label), k))
    labels = [every[k].label for k in rank]
    verdicts = [every[k].verdict for k in rank]
    kinds = [(sign, own, [every[rank[i]].glob for i in own]) for sign, split in (("#", True), ("", False)) if (own := [i for i, k in enumerate(rank) if every[k].split == split])]
    n_rules = len(rules)
    built: list[Automaton] = []

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if len(built) < len(kinds):
            built.extend(Automaton(globs) for _, _, globs in kinds)
        names = [*labels, None]
        for batch in batches:
            host, path = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("host", "path"))
            fits = np.zeros((len(host), len(labels)), bool)
            for machine, (sign, own, _) in zip(built, kinds):
                fits[:, own] = machine.fits([f".{h}{sign}{p}".encode() for h, p in zip(host, path)])
            first = np.where(fits.any(1), fits.argmax(1), len(labels)) if len(labels) else np.zeros(len(host), int)
            cols = [pa.array([names[i] if i < n_rules else None for i in first], pa.string()), pa.array([names[i] if i >= n_rules else None for i in first], pa.string()), pa.array([verdicts[i] if i < len(verdicts) else default for i in first], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], [*batch.schema.names, "rule", "pattern", "verdict"])

    kept = [f for f in pages.schema.fields if f.name not in ("host", "path", "rule", "pattern", "verdict")]
    host, path = canonical(F.col("url"))
    ready = only(pages, *[f.name for f in kept]).select(*[f.name for f in kept], host.alias("host"), path.alias("path"))
    schema = extended(ready, ready.columns, {"rule": "string", "pattern": "string", "verdict": "string"})
    return ready.mapInArrow(judge, schema)
