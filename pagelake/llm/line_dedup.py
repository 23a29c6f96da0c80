"""Line dedup by an exact set-similarity join.

A line is its set of distinct words (A-Z lower-cased). A line goes if an earlier line, in the order of doc_id and line
number over the whole corpus, has a Jaccard similarity of at least the threshold (over 50 %), whether or not that one goes
too; so of equal sets the first stays. Lines without words stay.

Words are ordered by rarity: a 64-bit word hash gets, in place of its upper 16 bits, a rank by the count of its bucket in
the corpus. The table has 2^18 buckets whatever the corpus; any total order keeps the join exact, and the counts only make
the prefixes selective. Two similar sets of n and m words share a word among the first n - ceil(t n) + 1 and
m - ceil(t m) + 1 in that order (prefix filter). Lines that share a prefix word pass on only if their sizes allow the
threshold (length filter), if enough words are left after the shared one on both sides (positional filter), and if their
128-bit word maps differ in few enough bits (a word turns a bit over, so each bit that differs stands for a word that does). What passes is verified on the full sets, which are
gathered in one pass over the texts that hold them.

Equal sets are one class from the start, by a 128-bit digest. Word groups are read in order of line size, so that only
lines of fitting sizes meet. In groups of up to SMALL classes, each class is first paired with at most FIRST earlier ones
that pass the filters; in larger ones, or those of a very frequent word, which are dealt over several tasks, with one early
one. Where there may be more, the classes still without an earlier match meet the members that share a second word with
them. So a template with very many variants isn't expanded into all its pairs, and no pair is left out.

Defined results: a null text stays null. Rows with equal doc_id share their place, so that of their lines only one with a
higher number is later than another; their texts are told apart by a digest, and each loses its own lines alone. A null
doc_id comes after all others. Extra columns are carried; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, extended, only
from .words import FINE, Texts, Words, chunks, mix, tidy

#: Buckets of word hashes that are counted: a bounded table, whatever the corpus.
BITS = 18
BUCKETS = 1 << BITS
PARTS = 64
#: Classes of a word's group that are held against one another at once.
SMALL = 2_048
#: Candidates that a class gets from a group at first; where there may be more, they are looked for once these have failed.
FIRST = 4
#: From so many occurrences of a word's bucket on, or so many times the mean, its group is dealt over SALTS tasks.
FREQUENT = 50_000
TIMES_MEAN = 100
#: Rows that are gone through at once.
ROWS = 100_000
SALTS = 16
#: A class with more than a part in so many of the rows to look up is looked up where the rows are.
HOT = 1_000
_SALT_BIT = 40
_UNSALTED = ~((SALTS - 1) << _SALT_BIT)
_LAST = 2**63 - 1


class Lines:
    """The lines with words of a chunk of texts, and their sorted distinct word keys."""

    def __init__(self, column: pa.Array, rank: np.ndarray):
        texts = Texts(column, lower=True)
        words = Words(texts)
        breaks = np.flatnonzero(texts.bytes == 10)
        # A line begins with the first word of a text or after a line break; its number is that of the line breaks before it in its text.
        begin = np.unique(np.concatenate([words.bounds[:-1], np.searchsorted(words.starts, breaks)]))
        begin = begin[begin < words.n]
        self.text = np.searchsorted(words.bounds, begin, "right") - 1
        self.number = np.searchsorted(breaks, words.starts[begin]) - np.searchsorted(breaks, texts.offsets[:-1])[self.text]
        key = words.hashes()
        key = rank[(key >> np.uint64(64 - BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(48) | key & np.uint64(2**48 - 1)
        ends = np.append(begin, words.n)
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
            key[a:b].sort()
        keep = np.ones(words.n, bool)
        keep[1:] = key[1:] != key[:-1]
        keep[begin] = True
        self.keys = key[keep]
        self.begin = (np.cumsum(keep) - keep)[begin]
        self.sizes = np.diff(np.append(self.begin, len(self.keys)))
        self.n = len(begin)

    def _sums(self, seed: int) -> np.ndarray:
        if not self.n:
            return np.zeros(0, np.int64)
        return (np.add.reduceat(mix(self.keys ^ np.uint64(seed)), self.begin) + self.sizes.astype(np.uint64)).view(np.int64)

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of each set, in two halves."""
        return self._sums(0x2545F4914F6CDD1D), self._sums(0x5851F42D4C957F2D)

    def maps(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits, of which each word turns one over; so two sets differ in at least as many words as their maps do in bits."""
        if not self.n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place = mix(self.keys) >> np.uint64(57)
        bit = np.uint64(1) << (place & np.uint64(63))
        return tuple(np.bitwise_xor.reduceat(np.where(place >> np.uint64(6) == half, bit, np.uint64(0)), self.begin).view(np.int64) for half in range(2))

    def set_of(self, i: int) -> np.ndarray:
        return self.keys[self.begin[i] : self.begin[i] + self.sizes[i]]


def _ready(docs: DataFrame) -> DataFrame:
    return only(docs, "doc_id", "text").select(*_row_of("doc_id", "text"), "text")


def _row_of(doc_id: str, text: str) -> tuple[F.Column, F.Column]:
    """What tells rows apart, but for those of equal doc_id and text: the id and a digest of the text."""
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64(text).alias("own")


def rarity(docs: DataFrame, spare: bool = False) -> tuple[np.ndarray, int]:
    """The rank of each bucket of word hashes by its count over the whole corpus, and the rank from which words are frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in chunks(batch, "text", FINE):
                total += np.bincount((Words(Texts(part["text"], lower=True)).hashes() >> np.uint64(64 - BITS)).astype(np.int64), minlength=BUCKETS)
        counts = total.reshape(PARTS, -1)
        used = np.flatnonzero(counts.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([counts[i].tobytes() for i in used], pa.binary())], ["part", "counts"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch["part"].to_pylist(), batch["counts"].to_pylist()):
                own = np.frombuffer(counts, np.int64)
                total[part] = total[part] + own if part in total else own
        for part, counts in total.items():
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(used + part * (BUCKETS // PARTS), pa.int64()), pa.array(counts[used])], ["bucket", "words"])

    # A task sends its counts as PARTS arrays; each task after the exchange holds sums alone.
    counted = only(docs, "text").mapInArrow(tidy(run, spare), "part int, counts binary").repartition("part").mapInArrow(summed, "bucket long, words long").toArrow()
    bucket, words = counted["bucket"].to_numpy(), counted["words"].to_numpy()
    order = np.lexsort((bucket, words))
    place = np.arange(len(order)) * 65_535 // max(1, len(order))
    rank = np.zeros(BUCKETS, np.uint16)
    rank[bucket[order]] = place
    often = words[order] >= max(FREQUENT, TIMES_MEAN * words.mean()) if len(order) else np.zeros(0, bool)
    return rank, int(place[often][0]) if often.any() else 1 << 16


def _least(n, percent: int):
    """Words that a line of n must share with any similar one."""
    return (percent * n + 99) // 100


def _occurrences(docs: DataFrame, rank: np.ndarray, percent: int, spare: bool) -> DataFrame:
    """A row per line with words; prefix, with a word more than the prefix filter needs, only for the first of equal ones in a chunk, and null where no other line can be similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", FINE):
                lines = Lines(part["text"], rank)
                digest, second = lines.digests()
                doc = part["doc"].to_numpy()[lines.text]
                order = np.lexsort((lines.number, doc, second, digest))
                first = np.ones(lines.n, bool)
                first[order[1:]] = (np.diff(digest[order]) != 0) | (np.diff(second[order]) != 0)
                n = lines.sizes
                # Lines of up to three words have no similar line but equal ones unless the threshold is low.
                alone = (_least(n, percent) == n) & (100 * n < percent * (n + 1))
                size = np.where(first & ~alone, np.minimum(n, n - _least(n, percent) + 2), 0)
                shift = np.repeat(lines.begin - (np.cumsum(size) - size), size)
                prefix = lines.keys[shift + np.arange(len(shift))].view(np.int64)
                ends = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
                listed = pa.ListArray.from_arrays(ends, pa.array(prefix, pa.int64()), mask=pa.array(size == 0))
                kept = lambda x, none=size == 0: pa.array(x, pa.int64(), mask=none)
                yield pa.RecordBatch.from_arrays([pa.array(digest), pa.array(second), pa.array(doc), pa.array(part["own"].to_numpy()[lines.text]), pa.array(lines.number), kept(n), *map(kept, lines.maps()), listed], ["digest", "second", "doc", "own", "line", "n", "m1", "m2", "prefix"])

    return _ready(docs).mapInArrow(tidy(run, spare), "digest long, second long, doc long, own long, line long, n long, m1 long, m2 long, prefix array<long>")


#: Rows of word groups: size and place of the word are in one number, the size first.
_ROW = ["word", "sized", "digest", "m1", "m2", "doc", "line"]
_NAMES = ["a", "b", *_ROW, "more"]
#: In `more`: 0 for a row that is only met, 1 for one that may have more earlier matches, _LARGE for any row of a large group.
_LARGE = 2
_CANDIDATE = ", ".join(f"{c} long" for c in _NAMES)


def _passes(rows: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether rows i and j, which share a word, pass the length, positional and map filter."""
    n, m = rows["n"][i], rows["n"][j]
    need = (percent * (n + m) + 99 + percent) // (100 + percent)
    good = (rows["digest"][i] != rows["digest"][j]) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (np.minimum(n - rows["at"][i], m - rows["at"][j]) >= need)
    apart = sum(np.bitwise_count((rows[k][i] ^ rows[k][j]).view(np.uint64)).astype(np.int64) for k in ("m1", "m2"))
    return good & (n + m - apart >= 2 * need)


def _in_groups(percent: int, frequent: int):
    """Rows sorted by word -> candidate pairs (a before b in the corpus), and the rows of large groups."""

    def before(doc, line, other_doc, other_line):
        return (doc < other_doc) | (doc == other_doc) & (line < other_line)

    def in_order(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """Sorted by (word, sized, digest, doc, line). Words are in runs already, so they are numbered; few rows tie on the first two."""
        run = np.cumsum(np.diff(rows["word"], prepend=rows["word"][:1]) != 0)
        order = np.lexsort((rows["sized"], run))
        run, sized = run[order], rows["sized"][order]
        same = (run[1:] == run[:-1]) & (sized[1:] == sized[:-1])
        tied = np.flatnonzero(np.append(same, False) | np.append(False, same))
        own = order[tied]
        order[tied] = own[np.lexsort((rows["line"][own], rows["doc"][own], rows["digest"][own], sized[tied], run[tied]))]
        return {k: v[order] for k, v in rows.items()}

    def of_groups(rows: dict[str, np.ndarray], hub: dict | None, goes_further: bool) -> tuple[list[dict[str, np.ndarray]], dict | None]:
        """Output for whole groups of one row a class, but that the first may continue the large group of `hub`, and the last is large and goes on if it `goes_further`."""
        word = rows["word"]
        rows = rows | {"n": rows["sized"] >> 32, "at": rows["sized"] & (2**32 - 1)}
        n = rows["n"]
        new = np.ones(len(word), bool)
        new[1:] = word[1:] != word[:-1]
        begin = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        size = np.diff(np.append(begin, len(word)))
        large = (size > SMALL) | (word[begin].view(np.uint64) >> np.uint64(48) >= frequent)
        goes_on = hub is not None and hub["word"][0] == word[0]
        large[0] |= goes_on
        large[-1] |= goes_further
        out = []
        # Within a small group rows are in order of n: once a later row is too long, all after it are.
        doc, line, digest = rows["doc"], rows["line"], rows["digest"]
        i, lag, got = np.flatnonzero(~large[group] & (size[group] > 1)), 0, np.zeros(len(word), np.int64)
        more, beside = np.zeros(len(word), bool), np.zeros(len(word), bool)
        end = (begin + size)[group]
        while len(i):
            lag += 1
            i = i[i + lag < end[i]]
            i = i[percent * n[i + lag] <= 100 * n[i]]
            x = i[_passes(rows, i, i + lag, percent)]
            y = x + lag
            later = before(doc[x], line[x], doc[y], line[y])
            x, y = np.where(later, x, y), np.where(later, y, x)
            sure = before(doc[x], line[x], doc[y], line[y])  # else both have the same place
            x, y = x[sure], y[sure]
            open_ = got[y] < FIRST
            out.append({"a": digest[x[open_]], "b": digest[y[open_]]})
            np.add.at(got, y[open_], 1)
            more[y[~open_]] = beside[x[~open_]] = True
        left = more | beside
        out.append({k: rows[k][left] for k in _ROW} | {"more": more[left].astype(np.int64)})
        for g in np.flatnonzero(large):
            own = np.arange(begin[g], begin[g] + size[g])
            if not (g == 0 and goes_on):
                first = own[np.lexsort((line[own], doc[own]))[0]]
                hub = {k: v[first : first + 1] for k, v in rows.items()}
            both = {k: np.concatenate([hub[k], rows[k][own]]) for k in rows}
            good = own[_passes(both, np.zeros(len(own), np.int64), np.arange(1, len(own) + 1), percent)]
            for late, a, b in ((before(hub["doc"][0], hub["line"][0], doc[good], line[good]), None, good), (before(doc[good], line[good], hub["doc"][0], hub["line"][0]), good, None)):
                pick = good[late]
                fixed = np.repeat(hub["digest"], len(pick))
                out.append({"a": fixed if a is None else digest[pick], "b": fixed if b is None else digest[pick]})
            out.append({k: rows[k][own] for k in _ROW} | {"more": np.full(len(own), _LARGE)})
        return out, hub if large[-1] else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        hub = None

        def settle(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, hub
            rows = in_order({k: np.concatenate([h[k] for h in held]) for k in _ROW})
            # A class counts once in a group, by its first place; so the group's size is that of its classes.
            again = np.zeros(len(rows["word"]), bool)
            again[1:] = (rows["word"][1:] == rows["word"][:-1]) & (rows["digest"][1:] == rows["digest"][:-1])
            rows = {k: v[~again] for k, v in rows.items()}
            held, goes_further = [], False
            if not last:
                # The last group's end isn't seen yet: it waits, unless it is large already.
                differs = rows["word"] != rows["word"][-1]
                at = int(np.flatnonzero(differs)[-1]) + 1 if differs.any() else 0
                if len(differs) - at > SMALL:
                    # The last class waits alone, in case that more of its rows follow.
                    at, goes_further = len(differs) - 1, True
                held = [{k: v[at:] for k, v in rows.items()}]
                rows = {k: v[:at] for k, v in rows.items()}
            if not len(rows["word"]):
                return
            out, hub = of_groups(rows, hub, goes_further)
            a, b = (np.concatenate([x[k] for x in out if "a" in x] or [np.zeros(0, np.int64)]) for k in ("a", "b"))
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            for x in ({"a": a[new], "b": b[new]}, *[x for x in out if "a" not in x]):
                size = len(next(iter(x.values())))
                yield pa.RecordBatch.from_arrays([pa.array(x[c]) if c in x else pa.nulls(size, pa.int64()) for c in _NAMES], _NAMES)

        n = 0
        for batch in batches:
            if batch.num_rows:
                held.append({k: batch[k].to_numpy() for k in _ROW})
                n += batch.num_rows
            if n >= ROWS:
                yield from settle(False)
                n = 0
        if held:
            yield from settle(True)

    return run


def _sets(needed: DataFrame, classes: DataFrame, docs: DataFrame, rank: np.ndarray, scratch: Scratch, name: str, spare: bool) -> DataFrame:
    """digest, second, doc, line, words: the sets of the needed(digest) classes and their first places, from one pass over the texts that have these."""
    places = classes.select("digest", "second", "doc", "own", "line").join(needed, "digest").groupBy("doc", "own").agg(F.collect_list(F.struct("line", "digest", "second")).alias("wanted"))
    places = scratch.write(places, f"{name}_places")

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", FINE):
                lines = Lines(part["text"], rank)
                wanted = {(t, x["line"]): (x["digest"], x["second"]) for t, own in enumerate(part["wanted"].to_pylist()) for x in own}
                doc = part["doc"].to_numpy()
                found = [(*wanted[place], doc[place[0]], place[1], lines.set_of(i).tobytes()) for i, place in enumerate(zip(lines.text.tolist(), lines.number.tolist())) if place in wanted]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)], ["digest", "second", "doc", "line", "words"])

    # Of repeated rows one is enough; their grouping needs no further exchange where the join has sorted them.
    held = _ready(docs).join(places, ["doc", "own"]).groupBy("doc", "own").agg(F.first("text").alias("text"), F.first("wanted").alias("wanted"))
    return scratch.write(held.select("doc", "text", "wanted").mapInArrow(tidy(to_sets, spare), "digest long, second long, doc long, line long, words binary"), name)


def _later(pairs: DataFrame, sets: DataFrame, percent: int, spare: bool) -> DataFrame:
    """digest, second: of the pairs (a, b) of digests whose sets are similar, the class that comes later."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch["x_words"].to_pylist(), batch["y_words"].to_pylist())):
                both = np.sort(np.frombuffer(x + y, np.uint64))
                common = int((both[1:] == both[:-1]).sum())
                good[i] = 100 * common >= percent * (len(both) - common)
            yield pa.RecordBatch.from_arrays([batch["digest"], batch["second"]], ["digest", "second"]).filter(pa.array(good))

    side = lambda name: sets.select(*[F.col(c).alias(f"{name}_{c}") for c in sets.columns])
    joined = pairs.join(side("x"), F.col("a") == F.col("x_digest")).join(side("y"), F.col("b") == F.col("y_digest"))
    x_place, y_place = F.struct("x_doc", "x_line"), F.struct("y_doc", "y_line")
    pick = lambda c: F.when(x_place < y_place, F.col(f"y_{c}")).otherwise(F.col(f"x_{c}")).alias(c)
    return joined.where(x_place != y_place).select(pick("digest"), pick("second"), "x_words", "y_words").mapInArrow(tidy(compare, spare), "digest long, second long").distinct()


def _rest(big: DataFrame, late: DataFrame, found: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of the late rows with all earlier members of their groups.

    In large groups these share a second word: similar lines have two words at least in common among the first
    n - ceil(t n) + 2, and the first of these is that of a group of both; so large groups are parted by the words after it."""

    def passing(x: DataFrame, y: DataFrame, *keys: str) -> DataFrame:
        x, y = x.alias("x"), y.alias("y")
        n = lambda side: F.shiftright(f"{side}.sized", 32)
        left = lambda side: n(side) - F.col(f"{side}.sized").bitwiseAND(F.lit(2**32 - 1))
        need = F.floor((percent * (n("x") + n("y")) + 99 + percent) / (100 + percent))
        apart = sum(F.bit_count(F.col(f"x.{m}").bitwiseXOR(F.col(f"y.{m}"))) for m in ("m1", "m2"))
        passes = (
            (F.struct("x.doc", "x.line") < F.struct("y.doc", "y.line"))
            & (100 * F.least(n("x"), n("y")) >= percent * F.greatest(n("x"), n("y")))
            & (F.least(left("x"), left("y")) >= need)
            & (n("x") + n("y") - apart >= 2 * need)
        )
        for key in keys:
            passes = (F.col(f"x.{key}") == F.col(f"y.{key}")) & passes
        return x.join(y, passes).select(F.col("x.digest").alias("a"), F.col("y.digest").alias("b"))

    pairs = passing(big.where(F.col("more") < _LARGE), late.where(F.col("more") < _LARGE), "word")
    late = late.where(F.col("more") == _LARGE)
    if not late.isEmpty():
        met = scratch.write(big.where(F.col("more") == _LARGE).join(late.select("word").distinct(), "word", "left_semi"), "met")
        asked = scratch.write(met.select("digest").distinct(), "asked")
        prefixes = scratch.write(found.where("prefix IS NOT NULL").select("digest", "prefix").join(asked, "digest").groupBy("digest").agg(F.first("prefix").alias("prefix")), "prefixes")
        place = F.col("sized").bitwiseAND(F.lit(2**32 - 1)).cast("int")
        parted = lambda rows: rows.join(prefixes, "digest").select(*_ROW, F.explode(F.slice("prefix", place + 2, F.size("prefix"))).alias("other"))
        pairs = pairs.union(passing(parted(met), parted(late), "word", "other"))
    return pairs.distinct()


def _gone(found: DataFrame, classes: DataFrame, matched: DataFrame, scratch: Scratch) -> DataFrame:
    """doc, own, lines: matched classes go wholly, of the others all but the first place."""
    named = classes.join(matched.withColumn("matched", F.lit(True)), ["digest", "second"], "left").where("matched OR again")
    named = scratch.write(named.select("digest", "second", F.struct("doc", "line").alias("first"), F.coalesce("matched", F.lit(False)).alias("matched"), "rows"), "named")
    total = named.agg(F.sum("rows")).first()[0] or 0
    # The few classes with more than a thousandth of these rows are looked up where the rows are: fewer than a thousand, whatever the corpus.
    hot = F.broadcast(named.where(F.col("rows") * HOT > total))
    key, rows = ["digest", "second"], found.select("digest", "second", "doc", "own", "line")
    gone = rows.join(hot, key).unionByName(rows.join(hot, key, "left_anti").join(named.where(F.col("rows") * HOT <= total), key))
    gone = gone.where(F.col("matched") | (F.struct("doc", "line") > F.col("first")))
    return scratch.write(gone.groupBy("doc", "own").agg(F.collect_set("line").alias("lines")), "gone")


def later_matches(docs: DataFrame, percent: int = 80, spare: bool = False) -> DataFrame:
    """docs(doc_id, text) -> doc, own, lines: the numbers (from 0) of the lines of each document, by id and digest of its text, that go.

    spare: workers give their free memory back after each task, which takes a little more time."""
    if not 50 < percent <= 100:
        raise ValueError("percent must be over 50 and at most 100")
    scratch = Scratch(docs.sparkSession, "lines")
    rank, frequent = rarity(docs, spare)
    found = scratch.write(_occurrences(docs, rank, percent, spare), "occurrences")

    n = F.col("n")
    rows = found.where("prefix IS NOT NULL").select("digest", "doc", "line", "n", "m1", "m2", F.posexplode(F.slice("prefix", F.lit(1), (n - F.floor((percent * n + 99) / 100) + 1).cast("int"))).alias("at", "word"))
    is_frequent = F.shiftrightunsigned("word", 48) >= frequent
    salt = F.shiftleft(F.pmod(F.xxhash64("digest"), F.lit(SALTS)), _SALT_BIT)
    rows = rows.select(F.when(is_frequent, F.col("word").bitwiseXOR(salt)).otherwise(F.col("word")).alias("word"), (F.shiftleft("n", 32) + F.col("at")).alias("sized"), "digest", "m1", "m2", "doc", "line")
    groups = scratch.write(rows.repartition("word").sortWithinPartitions("word").mapInArrow(tidy(_in_groups(percent, frequent), spare), _CANDIDATE), "groups")

    place = F.struct("doc", "line", "own")
    classes = found.groupBy("digest", "second").agg(F.min(place).alias("p"), F.max(place).alias("q"), F.count("*").alias("rows"))
    classes = scratch.write(classes.select("digest", "second", "p.doc", "p.own", "p.line", (F.struct("p.doc", "p.line") != F.struct("q.doc", "q.line")).alias("again"), "rows"), "classes")
    pairs = scratch.write(groups.where("a IS NOT NULL").select("a", "b").distinct(), "pairs")
    big = groups.where("a IS NULL").drop("a", "b").withColumn("word", F.col("word").bitwiseAND(F.lit(_UNSALTED)))
    needed = pairs.select(F.explode(F.array("a", "b")).alias("digest")).union(big.where(F.col("more") < _LARGE).select("digest")).distinct()
    sets = _sets(needed, classes, docs, rank, scratch, "sets", spare)
    matched = scratch.write(_later(pairs, sets, percent, spare), "matched")
    # Those that may have more candidates and are still without an earlier match.
    late = scratch.write(big.where("more > 0").join(matched.select("digest").distinct(), "digest", "left_anti"), "late")
    if not late.isEmpty():
        rest = scratch.write(_rest(big, late, found, percent, scratch).join(pairs, ["a", "b"], "left_anti"), "rest")
        missing = scratch.write(rest.select(F.explode(F.array("a", "b")).alias("digest")).distinct().join(sets.select("digest"), "digest", "left_anti"), "missing")
        if not missing.isEmpty():
            sets = sets.union(_sets(missing, classes, docs, rank, scratch, "more_sets", spare))
        matched = scratch.write(matched.union(_later(rest, sets, percent, spare)).distinct(), "all_matched")
    gone = _gone(found, classes, matched, scratch)
    scratch.drop_all_but(gone)
    return gone


def dedup_lines(docs: DataFrame, percent: int = 80, spare: bool = False) -> DataFrame:
    """The documents with later lines removed, and n_lines (with words) and n_removed at the end; n_chars follows the text if there is such a column."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    text, doc = (names[docs.columns.index(c)] for c in ("text", "doc_id"))
    gone = later_matches(docs, percent, spare)
    row_doc, row_own = _row_of(doc, text)
    joined = docs.toDF(*names).join(gone.hint("shuffle_hash"), (row_doc == F.col("doc")) & (row_own == F.col("own")), "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text):
                out, n_lines, n_gone = [], [], []
                # Only documents that lose a line are taken apart.
                for t, lines in zip(part[text].to_pylist(), part["lines"].to_pylist()):
                    own = t.split("\n") if t is not None else []
                    n_lines.append(sum(1 for line in own if line.strip(" \t\n\v\f\r")))
                    n_gone.append(len(lines or ()))
                    if lines:
                        drop = set(lines)
                        t = "\n".join(line for i, line in enumerate(own) if i not in drop)
                    out.append(t)
                cols = [pa.array(out, part.schema.field(text).type) if c == text else part[c] for c in names]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(n_lines, pa.int64()), pa.array(n_gone, pa.int64())], [*names, "n_lines", "n_removed"])

    kept = joined.select(*names, "lines")
    out = kept.mapInArrow(tidy(cut, spare), extended(kept, names, {"n_lines": "long", "n_removed": "long"}))
    if "n_chars" in docs.columns:
        chars = names[docs.columns.index("n_chars")]
        out = out.withColumn(chars, F.when(F.col("n_removed") > 0, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col(chars)))
    return out.toDF(*docs.columns, "n_lines", "n_removed")
