"""Periodic runs in texts: stretches of words that repeat with some period, found while reading.

A run is a stretch of consecutive words in which words one period apart are equal, that no
neighbouring word extends; its period is the smallest one. Runs are put together from squares, which
are caught online: words are appended, and for every power of two L the completed blocks of L words
(at multiples of L) are catchers. The window of the last L words is compared with the catchers that
lie 2 L to 4 L words back; there are two of them, whatever the text. The first half of a square of
period p holds a whole block for every L up to p / 2, and that block comes again p words later, so
each square is caught at the level where 2 L <= p < 4 L. A catch is led on to both sides by comparing
suffixes and prefixes; if it reaches a square, the square joins the run of its period and start. A
stretch that reaches the last word stays open and grows with the words appended next.

Comparisons go by names: the name of a window of 2 L words is a scramble of those of its halves, so
an appended word costs a few steps per level and a comparison of any length a few per level too. A
word is named exactly (its number in a dictionary of the batch), longer windows by 64 bits; every run
found is compared word by word, and a batch with a wrong one is named anew.

Texts are worked on one by one or as slices of a batch, each row by itself: nothing is shuffled. Only
texts in which a window of the least length of a repeat comes twice are read for squares; others have
no run.

Defined results: null and empty texts have no words, no run and an empty text; ids may be null or
repeated, every row has its own result. An empty table gives no rows. Extra columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from censemble.llm.flat import flat, joined, mix, sliced, windows, words

LEAST_WORDS, LEAST_EXPONENT = 6, 4
# Words appended at a time.
STEP = 1 << 16


class Catchers:
    """Squares in a sequence of numbers (words) that grows by ``append``.

    ``most``: the largest period looked for.
    """

    def __init__(self, most: int, seed: int = 1) -> None:
        self.most, self.seed = most, np.uint64(seed)
        self.words = np.zeros(0, dtype=np.int64)
        self.divisor = _smallest_divisors(max(most, 1))
        # Names of the windows of 2**level words by where they begin.
        self.names = [np.zeros(0, dtype=np.uint64)]
        while 4 << len(self.names) - 1 <= most:
            self.names.append(np.zeros(0, dtype=np.uint64))
        # (period, start) of each square or run -> end of the stretch whose words are equal to those a
        # period on. Open stretches reach the last word, whether they are squares yet or not.
        self.found: dict[tuple[int, int], int] = {}
        self.open: dict[tuple[int, int], int] = {}

    def append(self, words: np.ndarray) -> None:
        """Read more words, and take in what squares they complete."""
        known = [len(n) for n in self.names]
        self.words = np.concatenate([self.words, words])
        self._name()
        if self.open:
            p, s, e = np.array([(p, s, e) for (p, s), e in self.open.items()], dtype=np.int64).T
            self.open = {}
            self._take(p, s, e + self._ahead(e, e + p))
        for level, first in enumerate(known):
            self._catch(level, first)

    def _name(self) -> None:
        with np.errstate(over="ignore"):
            new = self.words[len(self.names[0]) :].astype(np.uint64)
            self.names[0] = np.concatenate([self.names[0], mix(new + self.seed * np.uint64(0x9E3779B97F4A7C15))])
            for level in range(1, len(self.names)):
                half, below, known = 1 << level - 1, self.names[level - 1], len(self.names[level])
                if len(below) - half > known:
                    new = mix(mix(below[known : len(below) - half]) * np.uint64(0xD6E8FEB86659FD93) + below[known + half :])
                    self.names[level] = np.concatenate([self.names[level], new])

    def _catch(self, level: int, first: int) -> None:
        """Compare the new windows with the catchers behind them."""
        size, names = 1 << level, self.names[level]
        x = np.arange(first, len(names))
        block = (x - 2 * size) >> level << level
        catchers = [block, block - size] if level else [x - 1, x - 2, x - 3]
        starts, periods = [], []
        for b in catchers:
            there = np.flatnonzero((b >= 0) & (x - b <= self.most))
            there = there[names[x[there]] == names[b[there]]]
            starts.append(b[there])
            periods.append(x[there] - b[there])
        b, p = np.concatenate(starts), np.concatenate(periods)
        if not len(b):
            return
        # Catches of one period by blocks that meet are one stretch.
        order = np.lexsort((b, p))
        b, p = b[order], p[order]
        new = np.ones(len(b), dtype=bool)
        new[1:] = (p[1:] != p[:-1]) | (b[1:] - b[:-1] > size)
        begins = np.flatnonzero(new)
        s, e, p = b[begins], b[np.append(begins[1:], len(b)) - 1] + size, p[begins]
        self._take(p, s - self._behind(s, s + p), e + self._ahead(e, e + p))

    def _take(self, p: np.ndarray, s: np.ndarray, e: np.ndarray) -> None:
        square = e - s >= p
        # A square that is made of shorter ones is in the run of the smaller period, as far as it goes.
        use = ~square
        use[square] = self._smallest(p[square], s[square])
        for stretches, some in ((self.found, use & square), (self.open, use & (e + p == len(self.words)))):
            stretches.update(zip(zip(p[some].tolist(), s[some].tolist(), strict=True), e[some].tolist(), strict=True))

    def _smallest(self, p: np.ndarray, s: np.ndarray) -> np.ndarray:
        """Whether squares of period p at s have no smaller period, which would divide p."""
        out, left = np.ones(len(p), dtype=bool), p.copy()
        while (live := np.flatnonzero(left > 1)).size:
            prime = self.divisor[left[live]]
            out[live] &= self._ahead(s[live], s[live] + p[live] // prime) < p[live]
            left[live] //= prime
        return out

    def _ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i and from j on are equal (i below j)."""
        done = np.zeros(len(i), dtype=np.int64)
        for level in range(len(self.names) - 1, -1, -1):
            size, names = 1 << level, self.names[level]
            # The largest windows may follow each other; of every other level one is enough.
            live = np.arange(len(i))
            while len(live):
                live = live[j[live] + done[live] < len(names)]
                live = live[names[i[live] + done[live]] == names[j[live] + done[live]]]
                done[live] += size
                if level < len(self.names) - 1:
                    break
        return done

    def _behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i and before j are equal (i below j)."""
        done = np.zeros(len(i), dtype=np.int64)
        for level in range(len(self.names) - 1, -1, -1):
            size, names = 1 << level, self.names[level]
            live = np.arange(len(i))
            while len(live):
                live = live[i[live] - done[live] >= size]
                live = live[names[i[live] - done[live] - size] == names[j[live] - done[live] - size]]
                done[live] += size
                if level < len(self.names) - 1:
                    break
        return done

    def runs(self, least: int, exponent: int) -> np.ndarray | None:
        """Start, length and period of the runs of at least ``least`` words and ``exponent`` periods,
        by start and period. None if a name has stood for two windows."""
        rows = [(s, e - s + p, p) for (p, s), e in self.found.items() if e - s + p >= max(least, exponent * p)]
        if not rows:
            return np.zeros((0, 3), dtype=np.int64)
        found = np.array(sorted(rows), dtype=np.int64)
        w = self.words
        for s, n, p in found.tolist():
            inside = (w[s : s + n - p] == w[s + p : s + n]).all()
            before = s > 0 and w[s - 1] == w[s - 1 + p]
            after = s + n < len(w) and w[s + n] == w[s + n - p]
            if not inside or before or after:
                return None
        return found


def _smallest_divisors(most: int) -> np.ndarray:
    """The smallest prime divisor of every number up to ``most``."""
    out = np.arange(most + 1)
    for d in range(2, int(most**0.5) + 1):
        if out[d] == d:
            multiples = out[d * d :: d]
            multiples[multiples == np.arange(d * d, most + 1, d)] = d
    return out


def runs_of(words: np.ndarray, least: int, exponent: int, most: int | None = None, step: int = STEP) -> np.ndarray:
    """Start, length and period of every run of a sequence of numbers."""
    seed = 1
    while True:
        caught = Catchers((len(words) if most is None else most) // exponent, seed)
        for begin in range(0, len(words), step):
            caught.append(words[begin : begin + step])
        found = caught.runs(least, exponent)
        if found is not None:
            return found
        seed += 1


def _numbered(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Every word's number in the dictionary of all."""
    change = np.zeros(len(buffer) + 1, dtype=np.int8)
    change[starts] += 1
    change[ends] -= 1
    letters = buffer[np.cumsum(change[:-1], dtype=np.int8).astype(bool)]
    at = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    made = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(letters)])
    return made.dictionary_encode().indices.to_numpy().astype(np.int64)


def _may_repeat(numbers: np.ndarray, before: np.ndarray, width: int) -> np.ndarray:
    """Texts in which some window of ``width`` words comes twice, and perhaps a few others."""
    hashes, begins = windows(mix(numbers.astype(np.uint64)), before, width)
    doc = np.searchsorted(before, begins, side="right") - 1
    with np.errstate(over="ignore"):
        hashes = mix(hashes + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(hashes)
    twice = order[1:][hashes[order[1:]] == hashes[order[:-1]]]
    return np.unique(doc[twice])


def text_runs(texts: pa.Array, least: int, exponent: int) -> tuple[list[np.ndarray], np.ndarray, pa.Array]:
    """For every text its runs (start, length, period), its number of words, and itself without the
    words of a run that come after the run's first period."""
    buffer, at = flat(texts)
    starts, ends, before = words(buffer, at)
    n = np.diff(before)
    out = [np.zeros((0, 3), dtype=np.int64)] * len(n)
    change = np.zeros(len(starts) + 1, dtype=np.int64)
    if len(starts):
        numbers = _numbered(buffer, starts, ends)
        # A run repeats this many words at least a period later.
        width = min(max(least, exponent * p) - p for p in range(1, least + 2))
        some = _may_repeat(numbers, before, width)
        if len(some):
            # One sequence of all these texts, each followed by a number that comes once.
            fresh = int(numbers.max()) + 1
            parts = [np.append(numbers[before[d] : before[d + 1]], fresh + k) for k, d in enumerate(some.tolist())]
            edges = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            found = runs_of(np.concatenate(parts), least, exponent, int(n[some].max()))
            of = np.searchsorted(edges, found[:, 0], side="right") - 1
            for k in np.unique(of).tolist():
                own = found[of == k] - [edges[k], 0, 0]
                d = int(some[k])
                out[d] = own
                np.add.at(change, before[d] + own[:, 0] + own[:, 2], 1)
                np.add.at(change, before[d] + own[:, 0] + own[:, 1], -1)
    keep = np.cumsum(change[:-1]) == 0
    return out, n, joined(buffer, at, starts, ends, before, keep)


RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def find_runs(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = LEAST_WORDS, exponent: int = LEAST_EXPONENT
) -> DataFrame:
    """``doc_id``, ``n_words``, ``runs`` (by start and period) and ``collapsed`` of every row.

    A run has at least ``least`` words and ``exponent`` periods (two or more). ``collapsed`` is the
    text with one space between words, without those after the first period of a run.
    """
    if exponent < 2 or least < 2:
        raise ValueError("a run has two periods at least")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    entry = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, "text"):
                found, n, collapsed = text_runs(batch.column("text"), least, exponent)
                at = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
                flat_runs = np.concatenate(found)
                entries = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in flat_runs.T], fields=list(entry))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(n), pa.ListArray.from_arrays(pa.array(at), entries), collapsed.cast(pa.string())],
                    names=["doc_id", "n_words", "runs", "collapsed"],
                )

    return rows.mapInArrow(run, f"doc_id {kind}, n_words bigint, runs {RUNS}, collapsed string")


def longest(runs: Column) -> Column:
    """The run with most words; of equal ones the first, then that of the smallest period."""
    least = F.array_min(F.transform(runs, lambda r: F.struct(F.negative(r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period"))))
    return F.when(F.size(runs) > 0, F.struct(least["start"].alias("start"), F.negative(least["n"]).alias("length"), least["period"].alias("period")))


def with_loops(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents; every tenth by the crc32 of its id goes round in a loop from some word on."""
    h = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    g = F.floor(h / 10)
    split = F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    a = F.pmod(g, F.size(split).cast("bigint"))
    p = 1 + F.floor((F.size(split) - a) / (3 + g % 8))
    # Worked out once per row and used for every word.
    named = F.transform(F.array(F.struct(split.alias("w"), a.alias("a"), p.alias("p"))), lambda x: F.array_join(
        F.transform(F.sequence(F.lit(0).cast("bigint"), F.size(x["w"]) - F.lit(1).cast("bigint")), lambda i: F.get(
            x["w"], F.when(i < x["a"], i).otherwise(x["a"] + (i - x["a"]) % x["p"]).cast("int")
        )), " ",
    ))[0]
    has_words = F.col(text).rlike(r"[^\x20\x09-\x0D]")
    return docs.withColumn(text, F.when((h % 10 == 0) & has_words, named).otherwise(F.col(text)))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of runs, the longest one, and digests of all runs and of the collapsed text."""
    found = find_runs(with_loops(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
    best = longest(F.col("runs"))
    lines = F.array_join(
        F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), ""
    )
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"),
        best["period"].alias("period"), F.floor(1000 * best["length"] / best["period"]).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
