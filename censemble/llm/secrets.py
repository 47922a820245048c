"""Secret scans: fixed patterns, and a battery of randomness tests with false-discovery control.

Patterns give the base spans. Every other run of 16 or more characters that keys are made of is
tested: its encoding is inferred (the smallest alphabet that holds it), and it must pass, as random
over that alphabet, a chi-squared test of uniformity, a runs test and a serial-correlation test.
How easily prose would look so is told by two more p-values. The sum of squared character counts has
a known mean and variance for text of that length with the corpus's own character frequencies. And
under a chain of the corpus's character pairs, the chance that a run is a times likelier over its
alphabet than in the chain is at most 1 / a; so a key of 16 characters shows, however few its counts.
The smaller of both, twice, is controlled for false discovery inside each class of lengths, over all
runs of the corpus, words included.

Three passes over the texts: counts of characters and pairs, a histogram of p-values, the spans. What
comes to the driver is of fixed size: at most 5,000 counts, and one threshold per length class.

Defined results: a null text is empty and has no spans; repeated rows are scanned one by one and
count as often in the statistics; an empty table gives no rows. Runs of digits alone are numbers,
not secrets. ``redact_secrets`` keeps all columns as they are but the text and its length; no other
function reads extra columns.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from censemble.llm.flat import flat, sliced

# Fixed patterns of the base spans.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ASSIGN_CHARS = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_CHARS = 18
HEX_CHARS = 16
KINDS = ("assign", "access", "hex", "random")

RUN_CHARS = 16
# A run counts as random unless one of the three tests rejects it at this level, all told.
REJECT = 0.001
# Expected share of prose among the runs that are added, per length class.
FALSE_DISCOVERIES = 0.01
LENGTH_CLASSES = (16, 20, 24, 32, 48, 64, 128, 256)
BINS = 400
# Share of the pair chain in which any character may follow, and the power of its likelihood ratios:
# text in a rare language, or an odd pair in a path or name, is less likely than the chain says.
ANY_NEXT = 0.01
TEMPER = 0.5
# Weight of the single characters' frequencies in the chain, in pairs.
SINGLE_WEIGHT = 50

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Alphabets by size; the first that holds a run is its encoding.
ALPHABETS = {
    "decimal": DIGITS,
    "hex": DIGITS + "abcdef",
    "HEX": DIGITS + "ABCDEF",
    "lower": LOWER,
    "upper": UPPER,
    "base32": UPPER + "234567",
    "base36": DIGITS + LOWER,
    "BASE36": DIGITS + UPPER,
    "letters": UPPER + LOWER,
    "base62": UPPER + LOWER + DIGITS,
    "base64": UPPER + LOWER + DIGITS + "+/",
    "base64url": UPPER + LOWER + DIGITS + "-_",
    "any": UPPER + LOWER + DIGITS + "+/-_=",
}
_PLACES = {name: {c: i for i, c in enumerate(a)} for name, a in ALPHABETS.items()}
_SETS = {name: frozenset(a) for name, a in ALPHABETS.items()}


def _mask(chars: str) -> np.ndarray:
    mask = np.zeros(256, dtype=bool)
    mask[np.frombuffer(chars.encode(), dtype=np.uint8)] = True
    return mask


_HEX, _KEY = _mask(ALPHABETS["hex"]), _mask(ALPHABETS["any"])
_N_KEY = len(ALPHABETS["any"])
# Place of a byte among the key characters; all others share the last.
_PLACE = np.full(256, _N_KEY, dtype=np.int32)
_PLACE[np.frombuffer(ALPHABETS["any"].encode(), dtype=np.uint8)] = np.arange(_N_KEY)


def _runs(inside: np.ndarray, at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, begin and end byte of maximal runs of at least so many bytes inside one text."""
    edge = np.zeros(len(inside) + 1, dtype=bool)
    edge[at] = True
    change = np.zeros(len(inside) + 1, dtype=bool)
    change[1:-1] = inside[1:] != inside[:-1]
    marks = np.flatnonzero(change | edge)
    begins, ends = marks[:-1], marks[1:]
    long = (ends - begins >= least) & inside[begins] if len(begins) else np.zeros(0, dtype=bool)
    begins, ends = begins[long], ends[long]
    return np.searchsorted(at, begins, side="right") - 1, begins, ends


def upper_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def encoding_of(run: str) -> str:
    """The smallest alphabet that holds the run, padding aside."""
    chars = set(run.rstrip("="))
    return next((name for name, a in _SETS.items() if chars <= a), "any")


def randomness(run: str, encoding: str) -> float:
    """Chance that a random run over the alphabet fares as badly in the worst of the three tests."""
    place = _PLACES[encoding]
    values = [place[c] for c in run.rstrip("=")]
    n, k = len(values), len(place)
    if n < 2:
        return 1.0
    counts = np.bincount(values, minlength=k)
    chi = k / n * float((counts * counts).sum()) - n
    free = k - 1
    # Wilson and Hilferty's normal form of chi-squared.
    p = [upper_tail(((max(chi, 0.0) / free) ** (1 / 3) - 1 + 2 / (9 * free)) / math.sqrt(2 / (9 * free)))]
    high = [2 * v >= k for v in values]
    a = sum(high)
    b = n - a
    runs = 1 + sum(x != y for x, y in zip(high, high[1:], strict=False))
    if a and b:
        mean = 1 + 2 * a * b / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        p.append(2 * upper_tail(abs(runs - mean) / math.sqrt(var)) if var > 0 else 1.0)
    mean = sum(values) / n
    spread = sum((v - mean) ** 2 for v in values)
    if spread:
        serial = sum((x - mean) * (y - mean) for x, y in zip(values, values[1:], strict=False)) / spread
        p.append(2 * upper_tail(abs(serial) * math.sqrt(n)))
    return min(1.0, len(p) * min(p))


def prose_evenness(run: str, encoding: str, frequency: dict[str, tuple[float, float, float]]) -> float:
    """Chance that prose of that length, in the alphabet's characters, is as evenly spread."""
    chars = run.rstrip("=")
    n = len(chars)
    two, three, known = frequency[encoding]
    if n < 2 or not known:
        return 1.0
    counts: dict[str, int] = {}
    for c in chars:
        counts[c] = counts.get(c, 0) + 1
    squares = sum(c * c for c in counts.values())
    mean = n + n * (n - 1) * two
    var = 2 * n * (n - 1) * (two + 2 * (n - 2) * three - (2 * n - 3) * two * two)
    if var <= 0:
        return 1.0
    return upper_tail((mean - squares) / math.sqrt(var))


def pair_evidence(run: str, encoding: str, chain: tuple[list[list[int]], list[int], list[float]]) -> float:
    """Bound on the chance that the chain of pairs, without those of the run itself, gives a run that
    speaks as much for the alphabet."""
    pairs, sums, single = chain
    places = [_N_KEY, *(_PLACES["any"][c] for c in run.rstrip("="))]
    steps = list(zip(places, places[1:], strict=False))
    own, own_sums = Counter(steps), Counter(places[:-1])
    prose = 0.0
    for a, b in steps:
        near = (pairs[a][b] - own[a, b] + SINGLE_WEIGHT * single[b]) / (sums[a] - own_sums[a] + SINGLE_WEIGHT)
        prose += math.log((1 - ANY_NEXT) * max(near, 0.0) + ANY_NEXT / _N_KEY)
    # The alphabet is one of several, chosen after the run.
    even = -len(steps) * math.log(len(_PLACES[encoding])) - math.log(len(ALPHABETS))
    return math.exp(min(0.0, TEMPER * (prose - even)))


def prose_chance(run: str, encoding: str, prose: tuple[dict, tuple]) -> float:
    """Chance that prose of that length looks as little like prose in the clearer of both tests."""
    frequency, chain = prose
    return min(1.0, 2 * min(prose_evenness(run, encoding, frequency), pair_evidence(run, encoding, chain)))


def moments(counts: list[int]) -> dict[str, tuple[float, float, float]]:
    """Sums of squared and cubed frequencies inside each alphabet, from counts by byte."""
    out = {}
    for name, chars in ALPHABETS.items():
        part = np.array([counts[ord(c)] for c in chars], dtype=float)
        total = part.sum()
        share = part / total if total else part
        out[name] = (float((share**2).sum()), float((share**3).sum()), float(total))
    return out


def pair_chain(pairs: np.ndarray) -> tuple[list[list[int]], list[int], list[float]]:
    """Counts of each key character after another, or (last row) at the begin of a run; their sums; frequencies."""
    single = pairs.sum(axis=0) + 1.0
    return pairs.tolist(), pairs.sum(axis=1).tolist(), (single / single.sum()).tolist()


def length_class(n: int) -> int:
    return max(c for c in LENGTH_CLASSES if c <= max(n, LENGTH_CLASSES[0]))


def p_bin(p: float) -> int:
    """Bin of a p-value, the smallest p-values first."""
    return BINS - min(BINS, int(-10 * math.log10(max(p, 1e-300))))


class Scan:
    """Spans of a batch of texts."""

    def __init__(self, texts: pa.Array) -> None:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        self.texts = texts
        self.buffer, self.at = flat(texts)
        # Code points before every byte, counted once.
        self.points = np.concatenate([[0], np.cumsum((self.buffer & 0xC0) != 0x80, dtype=np.int64)])

    def _placed(self, inside: np.ndarray, least: int) -> Iterator[tuple[int, int, int, int]]:
        """Text, begin in code points, and begin and end byte of runs of at least so many bytes."""
        texts, begins, ends = _runs(inside, self.at, least)
        chars = self.points[begins] - self.points[self.at[texts]]
        return zip(texts.tolist(), chars.tolist(), begins.tolist(), ends.tolist(), strict=True)

    def base(self) -> list[list[tuple[int, int, int]]]:
        """Per text its pattern spans as (begin, kind, end), sorted."""
        found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(self.texts))]
        if not len(self.buffer):
            return found
        signs = np.flatnonzero((self.buffer == 58) | (self.buffer == 61))
        for t in np.unique(np.searchsorted(self.at, signs, side="right") - 1).tolist():
            for m in ASSIGN.finditer(self.texts[t].as_py()):
                if len(m[2]) >= ASSIGN_CHARS:
                    found[t].append((m.start(), 0, m.end()))
        for t in np.flatnonzero(pc.match_substring(self.texts, "AKIA").to_numpy(zero_copy_only=False)).tolist():
            for m in ACCESS.finditer(self.texts[t].as_py()):
                if len(m[0]) >= ACCESS_CHARS:
                    found[t].append((m.start(), 1, m.end()))
        for t, begin, b, e in self._placed(_HEX[self.buffer], HEX_CHARS):
            found[t].append((begin, 2, begin + e - b))
        for spans in found:
            spans.sort()
        return found

    def runs(self, base: list[list[tuple[int, int, int]]]) -> Iterator[tuple[int, int, int, str]]:
        """Other runs of key characters: text, begin, end, and the run."""
        if not len(self.buffer):
            return
        text, at, reach = -1, 0, 0
        for t, begin, b, e in self._placed(_KEY[self.buffer], RUN_CHARS):
            if t != text:
                text, at, reach = t, 0, 0
            # Runs and spans both come in order: how far do the spans that begin before this end reach?
            end = begin + e - b
            while at < len(base[t]) and base[t][at][0] < end:
                reach = max(reach, base[t][at][2])
                at += 1
            run = self.buffer[b:e].tobytes().decode()
            if reach <= begin and not run.isdigit():
                yield t, begin, end, run


def prose_of(docs: DataFrame, text: str = "text") -> tuple[dict, tuple]:
    """What prose looks like: moments of the characters' frequencies, and the chain of their pairs."""
    n_pairs = (_N_KEY + 1) * (_N_KEY + 1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(256 + n_pairs, dtype=np.int64)
        for batch in batches:
            for part in sliced(batch, "t"):
                buffer, at = flat(part.column(0))
                counts[:256] += np.bincount(buffer, minlength=256)
                # A text begins after what is no key character.
                places = _PLACE[buffer]
                pairs = places.copy()
                pairs[1:] += (_N_KEY + 1) * places[:-1]
                first = at[at < len(buffer)]
                pairs[first] = (_N_KEY + 1) * _N_KEY + places[first]
                counts[256:] += np.bincount(pairs, minlength=n_pairs)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], names=["code", "n"])

    per_task = docs.select(F.col(text).alias("t")).mapInArrow(run, "code bigint, n bigint")
    counts = np.zeros(256 + n_pairs, dtype=np.int64)
    for r in per_task.groupBy("code").agg(F.sum("n").alias("n")).collect():
        counts[r["code"]] = r["n"]
    pairs = counts[256:].reshape(_N_KEY + 1, _N_KEY + 1)[:, :_N_KEY]
    return moments(counts[:256].tolist()), pair_chain(pairs)


def discovery_thresholds(docs: DataFrame, prose: tuple[dict, tuple], text: str = "text") -> dict[int, int]:
    """Per length class the last bin of p-values in which false discoveries stay rare enough."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, int, bool], int] = {}
        for batch in batches:
            for part in sliced(batch, "t"):
                scan = Scan(part.column(0))
                for _, _, _, found in scan.runs(scan.base()):
                    encoding = encoding_of(found)
                    at = p_bin(prose_chance(found, encoding, prose))
                    key = (length_class(len(found)), at, randomness(found, encoding) >= REJECT)
                    counts[key] = counts.get(key, 0) + 1
        columns = list(zip(*counts, strict=True)) if counts else [[], [], []]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.bool_()),
             pa.array(list(counts.values()), pa.int64())],
            names=["class", "bin", "random", "n"],
        )

    schema = "class int, bin int, random boolean, n bigint"
    bins = docs.select(F.col(text).alias("t")).mapInArrow(run, schema)
    bins = bins.groupBy("class", "bin").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("random"), F.col("n")).otherwise(0)).alias("random")
    )
    # At most classes x bins rows, whatever the corpus.
    each = W.partitionBy("class")
    upto = each.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    ranked = bins.select(
        "class", "bin", F.sum("n").over(each).alias("all"), F.sum("random").over(upto).alias("found")
    )
    # Prose of m runs puts p * m of them in bins up to p.
    p = F.pow(F.lit(10.0), (F.col("bin") - BINS) / 10 + 0.1)
    kept = ranked.where((F.col("found") > 0) & (p * F.col("all") <= FALSE_DISCOVERIES * F.col("found")))
    return {r["class"]: r["bin"] for r in kept.groupBy("class").agg(F.max("bin").alias("bin")).collect()}


def _spans(scan: Scan, prose: tuple[dict, tuple], thresholds: dict[int, int]) -> tuple[list, list]:
    """Per text its base spans, and all spans."""
    base = scan.base()
    every = [list(spans) for spans in base]
    for t, begin, end, run in scan.runs(base):
        last = thresholds.get(length_class(len(run)))
        if last is None:
            continue
        encoding = encoding_of(run)
        if p_bin(prose_chance(run, encoding, prose)) <= last and randomness(run, encoding) >= REJECT:
            every[t].append((begin, 3, end))
    for spans in every:
        spans.sort()
    return base, every


SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _as_spans(rows: list) -> pa.Array:
    return pa.array([[{"kind": KINDS[k], "start": b, "end": e} for b, k, e in spans] for spans in rows], SPAN)


def find_secrets(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id``, ``base`` and ``spans``: arrays of ``struct<kind, start, end>`` in code points."""
    prose = prose_of(docs, text)
    thresholds = discovery_thresholds(docs, prose, text)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"))
    kind = dict(rows.dtypes)["doc_id"]
    span = "array<struct<kind:string,start:int,end:int>>"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, "t"):
                base, every = _spans(Scan(part.column(1)), prose, thresholds)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), _as_spans(base), _as_spans(every)], names=["doc_id", "base", "spans"]
                )

    return rows.mapInArrow(run, f"doc_id {kind}, base {span}, spans {span}")


def redact_secrets(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars", put: str = "[SECRET]") -> DataFrame:
    """The documents with every span replaced; other columns and all rows stay."""
    prose = prose_of(docs, text)
    thresholds = discovery_thresholds(docs, prose, text)
    place = docs.columns.index(text)

    def cleaned(value: str | None, spans: list) -> str | None:
        if not spans:
            return value
        out, at = [], 0
        for begin, _, end in spans:
            if begin >= at:
                out += [value[at:begin], put]
            at = max(at, end)
        return "".join(out) + value[at:]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, text):
                _, every = _spans(Scan(part.column(place)), prose, thresholds)
                old = part.column(place)
                columns = list(part.columns)
                if any(every):
                    new = [cleaned(t, s) for t, s in zip(old.to_pylist(), every, strict=True)]
                    columns[place] = pa.array(new, old.type)
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    out = docs.mapInArrow(run, docs.schema)
    if n_chars in docs.columns:
        out = out.withColumn(n_chars, F.length(text).cast(docs.schema[n_chars].dataType))
    return out


def _told(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of the base spans, and all spans, of every document."""
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(_told("base"), 256).alias("base_sha256"), _told("spans").alias("spans"))
