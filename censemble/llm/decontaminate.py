"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are runs of letters and digits, without regard to the case of A-Z. A seed is the shortest run
of ``SEED_WORDS`` words of a test item that is expected at most ``EXPECTED`` times by chance in a
corpus of this size: the product of its words' frequencies, counted over all documents, times the
number of words. Rarity is judged by words and not by counting the run itself, so a test item that
has leaked into a third of the corpus still has its seeds. Documents are scanned for seeds; around
every hit the document's words and the item are aligned locally, word by word, with a gain for
equal words and losses for changed, missing and added ones, so edited and paraphrased copies score
too. A pair counts as a leak if the score is at least ``LEAST`` of what a full copy would get.

Scale: the corpus is read twice (word counts, seeds) and never shuffled; only words near hits are.
The scan holds two bitmaps of fixed size (``bitmaps.BITS``) of the benchmark's words and seeds,
whatever the size of the benchmark; what passes by chance falls out in the join with the seeds.

Defined results: null or empty texts and items have no words and no leaks; rows that share an id
and text are one document; an item with no seed that is rare enough is not found. Items with equal
ids are separate texts, the best one counts. An empty table gives no rows. Extra columns of the
inputs are never read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from censemble.llm.bitmaps import bitmap, few_files, passing
from censemble.llm.flat import flat, sliced, windows, word_hashes, words
from censemble.llm.quality import fresh
from censemble.session import stored

SEED_WORDS = (3, 8)
EXPECTED = 0.01
GAIN, LOSS = 2, 1
LEAST = 0.5


def _hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts on end, and where each text's begin."""
    buffer, at = flat(texts)
    starts, ends, before = words(buffer, at, bare=True)
    return word_hashes(buffer, starts, ends, lower=True), before


def item_words(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``item`` (one per row), ``item_id`` and ``words``: the hashes of its words."""
    rows = items.select(F.col(item_id).alias("item_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.distinct()
    kind = dict(rows.dtypes)["item_id"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, "text"):
                hashes, at = _hashed(batch.column("text"))
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("item_id"), lists], names=["item_id", "words"])

    found = rows.mapInArrow(run, f"item_id {kind}, words array<bigint>").where(F.size("words") > 0)
    return found.select(F.xxhash64("item_id", "words").alias("item"), "item_id", "words").distinct()


def word_counts(docs: DataFrame, item: DataFrame, text: str = "text") -> DataFrame:
    """``word`` and ``n``: corpus counts of the benchmark's words; the total is under a null word."""
    known = docs.sparkSession.sparkContext.broadcast(bitmap(item.select(F.explode("words").alias("word")), "word"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for whole in batches:
            for batch in sliced(whole, "t"):
                hashes, _ = _hashed(batch.column(0))
                total += len(hashes)
                found, n = np.unique(hashes[passing(known.value, hashes)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], names=["word", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([total])], names=["word", "n"])

    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("t")).mapInArrow(run, "word bigint, n bigint")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def rare_seeds(item: DataFrame, counts: DataFrame, expected: float = EXPECTED) -> DataFrame:
    """``seed`` (hash), ``item`` and ``at``: for each place of an item its shortest rare run."""
    total = counts.where(F.col("word").isNull()).agg(F.sum("n")).first()[0] or 0
    placed = item.select("item", F.posexplode("words").alias("at", "word"))
    placed = placed.join(counts.where(F.col("word").isNotNull()), "word", "left")
    whole = placed.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("at", "word", F.coalesce("n", F.lit(0)).alias("n")))).alias("w"))
    shortest, longest = SEED_WORDS

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seeds, names, places = [], [], []
            for name, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                hashes = np.array([x["word"] for x in found], dtype=np.int64).view(np.uint64)
                n = np.array([x["n"] for x in found], dtype=float)
                # A word that the corpus lacks is in no hit.
                log = np.log(np.where(n > 0, n, np.inf) / max(total, 1))
                sums = np.concatenate([[0], np.cumsum(np.where(n > 0, log, 0))])
                absent = np.concatenate([[0], np.cumsum(n == 0)])
                open_ = np.ones(len(hashes), dtype=bool)
                edges = np.array([0, len(hashes)])
                for width in range(shortest, longest + 1):
                    runs, at = windows(hashes, edges, width)
                    if not len(at):
                        break
                    rare = sums[at + width] - sums[at] + np.log(max(total, 1)) <= np.log(expected)
                    use = rare & open_[at] & (absent[at + width] == absent[at])
                    open_[at[rare]] = False
                    seeds += runs[use].view(np.int64).tolist()
                    places += at[use].tolist()
                    names += [name] * int(use.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array(seeds, pa.int64()), pa.array(names, pa.int64()), pa.array(places, pa.int32())], names=["seed", "item", "at"]
            )

    return whole.mapInArrow(run, "seed bigint, item bigint, at int")


def scan(docs: DataFrame, seeds: DataFrame, reach: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Stretches of documents around possible seeds.

    ``stretch`` (a hash of what follows), ``doc_id``, ``text_key`` (hash of the text),
    ``begin`` (its first word), ``words`` (hashes), ``hits``: array of ``struct<seed, at>``.
    ``reach``: words on each side of a hit; stretches that meet are one.
    """
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    known = docs.sparkSession.sparkContext.broadcast(bitmap(seeds, "seed"))
    shortest, longest = SEED_WORDS
    hit_type = pa.list_(pa.struct([("seed", pa.int64()), ("at", pa.int32())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, "text"):
                hashes, before = _hashed(batch.column("text"))
                places, found = [], []
                for width in range(shortest, longest + 1):
                    runs, at = windows(hashes, before, width)
                    use = passing(known.value, runs)
                    places.append(at[use])
                    found.append(runs[use])
                place, seed = np.concatenate(places), np.concatenate(found)
                order = np.argsort(place, kind="stable")
                place, seed = place[order], seed[order]
                doc = np.searchsorted(before, place, side="right") - 1
                new = np.ones(len(place), dtype=bool)
                new[1:] = (doc[1:] != doc[:-1]) | (np.diff(place) > 2 * reach)
                edges = np.append(np.flatnonzero(new), len(place))
                ids, keys = batch.column("doc_id"), batch.column("text_key")
                out: list[tuple] = []
                for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    d = int(doc[a])
                    first = max(int(before[d]), int(place[a]) - reach)
                    last = min(int(before[d + 1]), int(place[b - 1]) + longest + reach)
                    begin = first - int(before[d])
                    hits = [{"seed": s, "at": p} for s, p in zip(seed[a:b].view(np.int64).tolist(), (place[a:b] - first).tolist(), strict=True)]
                    out.append((ids[d].as_py(), keys[d].as_py(), begin, hashes[first:last].view(np.int64).tolist(), hits))
                columns = list(zip(*out, strict=True)) if out else [[]] * 5
                types = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), hit_type]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "text_key", "begin", "words", "hits"]
                )

    schema = "doc_id bigint, text_key bigint, begin int, words array<bigint>, hits array<struct<seed:bigint,at:int>>"
    found = rows.mapInArrow(run, schema)
    return found.withColumn("stretch", F.xxhash64("doc_id", "text_key", "begin"))


def best_local(item: np.ndarray, stretch: np.ndarray) -> tuple[int, int, int]:
    """Score, last item word and last stretch word of the best local alignment."""
    ramp = LOSS * np.arange(len(stretch) + 1)
    above = np.zeros(len(stretch) + 1, dtype=np.int64)
    best, at = 0, (0, 0)
    for i, word in enumerate(item):
        here = np.maximum(above - LOSS, 0)
        here[1:] = np.maximum(here[1:], above[:-1] + np.where(stretch == word, GAIN, -LOSS))
        # Added words: the running maximum, less a loss for every step since.
        here = np.maximum.accumulate(here + ramp) - ramp
        j = int(here.argmax())
        if here[j] > best:
            best, at = int(here[j]), (i, j - 1)
        above = here
    return best, at[0], at[1]


def align(pairs: DataFrame) -> DataFrame:
    """Adds the score (1.0 for a full copy) and the aligned words of the document.

    ``pairs``: doc_id, text_key, begin, words, item_id, item_words, low, high.
    """
    schema = "doc_id bigint, text_key bigint, item_id {}, score double, first_word int, last_word int".format(
        dict(pairs.dtypes)["item_id"]
    )
    columns = ["doc_id", "text_key", "item_id", "begin", "words", "item_words", "low", "high"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, firsts, lasts = [], [], []
            for row in zip(*(batch.column(c) for c in ("begin", "words", "item_words", "low", "high")), strict=True):
                begin = row[0].as_py()
                stretch, item = row[1].values.to_numpy(), row[2].values.to_numpy()
                low = max(0, row[3].as_py() - len(item) // 2)
                part = stretch[low : row[4].as_py() + len(item) + len(item) // 2]
                best, i, j = best_local(item, part)
                # The same from the end backwards gives where it begins.
                _, _, back = best_local(item[: i + 1][::-1], part[: j + 1][::-1])
                scores.append(best / (GAIN * len(item)))
                firsts.append(begin + low + j - back)
                lasts.append(begin + low + j)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "text_key", "item_id")), pa.array(scores, pa.float64()), pa.array(firsts, pa.int32()), pa.array(lasts, pa.int32())],
                names=["doc_id", "text_key", "item_id", "score", "first_word", "last_word"],
            )

    return pairs.select(*columns).mapInArrow(run, schema)


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    least: float = LEAST,
    expected: float = EXPECTED,
    text: str = "text",
    doc_id: str = "doc_id",
) -> DataFrame:
    """A row for every document and test item that it holds: ``doc_id``, ``text_key``, ``item_id``,
    ``score``, and the first and last word of the best alignment."""
    item = stored(few_files(item_words(items)), "items")
    seeds = stored(few_files(rare_seeds(item, word_counts(docs, item, text), expected)), "seeds")
    reach = int(item.agg(F.max(F.size("words"))).first()[0] or 0) * 3 // 2
    found = stored(scan(docs, seeds, reach, text, doc_id), "stretches")
    hits = found.select("stretch", F.explode("hits").alias("hit")).select("stretch", "hit.seed", F.col("hit.at").alias("there"))
    shift = F.col("there") - F.col("at")
    met = hits.join(seeds, "seed").groupBy("stretch", "item").agg(F.min(shift).alias("low"), F.max(shift).alias("high"))
    whole = found.drop("hits").dropDuplicates(["stretch"])
    pairs = met.join(whole, "stretch").join(item.withColumnRenamed("words", "item_words"), "item")
    scored = align(pairs).where(F.col("score") >= least)
    best = F.max(F.struct("score", F.negative("first_word").alias("f"), "last_word"))
    out = scored.groupBy("doc_id", "text_key", "item_id").agg(best.alias("best"))
    return out.select(
        "doc_id", "text_key", "item_id", F.round("best.score", 6).alias("score"),
        F.negative("best.f").alias("first_word"), F.col("best.last_word").alias("last_word"),
    )


def without_leaks(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents that hold no test item; columns and other rows stay as they are."""
    leaks = find_leaks(docs, items, text=text, doc_id=doc_id)
    leaked, key = fresh(docs, "leaked"), fresh(docs, "key")
    bad = leaks.select(F.col("doc_id").alias(leaked), F.col("text_key").alias(key)).distinct()
    same = F.col(doc_id).cast("long").eqNullSafe(F.col(leaked)) & (F.xxhash64(text) == F.col(key))
    return docs.join(bad, same, "leftanti")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of documents and benchmark items that leaked into them."""
    leaks = find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return leaks.select("doc_id", "item_id", "score", "first_word", "last_word")
