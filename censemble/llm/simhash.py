"""SimHash near-dedup by the generalised pigeonhole principle, exact for a Hamming distance.

A text's fingerprint has 64 bits: each is set if it is set in more than half of the XXH64 hashes of
the text's word shingles, repeats included. Fingerprints that differ in at most ``most`` bits are
linked; the result is the connected components.

Pigeonhole: cut the 64 bits into m parts with a threshold each, -1 or more, that add up to
``most - m + 1``. Two fingerprints within ``most`` bits are within the threshold of some part there
(if every part were beyond its own, the distances would add up to ``most + 1`` at least). A part of
threshold -1 is not looked at.

1. Distinct fingerprints are classes. The co-occurrence of all bits is counted over all of them.
2. Bits that go together are put into one part, so that other parts are as selective as can be.
   For each number of parts, dynamic programming gives out the thresholds that cost least: rows to
   send and pairs to compare, estimated from the bits' frequencies and from the distances within
   ``SAMPLE`` fingerprints. The cheapest number of parts wins: few fingerprints take more parts with
   threshold 0, many take fewer and wider ones. A bad estimate costs time, never a link.
3. Probing: every fingerprint goes to the bucket of its bits in each part (threshold 1: also to
   those one bit away, as a guest; threshold 2: the same, and guests meet guests).
4. Verification: all pairs of a bucket are compared in full, and links enough to connect what they
   connect leave the task, never all pairs. Buckets above ``CHUNK`` are dealt into chunks. Chunks are
   compared inside; all of the bucket is compared to the member next to its centre; then those that
   are still not in the bucket's largest component are compared to all of it. Big buckets are near
   copies of one text, so these are few.

Defined results: null and empty texts have fingerprint zero, linked like any other; rows without an
id are linked with nothing and have no component; rows that share an id are one document. Repeated
rows are returned as often as they come. An empty table gives no rows. Extra columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from censemble.llm.components import connected_components
from censemble.llm.flat import flat, joined, sliced, words
from censemble.operators.skew import split_join
from censemble.session import stored

BITS, WIDTH, MOST = 64, 4, 4
SEED = 42
SAMPLE = 4096
CHUNK = 1024
# Relative cost of a row that is sent, in pairs that are compared.
ROW_COST = 200
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ONE = np.uint64(1)


def fingerprints(docs: DataFrame, width: int = WIDTH, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id`` and ``print`` (the 64 bits as a bigint) of every row."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, "text"):
                found = text_prints(batch.column("text"), width).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], names=["doc_id", "print"])

    return rows.mapInArrow(run, "doc_id bigint, print bigint")


def text_prints(texts: pa.Array, width: int) -> np.ndarray:
    """The fingerprint of every text."""
    buffer, at = flat(texts)
    buffer = _LOWER[buffer]
    starts, ends, before = words(buffer, at)
    # One space between words, so that a shingle is a stretch of bytes.
    buffer, at = flat(joined(buffer, at, starts, ends, before, np.ones(len(starts), dtype=bool)))
    starts, ends, before = words(buffer, at)
    n = np.diff(before)
    shingles = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    edges = np.concatenate([[0], np.cumsum(shingles)])
    first = np.arange(edges[-1]) - np.repeat(edges[:-1] - before[:-1], shingles)
    last = first + np.repeat(np.minimum(n, width) - 1, shingles)
    data, digest = buffer.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(data[a:b], SEED) for a, b in zip(starts[first].tolist(), ends[last].tolist(), strict=True)), dtype=np.uint64, count=len(first)
    )
    out = np.zeros(len(n), dtype=np.uint64)
    some = np.flatnonzero(shingles)
    for bit in range(BITS if len(some) else 0):
        count = np.add.reduceat(((hashes >> np.uint64(bit)) & _ONE).astype(np.int32), edges[some])
        out[some] |= (2 * count > shingles[some]).astype(np.uint64) << np.uint64(bit)
    return out


class Plan(NamedTuple):
    """Masks of the parts and their thresholds."""

    masks: list[int]
    thresholds: list[int]


def bit_counts(classes: DataFrame) -> np.ndarray:
    """How many fingerprints have both of two bits, for all 64 x 64."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((BITS, BITS), dtype=np.int64)
        for batch in batches:
            bits = _bits(batch.column("print").to_numpy().view(np.uint64)).astype(np.float32)
            for begin in range(0, len(bits), 1 << 16):
                part = bits[begin : begin + (1 << 16)]
                both += np.rint(part.T @ part).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(range(BITS * BITS), pa.int32()), pa.array(both.ravel())], names=["cell", "n"])

    rows = classes.select("print").mapInArrow(run, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    out = np.zeros(BITS * BITS, dtype=np.int64)
    # 4,096 rows, whatever the table.
    for row in rows.collect():
        out[row["cell"]] = row["n"]
    return out.reshape(BITS, BITS)


def _bits(prints: np.ndarray) -> np.ndarray:
    return (prints[:, None] >> np.arange(BITS, dtype=np.uint64)[None, :]) & _ONE


def correlated_parts(both: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """The bits in so many parts of about one size; bits that go together share a part."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.outer(p * (1 - p), p * (1 - p)))
    phi = np.divide(np.abs(both / max(n, 1) - np.outer(p, p)), spread, out=np.zeros((BITS, BITS)), where=spread > 0)
    fixed = (p == 0) | (p == 1)
    phi[np.ix_(fixed, fixed)] = 1
    np.fill_diagonal(phi, 0)
    left, out = list(range(BITS)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        near = phi[np.ix_(left, left)].sum(axis=0) if size < 2 else phi[np.ix_(left, left)].max(axis=0)
        part = [left[int(near.argmax())]]
        while len(part) < size:
            rest = [b for b in left if b not in part]
            part.append(rest[int(phi[np.ix_(part, rest)].sum(axis=0).argmax())])
        left = [b for b in left if b not in part]
        out.append(sorted(part))
    return out


def near_share(part: list[int], p: np.ndarray, sample: np.ndarray) -> np.ndarray:
    """Estimated shares of pairs that differ in 0, 1 and 2 bits of a part.

    The larger of what independent bits would give and what the sample has.
    """
    alone = np.array([1.0, 0.0, 0.0])
    for e in 2 * p[part] * (1 - p[part]):
        alone = alone * (1 - e) + np.concatenate([[0.0], alone[:2]]) * e
    seen = np.zeros(3)
    values = sample & np.uint64(_mask(part))
    for begin in range(0, len(values), 256):
        far = np.bitwise_count(values[begin : begin + 256, None] ^ values[None, :])
        seen += [(far == d).sum() for d in range(3)]
    seen[0] -= len(values)
    return np.maximum(alone, seen / max(1, len(values) * (len(values) - 1)))


def _mask(part: list[int]) -> int:
    return sum(1 << b for b in part)


def part_costs(part: list[int], share: np.ndarray, n: int) -> dict[int, float]:
    """The cost of each threshold of a part for ``n`` fingerprints."""
    pairs, w = n * n / 2, len(part)
    return {
        -1: 0.0,
        0: n * ROW_COST + pairs * share[0],
        1: n * (w + 1) * ROW_COST + pairs * (share[0] + 2 * share[1]),
        2: n * (w + 1) * ROW_COST + pairs * ((w + 1) * share[0] + 2 * share[1] + 2 * share[2]),
    }


def allocate(costs: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """The thresholds that add up to ``total`` at the least cost."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for choices in costs:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for reached, (cost, chosen) in best.items():
            for t, more in choices.items():
                if reached + t not in nxt or cost + more < nxt[reached + t][0]:
                    nxt[reached + t] = (cost + more, [*chosen, t])
        best = nxt
    return best.get(total, (np.inf, []))


def make_plan(both: np.ndarray, n: int, sample: np.ndarray, most: int) -> Plan:
    """The cheapest parts and thresholds over all numbers of parts."""
    p = np.diag(both) / max(n, 1)
    found = []
    for m in range(1, most + 2):
        parts = correlated_parts(both, n, m)
        costs = [part_costs(part, near_share(part, p, sample), n) for part in parts]
        cost, thresholds = allocate(costs, most - m + 1)
        found.append((cost, -m, Plan([_mask(part) for part in parts], thresholds)))
    return min(found)[2]


def plan_for(classes: DataFrame, n: int, most: int, sample: int = SAMPLE) -> Plan:
    """The plan, worked out by a task from ``sample`` fingerprints (those of the least hashes)."""
    both = bit_counts(classes)
    some = classes.select("print", F.xxhash64("print", F.lit(1)).alias("h")).orderBy("h", "print").limit(sample)

    def run(table: pa.Table) -> pa.Table:
        plan = make_plan(both, n, table.column("print").to_numpy().view(np.uint64), most)
        masks = np.array(plan.masks, dtype=np.uint64).view(np.int64)
        return pa.table({"mask": pa.array(masks), "threshold": pa.array(plan.thresholds, pa.int32())})

    rows = some.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(run, "mask bigint, threshold int").collect()
    return Plan([r["mask"] & 2**64 - 1 for r in rows], [r["threshold"] for r in rows])


def probes(classes: DataFrame, plan: Plan) -> DataFrame:
    """``part``, ``key`` (the part's bits), ``home`` and ``print`` for every bucket of a fingerprint."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 4096):
                column = whole.slice(begin, 4096).column("print")
                prints = column.to_numpy().view(np.uint64)
                for i, (mask, threshold) in enumerate(zip(plan.masks, plan.thresholds, strict=True)):
                    flips = [0] * (threshold >= 0) + [1 << b for b in range(BITS) if threshold > 0 and mask >> b & 1]
                    for flip in flips:
                        key = (prints & np.uint64(mask)) ^ np.uint64(flip)
                        home = np.full(len(prints), flip == 0 or threshold > 1)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(prints), i, dtype=np.int32)), pa.array(key.view(np.int64)), pa.array(home), column],
                            names=["part", "key", "home", "print"],
                        )

    return classes.select("print").mapInArrow(run, "part int, key bigint, home boolean, print bigint")


def _forest(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Places of pairs enough to connect what all pairs connect."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            root[x] = x = root.get(root[x], root[x])
        return x

    out = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = find(x), find(y)
        if x != y:
            root[x] = y
            out.append(i)
    return out


def _bucket_links(segment: np.ndarray, home: np.ndarray, prints: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside each stretch of equal ``segment``; a guest is compared to those at home."""
    edges = np.append(np.flatnonzero(np.append(True, segment[1:] != segment[:-1])), len(segment))
    size = np.diff(edges)
    ends = np.repeat(edges[1:], size)
    a, b = [], []
    # Short ones all at once: each row with the next, the one after it, and so on.
    live = np.flatnonzero(np.repeat(size <= 64, size))
    step = 1
    while len(live := live[live + step < ends[live]]):
        near = np.bitwise_count(prints[live] ^ prints[live + step]) <= most
        near &= home[live] | home[live + step]
        a.append(live[near])
        b.append(live[near] + step)
        step += 1
    if a:
        x, y = np.concatenate(a), np.concatenate(b)
        pick = _forest(x, y)
        a, b = [x[pick]], [y[pick]]
    # Long ones by a search from member to member.
    for k in np.flatnonzero(size > 64).tolist():
        own, at_home = prints[edges[k] : edges[k + 1]], home[edges[k] : edges[k + 1]]
        left = np.ones(len(own), dtype=bool)
        for start in range(len(own)):
            queue = [start] if left[start] else []
            left[start] = False
            while queue:
                i = queue.pop()
                near = left & (np.bitwise_count(own ^ own[i]) <= most) & (at_home | at_home[i])
                new = np.flatnonzero(near)
                left[new] = False
                queue += new.tolist()
                a.append(np.full(len(new), edges[k] + i))
                b.append(edges[k] + new)
    if not a:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return prints[np.concatenate(a)], prints[np.concatenate(b)]


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])


def compare_buckets(dealt: DataFrame, most: int) -> DataFrame:
    """Links (a, b) of the rows of each (part, key, chunk), at most one less than rows."""
    n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = dealt.select(F.xxhash64("part", "key", "chunk").alias("segment"), "part", "key", "chunk", "home", "print")
    rows = rows.repartition(n, "part", "key", "chunk").sortWithinPartitions("segment", "part", "key", "chunk").select("segment", "home", "print")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def links(rows: pa.Table) -> pa.RecordBatch:
            columns = [rows.column(c).to_numpy() for c in ("segment", "home", "print")]
            return _pairs(*_bucket_links(columns[0], columns[1], columns[2].view(np.uint64), most))

        for batch in batches:
            if not batch.num_rows:
                continue
            segment = batch.column("segment").to_numpy()
            last = int(np.searchsorted(segment, segment[-1]))
            if last or (held and held[-1].column("segment")[0].as_py() != segment[0]):
                yield links(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held = []
            held.append(batch.slice(last))
        if held:
            yield links(pa.Table.from_batches(held))

    # Two buckets of one hash would be compared as one, which finds true links only.
    return rows.mapInArrow(run, "a bigint, b bigint")


def _differ(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def centre_links(big: DataFrame, most: int) -> DataFrame:
    """Links of each bucket's rows to the one next to its centre (the bits that most of it have)."""
    key = ["part", "key"]
    ones = [F.sum(F.shiftright("print", b).bitwiseAND(F.lit(1).cast("bigint"))).alias(f"b{b}") for b in range(BITS)]
    counts = big.groupBy(*key).agg(F.count(F.lit(1)).alias("rows"), *ones)
    centre = F.lit(0).cast("bigint")
    for b in range(BITS):
        bit = F.shiftleft(F.lit(1).cast("bigint"), b)
        centre = centre.bitwiseOR(F.when(2 * F.col(f"b{b}") > F.col("rows"), bit).otherwise(F.lit(0).cast("bigint")))
    centred = split_join(big, counts.select(*key, centre.alias("centre")), key, "inner", spread_by=["print"])
    chosen = centred.groupBy(*key).agg(F.min(F.struct(_differ("print", "centre").alias("far"), "print")).alias("m"))
    told = split_join(big, chosen.select(*key, F.col("m.print").alias("lead")), key, "inner", spread_by=["print"])
    return told.where((F.col("print") != F.col("lead")) & (_differ("print", "lead") <= most)).select(
        F.col("print").alias("a"), F.col("lead").alias("b")
    )


def stray_links(big: DataFrame, links: DataFrame, most: int) -> DataFrame:
    """Links between components of a bucket: all that is not in its largest one, against all of it.

    ``big``: part, key, chunk and print of buckets of several chunks; ``links`` are those known.
    """
    key = ["part", "key"]
    so_far = connected_components(links).select(F.col("node").alias("print"), "component")
    named = big.join(so_far, "print", "left").withColumn("component", F.coalesce("component", "print"))
    sizes = named.groupBy(*key, "component").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy(*key).agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count(F.lit(1)).alias("several"))
    named = named.join(main.where(F.col("several") > 1).drop("several"), key)
    entry = F.struct("print", "component")
    # A chunk has about CHUNK rows.
    chunks = named.groupBy(*key, "chunk").agg(
        F.collect_list(entry).alias("y"), F.collect_list(F.when(F.col("component") != F.col("main"), entry)).alias("x")
    )
    chunks = stored(chunks, "chunks")
    strays = chunks.where(F.size("x") > 0).select(*key, "x")
    pairs = strays.join(chunks.select(*key, "y"), key)
    n = int(big.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (x, cx), (y, cy) = ([f.to_numpy().view(np.uint64) for f in batch.column(c)[i].values.flatten()] for c in ("x", "y"))
                near = (np.bitwise_count(x[:, None] ^ y[None, :]) <= most) & (cx[:, None] != cy[None, :])
                a, b = np.nonzero(near)
                pick = _forest(cx[a], cy[b])
                yield _pairs(x[a[pick]], y[b[pick]])

    return pairs.select("x", "y").repartition(n).mapInArrow(run, "a bigint, b bigint")


def near_links(classes: DataFrame, plan: Plan, most: int, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) of fingerprints that connect what all pairs within ``most`` bits connect."""
    key = ["part", "key"]
    rows = probes(classes, plan)
    sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > chunk)
    hot = stored(sizes.select(*key, F.ceil(F.col("n") / chunk).cast("int").alias("chunks")), "hot")
    dealt = rows.join(hot, key, "left").withColumn("chunk", F.pmod(F.xxhash64("print"), F.coalesce("chunks", F.lit(1))).cast("int"))
    links = stored(compare_buckets(dealt, most), "links")
    if hot.isEmpty():
        return links
    big = stored(dealt.where(F.col("chunks").isNotNull()).select(*key, "chunk", "print"), "big")
    links = stored(links.unionByName(centre_links(big, most)).distinct(), "links")
    return links.unionByName(stray_links(big, links, most))


def near_prints(
    docs: DataFrame, width: int = WIDTH, most: int = MOST, text: str = "text", doc_id: str = "doc_id", chunk: int = CHUNK
) -> DataFrame:
    """``doc_id``, ``print`` and ``component_id`` (the smallest id of the component) of every row."""
    signed = stored(fingerprints(docs, width, text, doc_id), "prints")
    named = signed.where(F.col("doc_id").isNotNull())
    classes = stored(named.groupBy("print").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("__rows")), "classes")
    n = classes.count()
    links = near_links(classes, plan_for(classes, n, most), most, chunk) if n else classes.select(F.col("print").alias("a"), F.col("print").alias("b"))
    # Rows of one id with several texts.
    ids = named.groupBy("doc_id").agg(F.min("print").alias("a"), F.max("print").alias("z")).where(F.col("a") != F.col("z"))
    same = named.join(ids, "doc_id").select("a", F.col("print").alias("b"))
    components = connected_components(links.unionByName(same)).select(F.col("node").alias("print"), "component")
    told = classes.join(components, "print", "left").withColumn("component", F.coalesce("component", "print"))
    lowest = told.groupBy("component").agg(F.min("least").alias("component_id"))
    found = told.select("print", "component", "__rows").join(lowest, "component")
    out = split_join(
        signed, found.select("print", "component_id"), ["print"], "left", spread_by=["doc_id"], counts=classes.select("print", "__rows")
    )
    return out.select("doc_id", "print", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def op13_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of all documents: four-word shingles, four bits or less apart."""
    told = near_prints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return told.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")
