"""MinHash near-dedup over an LSH forest, with exact links.

A document is the set of its distinct word shingles; two are linked if their sets' Jaccard
similarity is at least ``threshold``. Result: the connected components.

1. Every text gives a MinHash signature and a 128-bit key of its set. Documents with equal sets are
   one class, named by its smallest id.
2. LSH forest: ``TREES`` orders of the signature, order t beginning at its value t * ``DEPTH``. All
   documents are sorted by each order; neighbours whose common prefix has ``DEPTH`` values or more
   are candidates, as pairs of their classes. Beyond that depth the sort itself adapts: in a crowded region the neighbours are
   those with the longest common prefix. The sort is by ranges of (prefix, document), so a region may
   span any number of tasks. At the threshold 0.8 a pair is apart in all 40 trees with a chance of
   1e-7.
3. Candidates whose signatures estimate a similarity of ``LOOSE`` or more make loose clusters
   (connected components). Every link lies inside one.
4. Inside loose clusters links are exact, on the full sets. Clusters are cut into chunks of
   ``CHUNK`` classes. Chunks are compared inside and to their cluster's first chunk; then every
   class that is not in the cluster's largest component so far is compared to all of the cluster.
   So each pair of classes is compared, or known to be in one component. What is sent between
   tasks are chunks; pairs are only made inside a task, and only those that link components leave.

Defined results: texts with fewer words than a shingle are one shingle; null or empty texts have an
empty set and are linked with nothing; rows without an id are linked with nothing and have no
component; rows that share an id are one document. Repeated rows are returned as often as they
come. An empty table gives no rows. Extra columns of the input are never read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from censemble.llm.bitmaps import bitmap, few_files, passing
from censemble.llm.components import connected_components
from censemble.llm.flat import flat, mix, sliced, windows, word_hashes, words
from censemble.llm.quality import fresh
from censemble.session import stored

DEPTH, TREES = 5, 40
DEEPER = 3
VALUES = DEPTH * TREES
LOOSE = 0.6
CHUNK = 256
WIDTH, PERCENT = 5, 80
# Factors of the hash functions: odd numbers from a fixed sequence.
_FACTORS = mix(np.arange(1, VALUES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts on end, ascending in each, and where each text's begin."""
    buffer, at = flat(texts)
    starts, ends, before = words(buffer, at)
    hashes = word_hashes(buffer, starts, ends, lower=True)
    shingles, begins = windows(hashes, before, width)
    doc = np.searchsorted(before, begins, side="right") - 1
    sizes = np.diff(before)
    short = np.flatnonzero((sizes > 0) & (sizes < width))
    if len(short):
        whole = np.zeros(len(short), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for j in range(width - 1):
                there = sizes[short] > j
                whole[there] = mix(whole[there] * np.uint64(3) + hashes[before[short[there]] + j])
        shingles, doc = np.concatenate([shingles, whole]), np.concatenate([doc, short])
    order = np.lexsort((shingles, doc))
    shingles, doc = shingles[order], doc[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (shingles[1:] != shingles[:-1]) | (doc[1:] != doc[:-1])
    shingles, doc = shingles[new], doc[new]
    return shingles, np.searchsorted(doc, np.arange(len(sizes) + 1))


def signatures(docs: DataFrame, width: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id``, ``n_shingles``, the set's key (``k1``, ``k2``) and its signature."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, "text"):
                shingles, at = shingle_sets(batch.column("text"), width)
                sizes = np.diff(at)
                some = np.flatnonzero(sizes)
                keys = np.zeros((2, len(sizes)), dtype=np.uint64)
                values = np.zeros((len(sizes), VALUES), dtype=np.uint32)
                if len(some):
                    begins = at[some]
                    with np.errstate(over="ignore"):
                        keys[0, some] = np.add.reduceat(mix(shingles), begins)
                        keys[1, some] = np.add.reduceat(mix(shingles + np.uint64(0x632BE59BD9B4E019)), begins)
                        for j in range(VALUES):
                            values[some, j] = np.minimum.reduceat(shingles * _FACTORS[j], begins) >> np.uint64(32)
                rows = pa.FixedSizeBinaryArray.from_buffers(
                    pa.binary(4 * VALUES), len(sizes), [None, pa.py_buffer(values)]
                ).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(sizes), pa.array(keys[0].view(np.int64)), pa.array(keys[1].view(np.int64)), rows],
                    names=["doc_id", "n_shingles", "k1", "k2", "signature"],
                )

    return rows.mapInArrow(run, "doc_id bigint, n_shingles bigint, k1 bigint, k2 bigint, signature binary")


def _values(column: pa.Array) -> np.ndarray:
    buffer, _ = flat(column)
    return buffer.view(np.uint32).reshape(len(column), VALUES)


def forest(classes: DataFrame) -> DataFrame:
    """A row (prefix, deeper, doc) for every class and tree."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 2000):
                part = batch.slice(begin, 2000)
                values = _values(part.column("signature")).astype(np.uint64)
                for tree in range(TREES):
                    prefix = np.full(len(values), tree + 1, dtype=np.uint64)
                    with np.errstate(over="ignore"):
                        for j in range(DEPTH):
                            prefix = mix(prefix * np.uint64(3) + values[:, tree * DEPTH + j])
                    order = (np.arange(DEEPER) + (tree + 1) * DEPTH) % VALUES
                    # Big-endian, so that bytes sort as the values do.
                    deeper = np.ascontiguousarray(values[:, order].astype(">u4")).tobytes()
                    size = 4 * DEEPER
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(prefix.view(np.int64)),
                            pa.array([deeper[i : i + size] for i in range(0, len(deeper), size)], pa.binary()),
                            part.column("doc_id"),
                        ],
                        names=["prefix", "deeper", "doc"],
                    )

    return classes.select("doc_id", "signature").mapInArrow(run, "prefix bigint, deeper binary, doc bigint")


def candidates(classes: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) that are neighbours with a common prefix in some tree."""
    spark = classes.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = forest(classes).repartitionByRange(n, "prefix", "deeper", "doc").sortWithinPartitions("prefix", "deeper", "doc")
    ranged = ranged.select(F.spark_partition_id().alias("part"), "prefix", "doc")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a and b are a pair; a row with prefix is the first or last one of its partition.
        last: tuple[int, int] | None = None
        part = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            prefix, doc = batch.column("prefix").to_numpy(), batch.column("doc").to_numpy()
            part = batch.column("part")[0].as_py()
            if last is None:
                yield _rows([], [], [(part, 0, prefix[0], doc[0])])
            else:
                prefix, doc = np.insert(prefix, 0, last[0]), np.insert(doc, 0, last[1])
            same = (prefix[1:] == prefix[:-1]) & (doc[1:] != doc[:-1])
            a, b = doc[:-1][same], doc[1:][same]
            last = (prefix[-1], doc[-1])
            yield _rows(np.minimum(a, b), np.maximum(a, b), [])
        if last is not None:
            yield _rows([], [], [(part, 1, *last)])

    schema = "a bigint, b bigint, part int, edge int, prefix bigint"
    found = stored(ranged.mapInArrow(run, schema), "neighbours")
    pairs = found.where(F.col("part").isNull()).select("a", "b")
    # The last row of a partition and the first of the next one that has any: two rows a partition.
    order = W.orderBy("part", "edge")
    edges = found.where(F.col("part").isNotNull()).select("part", "edge", "prefix", F.col("a").alias("doc"))
    over = edges.select(
        "edge", "prefix", "doc", F.lag("prefix").over(order).alias("p"), F.lag("doc").over(order).alias("d")
    ).where((F.col("edge") == 0) & (F.col("p") == F.col("prefix")) & (F.col("d") != F.col("doc")))
    over = over.select(F.least("d", "doc").alias("a"), F.greatest("d", "doc").alias("b"))
    return pairs.unionByName(over).distinct()


def _rows(a, b, edges: list[tuple]) -> pa.RecordBatch:
    if edges:
        part, edge, prefix, doc = edges[0]
        columns = [[doc], [None], [part], [edge], [prefix]]
    else:
        none = np.zeros(0)
        columns = [a, b, none, none, none]
        n = len(a)
        return pa.RecordBatch.from_arrays(
            [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64())],
            names=["a", "b", "part", "edge", "prefix"],
        )
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["a", "b", "part", "edge", "prefix"]
    )


def loose_pairs(pairs: DataFrame, classes: DataFrame, least: float = LOOSE) -> DataFrame:
    """The pairs whose signatures agree in a share of at least ``least`` of their values."""

    def lowest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One byte of each value is enough to tell agreement: chance adds 1/256.
        for batch in batches:
            low = np.ascontiguousarray(_values(batch.column("signature")).astype(np.uint8))
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(VALUES), len(low), [None, pa.py_buffer(low)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), packed.cast(pa.binary())], names=["doc", "low"])

    low = classes.select("doc_id", "signature").mapInArrow(lowest, "doc bigint, low binary")
    both = pairs.join(low.select(F.col("doc").alias("a"), F.col("low").alias("x")), "a")
    both = both.join(low.select(F.col("doc").alias("b"), F.col("low").alias("y")), "b")

    def close(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (flat(batch.column(c))[0].reshape(-1, VALUES) for c in ("x", "y"))
            keep = pa.array((x == y).sum(axis=1) >= least * VALUES)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return both.select("a", "b", "x", "y").mapInArrow(close, "a bigint, b bigint")


def _linked(shingles: np.ndarray, at: np.ndarray, n_left: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), i below ``n_left`` and j above i, of sets that are alike enough."""
    n = len(at) - 1
    doc = np.repeat(np.arange(n), np.diff(at))
    _, place, count = np.unique(shingles, return_inverse=True, return_counts=True)
    shared = count[place] > 1
    doc, place = doc[shared], place[shared]
    _, place = np.unique(place, return_inverse=True)
    both = np.zeros((n_left, n), dtype=np.float32)
    order = np.argsort(place, kind="stable")
    doc, place = doc[order], place[order]
    width = 4096
    total = int(place[-1]) + 1 if len(place) else 0
    for first in range(0, total, width):
        lo, hi = np.searchsorted(place, [first, first + width])
        table = np.zeros((n, min(width, total - first)), dtype=np.float32)
        table[doc[lo:hi], place[lo:hi] - first] = 1
        both += table[:n_left] @ table.T
    sizes = np.diff(at)
    union = sizes[:n_left, None] + sizes[None, :] - both
    alike = 100 * both >= percent * union
    alike &= np.arange(n)[None, :] > np.arange(n_left)[:, None]
    return np.nonzero(alike)


def _spanning(ids: np.ndarray, i: np.ndarray, j: np.ndarray, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links enough to connect what all links connect; none between equal known components."""
    root = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            root[x] = x = root.get(root[x], root[x])
        return x

    names = ids if known is None else known
    out = []
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        a, b = find(int(names[x])), find(int(names[y]))
        if a != b:
            root[a] = b
            out.append((int(ids[x]), int(ids[y])))
    return out


_CHUNKS = "a bigint, b bigint, cluster bigint, chunk int, docs array<bigint>, sizes array<int>, sets binary"


def compare_chunks(members: DataFrame, percent: int, width: int) -> DataFrame:
    """Links inside chunks as (a, b), and for clusters of several chunks the chunks themselves.

    ``members``: cluster, chunk, chunks, doc, text.
    """
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = members.repartition(n, "cluster", "chunk").sortWithinPartitions("cluster", "chunk", "doc")

    def finish(rows: list[tuple]) -> tuple[list, list]:
        ids = np.array([r[3] for r in rows], dtype=np.int64)
        shingles, at = shingle_sets(pa.array([r[4] for r in rows], pa.large_string()), width)
        links = _spanning(ids, *_linked(shingles, at, len(ids), percent))
        chunk = []
        if rows[0][2] > 1:
            chunk = [(None, None, rows[0][0], rows[0][1], ids.tolist(), np.diff(at).tolist(), shingles.tobytes())]
        return [(a, b, None, None, None, None, None) for a, b in links], chunk

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for whole in batches:
            for batch in sliced(whole, "text"):
                out: list[tuple] = []
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if held and held[0][:2] != row[:2]:
                        links, chunk = finish(held)
                        out += links + chunk
                        held = []
                    held.append(row)
                yield _chunk_rows(out)
        if held:
            links, chunk = finish(held)
            yield _chunk_rows(links + chunk)

    return dealt.select("cluster", "chunk", "chunks", "doc", "text").mapInArrow(run, _CHUNKS)


_CHUNK_TYPES = pa.schema([
    ("a", pa.int64()), ("b", pa.int64()), ("cluster", pa.int64()), ("chunk", pa.int32()),
    ("docs", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("sets", pa.binary()),
])


def _chunk_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_CHUNK_TYPES)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _CHUNK_TYPES, strict=True)], schema=_CHUNK_TYPES)


def compare_pairs_of_chunks(pairs: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components, for rows of two chunks.

    Columns x_docs, x_sizes, x_sets, x_known and the same with y; known is the component so far.
    """
    names = [f"{side}_{c}" for side in "xy" for c in ("docs", "sizes", "sets", "known")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int]] = []
            for i in range(batch.num_rows):
                docs, sizes, sets, known = (
                    [batch.column(f"{side}_{c}")[i].as_py() for side in "xy"] for c in ("docs", "sizes", "sets", "known")
                )
                ids = np.array(docs[0] + docs[1], dtype=np.int64)
                at = np.concatenate([[0], np.cumsum(sizes[0] + sizes[1])])
                shingles = np.frombuffer(sets[0] + sets[1], dtype=np.uint64)
                part = np.array(known[0] + known[1], dtype=np.int64)
                x, y = _linked(shingles, at, len(docs[0]), percent)
                apart = part[x] != part[y]
                out += _spanning(ids, x[apart], y[apart], part)
            a, b = zip(*out, strict=True) if out else ([], [])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs.select(*names).repartition(n).mapInArrow(run, "a bigint, b bigint")


def exact_links(docs: DataFrame, clusters: DataFrame, percent: int, width: int) -> DataFrame:
    """Links (a, b) of alike sets that connect what all such links inside clusters connect.

    ``docs``: doc_id and text of classes; ``clusters``: node, component.
    """
    sizes = clusters.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    members = clusters.join(sizes, "component").select(
        F.col("node").alias("doc_id"),
        F.col("component").alias("cluster"),
        F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("chunk"),
        "chunks",
    )
    texts = members.join(_of_members(docs, members), "doc_id").select(
        "cluster", "chunk", "chunks", F.col("doc_id").alias("doc"), "text"
    )
    compared = stored(compare_chunks(texts, percent, width), "chunks")
    links = compared.where(F.col("a").isNotNull()).select("a", "b")
    chunks = compared.where(F.col("a").isNull()).drop("a", "b")
    if chunks.isEmpty():
        return links

    def side(name: str, frame: DataFrame) -> DataFrame:
        return frame.select("cluster", *[F.col(c).alias(f"{name}_{c}") for c in ("chunk", "docs", "sizes", "sets", "known")])

    # To the first chunk of each cluster, to find most of its large components.
    bare = chunks.withColumn("known", F.col("docs"))
    first = chunks.groupBy("cluster").agg(F.min("chunk").alias("first"))
    firsts = side("x", bare.join(first, "cluster").where(F.col("chunk") == F.col("first")))
    meet = firsts.join(side("y", bare), "cluster").where(F.col("x_chunk") < F.col("y_chunk"))
    links = stored(few_files(links.unionByName(compare_pairs_of_chunks(meet, percent))), "links")

    # All that is not in the largest component of its cluster, against the whole cluster.
    so_far = connected_components(links)
    flat_docs = chunks.select("cluster", "chunk", F.posexplode("docs").alias("place", "node"))
    named = flat_docs.join(so_far, "node", "left").select(
        "cluster", "chunk", "place", "node", F.coalesce("component", "node").alias("component")
    )
    weights = named.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("n"))
    main = weights.groupBy("cluster").agg(F.max_by("component", F.struct("n", "component")).alias("main"))
    known = named.groupBy("cluster", "chunk").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("place", "component"))), lambda p: p["component"]).alias("known")
    )
    told = chunks.join(known, ["cluster", "chunk"]).join(main, "cluster")
    strays = told.where(F.exists("known", lambda c: c != F.col("main")))
    strays = strays.withColumn("only", F.transform("known", lambda c: c != F.col("main")))
    strays = _only(strays)
    again = side("x", strays).join(side("y", told), "cluster")
    return links.unionByName(compare_pairs_of_chunks(again, percent))


def _of_members(docs: DataFrame, members: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` of documents that may be members, told by a bitmap of fixed size.

    It spares the shuffle the texts of most documents that are in no cluster; the join that
    follows leaves out the rest.
    """
    known = docs.sparkSession.sparkContext.broadcast(bitmap(members.select(F.xxhash64("doc_id").alias("h")), "h"))
    hashed = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("h"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array(passing(known.value, batch.column("h").to_numpy().view(np.uint64)))
            kept = batch.filter(keep)
            yield pa.RecordBatch.from_arrays([kept.column("doc_id"), kept.column("text")], names=["doc_id", "text"])

    return hashed.mapInArrow(run, "doc_id bigint, text string")


def _only(strays: DataFrame) -> DataFrame:
    """Chunks with the members that ``only`` marks."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                keep = np.array(row["only"], dtype=bool)
                sets = np.frombuffer(row["sets"], dtype=np.uint64)[np.repeat(keep, row["sizes"])]
                pick = np.flatnonzero(keep).tolist()
                out.append((row["cluster"], row["chunk"], *([row[c][i] for i in pick] for c in ("docs", "sizes", "known")), sets.tobytes()))
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            types = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["cluster", "chunk", "docs", "sizes", "known", "sets"]
            )

    return strays.select("cluster", "chunk", "docs", "sizes", "sets", "known", "only").mapInArrow(
        run, "cluster bigint, chunk int, docs array<bigint>, sizes array<int>, known array<bigint>, sets binary"
    )


def _by_class(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """Pairs of documents as distinct pairs of different classes."""
    x = names.select(F.col("doc_id").alias("a"), F.col("least").alias("x"))
    y = names.select(F.col("doc_id").alias("b"), F.col("least").alias("y"))
    both = pairs.join(x, "a").join(y, "b").where(F.col("x") != F.col("y"))
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` of every row."""
    signed = stored(signatures(docs, width, text, doc_id), "signatures")
    named = signed.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    key = ["k1", "k2", "n_shingles"]
    classes = named.groupBy(*key).agg(F.min("doc_id").alias("least"))
    signs = named.select("doc_id", "signature")
    # Signatures stay where they are: copies go through the forest, then pairs take class names.
    names = named.select("doc_id", *key).join(classes, key).select("doc_id", "least").distinct()
    pairs = loose_pairs(_by_class(candidates(signs), names), signs)
    clusters = connected_components(pairs)
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    links = exact_links(texts, clusters, percent, width)
    # Rows with one id and several texts tie their classes together.
    lowest = names.groupBy("doc_id").agg(F.min("least").alias("a"))
    same = names.join(lowest, "doc_id").where(F.col("a") != F.col("least")).select("a", F.col("least").alias("b"))
    links = links.unionByName(same)
    components = connected_components(links).select(F.col("node").alias("least"), "component")
    found = classes.join(components, "least", "left").select(
        "k1", "k2", "n_shingles", F.coalesce("component", "least").alias("component_id")
    )
    out = signed.select("doc_id", "n_shingles", "k1", "k2").join(found, ["k1", "k2", "n_shingles"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The document with the smallest id of every component, once; the columns stay the same.

    Rows without an id all stay. Of rows that share an id, the one with the smallest text stays.
    """
    judged = near_duplicates(docs, width, percent, text, doc_id)
    stays, nth = fresh(docs, "stays"), fresh(docs, "nth")
    stay = judged.where(F.col("kept") & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias(stays)).distinct()
    named = docs.join(stay, F.col(doc_id).cast("long") == F.col(stays), "leftsemi")
    turn = F.row_number().over(W.partitionBy(doc_id).orderBy(text))
    named = named.withColumn(nth, turn).where(F.col(nth) == 1).drop(nth)
    return named.unionByName(docs.where(F.col(doc_id).isNull()))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents by two-word shingles at a similarity of 0.8 or more."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=2)
