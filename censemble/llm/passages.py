"""Substring dedup: words of passages that an earlier document holds are removed, exactly.

A window is a run of consecutive words of one document. A word goes if a window that covers it also
starts in a document with a smaller id. Documents are dealt into groups by a hash of their id and text; each
group is the partition of a count-min sketch:

1. every group counts its distinct windows in the cells of the sketch's rows; counts of a block of
   cells are merged over all groups, and each group gets back one bit per cell: counted twice or not;
2. only windows whose cells were all counted twice can be repeated. They alone are grouped exactly,
   by 128-bit fingerprint; each group sends a window once, with its smallest document, and gets back
   one bit: another group has a smaller one;
3. every group removes covered words.

What moves between groups and blocks are packed arrays, one row per group and block. A window that
a third of all documents share is sent once per group, never once per document. The number of
groups and blocks grows with the square root of the corpus, so that a row holds about
``CHUNK_BYTES`` of text at every size; nothing is broadcast and nothing comes to the driver but the
total length of the texts. The overestimate of the sketch costs only work: no window is lost.

Defined results: a null or empty text has no words and an empty result; documents without an id
count as the last ones, and equal ids take nothing from each other; an empty table gives no rows.
Extra columns of the input are never read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from censemble.llm.flat import flat, mix, windows, word_hashes, words

WINDOW_WORDS = 13
SKETCH_ROWS = 2
# Cells of a sketch row for each window of the corpus.
CELLS_PER_WINDOW = 8
CHUNK_BYTES = 5_600
BYTES_PER_WORD = 5
NO_ID = np.iinfo(np.int64).max


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers as compressed byte planes."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


class Shape:
    """Groups, blocks and cells for a corpus of so many bytes."""

    def __init__(self, size: int, rows: int = SKETCH_ROWS) -> None:
        self.groups = max(1, math.ceil(math.sqrt(size / CHUNK_BYTES)))
        self.rows = rows
        per_block = CELLS_PER_WINDOW * size / BYTES_PER_WORD / self.groups
        self.cell_bits = min(30, max(10, math.ceil(math.log2(per_block + 1))))


class Group:
    """Distinct windows of the documents of a group."""

    def __init__(self, docs: pa.Table, width: int) -> None:
        ids = docs.column("doc_id").to_numpy() if not docs.column("doc_id").null_count else np.array(
            [NO_ID if i is None else i for i in docs.column("doc_id").to_pylist()], dtype=np.int64
        )
        order = np.argsort(ids, kind="stable")
        docs = docs.take(pa.array(order))
        self.docs, self.ids, self.width = docs, ids[order], width
        self.buffer, self.at = flat(docs.column("text"))
        self.starts, self.ends, self.before = words(self.buffer, self.at)
        one, self.begins = windows(word_hashes(self.buffer, self.starts, self.ends, seed=1), self.before, width)
        two, _ = windows(word_hashes(self.buffer, self.starts, self.ends, seed=2), self.before, width)
        self.doc = np.searchsorted(self.before, self.begins, side="right") - 1
        # Documents are in order of their ids, so a stable sort keeps the smallest of a window first.
        self.order = np.argsort(one, kind="stable")
        one, two = one[self.order], two[self.order]
        doc_ids = self.ids[self.doc[self.order]]
        new = np.ones(len(one), dtype=bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        first = np.flatnonzero(new)
        # For each window in sorted order its place among the distinct ones.
        self.place = np.cumsum(new) - 1
        other = new.copy()
        other[1:] |= doc_ids[1:] != doc_ids[:-1]
        self.one, self.two, self.least = one[first], two[first], doc_ids[first]
        self.n_docs = np.add.reduceat(other.astype(np.int64), first) if len(first) else np.zeros(0, np.int64)

    def cells(self, row: int, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct cells in order, where each block begins, which were counted twice here, and the
        cell of each distinct window."""
        with np.errstate(over="ignore"):
            c = mix(self.one + np.uint64((row + 1) * 0xA24BAED4963EE407 & (2**64 - 1)))
        block = c % np.uint64(shape.groups)
        cell = (c >> np.uint64(20)) & np.uint64((1 << shape.cell_bits) - 1)
        keys, place = np.unique(block << np.uint64(32) | cell, return_inverse=True)
        counted = np.bincount(place, weights=self.n_docs, minlength=len(keys))
        edges = np.searchsorted(keys, np.arange(shape.groups + 1, dtype=np.uint64) << np.uint64(32))
        return keys, edges, counted >= 2, place

    def suspects(self, bits: pa.Table, shape: Shape) -> np.ndarray:
        """Distinct windows that the merged sketch takes for repeated, by block of the exact pass."""
        repeated = np.ones(len(self.one), dtype=bool)
        told = _by_block(bits, "row")
        for row in range(shape.rows):
            keys, edges, _, place = self.cells(row, shape)
            repeated &= _spread(told.get(row, {}), edges, len(keys))[place]
        found = np.flatnonzero(repeated)
        return found[np.argsort(self.one[found] % np.uint64(shape.groups), kind="stable")]

    def edges(self, found: np.ndarray, shape: Shape) -> np.ndarray:
        return np.searchsorted(self.one[found] % np.uint64(shape.groups), np.arange(shape.groups + 1, dtype=np.uint64))

    def kept(self, earlier: np.ndarray) -> pa.Table:
        """Words that are left, given which distinct windows another group has in an earlier document."""
        gone = earlier[self.place] | (self.least[self.place] < self.ids[self.doc[self.order]])
        begins = self.begins[self.order][gone]
        change = np.zeros(len(self.starts) + 1, dtype=np.int64)
        np.add.at(change, begins, 1)
        np.add.at(change, begins + self.width, -1)
        covered = np.cumsum(change)[:-1] > 0
        n_words = np.diff(self.before)
        removed = np.concatenate([[0], np.cumsum(covered)])
        n_removed = removed[self.before[1:]] - removed[self.before[:-1]]
        data = self.buffer.tobytes()
        texts = []
        for d in range(len(self.ids)):
            left = np.flatnonzero(~covered[self.before[d] : self.before[d + 1]]) + self.before[d]
            texts.append(b" ".join(data[a:b] for a, b in zip(self.starts[left].tolist(), self.ends[left].tolist(), strict=True)).decode())
        return pa.table({
            "doc_id": self.docs.column("doc_id"), "n_words": pa.array(n_words), "n_removed": pa.array(n_removed),
            "text": pa.array(texts, pa.string()),
        })


def _by_block(bits: pa.Table, row: str | None) -> dict:
    out: dict = {}
    rows = bits.column(row).to_pylist() if row else [0] * bits.num_rows
    for r, block, data in zip(rows, bits.column("block").to_pylist(), bits.column("bits").to_pylist(), strict=True):
        out.setdefault(r, {})[block] = data
    return out


def _spread(told: dict[int, bytes], edges: np.ndarray, n: int) -> np.ndarray:
    """Bits of blocks, put in their places."""
    out = np.zeros(n, dtype=bool)
    for block, data in told.items():
        begin, end = edges[block], edges[block + 1]
        out[begin:end] = np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=end - begin).astype(bool)
    return out


def remove_repeated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = WINDOW_WORDS) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed`` and ``text``: the words left, joined by one space."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    shape = Shape(int(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0))
    n = shape.groups
    dealt = rows.withColumn("gid", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int"))

    def sketch(table: pa.Table) -> pa.Table:
        group = Group(table, width)
        out: dict[str, list] = {"gid": [], "row": [], "block": [], "cells": []}
        for row in range(shape.rows):
            keys, edges, twice, _ = group.cells(row, shape)
            values = (keys & np.uint64(0x7FFFFFFF)).astype(np.uint32) | (twice.astype(np.uint32) << np.uint32(31))
            for block in np.flatnonzero(np.diff(edges)).tolist():
                part = values[edges[block] : edges[block + 1]]
                out["gid"].append(table.column("gid")[0].as_py())
                out["row"].append(row)
                out["block"].append(block)
                out["cells"].append(_cells_packed(part))
        return pa.table(out, schema=pa.schema([("gid", pa.int32()), ("row", pa.int32()), ("block", pa.int32()), ("cells", pa.binary())]))

    def merge_cells(table: pa.Table) -> pa.Table:
        parts = [_cells_unpacked(c) for c in table.column("cells").to_pylist()]
        flow = np.concatenate(parts)
        _, place, count = np.unique(flow & np.uint32(0x7FFFFFFF), return_inverse=True, return_counts=True)
        repeated = (count >= 2) | (np.bincount(place, weights=flow >> np.uint32(31)) > 0)
        return _answers(table, repeated[place], [len(p) for p in parts], ["gid", "row", "block"])

    def exact(docs_table: pa.Table, bits: pa.Table) -> pa.Table:
        out: dict[str, list] = {"gid": [], "block": [], "prints": []}
        if docs_table.num_rows:
            group = Group(docs_table, width)
            found = group.suspects(bits, shape)
            edges = group.edges(found, shape)
            for block in np.flatnonzero(np.diff(edges)).tolist():
                part = found[edges[block] : edges[block + 1]]
                out["gid"].append(docs_table.column("gid")[0].as_py())
                out["block"].append(block)
                out["prints"].append(
                    _pack(np.concatenate([group.one[part], group.two[part], group.least[part].view(np.uint64)]))
                )
        return pa.table(out, schema=pa.schema([("gid", pa.int32()), ("block", pa.int32()), ("prints", pa.binary())]))

    def merge_exact(table: pa.Table) -> pa.Table:
        parts = [_unpack(p, np.uint64).reshape(3, -1) for p in table.column("prints").to_pylist()]
        one, two, doc = np.concatenate(parts, axis=1)
        doc = doc.view(np.int64)
        order = np.lexsort((doc, two, one))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
        least = doc[order][new][np.cumsum(new) - 1]
        earlier = np.zeros(len(order), dtype=bool)
        earlier[order] = least < doc[order]
        return _answers(table, earlier, [p.shape[1] for p in parts], ["gid", "block"])

    def clean(docs_table: pa.Table, both: pa.Table) -> pa.Table:
        if not docs_table.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()),
                             "n_removed": pa.array([], pa.int64()), "text": pa.array([], pa.string())})
        group = Group(docs_table, width)
        exactly = np.array(both.column("row").to_pylist(), dtype=np.int64) < 0
        found = group.suspects(both.filter(pa.array(~exactly)), shape)
        told = _by_block(both.filter(pa.array(exactly)), None).get(0, {})
        earlier = np.zeros(len(group.one), dtype=bool)
        earlier[found] = _spread(told, group.edges(found, shape), len(found))
        return group.kept(earlier)

    cells = dealt.groupBy("gid").applyInArrow(sketch, "gid int, row int, block int, cells binary")
    answers = cells.groupBy("row", "block").applyInArrow(merge_cells, "gid int, row int, block int, bits binary")
    prints = dealt.groupBy("gid").cogroup(answers.groupBy("gid")).applyInArrow(exact, "gid int, block int, prints binary")
    earlier = prints.groupBy("block").applyInArrow(merge_exact, "gid int, block int, bits binary")
    told = answers.unionByName(earlier.withColumn("row", F.lit(-1)))
    return dealt.groupBy("gid").cogroup(told.groupBy("gid")).applyInArrow(
        clean, "doc_id bigint, n_words bigint, n_removed bigint, text string"
    )


def _cells_packed(values: np.ndarray) -> bytes:
    """Ascending cells as steps, with the flags kept apart."""
    cells = values & np.uint32(0x7FFFFFFF)
    steps = np.diff(cells, prepend=np.uint32(0)).astype(np.uint32)
    return _pack(steps | (values & np.uint32(0x80000000)))


def _cells_unpacked(data: bytes) -> np.ndarray:
    steps = _unpack(data, np.uint32)
    cells = np.cumsum(steps & np.uint32(0x7FFFFFFF), dtype=np.uint32)
    return cells | (steps & np.uint32(0x80000000))


def _answers(table: pa.Table, bits: np.ndarray, sizes: list[int], keys: list[str]) -> pa.Table:
    """One row of bits per row that was sent."""
    edges = np.concatenate([[0], np.cumsum(sizes)])
    packed = [np.packbits(bits[a:b]).tobytes() for a, b in zip(edges, edges[1:], strict=False)]
    columns = [table.column(k) for k in keys]
    return pa.table([*columns, pa.array(packed, pa.binary())], names=[*keys, "bits"])


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word counts and digest of the words left of every document."""
    left = remove_repeated(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
