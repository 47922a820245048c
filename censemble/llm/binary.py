"""Token ids as compressed byte planes: encode texts, write a sharded id file set, read it back.

Format (version 1), a folder of Parquet files, so that Spark's committers keep it whole when tasks
are repeated, and any store that Spark reads can hold it. A row holds one of two records:

* ``b``, a block: shard, block, n_ids, planes. The ids of a shard, in document order, are cut into
  blocks of a fixed number of ids; a block's ids as little-endian unsigned 32-bit integers are
  transposed into four byte planes or 32 bit planes, each compressed with zstandard by itself.
* ``e``, an entry of the chunk index: shard, block, entry, doc_id, in_block, n_ids. It says where a
  document begins, so that its blocks are found without reading others.

Shards are consecutive ranges of documents by id, so shard order and order inside a shard give the
global order. Within a shard a block may hold parts of many documents, and a document many blocks.

Defined results: a null or empty text has only the end id; documents without an id come first;
equal ids are ordered by text, and each repeated row is a document of its own; an empty table
gives an empty set. Extra columns of the input are never read.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from censemble.llm.flat import CUT_BYTES, Cache, flat, sliced
from censemble.session import scratch_path

BLOCK_IDS = 65_536
SHARD_BYTES = 16_000_000
CACHED_CUTS = 800_000
RECORDS = (
    "b struct<shard:int, block:bigint, n_ids:int, planes:array<binary>>, "
    "e struct<shard:int, block:bigint, entry:bigint, doc_id:bigint, in_block:int, n_ids:bigint>"
)


class Coder:
    """Ids of the tokenizers library, each distinct cut of a batch encoded once.

    A byte-level vocabulary's splitting pattern has a boundary before white space that follows
    another character, after a newline that stands alone between other characters, and between a
    letter and a mark; texts are cut there, where the bytes show the case beyond doubt. They are also
    cut before and after the strings of added tokens, never inside.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Added tokens are found in a text before it is split; texts are cut around them.
        added = self.tokenizer.get_added_tokens_decoder().values()
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added):
            raise ValueError("added tokens that take in white space or ask for whole words are not cut around")
        longest_first = sorted((t.content.encode() for t in added), key=len, reverse=True)
        self.added = re.compile(b"|".join(map(re.escape, longest_first))) if longest_first else None
        self.cache = Cache(self._encode_new, CACHED_CUTS)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids on end, and the number of ids of each text."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        buffer, at = flat(texts)
        if not len(buffer):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        # Where the byte before and the byte itself show a boundary, or may show one.
        show = _SHOWN[buffer[:-1], buffer[1:]]
        found = np.flatnonzero(show)
        show = show[found]
        # Told by the byte two before: C3 begins a letter, but for two signs; a newline must stand
        # alone, as more white space before it would be taken together with it.
        two_before = buffer[np.maximum(found - 1, 0)]
        last = buffer[found]
        letter = (two_before == 0xC3) & (last != 0x97) & (last != 0xB7)
        alone = (found > 0) & ~_IS_SPACE[two_before]
        alone &= _ENDS_VISIBLE[two_before] | (buffer[np.maximum(found - 2, 0)] == 0xC3)
        sure = (show == 1) | (show == 2) & (two_before == 0xC3) | (show == 3) & letter | (show == 4) & alone
        cut = np.zeros(len(buffer) + 1, dtype=bool)
        cut[found[sure] + 1] = True
        for begin, end in self._added_in(buffer, at):
            cut[begin + 1 : end] = False
            cut[[begin, end]] = True
        cut[at] = True
        cut[-1] = False
        begins = np.flatnonzero(cut)
        edges = np.append(begins, len(buffer)).astype(np.int64)
        cuts = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(begins), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(buffer))]
        ).dictionary_encode()
        found = self.cache.look_up(cuts.dictionary.to_pylist())
        which = cuts.indices.to_numpy()
        counts = np.array([len(f) for f in found], dtype=np.int64) // 4
        offsets = np.concatenate([[0], np.cumsum(counts)])
        all_ids = np.frombuffer(b"".join(found), np.uint32)
        n = counts[which]
        total = np.concatenate([[0], np.cumsum(n)])
        ids = all_ids[np.arange(total[-1]) + np.repeat(offsets[which] - total[:-1], n)]
        # A text's cuts begin where the text does.
        bounds = total[np.searchsorted(begins, at)]
        return ids, np.diff(bounds)

    def _added_in(self, buffer: np.ndarray, at: np.ndarray) -> list[tuple[int, int]]:
        """Where added tokens stand, the first and longest ones, inside texts."""
        if self.added is None:
            return []
        data = buffer.tobytes()
        # Of all texts on end first, which may also show some that two texts share.
        shown = {d for m in self.added.finditer(data) for d in np.searchsorted(at, [m.start(), m.end() - 1], side="right") - 1}
        return [m.span() for d in sorted(shown) for m in self.added.finditer(data, int(at[d]), int(at[d + 1]))]

    def _encode_new(self, cuts: list[bytes]) -> list[bytes]:
        coded = self.tokenizer.encode_batch_fast([c.decode() for c in cuts], add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in coded]


def _shown() -> np.ndarray:
    """For a byte and the next: 1 a boundary, 2-4 one under a condition on the byte before, else 0.

    White space beyond ASCII begins with C2, E1, E2 or E3 and never ends in B0-BF.
    """
    byte = np.arange(256)
    letter = (byte >= 0x41) & (byte <= 0x5A) | (byte >= 0x61) & (byte <= 0x7A)
    digit = (byte >= 0x30) & (byte <= 0x39)
    mark = (byte >= 0x21) & (byte <= 0x7E) & ~letter & ~digit
    starts = letter | digit | mark | (byte >= 0xC3) & (byte <= 0xE0) | (byte >= 0xE4) & (byte <= 0xF4)
    later = (byte >= 0x80) & (byte <= 0xBF)
    out = np.zeros((256, 256), dtype=np.uint8)
    out[np.ix_(later & ~_ENDS_VISIBLE, _IS_SPACE)] = 2
    out[np.ix_(_ENDS_VISIBLE, _IS_SPACE)] = 1
    out[np.ix_(letter, mark)] = 1
    out[np.ix_(later, mark)] = 3
    out[10, starts] = 4
    return out


_IS_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_ENDS_VISIBLE = np.isin(np.arange(256), [*range(0x21, 0x7F), *range(0xB0, 0xC0)])
_SHOWN = _shown()


@lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    return Coder(path)


def to_planes(ids: np.ndarray, bits: bool, level: int = 3) -> list[bytes]:
    """Byte or bit planes of unsigned 32-bit ids, each compressed."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if bits:
        planes = np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T, axis=1)
    else:
        planes = np.ascontiguousarray(raw.T)
    press = zstandard.ZstdCompressor(level=level)
    return [press.compress(p.tobytes()) for p in planes]


def from_planes(planes: list[bytes], n_ids: int) -> np.ndarray:
    """The ids of a block; bit and byte planes are told apart by their number."""
    press = zstandard.ZstdDecompressor()
    rows = np.stack([np.frombuffer(press.decompress(p), dtype=np.uint8) for p in planes])
    if len(planes) == 32:
        raw = np.packbits(np.unpackbits(rows, axis=1)[:, :n_ids].T, axis=1, bitorder="little")
    else:
        raw = rows.T
    return np.ascontiguousarray(raw).reshape(-1).view("<u4")


def write_ids(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    end_id: int | None = 0,
    block_ids: int = BLOCK_IDS,
    bits: bool = False,
    shard_bytes: int = SHARD_BYTES,
) -> None:
    """Encode ``(doc_id, text)`` and write the format to ``folder``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    spark = docs.sparkSession
    size = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    shards = max(1, -(-int(size) // shard_bytes))
    # Rows that share an id, or have none, are more than one shard's: the begin of the text goes on.
    placed = rows.repartitionByRange(shards, F.col("doc_id"), F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text")
    placed = placed.withColumn("shard", F.spark_partition_id())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(tokenizer)
        shard, held, n_held, first_block, placed_ids, entry = None, [], 0, 0, 0, 0

        def block(ids: np.ndarray, number: int) -> dict:
            return {"shard": shard, "block": number, "n_ids": len(ids), "planes": to_planes(ids, bits)}

        for whole in batches:
            for batch in sliced(whole, "text", CUT_BYTES):
                shard = batch.column("shard")[0].as_py()
                ids, counts = code.encode(batch.column("text"))
                if end_id is not None:
                    ids = np.insert(ids, np.cumsum(counts), np.uint32(end_id))
                    counts = counts + 1
                starts = placed_ids + np.concatenate([[0], np.cumsum(counts)[:-1]])
                n = len(counts)
                entries = [
                    pa.array(np.full(n, shard, np.int32)), pa.array(starts // block_ids),
                    pa.array(np.arange(entry, entry + n)), batch.column("doc_id"),
                    pa.array((starts % block_ids).astype(np.int32)), pa.array(counts),
                ]
                entry += n
                placed_ids += len(ids)
                held.append(ids)
                n_held += len(ids)
                blocks = []
                if n_held >= block_ids:
                    flow = np.concatenate(held)
                    full = len(flow) // block_ids
                    blocks = [block(flow[i * block_ids : (i + 1) * block_ids], first_block + i) for i in range(full)]
                    held, n_held = [flow[full * block_ids :]], len(flow) - full * block_ids
                    first_block += full
                yield _both(blocks, entries)
        if n_held:
            yield _both([block(np.concatenate(held), first_block)], None)

    placed.mapInArrow(run, RECORDS).write.parquet(folder)


_BLOCK_TYPE = pa.struct([("shard", pa.int32()), ("block", pa.int64()), ("n_ids", pa.int32()), ("planes", pa.list_(pa.binary()))])
_ENTRY_TYPE = pa.struct(
    [("shard", pa.int32()), ("block", pa.int64()), ("entry", pa.int64()), ("doc_id", pa.int64()), ("in_block", pa.int32()), ("n_ids", pa.int64())]
)


def _both(blocks: list[dict], entries: list[pa.Array] | None) -> pa.RecordBatch:
    """Rows that hold either a block or an index entry."""
    n = len(entries[0]) if entries is not None else 0
    left = pa.array([*blocks, *[None] * n], _BLOCK_TYPE)
    if n:
        right = pa.StructArray.from_arrays(entries, fields=list(_ENTRY_TYPE))
        right = pa.concat_arrays([pa.nulls(len(blocks), _ENTRY_TYPE), right])
    else:
        right = pa.nulls(len(blocks), _ENTRY_TYPE)
    return pa.RecordBatch.from_arrays([left, right], names=["b", "e"])


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32`` of every document, from the files.

    Blocks are unpacked where they lie; each yields the checksums of the documents' parts in it, and
    the parts of a document are put together by its index entry.
    """
    records = spark.read.schema(RECORDS).parquet(folder)
    blocks = records.where("b is not null")
    sizes = blocks.groupBy("b.shard").agg(F.sum("b.n_ids").cast("long").alias("n"))
    # One row per shard; a shard is a fixed amount of text.
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    bases = sizes.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # Each block is followed by the entries that begin in it; a shard is a bounded amount of text.
    flow = records.select(
        F.coalesce("b.shard", "e.shard").alias("shard"),
        F.coalesce("b.block", "e.block").alias("block"),
        F.when(F.col("b").isNotNull(), 0).otherwise(1).alias("kind"),
        F.coalesce(F.col("b.n_ids").cast("long"), "e.n_ids").alias("n"),
        "b.planes",
        "e.entry",
        "e.doc_id",
    )
    flow = flow.repartition("shard").sortWithinPartitions("shard", "block", "kind", "entry")
    schema = "shard int, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _ShardReader()
        for batch in batches:
            yield reader.take(batch)

    found = flow.mapInArrow(run, schema)
    return found.join(bases, "shard").select(
        "doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )


class _ShardReader:
    """Checksums of documents from blocks and index entries in order, holding one block."""

    def __init__(self) -> None:
        self.shard: int | None = None
        self.at = 0
        self.open: list[list] = []

    def take(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        shard, kind, n, planes, entry, doc = (batch.column(batch.schema.names.index(c)).to_pylist() for c in ("shard", "kind", "n", "planes", "entry", "doc_id"))
        for i in range(batch.num_rows):
            if shard[i] != self.shard:
                self.shard, self.at, self.data, self.given = shard[i], 0, b"", 0
                self.left, self.crc, self.doc, self.begin, self.size = 0, 0, None, 0, 0
            if kind[i] == 0:
                self.data, self.given = from_planes(planes[i], n[i]).tobytes(), 0
                if self.left:
                    self._feed(out)
            else:
                self.doc, self.size, self.left, self.crc, self.begin = doc[i], n[i], n[i], 0, self.at
                self._feed(out)
        columns = list(zip(*out, strict=True)) if out else [[], [], [], [], []]
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
            names=["shard", "doc_id", "at", "n_tokens", "ids_crc32"],
        )

    def _feed(self, out: list[tuple]) -> None:
        part = self.data[self.given : self.given + 4 * self.left]
        self.crc = zlib.crc32(part, self.crc)
        self.given += len(part)
        self.left -= len(part) // 4
        self.at += len(part) // 4
        if not self.left:
            out.append((self.shard, self.doc, self.begin, self.size, self.crc))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents' ids as byte planes and return what the files hold."""
    folder = scratch_path(spark, "ids")
    write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, default_tokenizer())
    return read_documents(spark, folder)
