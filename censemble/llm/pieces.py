"""SentencePiece encoding with byte offsets, and decoding, over a BPE model file with byte fallback.

Encoding normalises each text by longest prefixes of the model's compiled character map and keeps,
for every normalised byte, the byte of the source it comes from. The normalised text is cut between
neighbours that no piece of the vocabulary holds side by side, such as a letter and a space, so
merges never cross these cuts. Equal cuts of a batch are encoded once, and every piece is projected
back to the bytes of the source.

The model file is read from a path that every executor has; it is never copied.

Defined results: a null or empty text has no pieces and decodes to an empty text; repeated rows are
encoded one by one; an empty table gives no rows. Extra columns of the input are never read.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from censemble.llm.quality import fresh
from censemble.llm.flat import CUT_BYTES, Cache, flat, sliced

META = "▁"
NORMAL, UNKNOWN, CONTROL, USER, BYTE, UNUSED = 1, 2, 3, 4, 6, 5
# Cuts whose pieces a task keeps at hand; beyond it the table starts anew.
CACHED_CUTS = 300_000
SHORT = 40
# Rows that are decoded at once.
DECODED_ROWS = 256


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and raw values of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 2: None, 5: 4}[key & 7]
            size = varint() if size is None else size
            yield key >> 3, data[at : at + size]
            at += size


class CharacterMap:
    """The compiled normalisation map: a double-array trie over UTF-8 bytes and its replacements."""

    def __init__(self, blob: bytes) -> None:
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if blob else ()
        self.texts = blob[4 + size :]

    def longest(self, text: bytes, begin: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest key that begins there."""
        if not self.units:
            return None

        def offset(unit: int) -> int:
            return (unit >> 10) << ((unit & 512) >> 6)

        found = None
        node = offset(self.units[0])
        for i in range(begin, len(text)):
            node ^= text[i]
            if node >= len(self.units) or self.units[node] & 0x800000FF != text[i]:
                break
            unit = self.units[node]
            node ^= offset(unit)
            if unit >> 8 & 1:
                found = (i + 1 - begin, self.units[node] & 0x7FFFFFFF)
        if found is None:
            return None
        end = self.texts.index(b"\0", found[1])
        return found[0], self.texts[found[1] : end]


class Model:
    """Vocabulary, merge scores and normaliser of a model file."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as file:
            data = file.read()
        pieces, normal = [], {}
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
                pieces.append((piece[1].decode(), score, piece.get(3, NORMAL)))
            elif number == 3:
                normal = dict(_fields(value))
        self.map = CharacterMap(normal.get(2, b""))
        self.dummy_prefix = bool(normal.get(3, 1))
        self.squeeze = bool(normal.get(4, 1))
        if not normal.get(5, 1):
            raise ValueError("models that do not escape white space are not supported")
        scores: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.byte_ids = [0] * 256
        self.surface: list[bytes] = []
        for i, (piece, score, kind) in enumerate(pieces):
            plain = piece.replace(META, " ")
            if kind in (NORMAL, USER, UNUSED):
                if kind != NORMAL:
                    raise ValueError("user-defined and unused pieces are not supported")
                scores[plain], self.ids[plain] = score, i
            if kind == BYTE:
                self.byte_ids[int(piece[3:5], 16)] = i
            self.surface.append(
                bytes([int(piece[3:5], 16)]) if kind == BYTE
                else b"" if kind == CONTROL
                else " ⁇ ".encode() if kind == UNKNOWN
                else plain.encode()
            )
        if not all(self.byte_ids):
            raise ValueError("models without byte fallback are not supported")
        # Equal scores share a rank, so that the leftmost pair goes first among them.
        order = {x: i for i, x in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = {piece: order[x] for piece, x in scores.items()}
        self.sizes = np.array([len(x) for x in self.surface], dtype=np.int64)
        # Pairs of bytes that stand side by side in a piece.
        self.joined = np.zeros((256, 256), dtype=bool)
        for piece in scores:
            data = np.frombuffer(piece.encode(), dtype=np.uint8)
            self.joined[data[:-1], data[1:]] = True
        # A character is never cut, whether the vocabulary has it or not.
        self.joined[:, 0x80:0xC0] = True
        self.cache = Cache(self._merge_new, CACHED_CUTS)

    def identity(self) -> bool:
        return not self.map.units and not self.squeeze

    def normalise(self, text: str) -> tuple[bytes, list[int]]:
        """Normalised bytes with plain spaces, and the source byte of each (and of the end)."""
        data = text.encode()
        out, source = bytearray(), []
        at = 0
        while at < len(data):
            found = self.map.longest(data, at)
            if found is None:
                lead = data[at]
                size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                found = (size, data[at : at + size])
            put = found[1].replace(META.encode(), b" ")
            if self.squeeze and put.startswith(b" ") and (not out or out.endswith(b" ")):
                put = put.lstrip(b" ")
            # A character that is copied keeps its bytes apart; a replacement stands for its whole key.
            copied = put == data[at : at + found[0]]
            source += [at + (i if copied else 0) for i in range(len(put))]
            out += put
            at += found[0]
        end = len(data)
        if self.squeeze:
            while out.endswith(b" "):
                out.pop()
                end = source.pop()
        if self.dummy_prefix and out:
            out = bytearray(b" ") + out
            source = [source[0], *source]
        return bytes(out), [*source, end]

    def _merge_new(self, cuts: list[bytes]) -> list[bytes]:
        """Ids of cuts, as 32-bit numbers."""
        out = []
        known, array = self.ids, np.array
        for cut in cuts:
            symbols = list(cut.decode())
            symbols = self._short(symbols) if len(symbols) <= SHORT else self._long(symbols)
            try:
                ids = [known[s] for s in symbols]
            except KeyError:
                each = ([known[s]] if s in known else [self.byte_ids[b] for b in s.encode()] for s in symbols)
                ids = list(chain.from_iterable(each))
            out.append(array(ids, np.int32).tobytes())
        return out

    def _short(self, symbols: list[str]) -> list[str]:
        """Merge the best neighbours, the leftmost of equals, until none is left."""
        rank, none = self.rank.get, len(self.rank)
        ranks = [rank(a + b, none) for a, b in zip(symbols, symbols[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            at = ranks.index(best)
            both = symbols[at] + symbols[at + 1]
            symbols[at : at + 2] = [both]
            del ranks[at]
            if at:
                ranks[at - 1] = rank(symbols[at - 1] + both, none)
            if at < len(ranks):
                ranks[at] = rank(both + symbols[at + 1], none)
        return symbols

    def _long(self, symbols: list[str]) -> list[str]:
        """The same merges with a queue, for long runs without spaces."""
        n = len(symbols)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        queue: list[tuple[float, int, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and right[i] < n:
                both = symbols[i] + symbols[right[i]]
                r = self.rank.get(both)
                if r is not None:
                    heapq.heappush(queue, (r, i, right[i], both))

        for i in range(n - 1):
            offer(i)
        while queue:
            _, i, j, both = heapq.heappop(queue)
            if not symbols[i] or right[i] != j or symbols[i] + symbols[j] != both:
                continue
            symbols[i], symbols[j] = both, ""
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            offer(left[i])
            offer(i)
        return [s for s in symbols if s]

    def encode(self, texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
        """Lists of ids, and of the begin and end byte of each piece in the source."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        sources = None
        if self.identity():
            normal = pc.replace_substring(texts, META, " ") if pc.any(pc.match_substring(texts, META)).as_py() else texts
            if self.dummy_prefix:
                space, none = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
                normal = pc.if_else(pc.equal(normal, none), none, pc.binary_join_element_wise(space, normal, none))
        else:
            both = [self.normalise(t) for t in texts.to_pylist()]
            normal = pa.array([b for b, _ in both], pa.large_binary())
            sources = [np.array(s, dtype=np.int64) for _, s in both]
        buffer, at = flat(normal)
        if not len(buffer):
            none = pa.array([[]] * len(texts), pa.list_(pa.int32()))
            return none, none, none
        cut = np.zeros(len(buffer) + 1, dtype=bool)
        cut[1:-1] = ~self.joined[buffer[:-1], buffer[1:]]
        cut[at] = True
        cut[-1] = False
        begins = np.flatnonzero(cut)
        edges = np.append(begins, len(buffer)).astype(np.int64)
        cuts = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(begins), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(buffer))]
        ).dictionary_encode()
        merged = self.cache.look_up(cuts.dictionary.to_pylist())
        which = cuts.indices.to_numpy()
        counts = np.array([len(m) for m in merged], dtype=np.int64) // 4
        offsets = np.concatenate([[0], np.cumsum(counts)])
        all_ids = np.frombuffer(b"".join(merged), np.int32)
        n = counts[which]
        total = np.concatenate([[0], np.cumsum(n)])
        gather = np.arange(total[-1]) + np.repeat(offsets[which] - total[:-1], n)
        ids = all_ids[gather]
        sizes = self.sizes[ids]
        # Pieces lie end to end, so running sums give their place in the normalised buffer.
        after = np.cumsum(sizes, dtype=np.int64)
        # A text's cuts begin where the text does.
        bounds = total[np.searchsorted(begins, at)].astype(np.int32)
        per_text = np.diff(bounds)
        base = np.repeat(at[:-1], per_text)
        begin, end = after - sizes - base, after - base
        if sources is None:
            # The dummy prefix has no width; a space sign of the source took three bytes there.
            shift = int(self.dummy_prefix)
            begin, end = np.maximum(begin - shift, 0), end - shift
            if normal is not texts and pc.any(pc.match_substring(texts, META)).as_py():
                begin, end = _widened(texts, bounds, begin, end)
        else:
            table = np.concatenate(sources) if sources else np.zeros(0, np.int64)
            rows = np.concatenate([[0], np.cumsum([len(s) for s in sources])])[:-1]
            begin, end = table[np.repeat(rows, per_text) + begin], table[np.repeat(rows, per_text) + end]
        lists = [
            pa.ListArray.from_arrays(pa.array(bounds), pa.array(x.astype(np.int32))) for x in (ids, begin, end)
        ]
        return lists[0], lists[1], lists[2]

    def decode(self, ids: pa.Array) -> pa.Array:
        """Texts of lists of ids; bytes that are no UTF-8 become U+FFFD one by one."""
        ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
        pieces = pa.array(self.surface, pa.large_binary()).take(ids.flatten())
        buffer, at = flat(pieces)
        bounds = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy())]).astype(np.int64)
        data = buffer.tobytes()
        out = []
        for b, e in zip(at[bounds[:-1]], at[bounds[1:]], strict=True):
            text = data[b:e]
            if self.dummy_prefix and text.startswith(b" "):
                text = text[1:]
            try:
                out.append(text.decode())
            except UnicodeDecodeError:
                out.append(_lossy(text))
        return pa.array(out, pa.string())


def _lossy(data: bytes) -> str:
    out, at = [], 0
    while at < len(data):
        try:
            out.append(data[at:].decode())
            break
        except UnicodeDecodeError as bad:
            out.append(data[at : at + bad.start].decode() + "�")
            at += bad.start + 1
    return "".join(out)


def _widened(texts: pa.Array, bounds: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets as if each space sign of a source had been one byte, turned into real ones."""
    begin, end = begin.copy(), end.copy()
    for i, text in enumerate(texts.to_pylist()):
        if META in text:
            width = np.array([3 if c == META else len(c.encode()) for c in text])
            short = np.array([1 if c == META else len(c.encode()) for c in text])
            real = np.concatenate([[0], np.cumsum(width)])
            seen = np.concatenate([[0], np.cumsum(short)])
            part = slice(bounds[i], bounds[i + 1])
            for x in (begin, end):
                k = np.searchsorted(seen, x[part], side="right") - 1
                x[part] = real[k] + (x[part] - seen[k])
    return begin, end


@lru_cache(maxsize=4)
def model(path: str) -> Model:
    return Model(path)


def encode_pieces(
    docs: DataFrame, path: str, keys: tuple[str, ...] = ("doc_id",), text: str = "text", decoded: bool = False
) -> DataFrame:
    """``keys`` with ``ids``, ``begins`` and ``ends``: pieces and their byte spans in the text.

    ``decoded`` adds what the ids decode to, in the same pass: the ids need not come back to Python.
    """
    whole_text = fresh(docs, "whole_text")
    rows = docs.select(*keys, F.col(text).alias(whole_text))
    added = [StructField(name, ArrayType(IntegerType())) for name in ("ids", "begins", "ends")]
    if decoded:
        added.append(StructField("decoded", StringType()))
    names = [*keys, *[f.name for f in added]]
    schema = StructType([*rows.drop(whole_text).schema.fields, *added])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = model(path)
        for whole in batches:
            for batch in sliced(whole, whole_text, CUT_BYTES):
                lists = coder.encode(batch.column(whole_text))
                text_again = [coder.decode(lists[0])] if decoded else []
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *lists, *text_again], names=names)
        # The process lives on for other stages; the table would fill its memory.
        coder.cache.clear()

    return rows.mapInArrow(run, schema)


def decode_pieces(coded: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the decoded text of each list of ids; a null list decodes to an empty text."""
    if out in coded.columns:
        raise ValueError(f"{out} is a column already")
    schema = StructType([*coded.schema.fields, StructField(out, StringType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = model(path)
        for whole in batches:
            for begin in range(0, whole.num_rows, DECODED_ROWS):
                batch = whole.slice(begin, DECODED_ROWS)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, coder.decode(batch.column(batch.schema.names.index(ids)))],
                    names=[*batch.schema.names, out],
                )

    return coded.mapInArrow(run, schema)


def digest(ids: Column) -> Column:
    """Hex SHA-256 of the decimal ids joined by commas."""
    return F.sha2(F.array_join(ids.cast("array<string>"), ","), 256)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece count and digests of ids and decoded text of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = default_model()
    return encode_pieces(docs, path, decoded=True).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        digest(F.col("ids")).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
        F.coalesce(F.get("ends", F.size("ends") - 1), F.lit(0)).cast("long").alias("n_bytes"),
    )
