"""Token ids in fixed-width bit-packed blocks, in ascending id order.

Format.  A file set is a table of blocks (part, block, n_docs, n_ids, bytes); the bytes
of a block stand on their own:

    4 bytes  magic QSID
    u32      bits per id
    u32      documents
    u64      ids
    u64 x (documents + 1)   offset of each document's first id, in ids
    payload  ids of ``bits`` bits each, lowest bit first, padded to whole bytes

The width is the fewest bits that hold the vocabulary.  Offsets make any document of
a block readable on its own, vectorised (``read_doc``); the index (all columns but bytes)
leads to the block.  Blocks lie in Parquet, so any store that Spark reaches will do.

Encoding caches the ids of words within a worker, in a bounded cache.

Null texts are empty: their end id alone.  Ids may be of any sortable type; null ids come first,
repeated ids in the order read.  Texts of any length stay whole; blocks are bounded in ids and in
documents.  An empty table gives no block.  Only the id and the text column are read.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise
from .ordered import cuts, in_order, lowest, with_row_numbers

MAGIC = b"QSID"
#: Rust's \s lacks these, Python's split() has them.
ODD = "\x1c\x1d\x1e\x1f"


def bit_width(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits < 32 and len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"the id {int(ids.max())} doesn't fit {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    cells = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(cells, bitorder="little").tobytes()


def unpack(payload: bytes, bits: int, first: int, count: int) -> np.ndarray:
    """count ids from the first-th on; reads only their bytes."""
    lo, hi = first * bits, (first + count) * bits
    raw = np.frombuffer(payload, np.uint8)[lo // 8 : -(-hi // 8)]
    if bits in (8, 16, 32):
        return raw.view(f"<u{bits // 8}").astype("<u4")
    cells = np.unpackbits(raw, bitorder="little")[lo % 8 : lo % 8 + count * bits].reshape(count, bits)
    wide = np.zeros((count, 32), np.uint8)
    wide[:, :bits] = cells
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()


def write_block(docs: list[np.ndarray], bits: int) -> bytes:
    return joined_block([pack(d, bits) for d in docs], [len(d) for d in docs], bits)


def joined_block(packed: list[bytes], lens: list[int], bits: int) -> bytes:
    """A block of documents that are packed already, each from a whole byte on."""
    offsets = np.concatenate(([0], np.cumsum(lens, dtype=np.int64))).astype("<u8")
    head = MAGIC + np.array([bits, len(lens)], "<u4").tobytes() + offsets[-1:].tobytes()
    payload = b"".join(packed) if bits % 8 == 0 else pack(np.concatenate([np.empty(0, "<u4"), *[unpack(p, bits, 0, n) for p, n in zip(packed, lens)]]), bits)
    return head + offsets.tobytes() + payload


def block_offsets(block: bytes) -> tuple[int, np.ndarray, int]:
    """Bits, document offsets and where the payload starts."""
    if block[:4] != MAGIC:
        raise ValueError("not a block of token ids")
    bits, n = np.frombuffer(block, "<u4", 2, 4).tolist()
    return bits, np.frombuffer(block, "<u8", n + 1, 20).astype(np.int64), 20 + 8 * (n + 1)


def read_doc(block: bytes, k: int) -> np.ndarray:
    """Random access: the ids of the k-th document."""
    bits, offsets, at = block_offsets(block)
    return unpack(memoryview(block)[at:], bits, int(offsets[k]), int(offsets[k + 1] - offsets[k]))


@functools.lru_cache(maxsize=2)
def _worker(path: str) -> "_Encoder":
    return _Encoder(path)


class _Encoder(dict):
    """A run of text without white space -> its ids as bytes, exactly as the library encodes it.

    Plain Latin text goes straight to the model, with the file's own normaliser, split
    pattern and byte alphabet applied here; whatever else goes through the whole library.
    """

    def __init__(self, path: str, room: int = 400_000):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.lib, self.room = Tokenizer.from_file(path), room
        pre = spec["pre_tokenizer"]["pretokenizers"] if (spec.get("pre_tokenizer") or {}).get("type") == "Sequence" else []
        norm = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.direct = norm == ["NFC", "Replace", "Lowercase"] and [p["type"] for p in pre] == ["Split", "ByteLevel"] and pre[0]["invert"] and not pre[1]["add_prefix_space"] and not pre[1]["use_regex"]
        self.find = regex.compile(pre[0]["pattern"]["Regex"]).findall if self.direct else None
        self.model, self.words = self.lib.model, {}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        self.alphabet = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in shown)}

    def __missing__(self, piece: str) -> bytes:
        if not self.direct or not piece.isascii() and max(piece) > "ɏ" or "<|" in piece:
            ids = np.array(self.lib.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()
        else:
            low = piece.lower()
            ids = b"".join([self.words.get(w) or self._word(w) for w in ([low] if low.isalpha() else self.find(low))])
        if len(piece) <= 64:
            if len(self) >= self.room:
                self.clear()
            self[piece] = ids
        return ids

    def _word(self, word: str) -> bytes:
        shown = word if word.isascii() and word.isprintable() else "".join(map(self.alphabet.__getitem__, word.encode()))
        ids = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(shown)])
        if len(word) <= 64:
            if len(self.words) >= self.room:
                self.words.clear()
            self.words[word] = ids
        return ids

    def text(self, text: str) -> bytes:
        if any(c in text for c in ODD):
            return np.array(self.lib.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.__getitem__, text.split()))


def vocabulary_of(path: str, *more: int) -> int:
    """One more than the greatest id of the tokenizer file and of the ids more."""
    from tokenizers import Tokenizer

    return 1 + max([*Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values(), *more])


def write_token_files(docs: DataFrame, path: str, end_id: int = 2, vocabulary: int | None = None, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None, block_ids: int = 1 << 20, block_docs: int = 1 << 16) -> DataFrame:
    """Encode, order and pack; returns the table of blocks as written and read back.  vocabulary: that of the file, unless given."""
    bits = bit_width(vocabulary or vocabulary_of(path, end_id))
    src = with_row_numbers(docs, id_col, text_col)
    kind = src.schema["id"].dataType.simpleString()
    arrow_id = src.select("id").limit(0).toArrow().schema.field(0).type
    where = cuts(src, lowest(src), parts)
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _worker(path)
        for b in batches:
            coded = [np.frombuffer(enc.text(t.as_py() or "") + end, "<u4") for t in b.column("text")]
            n, packed = [len(c) for c in coded], [pack(c, bits) for c in coded]
            yield pa.RecordBatch.from_arrays([pa.array(where.place(b.column("id"), b.column("rid"))[0]), b.column("id"), b.column("rid"), pa.array(n, pa.int64()), pa.array(packed, pa.binary())], names=["part", "id", "rid", "n", "packed"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, lens, ids, total, part, seq = [], [], [], 0, None, 0

        def flush():
            data = joined_block(held, lens, bits)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([seq], pa.int64()), pa.array([ids], pa.list_(arrow_id)), pa.array([len(held)], pa.int64()), pa.array([total], pa.int64()), pa.array([data], pa.binary())], names=["part", "block", "ids", "n_docs", "n_ids", "bytes"])

        for b in batches:
            for p, i, n, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), b.column(4)):
                if held and (p != part or total >= block_ids or len(held) >= block_docs):
                    yield flush()
                    seq = seq + 1 if p == part else 0
                    held, lens, ids, total = [], [], [], 0
                elif p != part:
                    seq = 0
                part = p
                held.append(packed.as_py())
                lens.append(n)
                ids.append(i)
                total += n
        if held:
            yield flush()

    coded = src.mapInArrow(encode, f"part bigint, id {kind}, rid bigint, n bigint, packed binary")
    made = in_order(coded, where.parts, "id", "rid").mapInArrow(blocks, f"part bigint, block bigint, ids array<{kind}>, n_docs bigint, n_ids bigint, bytes binary")
    return materialise(made, "tokens")


def read_token_files(files: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document from the blocks: id, start, n_tokens, ids_crc32 (of its ids as little-endian 32-bit).

    Only the small rows of documents meet the blocks' starts; the blocks themselves are not shuffled.
    """
    index = files.groupBy("part").agg(F.sum("n_ids").alias("part_ids"))
    before = F.coalesce(F.sum("part_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = index.select(F.col("part").alias("p"), before.alias("part_start"))  # a row for each part only
    inner = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = files.select("part", "block", inner.alias("block_start")).join(parts, F.col("part") == F.col("p")).select("part", "block", (F.col("part_start") + F.col("block_start")).alias("first"))
    kind = files.schema["ids"].dataType.elementType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, seq, ids, block in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
                data = block.as_py()
                bits, offsets, at = block_offsets(data)
                raw = unpack(memoryview(data)[at:], bits, 0, int(offsets[-1])).astype("<u4")
                crc = [zlib.crc32(raw[i:j]) for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                n = len(crc)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part)), pa.array(np.full(n, seq)), ids.values, pa.array(offsets[:-1]), pa.array(np.diff(offsets)), pa.array(crc, pa.int64())], names=["part", "block", id_col, "offset", "n_tokens", "ids_crc32"])

    found = files.select("part", "block", "ids", "bytes").mapInArrow(read, f"part bigint, block bigint, `{id_col}` {kind}, offset bigint, n_tokens bigint, ids_crc32 bigint")
    return found.join(starts, ["part", "block"]).select(id_col, (F.col("first") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
