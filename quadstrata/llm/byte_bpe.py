"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

A word is a match of the split pattern.  The texts of a partition are cut into blocks, read
once: a block is its distinct words and its positions (one code per word of the text, in
order), and is exchanged once, by block.  From that exchange its distinct words go out as
plain rows (block, code, word), one hash exchange by word; sorted by word, each distinct word
of the corpus is encoded once, and its ids go back to the blocks that have it, where the
documents are put together again by position.  So rows grow with the distinct words of blocks,
a word's repeats are never shuffled, and one found in every document is one row per block.
Decoding joins the ids with the token-byte table of the ranks, in the worker, since that table
has the size of the vocabulary whatever the corpus.

Null texts are empty texts; they have no ids.  Null ids are kept; repeated rows have a row each.
Texts of any length stay whole, as one block if need be; a block is bounded in characters and in
rows.  An empty table gives no row.  Only the id and the text column are read.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions

#: White space as the split pattern's \s has it (Python's \s has four control characters more).
SPACE = " \t\n\x0b\x0c\r\x85\xa0  -     　"
PIECE = f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})


@functools.lru_cache(maxsize=4)
def token_bytes(path: str) -> list[bytes]:
    ranks = load_ranks(path)
    table = [b""] * (max(ranks.values()) + 1)
    for token, k in ranks.items():
        table[k] = token
    return table


Ranges = tuple[tuple[int, int, str], ...]


@functools.lru_cache(maxsize=1)
def stand_ins() -> Ranges:
    """Ranges of code points (end exclusive) whose class differs between the regex module and tiktoken's engine, as their Unicode versions do, each with a character of the class that tiktoken sees.

    Found by asking both: an encoding with one token a byte returns just what its pattern matches.  Covers \\p{L} and
    \\p{N}, the only versioned classes of the split pattern.
    """
    import regex
    import tiktoken

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    byte = {bytes([k]): k for k in range(256)}
    theirs = {p: set(bytes(tiktoken.Encoding("class", pat_str=p, mergeable_ranks=byte, special_tokens={}).encode_ordinary(every)).decode()) for p in (r"\p{L}", r"\p{N}")}
    odd = set().union(*(theirs[p] ^ set(regex.findall(p, every)) for p in theirs))
    found: list[tuple[int, int, str]] = []
    for c in sorted(odd):
        s = "a" if c in theirs[r"\p{L}"] else "0" if c in theirs[r"\p{N}"] else "!"
        if found and found[-1][1:] == (ord(c), s):
            found[-1] = (found[-1][0], ord(c) + 1, s)
        else:
            found.append((ord(c), ord(c) + 1, s))
    return tuple(found)


@functools.lru_cache(maxsize=1)
def _translation(odd: Ranges) -> dict[int, str]:
    return {c: s for a, b, s in odd for c in range(a, b)}


class _Words(dict):
    """word -> code, in order of first occurrence."""

    def __missing__(self, word: str) -> int:
        self[word] = code = len(self)
        return code


class _Pieces(dict):
    """A piece of text (white space, then the rest up to the next) -> its words' codes as bytes; no match of the pattern spans two pieces."""

    def __init__(self, pattern: str, odd: Ranges = ()):
        import regex

        compiled = regex.compile(pattern)
        self.find, self.spans, self.words = compiled.findall, compiled.finditer, _Words()
        self.odd, self.first_odd = _translation(odd), chr(odd[0][0]) if odd else chr(0x10FFFF)

    def __missing__(self, piece: str) -> bytes:
        if not piece.isascii() and max(piece) >= self.first_odd and any(ord(c) in self.odd for c in piece):
            found = [piece[m.start() : m.end()] for m in self.spans(piece.translate(self.odd))]
        else:
            found = self.find(piece)
        codes = np.array([self.words[w] for w in found], dtype="<u4").tobytes()
        if len(piece) <= 64:
            self[piece] = codes
        return codes


class _Block:
    """Some documents, their words and one code per word."""

    def __init__(self, pattern: str, odd: Ranges = ()):
        import re

        self.pieces, self.cut = _Pieces(pattern, odd), re.compile(PIECE).findall
        self.ids: list = []
        self.codes: list[bytes] = []
        self.chars = 0

    def add(self, doc_id, text: str | None) -> None:
        text = text or ""
        self.ids.append(doc_id)
        self.codes.append(b"".join(map(self.pieces.__getitem__, self.cut(text))))
        self.chars += len(text)

    def packed(self) -> tuple[list[str], list[int], bytes]:
        """Distinct words, commonest first; words by document; every word's code in order, as packed bytes."""
        import zstandard

        codes = np.frombuffer(b"".join(self.codes), "<u4")
        words = list(self.pieces.words)
        order = np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")
        final = np.empty(len(words), "<u4")
        final[order] = np.arange(len(words), dtype="<u4")  # small codes for common words: they compress
        return [words[k] for k in order.tolist()], [len(c) // 4 for c in self.codes], zstandard.compress(planes(final[codes]), 1)


#: What a document costs beside its characters.
ROW_CHARS = 256


def planes(x: np.ndarray) -> bytes:
    """32-bit numbers with bytes of equal weight together, so that they compress, here or in the exchange."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _blocks(batches: Iterator[pa.RecordBatch], pattern: str, odd: Ranges, block_chars: int) -> Iterator[tuple[int, _Block]]:
    from pyspark import TaskContext

    base, seq, block = TaskContext.get().partitionId() << 24, 0, None
    for b in batches:
        for doc_id, text in zip(b.column(0), b.column(1)):
            block = block or _Block(pattern, odd)
            block.add(doc_id.as_py(), text.as_py())
            if block.chars + ROW_CHARS * len(block.ids) >= block_chars:
                yield base + seq, block
                seq, block = seq + 1, None
    if block:
        yield base + seq, block


def byte_bpe(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", block_chars: int = 1 << 25, keep_ids: bool = False, batch_words: int = 1 << 16, answer_words: int = 1 << 19) -> DataFrame:
    """One row per input row: id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids."""
    import zstandard

    src = docs.select(id_col, text_col)
    kind = src.schema[id_col].dataType.simpleString()
    arrow_id = src.limit(0).toArrow().schema.field(0).type
    odd = stand_ins()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, block in _blocks(batches, pattern, odd, block_chars):
            words, n, codes = block.packed()
            raw = [w.encode() for w in words]
            lens = np.fromiter(map(len, raw), "<u4", len(raw)).tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array([key], pa.int64()), pa.array([block.ids], pa.list_(arrow_id)), pa.array([n], pa.list_(pa.int64())), *[pa.array([c], pa.binary()) for c in (codes, zstandard.compress(lens, 1), zstandard.compress(b"".join(raw), 1))]],
                names=["block", "ids", "n", "codes", "lens", "words"],
            )

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """block, code, word."""
        unzip = zstandard.ZstdDecompressor().decompress
        for b in batches:
            for key, lens, words in zip(b.column("block").to_pylist(), b.column("lens"), b.column("words")):
                lens = np.frombuffer(unzip(lens.as_py()), "<u4")
                ends = np.concatenate(([0], np.cumsum(lens))).astype("<i4")
                every = pa.Array.from_buffers(pa.string(), len(lens), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(unzip(words.as_py()))])
                for k in range(0, len(lens), batch_words):
                    part = every.slice(k, batch_words)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), key)), pa.array(np.arange(k, k + len(part), dtype=np.int32)), part], names=["block", "code", "word"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Equal words follow each other: each is encoded once.  Answers go out together by block, after every answer_words of them."""
        enc = encoding(path, pattern)
        single, wide, last, ids = enc._core_bpe.encode_single_piece, "<u2" if enc.n_vocab <= 1 << 16 else "<u4", None, b""
        block, code, out = [], [], []

        def flush() -> pa.RecordBatch:
            owner, codes = np.concatenate(block), np.concatenate(code)
            order = np.lexsort((codes, owner))
            owner, codes = owner[order], codes[order]
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            rows = []
            for i, j in zip(first.tolist(), [*first[1:].tolist(), len(owner)]):
                own = [out[k] for k in order[i:j].tolist()]
                rows.append((planes(np.diff(codes[i:j], prepend=0)), planes(np.fromiter(map(len, own), np.int64, j - i) // int(wide[2])), np.frombuffer(b"".join(own), wide).astype("<u4")))
            return pa.RecordBatch.from_arrays([pa.array(owner[first]), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary()), pa.array([planes(r[2]) for r in rows], pa.binary())], names=["block", "codes", "lens", "tokens"])

        for b in batches:
            for w in b.column("word").to_pylist():
                if w != last:
                    last, ids = w, np.array(single(w.encode()), wide).tobytes()
                out.append(ids)
            block.append(b.column("block").to_numpy())
            code.append(b.column("code").to_numpy())
            if len(out) >= answer_words:
                yield flush()
                block, code, out = [], [], []
        if out:
            yield flush()

    fields = f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 4 + keep_ids]

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        codes = from_planes(zstandard.ZstdDecompressor().decompress(left.column("codes")[0].as_py()))
        got = {k: [from_planes(v.as_py()) for v in right.column(k)] for k in ("codes", "lens", "tokens")}
        order = np.argsort(np.concatenate([np.empty(0, np.int64), *map(np.cumsum, got["codes"])]))
        if len(codes) and int(codes.max()) + 1 != len(order):
            raise RuntimeError("a block's words aren't all encoded")
        lens, tokens = (np.concatenate([np.empty(0, np.uint32), *got[k]]) for k in ("lens", "tokens"))
        ends = np.cumsum(lens, dtype=np.int64)[order]
        lens = lens[order].astype(np.int64)
        starts = ends - lens
        table, as_list = token_bytes(path), tokens.tolist()
        digits, decoded = [], []
        for i, j in zip(starts.tolist(), ends.tolist()):
            own = as_list[i:j]
            digits.append(" ".join(map(str, own)).encode())
            decoded.append(b"".join([table[k] for k in own]))
        cut = np.concatenate(([0], np.cumsum(np.array(left.column("n")[0].as_py(), np.int64))))
        n_tokens, sha_ids, sha_text, ids = [], [], [], []
        for i, j in zip(cut[:-1].tolist(), cut[1:].tolist()):
            own = codes[i:j]
            listed = own.tolist()
            n_tokens.append(int(lens[own].sum()))
            sha_ids.append(hashlib.sha256(b" ".join(map(digits.__getitem__, listed))).hexdigest())
            sha_text.append(hashlib.sha256(b"".join(map(decoded.__getitem__, listed))).hexdigest())
            if keep_ids:
                ids.append(np.concatenate([tokens[starts[c] : ends[c]] for c in listed]).astype(np.int32) if listed else np.empty(0, np.int32))
        doc_ids = left.column("ids").combine_chunks().flatten()
        cols = [doc_ids, pa.array(n_tokens, pa.int64()), pa.array(sha_ids, pa.string()), pa.array(sha_text, pa.string())]
        return pa.table(cols + [pa.array(ids, pa.list_(pa.int32()))] * keep_ids, names=names)

    parts = max(partitions(src), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    blocks = src.mapInArrow(read, f"block bigint, ids array<{kind}>, n array<bigint>, codes binary, lens binary, words binary").repartition(parts, "block")
    # both uses of blocks take all its columns, so that they share one exchange
    words = blocks.mapInArrow(distinct, "block bigint, code int, word string").repartition(parts, "word").sortWithinPartitions("word")
    answers = words.mapInArrow(encode, "block bigint, codes binary, lens binary, tokens binary")
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(assemble, fields)
