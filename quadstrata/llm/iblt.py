"""Document fingerprints: invertible Bloom lookup sketches of paragraphs and their pieces.

A text's paragraphs are its lines.  Each gives a digest, and each longer than ``piece_words``
words also the digests of its pieces of so many words, so that a change inside a long paragraph,
or a one-line text, shows as a change of part.  A digest is a hash of the bytes and of how often
they came before in the text, so repeats count.  A sketch has cells in three equal parts; each
digest is added to one cell of each part: a count, the xor of digests and the xor of check hashes.
Two sketches subtract cell by cell, then peeling recovers the digests that only one side
has: a cell with one digest left gives it away and it is taken out of its other cells.
Where peeling gets stuck, the pair is tried again with sketches four times as large,
built anew from the digests, until it succeeds.  Likeness is shared over all digests.

All pairs of a batch, bounded in characters and rows, are sketched and peeled together, in array
operations.

Empty texts have an empty sketch and are alike; null texts count as empty.  Ids may be of any
sortable type; null ids come first, repeated ids in the order read.  Texts of any length stay whole.
An empty table gives no row; the next of a single row is itself.  Only the id and the text column
are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .ordered import cuts, in_order, lowest, with_row_numbers

BASE_CELLS = 24
GROWTH = 4
#: A sketch with so many cells for each digest peels, if any does.
ROOM = 64
#: What a document costs beside its characters.
ROW_CHARS = 512


def piece_digests(text: str, piece_words: int = 5) -> np.ndarray:
    """Digests of the paragraphs and of the pieces of long ones; each once."""
    import xxhash

    digest, pieces, whole = xxhash.xxh64_intdigest, [], []
    for line in text.encode("utf-8", "surrogatepass").split(b"\n"):
        words = line.split(b" ")
        if len(words) <= piece_words:
            if line:
                pieces.append(line)
        else:
            whole.append(line)
            pieces += [b" ".join(words[k : k + piece_words]) for k in range(0, len(words), piece_words)]
    out = []
    for units, kind in ((pieces, 0), (whole, 1)):
        if len(set(units)) == len(units):
            out += [digest(u, kind) for u in units]
        else:
            seen: dict[bytes, int] = {}
            for u in units:
                n = seen[u] = seen.get(u, -1) + 1
                out.append(digest(u, 2 * n + kind))
    return np.unique(np.array(out, np.uint64))


def mix(x: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit mix (xor-shift-multiply) of x, another for each k."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Sketches:
    """Sketches of n texts with m cells each."""

    def __init__(self, n: int, m: int, seed: int = 0):
        self.m, self.seed = m, seed
        self.count, self.keys, self.checks = np.zeros(n * m, np.int64), np.zeros(n * m, np.uint64), np.zeros(n * m, np.uint64)

    def cells(self, owner: np.ndarray, key: np.ndarray) -> list[np.ndarray]:
        third = np.uint64(self.m // 3)
        return [owner * self.m + j * (self.m // 3) + (mix(key, 8 * self.seed + j) % third).astype(np.int64) for j in range(3)]

    def check(self, key: np.ndarray) -> np.ndarray:
        return mix(key, 8 * self.seed + 7) & np.uint64(0xFFFF)

    def add(self, owner: np.ndarray, key: np.ndarray, sign: np.ndarray | int = 1) -> "Sketches":
        check = self.check(key)
        for at in self.cells(owner, key):
            np.add.at(self.count, at, sign)
            np.bitwise_xor.at(self.keys, at, key)
            np.bitwise_xor.at(self.checks, at, check)
        return self

    def text(self, k: int) -> str:
        """The k-th sketch as hex: count (4 digits), digests (16) and checks (4) of each cell."""
        at = slice(k * self.m, (k + 1) * self.m)
        raw = np.concatenate([(self.count[at] & 0xFFFF).astype(">u2").view(np.uint8).reshape(-1, 2), self.keys[at].astype(">u8").view(np.uint8).reshape(-1, 8), self.checks[at].astype(">u2").view(np.uint8).reshape(-1, 2)], axis=1)
        return raw.tobytes().hex()

    def subtract(self, mine: np.ndarray, other: "Sketches", theirs: np.ndarray) -> "Sketches":
        """Sketch by sketch, self[mine] - other[theirs]."""
        m = self.m
        out = Sketches(0, m, self.seed)
        pick = lambda x, k: x.reshape(-1, m)[k].ravel()
        out.count = pick(self.count, mine) - pick(other.count, theirs)
        out.keys = pick(self.keys, mine) ^ pick(other.keys, theirs)
        out.checks = pick(self.checks, mine) ^ pick(other.checks, theirs)
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Recovered owners, digests and signs; and for each sketch whether all of it was recovered."""
        got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        n = len(self.count) // self.m if self.m else 0
        at = np.flatnonzero(np.abs(self.count) == 1)
        for _ in range(4 * self.m + 64):
            at = at[(np.abs(self.count[at]) == 1)]
            at = at[self.check(self.keys[at]) == self.checks[at]]
            owner, key = at // self.m, self.keys[at]
            home = self.cells(owner, key)
            at_home = (home[0] == at) | (home[1] == at) | (home[2] == at)
            at, owner, key = at[at_home], owner[at_home], key[at_home]
            if not len(at):
                break
            _, first = np.unique(np.stack([owner.view(np.uint64), key]), axis=1, return_index=True)
            at, owner, key = at[first], owner[first], key[first]
            sign = self.count[at]
            got.append((owner, key, sign))
            self.add(owner, key, -sign)
            at = np.unique(np.concatenate(self.cells(owner, key)))
        left = (self.count != 0) | (self.keys != 0) | (self.checks != 0)
        whole = ~left.reshape(n, self.m).any(axis=1) if n else np.empty(0, bool)
        cat = lambda k, kind: np.concatenate([g[k] for g in got]) if got else np.empty(0, kind)
        return cat(0, np.int64), cat(1, np.uint64), cat(2, np.int64), whole


def flat(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lens = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.repeat(np.arange(len(lists)), lens), np.concatenate(lists) if lists else np.empty(0, np.uint64)


def sketch(lists: list[np.ndarray], m: int, seed: int = 0) -> Sketches:
    return Sketches(len(lists), m, seed).add(*flat(lists))


def differences(a: list[np.ndarray], b: list[np.ndarray], base_a: Sketches | None = None, base_b: Sketches | None = None, base_cells: int = BASE_CELLS) -> tuple[np.ndarray, np.ndarray]:
    """For each pair, how many digests only a has and only b has, by subtracting and peeling sketches of growing size."""
    n = len(a)
    only_a, only_b = np.zeros(n, np.int64), np.zeros(n, np.int64)
    todo, m, level = np.arange(n), base_cells, 0
    while len(todo):
        stuck = np.array([m > ROOM * (len(a[k]) + len(b[k])) + 4096 for k in todo])  # digests that no sketch tells apart
        for k in todo[stuck]:
            only_a[k], only_b[k] = len(np.setdiff1d(a[k], b[k])), len(np.setdiff1d(b[k], a[k]))
        todo = todo[~stuck]
        if not len(todo):
            break
        if level == 0 and base_a is not None:
            diff = base_a.subtract(todo, base_b, todo)
        else:
            own, other = [a[k] for k in todo], [b[k] for k in todo]
            all_ = np.arange(len(todo))
            diff = sketch(own, m, level).subtract(all_, sketch(other, m, level), all_)
        owner, _, sign, whole = diff.peel()
        plus, minus = np.bincount(owner[sign > 0], minlength=len(todo)), np.bincount(owner[sign < 0], minlength=len(todo))
        # what was recovered must explain the difference in numbers
        size = np.array([len(a[k]) - len(b[k]) for k in todo], np.int64)
        whole &= plus - minus == size
        only_a[todo[whole]], only_b[todo[whole]] = plus[whole], minus[whole]
        todo, m, level = todo[~whole], m * GROWTH, level + 1
    return only_a, only_b


def likeness(a: list[np.ndarray], b: list[np.ndarray], base_a: Sketches | None = None, base_b: Sketches | None = None) -> np.ndarray:
    only_a, only_b = differences(a, b, base_a, base_b)
    n_a = np.fromiter(map(len, a), np.int64, len(a))
    every = n_a + only_b
    return np.where(every == 0, 1.0, (n_a - only_a) / np.maximum(every, 1))


def edited(text: str, following: str) -> str:
    """The last quarter of text replaced by as much of the beginning of what follows."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", piece_words: int = 5, parts: int | None = None, group_chars: int = 1 << 21) -> DataFrame:
    """One row per input row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next row is the next by id (null ids first, equal ids in the order read); after the last comes the first.
    One shuffle, by ranges of ids; the first row of each part goes to the part before as well, that of all to the last.
    """
    src = with_row_numbers(docs, id_col, text_col)
    kind = src.schema["id"].dataType.simpleString()
    arrow_id = src.select("id").limit(0).toArrow().schema.field(0).type
    low = lowest(src)
    where = cuts(src, low, parts)
    low_rid = None if low is None else low[1]

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        zip_ = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            part, first = where.place(b.column("id"), b.column("rid"))
            data = [zip_((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in b.column("text")]
            head, lead = np.flatnonzero(first), np.flatnonzero(b.column("rid").to_numpy() == low_rid)
            rows = pa.array(np.concatenate((np.arange(len(part)), head, lead)))
            before = np.concatenate((part, part[head] - 1, np.full(len(lead), where.parts - 1)))
            again = np.repeat(np.array([0, 1, 2], np.int32), [len(part), len(head), len(lead)])
            yield pa.RecordBatch.from_arrays([pa.array(before), pa.array(again), b.column("id").take(rows), b.column("rid").take(rows), pa.array(data, pa.binary()).take(rows)], names=["part", "again", "id", "rid", "data"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, str, str]]:
        """id, text, next text; per part: its rows, then the first of the next part (again = 1), or of all after the last (2)."""
        import zstandard

        unzip = zstandard.ZstdDecompressor().decompress
        held, part, tail = None, None, None
        for b in batches:
            for p, again, i, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(4)):
                if p != part:
                    if held and tail is not None:
                        yield held[0], held[1], tail
                    part, held, tail = p, None, None
                if again:
                    if tail is None:
                        tail = unzip(data.as_py()).decode("utf-8", "surrogatepass")
                    continue
                text = unzip(data.as_py()).decode("utf-8", "surrogatepass")
                if held:
                    yield held[0], held[1], text
                held = (i, text)
        if held and tail is not None:
            yield held[0], held[1], tail

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, chars = [], 0
        for x in pairs(batches):
            group.append(x)
            chars += len(x[1]) + ROW_CHARS
            if chars >= group_chars:
                yield finish(group)
                group, chars = [], 0
        if group:
            yield finish(group)

    def finish(group: list[tuple[object, str, str]]) -> pa.RecordBatch:
        texts = [edited(t, f) for _, t, f in group]
        own, new = [piece_digests(t, piece_words) for _, t, _ in group], [piece_digests(t, piece_words) for t in texts]
        nxt = [own[k + 1] if k + 1 < len(group) and group[k][2] is group[k + 1][1] else piece_digests(group[k][2], piece_words) for k in range(len(group))]
        s_own, s_new, s_nxt = sketch(own, BASE_CELLS), sketch(new, BASE_CELLS), sketch(nxt, BASE_CELLS)
        n = range(len(group))
        return pa.RecordBatch.from_arrays(
            [pa.array([g[0] for g in group], arrow_id), pa.array([len(g[1]) for g in group], pa.int64()), pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in texts]), pa.array([s_own.text(k) for k in n]), pa.array([s_new.text(k) for k in n]), pa.array(likeness(own, new, s_own, s_new)), pa.array(likeness(own, nxt, s_own, s_nxt))],
            names=[id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    tagged = src.mapInArrow(tag, f"part bigint, again int, id {kind}, rid bigint, data binary")
    return in_order(tagged, where.parts, "again", "id", "rid").mapInArrow(run, f"`{id_col}` {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
