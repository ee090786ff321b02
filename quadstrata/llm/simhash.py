"""SimHash near-duplicates by a binary trie self-join over the distinct fingerprints.

Fingerprints: 64 bits, a bit is set if it is in over half the XXH64 hashes of the
4-word shingles (repeats count; fewer words: the whole sequence; none: zero).

Join: two fingerprints link at ``budget`` or fewer differing bits.  The 64 bits are
budget + 1 blocks; for a linked pair there is a rotation of the blocks in which the
first j blocks hold at most j - 1 differing bits, for every j (cycle lemma).  So each
fingerprint enters one trie per rotation, sharded by the exact first block, and in a
shard pairs of trie nodes are walked down together, differing bits accumulate, and a
pair is pruned as soon as it exceeds the budget of its depth.  Walks go depth first
over chunks of bounded size; node pairs whose leaves are joined already are dropped,
so a large group of near copies costs no pair enumeration, and a shard returns at most
one edge per fingerprint.  Edges of all shards meet in ``graph.components``.

Null texts are empty texts.  The class id is the smallest id of the component; null
ids are in a class but never name it unless it has no other.  Repeated rows have a row
each, and one keeper.  Texts of any length are read whole.  An empty table gives no row.
Only the id and the text column are read; decisions go back to whole rows by number, and
the job stops if a number has come to mean another id, so columns of any name can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_spread, materialise, without
from .graph import components

SEED = 42
#: Nodes of up to so many leaves are compared leaf by leaf.
FEW = 16


def fingerprint(text: str | None, width: int = 4) -> int:
    """The SimHash of one text, as an unsigned integer."""
    h = shingles(text, width)
    return majority(h) if len(h) else 0


def shingles(text: str | None, width: int) -> np.ndarray:
    """Hashes of the shingles in their order; none of a text without words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest, n = xxhash.xxh64_intdigest, len(words) - width + 1
    return np.fromiter((digest(joined[i:j], SEED) for i, j in zip(starts[:n].tolist(), ends[width - 1 :].tolist())), np.uint64, n)


def majority(h: np.ndarray) -> int:
    """Bits set in over half of the hashes."""
    if len(h) == 1:
        return int(h[0])
    if len(h) < 256:
        ones = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0)
    else:
        cells = h.astype("<u8").view(np.uint8).reshape(-1, 8)
        ones = np.concatenate([np.bincount(cells[:, k], minlength=256) @ BITS for k in range(8)])
    return int.from_bytes(np.packbits(ones * 2 > len(h), bitorder="little").tobytes(), "little")


BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """rid, id, fp (signed 64-bit) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), width) for t in b.column(2)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp, pa.int64())], names=["rid", id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.monotonically_increasing_id().alias("rid"), id_col, text_col).mapInArrow(run, f"rid bigint, `{id_col}` {kind}, fp bigint")


def blocks(bits: int, budget: int) -> list[int]:
    """Lengths of budget + 1 blocks of nearly equal length."""
    n = budget + 1
    return [bits // n + (k < bits % n) for k in range(n)]


def rotate(x: np.ndarray, k: int) -> np.ndarray:
    return x if k == 0 else (x << np.uint64(k)) | (x >> np.uint64(64 - k))


class Forest:
    """Which leaves are joined: union by label, whole arrays at a time.

    A join touches what it joins; the labels of all leaves, which serve to skip node pairs that are
    one class already, are brought up to date only after every n / 16 joins (older ones skip less).
    """

    def __init__(self, n: int):
        self.parent = np.arange(n, dtype=np.int32 if n < 1 << 31 else np.int64)
        self.edges: list[np.ndarray] = []
        self.joined, self.every = 0, max(256, n // 16)
        self._refresh()

    def _refresh(self) -> None:
        up = self.parent
        while True:
            further = up[up]
            if (further == up).all():
                break
            up = further
        self.label, self.parent = up, up.copy()
        self.run = np.concatenate(([0], np.cumsum(up[1:] != up[:-1], dtype=np.int32)))
        self.joined = 0

    def root(self, x: np.ndarray) -> np.ndarray:
        """The least leaf known of the class of each leaf; shortens the paths that it walks."""
        top = self.parent[x]
        while True:
            up = self.parent[top]
            if (up == top).all():
                self.parent[x] = top
                return top
            self.parent[x] = up
            top = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Links a-b; keeps those that join two classes yet apart, one at a time where they compete."""
        while len(a):
            x, y = self.root(a), self.root(b)
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            if not len(a):
                break
            low, high = np.minimum(x, y), np.maximum(x, y)
            order = np.lexsort((low, high))
            first = np.concatenate(([True], high[order][1:] != high[order][:-1]))
            pick = order[first]  # each class hangs below one smaller class: no cycle
            self.edges.append(np.stack([a[pick], b[pick]], axis=1))
            self.parent[high[pick]] = low[pick]
            self.joined += len(pick)
        if self.joined >= self.every:
            self._refresh()

    def same(self, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> np.ndarray:
        """Whether all leaves of [a0, a1) and [b0, b1) are known to be one class."""
        return (self.run[a0] == self.run[a1 - 1]) & (self.run[b0] == self.run[b1 - 1]) & (self.label[a0] == self.label[b0])


def trie_links(keys: np.ndarray, lengths: list[int], chunk: int = 1 << 18) -> np.ndarray:
    """Spanning edges (indexes into keys) of the links in one shard.

    keys: sorted distinct uint64 that agree in the first lengths[0] bits; a pair links if its
    first j blocks differ in at most j - 1 bits for each j.
    """
    n = len(keys)
    forest = Forest(n)
    if n < 2:
        return np.empty((0, 2), np.int64)
    allowed = np.repeat(np.arange(len(lengths)), lengths)  # by bit
    # pairs of nodes (a0, a1, b0, b1, differing bits), a node being the leaves [a0, a1) that share the bits so far
    todo = [(lengths[0], *(np.array([v]) for v in (0, n, 0, n, 0)))]
    while todo:
        depth, a0, a1, b0, b1, d = todo.pop()
        live = ~forest.same(a0, a1, b0, b1)
        a0, a1, b0, b1, d = (v[live] for v in (a0, a1, b0, b1, d))
        if not len(a0):
            continue
        few = np.maximum(a1 - a0, b1 - b0) <= FEW
        if few.any():  # few leaves each: what is left of their paths at once
            at = np.flatnonzero(few)
            for k in range(0, len(at), chunk >> 3):
                part = at[k : k + (chunk >> 3)]
                part = part[~forest.same(a0[part], a1[part], b0[part], b1[part])]
                i, j = near(keys, a0[part], a1[part], b0[part], b1[part], len(lengths) - 1)
                x, ok, bits = keys[i] ^ keys[j], np.ones(len(i), bool), 0
                for n_block, length in enumerate(lengths):
                    bits += length
                    ok &= np.bitwise_count(x >> np.uint64(64 - bits)) <= n_block
                forest.join(i[ok], j[ok])
            a0, a1, b0, b1, d = (v[~few] for v in (a0, a1, b0, b1, d))
            if not len(a0):
                continue
        if len(a0) > chunk:
            for s in range(0, len(a0), chunk):
                todo.append((depth, *(v[s : s + chunk] for v in (a0, a1, b0, b1, d))))
            continue
        if depth == 64:
            forest.join(a0, b0)
            continue
        bit = np.uint64(63 - depth)
        am, bm = split(keys, a0, a1, bit), split(keys, b0, b1, bit)
        most, equal, made = allowed[depth], (a0 == b0) & (a1 == b1), []
        for x0, x1, y0, y1, cost in ((a0, am, b0, bm, 0), (am, a1, bm, b1, 0), (a0, am, bm, b1, 1), (am, a1, b0, bm, 1)):
            ok = (x0 < x1) & (y0 < y1) & (d + cost <= most)
            if cost and x0 is am:
                ok &= ~equal  # the mirror image of a pair inside one node
            ok &= ~((x0 == y0) & (x1 - x0 == 1))  # a leaf and itself
            made.append((x0[ok], x1[ok], y0[ok], y1[ok], d[ok] + cost))
        todo.append((depth + 1, *(np.concatenate(v) for v in zip(*made))))
    return np.concatenate(forest.edges) if forest.edges else np.empty((0, 2), np.int64)


def near(keys: np.ndarray, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Leaves i of [a0, a1) and j > i or of another node [b0, b1) that differ in at most budget bits."""
    n_a, n_b, twin = a1 - a0, b1 - b0, a0 == b0
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    if len(a0) <= 8:  # few nodes: each pair of them at once
        for i, m, j, n, same in zip(a0.tolist(), n_a.tolist(), b0.tolist(), n_b.tolist(), twin.tolist()):
            hit = np.bitwise_count(keys[i : i + m, None] ^ keys[None, j : j + n]) <= budget
            s, t = np.nonzero(np.triu(hit, 1) if same else hit)
            found.append((i + s, j + t))
        return tuple(np.concatenate(v) for v in zip(*found))
    for s in range(int(n_a.max(initial=0))):
        row = np.flatnonzero(n_a > s)
        mine = keys[a0[row] + s]
        for t in range(int(n_b[row].max(initial=0))):
            own = n_b[row] > t if s < t else (n_b[row] > t) & ~twin[row]
            r = row[own]
            hit = np.bitwise_count(mine[own] ^ keys[b0[r] + t]) <= budget
            if hit.any():
                found.append((a0[r[hit]] + s, b0[r[hit]] + t))
    return tuple(np.concatenate(v) for v in zip(*found))


def split(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.uint64) -> np.ndarray:
    """First leaf in each [lo, hi) with the bit set; the leaves are sorted and share the bits above."""
    mark = ((keys[lo] >> bit) | np.uint64(1)) << bit
    return np.clip(np.searchsorted(keys, mark), lo, hi)


def link_edges(distinct: DataFrame, budget: int = 4, shards: int | None = None) -> DataFrame:
    """distinct: fp -> edges a, b that connect what links, at most budget + 1 for each fingerprint."""
    lengths = blocks(64, budget)
    starts = [sum(lengths[:k]) for k in range(len(lengths))]
    first = F.array(*[F.struct(F.lit(k).cast("int").alias("turn"), F.shiftrightunsigned(F.shiftleft("fp", starts[k]) if starts[k] else F.col("fp"), 64 - lengths[k]).cast("int").alias("block")) for k in range(len(lengths))])
    entries = distinct.select("fp", F.explode(first).alias("e")).select("fp", "e.turn", "e.block")

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        now: tuple[int, int] | None = None

        def flush():
            if now is None or sum(map(len, held)) < 2:
                return
            k = now[0]
            own = lengths[k:] + lengths[:k]
            keys = np.unique(rotate(np.concatenate(held), starts[k]))
            e = trie_links(keys, own)
            if len(e):
                back = rotate(keys, 64 - starts[k] if starts[k] else 0).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(back[e[:, 0]]), pa.array(back[e[:, 1]])], names=["a", "b"])

        for b in batches:
            fp, turn, block = b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy(), b.column(2).to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero((turn[1:] != turn[:-1]) | (block[1:] != block[:-1])) + 1, [len(fp)])) if len(fp) else []
            for i, j in zip(cuts[:-1], cuts[1:]):
                key = (int(turn[i]), int(block[i]))
                if key != now:
                    yield from flush()
                    held, now = [], key
                held.append(fp[i:j])
        yield from flush()

    return entries.repartition(shards or _shuffle_partitions(distinct), "turn", "block").sortWithinPartitions("turn", "block").mapInArrow(shard, "a bigint, b bigint")


def _shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, budget: int = 4) -> DataFrame:
    """One row per input row: rid, id, fp, component_id (smallest id of what links), keeper (the one row of each component that stays)."""
    marked = materialise(fingerprints(docs, id_col, text_col, width), "fp")
    classes = materialise(marked.groupBy("fp").agg(F.min(F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), "rid")).alias("best")), "fpclass")
    roots = components(link_edges(classes.select("fp"), budget)).withColumnRenamed("node", "fp")
    grouped = materialise(classes.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "best"), "fproot")
    best = grouped.groupBy("root").agg(F.min("best").alias("first"), F.count("*").alias("n"))
    names = join_spread(grouped, best, "root", "n", "fp").select("fp", F.col("first.id").alias("component_id"), F.col("first.rid").alias("first_rid"))
    return marked.join(names, "fp").select("rid", id_col, "fp", "component_id", (F.col("rid") == F.col("first_rid")).alias("keeper"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each component; docs must be a plan that repeats, such as a table scan."""
    id_col = options.get("id_col", "doc_id")
    return without(docs, near_duplicates(docs, **options).filter(~F.col("keeper")).select("rid", id_col), id_col)
