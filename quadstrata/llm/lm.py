"""Language-model scores by deleted interpolation.

P(w | u) = l2(b) c(u, w) / c(u) + l1(b) c(w) / N + l0(b) / (V + 1), b the bucket of how often
the context u was seen.  The weights of each bucket are learned by expectation-maximisation
on held-out counts: the training documents of one hash class are set aside, the ratios come
from the others, and the weights then serve the counts of all.  A context not seen has l2 = 0.

Texts are read once: blocks of documents are written as codes of their words.  No n-gram table
is broadcast or collected.  A block sends its distinct words and word pairs, with its own
training counts, in ``fan`` ranges of the hash space to the nodes of its group of blocks; a node
adds up what its group sent and passes its range on, again in ``fan`` parts, to the group of
groups, and so on until one group holds the corpus; the totals come back the same way, each
node answering in the order of the keys it was asked.  So a node holds about as many keys as
a block whatever the size of the corpus, rows grow with blocks times the logarithm of their
number, and a hot word weighs no more than one key for each child.  All counts are 64-bit.

Held-out evidence for the weights comes as a histogram with a bounded number of cells.
Words are 61-bit hashes of their bytes throughout, pairs 52-bit hashes.

Null texts are empty: one token, the end.  Null ids hash as the empty text; repeated rows count
and are scored each.  Texts of any length stay whole, as one block if need be.  An empty table
gives no row.  Only the id and the text column are read, so other columns can't clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release

WORD_BITS, PAIR_BITS = 61, 52
END, BEGIN = np.uint64(0x1AE16A3B2F90404F), np.uint64(0x03A5C85C97CB3127)
BUCKETS, BINS = 24, 64
#: Children of a node of the exchange.
FAN = 128
#: What a document costs beside its characters.
ROW_BYTES = 256


def narrow(x: np.ndarray) -> np.ndarray:
    """Counts in as few bytes as hold the greatest, 8 at most."""
    top = int(x.max()) if len(x) else 0
    return x.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<i8")


def pack_counts(x: np.ndarray) -> bytes:
    x = narrow(x)
    return bytes([x.dtype.itemsize]) + pack(x)


def unpack_counts(data: bytes) -> np.ndarray:
    """As narrow as they were packed."""
    return unpack(memoryview(data)[1:], {1: "<u1", 2: "<u2", 4: "<u4", 8: "<i8"}[data[0]])


def pack(x: np.ndarray) -> bytes:
    """Bytes of equal weight together, then zstd."""
    import zstandard

    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def unpack(data: bytes, kind: str) -> np.ndarray:
    import zstandard

    size = np.dtype(kind).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def pair_key(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Hash of an ordered pair of word hashes, of PAIR_BITS bits."""
    with np.errstate(over="ignore"):
        x = (u * np.uint64(0x9FB21C651E98DF25)) ^ ((w << np.uint64(31)) | (w >> np.uint64(33)))
        x = (x ^ (x >> np.uint64(28))) * np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ (x >> np.uint64(32))) >> np.uint64(64 - PAIR_BITS)


def range_cuts(keys: np.ndarray, bits: int, ranges: int, first: int, count: int) -> np.ndarray:
    """Where ranges first, ... of the hash space (``ranges`` equal ones) begin in the sorted keys, count of them; and the end."""
    edges = np.array([((first + k) << bits) // ranges for k in range(count)], np.uint64)
    return np.append(np.searchsorted(keys, edges), len(keys))


def counted(keys: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each occurs in part 0 and in part 1."""
    both = np.sort(keys << np.uint64(2) | part.astype(np.uint64))
    key, p = both >> np.uint64(2), both & np.uint64(3)
    first = np.flatnonzero(starts(key))
    sums = [np.add.reduceat((p == k).astype(np.int64), first) if len(first) else np.empty(0, np.int64) for k in (0, 1)]
    return key[first], *sums


def starts(ordered: np.ndarray) -> np.ndarray:
    """Whether each value is the first of its run."""
    return np.concatenate(([True], ordered[1:] != ordered[:-1])) if len(ordered) else np.empty(0, bool)


def merge(keys: list[np.ndarray], counts: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys of several lists, where each key of the lists stands among them, and for each kind of counts the sums."""
    every = np.concatenate(keys)
    order = np.argsort(every)
    ordered = every[order]
    new = starts(ordered)
    at = np.empty(len(every), np.int64)
    at[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    return ordered[new], at, [np.add.reduceat(np.concatenate(c)[order], first, dtype=np.int64) if len(first) else np.empty(0, np.int64) for c in counts]


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self)
        return code


class _Block:
    """Some documents as codes of their words; split: 0 train, 1 set aside, 2 held out."""

    def __init__(self):
        self.words, self.ids, self.codes, self.split, self.bytes = _Words(), [], [], [], 0

    def add(self, doc_id, text: str | None, split: int) -> None:
        raw = (text or "").encode("utf-8", "surrogatepass").lower()
        words = raw.split()
        self.ids.append(doc_id)
        self.codes.append(np.fromiter(map(self.words.__getitem__, words), np.int32, len(words)))
        self.split.append(split)
        self.bytes += len(raw)

    def tokens(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word hashes in order (END and BEGIN among them), the number of each token's word there, and tokens by document."""
        import xxhash

        own = np.fromiter((xxhash.xxh64_intdigest(w) >> (64 - WORD_BITS) for w in self.words), np.uint64, len(self.words))
        hashes = np.concatenate((own, [END, BEGIN]))
        order = np.argsort(hashes)
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        n = np.fromiter(map(len, self.codes), np.int64, len(self.codes)) + 1
        ends = np.cumsum(n)
        token = np.empty(int(n.sum()), np.int32)
        inside = np.ones(len(token), bool)
        inside[ends - 1] = False
        token[inside] = rank[np.concatenate(self.codes)] if self.codes else 0
        token[ends - 1] = rank[-2]
        return hashes[order], token, n


def contexts(hashes: np.ndarray, token: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The number of the word before each token; BEGIN at the start of a document."""
    before = np.concatenate((token[:1], token[:-1]))
    before[np.cumsum(n) - n] = np.searchsorted(hashes, BEGIN)
    return before


def _read(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[tuple[int, _Block]]:
    """The blocks of a partition, bounded in text and in rows."""
    from pyspark import TaskContext

    base, seq, block, size = TaskContext.get().partitionId() << 24, 0, None, 0
    for b in batches:
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
            h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10
            block = block or _Block()
            text = text.as_py() or ""
            size += len(text) + ROW_BYTES
            block.add(doc_id, text, 2 if h == 0 else 1 if h == 1 else 0)
            if size >= block_bytes:
                yield base + seq, block
                seq, block, size = seq + 1, None, 0
    if block:
        yield base + seq, block


def bucket(c: np.ndarray) -> np.ndarray:
    """0 for a context not seen, then by powers of two of its count."""
    return np.where(c > 0, np.minimum(np.floor(np.log2(np.maximum(c, 1))).astype(np.int64) + 1, BUCKETS - 1), 0)


def log_bin(p: np.ndarray) -> np.ndarray:
    """0 for nothing, then a half power of two for each bin."""
    return np.where(p > 0, np.clip(np.round(-2 * np.log2(np.maximum(p, 1e-30))).astype(np.int64) + 1, 1, BINS - 1), 0)


def bin_value(k: np.ndarray) -> np.ndarray:
    return np.where(k > 0, 2.0 ** (-(k - 1) / 2), 0.0)


def learn_weights(cells: np.ndarray, uniform: float, rounds: int = 60) -> np.ndarray:
    """cells: bucket, bin of the pair ratio, bin of the word ratio, held-out count -> l2, l1, l0 of each bucket by EM; buckets without evidence take those of all."""
    def em(c: np.ndarray, seen: bool) -> np.ndarray:
        w = np.array([0.5, 0.4, 0.1]) if seen else np.array([0.0, 0.8, 0.2])
        if not len(c):
            return w
        p = np.stack([bin_value(c[:, 1]), bin_value(c[:, 2]), np.full(len(c), uniform)], axis=1)
        for _ in range(rounds):
            share = p * w
            share /= np.maximum(share.sum(axis=1, keepdims=True), 1e-300)
            w = (share * c[:, 3:4]).sum(axis=0)
            w = np.maximum(w / w.sum(), [1e-9 * seen, 1e-9, 1e-6])
            w /= w.sum()
        return w

    every = em(cells[cells[:, 0] > 0], True)
    out = np.tile(every, (BUCKETS, 1))
    for b in range(BUCKETS):
        own = cells[cells[:, 0] == b]
        out[b] = em(own, b > 0) if len(own) or b == 0 else every
    return out


WHAT = (("w", "words", WORD_BITS), ("p", "pairs", PAIR_BITS))
KEYS = ["words", "w_train", "w_aside", "pairs", "p_train", "p_aside"]
ANSWERS = ["w_train", "w_aside", "w_dev", "p_train", "p_aside", "p_dev"]
FACTS = ["n_train", "n_aside", "n_words"]
_binary = lambda names: ", ".join(f"{k} binary" for k in names)
ASKED = f"grp bigint, rng bigint, child bigint, {_binary(KEYS)}"
ANSWERED = f"owner bigint, rng bigint, {_binary(ANSWERS)}, {', '.join(f'{k} bigint' for k in FACTS)}"


def _asked(child: int, parent: int, ranges: int, first: int, fan: int, data: dict[str, tuple]) -> Iterator[list]:
    """Rows of ASKED: the keys and counts of a child in fan ranges, from range first of ranges; empty ranges are left out."""
    cut = {k: range_cuts(data[k][0], bits, ranges, first, fan) for k, _, bits in WHAT}
    for s in range(fan):
        own = {k: slice(cut[k][s], cut[k][s + 1]) for k in cut}
        if any(v.start < v.stop for v in own.values()):
            cells = [c for k in cut for c in (pack(np.diff(data[k][0][own[k]], prepend=np.uint64(0))), *[pack_counts(x[own[k]]) for x in data[k][1]])]
            yield [parent, first + s, child, *cells]


def _table(rows: list[list], schema: list[str], binary_from: int, binary_to: int) -> pa.Table:
    kind = lambda k: pa.binary() if binary_from <= k < binary_to else pa.int64()
    return pa.table([pa.array([r[k] for r in rows], kind(k)) for k in range(len(schema))], names=schema)


def _asked_table(rows: list[list]) -> pa.Table:
    return _table(rows, ["grp", "rng", "child", *KEYS], 3, 9)


class _Node:
    """What the children of a node sent, added up."""

    def __init__(self, table: pa.Table):
        self.table, self.keys, self.data, self.at = table, {}, {}, {}
        for k, name, _ in WHAT:
            self.keys[k] = [np.cumsum(unpack(v.as_py(), "<u8"), dtype=np.uint64) for v in table.column(name)]
            distinct, self.at[k], sums = merge(self.keys[k], [[unpack_counts(v.as_py()) for v in table.column(f"{k}_{c}")] for c in ("train", "aside")])
            self.data[k] = (distinct, sums)

    def facts(self) -> list[int]:
        words, (train, aside) = self.data["w"]
        word = words != BEGIN
        return [int(train[word].sum()), int(aside[word].sum()), int(((train + aside > 0) & word).sum())]

    def answers(self, totals: dict[str, list[np.ndarray]], facts: list[int]) -> pa.Table:
        """For each child the totals of its keys, in its order; and, of those it has set aside, the training totals alone."""
        out = []
        at = {k: 0 for k in totals}
        for row in range(self.table.num_rows):
            cells = []
            for k, _, _ in WHAT:
                n = len(self.keys[k][row])
                own = self.at[k][at[k] : at[k] + n]
                at[k] += n
                train, aside = (t[own] for t in totals[k])
                has = unpack_counts(self.table.column(f"{k}_aside")[row].as_py()) > 0
                cells += [pack_counts(train), pack_counts(aside), pack_counts(train[has])]
            out.append([self.table.column("child")[row].as_py(), self.table.column("rng")[row].as_py(), *cells, *facts])
        return _table(out, ["owner", "rng", *ANSWERS, *FACTS], 2, 8)


def _in_order(right: pa.Table, name: str) -> np.ndarray:
    by = np.argsort(right.column("rng").to_numpy())
    return np.concatenate([unpack_counts(right.column(name)[int(s)].as_py()) for s in by] or [np.empty(0, np.int64)])


def _upwards(level: int, fan: int):
    def up(table: pa.Table) -> pa.Table:
        grp, rng, node = table.column("grp")[0].as_py(), table.column("rng")[0].as_py(), _Node(table)
        return _asked_table(list(_asked(grp, grp // fan, fan ** (level + 1), rng * fan, fan, node.data)))

    return up


def corpus_counts(asked: DataFrame, blocks: int, fan: int) -> tuple[DataFrame, tuple[int, int, int]]:
    """ASKED of the blocks (grp: ceil(blocks / fan) groups) -> ANSWERED by block, and the facts of the corpus."""
    groups, level, sent = -(-blocks // fan), 1, [asked]
    while groups > 1:
        sent[-1] = materialise(sent[-1], "lmup")  # read once on the way up and once on the way down

        sent.append(sent[-1].groupBy("grp", "rng").applyInArrow(_upwards(level, fan), ASKED))
        groups, level = -(-groups // fan), level + 1

    def top(table: pa.Table) -> pa.Table:
        node = _Node(table)
        return node.answers({k: v[1] for k, v in node.data.items()}, node.facts())

    def down(children: pa.Table, right: pa.Table) -> pa.Table:
        return _Node(children).answers({k: [_in_order(right, f"{k}_{c}") for c in ("train", "aside")] for k, _, _ in WHAT}, [0, 0, 0])

    answers = materialise(sent.pop().groupBy("grp", "rng").applyInArrow(top, ANSWERED), "lm")
    facts = answers.groupBy("rng").agg(*[F.first(c).alias(c) for c in FACTS]).agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in FACTS]).first()
    while sent:
        mine, above = sent.pop(), answers
        back = above.withColumn("node", F.floor(F.col("rng") / fan)).groupBy("owner", "node")
        answers = materialise(mine.groupBy("grp", "rng").cogroup(back).applyInArrow(down, ANSWERED), "lm")
        release(above)
        release(mine)
    return answers, tuple(int(v) for v in facts)


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 1 << 24, fan: int = FAN) -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    src = docs.select(id_col, text_col)
    kind = src.schema[id_col].dataType.simpleString()
    arrow_id = src.limit(0).toArrow().schema.field(0).type

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, block in _read(batches, block_bytes):
            hashes, token, n = block.tokens()
            cells = [np.array(block.split, np.int8).tobytes(), pack(n), pack(np.diff(hashes, prepend=np.uint64(0))), pack(token)]
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([block.ids], pa.list_(arrow_id)), *[pa.array([c], pa.binary()) for c in cells]], names=["block", "ids", "split", "n", "hashes", "token"])

    def parts(table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """split by document, word hashes in order, tokens as numbers of those, tokens by document."""
        get = lambda name, t: unpack(table.column(name)[0].as_py(), t)
        return np.frombuffer(table.column("split")[0].as_py(), np.int8), np.cumsum(get("hashes", "<u8"), dtype=np.uint64), get("token", "<i4"), get("n", "<i8")

    blocks = materialise(src.mapInArrow(write, f"block bigint, ids array<{kind}>, split binary, n binary, hashes binary, token binary"), "lmblocks")
    n_blocks = blocks.count()
    groups = max(1, -(-n_blocks // fan))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1)
                key = row.column("block")[0].as_py()
                split, hashes, token, n = parts(row)
                part = np.repeat(split, n)
                words, *w_counts = counted(hashes[token], part)
                at = int(np.searchsorted(words, BEGIN))  # a context once for each document, not a token
                words, w_counts = np.insert(words, at, BEGIN), [np.insert(c, at, (split == p).sum()) for p, c in enumerate(w_counts)]
                pairs, *p_counts = counted(pair_key(hashes[contexts(hashes, token, n)], hashes[token]), part)
                group = zlib.crc32(key.to_bytes(8, "little")) % groups
                yield from _asked_table(list(_asked(key, group, fan, 0, fan, {"w": (words, w_counts), "p": (pairs, p_counts)}))).to_batches()

    answers, (n_train, n_aside, n_words) = corpus_counts(blocks.select("block", "split", "n", "hashes", "token").mapInArrow(ask, ASKED), n_blocks, fan)

    def tokens(table: pa.Table):
        """Tokens by document, each token's word and context as numbers of the block's words, each token's pair as number of the block's pairs; and how many words and pairs."""
        _, hashes, token, count = parts(table)
        before = contexts(hashes, token, count) if len(token) else token
        pairs = pair_key(hashes[before], hashes[token])
        order = np.argsort(pairs)
        new = starts(pairs[order])
        pair = np.empty(len(pairs), np.int64)
        pair[order] = np.cumsum(new) - 1
        # the block asked for the words it has; a word is numbered among those, BEGIN included
        used = np.zeros(len(hashes), bool)
        used[token] = True
        used[np.searchsorted(hashes, BEGIN)] = True
        number = np.cumsum(used) - 1
        return count, number[token], number[before], pair, int(used.sum()), int(new.sum())

    def answered(right: pa.Table, name: str, size: int) -> np.ndarray:
        got = _in_order(right, name).astype(np.int64)
        if len(got) != size:
            raise RuntimeError("the totals of a block don't fit its keys")
        return got

    def joined(left: DataFrame, names: list[str], f, schema: str) -> DataFrame:
        return left.groupBy("block").cogroup(answers.select("owner", "rng", *names).groupBy("owner")).applyInArrow(f, schema)

    def aside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The documents set aside alone."""
        for b in batches:
            for k in range(b.num_rows):
                split, hashes, token, n = parts(b.slice(k, 1))
                keep = split == 1
                if keep.any():
                    cells = [split[keep].tobytes(), pack(n[keep]), pack(np.diff(hashes, prepend=np.uint64(0))), pack(token[np.repeat(keep, n)])]
                    yield pa.RecordBatch.from_arrays([b.column("block").slice(k, 1), *[pa.array([c], pa.binary()) for c in cells]], names=["block", "split", "n", "hashes", "token"])

    def evidence(left: pa.Table, right: pa.Table) -> pa.Table:
        """Histogram of the tokens set aside: context bucket, pair ratio, word ratio."""
        if not left.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64())], names=["cell", "n"])
        _, w, u, pair, n_w, n_p = tokens(left)
        c_w, c_p = answered(right, "w_dev", n_w), answered(right, "p_dev", n_p)
        cell = (bucket(c_w[u]) * BINS + log_bin(c_p[pair] / np.maximum(c_w[u], 1))) * BINS + log_bin(c_w[w] / max(n_train, 1))
        k, many = np.unique(cell, return_counts=True)
        return pa.table([pa.array(k, pa.int64()), pa.array(many.astype(np.int64))], names=["cell", "n"])

    held = blocks.select("block", "split", "n", "hashes", "token").mapInArrow(aside, f"block bigint, {_binary(['split', 'n', 'hashes', 'token'])}")
    cells = joined(held, ["w_dev", "p_dev"], evidence, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most BUCKETS * BINS^2 rows
    k = cells.column("cell").to_numpy()
    weights = learn_weights(np.stack([k // BINS**2, k // BINS % BINS, k % BINS, cells.column("n").to_numpy()], axis=1).astype(float), 1 / (n_words + 1))
    n_all = n_train + n_aside

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        count, w, u, pair, n_w, n_p = tokens(left)
        c_w, c_p = (answered(right, f"{k}_train", m) + answered(right, f"{k}_aside", m) for k, m in (("w", n_w), ("p", n_p)))
        base = np.log10((c_w + 0.1) / (n_all + 0.1 * (n_words + 1)))
        lam = weights[bucket(c_w)]  # by context
        prob = np.log10(lam[u, 0] * c_p[pair] / np.maximum(c_w[u], 1) + lam[u, 1] * c_w[w] / max(n_all, 1) + lam[u, 2] / (n_words + 1))
        start = np.cumsum(count) - count
        sums = lambda v: np.add.reduceat(v, start)
        split = np.frombuffer(left.column("split")[0].as_py(), np.int8)
        return pa.table(
            [left.column("ids").combine_chunks().flatten(), pa.array(split == 2), pa.array(count), pa.array(sums((c_w > 0)[w].astype(np.int64))), pa.array(np.full(len(count), n_all)), pa.array(sums(base[w])), pa.array(sums(prob))],
            names=[id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return joined(blocks, ["w_train", "w_aside", "p_train", "p_aside"], score, f"`{id_col}` {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
