"""Near copies by exact shingle similarity: the pipeline's stage on top of the SimHash operator.

Two texts are near copies if the Jaccard similarity of their sets of ``width``-word
shingles is ``least`` or more.  At 0.8 two SimHashes differ in about ten bits, which no
join on few bits finds; so candidates are the operator's links (``budget`` bits) and
the texts that share a band of min-hashes: ``ROWS`` minima agree at similarity s with
probability s^ROWS, and one of ``BANDS`` bands does at 0.8 with 0.998.  In each band's
bucket, rows are first compared with two hubs, the ends of an order by hashed id that differs by
band, which makes one class of a large group of copies at a cost of two pairs for each row.  What
a bucket then still holds in different classes is compared pair by pair, in blocks of bounded
size, on sizes and parity bits: of two sets as many bits differ as have an odd number of the
elements in only one of the sets, so no pair of ``least`` or more is passed over.  What passes is a
candidate too.  A pair of one class is not compared again, so the hubs cost no class.

Every candidate is verified on the whole sets before it links; classes are the
components of verified links.  Texts without words are alike; null texts are empty.  Null
ids and repeated rows are rows like others; of a class the smallest id stays, null ids last.
Texts of any length are compared whole.  An empty table gives no row.  Decisions go back to
whole rows by number, and the job stops if a number has come to mean another id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_spread, materialise, without
from .graph import components
from .simhash import link_edges, majority, shingles

BANDS, ROWS = 16, 5
#: Parity bits of a set of shingles.
PARITY = 1024
#: Rows of a bucket that one task compares with as many others.
BLOCK = 8192
_rng = np.random.default_rng(42)
FLIP, TIMES = _rng.integers(0, 2**64, (BANDS * ROWS, 1), dtype=np.uint64), _rng.integers(0, 2**64, (BANDS * ROWS, 1), dtype=np.uint64) | np.uint64(1)


def band_keys(h: np.ndarray, chunk: int = 4096) -> list[int]:
    """One signed key per band from the shingle hashes."""
    import xxhash

    low = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for k in range(0, len(h), chunk):
        low = np.minimum(low, ((h[k : k + chunk] ^ FLIP) * TIMES).min(axis=1))
    return [xxhash.xxh64_intdigest(low[k : k + ROWS].tobytes(), k) - (1 << 63) for k in range(0, len(low), ROWS)]


def parity(distinct: np.ndarray) -> bytes:
    """PARITY bits of a set of hashes: whether an odd number of them falls on each."""
    return np.packbits(np.bincount((distinct >> np.uint64(32)) % np.uint64(PARITY), minlength=PARITY) & 1).tobytes()


def sketches(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """rid, id, fp, bands, n (distinct shingles), parity of every row, in one pass over the texts."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, bands, n, bits = [], [], [], []
            for t in b.column(2):
                h = shingles(t.as_py(), width)
                fp.append(majority(h) if len(h) else 0)
                bands.append(band_keys(h))
                own = np.unique(h)
                n.append(len(own))
                bits.append(parity(own))
            columns = [b.column(0), b.column(1), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(bands, pa.list_(pa.int64())), pa.array(n, pa.int64()), pa.array(bits, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["rid", "id", "fp", "bands", "n", "parity"])

    return docs.select(F.monotonically_increasing_id().alias("rid"), id_col, text_col).mapInArrow(run, f"rid bigint, id {kind}, fp bigint, bands array<bigint>, n bigint, parity binary")


def candidates(marked: DataFrame, budget: int) -> DataFrame:
    """Distinct pairs a < b of rows that may be near copies."""
    entries = marked.select("rid", "id", F.posexplode("bands").alias("band", "key")).withColumn("place", F.struct(F.xxhash64("band", "id").alias("h"), "rid"))
    hubs = entries.groupBy("band", "key").agg(F.min("place").alias("low"), F.max("place").alias("high")).filter("low.rid <> high.rid")
    hubs = hubs.select("band", "key", F.explode(F.array("low.rid", "high.rid")).alias("hub"))
    found = entries.select("rid", "band", "key").join(hubs, ["band", "key"]).select("hub", "rid")
    classes = materialise(marked.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "rid")).alias("best")).select("fp", F.col("best.rid").alias("first")), "nearfp")
    links = link_edges(classes.select("fp"), budget)
    links = links.join(classes.select(F.col("fp").alias("a"), F.col("first").alias("hub")), "a").join(classes.select(F.col("fp").alias("b"), F.col("first").alias("rid")), "b").select("hub", "rid")
    same = marked.join(classes, "fp").select(F.col("first").alias("hub"), "rid")
    every = found.unionAll(links).unionAll(same).filter("hub <> rid")
    return every.select(F.least("hub", "rid").alias("a"), F.greatest("hub", "rid").alias("b")).distinct()


def apart(root: np.ndarray, n: np.ndarray, bits: np.ndarray, left: np.ndarray | None, least: float, chunk: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i, j of rows of different classes that may be similar, by sizes and parity bits.

    left: which rows are the first block; None: there is one block, compared with itself.
    """
    one = np.arange(len(n)) if left is None else np.flatnonzero(left)
    other = one if left is None else np.flatnonzero(~left)
    other = other[np.argsort(n[other], kind="stable")]
    sizes, room = n[other], (1 - least) / (1 + least)
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    step = max(1, chunk // max(1, len(other)))
    one = one[np.argsort(n[one], kind="stable")]
    for s in range(0, len(one), step):
        i = one[s : s + step]
        window = other[np.searchsorted(sizes, np.floor(least * n[i[0]])) : np.searchsorted(sizes, np.ceil(n[i[-1]] / least), "right")]
        live = root[i][:, None] != root[window][None, :]
        if left is None:
            live &= i[:, None] < window[None, :]
        x, y = np.nonzero(live)
        x, y = i[x], window[y]
        ok = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1) <= room * (n[x] + n[y]) + 1e-6
        found.append((x[ok], y[ok]))
    return tuple(np.concatenate(v) for v in zip(*found))


def remaining(marked: DataFrame, roots: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """Distinct pairs a < b of rows that share a bucket, are in different classes yet, and may be near copies.

    A bucket of more than ``block`` rows is dealt to parts by hash, and each two parts are one group.
    """
    rooted = marked.join(roots.withColumnRenamed("node", "rid"), "rid", "left").select("rid", F.coalesce("root", "rid").alias("root"), "bands")
    entries = rooted.select("rid", "root", F.explode("bands").alias("key"))
    open_ = entries.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("rows")).filter("rows > 3 and low <> high").select("key", "rows")
    found = join_spread(entries, open_, "key", "rows", "rid")
    parts = F.ceil(F.col("rows") / block).cast("int")
    dealt = found.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("rid"), "parts").cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("rid", "root", "key", F.least("part", "with").alias("lo"), F.greatest("part", "with").alias("hi"), "part").join(marked.select("rid", "n", "parity"), "rid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            t = pa.Table.from_batches(held)
            rid, root, n, part = (t.column(c).to_numpy() for c in ("rid", "root", "n", "part"))
            bits = np.frombuffer(b"".join(t.column("parity").to_pylist()), np.uint64).reshape(len(rid), -1)
            i, j = apart(root, n, bits, None if now[1] == now[2] else part == now[1], least)
            a, b = np.minimum(rid[i], rid[j]), np.maximum(rid[i], rid[j])
            for s in range(0, len(a), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(a[s : s + (1 << 16)]), pa.array(b[s : s + (1 << 16)])], names=["a", "b"])

        for b in batches:
            group = np.stack([b.column(c).to_numpy().astype(np.int64) for c in ("key", "lo", "hi")], axis=1)
            cuts = [0, *(np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1).tolist(), len(group)] if len(group) else []
            for i, j in zip(cuts[:-1], cuts[1:]):
                key = tuple(group[i].tolist())
                if key != now:
                    yield from flush()
                    held, now = [], key
                held.append(b.slice(i, j - i))
        yield from flush()

    return dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(run, "a bigint, b bigint").distinct()


def verified(docs: DataFrame, pairs: DataFrame, width: int, least: float, text_col: str) -> DataFrame:
    """The pairs of which the shingle sets are similar; only the texts in a pair are cut into shingles again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(shingles(t.as_py(), width)).view(np.int64) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["rid", "words"])

    asked = pairs.select(F.explode(F.array("a", "b")).alias("rid")).distinct()
    sets = materialise(docs.select(F.monotonically_increasing_id().alias("rid"), text_col).join(asked, "rid").mapInArrow(run, "rid bigint, words array<bigint>"), "nearsets")
    one, other = (sets.select(F.col("rid").alias(c), F.col("words").alias(f"words_{c}")) for c in "ab")
    both = pairs.join(one, "a").join(other, "b").withColumn("shared", F.size(F.array_intersect("words_a", "words_b")))
    every = F.size("words_a") + F.size("words_b") - F.col("shared")
    return both.filter((every == 0) | (F.col("shared") >= least * every)).select("a", "b")


def near_copies(docs: DataFrame, width: int = 5, least: float = 0.8, budget: int = 4, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """rid, id, root, keeper of the rows that are a near copy of another; the keeper has the smallest id of its class, null ids last."""
    marked = materialise(sketches(docs, width, id_col, text_col), "near")
    pairs = materialise(candidates(marked, budget), "nearpairs")
    roots = components(verified(docs, pairs, width, least, text_col))
    more = materialise(remaining(marked, roots, least, block), "nearmore")
    links = verified(docs, more, width, least, text_col)
    roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(links))
    grouped = roots.select(F.col("node").alias("rid"), "root").join(marked.select("rid", "id"), "rid")
    best = grouped.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "rid")).alias("best"), F.count("*").alias("n"))
    return join_spread(grouped, best, "root", "n", "rid").select("rid", F.col("id").alias(id_col), "root", (F.col("rid") == F.col("best.rid")).alias("keeper"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each class of near copies; docs must be a plan that repeats, such as a table scan."""
    id_col = options.get("id_col", "doc_id")
    return without(docs, near_copies(docs, **options).filter(~F.col("keeper")).select("rid", id_col), id_col)
