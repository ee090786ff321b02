import hashlib
import re
from collections import Counter, defaultdict

import numpy as np

from quadstrata.llm import common, exact_dedup, graph, near_copies, simhash

norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")


def test_exact_groups(docs, rows):
    got = exact_dedup.exact_dedup(docs, fan_in=2).toPandas()
    groups = defaultdict(list)
    for r in rows:
        groups[hashlib.sha256(norm(r[1]).encode()).hexdigest()].append(r)
    assert len(got) == len(rows)
    for sha, part in got.groupby("text_sha256"):
        want = groups[sha]
        assert len(part) == len(want) == part.group_size.iloc[0]
        best = min(want, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))[0]
        assert part.kept.sum() == 1
        keep = part.keep_id.iloc[0]
        assert (keep == best) or (best is None and np.isnan(keep))


def test_exact_keep_first(docs, rows, none):
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    out = kept.collect()
    assert len(out) == len({norm(r[1]) for r in rows}) and {norm(r.text) for r in out} == {norm(r[1]) for r in rows}
    assert {r.rid for r in out} == {"r"}
    assert exact_dedup.keep_first(none).count() == 0 and exact_dedup.exact_dedup(none).count() == 0


def test_ties_under_another_partitioning(docs):
    again = docs.repartition(2, "doc_id")
    for f, cols in ((exact_dedup.exact_dedup, ("doc_id", "keep_id", "group_size", "text_sha256")), (simhash.near_duplicates, ("doc_id", "fp", "component_id"))):
        one, other = (Counter(tuple(str(v) for v in r) for r in f(t).select(*cols).collect()) for t in (docs, again))
        assert one == other


def test_changed_row_numbers_stop_the_job(spark):
    import pytest

    docs = spark.range(4).selectExpr("id as doc_id", "'x' as text")
    wrong = docs.selectExpr("monotonically_increasing_id() as rid", "doc_id + 1 as doc_id")
    with pytest.raises(Exception, match="changed their numbers"):
        common.without(docs, wrong).count()
    assert common.without(docs, wrong.limit(0)).count() == 4


def brute_fingerprint(text):
    import xxhash

    words = re.findall(rb"[^\x20\x09-\x0D]+", bytes((text or ""), "utf-8").lower())
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(links, n):
    lab = list(range(n))

    def top(x):
        while lab[x] != x:
            x = lab[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        lab[max(a, b)] = min(a, b)
    return [top(k) for k in range(n)]


def test_simhash_fingerprint_and_components(docs, rows):
    got = simhash.near_duplicates(docs).toPandas()
    assert len(got) == len(rows)
    fps = [brute_fingerprint(r[1]) for r in rows]
    ours = Counter((None if np.isnan(i) else int(i), int(f) & (2**64 - 1)) for i, f in zip(got.doc_id, got.fp))
    assert ours == Counter((r[0], f) for r, f in zip(rows, fps))
    lab = classes([(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4], len(fps))
    least = defaultdict(lambda: 10**9)
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[lab[k]] = min(least[lab[k]], r[0])
    want = {f: least.get(lab[k], None) for k, f in enumerate(fps)}
    for f, c in zip(got.fp, got.component_id):
        w = want[int(f) & (2**64 - 1)]
        assert (w is None and np.isnan(c)) or w == c
    assert got.keeper.sum() == len(set(lab))
    assert simhash.keep_one(docs).count() == len(set(lab))


def test_simhash_empty(none):
    assert simhash.near_duplicates(none).count() == 0


def test_trie_against_all_pairs():
    rng = np.random.default_rng(3)
    lengths = simhash.blocks(64, 4)
    starts = [sum(lengths[:k]) for k in range(5)]
    for n, flips in ((300, 6), (300, 3), (200, 9)):
        base = rng.integers(0, 2**64, 15, dtype=np.uint64)
        fp = np.unique(np.array([int(base[k % 15]) ^ sum({1 << int(b) for b in rng.integers(0, 64, rng.integers(0, flips + 1))}) for k in range(n)], dtype=np.uint64))
        where, links = {int(f): k for k, f in enumerate(fp)}, []
        for k in range(5):
            turned = simhash.rotate(fp, starts[k])
            block = turned >> np.uint64(64 - lengths[k])
            for b in np.unique(block):
                keys = np.unique(turned[block == b])
                back = simhash.rotate(keys, 64 - starts[k] if starts[k] else 0)
                found = simhash.trie_links(keys, lengths[k:] + lengths[:k], chunk=50)
                assert len(found) < len(keys)
                links += [(where[int(back[i])], where[int(back[j])]) for i, j in found]
        assert all(int(fp[a] ^ fp[b]).bit_count() <= 4 for a, b in links)
        brute = [(a, b) for a in range(len(fp)) for b in range(a) if int(fp[a] ^ fp[b]).bit_count() <= 4]
        assert classes(links, len(fp)) == classes(brute, len(fp))


def test_trie_dense_group_is_not_paired():
    rng = np.random.default_rng(5)
    fp = np.unique(np.array([sum(1 << int(b) for b in rng.choice(20, rng.integers(0, 6), replace=False)) for _ in range(8000)], dtype=np.uint64))
    assert len(simhash.trie_links(fp, simhash.blocks(64, 4))) == len(fp) - 1


def named_pairs(table):
    """Candidate pairs by id, of rows whose ids don't repeat."""
    from pyspark.sql import functions as F

    once = common.materialise(table.filter("doc_id > 5"), "test")
    marked = common.materialise(near_copies.sketches(once, 5, "doc_id", "text"), "test")
    p = near_copies.candidates(marked, 4)
    for c in "ab":
        p = p.join(marked.select(F.col("rid").alias(c), F.col("id").alias(f"id_{c}")), c)
    return p.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).collect()


def test_near_copies_against_all_pairs(spark, docs, rows, none, tmp_path):
    rng = np.random.default_rng(11)
    data, words = list(rows), [f"w{k}" for k in range(3000)]
    for g in range(40):  # one or a few words of a hundred replaced: similarity about 0.5 to 0.9
        base = rng.choice(words, 100)
        for k in range(3):
            w = base.copy()
            w[rng.choice(100, k * (1 + g % 3), replace=False)] = f"edit{g}"
            data.append((1000 + 3 * g + k, " ".join(w), "en", "s1", None, "r", "s", "p", "b"))
    table = docs.unionByName(spark.createDataFrame(data[len(rows) :], docs.schema))
    table.write.parquet(path := str(tmp_path / "documents.parquet"))
    table = spark.read.parquet(path)
    sets = [frozenset(simhash.shingles(r[1], 5).tolist()) for r in data]
    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if not (sets[a] or sets[b]) or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    lab = classes(pairs, len(sets))
    got = near_copies.near_copies(table)
    assert got.filter("not keeper").count() == len(data) - len(set(lab))
    pairs = lambda t: {(r.a, r.b) for r in named_pairs(t)}
    assert pairs(table) == pairs(table.repartition(3, "text"))  # the hubs don't depend on how rows are dealt


def test_near_copies_beside_the_hubs(spark, tmp_path):
    """Chains of texts that share most of themselves: two hubs of a bucket don't join them, and its blocks must."""
    rng = np.random.default_rng(3)
    data, words = [], [f"w{k}" for k in range(5000)]
    for g in range(6):
        w = rng.choice(words, 130)
        for k in range(40):
            data.append((1000 * g + k, " ".join(w)))
            w = w.copy()
            w[rng.choice(130, 1 + g % 3, replace=False)] = rng.choice(words, 1 + g % 3)
    spark.createDataFrame(data, "doc_id bigint, text string").repartition(3).write.parquet(path := str(tmp_path / "documents.parquet"))
    table = spark.read.parquet(path)
    sets = [frozenset(simhash.shingles(t, 5).tolist()) for _, t in data]
    lab = classes([(a, b) for a in range(len(sets)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])], len(sets))
    stay = sorted({data[k][0] for k in lab})
    marked = common.materialise(near_copies.sketches(table, 5, "doc_id", "text"), "test")
    hubs = graph.components(near_copies.verified(table, near_copies.candidates(marked, 4), 5, 0.8, "text"))
    every = [near_copies.remaining(marked, hubs, 0.8, block=b).collect() for b in (8192, 7, 1)]
    assert every[0] and all(sorted(e) == sorted(every[0]) for e in every)  # blocks of any size give the same pairs
    assert sorted(r.doc_id for r in near_copies.keep_one(table, block=7).collect()) == stay


def test_parity_bits_pass_over_no_similar_pair():
    rng = np.random.default_rng(8)
    for size in (1, 3, 20, 300, 5000):
        base = rng.integers(0, 2**64, size, dtype=np.uint64)
        sets = [np.unique(np.concatenate((base[rng.random(size) < keep], rng.integers(0, 2**64, rng.integers(0, size // 4 + 1), dtype=np.uint64)))) for keep in rng.uniform(0.7, 1, 40)]
        bits = np.frombuffer(b"".join(map(near_copies.parity, sets)), np.uint64).reshape(len(sets), -1)
        n, left = np.array(list(map(len, sets))), rng.random(len(sets)) < 0.5
        near = {(a, b) for a in range(40) for b in range(a + 1, 40) if len(np.union1d(sets[a], sets[b])) * 0.8 <= len(np.intersect1d(sets[a], sets[b]))}
        root = rng.integers(0, 30, 40)
        near = {(a, b) for a, b in near if root[a] != root[b]}
        i, j = near_copies.apart(root, n, bits, None, 0.8, chunk=50)
        assert near <= set(zip(i.tolist(), j.tolist())) and (i < j).all()
        i, j = near_copies.apart(root, n, bits, left, 0.8, chunk=50)
        assert {(a, b) for a, b in near if left[a] != left[b]} <= {(min(p), max(p)) for p in zip(i.tolist(), j.tolist())}


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 50)] + [(100, 200), (200, 150), (7, 7), (300, 300)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{k: 0 for k in range(51)}, 100: 100, 200: 100, 150: 100}
    star = [(0, k) for k in range(1, 200)] + [(k, k + 1000) for k in range(1, 200)]
    got = graph.components(spark.createDataFrame(star, "a bigint, b bigint"), most=10).collect()  # the hot node in parts
    assert len(got) == 399 and all(r.root == 0 for r in got)
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
