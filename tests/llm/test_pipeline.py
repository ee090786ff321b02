import hashlib
import math
import re
from collections import Counter

import corpus_pipeline
from quadstrata.llm import byte_bpe, common, queries, toxicity
from tests.llm.test_dedup import classes
from tests.llm.test_text import brute_score


def test_pipeline_against_its_parts(spark, sf):
    docs = common.documents(spark, sf)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = common.materialise(stage(spark, docs, sf), name)
        assert after.columns == docs.columns
        if name == "exact_dedup":
            import re

            texts = [re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in after.collect()]
            assert len(set(texts)) == len(texts) and set(texts) == {re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in docs.collect()}
        elif name != "mix":
            assert 0.5 * docs.count() < after.count() <= docs.count()
        docs = after
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert out.count() == docs.count()


def brute_pipeline(spark, sf):
    """doc_id and token ids of what the pipeline gives, by plain loops; only the trained weights are the operator's."""
    docs = common.documents(spark, sf)
    lab = queries.labels(spark, sf)
    model = toxicity.fit(docs, lab)
    rows = [r for r in docs.select("doc_id", "text", "source").collect() if brute_score(model, r.text or "") < 0.7]
    best = {}
    for r in rows:  # exact copies
        k = re.sub(r"[\x20\x09-\x0D]", "", r.text or "")
        if k not in best or (-len(r.text or ""), r.doc_id) < (-len(best[k].text or ""), best[k].doc_id):
            best[k] = r
    rows = sorted(best.values(), key=lambda r: r.doc_id)
    words = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := words(r.text)) else set() for r in rows]
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if not (sets[a] or sets[b]) or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    lab_of = classes(pairs, len(rows))
    rows = [r for k, r in enumerate(rows) if lab_of[k] == k]
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows}
    quality = {r.doc_id: r.quality for r in lab.collect() if r.quality is not None}
    cell = {r.doc_id: (min(len(r.text or "") // max(size[r.doc_id], 1), 15), min(int(math.log2(size[r.doc_id] + 1)), 15)) for r in rows}
    seen = {}
    for r in rows:
        if r.doc_id in quality:
            g = seen.setdefault(cell[r.doc_id], [0, 0])
            g[0] += quality[r.doc_id]
            g[1] += 1
    weight = lambda i: 0.5 + 0.5 * (seen[cell[i]][0] + 1) / (seen[cell[i]][1] + 2) if cell[i] in seen else 0.75
    key = lambda i: -math.log((int(hashlib.md5(f"{i}:mix".encode()).hexdigest()[:12], 16) + 0.5) / 2**48) / weight(i)
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    total, names = {s: sum(size[r.doc_id] for r in v) for s, v in by.items()}, sorted(by)
    w = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    fixed = {}
    while True:
        left, free = 1.5 * sum(total.values()) - sum(fixed.values()), [s for s in names if s not in fixed]
        share = {s: left * w[s] / sum(w[f] for f in free) for s in free}
        over = {s: 2.0 * total[s] for s in free if share[s] > 2 * total[s]}
        if not over:
            break
        fixed |= over
    lib = byte_bpe.encoding(queries.tokenizer_path("byte_bpe_50k.tiktoken"), queries.split_pattern())
    out = Counter()
    for s, t in ({**share, **fixed}).items():
        epochs = int(t // total[s]) if total[s] else 0
        rest = math.floor(t - epochs * total[s])
        for r in sorted(by[s], key=lambda r: key(r.doc_id)):
            n = size[r.doc_id]
            taken = epochs * n + min(n, max(0, rest))
            rest -= n
            if taken:
                out[(r.doc_id, tuple(lib.encode_ordinary(r.text or "")))] += -(-taken // n)
    return out


def test_pipeline_against_brute_force(spark, sf):
    got = Counter((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, sf).select("doc_id", "ids").collect())
    assert got == brute_pipeline(spark, sf)


def test_pipeline_survives_edges(spark, docs, none, sf):
    for table in (docs, none):
        for name, stage in corpus_pipeline.STAGES:
            table = common.materialise(stage(spark, table, sf), name)
        table.count()
