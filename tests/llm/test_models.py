"""LM scores and vector links against plain versions."""

import math
import random
import re
from collections import Counter

import numpy as np

from tracewell.llm import hnsw, lmscore

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_scores(docs, good, mu):
    toks = [WORD.findall((t or "").lower()) for _, t in docs]
    target = [i in good for i, _ in docs]
    vocab = {w for t in toks for w in t}

    def model(skip, want):
        uni, two, ctx = Counter(), Counter(), Counter()
        for k, t in enumerate(toks):
            if target[k] == want and k != skip:
                for a, b in zip(["^", *t], t):
                    uni[b] += 1
                    two[a, b] += 1
                if t:
                    ctx["^"] += 1
                for w in t:
                    ctx[w] += 1
        return uni, two, ctx

    out = []
    for k, t in enumerate(toks):
        ce = []
        for want in (True, False):
            uni, two, ctx = model(k, want)
            n = sum(uni.values())
            loss = 0.0
            for a, b in zip(["^", *t], t):
                p1 = (uni[b] + 1) / (n + len(vocab))
                loss -= math.log((two[a, b] + mu * p1) / (ctx[a] + mu))
            ce.append(loss / len(t) if t else None)
        out.append((docs[k][0], len(t), *ce))
    return out


def test_scores(spark):
    rnd = random.Random(2)
    docs = [(i, " ".join(rnd.choice("der die das the of and x y z".split()) for _ in range(rnd.randint(1, 30)))) for i in range(25)] + [(50, None), (51, ""), (52, "?!"), (None, "der the")]
    labels = [(0, 1, 0), (1, 1, 1), (2, 0, 0), (3, 1, None), (3, 1, 0), (4, None, 0), (99, 1, 0), (None, 1, 0), (5, 1, 0), (5, 1, 1)]
    d = spark.createDataFrame([(a, b, True) for a, b in docs], "doc_id long, text string, good boolean")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = sorted(brute_scores(docs, {0, 3}, 8.0), key=str)
    for size in (8 << 20, 200):
        got = sorted(((r.doc_id, r.n_tokens, r.ce_target, r.ce_background) for r in lmscore.cross_entropy_difference(d, lab, block_bytes=size, bucket_bytes=size).collect()), key=str)
        assert [g[:2] for g in got] == [w[:2] for w in want]
        for g, w in zip(got, want):
            assert all((x is None) == (y is None) and (x is None or abs(x - y) < 1e-9) for x, y in zip(g[2:], w[2:])), (g, w)
    assert lmscore.cross_entropy_difference(d.limit(0), lab).count() == 0
    assert lmscore.cross_entropy_difference(d, lab.limit(0)).count() == len(docs)


def brute_links(ids, x, least=0.95):
    ok = np.array([v is not None and len(v) == 8 and None not in v and np.isfinite(v).all() and any(v) for v in x])
    m = np.array([v if k else [1] * 8 for v, k in zip(x, ok)], np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    near = (m @ m.T >= least) & ok[:, None] & ok[None, :]
    np.fill_diagonal(near, False)
    label = list(ids)
    for _ in range(len(ids)):
        new = [min([label[a], *(label[b] for b in np.flatnonzero(near[a]))]) for a in range(len(ids))]
        if new == label:
            break
        label = new
    return sorted((i, int(n), c, i == c) for i, n, c in zip(ids, near.sum(1), label))


def test_links(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = []
    for _ in range(60):
        c = rng.normal(size=8)
        x += [(c + rng.normal(size=8) * rng.choice([0, 0.02, 0.1, 0.2])).astype(np.float32).tolist() for _ in range(rng.integers(1, 12))]
    c = rng.normal(size=8)
    x += [(c + rng.normal(size=8) * 0.03).astype(np.float32).tolist() for _ in range(150)] + [x[0]] * 40
    x += [None, [], [0.0] * 8, [float("nan")] + [1.0] * 7, [float("inf")] + [1.0] * 7, [None] + [1.0] * 7, [3e38] * 8, [1e-38] * 8]
    ids = rng.permutation(len(x)).tolist()
    d = spark.createDataFrame([(i, v, 1, 2) for i, v in zip(ids, x)], "vec_id long, embedding array<float>, cls int, label int")
    got = sorted(tuple(r) for r in hnsw.near_vectors(d, shard=100, queries=200).select("vec_id", "n_links", "component_id", "kept").collect())
    want = brute_links(ids, x)
    assert sum(g == w for g, w in zip(got, want)) >= 0.98 * len(want)
    assert sum(g[1] for g in got) >= 0.98 * sum(w[1] for w in want) and all(g[1] <= w[1] for g, w in zip(got, want))
    assert hnsw.near_vectors(d.limit(0)).count() == 0


def test_double_vectors(spark):
    """Doubles far beyond floats, repeated and null ids, hot copies."""
    rows = [(1, [1e39, 2e39]), (2, [1e39, 2e39]), (3, [1e-46, 2e-46]), (4, [-1.0, 0.0]), (4, [-1.0, 0.0]), (None, [-1.0, 0.0]), (5, [float("nan"), 1.0]), (6, [0.0, 0.0]), (7, None), (8, [1.0])]
    got = hnsw.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    want = [(1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 2, 4), (4, 2, 4), (None, 2, 4), (5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 0, 8)]
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == sorted(want, key=str)


def test_many_blocks_pass_by_a_graph(spark):
    """One query a block: copies of the graphs for all blocks together (6 GB) are more than the heap holds."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(500, 3072))
    x[1::2] = x[::2] + 0.1 * rng.normal(size=(250, 3072))  # links are pairs of an even and the next id
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = hnsw.near_vectors(d, queries=1).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == [(i, 1, i - i % 2, i % 2 == 0) for i in range(500)]


def test_recall_on_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    m = np.array([r.embedding for r in rows], np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    near = m @ m.T >= 0.95
    want = dict(zip([r.vec_id for r in rows], near.sum(1) - 1))
    got = {r.vec_id: r.n_links for r in hnsw.op2_embedding_dedup(spark, sf).collect()}
    assert sum(got.values()) >= 0.98 * sum(want.values()) and all(got[k] <= want[k] for k in want)


def test_graph_has_no_closed_groups():
    """Tight groups larger than any neighbour list are reached from the first node, and their links found."""
    rng = np.random.default_rng(3)
    heads = rng.normal(size=(12, 32))
    groups = np.concatenate([h + 0.02 * rng.normal(size=(120, 32)) for h in heads])
    x = hnsw.unit(np.concatenate([groups, rng.normal(size=(1500, 32))])).astype(np.float32)
    g = hnsw.Graph(x)
    reached, front = {0}, [0]
    while front:
        front = sorted({int(b) for a in front for b in g.layers[0][a] if b >= 0} - reached)
        reached.update(front)
    assert len(reached) == len(x)
    true = set(zip(*(a.tolist() for a in np.nonzero(x @ g.x.T >= 0.95)), strict=True))
    got = {(a, int(b)) for a, found in g.links(x, 0.95, g.audited_width(x, 0.95)) for b in found}
    assert len(got & true) >= 0.99 * len(true)
