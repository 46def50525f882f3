"""Vector near-duplicates and exact top-k search against brute force."""

import math
from collections import Counter

import numpy as np
import pytest

from undula.llm import topk, vector_dedup
from undula.llm.components import connected_components, link

SCHEMA = "vec_id long, embedding array<float>, label int, point string, root string"


def brute_links(rows, least):
    n = len(rows)
    good = lambda e: e is not None and len(e) and all(x is not None and math.isfinite(x) for x in e) and any(e)
    vectors = [np.array(r[1], np.float32).astype(float) if r[0] is not None and r[2] is not None and good(r[1]) else None for r in rows]
    links, up = [0] * n, np.arange(n)
    for i in range(n):
        for j in range(i):
            a, b = vectors[i], vectors[j]
            if a is None or b is None or rows[i][2] != rows[j][2] or len(a) != len(b):
                continue
            if (a @ b) / (np.linalg.norm(a) * np.linalg.norm(b)) >= least:
                links[i] += 1
                links[j] += 1
                up = link(up, np.array([i]), np.array([j]))
    out = Counter()
    for i, r in enumerate(rows):
        own = min((rows[j][0] for j in range(n) if up[j] == up[i] and rows[j][0] is not None), default=None) if vectors[i] is not None else r[0]
        out[r[0], links[i], own, r[0] is not None and r[0] == own] += 1
    return out


def cloud(seed, n=220, dim=12):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(9, dim))
    rows = []
    for i in range(n):
        x = centres[draw.integers(9)] + draw.normal(size=dim) * draw.choice([0.05, 0.2, 0.3])
        rows.append((1000 - i, [float(v) for v in np.float32(x)], int(draw.integers(3)), "x", "y"))
    rows += [(2000 + i, rows[0][1], rows[0][2], "x", "y") for i in range(40)]  # copies
    rows += [rows[3], rows[3]]  # repeated rows
    odd = [None, [], [0.0] * dim, [math.nan] * dim, [math.inf, *[1.0] * (dim - 1)], [1.0, None, *[0.0] * (dim - 2)], [1.0, 2.0], [1.0, 2.0], [1e30] * dim, [1e-30] * dim]
    rows += [(3000 + i, e, 1, "x", "y") for i, e in enumerate(odd)]
    rows += [(4000, rows[0][1], None, "x", "y"), (4001, rows[0][1], None, "x", "y"), (None, rows[0][1], rows[0][2], "x", "y")]
    return rows


@pytest.mark.parametrize("seed,block,leaf", [(1, 512, 128), (2, 16, 4)])
def test_links_equal_brute_force(spark, monkeypatch, seed, block, leaf):
    monkeypatch.setattr(vector_dedup, "BLOCK", block)
    monkeypatch.setattr(vector_dedup, "LEAF", leaf)
    rows = cloud(seed)
    got = vector_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA), 0.93)
    assert Counter(map(tuple, got.collect())) == brute_links(rows, 0.93)


def test_no_vectors(spark):
    assert vector_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_components_of_a_chain_a_star_and_a_loop(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(500, i) for i in range(501, 560)]
    edges = spark.createDataFrame([*chain, *star, (7, 7), (3, 2), (2, 1), (1, 3), (2, 1), (None, 4), (4, None)], "a long, b long")
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert got == {**dict.fromkeys(range(100, 161), 100), **dict.fromkeys(range(500, 560), 500), 1: 1, 2: 1, 3: 1}


def brute_top(rows, every, k):
    good = lambda e: e is not None and len(e) and all(x is not None and math.isfinite(x) for x in e)
    codes = [[math.floor(256 * float(np.float32(x))) for x in r[1]] if r[0] is not None and good(r[1]) else None for r in rows]
    out = Counter()
    for i, r in enumerate(rows):
        if codes[i] is None or r[0] % every:
            continue
        scored = []
        for j, c in enumerate(rows):
            if j != i and codes[j] is not None and len(codes[j]) == len(codes[i]):
                s = sum(a * b for a, b in zip(codes[i], codes[j], strict=True))
                scored.append((-max(-(1 << 63), min((1 << 63) - 1, s)), c[0]))
        for n, (s, v) in enumerate(sorted(scored)[:k]):
            out[r[0], n + 1, v, -s] += 1
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_top_k_equals_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(topk, "CANDIDATES", 50)
    monkeypatch.setattr(topk, "QUERIES", 7)
    rows = cloud(seed)
    rows += [(5000, [0.0] * 12, 1, "x", "y"), (5000, [0.5] * 12, 1, "x", "y"), (5000, [-0.5] * 12, 1, "x", "y"), (-50, [1.0] * 12, 1, "x", "y")]
    got = topk.top_k(spark.createDataFrame(rows, SCHEMA), 10, 5)
    assert Counter(map(tuple, got.collect())) == brute_top(rows, 10, 5)


def test_top_k_of_nothing(spark):
    assert topk.top_k(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("seed", range(5))
def test_bounds_lose_nothing(seed):
    draw = np.random.default_rng(seed)
    vectors = np.floor(256 * draw.normal(size=(700, 40)) * (draw.random((700, 1)) ** 3))
    ids = draw.permutation(700).astype(np.int64)
    query = np.floor(256 * draw.normal(size=40))
    at, score = topk.best(query, np.ascontiguousarray(vectors.T), ids, 6, -np.inf, np.argsort(-np.abs(query)))
    want = sorted(zip(-(vectors @ query), ids, strict=True))[:6]
    assert [(-s, i) for s, i in want] == list(zip(score, ids[at], strict=True))


def test_links_through_many_levels_of_intervals(spark, monkeypatch):
    """Blocks of eight vectors in intervals of two, from two intervals a label down."""
    for name, value in (("BLOCK", 8), ("FAN", 2), ("TOP", 2)):
        monkeypatch.setattr(vector_dedup, name, value)
    rows = cloud(5, 300)
    got = vector_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA), 0.93)
    assert Counter(map(tuple, got.collect())) == brute_links(rows, 0.93)


def test_pairs_at_the_threshold_are_decided_by_the_plain_formula(spark):
    vectors = [[3.0, 4.0], [5.0, 0.0], [4.0, 3.0], [0.0, 5.0], [6.0, 8.0], [3.0, 4.0]]
    docs = spark.createDataFrame([(i, v, 1) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_dedup.near_duplicates(docs, 0.6).collect()}
    assert got == {0: (5, 0), 1: (4, 0), 2: (5, 0), 3: (4, 0), 4: (5, 0), 5: (5, 0)}


def test_top_k_of_large_components(spark):
    draw = np.random.default_rng(7)
    rows = [(i, [float(v) for v in draw.normal(size=6) * 10.0 ** draw.choice([0, 3, 9, 14, 17, 100, 290])]) for i in range(120)]
    rows += [(200 + i, [1e200] * 6) for i in range(10)] + [(300, [-1e200] * 6), (301, [float(1 << 40), 0.5, 0.0, -0.0, 3.0, 1.0])]
    good = [(i, [math.floor(256 * x) if abs(x) < 1e15 else int(256 * x) for x in v]) for i, v in rows]
    want = Counter()
    for i, q in good:
        if i % 10 == 0:
            scored = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(q, c, strict=True)))), j) for j, c in good if j != i)
            want.update((i, n + 1, j, -s) for n, (s, j) in enumerate(scored[:5]))
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 10, 5)
    assert Counter(map(tuple, got.collect())) == want


@pytest.mark.parametrize(("vectors", "numbers", "asked", "tasks"), [(0, 0, 0, 8), (10, 640, 1, 8), (50_000, 3_200_000, 1000, 24), (10**9, 64 * 10**9, 2 * 10**7, 20_000), (10**6, 4096 * 10**6, 20_000, 100)])
def test_cells_fit_a_task(vectors, numbers, asked, tasks):
    cells, slices = topk.grid(vectors, numbers, asked, tasks)
    assert cells >= 1 and slices >= 1 and numbers / cells <= topk.HELD and cells * slices <= max(2 * tasks, 2 * numbers / topk.HELD)
