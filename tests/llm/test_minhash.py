"""Near-duplicate texts against brute force."""

import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import ODD, corpus, crowded, empty
from undula.llm import minhash
from undula.llm.components import link
from undula.llm.queries import QUERIES

VOCABULARY = [f"w{i}" for i in range(400)]


def drawn(n=60, seed=1):
    """Texts of many lengths with copies, near copies in chains, and a shared passage."""
    draw = random.Random(seed)
    texts = []
    for _ in range(n):
        words = draw.choices(VOCABULARY, k=draw.choice([3, 20, 60, 200]))
        texts.append(" ".join(words))
        for _ in range(draw.choice([0, 0, 1, 4])):
            words = list(words)
            for _ in range(draw.choice([0, 1, 1, 3])):
                words[draw.randrange(len(words))] = draw.choice(VOCABULARY)
            texts.append(" ".join(words).upper() + "!")
    passage = " ".join(draw.choices(VOCABULARY, k=60))
    return texts + [f"{passage} {t}" for t in texts[:10]]


def brute(rows, tf):
    sets, nodes = [], []
    for r in rows:
        words = minhash.words_of(r.text or "")
        n = min(5, len(words))
        found = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if words else {}
        sets.append({(s, k) for s, c in found.items() for k in range(c if tf else 1)})  # the k-th of equal ones is one of its own
        nodes.append(tuple(words) or ("\x1e", r.text or ""))
    up = np.arange(len(rows))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if nodes[i] == nodes[j] or both and both >= 0.8 * len(sets[i] | sets[j]):
                up = link(up, np.array([i]), np.array([j]))
    least = {}
    for i, r in enumerate(rows):
        least[up[i]] = min(least.get(up[i], r.doc_id), r.doc_id)
    return Counter((r.doc_id, least[up[i]], least[up[i]] == r.doc_id) for i, r in enumerate(rows))


#: Equal sets of shingles with other counts, and the other way round: alike by one measure and not by the other.
REFRAINS = [f"{' '.join(VOCABULARY[:9])} {f'{" ".join(VOCABULARY[10:16])} ' * n}" for n in (2, 3, 30, 36)]


@pytest.mark.parametrize("tf", [True, False])
@pytest.mark.parametrize("block", [4, 128])
def test_classes_equal_brute_force(spark, monkeypatch, block, tf):
    monkeypatch.setattr(minhash, "BLOCK", block)
    docs = crowded(corpus(spark, ODD + REFRAINS + drawn()), "node", "bands", "bucket", "size", "root", "low")
    got = minhash.near_duplicates(docs, tf).select("doc_id", "class_id", "kept")
    assert Counter(map(tuple, got.collect())) == brute(docs.collect(), tf)


def test_counts_decide():
    a, b, c, d = (minhash.unfolded(*minhash.shingles(minhash.words_of(t))) for t in REFRAINS)
    assert len(minhash.similar_pairs([a, c])[0]) == 0 and len(minhash.similar_pairs([c, d])[0]) == 1


def test_the_query_finds_the_pairs_of_documents(spark):
    """Over 0.9 of all pairs of different texts at 0.8 or more, by brute force, and no class of its own making."""
    folder = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    class_of = {r.doc_id: r.class_id for r in QUERIES["op9_minhash"](spark, folder).collect()}
    held, by = {}, defaultdict(list)
    for r in rows:
        words = minhash.words_of(r.text or "")
        n = min(5, len(words))
        found = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if words else {}
        held[r.doc_id] = {(s, k) for s, c in found.items() for k in range(c)}
        for x in held[r.doc_id]:
            by[x].append(r.doc_id)
    common = Counter((a, b) for ids in by.values() if len(ids) > 1 for i, a in enumerate(ids) for b in ids[:i])
    pairs = {p for p, n in common.items() if n >= 0.8 * (len(held[p[0]]) + len(held[p[1]]) - n)}
    up, place = np.arange(len(rows)), {r.doc_id: i for i, r in enumerate(rows)}
    up = link(up, np.array([place[a] for a, _ in pairs]), np.array([place[b] for _, b in pairs]))
    found = sum(class_of[a] == class_of[b] for a, b in pairs)
    assert len(pairs) > 50 and found >= 0.9 * len(pairs)
    assert all(up[place[i]] == up[place[c]] for i, c in class_of.items() if held[i])


def test_a_crowded_bucket_is_compared_once_and_not_in_squares(spark, monkeypatch):
    """Of 400 near copies of one text and 40 others with its passage, blocks of 16: far fewer rows than 400 * 400 / 16."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    own = spark.createDataFrame([(i, 7, 1) for i in range(400)] + [(1000 + i, 7, 1000 + i) for i in range(40)], "node long, bucket long, root long")
    met = minhash._across(own).collect()
    assert len(met) <= 400 * 5 + 40 * 40 and {r.node for r in met} == {r.node for r in own.collect()}
    blocks = {(r.low, r.high) for r in met}
    place = {r.node: r.block for r in met}
    for i in (3, 1000, 1039):
        for j in (1000, 1020, 399):
            if i != j and (i > 999 or j > 999):
                assert (min(place[i], place[j]), max(place[i], place[j])) in blocks


def test_one_of_each_class_stays(spark):
    docs = corpus(spark, ODD + drawn(20))
    docs = docs.unionByName(docs.limit(1).selectExpr("999 AS doc_id", "* EXCEPT (doc_id)")).unionByName(docs.limit(1).selectExpr("999 AS doc_id", "'other words here' AS text", "* EXCEPT (doc_id, text)"))
    classes = minhash.near_duplicates(docs)
    kept = minhash.keep_one(docs, classes)
    assert kept.columns == docs.columns
    rows = kept.collect()
    want = {r.class_id for r in classes.collect()}
    assert len(rows) == len(want) and {r.doc_id for r in rows} == want


def test_one_of_each_class_stays_without_ids(spark):
    texts = ["a b c d", "A b, c d", "x y z", "x y z", None, "", "lone words here"]
    rows = [(None, t, "s") for t in texts] + [(5, "x y z", "s"), (5, "lone words here", "s"), (6, "a q", "s"), (6, "a q", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, own_node string").select("*", F.lit(1).alias("NODE"), F.lit(2).alias("root"))
    kept = minhash.keep_one(docs, minhash.near_duplicates(docs))
    assert kept.columns == docs.columns
    got = Counter((r.doc_id, (r.text or "").lower().replace(",", "")) for r in kept.collect())
    assert got == Counter([(None, "a b c d"), (5, "x y z"), (5, "lone words here"), (6, "a q"), (None, "")])


def test_near_copies_without_ids_are_linked(spark):
    words = VOCABULARY[:80]
    near = [*words[:40], "other", *words[41:]]
    docs = spark.createDataFrame([(None, " ".join(words)), (4, " ".join(near)), (None, " ".join(near).upper())], "doc_id long, text string")
    got = minhash.near_duplicates(docs)
    assert Counter((r.doc_id, r.class_id, r.kept) for r in got.collect()) == Counter([(None, 4, False), (None, 4, False), (4, 4, True)])
    assert [r.doc_id for r in minhash.keep_one(docs, got).collect()] == [4]


def test_nothing(spark):
    classes = minhash.near_duplicates(empty(spark))
    assert classes.collect() == [] and minhash.keep_one(empty(spark), classes).collect() == []


def test_rows_without_an_id(spark):
    docs = spark.createDataFrame([(None, "some words that nobody else has"), (1, "a b c"), (None, "A b C")], "doc_id long, text string")
    got = Counter((r.doc_id, r.class_id, r.kept) for r in minhash.near_duplicates(docs).collect())
    assert got == Counter([(None, None, False), (1, 1, True), (None, 1, False)])


@pytest.mark.parametrize("weighted", [False, True])
def test_agreement_is_the_similarity(weighted):
    draw = np.random.default_rng(4)
    elements = draw.integers(0, 2**63, 400).astype(np.uint64)
    a, b = draw.integers(0, 4, 400) * 1.0, draw.integers(0, 4, 400) * 1.0
    b[:300] = a[:300]
    if not weighted:
        a, b = np.minimum(a, 1), np.minimum(b, 1)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    k = 4000
    found = minhash.signatures(np.concatenate([elements[a > 0], elements[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), np.repeat([0, 1], [(a > 0).sum(), (b > 0).sum()]), 2, k)
    assert abs((found[0] == found[1]).mean() - want) < 4 * np.sqrt(want * (1 - want) / k)


def test_similar_pairs_equal_sets():
    draw = np.random.default_rng(5)
    base = np.unique(draw.integers(0, 2**32, 300, dtype=np.uint64).astype(np.uint32))
    sets = [np.unique(np.concatenate([base[draw.random(len(base)) < p], draw.integers(0, 2**32, 20, dtype=np.uint64).astype(np.uint32)])) for p in draw.uniform(0.8, 1, 40)]
    i, j = minhash.similar_pairs(sets)
    want = {(x, y) for x in range(40) for y in range(x + 1, 40) if len(np.intersect1d(sets[x], sets[y])) >= 0.8 * len(np.union1d(sets[x], sets[y]))}
    assert want and set(zip(i.tolist(), j.tolist(), strict=True)) == want


def peak_of(run):
    tracemalloc.start()
    try:
        out = run()
        return out, tracemalloc.get_traced_memory()[1] / 2**20
    finally:
        tracemalloc.stop()


def test_the_check_of_long_texts_holds_a_part_of_their_shingles_at_once():
    draw = np.random.default_rng(1)
    base = draw.integers(0, 1 << 64, 12_000, np.uint64)
    sets = []
    for k in range(300):
        s = base.copy()
        s[: 4 * k] = draw.integers(0, 1 << 64, 4 * k, np.uint64)
        sets.append(np.sort(s))
    (i, j), megabytes = peak_of(lambda: minhash.similar_pairs(sets))
    # Sets k < l have all numbers but the first 4 l of each in common.
    same = {(k, m) for m in range(300) for k in range(m) if 12_000 - 4 * m >= 0.8 * (12_000 + 4 * m) - 1e-9}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == same
    assert megabytes < 100  # 27 MB of shingles


def test_a_mixed_block_of_many_texts_is_compared_in_parts():
    draw = np.random.default_rng(2)
    n = 1500
    signs = draw.integers(0, 256, (n, minhash.COORDINATES), np.uint8)
    signs[1::3] = signs[::3]  # each third text is the copy of another, the last of three has no partner
    bands = draw.integers(0, 1 << 62, (n, minhash.BANDS))
    bands[:, 1] = 5
    rows = {"bucket": 5, "low": 0, "high": 0, "block": 0, "node": np.arange(n), "bands": list(bands), "signature": [s.tobytes() for s in signs]}
    cross = pd.DataFrame(rows).assign(high=1, block=np.arange(n) % 3 % 2)
    for frame in (pd.DataFrame(rows), cross):
        parts, megabytes = peak_of(lambda frame=frame: list(minhash._paired(iter([frame]))))
        assert sorted(pd.concat(parts)["node"]) == [k for k in range(n) if k % 3 < 2]
        assert megabytes < 60
