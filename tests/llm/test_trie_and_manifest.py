"""The conversation trie and the manifest against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from tests.llm.helpers import ODD, SCHEMA, corpus, crowded, empty
from undula.llm import manifest, prefix_trie

TURNS = "conv_id long, turn long, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def trie_of(rows):
    """Every node of the trie of (conv_id, turn, role, text) rows, from lists of whole prefixes."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0, sha(f"{len(role.encode())}:{role}{text}")), (role, text)))
    own = {c: [t for _, t in sorted(x)] for c, x in own.items()}
    built = {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(own.get(c - c % 100, [])[:h] + x[h:])
    members, children = defaultdict(list), defaultdict(list)
    for c, s in built.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in children[k]) or 1
        saved[k] = (len(members[k]) - 1) * (len(k[-1][1]) if k else 0) + sum(saved[x] for x in children[k])
    return Counter(
        (min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children[k]), leaves[k], saved[k], sha(",".join(str(c) for c in sorted(m) if len(built[c]) == len(k)))) for k, m in members.items()
    )


def conversations(seed, n=260):
    """Some with many turns in common, exact copies, nulls, equal turn numbers, one very long and one that is a prefix."""
    draw = random.Random(seed)
    rows = []
    for c in range(n):
        for turn in range(draw.randint(1, 8)):
            rows.append((c, None if draw.random() < 0.05 else turn, draw.choice(["user", "assistant", None]), draw.choice(["a", "b", "éé", "", None, "😀x"])))
    rows += [(1000, t, "user", f"turn {t}") for t in range(300)] + [(c, t, "user", f"turn {t}") for c in (1100, 1200) for t in range(40)]
    rows += [(c, t, "user", "same") for c in range(5000, 5060) for t in range(7)] + [(None, 0, "user", "nobody's")] + rows[:3]
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_trie(spark, monkeypatch, seed):
    monkeypatch.setattr(prefix_trie, "BLOCK", 8)
    monkeypatch.setattr(prefix_trie, "SPAN", 7)
    rows = conversations(seed)
    found = prefix_trie.history_trie(crowded(spark.createDataFrame(rows, TURNS), "pos", "digest", "cls", "node"))
    assert found.columns == prefix_trie.NODE
    assert Counter(map(tuple, found.collect())) == trie_of(rows)


def test_trie_of_one_kind_and_of_nothing(spark):
    for rows in ([(7, 0, "user", "x")], [(c, t, "user", "x") for c in (3, 4, 5) for t in range(6)], [(100, 0, "u", "x"), (101, 0, "u", "y")]):
        assert Counter(map(tuple, prefix_trie.history_trie(spark.createDataFrame(rows, TURNS)).collect())) == trie_of(rows)
    for rows in ([], [(None, 1, "user", "x")]):
        assert prefix_trie.history_trie(spark.createDataFrame(rows, TURNS)).collect() == []


def leaf(r):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, r.text)))


def levels(digests):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def way(tree, i):
    for row in tree[:-1]:
        run = row[i // 3 * 3 : i // 3 * 3 + 3]
        yield i % 3, run
        i //= 3


def proofs(rows):
    sources = defaultdict(list)
    for r in rows:
        sources[r.source].append(r)
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        sources[s].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r)))
    trees = [levels([leaf(r) for r in sources[s]]) for s in names]
    top = levels([t[-1][0] for t in trees])
    out = Counter()
    for j, s in enumerate(names):
        for i, r in enumerate(sources[s]):
            digest = own = leaf(r)
            if zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 2 == 0 and r.text is not None:
                digest = leaf(type(r)(**{**r.asDict(), "text": r.text.replace("\n", "")}))
            siblings = ""
            for k, run in [*way(trees[j], i), *way(top, j)]:
                siblings += "".join(run[:k] + run[k + 1 :])
                digest = sha("".join([*run[:k], digest, *run[k + 1 :]]))
            out[r.doc_id, own, trees[j][-1][0], top[-1][0], sha(siblings), digest, digest == top[-1][0]] += 1
    return out


@pytest.mark.parametrize("height", [1, 2])
def test_manifest(spark, monkeypatch, height):
    monkeypatch.setattr(manifest, "TASK", 50)
    monkeypatch.setattr(manifest, "HEIGHT", height)
    docs = crowded(corpus(spark, ODD * 6 + [f"line {i}\nend" for i in range(90)]), "place", "size", "leaf", "tree")
    odd = docs.limit(3).selectExpr("cast(null as long) as doc_id", "text", "lang", "cast(null as string) as source", "* except (doc_id, text, lang, source)")
    lone = docs.limit(1).selectExpr("doc_id", "text", "cast(null as string) as lang", "'é lone' as source", "cast(null as long) as n_chars", "* except (doc_id, text, lang, source, n_chars)")
    hot = docs.limit(1).selectExpr("doc_id", "text", "lang", "'hot' as source", "* except (doc_id, text, lang, source)", "explode(sequence(1, 100)) as copy").drop("copy")
    docs = docs.unionByName(odd).unionByName(lone).unionByName(hot)
    found = manifest.prove(docs)
    assert found.dtypes == [tuple(c.split()) for c in manifest.PROVEN.replace("long", "bigint").split(", ")]
    assert Counter(map(tuple, found.collect())) == proofs(docs.collect())


@pytest.mark.parametrize("n", [1, 2, 3, 4, 10, 28, 82])
def test_manifest_of_one_source(spark, n):
    docs = spark.createDataFrame([(i, f"a\n{i}", "en", "s", 3) for i in range(n)], SCHEMA)
    assert Counter(map(tuple, manifest.prove(docs).collect())) == proofs(docs.collect())


def test_manifest_of_many_sources(spark):
    docs = spark.createDataFrame([(i, f"a\n{i}", "en", f"s{i % 31}", 3) for i in range(70)], SCHEMA)
    assert Counter(map(tuple, manifest.prove(docs).collect())) == proofs(docs.collect())


def test_manifest_of_nothing(spark):
    assert manifest.prove(empty(spark)).collect() == []
