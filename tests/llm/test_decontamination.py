"""Windows of test items in documents against a plain search."""

import hashlib
import re
from collections import Counter

import pytest

from tests.llm.helpers import corpus, crowded, empty
from undula.llm import decontamination as dc

UPPER = {c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
ITEM = "one two THREE four five six Seven eight nine ten eleven twelve"
ITEMS = [(1, ITEM), (2, "one two three four five six seven eight nine ten"), (30, "short item"), (4, ""), (5, None), (6, "ÉCOLE straße 日本 x y z a b c d e"), (None, "no id here"), (7, "zz")]
TEXTS = [
    ITEM, f"before, {ITEM.upper()}! and after", "one two three four five six seven eight nine", "a short item. Another SHORT-ITEM", None, "", "...", "x" * 5000, "ÉCOLE straße 日本 x y z a b c d e", "École straße 日本 x y z a b c d e",
    "zz zz zz", f"{ITEM} {ITEM}", "one two three four five six seven eight nine ten one two three four five six seven eight nine ten", "word " * 3000 + ITEM, "no id here", "\n\tno\nid  here zz",
]


def items(spark, rows=ITEMS):
    return spark.createDataFrame(rows, "item_id long, text string")


def words(text):
    return re.findall(dc.WORD, "".join(UPPER.get(c, c) for c in text or ""))


def hits(text, rows=ITEMS, n=10):
    w, found, named = words(text), set(), set()
    for item, t in rows:
        own = words(t)
        size = min(n, len(own))
        for i in range(len(own) - size + 1 if size else 0):
            for k in range(len(w) - size + 1):
                if w[k : k + size] == own[i : i + size]:
                    found.update(range(k, k + size))
                    named.add("" if item is None else str(item))
    return w, found, named


def expected(row, rows=ITEMS):
    w, found, named = hits(row.text, rows)
    return row.doc_id, len(w), len(found), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(found)


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_every_occurrence_is_found(spark, monkeypatch, most):
    monkeypatch.setattr(dc, "MOST_BROADCAST", most)
    docs = crowded(corpus(spark, TEXTS), "words", "start", "hash", "list", "key_a", "item_id")
    docs = docs.unionByName(docs.limit(2).selectExpr("cast(null as long) as doc_id", "* except (doc_id)"))
    found = dc.find_contamination(docs, crowded(items(spark), "size", "gram"))
    assert Counter(map(tuple, found.collect())) == Counter(expected(r) for r in docs.collect())


def test_rows_of_one_item_are_one_item(spark):
    rows = [(1, "aa bb"), (1, "cc dd"), (2, "aa bb")]
    docs = corpus(spark, ["aa bb cc dd", "cc dd"])
    found = dc.find_contamination(docs, items(spark, rows))
    assert Counter(map(tuple, found.collect())) == Counter(expected(r, rows) for r in docs.collect())


def test_nothing_to_find(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.find_contamination(empty(spark), items(spark)).collect() == []
    assert all(r.n_hit == r.n_items == 0 and not r.contaminated and r.items_sha256 == hashlib.sha256(b"").hexdigest() for r in dc.find_contamination(corpus(spark, TEXTS), none).collect())


def without(text):
    """The text without its hit words and what follows each up to the next word."""
    _, found, _ = hits(text)
    pieces = re.findall(dc.PIECE, text)
    return text[: len(text) - len("".join(pieces))] + "".join(p for i, p in enumerate(pieces) if i not in found)


def test_spans_are_removed(spark):
    docs = crowded(corpus(spark, TEXTS), "key_a", "_key_a", "hit_spans", "lead")
    left = dc.decontaminate(docs, items(spark))
    assert left.columns == docs.columns
    assert Counter(map(tuple, left.collect())) == Counter((r.doc_id, None if r.text is None else without(r.text), *r[2:]) for r in docs.collect())


def test_documents_are_removed(spark):
    docs = corpus(spark, TEXTS)
    left = dc.decontaminate(docs, items(spark), "documents")
    assert Counter(map(tuple, left.collect())) == Counter(tuple(r) for r in docs.collect() if not hits(r.text)[1])
    most = dc.decontaminate(docs, items(spark), "documents", least=0.5)
    assert Counter(map(tuple, most.collect())) == Counter(tuple(r) for r in docs.collect() if not hits(r.text)[1] or len(hits(r.text)[1]) < 0.5 * len(words(r.text)))
    with pytest.raises(ValueError):
        dc.decontaminate(docs, items(spark), "words")


def test_no_python_worker_on_the_way(spark):
    plan = dc.find_contamination(corpus(spark, TEXTS), items(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
