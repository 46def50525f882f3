"""The pipeline's stages on odd, repeated, crowded and empty tables, each against brute force on its own input."""

import random
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.helpers import ODD
from tests.llm.test_minhash import brute
from undula.llm import language_id, mixing, toxicity

FOLDER = "/root/testdata/sf0.01"
EXTRA = ["tox_score", "lang_pred", "own_node", "node", "mix_rate", "mix_group", "piece", "length"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A part of the documents with odd texts, copies, near copies, repeated rows and ids, and no ids."""
    path = tmp_path_factory.mktemp("tables")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("doc_id % 4 = 0")
    draw = random.Random(1)
    rows = docs.where("length(text) BETWEEN 500 AND 3000").orderBy("doc_id").limit(6).collect()
    added = []
    for k, r in enumerate(rows):
        words = r.text.split(" ")
        words[draw.randrange(len(words))] = "changed"
        added += [(500_000 + k, " ".join(words), r.lang, r.source, r.n_chars), (None, r.text.upper(), r.lang, None, r.n_chars), (500_100, r.text + " and more words here", r.lang, "x", None)]
    added += [(600_000 + k, t, None, None if k % 2 else "odd", None) for k, t in enumerate(ODD)] + [(None, None, None, None, None)] * 2
    extra = spark.createDataFrame(added, docs.schema)
    both = docs.unionByName(extra).unionByName(docs.limit(3)).select("*", *(F.lit("x").alias(c) for c in EXTRA))
    both.write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{FOLDER}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.fixture(scope="module")
def stages(spark, folder):
    """Each stage's input and output rows."""
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, f in corpus_pipeline.STAGES:
        made = corpus_pipeline.written(f(spark, docs, folder), f"test-{name}")
        out[name] = (docs, made)
        docs = made
    return out


def key(r):
    return r.doc_id, r.text, r.lang, r.source, r.n_chars


def test_filters_drop_what_their_models_say(spark, folder, stages):
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    scorer = toxicity.train_on_fold(docs, labels).scorer()
    before, after = stages["toxicity"]
    assert after.columns == before.columns and set(EXTRA) <= set(after.columns)
    want = Counter(key(r) for r in before.collect() if scorer.score(r.text or "") < 0.7)
    assert Counter(key(r) for r in after.collect()) == want and 0 < before.count() - after.count() < 0.2 * before.count()
    model = language_id.train_on_fold(docs)
    before, after = stages["language"]
    rows = before.collect()
    sure = {t: s for t in {r.text for r in rows if r.text and any(c.isalpha() for c in r.text)} for s in [model.predict([t])[1][0]] if abs(s - corpus_pipeline.LEAST_SURE) > 1e-4}
    got = Counter(key(r) for r in after.collect())
    assert all((got[key(r)] > 0) == (sure[r.text] >= corpus_pipeline.LEAST_SURE) for r in rows if r.text in sure)
    assert not any(k[1] is None or not any(c.isalpha() for c in k[1]) for k in got)


def test_one_of_each_group_of_copies_stays(stages):
    before, after = stages["near_duplicates"]
    rows = before.collect()
    numbered = [r.asDict() | {"doc_id": i if r.doc_id is not None else 10**9 + i} for i, r in enumerate(rows)]

    class Row:
        def __init__(self, d):
            self.doc_id, self.text = d["doc_id"], d["text"]

    class_of = {d: c for d, c, _ in brute([Row(d) for d in numbered], True)}
    groups = defaultdict(list)
    for d, r in zip(numbered, rows, strict=True):
        groups[class_of[d["doc_id"]]].append(r)
    kept = after.collect()
    assert after.columns == before.columns and len(kept) == len(groups) < len(rows)
    want = Counter(min((r.doc_id for r in g if r.doc_id is not None), default=None) for g in groups.values())
    assert Counter(r.doc_id for r in kept) == want


def test_copies_follow_their_sources(stages):
    before, after = stages["mixing"]
    assert after.columns == before.columns
    rates = {r.mix_group: r.rate for r in mixing.rates(before, 0.5).collect()}
    got = Counter(key(r) for r in after.collect())
    assert set(got) <= {key(r) for r in before.collect()}
    for r in before.collect():
        u = int.from_bytes(bytes.fromhex("0" + __import__("hashlib").md5(f"7:{'' if r.doc_id is None else r.doc_id}:1".encode()).hexdigest()[:13]), "big") / 2**52
        m, n = rates[r.source], 0
        p = c = np.exp(-m)
        while c <= u:
            n += 1
            p = p * m / n
            c += p
        assert got[key(r)] % max(n, 1) == 0 and (got[key(r)] > 0) == (n > 0)


def test_sequences_hold_every_document(stages):
    before, after = stages["packing"]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for r in before.collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 0]
        for k, a in enumerate(range(0, len(ids), 2048)):
            want[r.doc_id, k, a, len(ids[a : a + 2048]), zlib.crc32(np.array(ids[a : a + 2048], "<u4").tobytes())] += 1
    rows = after.collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    fill = Counter()
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill[r.sequence_id]
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 2048


def test_the_pipeline_is_its_stages_and_empty_tables_come_out_empty(spark, folder, stages, tmp_path):
    name = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert Counter(map(name, corpus_pipeline.run(spark, folder).collect())) == Counter(map(name, stages["packing"][1].collect()))
    for table in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{table}.parquet").where("false").write.parquet(f"{tmp_path}/{table}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
