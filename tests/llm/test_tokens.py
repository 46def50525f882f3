"""Token counts, token files and packing against the tokenizer libraries themselves."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tests.llm.helpers import ODD, corpus, crowded, empty
from undula.llm import packing, token_counts, token_files
from undula.llm.chunks import ChunkEncoder

PIECE, BYTE, WORD = (public_tokenizers.path(p) for p in ("piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"))


def torture(n=1500):
    draw = random.Random(3)
    letters = [*" .,\n\tab'sÉ1!́ 日▁", "the", " of", *"İıÅ\u212bﬁß\u00a0\u0085\u200b\u200d\ufeff;:?", "😀", "İ.", "ﬁ,"]
    return ["".join(draw.choice(letters) for _ in range(draw.randint(0, 30))) for _ in range(n)]


@pytest.mark.parametrize("path,space", [(BYTE, True), (WORD, False)])
@pytest.mark.parametrize("limit", [10, 100_000])
def test_chunks_equal_the_library(path, space, limit):
    texts = [t or "" for t in ODD] + torture()
    library = Tokenizer.from_file(path)
    cached = ChunkEncoder(path, space, limit)
    for _ in range(2):
        got = [np.frombuffer(b, "<u4").tolist() for b in cached.encode(texts)]
        assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_counts_equal_the_library(spark, monkeypatch):
    texts = ODD + torture(300) + ["of the thing and the rest of it"] * 5
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    docs = crowded(corpus(spark, texts), "token", "pieces", "copies", "pos")
    want = Counter((r.doc_id, len((r.text or "").encode()), n := len(sp.encode(r.text or "")), n > 100) for r in docs.collect())
    for size in (0, 20, 200_000):  # all rare, some rare, none rare
        monkeypatch.setattr(token_counts, "HEAD_SIZE", size)
        assert Counter(map(tuple, token_counts.token_counts(docs, PIECE, 100).collect())) == want


def test_counts_of_nothing(spark):
    assert token_counts.token_counts(empty(spark), PIECE).collect() == []


@pytest.mark.parametrize("ids", [[], [7], [5] * 1000, [0, 2**32 - 1] * 400, list(range(3000))])
def test_blocks_round_trip(ids):
    ids = np.array(ids, np.uint32)
    payload, starts = token_files.pack(ids)
    assert token_files.unpack(payload, starts).tolist() == ids.tolist()
    offsets = np.frombuffer(starts, "<u8").tolist()
    if len(offsets) > 1:  # a block is read alone
        assert token_files.unpack_block(payload, offsets[1]).tolist() == ids[token_files.BLOCK : 2 * token_files.BLOCK].tolist()


def test_blocks_are_small():
    ids = np.random.default_rng(0).geometric(0.01, 100_000).astype(np.uint32)
    ids[::997] = 50_000
    assert len(token_files.pack(ids)[0]) < 0.35 * 4 * len(ids)


def test_files_hold_every_document_in_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT_IDS", 2000)
    docs = crowded(corpus(spark), "shard", "ids", "start")
    docs = docs.unionByName(docs.limit(1).selectExpr("cast(null as long) as doc_id", "* except (doc_id)"))
    token_files.write_token_files(docs, str(tmp_path / "f"), BYTE, 2, shards=3)
    got = sorted((tuple(r) for r in token_files.digest(token_files.read_token_files(spark, str(tmp_path / "f"))).collect()), key=lambda r: r[1])
    library = Tokenizer.from_file(BYTE)
    want, at = [], 0
    for r in sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, (r.text or "").encode())):
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.append((r.doc_id, at, len(ids), token_files.crc32_of(ids)))
        at += len(ids)
    assert got == want


def test_files_of_nothing(spark, tmp_path):
    token_files.write_token_files(empty(spark), str(tmp_path / "f"), BYTE, 2)
    assert token_files.read_token_files(spark, str(tmp_path / "f")).collect() == []


def check_packed(rows, docs, capacity, end_id):
    library = Tokenizer.from_file(WORD)
    want = Counter()
    for r in docs:
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, end_id]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want[r.doc_id, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    return len(bins)


def test_packing(spark):
    docs = crowded(corpus(spark, ODD + torture(300) + ["of the thing"] * 40), "shard", "nth", "length", "base", "rank")
    rows = packing.pack_documents(docs, WORD, 0, 64).collect()
    bins = check_packed(rows, docs.collect(), 64, 0)
    assert bins <= 1.02 * -(-sum(r.length for r in rows) // 64) + 1


def test_packing_nothing(spark):
    assert packing.pack_documents(empty(spark), WORD).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_plan_fills_sequences(seed):
    draw = random.Random(seed)
    capacity = 100
    lengths = Counter(draw.choice([draw.randint(1, 100), draw.randint(30, 70), draw.randint(1, 10)]) for _ in range(5000))
    slots, total = packing.plan(dict(lengths), capacity)
    fill, ranks = defaultdict(list), Counter()
    for n, first, bins, each, sequence, offset in slots:
        assert first == ranks[n]
        ranks[n] += bins * each
        for b in range(bins):
            fill[sequence + b] += [(offset + k * n, n) for k in range(each)]
    assert ranks == lengths and set(fill) == set(range(total))
    for parts in fill.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity and sum(3 * n > capacity for _, n in parts) <= 2
    assert total <= 1.03 * -(-sum(n * c for n, c in lengths.items()) // capacity)
