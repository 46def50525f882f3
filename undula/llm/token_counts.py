"""Token counts of whole texts: pieces of distinct pre-tokens, joined to the documents' pre-token frequencies."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undula.llm.chunks import in_blocks
from undula.llm.common import tidy, written

#: The mark that sentencepiece writes for a space.
MARK = "▁"
#: No piece of the vocabulary goes on after a letter with something else than a letter, or the other way round, and none has
#: the mark after another character; so pieces never cross these pre-tokens' ends. check_boundaries() holds a model to it.
PRE_TOKEN = regex.compile(rf"{MARK}*(?:\p{{L}}+|[^\p{{L}}{MARK}]+|\Z)")
#: A pre-token of more bytes is known by its 128-bit hash behind a mark that no pre-token has there, so that every key is short.
KEY_BYTES = 48
#: The frequent pre-tokens are those of so many uses that there are HEAD_SIZE of them at most; about 20 MB in memory. They
#: alone are broadcast.
HEAD_SIZE = 200_000
FREQUENCIES = "doc long, doc_id long, n_bytes long, token string, whole string, uses long"


def check_boundaries(model: str) -> None:
    """Raise ValueError if a piece of the model crosses the end of a pre-token, its text is changed before it is cut, or it
    has no pieces for bytes: then unknown characters would join each other over a pre-token's end."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    for i in range(sp.vocab_size()):
        p = sp.id_to_piece(i)
        if sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i):
            continue
        body = p.lstrip(MARK)
        if MARK in body or len({c.isalpha() for c in body}) > 1:
            raise ValueError(f"piece {p!r} crosses a pre-token's end")
    if sum(sp.is_byte(i) for i in range(sp.vocab_size())) < 256:
        raise ValueError("the model has no pieces for bytes")
    if sp.encode_as_pieces("  a  ﬁ  ")[0][0] != MARK or "".join(sp.encode_as_pieces("a  ﬁ ")) != f"{MARK}a{MARK}{MARK}ﬁ{MARK}":
        raise ValueError("the model changes texts before it cuts them")


def pre_tokens(text: str) -> Counter[str]:
    """How often each pre-token occurs in a text as the model sees it: a mark first, spaces as marks; none in an empty text."""
    found = Counter(PRE_TOKEN.findall(MARK + text.replace(" ", MARK))) if text else Counter()
    found.pop("", None)
    return found


def frequencies(docs: DataFrame) -> DataFrame:
    """doc, doc_id, n_bytes, token, whole and uses: how often each document has each pre-token, cut and counted where the text
    is read. `doc` numbers the rows, so that equal ones stay apart; `whole` is a long pre-token's text, `token` then its hash.
    A document without pre-tokens has a row without one."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for block in in_blocks(texts, 1_000_000):
                found = [pre_tokens(t) for t in texts[block]]
                sizes = np.array([max(1, len(c)) for c in found])
                tokens = list(chain.from_iterable(c or [None] for c in found))
                uses = list(chain.from_iterable(c.values() or [0] for c in found))
                whole: list[str | None] = [None] * len(tokens)
                for i, t in enumerate(tokens):
                    if t is not None and 4 * len(t) > KEY_BYTES and len(raw := t.encode()) > KEY_BYTES:
                        tokens[i], whole[i] = f"x{MARK}" + xxhash.xxh3_128_hexdigest(raw), t
                own = batch.slice(block.start, block.stop - block.start)
                places = pa.array(np.repeat(np.arange(len(sizes)), sizes))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(row + np.arange(len(sizes)), sizes)), own.column("doc_id").take(places), own.column("n_bytes").take(places), pa.array(tokens, pa.string()), pa.array(whole, pa.string()), pa.array(uses, pa.int64())],
                    [c.split()[0] for c in FREQUENCIES.split(", ")],
                )
                row += len(sizes)

    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text")).mapInArrow(tidy(cut), FREQUENCIES)


def count_pieces(vocabulary: DataFrame, model: str) -> DataFrame:
    """token, uses and `pieces`, the length of each distinct pre-token's encoding, from (token, whole, uses)."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        before = len(sp.encode("\n"))  # a line break never joins what follows it
        for batch in batches:
            texts = batch["whole"].where(batch["whole"].notna(), batch["token"])
            ids = sp.encode(["\n" + t for t in texts], num_threads=1)
            yield pd.DataFrame({"token": batch["token"], "uses": batch["uses"], "pieces": [len(i) - before for i in ids]})

    return vocabulary.mapInPandas(tidy(counted), "token string, uses long, pieces long")


def token_counts(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of `docs` (doc_id, text), as sentencepiece counts the tokens.

    Null texts are empty and have no tokens; a null doc_id stays; rows that share a doc_id, and equal rows, are documents of
    their own; other columns are ignored; an empty table has no rows. The documents' pre-token frequencies are cut once and
    written. Each distinct pre-token of the corpus is encoded once. The frequent ones, a bounded number of short keys, are
    broadcast to the frequencies, which are summed by document where they are read; the rest, each of which is rare, meet
    their counts in a shuffle. No ids are kept anywhere.
    """
    check_boundaries(model)
    used = written(frequencies(docs), "pre-token-frequencies", compression="zstd")
    # Numbers alone are summed by hash; the few long texts are looked up apart.
    distinct = used.where("token IS NOT NULL").groupBy("token").agg(F.sum("uses").alias("uses"))
    distinct = distinct.join(used.where("whole IS NOT NULL").groupBy("token").agg(F.min("whole").alias("whole")), "token", "left")
    vocabulary = written(count_pieces(distinct, model), "pre-tokens")

    bucket = F.floor(F.log2("uses") * 8)
    sizes = {r.bucket: r.n for r in vocabulary.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")).collect()}  # at most 512 rows
    least, held = max(sizes, default=0) + 1, 0
    while least - 1 >= 0 and held + sizes.get(least - 1, 0) <= HEAD_SIZE:
        least -= 1
        held += sizes.get(least, 0)
    head = F.broadcast(vocabulary.where(bucket >= least).select("token", "pieces"))

    tokens = F.sum(F.coalesce(F.col("uses") * F.col("pieces"), F.lit(0))).alias("tokens")
    near = used.select("doc", "doc_id", "n_bytes", "token", "uses").join(head, "token", "left").groupBy("doc", "doc_id", "n_bytes").agg(tokens)
    rare = used.where("token IS NOT NULL").select("doc", "token", "uses").join(head.select("token"), "token", "left_anti")
    far = rare.join(vocabulary.where(bucket < least).select("token", "pieces"), "token").groupBy("doc").agg(tokens)
    both = near.unionByName(far, allowMissingColumns=True)
    summed = both.groupBy("doc").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("tokens").alias("n_tokens"))
    return summed.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
