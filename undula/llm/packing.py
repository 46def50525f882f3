"""Packing documents into fixed-length training sequences by large-item matching."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from undula.llm.chunks import encoder, forget_encoders, in_blocks
from undula.llm.common import tidy, written

PIECES = "shard int, nth long, doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, space: bool = False, cached: int = 500_000, keep: bool = True) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32, and the piece's rank within its task's equals.

    A document is its ids and `end_id`; one longer than `capacity` is cut into pieces of that length, the last may be
    shorter. Null texts are empty, so every row gives a piece at least; rows that share a doc_id are documents of their own.
    `shard` is the task, `nth` how many pieces of the same length came before it there. A worker remembers `cached` words, from task
    to task if it may `keep` them; else it also takes fewer texts at a time.
    """
    end = np.array([end_id], "<u4").tobytes()
    source = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.spark_partition_id().alias("shard"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer, space, cached)
        seen: Counter[int] = Counter()
        for batch in batches:
            texts = batch["text"].tolist()
            doc_ids = batch["doc_id"].astype("Int64").tolist()
            shard = int(batch["shard"].iloc[0]) if len(batch) else 0
            rows = []
            for block in in_blocks(texts, 2_000_000 if keep else 500_000):
                for doc_id, ids in zip(doc_ids[block], enc.encode(texts[block]), strict=True):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        n = len(part) // 4
                        rows.append((shard, seen[n], doc_id, k, at // 4, n, zlib.crc32(part)))
                        seen[n] += 1
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")])
            yield out.assign(doc_id=out["doc_id"].astype("Int64"))
        if not keep:
            forget_encoders()

    return source.mapInPandas(tidy(cut), PIECES)


def plan(lengths: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Where the pieces go, from the count of each length: slots (length, first, bins, each, sequence, offset), and the bins.

    A slot takes the pieces of its length with ranks first .. first + bins * each - 1, `each` to a sequence one after the
    other from `offset`, into `bins` sequences from `sequence` on. Lengths above a third of the capacity come two to a
    sequence at most: the longest left is matched with the longest that still fits beside it. Shorter ones go, longest
    first, into the tightest gap that takes them, and into new sequences when none does. Work and slots depend on the
    number of distinct lengths, which the capacity bounds, not on the number of pieces.
    """
    left = {n: c for n, c in lengths.items() if c > 0}
    used: Counter[int] = Counter()
    slots: list[tuple[int, int, int, int, int, int]] = []
    gaps: list[tuple[int, int, int]] = []  # room, first sequence, sequences
    total = 0

    def put(n: int, bins: int, each: int, sequence: int, offset: int) -> None:
        slots.append((n, used[n], bins, each, sequence, offset))
        used[n] += bins * each
        left[n] -= bins * each

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        n = large[-1]
        if not left[n]:
            large.pop()
            continue
        fits = len(large)
        while fits and (large[fits - 1] > capacity - n or not left[large[fits - 1]] or (large[fits - 1] == n and left[n] < 2)):
            fits -= 1
        mate = large[fits - 1] if fits else 0
        bins = (left[n] // 2 if mate == n else min(left[n], left[mate])) if mate else left[n]
        put(n, bins, 1, total, 0)
        if mate:
            put(mate, bins, 1, total, n)
        if room := capacity - n - mate:
            insort(gaps, (room, total, bins))
        total += bins
    for n in sorted((n for n in left if left[n] and 3 * n <= capacity), reverse=True):
        while left[n]:
            k = bisect_left(gaps, (n, -1, -1))
            if k == len(gaps):
                each = capacity // n
                bins = -(-left[n] // each)
                insort(gaps, (capacity, total, bins))
                total += bins
                k = len(gaps) - 1
            room, sequence, bins = gaps.pop(k)
            each = room // n
            full = min(bins, left[n] // each)
            if full:
                put(n, full, each, sequence, capacity - room)
                if rest := room - each * n:
                    insort(gaps, (rest, sequence, full))
                sequence, bins = sequence + full, bins - full
            if bins and left[n]:  # too few to fill one more sequence
                k = left[n]
                put(n, 1, k, sequence, capacity - room)
                if rest := room - k * n:
                    insort(gaps, (rest, sequence, 1))
                sequence, bins = sequence + 1, bins - 1
            if bins:
                insort(gaps, (room, sequence, bins))
    return slots, total


def pack(cut: DataFrame, capacity: int) -> DataFrame:
    """Give every piece of `cut` (as pieces() returns them, written) its sequence_id and offset.

    The plan needs the count of each length alone: `capacity` numbers at most reach the driver, and the slots, a few for
    each length, are broadcast. Each task's pieces of a length start at the count of those in the tasks before it, so no
    task holds all pieces of a length, however many equal documents there are.
    """
    spark = cut.sparkSession
    each = cut.groupBy("shard", "length").agg(F.count("*").alias("n"))
    lengths = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots, _ = plan(lengths, capacity)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    bases = each.select("shard", "length", F.coalesce(before, F.lit(0)).alias("base"))
    places = spark.createDataFrame(slots, "length long, first long, bins long, each long, sequence long, at long")
    ranked = cut.join(bases, ["shard", "length"]).withColumn("rank", F.col("base") + F.col("nth"))
    s, within = F.broadcast(places).alias("s"), F.col("rank") - F.col("s.first")
    on = (F.col("p.length") == F.col("s.length")) & (within >= 0) & (within < F.col("bins") * F.col("each"))
    return ranked.alias("p").join(s, on).select(
        "doc_id", "piece", "start", "p.length", "ids_crc32",
        (F.col("sequence") + F.floor(within / F.col("each"))).alias("sequence_id"),
        (F.col("at") + within % F.col("each") * F.col("p.length")).alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048, cached: int = 500_000, keep: bool = True) -> DataFrame:
    """Cut, encode and pack all `docs` (doc_id, text); an empty table gives no rows. See pieces() and pack()."""
    return pack(written(pieces(docs, tokenizer, end_id, capacity, cached=cached, keep=keep), "pieces"), capacity)
