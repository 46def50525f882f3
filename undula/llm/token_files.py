"""Token-id files of patched frame-of-reference blocks."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from undula.llm.chunks import encoder, in_blocks
from undula.llm.common import broadcast_if_small

#: Ids in a block, and the share of a block's ids that its width must hold; the rest are exceptions.
BLOCK, SHARE = 2048, 0.95
#: A segment, one row of the file, is closed once it holds so many ids.
SEGMENT_IDS = 1 << 20
#: Chunks whose ids a Python worker keeps, about 250 MB.
CACHED = 1_200_000

SEGMENT = "shard int, segment int, n_docs long, n_ids long, doc_ids binary, null_ids binary, doc_lengths binary, block_starts binary, payload binary"


def pack(ids: np.ndarray) -> tuple[bytes, bytes]:
    """Blocks of `ids` (unsigned 32-bit), one after the other, and the byte at which each starts (unsigned 64-bit).

    A block: count, minimum and number of exceptions (unsigned 32-bit each), width (8-bit), the differences from the
    minimum cut to that width and packed by bits, then the exceptions' places (16-bit) and whole differences (32-bit).
    """
    parts: list[bytes] = []
    starts: list[int] = []
    at = 0
    for k in range(0, len(ids), BLOCK):
        block = ids[k : k + BLOCK]
        low = int(block.min())
        over = (block - np.uint32(low)).astype(np.uint32)
        width = int(np.partition(over, m := int(SHARE * (len(over) - 1)))[m]).bit_length()
        odd = np.flatnonzero(over >> np.uint32(width)) if width < 32 else np.empty(0, np.int64)
        bits = np.unpackbits(over.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
        head = np.array([len(block), low, len(odd)], "<u4").tobytes() + bytes([width])
        body = np.packbits(bits.reshape(-1), bitorder="little").tobytes()
        part = head + body + odd.astype("<u2").tobytes() + over[odd].astype("<u4").tobytes()
        starts.append(at)
        at += len(part)
        parts.append(part)
    return b"".join(parts), np.array(starts, "<u8").tobytes()


def unpack_block(payload: bytes, at: int) -> np.ndarray:
    """The ids of the block that starts at byte `at`."""
    count, low, odd = np.frombuffer(payload, "<u4", 3, at).tolist()
    width, at = payload[at + 12], at + 13
    size = (count * width + 7) // 8
    bits = np.unpackbits(np.frombuffer(payload, np.uint8, size, at), bitorder="little", count=count * width).reshape(count, width)
    whole = np.zeros((count, 32), np.uint8)
    whole[:, :width] = bits
    over = np.packbits(whole, axis=1, bitorder="little").view("<u4").reshape(-1).copy()
    at += size
    places = np.frombuffer(payload, "<u2", odd, at)
    over[places] = np.frombuffer(payload, "<u4", odd, at + 2 * odd)
    return over + np.uint32(low)


def unpack(payload: bytes, block_starts: bytes) -> np.ndarray:
    starts = np.frombuffer(block_starts, "<u8").tolist()
    return np.concatenate([unpack_block(payload, at) for at in starts]) if starts else np.empty(0, np.uint32)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, space: bool = True, shards: int | None = None) -> None:
    """Encode `docs` (doc_id, text) and write the ids under `path`, in ascending doc_id order over all shards.

    Each document's ids are followed by `end_id`. Null texts are empty, null doc_ids come first, rows that share a doc_id
    stand by text, equal rows stay apart; other columns are ignored. The files are Parquet rows, one for a segment of
    about a million ids: the documents' ids and lengths, the packed blocks and the index of block starts.
    """
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        # By the text's beginning, too, so that many rows of one doc_id, or without any, are dealt to several shards.
        .repartitionByRange(shards, F.col("doc_id").asc_nulls_first(), F.substring("text", 1, 64))
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
        .withColumn("shard", F.spark_partition_id())
        .select("shard", "doc_id", F.col("doc_id").isNull().alias("no_id"), "text")
    )
    end = np.array([end_id], "<u4").tobytes()

    def segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer, space, CACHED)
        held: list[tuple[int, bool, bytes]] = []
        size = number = shard = 0

        def closed() -> pd.DataFrame:
            payload, starts = pack(np.frombuffer(b"".join(h[2] for h in held), "<u4"))
            columns = [np.array([h[0] for h in held], "<i8"), np.array([h[1] for h in held], np.uint8), np.array([len(h[2]) // 4 for h in held], "<u8")]
            return pd.DataFrame([[shard, number, len(held), size, *(c.tobytes() for c in columns), starts, payload]], columns=[c.split()[0] for c in SEGMENT.split(", ")])

        for batch in batches:
            shard = int(batch["shard"].iloc[0]) if len(batch) else shard
            texts = batch["text"].tolist()
            keys = list(zip(batch["doc_id"].fillna(0).astype("int64").tolist(), batch["no_id"].tolist(), strict=True))
            for block in in_blocks(texts):
                for (doc_id, no_id), ids in zip(keys[block], enc.encode(texts[block]), strict=True):
                    held.append((doc_id, no_id, ids + end))
                    size += len(ids) // 4 + 1
                    if size >= SEGMENT_IDS:
                        yield closed()
                        held, size, number = [], 0, number + 1
        if held:
            yield closed()

    ordered.mapInPandas(segments, SEGMENT).write.option("compression", "uncompressed").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Every document of the files at `path`: doc_id, start (ids of all documents before it), n_tokens, ids (binary).

    The ids are little-endian unsigned 32-bit. Starts come from the segments' sizes: summed within each shard by a window,
    and over the shards, of which there are as many as the write had tasks, on the driver.
    """
    rows = spark.read.schema(SEGMENT).parquet(path)
    earlier = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    within = rows.select("shard", "segment", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)).alias("within"))
    shards = sorted(rows.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect())
    starts = [0, *accumulate(r.n for r in shards)]
    firsts = spark.createDataFrame([(r.shard, at) for r, at in zip(shards, starts, strict=False)], "shard int, first long")
    bases = within.join(F.broadcast(firsts), "shard").select("shard", "segment", (F.col("first") + F.col("within")).alias("base"))
    bases = broadcast_if_small(bases)

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                ids = unpack(r.payload, r.block_starts)
                lengths = np.frombuffer(r.doc_lengths, "<u8").astype(np.int64)
                ends = np.cumsum(lengths)
                missing = np.frombuffer(r.null_ids, np.uint8).astype(bool)
                doc_ids = pd.Series(np.frombuffer(r.doc_ids, "<i8"), dtype="Int64").mask(missing)
                raw = [ids[b - n : b].tobytes() for b, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pd.DataFrame({"doc_id": doc_ids, "start": r.base + ends - lengths, "n_tokens": lengths, "ids": raw})

    return rows.join(bases, ["shard", "segment"]).mapInPandas(documents, "doc_id long, start long, n_tokens long, ids binary")


def digest(documents: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids' bytes."""
    return documents.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def crc32_of(ids: list[int]) -> int:
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())
