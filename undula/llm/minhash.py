"""Near-duplicate texts by DartMinHash signatures, banded joining and an exact check."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from undula.llm.common import broadcast_if_small, complete_groups, fresh_name, tidy, written
from undula.llm.components import connected_components, link

WORD = re.compile(r"\w+")
#: Words in a shingle, and the similarity from which texts are near-duplicates.
SHINGLE, LEAST = 5, 0.8
#: Coordinates of a signature and bands of it: at a similarity of 0.8 a pair shares a band in all but 0.04 % of cases.
COORDINATES, BANDS = 100, 20
#: Pairs whose signatures agree in a smaller share are not checked: 4.5 standard deviations below LEAST.
AGREE = 0.62
#: Texts of a band's bucket that are compared at once.
BLOCK = 512
#: Pairs of signatures, and numbers of shingle sets, that are held against one another at once: memory follows neither a block
#: of more texts nor the length of its texts.
PAIRS, NUMBERS = 1 << 16, 1 << 20

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def _unit(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _times(n: int, x: np.uint64) -> np.uint64:
    return np.uint64(n * int(x) % (1 << 64))


class WordHashes(dict):
    """64-bit hashes of words; remembers a bounded number, until the task ends."""

    def __missing__(self, word: str) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < 200_000:
            self[word] = value
        return value


_hashes = WordHashes()


def shingles(words: list[str], tf: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of SHINGLE words as sorted 64-bit hashes, and their weights: their counts, or 1 without `tf`.

    Fewer words make one shingle of all; no words make none.
    """
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    if not len(h):
        return h, np.empty(0)
    n = min(SHINGLE, len(h))
    x = h[: len(h) - n + 1]
    for j in range(1, n):
        x = mix(x * _A + h[j : len(h) - n + 1 + j])
    x, counts = np.unique(mix(x + _A), return_counts=True)
    return x, counts.astype(np.float64) if tf else np.ones(len(x))


def _darts(elements: np.ndarray, weights: np.ndarray, limits: np.ndarray, k: int, unit: float):
    """The darts of rank below its limit that land in each element's region: (index, rank, coordinate, dart).

    An element's darts are a Poisson process over weight and rank that its hash alone seeds. The weight axis is cut into
    [0, unit), [unit, 2 unit), [2 unit, 4 unit) and so on; in a region whose weights start below the element's, darts come
    by growing rank, and those above the element's weight miss it.
    """
    low, high, level = 0.0, unit, 0
    index = np.arange(len(elements))
    while len(index := index[weights[index] > low]):
        at, rank, throw = index, np.zeros(len(index)), 0
        seed = mix(elements[at] + _times(level, _C))
        while len(at):
            h = mix(seed + _times(throw + 1, _A))
            rank = rank - np.log(_unit(h)) / (high - low)
            near = rank < limits[at]
            at, rank, seed, h = at[near], rank[near], seed[near], h[near]
            dart = mix(h ^ _B)
            hit = low + (high - low) * _unit(mix(dart + _C)) < weights[at]
            yield at[hit], rank[hit], (dart[hit] % np.uint64(k)).astype(np.int64), dart[hit]
            throw += 1
        low, high, level = high, 2 * high, level + 1


def signatures(elements: np.ndarray, weights: np.ndarray, owners: np.ndarray, n: int, k: int = COORDINATES, unit: float = 1.0) -> np.ndarray:
    """DartMinHash signatures of n weighted sets, given as parallel arrays: for each set and coordinate the dart of least rank.

    Two sets agree in a coordinate with a chance equal to their weighted Jaccard similarity. About k ln k darts are enough
    for a set, whatever its size: that sets the limit on their rank, which doubles for sets with an empty coordinate. Sets
    without elements are all 0.
    """
    out = np.zeros((n, k), np.uint64)
    total = np.bincount(owners, weights, n)
    limit = np.divide(k * (np.log(k) + 2), total, out=np.zeros(n), where=total > 0)
    todo = total > 0
    while todo.any():
        own = todo[owners]
        e, w, o = elements[own], weights[own], owners[own]
        best, first = np.full(n * k, np.inf), np.zeros(n * k, np.uint64)
        thrown = list(_darts(e, w, limit[o], k, unit))
        at, rank, coordinate, dart = (np.concatenate(x) for x in zip(*thrown, strict=True))
        place = o[at] * k + coordinate
        np.minimum.at(best, place, rank)
        least = rank == best[place]
        first[place[least]] = dart[least]
        full = np.isfinite(best).reshape(n, k).all(1) & todo
        out[full] = first.reshape(n, k)[full]
        todo &= ~full
        limit[todo] *= 2
    return out


def unfolded(elements: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A set whose plain Jaccard similarities are the weighted ones of sets with whole weights: an element of weight w gives w
    64-bit numbers, sorted."""
    n = weights.astype(np.int64)
    nth = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)).astype(np.uint64)
    return np.sort(mix(np.repeat(elements, n) ^ mix(nth * _B)))


def band_keys(found: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A 64-bit key for each band of each signature; bands never share keys by their place."""
    parts = found.reshape(len(found), bands, -1)
    key = mix(np.arange(1, bands + 1, dtype=np.uint64) * _A)[None, :]
    for j in range(parts.shape[2]):
        key = mix(key * _A + parts[:, :, j])
    return key.view(np.int64)


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def node_of(text: str, words: list[str]) -> int:
    """A 64-bit hash of the words in their order, of the bare text if it has none: equal for texts that count as copies."""
    whole = "\x1f".join(words) if words else "\x1e" + text
    return xxhash.xxh3_64_intdigest(whole, 7) - (1 << 63)


SKETCH = "doc_id long, node long, words long, bands array<long>, signature binary"


def sketches(docs: DataFrame, tf: bool = True) -> DataFrame:
    """doc_id, node (equal for copies), words, band keys and a byte of each coordinate, for every whole text."""

    def sketched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, doc_ids = batch["text"].tolist(), batch["doc_id"].astype("Int64")
            start = 0
            while start < len(texts):
                sets, nodes, counts, held = [], [], [], 0
                while start + len(sets) < len(texts) and held < 400_000:
                    text = texts[start + len(sets)]
                    words = words_of(text)
                    sets.append(shingles(words, tf))
                    nodes.append(node_of(text, words))
                    counts.append(len(words))
                    held += len(words)
                n = len(sets)
                owners = np.repeat(np.arange(n), [len(s[0]) for s in sets])
                found = signatures(np.concatenate([s[0] for s in sets]), np.concatenate([s[1] for s in sets]), owners, n)
                keys, small = band_keys(found), (found >> np.uint64(20)).astype(np.uint8)
                yield pd.DataFrame({
                    "doc_id": doc_ids.iloc[start : start + n].to_numpy(), "node": nodes, "words": counts,
                    "bands": [k if c else k[:0] for k, c in zip(keys, counts, strict=True)], "signature": [s.tobytes() for s in small],
                }).astype({"doc_id": "Int64"})
                start += n
        _hashes.clear()

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(tidy(sketched), SKETCH)


def _paired(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of (bucket, low, high, block, node, bands, signature) rows the documents of each block pair that have a partner there
    whose signature agrees in a share of AGREE, and with whom they share no earlier band."""
    for batch, starts, ends in complete_groups(batches, ["bucket", "low", "high"]):
        bands, signs = np.stack(batch["bands"].to_numpy()), np.frombuffer(b"".join(batch["signature"]), np.uint8).reshape(len(batch), -1)
        bucket, low, high, block = (batch[c].to_numpy() for c in ("bucket", "low", "high", "block"))
        kept = np.zeros(len(batch), bool)
        for a, b in zip(starts, ends, strict=True):
            if b - a < 2:
                continue
            cross = low[a] != high[a]
            i = np.arange(a, b)[block[a:b] == low[a]] if cross else np.arange(a, b)
            j = np.arange(a, b)[block[a:b] == high[a]] if cross else i
            if not len(i) or not len(j):
                continue
            here, step = bands[i[0]].tolist().index(bucket[a]), max(1, PAIRS // len(j))
            for k in range(0, len(i), step):
                near = (signs[i[k : k + step], None] == signs[None, j]).sum(2) >= AGREE * signs.shape[1]
                if not cross:
                    near = np.triu(near, k + 1)
                x, y = near.nonzero()
                x += k
                first = (bands[i[x]] == bands[j[y]]).argmax(1) == here
                kept[i[x[first]]] = kept[j[y[first]]] = True
        yield batch.loc[kept, ["bucket", "low", "high", "node"]]


def similar_pairs(sets: list[np.ndarray], least: float = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """The pairs i < j of sorted sets of numbers whose Jaccard similarity is `least` or more."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.float64)
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        hit = both and both >= least * (sizes.sum() - both) - 1e-9
        return (np.array([0]), np.array([1])) if hit else (np.empty(0, np.int64), np.empty(0, np.int64))
    common = np.zeros((n, n))
    # The numbers are hashes, so equal spans of them hold about equally many.
    spans = max(1, -(-int(sizes.sum()) // NUMBERS))
    edges = np.array([k * (1 << 64) // spans for k in range(1, spans)], np.uint64)
    cuts = [[0, *np.searchsorted(s, edges).tolist(), len(s)] for s in sets]
    for k in range(spans):
        own = [s[c[k] : c[k + 1]] for s, c in zip(sets, cuts, strict=True)]
        owners = np.repeat(np.arange(n), [len(s) for s in own])
        _, column, times = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
        shared = times[column] > 1
        owners, column = owners[shared], column[shared]
        names, column = np.unique(column, return_inverse=True)
        order = np.argsort(column, kind="stable")
        owners, column = owners[order], column[order]
        for a in range(0, len(names), 4096):
            lo, hi = np.searchsorted(column, [a, a + 4096])
            part = np.zeros((n, min(4096, len(names) - a)), np.float32)
            part[owners[lo:hi], column[lo:hi] - a] = 1
            common += part @ part.T
    hit = (common > 0) & (common >= least * (sizes[:, None] + sizes[None] - common) - 1e-9)
    return np.triu(hit, 1).nonzero()


def _checked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of (bucket, low, high, node, shingles) rows a spanning forest of the near-duplicate pairs of each block pair."""
    for batch, starts, ends in complete_groups(batches, ["bucket", "low", "high"]):
        nodes = batch["node"].to_numpy(np.int64)
        sets = [np.frombuffer(s, np.uint64) for s in batch["shingles"]]
        a_, b_ = [], []
        for a, b in zip(starts, ends, strict=True):
            if b - a > 1:
                i, j = similar_pairs(sets[a:b])
                up = link(np.arange(b - a), i, j)
                moved = np.flatnonzero(up != np.arange(b - a))
                a_.append(nodes[a + moved])
                b_.append(nodes[a + up[moved]])
        if a_:
            yield pd.DataFrame({"a": np.concatenate(a_), "b": np.concatenate(b_)})


def _compared(paired: DataFrame, texts: DataFrame, docs: DataFrame, tf: bool) -> DataFrame:
    """Edges (a, b), a spanning forest of the near-duplicate pairs of each group of `paired` (bucket, low, high, node)."""

    def shingled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            nodes, sets = [], []
            for text in batch["text"]:
                words = words_of(text)
                nodes.append(node_of(text, words))
                sets.append(unfolded(*shingles(words, tf)).tobytes())
            yield pd.DataFrame({"node": nodes, "shingles": sets})
        _hashes.clear()

    wanted = written(paired.select("node").distinct().join(texts.select("node", "doc_id"), "node"), "wanted")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    read = rows.join(broadcast_if_small(wanted.where("doc_id IS NOT NULL").select("doc_id").distinct()), "doc_id", "left_semi")
    if not wanted.where("doc_id IS NULL").isEmpty():  # their texts are under no doc_id
        read = read.unionByName(rows.where("doc_id IS NULL"))
    read = read.mapInPandas(tidy(shingled), "node long, shingles binary").dropDuplicates(["node"])
    key = ["bucket", "low", "high"]
    return paired.join(read, "node").repartition(*key).sortWithinPartitions(*key).mapInPandas(tidy(_checked), "a long, b long")


def near_duplicates(docs: DataFrame, tf: bool = True) -> DataFrame:
    """doc_id, node, root, class_id and kept of every row of `docs` (doc_id, text).

    Texts whose words are the same in the same order, letter case and marks aside, are copies; texts without words are
    copies if they are equal, and a null text is an empty one. Copies share a `node`. Two different texts link if the
    weighted Jaccard similarity of their shingles of five words is 0.8 or more; a shingle weighs as often as it occurs, or
    1 without `tf`. Copies and links make classes: `root` is a class's smallest node, class_id its smallest doc_id, null if
    no row of it has one. `kept` marks the rows whose doc_id is the class_id; rows that share a doc_id and a text are both
    marked, rows without a doc_id never. Other columns are ignored.

    Each distinct text has one signature in the banded join. Signatures decide which texts of a bucket need their shingles;
    those are compared exactly, and a spanning forest of the links leaves the task, so all links count and no list of pairs
    grows with the square of a group. A bucket of more than BLOCK texts is cut into blocks, and each compared within itself
    alone, at a cost that grows with the bucket. What is in one class by then needs no comparing: in a second round the
    crowded buckets are cut into blocks anew, of one class each where a class fills a block, and only blocks of different
    classes meet. So a bucket of a million near copies costs little more than its size.
    """
    found = written(sketches(docs, tf), "sketches")
    texts = found.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first(F.struct("bands", "signature")).alias("s"))
    texts = written(texts.select("node", "doc_id", "s.*"), "texts")
    bucketed = texts.select("node", F.explode("bands").alias("bucket"))
    crowded = written(bucketed.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    members = bucketed.join(crowded, "bucket").withColumn("low", F.pmod(F.xxhash64("node", "bucket"), F.ceil(F.col("size") / BLOCK)))
    key, row = ["bucket", "low", "high"], "bucket long, low long, high long, node long"

    def paired(cut: DataFrame) -> DataFrame:
        """Of (node, bucket, block, low, high) rows those that _paired() leaves."""
        full = cut.join(texts.select("node", "bands", "signature"), "node").repartition(*key).sortWithinPartitions(*key)
        return written(full.mapInPandas(tidy(_paired), row), "candidates")

    within = paired(members.select("node", "bucket", F.col("low").alias("block"), "low", F.col("low").alias("high")))
    roots = connected_components(_compared(within, texts, docs, tf))
    large = crowded.where(F.col("size") > BLOCK)
    if not large.isEmpty():
        own = bucketed.join(large.select("bucket"), "bucket").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        across = paired(_across(written(own.select("node", "bucket", "root"), "crowded")))
        more = _compared(across, texts, docs, tf)
        roots = connected_components(more.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    grouped = texts.select("node", "doc_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = grouped.join(grouped.groupBy("root").agg(F.min("doc_id").alias("class_id")), "root").select("node", "root", "class_id")
    out = found.select("doc_id", "node").join(classes, "node")
    return out.select("doc_id", "node", "root", "class_id", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(False)).alias("kept"))


def _across(own: DataFrame) -> DataFrame:
    """Of (node, bucket, root) rows of crowded buckets, the rows (node, bucket, block, low, high) of the block pairs that hold
    more than one class.

    A class of BLOCK texts or more in its bucket has blocks of its own; the others share mixed ones. Mixed blocks meet all of
    their bucket, blocks of one class those of others. At most one row in BLOCK of a bucket is a class that a window numbers.
    """
    sizes = own.groupBy("bucket", "root").agg(F.count("*").alias("size"))
    mixed = sizes.where(F.col("size") < BLOCK).groupBy("bucket").agg(F.ceil(F.sum("size") / BLOCK).alias("mixed"))
    filled = sizes.where(F.col("size") >= BLOCK).withColumn("n", F.ceil(F.col("size") / BLOCK))
    each = Window.partitionBy("bucket").orderBy("root")
    filled = filled.withColumns({"before": F.sum("n").over(each) - F.col("n"), "all": F.sum("n").over(Window.partitionBy("bucket"))})
    totals = mixed.join(filled.groupBy("bucket").agg(F.max("all").alias("all")), "bucket", "full").fillna(0, ["mixed", "all"]).where("mixed + all > 1")
    placed = own.join(totals, "bucket").join(filled.select("bucket", "root", "n", "before"), ["bucket", "root"], "left")
    first, n = F.col("mixed") + F.col("before"), F.col("n")
    alone = n.isNotNull()
    block = F.when(alone, first + F.pmod(F.xxhash64("node"), n)).otherwise(F.pmod(F.xxhash64("root"), F.greatest("mixed", F.lit(1))))
    placed = placed.withColumn("block", block)
    last = F.col("mixed") + F.col("all") - 1
    zero, none = F.lit(0).cast("long"), F.array().cast("array<long>")
    behind = F.when(first + n <= last, F.sequence(first + n, last)).otherwise(none)
    others = F.when(alone, F.concat(F.when(first > 0, F.sequence(zero, first - 1)).otherwise(none), behind)).otherwise(F.sequence(zero, last))
    met = placed.withColumn("other", F.explode(others))
    return met.select("node", "bucket", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))


def keep_one(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """One row of `docs` (doc_id, text and any other columns) for each class that near_duplicates() gives.

    It is the one with the smallest doc_id; where several rows share that doc_id and a text, one of them. Rows that share a
    doc_id with other texts, and rows without a doc_id, are held against their own text's class. Of a class in which no row
    has a doc_id, a row of its smallest node stays.
    """
    classes = written(classes, "classes")
    often = written(classes.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated-ids")
    gone = written(classes.where("class_id IS NOT NULL AND doc_id IS NOT NULL AND NOT kept").select("doc_id").unionByName(often).distinct(), "dropped-ids")
    single = docs.where("doc_id IS NOT NULL").join(broadcast_if_small(gone), "doc_id", "left_anti")
    nameless = docs.where("doc_id IS NULL")
    shared = docs.join(broadcast_if_small(often), "doc_id", "left_semi").select(*docs.columns).unionByName(nameless)
    own = fresh_name(docs, "own_node")

    @F.pandas_udf("long")
    def node(texts: pd.Series) -> pd.Series:
        return pd.Series([node_of(t, words_of(t)) for t in texts], dtype="int64")

    shared = shared.withColumn(own, node(F.coalesce("text", F.lit(""))))
    mine = classes.where("kept OR doc_id IS NULL AND class_id IS NULL AND node = root").select("doc_id", F.col("node").alias(own)).distinct().alias("mine")
    same = F.col("mine.doc_id").eqNullSafe(F.col("shared.doc_id")) & (F.col(f"mine.{own}") == F.col(f"shared.{own}"))
    left = shared.alias("shared").join(mine, same, "left_semi").dropDuplicates(["doc_id", own])
    return single.select(*docs.columns).unionByName(left.select(*docs.columns))
