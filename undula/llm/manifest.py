"""A Merkle manifest of a dataset, built and verified in supersteps.

Each source's rows are the leaves of a tree, the sources' roots those of one more. In every superstep the vertices of a level
message their parents, which hash and go on once all of their children have reported; back down, parents message their
children what a proof needs above them. A vertex stands for HEIGHT levels of its tree: the children it waits for are those of
its lowest one, and it hashes its own levels at once, so a superstep, and a shuffle, climbs that many.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undula.core import numbered
from undula.llm.common import written

#: Children of a vertex.
RUN = 3
#: Levels of a tree that a vertex stands for.
HEIGHT = 3
#: Vertices for each task of a superstep.
TASK = 20_000
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def leaf_of(*values: Column) -> Column:
    """sha256 of the values one after the other: `-` for null, else the length in UTF-8 bytes, a colon and the value as text."""
    parts = []
    for v in values:
        text = v.cast("string")
        parts.append(F.when(v.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def hashed(digests: list[bytes]) -> bytes:
    """The digest of digests, each as hexadecimal text, one after the other."""
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def leaves(docs: DataFrame) -> DataFrame:
    """source_no, place, size, doc_id, leaf, tampered: every row's leaf and where it stands in its source's tree, written.

    Sources are numbered in their order (null first, then by bytes), rows within them by doc_id (null first), equal ones by
    leaf; `size` is the source's count of rows. `tampered` is the leaf without the text's line breaks for documents whose
    crc32(doc_id as text; null counts as empty) is even, else the leaf. Texts are hashed where they are read; the sort that
    numbers the rows moves digests alone, and deals a source of any size to many tasks.
    """
    picked = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(2)) == 0
    rest = [F.col(c) for c in FIELDS[:-1]]
    other = leaf_of(*rest, F.when(picked, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text")))
    own = docs.select("doc_id", "source", leaf_of(*rest, F.col("text")).alias("leaf"), other.alias("tampered"))
    # The last key has no meaning; by it, equal rows are dealt to several tasks, too.
    own = numbered(written(own.withColumn("tie", F.monotonically_increasing_id()), "leaves"), ["source"], ["doc_id", "leaf", "tie"], "place")
    sizes = written(own.groupBy("source").agg(F.count("*").alias("size")), "source-sizes")
    sources = numbered(sizes.withColumn("one", F.lit(1)), ["one"], ["source"], "source_no")
    both = own.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    return written(both.select("s.source_no", "place", "size", "doc_id", F.unhex("leaf").alias("leaf"), F.unhex("tampered").alias("tampered")), "numbered-leaves")


Vertex = tuple[int, int]
#: Ends the levels of a source's tree in a path.
BORDER = bytes([255, 0])


def _climbed(digests: list[bytes], size: int, height: int) -> tuple[list[list[bytes]], int]:
    """The levels of a vertex, from its children's digests on, and the size of the tree's level that it ends at; `size` is that
    of its children's level. A tree that has come to a single node ends there."""
    out = [digests]
    for _ in range(height):
        if size == 1:
            break
        last = out[-1]
        out.append([hashed(last[i : i + RUN]) for i in range(0, len(last), RUN)])
        size = -(-size // RUN)
    return out, size


def _above(size: int) -> int:
    """The size of a tree's level HEIGHT levels above one of that size."""
    for _ in range(HEIGHT):
        size = -(-size // RUN)
    return size


def _up(level: RDD, parts: int) -> RDD:
    """One superstep up: from (vertex, (size of its level, digest)) to the next level's (vertex, (size of its level, digest,
    children's digests, size of their level)), a vertex being (tree, place). Trees that have come to one vertex send nothing
    and so are done.

    The size tells a parent how many children to wait for: RUN ** HEIGHT, but for the level's last.
    """
    height, block = HEIGHT, RUN**HEIGHT

    def message(vertex: tuple[Vertex, tuple]) -> Iterator[tuple[Vertex, tuple]]:
        (tree, place), (size, digest) = vertex
        if size > 1:
            yield (tree, place // block), (place % block, size, digest)

    def complete(parent: tuple[Vertex, Iterator]) -> tuple[Vertex, tuple]:
        (tree, place), got = parent
        got = sorted(got)
        base, digests = got[0][1], [m[2] for m in got]
        if len(digests) != min(block, base - block * place):
            raise ValueError(f"vertex {place} of tree {tree} waits for children that don't come")
        levels, size = _climbed(digests, base, height)
        return (tree, place), (size, levels[-1][0], b"".join(digests), base)

    return level.flatMap(message).groupByKey(parts).map(complete)


def _down(vertices: RDD, paths: RDD, parts: int) -> RDD:
    """One superstep down: each vertex that has heard its path, which is what stands above it, messages its children theirs:
    for each level their place in its run and the siblings' digests, and then its own path. From (vertex, (children's digests,
    size of their level)) and (vertex, path)."""
    height, block = HEIGHT, RUN**HEIGHT

    def messages(vertex: tuple[Vertex, tuple]) -> Iterator[tuple[Vertex, bytes]]:
        (tree, place), ((joined, base), above) = vertex
        digests = [joined[i : i + 32] for i in range(0, len(joined), 32)]
        levels, _ = _climbed(digests, base, height)
        for k in range(len(digests)):
            path, i = b"", k
            for level in levels[:-1]:
                run, at = level[i - i % RUN : i - i % RUN + RUN], i % RUN
                path += bytes([at, len(run) - 1]) + b"".join(run[:at] + run[at + 1 :])
                i //= RUN
            yield (tree, block * place + k), path + above

    return vertices.join(paths, parts).flatMap(messages)


def _levels(path: bytes) -> Iterator[tuple[int, list[bytes]]]:
    """A path's levels from the leaf's up: the place in the run, and the siblings' digests."""
    at = 0
    while at < len(path):
        place, n = path[at], path[at + 1]
        yield place, [path[at + 2 + 32 * i : at + 34 + 32 * i] for i in range(n)]
        at += 2 + 32 * n


def fold(leaf: bytes, path: bytes) -> tuple[bytes, bytes]:
    """The roots of its source and of all that a leaf and its path come to."""
    digest = subroot = leaf
    for place, siblings in _levels(path):
        if place == BORDER[0]:
            subroot = digest
        else:
            digest = hashed([*siblings[:place], digest, *siblings[place:]])
    return subroot, digest


def proof(path: bytes) -> str:
    """sha256 of the path's siblings, from the leaf's level up and from left to right."""
    return hashed([d for _, siblings in _levels(path) for d in siblings]).hex()


class Forest:
    """All vertices of some trees, from their leaves: (tree, place, size, digest) rows. They are written as one table, so that
    the way down starts from files; supersteps up are as many as the largest tree needs."""

    SCHEMA = "level int, tree long, place long, size long, digest binary, children binary, base long"

    def __init__(self, leaves: DataFrame):
        spark = leaves.sparkSession
        most = int(spark.conf.get("spark.sql.shuffle.partitions"))
        largest, total = leaves.agg(F.max("size"), F.count("*")).first()
        self.parts = [max(1, min(most, -(-total // TASK)))]
        level = leaves.select("tree", "place", "size", "digest").rdd.map(lambda r: ((r[0], r[1]), (r[2], bytes(r[3]))))
        rows = [level.map(lambda v: (0, *v[0], *v[1], b"", 0))]
        while largest > 1:
            largest, total = _above(largest), -(-total // RUN**HEIGHT)
            self.parts.append(max(1, min(self.parts[-1], -(-total // TASK))))
            above = _up(level, self.parts[-1])
            rows.append(above.map(_row_of(len(rows))))
            level = above.mapValues(lambda v: v[:2])
        every = spark.sparkContext.union(rows).coalesce(sum(self.parts))
        self.table = written(spark.createDataFrame(every, self.SCHEMA, verifySchema=False), "merkle-levels")

    def roots(self) -> DataFrame:
        """tree, digest and level of every tree's root."""
        return self.table.where("size = 1").select("tree", "digest", "level")

    def paths(self, above: RDD) -> RDD:
        """((tree, place), path) of every leaf, from the paths above the roots: (tree, path)."""
        ends = self.roots().select("tree", "level").rdd.map(tuple).join(above, self.parts[0])
        heard = None
        for k in range(len(self.parts) - 1, -1, -1):
            own = ends.flatMap(_ends_at(k))
            heard = own if heard is None else heard.union(own)
            if k:
                states = self.table.where(F.col("level") == k).select("tree", "place", "children", "base").rdd.map(lambda r: ((r[0], r[1]), (bytes(r[2]), r[3])))
                heard = _down(states, heard, self.parts[k])
        return heard


def _row_of(level: int):
    return lambda v: (level, *v[0], *v[1])


def _ends_at(level: int):
    """The roots' own paths, of the trees that end at a level."""
    return lambda end: [((end[0], 0), end[1][1])] if end[1][0] == level else []


PROVEN = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def prove(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row of `docs` (doc_id, source, lang,
    n_chars, text).

    A row is a leaf, see leaf_of(). Within a source leaves stand by doc_id; while there are several nodes, each RUN
    consecutive ones, and the last fewer, even a single one, become the hash of their digests; the last that is left is the
    source's root, a lone leaf itself. The sources' roots, in the order of the sources, are the leaves of one more tree.
    `proof_sha256` is the hash of the siblings on the way from the leaf to the root, `folded_root` what the leaf of the row
    as it was tampered with (see leaves()) comes to along that way.

    Nulls are values of their own in every column, a null source is a source; empty texts are hashed as such; rows that are
    equal are leaves of their own; a column that is missing is an error, others are ignored; an empty table has no rows.
    """
    spark = docs.sparkSession
    rows = leaves(docs)
    if rows.isEmpty():
        return spark.createDataFrame([], PROVEN)
    trees = Forest(rows.select(F.col("source_no").alias("tree"), "place", "size", F.col("leaf").alias("digest")))
    subroots = trees.roots()
    n = subroots.count()
    whole = Forest(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), F.lit(n).cast("long").alias("size"), "digest"))
    root = bytes(whole.roots().first().digest)
    above = whole.paths(spark.sparkContext.parallelize([(0, b"")], 1)).map(lambda v: (v[0][1], BORDER + v[1]))
    paths = trees.paths(above)

    def told(both: tuple[Vertex, tuple]) -> tuple:
        (doc_id, leaf, tampered), path = both[1]
        subroot, folded = fold(leaf, path)
        if tampered != leaf:
            folded = fold(tampered, path)[1]
        return doc_id, leaf.hex(), subroot.hex(), root.hex(), proof(path), folded.hex(), folded == root

    own = rows.select("source_no", "place", "doc_id", "leaf", "tampered").rdd.map(lambda r: ((r[0], r[1]), (r[2], bytes(r[3]), bytes(r[4]))))
    return spark.createDataFrame(own.join(paths, trees.parts[0]).map(told), PROVEN, verifySchema=False)
