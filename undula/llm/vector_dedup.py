"""Near-duplicate vectors by an epsilon grid order join."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from undula.llm.common import complete_groups, written
from undula.llm.components import connected_components, link

#: Vectors in a block of the sequence, leading dimensions that make the grid, and rows below which a join isn't split further.
BLOCK, GRID_DIMS, LEAF = 512, 8, 128
#: Blocks or intervals that make an interval of the next level, also those that a task gets of each side.
FAN = 8
#: Intervals of a label from which pairs are sought: the level at which the longest label has no more.
TOP = 32
#: Relative room for rounding in bounds that skip work; never in the decision about a pair.
ROOM = 1e-9


def principal_axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each dimension of the vectors their leading principal axes, from moments summed over all rows in the tasks."""

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, rows in batch.groupby("dim")["unit"]:
                x = np.stack(rows.to_numpy())
                x = np.column_stack([x, np.ones(len(x))])
                sums[dim] = sums.get(dim, 0) + x.T @ x
        for dim, m in sums.items():
            yield pd.DataFrame({"dim": dim, "place": np.arange(m.size), "value": m.reshape(-1)})

    out: dict[int, np.ndarray] = {}
    total = vectors.select("dim", "unit").mapInPandas(moments, "dim int, place int, value double").groupBy("dim", "place").agg(F.sum("value").alias("value"))
    for dim, rows in total.toPandas().groupby("dim"):  # (dim + 1) ** 2 numbers for each dimension that occurs
        m = np.zeros((dim + 1) ** 2)
        m[rows["place"]] = rows["value"]
        m = m.reshape(dim + 1, dim + 1)
        mean = m[-1, :-1] / m[-1, -1]
        values, axes = np.linalg.eigh(m[:-1, :-1] / m[-1, -1] - np.outer(mean, mean))
        out[dim] = axes[:, np.argsort(-values)[:GRID_DIMS]]
    return out


def box_distance(a: np.ndarray, b: np.ndarray) -> float:
    """The least distance between two point sets on their leading axes: a bound from below on that of their vectors."""
    gap = np.maximum(0, np.maximum(a.min(0) - b.max(0), b.min(0) - a.max(0)))
    return float(np.sqrt((gap * gap).sum()))


def join_sequences(a: dict, b: dict, same: bool, epsilon: float, least: float, emit) -> None:
    """Join two intervals of the sequence: skip them if their boxes are further apart than epsilon, halve them while they are
    long, else compare all their vectors. `emit` gets the row numbers of the pairs found, and of those too close to `least`
    to be decided by unit vectors."""
    if not same and box_distance(a["grid"], b["grid"]) > epsilon * (1 + ROOM) + ROOM:
        return
    n, m = len(a["row"]), len(b["row"])
    if max(n, m) <= LEAF:
        cosine = a["unit"] @ b["unit"].T
        if same:
            cosine = np.where(np.tri(n, m, dtype=bool), -2.0, cosine)
        near = np.abs(cosine - least) < ROOM
        i, j = ((cosine >= least) & ~near).nonzero()
        x, y = near.nonzero()
        if len(i) or len(x):
            emit(a["row"][i], b["row"][j], a["row"][x], b["row"][y])
        return
    halves = lambda x: [{k: v[: len(v) // 2] for k, v in x.items()}, {k: v[len(v) // 2 :] for k, v in x.items()}]
    if same:
        low, high = halves(a)
        join_sequences(low, low, True, epsilon, least, emit)
        join_sequences(low, high, False, epsilon, least, emit)
        join_sequences(high, high, True, epsilon, least, emit)
        return
    for x in halves(a) if n >= m else [a]:
        for y in halves(b) if m > n else [b]:
            join_sequences(x, y, False, epsilon, least, emit)


SIDE = ["points", "times", "units"]
FOUND = "point long, links long, other long, open boolean"


def join_blocks(blocks: dict[int, dict], pairs: list[tuple[int, int]], epsilon: float, least: float) -> pd.DataFrame:
    """Of the given pairs of blocks (a pair of equal ones: within a block) each point's links, with another point of its
    component; pairs that unit vectors don't decide are rows of their own, `open`."""
    starts, at = {}, 0
    for k, x in blocks.items():
        starts[k] = at
        x["row"] = np.arange(at, at := at + len(x["point"]))
    points, times = (np.concatenate([x[k] for x in blocks.values()]) for k in ("point", "times"))
    links, up, open_ = np.zeros(len(points), np.int64), np.arange(len(points)), []
    seen = ("row", "unit", "grid")

    def emit(i: np.ndarray, j: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
        nonlocal up
        np.add.at(links, i, times[j])
        np.add.at(links, j, times[i])
        up = link(up, i, j)
        open_.append((points[x], points[y]))

    for a, b in pairs:
        join_sequences({k: blocks[a][k] for k in seen}, {k: blocks[b][k] for k in seen}, a == b, epsilon, least, emit)
    hit = np.flatnonzero(links)
    x, y = (np.concatenate(z) for z in zip(*open_, strict=True)) if open_ else (np.empty(0, np.int64),) * 2
    out = {"point": np.r_[points[hit], x], "links": np.r_[links[hit], np.zeros(len(x), np.int64)], "other": np.r_[points[up[hit]], y]}
    return pd.DataFrame(out).assign(open=np.r_[np.zeros(len(hit), bool), np.ones(len(x), bool)])


def near_pairs(blocks: DataFrame, epsilon: float) -> DataFrame:
    """The pairs (block, block2) of blocks of a label whose boxes are within epsilon, found from above.

    `blocks` has label, dim, seq, least and most. FAN intervals next to each other make one of the next level, with the box
    of them all. From the level at which no label has more than TOP intervals, each pair whose boxes are within epsilon is
    replaced by the pairs of their parts, level by level; what is provably distant is never taken apart.
    """
    reach = (epsilon * (1 + ROOM) + ROOM) ** 2
    gap = F.expr("aggregate(sequence(0, size(least) - 1), 0D, (s, k) -> s + pow(greatest(0D, least[k] - most2[k], least2[k] - most[k]), 2))")
    longest = blocks.groupBy("label", "dim").agg((F.max("seq") - F.min("seq") + 1).alias("n")).agg(F.max("n")).first()[0] or 0
    level = 0
    while longest > TOP * FAN**level:
        level += 1

    def intervals(level: int) -> DataFrame:
        cut = blocks.withColumn("node", F.floor(F.col("seq") / FAN**level))
        low, high = (F.array(*(f(F.get(c, F.lit(i))) for i in range(GRID_DIMS))) for c, f in (("least", F.min), ("most", F.max)))
        boxes = cut.groupBy("label", "dim", "node").agg(low.alias("least"), high.alias("most"))
        return boxes.select("label", "dim", "node", *(F.filter(c, lambda x: x.isNotNull()).alias(c) for c in ("least", "most")))

    def second(boxes: DataFrame) -> DataFrame:
        return boxes.select("label", "dim", F.col("node").alias("node2"), F.col("least").alias("least2"), F.col("most").alias("most2"))

    boxes = intervals(level)
    met = boxes.join(second(boxes), ["label", "dim"]).where("node <= node2").where(gap <= reach).select("label", "dim", "node", "node2")
    for lower in range(level - 1, -1, -1):
        boxes = intervals(lower)
        parts = lambda c: F.explode(F.sequence(F.col(c) * FAN, F.col(c) * FAN + FAN - 1)).alias(c)
        met = written(met, "intervals").select("label", "dim", parts("node"), "node2").select("label", "dim", "node", parts("node2")).where("node <= node2")
        met = met.join(boxes, ["label", "dim", "node"]).join(second(boxes), ["label", "dim", "node2"]).where(gap <= reach).select("label", "dim", "node", "node2")
    return met.select(F.col("node").alias("block"), F.col("node2").alias("block2"))


def near_duplicates(vectors: DataFrame, least: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of `vectors` (vec_id, embedding, label).

    Two rows link if their labels are equal and not null, their vectors are as long, and their cosine in double precision is
    `least` or more; vectors that are null, empty or zero, or hold null or non-finite components, link with nothing. The
    component is the smallest vec_id that links reach. Rows without a vec_id link with nothing, have no component and
    aren't kept; rows that share one are rows of their own that link like others, and are kept if it is the component's.

    Rows with equal label and vector become one point that knows their number. Points are turned to the principal axes of
    all, sorted by label and by the cells, epsilon wide, in which their leading coordinates fall, and cut into blocks of
    BLOCK points. near_pairs() finds the blocks that have to meet. A task gets up to FAN blocks next to each other of either
    side, each once however many partners it has there, and joins them recursively. It gives each point's links and, of the
    links, a spanning forest, so its output is no longer than its input, however many vectors are alike. Only unit vectors
    travel; pairs within rounding of `least` are decided by the plain formula afterwards.
    """
    spark = vectors.sparkSession
    clean = "size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(embedding, x -> x <> 0)"
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label")
    usable = F.expr(f"vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND {clean}")
    # -0.0 + 0.0 is 0.0, so equal vectors are equal keys.
    rows = rows.withColumn("vector", F.when(usable, F.transform("embedding", lambda x: x + F.lit(0.0)))).drop("embedding")
    rows = rows.withColumn("point", F.when(F.col("vector").isNotNull(), F.xxhash64("label", "vector")))
    points = rows.where("vector IS NOT NULL").groupBy("label", "vector", "point").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("times"))
    # By the largest component first, so that no norm overflows. As an array's element the divisor is worked out once a vector.
    points = points.withColumn("unit", F.expr("transform(array(array_max(transform(vector, y -> abs(y)))), m -> transform(vector, x -> x / m))[0]"))
    length = "transform(array(sqrt(aggregate(unit, 0D, (s, y) -> s + y * y))), m -> transform(unit, x -> x / m))[0]"
    points = written(points.withColumn("unit", F.expr(length)).withColumn("dim", F.size("unit")), "points")
    axes = spark.sparkContext.broadcast(principal_axes(points))
    epsilon = math.sqrt(max(0.0, 2 - 2 * least))
    label = f"label {points.schema['label'].dataType.simpleString()}"

    def turned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, own in batch.groupby("dim"):
                grid = np.stack(own["unit"].to_numpy()) @ axes.value[dim]
                yield own.assign(cells=list(np.floor(grid / epsilon).astype(np.int32)))

    columns = f"{label}, point long, times long, unit array<double>, dim int, cells array<int>"
    placed = points.select("label", "point", "times", "unit", "dim").mapInPandas(turned, columns)
    ordered = placed.repartitionByRange("label", "dim", "cells", "point").sortWithinPartitions("label", "dim", "cells", "point")

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part_id, nth = TaskContext.get().partitionId(), 0
        rest: pd.DataFrame | None = None

        def closed(part: pd.DataFrame) -> pd.DataFrame:
            nonlocal nth
            nth += 1
            dim = int(part["dim"].iloc[0])
            unit = np.stack(part["unit"].to_numpy())
            grid = unit @ axes.value[dim]
            packed = [part[c].to_numpy(np.int64).tobytes() for c in ("point", "times")] + [unit.tobytes()]
            row = [part["label"].iloc[0], dim, part_id, nth - 1, grid.min(0).tolist(), grid.max(0).tolist(), *packed]
            return pd.DataFrame([row], columns=["label", "dim", "part", "nth", "least", "most", *SIDE])

        for batch in batches:
            part = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            rest = None
            runs = ((part["label"] != part["label"].shift()) | (part["dim"] != part["dim"].shift())).cumsum()
            for run, own in part.groupby(runs, sort=False):
                for a in range(0, len(own), BLOCK):
                    piece = own.iloc[a : a + BLOCK]
                    if run == runs.iloc[-1] and len(piece) < BLOCK:
                        rest = piece
                    else:
                        yield closed(piece)
        if rest is not None:
            yield closed(rest)

    sides = ", ".join(f"{c} binary" for c in SIDE)
    made = written(ordered.mapInPandas(blocks, f"{label}, dim int, part int, nth long, least array<double>, most array<double>, {sides}"), "blocks")
    # One row a partition tells where its blocks stand in the sequence of all.
    counts = made.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    numbered = made.join(F.broadcast(before), "part").withColumn("seq", F.col("before") + F.col("nth"))
    pairs = written(near_pairs(numbered.select("label", "dim", "seq", "least", "most"), epsilon), "block-pairs")

    group = lambda c: F.floor(F.col(c) / FAN)
    work = pairs.groupBy(group("block").alias("g"), group("block2").alias("g2")).agg(F.collect_set(F.struct("block", "block2")).alias("pairs"))  # FAN * FAN at most
    needs = F.array_distinct(F.flatten(F.transform("pairs", lambda p: F.array(p["block"], p["block2"]))))
    needed = work.select("g", "g2", "pairs", F.explode(needs).alias("seq")).join(numbered.select("seq", "dim", *SIDE), "seq")
    tasks = needed.repartition("g", "g2").sortWithinPartitions("g", "g2", "seq")

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch, starts, ends in complete_groups(batches, ["g", "g2"]):
            for a, b in zip(starts, ends, strict=True):
                own = {}
                for r in batch.iloc[a:b].itertuples(index=False):
                    unit = np.frombuffer(r.units, np.float64).reshape(-1, r.dim)
                    own[r.seq] = {"point": np.frombuffer(r.points, np.int64), "times": np.frombuffer(r.times, np.int64), "unit": unit, "grid": unit @ axes.value[r.dim]}
                yield join_blocks(own, [(p["block"], p["block2"]) for p in batch["pairs"].iloc[a]], epsilon, least)

    found = written(tasks.mapInPandas(joined, FOUND), "links")
    closed_ = found.where("NOT open").select("point", "links", "other")
    if not found.where("open").isEmpty():
        side = lambda c, v: points.select(F.col("point").alias(c), F.col("vector").alias(v), F.col("times").alias(f"{v}_times"))
        undecided = found.where("open").select("point", "other").join(side("point", "v"), "point").join(side("other", "w"), "other")

        def decided(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                keep = [math.fsum(x * y) / (math.sqrt(math.fsum(x * x)) * math.sqrt(math.fsum(y * y))) >= least for x, y in zip(batch["v"], batch["w"], strict=True)]
                yield batch.loc[keep, ["point", "other", "v_times", "w_times"]]

        linked = written(undecided.mapInPandas(decided, "point long, other long, v_times long, w_times long"), "decided")
        closed_ = closed_.unionByName(linked.selectExpr("point", "w_times AS links", "other")).unionByName(linked.selectExpr("other AS point", "v_times AS links", "point AS other"))
    links = closed_.groupBy("point").agg(F.sum("links").alias("links"))
    roots = connected_components(closed_.select(F.col("point").alias("a"), F.col("other").alias("b")))
    known = points.select("point", "first_id", "times").join(links, "point", "left").join(roots.withColumnRenamed("node", "point"), "point", "left")
    known = known.withColumn("root", F.coalesce("root", "point"))
    smallest = known.groupBy("root").agg(F.min("first_id").alias("component_id"))
    known = known.join(smallest, "root").select("point", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), "component_id")
    linked_rows = rows.select("vec_id", "point").join(known, "point", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return linked_rows.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
