"""Change points and unusual stretches of recordings."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from undula.core import neighbours, shifted, stored
from undula.operators.features import windowed_features

#: Blocks that a recording is summed up in: change points of longer ones fall on the blocks' ends.
BLOCKS = 10_000


def _cheapest(n: np.ndarray, s1: np.ndarray, s2: np.ndarray, least: int, penalty: float, cost) -> list[int]:
    """Where the blocks are cut so that the pieces' costs and a penalty for each are least: exact, as only starts are dropped
    that can't be best any more."""
    count, x, xx = (np.r_[0.0, np.cumsum(v)] for v in (n, s1, s2))
    best, before = np.full(len(count), np.inf), np.zeros(len(count), int)
    best[0] = -penalty
    starts = [0]
    for end in range(least, len(count)):
        at = np.array([s for s in starts if end - s >= least])
        total = best[at] + cost(count[end] - count[at], x[end] - x[at], xx[end] - xx[at])
        k = int(np.argmin(total))
        best[end], before[end] = total[k] + penalty, at[k]
        hopeless = set(at[total > best[end]].tolist())
        starts = [s for s in starts if s not in hopeless]
        starts.append(end)
    cuts, end = [], len(count) - 1
    while end > 0 and np.isfinite(best[end]):
        end = int(before[end])
        cuts.append(end)
    return [c for c in cuts[::-1] if c > 0]


def change_points(samples: DataFrame, cost: str = "meanvar", penalty: float | None = None, least: int | None = None, blocks: int = BLOCKS) -> DataFrame:
    """rec, idx and penalty of the samples at which a recording's level (`mean`) or level and spread (`meanvar`) change.

    A normal law is fitted to each piece, of one deviation for all with `mean`; a change has to save the penalty, by default 2
    or 3 times the log of the length. Pieces have `least` samples, by default a hundredth of the recording and two at least.
    A recording is summed up in at most `blocks` blocks in the tasks, and those rows alone meet in one. Recordings with gaps,
    and those with fewer samples than two pieces, have no change points.
    """
    if cost not in ("mean", "meanvar"):
        raise ValueError("cost has to be mean or meanvar")
    size = samples.groupBy("rec").agg((F.max("idx") + 1).alias("n"), F.count_if(F.col("value").isNull()).alias("gaps"), F.var_pop("value").alias("var")).where("gaps = 0").drop("gaps")
    jumps = shifted(samples, prev=-1).select("rec", (F.col("value") - F.col("prev")).alias("d")).where("d IS NOT NULL")
    middle = jumps.groupBy("rec").agg(F.percentile("d", F.lit(0.5)).alias("m"))
    noise = jumps.join(middle, "rec").groupBy("rec").agg((1.4826 * F.percentile(F.abs(F.col("d") - F.col("m")), F.lit(0.5)) / F.sqrt(F.lit(2.0))).alias("noise"))
    about = size.join(noise, "rec", "left").withColumn("step", F.greatest(F.lit(1), F.ceil(F.col("n") / blocks)))
    summed = samples.join(about, "rec").groupBy("rec", F.floor(F.col("idx") / F.col("step")).alias("block"), "n", "var", "noise", "step")
    summed = summed.agg(F.count("*").alias("c"), F.sum("value").alias("s1"), F.sum(F.col("value") * F.col("value")).alias("s2"))

    def cut(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("block")
        n, step, var, noise = (own[k].iloc[0] for k in ("n", "step", "var", "noise"))
        steady = noise**2 if noise and noise > 0 else (var or 1.0)
        floor = 1e-6 * (var or 1.0)
        price = penalty if penalty is not None else (2 if cost == "mean" else 3) * np.log(n)
        pieces = {
            "mean": lambda c, a, b: (b - a * a / c) / steady,
            "meanvar": lambda c, a, b: c * (np.log(2 * np.pi * np.maximum(b / c - (a / c) ** 2, floor)) + 1),
        }
        smallest = least if least is not None else max(2, int(n) // 100)
        found = _cheapest(own["c"].to_numpy(float), own["s1"].to_numpy(), own["s2"].to_numpy(), max(1, -(-smallest // int(step))), price, pieces[cost])
        return pd.DataFrame({"rec": own["rec"].iloc[0], "idx": np.array(found, np.int64) * int(step), "penalty": float(price)})

    return summed.groupBy("rec").applyInPandas(cut, f"rec {samples.schema['rec'].dataType.simpleString()}, idx long, penalty double")


def segments_between(samples: DataFrame, points: DataFrame, fs: float | None = None) -> DataFrame:
    """rec, start_s, end_s, n, mean and std of the stretches that change points (rec, idx) make."""
    size = samples.groupBy("rec").agg((F.max("idx") + 1).alias("n"))
    starts = points.select("rec", "idx").unionByName(size.select("rec", F.lit(0).cast("long").alias("idx"))).distinct()
    w = Window.partitionBy("rec").orderBy("idx")
    spans = starts.join(size, "rec").withColumn("end", F.coalesce(F.lead("idx").over(w), "n")).select("rec", F.col("idx").alias("start"), "end")
    # Each sample takes the last start at or before it, found within its chunk or from the chunks before.
    marked = samples.select("rec", "idx", F.col("value").alias("x")).join(starts.withColumn("value", F.col("idx").cast("double")), ["rec", "idx"], "left")
    own = neighbours(marked).select("rec", F.col("x").alias("value"), F.col("prev_v").cast("long").alias("start"))
    stats = own.groupBy("rec", "start").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    r = fs or 1.0
    return spans.join(stats, ["rec", "start"]).select("rec", (F.col("start") / r).alias("start_s"), (F.col("end") / r).alias("end_s"), (F.col("end") - F.col("start")).alias("n"), "mean", "std")


#: Trees of a forest, windows that a tree sees, and windows of a recording from which trees draw.
TREES, SEEN, POOL = 100, 256, 16_384


def _average_depth(n: np.ndarray) -> np.ndarray:
    """Steps that an unsuccessful search in a tree of n takes on average."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def _tree(x: np.ndarray, draw: np.random.Generator, most: int) -> list[tuple[int, float, int, int, float]]:
    """Nodes (column, cut, left, right, depth): random cuts until a row is alone or the depth is reached."""
    nodes: list[tuple[int, float, int, int, float]] = []
    todo = [(np.arange(len(x)), 0, -1, 0)]
    while todo:
        rows, depth, parent, side = todo.pop()
        place = len(nodes)
        if parent >= 0:
            p = list(nodes[parent])
            p[2 + side] = place
            nodes[parent] = tuple(p)
        low, high = x[rows].min(0), x[rows].max(0)
        wide = np.flatnonzero(high > low)
        if depth >= most or len(rows) < 2 or not len(wide):
            nodes.append((-1, 0.0, -1, -1, float(depth + _average_depth(len(rows)))))
            continue
        c = int(draw.choice(wide))
        # Below the highest value, where the draw may be rounded to, so that both sides have rows.
        at = min(float(draw.uniform(low[c], high[c])), float(np.nextafter(high[c], low[c])))
        nodes.append((c, at, -1, -1, 0.0))
        left = x[rows, c] <= at
        todo += [(rows[~left], depth + 1, place, 1), (rows[left], depth + 1, place, 0)]
    return nodes


def _scores(x: np.ndarray, seed: int) -> np.ndarray:
    """The scores of up to SEEN windows by a forest whose trees see all of them: those of trees by _tree(), of which only the depths
    at which windows end up are kept. So small nodes take longer to make in NumPy than in lists."""
    n, columns, draw = len(x), x.T.tolist(), np.random.default_rng(seed)
    most, total = int(np.ceil(np.log2(max(n, 2)))), [0.0] * n
    ends = [[float(d + a) for a in _average_depth(np.arange(n + 1))] for d in range(most + 1)]
    every = range(len(columns))
    # The columns in which a window shares its value with another: only they can be level among windows, of which it is one.
    shared = [[c for c in every if columns[c].count(columns[c][i]) > 1] for i in range(n)]
    for _ in range(TREES):
        draw.choice(n, n, replace=False)  # the order in which a tree sees them changes nothing but the draws after it
        todo = [(list(range(n)), 0)]
        while todo:
            rows, depth = todo.pop()
            wide: list[int] | range = []
            if depth < most and len(rows) > 1:
                first, rest = rows[0], rows[1:]
                level = {c for c in shared[first] if all(v == columns[c][first] for v in map(columns[c].__getitem__, rest))}
                wide = [c for c in every if c not in level] if level else every
            if not wide:
                for i in rows:
                    total[i] += ends[depth][len(rows)]
                continue
            own = columns[wide[int(draw.integers(0, len(wide)))]]
            values = [own[i] for i in rows]
            low, high = min(values), max(values)
            at = min(low + (high - low) * draw.random(), math.nextafter(high, low))  # as draw.uniform(low, high)
            todo.append(([i for i in rows if own[i] > at], depth + 1))
            todo.append(([i for i in rows if own[i] <= at], depth + 1))
    return 2 ** (-np.array(total) / TREES / max(_average_depth(np.array(n)), 1e-12))


def anomaly_scores(samples: DataFrame, window: float, step: float | None = None, fs: float | None = None, include: list[str] | None = None, share: float | None = None, seed: int = 0) -> DataFrame:
    """rec, t_start, t_end, score (0 to 1, higher is more unusual) and anomaly of each full window, by an isolation forest over
    its features (by default time, and with a rate freq); recordings of fewer than eight windows have none.

    Features are centred at their median and divided by their interquartile range; missing ones are the median. A recording's
    forest has TREES trees that see SEEN windows each, drawn from POOL of the recording's, which bounds what grows it; every
    window is scored, in any task; those of recordings of up to SEEN windows by the task that grows their forest. Without `share` a window is an anomaly above 0.5, else the `share` with the highest scores.
    """
    kind = samples.schema["rec"].dataType.simpleString()
    found = stored(windowed_features(samples, window, step, fs, tuple(include or (("time", "freq") if fs else ("time",)))))
    names = [c for c in found.columns if c not in ("rec", "t_start", "t_end")]
    q = found.groupBy("rec").agg(F.count("*").alias("windows"), *(F.percentile(c, F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias(f"q_{c}") for c in names)).where("windows >= 8")
    scaled = []
    for c in names:
        middle = F.coalesce(F.col(f"q_{c}")[1], F.lit(0.0))
        wide = F.col(f"q_{c}")[2] - F.col(f"q_{c}")[0]
        filled = F.coalesce(F.when(~F.isnan(c), F.col(c)), middle)
        scaled.append((filled - middle) / F.when(wide > 0, wide).otherwise(1.0))
    rows = stored(found.join(q, "rec").select("rec", "t_start", "t_end", "windows", F.array(*scaled).alias("x")))
    finite = F.forall("x", lambda v: F.abs(v) < float("inf"))
    few = rows.where(F.col("windows") <= SEEN).groupBy("rec").agg(F.array_sort(F.collect_list(F.struct("t_start", "t_end", "x"))).alias("p"), F.bool_and(finite).alias("finite"))

    def at_once(batches):
        for batch in batches:
            if len(batch):
                made = [_scores(np.stack([np.asarray(v, float) for v in x]), seed) for x in batch["x"]]
                ends = {c: np.concatenate(batch[c].to_list()) for c in ("t_start", "t_end")}
                yield pd.DataFrame({"rec": batch["rec"].repeat([len(m) for m in made]).to_numpy(), **ends, "score": np.concatenate(made)})

    kinds = f"rec {kind}, t_start double, t_end double, score double"
    small = few.where("finite").select("rec", F.col("p.t_start").alias("t_start"), F.col("p.t_end").alias("t_end"), F.col("p.x").alias("x")).mapInPandas(at_once, kinds)
    rows = rows.join(few.where("finite").select("rec"), "rec", "left_anti")
    pool = rows.where(F.pmod(F.xxhash64("rec", "t_start", F.lit(seed)), F.lit(1 << 40)) < F.lit(float(1 << 40)) * POOL / F.col("windows")).select("rec", "t_start", "x")

    def grown(own: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(own.sort_values("t_start")["x"].to_numpy())
        draw = np.random.default_rng(seed)
        seen = min(SEEN, len(x))
        trees = [_tree(x[draw.choice(len(x), seen, replace=False)], draw, int(np.ceil(np.log2(max(seen, 2))))) for _ in range(TREES)]
        nodes = [(t, *node) for t, tree in enumerate(trees) for node in tree]
        columns = [np.array(c, float).tobytes() for c in zip(*nodes, strict=True)]
        return pd.DataFrame([[own["rec"].iloc[0], seen, *columns]], columns=["rec", "seen", *PARTS])

    forest = pool.groupBy("rec").applyInPandas(grown, f"rec {kind}, seen long, {', '.join(f'{p} binary' for p in PARTS)}")

    def scored(batches):
        for batch in batches:
            out = np.zeros(len(batch))
            for _, at in batch.groupby(PARTS[1]).indices.items():
                r = batch.iloc[at[0]]
                tree, column, cut, left, right, depth = (np.frombuffer(r[p]) for p in PARTS)
                x = np.stack(batch["x"].iloc[at].to_numpy())
                starts = np.flatnonzero(np.r_[True, tree[1:] != tree[:-1]])
                total = np.zeros(len(x))
                for s in starts:
                    node = np.full(len(x), s)
                    while (inner := column[node] >= 0).any():
                        i = np.flatnonzero(inner)
                        k = node[i]
                        goes = x[i, column[k].astype(int)] <= cut[k]
                        node[i] = s + np.where(goes, left[k], right[k]).astype(int)
                    total += depth[node]
                out[at] = 2 ** (-total / len(starts) / max(_average_depth(np.array(r["seen"])), 1e-12))
            yield batch[["rec", "t_start", "t_end"]].assign(score=out)

    made = small.unionByName(rows.drop("windows").join(forest, "rec").mapInPandas(scored, kinds))
    if share is None:
        return made.withColumn("anomaly", F.col("score") > 0.5)
    made = stored(made)
    bar = made.groupBy("rec").agg(F.percentile("score", F.lit(1 - share)).alias("bar"))
    return made.join(bar, "rec").withColumn("anomaly", F.col("score") > F.col("bar")).drop("bar")


PARTS = ["tree", "column", "cut", "left", "right", "depth"]
