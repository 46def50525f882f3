"""Exact top-k search by inner product: branch and bound over columns."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors in a block of candidates and queries in a block, and dimensions that are added up between two looks at the bounds.
CANDIDATES, QUERIES, STEP = 4096, 32, 16
#: The share of a block's candidates below which the survivors are compacted.
COMPACT = 0.5
#: Components of the candidates that a task holds, in expectation (128 MB as doubles).
HELD = 16_000_000
#: Candidates with larger components are summed up apart, so that doubles hold the others' scores.
PLAIN = 1 << 20
#: Candidates below which a cell isn't split further for the sake of more tasks.
LEAST_CELL = 1024

_EXACT, _MOST = float(1 << 53), (1 << 63) - 1


def best_each(queries: np.ndarray, columns: np.ndarray, ids: np.ndarray, k: int, floors: np.ndarray, order: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the row numbers and scores of its k best candidates, ties to the smaller id; none below its floor.

    `columns` holds the candidates by dimension. Scores grow dimension block by block in the given order. A candidate's score
    can still change by no more than the product of what is left of the query's length and of its own, so a candidate whose
    upper bound is below the k-th best lower bound of every query of the block is out; once enough are, the rest is compacted.
    """
    n, dim = columns.shape[1], len(order)
    alive = np.arange(n)
    part, q = columns[order], queries[:, order]
    left, left_q = (part * part).sum(0), (q * q).sum(1)
    spare = 1e-12 * left  # for rounding in what is left
    score = np.zeros((len(q), n))
    for a in range(0, dim, STEP):
        score += q[:, a : a + STEP] @ part[a : a + STEP]
        left = left - (part[a : a + STEP] ** 2).sum(0)
        left_q = left_q - (q[:, a : a + STEP] ** 2).sum(1)
        known = np.isfinite(floors).all()
        if a + STEP >= dim or not known and 2 * (a + STEP) < dim:
            continue
        swing = np.sqrt(np.maximum(left_q, 0))[:, None] * np.sqrt(np.maximum(left, 0) + spare) * (1 + 1e-9) + 1e-6
        bar = floors
        if not known and len(alive) > k:
            bar = np.maximum(bar, np.partition(score - swing, len(alive) - k, axis=1)[:, len(alive) - k])
        fit = (score + swing >= bar[:, None]).any(0)
        if fit.mean() < COMPACT:
            alive, part, score, left, spare = alive[fit], part[:, fit], score[:, fit], left[fit], spare[fit]
    out = []
    for own, floor in zip(score, floors, strict=True):
        bar = max(floor, float(np.partition(own, len(own) - k)[len(own) - k])) if len(own) > k else floor
        fit = np.flatnonzero(own >= bar)
        top = fit[np.lexsort((ids[alive[fit]], -own[fit]))[:k]]
        out.append((alive[top], own[top]))
    return out


def best(query: np.ndarray, columns: np.ndarray, ids: np.ndarray, k: int, floor: float, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """best_each() of one query."""
    return best_each(query[None], columns, ids, k, np.array([floor]), order)[0]


def largest(vectors: np.ndarray) -> np.ndarray:
    """Each vector's largest component, its sign aside."""
    return np.maximum(vectors.max(1, initial=0).astype(np.float64), -vectors.min(1, initial=0).astype(np.float64))


def exact_score(a: np.ndarray, b: np.ndarray) -> int:
    """An inner product of whole numbers of any size, held within the range of a long."""
    return max(-_MOST - 1, min(_MOST, sum(int(x) * int(y) for x, y in zip(a, b, strict=True))))


def best_wide(query: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """best() for numbers whose products doubles can't hold. A bound on the rounding error tells which candidates may be
    among the k best, and those alone are summed up as Python's integers; those surely beyond a long are at its end."""
    a, b = query.astype(np.longdouble), vectors.astype(np.longdouble)
    score, error = b @ a, (np.abs(b) @ np.abs(a)) * np.longdouble(len(query) * 2.0**-60)
    low, high = (np.clip(s, -float(1 << 63), float(1 << 63)) for s in (score - error, score + error))
    bar = np.partition(low, len(low) - k)[len(low) - k] if len(low) > k else -np.inf
    fit = np.flatnonzero(high >= bar)
    sure = {float(1 << 63): _MOST, -float(1 << 63): -_MOST - 1}
    found = [sure[float(low[i])] if low[i] == high[i] and float(low[i]) in sure else exact_score(query, vectors[i]) for i in fit]
    top = sorted(range(len(fit)), key=lambda j: (-found[j], ids[fit[j]]))[:k]
    return fit[top], np.array([found[j] for j in top], np.int64)


class Cell:
    """The candidates of one dimension that a task holds: by columns in blocks, and those too large for doubles apart."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray]]):
        ids, vectors = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.blocks = []
        for a in range(0, len(ids), CANDIDATES):
            own = largest(vectors[a : a + CANDIDATES])
            plain = own < PLAIN
            self.blocks.append((ids[a : a + CANDIDATES][plain], np.ascontiguousarray(vectors[a : a + CANDIDATES][plain].T.astype(np.float64))))
        wide = largest(vectors) >= PLAIN
        self.ids, self.vectors = ids[wide], vectors[wide].astype(np.float64)

    def search(self, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the vec_ids and scores of at most 2 * k candidates, its k best among them."""
        found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in queries]
        most = largest(queries)
        plain = np.flatnonzero(queries.shape[1] * most * PLAIN < _EXACT)
        floors = np.full(len(queries), -np.inf)
        order = np.argsort(-np.abs(queries[plain]).sum(0), kind="stable")
        for ids, columns in self.blocks:
            if not len(ids):
                continue
            if len(plain):
                for i, (at, score) in zip(plain, best_each(queries[plain], columns, ids, k, floors[plain], order), strict=True):
                    found[i].append((ids[at], score.astype(np.int64)))
                    if len(score) >= k:
                        floors[i] = max(floors[i], float(score[k - 1]))
            for i in set(range(len(queries))) - set(plain.tolist()):
                at, score = best_wide(queries[i], columns.T, ids, k)
                found[i].append((ids[at], score))
        if len(self.ids):
            for i, q in enumerate(queries):
                at, score = best_wide(q, self.vectors, self.ids, k)
                found[i].append((self.ids[at], score))
        out = []
        for each in found:
            ids, score = (np.concatenate(x) for x in zip(*each, strict=True)) if each else (np.empty(0, np.int64),) * 2
            top = np.lexsort((ids, ~score))[:k]  # ~ turns the order round and can't overflow
            out.append((ids[top], score[top]))
        return out


FOUND = "key long, query_id long, own_score long, times long, vec_id long, score long"


def _searched(k: int):
    """Rows sorted by dim and side, a dimension's candidates (side 0) ahead of its queries (side 1), to the queries' best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dim, parts, cell, waiting = None, [], None, []

        def answered() -> Iterator[pa.RecordBatch]:
            nonlocal cell
            if waiting and parts:
                cell = cell or Cell(parts)
                query_ids, keys, times, queries = (np.concatenate(x) for x in zip(*waiting, strict=True))
                for a in range(0, len(keys), QUERIES):
                    own = queries[a : a + QUERIES].astype(np.float64)
                    results = cell.search(own, k)
                    n = [len(ids) for ids, _ in results]
                    sums = (own * own).sum(1) if own.shape[1] * largest(own).max() ** 2 < _EXACT else [exact_score(q, q) for q in own]
                    self_ = np.array(sums).astype(np.int64)
                    columns = [np.repeat(x, n) for x in (keys[a : a + QUERIES], query_ids[a : a + QUERIES], self_, times[a : a + QUERIES])]
                    columns += [np.concatenate([r[j] for r in results]) for j in (0, 1)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [c.split()[0] for c in FOUND.split(", ")])
            waiting.clear()

        for batch in batches:
            dims, sides = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "side"))
            is_small = batch.column("small").is_valid().to_numpy(zero_copy_only=False)
            kind = np.stack([dims, sides, is_small], axis=1)
            starts = np.flatnonzero(np.r_[True, (kind[1:] != kind[:-1]).any(axis=1)]) if len(kind) else []
            for start, end in zip(starts, [*starts[1:], len(kind)], strict=True):
                run_, own = batch.slice(start, end - start), int(dims[start])
                if own != dim:
                    yield from answered()
                    dim, parts, cell = own, [], None
                values = run_.column("small" if is_small[start] else "wide").flatten().to_numpy(zero_copy_only=False).reshape(-1, own)
                ids, keys, times = (run_.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "key", "times"))
                if sides[start] == 0:
                    parts.append((ids, values))
                else:
                    waiting.append((ids, keys, times, values.astype(np.float64)))
            if sum(len(w[0]) for w in waiting) >= 4 * QUERIES:
                yield from answered()
        yield from answered()

    return run


def grid(vectors: int, numbers: int, asked: int, tasks: int) -> tuple[int, int]:
    """Into how many cells the candidates and into how many slices the queries go; a task has one of each.

    Every cell gets a copy of its slice's queries and every slice one of its cell's candidates. As many tasks as asked for
    and little copying call for sqrt(tasks * vectors / asked) cells, a task's memory for one per HELD numbers at least.
    """
    cells = min(tasks, math.ceil(math.sqrt(tasks * vectors / max(1, asked))), math.ceil(vectors / LEAST_CELL))
    cells = max(1, cells, math.ceil(numbers / HELD))
    return cells, max(1, min(math.ceil(tasks / cells), math.ceil(asked / QUERIES)))


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id and score of the k best candidates for each row of `vectors` whose vec_id `every` divides.

    Components x become floor(scale * x) of x as a double, held within the range of doubles; the score is the integer inner
    product, held within the range of a long. Candidates are all rows but the query's own, of as many dimensions; ties go to
    the smaller vec_id. Rows whose vec_id or vector is null, or whose vector is empty or holds null or non-finite components,
    take no part. Rows that share a vec_id are rows of their own, as queries and as candidates. Other columns are ignored.

    Candidates are dealt to cells by turns and queries to slices, and each task searches one cell for one slice (see grid()):
    it holds its cell's candidates and lets its slice's queries pass, a block at a time. Each task gives k + 1 rows for a
    query at most, the query's own row among them; that one is then taken out.
    """
    spark = vectors.sparkSession
    fine = "vec_id IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"
    # Beyond 1e15 a double has no fraction, and floor() would not hold it.
    far = f"greatest(-1.7976931348623157e308D, least(1.7976931348623157e308D, cast(x AS double) * {float(scale)}D))"
    codes = F.expr(f"transform(embedding, x -> CASE WHEN abs(cast(x AS double)) < 1e15 THEN cast(floor(cast(x AS double) * {float(scale)}D) AS double) ELSE {far} END)")
    rows = vectors.where(fine).select("vec_id", codes.alias("codes"), F.size("embedding").alias("dim"))
    asked = rows.where(F.pmod(F.col("vec_id"), F.lit(every)) == 0)
    # Equal query rows have equal answers: they are searched once.
    asked = asked.groupBy("vec_id", "codes", "dim").agg(F.count("*").alias("times")).withColumn("key", F.xxhash64("vec_id", "codes"))
    sizes = vectors.where(fine).agg(F.count("*").alias("n"), F.sum(F.size("embedding").cast("long")).alias("numbers"), F.count_if(F.pmod(F.col("vec_id"), F.lit(every)) == 0).alias("asked")).first()
    cells, slices = grid(sizes.n, sizes.numbers or 0, sizes.asked, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    turn = F.pmod(F.monotonically_increasing_id(), F.lit(cells)).cast("int")
    small = "forall(codes, c -> abs(c) < 32768)"
    packed = [F.expr(f"IF({small}, cast(codes AS array<short>), NULL)").alias("small"), F.expr(f"IF({small}, NULL, codes)").alias("wide")]
    none = F.lit(0).cast("long")
    candidates = rows.withColumn("cell", turn).select((F.col("cell") * slices).alias("at"), F.lit(0).alias("side"), "dim", "vec_id", none.alias("key"), none.alias("times"), *packed)
    candidates = candidates.withColumn("at", F.explode(F.sequence("at", F.col("at") + slices - 1)))
    queries = asked.select(F.pmod("key", F.lit(slices)).cast("int").alias("at"), F.lit(1).alias("side"), "dim", "vec_id", "key", "times", *packed)
    queries = queries.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1)))).withColumn("at", F.col("at") + F.col("cell") * slices).drop("cell")
    dealt = candidates.unionByName(queries).repartitionById(cells * slices, "at").sortWithinPartitions("dim", "side")
    pairs = dealt.select("side", "dim", "vec_id", "key", "times", "small", "wide").mapInArrow(_searched(k + 1), FOUND)

    each = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    is_own = (F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("own_score"))
    ranked = pairs.withColumn("n", F.row_number().over(each)).where(F.col("n") <= k + 1)
    first_own = F.min(F.when(is_own, F.col("n"))).over(Window.partitionBy("key"))
    ranked = ranked.withColumn("own", first_own).where(F.col("own").isNull() | (F.col("n") != F.col("own")))
    ranked = ranked.withColumn("rank", (F.col("n") - F.when(F.col("own") < F.col("n"), 1).otherwise(0)).cast("int")).where(F.col("rank") <= k)
    out = ranked.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return out.select("query_id", "rank", "vec_id", "score")
