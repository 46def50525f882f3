"""The data model: samples in long form, and how they are cut into chunks for windows.

`samples` has a recording key `rec`, a dense index `idx` from 0 and a `value`, null where it is missing. A recording may be
of any length: per-sample windows run over chunks of it, so one long recording is spread over many tasks; statistics of a
whole recording are aggregates, which Spark pre-sums in each task, joined back to the samples.

Heartbeats are also found in samples in runs: `rec`, `first` and `values`, the array of consecutive samples from the index `first`
on, NaN where they are missing. filtering.run_rows() cuts either form into chunks.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Samples in a chunk.
CHUNK = 1 << 16


def from_rows(df: DataFrame, rec: str | Column, order: list[str | Column], value: str | Column, bucket: Column | None = None) -> DataFrame:
    """Samples from rows in an order; NaN becomes null.

    `bucket` is a column that never falls in that order, such as the day of a time: rows are then numbered within each bucket,
    from the counts of the buckets before, and a long recording is spread over many tasks. Without it they are dealt to tasks
    by ranges of the order, which costs a written table.
    """
    rec, value = (F.col(c) if isinstance(c, str) else c for c in (rec, value))
    keys = [(F.col(o) if isinstance(o, str) else o).alias(f"_o{i}") for i, o in enumerate(order)]
    v = value.cast("double")
    order = [f"_o{i}" for i in range(len(order))]
    rows = df.select(rec.alias("rec"), *keys, F.when(~F.isnan(v), v).alias("value"), *([] if bucket is None else [bucket.alias("_b")]))
    if bucket is None:
        return numbered(rows, ["rec"], order, "idx").select("rec", "idx", "value")
    return _numbered_within(rows, ["rec"], "_b", order, "idx").select("rec", "idx", "value")


def dealt(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """`df` dealt to tasks by ranges of its order and written, with each row's range as `name`: a later range has later rows,
    and equal ones share a range."""
    return stored(df.repartitionByRange(*order).withColumn(name, F.spark_partition_id()))


def _numbered_within(df: DataFrame, key: list[str], bucket: str, order: list[str], name: str) -> DataFrame:
    counts = df.groupBy(*key, bucket).agg(F.count("*").alias("_n"))
    base = counts.select(*key, bucket, (F.sum("_n").over(Window.partitionBy(*key).orderBy(bucket)) - F.col("_n")).alias("_base"))
    place = F.row_number().over(Window.partitionBy(*key, bucket).orderBy(*order)) - 1
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in [*key, bucket]]
    both = df.withColumn("_place", place).alias("x").join(base.alias("y"), same).select("x.*", "y._base")
    return both.withColumn(name, (F.col("_base") + F.col("_place")).cast("long")).drop("_base", "_place")


def numbered(df: DataFrame, key: list[str], order: list[str], name: str) -> DataFrame:
    """Adds the place of each row among those of its key, from 0, by ranges of the order: no task sorts all rows of a key."""
    return _numbered_within(dealt(df, [*key, *order], "_part"), key, "_part", order, name).drop("_part")


def from_arrays(df: DataFrame, rec: str, values: str) -> DataFrame:
    """Samples from one array for each recording."""
    rows = df.select(F.col(rec).alias("rec"), F.posexplode(values).alias("idx", "value"))
    v = F.col("value").cast("double")
    return rows.select("rec", F.col("idx").cast("long").alias("idx"), F.when(~F.isnan(v), v).alias("value"))


def from_runs(runs: DataFrame) -> DataFrame:
    """Samples from samples in runs."""
    each = runs.select("rec", "first", F.posexplode("values").alias("pos", "value"))
    return each.select("rec", (F.col("first") + F.col("pos")).alias("idx"), F.when(~F.isnan("value"), F.col("value")).alias("value"))


def to_arrays(samples: DataFrame) -> DataFrame:
    """One array of values for each recording, in order; for recordings that fit a task."""
    pairs = F.array_sort(F.collect_list(F.struct("idx", "value")))
    return samples.groupBy("rec").agg(F.transform(pairs, lambda p: p["value"]).alias("values"))


def from_wide(df: DataFrame, rec: str, idx: str, channels: list[str]) -> DataFrame:
    """Samples from one column for each channel; the recording key is the channel's name after the recording's."""
    long = df.unpivot([rec, idx], channels, "channel", "value")
    return long.select(F.concat_ws("/", F.col(rec).cast("string"), "channel").alias("rec"), F.col(idx).cast("long").alias("idx"), F.col("value").cast("double").alias("value"))


def chunked(samples: DataFrame, before: int, after: int, chunk: int | None = None) -> DataFrame:
    """Every chunk with the `before` samples ahead of it and the `after` samples behind: adds `chunk` and `owned`.

    Over partitions of (rec, chunk) a frame of at most that reach is exact for owned rows. Nothing is ahead of the first chunk,
    unless samples are numbered so.
    """
    n = F.lit(chunk or CHUNK)
    own = F.floor(F.col("idx") / n)
    first = F.floor((F.col("idx") - after) / n)
    first = F.when(F.col("idx") >= 0, F.greatest(first, F.lit(0).cast("long"))).otherwise(first)
    out = samples.withColumn("chunk", F.explode(F.sequence(first, F.floor((F.col("idx") + before) / n))))
    return out.withColumn("owned", F.col("chunk") == own)


def over_chunks(frame: tuple[int, int] | None = None):
    w = Window.partitionBy("rec", "chunk").orderBy("idx")
    return w.rowsBetween(*frame) if frame else w


def owned(df: DataFrame) -> DataFrame:
    return df.where("owned").drop("owned", "chunk")


def stored(df: DataFrame) -> DataFrame:
    """Written as Parquet to spark.checkpoint.dir and read back, for what is used many times over; the files go when the
    application ends. Where that is unset, to a temporary folder in local mode; on a cluster it has to be set."""
    spark = df.sparkSession
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="undula-")
        spark.conf.set("spark.checkpoint.dir", where)
    path = f"{where.rstrip('/')}/samples-{uuid.uuid4().hex}"
    df.write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def within_a_chunk(samples: DataFrame) -> bool:
    """Whether no recording goes beyond a chunk; of a stored table the files' own statistics mostly tell."""
    return samples.where(F.col("idx") >= CHUNK).isEmpty()


def told(samples: DataFrame, about: DataFrame, short: bool) -> DataFrame:
    """The samples with what a table holds of their recording. Where all are `short`, so that none fills a task, they aren't
    sorted for it; else a small table is broadcast, and the samples stay where they are."""
    return samples.join(about.hint("shuffle_hash") if short else about, "rec")


def with_stats(samples: DataFrame, **aggregates: Column) -> DataFrame:
    """The samples with aggregates of their whole recording."""
    stats = samples.groupBy("rec").agg(*(a.alias(k) for k, a in aggregates.items()))
    return samples.join(stats, "rec")


def ordered_means(samples: DataFrame, key: list[str], at: str = "idx") -> DataFrame:
    """The key and `mean`, the mean of its values, added up in their order: whether a value equal to the mean lies below it hangs
    on the sum's last bit, and so on that order. Chunks are summed by themselves, and their sums in order, too."""
    df = samples.withColumn("_chunk", F.floor(F.col(at) / F.lit(CHUNK)))
    upto = F.sum("value").over(Window.partitionBy(*key, "_chunk").orderBy(at).rowsBetween(Window.unboundedPreceding, 0))
    chunks = df.withColumn("_upto", upto).groupBy(*key, "_chunk").agg(F.max_by("_upto", at).alias("_sum"), F.count("value").alias("_n"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("_chunk", "_sum"))), lambda p: F.coalesce(p["_sum"], F.lit(0.0)))
    return chunks.groupBy(*key).agg(F.try_divide(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x), F.sum("_n")).alias("mean"))


#: Up to so many values of a recording meet in one aggregation buffer; longer ones' quantiles are narrowed down first.
LONG = 1 << 16
#: Quantiles told by each round's sketch, its accuracy, and the values that a finish gathers at most.
GRID, ACCURACY, FINISH = 200, 2000, 4096


def long_recordings(samples: DataFrame) -> DataFrame | None:
    """The recordings of more than LONG rows, written; None if there are none. Only the key is read, and counts are pre-summed."""
    counts = samples.groupBy("rec").agg(F.count("*").alias("_n")).where(F.col("_n") > LONG).select("rec")
    return None if counts.isEmpty() else stored(counts)


def quantiles(df: DataFrame, value: str | Column, qs: list[float], long: DataFrame | None, name: str = "q") -> DataFrame:
    """rec and `name`, the array of exact quantiles of each recording's non-null values, equal to percentile(value, qs).

    A recording of up to LONG rows is one aggregate's work. Those in `long`, see long_recordings(), go through narrowing
    rounds: of the values that lie between two bounds each round counts those below and within, pre-summed in each task, and a
    sketch of bounded size tells GRID quantiles of those strictly within, of which the nearest around the wanted rank are the next
    bounds. Bounds that turn out not to hold the rank are widened again, so the result doesn't lean on the sketch. Once
    FINISH values are left, or the rank falls on a bound, it is read off. The driver learns only whether bounds are left.
    """
    own = df.select("rec", (F.col(value) if isinstance(value, str) else value).alias("_v"))
    whole = lambda d: d.groupBy("rec").agg(F.percentile("_v", F.array(*(F.lit(float(q)) for q in qs))).alias(name))
    if long is None:
        return whole(own)
    return whole(own.join(long, "rec", "left_anti")).unionByName(_narrowed(stored(own.join(long, "rec", "left_semi")), qs, name))


def _narrowed(rows: DataFrame, qs: list[float], name: str) -> DataFrame:
    grid = F.array(*(F.lit(i / GRID) for i in range(GRID + 1)))
    present = rows.where("_v IS NOT NULL")
    n = present.groupBy("rec").agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    places = F.array(*(F.struct(F.lit(i).alias("nth"), F.lit(up).alias("up"), (F.lit(float(q)) * (F.col("n") - 1)).alias("at")) for i, q in enumerate(qs) for up in (False, True)))
    wanted = n.select("rec", "lo", "hi", F.explode(places).alias("p")).select("rec", "p.*", "lo", "hi").withColumn("rank", F.when(F.col("up"), F.ceil("at")).otherwise(F.floor("at")))
    # The bounds before, the ranks that the sketch may be wrong by, as parts of the grid, and values below and within.
    state = wanted.select("rec", "nth", "up", "at", "rank", "lo", "hi", F.col("lo").alias("lo0"), F.col("hi").alias("hi0"), F.lit(1).alias("margin"))
    state = stored(state)
    names = ["nth", "up", "at", "rank", "lo", "hi", "lo0", "hi0", "margin"]
    v, lo, hi = F.col("_v"), F.col("lo"), F.col("hi")
    inner = (v > lo) & (v < hi)
    # Ranks behind those below lo: the first at_lo are lo, the last at_hi are hi.
    r = F.col("rank") - F.col("below")
    held = (r >= 0) & (r < F.col("at_lo") + F.col("inner") + F.col("at_hi"))
    is_lo, is_hi = held & (r < F.col("at_lo")), held & (r >= F.col("at_lo") + F.col("inner"))
    between = held & ~is_lo & ~is_hi
    told, ready = [], []
    while True:
        met = present.join(state, "rec")
        counted = stored(met.groupBy("rec", *names).agg(
            F.count_if(v < lo).alias("below"), F.count_if(v == lo).alias("at_lo"), F.count_if((v == hi) & (lo < hi)).alias("at_hi"), F.count_if(inner).alias("inner"),
            F.percentile_approx(F.when(inner, v), grid, ACCURACY).alias("sketch"),
        ))
        told.append(counted.where(is_lo | is_hi).select("rec", "nth", "up", "at", F.when(is_lo, lo).otherwise(hi).alias("found")))
        ready.append(counted.where(between & (F.col("inner") <= FINISH)).select("rec", "nth", "up", "at", (r - F.col("at_lo")).alias("place"), "lo", "hi"))
        share = (r - F.col("at_lo")) / F.col("inner") * GRID
        down, up = F.greatest(F.floor(share) - F.col("margin"), F.lit(0)), F.least(F.ceil(share) + F.col("margin"), F.lit(GRID))
        narrower = counted.where(between & (F.col("inner") > FINISH))
        narrower = narrower.select("rec", "nth", "up", "at", "rank", F.get("sketch", down.cast("int")).alias("lo"), F.get("sketch", up.cast("int")).alias("hi"), lo.alias("lo0"), hi.alias("hi0"), F.lit(1).alias("margin"))
        # A rank that slipped out is looked for between the bounds before, once more with a wider margin.
        wider = counted.where(~held).select("rec", "nth", "up", "at", "rank", F.col("lo0").alias("lo"), F.col("hi0").alias("hi"), "lo0", "hi0", (F.col("margin") * 4).alias("margin"))
        state = stored(narrower.unionByName(wider))
        if state.isEmpty():
            break
    last = present.join(stored(reduce(DataFrame.unionByName, ready)), "rec").where(inner).groupBy("rec", "nth", "up", "at", "place").agg(F.sort_array(F.collect_list("_v")).alias("all"))
    found = reduce(DataFrame.unionByName, told).unionByName(last.select("rec", "nth", "up", "at", F.get("all", F.col("place").cast("int")).alias("found")))
    ends = found.groupBy("rec", "nth", "at").agg(F.max(F.when(~F.col("up"), F.col("found"))).alias("a"), F.max(F.when(F.col("up"), F.col("found"))).alias("b"))
    between = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((F.ceil("at") - F.col("at")) * F.col("a") + (F.col("at") - F.floor("at")) * F.col("b"))
    made = ends.groupBy("rec").agg(F.array_sort(F.collect_list(F.struct("nth", between.alias("x")))).alias("q")).select("rec", F.transform("q", lambda x: x["x"]).alias(name))
    empty = rows.select("rec").distinct().join(made.select("rec"), "rec", "left_anti").select("rec", F.lit(None).cast("array<double>").alias(name))
    return made.unionByName(empty)


def with_quantiles(samples: DataFrame, long: DataFrame | None, **wanted: tuple[str | Column, float | list[float]]) -> DataFrame:
    """The samples with exact quantiles of their whole recording: with_quantiles(s, long, mid=("value", 0.5)); see quantiles()."""
    if long is None:
        plain = lambda q: F.array(*map(F.lit, q)) if isinstance(q, list) else F.lit(q)
        return with_stats(samples, **{name: F.percentile(value, plain(q)) for name, (value, q) in wanted.items()})
    out = samples = stored(samples)
    for name, (value, q) in wanted.items():
        made = quantiles(samples, value, q if isinstance(q, list) else [q], long, name)
        out = out.join(made if isinstance(q, list) else made.withColumn(name, F.col(name)[0]), "rec")
    return out


def _middle(values: Column) -> Column:
    """The median of a sorted array, as percentile() has it."""
    n = F.size(values)
    low, high = F.get(values, F.floor((n - 1) / 2).cast("int")), F.get(values, F.floor(n / 2).cast("int"))
    return F.when(n > 0, F.when(low == high, low).otherwise(0.5 * low + 0.5 * high))


def with_spreads(samples: DataFrame, long: DataFrame | None, **wanted: str) -> DataFrame:
    """The samples with median absolute deviations of their whole recording: with_spreads(s, long, spread="value"). Recordings of
    up to LONG rows gather their values once for both medians; see quantiles() for those in `long`."""
    samples = stored(samples)
    if long is not None:
        df = with_quantiles(samples, long, **{f"_{k}": (v, 0.5) for k, v in wanted.items()})
        df = with_quantiles(df, long, **{k: (F.abs(F.col(v) - F.col(f"_{k}")), 0.5) for k, v in wanted.items()})
        return df.drop(*(f"_{k}" for k in wanted))
    made = samples.groupBy("rec").agg(*(F.sort_array(F.collect_list(v)).alias(k) for k, v in wanted.items()))
    made = made.withColumns({f"_{k}": _middle(F.col(k)) for k in wanted})
    off = lambda k: F.sort_array(F.transform(k, lambda x: F.abs(x - F.col(f"_{k}"))))
    made = made.select("rec", *(off(k).alias(k) for k in wanted))
    return told(samples, made.select("rec", *(_middle(F.col(k)).alias(k) for k in wanted)), True)


def shifted(samples: DataFrame, **by: int) -> DataFrame:
    """Adds the values so many samples away, null beyond the ends: shifted(s, prev=-1, next=1)."""
    before, after = max(0, *(-n for n in by.values())), max(0, *by.values())
    w = over_chunks()
    df = chunked(samples, before, after)
    return owned(df.withColumns({k: F.lag("value", -n).over(w) if n < 0 else F.lead("value", n).over(w) for k, n in by.items()}))


def neighbours(samples: DataFrame, short: bool = False) -> DataFrame:
    """Adds prev_i, prev_v, next_i, next_v: the nearest present sample at or before, and at or after, each.

    Within a chunk by a window; across chunks from each chunk's first and last present sample, one row a chunk, unless all
    recordings are known to be `short`, see within_a_chunk().
    """
    df = samples.withColumn("chunk", F.floor(F.col("idx") / F.lit(CHUNK)))
    here = F.when(F.col("value").isNotNull(), F.struct("idx", "value"))
    at = F.when(F.col("value").isNotNull(), F.col("idx"))
    end = lambda a, v, name: F.when(a(at).isNotNull(), F.struct(a(at).alias("idx"), v("value", at).alias("value"))).alias(name)
    ends = df.groupBy("rec", "chunk").agg(end(F.min, F.min_by, "head"), end(F.max, F.max_by, "tail"))
    w = Window.partitionBy("rec").orderBy("chunk")
    ends = ends.select("rec", "chunk", F.last("tail", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("tail"), F.first("head", True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("head"))
    back = F.last(here, True).over(over_chunks((Window.unboundedPreceding, 0)))
    # Backwards, as a frame up to the end would be gone through again for each row.
    ahead = F.last(here, True).over(Window.partitionBy("rec", "chunk").orderBy(F.desc("idx")).rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumns({"back": back, "ahead": ahead})
    df = df if short else df.join(ends, ["rec", "chunk"])
    prev, next_ = (F.col("back"), F.col("ahead")) if short else (F.coalesce("back", "tail"), F.coalesce("ahead", "head"))
    return df.select(*samples.columns, prev["idx"].alias("prev_i"), prev["value"].alias("prev_v"), next_["idx"].alias("next_i"), next_["value"].alias("next_v"))


def windows(samples: DataFrame, win: int, hop: int | None = None) -> DataFrame:
    """Every full window of `win` samples, `hop` apart: adds `w` (its number) and `pos` (place in it). Windows that end past
    the recording's end are left out."""
    hop = hop or win
    first = F.greatest(F.lit(0), F.ceil((F.col("idx") - win + 1) / F.lit(hop)))
    each = samples.withColumn("w", F.explode(F.sequence(first, F.floor(F.col("idx") / F.lit(hop))))) if hop < win else samples.withColumn("w", F.floor(F.col("idx") / F.lit(hop)))
    each = each.withColumn("pos", F.col("idx") - F.col("w") * hop).where(F.col("pos") < win)
    n = samples.groupBy("rec").agg((F.max("idx") + 1).alias("n"))
    return each.join(n, "rec").where(F.col("w") * hop + win <= F.col("n")).drop("n")
