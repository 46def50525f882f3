"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undula.llm.common import broadcast_if_small, fresh_name, written

#: Bits of md5 in a uniform number: 13 hexadecimal digits, which a double holds exactly.
_SPAN = float(1 << 52)
#: A mean above this is the sum of equal smaller ones, each with a number of its own, so that exp(-mean) stays exact enough.
MOST_MEAN = 16.0
#: Beyond so many copies the chance that is left, at a mean of 16, is below the numbers' resolution of 2**-52.
MOST_COPIES = 80


def hashed(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) from md5 of the seed and the keys written as text; null keys count as empty."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(k.cast("string"), F.lit("")) for k in keys))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(_SPAN)


def parts_of(mean: Column) -> Column:
    """Into how many equal parts a mean is split so that none is above MOST_MEAN."""
    return F.greatest(F.lit(1), F.ceil(mean / F.lit(MOST_MEAN))).cast("int")


def steps_of(mean: Column) -> Column:
    """Where the distribution of one part of the mean steps up: P(count <= k) for k from 0 on, as far as a hashed number can
    reach. One row a source needs it, so the documents only look numbers up in it."""
    m = mean / parts_of(mean)
    start = F.struct(F.exp(-m).alias("p"), F.exp(-m).alias("cdf"), F.array(F.exp(-m)).alias("all"))

    def step(s: Column, k: Column) -> Column:
        p = s["p"] * m / k
        return F.struct(p.alias("p"), (s["cdf"] + p).alias("cdf"), F.array_append(s["all"], s["cdf"] + p).alias("all"))

    whole = F.aggregate(F.sequence(F.lit(1), F.lit(MOST_COPIES - 1)), start, step, lambda s: s["all"])
    return F.filter(whole, lambda c: c <= 1 - 1 / _SPAN)


def poisson(mean: Column, seed: int, *keys: Column, steps: Column | None = None) -> Column:
    """A Poisson count with that mean, by inversion: the number of k with P(count <= k) <= u, u hashed from seed and keys.

    Means above MOST_MEAN are split into equal parts whose counts are added. `steps` is steps_of(mean), where it is at hand.
    """
    steps = steps_of(mean) if steps is None else steps

    def one(part: Column) -> Column:
        # As the element of an array the number is hashed once, not again for each step.
        return F.transform(F.array(hashed(seed, *keys, part)), lambda u: F.size(F.filter(steps, lambda c: c <= u)))[0]

    # Nearly all means are of one part: spare those the loop.
    many = F.aggregate(F.sequence(F.lit(1), parts_of(mean)), F.lit(0), lambda n, j: n + one(j))
    return F.when(mean <= 0, 0).when(mean <= MOST_MEAN, one(F.lit(1))).otherwise(many)


def rates(docs: DataFrame, power: float, group: str = "source") -> DataFrame:
    """Per source: its documents, its target share (count ** power, scaled to 1), and the mean repetitions that reach it.

    The output's expected size is the input's. Counted over all rows, pre-aggregated in each task; a null source is one of
    its own. `power` 1 leaves the mix as it is, 0 makes all sources equal.
    """
    counts = docs.groupBy(F.col(group).alias("mix_group")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("all_n"), F.sum(F.pow(F.col("n").cast("double"), F.lit(power))).alias("all_w"))
    weight = F.pow(F.col("n").cast("double"), F.lit(power)) / F.col("all_w")
    return counts.join(total).select("mix_group", "n", weight.alias("target"), (F.col("all_n") * weight / F.col("n")).alias("rate"))


def mix_sources(docs: DataFrame, power: float = 0.5, seed: int = 7, group: str = "source", targets: DataFrame | None = None) -> DataFrame:
    """Repeat each document by a Poisson count whose mean is its source's rate, then shuffle all copies globally.

    `targets` (mix_group, rate) replaces the rates that `power` gives. Added columns: mix_rate, mix_copies, mix_copy (from
    1) and mix_place, a hashed number by which the output is ordered over all partitions; where `docs` has such a name,
    the added one gets underscores in front. Counts depend on the seed, doc_id, source and n-th copy alone, so a task that
    runs again gives the same rows. Rows that share a doc_id and source share their count; a null doc_id counts as empty;
    a source without a target is dropped, as a rate of 0 says.
    """
    rate, copies, copy, place = (fresh_name(docs, c) for c in ("mix_rate", "mix_copies", "mix_copy", "mix_place"))
    key, steps, part = (fresh_name(docs, c) for c in ("mix_group", "mix_steps", "mix_part"))
    per = written(rates(docs, power, group), "rates") if targets is None else targets
    per = per.select(F.col("mix_group").alias(key), F.col("rate").alias(rate), steps_of(F.col("rate")).alias(steps))
    per = broadcast_if_small(written(per, "steps"), 10_000)
    counted = docs.join(per, docs[group].eqNullSafe(per[key])).drop(key)
    counted = counted.withColumn(copies, poisson(F.col(rate), seed, F.col("doc_id"), steps=F.col(steps))).drop(steps).where(F.col(copies) > 0)
    repeated = counted.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies))))
    placed = repeated.withColumn(place, hashed(seed + 1, F.col("doc_id"), F.col(copy)))
    # Places are uniform, so equal spans of them hold about equally many copies; no pass over the rows has to find the spans.
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = placed.withColumn(part, F.floor(F.col(place) * n).cast("int")).repartitionById(n, part)
    return dealt.drop(part).sortWithinPartitions(place, "doc_id")
