"""Building blocks that stay balanced when one session holds much of the data.

Nothing here puts a whole session into one task: joins on a session are salted,
ranks are taken inside small ordered buckets, and exact percentiles are found by
counting before any row is ordered.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 32


def salted_join(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    spread_by: Sequence[str],
    how: str = "left",
    salts: int = SALTS,
    hashed: bool = False,
) -> DataFrame:
    """Join rows to one-row-per-key facts without gathering a key in one task.

    ``small`` is repeated ``salts`` times and ``big`` is spread over the copies by a
    hash of ``spread_by``. With ``hashed``, for facts of images or ROIs, of which there are far fewer
    than pixels, a task holds its share of the facts and does not sort the rows.
    """
    salt = F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int")
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    join = hash_join if hashed else merge_join
    return join(big.withColumn("_salt", salt), copies, [*keys, "_salt"], how).drop("_salt")


def merge_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join two tables that both grow with the data, by sorting them.

    Adaptive execution broadcasts what was small when shuffled, but shuffled rows are compressed:
    repetitive ones, as copies and names of sessions are, take many times as much at the driver.
    """
    return left.join(right.hint("merge"), list(on), how)


def hash_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join to a table of which each task can hold its share, without sorting and without a broadcast."""
    return left.join(right.hint("shuffle_hash"), list(on), how)


def shapes_once(shapes: DataFrame, keys: Sequence[str] = ("session",)) -> DataFrame:
    """``(keys, height, width)`` once for each image, however often a table lists it."""
    return shapes.select(*keys, "height", "width").distinct()


def bucketed_row_number(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[Column],
    out: str,
) -> DataFrame:
    """``row_number() over (partition by keys order by bucket, order)``, spread out.

    Rows are ordered only inside ``(keys, bucket)``; the number of earlier rows comes
    from a cumulative sum over bucket counts. ``bucket`` must never decrease along
    the wanted order.
    """
    keys = list(keys)
    df = df.withColumn("_bucket", bucket)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.groupBy(*keys, "_bucket")
        .agg(F.count("*").alias("_n"))
        .select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return (
        merge_join(df, offsets, [*keys, "_bucket"])
        .withColumn(out, F.row_number().over(inside) + F.col("_before"))
        .drop("_bucket", "_before")
    )


def _ordered_bits(value: Column, per_octave: int = 256) -> Column:
    """A whole number that never falls as the value rises: sign, exponent and first mantissa bits.

    Rounding of the logarithm can only move a value next to a power of two by one step, in
    the direction that keeps the order.
    """
    size = F.abs(value)
    octave = F.greatest(F.floor(F.log2(size)), F.lit(-1022))
    step = F.floor((size / F.pow(F.lit(2.0), octave) - 1) * per_octave)
    step = F.greatest(F.lit(0), F.least(F.lit(per_octave - 1), step))
    number = (octave + 1024) * per_octave + step + 1
    return F.when(value == 0, F.lit(0)).when(value > 0, number).otherwise(-number).cast("int")


def group_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float | str],
    weight: str | None = None,
    per_bucket: int = 256,
) -> DataFrame:
    """Exact percentiles per key with linear interpolation between neighbours.

    1. equal values collapse to ``(key, value, count)`` before the shuffle;
    2. values are counted by the leading bits of the number, so how far the extremes lie
       apart does not matter;
    3. the few buckets that hold a wanted rank are split once more, evenly between their
       own extremes, into as many as their number of values calls for;
    4. of these the ones that hold a wanted rank are ordered, each on its own.

    A percentile is a number, or the name of one of ``keys`` that holds each group's own.
    ``weight`` counts a row several times (used for the implicit background).
    NaN and null values must be removed by the caller.
    """
    keys = list(keys)
    counted = F.sum(weight) if weight else F.count("*")
    values = (
        df.select(*keys, F.col(value).cast("double").alias("_v"), *([weight] if weight else []))
        .groupBy(*keys, "_v")
        .agg(counted.alias("_c"))
        .filter("_c > 0")
        .withColumn("_b1", _ordered_bits(F.col("_v")))
    )

    def rank(p: float | str) -> Column:
        return (F.col(p) if isinstance(p, str) else F.lit(float(p))) * (F.col("_n") - 1)

    def hits(upper: Column) -> Column:
        return F.filter("_ranks", lambda k: (k >= upper - F.col("_c")) & (k < upper))

    def upto(by: list[str], order: str) -> Column:
        line = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return F.sum("_c").over(line)

    wanted = [f(rank(p)).cast("bigint") for p in probs.values() for f in (F.floor, F.ceil)]
    coarse = (
        values.groupBy(*keys, "_b1")
        .agg(F.sum("_c").alias("_c"), F.count("*").alias("_d"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        .withColumn("_n", F.sum("_c").over(Window.partitionBy(*keys)))
        .withColumn("_upper", upto(keys, "_b1"))
        .withColumn("_ranks", F.array_distinct(F.array(*wanted)))
        .withColumn("_ranks", hits(F.col("_upper")))
        .filter(F.size("_ranks") > 0)
        .select(*keys, "_b1", "_n", "_d", "_lo", "_hi", "_ranks", (F.col("_upper") - F.col("_c")).alias("_base"))
    )
    n_buckets = F.greatest(F.lit(1), F.floor(F.col("_d") / per_bucket))
    # halving first keeps the width finite for the widest doubles
    share = (F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)
    bucket = F.when(
        F.col("_hi") > F.col("_lo"), F.least(F.floor(share * n_buckets), n_buckets - 1)
    ).otherwise(F.lit(0))
    placed = salted_join(values, coarse, [*keys, "_b1"], ["_v"], "inner", salts=8).withColumn("_b2", bucket.cast("bigint"))
    facts = [F.first(c).alias(c) for c in ("_n", "_ranks", "_base")]
    fine = (
        placed.groupBy(*keys, "_b1", "_b2")
        .agg(F.sum("_c").alias("_c"), *facts)
        .withColumn("_upper", upto([*keys, "_b1"], "_b2") + F.col("_base"))
        .withColumn("_ranks", hits(F.col("_upper")))
        .filter(F.size("_ranks") > 0)
        .select(*keys, "_b1", "_b2", "_n", "_ranks", (F.col("_upper") - F.col("_c")).alias("_base"))
    )
    found = (
        merge_join(placed.select(*keys, "_b1", "_b2", "_v", "_c"), fine, [*keys, "_b1", "_b2"])
        .withColumn("_upper", upto([*keys, "_b1", "_b2"], "_v") + F.col("_base"))
        .select(*keys, "_n", "_v", F.explode(hits(F.col("_upper"))).alias("_k"))
    )
    picks = []
    for name, p in probs.items():
        for tag, f in (("lo", F.floor), ("hi", F.ceil)):
            at = F.col("_k") == f(rank(p)).cast("bigint")
            picks.append(F.max(F.when(at, F.col("_v"))).alias(f"_{tag}_{name}"))
    picked = found.groupBy(*keys).agg(F.max("_n").alias("_n"), *picks)
    out = []
    for name, p in probs.items():
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        part = rank(p) - F.floor(rank(p))
        out.append((lo + (hi - lo) * part).alias(name))
    return picked.select(*keys, *out)
