"""Segmentation losses and run histories as aggregations over scored pixels.

``scored`` is ``(batch keys, sample, channel, y, x, z, t)`` with a logit ``z`` and a
target ``t``. Every sum combines on the map side, so one large sample or batch does
not crowd a task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.functions.scalars import sigmoid

DICE_EPS = 1e-6
BATCH_EPS = 1e-8


def per_channel(values: Sequence[float] | None) -> Column:
    """The value of this row's channel; one when no list is given."""
    if values is None:
        return F.lit(1.0)
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.col("channel") + 1)


def bce_with_logits(pos_weight: Sequence[float] | None = None) -> Column:
    """Cross entropy from a logit without overflow; ``pos_weight`` scales the positive term."""
    z, t = F.col("z"), F.col("t")
    soft = F.log1p(F.exp(-F.abs(z)))
    if pos_weight is None:
        return F.greatest(z, F.lit(0.0)) - z * t + soft
    return (1 - t) * z + (1 + (per_channel(pos_weight) - 1) * t) * (soft + F.greatest(-z, F.lit(0.0)))


def mean_bce(
    scored: DataFrame, batch: Sequence[str] = (), channel_weights: Sequence[float] | None = None,
    pos_weight: Sequence[float] | None = None,
) -> DataFrame:
    return scored.groupBy(*batch).agg(
        F.avg(per_channel(channel_weights) * bce_with_logits(pos_weight)).alias("bce")
    )


def soft_dice(
    scored: DataFrame, batch: Sequence[str] = (), channel_weights: Sequence[float] | None = None
) -> DataFrame:
    """One minus the mean over samples of soft Dice on all channels together.

    Channel weights act on the logits, before the sigmoid.
    """
    p, t = sigmoid(F.col("z") * per_channel(channel_weights)), F.col("t")
    sums = scored.groupBy(*batch, "sample").agg(
        F.sum(p * t).alias("_both"), (F.sum(p) + F.sum(t)).alias("_all")
    )
    dice = (2 * F.col("_both") + DICE_EPS) / (F.col("_all") + DICE_EPS)
    return sums.groupBy(*batch).agg((1 - F.avg(dice)).alias("dice_loss"))


def soft_tversky(
    scored: DataFrame, batch: Sequence[str] = (), alpha: float = 0.3, beta: float = 0.7
) -> DataFrame:
    """One minus the mean over samples and channels of the Tversky score."""
    p, t = sigmoid("z"), F.col("t")
    sums = scored.groupBy(*batch, "sample", "channel").agg(
        F.sum(p * t).alias("_tp"), F.sum(p * (1 - t)).alias("_fp"), F.sum((1 - p) * t).alias("_fn")
    )
    score = (F.col("_tp") + DICE_EPS) / (
        F.col("_tp") + alpha * F.col("_fp") + beta * F.col("_fn") + DICE_EPS
    )
    return sums.groupBy(*batch).agg((1 - F.avg(score)).alias("tversky_loss"))


def segmentation_loss(
    scored: DataFrame, config: Mapping | None = None, batch: Sequence[str] = ()
) -> DataFrame:
    """Weighted sum of cross entropy and a region loss, with its parts, per batch."""
    config = config or {}
    mode = config.get("mode", "bce_dice")
    weights = config.get("channel_weights")
    bce = mean_bce(scored, batch, weights, config.get("pos_weight"))
    if mode == "bce_dice":
        region, name = soft_dice(scored, batch, weights), "dice_loss"
    elif mode == "bce_tversky":
        alpha, beta = config.get("tversky_alpha", 0.3), config.get("tversky_beta", 0.7)
        region, name = soft_tversky(scored, batch, alpha, beta), "tversky_loss"
    else:
        raise ValueError(f"a loss is bce_dice or bce_tversky, not {mode}")
    # with no batch key both sides are a single row
    on = list(batch) or ["_one"]
    if not batch:
        bce, region = (df.withColumn("_one", F.lit(1)) for df in (bce, region))
    total = float(config.get("bce_weight", 1.0)) * F.col("bce") + float(
        config.get("seg_weight", 1.0)
    ) * F.col(name)
    return bce.join(region, on).select(*batch, total.alias("loss"), "bce", name)


def batch_dice(scored: DataFrame, batch: Sequence[str] = (), threshold: float = 0.5) -> DataFrame:
    """Mean over samples of hard Dice on channel 0; an empty pair scores one."""
    p, t = sigmoid("z") >= threshold, F.col("t") >= 0.5
    sums = scored.filter("channel = 0").groupBy(*batch, "sample").agg(
        F.sum((p & t).cast("double")).alias("_tp"), F.sum((p & ~t).cast("double")).alias("_fp"),
        F.sum((~p & t).cast("double")).alias("_fn"),
    )
    dice = (2 * F.col("_tp") + BATCH_EPS) / (2 * F.col("_tp") + F.col("_fp") + F.col("_fn") + BATCH_EPS)
    return sums.groupBy(*batch).agg(F.avg(dice).alias("pixel_dice"))


# --------------------------------------------------------------------- histories
def epoch_averages(batches: DataFrame, metrics: Sequence[str], phases: Sequence[str] = ("train", "val"),
                   keys: Sequence[str] = ("run", "epoch")) -> DataFrame:
    """Unweighted batch means per epoch, one column per phase and metric."""
    out = batches.groupBy(*keys).pivot("phase", list(phases)).agg(
        *[F.avg(m).alias(m) for m in metrics], F.count(F.lit(1)).alias("_n")
    )
    return out.select(*keys, *[F.col(f"{p}_{m}") for p in phases for m in metrics])


def stack_histories(histories: Sequence[DataFrame]) -> DataFrame:
    """Rows of all histories under the union of their columns, in name order."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), histories)
    return stacked.select(*sorted(stacked.columns))


def best_epoch(history: DataFrame, metric: str = "val_pixel_dice", keys: Sequence[str] = ("run",)) -> DataFrame:
    """The earliest epoch with the highest metric; a missing metric never wins."""
    score = F.coalesce(metric, F.lit(float("-inf")))
    top = history.groupBy(*keys).agg(
        F.max(F.struct(score.alias("s"), (-F.col("epoch")).alias("e"))).alias("_b")
    )
    return top.filter(F.col("_b.s") > float("-inf")).select(
        *keys, (-F.col("_b.e")).cast("int").alias("epoch"), F.col("_b.s").alias(metric)
    )


def running_best(history: DataFrame, metric: str = "val_pixel_dice", keys: Sequence[str] = ("run",)) -> DataFrame:
    """Mark the epochs at which a new best would have been kept. A run has one row per epoch."""
    score = F.coalesce(metric, F.lit(float("-inf")))
    before = Window.partitionBy(*keys).orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.max(score).over(before), F.lit(float("-inf")))
    return history.withColumn("new_best", score > earlier)
