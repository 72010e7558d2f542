"""A trainable pixel foreground model: features, weighted fit, probabilities."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelloom.functions.scalars import sigmoid
from pixelloom.operators.components import TILE
from pixelloom.operators.intensity import _footprint, _lines, densify, robust_normalise, top_hat
from pixelloom.operators.losses import batch_dice

#: How a model is stored: its weights by feature and, under ``fit``, the other numbers.
MODEL = "part string, name string, value double"
FEATURES = ("normalised", "local_mean", "local_max", "local_min", "detail")


def pixel_features(
    pixels: DataFrame, kernel: int = 5, keys: Sequence[str] = ("session",), shapes: DataFrame | None = None,
    max_side: int | None = None,
) -> DataFrame:
    """Normalised value, 3 x 3 mean, maximum and minimum, and top-hat per pixel.

    With ``shapes``, absent cells are zeros; without, every cell must be there. If the caller knows that
    images have at most ``max_side`` rows and columns, and that fits a tile, each is worked as one array
    after a single shuffle of its rows; larger ones go along their scanlines.
    """
    keys = list(keys)
    if shapes is not None and max_side is not None and max_side <= TILE:
        return image_features(pixels, shapes, max_side, kernel, keys)
    dense = pixels if shapes is None else densify(pixels, shapes, keys)
    base = robust_normalise(dense, keys=keys).select(*keys, "y", "x", "normalised")
    row, column = _lines(keys)
    across, down = row.rowsBetween(-1, 1), column.rowsBetween(-1, 1)
    wide = base.select("*", *[
        f("normalised").over(across).alias(n)
        for n, f in (("_s", F.sum), ("_c", F.count), ("_hi", F.max), ("_lo", F.min))
    ])
    near = wide.select(
        *keys, "y", "x", "normalised",
        (F.sum("_s").over(down) / F.sum("_c").over(down)).alias("local_mean"),
        F.max("_hi").over(down).alias("local_max"), F.min("_lo").over(down).alias("local_min"),
    )
    # the filter carries the other features along, so no pixel is joined with itself
    return top_hat(near.withColumn("detail", F.col("normalised")), kernel, keys, "detail")


def image_features(
    pixels: DataFrame, shapes: DataFrame, side: int, kernel: int = 5, keys: Sequence[str] = ("session",),
    carried: Sequence[str] = (),
) -> DataFrame:
    """:func:`pixel_features` of images of at most ``side`` rows and columns, each in one task.

    Only the rows present and one row with the shape of each image are shuffled. ``carried`` names
    numbers of the pixels that stay as they are; absent cells have zero there.
    """
    keys = list(keys)
    inner = ("y", "x", "_height", "_width")
    rows = pixels.filter("y >= 0 and x >= 0").select(
        *keys, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"),
        *[F.lit(None).cast("int").alias(n) for n in inner[2:]],
        *[F.col(n).cast("double").alias(n) for n in ("value", *carried)],
    )
    marks = shapes.select(
        *keys, *[F.lit(-1).alias(n) for n in inner[:2]], F.col("height").cast("int").alias("_height"),
        F.col("width").cast("int").alias("_width"), *[F.lit(None).cast("double").alias(n) for n in ("value", *carried)],
    )
    both = rows.unionByName(marks)
    kinds = {f.name: f for f in both.schema.fields}
    schema = T.StructType(
        [kinds[k] for k in (*keys, "y", "x")] + [T.StructField(n, T.DoubleType()) for n in (*carried, *FEATURES)]
    )
    widths, _ = _footprint(kernel)

    def run(table: pa.Table) -> pa.Table:
        y, x = (table.column(c).to_numpy() for c in ("y", "x"))
        mark = y < 0
        if not mark.any():  # an image of no known shape
            height = width = 0
        else:
            height, width = (int(table.column(c).to_numpy()[mark].max()) for c in inner[2:])
        if max(height, width) > side:
            raise ValueError(f"an image is larger than max_side={side}")
        inside = ~mark & (y < height) & (x < width)
        at = (y[inside], x[inside])

        def plane(name: str) -> np.ndarray:
            out = np.zeros((height, width))
            out[at] = table.column(name).to_numpy()[inside]
            return out

        missing = np.zeros((height, width), dtype=bool)
        missing[at] = table.column("value").is_null().to_numpy()[inside]
        found = _features(plane("value"), missing, widths)
        n = height * width
        cols = [pa.repeat(table.column(k)[0], n) for k in keys]
        cols += [pa.array(np.repeat(np.arange(height, dtype=np.int32), width)), pa.array(np.tile(np.arange(width, dtype=np.int32), height))]
        cols += [pa.array(plane(c).ravel()) for c in carried] + [pa.array(f.ravel()) for f in found]
        return pa.Table.from_arrays(cols, names=schema.fieldNames())

    return both.groupBy(*keys).applyInArrow(run, schema)


def _shifted(image: np.ndarray, dy: int, dx: int, fill: float) -> np.ndarray:
    """``image[y + dy, x + dx]`` at each place, ``fill`` where that lies outside."""
    height, width = image.shape
    out = np.full(image.shape, fill)
    if abs(dy) < height and abs(dx) < width:
        out[max(0, -dy):height - max(0, dy), max(0, -dx):width - max(0, dx)] = image[
            max(0, dy):height + min(0, dy), max(0, dx):width + min(0, dx)
        ]
    return out


def _of_all(pick, parts) -> np.ndarray:
    parts = iter(parts)
    out = next(parts)
    for part in parts:
        out = pick(out, part)
    return out


def _features(image: np.ndarray, missing: np.ndarray, widths: dict[int, int]) -> list[np.ndarray]:
    """The features of one image in their order; as in SQL, NaN is the largest number."""
    known = np.sort(image[np.isfinite(image) & ~missing])

    def at(share: float) -> float:
        rank = share * (len(known) - 1)
        below, above = known[math.floor(rank)], known[math.ceil(rank)]
        return below + (above - below) * (rank - math.floor(rank))

    base = np.zeros(image.shape)
    if len(known) and known[-1] > known[0]:
        low, high = at(1 / 100.0), at(99.7 / 100.0)
        if high <= low:
            low, high = known[0], known[-1]
        base = np.where(np.isnan(image), image, np.clip((image - low) / (high - low), 0.0, 1.0))
        base[missing] = 1.0

    def around(pick, image: np.ndarray, fill: float) -> np.ndarray:
        line = _of_all(pick, (_shifted(image, 0, d, fill) for d in (-1, 0, 1)))
        return _of_all(pick, (_shifted(line, d, 0, fill) for d in (-1, 0, 1)))

    def footprint(pick, image: np.ndarray, fill: float) -> np.ndarray:
        return _of_all(pick, (_shifted(image, dy, dx, fill) for dy, w in widths.items() for dx in range(-w, w + 1)))

    mean = around(np.add, base, 0.0) / around(np.add, np.ones(base.shape), 0.0)
    opened = footprint(np.maximum, footprint(np.fmin, base, np.nan), -np.inf)
    return [base, mean, around(np.maximum, base, -np.inf), around(np.fmin, base, np.nan), base - opened]


class ForegroundModel:
    """A fitted linear model, applied as a plain column expression."""

    def __init__(self, weights: Sequence[float], intercept: float, strength: float, dice: float = 0.0):
        self.weights, self.intercept = [float(w) for w in weights], float(intercept)
        self.strength, self.dice = strength, dice

    def store(self, spark: SparkSession, path: str) -> None:
        """Write the model as a table: a row for each weight, the intercept and the facts of the fit."""
        rows = [("weight", n, w) for n, w in zip(FEATURES, self.weights)]
        rows += [("fit", n, float(v)) for n, v in (("intercept", self.intercept), ("strength", self.strength), ("dice", self.dice))]
        spark.createDataFrame(rows, MODEL).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ForegroundModel:
        found = {(r.part, r.name): r.value for r in spark.read.schema(MODEL).parquet(path).collect()}
        missing = [n for n in FEATURES if ("weight", n) not in found]
        if missing:
            raise ValueError(f"{path} has no weights for {', '.join(missing)}")
        fit = [found[("fit", n)] for n in ("intercept", "strength", "dice")]
        return cls([found[("weight", n)] for n in FEATURES], *fit)

    def logit(self) -> Column:
        z = F.lit(self.intercept)
        for name, weight in zip(FEATURES, self.weights):
            z = z + F.lit(weight) * F.col(name)
        return z


def fit_foreground(
    train: DataFrame, validation: DataFrame, pos_weight: float = 1.0,
    regularisation: Sequence[float] = (0.0, 0.01), max_iter: int = 20,
) -> ForegroundModel:
    """Fit by weighted cross entropy; keep the strength with the best validation Dice.

    ``train`` and ``validation`` are stored feature rows with ``session`` and ``mask``.
    Only the coefficients and the few candidate scores come back to the driver.
    """
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="_features")
    weighted = assembler.transform(
        train.withColumn("_w", F.when(F.col("mask") > 0, float(pos_weight)).otherwise(1.0))
    ).select("_features", "mask", "_w")
    best = None
    for strength in regularisation:
        fitted = LogisticRegression(
            featuresCol="_features", labelCol="mask", weightCol="_w", regParam=float(strength),
            maxIter=max_iter,
        ).fit(weighted)
        model = ForegroundModel(fitted.coefficients, fitted.intercept, float(strength))
        scored = validation.select(
            F.col("session").alias("sample"), F.lit(0).alias("channel"),
            model.logit().alias("z"), F.col("mask").alias("t"),
        )
        dice = batch_dice(scored).first()["pixel_dice"]
        model.dice = float("-inf") if dice is None else dice
        if best is None or model.dice > best.dice:
            best = model
    return best


def foreground_probability(model: ForegroundModel, features: DataFrame) -> DataFrame:
    """``(session, y, x, probability)`` ready for labelling."""
    return features.select("session", "y", "x", sigmoid(model.logit()).alias("probability"))
