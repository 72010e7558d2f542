"""Segmentation parameters: ranges, defaults, per-image advice, operating points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.functions.scalars import column_name
from pixelloom.operators.intensity import contrast_and_brightness
from pixelloom.operators.spread import group_quantiles, merge_join
from pixelloom.session import StoredTable

# fixed values: name, kind, default, minimum, maximum, step
PARAMETERS = [
    ("solidity min", "float", 0.1, 0.0, 1.0, 0.01),
    ("eccentricity min", "float", 0.75, 0.0, 1.0, 0.01),
    ("thinness max", "float", 0.8, 0.0, 1.0, 0.01),
    ("tophat kernel", "int", 11, 1, 99, 2),
    ("clahe clip", "float", 2.0, 0.1, 10.0, 0.1),
    ("MSER max variation", "float", 1.2, 0.0, 10.0, 0.05),
    ("MSER delta", "int", 5, 1, 50, 1),
    ("MSER min area", "int", 30, 1, 5000, 1),
    ("MSER max area", "int", 15000, 10, 100000, 100),
    ("aspect ratio min", "float", 1.2, 1.0, 10.0, 0.05),
    ("clip-percentile", "float", 99.0, 0.0, 100.0, 0.1),
    ("area min", "int", 30, 1, 5000, 1),
    ("MSER threshold", "float", 85.0, 0.0, 100.0, 0.1),
]
# fixed values: operating point when nothing else names one
DEFAULT_THRESHOLD = 0.5
DEFAULT_MIN_SIZE = 30


def default_parameters() -> dict[str, float]:
    return {name: default for name, _, default, *_ in PARAMETERS}


def parameter_table(spark: SparkSession) -> DataFrame:
    schema = "name string, kind string, default double, minimum double, maximum double, step double"
    rows = [(n, k, *map(float, rest)) for n, k, *rest in PARAMETERS]
    return spark.createDataFrame(rows, schema)


def recommend(
    pixels: DataFrame, labels: DataFrame | None = None, shapes: DataFrame | None = None,
    keys: Sequence[str] = ("session",), value: str = "value",
) -> DataFrame:
    """One row of parameters per image, from its contrast, brightness and ROI areas."""
    keys = list(keys)
    facts = contrast_and_brightness(pixels, shapes, keys, value)
    if labels is not None:
        # the percentiles read the areas several times
        areas = StoredTable(labels.filter("label > 0").groupBy(*keys, "label").agg(F.count("*").alias("area"))).df
        facts = merge_join(facts, group_quantiles(areas, keys, "area", {"_mid": 0.5, "_top": 0.95}), keys, "left")
    else:
        facts = facts.withColumn("_mid", F.lit(None).cast("double")).withColumn(
            "_top", F.lit(None).cast("double")
        )
    dim = F.col("contrast") < 0.12
    bright = ~dim & (F.col("bright_fraction") > 0.12)
    small = F.greatest(F.lit(10.0), F.bround(F.col("_mid") * 0.2, 0))
    large = F.greatest(F.lit(1000.0), F.bround(F.col("_top") * 3, 0))
    has = F.col("_mid").isNotNull()
    adjusted: dict[str, Column] = {
        "clahe clip": F.when(dim, 3.0),
        "clip-percentile": F.when(dim, 99.5),
        "MSER threshold": F.when(dim, 80.0).when(bright, 90.0),
        "MSER max variation": F.when(bright, 0.9),
        "MSER min area": F.when(has, small),
        "area min": F.when(has, small),
        "MSER max area": F.when(has, large),
    }
    out = []
    for name, kind, default, *_ in PARAMETERS:
        chosen = F.lit(float(default))
        if name in adjusted:
            chosen = F.coalesce(adjusted[name], chosen)
        out.append(chosen.cast("int" if kind == "int" else "double").alias(column_name(name)))
    return facts.select(*keys, "contrast", "bright_fraction", *out)


def resolve_operating_point(
    requests: DataFrame, registry: DataFrame, checkpoints: DataFrame
) -> DataFrame:
    """Threshold, size bounds and flip averaging for each request.

    Order of precedence: the request, the registry entry of its model, the settings
    kept with the checkpoint, the defaults. ``max_size`` has no request form and flip
    averaging has no checkpoint form. A request without a checkpoint of its own must
    name a registered model.

    ``requests``: request_id, model, checkpoint, threshold, min_size, tta.
    ``registry``: model, checkpoint, threshold, min_size, max_size, tta.
    ``checkpoints``: checkpoint, threshold, min_size, max_size.
    Registry and checkpoint tables hold one row per model; whether they are small
    enough to broadcast is left to their measured size.
    """
    asked = requests.select(
        "request_id", "model", "checkpoint", *[F.col(c).alias(f"_a_{c}") for c in ("threshold", "min_size", "tta")]
    )
    named = registry.select(
        "model", F.col("checkpoint").alias("_r_checkpoint"), F.lit(True).alias("_known"),
        *[F.col(c).alias(f"_r_{c}") for c in ("threshold", "min_size", "max_size", "tta")],
    )
    kept = checkpoints.select(
        "checkpoint", *[F.col(c).alias(f"_c_{c}") for c in ("threshold", "min_size", "max_size")]
    )
    unknown = F.raise_error(F.concat(F.lit("no registry entry is named "), F.col("model")))
    path = F.coalesce("checkpoint", F.when(F.col("_known"), F.col("_r_checkpoint")).otherwise(unknown.cast("string")))
    joined = asked.join(named, "model", "left").withColumn("checkpoint", path).join(kept, "checkpoint", "left")
    return joined.select(
        "request_id", "model", "checkpoint",
        F.coalesce("_a_threshold", "_r_threshold", "_c_threshold", F.lit(DEFAULT_THRESHOLD)).alias("threshold"),
        F.coalesce("_a_min_size", "_r_min_size", "_c_min_size", F.lit(DEFAULT_MIN_SIZE)).cast("int").alias("min_size"),
        F.coalesce("_r_max_size", "_c_max_size").cast("int").alias("max_size"),
        F.coalesce("_a_tta", "_r_tta", F.lit(False)).alias("tta"),
    )
