"""Manifest, score and history tables as CSV."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.operators.losses import stack_histories
from pixelloom.operators.manifest import coerce_manifest, select_rows
from pixelloom.schemas import MANIFEST_COLUMNS, MANIFEST_TEXT


def _write(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def read_manifest(
    spark: SparkSession, path: str, included_only: bool = False, split: str | None = None
) -> DataFrame:
    """Typed manifest rows; text cells are read by name and cast leniently."""
    text = spark.read.option("header", True).option("enforceSchema", False).schema(MANIFEST_TEXT).csv(path)
    return select_rows(coerce_manifest(text), included_only, split)


def write_manifest(manifest: DataFrame, path: str) -> None:
    """The manifest columns in their fixed order; columns not present are blank."""
    present = set(manifest.columns)
    _write(manifest.select(*[
        F.col(c) if c in present else F.lit(None).cast("string").alias(c) for c in MANIFEST_COLUMNS
    ]), path)


def write_scores(scores: DataFrame, path: str) -> None:
    """Score rows with columns in name order."""
    _write(scores.select(*sorted(scores.columns)), path)


def write_history(histories: Sequence[DataFrame], path: str) -> None:
    """All history rows under the union of their columns, replacing the last write."""
    _write(stack_histories(histories), path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Every column is a number, so no second pass over the file is needed for types."""
    text = spark.read.option("header", True).csv(path)
    return text.select(*[
        F.col(c).cast("double").cast("int").alias(c) if c == "epoch" else F.col(c).cast("double").alias(c)
        for c in text.columns
    ])
