"""Scoring a split end to end, from probabilities and curated labels to scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.operators.components import TILE, probability_to_labels
from pixelloom.operators.manifest import select_rows
from pixelloom.operators.scores import score_sessions
from pixelloom.operators.spread import salted_join


def evaluate_split(
    prob: DataFrame,
    target_labels: DataFrame,
    manifest: DataFrame,
    split: str = "test",
    threshold: float = 0.5,
    min_size: int = 30,
    max_size: int | None = None,
    tile: int = TILE,
    max_side: int | None = None,
) -> DataFrame:
    """Score every included session of a split.

    Pixels of other sessions are dropped before any labelling.
    """
    rows = select_rows(manifest, included_only=True, split=split)
    wanted = rows.select("session")
    prob = prob.select("session", "y", "x", "probability").filter(F.col("probability") >= threshold)
    pred = probability_to_labels(
        salted_join(prob, wanted, ["session"], ["y"], "left_semi"), threshold, min_size, max_size,
        tile=tile, max_side=max_side,
    )
    target = salted_join(target_labels, wanted, ["session"], ["y"], "left_semi")
    return score_sessions(pred, target, rows)
