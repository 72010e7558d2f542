"""Curation edits as set operations over label tables.

``labels`` is ``(session, y, x, label)``; ``selected`` and ``fixed`` are distinct
``(session, label)`` rows. Every edit works on all sessions at once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.operators.components import labels_at_points, probability_to_labels, relabel_map
from pixelloom.operators.spread import bucketed_row_number, hash_join, merge_join, salted_join, shapes_once
from pixelloom.operators.words import pack_words, word_pixels
from pixelloom.session import StoredTable

ID = ["session", "label"]
UNDO_DEPTH = 30


@dataclass(frozen=True)
class Curation:
    labels: DataFrame
    selected: DataFrame
    fixed: DataFrame


def label_ids(labels: DataFrame) -> DataFrame:
    return labels.filter("label > 0").select(*ID).distinct()


def _none(ids: DataFrame) -> DataFrame:
    return ids.limit(0)


def _minus(left: DataFrame, right: DataFrame) -> DataFrame:
    return merge_join(left, right.select(*ID), ID, "left_anti")


def _both(left: DataFrame, right: DataFrame) -> DataFrame:
    return merge_join(left, right.select(*ID), ID, "left_semi")


def _either(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.select(*ID).unionByName(right.select(*ID)).distinct()


# --------------------------------------------------------------------- hit test
def hit_test(points: DataFrame, labels: DataFrame, shapes: DataFrame, point_id: str = "event_id") -> DataFrame:
    """The label under each point; points on background or outside give no row.

    Coordinates round half to even. The distinct clicked cells meet the label table
    first, so a cell clicked very often costs one row there.
    """
    at = points.withColumn("y", F.bround("yf", 0).cast("int")).withColumn("x", F.bround("xf", 0).cast("int"))
    shaped = salted_join(at, shapes_once(shapes), ["session"], [point_id], "inner")
    inside = shaped.filter("y >= 0 and x >= 0 and y < height and x < width").drop("height", "width")
    cell = ["session", "y", "x"]
    hits = merge_join(inside.select(*cell).distinct(), labels.filter("label > 0"), cell)
    return salted_join(inside, hits, cell, [point_id], "inner", salts=8).select(
        point_id, "session", "y", "x", "label"
    )


# -------------------------------------------------------------------- selection
def select_all(labels: DataFrame) -> DataFrame:
    return label_ids(labels)


def invert_selection(labels: DataFrame, selected: DataFrame) -> DataFrame:
    return _minus(label_ids(labels), selected)


def add_to_selection(selected: DataFrame, picked: DataFrame) -> DataFrame:
    return _either(selected, picked)


def toggle_selection(selected: DataFrame, picked: DataFrame) -> DataFrame:
    return _minus(selected, picked).unionByName(_minus(picked.select(*ID), selected))


def replace_selection(selected: DataFrame, picked: DataFrame) -> DataFrame:
    """Sessions with a pick hold just that pick; the others keep their selection."""
    clicked = picked.select("session").distinct()
    return merge_join(selected, clicked, ["session"], "left_anti").unionByName(picked.select(*ID).distinct())


def clear_selection(selected: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """Nothing selected, in ``sessions(session)`` or everywhere."""
    return _none(selected) if sessions is None else selected.join(sessions, "session", "left_anti")


# ------------------------------------------------------------------- fixed marks
def clear_fixed(fixed: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """No marks, in ``sessions(session)`` or everywhere."""
    return clear_selection(fixed, sessions)


def fix_selected(labels: DataFrame, selected: DataFrame, fixed: DataFrame) -> DataFrame:
    return _either(fixed, _both(selected, label_ids(labels)))


def unfix_selected(selected: DataFrame, fixed: DataFrame) -> DataFrame:
    return _minus(fixed, selected)


def toggle_fixed(labels: DataFrame, selected: DataFrame, fixed: DataFrame) -> DataFrame:
    """Unfix where every selected ROI of the session is fixed already, else fix them."""
    present = _both(selected, label_ids(labels))
    marked = merge_join(present, fixed.select(*ID, F.lit(1).alias("_f")), ID, "left")
    whole = marked.groupBy("session").agg(F.min(F.coalesce("_f", F.lit(0))).alias("_all"))
    unfix = selected.join(whole.filter("_all = 1").select("session"), "session", "left_semi")
    fix = present.join(whole.filter("_all = 0").select("session"), "session", "left_semi")
    return _either(_minus(fixed, unfix), fix)


def keep_present(ids: DataFrame, labels: DataFrame) -> DataFrame:
    """Drop ids no ROI carries any more."""
    return _both(ids, label_ids(labels))


# ------------------------------------------------------------------------ edits
def remap_ids(ids: DataFrame, names: DataFrame) -> DataFrame:
    """Old ids to new ones; ids without a new name drop out."""
    return merge_join(ids, names, ID).select("session", F.col("new_label").alias("label"))


def _renamed(labels: DataFrame, fixed: DataFrame, touched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Compact the labels of the touched sessions and carry the fixed marks along."""
    ids = label_ids(labels)
    names = relabel_map(merge_join(ids, touched, ["session"], "left_semi")).unionByName(
        merge_join(ids, touched, ["session"], "left_anti").withColumn("new_label", F.col("label"))
    )
    moved = salted_join(labels, names, ID, ["y"], "inner", salts=8, hashed=True).select(
        "session", "y", "x", F.col("new_label").alias("label")
    )
    return moved, remap_ids(fixed, names)


def delete_selected(state: Curation) -> Curation:
    """Remove the selected ROIs; sessions without a selection stay as they are."""
    touched = state.selected.select("session").distinct()
    left = salted_join(state.labels, state.selected.select(*ID), ID, ["y"], "left_anti", salts=8, hashed=True)
    labels, fixed = _renamed(left, state.fixed, touched)
    return Curation(labels, _none(state.selected), fixed)


def clear_unfixed(state: Curation) -> Curation:
    """Keep fixed ROIs only; a session with none loses all its ROIs."""
    left = salted_join(state.labels, state.fixed.select(*ID), ID, ["y"], "left_semi", salts=8, hashed=True)
    labels, fixed = _renamed(left, state.fixed, state.labels.select("session").distinct())
    return Curation(labels, _none(state.selected), fixed)


def merge_selected(state: Curation) -> Curation:
    """Selected ROIs of a session become one, under the smallest id, if there are two
    or more; it is fixed when any of them was."""
    marked = merge_join(state.selected.select(*ID), state.fixed.select(*ID, F.lit(1).alias("_f")), ID, "left")
    groups = marked.groupBy("session").agg(
        F.count("*").alias("_n"), F.min("label").alias("_keep"), F.max("_f").alias("_fixed")
    ).filter("_n >= 2")
    members = merge_join(state.selected.select(*ID), groups, ["session"]).select(*ID, "_keep")
    joined = salted_join(state.labels, members, ID, ["y"], "left", salts=8, hashed=True).select(
        "session", "y", "x", F.coalesce("_keep", "label").alias("label")
    )
    added = groups.filter("_fixed = 1").select("session", F.col("_keep").alias("label"))
    labels, fixed = _renamed(joined, _either(state.fixed, added), groups.select("session"))
    selected = state.selected.select(*ID).join(groups.select("session"), "session", "left_anti")
    return Curation(labels, selected, fixed)


def rebuild(
    prob: DataFrame, threshold: float | DataFrame, min_size: int | None = None, **options
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """ROIs from a kept probability table; the selection and fixed marks are emptied.

    ``threshold`` may be a table ``(session, threshold, min_size)`` of each session's own point; as in
    a single rebuild, there is no upper bound on sizes.
    """
    if isinstance(threshold, DataFrame):
        points = threshold.select("session", "threshold", "min_size", F.lit(None).cast("int").alias("max_size"))
        labels = labels_at_points(prob, points, **options)
    else:
        labels = probability_to_labels(prob, threshold, min_size, **options)
    nothing = _none(labels.select(*ID))
    return labels, nothing, nothing


# --------------------------------------------------------------------- versions
def stack_versions(states: list[Curation], depth: int | None = UNDO_DEPTH) -> Curation:
    """Number snapshots 0, 1, ... and keep the newest ``depth`` (None: all) plus the current."""
    first = 0 if depth is None else max(0, len(states) - 1 - depth)
    parts = [
        [df.withColumn("version", F.lit(v)) for df in (s.labels, s.selected, s.fixed)]
        for v, s in enumerate(states) if v >= first
    ]
    stacked = parts[0]
    for more in parts[1:]:
        stacked = [a.unionByName(b) for a, b in zip(stacked, more)]
    return Curation(*stacked)


def undo(stacked: Curation, current: int) -> Curation:
    """The state before version ``current``."""
    return Curation(*[
        df.filter(F.col("version") == current - 1).drop("version")
        for df in (stacked.labels, stacked.selected, stacked.fixed)
    ])


# --------------------------------------------------------------------- listings
def roi_listing(labels: DataFrame, fixed: DataFrame) -> DataFrame:
    """Id, pixel count and fixed mark per ROI."""
    sizes = labels.filter("label > 0").groupBy(*ID).agg(F.count("*").alias("pixels"))
    return merge_join(sizes, fixed.select(*ID, F.lit("yes").alias("fixed")), ID, "left").select(
        *ID, "pixels", F.coalesce("fixed", F.lit("")).alias("fixed")
    )


def status_counts(state: Curation) -> DataFrame:
    """ROIs, selected and fixed per session."""
    parts = [
        (label_ids(state.labels), 1, 0, 0), (state.selected.select(*ID), 0, 1, 0),
        (state.fixed.select(*ID), 0, 0, 1),
    ]
    rows = None
    for ids, r, s, f in parts:
        one = ids.select(
            "session", F.lit(r).alias("rois"), F.lit(s).alias("selected"), F.lit(f).alias("fixed")
        )
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("session").agg(
        F.sum("rois").alias("rois"), F.sum("selected").alias("selected"), F.sum("fixed").alias("fixed")
    )


# -------------------------------------------------------------- fixed + proposed
def take_in_order(candidates: DataFrame) -> DataFrame:
    """Of overlapping ``(session, roi_id, y, x)``, or their words, those that a pass by rising id would keep.

    Each is kept whole unless it shares a pixel with one kept before it. A round keeps the
    candidates that come first at all of their pixels and drops what touches them; words
    are compared with all that lies before them, so no pairs are made. Every round is stored.
    """
    word, roi = ["session", "y", "_w"], ["session", "roi_id"]
    open_ = StoredTable(_words_of(candidates).select(*roi, "y", "_w", "bits"), n=F.count("*"))
    kept = open_.df.limit(0)
    before = Window.partitionBy(*word).orderBy("roi_id").rowsBetween(Window.unboundedPreceding, -1)
    while open_.metrics["n"]:
        lower = open_.df.withColumn("_lower", F.coalesce(F.bit_or("bits").over(before), F.lit(0).cast("bigint")))
        whole = lower.groupBy(*roi).agg(F.min(F.col("bits").bitwiseAND(F.col("_lower")) == 0).alias("_all"))
        won = StoredTable(hash_join(open_.df, whole.filter("_all"), roi, "left_semi")).df
        kept = kept.unionByName(won)
        open_ = StoredTable(hash_join(open_.df, _touching(open_.df, won), roi, "left_anti"), n=F.count("*"))
    return word_pixels(kept)


def _words_of(rois: DataFrame) -> DataFrame:
    return rois if "bits" in rois.columns else pack_words(rois, ["session", "roi_id"])


def _touching(words: DataFrame, taken: DataFrame) -> DataFrame:
    """``(session, roi_id)`` of the words that share a pixel with ``taken``."""
    word = ["session", "y", "_w"]
    held = taken.groupBy(*word).agg(F.bit_or("bits").alias("_held"))
    met = merge_join(words, held, word).filter(F.col("bits").bitwiseAND(F.col("_held")) != 0)
    return met.select("session", "roi_id").distinct()


def combine_fixed(
    fixed_rois: DataFrame, candidates: DataFrame, overlapping: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Fixed ROIs first, then candidates that touch none of their pixels.

    Both inputs are long ``(session, roi_id, y, x)``; candidates are disjoint, as those
    drawn from one label image are, or ``overlapping`` and taken in order; these may also be words
    ``(session, roi_id, y, _w, bits)``. Returns ``(session, label, is_fixed, y, x)`` and the label
    table. A candidate that conflicts is dropped whole.
    """
    taken = pack_words(fixed_rois, ["session"])
    if overlapping:
        words = _words_of(candidates)
        free = take_in_order(hash_join(words, _touching(words, taken), ["session", "roi_id"], "left_anti"))
    else:
        clash = _touching(_words_of(candidates), taken)
        free = salted_join(candidates, clash, ["session", "roi_id"], ["y", "x"], "left_anti", salts=8, hashed=True)
    return number_fixed_then_free(fixed_rois, free)


def number_fixed_then_free(fixed_rois: DataFrame, free: DataFrame) -> tuple[DataFrame, DataFrame]:
    both = fixed_rois.select("session", "roi_id", "y", "x", F.lit(0).alias("_late")).unionByName(
        free.select("session", "roi_id", "y", "x", F.lit(1).alias("_late"))
    )
    ids = both.select("session", "_late", "roi_id").distinct()
    order = F.col("_late") * F.lit(1 << 40).cast("bigint") + F.floor(F.col("roi_id") / 1024)
    names = bucketed_row_number(ids, ["session"], order, [F.col("roi_id")], "label").withColumn(
        "label", F.col("label").cast("int")
    )
    rois = salted_join(both, names, ["session", "_late", "roi_id"], ["y", "x"], "inner", salts=8, hashed=True).select(
        "session", "label", (F.col("_late") == 0).alias("is_fixed"), "y", "x"
    )
    # a pixel of two fixed ROIs belongs to the later one
    return rois, rois.groupBy("session", "y", "x").agg(F.max("label").alias("label"))
