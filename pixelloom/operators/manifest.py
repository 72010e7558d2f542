"""The session table: file pairing, exclusion, splits, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.functions.scalars import (
    animal_of, keyed_digest, lenient_double, lenient_int, parse_bool,
)
from pixelloom.operators.spread import bucketed_row_number, salted_join, shapes_once
from pixelloom.schemas import MANIFEST_COLUMNS, MANIFEST_KINDS

# fixed values: file names and exclusion reasons
REF_NAME = "ref_mat_ch2.npy"
REF_SUFFIX = "_ref_mat_ch2.npy"
ROI_SUFFIX = "_ROI_dict.npy"
NO_FOLDER = "no processed_data"
NO_REFERENCE = "no channel-2 reference"
NO_ROIS = "no ROI dict"
HAS_1100 = "contains 1100 reference"


def is_reference(name: str = "name") -> Column:
    return (F.col(name) == REF_NAME) | F.col(name).endswith(REF_SUFFIX)


def reference_images(files: DataFrame) -> DataFrame:
    """The reference image of each session: the canonical name, else the first by name.

    ``files`` is ``(session, name)`` with one row per file in the session's folder.
    A minimum over (is archive, name) combines before the shuffle.
    """
    archive = F.col("name") != REF_NAME
    return files.filter(is_reference()).groupBy("session").agg(
        F.min(F.struct(archive.alias("a"), F.col("name"))).alias("_r")
    ).select("session", F.col("_r.name").alias("image_name"))


def pair_files(files: DataFrame) -> DataFrame:
    """Reference image and ROI file of each session that has both.

    A ROI file starting with the recording's prefix is preferred, then name order.
    """
    images = reference_images(files).withColumn(
        "_prefix",
        F.when(F.col("image_name") == REF_NAME, F.col("session")).otherwise(
            F.replace(F.col("image_name"), F.lit(REF_SUFFIX), F.lit(""))
        ),
    )
    rois = files.filter(F.col("name").endswith(ROI_SUFFIX))
    matched = salted_join(rois, images, ["session"], ["name"], "inner")
    other = ~F.col("name").startswith(F.col("_prefix"))
    return matched.groupBy("session", "image_name").agg(
        F.min(F.struct(other.alias("o"), F.col("name"))).alias("_r")
    ).select("session", "image_name", F.col("_r.name").alias("roi_name"))


def exclusion_reasons(sessions: DataFrame, files: DataFrame) -> DataFrame:
    """``exclusion_reason`` per session, first match wins, blank when usable.

    ``sessions`` is ``(session, has_processed, ...)``.
    """
    seen = files.groupBy("session").agg(
        F.bool_or(is_reference()).alias("_ref"),
        F.bool_or(F.col("name").endswith(ROI_SUFFIX)).alias("_roi"),
        F.bool_or(F.col("name").contains("1100") & F.col("name").endswith(".npy")).alias("_1100"),
    )
    reason = (
        F.when(~F.col("has_processed"), NO_FOLDER)
        .when(~F.coalesce("_ref", F.lit(False)), NO_REFERENCE)
        .when(~F.coalesce("_roi", F.lit(False)), NO_ROIS)
        .when(F.coalesce("_1100", F.lit(False)), HAS_1100)
        .otherwise("")
    )
    return sessions.join(seen, "session", "left").select(
        *sessions.columns, reason.alias("exclusion_reason"), (reason == "").alias("included")
    )


def build_manifest(
    sessions: DataFrame, files: DataFrame, shapes: DataFrame, summaries: DataFrame
) -> DataFrame:
    """One manifest row per row of ``sessions``; excluded rows carry zero summaries.

    ``sessions`` is ``(session, processed_path, has_processed)``, ``shapes`` holds the
    image shape and ``summaries`` the ROI summary of each decoded session.
    """
    reasoned = exclusion_reasons(sessions, files)
    joined = (
        reasoned.join(pair_files(files), "session", "left")
        .join(shapes_once(shapes), "session", "left")
        .join(summaries.drop("height", "width").distinct(), "session", "left")
    )
    ok = F.col("included")

    def path(name: str) -> Column:
        return F.when(ok, F.concat_ws("/", "processed_path", name)).otherwise("")

    columns = {
        "animal": animal_of("session"),
        "image_path": path("image_name"),
        "roi_path": path("roi_name"),
        "height": F.when(ok, F.col("height")),
        "width": F.when(ok, F.col("width")),
        "split": F.lit(""),
    }
    for name, kind in MANIFEST_KINDS.items():
        if name in summaries.columns and name not in columns:
            columns[name] = F.when(ok, F.coalesce(F.col(name), F.lit(0))).otherwise(F.lit(0)).cast(kind)
    return joined.select(*[columns.get(c, F.col(c)).alias(c) for c in MANIFEST_COLUMNS])


def coerce_manifest(text: DataFrame) -> DataFrame:
    """Typed manifest rows from text cells."""
    kinds = {
        "int": lambda c: lenient_int(c), "bigint": lambda c: lenient_int(c, "bigint"),
        "double": lenient_double, "boolean": parse_bool,
    }
    out = []
    for name in text.columns:
        kind = MANIFEST_KINDS.get(name)
        out.append((kinds[kind](name) if kind else F.coalesce(F.col(name), F.lit(""))).alias(name))
    return text.select(*out)


def select_rows(manifest: DataFrame, included_only: bool = False, split: str | None = None) -> DataFrame:
    if included_only:
        manifest = manifest.filter(F.col("included"))
    if split is not None:
        manifest = manifest.filter(F.col("split") == split)
    return manifest


def require_rows(manifest: DataFrame, split: str) -> DataFrame:
    """The rows of a training split; an empty split is an error."""
    rows = select_rows(manifest, included_only=True, split=split)
    if rows.isEmpty():
        raise ValueError(f"split {split!r} holds no included session")
    return rows


# ----------------------------------------------------------------------- splits
def split_count(n: Column, fraction: float) -> Column:
    """Held-out rows out of ``n``: none for one row or fraction zero, else at least one."""
    if fraction <= 0:
        return F.lit(0)
    rounded = F.bround(n * F.lit(float(fraction)), 0).cast("int")
    return F.when(n <= 1, F.lit(0)).otherwise(F.greatest(F.lit(1), rounded))


def assign_splits(
    manifest: DataFrame, val_fraction: float = 0.15, test_fraction: float = 0.15, seed: int = 7
) -> DataFrame:
    """Whole sessions to test, val and train inside each animal; excluded rows get ''.

    The order within an animal is a seeded hash of the session, so it does not depend
    on partitioning. Hashes are even, so their first digits make balanced buckets.
    """
    rows = manifest.drop("split")
    used = rows.filter("included").withColumn("_h", keyed_digest(seed, "session"))
    ranked = bucketed_row_number(
        used, ["animal"], F.substring("_h", 1, 3), [F.col("_h"), F.col("session")], "_rank"
    )
    totals = used.groupBy("animal").agg(F.count("*").cast("int").alias("_n"))
    counted = salted_join(ranked, totals, ["animal"], ["session"], "inner")
    n_test = split_count(F.col("_n"), test_fraction)
    n_val = split_count(F.col("_n") - F.col("_nt"), val_fraction)
    placed = counted.withColumn("_nt", n_test).withColumn("_nv", n_val).select(
        *rows.columns,
        F.when(F.col("_rank") <= F.col("_nt"), "test")
        .when(F.col("_rank") <= F.col("_nt") + F.col("_nv"), "val")
        .otherwise("train").alias("split"),
    )
    # each row keeps its own place, so rows of one session are not joined with each other
    excluded = rows.filter(~F.coalesce("included", F.lit(False))).withColumn("split", F.lit(""))
    return placed.unionByName(excluded)


def preview_sample(manifest: DataFrame, n: int, seed: int = 7) -> DataFrame:
    """Up to ``n`` sessions without replacement, the same ones for the same seed."""
    return manifest.orderBy(keyed_digest(seed, "session"), "session").limit(n)


# -------------------------------------------------------------------- summaries
def manifest_totals(manifest: DataFrame) -> DataFrame:
    used = F.col("included")
    return manifest.agg(
        F.count("*").alias("sessions"),
        F.count(F.when(used, 1)).alias("included_sessions"),
        F.countDistinct(F.when(used, F.col("animal"))).alias("animals"),
        F.coalesce(F.sum(F.when(used, F.col("roi_count"))), F.lit(0)).alias("rois"),
    )


def animals(manifest: DataFrame) -> DataFrame:
    return manifest.filter("included").select("animal").distinct().orderBy("animal")


def split_counts(manifest: DataFrame, blank: str = "") -> DataFrame:
    """Included sessions per split, with blank splits under the given name."""
    name = F.coalesce(F.nullif("split", F.lit("")), F.lit(blank)).alias("split")
    return manifest.filter("included").groupBy(name).agg(F.count("*").alias("sessions"))


def exclusion_counts(manifest: DataFrame) -> DataFrame:
    name = F.coalesce(F.nullif("exclusion_reason", F.lit("")), F.lit("not included"))
    return manifest.filter("not included").groupBy(name.alias("reason")).agg(
        F.count("*").alias("sessions")
    )


def census(manifest: DataFrame) -> DataFrame:
    """Sessions, ROIs and foreground pixels per split and animal, with subtotals."""
    return manifest.filter("included").rollup("split", "animal").agg(
        F.count("*").alias("sessions"), F.sum("roi_count").alias("rois"),
        F.sum("positive_pixels").alias("foreground_pixels"),
    )
