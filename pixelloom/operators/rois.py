"""Ragged ROI records: cleaning, rasterising, summaries, masks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.operators.spread import bucketed_row_number, group_quantiles, merge_join, salted_join, shapes_once
from pixelloom.operators.words import pack_words, up_to, word_pixels
from pixelloom.session import StoredTable


def _cast_pixels(name: str) -> Column:
    """Text pixels to whole numbers; fractions are cut, a bad entry gives null.

    Whole-number text is read as such so that large values stay exact, and booleans
    count as 0 and 1.
    """

    def one(v: Column) -> Column:
        flag = F.when(F.lower(v) == "true", F.lit(1)).when(F.lower(v) == "false", F.lit(0))
        return F.coalesce(
            v.try_cast("bigint"), v.try_cast("double").try_cast("bigint"), flag.cast("bigint")
        )

    return F.transform(name, one)


def clean_rois(raw: DataFrame, shapes: DataFrame, keys: Sequence[str] = ("session",)) -> DataFrame:
    """Clean records ``(keys, roi_id, ord, xpix[], ypix[])`` of text pixels.

    Record-local array work: no shuffle beyond attaching the image shape. Every
    record is returned with its ``invalid`` count and a ``kept`` flag; dropped
    records have empty arrays. One record can count twice (unequal lengths and an
    out-of-bounds pixel). Records that are parts of an ROI keep their ``part`` and tell
    the faults apart, for :func:`whole_rois`.
    """
    keys = list(keys)
    cast = salted_join(
        raw.withColumn("_cx", _cast_pixels("xpix")).withColumn("_cy", _cast_pixels("ypix")),
        shapes_once(shapes, keys), keys, ["roi_id"], "inner",
    )
    broken = (
        F.col("_cx").isNull() | F.col("_cy").isNull()
        | F.exists("_cx", lambda v: v.isNull()) | F.exists("_cy", lambda v: v.isNull())
    )
    shorter = F.least(F.size("_cx"), F.size("_cy"))
    pairs = F.slice(F.arrays_zip(F.col("_cx").alias("x"), F.col("_cy").alias("y")), 1, shorter)
    inside = F.filter(
        "_pairs",
        lambda p: (p["x"] >= 0) & (p["x"] < F.col("width")) & (p["y"] >= 0) & (p["y"] < F.col("height")),
    )
    empty = F.array().cast("array<struct<x:bigint,y:bigint>>")
    out = (
        cast.withColumn("_broken", broken)
        .withColumn("_pairs", F.when(F.col("_broken"), empty).otherwise(pairs))
        .withColumn("_in", inside)
    )
    faults = F.struct(
        F.col("_broken").cast("int").alias("broken"),
        (~F.col("_broken") & (F.size("_cx") != F.size("_cy"))).cast("int").alias("uneven"),
        (~F.col("_broken") & (F.size("_in") < F.size("_pairs"))).cast("int").alias("outside"),
    )
    out = out.withColumn("_faults", faults)
    parts = [F.col("part"), F.col("_faults").alias("faults")] if "part" in raw.columns else []
    return out.select(
        *keys, "roi_id", "ord", _fault_count("_faults").alias("invalid"), (F.size("_in") > 0).alias("kept"),
        F.col("_in.x").alias("xpix"), F.col("_in.y").alias("ypix"), *parts,
    )


def _fault_count(faults: str) -> Column:
    """A broken record counts once, whatever else it is."""
    f = F.col(faults)
    return F.when(f["broken"] > 0, F.lit(1)).otherwise(f["uneven"] + f["outside"])


def whole_rois(cleaned: DataFrame, keys: Sequence[str] = ("session",)) -> DataFrame:
    """``area``, ``invalid`` and ``kept`` of each ROI of cleaned records, its parts taken together.

    A fault of one rule counts once per ROI, however many of its parts show it.
    """
    area = F.size("xpix").cast("bigint")
    if "part" not in cleaned.columns:
        return cleaned.select(*keys, "roi_id", "ord", area.alias("area"), "invalid", "kept")
    rules = [F.max(f"faults.{n}").alias(n) for n in ("broken", "uneven", "outside")]
    whole = cleaned.groupBy(*keys, "roi_id", "ord").agg(
        F.sum(area).alias("area"), F.max("kept").alias("kept"), F.struct(*rules).alias("faults")
    )
    return whole.select(*keys, "roi_id", "ord", "area", _fault_count("faults").alias("invalid"), "kept")


def clean_fixed_rois(raw: DataFrame, shapes: DataFrame, keys: Sequence[str] = ("session",)) -> DataFrame:
    """Forgiving cleaning of fixed ROIs: missing lists are empty, nothing is counted,
    and an entry that is not a number stops the job."""
    keys = list(keys)
    filled = raw.withColumn("xpix", F.coalesce("xpix", F.array().cast("array<string>"))).withColumn(
        "ypix", F.coalesce("ypix", F.array().cast("array<string>"))
    )
    cleaned = clean_rois(filled, shapes, keys)
    source = filled.select(*keys, "roi_id", "ord", "xpix", "ypix")
    bad = F.exists(_cast_pixels("xpix"), lambda v: v.isNull()) | F.exists(
        _cast_pixels("ypix"), lambda v: v.isNull()
    )
    checked = source.select(
        *keys, "roi_id", "ord",
        F.when(bad, F.raise_error(F.lit("fixed ROI holds a pixel that is not a number")).cast("boolean"))
        .otherwise(F.lit(True)).alias("_ok"),
    )
    return (
        merge_join(cleaned, checked, [*keys, "roi_id", "ord"])
        .filter("_ok and kept").select(*keys, "roi_id", "ord", "xpix", "ypix")
    )


def in_bounds(x: str = "x", y: str = "y") -> Column:
    """Bounds test against the ``width`` and ``height`` of the same row."""
    return (
        (F.col(x) >= 0) & (F.col(x) < F.col("width")) & (F.col(y) >= 0) & (F.col(y) < F.col("height"))
    )


def clean_roi_pixels(
    pixels: DataFrame, shapes: DataFrame, keys: Sequence[str] = ("session",)
) -> tuple[DataFrame, DataFrame]:
    """The long form of :func:`clean_rois` for numeric pixel rows.

    Returns the pixels inside their image and, per ROI, ``area`` (repeats count),
    ``invalid`` and ``kept``.
    """
    keys = list(keys)
    shaped = salted_join(pixels, shapes_once(shapes, keys), keys, ["y"], "inner", hashed=True)
    flagged = shaped.withColumn("_in", in_bounds())
    facts = flagged.groupBy(*keys, "roi_id", "ord").agg(
        F.count(F.when(F.col("_in"), 1)).alias("area"),
        F.max((~F.col("_in")).cast("int")).alias("invalid"),
    ).withColumn("kept", F.col("area") > 0)
    return flagged.filter("_in").select(*keys, "roi_id", "ord", "y", "x"), facts


def renumber_kept(facts: DataFrame, keys: Sequence[str] = ("session",)) -> DataFrame:
    """1-based number of each kept ROI in record order."""
    return bucketed_row_number(
        facts.filter("kept").select(*keys, "roi_id", "ord"), keys,
        F.floor(F.col("ord") / 1024), [F.col("ord"), F.col("roi_id")], "label",
    ).withColumn("label", F.col("label").cast("int"))


def rasterise(clean: DataFrame, facts: DataFrame, keys: Sequence[str] = ("session",)) -> DataFrame:
    """Label image rows: where ROIs overlap the later record owns the pixel.

    The owner is found first, by a map-side-combined maximum over record order, so
    only one row per pixel reaches the renumbering join.
    """
    keys = list(keys)
    owners = clean.groupBy(*keys, "y", "x").agg(F.max(F.struct("ord", "roi_id")).alias("_o")).select(
        *keys, "y", "x", F.col("_o.ord").alias("ord"), F.col("_o.roi_id").alias("roi_id")
    )
    names = renumber_kept(facts, keys)
    return salted_join(owners, names, [*keys, "roi_id", "ord"], ["y"], "inner", salts=8, hashed=True).select(
        *keys, "y", "x", "label"
    )


def roi_words(
    pixels: DataFrame, shapes: DataFrame, keys: Sequence[str] = ("session",), ids: Sequence[str] = ("roi_id", "ord"),
) -> DataFrame:
    """The pixels of each ROI that lie inside its image as words ``(keys, ids, y, _w, bits)``.

    Rows shrink before any is joined: to a word for 64 columns of an ROI's scanline, however often rows
    repeat, and a whole number at a time, so a task hashes its rows and does not sort them.
    """
    keys = list(keys)
    words = pack_words(pixels.filter("x >= 0 and y >= 0"), [*keys, *ids])
    shaped = salted_join(words, shapes_once(shapes, keys), keys, ["y"], "inner", hashed=True)
    inside = shaped.filter("y < height").withColumn("bits", F.col("bits").bitwiseAND(up_to("width")))
    return inside.filter("bits <> 0").drop("height", "width")


def rasterise_pixels(pixels: DataFrame, shapes: DataFrame, keys: Sequence[str] = ("session",)) -> DataFrame:
    """:func:`rasterise` of the raw pixel rows themselves, worked on words of 64 pixels.

    The words are stored, as they are read for the ROIs' numbers and for their pixels.
    """
    keys = list(keys)
    words = StoredTable(roi_words(pixels, shapes, keys)).df
    names = renumber_kept(words.select(*keys, "roi_id", "ord").distinct().withColumn("kept", F.lit(True)), keys)
    named = salted_join(words, names, [*keys, "roi_id", "ord"], ["y"], "inner", salts=8, hashed=True)
    later = Window.partitionBy(*keys, "y", "_w").orderBy(F.desc("label")).rowsBetween(Window.unboundedPreceding, -1)
    taken = F.coalesce(F.bit_or("bits").over(later), F.lit(0).cast("bigint"))
    owned = named.select(*keys, "y", "_w", "label", F.col("bits").bitwiseAND(F.bitwise_not(taken)).alias("bits"))
    return word_pixels(owned.filter("bits <> 0")).select(*keys, "y", "x", "label")


def roi_mask(clean: DataFrame, keys: Sequence[str] = ("session",)) -> DataFrame:
    """Union of all ROIs as distinct pixels."""
    return clean.select(*keys, "y", "x").distinct()


def roi_summary(
    pixels: DataFrame, shapes: DataFrame, keys: Sequence[str] = ("session",)
) -> DataFrame:
    """ROI count, area statistics and foreground share per session.

    Areas are kept list lengths (repeats count); ``positive_pixels`` are distinct
    pixels. Sessions without ROIs get zeros. A row of ``shapes`` gives a row, so a session
    listed twice has two equal ones.
    """
    return _summarise(*clean_roi_pixels(pixels, shapes, keys), shapes, keys)


def summarise_records(
    cleaned: DataFrame, shapes: DataFrame, keys: Sequence[str] = ("session",)
) -> DataFrame:
    """The same summary from the records :func:`clean_rois` returns."""
    return _summarise(record_pixels(cleaned, keys), whole_rois(cleaned, keys), shapes, keys)


def record_pixels(cleaned: DataFrame, keys: Sequence[str] = ("session",)) -> DataFrame:
    """Cleaned records to long pixel rows."""
    pair = F.explode(F.arrays_zip(F.col("xpix").alias("x"), F.col("ypix").alias("y"))).alias("p")
    return cleaned.filter("kept").select(*keys, "roi_id", "ord", pair).select(
        *keys, "roi_id", "ord", F.col("p.y").cast("int").alias("y"), F.col("p.x").cast("int").alias("x")
    )


def _summarise(
    clean: DataFrame, facts: DataFrame, shapes: DataFrame, keys: Sequence[str]
) -> DataFrame:
    keys = list(keys)
    kept = facts.filter("kept")
    counts = facts.groupBy(*keys).agg(
        F.count(F.when(F.col("kept"), 1)).alias("roi_count"),
        F.min(F.when(F.col("kept"), F.col("area"))).alias("min_roi_area_px"),
        F.max(F.when(F.col("kept"), F.col("area"))).alias("max_roi_area_px"),
        F.sum("invalid").alias("invalid_roi_entries"),
    )
    medians = group_quantiles(kept, keys, "area", {"median_roi_area_px": 0.5})
    covered = roi_mask(clean, keys).groupBy(*keys).agg(F.count("*").alias("positive_pixels"))
    joined = shapes
    for part in (counts, medians, covered):
        joined = merge_join(joined, part, keys, "left")

    def zero(name: str, kind: str = "bigint") -> Column:
        return F.coalesce(F.col(name), F.lit(0)).cast(kind).alias(name)

    size = F.col("height").cast("double") * F.col("width")
    return joined.select(
        *keys, "height", "width", zero("roi_count"), zero("positive_pixels"),
        (F.coalesce("positive_pixels", F.lit(0)) / size).alias("positive_fraction"),
        zero("median_roi_area_px", "double"), zero("min_roi_area_px"), zero("max_roi_area_px"),
        zero("invalid_roi_entries"),
    )
