"""Session folders of ``.npy`` files: listing, image and ROI decoding, ROI storage."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FOLDER = "processed_data"


# ---------------------------------------------------------------------- listing
def list_sessions(spark: SparkSession, root: str) -> DataFrame:
    """Every directory under ``root``, name-sorted, with whether it has a data folder.

    Only names are listed, as Spark's own file index does; folders without files would
    not show in a file scan.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    base = hadoop.Path(root)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    rows = []
    for status in fs.listStatus(base):
        if status.isDirectory():
            folder = hadoop.Path(status.getPath(), FOLDER)
            rows.append((status.getPath().getName(), folder.toUri().getPath(), bool(fs.exists(folder))))
    schema = "session string, processed_path string, has_processed boolean"
    return spark.createDataFrame(sorted(rows), schema)


def scan_files(spark: SparkSession, root: str) -> DataFrame:
    """``(session, name, path, length)`` of the arrays in each session's data folder.

    File contents are not read: the columns asked for come from the listing.
    """
    found = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.npy").load(root).select("path", "length")
    )
    pattern = rf"([^/]+)/{FOLDER}/([^/]+)$"
    return found.select(
        F.regexp_extract("path", pattern, 1).alias("session"),
        F.regexp_extract("path", pattern, 2).alias("name"), "path", "length",
    ).filter("session <> ''")


def read_contents(spark: SparkSession, root: str, wanted: DataFrame) -> DataFrame:
    """Bytes of the wanted ``(session, name)`` files; others are not decoded."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.npy").load(root).select("path", "content")
    )
    pattern = rf"([^/]+)/{FOLDER}/([^/]+)$"
    named = files.select(
        F.regexp_extract("path", pattern, 1).alias("session"),
        F.regexp_extract("path", pattern, 2).alias("name"), "path", "content",
    )
    return named.join(wanted.select("session", "name"), ["session", "name"], "left_semi")


# --------------------------------------------------------------------- decoding
def decode_array(content: bytes) -> tuple[np.ndarray | None, str | None]:
    """The two-sided array of a file, or why there is none."""
    try:
        image = np.load(io.BytesIO(content), allow_pickle=False)
    except Exception as error:  # a bad file becomes a quarantine row
        return None, f"unreadable array: {error}"
    sides = _sides(image.shape)
    if len(sides) != 2:
        return None, f"not an image of two sides: {image.shape}"
    return image.reshape(sides), None


def _sides(shape: Sequence[int]) -> list[int]:
    """The sides that count: of more than two, those of length one do not."""
    return [n for n in shape if n != 1] if len(shape) > 2 else list(shape)


def _image_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for session, path, content in zip(frame["session"], frame["path"], frame["content"]):
            image, error = decode_array(content)
            ok = image is not None
            yield pd.DataFrame({
                "session": [session], "path": [path],
                "height": [image.shape[0] if ok else 0], "width": [image.shape[1] if ok else 0],
                "dtype": [str(image.dtype) if ok else ""],
                "pixels": [image.astype(np.float32).ravel() if ok else np.zeros(0, np.float32)],
                "error": [error],
            })


def decode_images(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(session, path, content)`` to image rows and a quarantine of bad files."""
    schema = (
        "session string, path string, height int, width int, dtype string, pixels array<float>, error string"
    )
    rows = files.select("session", "path", "content").mapInPandas(_image_rows, schema)
    good = rows.filter("error is null").drop("error")
    return good, rows.filter("error is not null").select("session", "path", "error")


def header_shape(read: Callable[[int], bytes], first: int) -> tuple[list[int] | None, str | None]:
    """The two sides that an array file's header states, or why there are none; ``read(n)`` gives the first bytes."""
    head = read(first)
    try:
        version = np.lib.format.read_magic(io.BytesIO(head))
        wide = 2 if version == (1, 0) else 4
        length = 8 + wide + int.from_bytes(head[8 : 8 + wide], "little")
        stream = io.BytesIO(head if length <= len(head) else read(length))
        np.lib.format.read_magic(stream)
        sides = _sides((np.lib.format.read_array_header_1_0 if wide == 2 else np.lib.format.read_array_header_2_0)(stream)[0])
    except Exception as error:
        return None, f"unreadable array: {error}"
    return (sides, None) if len(sides) == 2 else (None, f"not an image of two sides: {tuple(sides)}")


def _shape_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        shapes = []
        for content in frame["head"]:
            stream = io.BytesIO(content)
            version = np.lib.format.read_magic(stream)
            read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
            shapes.append([n for n in read(stream)[0]])
        two = [_sides(s) for s in shapes]
        yield frame[["session", "path"]].assign(height=[s[0] for s in two], width=[s[1] for s in two])


def decode_shapes(files: DataFrame) -> DataFrame:
    """Image shapes from array headers: the header says its length, and only it reaches Python."""
    # fixed value: after six bytes of name and two of version the length, little-endian, in two bytes or four

    def little(first: int, n: int) -> Column:
        parts = [F.hex(F.substring("content", first + k, 1)) for k in reversed(range(n))]
        return F.conv(F.concat(*parts), 16, 10).cast("int")

    old = F.hex(F.substring("content", 7, 1)) == "01"
    length = F.when(old, little(9, 2) + 10).otherwise(little(9, 4) + 12)
    heads = files.select("session", "path", F.substring("content", F.lit(1), length).alias("head"))
    return heads.mapInPandas(_shape_rows, "session string, path string, height int, width int")


def roi_records(path: str, content: bytes) -> list[tuple[int, int, list[str] | None, list[str] | None]]:
    """``(roi_id, ord, xpix, ypix)`` of a dictionary file, coordinates as text."""

    def text(values) -> list[str] | None:
        return None if values is None else [str(v) for v in np.asarray(values).ravel()]

    stored = np.load(io.BytesIO(content), allow_pickle=True).item()
    if not isinstance(stored, dict):
        raise ValueError(f"{path} holds no dictionary of ROIs")
    return [(int(i), k + 1, text(r.get("xpix")), text(r.get("ypix"))) for k, (i, r) in enumerate(stored.items())]


def _roi_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for session, path, content in zip(frame["session"], frame["path"], frame["content"]):
            rows = pd.DataFrame(roi_records(path, content), columns=["roi_id", "ord", "xpix", "ypix"])
            rows.insert(0, "session", session)
            rows.insert(1, "path", path)
            yield rows


def decode_rois(files: DataFrame, trusted: bool = False) -> DataFrame:
    """ROI dictionary files to raw records, in dictionary order.

    These files are pickles, which can run code when opened, so the caller must say
    that the files are trusted. Anything but a dictionary stops the job.
    """
    if not trusted:
        raise ValueError("ROI files are pickles: pass trusted=True for files of known origin")
    schema = "session string, path string, roi_id int, ord int, xpix array<string>, ypix array<string>"
    return files.select("session", "path", "content").mapInPandas(_roi_rows, schema)


# ---------------------------------------------------------------- array encoding
def _npy_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = []
        for h, w, pixels in zip(frame["height"], frame["width"], frame["pixels"]):
            stream = io.BytesIO()
            np.save(stream, np.asarray(pixels, dtype=np.float32).reshape(int(h), int(w)))
            out.append(stream.getvalue())
        yield frame[["session", "path"]].assign(content=out)


def encode_images(images: DataFrame) -> DataFrame:
    """Image rows to the bytes of array files."""
    return images.select("session", "path", "height", "width", "pixels").mapInPandas(
        _npy_rows, "session string, path string, content binary"
    )


# ------------------------------------------------------------------- ROI storage
ROIS_PER_FILE = 4096


def write_rois(rois: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Packed ROI records, one folder per session, each written by few tasks."""
    rois.repartition("session", F.floor(F.col("roi_id") / ROIS_PER_FILE)).write.mode(mode).partitionBy("session").parquet(path)


def read_rois(spark: SparkSession, path: str) -> DataFrame:
    schema = (
        "session string, roi_id int, ord int, part int, xpix array<bigint>, ypix array<bigint>"
    )
    return spark.read.schema(schema).parquet(path).select(
        "session", "roi_id", "ord", "part", "xpix", "ypix"
    )
