"""Session folders as a Spark data source, and ROI files as a data sink.

Reading: the folder names of the root are listed by the tasks, each of which keeps its own share of
them, so nothing is listed on the driver; a filter on the session name is taken over, and skips
folders before they are looked into. What is read of a file depends on the table asked for: its
listing, its header, or all of it.

Writing: each task writes the ROI files of its sessions under a folder of its own attempt, and only
the commit moves them to their places; a failed job leaves nothing there.

Paths are those of the local or any other file system that ``pyarrow.fs`` opens by its URI.
"""

from __future__ import annotations

import io
import posixpath
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage,
)
from pyspark.sql.types import StructType

from pixelloom.functions.scalars import default_roi_name
from pixelloom.sources.files import FOLDER, decode_array, header_shape, roi_records

#: Tables of the source and their columns.
TABLES = {
    "sessions": "session string, processed_path string, has_processed boolean",
    "files": "session string, name string, path string, length long",
    "shapes": "session string, name string, path string, height int, width int, error string",
    "images": "session string, name string, path string, height int, width int, dtype string, pixels array<float>, error string",
    "rois": "session string, name string, path string, roi_id int, ord int, xpix array<string>, ypix array<string>",
}
SUFFIXES = {"shapes": ("ref_mat_ch2.npy",), "images": ("ref_mat_ch2.npy",), "rois": ("_ROI_dict.npy",)}
ARROW = {
    "string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(),
    "array<float>": pa.list_(pa.float32()), "array<string>": pa.list_(pa.string()),
}
HEAD = 256  # bytes read first; longer headers are read in a second step
PARTITIONS = 32


def opened(root: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a path or URI, and the path on it."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*://|file:", root):
        return arrow_fs.FileSystem.from_uri(root)
    return arrow_fs.LocalFileSystem(), root


@dataclass
class Share(InputPartition):
    """The folders whose name falls to this share."""

    number: int
    of: int


class SessionReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.table = options["path"].rstrip("/"), options.get("table", "files")
        self.shares, self.trusted = int(options.get("partitions", PARTITIONS)), options.get("trusted", "false").lower() == "true"
        self.names = set(options["names"].split("/")) if "names" in options else None  # "/" cannot be in a name
        self.wanted: set[str] | None = None
        if self.table == "rois" and not self.trusted:
            raise ValueError("ROI files are pickles: set trusted for files of known origin")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for test in filters:
            if isinstance(test, (EqualTo, In)) and test.attribute == ("session",):
                values = {test.value} if isinstance(test, EqualTo) else set(test.value)
                self.wanted = values if self.wanted is None else self.wanted & values
            else:
                yield test

    def partitions(self) -> list[Share]:
        return [Share(k, self.shares) for k in range(self.shares)]

    def read(self, share: Share) -> Iterator[tuple]:
        system, root = opened(self.root)
        if self.wanted is not None:
            folders = [n for n in sorted(self.wanted) if self._mine(n, share)]
            folders = [n for n in folders if system.get_file_info(f"{root}/{n}").type == arrow_fs.FileType.Directory]
        else:
            listed = system.get_file_info(arrow_fs.FileSelector(root))
            folders = sorted(i.base_name for i in listed if i.type == arrow_fs.FileType.Directory and self._mine(i.base_name, share))
        for session in folders:
            yield from self._session(system, session, f"{root}/{session}/{FOLDER}")

    def _mine(self, name: str, share: Share) -> bool:
        return zlib.crc32(name.encode()) % share.of == share.number

    def _session(self, system: arrow_fs.FileSystem, session: str, folder: str) -> Iterator[tuple]:
        there = system.get_file_info(folder).type == arrow_fs.FileType.Directory
        if self.table == "sessions":
            yield session, folder, there
            return
        found = system.get_file_info(arrow_fs.FileSelector(folder)) if there else []
        for info in sorted(found, key=lambda i: i.base_name):
            name = info.base_name
            if info.type != arrow_fs.FileType.File or not name.endswith(SUFFIXES.get(self.table, (".npy",))):
                continue
            if self.names is None or name in self.names:
                yield from self._file(system, session, name, info.path, info.size)

    def _file(self, system: arrow_fs.FileSystem, session: str, name: str, path: str, size: int) -> Iterator[tuple]:
        if self.table == "files":
            yield session, name, path, size
        elif self.table == "shapes":
            with system.open_input_file(path) as file:
                sides, error = header_shape(lambda n: file.read_at(n, 0), HEAD)
            yield session, name, path, *(sides or (0, 0)), error
        else:
            with system.open_input_file(path) as file:
                content = file.read()
            if self.table == "rois":
                for row in roi_records(path, content):
                    yield session, name, path, *row
                return
            image, error = decode_array(content)
            sides = image.shape if image is not None else (0, 0)
            pixels = image.astype(np.float32).ravel().tolist() if image is not None else []
            yield session, name, path, *sides, str(image.dtype) if image is not None else "", pixels, error


@dataclass
class Written(WriterCommitMessage):
    """The folder of an attempt."""

    folder: str
    files: int


class RoiWriter(DataSourceArrowWriter):
    """Rows ``(session, image_name, roi_id, ord, part, xpix, ypix)``, each session's in one task and together."""

    def __init__(self, options: dict[str, str]):
        self.root = options["path"].rstrip("/")
        self.staging = f"{self.root}/_writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, base = opened(f"{self.staging}/{uuid.uuid4().hex}")
        files, key, held = 0, None, []

        def flush() -> int:
            if key is None:
                return 0
            rois: dict[int, dict[str, list]] = {}
            for row in sorted(held, key=lambda r: (r["ord"], r["roi_id"], r["part"])):
                own = rois.setdefault(row["roi_id"], {"xpix": [], "ypix": []})
                own["xpix"] += row["xpix"]
                own["ypix"] += row["ypix"]
            stored = {k: {c: np.asarray(v, np.int64) for c, v in own.items()} for k, own in rois.items()}
            stream = io.BytesIO()
            np.save(stream, np.array(stored, dtype=object), allow_pickle=True)
            folder = f"{base}/{key[0]}/{FOLDER}"
            system.create_dir(folder, recursive=True)
            with system.open_output_stream(f"{folder}/{key[1]}") as out:
                out.write(stream.getvalue())
            return 1

        for batch in iterator:
            for row in batch.to_pylist():
                if (row["session"], row["name"]) != key:
                    files += flush()
                    key, held = (row["session"], row["name"]), []
                if row["roi_id"] is not None:
                    held.append(row)
        files += flush()
        return Written(base, files)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = opened(self.root)
        for message in messages:
            if message is None or not message.files:
                continue
            for info in system.get_file_info(arrow_fs.FileSelector(message.folder, recursive=True)):
                if info.type == arrow_fs.FileType.File:
                    place = f"{root}/{posixpath.relpath(info.path, message.folder)}"
                    system.create_dir(posixpath.dirname(place), recursive=True)
                    system.move(info.path, place)
        self._clean()

    def abort(self, messages: list[Written | None]) -> None:
        self._clean()

    def _clean(self) -> None:
        system, staging = opened(self.staging)
        if system.get_file_info(staging).type == arrow_fs.FileType.Directory:
            system.delete_dir(staging)


class SessionFolders(DataSource):
    """``format("session_folders")``: option ``table`` names what is read."""

    @classmethod
    def name(cls) -> str:
        return "session_folders"

    def schema(self) -> str:
        return TABLES[self.options.get("table", "files")]

    def reader(self, schema: StructType) -> SessionReader:
        return SessionReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> RoiWriter:
        return RoiWriter(dict(self.options))


def read_sessions(spark: SparkSession, root: str, table: str = "files", trusted: bool = False, partitions: int = PARTITIONS) -> DataFrame:
    """A table of the session folders under ``root``; filters on ``session`` skip folders."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SessionFolders)
    options = {"table": table, "trusted": str(trusted), "partitions": str(partitions)}
    return spark.read.format("session_folders").options(**options).load(root)


def read_files(files: DataFrame, root: str, table: str, trusted: bool = False) -> DataFrame:
    """A table of the wanted ``files(session, name, path)`` only, each opened where its row lies.

    ``root`` names the file system that the paths are of.
    """
    reader = SessionReader({"path": root, "table": table, "trusted": str(trusted)})
    names = [part.split()[0] for part in TABLES[table].split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = opened(reader.root)
        kinds = None
        for batch in batches:
            for file in batch.to_pylist():
                rows = [dict(zip(names, r)) for r in reader._file(system, file["session"], file["name"], file["path"], 0)]
                kinds = kinds or pa.schema([(n, ARROW[k]) for n, k in (part.split() for part in TABLES[table].split(", "))])
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    return files.select("session", "name", "path").mapInArrow(run, TABLES[table])


def write_roi_files(rois: DataFrame, images: DataFrame, root: str) -> None:
    """One ROI file for each row of ``images(session, name)``, under its default name.

    ``rois`` are packed records. An image without ROIs gets an empty file. A file holds one image's
    ROIs, so each image's rows meet in one task, many images in each.
    """
    rois.sparkSession.dataSource.register(SessionFolders)
    named = images.select("session", default_roi_name("name").alias("name"))
    rows = named.join(rois.select("session", "roi_id", "ord", "part", "xpix", "ypix"), "session", "left")
    placed = rows.repartition("session").sortWithinPartitions("session", "ord", "part")
    placed.write.format("session_folders").mode("append").save(root)
