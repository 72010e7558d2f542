"""Token-id output: Arrow files of equal-length sequences with masks, opened without copying.

Documents are encoded where they lie and put in ascending ``doc_id`` order by a range partitioning;
each partition writes one pair of files. The sequence file holds record batches of two fixed-size lists, ``ids`` and
``mask`` (a byte each, 0 where the last sequence of a file is padded). The index file holds, per document,
its first id's place in the sequence file and its number of ids. A file is written under a name
of its own attempt and counts only once its task has ended, so a lost executor costs one
partition and leaves no half-written file in the result.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.llm.tokens import WordEncoder, encoded, tokenizer_path
from pixelloom.session import shared_dir

END_ID = 1
STEP = 512
MANIFEST = "part int, sequences string, documents string, n_docs long, n_tokens long"
READ_BACK = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _opened(uri: str):
    """A random-access file: mapped into memory where the folder is local or mounted."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return pa.memory_map(path) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(path)


def _created(uri: str):
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    return store.open_output_stream(path)


class SequenceFile:
    """The ids of one sequence file; nothing is read before it is asked for."""

    def __init__(self, uri: str):
        self.reader = pa.ipc.open_file(_opened(uri))
        self.length = self.reader.schema.field("ids").type.list_size
        self.per_batch = int(self.reader.schema.metadata[b"sequences_per_batch"])

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask (1 for an id, 0 for padding) of sequence ``i``, both views of the file."""
        batch = self.reader.get_batch(i // self.per_batch)
        row = i % self.per_batch
        ids = batch.column(0).slice(row, 1).flatten().to_numpy(zero_copy_only=True)
        return ids, batch.column(1).slice(row, 1).flatten().to_numpy(zero_copy_only=True)

    def ids(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from place ``start``, over as many batches as they span."""
        span, out = self.length * self.per_batch, []
        while n > 0:
            batch = self.reader.get_batch(start // span)
            values = batch.column(0).flatten().to_numpy(zero_copy_only=True)
            part = values[start % span : start % span + n]
            out.append(part)
            start, n = start + len(part), n - len(part)
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, "<u4")


class _Writer:
    """Appends ids to a sequence file, a batch at a time."""

    def __init__(self, uri: str, length: int, per_batch: int, kind: pa.DataType):
        self.length, self.span, self.kind = length, length * per_batch, kind
        self.schema = pa.schema(
            [("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.uint8(), length))],
            metadata={"sequences_per_batch": str(per_batch)},
        )
        self.sink = _created(uri)
        self.out = pa.ipc.new_file(self.sink, self.schema)
        self.held: list[np.ndarray] = []
        self.n_held = self.total = 0

    def add(self, ids: np.ndarray) -> int:
        """Append and return the place of the first id."""
        start = self.total
        self.total += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.span:
            values = np.concatenate(self.held)
            for at in range(0, len(values) - self.span + 1, self.span):
                self._batch(values[at : at + self.span], self.span)
            rest = values[len(values) // self.span * self.span :]
            self.held, self.n_held = [rest], len(rest)
        return start

    def _batch(self, values: np.ndarray, real: int) -> None:
        mask = (np.arange(len(values)) < real).astype(np.uint8)
        columns = [
            pa.FixedSizeListArray.from_arrays(pa.array(values, self.kind), self.length),
            pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length),
        ]
        self.out.write_batch(pa.record_batch(columns, schema=self.schema))

    def close(self) -> None:
        if self.n_held:
            values = np.concatenate(self.held)
            padded = np.zeros(-(-len(values) // self.length) * self.length, values.dtype)
            padded[: len(values)] = values
            self._batch(padded, len(values))
        self.out.close()
        self.sink.close()


def write_token_files(
    docs: DataFrame,
    folder: str,
    tokenizer: str | None = None,
    end_id: int = END_ID,
    length: int = 2048,
    sequences_per_batch: int = 128,
) -> list[dict]:
    """Write ``docs(doc_id, text)`` under ``folder``; one manifest entry per file pair.

    A null text counts as empty and is its end id alone. Rows with a null ``doc_id`` come
    first; rows that share a ``doc_id`` are all written, ordered by a checksum of their ids.
    Other columns are ignored; an empty table writes nothing. Ids are stored in 16 bits where
    the vocabulary allows, else in 32. The manifest grows with the number of partitions only.
    """
    path, spark = tokenizer or tokenizer_path(), docs.sparkSession
    n_ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = [k / n_ranges for k in range(1, n_ranges)]
    # one bound per partition comes back
    bounds = docs.agg(F.percentile_approx("doc_id", cuts, 10 * n_ranges)).first()[0] if cuts else None
    bounds = np.array(sorted(bounds or []))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(path)
        kind = "<u2" if max(encoder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
        for batch in batches:
            ids = batch.column(0)
            ranges = np.searchsorted(bounds, ids.fill_null(0).to_numpy(zero_copy_only=False), side="left")
            ranges = np.where(ids.is_null().to_numpy(zero_copy_only=False), 0, ranges)
            for at in range(0, batch.num_rows, STEP):
                own = slice(at, at + STEP)
                data = [x.astype(kind).tobytes() for _, x in encoded(batch.column(1).slice(at, STEP), encoder, end_id)]
                yield pa.record_batch(
                    [pa.array(ranges[own], pa.int32()), ids.slice(at, STEP), pa.array(map(zlib.crc32, data), pa.int64()),
                     pa.array([len(x) // int(kind[-1]) for x in data], pa.int64()), pa.array(data, pa.binary())],
                    names=["range", "doc_id", "tie", "n", "ids"],
                )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, name = TaskContext.get().partitionId(), uuid.uuid4().hex
        names = [f"{folder}/{part:06d}-{name}-{kind}.arrow" for kind in ("sequences", "documents")]
        out = index = sink = None
        n_docs = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = batch.column(1).to_pylist()
            starts = []
            for n, data in zip(sizes, batch.column(2)):
                ids = np.frombuffer(data.as_buffer(), f"<u{data.as_buffer().size // n}")
                if out is None:
                    out = _Writer(names[0], length, sequences_per_batch, pa.from_numpy_dtype(ids.dtype))
                    schema = pa.schema([("doc_id", batch.column(0).type), ("start", pa.int64()), ("n", pa.int64())])
                    sink = _created(names[1])
                    index = pa.ipc.new_file(sink, schema)
                starts.append(out.add(ids))
            index.write_batch(pa.record_batch([batch.column(0), pa.array(starts, pa.int64()), batch.column(1)], schema=schema))
            n_docs += batch.num_rows
        if out is not None:
            out.close()
            index.close()
            sink.close()
            row = {"part": [part], "sequences": [names[0]], "documents": [names[1]]}
            row |= {"n_docs": [n_docs], "n_tokens": [out.total]}
            yield pa.RecordBatch.from_pydict(row, schema=pa.schema([
                ("part", pa.int32()), ("sequences", pa.string()), ("documents", pa.string()),
                ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    ordered = (
        rows.mapInArrow(encode, "range int, doc_id long, tie long, n long, ids binary")
        .repartitionById(n_ranges, F.col("range"))
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")
        .select("doc_id", "n", "ids")
    )
    entries = sorted((r.asDict() for r in ordered.mapInArrow(write, MANIFEST).collect()), key=lambda r: r["part"])
    base = 0
    for entry in entries:
        entry["base"] = base
        base += entry["n_tokens"]
    return entries


def read_token_files(spark: SparkSession, manifest: list[dict]) -> DataFrame:
    """Per document of the files: id, place in the whole stream, number and checksum of its ids."""

    def read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for entry in (row for batch in batches for row in batch.to_pylist()):
            sequences = SequenceFile(entry["sequences"])
            index = pa.ipc.open_file(_opened(entry["documents"]))
            for k in range(index.num_record_batches):
                rows = index.get_batch(k)
                starts, sizes = rows.column(1).to_numpy(), rows.column(2).to_numpy()
                sums = [zlib.crc32(sequences.ids(s, n).astype("<u4").tobytes()) for s, n in zip(starts, sizes)]
                yield pa.record_batch(
                    [rows.column(0).cast(pa.int64()), pa.array(starts + entry["base"]), rows.column(2), pa.array(sums, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    listed = [(e["sequences"], e["documents"], e["base"]) for e in manifest]
    files = spark.createDataFrame(listed, "sequences string, documents string, base long")
    spread = files.repartition(max(1, len(listed))) if len(listed) < 4096 else files
    return spread.mapInArrow(read_back, READ_BACK)


def token_file_digest(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write the files to a new folder beside the session's checkpoints and read them back."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    return read_token_files(spark, write_token_files(docs, folder, tokenizer))
