"""What several operators of this subpackage share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words between the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def binary(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def quoted(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col(f"`{name.replace('`', '``')}`")


def batch_rows(spark: SparkSession, rows: int) -> None:
    """Set how many rows go to Python at once, for the plans that the session runs from now on.

    A batch of texts is held whole on both sides, so operators that keep state of their own ask for
    small ones, whatever another has asked for before.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def same(left: Column, right: Column) -> Column:
    """Equality that also joins nulls."""
    return left.eqNullSafe(right)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (published splitmix constants): every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def unit(*parts: Column, seed: int = 0) -> Column:
    """A keyed draw in [0, 1) that any SQL engine with md5 repeats."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(float(2**52))
