"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: what counts as true in a manifest cell
TRUE_WORDS = ("true", "1", "yes", "y")


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def sigmoid(z: Column | str) -> Column:
    return 1 / (1 + F.exp(-col(z)))


def parse_bool(text: Column | str) -> Column:
    return F.coalesce(F.lower(col(text).cast("string")).isin(*TRUE_WORDS), F.lit(False))


def lenient_int(text: Column | str, kind: str = "int") -> Column:
    """Decimal text is cut to its whole part; blank or missing text is zero."""
    filled = F.coalesce(F.nullif(col(text), F.lit("")), F.lit("0"))
    return filled.cast("double").cast(kind)


def lenient_double(text: Column | str) -> Column:
    return F.coalesce(F.nullif(col(text), F.lit("")), F.lit("0")).cast("double")


def animal_of(session: Column | str) -> Column:
    return F.substring_index(col(session), "-", 1)


def column_name(parameter: str) -> str:
    """The column that holds a parameter in a table of parameters."""
    return parameter.lower().replace(" ", "_").replace("-", "_")


def default_roi_name(image_name: Column | str) -> Column:
    return F.concat(F.substring_index(col(image_name), "_ref_mat", 1), F.lit("_ROI_dict.npy"))


def blend(value: Column, colour: float | Column, alpha: float) -> Column:
    return (1 - F.lit(alpha)) * value + F.lit(alpha) * colour


def keyed_uniform(seed: int, *key: Column | str) -> Column:
    """A draw in [0, 1) fixed by seed and key, whatever the partitioning.

    The first eight hex digits of an md5, so other SQL engines can repeat it.
    """
    digest = keyed_digest(seed, *key)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def keyed_digest(seed: int, *key: Column | str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[col(k).cast("string") for k in key]))


def pixel_key(y: Column | str = "y", x: Column | str = "x") -> Column:
    """One long that orders pixels row by row without knowing the image width."""
    return F.shiftleft(col(y).cast("bigint"), 32) + col(x).cast("bigint")


def key_row(key: Column | str) -> Column:
    return F.shiftright(col(key), 32).cast("int")


def key_column(key: Column | str) -> Column:
    return col(key).bitwiseAND(F.lit(4294967295).cast("bigint")).cast("int")
