"""Near-duplicate vectors: int8 tile products with rigorous error bounds, rechecked in doubles.

Equal vectors are one class with a count. The classes are cut into blocks of about ``BLOCK`` by a
hash, and every pair of blocks is one task, whose size does not grow with the data. A unit vector
``u`` is stored as ``s * q`` with ``q`` of int8 and the exact error ``e = |u - s q|``; two vectors'
cosine then differs from ``s s' (q . q')`` by at most ``e + e' + e e'``. Only codes, scales and errors
are sent to the pairs of blocks. Products of up to ``EXACT`` components of int8 tiles are whole
numbers that single precision holds exactly, and are added in doubles; so a tile is a few matrix
products, and most pairs of vectors are decided by the bounds. The vectors of those that are not are
sent to their pair of blocks in a second pass and decided in double precision. A task returns, for
each of its vectors, a count of links and its smallest fellow in the task's graph, never the pairs
themselves.

Every pair of blocks must be looked at, as nothing bounds the cosine between two blocks of vectors
without direction; so the work grows with the square of the number of different vectors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.llm.graph import Sets, components
from pixelloom.llm.vectors import matrix, packed, usable
from pixelloom.session import StoredTable

THRESHOLD = 0.9
BLOCK, TILE = 4096, 1024
EXACT = (1 << 24) // 127**2  # components whose products add up exactly in single precision
SLACK = 1e-9  # more than what rounding in double precision can add to a cosine


def scaled(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows brought near length one by powers of two, which changes no digit, and their lengths."""
    _, power = np.frexp(np.abs(rows).max(axis=1))
    # two steps, as one factor could leave the range
    rows = np.ldexp(np.ldexp(rows, -(power // 2)[:, None]), -(power - power // 2)[:, None])
    return rows, np.linalg.norm(rows, axis=1)


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, scales and the length of what the codes miss."""
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    return codes, scale, np.linalg.norm(unit - codes * scale[:, None], axis=1)


@dataclass
class Side:
    """Vectors on one side of a task: their codes and, in the second pass, themselves."""

    codes: np.ndarray
    scale: np.ndarray
    error: np.ndarray
    copies: np.ndarray
    rows: np.ndarray | None = None
    norm: np.ndarray | None = None

    @classmethod
    def of(cls, rows: np.ndarray, copies: np.ndarray) -> Side:
        rows, norm = scaled(rows)
        return cls(*quantised(rows / norm[:, None]), copies, rows, norm)

    def __len__(self) -> int:
        return len(self.scale)

    def __getitem__(self, own) -> Side:
        return Side(*(None if c is None else c[own] for c in (self.codes, self.scale, self.error, self.copies, self.rows, self.norm)))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of int8 rows."""
    total = None
    for at in range(0, a.shape[1], EXACT):
        part = a[:, at : at + EXACT].astype(np.float32) @ b[:, at : at + EXACT].astype(np.float32).T
        total = part if total is None else total.astype(np.float64) + part
    return total


def bounded(a: Side, b: Side, threshold: float) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Which pairs of two tiles link for sure, and which ones (places in ``a`` and ``b``) may or may not."""
    product = products(a.codes, b.codes)
    most = a.error.max() + b.error.max() + a.error.max() * b.error.max() + SLACK
    least = np.multiply.outer((threshold - most) / a.scale, 1 / b.scale)
    i, j = np.nonzero(product >= least * (1 - 1e-6))
    near = a.scale[i] * b.scale[j] * product[i, j].astype(np.float64)
    off = a.error[i] + b.error[j] + a.error[i] * b.error[j] + SLACK
    sure, open_ = near - off >= threshold, (near + off >= threshold) & (near - off < threshold)
    links = np.zeros(product.shape, bool)
    links[i[sure], j[sure]] = True
    return links, (i[open_], j[open_])


def decided(a: Side, b: Side, threshold: float) -> np.ndarray:
    """Which of the pairs that the bounds leave open link, in double precision."""
    links, (i, j) = bounded(a, b, threshold)
    links[:] = False
    for at in range(0, len(i), 1 << 15):
        k, m = i[at : at + (1 << 15)], j[at : at + (1 << 15)]
        cosine = np.einsum("ij,ij->i", a.rows[k], b.rows[m]) / (a.norm[k] * b.norm[m])
        links[k, m] = cosine >= threshold
    return links


def block_links(side: Side, first: np.ndarray, same: bool, threshold: float, second: bool = False):
    """Per vector its links, its smallest fellow, and whether the bounds leave a pair of it open.

    Pairs are of one with and one without ``first`` or, if ``same``, of all. In the ``second`` pass only
    the pairs that the bounds leave open count.
    """
    n = len(side)
    links, sets, unsure = np.zeros(n, np.int64), Sets(n), np.zeros(n, bool)
    sides = [np.arange(n)] * 2 if same else [np.flatnonzero(first), np.flatnonzero(~first)]
    left, right = ([own[at : at + TILE] for at in range(0, len(own), TILE)] for own in sides)
    for p, own in enumerate(left):
        for q, other in enumerate(right):
            if same and q < p:
                continue
            x, y = side[own], side[other]
            if second:
                found = decided(x, y, threshold)
            else:
                found, (i, j) = bounded(x, y, threshold)
                apart = own[i] != other[j]
                unsure[own[i[apart]]] = unsure[other[j[apart]]] = True
            if same and p == q:
                np.fill_diagonal(found, False)
            if not found.any():
                continue
            links[own] += found @ y.copies
            if not (same and p == q):
                links[other] += x.copies @ found
            # spread the smallest number through the tile's graph; the ties to it keep what it joins
            low, high = np.arange(len(own)), np.full(len(other), len(own))
            while True:
                high_new = np.minimum(high, np.where(found, low[:, None], len(own)).min(axis=0))
                low_new = np.minimum(low, np.where(found, high_new[None, :], len(own)).min(axis=1))
                if (high_new == high).all() and (low_new == low).all():
                    break
                low, high = low_new, high_new
            for i in np.flatnonzero(low != np.arange(len(own))):
                sets.union(int(own[i]), int(own[low[i]]))
            for j in np.flatnonzero(high < len(own)):
                sets.union(int(other[j]), int(own[high[j]]))
    return links, np.array([sets.find(i) for i in range(n)], np.int64), unsure


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """One row per row of ``vectors(vec_id, embedding)`` with its links and component.

    Null, zero and empty vectors, and those with a null or non-finite component, link with
    nothing, nor do vectors of different lengths, nor rows without an id. Rows that repeat are
    vectors of their own and link with each other; rows that share an id share what any of them
    links with. Other columns are ignored; an empty table gives no rows.
    """
    part = StoredTable(
        packed(vectors.select("vec_id", "embedding")).withColumn("ok", usable() & F.col("vec_id").isNotNull())
    ).df
    good = part.filter("ok")
    # -0.0 and 0.0 are grouped as one value
    classes = StoredTable(
        good.groupBy("dim", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), n=F.count("*")
    )
    n_blocks = max(1, math.ceil(classes.metrics["n"] / block))
    own = F.pmod(F.xxhash64("rep", "dim"), F.lit(n_blocks)).cast("int")
    names = ["reps", "copies", "codes", "scale", "error"]

    def pack(key, table):
        side = Side.of(matrix(table["embedding"], key[0].as_py()), table["copies"].to_numpy())
        parts = [table["rep"].to_numpy(), side.copies, side.codes, side.scale, side.error]
        return pa.table({"dim": [key[0]], "own": [key[1]], **{n: pa.array([c.tobytes()], pa.binary()) for n, c in zip(names, parts)}})

    packs = classes.df.select("*", own.alias("own")).groupBy("dim", "own").applyInArrow(
        pack, "dim int, own int, reps binary, copies binary, codes binary, scale binary, error binary"
    )
    other = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("other")
    paired = StoredTable(packs).df.select("*", other).select(
        "dim", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") <= F.col("other")).alias("first"), *names
    )

    def answer(reps, some, links, root, unsure, first) -> pa.Table:
        return pa.table({"rep": reps[some], "links": links[some], "fellow": reps[root[some]], "unsure": unsure[some], "first": first[some]})

    def by_bounds(key, table):
        dim, i, j = (k.as_py() for k in key)
        kinds = dict(zip(names, (np.int64, np.int64, np.int8, np.float64, np.float64)))
        held = {n: np.frombuffer(b"".join(table[n].to_pylist()), kind) for n, kind in kinds.items()}
        per_row = [len(r) // 8 for r in table["reps"].to_pylist()]
        first = np.repeat(table["first"].to_numpy(zero_copy_only=False), per_row)
        side = Side(held["codes"].reshape(-1, dim), held["scale"], held["error"], held["copies"])
        links, root, unsure = block_links(side, first, i == j, threshold)
        some = np.flatnonzero((links > 0) | (root != np.arange(len(root))) | unsure)
        return answer(held["reps"], some, links, root, unsure, first).append_column("i", pa.array([i] * len(some), pa.int32())).append_column(
            "j", pa.array([j] * len(some), pa.int32())).append_column("dim", pa.array([dim] * len(some), pa.int32()))

    def in_doubles(key, table):
        dim, i, j = (k.as_py() for k in key)
        reps, first = table["rep"].to_numpy(), table["first"].to_numpy(zero_copy_only=False)
        side = Side.of(matrix(table["embedding"], dim), table["copies"].to_numpy())
        links, root, unsure = block_links(side, first, i == j, threshold, second=True)
        return answer(reps, np.flatnonzero((links > 0) | (root != np.arange(len(root)))), links, root, unsure, first)

    kinds = "rep long, links long, fellow long, unsure boolean, first boolean"
    told = StoredTable(paired.groupBy("dim", "i", "j").applyInArrow(by_bounds, f"{kinds}, i int, j int, dim int")).df
    left = told.filter("unsure").select("dim", "i", "j", "first", "rep").distinct().join(classes.df, ["dim", "rep"])
    rechecked = left.groupBy("dim", "i", "j").applyInArrow(in_doubles, kinds)
    linked = StoredTable(told.select("rep", "links", "fellow").filter("links > 0 or rep <> fellow").union(rechecked.select("rep", "links", "fellow"))).df
    counts = linked.groupBy("rep").agg(F.sum("links").alias("links"))
    # classes that an id stands in are tied together
    shared = good.join(classes.df, ["dim", "embedding"]).groupBy("vec_id", "rep").agg(F.max("copies").alias("copies"))
    first = F.min("rep").over(Window.partitionBy("vec_id"))
    ties = shared.select(F.col("rep").alias("a"), first.alias("b")).filter("a <> b")
    joined = components(linked.select(F.col("rep").alias("a"), F.col("fellow").alias("b")).union(ties))
    of = (
        shared.join(counts, "rep", "left").join(joined, F.col("rep") == F.col("node"), "left")
        .groupBy(F.col("vec_id").alias("_id"))
        .agg(F.max(F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.min(F.coalesce("component", "rep")).alias("component"))
    )
    found = part.join(of, F.col("ok") & (F.col("vec_id") == F.col("_id")), "left")
    component = F.coalesce("component", "vec_id")
    return found.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"), (F.col("vec_id") == component).alias("kept"),
    )
