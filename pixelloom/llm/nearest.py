"""Nearest neighbours by randomly rotated one-bit codes, reranked on the original vectors.

Vectors are centred, brought to unit length, and rotated by a fixed random rotation; the code is
the signs, with two correction numbers: the length taken off and the code's own inner product with
the vector it stands for (published estimator). A query's inner product with the code, divided by
the latter, estimates its inner product with the vector, with an error bound that shrinks as one
over the root of the dimension. Within a block of candidates the estimates pick the first
candidates, whose exact distances set the limit; every other candidate whose bound could still
beat it is reranked exactly. Bound and recall are set by ``EPSILON``.

Queries and candidates meet in blocks of fixed size, each pair of blocks in one task, and each task
returns the best few of its queries. Vectors go with their codes, in the precision that they came in:
a block of queries is large, so a row is sent once for some 800,000 rows of the table, and no list of
survivors, which may be a whole cluster for each of its queries, is ever written. All rows are
indexed; the centre is the mean of all rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.llm.vectors import matrix, sized, usable
from pixelloom.session import StoredTable

K, EVERY = 10, 100
EPSILON = 2.5
CANDIDATES, QUERIES = 8192, 8192
SEED = 17


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(rows: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, lengths, and the inner products of codes and rotated unit vectors."""
    rest = rows - centre
    length = np.linalg.norm(rest, axis=1)
    turned = rest @ turn / np.maximum(length, 1e-300)[:, None]
    fit = np.abs(turned).sum(axis=1) / math.sqrt(rows.shape[1])
    return np.packbits(turned > 0, axis=1), length, np.where(length > 0, fit, 1.0)


def estimates(bits, length, fit, queries, centre, turn, epsilon: float):
    """Squared distances of each query to each code: estimate, and the least that the bound allows."""
    dim = queries.shape[1]
    rest = queries - centre
    own = np.linalg.norm(rest, axis=1)
    turned = (rest @ turn / np.maximum(own, 1e-300)[:, None]).astype(np.float32)
    signs = np.unpackbits(bits, axis=1, count=dim).astype(np.float32) * 2 - 1
    inner = (turned @ signs.T) / (math.sqrt(dim) * fit)
    error = epsilon / math.sqrt(max(dim - 1, 1)) * np.sqrt(np.maximum(1 / (fit * fit) - 1, 0))
    whole, cross = own[:, None] ** 2 + length**2, 2 * own[:, None] * length
    return whole - cross * inner, whole - cross * np.minimum(inner + error, 1.0)


def best_of_block(ids, rows, bits, length, fit, query_ids, queries, centre, turn, k: int, epsilon: float):
    """Rows ``(query, vec_id, distance)`` of the ``k`` nearest of this block for each query."""
    out = []
    for at in range(0, len(queries), 64):
        q = queries[at : at + 64]
        guess, least = estimates(bits, length, fit, q, centre, turn, epsilon)
        for i, query in enumerate(q):
            allowed = np.flatnonzero(ids != query_ids[at + i])
            if not len(allowed):
                continue
            some = allowed
            if len(allowed) > 4 * k:
                near = allowed[np.argpartition(guess[i, allowed], 4 * k)[: 4 * k]]
                limit = np.partition(((rows[near] - query) ** 2).sum(axis=1), k - 1)[k - 1]
                some = allowed[least[i, allowed] <= limit * (1 + 1e-6) + 1e-12]
                some = np.union1d(some, near)
            distance = np.sqrt(((rows[some] - query) ** 2).sum(axis=1))
            order = np.lexsort((ids[some], distance))[:k]
            out.append((np.full(len(order), query_ids[at + i]), ids[some][order], distance[order]))
    return [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]


def nearest(
    vectors: DataFrame, k: int = K, every: int = EVERY, epsilon: float = EPSILON,
    candidates: int = CANDIDATES, queries: int = QUERIES,
) -> DataFrame:
    """The ``k`` nearest found of each row whose ``vec_id`` is divisible by ``every``.

    Null, zero and empty vectors, those with a null or non-finite component, and rows without an id
    take no part; vectors of different lengths are no candidates for each other. Rows that share a
    query's id are the query's own; rows that repeat are candidates each, and queries once. Other
    columns are ignored; without queries or candidates there are no rows.
    """
    good = sized(vectors.select("vec_id", "embedding").filter(usable() & F.col("vec_id").isNotNull()))

    kind = good.schema["embedding"].dataType.simpleString()

    def add_up(batches):
        sums: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims).tolist():
                part = matrix(batch.column(0).filter(pa.array(dims == dim)), dim)
                n, total = sums.get(dim, (0, np.zeros(dim)))
                sums[dim] = n + len(part), total + part.sum(axis=0)
        dims = list(sums)
        yield pa.record_batch(
            [pa.array(dims, pa.int32()), pa.array([sums[d][0] for d in dims], pa.int64()), pa.array([list(sums[d][1]) for d in dims], pa.list_(pa.float64()))],
            names=["dim", "n", "total"],
        )

    # one row per length of vector comes back, with as many sums
    sums = good.select("embedding", "dim").mapInArrow(add_up, "dim int, n long, total array<double>")
    added = sums.select("dim", "n", F.posexplode("total").alias("at", "x")).groupBy("dim", "at").agg(F.sum("n"), F.sum("x")).collect()
    n_of, centre_of = {}, {}
    for dim, at, n, x in sorted(added):
        n_of[dim] = n
        centre_of.setdefault(dim, np.zeros(dim))[at] = x / n

    def index(batches):
        turns = {dim: rotation(dim) for dim in centre_of}
        for batch in batches:
            ids, vectors, dims = batch.column(0), batch.column(1), batch.column(2).to_numpy()
            for dim in np.unique(dims).tolist():
                own = pa.array(dims == dim)
                part = vectors.filter(own)
                bits, length, fit = encode(matrix(part, dim), centre_of[dim], turns[dim])
                yield pa.record_batch(
                    [ids.filter(own), part, pa.array([dim] * len(part), pa.int32()), pa.array([b.tobytes() for b in bits], pa.binary()), pa.array(length), pa.array(fit)],
                    names=["vec_id", "embedding", "dim", "bits", "length", "fit"],
                )

    indexed = StoredTable(
        good.select("vec_id", "embedding", "dim").mapInArrow(
            index, f"vec_id long, embedding {kind}, dim int, bits binary, length double, fit double"
        )
    ).df
    asked = StoredTable(good.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "embedding"]).select("vec_id", "dim", "embedding"), n=F.count("*"))
    n_candidates = max([math.ceil(n / candidates) for n in n_of.values()], default=1)
    n_queries = max(1, math.ceil(asked.metrics["n"] / queries))

    def spread(df, own, n_own, other, n_other):
        key = F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(n_own)).cast("int").alias(own)
        return df.select("*", key, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))).alias(other))

    rows = spread(indexed, "c", n_candidates, "q", n_queries)
    asks = spread(asked.df, "q", n_queries, "c", n_candidates)

    def run(key, left, right):
        dim = key[2].as_py()
        found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if left.num_rows and right.num_rows:
            bits = np.frombuffer(b"".join(left["bits"].to_pylist()), np.uint8).reshape(left.num_rows, -1)
            found = best_of_block(
                left["vec_id"].to_numpy(), matrix(left["embedding"], dim), bits, left["length"].to_numpy(), left["fit"].to_numpy(),
                right["vec_id"].to_numpy(), matrix(right["embedding"], dim), centre_of[dim], rotation(dim), k, epsilon,
            )
        return pa.table(dict(zip(("query_id", "vec_id", "score"), found)))

    best = rows.groupBy("c", "q", "dim").cogroup(asks.groupBy("c", "q", "dim")).applyInArrow(
        run, "query_id long, vec_id long, score double"
    )
    place = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return best.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int"), "vec_id", "score"
    )
