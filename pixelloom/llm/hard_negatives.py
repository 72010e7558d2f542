"""Hard negatives by a vertical scan over whole-number vectors (published as BOND).

A block of candidates is held by dimension. An anchor's dimensions are read in the order of its
components' size; after every few of them each candidate has a partial inner product, and the
smallest and largest component that the block has in each unread dimension bound what is still to
come. A bitmap of candidates shrinks: for the best ``k``, whoever cannot reach the ``k``-th best of
the lower bounds goes; for a window of scores, whoever lies outside it for sure, or below ``k``
candidates that lie in it for sure. What is left in the end has exact scores.

Anchors and candidates meet in pairs of blocks of bounded size, once to find the anchors' positives,
once with the score windows that these set; a pair returns the best few of each anchor and window.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.session import StoredTable

EVERY, POSITIVES, NEGATIVES = 100, 5, 10
LOW, HIGH, WHOLE = 30, 90, 100
BLOCK, ANCHORS = 4096, 4096
STEP = 8
#: Rows with a larger squared length are left out: their scores need not fit a long.
LONGEST = float(1 << 61)
EXACT = 1 << 52  # up to here products of doubles are whole numbers


def complete(vector: str = "embedding") -> Column:
    """Not null, without a null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & ~bad, F.lit(False))


class Block:
    """Candidates by dimension: ``columns[d]`` has component ``d`` of all."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, longest: int = 0):
        self.ids, self.labels = ids, labels
        # squared lengths bound all partial sums, so doubles are exact below EXACT
        small = max(int((rows.astype(np.float64) ** 2).sum(axis=1).max(initial=0)), longest) < EXACT
        self.kind = np.float64 if small else np.int64
        self.columns = np.ascontiguousarray(rows.T, dtype=self.kind)
        self.low, self.high = self.columns.min(axis=1, initial=0), self.columns.max(axis=1, initial=0)

    def scan(self, anchor: np.ndarray, alive: np.ndarray, shrink) -> tuple[np.ndarray, np.ndarray]:
        """Places and exact scores of the candidates among ``alive`` that ``shrink`` leaves.

        ``shrink(least, most)`` tells which candidates stay, from the bounds of their scores.
        """
        anchor = anchor.astype(self.kind)
        order = np.argsort(-np.abs(anchor), kind="stable")
        ends = np.sort([anchor * self.low, anchor * self.high], axis=0)[:, order]
        # what the dimensions from a place of the order on can add, at least and at most
        rest = np.concatenate([np.cumsum(ends[:, ::-1], axis=1)[:, ::-1], np.zeros((2, 1), self.kind)], axis=1)
        scores = np.zeros(len(alive), self.kind)
        for at in range(0, len(order), STEP):
            dims = order[at : at + STEP]
            part = self.columns[dims] if len(alive) == len(self.ids) else self.columns[dims[:, None], alive]
            scores = scores + anchor[dims] @ part
            to_come = rest[:, min(at + STEP, len(order))]
            stay = shrink(scores + to_come[0], scores + to_come[1])
            if not stay.all():
                alive, scores = alive[stay], scores[stay]
            if not len(alive):
                break
        return alive, scores.astype(np.int64)

    def best(self, anchor: np.ndarray, wanted: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` highest scores among the places ``wanted``, ties by smaller id."""

        def shrink(least, most):
            if len(least) <= k:
                return np.ones(len(least), bool)
            return most >= np.partition(least, len(least) - k)[len(least) - k]

        return self._first(*self.scan(anchor, wanted, shrink), k)

    def windows(self, anchor: np.ndarray, wanted: np.ndarray, bounds: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each ``[low, high]`` of ``bounds`` the ``k`` highest scores that lie in it."""
        low, high = bounds[:, :1], bounds[:, 1:]

        def shrink(least, most):
            stay = (most >= low) & (least <= high)
            sure = (least >= low) & (most <= high)
            for w in np.flatnonzero(sure.sum(axis=1) >= k):
                found = least[sure[w]]
                stay[w] &= most >= np.partition(found, len(found) - k)[len(found) - k]
            return stay.any(axis=0)

        places, scores = self.scan(anchor, wanted, shrink)
        inside = (scores >= low) & (scores <= high)
        return [self._first(places[own], scores[own], k) for own in inside]

    def _first(self, places: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((self.ids[places], -scores))[:k]
        return places[order], scores[order]


def window(score: int) -> tuple[int, int]:
    """The whole-number scores ``s`` with ``LOW * score <= WHOLE * s <= HIGH * score``."""
    return -(-LOW * score // WHOLE), HIGH * score // WHOLE


def _rows(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _loaded(table: pa.Table, dim: int, longest: int) -> Block:
    return Block(table["vec_id"].to_numpy(), table["label"].to_numpy(), _rows(table["codes"], dim), longest)


def _empty(names: list[str]) -> pa.Table:
    return pa.table({n: pa.array([], pa.int64()) for n in names})


def hard_negatives(vectors: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, block: int = BLOCK, anchors: int = ANCHORS) -> DataFrame:
    """Hard negatives of ``vectors(vec_id, label, codes)`` with whole-number components.

    Anchors are the ids divisible by ``every``; an id in several rows is one anchor, by the row of the
    smallest label, then components. All rows of other ids are its candidates, rows that repeat each
    for itself; vectors of different lengths are none for each other. An anchor's positives are the
    ``positives`` rows of its label with the highest inner products; for each, the ``negatives``
    highest rows of other labels in the score window are returned. An anchor without positives, or a
    positive without negatives, gives no rows, nor does an empty table. Rows with a null take no part.
    """
    good = StoredTable(
        vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), "codes")
        .filter("vec_id is not null and label is not null and codes is not null").withColumn("dim", F.size("codes")),
        n=F.count("*"), asked=F.countDistinct(F.when(F.col("vec_id") % every == 0, F.col("vec_id"))),
    )
    n_blocks = max(1, math.ceil(good.metrics["n"] / block))
    n_anchors = max(1, math.ceil(good.metrics["asked"] / anchors))
    first = good.df.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("label", "dim", "codes")).alias("row"))
    asked = StoredTable(first.select("vec_id", "row.*")).df

    def spread(df: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        key = F.pmod(F.xxhash64("vec_id", "codes"), F.lit(n_own)).cast("int").alias(own)
        return df.select("*", key, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))).alias(other))

    keys = ["c", "a", "dim"]
    rows = spread(good.df, "c", n_blocks, "a", n_anchors).groupBy(*keys)

    def met(asks: DataFrame, run, schema: str) -> DataFrame:
        return rows.cogroup(spread(asks, "a", n_anchors, "c", n_blocks).groupBy(*keys)).applyInArrow(run, schema)

    def loaded(key, left: pa.Table, right: pa.Table):
        dim = key[2].as_py()
        own = _rows(right["codes"], dim)
        longest = int((own.astype(np.float64) ** 2).sum(axis=1).max(initial=0))
        return _loaded(left, dim, longest), right["vec_id"].to_numpy(), right["label"].to_numpy(), own

    def find_positives(key, left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["anchor_id", "positive_id", "score"]
        if not (left.num_rows and right.num_rows):
            return _empty(names)
        held, ids, labels, own = loaded(key, left, right)
        out = []
        for i, label, anchor in zip(ids, labels, own):
            places, scores = held.best(anchor, np.flatnonzero((held.labels == label) & (held.ids != i)), positives)
            out.append((np.full(len(places), i), held.ids[places], scores))
        return pa.table(dict(zip(names, map(np.concatenate, zip(*out)))))

    found = met(asked, find_positives, "anchor_id long, positive_id long, score long")
    along = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "positive_id")
    found = StoredTable(found.withColumn("place", F.row_number().over(along)).filter(F.col("place") <= positives))
    sets = found.df.groupBy(F.col("anchor_id").alias("_id")).agg(F.array_sort(F.collect_list(F.struct("place", "positive_id", "score"))).alias("own"))
    ready = asked.join(sets, F.col("vec_id") == F.col("_id")).select("vec_id", "label", "codes", "dim", F.col("own.score").alias("scores"))

    def find_negatives(key, left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["anchor_id", "place", "negative_id", "negative_score"]
        if not (left.num_rows and right.num_rows):
            return _empty(names)
        held, ids, labels, own = loaded(key, left, right)
        out = []
        for i, label, anchor, scores in zip(ids, labels, own, right["scores"].to_pylist()):
            wanted = np.flatnonzero((held.labels != label) & (held.ids != i))
            bounds = np.array([window(s) for s in scores])
            for k, (places, scored) in enumerate(held.windows(anchor, wanted, bounds, negatives)):
                out.append((np.full(len(places), i), np.full(len(places), k + 1), held.ids[places], scored))
        return pa.table(dict(zip(names, map(np.concatenate, zip(*out)))))

    scored = met(ready, find_negatives, "anchor_id long, place long, negative_id long, negative_score long")
    along = Window.partitionBy("anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id")
    first = scored.withColumn("rank", F.row_number().over(along)).filter(F.col("rank") <= negatives)
    named = found.df.select("anchor_id", F.col("place").cast("bigint").alias("place"), "positive_id", F.col("score").alias("positive_score"))
    return first.join(named, ["anchor_id", "place"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"
    )


def mine_embeddings(vectors: DataFrame) -> DataFrame:
    """Hard negatives of ``vectors(vec_id, embedding, label)``, components as whole 256ths.

    Where 7 divides the id the label moves on by one, modulo 10. Rows with a null id or label, a null
    vector, a null or non-finite component, or a squared length from 2^61 on, take no part. Other
    columns are ignored.
    """
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))
    length = F.aggregate("embedding", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double") * 65536)
    return hard_negatives(vectors.filter(complete() & (length < LONGEST)).select("vec_id", label.alias("label"), scaled.alias("codes")))


CHECK = """
with v as (
    select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
           list_transform(embedding, lambda x: floor(cast(x as double) * 256)) as codes
    from embeddings
    where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as materialized (
    select a.vec_id as anchor_id, a.label = b.label as alike, b.vec_id as other_id, cast(list_inner_product(a.codes, b.codes) as bigint) as score
    from v a join v b on a.vec_id <> b.vec_id and len(a.codes) = len(b.codes) where a.vec_id % 100 = 0),
positives as (select * from scored where alike qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5),
pairs as (
    select p.anchor_id, p.other_id as positive_id, n.other_id as negative_id, p.score as positive_score, n.score as negative_score,
           row_number() over (partition by p.anchor_id, p.other_id order by n.score desc, n.other_id) as rank
    from positives p join scored n on n.anchor_id = p.anchor_id and not n.alike and 30 * p.score <= 100 * n.score and 100 * n.score <= 90 * p.score)
select anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score from pairs where rank <= 10
"""
