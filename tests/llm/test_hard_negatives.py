"""Hard negatives against plain sorting of all scores."""

import numpy as np
import pytest

from pixelloom.llm import hard_negatives as hn

FLOATS = "vec_id long, embedding array<float>, label int, rank int"


def product(u, v):
    return sum(a * b for a, b in zip(u, v))


def expected(rows, positives=5, negatives=10):
    """From ``(id, label, whole numbers)``; an id in several rows is one anchor."""
    first = {}
    for i, label, codes in rows:
        if i % 100 == 0:
            first[i] = min(first.get(i, (label, len(codes), codes)), (label, len(codes), codes))
    out = []
    for i, (label, dim, codes) in first.items():
        scored = sorted((-product(codes, v), j, own) for j, own, v in rows if j != i and len(v) == dim)
        for s, j, _ in [r for r in scored if r[2] == label][:positives]:
            inside = [(n, -t) for t, n, own in scored if own != label and 30 * -s <= 100 * -t <= 90 * -s]
            out += [(i, j, k + 1, n, -s, t) for k, (n, t) in enumerate(inside[:negatives])]
    return sorted(out)


def whole(rows):
    good = [r for r in rows if r[0] is not None and r[2] is not None and r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    return [(i, (label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v, label, *_ in good]


def table(seed=3, n=700, dim=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(10, dim)) + 0.6
    rows = [(k, [float(x) for x in centres[k % 10] + 0.5 * rng.normal(size=dim)], int(rng.integers(0, 4)), 1) for k in range(n)]
    rows += [(k + 1000, rows[k][1], rows[k][2], 1) for k in range(60)]  # ties
    odd = [None, [float("nan")] * dim, [float("inf")] + [0.0] * (dim - 1), [None] * dim, [0.0] * dim, [], [1.0, 2.0]]
    rows += [(5000 + 100 * k, v, 1, 1) for k, v in enumerate(odd)] + [(6000, [1.0] * dim, None, 1), (None, [1.0] * dim, 1, 1)]
    return rows + [(5601, [2.0, 2.0], 1, 1), (5602, [1.0, 1.5], 2, 1), (5603, [], 1, 1), rows[3], rows[200], (200, rows[7][1], 0, 1)]


@pytest.mark.parametrize("block, anchors", [(4096, 4096), (50, 3)])
def test_against_all_scores(spark, block, anchors):
    rows = table()
    df = spark.createDataFrame(rows, FLOATS).repartition(5)
    label = hn.F.when(hn.F.col("vec_id") % 7 == 0, (hn.F.col("label") + 1) % 10).otherwise(hn.F.col("label"))
    codes = hn.F.transform("embedding", lambda x: hn.F.floor(x.cast("double") * 256))
    got = hn.hard_negatives(df.filter(hn.complete()).select("vec_id", label.alias("label"), codes.alias("codes")), block=block, anchors=anchors)
    assert sorted(map(tuple, got.collect())) == expected(whole(rows))


def test_query_columns_and_no_rows(spark):
    rows = table(4, 300, 5)
    got = hn.mine_embeddings(spark.createDataFrame(rows, FLOATS))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == expected(whole(rows))
    assert hn.mine_embeddings(spark.createDataFrame([], FLOATS)).count() == 0
    lone = spark.createDataFrame([(100, [1.0], 1, 1), (3, [1.0], 2, 1)], FLOATS)
    assert hn.mine_embeddings(lone).count() == 0


def test_large_components(spark):
    rng = np.random.default_rng(5)
    rows = [(k, [float(np.float32(x)) for x in rng.normal(size=4) * 1e5 + 3e5], k % 3, 1) for k in range(1, 130)] + [(500, [3e5] * 4, 1, 1)]
    rows += [(600, [1e30] * 4, 1, 1), (601, [3e38] * 4, 1, 1)]
    got = hn.mine_embeddings(spark.createDataFrame(rows, FLOATS))
    assert sorted(map(tuple, got.collect())) == expected(whole(rows[:-2]))


@pytest.mark.parametrize("scale", [3, 1 << 27])
def test_scans(scale):
    rng = np.random.default_rng(scale)
    for dim in (1, 7, 8, 40):
        rows = rng.integers(-scale, scale + 1, size=(300, dim))
        held = hn.Block(np.arange(300), np.zeros(300, int), rows)
        anchor = rng.integers(-scale, scale + 1, size=dim)
        scores = [product(anchor.tolist(), r) for r in rows.tolist()]
        wanted = np.flatnonzero(rng.random(300) < 0.7)
        order = sorted(wanted.tolist(), key=lambda k: (-scores[k], k))
        places, found = held.best(anchor, wanted, 6)
        assert places.tolist() == order[:6] and found.tolist() == [scores[k] for k in order[:6]]
        top = scores[order[0]]
        bounds = [(top // 3, top // 2), (-top // 2, top), (top, top), (1, 0)]
        for (low, high), (places, found) in zip(bounds, held.windows(anchor, wanted, np.array(bounds), 5)):
            assert places.tolist() == [k for k in order if low <= scores[k] <= high][:5]


def test_windows_are_exact():
    for score in (*range(-20, 400), 10**18 + 7):
        low, high = hn.window(score)
        for s in (low - 1, low, high, high + 1):
            assert (low <= s <= high) == (30 * score <= 100 * s <= 90 * score)
