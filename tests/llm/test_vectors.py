"""Links between vectors and nearest neighbours against all pairs."""

import numpy as np
import pytest

from pixelloom.llm import near_vectors, nearest
from pixelloom.llm.graph import components


def table():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 24))
    rows = [centres[k % 12] + 0.15 * rng.normal(size=24) for k in range(150)]
    rows += [rng.normal(size=24) for _ in range(150)]
    rows += [rows[3], rows[3], 7 * rows[3], -rows[3]]
    vectors = [(k, [float(np.float32(x)) for x in v], None) for k, v in enumerate(rows)]
    odd = [None, [], [0.0] * 24, [float("nan")] + [1.0] * 23, [float("inf")] * 24, [1.0, None] + [0.0] * 22, [1.0, 2.0, 2.0], [1.0, 2.0, 2.1]]
    vectors += [(1000 + k, v, 1) for k, v in enumerate(odd)]
    return vectors + [(None, vectors[0][1], 1), vectors[5], (100_000, [1.0, 2.0, 2.0], 1)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumnRenamed("label", "rep").repartition(4)


def ok(i, v):
    return i is not None and bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


@pytest.mark.parametrize("block", [4096, 37])
def test_links(spark, block):
    rows = table()
    got = near_vectors.near_duplicates(frame(spark, rows), block=block).collect()
    assert len(got) == len(rows)
    good = [(i, np.array(v, np.float32).astype(float)) for i, v, _ in rows if ok(i, v)]
    links, label = {i: 0 for i, _ in good}, {i: i for i, _ in good}
    for a, (i, u) in enumerate(good):
        n = 0
        for b, (j, v) in enumerate(good):
            if a != b and len(u) == len(v) and u @ v / (np.linalg.norm(u) * np.linalg.norm(v)) >= 0.9:
                n += 1
                low, high = sorted((label[i], label[j]))
                label = {k: low if x == high else x for k, x in label.items()}
        links[i] = max(links[i], n)
    for r in got:
        if r.vec_id in label:
            assert (r.n_links, r.component_id, r.kept) == (links[r.vec_id], label[r.vec_id], label[r.vec_id] == r.vec_id)
        else:
            assert (r.n_links, r.component_id) == (0, r.vec_id)
    assert near_vectors.near_duplicates(frame(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("dim", [64, 1040, 4000, 10_000])
def test_links_at_the_threshold_in_any_dimension(dim):
    """Vectors of +-1 with a cosine of exactly nine tenths, and others next to it."""
    rng = np.random.default_rng(dim)
    base = rng.choice([-1.0, 1.0], size=dim)
    rows = [base]
    for k in range(120):
        flipped = base.copy()
        flipped[rng.permutation(dim)[: dim // 20 + k % 3 - 1]] *= -1
        rows.append(flipped)
    rows = np.array(rows + [r * s for r, s in zip(rows[:6], (2.0**600, 2.0**-600, 2.0**-1040, 4.0, 2.0**1000, 2.0**-1060))])
    side = near_vectors.Side.of(rows, np.ones(len(rows), np.int64))
    plain, norm = near_vectors.scaled(rows)
    cosine = (plain @ plain.T) / np.multiply.outer(norm, norm)
    want = cosine >= 0.9
    np.fill_diagonal(want, False)
    links, root, unsure = near_vectors.block_links(side, np.ones(len(rows), bool), True, 0.9)
    more, root2, _ = near_vectors.block_links(side[unsure], np.ones(unsure.sum(), bool), True, 0.9, second=True)
    links[unsure] += more
    assert links.tolist() == want.sum(axis=1).tolist()
    whole = near_vectors.products(side.codes, side.codes)
    assert (whole == side.codes.astype(np.int64) @ side.codes.T.astype(np.int64)).all()


@pytest.mark.parametrize("dim", [4000, 10_000])
def test_links_of_long_vectors(spark, dim):
    rng = np.random.default_rng(dim + 1)
    base = rng.choice([-1.0, 1.0], size=dim)
    rows = [base] + [base.copy() for _ in range(40)]
    for k, row in enumerate(rows[1:]):
        row[rng.permutation(dim)[: dim // 20 + k % 3 - 1]] *= -1
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(rows)], "vec_id long, embedding array<float>")
    whole = np.array(rows)
    norm = np.linalg.norm(whole, axis=1)
    want = (whole @ whole.T) / np.multiply.outer(norm, norm) >= 0.9
    got = {r.vec_id: r.n_links for r in near_vectors.near_duplicates(df, block=16).collect()}
    assert got == {k: int(want[k].sum()) - 1 for k in range(len(rows))}


def test_error_bounds():
    rng = np.random.default_rng(1)
    unit = rng.normal(size=(300, 24)) * rng.lognormal(0, 2, size=24)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    codes, scale, error = near_vectors.quantised(unit)
    near = (codes.astype(float) @ codes.T.astype(float)) * np.multiply.outer(scale, scale)
    assert (np.abs(near - unit @ unit.T) <= error[:, None] + error + np.multiply.outer(error, error) + 1e-12).all()


@pytest.mark.parametrize("candidates, queries", [(8192, 1024), (40, 2)])
def test_nearest(spark, candidates, queries):
    rows = table()
    got = nearest.nearest(frame(spark, rows), candidates=candidates, queries=queries).collect()
    by_query = {}
    for r in got:
        by_query.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    good = [(i, np.array(v, np.float32).astype(float)) for i, v, _ in rows if ok(i, v)]
    hits = total = 0
    asked = {i: v for i, v in good if i % 100 == 0}
    assert set(by_query) == set(asked)
    for q, u in asked.items():
        want = sorted((float(np.sqrt(((u - v) ** 2).sum())), i) for i, v in good if i != q and len(v) == len(u))[:10]
        own = sorted(by_query[q])
        assert [r for r, _, _ in own] == list(range(1, len(want) + 1))
        assert [(s, i) for _, i, s in own] == sorted((s, i) for _, i, s in own)
        exact = {}
        for i, v in good:
            exact.setdefault(i, []).append(v)
        for _, i, s in own:
            assert any(len(v) == len(u) and s == pytest.approx(float(np.sqrt(((u - v) ** 2).sum())), abs=1e-12) for v in exact[i])
        hits += len({i for _, i in want} & {i for _, i, _ in own})
        total += len({i for _, i in want})
    assert hits >= 0.9 * total
    assert nearest.nearest(frame(spark, rows).limit(0)).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 101), (103, 101), (7, 7), (200, 201), (201, 202), (202, 200)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in components(df).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100, 103: 100, 200: 200, 201: 200, 202: 200}
    assert components(df.limit(0)).count() == 0
