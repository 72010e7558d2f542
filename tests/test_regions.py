import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from grids import components, frame, grid, labels, shapes
from pixelloom.functions.scalars import key_column, key_row
from pixelloom.operators import proposals as Q
from pixelloom.operators import shape as H
from pixelloom.plans.segmentation import propose_rois
from pixelloom.workload import regions


def blobs(seed=8, side=24):
    rng = np.random.default_rng(seed)
    return components(rng.random((side, side)) < 0.5)


def inside_hull(cells):
    """Pixels in the hull of the pixel edges' midpoints, by half planes."""
    pts = [(y + a, x + b) for y, x in cells for a, b in ((0.5, 0), (-0.5, 0), (0, 0.5), (0, -0.5))]
    ys, xs = [p[0] for p in cells], [p[1] for p in cells]
    sides = []
    for i, p in enumerate(pts):
        for q in pts[i + 1:]:
            if p == q:
                continue
            side = [(q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0]) for r in pts]
            if all(s <= 1e-9 for s in side):
                sides.append((p, q, 1))
            if all(s >= -1e-9 for s in side):
                sides.append((p, q, -1))
    n = 0
    for y in range(min(ys), max(ys) + 1):
        for x in range(min(xs), max(xs) + 1):
            n += all(
                s * ((q[0] - p[0]) * (x - p[1]) - (q[1] - p[1]) * (y - p[0])) <= 1e-9 for p, q, s in sides
            )
    return n


def test_solidity_equals_half_plane_count(spark):
    drawn = blobs(side=14)
    out = {r.label: r for r in H.solidity(labels(spark, drawn)).collect()}
    for k, row in out.items():
        cells = [tuple(map(int, c)) for c in np.argwhere(drawn == k)]
        assert row.convex_area == inside_hull(cells), cells
        assert row.solidity == pytest.approx(len(cells) / row.convex_area)


def test_geometry_and_perimeter(spark):
    drawn = blobs()
    geometry = {r.label: r for r in H.geometry(labels(spark, drawn)).collect()}
    perimeters = {r.label: r.perimeter for r in H.perimeter(labels(spark, drawn)).collect()}
    weights = {**dict.fromkeys(H.STRAIGHT_CODES, 1.0), **dict.fromkeys(H.DIAGONAL_CODES, math.sqrt(2)),
               **dict.fromkeys(H.MIXED_CODES, (1 + math.sqrt(2)) / 2)}
    for k in range(1, drawn.max() + 1):
        mask = np.pad(drawn == k, 1)
        ys, xs = np.nonzero(mask[1:-1, 1:-1])
        inner = mask & np.roll(mask, 1, 0) & np.roll(mask, -1, 0) & np.roll(mask, 1, 1) & np.roll(mask, -1, 1)
        edge = mask & ~inner
        total = 0.0
        for y, x in np.argwhere(edge):
            code = 1 + sum(
                (2 if abs(a) + abs(b) == 1 else 10) * edge[y + a, x + b]
                for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b
            )
            total += weights.get(code, 0.0)
        assert perimeters[k] == pytest.approx(total)
        vals = np.sort(np.linalg.eigvalsh(np.cov(np.vstack([ys, xs]), bias=True)))[::-1] if len(ys) > 1 else [0, 0]
        assert geometry[k].major_axis == pytest.approx(4 * math.sqrt(max(vals[0], 0)), abs=1e-6)
        assert geometry[k].centroid_x == pytest.approx(xs.mean())


def plain_stable(image, delta, lo, hi, most):
    """Stable regions by labelling every level of both polarities."""
    out = []
    for polarity, u in ((0, image), (1, 255 - image)):
        maps = {i: components(u >= i) for i in range(1, int(u.max()) + 1)}
        info = {}
        for i, m in maps.items():
            for k in range(1, m.max() + 1):
                y, x = np.argwhere(m == k)[0]
                parent = (i - 1, maps[i - 1][y, x]) if i > 1 else None
                far = (i - delta, maps[i - delta][y, x]) if i > delta else None
                info[i, k] = {"area": int((m == k).sum()), "seed": (int(y), int(x)), "parent": parent, "far": far, "kids": [], "inner": 0}
        for key, r in info.items():
            if r["parent"]:
                info[r["parent"]]["kids"].append(key)
            if r["far"]:
                info[r["far"]]["inner"] = max(info[r["far"]]["inner"], r["area"])
        for r in info.values():
            r["main"] = max(r["kids"], key=lambda c: (info[c]["area"], [-v for v in info[c]["seed"]]), default=None)
            r["v"] = (info[r["far"]]["area"] - r["inner"]) / r["area"] if r["far"] else None
        for (i, _), r in info.items():
            v = r["v"]
            if v is None or v > most or not lo <= r["area"] <= hi:
                continue
            pv = info[r["parent"]]["v"]
            cv = info[r["main"]]["v"] if r["main"] else None
            if (pv is None or v <= pv) and (cv is None or v < cv):
                out.append((polarity, i, *r["seed"], r["area"], round(v, 9)))
    return sorted(out)


@pytest.mark.parametrize("tile", [6, 64])
def test_stable_regions_equal_plain_search(spark, tile):
    rng = np.random.default_rng(11)
    image = rng.integers(0, 256, (16, 18))
    image = (image + np.roll(image, 1, 0) + np.roll(image, 1, 1)) // 3
    regions, spans = Q.stable_regions(
        frame(spark, "value", image, kind="int"), 20, 5, 120, 1.2, tile=tile,
        max_side=18 if tile == 64 else None,
    )
    found = sorted(
        (r.polarity, r.level, r.y, r.x, r.area, round(r.variation, 9))
        for r in regions.withColumn("y", key_row("root")).withColumn("x", key_column("root")).collect()
    )
    assert found == plain_stable(image, 20, 5, 120, 1.2)
    sizes = spans.groupBy("region").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("n"))
    assert {r.region: r.n for r in sizes.collect()} == {r.region: r.area for r in regions.collect()}


def test_model_free_route_keeps_fixed_rois(spark):
    y, x = np.mgrid[:48, :48]
    image = np.zeros((48, 48))
    image += 90 * np.exp(-((y - 12) ** 2) / 6 - ((x - 20) ** 2) / 200)
    image += 90 * np.exp(-((x - 38) ** 2) / 6 - ((y - 34) ** 2) / 120)
    image += np.random.default_rng(0).random((48, 48))
    fixed = spark.createDataFrame([("s", 1, a, 2) for a in range(30, 40)], "session string, roi_id int, y int, x int")
    shape = shapes(spark, ("s", 48, 48))
    out = propose_rois(
        frame(spark, "value", image), shape,
        # the background of so small an image must not pass for a region
        {"MSER min area": 10, "area min": 10, "MSER threshold": 90.0, "MSER max area": 400, "MSER max variation": 0.5},
        fixed, max_side=48,
    )
    rois = out.rois.groupBy("label", "is_fixed").count().collect()
    assert [(r.label, r["count"]) for r in rois if r.is_fixed] == [(1, 10)]
    assert any(not r.is_fixed for r in rois)
    stats = out.stats.first()
    assert stats.fixed == 1 and stats.kept == len(rois) and stats.regions >= stats.candidates
    table = grid(out.labels, "label", (48, 48))
    assert (table[30:40, 2] == 1).all()


def test_level_runs_query_takes_every_level(spark):
    import __spark_entry__ as entry

    runs = entry.queries()["level_runs_every_level"](spark, "/root/testdata/sf0.001")
    image = regions.byte_image(spark, "/root/testdata/sf0.001").agg(F.max("value"), F.min("value")).first()
    top = {r.polarity: r.top for r in runs.groupBy("polarity").agg(F.countDistinct("level").alias("top")).collect()}
    assert top == {Q.BRIGHT: image[0], Q.DARK: 255 - image[1]}
