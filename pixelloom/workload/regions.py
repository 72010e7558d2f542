"""Registered queries: region shape, stable regions, scoring, prediction bundle."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from pixelloom.functions.scalars import column_name, key_column, key_row
from pixelloom.operators import intensity as I
from pixelloom.operators import parameters as P
from pixelloom.operators import proposals as Q
from pixelloom.operators import scoring as S
from pixelloom.operators import shape as H
from pixelloom.plans.prediction import predict_images
from pixelloom.plans.segmentation import prepare, propose_rois
from pixelloom.session import StoredTable
from pixelloom.workload import shared, views
from pixelloom.workload.images import EQUAL
from pixelloom.workload.registry import register
from pixelloom.workload.views import sql

SIDE = views.SIDE

GEOMETRY = """
    select session, label, area, cx, cy, 4 * sqrt(l1) as major, 4 * sqrt(l2) as minor,
           case when l1 > 0 then sqrt(1 - l2 / l1) else 0.0 end as ecc,
           4 * sqrt(l1) / greatest(4 * sqrt(l2), cast(1e-6 as double)) as aspect
    from (select *, m + s as l1, greatest(m - s, 0.0) as l2
          from (select *, (vx + vy) / 2 as m, sqrt(((vx - vy) / 2) * ((vx - vy) / 2) + c * c) as s
                from (select session, label, count(*) as area, avg(x) as cx, avg(y) as cy, var_pop(x) as vx, var_pop(y) as vy,
                             covar_pop(cast(x as double), cast(y as double)) as c from pred group by 1, 2)))"""
PERIMETER = {
    "border": """select p.session, p.label, p.y, p.x from pred p where (
        select count(*) from pred n where n.session = p.session and n.label = p.label
          and abs(n.y - p.y) + abs(n.x - p.x) = 1) < 4""",
    "peri": """select session, label, sum(case when code in (5, 7, 15, 17, 25, 27) then 1.0 when code in (21, 33) then sqrt(2.0)
                 when code in (13, 23) then (1 + sqrt(2.0)) / 2 else 0.0 end) as perimeter
        from (select b.session, b.label, b.y, b.x,
                     1 + cast(sum(case when abs(n.y - b.y) + abs(n.x - b.x) = 1 then 2
                                       when abs(n.y - b.y) = 1 and abs(n.x - b.x) = 1 then 10 else 0 end) as int) as code
              from border b join border n on n.session = b.session and n.label = b.label
              group by 1, 2, 3, 4) group by 1, 2""",
}


@register("region_geometry", sql(f"""
    select session, label, area, round(cx, 6) as centroid_x, round(cy, 6) as centroid_y, round(major, 6) as major_axis,
           round(minor, 6) as minor_axis, round(ecc, 6) as eccentricity from ({GEOMETRY})""", "pred"))
def region_geometry(spark, sf):
    out = H.geometry(shared.predicted_labels(spark, sf)).drop("aspect_ratio")
    return out.select("session", "label", "area", *[
        F.round(c, 6).alias(c) for c in ("centroid_x", "centroid_y", "major_axis", "minor_axis", "eccentricity")
    ])


@register("region_perimeter", sql("select session, label, round(perimeter, 6) as perimeter from peri", "pred", **PERIMETER))
def region_perimeter(spark, sf):
    return H.perimeter(shared.predicted_labels(spark, sf)).withColumn("perimeter", F.round("perimeter", 6))


# the hull's edge at a row is the outermost line between two row ends on either side
HULL = {
    "spans": "select session, label, y, min(x) as lo, max(x) as hi, count(*) as n from pred group by 1, 2, 3",
    "ends": """select session, label, cast(y as double) as py, lo - cast(0.5 as double) as l, hi + cast(0.5 as double) as r from spans union all
               select session, label, y + d, lo, hi from spans cross join (select cast(0.5 as double) as d union all select cast(-0.5 as double)) v""",
    "edge": """select s.session, s.label, s.y,
               min(case when p.py = q.py then p.l else p.l + (q.l - p.l) * (s.y - p.py) / (q.py - p.py) end) as l,
               max(case when p.py = q.py then p.r else p.r + (q.r - p.r) * (s.y - p.py) / (q.py - p.py) end) as r
               from spans s join ends p on p.session = s.session and p.label = s.label and p.py <= s.y
               join ends q on q.session = s.session and q.label = s.label and q.py >= s.y group by 1, 2, 3""",
    "solid": """select s.session, s.label, cast(sum(n) as bigint) as area,
                cast(sum(floor(r + cast(1e-9 as double)) - ceil(l - cast(1e-9 as double)) + 1) as bigint) as convex_area
                from spans s join edge e on e.session = s.session and e.label = s.label and e.y = s.y group by 1, 2""",
}


@register("region_solidity", sql(
    "select session, label, convex_area, cast(area as double) / convex_area as solidity from solid", "pred", **HULL))
def region_solidity(spark, sf):
    return H.solidity(shared.predicted_labels(spark, sf))


LOOSE = {"area min": 6, "solidity min": 0.6, "eccentricity min": 0.75, "aspect ratio min": 1.2, "thinness max": 0.8}


@register("shape_filter", sql(f"""
    select g.session, g.label from ({GEOMETRY}) g join peri p on p.session = g.session and p.label = g.label
    join solid h on h.session = g.session and h.label = g.label
    where g.area >= 6 and g.ecc >= 0.75 and g.aspect >= 1.2 and cast(h.area as double) / h.convex_area >= 0.6
      and 4 * pi() * g.area / (greatest(p.perimeter, cast(1e-6 as double)) * greatest(p.perimeter, cast(1e-6 as double))) <= 0.8""",
    "pred", **PERIMETER, **HULL))
def shape_filter(spark, sf):
    labels = StoredTable(shared.predicted_labels(spark, sf)).df
    return H.shape_candidates(labels, LOOSE)


# ----------------------------------------------------------------- stable regions
def byte_image(spark, sf):
    dense = I.densify(views.pixels(spark, sf), views.pixel_sessions(spark, sf), value="probability")
    return dense.select("session", "y", "x", F.floor(F.col("probability") * 255).cast("int").alias("value"))


# every fixture level in both polarities, flooded pixel by pixel
LEVELS = {
    "bytes": """select d.session, d.y, d.x, cast(floor(coalesce(p.probability, 0) * 255) as int) as v
                from fx_dense d left join fx_pixels p on p.session = d.session and p.y = d.y and p.x = d.x""",
    "pol": "select session, 0 as polarity, y, x, v as u from bytes union all select session, 1, y, x, 255 - v from bytes",
    "lev": """select session, polarity, cast(l.range as int) as level, y, x from pol join range(1, 52) l on u >= l.range * 5""",
}


@register("level_runs", sql("""
    select session, polarity, level, y, cast(min(x) as int) as x0, cast(max(x) as int) as x1
    from (select *, x - row_number() over (partition by session, polarity, level, y order by x) as g from lev)
    group by session, polarity, level, y, g""", "fx_dense", **LEVELS))
def level_runs(spark, sf):
    """Every fifth grey level, as far apart as areas are compared by default."""
    return Q.level_runs(byte_image(spark, sf), 5)


EVERY_LEVEL = {k: LEVELS[k] for k in ("bytes", "pol")} | {
    "lev": "select session, polarity, cast(l.range as int) as level, y, x from pol join range(1, 256) l on u >= l.range",
}


@register("level_runs_every_level", sql("""
    select session, polarity, level, y, cast(min(x) as int) as x0, cast(max(x) as int) as x1
    from (select *, x - row_number() over (partition by session, polarity, level, y order by x) as g from lev)
    group by session, polarity, level, y, g""", "fx_dense", **EVERY_LEVEL))
def level_runs_every_level(spark, sf):
    """All 255 grey levels, as the stable regions read them."""
    return Q.level_runs(byte_image(spark, sf), 1)


@register("stable_regions")
def stable_regions(spark, sf):
    image = StoredTable(byte_image(spark, sf)).df
    regions, _ = Q.stable_regions(image, 5, 5, 200, 1.2, max_side=SIDE, with_spans=False)
    return regions.select(
        "session", "region", "polarity", "level", key_row("root").alias("first_y"),
        key_column("root").alias("first_x"), "area", "variation",
    )


# bounds that leave regions of noise, so that there is much to compare
LOOSE_SHAPE = {"eccentricity min": 0.3, "aspect ratio min": 1.05, "thinness max": 3.0, "solidity min": 0.3}
SMALL = {"MSER min area": 5, "MSER max area": 200, "area min": 5, "MSER threshold": 60.0, "tophat kernel": 5, "MSER max variation": 4.0, **LOOSE_SHAPE}


@register("propose_rois")
def propose_rois_query(spark, sf):
    """The whole model-free route with all target ROIs of each session held fixed."""
    pixels, shapes = views.pixels(spark, sf), views.pixel_sessions(spark, sf)
    fixed = shared.target_labels(spark, sf).withColumnRenamed("label", "roi_id")
    out = propose_rois(I.densify(pixels, shapes), shapes, SMALL, fixed, max_side=SIDE)
    return out.rois.groupBy("session", "label", "is_fixed").agg(F.count("*").alias("area"))


@register("segmentation_statistics")
def segmentation_statistics(spark, sf):
    pixels, shapes = views.pixels(spark, sf), views.pixel_sessions(spark, sf)
    return propose_rois(I.densify(pixels, shapes), shapes, SMALL, max_side=SIDE).stats


# ------------------------------------------------------- parameters of each image
KERNELS, CLIPS, CUTS = (3, 5, 7), (2.0, 32.0, 48.0), (60.0, 75.0, 85.0)


def own_parameters(spark, sf):
    """The advice for each session with, by its number, one of three kernels, clips and thresholds."""
    advice = P.recommend(views.pixels(spark, sf), shared.target_labels(spark, sf), views.pixel_sessions(spark, sf))
    turn = F.substring("session", 5, 10).cast("int") % 3

    def one_of(values):
        return F.element_at(F.array(*map(F.lit, values)), turn + 1)

    return advice.withColumn("tophat_kernel", one_of(KERNELS)).withColumn("clahe_clip", one_of(CLIPS)).withColumn("mser_threshold", one_of(CUTS))


def _footprints():
    cells = [(k, dy, dx) for k in KERNELS for dy, w in zip(range(-(k // 2), k // 2 + 1), I.ellipse_half_widths(k)) for dx in range(-w, w + 1)]
    return "select * from (values " + ", ".join(map(str, cells)) + ") v(kernel, dy, dx)"


# tiles are 4 x 4 pixels, so a clip of 2, 32 and 48 allows 1, 2 and 3 pixels of a value
PREPARED = {
    "own": """select distinct session, cast(substr(session, 5, 10) as int) % 3 as turn, [3, 5, 7][cast(substr(session, 5, 10) as int) % 3 + 1] as kernel,
              cast(substr(session, 5, 10) as int) % 3 + 1 as lim from fx_dense""",
    "med": """select c.session, c.y, c.x, quantile_cont(cast(n.value as double), 0.5) as value
              from fx_dense c cross join (values (-1), (0), (1)) a(dy) cross join (values (-1), (0), (1)) b(dx)
              join fx_dense n on n.session = c.session and n.y = greatest(0, least(31, c.y + a.dy)) and n.x = greatest(0, least(31, c.x + b.dx))
              group by 1, 2, 3""",
    "ends": """select session, quantile_cont(value, cast(0.01 as double)) as p1, quantile_cont(value, cast(0.99 as double)) as p99 from med group by 1""",
    "scaled": """select d.session, d.y, d.x, cast(floor(greatest(0.0, least(1.0, (d.value - p.p1) /
                 ((case when p.p99 > p.p1 then p.p99 else p.p1 + 1 end) - p.p1))) * 255) as int) as value, o.kernel
                 from med d join ends p on p.session = d.session join own o on o.session = d.session""",
    "fp": _footprints(),
    "er": """select c.session, c.y, c.x, c.kernel, min(n.value) as e from scaled c join fp on fp.kernel = c.kernel
             join scaled n on n.session = c.session and n.y = c.y + fp.dy and n.x = c.x + fp.dx group by 1, 2, 3, 4""",
    "op": """select c.session, c.y, c.x, max(n.e) as o from er c join fp on fp.kernel = c.kernel
             join er n on n.session = c.session and n.y = c.y + fp.dy and n.x = c.x + fp.dx group by 1, 2, 3""",
    "th": "select d.session, d.y, d.x, d.value - op.o as value from scaled d join op on op.session = d.session and op.y = d.y and op.x = d.x",
    **EQUAL,
    "tile": """select h.session, ty, tx, max(lim) as lim, cast(sum(greatest(n - lim, 0)) as bigint) as excess
               from hist h join own o on o.session = h.session group by 1, 2, 3""",
    "bins": EQUAL["bins"].replace("least(coalesce(h.n, 0), 1)", "least(coalesce(h.n, 0), t.lim)"),
    "cuts": """select e.session, case max(turn) when 0 then quantile_cont(e.value, cast(0.6 as double)) when 1 then quantile_cont(e.value, cast(0.75 as double))
               else quantile_cont(e.value, cast(0.85 as double)) end as cut
               from (select session, cast(value as double) as value from eq) e join own o on o.session = e.session group by 1""",
}


@register("prepare_with_own_parameters", sql("""
    select e.session, e.y, e.x, cast(case when e.value < c.cut then 0 else e.value end as int) as value
    from eq e join cuts c on c.session = e.session""", "fx_dense", **PREPARED))
def prepare_with_own_parameters(spark, sf):
    """Median, contrast and cut, each session by its own kernel, clip and threshold."""
    dense = I.densify(views.pixels(spark, sf), views.pixel_sessions(spark, sf))
    return prepare(dense, views.pixel_sessions(spark, sf), StoredTable(own_parameters(spark, sf)).df)


@register("propose_rois_with_own_parameters")
def propose_rois_with_own_parameters(spark, sf):
    """The whole model-free route with the advice of each session for its parameters."""
    pixels, shapes = views.pixels(spark, sf), views.pixel_sessions(spark, sf)
    own = own_parameters(spark, sf)
    for name in ("MSER min area", "MSER max variation", "area min", *LOOSE_SHAPE):
        own = own.withColumn(column_name(name), F.lit(SMALL[name]))
    out = propose_rois(I.densify(pixels, shapes), shapes, own, max_side=SIDE)
    return out.rois.groupBy("session", "label", "is_fixed").agg(F.count("*").alias("area"))


# ------------------------------------------------------------------------ scoring
def ramp_model():
    """A stand-in model whose answer depends on position, so flips matter."""

    def score(batch: np.ndarray) -> np.ndarray:
        rows, cols = np.mgrid[:batch.shape[1], :batch.shape[2]]
        return 1 / (1 + np.exp(-(4 * batch - 2 + 0.1 * cols + 0.05 * rows)))

    return score


def array_images(spark, sf):
    return views.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("session"), F.lit(8).alias("height"), F.lit(8).alias("width"),
        F.col("embedding").alias("pixels"),
    )


NORM8 = """select i.vec_id as session, i.y, i.x, greatest(0.0, least(1.0, (i.value - p.lo) / (p.hi - p.lo))) as n
    from fx_images8 i join (select vec_id, quantile_cont(value, cast(0.01 as double)) as lo,
    quantile_cont(value, cast(0.997 as double)) as hi from fx_images8 group by 1) p on p.vec_id = i.vec_id"""
SIG = "1 / (1 + exp(-(4 * n - 2 + cast(0.1 as double) * {x} + cast(0.05 as double) * {y})))"
PLAIN = SIG.format(x="x", y="y")
VIEWS4 = " + ".join(SIG.format(x=x, y=y) for y in ("y", "(7 - y)") for x in ("x", "(7 - x)"))


@register("batch_scoring", sql(f"select session, y, x, round({PLAIN}, 6) as probability from norm8", "fx_images8", norm8=NORM8))
def batch_scoring(spark, sf):
    scored = S.score_images(array_images(spark, sf), ramp_model)
    return S.explode_image(scored, "probability", "probability").withColumn("probability", F.round("probability", 6))


@register("flip_averaged_scoring", sql(f"select session, y, x, round(({VIEWS4}) / 4, 6) as probability from norm8", "fx_images8", norm8=NORM8))
def flip_averaged_scoring(spark, sf):
    scored = S.score_images(array_images(spark, sf), ramp_model, tta=True)
    return S.explode_image(scored, "probability", "probability").withColumn("probability", F.round("probability", 6))


@register("flip_averaged_expression", sql(f"select session, y, x, round(({VIEWS4}) / 4, 6) as probability from norm8", "fx_images8", norm8=NORM8))
def flip_averaged_expression(spark, sf):
    """The same with a column expression as the model, all on pixel rows."""
    images = views.images8(spark, sf).withColumnRenamed("vec_id", "session")
    normal = I.robust_normalise(images).select(
        "session", "y", "x", "normalised", F.lit(8).alias("height"), F.lit(8).alias("width")
    )
    z = 4 * F.col("normalised") - 2 + 0.1 * F.col("x") + 0.05 * F.col("y")
    scored = S.flip_views(normal).withColumn("probability", 1 / (1 + F.exp(-z)))
    return S.average_views(scored).withColumn("probability", F.round("probability", 6))


@register("prediction_bundle", sql("""
    select r.session, cast(row_number() over (partition by r.session order by r.root) as int) as roi_id, r.area,
           cast(greatest(10, round_even(a.mid * cast(0.2 as double), 0)) as int) as area_min, cast(0.5 as double) as threshold
    from (select session, root, count(*) as area from (
            select session, y, x, min(root) as root from fl8 group by 1, 2, 3) group by 1, 2 having count(*) >= 3) r
    join (select session, quantile_cont(area, 0.5) as mid from (
            select session, root, cast(count(*) as double) as area from (
              select session, y, x, min(root) as root from fl8 group by 1, 2, 3) group by 1, 2 having count(*) >= 3) group by 1) a
    on a.session = r.session""", "fx_images8", norm8=NORM8,
    m8=f"select session, y, x from norm8 where {PLAIN} >= 0.5",
    fl8="""select session, y, x, y * 100 + x as root from m8 union
           select f.session, f.y, f.x, r.root from fl8 r cross join (values (0, 1), (0, -1), (1, 0), (-1, 0)) d(dy, dx)
           join m8 f on f.session = r.session and f.y = r.y + d.dy and f.x = r.x + d.dx where r.root < f.y * 100 + f.x"""))
def prediction_bundle(spark, sf):
    out = predict_images(array_images(spark, sf), ramp_model, threshold=0.5, min_size=3, max_side=8)
    areas = out.rois.groupBy("session", "roi_id").agg(F.sum(F.size("xpix")).cast("bigint").alias("area"))
    return areas.join(out.parameters.select("session", "area_min"), "session").join(out.points.select("session", "threshold"), "session")
