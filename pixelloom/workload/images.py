"""Registered queries: background fill, normalisation, filters, overlays, advice."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelloom.operators import intensity as I
from pixelloom.operators import parameters as P
from pixelloom.workload import shared, views
from pixelloom.workload.registry import register
from pixelloom.workload.views import sql

PIX = ("fx_pixels",)


def dense(spark, sf):
    return I.densify(views.pixels(spark, sf), views.pixel_sessions(spark, sf))


@register("densify", sql("select session, y, x, cast(value as double) as value from fx_dense", "fx_dense"))
def densify(spark, sf):
    return dense(spark, sf)


PCT = """select session, quantile_cont(value, cast(0.01 as double)) as p1, quantile_cont(value, cast(0.997 as double)) as p997,
         quantile_cont(value, cast(0.05 as double)) as p5, quantile_cont(value, cast(0.95 as double)) as p95,
         quantile_cont(value, cast(0.85 as double)) as p85, quantile_cont(value, cast(0.99 as double)) as p99
         from (select session, cast(value as double) as value from fx_dense) group by 1"""
NORM = """select d.session, d.y, d.x,
          case when p.p997 > p.p1 then greatest(0.0, least(1.0, (d.value - p.p1) / (p.p997 - p.p1))) else 0.0 end as v
          from fx_dense d join pct p on p.session = d.session"""


@register("image_percentiles", sql("""
    select session, round(p1, 6) as p1, round(p997, 6) as p997, round(p99, 6) as p99 from pct""", "fx_dense", pct=PCT))
def image_percentiles(spark, sf):
    out = I.image_percentiles(
        views.pixels(spark, sf), {"p1": 0.01, "p997": 0.997, "p99": 0.99}, views.pixel_sessions(spark, sf)
    )
    return out.select("session", *[F.round(c, 6).alias(c) for c in ("p1", "p997", "p99")])


@register("robust_normalise", sql("select session, y, x, round(v, 6) as normalised from norm", "fx_dense", pct=PCT, norm=NORM))
def robust_normalise(spark, sf):
    return normalised(spark, sf).withColumn("normalised", F.round("normalised", 6))


@register("robust_normalise_embeddings", sql("""
    select i.vec_id, i.y, i.x, round(greatest(0.0, least(1.0, (i.value - p.lo) / (p.hi - p.lo))), 6) as normalised
    from fx_images8 i join (select vec_id, quantile_cont(value, cast(0.01 as double)) as lo,
                            quantile_cont(value, cast(0.997 as double)) as hi from fx_images8 group by 1) p
    on p.vec_id = i.vec_id""", "fx_images8"))
def robust_normalise_embeddings(spark, sf):
    out = I.robust_normalise(views.images8(spark, sf), keys=["vec_id"])
    return out.select("vec_id", "y", "x", F.round("normalised", 6).alias("normalised"))


@register("display_normalise", sql("""
    select d.session, d.y, d.x, round(case when p.p95 > p.p5 then
           greatest(0.0, least(1.0, (d.value - p.p5) / (p.p95 - p.p5))) else 0.0 end, 6) as shown
    from fx_dense d join pct p on p.session = d.session""", "fx_dense", pct=PCT))
def display_normalise(spark, sf):
    out = I.normalise_for_display(dense(spark, sf), 95, 5)
    return out.select("session", "y", "x", F.round("shown", 6).alias("shown"))


@register("threshold_to_zero", sql("""
    select d.session, d.y, d.x, cast(case when d.value < p.p85 then 0 else d.value end as double) as value
    from fx_dense d join pct p on p.session = d.session""", "fx_dense", pct=PCT))
def threshold_to_zero(spark, sf):
    return I.threshold_to_zero(dense(spark, sf), 85.0)


STATS = """select d.session, max((p.p99 - p.p5) / greatest(abs(p.p99), 1.0)) as contrast,
           avg(case when d.value >= p.p95 then 1.0 else 0.0 end) as bright
           from fx_dense d join pct p on p.session = d.session group by 1"""


@register("contrast_and_brightness", sql("""
    select session, round(contrast, 6) as contrast, round(bright, 6) as bright_fraction from stats""",
    "fx_dense", pct=PCT, stats=STATS))
def contrast_and_brightness(spark, sf):
    out = I.contrast_and_brightness(views.pixels(spark, sf), views.pixel_sessions(spark, sf))
    return out.select("session", *[F.round(c, 6).alias(c) for c in ("contrast", "bright_fraction")])


@register("recommended_parameters", sql("""
    select s.session, round(contrast, 6) as contrast, round(bright, 6) as bright_fraction,
           cast(0.1 as double) as solidity_min, cast(0.75 as double) as eccentricity_min,
           cast(0.8 as double) as thinness_max, 11 as tophat_kernel,
           cast(case when contrast < 0.12 then 3.0 else 2.0 end as double) as clahe_clip,
           cast(case when contrast < 0.12 then 1.2 when bright > 0.12 then 0.9 else 1.2 end as double) as mser_max_variation,
           5 as mser_delta, cast(case when a.mid is null then 30 else greatest(10, round_even(a.mid * cast(0.2 as double), 0)) end as int) as mser_min_area,
           cast(case when a.mid is null then 15000 else greatest(1000, round_even(a.top * 3, 0)) end as int) as mser_max_area,
           cast(1.2 as double) as aspect_ratio_min,
           cast(case when contrast < 0.12 then 99.5 else 99.0 end as double) as clip_percentile,
           cast(case when a.mid is null then 30 else greatest(10, round_even(a.mid * cast(0.2 as double), 0)) end as int) as area_min,
           cast(case when contrast < 0.12 then 80.0 when bright > 0.12 then 90.0 else 85.0 end as double) as mser_threshold
    from stats s left join (
      select session, quantile_cont(area, cast(0.5 as double)) as mid, quantile_cont(area, cast(0.95 as double)) as top
      from (select session, label, cast(count(*) as double) as area from truth group by 1, 2) group by 1) a
    on a.session = s.session""", "fx_dense", "truth", pct=PCT, stats=STATS))
def recommended_parameters(spark, sf):
    out = P.recommend(
        views.pixels(spark, sf), shared.target_labels(spark, sf), views.pixel_sessions(spark, sf)
    )
    return out.withColumn("contrast", F.round("contrast", 6)).withColumn(
        "bright_fraction", F.round("bright_fraction", 6)
    )


@register("median_filter", sql("""
    select c.session, c.y, c.x, quantile_cont(cast(n.value as double), 0.5) as value
    from fx_dense c cross join (values (-1), (0), (1)) a(dy) cross join (values (-1), (0), (1)) b(dx)
    join fx_dense n on n.session = c.session and n.y = greatest(0, least(31, c.y + a.dy))
                   and n.x = greatest(0, least(31, c.x + b.dx))
    group by 1, 2, 3""", "fx_dense"))
def median_filter(spark, sf):
    return I.median3(dense(spark, sf))


def normalised(spark, sf):
    """Every cell normalised; percentiles read the occupied cells only."""
    shapes, px = views.pixel_sessions(spark, sf), views.pixels(spark, sf)
    return I.robust_normalise(I.densify(px, shapes), shapes=shapes, measured=px).select(
        "session", "y", "x", "normalised"
    )


def _tophat_sql(kernel, source="fx_dense"):
    r = kernel // 2
    cells = [(dy, dx) for dy, w in zip(range(-r, r + 1), I.ellipse_half_widths(kernel)) for dx in range(-w, w + 1)]
    return {
        "fp": "select * from (values " + ", ".join(f"({a}, {b})" for a, b in cells) + ") v(dy, dx)",
        "er": f"""select c.session, c.y, c.x, min(n.value) as e from {source} c cross join fp
                 join {source} n on n.session = c.session and n.y = c.y + fp.dy and n.x = c.x + fp.dx group by 1, 2, 3""",
        "op": """select c.session, c.y, c.x, max(n.e) as o from er c cross join fp
                 join er n on n.session = c.session and n.y = c.y + fp.dy and n.x = c.x + fp.dx group by 1, 2, 3""",
        "th": f"""select d.session, d.y, d.x, d.value - op.o as value from {source} d
                 join op on op.session = d.session and op.y = d.y and op.x = d.x""",
    }


@register("white_top_hat", sql("select session, y, x, round(value, 6) as value from th", "fx_dense", **_tophat_sql(5)))
def white_top_hat(spark, sf):
    out = I.top_hat(dense(spark, sf), 5)
    return out.select("session", "y", "x", F.round("value", 6).alias("value"))


BYTES = """select d.session, d.y, d.x, cast(floor(greatest(0.0, least(1.0, (d.value - p.p1) /
           ((case when p.p99 > p.p1 then p.p99 else p.p1 + 1 end) - p.p1))) * 255) as int) as value
           from fx_dense d join pct p on p.session = d.session"""
# 4 x 4 pixel tiles, bin limit and blended mapping, spelled out on joins
EQUAL = {
    "hist": """select session, y // 4 as ty, x // 4 as tx, value as v, count(*) as n from th group by 1, 2, 3, 4""",
    "tile": """select session, ty, tx, cast(sum(greatest(n - 1, 0)) as bigint) as excess from hist group by 1, 2, 3""",
    "bins": """select t.session, t.ty, t.tx, b.v, least(coalesce(h.n, 0), 1) + t.excess // 256
               + case when t.excess % 256 > 0 and b.v % greatest(256 // (t.excess % 256), 1) = 0
                       and b.v // greatest(256 // (t.excess % 256), 1) < t.excess % 256 then 1 else 0 end as c
               from tile t cross join (select cast(range as int) as v from range(0, 256)) b
               left join hist h on h.session = t.session and h.ty = t.ty and h.tx = t.tx and h.v = b.v""",
    "lut": """select session, ty, tx, v, least(255.0, round_even(sum(c) over (partition by session, ty, tx order by v) * (cast(255 as double) / 16), 0)) as m
              from bins""",
    "pos": """select session, y, x, value as v, cast(floor(y / 4.0 - 0.5) as int) as t1, cast(floor(x / 4.0 - 0.5) as int) as l1,
              cast(y / 4.0 - 0.5 - floor(y / 4.0 - 0.5) as double) as wy, cast(x / 4.0 - 0.5 - floor(x / 4.0 - 0.5) as double) as wx from th""",
    "eq": """select p.session, p.y, p.x, cast(round_even(round(
               (a.m * (1 - wx) + b.m * wx) * (1 - wy) + (c.m * (1 - wx) + d.m * wx) * wy, 9), 0) as int) as value
             from pos p
             join lut a on a.session = p.session and a.v = p.v and a.ty = greatest(t1, 0) and a.tx = greatest(l1, 0)
             join lut b on b.session = p.session and b.v = p.v and b.ty = greatest(t1, 0) and b.tx = least(l1 + 1, 7)
             join lut c on c.session = p.session and c.v = p.v and c.ty = least(t1 + 1, 7) and c.tx = greatest(l1, 0)
             join lut d on d.session = p.session and d.v = p.v and d.ty = least(t1 + 1, 7) and d.tx = least(l1 + 1, 7)""",
}


@register("enhance_contrast", sql("select * from eq", "fx_dense", pct=PCT, bytes=BYTES, **_tophat_sql(5, "bytes"), **EQUAL))
def enhance_contrast(spark, sf):
    return I.enhance_contrast(dense(spark, sf), views.pixel_sessions(spark, sf), kernel=5, clip=2.0)


@register("intensity_histogram", sql("""
    select session, cast(y // 8 as int) as tile_y, cast(x // 8 as int) as tile_x, value, count(*) as pixels
    from (select session, y, x, cast(floor(value / 1000) as int) as value from fx_pixels) group by 1, 2, 3, 4""", *PIX))
def intensity_histogram(spark, sf):
    px = views.pixels(spark, sf).withColumn("value", F.floor(F.col("value") / 1000).cast("int"))
    return I.intensity_histogram(px, 8)


@register("dilate_mask", sql("""
    select distinct session, cast(y + dy as int) as y, cast(x + dx as int) as x
    from fx_pixels cross join (select range as dy from range(-3, 4)) cross join (select range as dx from range(-3, 4))
    where target = 1 and abs(dy) + abs(dx) <= 3 and y + dy between 0 and 31 and x + dx between 0 and 31""", *PIX))
def dilate_mask(spark, sf):
    mask = views.pixels(spark, sf).filter("target = 1")
    return I.dilate(mask, views.sessions(spark, sf), 3)


@register("mask_runs", sql("""
    select session, y, cast(min(x) as int) as x0, cast(max(x) as int) as x1
    from (select session, y, x, x - row_number() over (partition by session, y order by x) as g
          from fx_pixels where target = 1) group by session, y, g""", *PIX))
def mask_runs(spark, sf):
    return I.mask_runs(shared.target_mask(spark, sf))


EDGE = """select t.session, t.y, t.x, t.label, bool_or(coalesce(n.label, 0) <> t.label) as boundary
    from truth t cross join (values (0, 1), (0, -1), (1, 0), (-1, 0)) d(dy, dx)
    left join truth n on n.session = t.session and n.y = (t.y + d.dy + 32) % 32 and n.x = (t.x + d.dx + 32) % 32
    group by 1, 2, 3, 4"""


@register("label_boundary", sql("select * from edge", "truth", edge=EDGE))
def label_boundary(spark, sf):
    return I.label_boundary(shared.target_labels(spark, sf), views.sessions(spark, sf))


@register("label_overlay", sql("""
    select n.session, n.y, n.x, """ + ", ".join(
    f"""round(case when e.boundary then {c} when e.label is not null then 0.45 * n.v + cast(0.55 as double) *
        (0.1 + cast(0.9 as double) * (cast(concat('0x', substr(md5(concat('{I.PALETTE_SEED}|', e.label, '|{i}')), 1, 8)) as bigint) / 4294967296.0))
        else n.v end, 6) as {'rgb'[i]}""" for i, c in enumerate(I.BOUNDARY_COLOUR)) + """
    from norm n left join edge e on e.session = n.session and e.y = n.y and e.x = n.x""",
    "fx_dense", "truth", pct=PCT, norm=NORM, edge=EDGE))
def label_overlay(spark, sf):
    normal = normalised(spark, sf)
    out = I.label_overlay(normal, shared.target_labels(spark, sf), views.sessions(spark, sf))
    return out.select("session", "y", "x", *[F.round(c, 6).alias(c) for c in "rgb"])


@register("error_overlay", sql("""
    select n.session, n.y, n.x, """ + ", ".join(
    "round(case e.error " + " ".join(
        f"when '{k}' then cast(0.4 as double) * n.v + cast({0.6 * c[i]!r} as double)" for k, c in I.ERROR_COLOURS.items()
    ) + f" else n.v end, 6) as {'rgb'[i]}" for i in range(3)) + """
    from norm n left join (
      select session, y, x, case when p = 1 and t = 1 then 'TP' when p = 1 then 'FP' else 'FN' end as error
      from (select session, y, x, cast(probability >= 0.25 as int) as p, target as t from fx_pixels) where p + t > 0) e
    on e.session = n.session and e.y = n.y and e.x = n.x""", "fx_dense", pct=PCT, norm=NORM))
def error_overlay(spark, sf):
    from pixelloom.operators.scores import error_map

    px = views.pixels(spark, sf)
    errors = error_map(px.filter("probability >= 0.25"), px.filter("target = 1"))
    normal = normalised(spark, sf)
    out = I.error_overlay(normal, errors)
    return out.select("session", "y", "x", *[F.round(c, 6).alias(c) for c in "rgb"])


@register("paired_load", sql("""
    select n.session, n.y, n.x, round(n.v, 6) as normalised, cast(case when t.y is null then 0 else 1 end as double) as mask
    from norm n left join truth t on t.session = n.session and t.y = n.y and t.x = n.x""",
    "fx_dense", "truth", pct=PCT, norm=NORM))
def paired_load(spark, sf):
    out = I.load_pairs(dense(spark, sf), shared.target_labels(spark, sf))
    return out.withColumn("normalised", F.round("normalised", 6))


# --------------------------------------------------------------- operating points
@register("operating_point_lookup", """
    with req as (select o_orderkey as request_id, o_custkey % 4 as m, o_orderkey % 3 as c,
                        case when o_orderkey % 5 = 0 then (o_custkey % 10) / cast(10 as double) end as t,
                        case when o_orderkey % 7 = 0 then cast(o_custkey % 50 as int) end as s,
                        case when o_orderkey % 2 = 0 then o_orderkey % 4 = 0 end as tta from orders)
    select request_id, concat('m', m) as model,
           case when c = 0 or m = 3 then concat('ck', c) else concat('reg', m) end as checkpoint,
           cast(coalesce(t, case m when 0 then 0.25 when 1 then null when 2 then 0.4 end,
                case when c = 0 or m = 3 then 0.3 + c / cast(10 as double) end, 0.5) as double) as threshold,
           cast(coalesce(s, case m when 0 then 45 when 2 then 10 end, case when c = 0 or m = 3 then 20 + c end, 30) as int) as min_size,
           cast(coalesce(case m when 2 then 900 end, case when (c = 0 or m = 3) and c <> 1 then 500 end) as int) as max_size,
           coalesce(tta, case m when 0 then true end, false) as tta
    from req""")
def operating_point_lookup(spark, sf):
    """Requests from orders against a registry and checkpoints derived from them."""
    o = views.table(spark, sf, "orders")
    m, c = F.col("o_custkey") % 4, F.col("o_orderkey") % 3
    none = F.lit(None)
    requests = o.select(
        F.col("o_orderkey").alias("request_id"), F.concat(F.lit("m"), m.cast("string")).alias("model"),
        F.when((c == 0) | (m == 3), F.concat(F.lit("ck"), c.cast("string"))).alias("checkpoint"),
        F.when(F.col("o_orderkey") % 5 == 0, F.col("o_custkey") % 10 / 10.0).alias("threshold"),
        F.when(F.col("o_orderkey") % 7 == 0, (F.col("o_custkey") % 50).cast("int")).alias("min_size"),
        F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") % 4 == 0).alias("tta"),
    )
    registry = o.select(m.alias("m")).filter("m < 3").distinct().select(
        F.concat(F.lit("m"), F.col("m").cast("string")).alias("model"),
        F.concat(F.lit("reg"), F.col("m").cast("string")).alias("checkpoint"),
        F.when(F.col("m") == 0, 0.25).when(F.col("m") == 2, 0.4).alias("threshold"),
        F.when(F.col("m") == 0, 45).when(F.col("m") == 2, 10).alias("min_size"),
        F.when(F.col("m") == 2, 900).alias("max_size"),
        F.when(F.col("m") == 0, True).otherwise(none).alias("tta"),
    )
    checkpoints = o.select(c.alias("c")).distinct().select(
        F.concat(F.lit("ck"), F.col("c").cast("string")).alias("checkpoint"),
        (0.3 + F.col("c") / 10.0).alias("threshold"), (20 + F.col("c")).cast("int").alias("min_size"),
        F.when(F.col("c") != 1, 500).alias("max_size"),
    )
    return P.resolve_operating_point(requests, registry, checkpoints)
