"""Registered queries: ROI records, components, scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelloom.operators import components as C
from pixelloom.operators import rois as R
from pixelloom.operators import scores as S
from pixelloom.functions.scalars import key_column, key_row
from pixelloom.workload import shared, views
from pixelloom.workload.registry import register
from pixelloom.workload.views import sql

SIDE = views.SIDE

# ------------------------------------------------------------------- ROI records
RAW = """
    select concat('A', o_custkey % 4, '-s', lpad(cast(o_custkey % 50 as varchar(10)), 4, '0')) as session,
           o_orderkey as roi_id, o_orderkey as ord,
           cast(o_custkey % 40 as varchar) as a, cast(o_orderkey % 36 as varchar) as b,
           case when o_orderkey % 11 = 0 then 'bad'
                when o_orderkey % 7 = 0 then concat(cast(o_custkey % 9 as varchar), '.75')
                when o_orderkey % 13 = 0 then '-2' else cast(o_orderkey % 30 as varchar) end as c,
           o_orderkey % 5 as cut
    from orders"""


def raw_rois(spark, sf):
    """Text ROI records: fractions, negatives, words, unequal and missing lists."""
    o = views.table(spark, sf, "orders")
    cust, key = F.col("o_custkey"), F.col("o_orderkey")
    session = F.concat(
        F.lit("A"), (cust % 4).cast("string"), F.lit("-s"), F.lpad((cust % 50).cast("string"), 4, "0")
    )
    a, b = (cust % 40).cast("string"), (key % 36).cast("string")
    c = (
        F.when(key % 11 == 0, "bad")
        .when(key % 7 == 0, F.concat((cust % 9).cast("string"), F.lit(".75")))
        .when(key % 13 == 0, "-2").otherwise((key % 30).cast("string"))
    )
    ypix = F.when(key % 5 == 0, F.array(b, a)).when(key % 5 == 1, F.lit(None)).otherwise(F.array(b, a, b))
    return o.select(
        session.alias("session"), key.alias("roi_id"), key.alias("ord"),
        F.array(a, b, c).alias("xpix"), ypix.alias("ypix"),
    )


def raw_shapes(spark, sf):
    return raw_rois(spark, sf).select("session").distinct().select(
        "session", F.lit(SIDE).alias("height"), F.lit(SIDE).alias("width")
    )


# the checking SQL spells the three pairs out instead of using arrays
CLEAN_SQL = f"""
with raw as ({RAW}),
num as (select *, try_cast(a as double) as fa, try_cast(b as double) as fb, try_cast(c as double) as fc from raw),
cells as (
  select session, roi_id, ord, 1 as pos, cast(trunc(fa) as bigint) as x, cast(trunc(fb) as bigint) as y, fc, cut from num
  union all
  select session, roi_id, ord, 2, cast(trunc(fb) as bigint), cast(trunc(fa) as bigint), fc, cut from num
  union all
  select session, roi_id, ord, 3, cast(trunc(fc) as bigint), cast(trunc(fb) as bigint), fc, cut from num where cut <> 0),
ok as (select *, (fc is null or cut = 1) as broken, x between 0 and 31 and y between 0 and 31 as inside from cells)
"""


@register(
    "roi_cleaning",
    CLEAN_SQL + """
    select session, roi_id,
           cast(max(case when broken then 1 else 0 end)
                + case when bool_or(broken) then 0
                       else max(case when cut = 0 then 1 else 0 end) + max(case when inside then 0 else 1 end)
                  end as int) as invalid,
           not bool_or(broken) and bool_or(inside) as kept,
           cast(count(case when not broken and inside then 1 end) as int) as area,
           cast(coalesce(sum(case when not broken and inside then x * 64 + y end), 0) as bigint) as pixel_sum
    from ok group by session, roi_id""",
)
def roi_cleaning(spark, sf):
    cleaned = R.clean_rois(raw_rois(spark, sf), raw_shapes(spark, sf))
    cells = F.arrays_zip(F.col("xpix").alias("x"), F.col("ypix").alias("y"))
    total = F.aggregate(cells, F.lit(0).cast("bigint"), lambda s, p: s + p["x"] * 64 + p["y"])
    return cleaned.select(
        "session", "roi_id", "invalid", "kept", F.size("xpix").alias("area"), total.alias("pixel_sum")
    )


@register(
    "fixed_roi_cleaning",
    CLEAN_SQL + """
    select session, roi_id, cast(count(*) as int) as area, cast(sum(x * 64 + y) as bigint) as pixel_sum
    from ok where inside and fc is not null and cut <> 1 group by session, roi_id""",
)
def fixed_roi_cleaning(spark, sf):
    raw = raw_rois(spark, sf).filter("not array_contains(xpix, 'bad')")
    cleaned = R.clean_fixed_rois(raw, raw_shapes(spark, sf))
    cells = F.arrays_zip(F.col("xpix").alias("x"), F.col("ypix").alias("y"))
    total = F.aggregate(cells, F.lit(0).cast("bigint"), lambda s, p: s + p["x"] * 64 + p["y"])
    return cleaned.select("session", "roi_id", F.size("xpix").alias("area"), total.alias("pixel_sum"))


@register("bounds_filter", sql("select * from clean", "clean"))
def bounds_filter(spark, sf):
    shaped = views.roi_pixels(spark, sf).withColumn("height", F.lit(SIDE)).withColumn("width", F.lit(SIDE))
    return shaped.filter(R.in_bounds()).drop("height", "width")


@register("rasterise_last_wins", sql("select * from truth", "truth"))
def rasterise_last_wins(spark, sf):
    return shared.target_labels(spark, sf)


@register("roi_mask_union", sql("select distinct session, y, x from clean", "clean"))
def roi_mask_union(spark, sf):
    clean, _ = R.clean_roi_pixels(views.roi_pixels(spark, sf), views.sessions(spark, sf))
    return R.roi_mask(clean)


ROI_SUMMARY = sql("""
    select s.session, s.height, s.width, coalesce(a.roi_count, 0) as roi_count,
           coalesce(m.positive_pixels, 0) as positive_pixels,
           round(coalesce(m.positive_pixels, 0) / 1024.0, 6) as positive_fraction,
           coalesce(a.med, 0.0) as median_roi_area_px, coalesce(a.lo, 0) as min_roi_area_px,
           coalesce(a.hi, 0) as max_roi_area_px, coalesce(a.bad, 0) as invalid_roi_entries
    from fx_sessions s
    left join (select session, count(case when area > 0 then 1 end) as roi_count,
                      quantile_cont(case when area > 0 then cast(area as double) end, 0.5) as med,
                      min(case when area > 0 then area end) as lo, max(case when area > 0 then area end) as hi,
                      cast(sum(bad) as bigint) as bad
               from (select session, roi_id,
                            count(case when x < 32 then 1 end) as area,
                            max(case when x < 32 then 0 else 1 end) as bad
                     from fx_roi_pixels group by 1, 2) group by 1) a on a.session = s.session
    left join (select session, count(*) as positive_pixels from truth group by 1) m on m.session = s.session
    """, "truth", "fx_sessions")


@register("roi_summary", ROI_SUMMARY)
def roi_summary(spark, sf):
    out = R.roi_summary(views.roi_pixels(spark, sf), views.sessions(spark, sf))
    return out.withColumn("positive_fraction", F.round("positive_fraction", 6))


@register("roi_summary_of_parts", ROI_SUMMARY)
def roi_summary_of_parts(spark, sf):
    """The same from records cut into small parts: their size must not show."""
    drawn = views.roi_pixels(spark, sf).withColumnRenamed("roi_id", "label")
    parts = C.pack_rois(drawn, rows_per_part=5)
    text = parts.withColumn("xpix", F.col("xpix").cast("array<string>")).withColumn("ypix", F.col("ypix").cast("array<string>"))
    shapes = views.sessions(spark, sf)
    out = R.summarise_records(R.clean_rois(text, shapes), shapes)
    return out.withColumn("positive_fraction", F.round("positive_fraction", 6))


@register(
    "roi_pack",
    sql("""
    select session, label as roi_id, label as ord, 0 as part,
           list(cast(x as bigint) order by y, x) as xpix, list(cast(y as bigint) order by y, x) as ypix
    from truth group by session, label""", "truth"),
)
def roi_pack(spark, sf):
    return C.pack_rois(shared.target_labels(spark, sf))


@register(
    "roi_explode",
    sql("""
    select session, label as roi_id, label as ord, 0 as part,
           cast(row_number() over (partition by session, label order by y, x) - 1 as int) as pos, x, y
    from truth""", "truth"),
)
def roi_explode(spark, sf):
    return C.explode_rois(C.pack_rois(shared.target_labels(spark, sf)))


# -------------------------------------------------------------------- components
ROOTED = "select session, y, x, cast(root // 100000 as int) as first_y, cast(root % 100000 as int) as first_x from comp"


def _rooted(df):
    return df.select(
        "session", "y", "x", key_row("root").alias("first_y"), key_column("root").alias("first_x")
    )


def _foreground(spark, sf):
    return views.pixels(spark, sf).filter(F.col("probability") >= 0.25).select("session", "y", "x")


@register("probability_threshold", sql("select session, y, x, probability from fx_pixels where probability >= 0.25", "fx_pixels"))
def probability_threshold(spark, sf):
    return views.pixels(spark, sf).filter(F.col("probability") >= 0.25).select(
        "session", "y", "x", "probability"
    )


@register("components_one_tile", sql(ROOTED, "comp"))
def components_one_tile(spark, sf):
    return _rooted(C.label_components(_foreground(spark, sf), max_side=SIDE))


@register("components_across_tiles", sql(ROOTED, "comp"))
def components_across_tiles(spark, sf):
    return _rooted(C.label_components(_foreground(spark, sf), tile=16))


@register("component_area_filter", sql("""
    select session, cast(root // 100000 as int) as first_y, cast(root % 100000 as int) as first_x, area
    from sizes where area between 3 and 12""", "sizes"))
def component_area_filter(spark, sf):
    sizes = C.component_sizes(C.label_components(_foreground(spark, sf), max_side=SIDE))
    return sizes.filter(C.within_area(3, 12)).select(
        "session", key_row("root").alias("first_y"), key_column("root").alias("first_x"), "area"
    )


@register("probability_to_labels", sql("select * from pred", "pred"))
def probability_to_labels(spark, sf):
    return shared.predicted_labels(spark, sf)


@register("probability_to_rois", sql("""
    select session, label as roi_id, label as ord, 0 as part,
           list(cast(x as bigint) order by y, x) as xpix, list(cast(y as bigint) order by y, x) as ypix
    from pred group by session, label""", "pred"))
def probability_to_rois(spark, sf):
    rois, _ = C.probability_to_rois(
        views.pixels(spark, sf), threshold=0.25, min_size=4, max_side=SIDE
    )
    return rois


@register("label_area_filter", sql("""
    select t.session, t.y, t.x, n.new_label as label from truth t join (
      select session, label, cast(row_number() over (partition by session order by label) as int) as new_label
      from (select session, label, count(*) as area from truth group by 1, 2) where area between 45 and 70) n
    on n.session = t.session and n.label = t.label""", "truth"))
def label_area_filter(spark, sf):
    return C.filter_labels(shared.target_labels(spark, sf), 45, 70)


@register("compact_relabel", sql("""
    select session, y, x, cast(dense_rank() over (partition by session order by label) as int) as label
    from truth where label % 3 <> 1""", "truth"))
def compact_relabel(spark, sf):
    return C.compact_labels(shared.target_labels(spark, sf).filter("label % 3 <> 1"))


# ------------------------------------------------------------------------ scores
COUNTS = """
    select coalesce(p.session, t.session) as session,
           count(case when p.y is not null and t.y is not null then 1 end) as tp,
           count(case when t.y is null then 1 end) as fp, count(case when p.y is null then 1 end) as fn
    from {pred} p full outer join {target} t on t.session = p.session and t.y = p.y and t.x = p.x
    group by 1"""
RATIOS = """
    round(2.0 * tp / (2.0 * tp + fp + fn + 1e-8), 6) as dice,
    round(5.0 * tp / (5.0 * tp + 4.0 * fn + fp + 1e-8), 6) as f2,
    round(cast(tp as double) / (tp + fp + fn + 1e-8), 6) as iou,
    round(cast(tp as double) / (tp + fp + 1e-8), 6) as precision,
    round(cast(tp as double) / (tp + fn + 1e-8), 6) as recall"""
NAMED = "tp as true_positive_pixels, fp as false_positive_pixels, fn as false_negative_pixels"
TMASK = "select session, y, x, cast(y // 8 as int) + 1 as label from fx_pixels where target = 1"


def _rounded(df):
    return df.select(*[
        F.round(c, 6).alias(c) if kind == "double" and c not in ("threshold",) else F.col(c)
        for c, kind in df.dtypes
    ])


@register("error_map", sql("""
    select coalesce(p.session, t.session) as session, coalesce(p.y, t.y) as y, coalesce(p.x, t.x) as x,
           case when p.y is null then 'FN' when t.y is null then 'FP' else 'TP' end as error
    from pred p full outer join tmask t on t.session = p.session and t.y = p.y and t.x = p.x
    """, "pred", tmask=TMASK))
def error_map(spark, sf):
    return S.error_map(shared.predicted_labels(spark, sf), shared.target_mask(spark, sf))


@register("confusion_counts", sql(f"select session, {NAMED} from ({COUNTS.format(pred='pred', target='tmask')})", "pred", tmask=TMASK))
def confusion_counts(spark, sf):
    return S.confusion(shared.predicted_labels(spark, sf), shared.target_mask(spark, sf))


EVAL = f"""
    select m.session, m.animal, m.split, {RATIOS}, {NAMED}, predicted_components, target_components
    from (select m.session, m.animal, m.split, coalesce(c.tp, 0) as tp, coalesce(c.fp, 0) as fp, coalesce(c.fn, 0) as fn,
                 coalesce(pc.n, 0) as predicted_components, coalesce(tc.n, 0) as target_components
          from mani m left join ({COUNTS.format(pred='pred', target='tmask')}) c on c.session = m.session
          left join (select session, count(distinct label) as n from pred group by 1) pc on pc.session = m.session
          left join (select session, count(distinct label) as n from tmask group by 1) tc on tc.session = m.session
          where m.included and m.split = 'test') m"""


def evaluated(spark, sf):
    from pixelloom.plans.evaluation import evaluate_split

    return evaluate_split(
        views.pixels(spark, sf), shared.target_mask_labels(spark, sf), shared.manifest(spark, sf),
        split="test", threshold=0.25, min_size=4, max_side=SIDE,
    )


@register("evaluate_split", sql(EVAL, "pred", "fx_sessions", mani=shared.MANIFEST_SQL, tmask=TMASK))
def evaluate_split(spark, sf):
    return _rounded(evaluated(spark, sf))


@register("score_summary", sql(f"""
    select count(*) as sessions,
           {', '.join(f'round(avg({m}), 6) as {m}_mean, round(stddev_pop({m}), 6) as {m}_std' for m in S.METRICS)}
    from ({EVAL.replace('round(', '(').replace(', 6)', ')')})""", "pred", "fx_sessions", mani=shared.MANIFEST_SQL, tmask=TMASK))
def score_summary(spark, sf):
    return _rounded(S.score_summary(evaluated(spark, sf)))


@register("component_counts", sql("""
    select coalesce(p.session, t.session) as session, coalesce(p.n, 0) as predicted_components, coalesce(t.n, 0) as target_components
    from (select session, count(distinct label) as n from pred group by 1) p
    full join (select session, count(distinct label) as n from truth group by 1) t on t.session = p.session""", "pred", "truth"))
def component_counts(spark, sf):
    return S.component_counts(shared.predicted_labels(spark, sf), shared.target_labels(spark, sf))


@register("scores_with_manifest", sql(f"""
    select c.session, {NAMED}, m.animal, m.split from ({COUNTS.format(pred='pred', target='tmask')}) c
    join mani m on m.session = c.session""", "pred", "fx_sessions", mani=shared.MANIFEST_SQL, tmask=TMASK))
def scores_with_manifest(spark, sf):
    counts = S.confusion(shared.predicted_labels(spark, sf), shared.target_mask(spark, sf))
    return S.attach_manifest(counts, shared.manifest(spark, sf))


# --------------------------------------------------------------- operating points
THRESHOLDS, SIZES = (0.2, 0.5, 0.7, 0.9), (1, 2, 4, 8, 16)
SWEEP = f"""
    select g.session, g.t as threshold, g.m as min_size, coalesce(c.comps, 0) as predicted_components,
           coalesce(c.tp, 0) as tp, coalesce(c.pred, 0) - coalesce(c.tp, 0) as fp,
           coalesce(h.n, 0) - coalesce(c.tp, 0) as fn
    from (select session, cast(t.t as double) as t, m.m from fx_sessions
          cross join (values {', '.join(f'({t})' for t in THRESHOLDS)}) t(t)
          cross join (values {', '.join(f'({m})' for m in SIZES)}) m(m)) g
    left join (select session, count(*) as n from tmask group by 1) h on h.session = g.session
    left join (select r.session, r.t, m.m, count(*) as comps, cast(sum(area) as bigint) as pred, cast(sum(hits) as bigint) as tp
               from (select l.session, l.t, l.root, count(*) as area, count(k.y) as hits from low l
                     left join tmask k on k.session = l.session and k.y = l.y and k.x = l.x group by 1, 2, 3) r
               join (values {', '.join(f'({m})' for m in SIZES)}) m(m) on r.area >= m.m group by 1, 2, 3) c
      on c.session = g.session and c.t = g.t and c.m = g.m"""
SWEEP_CTES = {
    "masks": f"""select session, cast(t.t as double) as t, y, x from fx_pixels
                 join (values {', '.join(f'({t})' for t in THRESHOLDS)}) t(t) on probability >= t.t""",
    "spread": """
        select session, t, y, x, y * 100000 + x as root from masks
        union
        select f.session, f.t, f.y, f.x, r.root from spread r
        cross join (values (0, 1), (0, -1), (1, 0), (-1, 0)) d(dy, dx)
        join masks f on f.session = r.session and f.t = r.t and f.y = r.y + d.dy and f.x = r.x + d.dx
        where r.root < f.y * 100000 + f.x""",
    "low": "select session, t, y, x, min(root) as root from spread group by 1, 2, 3, 4",
    "tmask": TMASK,
}


def swept(spark, sf):
    return S.sweep(
        views.pixels(spark, sf), shared.target_mask(spark, sf), views.sessions(spark, sf),
        THRESHOLDS, SIZES, max_side=SIDE,
    )


@register("operating_point_sweep", sql(
    f"select session, threshold, min_size, predicted_components, {NAMED}, {RATIOS} from ({SWEEP})",
    "fx_pixels", "fx_sessions", **SWEEP_CTES))
def operating_point_sweep(spark, sf):
    return _rounded(swept(spark, sf))


SWEEP_MEANS = f"""
    select threshold, min_size, count(*) as sessions,
           {', '.join(f'avg({m}) as {m}' for m in S.METRICS)}, avg(predicted_components) as predicted_components
    from (select *, {RATIOS.replace('round(', '(').replace(', 6)', ')')} from ({SWEEP})) group by 1, 2"""


@register("operating_point_means", sql(
    f"""select threshold, min_size, sessions, {', '.join(f'round({m}, 6) as {m}' for m in S.METRICS)},
        round(predicted_components, 6) as predicted_components from ({SWEEP_MEANS})""",
    "fx_pixels", "fx_sessions", **SWEEP_CTES))
def operating_point_means(spark, sf):
    return _rounded(S.sweep_summary(swept(spark, sf)))


@register("best_operating_point", sql(
    f"""select threshold, min_size, round(f2, 6) as f2 from ({SWEEP_MEANS})
        order by round(f2, 12) desc, threshold, min_size limit 1""",
    "fx_pixels", "fx_sessions", **SWEEP_CTES))
def best_operating_point(spark, sf):
    best = S.best_point(S.sweep_summary(swept(spark, sf)), "f2")
    return _rounded(best.select("threshold", "min_size", "f2"))


@register("rebuild_from_probability", sql("""
    select session, y, x, cast(dense_rank() over (partition by session order by root) as int) as label
    from (select c.session, c.y, c.x, c.root from low c join
          (select session, root from low group by 1, 2 having count(*) >= 2) k
          on k.session = c.session and k.root = c.root)""",
    "fx_pixels", **{
        **SWEEP_CTES, "masks": "select session, 0.5 as t, y, x from fx_pixels where probability >= 0.5"}))
def rebuild_from_probability(spark, sf):
    """New threshold and size on a kept probability table; no size ceiling applies."""
    from pixelloom.operators.curate import rebuild

    labels, _, _ = rebuild(views.pixels(spark, sf), 0.5, 2, max_side=SIDE)
    return labels
