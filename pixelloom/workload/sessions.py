"""Registered queries: manifest, file pairing, splits, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelloom.functions import scalars as K
from pixelloom.operators import manifest as M
from pixelloom.workload import shared, views
from pixelloom.workload.registry import register
from pixelloom.workload.views import sql

# -------------------------------------------------------------- files of a session
FILES_SQL = """
    select distinct session, name from (
      select session, case
        when n = 1 and k % 6 <> 0 and k % 13 <> 0 then 'ref_mat_ch2.npy'
        when n = 2 and k % 13 <> 0 then concat('rec', o % 9, '_ref_mat_ch2.npy')
        when n = 3 and k % 7 <> 0 then concat(session, '_x', p % 5, '_ROI_dict.npy')
        when n = 4 and k % 7 <> 0 then concat('rec', p % 9, '_ROI_dict.npy')
        when n = 5 and k % 11 = 0 then 'mean_1100_map.npy'
        when n = 6 then concat('aux', p % 3, '.npy') end as name
      from (select concat('A', l_suppkey % 4, '-s', lpad(cast(l_suppkey as varchar(10)), 4, '0')) as session,
                   l_suppkey as k, l_linenumber as n, l_orderkey as o, l_partkey as p from lineitem))
    where name is not null"""
SESSIONS_SQL = "select *, cast(substr(session, 5, 10) as int) % 9 <> 0 as has_processed from fx_sessions"
IMAGES_SQL = """
    select session, name as image_name from (
      select *, row_number() over (partition by session
               order by case when name = 'ref_mat_ch2.npy' then 0 else 1 end, name) as rn
      from files where name like '%ref\\_mat\\_ch2.npy' escape '\\') where rn = 1"""
PAIRS_SQL = """
    select session, image_name, roi_name from (
      select i.session, i.image_name, f.name as roi_name, row_number() over (partition by i.session
        order by case when starts_with(f.name, case when i.image_name = 'ref_mat_ch2.npy' then i.session
                      else replace(i.image_name, '_ref_mat_ch2.npy', '') end) then 0 else 1 end, f.name) as rn
      from images i join files f on f.session = i.session and f.name like '%\\_ROI\\_dict.npy' escape '\\')
    where rn = 1"""
REASONS_SQL = """
    select s.session, s.has_processed,
           case when not s.has_processed then 'no processed_data'
                when not coalesce(f.ref, false) then 'no channel-2 reference'
                when not coalesce(f.roi, false) then 'no ROI dict'
                when coalesce(f.old, false) then 'contains 1100 reference' else '' end as exclusion_reason
    from se s left join (
      select session, bool_or(name like '%ref\\_mat\\_ch2.npy' escape '\\') as ref,
             bool_or(name like '%\\_ROI\\_dict.npy' escape '\\') as roi,
             bool_or(name like '%1100%.npy') as old from files group by 1) f on f.session = s.session"""


def files(spark, sf):
    k, n = F.col("l_suppkey"), F.col("l_linenumber")
    o, p = F.col("l_orderkey"), F.col("l_partkey")
    session = views._session("l_suppkey")

    def text(c):
        return c.cast("string")

    name = (
        F.when((n == 1) & (k % 6 != 0) & (k % 13 != 0), "ref_mat_ch2.npy")
        .when((n == 2) & (k % 13 != 0), F.concat(F.lit("rec"), text(o % 9), F.lit("_ref_mat_ch2.npy")))
        .when((n == 3) & (k % 7 != 0), F.concat(session, F.lit("_x"), text(p % 5), F.lit("_ROI_dict.npy")))
        .when((n == 4) & (k % 7 != 0), F.concat(F.lit("rec"), text(p % 9), F.lit("_ROI_dict.npy")))
        .when((n == 5) & (k % 11 == 0), "mean_1100_map.npy")
        .when(n == 6, F.concat(F.lit("aux"), text(p % 3), F.lit(".npy")))
    )
    rows = views.table(spark, sf, "lineitem").select(session.alias("session"), name.alias("name"))
    return rows.filter("name is not null").distinct()


def listed_sessions(spark, sf):
    key = F.substring("session", 5, 10).cast("int")
    return views.sessions(spark, sf).select(
        "session", F.concat(F.lit("/data/"), "session", F.lit("/processed_data")).alias("processed_path"),
        (key % 9 != 0).alias("has_processed"),
    )


@register("reference_discovery", sql("select * from images", files=FILES_SQL, images=IMAGES_SQL))
def reference_discovery(spark, sf):
    return M.reference_images(files(spark, sf))


@register("image_roi_pairing", sql("select * from pairs", files=FILES_SQL, images=IMAGES_SQL, pairs=PAIRS_SQL))
def image_roi_pairing(spark, sf):
    return M.pair_files(files(spark, sf))


@register("exclusion_reason", sql(
    "select *, exclusion_reason = '' as included from reasons", "fx_sessions",
    files=FILES_SQL, se=SESSIONS_SQL, reasons=REASONS_SQL))
def exclusion_reason(spark, sf):
    return M.exclusion_reasons(listed_sessions(spark, sf).drop("processed_path"), files(spark, sf))


@register("build_manifest", sql("""
    select r.session, split_part(r.session, '-', 1) as animal,
           concat('/data/', r.session, '/processed_data') as processed_path,
           case when ok then concat('/data/', r.session, '/processed_data/', p.image_name) else '' end as image_path,
           case when ok then concat('/data/', r.session, '/processed_data/', p.roi_name) else '' end as roi_path,
           case when ok then 32 end as height, case when ok then 32 end as width,
           case when ok then coalesce(a.n, 0) else 0 end as roi_count,
           case when ok then coalesce(m.px, 0) else 0 end as positive_pixels,
           round(case when ok then coalesce(m.px, 0) else 0 end / 1024.0, 6) as positive_fraction,
           case when ok then coalesce(a.med, 0.0) else 0.0 end as median_roi_area_px,
           case when ok then coalesce(a.lo, 0) else 0 end as min_roi_area_px,
           case when ok then coalesce(a.hi, 0) else 0 end as max_roi_area_px,
           case when ok then coalesce(a.bad, 0) else 0 end as invalid_roi_entries,
           ok as included, r.exclusion_reason, '' as split
    from (select *, exclusion_reason = '' as ok from reasons) r
    left join pairs p on p.session = r.session
    left join (select session, count(*) as n, quantile_cont(cast(area as double), 0.5) as med,
                      min(area) as lo, max(area) as hi, cast(sum(bad) as bigint) as bad
               from (select session, roi_id, count(case when x < 32 then 1 end) as area,
                            max(case when x < 32 then 0 else 1 end) as bad
                     from fx_roi_pixels group by 1, 2) where area > 0 group by 1) a on a.session = r.session
    left join (select session, count(*) as px from (select distinct session, y, x from clean) group by 1) m
           on m.session = r.session""",
    "fx_sessions", "clean", files=FILES_SQL, images=IMAGES_SQL, pairs=PAIRS_SQL, se=SESSIONS_SQL,
    reasons=REASONS_SQL))
def build_manifest(spark, sf):
    from pixelloom.operators.rois import roi_summary

    summaries = roi_summary(views.roi_pixels(spark, sf), views.sessions(spark, sf))
    made = M.build_manifest(
        listed_sessions(spark, sf), files(spark, sf), views.sessions(spark, sf), summaries
    )
    return made.withColumn("positive_fraction", F.round("positive_fraction", 6))


@register("animal_key", "select concat('A', s_suppkey % 4, '-s', lpad(cast(s_suppkey as varchar(10)), 4, '0')) as session, concat('A', s_suppkey % 4) as animal from supplier")
def animal_key(spark, sf):
    return views.sessions(spark, sf).select("session", K.animal_of("session").alias("animal"))


@register("default_output_name", "select page_id, concat(split_part(concat(replace(url, '/', '-'), '_ref_mat_ch2.npy'), '_ref_mat', 1), '_ROI_dict.npy') as out_name from pages")
def default_output_name(spark, sf):
    name = F.concat(F.replace("url", F.lit("/"), F.lit("-")), F.lit("_ref_mat_ch2.npy"))
    return views.table(spark, sf, "pages").select("page_id", K.default_roi_name(name).alias("out_name"))


# ---------------------------------------------------------------- text to typed rows
@register("manifest_coercion", """
    select concat('s', o_orderkey) as session,
           cast(trunc(o_totalprice) as int) as height,
           case when o_orderkey % 3 = 0 then 0 else cast(o_custkey as int) end as width,
           case when o_orderkey % 4 = 0 then 0.0 else o_totalprice end as positive_fraction,
           o_orderkey % 5 in (0, 1, 2) as included,
           case when o_orderstatus = 'F' then '' else o_orderstatus end as split
    from orders""")
def manifest_coercion(spark, sf):
    key = F.col("o_orderkey")
    included = F.element_at(
        F.array(*[F.lit(w) for w in ("TRUE", "1", "Yes", "no", "")]), (key % 5 + 1).cast("int")
    )
    text = views.table(spark, sf, "orders").select(
        F.concat(F.lit("s"), key.cast("string")).alias("session"),
        F.col("o_totalprice").cast("string").alias("height"),
        F.when(key % 3 == 0, "").otherwise(F.col("o_custkey").cast("string")).alias("width"),
        F.when(key % 4 == 0, F.lit(None)).otherwise(F.col("o_totalprice").cast("string")).alias("positive_fraction"),
        included.alias("included"),
        F.when(F.col("o_orderstatus") == "F", F.lit(None)).otherwise(F.col("o_orderstatus")).alias("split"),
    )
    return M.coerce_manifest(text)


@register("select_rows", sql("select session, split from mani where included and split = 'val'", "fx_sessions", mani=shared.MANIFEST_SQL))
def select_rows(spark, sf):
    return M.select_rows(shared.manifest(spark, sf), True, "val").select("session", "split")


# ------------------------------------------------------------------------- splits
SPLIT_SQL = """
    select session, animal, included,
           case when not included then '' when r <= nt then 'test' when r <= nt + nv then 'val' else 'train' end as split
    from (select *, case when n - nt <= 1 then 0 else greatest(1, cast(round_even((n - nt) * cast(0.15 as double), 0) as int)) end as nv
          from (select *, case when n <= 1 then 0 else greatest(1, cast(round_even(n * cast(0.15 as double), 0) as int)) end as nt
                from (select session, animal, included,
                             row_number() over (partition by animal, included order by md5(concat('7|', session)), session) as r,
                             count(*) over (partition by animal, included) as n
                      from fx_sessions)))"""


@register("session_splits", sql(SPLIT_SQL, "fx_sessions"))
def session_splits(spark, sf):
    rows = views.sessions(spark, sf).select("session", "animal", "included")
    return M.assign_splits(rows)


@register("split_count", """
    select cast(s_suppkey as int) as n,
           case when s_suppkey <= 1 then 0 else greatest(1, cast(round_even(s_suppkey * cast(0.15 as double), 0) as int)) end as held_out
    from supplier""")
def split_count(spark, sf):
    n = F.col("s_suppkey").cast("int")
    return views.table(spark, sf, "supplier").select(
        n.alias("n"), M.split_count(n, 0.15).alias("held_out")
    )


@register("preview_sample", sql("select session from fx_sessions order by md5(concat('7|', session)), session limit 6", "fx_sessions"))
def preview_sample(spark, sf):
    return M.preview_sample(views.sessions(spark, sf), 6).select("session")


@register("session_order", sql("select session from fx_sessions order by session", "fx_sessions"))
def session_order(spark, sf):
    return views.sessions(spark, sf).select("session").orderBy("session")


# ---------------------------------------------------------------------- summaries
def _mani(body):
    return sql(body, "fx_sessions", mani=shared.MANIFEST_SQL)


@register("manifest_totals", _mani("""
    select count(*) as sessions, count(case when included then 1 end) as included_sessions,
           count(distinct case when included then animal end) as animals,
           cast(coalesce(sum(case when included then roi_count end), 0) as bigint) as rois from mani"""))
def manifest_totals(spark, sf):
    return M.manifest_totals(shared.manifest(spark, sf))


@register("manifest_animals", _mani("select distinct animal from mani where included"))
def manifest_animals(spark, sf):
    return M.animals(shared.manifest(spark, sf))


@register("split_counts", _mani("select split, count(*) as sessions from mani where included group by 1"))
def split_counts(spark, sf):
    return M.split_counts(shared.manifest(spark, sf))


@register("inspect_splits", _mani("select coalesce(nullif(split, ''), 'unsplit') as split, count(*) as sessions from mani where included group by 1"))
def inspect_splits(spark, sf):
    return M.split_counts(shared.manifest(spark, sf), blank="unsplit")


@register("inspect_exclusions", _mani("""
    select coalesce(nullif(exclusion_reason, ''), 'not included') as reason, count(*) as sessions
    from mani where not included group by 1"""))
def inspect_exclusions(spark, sf):
    return M.exclusion_counts(shared.manifest(spark, sf))


@register("census", _mani("""
    select split, animal, count(*) as sessions, cast(sum(roi_count) as bigint) as rois,
           cast(sum(positive_pixels) as bigint) as foreground_pixels
    from mani where included group by rollup(split, animal)"""))
def census(spark, sf):
    return M.census(shared.manifest(spark, sf))
