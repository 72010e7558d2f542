"""Registered queries: curation edits on predicted labels.

Labels divisible by 5 are selected and labels divisible by 7 are fixed; the first
four sessions by animal (``A0``) have no selection.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pixelloom.operators import curate as U
from pixelloom.operators.history import ChangeLog, marks_of
from pixelloom.operators.rois import roi_words
from pixelloom.session import StoredTable, shared_dir
from pixelloom.workload import shared, views
from pixelloom.workload.registry import register
from pixelloom.workload.views import sql

SEL = "select distinct session, label from pred where label % 5 = 0 and session not like 'A0%'"
FIX = "select distinct session, label from pred where label % 7 = 0 or (label = 10 and session like 'A1%')"
IDS = "select distinct session, label from pred"
PICK = "select distinct session, label from pred where label % 10 = 0 and session not like 'A1%'"
SETS = {"sel": SEL, "fixd": FIX, "ids": IDS, "pick": PICK}


def q(body, **extra):
    return sql(body, "pred", **SETS, **extra)


def state(spark, sf):
    """Edits work on a stored label table: each one reads it several times."""
    labels = StoredTable(shared.predicted_labels(spark, sf)).df
    ids = U.label_ids(labels)
    selected = ids.filter("label % 5 = 0 and session not like 'A0%'")
    fixed = ids.filter("label % 7 = 0 or (label = 10 and session like 'A1%')")
    return U.Curation(labels, selected, fixed)


def picks(s):
    return U.label_ids(s.labels).filter("label % 10 = 0 and session not like 'A1%'")


@register("hit_test", sql("""
    select p.event_id, p.session, p.y, p.x, l.label
    from (select event_id, session, cast(round_even(yf, 0) as int) as y, cast(round_even(xf, 0) as int) as x from fx_points) p
    join pred l on l.session = p.session and l.y = p.y and l.x = p.x
    where p.y between 0 and 31 and p.x between 0 and 31""", "pred", "fx_points"))
def hit_test(spark, sf):
    return U.hit_test(views.points(spark, sf), shared.predicted_labels(spark, sf), views.sessions(spark, sf))


@register("select_all", q("select * from ids"))
def select_all(spark, sf):
    return U.select_all(state(spark, sf).labels)


@register("invert_selection", q("select * from ids except select * from sel"))
def invert_selection(spark, sf):
    s = state(spark, sf)
    return U.invert_selection(s.labels, s.selected)


@register("add_to_selection", q("select * from sel union select * from pick"))
def add_to_selection(spark, sf):
    s = state(spark, sf)
    return U.add_to_selection(s.selected, picks(s))


@register("toggle_selection", q("(select * from sel except select * from pick) union (select * from pick except select * from sel)"))
def toggle_selection(spark, sf):
    s = state(spark, sf)
    return U.toggle_selection(s.selected, picks(s))


@register("replace_selection", q("select * from pick union select * from sel where session not in (select session from pick)"))
def replace_selection(spark, sf):
    s = state(spark, sf)
    return U.replace_selection(s.selected, picks(s))


@register("fix_selected", q("select * from fixd union (select * from sel intersect select * from ids)"))
def fix_selected(spark, sf):
    s = state(spark, sf)
    return U.fix_selected(s.labels, s.selected, s.fixed)


@register("unfix_selected", q("select * from fixd except select * from sel"))
def unfix_selected(spark, sf):
    s = state(spark, sf)
    return U.unfix_selected(s.selected, s.fixed)


@register("toggle_fixed", q("""
    (select * from fixd except select * from sel where session in (select session from part where whole))
    union select * from sel where session in (select session from part where not whole)""",
    tsel="select * from sel where label > 0",
    part="select s.session, bool_and(f.label is not null) as whole from tsel s left join fixd f on f.session = s.session and f.label = s.label group by 1"))
def toggle_fixed(spark, sf):
    s = state(spark, sf)
    return U.toggle_fixed(s.labels, s.selected, s.fixed)


@register("fixed_set_repair", q("select session, label from (select session, label + 3 as label from fixd) intersect select * from ids"))
def fixed_set_repair(spark, sf):
    s = state(spark, sf)
    return U.keep_present(s.fixed.withColumn("label", F.col("label") + 3), s.labels)


NAMES = "select session, label, cast(row_number() over (partition by session order by label) as int) as new_label from left_ids"


@register("clear_unfixed", q("""
    select p.session, p.y, p.x, n.new_label as label from pred p
    join names2 n on n.session = p.session and n.label = p.label""",
    left_ids="select * from fixd", names2=NAMES))
def clear_unfixed(spark, sf):
    return U.clear_unfixed(state(spark, sf)).labels


DELETED = {
    "left_ids": "select i.* from ids i anti join sel s on s.session = i.session and s.label = i.label",
    "names2": """select session, label, case when session in (select session from sel)
                 then cast(row_number() over (partition by session order by label) as int) else label end as new_label
                 from left_ids""",
}


@register("delete_selected", q("""
    select p.session, p.y, p.x, n.new_label as label from pred p
    join names2 n on n.session = p.session and n.label = p.label""", **DELETED))
def delete_selected(spark, sf):
    return U.delete_selected(state(spark, sf)).labels


@register("remap_fixed_ids", q("""
    select f.session, n.new_label as label from fixd f
    join names2 n on n.session = f.session and n.label = f.label""", **DELETED))
def remap_fixed_ids(spark, sf):
    return U.delete_selected(state(spark, sf)).fixed


MERGED = {
    "grp": """select s.session, min(s.label) as keep, bool_or(f.label is not null) as fx from sel s
              left join fixd f on f.session = s.session and f.label = s.label
              group by 1 having count(*) >= 2""",
    "merged": """select p.session, p.y, p.x, case when s.label is not null and g.keep is not null then g.keep else p.label end as label
                 from pred p left join sel s on s.session = p.session and s.label = p.label
                 left join grp g on g.session = p.session""",
    "mfix": "select * from fixd union select session, keep from grp where fx",
    "names2": """select session, label, case when session in (select session from grp)
                 then cast(row_number() over (partition by session order by label) as int) else label end as new_label
                 from (select distinct session, label from merged)""",
}


@register("merge_selected", q("""
    select p.session, p.y, p.x, n.new_label as label from merged p
    join names2 n on n.session = p.session and n.label = p.label""", **MERGED))
def merge_selected(spark, sf):
    return U.merge_selected(state(spark, sf)).labels


@register("merge_selected_fixed", q("""
    select f.session, n.new_label as label from mfix f
    join names2 n on n.session = f.session and n.label = f.label""", **MERGED))
def merge_selected_fixed(spark, sf):
    return U.merge_selected(state(spark, sf)).fixed


@register("undo", q("select session, y, x, label from pred"))
def undo(spark, sf):
    first = state(spark, sf)
    stacked = U.stack_versions([first, U.delete_selected(first)])
    return U.undo(stacked, 1).labels


@register("undo_from_log", q("""
    select 'label' as kind, p.session, cast(p.y as int) as y, cast(p.x as int) as x, n.new_label as label from merged p
    join names2 n on n.session = p.session and n.label = p.label
    union all select 'fixed', f.session, null, null, n.new_label from mfix f join names2 n on n.session = f.session and n.label = f.label
    union all select 'selected', session, null, null, label from sel where session not in (select session from grp)""", **MERGED))
def undo_from_log(spark, sf):
    """Labels, selection and marks of a log after two edits, a merge and a clearing, of which the second is undone."""
    log = ChangeLog.create(spark, f"{shared_dir(spark)}/curation-{uuid.uuid4().hex}", state(spark, sf))
    log.edit(U.merge_selected)
    log.edit(U.clear_unfixed)
    log.undo()
    now = log.state()
    none = F.lit(None).cast("int")
    return now.labels.select(F.lit("label").alias("kind"), "session", "y", "x", "label").unionByName(
        marks_of(now).select("kind", "session", none.alias("y"), none.alias("x"), "label")
    )


@register("clear_selection", q("select * from sel where session not like 'A1%'"))
def clear_selection(spark, sf):
    s = state(spark, sf)
    return U.clear_selection(s.selected, views.sessions(spark, sf).filter("session like 'A1%'").select("session"))


@register("clear_fixed", q("select * from fixd where session not like 'A2%'"))
def clear_fixed(spark, sf):
    s = state(spark, sf)
    return U.clear_fixed(s.fixed, views.sessions(spark, sf).filter("session like 'A2%'").select("session"))


@register("roi_listing", q("""
    select p.session, p.label, count(*) as pixels, case when max(f.label) is null then '' else 'yes' end as fixed
    from pred p left join fixd f on f.session = p.session and f.label = p.label group by 1, 2"""))
def roi_listing(spark, sf):
    s = state(spark, sf)
    return U.roi_listing(s.labels, s.fixed)


@register("status_counts", q("""
    select i.session, count(*) as rois, count(s.label) as selected, count(f.label) as fixed from ids i
    left join sel s on s.session = i.session and s.label = i.label
    left join fixd f on f.session = i.session and f.label = i.label group by 1"""))
def status_counts(spark, sf):
    return U.status_counts(state(spark, sf))


# fixed ROIs are the raw target ROIs of even id; candidates are the predicted components
COMBINED = {
    "fx_fixed": "select session, label as roi_id, y, x from truth where label % 6 = 2",
    "clash": "select distinct p.session, p.label from pred p join fx_fixed f on f.session = p.session and f.y = p.y and f.x = p.x",
    "free": "select p.session, p.label as roi_id, p.y, p.x from pred p anti join clash c on c.session = p.session and c.label = p.label",
    "allr": "select *, 0 as late from fx_fixed union all select *, 1 as late from free",
}


@register("combine_fixed_rois", sql("""
    select session, cast(dense_rank() over (partition by session order by late, roi_id) as int) as label,
           late = 0 as is_fixed, y, x from allr""", "pred", "truth", **COMBINED))
def combine_fixed_rois(spark, sf):
    fixed = shared.target_labels(spark, sf).filter("label % 6 = 2").withColumnRenamed("label", "roi_id")
    candidates = shared.predicted_labels(spark, sf).withColumnRenamed("label", "roi_id")
    rois, _ = U.combine_fixed(fixed, candidates)
    return rois


# overlapping candidates are the raw ROIs; the pass by rising id is spelled out one ROI at a time
GREEDY = {
    "fx_fixed": "select session, label as roi_id, y, x from pred where label % 40 = 2",
    "cand": "select distinct session, roi_id, y, x from clean",
    "clash": "select distinct c.session, c.roi_id from cand c join fx_fixed f on f.session = c.session and f.y = c.y and f.x = c.x",
    "free": "select c.* from cand c anti join clash k on k.session = c.session and k.roi_id = c.roi_id",
    "meets": """select a.session, a.roi_id, list(distinct b.roi_id) as others from free a
                join free b on b.session = a.session and b.y = a.y and b.x = a.x and b.roi_id < a.roi_id group by 1, 2""",
    "turns": """select f.session, f.roi_id, coalesce(m.others, []) as others, row_number() over (partition by f.session order by f.roi_id) as k
                from (select distinct session, roi_id from free) f left join meets m on m.session = f.session and m.roi_id = f.roi_id""",
    "pass": """select session, cast(0 as bigint) as k, cast([] as int[]) as kept from (select distinct session from turns)
               union all
               select p.session, t.k, case when list_has_any(p.kept, cast(t.others as int[])) then p.kept else list_append(p.kept, cast(t.roi_id as int)) end
               from pass p join turns t on t.session = p.session and t.k = p.k + 1""",
    "last": "select session, max_by(kept, k) as kept from pass group by 1",
    "won": "select f.* from free f join last l on l.session = f.session and list_contains(l.kept, cast(f.roi_id as int))",
    "allr": "select *, 0 as late from fx_fixed union all select *, 1 as late from won",
}


@register("combine_overlapping_rois", sql("""
    select session, cast(dense_rank() over (partition by session order by late, roi_id) as int) as label,
           late = 0 as is_fixed, y, x from allr""", "pred", "clean", **GREEDY))
def combine_overlapping_rois(spark, sf):
    """Fixed ROIs, then of overlapping candidates those that a pass by rising id keeps."""
    fixed = shared.predicted_labels(spark, sf).filter("label % 40 = 2").withColumnRenamed("label", "roi_id")
    candidates = roi_words(views.roi_pixels(spark, sf), views.sessions(spark, sf), ids=["roi_id"])
    rois, _ = U.combine_fixed(StoredTable(fixed).df, StoredTable(candidates).df, overlapping=True)
    return rois
