"""Registered queries: each session labelled, rebuilt and predicted at its own operating point."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelloom.operators import curate as U
from pixelloom.operators.components import labels_at_points
from pixelloom.operators.parameters import resolve_operating_point
from pixelloom.operators.scores import score_sessions
from pixelloom.plans.prediction import predict_images
from pixelloom.session import StoredTable
from pixelloom.sources.files import decode_images, encode_images
from pixelloom.workload import views
from pixelloom.workload.regions import NORM8, SIG, VIEWS4, array_images, ramp_model
from pixelloom.workload.registry import register
from pixelloom.workload.views import sql


def points_of(spark, asked):
    """Operating points of ``asked(session, turn)``: a registered model, a request of its own, a model with an upper bound."""
    requests = asked.select(
        F.col("session").alias("request_id"), F.when(F.col("turn") == 2, "wide").otherwise("narrow").alias("model"),
        F.lit(None).cast("string").alias("checkpoint"),
        F.when(F.col("turn") == 1, 0.4).cast("double").alias("threshold"), F.when(F.col("turn") == 1, 2).cast("int").alias("min_size"),
        F.lit(None).cast("boolean").alias("tta"),
    )
    registry = spark.createDataFrame(
        [("narrow", "a.pt", 0.25, 4, None, False), ("wide", "b.pt", None, 3, None, True)],
        "model string, checkpoint string, threshold double, min_size int, max_size int, tta boolean",
    )
    checkpoints = spark.createDataFrame([("b.pt", 0.6, 9, 12)], "checkpoint string, threshold double, min_size int, max_size int")
    found = resolve_operating_point(requests, registry, checkpoints)
    return StoredTable(found.select(F.col("request_id").alias("session"), "threshold", "min_size", "max_size", "tta")).df


def session_points(spark, sf):
    turn = (F.substring("session", 5, 10).cast("int") % 3).alias("turn")
    return points_of(spark, views.pixel_sessions(spark, sf).select("session", turn))


def _pointed(table, key, most="max_size"):
    return {
        "fgp": f"""select p.session, p.y, p.x, o.min_size, o.max_size from {table} p join own o on o.session = p.session where p.probability >= o.threshold""",
        "floodp": f"""select session, y, x, y * 100000 + x as root from fgp
                     union
                     select f.session, f.y, f.x, r.root from floodp r cross join (values (0, 1), (0, -1), (1, 0), (-1, 0)) d(dy, dx)
                     join fgp f on f.session = r.session and f.y = r.y + d.dy and f.x = r.x + d.dx where r.root < f.y * 100000 + f.x""",
        "compp": "select session, y, x, min(root) as root from floodp group by 1, 2, 3",
        "namesp": f"""select c.session, c.root, count(*) as area, cast(row_number() over (partition by c.session order by c.root) as int) as label
                     from compp c join own o on o.session = c.session group by c.session, c.root
                     having count(*) >= max(o.min_size) and count(*) <= coalesce(max({most}), 1000000)""",
        "labelled": "select c.session, c.y, c.x, n.label from compp c join namesp n on n.session = c.session and n.root = c.root",
    }


OWN = """select distinct session, [0.25::double, 0.4::double, 0.6::double][turn + 1] as threshold, [4, 2, 3][turn + 1] as min_size,
         case turn when 2 then 12 end as max_size
         from (select session, cast(substr(session, 5, 10) as int) % 3 as turn from fx_pixels)"""


@register("labels_at_operating_points", sql("select * from labelled", "fx_pixels", own=OWN, **_pointed("fx_pixels", "session")))
def labels_at_operating_points(spark, sf):
    return labels_at_points(views.pixels(spark, sf), session_points(spark, sf), max_side=views.SIDE)


@register("labels_at_operating_points_tiled", sql("select * from labelled", "fx_pixels", own=OWN, **_pointed("fx_pixels", "session")))
def labels_at_operating_points_tiled(spark, sf):
    """The same on images that span several tiles."""
    return labels_at_points(views.pixels(spark, sf), session_points(spark, sf), tile=16)


@register("rebuild_at_operating_points", sql("select * from labelled", "fx_pixels", own=OWN, **_pointed("fx_pixels", "session", "null")))
def rebuild_at_operating_points(spark, sf):
    return U.rebuild(views.pixels(spark, sf), session_points(spark, sf), max_side=views.SIDE)[0]


@register("predictions_at_operating_points", sql("""
    select l.session, l.y, l.x, l.label, o.threshold from labelled l join own o on o.session = l.session""", "fx_images8", norm8=NORM8,
    own="""select vec_id as session, [0.25::double, 0.4::double, 0.6::double][vec_id % 3 + 1] as threshold, [4, 2, 3][vec_id % 3 + 1] as min_size,
           case vec_id % 3 when 2 then 12 end as max_size from embeddings""",
    scored=f"""select session, y, x, case when session % 3 = 2 then ({VIEWS4}) / 4 else {SIG.format(x="x", y="y")} end as probability from norm8""",
    **_pointed("scored", "session")))
def predictions_at_operating_points(spark, sf):
    """Images scored, with flip averaging where their model asks for it, and labelled, each at its own point."""
    asked = views.table(spark, sf, "embeddings").select(F.col("vec_id").alias("session"), (F.col("vec_id") % 3).alias("turn"))
    out = predict_images(array_images(spark, sf), ramp_model, points=points_of(spark, asked), max_side=8)
    return out.labels.join(out.points.select("session", "threshold"), "session")


ENCODED = {
    "norm8": NORM8,
    "m8": f"select session, y, x from norm8 where {SIG.format(x='x', y='y')} >= 0.5",
    "fl8": """select session, y, x, y * 100 + x as root from m8 union
              select f.session, f.y, f.x, r.root from fl8 r cross join (values (0, 1), (0, -1), (1, 0), (-1, 0)) d(dy, dx)
              join m8 f on f.session = r.session and f.y = r.y + d.dy and f.x = r.x + d.dx where r.root < f.y * 100 + f.x""",
    "cp8": "select session, y, x, min(root) as root from fl8 group by 1, 2, 3",
    "big8": "select session, root from cp8 group by 1, 2 having count(*) >= 3",
    "pred8": "select c.session, c.y, c.x, c.root from cp8 c join big8 b on b.session = c.session and b.root = c.root",
    "true8": "select vec_id as session, y, x from fx_images8 where value > cast(0.05 as double)",
    "cells8": """select coalesce(p.session, t.session) as session, p.root, p.y is not null as p, t.y is not null as t
                 from pred8 p full outer join true8 t on t.session = p.session and t.y = p.y and t.x = p.x""",
}


@register("scores_from_encoded_images", sql("""
    select concat('v', e.vec_id) as session, coalesce(c.tp, 0) as tp, coalesce(c.fp, 0) as fp, coalesce(c.fn, 0) as fn,
           coalesce(c.n, 0) as predicted_components, round(2 * coalesce(c.tp, 0) / (2 * coalesce(c.tp, 0) + coalesce(c.fp, 0) + coalesce(c.fn, 0) + cast(1e-8 as double)), 6) as dice
    from embeddings e left join (
        select session, count(*) filter (p and t) as tp, count(*) filter (p and not t) as fp, count(*) filter (t and not p) as fn, count(distinct root) as n
        from cells8 group by 1) c on c.session = e.vec_id""", "fx_images8", **ENCODED))
def scores_from_encoded_images(spark, sf):
    """From the bytes of array files to scores: decoding, scoring, labelling and comparison with curated labels."""
    images = array_images(spark, sf).withColumn("session", F.concat(F.lit("v"), F.col("session").cast("string")))
    files = encode_images(images.withColumn("path", F.col("session")))
    decoded, _ = decode_images(StoredTable(files).df)
    found = predict_images(StoredTable(decoded).df.select("session", "height", "width", "pixels"), ramp_model, threshold=0.5, min_size=3, max_side=8)
    target = views.images8(spark, sf).filter("value > 0.05").select(
        F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("session"), "y", "x", F.lit(1).alias("label")
    )
    rows = images.select("session", F.lit("v").alias("animal"), F.lit("test").alias("split"))
    scores = score_sessions(found.labels, target, rows)
    counts = [F.col(f"{n}_pixels").alias(c) for c, n in (("tp", "true_positive"), ("fp", "false_positive"), ("fn", "false_negative"))]
    return scores.select("session", *counts, "predicted_components", F.round("dice", 6).alias("dice"))
