"""Mixing sources to target weights: repetition rates per source, copies per document.

Sizes are summed per source, targets give each source a repetition rate, and every document is
emitted floor(rate) times plus one Bernoulli copy whose probability is the fraction. The draw is
a keyed hash, so reruns and repeated tasks agree. Only per-source sums are shuffled, and they are
added up before the shuffle; the targets meet the documents in a join whose one side has a row
per source, so a source with a third of all documents stays spread over its input partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.llm.common import WORD, quoted, same, unit
from pixelloom.session import StoredTable

WEIGHTS, SHARE, CAP, SEED = (3, 1, 2), 1.5, 2.0, 11


def words(text: str | Column = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(
    sized: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP
) -> DataFrame:
    """``(source, source_size, target)`` from ``sized(source, size)``; a null source is a source.

    Sources by code point, null last, take the ``weights`` in turn and share ``share`` times all
    sizes. No target exceeds ``cap`` times its source's size; what is above goes to the others by
    weight, until none is above. So targets are ``min(cap, level * weight)``: with the sources by
    falling need of the cap, the level is the largest that any number of capped ones gives. The
    windows here see one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before, after = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1)
    capped = F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    return (
        sized.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("_w", weight)
        .withColumn("_cap", F.lit(float(cap)) * F.col("source_size"))
        .withColumn("_all", F.lit(float(share)) * F.sum("source_size").over(every))
        .withColumn("_level", (F.col("_all") - capped) / F.sum("_w").over(after))
        .withColumn("_level", F.max("_level").over(every))
        .select("source", "source_size", F.least("_cap", F.col("_level") * F.col("_w")).alias("target"))
    )


def with_copies(sized: DataFrame, targets: DataFrame, seed: int = SEED) -> DataFrame:
    """``sized(doc_id, source, size, ...)`` with its source's figures and its number of ``copies``."""
    joined = sized.alias("d").join(targets.alias("t"), same(F.col("d.source"), F.col("t.source")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    drawn = unit(F.col("doc_id"), F.col("d.source"), F.col("size"), seed=seed) < F.col("_rate") - F.floor("_rate")
    return joined.withColumn("_rate", rate).select(
        *[F.col(f"d.{c}") for c in sized.columns], "source_size", "target",
        (F.floor("_rate") + drawn.cast("bigint")).alias("copies"),
    )


def mixture(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """What the mix takes of each row of ``docs(doc_id, source, text)``, in words.

    A null text has size 0; null and repeated ids are rows like any other, and rows equal in id,
    source and size draw alike. Other columns are ignored; an empty table gives no rows. Sizes
    are written once, so the texts are read once.
    """
    sized = StoredTable(docs.select("doc_id", "source", words().alias("size"))).df
    mixed = with_copies(sized, source_targets(sized), seed)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with all columns as they were.

    A null or empty text has size 0 and so a rate of its source's like any other; a row whose source
    has no words is not taken; rows that repeat are drawn alike; an empty table gives no rows.
    """
    kept = F.struct(*[quoted(c) for c in docs.columns]).alias("_row")
    sized = docs.select("doc_id", "source", words().alias("size"), kept)
    mixed = with_copies(sized, source_targets(sized.select("source", "size")), seed)
    repeated = mixed.filter("copies > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return repeated.select("_row.*")


CHECK = f"""
with sized as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as size
               from documents),
s as (select source, cast(sum(size) as bigint) as source_size from sized group by source),
weighted as (select *, [3.0, 1.0, 2.0][cast((row_number() over (order by source nulls last) - 1) % 3 + 1 as int)]::double as w,
                    2.0::double * source_size as cap, 1.5::double * sum(source_size) over () as whole from s),
levels as (select *, (whole - coalesce(sum(cap) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0))
                     / sum(w) over (order by cap / w, source nulls last rows between current row and unbounded following) as level
           from weighted),
t as (select source, source_size, least(cap, max(level) over () * w) as target from levels),
rated as (select d.*, t.source_size, t.target, case when t.source_size > 0 then t.target / t.source_size else 0.0::double end as rate
          from sized d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
       cast(size * (floor(rate) + case when
         ('0x' || substr(md5(concat_ws('|', '{SEED}', coalesce(cast(doc_id as varchar), ''), coalesce(source, ''), cast(size as varchar))), 1, 13))::bigint
         / 4503599627370496.0::double < rate - floor(rate) then 1 else 0 end) as bigint) as taken
from rated
"""
