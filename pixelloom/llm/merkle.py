"""A Merkle manifest of a table: one tree per group of rows, and one over the groups.

Each row becomes a leaf hash. Within a group the leaves are ordered and numbered, and every aligned
block of ``BLOCK`` neighbours keeps its levels as hex strings, all hashes of a level one after the
other. As hashes have a fixed width, the parents of a level are hashes of fixed-width substrings of
it, and what flanks a node in its run, left and right, are two substrings; so a proof is put together
without moving hashes about. The roots of the blocks are the leaves of the next round, in blocks of
their own, until each group has one root; the groups' roots are then treated in the same way.

A group may hold any part of the rows: rows are numbered by ranges of (group, order) with counts per
range added up, and no step sees more than one block of a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.session import StoredTable

FAN, DEPTH, WIDTH = 16, 2, 64
BLOCK = FAN**DEPTH
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATH = "array<struct<left: string, right: string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def written(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon, and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: Sequence[Column]) -> Column:
    return digest(*map(written, values))


def _numbered(nodes: DataFrame, order: Sequence[str]) -> tuple[DataFrame, StoredTable]:
    """``nodes(grp, ...)`` with ``pos``, from 0 along ``order`` in each group, and the group's count ``n``.

    Besides comes the stored table that they are read from.
    """
    ranges = nodes.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order)
    placed = StoredTable(ranges.withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33).alias("part")
    along = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = placed.df.groupBy("grp", part).agg(F.min("at").alias("first"), F.count("*").alias("held")).select(
        "grp", "part", "first", F.coalesce(F.sum("held").over(along), F.lit(0)).alias("before"),
        F.sum("held").over(Window.partitionBy("grp")).alias("n"),
    )
    found = placed.df.withColumn("part", part).join(runs, ["grp", "part"])
    return found.withColumn("pos", F.col("at") - F.col("first") + F.col("before")).drop("part", "at", "first", "before"), placed


def _parents(level: Column) -> Column:
    """The level above a level: one hash for each run of ``FAN`` hashes."""
    run = FAN * WIDTH
    places = F.sequence(F.lit(0), F.floor((F.length(level) - 1) / run).cast("int"))
    return F.concat_ws("", F.transform(places, lambda k: F.sha2(F.substring(level, k * run + 1, F.lit(run)), 256)))


def _blocks(nodes: DataFrame) -> DataFrame:
    """Rows ``(grp, block, n, items, level0 .. root)`` of ``nodes(grp, pos, n, hash, own)``."""
    items = F.array_sort(F.collect_list(F.struct("pos", "hash", "own")))
    block = F.floor(F.col("pos") / BLOCK).cast("bigint")
    out = nodes.groupBy("grp", block.alias("block"), "n").agg(items.alias("items"))
    out = out.withColumn("level0", F.concat_ws("", "items.hash"))
    for k in range(DEPTH):
        last = F.col(f"level{k}")
        out = out.withColumn(f"level{k + 1}", F.when(F.col("n") > FAN**k, _parents(last)).otherwise(last))
    return out.withColumnRenamed(f"level{DEPTH}", "root")


def _flanked(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """Each item of the blocks with its path: what flanks it at each level up to the top.

    ``above(grp, pos, path, top, over)`` has the paths of the blocks' roots.
    """
    upper = above.select("grp", F.col("pos").alias("block"), F.col("path").alias("further"), "top", "over")
    flat = blocks.join(upper, ["grp", "block"]).select("*", F.posexplode("items").alias("at", "item"))
    path = []
    for k in range(DEPTH):
        place, run = F.floor(F.col("at") / FAN**k).cast("int"), FAN * WIDTH
        row = F.substring(F.col(f"level{k}"), F.floor(place / FAN).cast("int") * run + 1, F.lit(run))
        left = F.substring(row, F.lit(1), place % FAN * WIDTH)
        right = F.substring(row, place % FAN * WIDTH + WIDTH + 1, F.lit(run))
        flanks = F.array(F.struct(left.alias("left"), right.alias("right"))).cast(PATH)
        path.append(F.when(F.col("n") > FAN**k, flanks).otherwise(F.array().cast(PATH)))
    return flat.select(
        "grp", F.col("item.pos").alias("pos"), F.col("item.hash").alias("hash"), F.col("item.own").alias("own"),
        F.concat(*path, "further").alias("path"), "top", "over",
    )


def _levels(nodes: DataFrame) -> list[StoredTable]:
    """Block tables from the leaves up, until every group is one block."""
    out = []
    while True:
        table = StoredTable(_blocks(nodes), most=F.max("n"))
        out.append(table)
        if table.metrics["most"] <= BLOCK:
            return out
        nodes = table.df.select(
            "grp", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).cast("bigint").alias("n"),
            F.col("root").alias("hash"), F.lit(None).cast("boolean").alias("own"),
        )


def _proved(levels: list[StoredTable], above: DataFrame) -> DataFrame:
    for table in reversed(levels):
        above = _flanked(table.df, above)
    return above


def manifest(rows: DataFrame, group: str, order: str) -> DataFrame:
    """The trees over ``rows(<group>, <order>, hash, own)``: per row its path and the roots above it.

    Out come ``grp``, ``hash``, ``own`` (any payload) as given, ``path`` (what flanks the row's node
    left and right at each level, from the row to the top), ``subroot`` of its group and ``root`` of
    all. Leaves ascend by ``order``, nulls first, and rows that tie by hash; groups by their bytes,
    null first. An empty table gives no rows.
    """
    # a letter before each name keeps the order and sets null apart from the empty name
    named = F.coalesce(F.concat(F.lit("g"), F.col(group).cast("string")), F.lit(""))
    nodes, placed = _numbered(rows.select(named.alias("grp"), F.col(order).alias("place"), "hash", "own"), ["place", "hash"])
    trees = _levels(nodes.select("grp", "pos", "n", "hash", "own"))
    placed.drop()
    none = F.lit(None).cast("boolean").alias("own")
    tops = trees[-1].df.select(F.lit("").alias("grp"), F.col("grp").alias("place"), F.col("root").alias("hash"))
    nodes, placed = _numbered(tops, ["place"])
    over = _levels(nodes.select("grp", "pos", "n", F.col("place").alias("own"), "hash"))
    placed.drop()
    start = over[-1].df.select(
        "grp", F.lit(0).cast("bigint").alias("pos"), F.array().cast(PATH).alias("path"), F.col("root").alias("top"), F.lit("").alias("over")
    )
    # an intermediate level carries no payload; the lowest one carries the group's name
    groups = _proved(over, start)
    above = groups.select(
        F.col("own").alias("grp"), F.lit(0).cast("bigint").alias("pos"), "path", F.col("hash").alias("top"), F.col("top").alias("over")
    )
    return _proved(trees, above).select("grp", "hash", "own", "path", F.col("top").alias("subroot"), F.col("over").alias("root"))


def proof(path: Column) -> Column:
    """All hashes of a path in one string, level by level, left to right."""
    return F.concat_ws("", F.transform(path, lambda step: F.concat(step["left"], step["right"])))


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, start, lambda below, step: digest(step["left"], below, step["right"]))


def document_manifest(docs: DataFrame) -> DataFrame:
    """Leaf, roots and proof of each row of ``docs``, and whether a tampered copy of it is found out.

    Where 5 divides the CRC-32 of the id, the copy has A-Z of its text lower-cased; elsewhere, and for
    a null id, it is the row itself. Nulls in any column are written ``-``; rows that repeat are leaves
    of their own, side by side; other columns take no part; an empty table gives no rows.
    """
    lowered = F.translate("text", UPPER, LOWER)
    touched = (F.crc32(F.col("doc_id").cast("string")) % 5 == 0) & (lowered != F.col("text"))
    copy = F.when(touched, leaf([*map(F.col, FIELDS[:-1]), lowered]))
    leaves = StoredTable(docs.select(
        "source", "doc_id", leaf(list(map(F.col, FIELDS))).alias("hash"), F.struct("doc_id", copy.alias("copy")).alias("own")
    ))
    found = manifest(leaves.df, "source", "doc_id")
    leaves.drop()
    refolded = folded(F.coalesce("own.copy", "hash"), F.col("path"))
    return found.select(
        F.col("own.doc_id").alias("doc_id"), F.col("hash").alias("leaf"), "subroot", "root",
        F.sha2(proof(F.col("path")), 256).alias("proof_sha256"), refolded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


#: The table of CRC-32 steps is made bit by bit, nodes are grown level by level.
CHECK = """
with recursive
t0 as (select cast(range as bigint) as i, cast(range as bigint) as c from range(256)),
""" + "\n".join(f"t{k + 1} as (select i, xor(c >> 1, (c & 1) * 3988292384) as c from t{k})," for k in range(8)) + """
steps as materialized (select list(c order by i) as t from t8),
parts as materialized (
    select *, case when source is null then '-' else concat(octet_length(encode(source)), ':', source) end as source_part,
           case when doc_id is null then '-' else concat(length(cast(doc_id as varchar)), ':', doc_id) end as id_part,
           case when lang is null then '-' else concat(octet_length(encode(lang)), ':', lang) end as lang_part,
           case when n_chars is null then '-' else concat(length(cast(n_chars as varchar)), ':', n_chars) end as chars_part,
           case when doc_id is null then 1 else xor(list_reduce(
               list_prepend(4294967295::bigint, list_transform(string_split(cast(doc_id as varchar), ''), lambda x: cast(ascii(x) as bigint))),
               lambda a, ch: xor(a >> 8, t[(xor(a, ch) & 255) + 1])), 4294967295) end as crc
    from documents, steps),
pairs as (select *, case when crc % 5 = 0 then translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else text end as copy from parts),
leaves as materialized (
    select doc_id, source, sha256(concat(id_part, source_part, lang_part, chars_part,
                    case when text is null then '-' else concat(octet_length(encode(text)), ':', text) end)) as leaf,
           sha256(concat(id_part, source_part, lang_part, chars_part,
                    case when copy is null then '-' else concat(octet_length(encode(copy)), ':', copy) end)) as copy_leaf
    from pairs),
nums as materialized (
    select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by source) as n from leaves),
tree(source, level, pos, n, h) as (
    select source, 0, pos, n, leaf from nums
    union all
    select source, level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(h, '' order by pos))
    from tree where n > 1 group by source, level, pos // 16, n),
sub as materialized (select source, h, row_number() over (order by source nulls first) - 1 as pos, count(*) over () as n from tree where n = 1),
high(level, pos, n, h) as (
    select 0, pos, n, h from sub
    union all
    select level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(h, '' order by pos)) from high where n > 1 group by level, pos // 16, n),
low_steps as materialized (
    select a.source, a.level, a.pos, coalesce(string_agg(b.h, '' order by b.pos) filter (b.pos < a.pos), '') as l,
           coalesce(string_agg(b.h, '' order by b.pos) filter (b.pos > a.pos), '') as r
    from tree a join tree b on a.source is not distinct from b.source and a.level = b.level and a.pos // 16 = b.pos // 16
    where a.n > 1 group by a.source, a.level, a.pos),
high_steps as materialized (
    select a.level, a.pos, coalesce(string_agg(b.h, '' order by b.pos) filter (b.pos < a.pos), '') as l,
           coalesce(string_agg(b.h, '' order by b.pos) filter (b.pos > a.pos), '') as r
    from high a join high b on a.level = b.level and a.pos // 16 = b.pos // 16 where a.n > 1 group by a.level, a.pos),
above as materialized (
    select s.source, s.h as subroot, coalesce(list({'l': g.l, 'h': '', 'r': g.r} order by g.level) filter (g.level is not null), []) as further
    from sub s left join high_steps g on g.pos = s.pos // (16::bigint ** g.level)::bigint group by 1, 2),
paths as (
    select k.doc_id, k.source, k.pos, k.leaf, k.copy_leaf,
           coalesce(list({'l': g.l, 'h': '', 'r': g.r} order by g.level) filter (g.level is not null), []) as own
    from nums k left join low_steps g on g.source is not distinct from k.source and g.pos = k.pos // (16::bigint ** g.level)::bigint
    group by 1, 2, 3, 4, 5),
done as (
    select p.doc_id, p.leaf, a.subroot, (select h from high where n = 1) as root, list_concat(p.own, a.further) as steps,
           list_prepend({'l': '', 'h': p.copy_leaf, 'r': ''}, list_concat(p.own, a.further)) as todo
    from paths p join above a on a.source is not distinct from p.source)
select doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(steps, lambda s: s.l || s.r), ''), '')) as proof_sha256,
       list_reduce(todo, lambda a, s: {'l': '', 'h': sha256(s.l || a.h || s.r), 'r': ''}).h as folded_root,
       list_reduce(todo, lambda a, s: {'l': '', 'h': sha256(s.l || a.h || s.r), 'r': ''}).h = root as verified
from done
"""
