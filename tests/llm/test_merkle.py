"""Merkle manifests against trees built node by node."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from pixelloom.llm import merkle


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(leaves):
    """The root, and for each leaf its flanks from the bottom up."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for k, p in enumerate(at):
            run = level[p // 16 * 16 : p // 16 * 16 + 16]
            paths[k].append(("".join(run[: p % 16]), "".join(run[p % 16 + 1 :])))
        at, level = [p // 16 for p in at], [h("".join(level[k : k + 16])) for k in range(0, len(level), 16)]
    return level[0], paths


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], row["text"])))


def lowered(text):
    return text if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def expected(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for name in names:
        groups[name].sort(key=lambda k: k[:3])
        built[name] = tree([k[2] for k in groups[name]])
    root, above = tree([built[name][0] for name in names])
    out = []
    for name, further in zip(names, above):
        subroot, paths = built[name]
        for (_, _, own, r), path in zip(groups[name], paths):
            path = path + further
            changed = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
            now = leaf(r | {"text": lowered(r["text"])}) if changed else own
            for a, b in path:
                now = h(a + now + b)
            out.append((r["doc_id"], own, subroot, root, h("".join(a + b for a, b in path)), now, now == root))
    return out


def check(spark, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, own string, hash string, grp int"
    df = spark.createDataFrame([(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], "x", "y", 1) for r in rows], schema).repartition(5)
    got = merkle.document_manifest(df)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = [tuple(r) for r in got.collect()]
    assert sorted(got, key=repr) == sorted(expected(rows), key=repr)
    return got


def row(k, source="s", text="Some Text", **more):
    return {"doc_id": k, "source": source, "lang": "en", "n_chars": 9, "text": text} | more


def test_groups_of_many_sizes(spark):
    rows = [row(k, "big", f"Text {k}") for k in range(4500)]
    for source, n in (("one", 1), ("two", 2), ("sixteen", 16), ("seventeen", 17), ("block", 256), ("more", 257), (None, 40), ("", 3), ("é", 2), ("z", 1), ("𝄞", 1)):
        rows += [row(10_000 + 7 * k, source, f"TEXT {k}") for k in range(n)]
    rows += [row(k, f"source {k}") for k in range(300)]
    got = check(spark, rows)
    assert any(not r[6] for r in got) and any(r[6] for r in got)


def test_nulls_and_repeats(spark):
    rows = [row(None), row(None, None), row(3, text=None), row(3, text=None), row(3, text=""), row(5, lang=None, n_chars=None), row(5, "É", "É a B" * 50_000)]
    check(spark, rows + rows[:3])


def test_lone_row_and_no_rows(spark):
    (got,) = check(spark, [row(1)])
    assert got[1] == got[2] == got[3] and got[4] == h("")
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert merkle.document_manifest(empty).count() == 0


@pytest.mark.parametrize("n", [65_536, 70_001])
def test_rounds_of_blocks(spark, n):
    rows = spark.range(n).select(F.lit("all").alias("name"), F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("hash"), F.lit(None).cast("string").alias("own"))
    found = merkle.manifest(rows, "name", "k")
    root, paths = tree([h(str(k)) for k in range(n)])
    tops = found.agg(F.min("subroot"), F.max("root"), F.count("*"), F.countDistinct("hash")).first()
    assert tuple(tops) == (root, root, n, n)
    wanted = {h(str(k)): paths[k] for k in (0, 255, 256, 4096, 65_535, n - 1)}
    for r in found.filter(F.col("hash").isin(list(wanted))).collect():
        assert [tuple(s) for s in r.path] == wanted[r.hash]
