"""License scan, mixing and URL filter: check SQL on the smallest tables, corners on small ones."""

import pytest

from compare import compare, connect
from pixelloom.llm import licenses, mixing, queries, urls

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.CHECKS))
def test_check_sql(spark, name):
    compare(spark, connect(SF), SF, queries.QUERIES[name], queries.CHECKS[name])


def against_sql(spark, tmp_path, table, rows, schema, operator, sql):
    """The operator on ``rows`` and its check SQL on the same table."""
    spark.createDataFrame(rows, schema).coalesce(2).write.parquet(f"{tmp_path}/{table}.parquet")
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
    return compare(spark, con, str(tmp_path), lambda s, d: operator(s.read.parquet(f"{d}/{table}.parquet")), sql)


def test_license_corners(spark, tmp_path):
    mit = "Released under the MIT License. " * 2
    def notice(label, drop=0):
        words = licenses.NOTICES[label][0].split()
        return " ".join(w for k, w in enumerate(words) if not drop or k % drop)

    shuffled = " ".join(sorted(notice("bsd").split()))
    rows = [
        (1, mit), (1, mit), (1, "other text, same id"), (2, None), (None, "CC BY-NC 4.0"), (3, ""), (4, notice("mit").capitalize() + " and more"),
        (5, "word " * 500 + notice("mit").upper() + " word" * 500), (6, "license mit the under"), (7, "under the mİt license under the mit license"),
        (8, "Apache License,\nVersion 2.0 Apache license version 2"), (9, "K underé the mit license"), (10, "See: " + notice("gpl", 9)), (14, "This is the GNU General Public License"), (15, notice("mpl", 3)), (16, shuffled), (17, notice("apache-2") + " word" * 300 + " " + notice("cc-by-nc")),
        (11, "x " * 40_000 + "cc by nc"), (12, "general public " * 30), (13, "hereby granted any person a copy"),
    ]
    rows = [(*r, "k", [1]) for r in rows]
    schema = "doc_id long, text string, labels string, words array<int>"
    assert against_sql(spark, tmp_path, "documents", rows, schema, licenses.scan_licenses, licenses.check_sql()) == 20
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, schema)).collect()}
    assert (got[8].n_base, got[8].first_word, got[8].last_word, got[8].base_labels) == (2, 0, 5, "apache-2")
    assert (got[4].base_labels, got[4].labels) == ("", "mit") and got[5].labels == "mit"
    assert got[10].labels == "gpl" and got[13].labels == "" and got[13].score == 0.0
    # a few words of a license here and there are no notice
    assert (got[6].labels, got[6].score, got[14].labels, got[15].labels) == ("", 0.0, "", "")
    assert got[16].labels == "bsd" and got[16].score == 1.0 and got[17].labels == "apache-2,cc-by-nc"
    assert licenses.scan_licenses(spark.createDataFrame([], schema)).count() == 0


def test_mixing_corners(spark, tmp_path):
    rows = [(k, "w " * (k % 7), f"s{k % 3}", 1, 2.0) for k in range(60)]
    rows += [(100, None, "s0", 1, None), (None, "a b", None, 1, 2.0), (101, "a b c", None, 1, 2.0), (101, "a b c", None, 1, 2.0), (102, "", "empty", 1, 2.0)]
    rows += [(200 + k, "w\x0bw   w", "z", 1, 2.0) for k in range(200)]
    schema = "doc_id long, text string, source string, size int, target double"
    assert against_sql(spark, tmp_path, "documents", rows, schema, mixing.mixture, mixing.CHECK) == len(rows)
    df = spark.createDataFrame(rows, schema)
    figures = {(r.source_size, r.target) for r in mixing.mixture(df).collect()}
    total = sum(s for s, _ in figures)
    assert abs(sum(t for _, t in figures) - 1.5 * total) < 1e-6
    assert all(t <= 2 * s + 1e-9 for s, t in figures)
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    taken = sum(r.taken for r in mixing.mixture(df).collect())
    assert sum(len([w for w in (r.text or "").replace("\x0b", " ").split(" ") if w]) for r in mixed.collect()) == taken
    assert mixing.mixture(df.limit(0)).count() == 0 and mixing.mix(df.limit(0)).count() == 0


def test_targets_share_the_excess():
    """The level against resharing step by step."""
    import random

    for seed in range(50):
        rng = random.Random(seed)
        sizes = [rng.choice([0, 1, 5, 100, 3000]) for _ in range(rng.randrange(1, 8))]
        weights = [mixing.WEIGHTS[k % 3] for k in range(len(sizes))]
        left, done = 1.5 * sum(sizes), {}
        while True:
            open_ = [k for k in range(len(sizes)) if k not in done]
            share = {k: left * weights[k] / sum(weights[j] for j in open_) for k in open_} if open_ else {}
            above = [k for k in open_ if share[k] > 2 * sizes[k]]
            if not above:
                done |= share
                break
            for k in above:
                done[k] = 2.0 * sizes[k]
                left -= 2.0 * sizes[k]
        order = sorted(range(len(sizes)), key=lambda k: (2 * sizes[k] / weights[k], k))
        level = max((1.5 * sum(sizes) - sum(2 * sizes[j] for j in order[:n])) / sum(weights[j] for j in order[n:]) for n in range(len(order)))
        for k in done:
            assert done[k] == pytest.approx(min(2 * sizes[k], level * weights[k]))


def test_url_corners(spark, tmp_path):
    rows = [
        "http://Example.COM/en/x", "http://www.example.com/en/x?q=http://net/es/", "https://a.net/es/1#f", "https://net/fr/", "http://notnet/es/",
        "http://example.com", "http://example.com?x", "ftp://b.org/É", "no scheme", "", None, "://", "http://x.org/a\nb", "http://x.net/en/1",
    ]
    rows = [(k, u, None, "h") for k, u in enumerate(rows)]
    rows += [(None, "http://y.org/", None, "h"), (3, rows[3][1], None, "h")]
    rows += [(100 + k, f"http://good{k}.example.com/de/{k}", None, "h") for k in range(40)]
    rows += [(200 + k, f"http://bad{k}.example.net/es/{k}", None, "h") for k in range(40)]
    rows += [(300 + k, f"http://bad{k}.example.org/es/{k}", None, "h") for k in range(5)] * 2
    schema = "page_id long, url string, rule string, host string"
    assert against_sql(spark, tmp_path, "pages", rows, schema, urls.filter_urls, urls.check_sql()) == len(rows)
    df = spark.createDataFrame(rows, schema)
    got = {r.page_id: r for r in urls.filter_urls(df).collect()}
    assert (got[0].host, got[0].path, got[0].rule, got[0].verdict) == ("example.com", "/en/x", "example.com/en/", "block")
    assert (got[1].rule, got[1].verdict) == ("www.example.com/en/", "allow") and got[4].rule is None
    assert (got[5].path, got[5].rule) == ("", None) and (got[10].host, got[10].path) == ("", "")
    assert got[302].verdict == "block"
    assert urls.filter_urls(df.limit(0)).count() == 0
    # beyond the broadcast bound the salted join gives the same
    written = df.filter("url is not null").select("url").distinct().withColumn("_written", urls._written())
    ratios = urls.gram_ratios(written.withColumn("verdict", urls.F.lit("allow")), written.select(urls.F.explode(urls._grams()).alias("gram")).distinct())
    both = [sorted(map(tuple, urls.scored(written, ratios, n).collect())) for n in (10**6, 0)]
    assert both[0] == both[1] and len(both[0]) == 99
