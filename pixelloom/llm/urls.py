"""URL filters: rules by host and path, and character language models for what no rule decides.

Two variable-order Markov models are counted, one on the URLs that rules allow, one on those that
rules block. A character is predicted from its last ``ORDER`` characters; each order's estimate is
its counts mixed with the next shorter order's estimate, down to a uniform one, so unseen contexts
fall back by themselves. A URL's score is the difference of both log-likelihoods over its length.
Every fifth decided URL (by hash) is kept out of the counts; the threshold on the score is the one
that separates those best.

Distinct URLs are counted and scored once, so repeated ones cost nothing, and n-grams are added up
before they are shuffled. Log-ratios are worked out once per distinct n-gram. Positions meet them in
a broadcast join while the measured table has at most ``BROADCAST_ROWS`` rows, and in a salted join
beyond, as a few n-grams stand in nearly every URL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.operators.spread import salted_join
from pixelloom.session import StoredTable

#: verdict, host, path
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
ORDER, MIX = 3, 4.0
FOLDS = 5
STEPS = 50  # thresholds tried per unit of score
BROADCAST_ROWS = 500_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: str = "url") -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path(url: str = "url") -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def matched(rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits columns ``host`` and ``path``, and its verdict; null if none fits."""
    name = verdict = F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((F.col("host") == h) | F.endswith(F.col("host"), F.lit(f".{h}"))) & F.startswith(F.col("path"), F.lit(p))
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(said)).otherwise(verdict)
    return name, verdict


def _written() -> Column:
    """What a URL's characters are predicted on: all after ``://`` (all of it if there is none), with its ends marked."""
    body = F.coalesce(F.regexp_extract("url", r"(?s)^.*?://(.*)$", 1), F.lit(""))
    body = F.when(F.instr("url", "://") > 0, body).otherwise(F.coalesce("url", F.lit("")))
    return F.concat(F.lit("^" * ORDER), F.translate(body, UPPER, LOWER), F.lit("$"))


def _grams(length: int = ORDER + 1) -> Column:
    """The run of ``length`` characters that ends at each predicted character."""
    first, last = ORDER + 2 - length, F.char_length("_written") - length + 1
    return F.transform(F.sequence(F.lit(first), last.cast("int")), lambda i: F.substring(F.col("_written"), i, F.lit(length)))


def gram_ratios(decided: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(gram, ratio)`` for each of ``wanted(gram)``: the log of its last character's two probabilities.

    ``decided(_written, verdict)`` are the URLs that are counted.
    """
    said = [F.sum((F.col("verdict") == v).cast("bigint")).alias(n) for v, n in (("allow", "a"), ("block", "b"))]
    whole = decided.select("verdict", F.explode(_grams()).alias("gram")).groupBy("gram").agg(*said)
    # shorter runs are the ends of the longest ones, context totals their beginnings
    ends = whole.select("a", "b", F.explode(F.sequence(F.lit(1), F.lit(ORDER + 1))).alias("n"), "gram")
    counts = ends.groupBy(F.right("gram", F.col("n")).alias("end")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    context = F.left("end", F.char_length("end") - 1)
    totals = counts.groupBy(context.alias("context")).agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    each = wanted.select("gram", F.explode(F.sequence(F.lit(1), F.lit(ORDER + 1))).alias("n")).withColumn(
        "end", F.right("gram", F.col("n"))
    )
    known = each.withColumn("context", context).join(counts, "end", "left").join(totals, "context", "left")
    values = [
        F.max(F.when(F.col("n") == n, F.coalesce(F.col(c), F.lit(0)))).alias(f"{c}{n}")
        for n in range(1, ORDER + 2) for c in ("a", "b", "ta", "tb")
    ]
    def probability(c: str) -> Column:
        p = F.lit(1.0 / 256)
        for n in range(1, ORDER + 2):
            p = (F.col(f"{c}{n}") + F.lit(MIX) * p) / (F.col(f"t{c}{n}") + F.lit(MIX))
        return p

    return known.groupBy("gram").agg(*values).select("gram", (F.log(probability("a")) - F.log(probability("b"))).alias("ratio"))


def scored(urls: DataFrame, ratios: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``(url, score)``: the mean log-ratio over the characters of each of the distinct ``urls(url, _written)``."""
    stored = StoredTable(ratios, n=F.count("*"))
    places = urls.select("url", F.explode(_grams()).alias("gram"))
    if stored.metrics["n"] <= broadcast_rows:
        met = places.join(F.broadcast(stored.df), "gram")
    else:
        met = salted_join(places, stored.df, ["gram"], ["url"], "inner")
    return met.groupBy("url").agg(F.round(F.avg("ratio"), 6).alias("score"))


def threshold(judged: DataFrame) -> float:
    """The step of ``judged(score, verdict)`` with the best mean of both classes' shares told right.

    Ties go to the lowest step; 0 if a class is missing. Scores are counted by step first.
    """
    bins = judged.groupBy(F.floor(F.col("score") * STEPS).alias("bin")).agg(
        *[F.sum((F.col("verdict") == v).cast("bigint")).alias(n) for v, n in (("allow", "a"), ("block", "b"))]
    )
    every = Window.partitionBy()
    below = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    up = Window.orderBy("bin").rowsBetween(0, Window.unboundedFollowing)
    right = F.sum("a").over(up) / F.sum("a").over(every) + F.coalesce(F.sum("b").over(below), F.lit(0)) / F.sum("b").over(every)
    best = (
        bins.withColumn("_both", (F.sum("a").over(every) > 0) & (F.sum("b").over(every) > 0))
        .withColumn("right", F.round(F.when(F.col("_both"), right), 9))
        .filter("right is not null").orderBy(F.desc("right"), "bin").select("bin").first()
    )
    return best[0] / STEPS if best else 0.0


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """Host, path, rule and verdict of each row of ``pages(page_id, url)``.

    The rule's verdict holds; otherwise a URL whose score reaches the threshold is allowed. A null
    URL, or one without ``://``, has an empty host and path, and is judged by its characters (null:
    none). Repeated rows and null ids are rows like any other; other columns are ignored. If no URL
    is allowed or none is blocked by a rule, all scores are compared with 0.
    """
    name, verdict = matched(rules)
    parts = pages.select("page_id", "url", host().alias("host"), path().alias("path"))
    parts = parts.select("*", name.alias("rule"), verdict.alias("_said"))
    distinct = StoredTable(
        parts.filter("url is not null").groupBy("url").agg(F.first("_said").alias("verdict")).withColumn("_written", _written())
    ).df
    fold = F.conv(F.substring(F.md5("url"), 1, 8), 16, 10).cast("bigint") % FOLDS == 0
    judged = distinct.filter(F.col("verdict").isNull() | fold)
    wanted = judged.select(F.explode(_grams()).alias("gram")).distinct()
    ratios = gram_ratios(distinct.filter(F.col("verdict").isNotNull() & ~fold), wanted)
    scores = StoredTable(scored(judged, ratios).join(judged.select("url", "verdict"), "url")).df
    least = threshold(scores.filter("verdict is not null"))
    undecided = scores.filter("verdict is null").select(F.col("url").alias("_url"), "score")
    method = F.when(F.coalesce("score", F.lit(0.0)) >= least, "allow").otherwise("block")
    return parts.join(undecided, F.col("_said").isNull() & (F.col("url") == F.col("_url")), "left").select(
        "page_id", "host", "path", "rule", F.coalesce("_said", method).alias("verdict")
    )


def _sql_rules(rules, what):
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    return "case " + " ".join(
        f"when (host = '{h}' or suffix(host, '.{h}')) and prefix(path, '{p}') then '{h + p if what == 'rule' else said}'"
        for said, h, p in ordered
    ) + " end"


def _sql_probability(c: str) -> str:
    p = "cast(1 as double) / 256"
    for n in range(1, ORDER + 2):
        p = f"(coalesce({c}{n}, 0) + {MIX}::double * ({p})) / (coalesce(t{c}{n}, 0) + {MIX}::double)"
    return p


def check_sql(rules=RULES) -> str:
    """The same counts, ratios and threshold, with a join per order."""
    low = f"'{UPPER}', '{LOWER}'"
    joins = " ".join(
        f"left join counts c{n} on c{n}.e = right(g.gram, {n}) left join totals t{n} on t{n}.c = left(right(g.gram, {n}), {n} - 1)"
        for n in range(1, ORDER + 2)
    )
    columns = ", ".join(f"c{n}.a as a{n}, c{n}.b as b{n}, t{n}.a as ta{n}, t{n}.b as tb{n}" for n in range(1, ORDER + 2))
    return f"""
with parts as (select page_id, url, coalesce(translate(regexp_extract(url, '{PARTS}', 1), {low}), '') as host,
                 coalesce(regexp_extract(url, '{PARTS}', 2), '') as path from pages),
ruled as (select *, {_sql_rules(rules, 'rule')} as rule, {_sql_rules(rules, 'said')} as said from parts),
urls as materialized (
  select url, min(said) as verdict,
         '{"^" * ORDER}' || translate(case when contains(url, '://') then substr(url, instr(url, '://') + 3) else url end, {low}) || '$' as w,
         ('0x' || substr(md5(url), 1, 8))::bigint % {FOLDS} = 0 as fold
  from ruled where url is not null group by url),
grams as materialized (select url, verdict, fold, substr(w, i, {ORDER + 1}) as gram
                       from (select *, unnest(range(1, length(w) - {ORDER} + 1)) as i from urls)),
whole as (select gram, count(*) filter (verdict = 'allow') as a, count(*) filter (verdict = 'block') as b
          from grams where verdict is not null and not fold group by gram),
counts as materialized (select right(gram, n) as e, sum(a) as a, sum(b) as b from whole, range(1, {ORDER + 2}) r(n) group by 1),
totals as materialized (select left(e, length(e) - 1) as c, sum(a) as a, sum(b) as b from counts group by 1),
wanted as (select distinct gram from grams where verdict is null or fold),
found as (select g.gram, {columns} from wanted g {joins}),
ratios as materialized (select gram, ln({_sql_probability('a')}) - ln({_sql_probability('b')}) as ratio from found),
scores as materialized (select url, any_value(verdict) as verdict, round(avg(ratio), 6) as score
                        from grams join ratios using (gram) where verdict is null or fold group by url),
bins as (select floor(score * {STEPS}) as bin, count(*) filter (verdict = 'allow') as a, count(*) filter (verdict = 'block') as b
         from scores where verdict is not null group by 1),
steps as (select bin, round(sum(a) over (order by bin rows between current row and unbounded following) / sum(a) over ()
                 + coalesce(sum(b) over (order by bin rows between unbounded preceding and 1 preceding), 0) / sum(b) over (), 9) as good,
                 sum(a) over () > 0 and sum(b) over () > 0 as both_seen from bins),
least as (select coalesce((select bin / {STEPS} from steps where both_seen order by good desc, bin limit 1), 0) as t)
select page_id, host, path, rule, coalesce(said, case when coalesce(score, 0) >= t then 'allow' else 'block' end) as verdict
from ruled left join (select url, score from scores where verdict is null) s on said is null and ruled.url = s.url, least
"""
