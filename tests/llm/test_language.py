"""Language identification: held-out accuracy, calibration and corners."""

from collections import Counter

import numpy as np
import zlib
from pyspark.sql import functions as F

from pixelloom.llm import language

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    truth = {r.doc_id: r for r in docs.collect()}
    got = language.identify(docs).collect()
    assert len(got) == len(truth)
    right = []
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
        if r.held_out:
            right.append(r.lang_pred == truth[r.doc_id].lang)
    assert np.mean(right) > 0.98


def test_only_texts_count(spark):
    """Ids, sources and held-out labels do not change a prediction."""
    docs = spark.read.parquet(f"{SF}/../sf0.001/documents.parquet")
    model = language.fit(docs)
    wrong = docs.selectExpr("doc_id", "text", "case when crc32(cast(doc_id as string)) % 3 = 1 then 'xx' else lang end as lang")
    assert language.fit(wrong).languages == model.languages
    texts = [r.text for r in docs.limit(30).collect()]
    same = spark.createDataFrame([(0, t) for t in texts], "doc_id long, text string")
    characters = language.Characters()
    for r, t in zip(language.predict(same, model).collect(), texts):
        assert (r.lang_pred, round(r.score, 9)) == (lambda p: (p[0], round(p[1], 9)))(model.predict(characters.count(t)))


def test_sample_is_even(spark):
    """A rare language gives as many documents as the others, or all it has, also above the bound."""
    sizes = {"aa": 6000, "bb": 3000, "cc": 2000, "dd": 1500, "ee": 1200, "ff": 90}
    rows = [(k, f"{lang} text of number{k}", lang) for lang, n in sizes.items() for k in range(n)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7, F.col("text"))
    for most, want in ((300, [50] * 6), (900, [162] * 5 + [90])):
        drawn = Counter(r.language for r in language.draw_sample(train, sizes, most).select("language").collect())
        assert [drawn[k] for k in range(6)] == want
    # copies of one row are rows like any other, but never more than the quota
    copies = spark.createDataFrame(rows[:1] * 5000 + rows[-90:], train.schema)
    drawn = Counter(r.language for r in language.draw_sample(copies, {"aa": 5000, "ff": 90}, 200).select("language").collect())
    assert drawn[0] <= 110 and drawn[1] == 90


def test_order_mixes_the_languages(spark):
    rows = [(k, f"text of number{k}", "aa" if k % 3 else "bb") for k in range(900)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    order = [r.language for r in language.draw_sample(train, {"aa": 600, "bb": 300}, 400).select("language").collect()]
    assert Counter(order[:200]).most_common()[-1][1] > 70 and Counter(order) == {0: 200, 1: 200}


def test_corners(spark):
    rows = [(k, "the and of to in " * 5 if k % 2 else "der die und das ist " * 5, "en" if k % 2 else "de", "s") for k in range(60)]
    rows += [(100, None, "en", "s"), (101, "", "de", "s"), (102, "123 !?", "en", "s"), (None, "und das", None, "s"), (103, "der " * 300_000, None, "s"), (103, "der " * 300_000, None, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = language.identify(df).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id in (100, 101, 102):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif r.doc_id == 103:
            assert r.lang_pred == "de"
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    kept = language.keep_known(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} & {100, 101, 102} == set()
    assert language.identify(df.limit(0)).count() == 0
    unlabelled = language.identify(df.selectExpr("doc_id", "text", "cast(null as string) lang")).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"}


def test_pieces_of_long_texts(monkeypatch):
    text = "Ein längerer Text, mit 3 Zahlen!! " * 50
    whole = language.Characters().count(text)
    monkeypatch.setattr(language, "PIECE", 64)
    parts = language.Characters().count(text)
    assert whole[0].tolist() == parts[0].tolist() and whole[1].tolist() == parts[1].tolist()


def test_temperature_lowers_the_loss():
    rng = np.random.default_rng(0)
    classes = rng.integers(0, 3, 400)
    logits = 5 * (np.eye(3)[classes] + 0.9 * rng.normal(size=(400, 3)))

    def loss(t):
        return -np.log(language.softmax(logits / t)[np.arange(400), classes]).mean()

    t = language.fitted_temperature(logits, classes)
    assert loss(t) <= min(loss(1.0), loss(t * 1.05), loss(t / 1.05)) + 1e-9
