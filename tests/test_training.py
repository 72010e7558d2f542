import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from grids import frame, grid, labels, shapes
from pixelloom.operators import losses as L
from pixelloom.operators import patches as P
from pixelloom.operators import scoring as S


def patch_of(spark, image, mask, turns=0, flip_y=False, flip_x=False, scale=1.0, offset=0.0):
    h, w = image.shape
    df = frame(spark, "value", image).join(
        frame(spark, "mask", mask.astype(float)), ["session", "y", "x"]
    )
    return df.select(
        "session", F.lit(1).alias("epoch"), F.lit(0).alias("patch"), F.col("y").alias("py"),
        F.col("x").alias("px"), F.lit(h).alias("h"), F.lit(w).alias("w"), "value", "mask",
        F.struct(F.lit(flip_y).alias("flip_y"), F.lit(flip_x).alias("flip_x"), F.lit(turns).alias("turns"),
                 F.lit(scale).alias("scale"), F.lit(offset).alias("offset")).alias("aug"),
    )


def as_grid(df, name, shape):
    return grid(df.withColumnRenamed("py", "y").withColumnRenamed("px", "x"), name, shape, -1)


@pytest.mark.parametrize("turns", [0, 1, 2, 3])
def test_turns_and_flips_move_image_and_mask_together(spark, turns):
    image = np.arange(12.0).reshape(3, 4) / 20
    mask = image >= 0.3
    out = P.augment(patch_of(spark, image, mask, turns, flip_y=True), noise_sd=0)
    want = np.rot90(np.flip(image, 0), turns)
    np.testing.assert_allclose(as_grid(out, "value", want.shape), want)
    np.testing.assert_array_equal(as_grid(out, "mask", want.shape), np.rot90(np.flip(mask, 0), turns))


def test_brightness_and_noise_touch_the_image_only(spark):
    image, mask = np.full((20, 20), 0.5), np.eye(20)
    out = P.augment(patch_of(spark, image, mask, scale=1.1, offset=0.05), noise_sd=0.02)
    v = as_grid(out, "value", image.shape)
    assert abs(v.mean() - 0.6) < 0.01 and abs(v.std() - 0.02) < 0.005
    np.testing.assert_array_equal(as_grid(out, "mask", image.shape), mask)
    again = P.augment(patch_of(spark, image, mask, scale=1.1, offset=0.05).repartition(5), noise_sd=0.02)
    np.testing.assert_array_equal(v, as_grid(again, "value", image.shape))


def test_crop_bounds(spark):
    mask = np.zeros((20, 30), dtype=int)
    mask[0, 0] = mask[19, 29] = 1
    plan = P.plan_patches(shapes(spark, ("s", 20, 30), ("tiny", 4, 50), ("blank", 20, 20)), [1, 2], 40)
    rows = P.sample_crops(plan, labels(spark, mask), 8, 1.0).collect()
    assert len(rows) == 3 * 80
    for r in rows:
        if r.session == "tiny":
            assert (r.top, r.left, r.h, r.w) == (0, 0, 4, 8)
        elif r.session == "s":
            assert (r.top, r.left) in {(0, 0), (12, 22)}
        else:
            assert 0 <= r.top <= 12 and 0 <= r.left <= 12
    assert {(r.top, r.left) for r in rows if r.session == "s"} == {(0, 0), (12, 22)}


def test_targets(spark):
    mask = np.zeros((5, 5))
    mask[2, 2] = 1
    patches = patch_of(spark, mask, mask)
    rows = P.make_targets(patches, "foreground_support", 1).collect()
    assert sorted((r.channel, r.py, r.px) for r in rows) == [
        (0, 2, 2), (1, 1, 2), (1, 2, 1), (1, 2, 2), (1, 2, 3), (1, 3, 2)
    ]
    with pytest.raises(ValueError, match="targets are"):
        P.make_targets(patches, "other")


SCORED = "sample string, channel int, y int, x int, z double, t double"


def test_losses_against_arrays(spark):
    rng = np.random.default_rng(3)
    z, t = rng.normal(0, 3, (2, 2, 4, 5)), (rng.random((2, 2, 4, 5)) < 0.4).astype(float)
    rows = [(f"s{n}", c, y, x, float(z[n, c, y, x]), float(t[n, c, y, x])) for n, c, y, x in np.ndindex(z.shape)]
    df = spark.createDataFrame(rows, SCORED)
    p = 1 / (1 + np.exp(-z))
    bce = -(t * np.log(p) + (1 - t) * np.log(1 - p))
    assert L.mean_bce(df).first().bce == pytest.approx(bce.mean())
    cw, pw = np.array([1.0, 0.35]).reshape(1, 2, 1, 1), np.array([2.0, 1.0]).reshape(1, 2, 1, 1)
    weighted = cw * -(pw * t * np.log(p) + (1 - t) * np.log(1 - p))
    assert L.mean_bce(df, (), [1.0, 0.35], [2.0, 1.0]).first().bce == pytest.approx(weighted.mean())
    q = 1 / (1 + np.exp(-z * cw))
    dice = (2 * (q * t).sum((1, 2, 3)) + 1e-6) / (q.sum((1, 2, 3)) + t.sum((1, 2, 3)) + 1e-6)
    assert L.soft_dice(df, (), [1.0, 0.35]).first().dice_loss == pytest.approx(1 - dice.mean())
    tp, fp, fn = (p * t).sum((2, 3)), (p * (1 - t)).sum((2, 3)), ((1 - p) * t).sum((2, 3))
    tv = (tp + 1e-6) / (tp + 0.15 * fp + 0.85 * fn + 1e-6)
    row = L.segmentation_loss(df, {"mode": "bce_tversky", "tversky_alpha": 0.15, "tversky_beta": 0.85}).first()
    assert row.tversky_loss == pytest.approx(1 - tv.mean())
    assert row.loss == pytest.approx(bce.mean() + 1 - tv.mean())
    with pytest.raises(ValueError, match="a loss is"):
        L.segmentation_loss(df, {"mode": "other"})


def test_hard_dice_of_an_empty_pair_is_one(spark):
    df = spark.createDataFrame([("s", 0, 0, 0, -9.0, 0.0)], SCORED)
    assert L.batch_dice(df).first().pixel_dice == 1.0
    extreme = spark.createDataFrame([("s", 0, 0, 0, -900.0, 0.0), ("s", 0, 0, 1, 900.0, 1.0)], SCORED)
    assert math.isfinite(L.mean_bce(extreme).first().bce)


def test_best_epoch_is_the_earliest_maximum(spark):
    df = spark.createDataFrame(
        [("r", 1, 0.5), ("r", 2, 0.9), ("r", 3, 0.9), ("r", 4, None), ("none", 1, None)],
        "run string, epoch int, val_pixel_dice double",
    )
    assert [(r.run, r.epoch) for r in L.best_epoch(df).collect()] == [("r", 2)]
    marks = {(r.run, r.epoch): r.new_best for r in L.running_best(df).collect()}
    assert marks == {("r", 1): True, ("r", 2): True, ("r", 3): False, ("r", 4): False, ("none", 1): False}


def test_flip_averaging_of_an_even_model_changes_nothing(spark):
    rng = np.random.default_rng(1)
    rows = [(f"i{n}", h, w, rng.random(h * w).tolist()) for n, (h, w) in enumerate([(4, 6), (5, 5), (4, 6)])]
    images = spark.createDataFrame(rows, "session string, height int, width int, pixels array<float>")

    def soft():
        return lambda batch: 1 / (1 + np.exp(-(batch - 0.5)))

    def constant():
        return lambda batch: np.full(batch.shape, 0.3)

    plain = {r.session: r.probability for r in S.score_images(images, soft, batch=2).collect()}
    views = {r.session: r.probability for r in S.score_images(images, soft, tta=True).collect()}
    for k in plain:
        np.testing.assert_allclose(plain[k], views[k])
    flat = S.score_images(images, constant).first().probability
    assert set(flat) == {0.3}


def test_a_wide_scanline_meets_only_near_patches(spark):
    side, size = 2048, 64
    px = spark.createDataFrame([("s", 0, x, float(x)) for x in range(side)], "session string, y int, x int, value double")
    rows = [("s", 1, k, 0, k * 30, 1, size) for k in range(66)]
    crops = spark.createDataFrame(rows, "session string, epoch int, patch int, top int, left int, h int, w int")
    out = P.crop(px, crops, block=size)
    assert out.count() == sum(min(size, side - r[4]) for r in rows)
    # at most two pieces per patch, each piece as wide as a patch: twice the rows that stay
    met = px.selectExpr("*", f"floor(x / {size}) piece").join(
        crops.selectExpr("*", f"explode(sequence(floor(left / {size}), floor((left + w - 1) / {size}))) piece"), ["session", "piece"])
    assert met.count() <= 2.1 * out.count()
