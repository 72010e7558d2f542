"""Runs of grey levels are found within scanlines: nothing is sorted but the pixels."""

import numpy as np
import pyarrow as pa

from pixelloom.operators import proposals as Q


def plain(values, delta, polarity):
    u = values if polarity == 0 else 255 - values
    out = set()
    for level in range(1, u.max() // delta + 1):
        at = np.flatnonzero(u >= level * delta)
        for part in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1):
            if len(part):
                out.add((polarity, level, part[0], part[-1]))
    return out


def test_few_levels_at_a_time_give_all_runs(monkeypatch):
    monkeypatch.setattr(Q, "RUNS", 50)
    values = np.random.default_rng(3).integers(0, 256, 70)
    line = pa.RecordBatch.from_pydict({
        "session": ["s"] * 70, "y": pa.array([4] * 70, pa.int32()), "x": pa.array(range(70), pa.int32()), "value": pa.array(values, pa.int32()),
    })
    # batches and pixels of a scanline come in any order
    mixed = line.take(pa.array(np.random.default_rng(4).permutation(70)))
    for delta in (1, 5):
        made = pa.Table.from_batches(Q._line_runs(["session"], delta)(iter([mixed.slice(0, 20), mixed.slice(20)])))
        got = [tuple(r[c] for c in ("polarity", "level", "x0", "x1")) for r in made.to_pylist()]
        assert len(got) == len(set(got))
        assert set(got) == plain(values, delta, 0) | plain(values, delta, 1)


def test_runs_are_not_sorted_or_shuffled(spark):
    image = spark.range(64).selectExpr("'s' as session", "cast(id div 8 as int) as y", "cast(id % 8 as int) as x", "cast(id * 37 % 256 as int) as value")
    runs = Q.level_runs(image, 1)
    assert runs.count() > 64
    plan = runs._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange hashpartitioning") <= 1
