"""The learner's parts against plain repetitions: n-grams, document counts, FTRL updates and temperature."""

import math

import numpy as np
import pytest

from pixelloom.llm import language as L


def grams(text):
    """Places of a text's n-grams with their counts, one character at a time."""
    codes, mark = [], True
    for c in text.lower():
        if c.isalpha():
            codes.append(ord(c))
            mark = False
        elif not mark:
            codes.append(0)
            mark = True
    # one boundary before the first letter and one after the last character
    codes = [0, *codes, 0]
    wrap, counts = (1 << 64) - 1, {}
    factors = [int(f) for f in L._FACTORS]
    for end in range(len(codes)):
        hashed = None
        for start in (end, end - 1, end - 2):
            if start < 0:
                continue
            window = codes[start : end + 1]
            hashed = window[0] * factors[0] & wrap
            for k, code in enumerate(window[1:], 1):
                hashed = (hashed * 31 + code * factors[k]) & wrap
            if len(window) == 1 and window[0] == 0:
                continue
            place = (hashed * factors[1] & wrap) >> int(L._SHIFT)
            counts[place] = counts.get(place, 0) + 1
    return counts


@pytest.mark.parametrize("text", ["a", "The cat", "  été, où? 12 ß", "x" * 50, "a-b-c d", "日本 語"])
def test_grams(text):
    places, counts = L.Characters().count(text)
    assert dict(zip(places.tolist(), counts.tolist())) == grams(text)


def test_document_counts(spark):
    texts = ["one cat", "two cats", None, "", "123", "one cat", "ñandú"]
    total, seen = L.document_counts(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    want = {}
    for t in texts:
        if t and any(c.isalpha() for c in t):
            for place in grams(t):
                want[place] = want.get(place, 0) + 1
    assert total == 4 and {k: int(seen[k]) for k in np.flatnonzero(seen)} == want


def plain_ftrl(rows, classes, k, epochs):
    """The published per-coordinate update with a softmax, a weight at a time."""
    z, n = {}, {}

    def weight(c, i):
        zi, ni = z.get((c, i), 0.0), n.get((c, i), 0.0)
        if abs(zi) <= L.L1:
            return 0.0
        return -(zi - math.copysign(L.L1, zi)) / ((L.BETA + math.sqrt(ni)) / L.ALPHA + L.L2)

    for _ in range(epochs):
        for (places, values), label in zip(rows, classes):
            row = [*zip(places.tolist(), values.tolist()), (L.N_FEATURES, 1.0)]
            w = {(c, i): weight(c, i) for c in range(k) for i, _ in row}
            scores = [sum(w[c, i] * x for i, x in row) for c in range(k)]
            top = max(scores)
            p = [math.exp(s - top) for s in scores]
            p = [v / sum(p) for v in p]
            for c in range(k):
                for i, x in row:
                    g = (p[c] - (c == label)) * x
                    ni = n.get((c, i), 0.0)
                    sigma = (math.sqrt(ni + g * g) - math.sqrt(ni)) / L.ALPHA
                    z[c, i] = z.get((c, i), 0.0) + g - sigma * w[c, i]
                    n[c, i] = ni + g * g
    return {key: weight(*key) for key in z}


def test_ftrl_updates():
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(25):
        places = np.sort(rng.choice(40, size=int(rng.integers(1, 8)), replace=False))
        rows.append((places, rng.random(len(places)) + 0.1))
    classes = rng.integers(0, 3, 25)
    got, want = L.train_ftrl(rows, classes, 3, epochs=3), plain_ftrl(rows, classes, 3, 3)
    for c in range(3):
        for i in [*range(40), L.N_FEATURES]:
            assert got[c, i] == pytest.approx(want.get((c, i), 0.0), abs=1e-12)
    assert (got == 0).sum() > got.size * 0.9 and any(v == 0 for v in want.values())


def test_temperature_is_the_best_on_a_fine_grid():
    rng = np.random.default_rng(2)
    classes = rng.integers(0, 4, 400)
    logits = rng.normal(size=(400, 4)) * 3
    logits[np.arange(400), classes] += 4

    def loss(t):
        total = 0.0
        for row, label in zip(logits / t, classes):
            top = row.max()
            total += math.log(sum(math.exp(v - top) for v in row)) + top - row[label]
        return total / len(classes)

    found = L.fitted_temperature(logits, classes)
    assert loss(found) <= min(loss(t) for t in np.geomspace(0.05, 20, 200)) + 1e-4


def test_weights_of_a_text():
    idf = np.linspace(1, 2, L.N_FEATURES)
    places, counts = L.Characters().count("banana")
    plain = [(1 + math.log(c)) * idf[p] for p, c in zip(places, counts)]
    size = math.sqrt(sum(v * v for v in plain))
    assert L.weighted(places, counts, idf).tolist() == pytest.approx([v / size for v in plain])
