"""Small dense arrays to and from pixel tables, and slow obvious references."""

import numpy as np


def frame(spark, name, array, session="s", keep=None, kind="double"):
    rows = [
        (session, int(y), int(x), array[y, x].item())
        for y, x in np.ndindex(array.shape) if keep is None or keep[y, x]
    ]
    return spark.createDataFrame(rows, f"session string, y int, x int, {name} {kind}")


def labels(spark, array, session="s"):
    return frame(spark, "label", array.astype(int), session, array > 0, "int")


def grid(df, name, shape, fill=0):
    out = np.full(shape, fill, dtype=float)
    for r in df.collect():
        out[r["y"], r["x"]] = r[name]
    return out


def shapes(spark, *rows):
    return spark.createDataFrame(list(rows), "session string, height int, width int")


def components(mask):
    """4-connected labels in first-pixel order by plain flood fill."""
    out = np.zeros(mask.shape, dtype=int)
    n = 0
    for y, x in np.ndindex(mask.shape):
        if mask[y, x] and not out[y, x]:
            n += 1
            stack = [(y, x)]
            out[y, x] = n
            while stack:
                a, b = stack.pop()
                for c, d in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                    if 0 <= c < mask.shape[0] and 0 <= d < mask.shape[1] and mask[c, d] and not out[c, d]:
                        out[c, d] = n
                        stack.append((c, d))
    return out
