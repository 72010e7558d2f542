"""Component trees of single images: all components of all grey levels, nested.

A node is a component together with the levels at which it stays the same, so a tree has
at most one node per pixel however many levels there are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class ComponentTree:
    """Nodes with the levels ``low``..``high`` they stand for; ``parent`` is -1 at the root.

    ``order`` lists the image's pixels so that those of node ``n`` are
    ``order[start[n] : start[n] + area[n]]``.
    """

    low: np.ndarray
    high: np.ndarray
    parent: np.ndarray
    area: np.ndarray
    first: np.ndarray
    start: np.ndarray
    order: np.ndarray

    def holder(self, nodes: np.ndarray, level: np.ndarray) -> np.ndarray:
        """The node that holds ``nodes`` at a lower ``level`` (1 or more)."""
        nodes = nodes.copy()
        while (above := self.low[nodes] > level).any():
            nodes[above] = self.parent[nodes[above]]
        return nodes


def component_tree(image: np.ndarray) -> ComponentTree:
    """Components of ``image >= level`` with 4 neighbours, for every level from 1."""
    height, width = image.shape
    values = image.ravel()
    falling = np.argsort(-values, kind="stable")
    joined = [-1] * values.size
    above = [-1] * values.size
    # pixels enter from bright to dark, and each takes the components it touches below itself
    for p in falling.tolist():
        joined[p] = above[p] = p
        x = p % width
        for q, inside in ((p - 1, x > 0), (p + 1, x < width - 1), (p - width, p >= width), (p + width, p < values.size - width)):
            if not inside or joined[q] < 0:
                continue
            while joined[q] != q:
                joined[q] = q = joined[joined[q]]
            if q != p:
                joined[q] = above[q] = p
    # one pixel stands for all of a component's own level: the last that entered
    level = values.tolist()
    stand = above[:]
    for p in falling[::-1].tolist():
        q = stand[p]
        if level[stand[q]] == level[q]:
            stand[p] = stand[q]
    up = np.array(stand)
    pixels = np.arange(values.size)
    heads = falling[::-1][(values[up] != values)[falling[::-1]] | (up == pixels)[falling[::-1]]]  # root first
    number = np.full(values.size, -1)
    number[heads] = np.arange(len(heads))
    own = number[np.where(number >= 0, pixels, up)]
    parent = number[up[heads]]
    parent[0] = -1
    area, first = np.bincount(own, minlength=len(heads)), np.full(len(heads), values.size)
    np.minimum.at(first, own, pixels)
    n_own, parents = area.copy(), parent.tolist()
    area, first = area.tolist(), first.tolist()
    for k in range(len(heads) - 1, 0, -1):
        area[parents[k]] += area[k]
        first[parents[k]] = min(first[parents[k]], first[k])
    start, free = [0] * len(heads), n_own.tolist()
    for k in range(1, len(heads)):
        start[k] = start[parents[k]] + free[parents[k]]
        free[parents[k]] += area[k]
    start, high = np.array(start), values[heads]
    low = np.where(parent >= 0, high[parent] + 1, 1)
    return ComponentTree(low, high, parent, np.array(area), np.array(first), start, np.argsort(start[own], kind="stable"))


def stable_nodes(
    tree: ComponentTree, delta: int, min_area: int, max_area: int, max_variation: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Node, level and variation of the regions that change least around their level.

    Every level is looked at; ``delta`` is how far the areas that are compared lie apart.
    """
    count = np.maximum(tree.high - tree.low + 1, 0)
    offset = np.cumsum(count) - count
    node = np.repeat(np.arange(len(count)), count)
    level = np.arange(len(node)) - offset[node] + tree.low[node]
    area = tree.area[node]

    def region(nodes: np.ndarray, levels: np.ndarray) -> np.ndarray:
        return offset[nodes] + levels - tree.low[nodes]

    variation, inner = np.full(len(node), np.nan), np.zeros(len(node))
    far = np.flatnonzero(level > delta)
    outer = tree.holder(node[far], level[far] - delta)
    np.maximum.at(inner, region(outer, level[far] - delta), area[far])
    variation[far] = (tree.area[outer] - inner[far]) / area[far]
    near = np.flatnonzero(level > 1)
    below = region(tree.holder(node[near], level[near] - 1), level[near] - 1)
    under, main = np.full(len(node), np.nan), np.full(len(node), np.nan)
    under[near] = variation[below]
    # the largest child last, of equals the one that begins first
    rising = np.lexsort((-tree.first[node[near]], area[near]))
    main[below[rising]] = variation[near[rising]]
    keep = (
        (variation <= max_variation) & (area >= min_area) & (area <= max_area)
        & ~(variation > under) & ~(variation >= main)
    )
    return node[keep], level[keep], variation[keep]


def pixel_runs(tree: ComponentTree, node: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last column of the runs of a node's pixels."""
    pixels = np.sort(tree.order[tree.start[node] : tree.start[node] + tree.area[node]])
    breaks = np.flatnonzero((np.diff(pixels) > 1) | (pixels[1:] % width == 0))
    begin, end = pixels[np.append(0, breaks + 1)], pixels[np.append(breaks, len(pixels) - 1)]
    return begin // width, begin % width, end % width
