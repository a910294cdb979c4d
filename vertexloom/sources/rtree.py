"""The packed R-tree over a container's features: sizes, building, searching.

A tree over n items has levels of n, ceil(n / s), … 1 nodes of 40 bytes (four doubles and an unsigned 64-bit number), stored from the root; leaves come last. The number of
an inner node is that of its first child, the number of a leaf the byte offset of its feature.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

NODE = np.dtype([("minx", "<f8"), ("miny", "<f8"), ("maxx", "<f8"), ("maxy", "<f8"), ("offset", "<u8")])
_SIDES = ["minx", "miny", "maxx", "maxy"]


def level_sizes(n_items: int, node_size: int) -> list[int]:
    """Nodes per level, leaves first."""
    if node_size < 2:
        raise ValueError(f"a tree needs two or more children a node, not {node_size}")
    if n_items < 1:
        raise ValueError("a tree over no items has no levels")
    sizes = [n_items]
    while len(sizes) == 1 or sizes[-1] > 1:
        sizes.append(-(-sizes[-1] // node_size))
    return sizes


def level_bounds(n_items: int, node_size: int) -> list[tuple[int, int]]:
    """First node and end of each level, leaves first."""
    sizes = level_sizes(n_items, node_size)
    end, out = sum(sizes), []
    for n in sizes:
        out.append((end - n, end))
        end -= n
    return out


def tree_bytes(n_items: int, node_size: int) -> int:
    """Size of the index; 0 for no items or node size 0. Node sizes are held to 2..65535."""
    if n_items == 0 or node_size == 0:
        return 0
    return sum(level_sizes(n_items, min(max(node_size, 2), 65535))) * NODE.itemsize


def build(leaves: np.ndarray, node_size: int) -> np.ndarray:
    """All nodes from the leaves; every parent's box contains those of its children."""
    bounds = level_bounds(len(leaves), node_size)
    tree = np.zeros(bounds[0][1], NODE)
    tree[bounds[0][0] :] = leaves
    for (c0, c1), (p0, p1) in zip(bounds, bounds[1:]):
        first = np.arange(p1 - p0) * node_size
        tree["offset"][p0:p1] = c0 + first
        for side in _SIDES:
            fold = np.fmin if side.startswith("min") else np.fmax
            tree[side][p0:p1] = fold.reduceat(tree[side][c0:c1], first)
    return tree


def search(n_items: int, node_size: int, rect: tuple[float, float, float, float], read: Callable[[int, int], np.ndarray], gap: int = 0) -> np.ndarray:
    """(item, offset) of each leaf whose closed box meets the closed ``rect``, in ascending order, each once.

    ``read(first, end)`` gives nodes. Level by level; nodes with at most ``gap`` others between them are read together. A NaN bound never excludes.
    """
    bounds = level_bounds(n_items, node_size)
    minx, miny, maxx, maxy = rect
    wanted = np.array([0])
    for level in range(len(bounds) - 1, -1, -1):
        breaks = np.flatnonzero(np.diff(wanted) > max(gap, node_size)) + 1
        runs = np.split(wanted, breaks) if len(wanted) else []
        nodes = np.concatenate([read(int(r[0]), int(r[-1]) + 1)[r - r[0]] for r in runs]) if runs else np.zeros(0, NODE)
        hit = ~((maxx < nodes["minx"]) | (maxy < nodes["miny"]) | (minx > nodes["maxx"]) | (miny > nodes["maxy"]))
        nodes, wanted = nodes[hit], wanted[hit]
        if level == 0:
            out = np.zeros(len(wanted), [("item", "<i8"), ("offset", "<i8")])
            out["item"], out["offset"] = wanted - bounds[0][0], nodes["offset"]
            return out
        children = nodes["offset"].astype(np.int64)[:, None] + np.arange(node_size)
        wanted = children[children < bounds[level - 1][1]]
    raise AssertionError


def hilbert(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Position of points (coordinates 0..65535) along a Hilbert curve of order 16."""
    x, y = x.astype(np.int64), y.astype(np.int64)
    d = np.zeros_like(x)
    s = 1 << 15
    while s:
        rx, ry = (x & s) > 0, (y & s) > 0
        d += s * s * ((3 * rx) ^ ry)
        turn = ~ry
        flip = turn & rx
        x, y = np.where(flip, 65535 - x, x), np.where(flip, 65535 - y, y)
        x, y = np.where(turn, y, x), np.where(turn, x, y)
        s >>= 1
    return d
