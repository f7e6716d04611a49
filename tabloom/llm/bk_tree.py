"""BK-trees over 64-bit fingerprints, built and walked level by level in numpy.

A tree is three arrays in breadth-first order: the fingerprints, the parent
of each node, and the integer Hamming distance to that parent. The children
of a node stand together, sorted by that distance. Many trees are handled at
once: arrays of all trees follow each other, with the offsets of each tree.
"""

from __future__ import annotations

import numpy as np


def build(fps: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trees of the groups fps[offsets[k]:offsets[k+1]]: (fps, parents, edges), parents local, -1 at a root.

    The first fingerprint of a group is its root; fingerprints of a group are distinct.
    """
    n = len(fps)
    tree = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order, place = np.empty(n, np.int64), 0
    parent, edge = np.full(n, -1, np.int64), np.zeros(n, np.int64)   # by place
    left, group = np.arange(n), tree * 65
    up, dist = np.full(n, -1, np.int64), np.zeros(n, np.int64)       # of the members left
    while len(left):
        first = np.r_[True, group[1:] != group[:-1]]
        k = int(first.sum())
        order[place:place + k] = left[first]
        parent[place:place + k], edge[place:place + k] = up[first], dist[first]
        node = (place + np.cumsum(first) - 1)[~first]
        left = left[~first]
        d = np.bitwise_count(fps[left] ^ fps[order[node]]).astype(np.int64)
        group, up, dist = node * 65 + d, node, d
        by = np.argsort(group, kind="stable")
        left, group, up, dist = left[by], group[by], up[by], dist[by]
        place += k
    # From the order of placing to trees one after the other.
    by = np.argsort(tree[order], kind="stable")
    at = np.empty(n, np.int64)
    at[by] = np.arange(n) - np.asarray(offsets)[tree[order][by]]
    return fps[order[by]], np.where(parent[by] < 0, -1, at[parent[by]]), edge[by]


class Forest:
    """Trees laid out one after the other, ready to be walked."""

    def __init__(self, fps: np.ndarray, parents: np.ndarray, edges: np.ndarray, offsets: np.ndarray):
        self.fps, self.edges = fps, edges
        self.roots = np.asarray(offsets[:-1], np.int64)
        base = np.repeat(self.roots, np.diff(offsets))
        inner = np.flatnonzero(parents >= 0)
        up = base[inner] + parents[inner]
        self.n_child = np.bincount(up, minlength=len(fps))
        self.first = np.zeros(len(fps), np.int64)
        self.first[up[::-1]] = inner[::-1]      # the smallest child is written last

    def within(self, queries: np.ndarray, trees: np.ndarray, radius: int):
        """(query, node) of all nodes within ``radius`` of queries[k] in tree trees[k]."""
        q, v = np.arange(len(queries)), self.roots[trees]
        found_q, found_v = [], []
        while len(q):
            d = np.bitwise_count(queries[q] ^ self.fps[v]).astype(np.int64)
            hit = d <= radius
            found_q.append(q[hit])
            found_v.append(v[hit])
            n = self.n_child[v]
            at = np.repeat(np.arange(len(q)), n)
            child = self.first[v][at] + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            near = np.abs(self.edges[child] - d[at]) <= radius      # follow only these edges
            q, v = q[at[near]], child[near]
        return np.concatenate(found_q or [q]), np.concatenate(found_v or [v])


def forest_labels(a: np.ndarray, b: np.ndarray, n: int, labels: np.ndarray | None = None) -> np.ndarray:
    """Smallest index reachable over the links a-b among n items, starting from ``labels``."""
    lab = np.arange(n) if labels is None else labels.copy()
    while True:
        low = np.minimum(lab[a], lab[b])
        new = lab.copy()
        np.minimum.at(new, lab[a], low)
        np.minimum.at(new, lab[b], low)
        new = new[new]
        if np.array_equal(new, lab):
            return lab
        lab = new
