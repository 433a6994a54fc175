"""BK-trees over 64-bit fingerprints: children keyed by their Hamming distance to the parent."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

# Steps of a search that are held at once.
FRONTIER = 2_000_000


class Forest:
    """One BK-tree per shard, all held in flat arrays and walked level by level.

    ``edges`` holds ``parent * 65 + distance`` of every child in ascending
    order, ``children`` the child; a search for the edges within a radius is
    thus a range of that array.
    """

    def __init__(self, prints: np.ndarray, tree: np.ndarray):
        """``prints`` are distinct within a tree; ``tree`` is ascending."""
        self.prints = prints
        self.roots = np.flatnonzero(np.concatenate(([True], tree[1:] != tree[:-1])))
        self.root_of = np.repeat(self.roots, np.diff(np.append(self.roots, len(prints))))
        waiting = np.setdiff1d(np.arange(len(prints)), self.roots, assume_unique=True)
        at = self.root_of[waiting]
        edges, children = [], []
        while len(waiting):
            edge = at * 65 + np.bitwise_count(prints[waiting] ^ prints[at]).astype(np.int64)
            # The first that arrives over an edge becomes the child, the others go on below it.
            kinds, chosen, which = np.unique(edge, return_index=True, return_inverse=True)
            edges.append(kinds)
            children.append(waiting[chosen])
            stays = np.ones(len(waiting), bool)
            stays[chosen] = False
            at = waiting[chosen][which[stays]]
            waiting = waiting[stays]
        edge = np.concatenate(edges) if edges else np.empty(0, np.int64)
        order = np.argsort(edge, kind="stable")
        self.edges = edge[order]
        self.children = (np.concatenate(children) if children else np.empty(0, np.int64))[order]

    def links(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of positions, the smaller first, whose prints differ in at most ``radius`` bits."""
        sizes = np.diff(np.append(self.roots, len(self.prints)))
        load = np.cumsum(np.repeat(sizes, sizes))
        at = 0
        while at < len(self.prints):
            before = load[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(load, before + FRONTIER, "right")))
            yield from self._search(np.arange(at, end), radius)
            at = end

    def _search(self, asked: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        node = self.root_of[asked]
        while len(asked):
            distance = np.bitwise_count(self.prints[asked] ^ self.prints[node]).astype(np.int64)
            near = (distance <= radius) & (asked < node)
            if near.any():
                yield asked[near], node[near]
            low = np.searchsorted(self.edges, node * 65 + np.maximum(distance - radius, 0))
            high = np.searchsorted(self.edges, node * 65 + np.minimum(distance + radius, 64), "right")
            count = high - low
            offsets = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            node = self.children[np.repeat(low, count) + offsets]
            asked = np.repeat(asked, count)


def merge_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give both ends of every link, and all they are already joined to, the smallest label."""
    while True:
        left, right = label[a], label[b]
        open_ = left != right
        if not open_.any():
            return
        a, b, left, right = a[open_], b[open_], left[open_], right[open_]
        low = np.minimum(left, right)
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        while (shorter := label[label] != label).any():
            label[shorter] = label[label[shorter]]
