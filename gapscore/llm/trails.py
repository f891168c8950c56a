"""Strings that share their beginnings: linked nodes with ancestors at powers of two and rolling hashes."""

from __future__ import annotations

_PRIME = (1 << 61) - 1
_BASE = 0x1F3A5C7E9B2D4F61 % _PRIME


class Trails:
    """A forest of labels. A node stands for the labels from its root to itself; node 0 is the empty string.

    ``add`` takes O(log depth). Equal beginnings of two nodes are found by their hashes at ancestors of equal depth,
    and equal hashes are verified: nodes that lead to the same node from there are equal, others are compared.
    """

    def __init__(self):
        self.parent, self.label, self.depth, self.hash, self.up = [0], [""], [0], [0], [[]]

    def add(self, parent: int, label: str) -> int:
        """A node that goes on from ``parent`` by a label that is not empty."""
        node, h = len(self.parent), self.hash[parent]
        for letter in label:
            h = (h * _BASE + ord(letter)) % _PRIME
        self.parent.append(parent)
        self.label.append(label)
        self.depth.append(self.depth[parent] + 1)
        self.hash.append(h)
        ups, k, at = [parent], 0, parent  # ups[k]: the ancestor 2^k above
        while k < len(self.up[at]):
            at = self.up[at][k]
            ups.append(at)
            k += 1
        self.up.append(ups)
        return node

    def above(self, node: int, steps: int) -> int:
        """The ancestor ``steps`` above."""
        k = 0
        while steps:
            if steps & 1:
                node = self.up[node][k]
            steps >>= 1
            k += 1
        return node

    def text(self, node: int, until: int = 0) -> str:
        """The labels from below ``until`` to the node."""
        labels = []
        while node != until:
            labels.append(self.label[node])
            node = self.parent[node]
        return "".join(reversed(labels))

    def _equal(self, a: int, b: int) -> bool:
        """Whether two nodes of equal depth and hash stand for equal strings."""
        while a != b:
            if self.label[a] != self.label[b]:
                return self.text(a) == self.text(b)
            a, b = self.parent[a], self.parent[b]
        return True

    def parting(self, a: int, b: int) -> tuple[int, int] | None:
        """The first nodes, at equal depth, at which two strings part; none if one begins with the other."""
        depth = min(self.depth[a], self.depth[b])
        a, b = self.above(a, self.depth[a] - depth), self.above(b, self.depth[b] - depth)
        if self.hash[a] == self.hash[b] and self._equal(a, b):
            return None
        for k in reversed(range(len(self.up[a]))):
            if k < len(self.up[a]) and self.hash[self.up[a][k]] != self.hash[self.up[b][k]]:
                a, b = self.up[a][k], self.up[b][k]
        while not self._equal(self.parent[a], self.parent[b]):  # only after a collision of hashes
            a, b = self.parent[a], self.parent[b]
        return a, b

    def less(self, a: int, b: int) -> bool:
        """Whether the string of ``a`` comes before that of ``b``."""
        parted = self.parting(a, b)
        if parted:
            x, y = self.label[parted[0]], self.label[parted[1]]
            if not (x.startswith(y) or y.startswith(x)):
                return x < y
        return self.text(a) < self.text(b)
