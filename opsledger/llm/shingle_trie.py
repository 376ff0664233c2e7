"""A trie of globally ordered shingle sets, probed for all sets of Jaccard similarity 0.8 or more."""

from __future__ import annotations

import numpy as np


class Node:
    """A path of tokens without a branch; least, most: sizes of the sets below; left: most tokens below this path."""

    __slots__ = ("path", "below", "ends", "least", "most", "left")

    def __init__(self, path: np.ndarray, size: int, left: int):
        self.path, self.below, self.ends, self.least, self.most, self.left = path, {}, [], size, size, left


class Trie:
    """Sets as ascending token arrays (the rarest first), with their full sizes; equal beginnings are stored once."""

    def __init__(self):
        self.root = Node(np.zeros(0, dtype=np.uint64), 1 << 60, 0)
        self.root.most = 0

    def add(self, tokens: np.ndarray, size: int, key: int) -> None:
        node, at = self.root, 0
        while True:
            node.least, node.most, node.left = min(node.least, size), max(node.most, size), max(node.left, len(tokens) - at)
            if at == len(tokens):
                node.ends.append((size, key))
                return
            child = node.below.get(first := int(tokens[at]))
            if child is None:
                child = node.below[first] = Node(tokens[at:], size, 0)
                child.ends.append((size, key))
                return
            n = min(len(child.path), len(tokens) - at)
            differ = np.flatnonzero(child.path[:n] != tokens[at : at + n])
            same = int(differ[0]) if len(differ) else n
            if same < len(child.path):  # the path parts here
                rest = child
                child = Node(rest.path[:same], size, max(rest.left + len(rest.path) - same, len(tokens) - at - same))
                child.least, child.most = min(size, rest.least), max(size, rest.most)
                rest.path = rest.path[same:]
                child.below[int(rest.path[0])] = rest
                node.below[first] = child
            node, at = child, at + same

    def linked(self, tokens: np.ndarray, size: int, done):
        """Keys of sets with 9 * overlap >= 4 * (both sizes), one after another; done(): whether to stop.

        The overlap with a path counts for all sets below it. A subtree is left when no set in it can reach the bound
        with the tokens that remain, there and in the probe, or by its size alone.
        """
        stack = [(self.root, 0)]
        while stack and not done():
            node, overlap = stack.pop()
            if 5 * node.most < 4 * size or 5 * size < 4 * node.least:
                continue
            need = -(-4 * (size + max(node.least, -(-4 * size // 5))) // 9)
            path, remain = node.path, len(tokens)
            if len(path):
                place = np.searchsorted(tokens, path)
                inside = place < len(tokens)
                overlap += int(np.count_nonzero(tokens[place[inside]] == path[inside]))
                remain = len(tokens) - int(place[-1])
            if overlap + min(node.left, remain) < need:
                continue
            for other, key in node.ends:
                if 9 * overlap >= 4 * (size + other):
                    yield key
            if node.below:
                own = tokens[len(tokens) - remain :]
                children = list(node.below.items())
                firsts = np.array([k for k, _ in children], dtype=np.uint64)
                hit = np.isin(firsts, own, assume_unique=True).tolist()
                stack += [(c, overlap) for (_, c), h in zip(children, hit) if not h] + [(c, overlap) for (_, c), h in zip(children, hit) if h]


class Forest:
    """Union-find over keys."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, x: int, y: int) -> bool:
        a, b = self.root(x), self.root(y)
        self.parent[max(a, b)] = min(a, b)
        return a != b


def self_links(sets: list[tuple[int, int, np.ndarray]]) -> list[tuple[int, int]]:
    """Links that connect all of (key, size, tokens) that any links connect: those that join two parts, no others."""
    trie, forest, links, parts = Trie(), Forest(), [], 0
    for key, size, tokens in sorted(sets, key=lambda x: (x[1], x[0])):
        forest.root(key)
        parts += 1
        seen = 1
        for other in trie.linked(tokens, size, lambda: parts == 1 and seen > 1):
            if forest.join(key, other):
                links.append((key, other))
                parts -= 1
            seen += 1
        trie.add(tokens, size, key)
    return links


def cross_links(stored: list[tuple[int, int, np.ndarray]], probes: list[tuple[int, int, np.ndarray]]) -> list[tuple[int, int]]:
    """As self_links, for links between a stored set and a probe."""
    trie, forest, links = Trie(), Forest(), []
    for key, size, tokens in stored:
        trie.add(tokens, size, key)
        forest.root(key)
    held = {k for k, _, _ in stored}  # roots of parts with a stored set
    parts = len(held)
    for key, size, tokens in sorted(probes, key=lambda x: (x[1], x[0])):
        state = {"parts": parts, "joined": forest.root(key) in held}  # whether the probe's part holds a stored set

        def done() -> bool:
            return state["joined"] and state["parts"] == 1

        for other in trie.linked(tokens, size, done):
            a, b = forest.root(key), forest.root(other)
            if other != key and forest.join(key, other):
                links.append((key, other))
                held -= {a, b}
                held.add(forest.root(key))
                if state["joined"]:
                    state["parts"] -= 1
                state["joined"] = True
        parts = state["parts"]
    return links
