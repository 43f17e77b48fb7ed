"""Suffix trees of number sequences, and longest common extensions by them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


class SuffixTree:
    """Ukkonen's tree of a sequence whose last symbol occurs nowhere else.

    Nodes are numbers, the root is 0.  ``edge_from`` and ``edge_to`` bound the
    symbols on the edge into a node, ``below`` has the children of an inner
    node by first symbol and None for a leaf, ``leaf_of`` the start of the
    suffix that ends in a leaf.
    """

    def __init__(self, symbols: Sequence[int]):
        size = len(symbols)
        edge_from, edge_to, suffix_link, leaf_of = [0], [0], [0], [-1]
        below: list[dict[int, int] | None] = [{}]
        node = 0  # the active point: a node, the symbols matched below it
        matched = 0
        edge = 0  # where those symbols stand
        pending = 0  # suffixes that end inside the tree so far
        leaves = 0
        for at, symbol in enumerate(symbols):
            made = 0  # inner node that still lacks its suffix link
            pending += 1
            while pending:
                if not matched:
                    edge = at
                kids = below[node]
                first = symbols[edge]
                child = kids.get(first)
                if child is None:
                    kids[first] = len(below)
                    edge_from.append(at)
                    if made:
                        suffix_link[made] = node
                        made = 0
                else:
                    begin = edge_from[child]
                    length = edge_to[child] - begin
                    if matched >= length:
                        node = child
                        edge += length
                        matched -= length
                        continue
                    middle = begin + matched
                    if symbols[middle] == symbol:
                        matched += 1
                        if made:
                            suffix_link[made] = node
                        break
                    split = len(below)
                    kids[first] = split
                    edge_from.append(begin)
                    edge_to.append(middle)
                    suffix_link.append(0)
                    leaf_of.append(-1)
                    edge_from[child] = middle
                    below.append({symbols[middle]: child, symbol: split + 1})
                    edge_from.append(at)
                    if made:
                        suffix_link[made] = split
                    made = split
                edge_to.append(size)
                suffix_link.append(0)
                leaf_of.append(leaves)
                below.append(None)
                leaves += 1
                pending -= 1
                if node:
                    node = suffix_link[node]
                elif matched:
                    matched -= 1
                    edge = at - pending + 1
        self.edge_from, self.edge_to, self.below, self.leaf_of = edge_from, edge_to, below, leaf_of

    def tour(self) -> tuple[list[int], list[int]]:
        """Leaves in lexicographic order, and before each the depth, in symbols,
        of the highest node that the Euler tour passes since the leaf before it.
        """
        edge_from, edge_to, below, leaf_of = self.edge_from, self.edge_to, self.below, self.leaf_of
        leaves: list[int] = []
        turns: list[int] = []
        stack = [(0, 0, 0)]
        while stack:
            node, turn, depth = stack.pop()
            kids = below[node]
            if kids is None:
                leaves.append(leaf_of[node])
                turns.append(turn)
                continue
            depth += edge_to[node] - edge_from[node]
            order = [kids[symbol] for symbol in sorted(kids)]
            for k, kid in enumerate(order):
                if below[kid] is not None:
                    stack.extend([(other, depth, depth) for other in order[:k:-1]])
                    stack.append((kid, turn, depth))
                    break
                leaves.append(leaf_of[kid])
                turns.append(turn)
                turn = depth
        return leaves, turns


class Extensions:
    """How far two suffixes of a sequence agree, in constant time a pair.

    The lowest common ancestor of two leaves is the highest node on the Euler
    tour between them; a table of minima over spans of 1, 2, 4, ... turns
    answers with two looks.  Memory is size * log2(size) small numbers.
    """

    def __init__(self, symbols: Sequence[int]):
        leaves, turns = SuffixTree(symbols).tour()
        size = len(leaves)
        self.rank = np.empty(size, np.int64)
        self.rank[leaves] = np.arange(size)
        self.minima = [np.asarray(turns, np.int32)]
        width = 1
        while 2 * width <= size:
            last = self.minima[-1]
            self.minima.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def lengths(self, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Common length of the suffixes from each ``one`` and ``other``, which
        must differ."""
        a, b = self.rank[one], self.rank[other]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        found = np.empty(len(low), np.int64)
        for step, table in enumerate(self.minima):
            now = np.flatnonzero(level == step)
            if len(now):
                found[now] = np.minimum(table[low[now]], table[high[now] - (1 << step)])
        return found
