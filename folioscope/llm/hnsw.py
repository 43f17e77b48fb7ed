"""A navigable small-world graph in numpy, built and searched many rows at a time.

Nodes are in order of their level, highest first, so a layer is a prefix of
them.  ``near`` means a large dot product; vectors have unit length.
"""

from __future__ import annotations

import io
import math

import numpy as np

WIDTH = 16  # links of a node in upper layers, twice as many in the lowest
BATCH = 512
STEP = 4  # nodes of a beam that are expanded at a time


def _choose(own: np.ndarray, candidates: np.ndarray, unit: np.ndarray, width: int) -> np.ndarray:
    """Up to ``width`` links per row out of ``candidates`` (-1: none).

    Nearest first; a candidate nearer to a chosen one than to the row itself
    is put off, which keeps links in different directions.
    """
    near = np.einsum("bkd,bd->bk", unit[candidates], unit[own])
    near[(candidates < 0) | (candidates == own[:, None])] = -np.inf
    order = np.argsort(-near, axis=1, kind="stable")
    candidates, near = np.take_along_axis(candidates, order, 1), np.take_along_axis(near, order, 1)
    repeated = np.zeros(candidates.shape, bool)
    by_id = np.argsort(candidates, axis=1, kind="stable")
    sorted_ids = np.take_along_axis(candidates, by_id, 1)
    np.put_along_axis(repeated[:, :], by_id[:, 1:], sorted_ids[:, 1:] == sorted_ids[:, :-1], 1)
    good = np.isfinite(near) & ~repeated
    vectors = unit[candidates]
    among = np.einsum("bkd,bld->bkl", vectors, vectors)
    chosen = np.zeros(candidates.shape, bool)
    for k in range(candidates.shape[1]):
        covered = (chosen & (among[:, k] > near[:, k, None])).any(axis=1)
        chosen[:, k] = good[:, k] & ~covered & (chosen.sum(axis=1) < width)
    # Free places go to the nearest of those put off.
    rank = np.where(chosen, 0, np.where(good, 1, 2)) * candidates.shape[1] + np.arange(candidates.shape[1])
    take = np.argsort(rank, axis=1, kind="stable")[:, :width]
    links = np.where(np.take_along_axis(good, take, 1), np.take_along_axis(candidates, take, 1), -1)
    if links.shape[1] < width:
        links = np.pad(links, ((0, 0), (0, width - links.shape[1])), constant_values=-1)
    return links.astype(np.int32)


class Graph:
    def __init__(self, unit: np.ndarray, layers: list[np.ndarray]):
        self.unit = unit
        self.layers = layers  # links of each layer, lowest first

    # -- search --

    def _beam(self, links: np.ndarray, queries: np.ndarray, entries: np.ndarray, beam: int):
        """The ``beam`` nearest nodes found per query in one layer, and their nearness."""
        unit, count = self.unit, len(queries)
        seen = np.zeros((count, len(links)), bool)
        rows = np.arange(count)[:, None]
        found = entries
        near = np.einsum("qed,qd->qe", unit[found], queries)
        near[found < 0] = -np.inf
        seen[rows, np.maximum(found, 0)] = found >= 0
        done = found < 0
        while True:
            waiting = np.where(done, -np.inf, near)
            active = np.flatnonzero(np.isfinite(waiting).any(axis=1))
            if not len(active):
                return found, near
            step = min(STEP, found.shape[1])
            picks = np.argpartition(-waiting[active], step - 1, axis=1)[:, :step]
            real = np.isfinite(np.take_along_axis(waiting[active], picks, 1))
            nodes = np.where(real, np.take_along_axis(found[active], picks, 1), -1)
            flags = done[active]
            np.put_along_axis(flags, picks, True, 1)
            done[active] = flags
            more = np.where(nodes[:, :, None] >= 0, links[nodes], -1).reshape(len(active), -1)
            at = active[:, None]
            more[seen[at, np.maximum(more, 0)] & (more >= 0)] = -1
            # Only one of repeated nodes counts.
            more = np.sort(more, axis=1)
            more[:, 1:][more[:, 1:] == more[:, :-1]] = -1
            seen[at, np.maximum(more, 0)] |= more >= 0
            fresh = np.einsum("qmd,qd->qm", unit[more], queries[active])
            fresh[more < 0] = -np.inf
            all_near = np.concatenate([near[active], fresh], axis=1)
            all_found = np.concatenate([found[active], more], axis=1)
            all_done = np.concatenate([done[active], more < 0], axis=1)
            keep = min(beam, all_near.shape[1])
            if keep > found.shape[1]:
                wider = keep - found.shape[1]
                found = np.pad(found, ((0, 0), (0, wider)), constant_values=-1)
                near = np.pad(near, ((0, 0), (0, wider)), constant_values=-np.inf)
                done = np.pad(done, ((0, 0), (0, wider)), constant_values=True)
            best = np.argpartition(-all_near, keep - 1, axis=1)[:, :keep]
            near[active, :keep] = np.take_along_axis(all_near, best, 1)
            found[active, :keep] = np.take_along_axis(all_found, best, 1)
            done[active, :keep] = np.take_along_axis(all_done, best, 1)

    def _descend(self, queries: np.ndarray, down_to: int) -> np.ndarray:
        """Entry nodes for layer ``down_to``, found in the layers above it."""
        entries = np.zeros((len(queries), 1), np.int64)
        for layer in range(len(self.layers) - 1, down_to, -1):
            found, near = self._beam(self.layers[layer], queries, entries, 4)
            entries = np.take_along_axis(found, near.argmax(axis=1)[:, None], 1)
        return entries

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Nodes (-1: none) and nearness per query, in no order."""
        return self._beam(self.layers[0], queries, self._descend(queries, 0), beam)

    # -- building --

    @classmethod
    def build(cls, unit: np.ndarray, seed: int = 3, beam: int = 48) -> tuple["Graph", np.ndarray]:
        """The graph and, per node, the row it stands for."""
        draws = np.random.default_rng(seed).random(len(unit))
        levels = np.floor(-np.log(np.maximum(draws, 1e-12)) / math.log(WIDTH)).astype(int)
        order = np.argsort(-levels, kind="stable")
        levels, unit = levels[order], np.ascontiguousarray(unit[order])
        top = int(levels[0]) if len(levels) else 0
        graph = cls(unit, [np.empty((0, 0), np.int32)] * (top + 1))
        for layer in range(top, -1, -1):
            size = int((levels >= layer).sum())
            above = int((levels > layer).sum())
            graph._build_layer(layer, size, max(above, min(size, 2 * WIDTH)), beam)
        return graph, order

    def _build_layer(self, layer: int, size: int, first: int, beam: int) -> None:
        width = WIDTH if layer else 2 * WIDTH
        links = np.full((size, width), -1, np.int32)
        self.layers[layer] = links
        unit = self.unit
        # Nodes of the layer above, or the first few, are compared with each other.
        for at in range(0, first, BATCH):
            own = np.arange(at, min(at + BATCH, first))
            near = unit[own] @ unit[:first].T
            count = min(first, 3 * width)
            links[own] = _choose(own, np.argpartition(-near, count - 1, axis=1)[:, :count], unit, width)
        self._link_back(links, np.arange(first), width)
        at = first
        while at < size:
            own = np.arange(at, min(size, at + min(BATCH, max(at, WIDTH))))
            found, _ = self._beam(links, unit[own], self._descend(unit[own], layer), beam)
            near = unit[own] @ unit[own].T
            count = min(len(own), width)
            peers = own[np.argpartition(-near, count - 1, axis=1)[:, :count]]
            links[own] = _choose(own, np.concatenate([found, peers], axis=1), unit, width)
            self._link_back(links, own, width)
            at = int(own[-1]) + 1

    def _link_back(self, links: np.ndarray, own: np.ndarray, width: int) -> None:
        """Give the nodes that ``own`` link to a chance to link back."""
        targets = links[own].ravel()
        sources = np.repeat(own, width)[targets >= 0]
        targets = targets[targets >= 0]
        if not len(targets):
            return
        near = np.einsum("ed,ed->e", self.unit[targets], self.unit[sources])
        order = np.lexsort((-near, targets))
        targets, sources = targets[order], sources[order]
        nodes, starts = np.unique(targets, return_index=True)
        place = np.arange(len(targets)) - np.repeat(starts, np.diff([*starts, len(targets)]))
        few = place < width
        offers = np.full((len(nodes), width), -1, np.int64)
        offers[np.searchsorted(nodes, targets[few]), place[few]] = sources[few]
        for at in range(0, len(nodes), BATCH):
            part = nodes[at : at + BATCH]
            candidates = np.concatenate([links[part].astype(np.int64), offers[at : at + BATCH]], axis=1)
            links[part] = _choose(part, candidates, self.unit, width)

    # -- storage --

    def to_bytes(self, **more: np.ndarray) -> bytes:
        out = io.BytesIO()
        layers = {f"layer{k}": links for k, links in enumerate(self.layers)}
        np.savez(out, unit=self.unit, **layers, **more)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, stored: bytes) -> tuple["Graph", dict[str, np.ndarray]]:
        arrays = dict(np.load(io.BytesIO(stored)))
        layers = [arrays.pop(f"layer{k}") for k in range(sum(name.startswith("layer") for name in arrays))]
        return cls(arrays.pop("unit"), layers), arrays


def links_within(graph: Graph, queries: np.ndarray, least: float, beam: int, target: float):
    """``(query, node)`` pairs with a nearness of at least ``least``, and the
    recall of the last audit.

    Beams are widened twofold for queries whose whole beam is near enough, and
    for all queries as long as an audit of some of them against every node
    finds less than ``target`` of the true pairs.  A beam as wide as the graph
    is replaced by comparing all nodes.
    """
    size = len(graph.unit)
    audited = np.arange(0, len(queries), max(1, len(queries) // 32))
    truth = queries[audited] @ graph.unit.T >= least
    while True:
        pairs = _pairs(graph, queries, least, beam)
        hits = np.zeros(truth.shape, bool)
        mine = np.isin(pairs[0], audited)
        hits[np.searchsorted(audited, pairs[0][mine]), pairs[1][mine]] = True
        recall = (hits & truth).sum() / max(1, truth.sum())
        if recall >= target or beam >= size:
            return pairs, float(recall)
        beam *= 2


def _pairs(graph: Graph, queries: np.ndarray, least: float, beam: int):
    size = len(graph.unit)
    rows, nodes = [], []
    waiting = np.arange(len(queries))
    while len(waiting):
        narrow = []
        for at in range(0, len(waiting), BATCH):
            part = waiting[at : at + BATCH]
            if beam * 4 >= size:
                hit = queries[part] @ graph.unit.T >= least
                r, node = np.nonzero(hit)
                rows.append(part[r])
                nodes.append(node)
                continue
            found, near = graph.search(queries[part], beam)
            hit = near >= least
            full = (hit.sum(axis=1) >= beam) | (hit.all(axis=1) & (found >= 0).all(axis=1))
            narrow.append(part[full])
            r, c = np.nonzero(hit & ~full[:, None])
            rows.append(part[r])
            nodes.append(found[r, c])
        waiting = np.concatenate(narrow) if narrow else np.empty(0, int)
        beam *= 2
    return np.concatenate(rows or [np.empty(0, int)]), np.concatenate(nodes or [np.empty(0, int)])
