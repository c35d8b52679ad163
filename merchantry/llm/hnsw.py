"""A hierarchical navigable small-world graph over unit vectors, built and searched in blocks.

Nodes come in random order, and level ``l`` holds the first ``n / LINKS^l`` of them. Nodes are inserted
in batches: a batch descends greedily to its highest level and looks there and below for its
nearest nodes with a beam, and among itself; links go to a varied choice of them (a node is left out
when it is nearer to one already chosen) and back, where a full list is chosen anew. All queries of a
block take a step of the beam search together, as array operations.
"""
from __future__ import annotations

import numpy as np

LINKS = 16                     # links of a node on the upper levels, twice as many on level 0
BUILD_BEAM = 64
STEP = 4                       # beam entries expanded at once
SEEN_BYTES = 1 << 23           # flags of seen nodes of a block of queries


def level_sizes(n: int) -> list[int]:
    """Nodes of each level, from level 0."""
    sizes = [n]
    while sizes[-1] > LINKS:
        sizes.append(-(-sizes[-1] // LINKS))
    return sizes


def width(level: int) -> int:
    return LINKS if level else 2 * LINKS


def _block(n: int) -> int:
    return int(np.clip(SEEN_BYTES // max(n, 1), 16, 512))


def beam_search(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, beam: int
                ) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, similarities) of the ``beam`` best nodes found for each query, best first, -1 where
    there are fewer. ``entry`` has columns of start nodes."""
    nodes = np.full((len(queries), beam), -1, dtype=np.int32)
    sims = np.full((len(queries), beam), -np.inf, dtype=np.float32)
    size = _block(len(links))
    for at in range(0, len(queries), size):
        to = min(at + size, len(queries))
        nodes[at:to], sims[at:to] = _search_block(vectors, links, queries[at:to], entry[at:to], beam)
    return nodes, sims


def _similar(vectors, queries, nodes):
    """Similarity of each query to its row of nodes, -inf for node -1."""
    s = np.matmul(vectors[nodes], queries[:, :, None])[:, :, 0]
    s[nodes < 0] = -np.inf
    return s


def _once(nodes: np.ndarray) -> np.ndarray:
    """Rows sorted, repeated nodes set to -1."""
    nodes = np.sort(nodes, axis=1)
    nodes[:, 1:][nodes[:, 1:] == nodes[:, :-1]] = -1
    return nodes


def _search_block(vectors, links, queries, entry, beam):
    count = len(queries)
    seen = np.zeros((count, len(links) + 1), dtype=bool)      # the last column stands for node -1
    seen[:, -1] = True
    best = np.full((count, beam), -1, dtype=np.int32)
    score = np.full((count, beam), -np.inf, dtype=np.float32)
    spread = np.ones((count, beam), dtype=bool)               # already expanded, or nothing there
    live, fresh = np.arange(count), _once(entry.astype(np.int32))
    while len(live):
        rows = live[:, None]
        fresh = np.where(seen[rows, fresh], -1, fresh)
        seen[rows, fresh] = True
        s = np.concatenate([score[live], _similar(vectors, queries[live], fresh)], axis=1)
        both = np.concatenate([best[live], fresh], axis=1)
        done = np.concatenate([spread[live], fresh < 0], axis=1)
        order = np.argsort(-s, axis=1, kind="stable")[:, :beam]
        best[live], score[live] = np.take_along_axis(both, order, 1), np.take_along_axis(s, order, 1)
        done = np.take_along_axis(done, order, 1) | (best[live] < 0)
        turn = ~done & (np.cumsum(~done, axis=1) <= STEP)
        spread[live] = done | turn
        going = turn.any(axis=1)
        live, turn = live[going], turn[going]
        first = np.argsort(~turn, axis=1, kind="stable")[:, :STEP]
        picked = np.where(np.take_along_axis(turn, first, 1), np.take_along_axis(best[live], first, 1), -1)
        fresh = links[picked].reshape(len(live), picked.shape[1] * links.shape[1])
        fresh[np.repeat(picked < 0, links.shape[1], axis=1)] = -1
        fresh = _once(fresh)
    return best, score


def varied(vectors: np.ndarray, nodes: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Per row up to ``most`` of ``nodes`` (nearest first, -1 for none): one is left out when it is nearer to
    a chosen one than to the row's own node; then the nearest left-out ones fill up."""
    out = np.full((len(nodes), most), -1, dtype=np.int32)
    size = max(1, (1 << 22) // (nodes.shape[1] ** 2 + 1))
    for at in range(0, len(nodes), size):
        part, near = nodes[at:at + size], sims[at:at + size]
        v = vectors[part]
        among = np.matmul(v, v.transpose(0, 2, 1))
        chosen = np.zeros(part.shape, dtype=bool)
        for j in range(part.shape[1]):
            rival = np.where(chosen, among[:, j], -np.inf).max(axis=1)
            chosen[:, j] = (part[:, j] >= 0) & (rival < near[:, j]) & (chosen.sum(axis=1) < most)
        rank = np.where(chosen, 0, np.where(part >= 0, 1, 2))
        order = np.argsort(rank, axis=1, kind="stable")[:, :most]
        kept = np.where(np.take_along_axis(rank, order, 1) < 2, np.take_along_axis(part, order, 1), -1)
        out[at:at + size, :kept.shape[1]] = kept
    return out


def _link_back(vectors, links, first: int, to: int):
    """Adds the links of nodes ``first`` to ``to`` to the other ends' lists."""
    source = np.repeat(np.arange(first, to, dtype=np.int32), links.shape[1])
    target = links[first:to].ravel()
    source, target = source[target >= 0], target[target >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    nodes, start, count = np.unique(target, return_index=True, return_counts=True)
    # lists with few and with many new links apart, so that the padding stays small
    for low, high in ((0, 8), (8, 64), (64, np.inf)):
        pick = (count > low) & (count <= high)
        if not pick.any():
            continue
        own, n, begin = nodes[pick], count[pick], start[pick]
        new = np.full((len(own), n.max()), -1, dtype=np.int32)
        slot = np.arange(n.max()) < n[:, None]
        new[slot] = source[np.repeat(begin, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        size = max(1, (1 << 20) // (links.shape[1] + new.shape[1]))
        for at in range(0, len(own), size):
            node = own[at:at + size]
            both = _once(np.concatenate([links[node], new[at:at + size]], axis=1))
            sims = _similar(vectors, vectors[node], both)
            order = np.argsort(-sims, axis=1, kind="stable")
            both, sims = np.take_along_axis(both, order, 1), np.take_along_axis(sims, order, 1)
            room = (both >= 0).sum(axis=1) <= links.shape[1]
            links[node[room]] = both[room][:, :links.shape[1]]
            if not room.all():
                links[node[~room]] = varied(vectors, both[~room], sims[~room], links.shape[1])


class Graph:
    """``vectors`` (float32 rows of length 1) and, per level, the links of its nodes (-1 for none)."""

    def __init__(self, vectors: np.ndarray, links: list[np.ndarray]):
        self.vectors, self.links = vectors, links

    @classmethod
    def build(cls, vectors: np.ndarray) -> "Graph":
        sizes = level_sizes(len(vectors))
        links = [np.full((m, width(level)), -1, dtype=np.int32) for level, m in enumerate(sizes)]
        graph, first = cls(vectors, links), 0
        while first < len(vectors):
            # a batch is at most as large as the graph so far and lies within one top level
            to = min(max(1, 2 * first), first + 1024, min(m for m in sizes if m > first))
            graph._insert(first, to, sum(m > first for m in sizes) - 1)
            first = to
        return graph

    def _insert(self, first: int, to: int, top: int):
        new = self.vectors[first:to]
        entry = self._descend(new, top, first) if first else None
        among = new @ new.T
        np.fill_diagonal(among, -np.inf)
        near = np.argsort(-among, axis=1, kind="stable")[:, :BUILD_BEAM // 2]
        own, own_sims = (near + first).astype(np.int32), np.take_along_axis(among, near, 1)
        own[~np.isfinite(own_sims)] = -1
        for level in range(top, -1, -1):
            nodes, sims = own, own_sims
            if first:
                found, near = beam_search(self.vectors, self.links[level][:first], new, entry, BUILD_BEAM)
                entry = found[:, :1]
                nodes, sims = np.concatenate([found, own], axis=1), np.concatenate([near, own_sims], axis=1)
                order = np.argsort(-sims, axis=1, kind="stable")[:, :BUILD_BEAM]
                nodes, sims = np.take_along_axis(nodes, order, 1), np.take_along_axis(sims, order, 1)
            self.links[level][first:to, :LINKS] = varied(self.vectors, nodes, sims, LINKS)
            _link_back(self.vectors, self.links[level], first, to)

    def _descend(self, queries: np.ndarray, level: int, nodes: int | None = None) -> np.ndarray:
        """Start nodes on ``level``: the nearest ones found on the levels above."""
        entry = np.zeros((len(queries), 1), dtype=np.int32)
        for upper in range(len(self.links) - 1, level, -1):
            links = self.links[upper][:nodes] if nodes else self.links[upper]
            entry = beam_search(self.vectors, links, queries, entry, 2 * STEP)[0]
        return entry

    def search(self, queries: np.ndarray, beam: int, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` best nodes found on level 0 and their similarities; ``start`` has further start nodes."""
        entry = self._descend(queries, 0)
        if start is not None:
            entry = np.concatenate([entry, start[:, None]], axis=1)
        return beam_search(self.vectors, self.links[0], queries, entry, beam)
