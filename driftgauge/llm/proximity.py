"""A robust-pruned directed graph over the vectors of one shard: building and beam search in numpy, many searches side by side.

A vertex gets at most `degree` out-edges, and half as many again may come in from behind. A new vertex searches the graph so far from the entry; the vertices that the search visits are its proposals.
Pruning keeps the nearest proposal, drops every other one that is nearer to it than to the vertex by the factor `slack` (relaxed: a factor above 1 keeps
longer edges than a plain relative neighbourhood), and goes on, so that edges lead in different directions. The edges are then proposed
backwards; a list that has grown by half is pruned to `degree` again in the same way.

Vertices are added in groups that double until they reach `GROUP`; all searches of a group advance together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Vertices that are added, and queries that are searched, together.
GROUP = 256
#: Numbers of one step of pruning (candidates squared, times vertices).
PRUNE_CELLS = 4_000_000


@dataclass
class Graph:
    """points: n x d, float32. edges: a row of vertices for each vertex, -1 where there is none. entry: where searches start."""

    points: np.ndarray
    edges: np.ndarray
    entry: int

    def __post_init__(self):
        self.norms = np.einsum("ij,ij->i", self.points, self.points)


def beam_search(graph: Graph, queries: np.ndarray, width: int, members: int | None = None) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """For each query: the `width` nearest vertices seen (-1 where fewer), unordered, their squared distances, and all vertices visited.

    Visits come as two lists, one array per step: which queries moved, and to which vertex. members: vertices that the graph holds so far.
    """
    n = len(graph.points) if members is None else members
    q = len(queries)
    own = np.einsum("ij,ij->i", queries, queries)
    ids = np.full((q, width), -1, np.int64)
    far = np.full((q, width), np.inf, np.float32)
    open_ = np.full((q, width), np.inf, np.float32)  # distances of vertices not yet visited
    seen = np.zeros((q, n), bool)
    ids[:, 0] = graph.entry
    far[:, 0] = open_[:, 0] = np.maximum(graph.norms[graph.entry] + own - 2 * (queries @ graph.points[graph.entry]), 0)
    seen[:, graph.entry] = True
    active = np.arange(q)
    movers, visits = [], []
    while len(active):
        best = open_[active].argmin(1)
        going = np.isfinite(open_[active, best])
        active, best = active[going], best[going]
        if not len(active):
            break
        node = ids[active, best]
        open_[active, best] = np.inf
        movers.append(active)
        visits.append(node)
        near = graph.edges[node]
        fresh = near >= 0
        fresh &= ~seen[active[:, None], np.where(fresh, near, 0)]
        row, col = np.nonzero(fresh)
        target = near[row, col]
        seen[active[row], target] = True
        apart = np.full(near.shape, np.inf, np.float32)
        apart[row, col] = np.maximum(graph.norms[target] + own[active[row]]
                                     - 2 * np.einsum("ij,ij->i", graph.points[target], queries[active[row]]), 0)
        # Keep the nearest `width` of what was held and what is new; visited ones keep their place but are not open.
        all_ids = np.concatenate([ids[active], np.where(fresh, near, -1)], 1)
        all_far = np.concatenate([far[active], apart], 1)
        all_open = np.concatenate([open_[active], apart], 1)
        keep = np.argpartition(all_far, width - 1, axis=1)[:, :width]
        ids[active] = np.take_along_axis(all_ids, keep, 1)
        far[active] = np.take_along_axis(all_far, keep, 1)
        open_[active] = np.take_along_axis(all_open, keep, 1)
    ids[~np.isfinite(far)] = -1
    return ids, far, movers, visits


def robust_prune(points: np.ndarray, vertices: np.ndarray, candidates: np.ndarray, degree: int, slack: float) -> np.ndarray:
    """Out-edges of each vertex (-1 where fewer), from its row of candidates (-1 where there is none; a vertex twice counts once)."""
    x = points[np.maximum(candidates, 0)]
    d = ((x - points[vertices][:, None, :]) ** 2).sum(2)
    d[(candidates < 0) | (candidates == vertices[:, None])] = np.inf
    norms = np.einsum("bmd,bmd->bm", x, x)
    between = np.maximum(norms[:, :, None] + norms[:, None, :] - 2 * np.matmul(x, x.transpose(0, 2, 1)), 0)
    out = np.full((len(vertices), degree), -1, np.int64)
    alive = d.copy()
    rows = np.arange(len(vertices))
    for k in range(degree):
        best = alive.argmin(1)
        live = np.isfinite(alive[rows, best])
        if not live.any():
            break
        out[live, k] = candidates[rows[live], best[live]]
        # slack * d(best, c) <= d(vertex, c), on squares; the chosen one and its repetitions are at distance 0 of it.
        gone = slack * slack * between[rows, best] <= d
        gone |= candidates == candidates[rows, best][:, None]
        alive[gone & live[:, None]] = np.inf
    return out


def _padded(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct keys, one row of values for each, padded by -1)."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    distinct, start, count = np.unique(keys, return_index=True, return_counts=True)
    out = np.full((len(distinct), int(count.max()) if len(count) else 0), -1, np.int64)
    place = np.arange(len(keys)) - np.repeat(start, count)
    out[np.repeat(np.arange(len(distinct)), count), place] = values
    return distinct, out


def _prune_all(points: np.ndarray, vertices: np.ndarray, candidates: np.ndarray, degree: int, slack: float) -> np.ndarray:
    """robust_prune in steps of bounded memory, rows of like length together."""
    out = np.full((len(vertices), degree), -1, np.int64)
    length = (candidates >= 0).sum(1)
    order, i = np.argsort(-length, kind="stable"), 0
    while i < len(order):
        m = max(int(length[order[i]]), 1)
        j = i + max(1, PRUNE_CELLS // (m * m + m * points.shape[1]))
        part = order[i:j]
        out[part] = robust_prune(points, vertices[part], candidates[part][:, :m], degree, slack)
        i = j
    return out


def build(points: np.ndarray, degree: int = 40, width: int = 64, slack: float = 1.2, seed: int = 11) -> Graph:
    """The graph of distinct points, in a seeded order of insertion; the entry is the point nearest to the mean."""
    points = np.ascontiguousarray(points, np.float32)
    n = len(points)
    room = degree + degree // 2
    edges = np.full((n, room), -1, np.int32)
    if n == 0:
        return Graph(points, edges, 0)
    entry = int(((points - points.mean(0)) ** 2).sum(1).argmin())
    # Vertices are renumbered by insertion, so that the vertices present are always a prefix.
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([[entry], order[order != entry]])
    graph = Graph(points[order], edges, 0)
    done = 1
    while done < n:
        more = np.arange(done, min(n, done + min(GROUP, max(done // 2, 1))))
        _, _, movers, visits = beam_search(graph, graph.points[more], width, done)
        own, proposals = _padded(more[np.concatenate(movers)], np.concatenate(visits))
        edges[own, :degree] = _prune_all(graph.points, own, proposals, degree, slack)
        source, slot = np.nonzero(edges[own] >= 0)
        targets, backward = _padded(edges[own][source, slot], own[source])
        lists = np.concatenate([edges[targets], backward], 1)
        # Lists with room take their new edges as they are; the others are pruned.
        lists = np.take_along_axis(lists, np.argsort(lists < 0, axis=1, kind="stable"), 1)
        long = (lists >= 0).sum(1) > room
        edges[targets[~long]] = np.pad(lists[~long], ((0, 0), (0, max(0, room - lists.shape[1]))), constant_values=-1)[:, :room]
        if long.any():
            edges[targets[long]] = -1
            edges[targets[long], :degree] = _prune_all(graph.points, targets[long], lists[long], degree, slack)
        done = int(more[-1]) + 1
    # Back to the numbers of the caller.
    back = np.full((n, room), -1, np.int32)
    back[order] = np.where(edges >= 0, order[np.maximum(edges, 0)], -1)
    return Graph(points, back, entry)
