"""A hierarchical navigable small-world graph of one shard, as flat neighbour arrays.

Layer 0 holds all vectors, each higher layer about one in M of the layer below. A layer's links
are an int32 array, a row of neighbours per vector, -1 where there are fewer. Insertions and
searches go in batches whose members take each step together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Links of a vector (twice as many in layer 0); breadth of the search when it is inserted.
M, EF_BUILD, BATCH = 16, 64, 256


@dataclass
class Graph:
    points: np.ndarray  # float32, vectors lifted so that the nearest has the largest inner product
    links: list[np.ndarray]  # by layer


def lifted(vectors: np.ndarray) -> np.ndarray:
    """Vectors, the longest scaled to length 1, with one more coordinate that gives all the same length: then nearest to (q, 0) is largest inner product with q.

    Meant for vectors whose lengths are not far apart, as beside a far longer one the rest would be all alike.
    """
    scaled = vectors / max(np.abs(vectors).max(initial=0.0), np.finfo(float).tiny)
    norms = (scaled**2).sum(axis=1)
    longest = max(norms.max(initial=0.0), np.finfo(float).tiny)
    return np.column_stack([scaled / np.sqrt(longest), np.sqrt(np.maximum(0, 1 - norms / longest))]).astype(np.float32)


def _distance(points: np.ndarray, ids: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Squared distances of points[ids] (queries x n) to the queries."""
    p = points[ids]
    return ((p - queries[:, None, :]) ** 2).sum(axis=2)


def search_layer(points: np.ndarray, links: np.ndarray, queries: np.ndarray, entries: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """The ef points nearest found to each query, from its entry: ids (-1: none) and squared distances, nearest first."""
    n = len(queries)
    ids, near = np.full((n, ef), -1, np.int64), np.full((n, ef), np.inf, np.float32)
    ids[:, 0], near[:, 0] = entries, _distance(points, entries[:, None], queries)[:, 0]
    done = np.zeros((n, ef), bool)
    seen = np.zeros((n, len(points)), bool)
    seen[np.arange(n), entries] = True
    on = np.arange(n)
    while len(on):
        ahead = np.where(done[on], np.inf, near[on])
        best = ahead.argmin(axis=1)
        going = np.isfinite(ahead[np.arange(len(on)), best])
        on, best = on[going], best[going]
        if not len(on):
            break
        done[on, best] = True
        next_to = links[ids[on, best]]
        fresh = (next_to >= 0) & ~seen[on[:, None], next_to]
        r, c = np.nonzero(fresh)
        to = next_to[r, c]
        seen[on[r], to] = True
        d = np.full(next_to.shape, np.inf, np.float32)
        d[r, c] = ((points[to] - queries[on[r]]) ** 2).sum(axis=1)
        all_d = np.concatenate([near[on], d], axis=1)
        order = np.argsort(all_d, axis=1, kind="stable")[:, :ef]
        near[on] = np.take_along_axis(all_d, order, 1)
        ids[on] = np.take_along_axis(np.concatenate([ids[on], np.where(fresh, next_to, -1)], axis=1), order, 1)
        done[on] = np.take_along_axis(np.concatenate([done[on], np.zeros(fresh.shape, bool)], axis=1), order, 1)
    return ids, near


def chosen(points: np.ndarray, ids: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
    """Of candidates (rows, nearest first, -1: none) up to ``most`` each: those nearer to the centre than to any chosen before, then the nearest of the rest."""
    n, width = ids.shape
    p = points[np.maximum(ids, 0)]
    sq = (p**2).sum(axis=2)
    between = sq[:, :, None] + sq[:, None, :] - 2 * np.matmul(p, p.transpose(0, 2, 1))
    closest, taken, count = np.full((n, width), np.inf, np.float32), np.zeros((n, width), bool), np.zeros(n, int)
    for c in range(width):
        ok = (ids[:, c] >= 0) & (near[:, c] < closest[:, c]) & (count < most)
        taken[ok, c] = True
        count += ok
        closest[ok] = np.minimum(closest[ok], between[ok, c])
    rank = np.where(ids < 0, 2, np.where(taken, 0, 1)) * width + np.arange(width)
    order = np.argsort(rank, axis=1)[:, :most]
    out = np.take_along_axis(ids, order, 1)
    return out if out.shape[1] == most else np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)


def _link_back(points: np.ndarray, links: np.ndarray, new: np.ndarray, to: np.ndarray) -> None:
    """Add new -> to in reverse: each ``to`` gets ``new``; where its row is full, the links are chosen anew."""
    most = links.shape[1]
    order = np.argsort(to, kind="stable")
    new, to = new[order], to[order]
    nodes, starts, counts = np.unique(to, return_index=True, return_counts=True)
    for first in range(0, int(counts.max()), most):
        some = counts > first
        u, at, k = nodes[some], starts[some] + first, np.minimum(counts[some] - first, most)
        extra = np.full((len(u), int(k.max())), -1, np.int64)
        inside = np.arange(extra.shape[1])[None, :] < k[:, None]
        extra[inside] = new[(at[:, None] + np.arange(extra.shape[1])[None, :])[inside]]
        extra[(extra[:, :, None] == links[u][:, None, :]).any(axis=2)] = -1  # linked already, from either end
        both = np.concatenate([links[u], extra], axis=1)
        near = np.where(both < 0, np.inf, _distance(points, np.maximum(both, 0), points[u]))
        order = np.argsort(near, axis=1, kind="stable")
        links[u] = chosen(points, np.take_along_axis(both, order, 1), np.take_along_axis(near, order, 1), most)


def build(vectors: np.ndarray, m: int = M, ef: int = EF_BUILD) -> Graph:
    """The graph of vectors in the order in which they stand, the first of which are in the higher layers; distinct vectors keep it connected."""
    points = lifted(vectors)
    n = len(points)
    sizes = [n]
    while sizes[-1] > 2 * m:
        sizes.append(max(1, sizes[-1] // m))
    upper: list[np.ndarray] = []
    for size in reversed(sizes):
        links = np.full((size, 2 * m if size == n else m), -1, np.int32)
        start = 1
        while start < size:
            batch = np.arange(start, min(size, start + BATCH, 2 * start))
            queries = points[batch]
            entries = descend(points, upper, queries)
            ids, near = search_layer(points[:start], links, queries, np.where(entries < start, entries, 0), min(ef, start))
            # Those inserted together are candidates of one another.
            among = ((queries[:, None, :] - queries[None, :, :]) ** 2).sum(axis=2)
            np.fill_diagonal(among, np.inf)
            closest = np.argsort(among, axis=1)[:, : min(8, len(batch) - 1)]
            ids = np.concatenate([ids, batch[closest]], axis=1)
            near = np.concatenate([near, np.take_along_axis(among, closest, 1)], axis=1)
            order = np.argsort(near, axis=1, kind="stable")
            to = chosen(points, np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1), m)
            links[batch, :m] = to
            r, c = np.nonzero(to >= 0)
            _link_back(points, links, batch[r], to[r, c])
            start = int(batch[-1]) + 1
        upper.append(links)
    return Graph(points, upper[::-1])


def descend(points: np.ndarray, upper: list[np.ndarray], queries: np.ndarray) -> np.ndarray:
    """Entries for the layer below ``upper`` (highest first)."""
    at = np.zeros(len(queries), np.int64)
    for links in upper:
        at = search_layer(points[: len(links)], links, queries, at, 16)[0][:, 0]
    return at


def search(graph: Graph, queries: np.ndarray, ef: int) -> np.ndarray:
    """Ids of the ef points with the largest inner product found for each query (not zero), -1 where there are fewer; the length of a query is of no account."""
    q = queries / np.abs(queries).max(axis=1, keepdims=True)
    q = np.column_stack([q / np.sqrt((q**2).sum(axis=1, keepdims=True)), np.zeros(len(q))]).astype(np.float32)
    found = []
    for i in range(0, len(q), BATCH):
        part = q[i : i + BATCH]
        found.append(search_layer(graph.points, graph.links[0], part, descend(graph.points, graph.links[:0:-1], part), ef)[0])
    return np.concatenate(found) if found else np.zeros((0, ef), np.int64)
