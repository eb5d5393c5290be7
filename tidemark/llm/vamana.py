"""A robust-pruned directed graph over unit vectors, built and searched in batches of queries.

Every routine works on a whole batch at a time with array operations.  Points are inserted in batches: a greedy
beam search over the graph so far proposes neighbours, relaxed distance pruning keeps diverse ones, and reverse
edges are added and pruned the same way.
"""

from __future__ import annotations

import numpy as np

DEGREE = 16
BEAM = 32
ALPHA = 1.2
BATCH = 256


def _top(sims: np.ndarray, k: int) -> np.ndarray:
    """Per row the positions of the k largest, in descending order."""
    if sims.shape[1] > k:
        part = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    else:
        part = np.broadcast_to(np.arange(sims.shape[1]), sims.shape).copy()
    order = np.argsort(-np.take_along_axis(sims, part, 1), axis=1, kind="stable")
    return np.take_along_axis(part, order, 1)


def beam_search(x: np.ndarray, graph: np.ndarray, q: np.ndarray, entries: np.ndarray, beam: int = BEAM, expand: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(ids, sims) [len(q), beam]: the best points found for each query, in descending order; -1 where fewer.

    ``entries`` [len(q), e] are the starting points, -1 for none.  Each step expands the ``expand`` best
    points not yet expanded of every query, until none is left in its beam.
    """
    m, n = len(q), len(x)
    seen = np.zeros((m, n), bool)
    ids = np.full((m, beam), -1, np.int64)
    sims = np.full((m, beam), -np.inf, np.float32)
    done = np.ones((m, beam), bool)

    def take(rows: np.ndarray, cand: np.ndarray) -> None:
        """Offer candidates [len(rows), c] to the beams of these rows."""
        nonlocal ids, sims, done
        cand = np.sort(cand, axis=1)
        new = cand >= 0
        new[:, 1:] &= cand[:, 1:] != cand[:, :-1]
        safe = np.where(new, cand, 0)
        new &= ~seen[rows[:, None], safe]
        r, c = np.nonzero(new)
        picked = cand[r, c]
        seen[rows[r], picked] = True
        s = np.full(cand.shape, -np.inf, np.float32)
        s[r, c] = np.einsum("ij,ij->i", x[picked], q[rows[r]])
        all_s = np.concatenate([sims[rows], s], 1)
        best = _top(all_s, beam)
        sims[rows] = np.take_along_axis(all_s, best, 1)
        ids[rows] = np.take_along_axis(np.concatenate([ids[rows], np.where(new, cand, -1)], 1), best, 1)
        done[rows] = np.take_along_axis(np.concatenate([done[rows], ~new], 1), best, 1)

    take(np.arange(m), entries)
    while True:
        rows = np.flatnonzero((~done).any(1))
        if not len(rows):
            return ids, sims
        # beams are in order, so the first open places are the best ones
        place = np.argsort(done[rows], axis=1, kind="stable")[:, :expand]
        open_ = ~np.take_along_axis(done[rows], place, 1)
        at = np.where(open_, np.take_along_axis(ids[rows], place, 1), -1)
        done[rows[:, None], place] = True
        near = np.where(at[:, :, None] >= 0, graph[np.maximum(at, 0)], -1)
        take(rows, near.reshape(len(rows), -1))


def robust_prune(x: np.ndarray, p: np.ndarray, pool: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """[len(p), degree]: of each pool the neighbours to keep, -1 for none.

    The nearest open candidate is kept and closes every candidate that is ``alpha`` times nearer to it than to
    the point itself.  Distance is squared Euclidean, of unit vectors ``2 - 2 cos``.
    """
    pool = np.sort(pool, axis=1)
    open_ = (pool >= 0) & (pool != p[:, None])
    open_[:, 1:] &= pool[:, 1:] != pool[:, :-1]
    v = x[np.maximum(pool, 0)]
    far = 2 - 2 * np.einsum("bld,bd->bl", v, x[p])
    far[~open_] = np.inf
    between = 2 - 2 * np.matmul(v, v.transpose(0, 2, 1))
    kept = np.full((len(p), degree), -1, np.int64)
    row = np.arange(len(p))
    for k in range(degree):
        best = np.argmin(far, axis=1)
        has = np.isfinite(far[row, best])
        if not has.any():
            break
        kept[has, k] = pool[row, best][has]
        closes = alpha * between[row, best] <= far
        closes[row, best] = True
        far[closes & has[:, None]] = np.inf
    return kept


def _add_reverse(x: np.ndarray, graph: np.ndarray, src: np.ndarray, kept: np.ndarray, alpha: float) -> None:
    degree = graph.shape[1]
    r, c = np.nonzero(kept >= 0)
    to, frm = kept[r, c], src[r]
    order = np.argsort(to, kind="stable")
    to, frm = to[order], frm[order]
    nodes, start, count = np.unique(to, return_index=True, return_counts=True)
    # points that many others chose get them in rounds, so that a pool stays small
    for lo in range(0, int(count.max(initial=0)), degree):
        some = np.flatnonzero(count > lo)
        width = np.minimum(count[some] - lo, degree)
        offset = np.arange(width.max())
        new = np.where(offset < width[:, None], frm[np.minimum(start[some, None] + lo + offset, len(frm) - 1)], -1)
        at = nodes[some]
        for i in range(0, len(at), BATCH):
            graph[at[i : i + BATCH]] = robust_prune(x, at[i : i + BATCH], np.concatenate([graph[at[i : i + BATCH]], new[i : i + BATCH]], 1), degree, alpha)


def entry_points(n: int, how_many: int, rng: np.random.Generator) -> np.ndarray:
    return rng.choice(n, size=min(n, how_many), replace=False)


def build(x: np.ndarray, *, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, seed: int = 0, passes: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(graph [n, degree], entries): neighbours of each point, -1 for none, and points to start from.

    Points are inserted in a random order, each batch against the graph of the batches before it; the first
    batch is linked among itself.  ``passes`` above 1 refine the finished graph.
    """
    n = len(x)
    rng = np.random.default_rng(seed)
    graph = np.full((n, degree), -1, np.int64)
    if n <= 1:
        return graph, np.arange(n)
    order = rng.permutation(n)
    first = order[: min(n, BATCH)]
    sims = x[first] @ x[first].T
    pool = first[_top(sims, min(len(first), 2 * beam))]
    kept = robust_prune(x, first, pool, degree, alpha)
    graph[first] = kept
    _add_reverse(x, graph, first, kept, alpha)
    entries = first[: min(len(first), beam // 2)]
    for p in range(passes):
        for i in range(len(first) if p == 0 else 0, n, BATCH):
            batch = order[i : i + BATCH]
            start = np.broadcast_to(entries, (len(batch), len(entries)))
            found, _ = beam_search(x, graph, x[batch], start, beam)
            # a batch is not yet in the graph: its own nearest points are proposed too
            own = batch[_top(x[batch] @ x[batch].T, min(len(batch), beam // 2))]
            kept = robust_prune(x, batch, np.concatenate([found, own, graph[batch]], 1), degree, alpha)
            graph[batch] = kept
            _add_reverse(x, graph, batch, kept, alpha)
    return graph, entries
