"""A hierarchical navigable small-world graph over the unit vectors of one shard, searched for many queries at once.

Nodes are numbered so that the nodes of every higher level come first: level l holds the first n / 16**l of them.  Each
level is built by inserting batches that at most double it; neighbours are found by beam search in what is
there, chosen so that they do not all lie in one direction, and linked back.
"""

import numpy as np

DEGREE, UPPER_DEGREE, FANOUT = 24, 16, 16
BUILD_BEAM, FIRST, BATCH = 40, 128, 1024
EXPAND = 4  # nodes of a beam that one step expands
VISITED_BYTES = 1 << 23
NONE = np.float32(-2)


def level_sizes(n: int) -> list[int]:
    sizes = [n]
    while sizes[-1] > FIRST:
        sizes.append(max(1, sizes[-1] // FANOUT))
    return sizes


def _best(ids: np.ndarray, sims: np.ndarray, k: int):
    """The k most similar of every row, sorted; duplicate ids count once."""
    order = np.argsort(ids, axis=1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    again = np.zeros(ids.shape, bool)
    again[:, 1:] = ids[:, 1:] == ids[:, :-1]
    sims = np.where(again | (ids < 0), NONE, sims)
    top = np.argsort(-sims, axis=1, kind="stable")[:, :k]
    ids, sims = np.take_along_axis(ids, top, 1), np.take_along_axis(sims, top, 1)
    return np.where(sims > NONE, ids, -1), sims


def _diverse(x: np.ndarray, ids: np.ndarray, sims: np.ndarray, degree: int) -> np.ndarray:
    """At most ``degree`` ids of every row (sorted by similarity): first those nearer to the row's node than to any
    chosen before, then the nearest of the others."""
    held = x[np.maximum(ids, 0)]
    between = np.einsum("bid,bjd->bij", held, held)
    chosen, nearest = np.zeros(ids.shape, bool), np.full(ids.shape, NONE)
    for j in range(ids.shape[1]):
        take = (ids[:, j] >= 0) & (sims[:, j] > nearest[:, j]) & (chosen.sum(1) < degree)
        chosen[:, j] = take
        nearest = np.where(take[:, None], np.maximum(nearest, between[:, j]), nearest)
    rank = np.where(ids < 0, 2, np.where(chosen, 0, 1))
    top = np.argsort(rank, axis=1, kind="stable")[:, :degree]
    out = np.take_along_axis(ids, top, 1)
    if out.shape[1] < degree:
        out = np.pad(out, ((0, 0), (0, degree - out.shape[1])), constant_values=-1)
    return out.astype(np.int32)


def beam(x: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, width: int):
    """(ids, similarities) of the ``width`` best nodes found for every query, unsorted, padded with -1."""
    if not len(queries):
        return np.zeros((0, width), np.int32), np.zeros((0, width), np.float32)
    step = max(8, min(512, VISITED_BYTES // max(1, len(links))))
    parts = [
        _beam(x, links, queries[at : at + step], entry[at : at + step], width) for at in range(0, len(queries), step)
    ]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _beam(x, links, queries, entry, width):
    n = len(queries)
    ids, sims, todo = np.full((n, width), -1, np.int32), np.full((n, width), NONE), np.zeros((n, width), bool)
    visited = np.zeros((n, len(links)), bool)
    rows = np.arange(n)
    ids[:, 0], todo[:, 0] = entry, True
    sims[:, 0] = np.einsum("bd,bd->b", queries, x[entry])
    visited[rows, entry] = True
    while len(rows):
        open_sims = np.where(todo[rows], sims[rows], NONE)
        picked = np.argpartition(-open_sims, min(EXPAND, width) - 1, axis=1)[:, :EXPAND]
        real = np.take_along_axis(open_sims, picked, 1) > NONE
        alive = real.any(1)
        rows, picked, real = rows[alive], picked[alive], real[alive]
        if not len(rows):
            break
        todo[rows[:, None], picked] = False
        found = np.where(real[:, :, None], links[np.maximum(ids[rows[:, None], picked], 0)], -1).reshape(len(rows), -1)
        found = np.sort(found, axis=1)
        fresh = found >= 0
        fresh[:, 1:] &= found[:, 1:] != found[:, :-1]
        safe = np.maximum(found, 0)
        fresh &= ~visited[rows[:, None], safe]
        at, column = np.nonzero(fresh)
        visited[rows[at], found[at, column]] = True
        near = np.full(found.shape, NONE)
        near[at, column] = np.einsum("bd,bd->b", queries[rows[at]], x[found[at, column]])
        all_ids = np.concatenate([ids[rows], np.where(fresh, found, -1)], 1)
        all_sims = np.concatenate([sims[rows], near], 1)
        all_todo = np.concatenate([todo[rows], fresh], 1)
        top = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
        ids[rows] = np.take_along_axis(all_ids, top, 1)
        sims[rows] = np.take_along_axis(all_sims, top, 1)
        todo[rows] = np.take_along_axis(all_todo, top, 1)
    return ids, sims


def descend(x: np.ndarray, levels: list[np.ndarray], queries: np.ndarray, lowest: int) -> np.ndarray:
    """Entry nodes for a search on level ``lowest``: the best found on the levels above it."""
    entry = np.zeros(len(queries), np.int64)
    for level in range(len(levels) - 1, lowest, -1):
        ids, sims = beam(x, levels[level], queries, entry, 8)
        entry = ids[np.arange(len(ids)), sims.argmax(1)].astype(np.int64)
    return entry


def build(x: np.ndarray) -> list[np.ndarray]:
    """Neighbour matrices of the levels, lowest first, of unit vectors in their order."""
    sizes = level_sizes(len(x))
    levels: list[np.ndarray] = [np.zeros((0, 0), np.int32)] * len(sizes)
    for level in range(len(sizes) - 1, -1, -1):
        degree, size = DEGREE if level == 0 else UPPER_DEGREE, sizes[level]
        links, done = np.full((size, degree), -1, np.int32), 0
        while done < size:
            end = min(size, max(FIRST, min(2 * done, done + BATCH)))
            batch = x[done:end]
            among = batch @ batch.T
            np.fill_diagonal(among, NONE)
            near = np.argsort(-among, axis=1, kind="stable")[:, : min(BUILD_BEAM, len(batch))]
            ids, sims = near + done, np.take_along_axis(among, near, 1)
            if done:
                entry = descend(x, levels, batch, level)
                entry = np.where(entry < done, entry, 0)
                found, found_sims = beam(x, links[:done], batch, entry, BUILD_BEAM)
                ids, sims = np.concatenate([ids, found], 1), np.concatenate([sims, found_sims], 1)
            ids, sims = _best(np.where(sims > NONE, ids, -1), sims, BUILD_BEAM)
            links[done:end] = _diverse(x, ids, sims, degree)
            _link_back(x, links, np.arange(done, end), degree)
            done = end
        levels[level] = links
    return levels


def _link_back(x: np.ndarray, links: np.ndarray, new: np.ndarray, degree: int) -> None:
    source, target = np.repeat(new, links.shape[1]), links[new].ravel()
    source, target = source[target >= 0], target[target >= 0]
    order = np.lexsort((-np.einsum("bd,bd->b", x[source], x[target]), target))
    source, target = source[order], target[order]
    touched, first, counts = np.unique(target, return_index=True, return_counts=True)
    place = np.arange(len(target)) - np.repeat(first, counts)
    near = place < 2 * degree
    more = np.full((len(touched), 2 * degree), -1, np.int32)
    more[np.repeat(np.arange(len(touched)), counts)[near], place[near]] = source[near]
    ids = np.concatenate([links[touched], more], 1)
    for at in range(0, len(touched), BATCH):
        rows, mine = ids[at : at + BATCH], touched[at : at + BATCH]
        sims = np.where(rows >= 0, np.einsum("bd,bkd->bk", x[mine], x[np.maximum(rows, 0)]), NONE)
        best, best_sims = _best(rows, sims, 2 * degree)
        links[mine] = _diverse(x, best, best_sims, degree)
