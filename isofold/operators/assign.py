"""Assignment kernels in numpy, free of Spark."""

from __future__ import annotations

import numpy as np


def hungarian(cost: np.ndarray) -> tuple[np.ndarray, float]:
    """(column of each row, total) of the cheapest assignment of all rows to different columns; rows <= columns."""
    n, m = cost.shape
    if n > m:
        raise ValueError("more rows than columns")
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    row_of = np.zeros(m + 1, np.int64)
    for i in range(1, n + 1):
        row_of[0] = i
        j = 0
        least, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, np.int64), np.zeros(m + 1, bool)
        while True:
            used[j] = True
            r = row_of[j]
            free = ~used[1:]
            slack = cost[r - 1] - u[r] - v[1:]
            better = free & (slack < least[1:])
            least[1:][better], way[1:][better] = slack[better], j
            masked = np.where(free, least[1:], np.inf)
            k = int(np.argmin(masked)) + 1
            delta = masked[k - 1]
            u[row_of[used]] += delta
            v[used] -= delta
            least[1:][free] -= delta
            j = k
            if row_of[j] == 0:
                break
        while j:
            row_of[j] = row_of[way[j]]
            j = way[j]
    out = np.zeros(n, np.int64)
    for j in range(1, m + 1):
        if row_of[j]:
            out[row_of[j] - 1] = j - 1
    return out, float(cost[np.arange(n), out].sum()) if n else 0.0


def diagonal_assignment(cost: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> tuple[list[tuple[int, int, float]], float]:
    """The cheapest matching in which any row and column may also go unmatched at its own cost: [(i or -1, j or -1, cost)], total."""
    n, m = len(rows), len(columns)
    if n > m:
        flipped, total = diagonal_assignment(cost.T, columns, rows)
        return [(j, i, c) for i, j, c in flipped], total
    # against all columns unmatched, a match saves its column's cost; a row may also take a column of its own
    full = np.concatenate((cost.reshape(n, m) - columns[None, :], np.repeat(np.asarray(rows, float)[:, None], n, 1)), 1)
    to, gain = hungarian(full) if n else (np.zeros(0, np.int64), 0.0)
    out = [(i, int(to[i]), float(cost[i, to[i]])) if to[i] < m else (i, -1, float(rows[i])) for i in range(n)]
    taken = set(to[to < m].tolist())
    out += [(-1, j, float(columns[j])) for j in range(m) if j not in taken]
    return out, float(np.sum(columns)) + gain


def _augmenting(allowed: list[np.ndarray], n_columns: int) -> np.ndarray:
    owner = np.full(n_columns, -1, np.int64)
    for start in range(len(allowed)):
        seen = np.zeros(n_columns, bool)
        stack, path = [(start, iter(allowed[start].tolist()))], []
        while stack:
            row, it = stack[-1]
            column = next((c for c in it if not seen[c]), None)
            if column is None:
                stack.pop()
                if path:
                    path.pop()
                continue
            seen[column] = True
            path.append((row, column))
            if owner[column] < 0:
                for r, c in path:
                    owner[c] = r
                break
            stack.append((int(owner[column]), iter(allowed[int(owner[column])].tolist())))
        else:
            return np.zeros(0, np.int64)
    return owner


def bottleneck(cost: np.ndarray) -> tuple[np.ndarray, float]:
    """(column of each row, largest cost) of an assignment of a square matrix whose largest cost is least."""
    n = len(cost)
    if not n:
        return np.zeros(0, np.int64), 0.0
    values = np.unique(cost)
    lo, hi = 0, len(values) - 1
    while lo < hi:
        mid = (lo + hi) // 2
        if len(_augmenting([np.flatnonzero(r <= values[mid]) for r in cost], n)):
            hi = mid
        else:
            lo = mid + 1
    owner = _augmenting([np.flatnonzero(r <= values[lo]) for r in cost], n)
    out = np.zeros(n, np.int64)
    out[owner] = np.arange(n)
    return out, float(values[lo])
