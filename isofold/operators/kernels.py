"""Topology of one scalar field in numpy: union-find, merge trees, persistence pairs, links, lower stars."""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np

#: Critical types.
MINIMUM, SADDLE1, SADDLE2, MAXIMUM, DEGENERATE, REGULAR = range(6)


class UnionFind:
    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def union(self, a: int, b: int) -> int:
        a, b = self.find(a), self.find(b)
        self.parent[b] = a
        return a


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest of each node's component under edges (a, b): roots meet the smaller of two, chains are halved."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while not np.array_equal(nxt := label[label], label):
            label = nxt
    return label


def dense_order(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rank of each vertex by (value, offset); NaN counts as 0."""
    order = np.lexsort((offsets, np.nan_to_num(values, nan=0.0)))
    out = np.empty(len(values), np.int64)
    out[order] = np.arange(len(values))
    return out


def adjacency(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, neighbours) of an undirected graph."""
    src, dst = np.concatenate((a, b)), np.concatenate((b, a))
    order = np.argsort(src, kind="stable")
    return np.searchsorted(src[order], np.arange(n + 1)), dst[order]


def _neighbour_lists(starts: np.ndarray, nbrs: np.ndarray) -> list[list[int]]:
    """Each vertex's neighbours as plain lists, which loops read faster than arrays."""
    flat, at = nbrs.tolist(), starts.tolist()
    return [flat[i:j] for i, j in zip(at, at[1:])]


def sweep_pairs(order: np.ndarray, starts: np.ndarray, nbrs: np.ndarray) -> tuple[list[tuple[int, int]], list[int]]:
    """(pairs (extremum, saddle) by the elder rule, extrema that never die) of sublevel sets in `order`'s sense."""
    n = len(order)
    by_rank = np.empty(n, np.int64)
    by_rank[order] = np.arange(n)
    uf, birth, pairs = UnionFind(n), list(range(n)), []
    near, order = _neighbour_lists(starts, nbrs), order.tolist()
    for v in by_rank.tolist():
        lower = {uf.find(u) for u in near[v] if order[u] < order[v]}
        if not lower:
            continue
        elder = min(lower, key=lambda r: order[birth[r]])
        for r in sorted(lower - {elder}, key=lambda r: order[birth[r]], reverse=True):
            pairs.append((birth[r], v))
        for r in lower:
            uf.parent[r] = elder
        uf.parent[v] = elder
    alive = [birth[r] for r in range(n) if uf.find(r) == r]
    return pairs, alive


def merge_tree(order: np.ndarray, starts: np.ndarray, nbrs: np.ndarray) -> tuple[list[tuple[int, int]], dict[int, int], np.ndarray]:
    """(arcs (child, parent), degree below of each node, arc's lower node of each vertex) of the join tree in `order`'s sense.

    Nodes are extrema, merging vertices and each component's last vertex, which is its root.
    """
    n = len(order)
    by_rank = np.empty(n, np.int64)
    by_rank[order] = np.arange(n)
    uf, arcs, down = UnionFind(n), [], {}
    head = np.arange(n)  # the node that a set's top arc starts at
    last = np.arange(n)
    owner = np.full(n, -1, np.int64)
    for v in by_rank.tolist():
        lower = {uf.find(int(u)) for u in nbrs[starts[v] : starts[v + 1]] if order[u] < order[v]}
        if not lower:
            down[v], owner[v] = 0, v
        elif len(lower) == 1:
            r = next(iter(lower))
            uf.parent[v], last[r] = r, v
            owner[v] = head[r]
        else:
            for r in sorted(lower):
                arcs.append((int(head[r]), v))
            down[v], owner[v] = len(lower), v
            keep = min(lower)
            for r in lower:
                uf.parent[r] = keep
            uf.parent[v] = keep
            head[keep] = last[keep] = v
    for r in range(n):
        if uf.find(r) == r and head[r] != last[r]:
            top = int(last[r])
            arcs.append((int(head[r]), top))
            down[top] = 1
    return arcs, down, owner


def contour_tree(n: int, order: np.ndarray, starts: np.ndarray, nbrs: np.ndarray) -> list[tuple[int, int]]:
    """Arcs (lower, upper) between critical vertices of a simply connected domain, from the fully augmented join and split trees.

    Leaves are taken one by one: an upper leaf has no split-tree children and one join-tree child, and the other way round.
    """

    def augmented(rank: np.ndarray) -> tuple[list[int], list[set[int]]]:
        """Parent (the later vertex) and children of each vertex in a sweep."""
        seq = np.argsort(rank)
        uf, top = UnionFind(n), list(range(n))
        parent, children = [-1] * n, [set() for _ in range(n)]
        for v in seq.tolist():
            for r in {uf.find(int(u)) for u in nbrs[starts[v] : starts[v + 1]] if rank[u] < rank[v]}:
                parent[top[r]] = v
                children[v].add(top[r])
                uf.parent[r] = v
            top[uf.find(v)] = v
        return parent, children

    jp, jc = augmented(order)
    sp, sc = augmented(n - 1 - order)
    up, down = defaultdict(set), defaultdict(set)
    queue = [v for v in range(n) if len(jc[v]) + len(sc[v]) == 1]
    gone = [False] * n

    def cut(v: int, parent: list[int], children: list[set[int]]) -> None:
        p = parent[v]
        for c in children[v]:
            parent[c] = p
            if p >= 0:
                children[p].add(c)
        if p >= 0:
            children[p].discard(v)

    while queue:
        v = queue.pop()
        if gone[v] or len(jc[v]) + len(sc[v]) != 1:
            continue
        if not jc[v]:  # a lower leaf: its arc goes up the join tree
            w = jp[v]
            if w < 0:
                continue
            up[v].add(w), down[w].add(v)
        else:
            w = sp[v]
            if w < 0:
                continue
            up[w].add(v), down[v].add(w)
        gone[v] = True
        cut(v, jp, jc), cut(v, sp, sc)
        if len(jc[w]) + len(sc[w]) == 1:
            queue.append(w)
    arcs = []
    for v in range(n):
        if len(up[v]) == 1 and len(down[v]) == 1:
            continue
        for w in up[v]:
            while len(up[w]) == 1 and len(down[w]) == 1:
                w = next(iter(up[w]))
            arcs.append((v, w))
    return arcs


def diagram(order: np.ndarray, starts: np.ndarray, nbrs: np.ndarray, dim: int) -> list[tuple[int, int, int, int, int]]:
    """(birth, death, pair type, birth's critical type, death's) of a field; the global pair once, as type 0. Saddle-saddle pairs are not here."""
    n = len(order)
    low, alive = sweep_pairs(order, starts, nbrs)
    high, tops = sweep_pairs(n - 1 - order, starts, nbrs)
    last = max(dim - 1, 0)
    out = [(b, d, 0, MINIMUM, SADDLE1 if dim > 1 else MAXIMUM) for b, d in low]
    out += [(d, b, last, SADDLE2 if dim > 2 else SADDLE1 if dim > 1 else MINIMUM, MAXIMUM) for b, d in high]
    uf = UnionFind(n)
    src = np.repeat(np.arange(n), np.diff(starts))
    for a, b in zip(src.tolist(), nbrs.tolist()):
        uf.union(a, b)
    top = {uf.find(t): t for t in tops}
    out += [(b, top[uf.find(b)], 0, MINIMUM, MAXIMUM) for b in alive]
    return out


def link_components(vertices: set[int], edges: list[tuple[int, int]]) -> int:
    where = {v: i for i, v in enumerate(vertices)}
    uf = UnionFind(len(where))
    for a, b in edges:
        uf.union(where[a], where[b])
    return sum(uf.find(i) == i for i in range(len(where)))


def critical_type(below: int, above: int, dim: int) -> int:
    """The type of a vertex with so many components of its lower and upper link."""
    if not below:
        return MINIMUM
    if not above:
        return MAXIMUM
    if below == above == 1:
        return REGULAR
    if dim < 3:
        return SADDLE1 if below <= 2 and above <= 2 else DEGENERATE
    return SADDLE1 if (below, above) == (2, 1) else SADDLE2 if (below, above) == (1, 2) else DEGENERATE


def lower_star_gradient(order: np.ndarray, cells: list[list[tuple[int, ...]]]) -> tuple[dict[tuple[int, ...], tuple[int, ...]], list[tuple[int, ...]]]:
    """(pairs face -> coface, critical simplices) of the discrete gradient; cells: simplices by dimension as sorted tuples.

    Each lower star by itself: its vertex takes the edge to the lowest neighbour; what then has one unpaired face left is paired with it,
    the least first, and what has none is critical.
    """
    stars: dict[int, list[tuple[int, ...]]] = defaultdict(list)
    for dim in range(1, len(cells)):
        for s in cells[dim]:
            stars[max(s, key=lambda v: order[v])].append(s)
    pair, critical = {}, []

    def key(s):
        return sorted((int(order[v]) for v in s), reverse=True)

    for (v,) in cells[0]:
        star = set(stars.get(v, ()))
        edges = [s for s in star if len(s) == 2]
        if not edges:
            critical.append((v,))
            continue
        first = min(edges, key=key)
        pair[(v,)] = first
        left = star - {first}
        faces = {s: [f for f in (tuple(x for x in s if x != w) for w in s) if f in star] for s in star}
        cofaces = defaultdict(list)
        for s, fs in faces.items():
            for f in fs:
                cofaces[f].append(s)
        unpaired = {s: sum(f in left for f in faces[s]) for s in star}
        zero = [(key(s), s) for s in left if len(s) == 2]
        one = [(key(s), s) for s in cofaces[first] if s in left and unpaired[s] == 1]
        heapq.heapify(zero), heapq.heapify(one)

        def settle(s):
            left.discard(s)
            for c in cofaces[s]:
                unpaired[c] -= 1
                if c in left and unpaired[c] == 1:
                    heapq.heappush(one, (key(c), c))

        while one or zero:
            while one:
                _, s = heapq.heappop(one)
                if s not in left:
                    continue
                free = [f for f in faces[s] if f in left]
                if not free:
                    heapq.heappush(zero, (key(s), s))
                    continue
                pair[free[0]] = s
                settle(free[0]), settle(s)
            while zero:
                _, s = heapq.heappop(zero)
                if s in left:
                    critical.append(s)
                    settle(s)
                    break
    return pair, critical


def simplify(values: np.ndarray, order: np.ndarray, starts: np.ndarray, nbrs: np.ndarray, keep: set[int], rounds: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(values, order) changed as little as flooding needs for only the extrema in `keep` to remain.

    Upward: vertices are reached from the kept minima, lowest first, and raised to what they are reached over; downward the same from the
    kept maxima; again, until no other extremum is left, or nothing changes (then a component has none to keep). A ValueError says that `rounds`, by
    default one for each vertex, didn't do.
    """
    n = len(order)
    near = _neighbour_lists(starts, nbrs)
    values, order, extrema = values.astype(float).copy(), order.copy(), []
    for _ in range(n + 1 if rounds is None else rounds):
        before = order.copy()
        for sign in (1, -1):
            rank = (order if sign > 0 else n - 1 - order).tolist()
            lows = [v for v in range(n) if all(rank[u] > rank[v] for u in near[v])]
            seeds = [v for v in lows if v in keep] or ([int(np.argmin(rank))] if n else [])
            heap, seen, turn = [(rank[v], v) for v in seeds], set(seeds), []
            heapq.heapify(heap)
            level, old = -np.inf, values.tolist()
            new = list(old)
            while heap:
                _, v = heapq.heappop(heap)
                turn.append(v)
                level = max(level, sign * old[v])
                new[v] = sign * level
                for u in near[v]:
                    if u not in seen:
                        seen.add(u)
                        heapq.heappush(heap, (rank[u], u))
            rest = [v for v in range(n) if v not in seen]  # components without a seed stay
            full = sorted(turn + rest, key=lambda v: (sign * new[v], 0)) if rest else turn
            order = np.empty(n, np.int64)
            order[np.array(full, np.int64)] = np.arange(n) if sign > 0 else n - 1 - np.arange(n)
            values = np.array(new, float)
        rank = order.tolist()
        extrema = [v for v in range(n) if len({rank[u] > rank[v] for u in near[v]}) <= 1]
        if all(v in keep for v in extrema) or (order == before).all():
            return values, order
    raise ValueError(f"extrema that aren't to be kept are left after as many rounds as were allowed: {len(set(extrema) - keep) or 'not counted'}")
