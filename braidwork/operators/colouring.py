"""Vertex colouring of small graphs given as adjacency bit sets."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

#: Up to so many vertices the least number of colours is found exactly.
EXACT = 15


def bits(x: int) -> Iterator[int]:
    while x:
        low = x & -x
        yield low.bit_length() - 1
        x ^= low


def maximal_independent_sets(adj: list[int], within: int) -> Iterator[int]:
    """Every maximal independent set of the vertices `within`, once."""

    def grow(chosen: int, open_: int, closed: int) -> Iterator[int]:
        if not open_ and not closed:
            yield chosen
            return
        pivot = max(bits(open_ | closed), key=lambda v: (open_ & ~adj[v] & ~(1 << v)).bit_count())
        for v in bits(open_ & (adj[pivot] | (1 << pivot))):
            stay = ~adj[v] & ~(1 << v)
            yield from grow(chosen | (1 << v), open_ & stay, closed & stay)
            open_ &= ~(1 << v)
            closed |= 1 << v

    yield from grow(0, within, 0)


def exact_colours(adj: list[int]) -> list[int]:
    """A colouring with as few colours as can be: the best over subsets, one independent set at a time."""
    n = len(adj)
    fewest = [0] + [n + 1] * ((1 << n) - 1)
    last = [0] * (1 << n)
    for subset in range(1, 1 << n):
        for chosen in maximal_independent_sets(adj, subset):
            if fewest[subset & ~chosen] + 1 < fewest[subset]:
                fewest[subset], last[subset] = fewest[subset & ~chosen] + 1, chosen
    colour, rest, k = [0] * n, (1 << n) - 1, 0
    while rest:
        for v in bits(last[rest]):
            colour[v] = k
        rest, k = rest & ~last[rest], k + 1
    return colour


def greedy_colours(adj: list[int], order: list[int]) -> list[int]:
    """First fit."""
    colour = [-1] * len(adj)
    for v in order:
        used = {colour[u] for u in bits(adj[v])}
        colour[v] = next(k for k in range(len(adj) + 1) if k not in used)
    return colour


def interchange_colours(adj: list[int], order: list[int]) -> list[int]:
    """First fit that, before it takes a new colour, tries to free one by exchanging two colours in one connected piece."""
    colour = [-1] * len(adj)
    most = -1
    for v in order:
        near = {colour[u] for u in bits(adj[v])} - {-1}
        k = next(c for c in range(len(adj) + 1) if c not in near)
        if k > most and most >= 1:
            k = _freed(adj, colour, v, most, k)
        colour[v] = k
        most = max(most, k)
    return colour


def _freed(adj: list[int], colour: list[int], v: int, most: int, fresh: int) -> int:
    near = list(bits(adj[v]))
    for a in range(most + 1):
        for b in range(a + 1, most + 1):
            with_a, with_b = [u for u in near if colour[u] == a], {u for u in near if colour[u] == b}
            piece, queue = set(with_a), deque(with_a)
            while queue:
                for u in bits(adj[queue.popleft()]):
                    if colour[u] in (a, b) and u not in piece:
                        piece.add(u)
                        queue.append(u)
            if not piece & with_b:
                for u in piece:
                    colour[u] = a + b - colour[u]
                return a
    return fresh


def by_degree(adj: list[int]) -> list[int]:
    return sorted(range(len(adj)), key=lambda v: (-adj[v].bit_count(), v))


def least_first(adj: list[int]) -> list[int]:
    """The vertex of least degree among those left comes last."""
    rest, out = (1 << len(adj)) - 1, []
    while rest:
        v = min(bits(rest), key=lambda v: ((adj[v] & rest).bit_count(), v))
        out.append(v)
        rest &= ~(1 << v)
    return out[::-1]


def shuffled(adj: list[int], seed: int) -> list[int]:
    """A seeded random permutation."""
    out, state = list(range(len(adj))), seed
    for k in range(len(out) - 1, 0, -1):
        state = (state * 6364136223846793005 + 1442695040888963407) % 2**64
        j = (state >> 33) % (k + 1)
        out[k], out[j] = out[j], out[k]
    return out


def walked(adj: list[int], depth_first: bool) -> list[int]:
    """Depth-first or breadth-first, pieces from their vertex of most neighbours."""
    out: list[int] = []
    seen: set[int] = set()
    for s in by_degree(adj):
        queue = deque([s])
        while queue:
            v = queue.pop() if depth_first else queue.popleft()
            if v not in seen:
                seen.add(v)
                out.append(v)
                queue.extend(u for u in bits(adj[v]) if u not in seen)
    return out


def colours(adj: list[int]) -> list[int]:
    """Few colours: exact for small graphs, else the best of several orders, done once the lower bound is met."""
    if not adj:
        return []
    if len(adj) <= EXACT and sum(a.bit_count() for a in adj) * 2.44225 ** len(adj) <= 2**22:
        return exact_colours(adj)
    least = 2 if any(adj) else 1
    best: list[int] = []
    orders = (by_degree, least_first, lambda a: walked(a, True), lambda a: walked(a, False), lambda a: shuffled(a, 1), lambda a: shuffled(a, 2))
    for order in orders:
        for method in (greedy_colours, interchange_colours):
            found = method(adj, order(adj))
            if not best or max(found) < max(best):
                best = found
            if max(best) + 1 == least:
                return best
    return best
