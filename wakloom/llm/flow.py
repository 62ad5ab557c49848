"""Giving bundles of equal components to splits by a min-cost flow.

A bundle is the components of one label and one size. Each split has a quota of
rows over all and one within each label; rows over or under a quota cost
OVERALL and WITHIN each. Every bundle first gives each split the whole
components its share holds. What is left, fewer components a bundle than there
are splits, is placed by flows with the bundles as nodes, one for each size,
largest first: a bundle offers its components, arcs of one component each cost
what that component changes in the deviations, so the flow is integral. At the
end two splits exchange components, one or one against one, while that lessens
the cost.

There are at most as many bundles of a label as the square root of twice its
rows, since unlike sizes add up: few beside the rows at any scale.
"""

from __future__ import annotations

import bisect
import heapq
import math
from collections import defaultdict
from fractions import Fraction

_MORE = 10**18
OVERALL, WITHIN = 10, 1


class Network:
    def __init__(self) -> None:
        self.to: list[int] = []
        self.cap: list[int] = []
        self.cost: list[int] = []
        self.out: dict[int, list[int]] = defaultdict(list)

    def edge(self, a: int, b: int, cap: int, cost: int) -> int:
        for x, y, c, k in ((a, b, cap, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.cap.append(c)
            self.cost.append(k)
        return len(self.to) - 2

    def send(self, s: int, t: int) -> int:
        """All that fits, at least cost, for arcs that cost nothing or more."""
        height: dict[int, int] = defaultdict(int)
        total = 0
        while True:
            far, via, heap = {s: 0}, {}, [(0, s)]
            while heap:
                d, v = heapq.heappop(heap)
                if d > far[v]:
                    continue
                for e in self.out[v]:
                    if self.cap[e]:
                        u = self.to[e]
                        n = d + self.cost[e] + height[v] - height[u]
                        if n < far.get(u, _MORE):
                            far[u], via[u] = n, e
                            heapq.heappush(heap, (n, u))
            if t not in far:
                return total
            top = far[t]
            for v in list(self.out):
                height[v] += min(far.get(v, top), top)
            v, most = t, _MORE
            while v != s:
                most = min(most, self.cap[via[v]])
                v = self.to[via[v] ^ 1]
            v = t
            while v != s:
                self.cap[via[v]] -= most
                self.cap[via[v] ^ 1] += most
                v = self.to[via[v] ^ 1]
            total += most


class Plan:
    """How many components of each bundle each split has, and what rows the splits lack."""

    def __init__(self, bundles: list[tuple[str, int, int]], shares: list[Fraction]) -> None:
        self.bundles, self.shares, self.splits = bundles, shares, range(len(shares))
        rows: dict[str, int] = defaultdict(int)
        for label, size, n in bundles:
            rows[label] += size * n
        # Rows are counted in units in which all quotas are whole.
        self.unit = math.lcm(*(f.denominator for f in shares))
        total = sum(rows.values())
        self.lack = [int(total * f * self.unit) for f in shares]
        self.within = {x: [int(n * f * self.unit) for f in shares] for x, n in rows.items()}
        self.given = [[0] * len(shares) for _ in bundles]

    def give(self, b: int, s: int, n: int) -> None:
        label, size, _ = self.bundles[b]
        self.given[b][s] += n
        self.lack[s] -= n * size * self.unit
        self.within[label][s] -= n * size * self.unit

    def step(self, lack: int, size: int) -> int:
        """What size more rows change in how far a split is from its quota."""
        return abs(lack - size * self.unit) - abs(lack)

    def place_rest(self) -> None:
        """The flows, size by size."""
        by_size = defaultdict(list)
        for b, (_, size, n) in enumerate(self.bundles):
            for s, f in enumerate(self.shares):
                self.give(b, s, int(n * f))
            if sum(self.given[b]) < n:
                by_size[size].append(b)
        for size in sorted(by_size, reverse=True):
            self._flow(size, by_size[size])

    def _flow(self, size: int, open_: list[int]) -> None:
        net, z = Network(), size * self.unit
        split = {s: 2 + len(open_) + s for s in self.splits}
        rest = [self.bundles[b][2] - sum(self.given[b]) for b in open_]
        arcs = []
        for i, b in enumerate(open_):
            net.edge(0, 2 + i, rest[i], 0)
            lack = self.within[self.bundles[b][0]]
            for s in self.splits:
                for j in range(rest[i]):
                    arcs.append((b, s, net.edge(2 + i, split[s], 1, WITHIN * (z + self.step(lack[s] - j * z, size)))))
        for s in self.splits:
            at = 0  # arcs of one cost run together: below the quota, over its edge, beyond
            for n in self._runs(self.lack[s], z, sum(rest)):
                net.edge(split[s], 1, n, OVERALL * (z + self.step(self.lack[s] - at * z, size)))
                at += n
        net.send(0, 1)
        for b, s, e in arcs:
            if net.cap[e ^ 1]:
                self.give(b, s, 1)

    @staticmethod
    def _runs(lack: int, z: int, n: int) -> list[int]:
        whole = min(n, max(0, lack // z))
        edge = min(1, n - whole)
        return [k for k in (whole, edge, n - whole - edge) if k]

    def _moved(self, b: int, s: int, t: int) -> int:
        """What it costs more if a component of bundle b goes from s to t, within its label."""
        label, size, _ = self.bundles[b]
        lack = self.within[label]
        return self.step(lack[s], -size) + self.step(lack[t], size)

    def exchange(self) -> None:
        """Single exchanges between two splits, each of those that bring the overall shares nearest, while one helps."""
        better = True
        while better:
            better = False
            for s in self.splits:
                for t in self.splits:
                    better |= s != t and self._exchange(s, t)

    def _exchange(self, s: int, t: int) -> bool:
        """One component from s to t, none or one of another size back."""
        over, lack = -self.lack[s], self.lack[t]
        if over + lack <= 0:
            return False
        mine, theirs = self._least(s, t), self._least(t, s)
        sizes = sorted(theirs)
        best, pick = 0, None
        for a, (cost, b) in mine.items():
            at = bisect.bisect_left(sizes, a - (over + lack) / (2 * self.unit))
            for c in {0, *sizes[max(0, at - 1) : at + 1]}:
                net = (a - c) * self.unit
                back = theirs[c] if c else (0, None)
                change = OVERALL * (abs(over - net) + abs(lack - net) - abs(over) - abs(lack)) + WITHIN * (cost + back[0])
                if change < best:
                    best, pick = change, (b, back[1])
        if pick is None:
            return False
        before = self._cost()
        self._swap(pick, s, t)
        if self._cost() < before:
            return True
        self._swap(pick, t, s)
        return False

    def _swap(self, pick: tuple[int, int | None], s: int, t: int) -> None:
        for b, x, y in ((pick[0], s, t), (pick[1], t, s)):
            if b is not None:
                self.give(b, x, -1)
                self.give(b, y, 1)

    def _least(self, s: int, t: int) -> dict[int, tuple[int, int]]:
        """For each size in s, the bundle whose label suffers least from going to t."""
        out: dict[int, tuple[int, int]] = {}
        for b, (_, size, _) in enumerate(self.bundles):
            if self.given[b][s]:
                cost = self._moved(b, s, t)
                if size not in out or cost < out[size][0]:
                    out[size] = cost, b
        return out

    def _cost(self) -> int:
        return OVERALL * sum(map(abs, self.lack)) + WITHIN * sum(abs(x) for lack in self.within.values() for x in lack)


def allocate(bundles: list[tuple[str, int, int]], shares: dict[str, float]) -> list[list[int]]:
    """bundles: (label, size, number). For each, how many components the first 1, 2, ... splits get."""
    parts = [Fraction(x).limit_denominator(10_000) for x in shares.values()]
    order = sorted(range(len(bundles)), key=lambda i: (-bundles[i][1], bundles[i][0], bundles[i][2]))
    plan = Plan([bundles[i] for i in order], [x / sum(parts) for x in parts])
    plan.place_rest()
    plan.exchange()
    ends: list[list[int]] = [[] for _ in bundles]
    for i, given in zip(order, plan.given, strict=True):
        for n in given:
            ends[i].append(n + (ends[i][-1] if ends[i] else 0))
    return ends
