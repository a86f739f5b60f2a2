"""Min-cost maximum flow on a small graph: shortest distances by Dijkstra with potentials, then a blocking flow on the shortest paths."""

from __future__ import annotations

import heapq
from collections import defaultdict


class Flow:
    """Arcs (from, to, room, cost >= 0) between hashable nodes, with integer rooms and costs."""

    def __init__(self):
        self.to: list = []
        self.room: list[int] = []
        self.cost: list[int] = []
        self.out: dict = defaultdict(list)

    def arc(self, a, b, room: int, cost: int = 0) -> int:
        """The arc's number, for ``carried``; the arc after it is its way back."""
        i = len(self.to)
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return i

    def carried(self, arc: int) -> int:
        return self.room[arc + 1]

    def solve(self, s, t) -> int:
        """Send as much as possible from s to t, at the least cost."""
        pull: dict = defaultdict(int)
        sent = 0
        while True:
            far = self._distances(s, pull)
            if t not in far:
                return sent
            for v in list(self.out):  # nodes out of reach count as the farthest
                pull[v] += far.get(v, far[t])
            sent += self._blocking(s, t, pull)

    def _distances(self, s, pull) -> dict:
        far, open_, n = {}, [(0, 0, s)], 0
        while open_:
            d, _, v = heapq.heappop(open_)
            if v in far:
                continue
            far[v] = d
            for i in self.out[v]:
                w = self.to[i]
                if self.room[i] and w not in far:
                    n += 1
                    heapq.heappush(open_, (d + self.cost[i] + pull[v] - pull[w], n, w))
        return far

    def _blocking(self, s, t, pull) -> int:
        """Maximum flow over arcs on shortest paths: layers by breadth-first search, then paths by depth, until no layer reaches t."""
        total = 0

        def short(v, i) -> bool:
            return self.room[i] > 0 and self.cost[i] + pull[v] - pull[self.to[i]] == 0

        while True:
            layer, queue = {s: 0}, [s]
            for v in queue:
                for i in self.out[v]:
                    if short(v, i) and self.to[i] not in layer:
                        layer[self.to[i]] = layer[v] + 1
                        queue.append(self.to[i])
            if t not in layer:
                return total
            tried: dict = defaultdict(int)
            path: list[int] = []
            v = s
            while True:
                if v == t:
                    least = min(self.room[i] for i in path)
                    for i in path:
                        self.room[i] -= least
                        self.room[i ^ 1] += least
                    total += least
                    path, v = [], s
                    continue
                arcs = self.out[v]
                while tried[v] < len(arcs) and not (short(v, arcs[tried[v]]) and layer.get(self.to[arcs[tried[v]]]) == layer[v] + 1):
                    tried[v] += 1
                if tried[v] < len(arcs):
                    path.append(arcs[tried[v]])
                    v = self.to[path[-1]]
                elif path:  # back one step: the arc leads nowhere
                    v = self.to[path.pop() ^ 1]
                    tried[v] += 1
                else:
                    break
