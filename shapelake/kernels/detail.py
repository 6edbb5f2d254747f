"""Fewer visual groups: hide overlays and recolor unimportant shapes while rules about color relations hold."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Shape:
    """A shape of a scene: palette entry, importance, share of the canvas, neighbours, anchors it stands for."""

    palette: int
    importance: float
    share: float
    near: frozenset[int] = frozenset()
    anchors: frozenset[int] = frozenset()
    lab: tuple[float, float, float] = (0.0, 0.0, 0.0)
    overlay: bool = False
    protected: bool = False


@dataclass(frozen=True)
class Rule:
    """Two shapes whose colors must stay apart by ``least``, and, if ``sign`` isn't 0, keep the order of lightness."""

    a: int
    b: int
    least: float
    sign: int = 0


@dataclass
class Budget:
    """Greedy reduction to at most ``most`` visual groups. ``entries``: palette entry -> (Lab, anchors it keeps)."""

    shapes: dict[int, Shape]
    entries: dict[int, tuple[tuple[float, float, float], frozenset[int]]]
    rules: list[Rule] = field(default_factory=list)
    unimportant: float = 0.45

    def __post_init__(self):
        self.color = {i: s.palette for i, s in self.shapes.items()}
        self.hidden: set[int] = set()
        self.recolored: dict[int, int] = {}
        self._rules: dict[int, list[Rule]] = {}
        for r in self.rules:
            self._rules.setdefault(r.a, []).append(r)
            self._rules.setdefault(r.b, []).append(r)

    def groups(self) -> int:
        """Connected visible shapes of one color count once."""
        seen: set[int] = set()
        n = 0
        for i in self.shapes:
            if i in seen or i in self.hidden:
                continue
            n += 1
            stack = [i]
            seen.add(i)
            while stack:
                for j in self.shapes[stack.pop()].near:
                    if j in self.shapes and j not in seen and j not in self.hidden and self.color[j] == self.color[i]:
                        seen.add(j)
                        stack.append(j)
        return n

    def _allowed(self, i: int, entry: int) -> bool:
        """Whether shape i may take a color: no anchor loses its last shape, no rule of i breaks."""
        support = Counter(a for j, s in self.shapes.items() for a in s.anchors if a in self.entries[self.color[j]][1])
        now, then = self.entries[self.color[i]][1], self.entries[entry][1]
        if any(a in now and a not in then and support[a] <= 1 for a in self.shapes[i].anchors):
            return False
        for r in self._rules.get(i, ()):
            la = self.entries[entry if r.a == i else self.color[r.a]][0]
            lb = self.entries[entry if r.b == i else self.color[r.b]][0]
            if math.dist(la, lb) <= r.least or (r.sign and (la[0] - lb[0]) * r.sign < 0):
                return False
        return True

    def _weak(self, overlay: bool) -> list[int]:
        ok = [i for i, s in self.shapes.items() if s.overlay == overlay and not s.protected and s.importance <= self.unimportant]
        return sorted(ok, key=lambda i: (self.shapes[i].importance, self.shapes[i].share, i))

    def reduce(self, most: int) -> int:
        """Hide the weakest overlays, then give weak shapes a neighbour's color (the nearest first) where that
        leaves fewer groups; repeat while it helps. Returns the number of groups reached."""
        n = self.groups()
        for i in self._weak(True):
            if n <= most:
                return n
            self.hidden.add(i)
            n = self.groups()
        moved = True
        while n > most and moved:
            moved = False
            for i in self._weak(False):
                if i in self.recolored or n <= most:
                    continue
                s = self.shapes[i]
                others = {self.color[j]: j for j in sorted(s.near, reverse=True) if j in self.shapes and not self.shapes[j].overlay and self.color[j] != self.color[i]}
                for entry in sorted(others, key=lambda e: (math.dist(s.lab, self.entries[e][0]), others[e])):
                    if not self._allowed(i, entry):
                        continue
                    old, self.color[i] = self.color[i], entry
                    if (m := self.groups()) < n:
                        n, moved = m, True
                        self.recolored[i] = others[entry]
                        break
                    self.color[i] = old
        return n
