"""Merge forests over region graphs and their optimal cuts: sequential by nature, one image per call."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable
from dataclasses import dataclass

from shapelake.operators.regions import COLOR_TAU, MAX_COST, MERGE_WEIGHTS, NECK_TAU, REDUNDANCY_WEIGHT


@dataclass
class Node:
    """A region of the forest with mergeable statistics."""

    n: float
    lab: tuple[float, float, float]  # sums
    perimeter: float
    left: int | None = None
    right: int | None = None
    cost: float = 0.0
    height: float = 0.0
    loss: float = 0.0


def edge_cost(p: Node, q: Node, shared: float, boundary: float, area: float) -> float:
    """Cost of joining two neighbours: color, boundary and neck terms, protection of large masses, reward for
    redundant slivers. The terms about subject, anchors and hulls are columns of the edge table's first round
    and have no part here."""
    n = p.n + q.n
    d2 = sum((a / p.n - b / q.n) ** 2 for a, b in zip(p.lab, q.lab, strict=True))
    c = 1 - math.exp(-(p.n * q.n / n * d2 / n) / COLOR_TAU)
    ratio = min(1.0, shared / max(1e-12, min(p.perimeter, q.perimeter)))
    small = min(p.n, q.n) / area
    reward = math.exp(-small / 0.01) * (1 - c) * (1 - boundary) * min(1.0, ratio / 0.5)
    base = MERGE_WEIGHTS["color"] * c + MERGE_WEIGHTS["boundary"] * boundary + MERGE_WEIGHTS["topology"] * math.exp(-ratio / NECK_TAU)
    return min(MAX_COST, max(0.0, base + 0.20 * min(1.0, small / 0.03) - REDUNDANCY_WEIGHT * reward))


def merge_forest(regions: dict[int, tuple], edges: Iterable[tuple], blocked: set[tuple[int, int]] = frozenset()) -> tuple[dict[int, Node], list[int]]:
    """Joins the cheapest pair of neighbours again and again until none is left.

    ``regions``: id -> (pixels, sums of l, a, b, perimeter); ``edges``: (a, b, shared, boundary cost);
    ``blocked``: pairs of leaves that no union may bring together. Equal costs go to the smaller ids. Gives all
    nodes (new ids follow the greatest) and the new ids in order.
    """
    nodes = {i: Node(float(r[0]), tuple(map(float, r[1:4])), float(r[4])) for i, r in regions.items()}
    area = sum(x.n for x in nodes.values())
    near: dict[int, dict[int, tuple[float, float]]] = {i: {} for i in nodes}
    bars: dict[int, set[int]] = {i: set() for i in nodes}
    for a, b in blocked:
        if a in nodes and b in nodes:
            bars[a].add(b)
            bars[b].add(a)
    for a, b, shared, boundary in edges:
        near[a][b] = near[b][a] = (float(shared), float(boundary))
    heap: list[tuple[float, int, int]] = []

    def offer(a: int, b: int) -> None:
        if b not in bars[a]:
            s, e = near[a][b]
            heapq.heappush(heap, (edge_cost(nodes[a], nodes[b], s, e, area), min(a, b), max(a, b)))

    for a in near:
        for b in near[a]:
            if a < b:
                offer(a, b)
    order: list[int] = []
    fresh = max(nodes, default=-1) + 1
    alive = set(nodes)
    while heap:
        cost, a, b = heapq.heappop(heap)
        if a not in alive or b not in alive:
            continue
        shared = near[a][b][0]
        p, q = nodes[a], nodes[b]
        m = Node(p.n + q.n, tuple(x + y for x, y in zip(p.lab, q.lab, strict=True)), p.perimeter + q.perimeter - 2 * shared, a, b, cost, max(p.height, q.height, cost))
        m.loss = p.loss + q.loss + cost * math.sqrt(m.n / area)
        nodes[fresh] = m
        around: dict[int, tuple[float, float]] = {}
        for side in (a, b):
            for c, (s, e) in near.pop(side).items():
                if c in (a, b):
                    continue
                s0, e0 = around.get(c, (0.0, 0.0))
                around[c] = (s0 + s, (e0 * s0 + e * s) / (s0 + s) if s0 + s else 0.0)
                near[c].pop(side, None)
        bars[fresh] = bars.pop(a) | bars.pop(b)
        for c in bars[fresh]:
            if c in bars:
                bars[c] = (bars[c] - {a, b}) | {fresh}
        near[fresh] = around
        alive -= {a, b}
        alive.add(fresh)
        for c, v in around.items():
            near[c][fresh] = v
            offer(fresh, c)
        order.append(fresh)
        fresh += 1
    return nodes, order


def _roots(nodes: dict[int, Node]) -> list[int]:
    below = {c for x in nodes.values() for c in (x.left, x.right) if c is not None}
    return sorted(i for i in nodes if i not in below)


def best_cut(nodes: dict[int, Node], order: list[int], count: int, cap: int | None = None) -> list[int]:
    """The set of nodes that covers every leaf once, has ``count`` nodes (or the nearest feasible number), and
    least summed loss: a knapsack up the trees, then across them. ``cap`` bounds the numbers considered."""
    roots = _roots(nodes)
    cap = cap or max(len(roots), min(len(nodes), max(2 * count, count + 64)))
    table: dict[int, dict[int, tuple[float, int]]] = {}
    for i in [i for i, x in nodes.items() if x.left is None] + order:
        x = nodes[i]
        t = {1: (x.loss, 0)}  # number of nodes -> (loss, how many of them left; 0: this node itself)
        if x.left is not None:
            for a, (la, _) in table[x.left].items():
                for b, (lb, _) in table[x.right].items():
                    if a + b <= cap and la + lb < t.get(a + b, (math.inf, 0))[0] - 1e-15:
                        t[a + b] = (la + lb, a)
        table[i] = t
    whole: list[dict[int, tuple[float, int]]] = [{0: (0.0, 0)}]
    for r in roots:
        nxt: dict[int, tuple[float, int]] = {}
        for a, (la, _) in whole[-1].items():
            for b, (lb, _) in table[r].items():
                if a + b <= cap and la + lb < nxt.get(a + b, (math.inf, 0))[0] - 1e-15:
                    nxt[a + b] = (la + lb, b)
        whole.append(nxt)
    if not roots:
        return []
    n = min(whole[-1], key=lambda k: (abs(k - count), k))
    chosen: list[tuple[int, int]] = []
    for r, w in zip(reversed(roots), reversed(whole[1:]), strict=True):
        took = w[n][1]
        chosen.append((r, took))
        n -= took
    out = []
    while chosen:
        i, k = chosen.pop()
        a = table[i][k][1]
        if a == 0:
            out.append(i)
        else:
            chosen += [(nodes[i].left, a), (nodes[i].right, k - a)]
    return sorted(out)


def leaves_under(nodes: dict[int, Node], cut: list[int]) -> dict[int, int]:
    """Leaf -> node of the cut above it."""
    out = {}
    for c in cut:
        stack = [c]
        while stack:
            i = stack.pop()
            if nodes[i].left is None:
                out[i] = c
            else:
                stack += [nodes[i].left, nodes[i].right]
    return out


def nested_cuts(nodes: dict[int, Node], order: list[int], counts: list[int]) -> dict[int, list[int]]:
    """A cut per count, each a refinement of the coarser one: finer counts first, coarser ones cut the forest
    whose leaves are the finer cut's nodes."""
    out: dict[int, list[int]] = {}
    keep, seq = nodes, order
    for count in sorted(set(counts), reverse=True):
        cut = best_cut(keep, seq, count)
        out[count] = cut
        top = set(cut)
        keep, seq = dict(keep), [i for i in seq if i not in top]
        inner = set()
        for c in cut:
            stack = [x for x in (keep[c].left, keep[c].right) if x is not None]
            while stack:
                i = stack.pop()
                inner.add(i)
                stack += [x for x in (keep[i].left, keep[i].right) if x is not None]
        for c in cut:
            x = keep[c]
            keep[c] = Node(x.n, x.lab, x.perimeter, None, None, x.cost, x.height, x.loss)
        keep = {i: x for i, x in keep.items() if i not in inner}
        seq = [i for i in seq if i in keep]
    return out
