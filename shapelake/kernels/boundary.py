"""Shared boundaries of a label image: chains between junctions, simplified once for both sides."""

from __future__ import annotations

import numpy as np

OUTSIDE = -1


def cracks(labels: np.ndarray) -> list[tuple[tuple[int, int], tuple[int, int], int, int]]:
    """Unit edges between pixels of different labels (the outside counts as one), directed so that the first
    label lies on their right: (from, to, right, left), ends as (x, y) pixel corners."""
    p = np.pad(labels, 1, constant_values=OUTSIDE)
    out = []
    for y, x in zip(*np.nonzero(p[:, :-1] != p[:, 1:]), strict=True):  # between (y, x) and (y, x + 1)
        out.append(((int(x), int(y)), (int(x), int(y) - 1), int(p[y, x + 1]), int(p[y, x])))
    for y, x in zip(*np.nonzero(p[:-1] != p[1:]), strict=True):  # between (y, x) and (y + 1, x)
        out.append(((int(x) - 1, int(y)), (int(x), int(y)), int(p[y + 1, x]), int(p[y, x])))
    return out


def chains(labels: np.ndarray) -> list[dict]:
    """Maximal chains of cracks between the same two regions, cut at junctions (corners where other than two
    cracks of one pair of regions meet). Each has right < left or the outside on its left, ``points`` with both
    ends, and ``closed`` if it meets no junction."""
    edges: dict[tuple[int, int], list[tuple[tuple[int, int], tuple[int, int], int, int]]] = {}
    at: dict[tuple[int, int], list[tuple]] = {}
    for p, q, r, l in cracks(labels):
        if l != OUTSIDE and (r == OUTSIDE or r > l):
            p, q, r, l = q, p, l, r
        c = (p, q, r, l)
        edges.setdefault(p, []).append(c)
        at.setdefault(p, []).append(c)
        at.setdefault(q, []).append(c)
    free = lambda v: len(at[v]) == 2 and at[v][0][2:] == at[v][1][2:] and at[v][0][1] != at[v][1][1]
    used: set[tuple] = set()
    out = []

    def walk(c: tuple) -> list[tuple[int, int]]:
        pts = [c[0]]
        while True:
            used.add(c)
            pts.append(c[1])
            if not free(c[1]):
                return pts
            nxt = [e for e in edges.get(c[1], ()) if e[2:] == c[2:] and e not in used]
            if not nxt:
                return pts
            c = nxt[0]

    for v in sorted(at):
        if not free(v):
            for c in sorted(edges.get(v, ())):
                if c not in used:
                    out.append({"right": c[2], "left": c[3], "points": walk(c), "closed": False})
    for v in sorted(edges):
        for c in sorted(edges[v]):
            if c not in used:
                out.append({"right": c[2], "left": c[3], "points": walk(c), "closed": True})
    return out


def _thin(pts: np.ndarray, tolerance: float) -> np.ndarray:
    """An open polyline with its ends and every point farther than the tolerance from the line kept."""
    keep, stack = {0, len(pts) - 1}, [(0, len(pts) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        line, seg = pts[b] - pts[a], pts[a + 1 : b] - pts[a]
        n = np.hypot(*line)
        d = np.hypot(seg[:, 0], seg[:, 1]) if n == 0 else np.abs(line[0] * seg[:, 1] - line[1] * seg[:, 0]) / n
        i = int(d.argmax())
        if d[i] > tolerance:
            keep.add(a + 1 + i)
            stack += [(a, a + 1 + i), (a + 1 + i, b)]
    return pts[sorted(keep)]


def simplified(found: list[dict], tolerance: float) -> list[dict]:
    """Chains with fewer points. As a chain belongs to both its regions and its ends stay, neighbours still meet
    without gaps; a closed chain is halved at its farthest point first."""
    out = []
    for c in found:
        pts = np.array(c["points"], float)
        if c["closed"]:
            far = int(((pts - pts[0]) ** 2).sum(1).argmax())
            pts = np.vstack([_thin(pts[: far + 1], tolerance)[:-1], _thin(pts[far:], tolerance)])
        else:
            pts = _thin(pts, tolerance)
        out.append({**c, "points": [tuple(map(float, p)) for p in pts]})
    return out


def areas(found: list[dict]) -> dict[int, float]:
    """Area of every region from its chains alone: each adds its shoelace sum to its right side and takes it from
    its left."""
    out: dict[int, float] = {}
    for c in found:
        p = np.array(c["points"], float)
        s = float((p[:-1, 0] * p[1:, 1] - p[1:, 0] * p[:-1, 1]).sum() / 2)
        out[c["right"]] = out.get(c["right"], 0.0) + s
        out[c["left"]] = out.get(c["left"], 0.0) - s
    out.pop(OUTSIDE, None)
    return out
