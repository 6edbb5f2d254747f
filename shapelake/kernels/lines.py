"""Line and facet kernels: straight segments, their support, facets of color, smoothing and reducing label maps."""

from __future__ import annotations

import numpy as np

from shapelake.kernels import raster
from shapelake.kernels.masks import dilate


def edge_mask(rgb: np.ndarray, low: float = 50.0, high: float = 120.0) -> np.ndarray:
    """Thin edges of the gray image: local maxima of the gradient that are strong, or weak and connected to a strong one."""
    gray = raster.gaussian(np.asarray(rgb, float) @ np.array([0.299, 0.587, 0.114]), 3)
    p = np.pad(gray, 1, mode="edge")
    gx = (p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[1:-1, :-2] + p[2:, :-2])
    gy = (p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[:-2, 1:-1] + p[:-2, 2:])
    size = np.hypot(gx, gy)
    way = np.rint(np.arctan2(gy, gx) / (np.pi / 4)).astype(int) % 4  # level, rising, upright, falling
    q = np.pad(size, 1)
    h, w = size.shape
    at = lambda dy, dx: q[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]
    ahead = np.choose(way, [at(0, 1), at(1, 1), at(1, 0), at(1, -1)])
    behind = np.choose(way, [at(0, -1), at(-1, -1), at(-1, 0), at(-1, 1)])
    thin = (size >= ahead) & (size > behind) & (size >= low)
    piece = raster.components(np.where(thin, 0, -1), 8)
    strong = np.unique(piece[thin & (size >= high)])
    return thin & np.isin(piece, strong)


def segments(edges: np.ndarray, votes: int, shortest: float, most_gap: float, most: int = 200) -> list[tuple[int, int, int, int]]:
    """Straight segments (x0, y0, x1, y1) of an edge mask by a Hough transform in steps of a degree and a pixel: the
    line with most votes (ties: the smaller angle, then offset) is walked, its runs without gaps beyond ``most_gap``
    that are long enough come out, and its pixels stop voting."""
    ys, xs = np.nonzero(edges)
    if not len(ys):
        return []
    t = np.deg2rad(np.arange(180))
    reach = int(np.ceil(np.hypot(*edges.shape))) + 1
    rho = np.rint(xs[:, None] * np.cos(t) + ys[:, None] * np.sin(t)).astype(int) + reach
    cell = np.arange(180) * (2 * reach + 1) + rho
    count = np.bincount(cell.reshape(-1), minlength=180 * (2 * reach + 1))
    free = np.ones(len(ys), bool)
    out: list[tuple[int, int, int, int]] = []
    while len(out) < most:
        best = int(count.argmax())
        if count[best] < votes:
            break
        angle, offset = divmod(best, 2 * reach + 1)
        on = np.flatnonzero(free & (np.abs(rho[:, angle] - offset) <= 1))
        along = xs[on] * -np.sin(t[angle]) + ys[on] * np.cos(t[angle])
        order = np.argsort(along, kind="stable")
        on, along = on[order], along[order]
        for run in np.split(np.arange(len(on)), np.flatnonzero(np.diff(along) > most_gap + 1) + 1):
            if len(run) and along[run[-1]] - along[run[0]] >= shortest:
                a, b = on[run[0]], on[run[-1]]
                out.append((int(xs[a]), int(ys[a]), int(xs[b]), int(ys[b])))
        free[on] = False
        np.subtract.at(count, cell[on].reshape(-1), 1)
        count[best] = 0
    return out[:most]


# Shortest line and gap as shares of the shorter side, and votes; how many lines are kept.
LINE_MODES = {"standard": (0.04, 0.015, 45, 14), "strict": (0.07, 0.010, 60, 8)}
AXIAL, FRAME, FRAME_TILT, FRAME_LENGTH = 12.0, 0.04, 8.0, 0.25


def structural_lines(rgb: np.ndarray, mode: str = "standard") -> list[tuple[float, tuple[int, int, int, int]]]:
    """Long nearly level or upright lines of a picture, longest first (length, segment), without the picture's frame."""
    if mode == "none":
        return []
    h, w = rgb.shape[:2]
    length, gap, votes, keep = LINE_MODES[mode]
    found = []
    for x0, y0, x1, y1 in segments(edge_mask(rgb, 80, 170), votes, max(10, int(min(h, w) * length)), max(3, int(min(h, w) * gap))):
        long, tilt = float(np.hypot(x1 - x0, y1 - y0)), float(np.degrees(np.arctan2(abs(y1 - y0), abs(x1 - x0))))
        mx, my = (x0 + x1) / 2 / w, (y0 + y1) / 2 / h
        level_frame = tilt <= FRAME_TILT and not FRAME <= my <= 1 - FRAME and long > w * FRAME_LENGTH
        upright_frame = 90 - tilt <= FRAME_TILT and not FRAME <= mx <= 1 - FRAME and long > h * FRAME_LENGTH
        if min(tilt, 90 - tilt) <= AXIAL and not level_frame and not upright_frame:
            found.append((long, (x0, y0, x1, y1)))
    return sorted(found, reverse=True)[:keep]


def line_support(rgb: np.ndarray, shortest: float = 0.04, gap: float = 0.007, votes: int = 25) -> dict[str, float]:
    """Density of edges, the share of them along long lines (within a pixel), and the number of lines; lengths are
    shares of the diagonal."""
    e = edge_mask(rgb)
    diagonal = float(np.hypot(*e.shape))
    lines = segments(e, votes, max(2, round(diagonal * shortest)), max(1, round(diagonal * gap)))
    drawn = np.zeros_like(e)
    for x0, y0, x1, y1 in lines:
        n = max(abs(x1 - x0), abs(y1 - y0)) + 1
        drawn[np.rint(np.linspace(y0, y1, n)).astype(int), np.rint(np.linspace(x0, x1, n)).astype(int)] = True
    support = float((e & dilate(drawn, 1, 1)).sum() / e.sum()) if lines else 0.0
    return {"edge_density": float(e.mean()) if e.size else 0.0, "support": support, "lines": len(lines)}


def macro_facets(rgb: np.ndarray, step: int = 32, least: float = 0.001, large: float = 0.02, tolerance: float = 0.02) -> dict[str, float]:
    """Facets of one quantized color: how many are at least ``least`` of the picture, the share of the picture in those
    of at least ``large``, and the mean number of corners of their outlines, weighted by area."""
    q = np.clip((np.asarray(rgb, int) + step // 2) // step * step, 0, 255)
    comp = raster.components((q * np.array([1 << 16, 1 << 8, 1])).sum(2), 8)
    total = comp.size
    sizes = np.bincount(comp.reshape(-1))
    kept = np.flatnonzero(sizes >= max(1, least * total))
    if not len(kept):
        return {"facets": 0, "large_share": 0.0, "mean_corners": 0.0}
    corners = []
    for k in kept:
        outline = raster.contour(comp == k)
        around = np.abs(np.roll(outline, -1, 0) - outline).sum()
        corners.append(len(raster.simplify(outline, tolerance * around)))
    n = sizes[kept]
    return {"facets": len(kept), "large_share": float(n[n >= large * total].sum() / total), "mean_corners": float(np.average(corners, weights=n))}


def majority_smooth(labels: np.ndarray, passes: int = 1, votes: int = 5) -> np.ndarray:
    """Label map in which a pixel takes the label most of its 3 x 3 neighbourhood has, if that is another with at least
    ``votes`` (ties: its own, then the smallest). Negative labels neither vote nor change."""
    now = np.asarray(labels).copy()
    h, w = now.shape
    names = np.unique(now[now >= 0])
    for _ in range(passes):
        p = np.pad(now, 1, constant_values=-1)
        best, count = now.copy(), np.zeros((h, w), int)
        views = [p[dy : dy + h, dx : dx + w] for dy in range(3) for dx in range(3)]
        own = sum((v == now).astype(int) for v in views)
        for name in names:
            n = sum((v == name).astype(int) for v in views)
            better = n > np.maximum(count, own)
            best, count = np.where(better, name, best), np.where(better, n, count)
        now = np.where((now >= 0) & (best != now) & (count >= votes), best, now)
    return now


def reduce_components(labels: np.ndarray, colors: np.ndarray, budget: int) -> np.ndarray:
    """Label map of at most ``budget`` components (4-connected, negative left out): again and again the smallest joins
    the neighbour nearest in color (ties: the smaller number), whose color becomes their mean by area. Components
    without neighbours stay, so a map of islands may keep more."""
    comp = raster.components(labels, 4)
    n = int(comp.max()) + 1
    if n <= budget:
        return comp
    size = np.bincount(comp[comp >= 0], minlength=n).astype(float)
    color = np.stack([np.bincount(comp[comp >= 0], weights=colors[..., c][comp >= 0], minlength=n) for c in range(colors.shape[2])], 1) / size[:, None]
    ends = np.concatenate([np.stack([a.reshape(-1), b.reshape(-1)], 1) for a, b in ((comp[:, :-1], comp[:, 1:]), (comp[:-1], comp[1:]))])
    near: list[set[int]] = [set() for _ in range(n)]
    for a, b in np.unique(ends[(ends[:, 0] != ends[:, 1]) & (ends >= 0).all(1)], axis=0):
        near[a].add(int(b))
        near[b].add(int(a))
    to = np.arange(n)
    alive = set(range(n))
    import heapq

    heap = [(size[k], k) for k in alive if near[k]]
    heapq.heapify(heap)
    while len(alive) > budget and heap:
        s, k = heapq.heappop(heap)
        if k not in alive or s != size[k] or not near[k]:
            continue
        t = min(near[k], key=lambda j: (float(((color[j] - color[k]) ** 2).sum()), j))
        color[t] = (color[t] * size[t] + color[k] * size[k]) / (size[t] + size[k])
        size[t] += size[k]
        to[k] = t
        alive.discard(k)
        for j in near[k]:
            near[j].discard(k)
            if j != t:
                near[j].add(t)
                near[t].add(j)
        near[k] = set()
        heapq.heappush(heap, (size[t], t))
    while (to[to] != to).any():
        to = to[to]
    out = np.where(comp >= 0, to[np.maximum(comp, 0)], -1)
    kept = np.unique(out[out >= 0])
    return np.where(out >= 0, np.searchsorted(kept, out), -1)
