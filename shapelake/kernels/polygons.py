"""Polygon kernels: cleaning, guarded simplification, candidate shapes, their measures, merging, trust regions."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np

from shapelake.kernels import raster
from shapelake.kernels.masks import area, hull

# ---- cleaning


def drop_collinear(points: np.ndarray, tolerance: float = 2.0) -> np.ndarray:
    """A closed polygon without the corners that lie within ``tolerance`` of the line through their neighbours. All such
    corners of a round go together; rounds go on while at least three corners stay."""
    pts = np.asarray(points, float)
    while len(pts) > 3:
        before, after = np.roll(pts, 1, 0), np.roll(pts, -1, 0)
        along = after - before
        length = np.hypot(along[:, 0], along[:, 1])
        off = pts - before
        far = np.where(length > 1e-9, np.abs(along[:, 0] * off[:, 1] - along[:, 1] * off[:, 0]) / np.maximum(length, 1e-9), np.hypot(off[:, 0], off[:, 1]))
        keep = far > tolerance
        if keep.all() or keep.sum() < 3:
            break
        pts = pts[keep]
    return pts


def snap_axes(points: np.ndarray, degrees: float = 16.0, tolerance: float = 1.5) -> np.ndarray:
    """Sides that are nearly level or upright made so, one after the other round the polygon (each moves both of its
    ends to their mean), then collinear corners dropped."""
    pts = np.asarray(points, float).copy()
    if len(pts) < 3:
        return pts
    lean = math.radians(degrees)
    for i in range(len(pts)):
        pair = [i, (i + 1) % len(pts)]
        dx, dy = pts[pair[1]] - pts[pair[0]]
        slope = math.atan2(abs(dy), abs(dx))  # 0 level, half pi upright
        for axis, near in ((1, slope), (0, math.pi / 2 - slope)):
            if near <= lean:
                pts[pair, axis] = pts[pair, axis].mean()
    return drop_collinear(pts, tolerance)


def _frame(*shapes: np.ndarray) -> tuple[np.ndarray, tuple[int, int]]:
    """Offset and raster size that hold all of some polygons with a margin of a pixel."""
    every = np.concatenate(shapes)
    low = np.floor(every.min(0)) - 1
    width, height = np.ceil(every.max(0)) + 1 - low
    return low, (int(height), int(width))


def polygon_iou(a: np.ndarray, b: np.ndarray, scale: float = 2.0) -> float:
    """Overlap of two polygons on a raster ``scale`` times finer than their units."""
    a, b = np.asarray(a, float) * scale, np.asarray(b, float) * scale
    low, size = _frame(a, b)
    return raster.mask_iou(raster.fill_polygon(a - low, size), raster.fill_polygon(b - low, size))


# How much of the wished tolerance is tried, from bold to careful, and its least.
STEPS = (1.75, 1.40, 1.15, 1.00, 0.80, 0.60, 0.45)
LEAST_TOLERANCE = 0.35


def simplify_guarded(points: np.ndarray, ratio: float = 0.01, area_error: float = 0.02, least_iou: float = 0.985) -> np.ndarray | None:
    """The boldest simplification that saves at least two corners and keeps area and silhouette; None if there is none.
    Polygons of fewer than seven corners are simple enough. The tolerance is ``ratio`` of the perimeter."""
    pts = np.asarray(points, float)
    size = area(pts)
    around = float(np.hypot(*(np.roll(pts, -1, 0) - pts).T).sum())
    if len(pts) < 7 or size <= 1e-6:
        return None
    for step in STEPS:
        less = raster.simplify(pts, max(LEAST_TOLERANCE, around * ratio * step))
        if 3 <= len(less) <= len(pts) - 2 and abs(area(less) - size) <= area_error * size and polygon_iou(pts, less) >= least_iou:
            return less
    return None


# ---- candidate shapes


def _ellipse(cx: float, cy: float, rx: float, ry: float, n: int = 48) -> np.ndarray:
    t = np.linspace(0, 2 * np.pi, n, endpoint=False)
    return np.stack([cx + rx * np.cos(t), cy + ry * np.sin(t)], 1)


def _rounded(x: float, y: float, w: float, h: float, share: float = 0.25, n: int = 6) -> np.ndarray:
    r = min(w, h) * share
    out = []
    for k, (cx, cy) in enumerate(((x + w - r, y + h - r), (x + r, y + h - r), (x + r, y + r), (x + w - r, y + r))):
        t = np.linspace(k * np.pi / 2, (k + 1) * np.pi / 2, n)
        out.append(np.stack([cx + r * np.cos(t), cy + r * np.sin(t)], 1))
    return np.concatenate(out)


def candidate_shapes(mask: np.ndarray) -> dict[str, np.ndarray]:
    """Outlines that may stand for a mask: its own polygon, box, ellipse of its box and of its moments, rounded box, and
    a trapezoid with the widths of its top and bottom quarters. Empty for an empty mask."""
    ys, xs = np.nonzero(mask)
    if not len(ys):
        return {}
    x, y, w, h = float(xs.min()), float(ys.min()), float(np.ptp(xs) + 1), float(np.ptp(ys) + 1)
    out = {"polygon": raster.contour(mask), "rectangle": np.array([(x, y), (x + w, y), (x + w, y + h), (x, y + h)]), "ellipse": _ellipse(x + w / 2, y + h / 2, w / 2, h / 2), "rounded": _rounded(x, y, w, h)}
    if len(ys) >= 5:
        spread = 2 * np.sqrt(np.maximum([xs.var(), ys.var()], 0.25))
        out["moments"] = _ellipse(xs.mean() + 0.5, ys.mean() + 0.5, *spread)
    if h >= 4:
        ends = []
        for rows in (ys < y + h / 4, ys >= y + h * 3 / 4):
            ends.append((xs[rows].min(), xs[rows].max() + 1) if rows.any() else (x, x + w))
        (a, b), (c, d) = ends
        out["trapezoid"] = np.array([(a, y), (b, y), (d, y + h), (c, y + h)], float)
    return out


def promote(points: np.ndarray, rectangle: float = 0.94, ellipse: float = 0.92, most_area: float = math.inf) -> tuple[str | None, float]:
    """Whether a polygon may become a rectangle or an ellipse of its box, and the overlap reached. The rectangle goes
    first unless the ellipse fits clearly better."""
    pts = np.asarray(points, float)
    if len(pts) < 4 or not 1e-6 < area(pts) <= most_area:
        return None, 0.0
    (x, y), (w, h) = pts.min(0), np.ptp(pts, axis=0)
    box = polygon_iou(pts, np.array([(x, y), (x + w, y), (x + w, y + h), (x, y + h)]))
    round_ = polygon_iou(pts, _ellipse(x + w / 2, y + h / 2, w / 2, h / 2)) if len(pts) >= 5 else 0.0
    if box >= rectangle and box + 0.01 >= round_:
        return "rectangle", box
    return ("ellipse", round_) if round_ >= ellipse else (None, max(box, round_))


def _rim(mask: np.ndarray) -> np.ndarray:
    """Pixels of a mask that have a neighbour outside it."""
    m = np.pad(mask, 1)
    return mask & ~(m[:-2, 1:-1] & m[2:, 1:-1] & m[1:-1, :-2] & m[1:-1, 2:])


def _mean_gap(a: np.ndarray, b: np.ndarray) -> float:
    """Mean distance of the pixels of ``a`` to the nearest of ``b``, in blocks."""
    p, q = np.argwhere(a).astype(float), np.argwhere(b).astype(float)
    nearest = [np.sqrt(((p[i : i + 256, None] - q[None]) ** 2).sum(2)).min(1) for i in range(0, len(p), 256)]
    return float(np.concatenate(nearest).mean()) if nearest and len(q) else 0.0


def measure_shape(target: np.ndarray, shape: np.ndarray, neighbours: np.ndarray | None = None, critical: np.ndarray | None = None, contacts: np.ndarray | None = None, protected: np.ndarray | None = None, saved: float = 0.0, reach: float = 1.5) -> dict[str, float]:
    """How well an outline stands for a mask, all in 0..1: overlap, what it misses and adds, what it takes from
    neighbours and critical ones (masks), shift of the center, worst loss and excess by direction, distance of the
    rims, error at protected points and share of contact points (x, y) kept, complexity ``saved``.

    Lengths are relative to the diagonal of the target's box. An outline that covers nothing misses everything. An
    empty target has no measure (ValueError)."""
    if not target.any():
        raise ValueError("empty target")
    got = raster.fill_polygon(np.asarray(shape, float), target.shape)
    n = float(target.sum())
    has = lambda a: a is not None and len(a) > 0
    unit = lambda v: float(min(1.0, max(0.0, v)))
    if not got.any():
        zero = {"iou": 0.0, "under": 1.0, "over": 0.0, "leakage": 0.0, "critical_leakage": 0.0, "shift": 1.0, "under_side": 1.0, "over_side": 0.0, "rim_distance": 1.0}
        return zero | {"protected_error": float(has(protected)), "contacts_kept": float(not has(contacts)), "saved": unit(saved)}
    ys, xs = np.nonzero(target)
    center = np.array([ys.mean(), xs.mean()])
    diagonal = max(1.0, float(np.hypot(np.ptp(ys) + 1, np.ptp(xs) + 1)))
    under, over = target & ~got, got & ~target
    y, x = np.mgrid[0 : target.shape[0], 0 : target.shape[1]]
    sector = ((np.arctan2(y - center[0], x - center[1]) + np.pi) / (2 * np.pi) * 8).astype(int) % 8
    share = lambda m: max((float(m[sector == k].sum()) / max(1.0, float(target[sector == k].sum())) for k in range(8)))
    edge, rim = _rim(got), _rim(target)
    pts = np.argwhere(edge).astype(float)
    near = lambda p: np.sqrt(((np.asarray(p, float)[:, None, ::-1] - pts[None]) ** 2).sum(2)).min(1)
    moved = np.argwhere(got).mean(0) - center
    return {
        "iou": raster.mask_iou(target, got),
        "under": unit(under.sum() / n),
        "over": unit(over.sum() / n),
        "leakage": unit((over & neighbours).sum() / n) if neighbours is not None else 0.0,
        "critical_leakage": unit((over & critical).sum() / n) if critical is not None else 0.0,
        "shift": unit(float(np.hypot(*moved)) / diagonal),
        "under_side": unit(share(under)),
        "over_side": unit(share(over)),
        "rim_distance": unit((_mean_gap(rim, edge) + _mean_gap(edge, rim)) / 2 / diagonal),
        "protected_error": unit(float(near(protected).mean()) / diagonal) if has(protected) else 0.0,
        "contacts_kept": unit(float((near(contacts) <= reach).mean())) if has(contacts) else 1.0,
        "saved": unit(saved),
    }


# ---- merging


def union_outline(a: np.ndarray, b: np.ndarray, scale: float = 2.0) -> np.ndarray | None:
    """Outline of the union of two polygons, from a raster ``scale`` times finer; None if it is not one piece."""
    p, q = np.asarray(a, float) * scale, np.asarray(b, float) * scale
    low, size = _frame(p, q)
    both = raster.fill_polygon(p - low, size) | raster.fill_polygon(q - low, size)
    if not both.any() or raster.components(np.where(both, 0, -1), 4).max() > 0:
        return None
    return (raster.contour(both) + low) / scale


def merge_same_color(shapes: Sequence[dict], gap: float = 2.0, color: float = 12.0, most_area: float = math.inf, inflation: float = 1.18) -> tuple[list[dict], list[tuple]]:
    """Adjacent polygons of nearly one color merged until no pair is left; the shapes and the (lost, kept) ids.

    Shapes have id, points, lab, importance. A pair merges into its hull if boxes are within ``gap``, colors within
    ``color``, both areas up to ``most_area``, and the hull has at most ``inflation`` times their area. The more
    important keeps id and color (ties: the earlier), the earlier's place in the order stays. Pairs are tried in
    order; after a merge only pairs with the merged shape are new, so each pair is tried once."""
    left = [dict(s, points=np.asarray(s["points"], float)) for s in shapes]
    lost: list[tuple] = []

    def joined(p: dict, q: dict) -> dict | None:
        sizes = area(p["points"]), area(q["points"])
        apart = np.maximum(p["points"].min(0) - q["points"].max(0), q["points"].min(0) - p["points"].max(0))
        if max(sizes) > most_area or (apart > gap).any() or float(np.linalg.norm(np.subtract(p["lab"], q["lab"]))) > color:
            return None
        outline = hull(np.concatenate([p["points"], q["points"]]))
        if area(outline) > inflation * max(sum(sizes), 1e-9):
            return None
        return dict(p if p["importance"] >= q["importance"] else q, points=outline)

    tried: set[tuple[int, int]] = set()
    version = list(range(len(left)))
    fresh = len(left)
    i = 0
    while i < len(left):
        for j in range(i + 1, len(left)):
            pair = (version[i], version[j])
            if pair in tried:
                continue
            tried.add(pair)
            one = joined(left[i], left[j])
            if one is not None:
                lost.append((left[j]["id"] if one["id"] == left[i]["id"] else left[i]["id"], one["id"]))
                left[i], version[i] = one, fresh
                del left[j], version[j]
                fresh, i = fresh + 1, -1  # earlier shapes may now reach the merged one
                break
        i += 1
    return left, lost


# ---- trust regions


def _crosses(a, b, c, d) -> bool:
    turn = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    return turn(a, b, c) * turn(a, b, d) < 0 and turn(c, d, a) * turn(c, d, b) < 0


def moved_polygon_error(before: np.ndarray, after: np.ndarray, width: float, height: float, most_shift: float = 4.0, least_area: float = 0.90) -> str | None:
    """Why a moved polygon must not replace the old one, or None: corners, numbers, canvas, winding, area, shift,
    crossing sides."""
    p, q = np.asarray(before, float), np.asarray(after, float)
    if p.shape != q.shape or len(p) < 3:
        return "corners"
    if not np.isfinite(q).all():
        return "numbers"
    if (q < 0).any() or (q > (width, height)).any():
        return "canvas"
    signed = lambda s: float(np.dot(s[:, 0], np.roll(s[:, 1], -1)) - np.dot(s[:, 1], np.roll(s[:, 0], -1)))
    if signed(p) * signed(q) <= 0:
        return "winding"
    if abs(signed(q)) < least_area * abs(signed(p)):
        return "area"
    if (np.hypot(*(q - p).T) > most_shift).any():
        return "shift"
    n = len(q)
    for i in range(n):
        for j in range(i + 2, n - (i == 0)):
            if _crosses(q[i], q[(i + 1) % n], q[j], q[(j + 1) % n]):
                return "crossing"
    return None


def descend(parameters: dict[str, float], loss: Callable[[dict[str, float]], float], rate: float, epsilon: float = 1e-3) -> dict[str, float]:
    """One step down the slope of ``loss``, the slope of each parameter by central differences."""
    slope = {k: (loss({**parameters, k: v + epsilon}) - loss({**parameters, k: v - epsilon})) / (2 * epsilon) for k, v in parameters.items()}
    return {k: v - rate * slope[k] for k, v in parameters.items()}
