"""Mask kernels: morphology with boxes, holes, hulls, splitting and joining of regions, scene scans."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

import numpy as np

from shapelake.kernels import raster


def dilate(mask: np.ndarray, ry: int, rx: int) -> np.ndarray:
    """Every pixel within a box of (2 ry + 1) x (2 rx + 1) around a set one; running sums, any radius alike."""
    h, w = mask.shape
    p = np.pad(mask.astype(np.int32), ((ry + 1, ry), (rx + 1, rx))).cumsum(0).cumsum(1)
    box = p[2 * ry + 1 :, 2 * rx + 1 :] - p[: h + 0, 2 * rx + 1 :][:h] - p[2 * ry + 1 :, :w] + p[:h, :w]
    return box > 0


def erode(mask: np.ndarray, ry: int, rx: int) -> np.ndarray:
    """Pixels whose whole box is set; what lies beyond the border counts as set."""
    return ~dilate(~mask.astype(bool), ry, rx)


def close(mask: np.ndarray, ry: int, rx: int) -> np.ndarray:
    """Gaps up to the box filled; the result contains the mask."""
    pad = np.pad(mask.astype(bool), ((ry, ry), (rx, rx)))
    return erode(dilate(pad, ry, rx), ry, rx)[ry : ry + mask.shape[0], rx : rx + mask.shape[1]]


def opened(mask: np.ndarray, ry: int, rx: int) -> np.ndarray:
    """Parts narrower than the box removed; the result lies within the mask."""
    pad = np.pad(mask.astype(bool), ((ry, ry), (rx, rx)))
    return dilate(erode(pad, ry, rx), ry, rx)[ry : ry + mask.shape[0], rx : rx + mask.shape[1]] & mask.astype(bool)


def fill_holes(mask: np.ndarray) -> np.ndarray:
    """The mask with all background that doesn't reach the border."""
    out = raster.components(np.where(mask, -1, 0), 4)
    edge = np.unique(np.concatenate([out[0], out[-1], out[:, 0], out[:, -1]]))
    return ~np.isin(out, edge[edge >= 0])


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counterclockwise in a y-up plane (sorted sweep)."""
    pts = np.unique(np.asarray(points, float), axis=0)
    if len(pts) < 3:
        return pts

    def half(seq):
        out = []
        for p in seq:
            while len(out) >= 2 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]))


def area(points: np.ndarray) -> float:
    if len(points) < 3:
        return 0.0
    x, y = points[:, 0], points[:, 1]
    return float(abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2)


def solidity(mask: np.ndarray) -> float:
    """Area over the area of the hull of the pixels' corners; 0 for an empty mask."""
    y, x = np.nonzero(mask)
    if not len(y):
        return 0.0
    corners = np.concatenate([np.stack([x + i, y + j], 1) for i in (0, 1) for j in (0, 1)])
    return float(len(y) / max(area(hull(corners)), 1e-9))


def split_large(mask: np.ndarray, radius: int, least: int) -> np.ndarray:
    """Labels of a mask's parts that narrow necks join: the mask opened by ``radius`` falls into pieces, each of at
    least ``least`` pixels is a seed, and all other pixels join the seed they reach first through the mask. A mask
    without two seeds stays one part; outside is -1."""
    seeds = raster.components(np.where(opened(mask, radius, radius), 0, -1), 4)
    n = np.bincount(seeds[seeds >= 0], minlength=1)
    keep = np.flatnonzero(n >= least)
    out = np.where(mask, 0, -1)
    if len(keep) < 2:
        return out
    label = np.full(mask.shape, -1)
    for new, old in enumerate(keep):
        label[seeds == old] = new
    while True:
        grow = label.copy()
        p = np.pad(label, 1, constant_values=-1)
        near = np.stack([p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]])
        fill = (label < 0) & mask.astype(bool) & (near >= 0).any(0)
        if not fill.any():
            break
        grow[fill] = np.where(near >= 0, near, np.iinfo(int).max).min(0)[fill]
        label = grow
    label[mask.astype(bool) & (label < 0)] = 0
    return label


def silhouette(parts: np.ndarray, ry: int, rx: int, least: int) -> np.ndarray:
    """One outline from the fragments of a group: closed, holes filled, pieces below ``least`` dropped."""
    m = fill_holes(close(parts, ry, rx))
    comp = raster.components(np.where(m, 0, -1), 8)
    n = np.bincount(comp[comp >= 0], minlength=1)
    return (comp >= 0) & (n[np.maximum(comp, 0)] >= least)


def scales(rgb: np.ndarray) -> dict[str, np.ndarray]:
    """Maps in 0..1 at several scales: edges, contrast to the mean color, coarse masses, fine detail."""
    lab = raster.to_lab(rgb)
    unit = lambda a: a / a.max() if a.max() > 0 else a
    side = max(3, int(max(rgb.shape[:2]) * 0.05) // 2 * 2 + 1)
    wide = raster.gaussian(lab, side)
    fine = np.sqrt(((lab - raster.gaussian(lab, 5)) ** 2).sum(2))
    return {"edge": raster.edges(lab), "saliency": unit(np.sqrt(((wide - lab.mean((0, 1))) ** 2).sum(2))), "macro": unit(raster.gaussian(raster.edges(wide), 5)), "detail": unit(fine)}


def corridor(mask: np.ndarray, middle: float = 0.40, widths: tuple[float, float] = (0.08, 0.24), band: tuple[float, float] = (0.20, 0.72), least: float = 0.055, emptier: float = 0.72) -> dict:
    """The upright corridor of a mask: an empty stretch of columns near the middle with clearly more mass on both sides.

    Every stretch of every width in the given range whose center is in the ``middle`` of the picture is judged at
    once by how much emptier it is than the emptier side (beyond a margin), less a little for being off the center;
    the best wins (ties: the narrower, then the left one). Gives its ends, the sides' masses, and how empty it is
    against them; it is not active if a side has less than ``least`` or it isn't at least that much ``emptier``."""
    h, w = mask.shape
    none = {"active": False, "x0": w / 2, "x1": w / 2, "left": 0.0, "right": 0.0, "score": 0.0}
    if min(h, w) < 20 or not mask.any():
        return none
    filled = np.concatenate([[0.0], np.cumsum(mask[round(h * band[0]) : round(h * band[1])].mean(0))])
    margin = max(4, round(w * 0.035))
    width = np.arange(max(5, round(w * widths[0])), max(5, round(w * widths[1])) + 1)[:, None]
    start = np.arange(w)[None, :]
    stop = start + width
    center = (start + stop) / 2 / w
    fits = (stop <= w - margin - 1) & (start >= margin + 1) & (np.abs(center - 0.5) <= middle / 2)
    if not fits.any():
        return none
    mean = lambda a, b: (filled[np.clip(b, 0, w)] - filled[np.clip(a, 0, w)]) / np.maximum(b - a, 1)
    inside, left, right = mean(start, stop), mean(np.zeros_like(stop), start - margin + 0 * width), mean(stop + margin, np.full_like(stop, w))
    side = np.minimum(left, right)
    merit = np.where(fits, side - inside - np.abs(center - 0.5) * 0.08, -np.inf)
    i, j = np.unravel_index(int(merit.argmax()), merit.shape)
    sides = none | {"left": float(left[i, j]), "right": float(right[i, j])}
    if side[i, j] < least or inside[i, j] > side[i, j] * emptier:
        return sides
    return sides | {"active": True, "x0": float(start[0, j]), "x1": float(stop[i, j]), "score": float(min(1.0, max(0.0, 1 - inside[i, j] / side[i, j])))}


def palette_tree(colors: np.ndarray, mass: np.ndarray, blocked: set[tuple[int, int]] = frozenset()) -> list[tuple[int, int, int, float]]:
    """Agglomerative hierarchy of Lab colors: again and again the nearest two clusters (by their mass-weighted
    means) join, unless a blocked pair would; steps (left, right, new, distance). Ids of leaves are their places,
    ties go to the smaller ids."""
    live = {i: (np.asarray(c, float), float(m), {i}) for i, (c, m) in enumerate(zip(colors, mass, strict=True))}
    steps, fresh = [], len(live)
    while len(live) > 1:
        ids = sorted(live)
        pairs = [(float(np.sqrt(((live[a][0] - live[b][0]) ** 2).sum())), a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if not any((min(x, y), max(x, y)) in blocked for x in live[a][2] for y in live[b][2])]
        if not pairs:
            break
        d, a, b = min(pairs)
        (ca, ma, la), (cb, mb, lb) = live.pop(a), live.pop(b)
        live[fresh] = ((ca * ma + cb * mb) / (ma + mb), ma + mb, la | lb)
        steps.append((a, b, fresh, d))
        fresh += 1
    return steps


def palette_cut(leaves: int, steps: list[tuple[int, int, int, float]], count: int) -> list[int]:
    """Cluster of each leaf when the hierarchy is replayed down to ``count`` clusters (or as far as it goes)."""
    group = list(range(leaves))
    for a, b, new, _ in steps[: max(0, leaves - count)]:
        group = [new if g in (a, b) else g for g in group]
    return group


_NUMBER = re.compile(r"-?\d*\.?\d+(?:[eE][-+]?\d+)?")


def scan_svg(text: str) -> list[dict]:
    """Shapes of an SVG subset in drawing order: rect, circle, ellipse, polygon with hex fills; others are left
    out. ValueError if it isn't XML or declares entities."""
    if "<!" in text:
        raise ValueError("declarations are not read")
    try:
        root = ET.fromstring(text)
    except ET.ParseError as e:
        raise ValueError("no SVG") from e
    out = []
    for e in root.iter():
        tag, fill = e.tag.rsplit("}", 1)[-1], e.get("fill", "")
        num = lambda n: float(e.get(n) or 0)  # noqa: B023, E731
        if not re.fullmatch(r"#[0-9a-fA-F]{6}", fill):
            continue
        rgb = tuple(int(fill[i : i + 2], 16) for i in (1, 3, 5))
        if tag == "rect":
            out.append({"kind": "rectangle", "box": (num("x"), num("y"), num("width"), num("height")), "points": [], "rgb": rgb})
        elif tag in ("circle", "ellipse"):
            rx, ry = (num("r"), num("r")) if tag == "circle" else (num("rx"), num("ry"))
            out.append({"kind": tag, "box": (num("cx") - rx, num("cy") - ry, 2 * rx, 2 * ry), "points": [], "rgb": rgb})
        elif tag == "polygon":
            v = [float(x) for x in _NUMBER.findall(e.get("points", ""))]
            pts = list(zip(v[::2], v[1::2], strict=False))
            if len(pts) >= 3:
                xs, ys = [p[0] for p in pts], [p[1] for p in pts]
                out.append({"kind": "polygon", "box": (min(xs), min(ys), max(xs) - min(xs), max(ys) - min(ys)), "points": pts, "rgb": rgb})
    return out


def paint(shapes: list[dict], shape: tuple[int, int]) -> np.ndarray:
    """RGBA raster of shapes in drawing order; nothing drawn is transparent."""
    out = np.zeros((*shape, 4), np.uint8)
    for s in shapes:
        x, y, w, h = s["box"]
        if s["kind"] in ("circle", "ellipse"):
            m = raster.fill_ellipse(x + w / 2, y + h / 2, w / 2, h / 2, shape)
        else:
            m = raster.fill_polygon(np.array(s["points"] or [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]), shape)
        out[m] = (*s["rgb"], 255)
    return out
