"""Raster kernels: components, clustering, smoothing, edges, superpixels, contours, filling."""

from __future__ import annotations

import numpy as np

from shapelake.functions.color import RGB_TO_XYZ, WHITE


def to_lab(rgb: np.ndarray) -> np.ndarray:
    """CIE Lab (D65) of (..., 3) channels in 0..255."""
    v = np.asarray(rgb, np.float64) / 255.0
    v = np.where(v <= 0.04045, v / 12.92, ((v + 0.055) / 1.055) ** 2.4)
    t = (v @ np.array(RGB_TO_XYZ).T) / np.array(WHITE)
    f = np.where(t > 216 / 24389, np.cbrt(t), (24389 / 27 * t + 16) / 116)
    return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], -1)


def components(labels: np.ndarray, connectivity: int = 4) -> np.ndarray:
    """Connected components of equal labels, numbered from 0 in order of their first pixel; labels below 0
    are no part of any and stay -1."""
    h, w = labels.shape
    ids = np.arange(h * w).reshape(h, w)
    shifts = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if connectivity == 8 else [])
    pairs = []
    for dy, dx in shifts:
        a = (slice(0, h - dy), slice(max(0, -dx), w - max(0, dx)))
        b = (slice(dy, h), slice(max(0, dx), w + min(0, dx)))
        same = (labels[a] == labels[b]) & (labels[a] >= 0)
        pairs.append(np.stack([ids[a][same], ids[b][same]]))
    a, b = np.concatenate(pairs, 1) if pairs else np.empty((2, 0), int)
    root = np.arange(h * w)
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            break
        low = np.minimum(ra[apart], rb[apart])
        np.minimum.at(root, np.maximum(ra[apart], rb[apart]), low)
        while True:  # short cuts to the roots
            up = root[root]
            if (up == root).all():
                break
            root = up
    out = np.full(h * w, -1)
    inside = labels.reshape(-1) >= 0
    _, out[inside] = np.unique(root[inside], return_inverse=True)
    return out.reshape(h, w)


def kmeans(points: np.ndarray, k: int, weights: np.ndarray | None = None, seed: int = 7, rounds: int = 40, eps: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Centers and labels of weighted k-means with k-means++ seeding; fewer centers if points coincide.
    Deterministic for a seed. Not the random stream of any other library."""
    points = np.asarray(points, np.float64)
    w = np.ones(len(points)) if weights is None else np.asarray(weights, np.float64)
    rng = np.random.default_rng(seed)
    centers = [points[rng.choice(len(points), p=w / w.sum())]]
    near = ((points - centers[0]) ** 2).sum(1)
    while len(centers) < k and (near * w).sum() > 0:
        centers.append(points[rng.choice(len(points), p=near * w / (near * w).sum())])
        near = np.minimum(near, ((points - centers[-1]) ** 2).sum(1))
    c = np.array(centers)
    for _ in range(rounds):
        d = (points**2).sum(1)[:, None] - 2 * points @ c.T + (c**2).sum(1)[None]
        label = d.argmin(1)
        mass = np.bincount(label, w, len(c))
        new = np.stack([np.bincount(label, w * points[:, j], len(c)) for j in range(points.shape[1])], 1) / np.maximum(mass, 1e-12)[:, None]
        new[mass == 0] = c[mass == 0]
        moved = np.sqrt(((new - c) ** 2).sum(1)).max()
        c = new
        if moved < eps:
            break
    d = (points**2).sum(1)[:, None] - 2 * points @ c.T + (c**2).sum(1)[None]
    return c, d.argmin(1)


def _blur1(a: np.ndarray, kernel: np.ndarray, axis: int) -> np.ndarray:
    r = len(kernel) // 2
    pad = [(r, r) if i == axis else (0, 0) for i in range(a.ndim)]
    p = np.pad(a, pad, mode="reflect" if a.shape[axis] > r else "edge")
    return sum(k * np.take(p, range(i, i + a.shape[axis]), axis) for i, k in enumerate(kernel))


def gaussian(a: np.ndarray, size: int, sigma: float | None = None) -> np.ndarray:
    """Gaussian blur with an odd kernel; the default sigma follows from its size."""
    sigma = sigma or 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    x = np.arange(size) - size // 2
    k = np.exp(-(x**2) / (2 * sigma**2))
    k /= k.sum()
    return _blur1(_blur1(np.asarray(a, np.float64), k, 0), k, 1)


def edges(lab: np.ndarray, percentile: float = 99.0) -> np.ndarray:
    """Sobel gradient of Lab, the greatest over its channels, scaled so that the percentile is 1, clipped."""
    p = np.pad(lab, ((1, 1), (1, 1), (0, 0)), mode="edge")
    s, d = np.array([1, 2, 1]), np.array([-1, 0, 1])
    gx = _blur1(_blur1(p, d, 1), s, 0)[1:-1, 1:-1]
    gy = _blur1(_blur1(p, d, 0), s, 1)[1:-1, 1:-1]
    g = np.sqrt(gx**2 + gy**2).max(2)
    scale = np.percentile(g, percentile)
    return np.clip(g / scale, 0, 1) if scale > 0 else np.zeros_like(g)


def l0_smooth(rgb: np.ndarray, weight: float = 0.02, growth: float = 2.0, most: float = 1e5) -> np.ndarray:
    """Smoothing that keeps few gradients (L0 minimisation by half-quadratic splitting in Fourier space)."""
    s = np.asarray(rgb, np.float64) / 255.0
    h, w, _ = s.shape
    fx = np.fft.fftfreq(w)[None, :]
    fy = np.fft.fftfreq(h)[:, None]
    grad = (np.abs(np.exp(2j * np.pi * fx) - 1) ** 2 + np.abs(np.exp(2j * np.pi * fy) - 1) ** 2)[:, :, None]
    base = np.fft.fft2(s, axes=(0, 1))
    beta = 2 * weight
    while beta < most:
        gx, gy = np.roll(s, -1, 1) - s, np.roll(s, -1, 0) - s
        flat = (gx**2 + gy**2).sum(2) < weight / beta
        gx[flat] = gy[flat] = 0
        div = (np.roll(gx, 1, 1) - gx) + (np.roll(gy, 1, 0) - gy)
        s = np.real(np.fft.ifft2((base + beta * np.fft.fft2(div, axes=(0, 1))) / (1 + beta * grad), axes=(0, 1)))
        beta *= growth
    return np.clip(np.rint(s * 255), 0, 255).astype(np.uint8)


def resize_nearest(a: np.ndarray, most: int) -> np.ndarray:
    """Nearest-neighbour scaling so that the longer side is at most ``most``; smaller images stay."""
    h, w = a.shape[:2]
    f = most / max(h, w)
    if f >= 1:
        return a
    nh, nw = max(1, round(h * f)), max(1, round(w * f))
    return a[np.minimum(h - 1, ((np.arange(nh) + 0.5) * h / nh).astype(int))][:, np.minimum(w - 1, ((np.arange(nw) + 0.5) * w / nw).astype(int))]


def superpixels(lab: np.ndarray, target: int, rounds: int = 10) -> np.ndarray:
    """Compact superpixels: local clustering in color and place with each cluster's own color scale, then split
    into connected pieces and pieces below a quarter of the mean size joined to a neighbour."""
    h, w, _ = lab.shape
    step = max(1, int(round(np.sqrt(h * w / max(1, target)))))
    cy, cx = np.meshgrid(np.arange(step // 2, h, step), np.arange(step // 2, w, step), indexing="ij")
    cy, cx = cy.reshape(-1).astype(float), cx.reshape(-1).astype(float)
    cl = lab[cy.astype(int), cx.astype(int)].copy()
    scale = np.full(len(cy), 10.0**2)
    yy, xx = np.mgrid[0:h, 0:w]
    label = np.zeros((h, w), int)
    for _ in range(rounds):
        best = np.full((h, w), np.inf)
        for i in range(len(cy)):
            y0, y1 = max(0, int(cy[i]) - step), min(h, int(cy[i]) + step + 1)
            x0, x1 = max(0, int(cx[i]) - step), min(w, int(cx[i]) + step + 1)
            dc = ((lab[y0:y1, x0:x1] - cl[i]) ** 2).sum(2)
            ds = (yy[y0:y1, x0:x1] - cy[i]) ** 2 + (xx[y0:y1, x0:x1] - cx[i]) ** 2
            d = dc / scale[i] + ds / step**2
            closer = d < best[y0:y1, x0:x1]
            best[y0:y1, x0:x1][closer] = d[closer]
            label[y0:y1, x0:x1][closer] = i
        flat, n = label.reshape(-1), len(cy)
        mass = np.maximum(np.bincount(flat, minlength=n), 1)
        cy, cx = np.bincount(flat, yy.reshape(-1), n) / mass, np.bincount(flat, xx.reshape(-1), n) / mass
        cl = np.stack([np.bincount(flat, lab[..., j].reshape(-1), n) / mass for j in range(3)], 1)
        dc = ((lab - cl[label]) ** 2).sum(2).reshape(-1)
        top = np.zeros(n)
        np.maximum.at(top, flat, dc)
        scale = np.maximum(top, 1.0)
    return absorb_small(components(label), h * w / max(1, len(cy)) / 4)


def absorb_small(label: np.ndarray, least: float) -> np.ndarray:
    """Pieces smaller than ``least`` join the neighbour with the longest common boundary; renumbered."""
    label = label.copy()
    while True:
        sizes = np.bincount(label.reshape(-1))
        small = sizes < least
        small[sizes == 0] = False
        if not small.any() or (sizes > 0).sum() < 2:
            break
        a = np.concatenate([label[:, :-1].reshape(-1), label[:-1].reshape(-1)])
        b = np.concatenate([label[:, 1:].reshape(-1), label[1:].reshape(-1)])
        ends = np.concatenate([np.stack([a, b]), np.stack([b, a])], 1)
        ends = ends[:, (ends[0] != ends[1]) & small[ends[0]]]
        pair, n = np.unique(ends, axis=1, return_counts=True)
        order = np.lexsort((pair[1], -n, pair[0]))
        first = np.unique(pair[0][order], return_index=True)[1]
        to = np.arange(len(sizes))
        for i in order[first]:
            src, dst = pair[0][i], pair[1][i]
            if to[dst] != src and to[src] == src:  # no two pieces swap
                to[src] = to[dst] if to[dst] != src else dst
        new = to[to][label]
        if (new == label).all():
            break
        label = new
    return np.unique(label, return_inverse=True)[1].reshape(label.shape)


def border_flood(rgb: np.ndarray, tolerance: float = 12.0) -> np.ndarray:
    """Mask of what is connected to the border through pixels near the border's dominant color (Lab)."""
    lab = to_lab(rgb)
    ring = np.concatenate([rgb[0], rgb[-1], rgb[:, 0], rgb[:, -1]]).astype(int)
    cell, n = np.unique(ring // 16, axis=0, return_counts=True)
    top = cell[n.argmax()]
    seed = to_lab(np.median(ring[(ring // 16 == top).all(1)], 0))
    near = np.sqrt(((lab - seed) ** 2).sum(2)) <= tolerance
    comp = components(np.where(near, 0, -1))
    touch = np.unique(np.concatenate([comp[0], comp[-1], comp[:, 0], comp[:, -1]]))
    return np.isin(comp, touch[touch >= 0])


def contour(mask: np.ndarray) -> np.ndarray:
    """Outer boundary of the first component of a mask as a closed list of pixel-corner points (x, y), walked
    with the inside to the right; only corners where the direction turns."""
    m = np.pad(mask.astype(bool), 1)
    ys, xs = np.nonzero(m)
    if not len(ys):
        return np.empty((0, 2))
    y, x = int(ys[0]), int(xs[0])  # topmost, then leftmost: its upper edge is on the outline
    start, d = (x, y), 0
    steps = [(1, 0), (0, 1), (-1, 0), (0, -1)]  # right, down, left, up along pixel corners
    out, at = [], start
    while True:
        px, py = at
        # the pixels ahead on the left and on the right of the corner, seen along direction d
        left = m[(py - 1, py, py, py - 1)[d], (px, px, px - 1, px - 1)[d]]
        right = m[(py, py, py - 1, py - 1)[d], (px, px - 1, px - 1, px)[d]]
        turn = 3 if left and right else 0 if right else 1
        if turn:
            out.append((px - 1, py - 1))
            d = (d + turn) % 4
        at = (px + steps[d][0], py + steps[d][1])
        if at == start and d == 3:
            break
    return np.array([(start[0] - 1, start[1] - 1), *(p for p in out if p != (start[0] - 1, start[1] - 1))], float)


def simplify(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Closed polyline with points dropped that lie within ``tolerance`` of the line kept (farthest first)."""
    n = len(points)
    if n < 4:
        return points
    far = int(((points - points[0]) ** 2).sum(1).argmax())
    keep = {0, far}
    stack = [(0, far), (far, n)]
    ring = np.vstack([points, points[:1]])
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        p, q = ring[a], ring[b]
        seg = ring[a + 1 : b] - p
        line = q - p
        length = np.hypot(*line)
        d = np.hypot(seg[:, 0], seg[:, 1]) if length == 0 else np.abs(line[0] * seg[:, 1] - line[1] * seg[:, 0]) / length
        i = int(d.argmax())
        if d[i] > tolerance:
            keep.add(a + 1 + i)
            stack += [(a, a + 1 + i), (a + 1 + i, b)]
    return points[sorted(keep)]


def fill_polygon(points: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Mask of the pixels whose centers lie inside a polygon (even-odd)."""
    h, w = shape
    out = np.zeros((h, w), bool)
    if len(points) < 3:
        return out
    x0, y0 = points[:, 0], points[:, 1]
    x1, y1 = np.roll(x0, -1), np.roll(y0, -1)
    centers = np.arange(w) + 0.5
    for y in range(max(0, int(np.floor(y0.min()))), min(h, int(np.ceil(y0.max())) + 1)):
        c = y + 0.5
        cross = (y0 <= c) != (y1 <= c)
        if cross.any():
            xs = np.sort(x0[cross] + (c - y0[cross]) * (x1[cross] - x0[cross]) / (y1[cross] - y0[cross]))
            out[y] = (np.searchsorted(xs, centers) % 2).astype(bool)
    return out


def fill_ellipse(cx: float, cy: float, rx: float, ry: float, shape: tuple[int, int]) -> np.ndarray:
    y, x = np.mgrid[0 : shape[0], 0 : shape[1]] + 0.5
    return ((x - cx) / max(rx, 1e-9)) ** 2 + ((y - cy) / max(ry, 1e-9)) ** 2 <= 1


def mask_iou(a: np.ndarray, b: np.ndarray) -> float:
    """Intersection over union; 1 for two empty masks."""
    either = (a | b).sum()
    return float((a & b).sum() / either) if either else 1.0


def fit_shape(mask: np.ndarray, wished: float = 0.90, rectangle: float = 0.93, ellipse: float = 0.90) -> dict:
    """A mask as rectangle or ellipse if one covers it well, else as a polygon, simplified as far as the wished
    overlap allows. Gives kind, box, points and the overlap reached."""
    ys, xs = np.nonzero(mask)
    y0, x0, y1, x1 = int(ys.min()), int(xs.min()), int(ys.max()) + 1, int(xs.max()) + 1
    part = mask[y0:y1, x0:x1].astype(bool)
    h, w = part.shape
    box = (float(x0), float(y0), float(w), float(h))
    full = part.mean()
    if full >= rectangle:
        return {"kind": "rectangle", "box": box, "points": [], "iou": float(full)}
    round_ = mask_iou(part, fill_ellipse(w / 2, h / 2, w / 2, h / 2, part.shape))
    if round_ >= ellipse:
        return {"kind": "circle" if abs(w - h) <= 1 else "ellipse", "box": box, "points": [], "iou": round_}
    comp = components(np.where(part, 0, -1), 8)
    big = comp == np.bincount(comp[comp >= 0]).argmax()
    outline = contour(big)
    best, score = outline, mask_iou(part, fill_polygon(outline, part.shape))
    for tolerance in np.array([0.08, 0.05, 0.03, 0.02, 0.01]) * max(h, w):
        p = simplify(outline, tolerance)
        if len(p) >= 3 and (s := mask_iou(part, fill_polygon(p, part.shape))) >= min(wished, score):
            best, score = p, s
            break
    return {"kind": "polygon", "box": box, "points": [(float(x + x0), float(y + y0)) for x, y in best], "iou": float(score)}
