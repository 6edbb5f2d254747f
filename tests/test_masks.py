import itertools

import numpy as np
import pytest

from shapelake.kernels import masks, raster


def brute(mask, ry, rx, how):
    h, w = mask.shape
    out = np.zeros_like(mask)
    for y, x in itertools.product(range(h), range(w)):
        win = [mask[a, b] if 0 <= a < h and 0 <= b < w else (how == "erode") for a in range(y - ry, y + ry + 1) for b in range(x - rx, x + rx + 1)]
        out[y, x] = all(win) if how == "erode" else any(win)
    return out


@pytest.mark.parametrize("r", [(0, 0), (1, 1), (2, 1), (3, 4)])
def test_morphology_matches_brute_force(r):
    for seed in range(5):
        m = np.random.default_rng(seed).random((13, 10)) < 0.3
        assert (masks.dilate(m, *r) == brute(m, *r, "dilate")).all()
        assert (masks.erode(~m, *r) == brute(~m, *r, "erode")).all()
        c, o = masks.close(m, *r), masks.opened(m, *r)
        assert (c | m == c).all() and (o & m == o).all()


def test_holes_hulls_and_solidity():
    ring = np.zeros((12, 12), bool)
    ring[2:10, 2:10] = True
    ring[4:8, 4:8] = False
    assert masks.fill_holes(ring).sum() == 64 and masks.solidity(masks.fill_holes(ring)) == pytest.approx(1.0)
    assert masks.solidity(ring) == pytest.approx(48 / 64) and masks.solidity(np.zeros((3, 3), bool)) == 0
    pts = np.random.default_rng(1).random((60, 2))
    h = masks.hull(pts)
    for a, b in zip(h, np.roll(h, -1, 0), strict=True):
        assert ((b[0] - a[0]) * (pts[:, 1] - a[1]) - (b[1] - a[1]) * (pts[:, 0] - a[0]) >= -1e-12).all()


def test_split_and_silhouette():
    m = np.zeros((20, 40), bool)
    m[4:16, 2:14] = m[4:16, 26:38] = True
    m[9:11, 14:26] = True
    parts = masks.split_large(m, 2, 50)
    assert set(np.unique(parts)) == {-1, 0, 1} and ((parts >= 0) == m).all() and parts[10, 3] != parts[10, 37]
    assert set(np.unique(masks.split_large(m, 1, 10_000))) == {-1, 0}
    bits = np.zeros((20, 20), bool)
    bits[5:15:2, 5:15:2] = True
    bits[0, 19] = True
    s = masks.silhouette(bits, 1, 1, 5)
    assert s[5:14, 5:14].all() and not s[0, 19]


def test_scales_and_corridor():
    a = np.zeros((60, 100, 3), np.uint8)
    a[:, 50:] = 255
    maps = masks.scales(a)
    assert set(maps) == {"edge", "saliency", "macro", "detail"} and all(0 <= v.min() and v.max() <= 1 + 1e-9 for v in maps.values())
    m = np.zeros((100, 200), bool)
    m[30:70, 10:85] = m[30:70, 112:190] = True
    c = masks.corridor(m)
    assert c["active"] and 80 <= c["x0"] < c["x1"] <= 118 and c["score"] > 0.8
    m[:] = True
    assert not masks.corridor(m)["active"] and not masks.corridor(np.zeros((5, 5), bool))["active"]


def test_palette_tree_and_cut():
    colors = np.array([[50, 0, 0], [51, 0, 0], [80, 40, 0], [80, 43, 0], [20, -60, 10]], float)
    steps = masks.palette_tree(colors, np.ones(5))
    assert steps[0][:2] == (0, 1) and steps[1][:2] == (2, 3) and len(steps) == 4
    for k in range(1, 6):
        assert len(set(masks.palette_cut(5, steps, k))) == k
    held = masks.palette_tree(colors, np.ones(5), {(0, 1)})
    group = masks.palette_cut(5, held, 1)
    assert group[0] != group[1]


def test_svg_scan_paints_back():
    svg = '<svg xmlns="http://www.w3.org/2000/svg" width="40" height="30"><rect x="2" y="3" width="10" height="8" fill="#ff0000"/><ellipse cx="25" cy="15" rx="8" ry="6" fill="#00ff00"/><polygon points="5,20 15,20 10,28" fill="#0000ff"/><path d="M0 0" fill="#000000"/><rect width="1" height="1" fill="none"/></svg>'
    shapes = masks.scan_svg(svg)
    assert [s["kind"] for s in shapes] == ["rectangle", "ellipse", "polygon"]
    a = masks.paint(shapes, (30, 40))
    assert tuple(a[5, 5]) == (255, 0, 0, 255) and tuple(a[15, 25]) == (0, 255, 0, 255) and a[0, 0, 3] == 0
    assert raster.mask_iou(a[:, :, 1] > 0, raster.fill_ellipse(25, 15, 8, 6, (30, 40))) == 1.0
    for bad in ("", "<svg", '<!DOCTYPE x [<!ENTITY a "b">]><svg/>'):
        with pytest.raises(ValueError):
            masks.scan_svg(bad)
