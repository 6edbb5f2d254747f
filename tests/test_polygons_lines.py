import numpy as np
import pytest

from shapelake.kernels import lines, polygons, raster


def box(x, y, w, h):
    return np.array([(x, y), (x + w, y), (x + w, y + h), (x, y + h)], float)


def test_cleaning():
    noisy = np.array([(0, 0), (5, 0.3), (10, 0), (10, 5), (10, 10), (0, 10)], float)
    assert len(polygons.drop_collinear(noisy, 1.0)) == 4 and len(polygons.drop_collinear(box(0, 0, 1, 1)[:3], 9.0)) == 3
    lean = np.array([(0, 0), (40, 2), (41, 30), (0, 29)], float)
    snapped = polygons.snap_axes(lean)
    sides = np.abs(np.roll(snapped, -1, 0) - snapped)
    assert len(snapped) == 4 and (sides.min(1)[:3] < 1e-9).sum() >= 2


def test_guarded_simplification_keeps_the_silhouette():
    t = np.linspace(0, 2 * np.pi, 80, endpoint=False)
    ring = np.stack([60 + 40 * np.cos(t), 60 + 40 * np.sin(t)], 1)
    less = polygons.simplify_guarded(ring, 0.004, 0.02, 0.97)
    assert less is not None and len(less) < 60 and polygons.polygon_iou(ring, less) >= 0.97
    assert polygons.simplify_guarded(box(0, 0, 9, 9)) is None


def test_promotion_and_candidates():
    assert polygons.promote(np.vstack([box(3, 4, 30, 20), [(3, 10)]]))[0] == "rectangle"
    t = np.linspace(0, 2 * np.pi, 40, endpoint=False)
    assert polygons.promote(np.stack([50 + 30 * np.cos(t), 40 + 20 * np.sin(t)], 1))[0] == "ellipse"
    assert polygons.promote(box(0, 0, 30, 30), most_area=10) == (None, 0.0)
    mask = np.zeros((40, 50), bool)
    mask[5:30, 10:40] = True
    found = polygons.candidate_shapes(mask)
    best = {k: polygons.measure_shape(mask, v)["iou"] for k, v in found.items()}
    assert best["rectangle"] == best["polygon"] == best["trapezoid"] == 1.0 and best["ellipse"] < 0.9 and polygons.candidate_shapes(mask & False) == {}


def test_measures():
    mask = np.zeros((30, 30), bool)
    mask[5:15, 5:15] = True
    beside = np.zeros_like(mask)
    beside[5:15, 15:25] = True
    m = polygons.measure_shape(mask, box(5, 5, 12, 10), beside, beside, contacts=np.array([(14, 9)]), protected=np.array([(5, 5)]), saved=0.4)
    assert m["over"] == m["leakage"] == m["critical_leakage"] == pytest.approx(0.2) and m["under"] == 0 and m["iou"] == pytest.approx(100 / 120) and m["saved"] == 0.4
    assert m["protected_error"] == 0 and m["contacts_kept"] == 0.0
    gone = polygons.measure_shape(mask, box(20, 20, 0.2, 0.2))
    assert gone["iou"] == 0 and gone["under"] == 1 and gone["contacts_kept"] == 1
    with pytest.raises(ValueError):
        polygons.measure_shape(mask & False, box(0, 0, 3, 3))


def test_unions_and_merging():
    u = polygons.union_outline(box(0, 0, 10, 10), box(5, 0, 10, 10))
    assert polygons.polygon_iou(u, box(0, 0, 15, 10)) == 1.0 and polygons.union_outline(box(0, 0, 4, 4), box(9, 9, 4, 4)) is None
    s = lambda i, p, lab, imp: {"id": i, "points": p, "lab": lab, "importance": imp}
    shapes = [s(1, box(0, 0, 10, 10), (50, 0, 0), 0.2), s(2, box(40, 0, 10, 10), (50, 0, 0), 0.1), s(3, box(10, 0, 10, 10), (52, 0, 0), 0.9), s(4, box(20, 0, 20, 10), (50, 1, 0), 0.5), s(5, box(0, 10, 10, 10), (90, 0, 0), 0.5)]
    left, lost = polygons.merge_same_color(shapes)
    assert [x["id"] for x in left] == [3, 5] and {a for a, _ in lost} == {1, 2, 4}
    assert polygons.polygon_iou(left[0]["points"], box(0, 0, 50, 10)) == 1.0


def test_trust_regions_and_descent():
    p = box(10, 10, 20, 20)
    err = lambda q, **kw: polygons.moved_polygon_error(p, q, 100, 100, **kw)
    assert err(p + 1) is None and err(p[:3]) == "corners" and err(p * np.nan) == "numbers" and err(p - 20) == "canvas" and err(p[::-1]) == "winding"
    assert err(p + 9) == "shift" and err(p[[0, 1, 3, 2]] + 0.5, most_shift=99) in ("crossing", "winding", "area")
    got = {"a": 3.0, "b": -2.0}
    for _ in range(60):
        got = polygons.descend(got, lambda v: (v["a"] - 1) ** 2 + (v["b"] - 4) ** 2, 0.2)
    assert got == pytest.approx({"a": 1.0, "b": 4.0}, abs=1e-3)


def picture():
    a = np.full((120, 160, 3), 30, np.uint8)
    a[60:, :] = 220
    a[20:50, 70:72] = 250
    return a


def test_lines():
    found = lines.structural_lines(picture())
    assert found and found[0][0] > 100 and abs(found[0][1][1] - 60) <= 2 and lines.structural_lines(picture(), "none") == []
    flat = lines.line_support(np.full((50, 50, 3), 9, np.uint8))
    assert flat == {"edge_density": 0.0, "support": 0.0, "lines": 0}
    m = lines.line_support(picture())
    assert m["support"] > 0.8 and m["lines"] >= 1
    assert lines.segments(np.eye(60, dtype=bool), 20, 30, 2)[0] in {(0, 0, 59, 59), (59, 59, 0, 0)}


def test_facets_smoothing_and_budget():
    f = lines.macro_facets(picture())
    assert f["facets"] == 3 and f["large_share"] > 0.9 and 4 <= f["mean_corners"] < 9
    lab = np.zeros((9, 9), int)
    lab[4, 4], lab[0, 0] = 3, -1
    assert (lines.majority_smooth(lab)[1:] == 0).all() and lines.majority_smooth(lab)[0, 0] == -1
    rng = np.random.default_rng(1)
    noise = rng.integers(0, 4, (20, 20))
    rgb = noise[..., None] * np.array([40, 10, 5]) + rng.integers(0, 3, (20, 20, 3))
    for budget in (1, 5, 50):
        out = lines.reduce_components(noise, rgb.astype(float), budget)
        assert len(np.unique(out)) == min(budget, raster.components(noise, 4).max() + 1) and len(np.unique(raster.components(out, 4))) == len(np.unique(out))
