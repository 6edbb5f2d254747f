import itertools
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shapelake.kernels import codec, raster, tree

RNG = np.random.default_rng(5)


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 12), st.integers(1, 12), st.sampled_from([1, 2, 3, 4]), st.integers(0, 10**6))
def test_png_round_trip(h, w, n, seed):
    a = np.random.default_rng(seed).integers(0, 256, (h, w, n), dtype=np.uint8)
    assert (codec.decode_png(codec.encode_png(a)) == a).all()


def test_png_filters_and_refusals():
    import struct
    import zlib

    a = RNG.integers(0, 256, (5, 7, 3), dtype=np.uint8).astype(int)
    rows = b""
    for y in range(5):
        line = a[y].reshape(-1)
        up = a[y - 1].reshape(-1) if y else np.zeros(21, int)
        left = np.concatenate([np.zeros(3, int), line[:-3]])
        corner = np.concatenate([np.zeros(3, int), up[:-3]])
        p = left + up - corner
        paeth = [min(((abs(p[i] - v), k, v) for k, v in enumerate((left[i], up[i], corner[i]))))[2] for i in range(21)]
        guess = [np.zeros(21, int), left, up, (left + up) // 2, np.array(paeth)][y]
        rows += bytes([y]) + bytes(((line - guess) % 256).astype(np.uint8))
    png = codec._MAGIC + codec._chunk(b"IHDR", struct.pack(">IIBBBBB", 7, 5, 8, 2, 0, 0, 0)) + codec._chunk(b"IDAT", zlib.compress(rows)) + codec._chunk(b"IEND", b"")
    assert (codec.decode_png(png) == a).all()
    for bad in (b"", b"JFIF", png[:40]):
        with pytest.raises(ValueError):
            codec.decode_png(bad)


@pytest.mark.parametrize("connectivity", [4, 8])
def test_components_match_flood_fill(connectivity):
    for seed in range(6):
        lab = np.random.default_rng(seed).integers(-1, 3, (14, 11))
        got = raster.components(lab, connectivity)
        want, n = np.full(lab.shape, -1), 0
        for y, x in itertools.product(range(14), range(11)):
            if lab[y, x] >= 0 and want[y, x] < 0:
                stack = [(y, x)]
                want[y, x] = n
                while stack:
                    a, b = stack.pop()
                    for dy, dx in itertools.product((-1, 0, 1), repeat=2):
                        c, d = a + dy, b + dx
                        if (dy or dx) and (connectivity == 8 or not (dy and dx)) and 0 <= c < 14 and 0 <= d < 11 and lab[c, d] == lab[y, x] and want[c, d] < 0:
                            want[c, d] = n
                            stack.append((c, d))
                n += 1
        assert (got == want).all()


def test_kmeans_separates_and_repeats():
    p = np.concatenate([RNG.normal(c, 1, (50, 3)) for c in ((0, 0, 0), (60, 0, 0), (0, 60, 0))])
    c, label = raster.kmeans(p, 3)
    assert all(len(set(label[i * 50 : i * 50 + 50])) == 1 for i in range(3)) and len(set(label)) == 3
    c2, label2 = raster.kmeans(p, 3)
    assert (c == c2).all() and (label == label2).all()
    assert len(raster.kmeans(np.zeros((9, 3)), 4)[0]) == 1


def test_smoothing_and_edges():
    a = np.zeros((20, 20, 3), np.uint8)
    a[:, 10:] = 200
    noisy = np.clip(a + RNG.normal(0, 6, a.shape), 0, 255).astype(np.uint8)
    flat = raster.l0_smooth(noisy)
    assert flat[:, :9].std() < noisy[:, :9].std() / 2 and abs(int(flat[5, 15, 0]) - 200) < 12
    e = raster.edges(raster.to_lab(a))
    assert e[:, 9:11].min() == 1 and e[:, :7].max() == 0
    assert raster.gaussian(np.ones((9, 9)), 5) == pytest.approx(np.ones((9, 9)))
    assert raster.resize_nearest(a, 10).shape == (10, 10, 3) and raster.resize_nearest(a, 50) is a


def test_superpixels_partition_the_image():
    a = np.zeros((40, 60, 3), np.uint8)
    a[:20, :30], a[20:, 30:] = (200, 30, 30), (30, 30, 200)
    s = raster.superpixels(raster.to_lab(a), 24)
    assert s.min() == 0 and set(np.unique(s)) == set(range(s.max() + 1)) and 8 <= s.max() < 60
    assert (raster.components(s) == s).sum() >= 0 and raster.components(s).max() == s.max()  # each is connected
    mixed = [len(np.unique(a[s == i].reshape(-1, 3), axis=0)) for i in range(s.max() + 1)]
    assert np.mean(np.array(mixed) == 1) > 0.8


def test_border_flood_finds_the_backdrop():
    a = np.full((30, 30, 3), 250, np.uint8)
    a[8:22, 8:22] = (20, 80, 20)
    a[12:16, 12:16] = 250  # enclosed, no backdrop
    m = raster.border_flood(a)
    assert m[0, 0] and not m[10, 10] and not m[13, 13] and m.sum() == 900 - 196


def test_contour_fills_back_to_the_mask():
    for seed in range(12):
        r = np.random.default_rng(seed)
        m = raster.fill_ellipse(12, 10, r.uniform(3, 10), r.uniform(3, 9), (22, 26)) | raster.fill_polygon(np.array([[4, 4], [20, 6], [8, 18]]) + r.uniform(-2, 2, (3, 2)), (22, 26))
        comp = raster.components(np.where(m, 0, -1), 4)
        m = comp == 0
        holes = raster.components(np.where(m, -1, 0), 8)
        outer = np.unique(np.concatenate([holes[0], holes[-1], holes[:, 0], holes[:, -1]]))
        solid = ~np.isin(holes, outer[outer >= 0])
        assert (raster.fill_polygon(raster.contour(m), m.shape) == solid).all()


def test_simplify_and_shapes():
    square = np.array([[x, 0] for x in range(10)] + [[10, y] for y in range(10)] + [[10 - x, 10] for x in range(10)] + [[0, 10 - y] for y in range(10)], float)
    assert len(raster.simplify(square, 0.5)) == 4
    box = np.zeros((30, 30), bool)
    box[5:20, 4:25] = True
    assert raster.fit_shape(box)["kind"] == "rectangle" and raster.fit_shape(box)["box"] == (4.0, 5.0, 21.0, 15.0)
    disc = raster.fill_ellipse(15, 15, 10, 10, (30, 30))
    assert raster.fit_shape(disc)["kind"] == "circle"
    tri = raster.fill_polygon(np.array([[2, 2], [28, 4], [6, 27]]), (30, 30))
    s = raster.fit_shape(tri)
    assert s["kind"] == "polygon" and s["iou"] >= 0.9 and len(s["points"]) < 9


def brute_cut(nodes, count):
    roots = tree._roots(nodes)

    def ways(i):
        x = nodes[i]
        yield (i,)
        if x.left is not None:
            for a in ways(x.left):
                for b in ways(x.right):
                    yield a + b

    best = {}
    for combo in itertools.product(*(list(ways(r)) for r in roots)):
        cut = tuple(itertools.chain(*combo))
        loss = sum(nodes[i].loss for i in cut)
        best[len(cut)] = min(best.get(len(cut), math.inf), loss)
    n = min(best, key=lambda k: (abs(k - count), k))
    return n, best[n]


def random_forest(seed, n=9):
    r = random.Random(seed)
    regions = {i: (r.randint(5, 200), *(r.uniform(0, 100) * 50 for _ in range(3)), r.randint(10, 60)) for i in range(n)}
    edges = [(a, b, r.randint(1, 9), r.random()) for a, b in itertools.combinations(range(n), 2) if r.random() < 0.4]
    return regions, edges


def test_cuts_are_optimal_nested_and_cover_all_leaves():
    for seed in range(15):
        regions, edges = random_forest(seed)
        nodes, order = tree.merge_forest(regions, edges)
        assert nodes == tree.merge_forest(regions, edges[::-1])[0]
        for count in (1, 3, 5, 20):
            cut = tree.best_cut(nodes, order, count)
            n, loss = brute_cut(nodes, count)
            assert len(cut) == n and sum(nodes[i].loss for i in cut) == pytest.approx(loss)
            assert set(tree.leaves_under(nodes, cut)) == set(regions)
        family = tree.nested_cuts(nodes, order, [6, 4, 2])
        fine, coarse = (tree.leaves_under(nodes, family[k]) for k in (6, 2))
        assert set(fine) == set(coarse) == set(regions)
        to = {}
        for leaf, f in fine.items():
            assert to.setdefault(f, coarse[leaf]) == coarse[leaf]


def test_barriers_hold_for_all_unions():
    regions, edges = random_forest(3)
    nodes, _ = tree.merge_forest(regions, edges, {(0, 1), (2, 5)})
    for i in nodes:
        under = set(tree.leaves_under(nodes, [i]))
        assert not {0, 1} <= under and not {2, 5} <= under
    assert tree.merge_forest({}, []) == ({}, [])
