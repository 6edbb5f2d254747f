import itertools

import numpy as np
import pytest

from shapelake.kernels import boundary, detail, raster


@pytest.mark.parametrize("seed", range(8))
def test_chains_carry_every_regions_area(seed):
    rng = np.random.default_rng(seed)
    lab = raster.components(rng.integers(0, 3, (9, 12)))
    found = boundary.chains(lab)
    sizes = dict(enumerate(np.bincount(lab.reshape(-1)).astype(float)))
    assert boundary.areas(found) == sizes
    steps = [frozenset(p) for c in found for p in zip(c["points"], c["points"][1:], strict=False)]
    assert len(steps) == len(set(steps)) == len(boundary.cracks(lab))
    ends = {c["points"][k] for c in found if not c["closed"] for k in (0, -1)}
    inner = {p for c in found for p in c["points"][1:-1]}
    assert not ends & inner
    thin = boundary.simplified(found, 1.0)
    # inner chains belong to two regions, so what the regions cover is what the outer outline covers: no gaps
    outer = [c for c in thin if c["left"] == boundary.OUTSIDE]
    assert sum(boundary.areas(thin).values()) == pytest.approx(sum(boundary.areas(outer).values()), abs=1e-6)
    for a, b in zip(found, thin, strict=True):
        assert a["points"][0] == b["points"][0] and a["points"][-1] == b["points"][-1] and len(b["points"]) <= len(a["points"])


def test_island_is_a_closed_chain():
    lab = np.zeros((8, 8), int)
    lab[2:6, 3:6] = 1
    found = boundary.chains(lab)
    inner = [c for c in found if c["left"] == 1]
    assert len(found) == 2 and inner[0]["closed"] and inner[0]["right"] == 0
    assert {tuple(p) for p in boundary.simplified(inner, 0.4)[0]["points"]} == {(3, 2), (6, 2), (6, 6), (3, 6)}


def board():
    near = {(y, x): [(y + dy, x + dx) for dy, dx in ((0, 1), (1, 0), (0, -1), (-1, 0)) if 0 <= y + dy < 4 and 0 <= x + dx < 4] for y, x in itertools.product(range(4), repeat=2)}
    num = {k: i for i, k in enumerate(sorted(near))}
    entries = {0: ((20.0, 0, 0), frozenset({7})), 1: ((60.0, 0, 0), frozenset()), 2: ((90.0, 30, 0), frozenset({9}))}
    shapes = {num[k]: detail.Shape(palette=(k[0] + k[1]) % 3, importance=0.1 + num[k] / 100, share=0.06, near=frozenset(num[n] for n in v), lab=entries[(k[0] + k[1]) % 3][0], anchors=frozenset({9}) if num[k] == 2 else frozenset()) for k, v in near.items()}
    shapes[99] = detail.Shape(palette=2, importance=0.0, share=0.001, overlay=True)
    return shapes, entries


def test_detail_budget_reduces_and_keeps_the_rules():
    shapes, entries = board()
    b = detail.Budget(shapes, entries, [detail.Rule(0, 5, 25.0)])
    start = b.groups()
    n = b.reduce(5)
    assert n == b.groups() < start and 99 in b.hidden
    la, lb = entries[b.color[0]][0], entries[b.color[5]][0]
    assert sum((p - q) ** 2 for p, q in zip(la, lb, strict=True)) ** 0.5 > 25
    assert b.color[2] == 2  # the last shape that stands for anchor 9
    fixed = detail.Budget({i: detail.Shape(**{**s.__dict__, "protected": True}) for i, s in shapes.items()}, entries)
    assert fixed.reduce(1) == start and not fixed.recolored and not fixed.hidden
    again = detail.Budget(shapes, entries, [detail.Rule(0, 5, 25.0)])
    again.reduce(5)
    assert again.color == b.color
