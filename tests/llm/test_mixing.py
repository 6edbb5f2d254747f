import os
import random

import numpy as np
import pandas as pd
import pytest

from shapelake.llm import mixing, tokens
from shapelake.llm.queries import p7_mix, p7_shares

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.DEFAULT_FILE), reason="no vocabulary file")
TARGETS = "mix_name string, source string, target_weight double, max_repeats int, budget_ratio double"
DOCS = "doc_id bigint, text string, source string, n_tokens int, p double"


def test_walk_keeps_both_totals():
    rnd = random.Random(2)
    walk, want_t, want_d, got_t, got_d = mixing.Walk(), 0.0, 0.0, 0.0, 0.0
    for i in range(5000):
        t, p = rnd.randint(1, 3000), rnd.random()
        want_t, want_d = want_t + t * p, want_d + p
        for payload, taken in walk.push(t, float(t), p, rnd.random()):
            got_t, got_d = got_t + payload * taken, got_d + taken
        assert len(walk.open) <= 2
    open_t, open_d = sum(o[1] * o[2] for o in walk.open), sum(o[2] for o in walk.open)
    assert got_t + open_t == pytest.approx(want_t, rel=1e-6) and got_d + open_d == pytest.approx(want_d, rel=1e-6)


def test_inclusion_probabilities_are_kept():
    rnd, hits, n = random.Random(4), [0] * 12, 4000
    sizes, probs = [3, 50, 7, 900, 20, 1, 64, 5, 5, 5, 300, 40], [0.1 * (i % 9 + 1) for i in range(12)]
    for _ in range(n):
        walk = mixing.Walk()
        for i in range(12):
            for k, taken in walk.push(i, sizes[i], probs[i], rnd.random()):
                hits[k] += taken
        for o in walk.open:
            hits[o[0]] += o[2]
    assert all(abs(h / n - p) < 0.04 for h, p in zip(hits, probs, strict=True))


def test_lanes_keep_both_totals_and_probabilities():
    rng = np.random.default_rng(3)
    for n, lanes in ((0, 4), (1, 4), (7, 4), (5000, 16), (3000, 128)):
        t, p = rng.integers(1, 3000, n), np.where(rng.random(n) < 0.1, 0.0, rng.random(n))
        got, decided = mixing.fly_lanes(t, p, rng.random(n), lanes)
        assert got.sum() == pytest.approx(p.sum()) and (got * t).sum() == pytest.approx((p * t).sum())
        assert (~decided).sum() <= 2 * lanes and set(got[decided]) <= {0.0, 1.0}
    t, p = rng.integers(1, 50, 40), rng.random(40)
    mean = np.mean([mixing.fly_lanes(t, p, rng.random(40), 4)[0] for _ in range(4000)], 0)
    assert np.abs(mean - p).max() < 0.04


def test_a_long_stream_gives_the_same_however_it_arrives():
    rng = np.random.default_rng(5)
    n = 2 * mixing.CHUNK + 777
    pdf = pd.DataFrame({"mix_name": "m", "source": "s", "doc_id": range(n), "n_tokens": rng.integers(1, 900, n), "base": 1, "p": 0.3, "coin": rng.random(n), "size": np.repeat([3, 4], [n - 900, 900]), "bucket": 0})
    runs = [pd.concat(mixing._fly(iter([pdf.iloc[i : i + k] for i in range(0, n, k)]))).sort_values("doc_id").reset_index(drop=True) for k in (n, 1000, 3333)]
    for r in runs[1:]:
        pd.testing.assert_frame_equal(runs[0], r)
    r = runs[0]
    assert len(r) == n and r.taken.isna().sum() <= 4
    reached = (r.n_tokens * r.taken.fillna(0).astype(float)).sum() + (r.n_tokens * r.p)[r.taken.isna()].sum()
    assert reached == pytest.approx((pdf.n_tokens * pdf.p).sum())


def docs(spark):
    rnd = random.Random(7)
    rows = []
    for s, n in (("big", 600), (" BIG ", 100), ("mid", 150), ("small", 20), (None, 10), ("", 5)):
        rows += [(len(rows) + i, "word " * rnd.randint(1, 60), s, 0, 0.5) for i in range(n)]
    rows += [(9001, None, "mid", 0, 0.1), (9002, "", "mid", 0, 0.1), (9003, "word " * 5000, "big", 1, 1.0)]
    return spark.createDataFrame(rows, DOCS)


def test_shares_caps_and_sizes(spark):
    t = [("m", "Big", 2.0, 1, 0.5), ("m", "mid ", 1.0, 2, 0.5), ("m", "small", 1.0, None, 0.5), ("m", "none", 1.0, 3, 0.5), ("m", "mid", 0.0, 9, 0.5), ("zero", "big", 0.0, 1, 1.0)]
    mixed, plan = mixing.mix_documents(docs(spark), spark.createDataFrame(t, TARGETS))
    rows = mixed.toPandas()
    assert not rows.duplicated(["mix_name", "doc_id"]).any() and (rows.copies > 0).all() and not rows.doc_id.isin([9001, 9002]).any()
    s = mixing.mix_shares(mixed, plan).toPandas().set_index(["mix_name", "source"])
    assert s.loc[("m", "mid"), "most_copies"] <= 2 and s.loc[("m", "big"), "most_copies"] <= 1
    assert s.loc[("m", "big"), "reached_share"] == pytest.approx(0.5, abs=0.01)
    assert s.loc[("m", "mid"), "reached_share"] == pytest.approx(0.25, abs=0.01)
    assert s.loc[("m", "none"), "tokens"] == 0 and s.loc[("zero", "big"), "tokens"] == 0
    assert s.loc["m", "reached_share"].sum() == pytest.approx(1.0)


def test_priority_size_fills_up(spark):
    t = [("m", "big", 1.0, 5, 1.0), ("m", "small", 1.0, 2, 1.0)]
    got = {}
    for priority in ("shares", "size"):
        mixed, plan = mixing.mix_documents(docs(spark), spark.createDataFrame(t, TARGETS), priority=priority)
        got[priority] = mixing.mix_shares(mixed, plan).toPandas().set_index("source")
    assert got["shares"].loc["small", "reached_share"] == pytest.approx(0.5, abs=0.01)
    assert got["size"].mix_tokens.iloc[0] == pytest.approx(got["size"].budget_tokens.iloc[0], rel=0.01)
    assert got["size"].loc["small", "most_copies"] == 2


def test_same_input_same_mix_in_any_order_and_empty_tables(spark):
    d, t = docs(spark), spark.createDataFrame([("m", "big", 1.0, 3, 0.7), ("m", "mid", 1.0, 3, 0.7)], TARGETS)
    runs = [mixing.mix_documents(x, t, buckets=4)[0].toPandas().sort_values("doc_id").reset_index(drop=True) for x in (d, d.orderBy("text").repartition(3))]
    pd.testing.assert_frame_equal(runs[0], runs[1])
    assert mixing.mix_documents(d.filter("false"), t)[0].count() == 0
    assert mixing.mix_documents(d, t.filter("false"))[0].count() == 0


def test_whole_tables(spark):
    folder = "/root/testdata/sf0.1"
    s = p7_shares(spark, folder).toPandas()
    live = s[s.want_tokens > 0]
    assert ((live.tokens - live.want_tokens).abs() / live.want_tokens < 0.005).all()
    assert (s.most_copies <= s.max_repeats.fillna(1e9)).all()
    assert p7_mix(spark, "/root/testdata/sf0.001").count() > 0
