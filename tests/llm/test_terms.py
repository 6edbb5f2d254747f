import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shapelake.llm import terms


def brute(rows, max_n):
    """rows: (id, delivery, sequence)"""
    occ, rec = Counter(), {}
    per = {}
    for rid, d, seq in rows:
        seq = [t for t in seq or [] if t is not None]
        for i in range(len(seq)):
            for n in range(1, max_n + 1):
                if i + n <= len(seq):
                    g = tuple(seq[i : i + n])
                    per.setdefault((rid, g), Counter())[d] += 1
    for (rid, g), c in per.items():
        occ[g] += max(c.values())
        rec.setdefault(g, set())
        if rid is not None:
            rec[g].add(rid)
    return {(g, occ[g], len(rec[g])) for g in occ}


@pytest.mark.parametrize(("max_n", "buckets"), [(1, 1), (1, 5), (3, 3)])
def test_ngrams_match_brute_force(spark, max_n, buckets):
    rnd = random.Random(max_n)
    words = ["a", "b", "b_c", "ü", "z" * 300, "日本"]
    rows = [(i, 0, [rnd.choice(words + ["a"] * 4) for _ in range(rnd.randint(0, 6))]) for i in range(200)]
    rows += [(i, 1, s) for i, _, s in rows[:20]]  # delivered again
    rows += [(900, 0, None), (901, 0, [None]), (902, 0, ["a", None, "b"]), (5, 2, ["new"])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id bigint, d int, s array<string>, field string")
    got = terms.ngram_frequency(df, "id", {"f": F.col("s")}, max_n, delivery=F.col("d"), buckets=buckets).collect()
    assert len(got) == len({(r.field, tuple(r.term)) for r in got})
    want = brute(rows, max_n) if max_n == 1 else None
    counts = {(tuple(r.term), r.occurrences, r.records) for r in got}
    if want is not None:
        assert counts == want
    else:  # deliveries of a record are alike here but for the last row
        assert {(g, r) for g, _, r in counts} == {(g, r) for g, _, r in brute(rows, max_n)}
        assert counts == brute(rows, max_n)


def test_hot_term_spreads_over_buckets_and_adds_up(spark):
    df = spark.range(3000).select("id", F.array(F.lit("hot"), F.concat(F.lit("t"), (F.col("id") % 700).cast("string"))).alias("s"))
    got = {tuple(r.term): (r.occurrences, r.records) for r in terms.ngram_frequency(df, "id", {"f": F.col("s")}, 2, buckets=16).collect()}
    assert got[("hot",)] == (3000, 3000) and got[("hot", "t3")] == (5, 5) and len(got) == 1 + 700 * 2


def test_normal_terms(spark):
    values = [" A - b_C\t", "a-b-c", "", "  ", None, " x　Y ", "_x_"]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(terms.normal_term(F.col("v"))).collect()]
    assert got == ["a_b_c", "a_b_c", None, None, None, "x_y", "_x_"]


def test_marks_and_empty_table(spark):
    df = spark.createDataFrame([(i, ["often"] if i < 9 else ["seldom"] if i < 11 else None) for i in range(20)] + [(None, ["seldom"])], "id bigint, s array<string>")
    counts = terms.ngram_frequency(df, "id", {"f": F.col("s")})
    got = {r.term[0]: (r.occurrences, r.records, r.mark) for r in terms.mark_terms(counts, df, "id").collect()}
    assert got == {"often": (9, 9, "common"), "seldom": (3, 2, "rare")}
    none = df.filter("false")
    assert terms.mark_terms(terms.ngram_frequency(none, "id", {"f": F.col("s")}), none, "id").count() == 0


@pytest.mark.parametrize("buckets", [1, 4])
def test_rows_without_id_all_count_with_deliveries(spark, buckets):
    rows = [(None, d, ["a", "b"]) for d in range(100)] + [(None, 7, ["a"])] * 3 + [(1, d, ["a", "b"]) for d in range(5)] + [(2, 0, ["b"])]
    df = spark.createDataFrame(rows, "id bigint, d int, s array<string>")
    got = {tuple(r.term): (r.occurrences, r.records) for r in terms.ngram_frequency(df, "id", {"f": F.col("s")}, 2, delivery=F.col("d"), buckets=buckets).collect()}
    assert got == {("a",): (104, 1), ("b",): (102, 2), ("a", "b"): (101, 1)}


def test_occurrences_do_not_depend_on_the_longest_ngram(spark):
    rnd = random.Random(2)
    rows = [(rnd.randint(0, 30), d, [rnd.choice("abc") for _ in range(rnd.randint(0, 5))]) for d in range(4) for _ in range(40)]
    rows += [(99, 0, ["a", "b"]), (99, 1, ["a", "c"])]
    df = spark.createDataFrame(rows, "id bigint, d int, s array<string>")
    for max_n in (1, 2, 4):
        got = {(tuple(r.term), r.occurrences, r.records) for r in terms.ngram_frequency(df, "id", {"f": F.col("s")}, max_n, delivery=F.col("d"), buckets=3).collect()}
        assert got == brute(rows, max_n)
