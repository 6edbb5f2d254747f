import json
from collections import Counter, defaultdict

import pyarrow.parquet as pq

from shapelake.operators import drift
from shapelake.plans import data_queries as Q

KIND = {bool: "boolean", int: "number", float: "number", str: "string", list: "array", dict: "object"}
SCHEMA = "series string, file_no int, file_id bigint, line_no int, body string, v int, type string"


def canon(v):
    return json.dumps(float(v) if KIND[type(v)] == "number" else v, sort_keys=True)


def brute(rows):
    files, seen = {}, set()
    data = defaultdict(lambda: defaultdict(list))
    for series, no, fid, line, body in rows:
        files[fid] = (series, no)
        if (fid, line) in seen:
            continue
        try:
            j = json.loads(body)
            items = j["context_metrics"].items()
        except (ValueError, TypeError, KeyError, AttributeError):
            continue
        seen.add((fid, line))
        for k, v in items:
            data[fid][k].append((j.get("case_id"), v))
    kind = {}
    for fid in files:
        for k, vs in data[fid].items():
            c = Counter(KIND[type(v)] for _, v in vs if v is not None)
            kind[fid, k] = min(c, key=lambda t: (-c[t], t)) if c else None
    out = set()
    by = defaultdict(list)
    for fid, (s, no) in files.items():
        by[s].append((no, fid))
    for order in by.values():
        order.sort()
        for (_, a), (_, b) in zip(order, order[1:], strict=False):
            gone, new = set(data[a]) - set(data[b]), set(data[b]) - set(data[a])
            done = set()
            for g in gone:
                for n in new:
                    t = kind[a, g]
                    if t is None or t != kind[b, n]:
                        continue
                    va, vb = defaultdict(set), defaultdict(set)
                    for d, vs in ((va, data[a][g]), (vb, data[b][n])):
                        for c, v in vs:
                            if v is not None and KIND[type(v)] == t and c is not None:
                                d[c].add(canon(v))
                    both = va.keys() & vb.keys()
                    if both and all(va[c] == vb[c] and len(va[c]) == 1 for c in both):
                        out.add((b, "renamed", g, n))
                        done |= {("g", g), ("n", n)}
            out |= {(b, "removed", g, "") for g in gone if ("g", g) not in done}
            out |= {(b, "added", n, "") for n in new if ("n", n) not in done}
            for k in set(data[a]) & set(data[b]):
                if kind[a, k] and kind[b, k] and kind[a, k] != kind[b, k]:
                    out.add((b, "retyped", k, ""))
    return out


def test_matches_brute_force_on_whole_tables(spark):
    for sf in ("sf0.001", "sf0.01", "sf0.1"):
        rows = pq.read_table(f"/root/testdata/{sf}/matrix_lines.parquet").to_pylist()
        want = brute([(r["series"], r["file_no"], r["file_id"], r["line_no"], r["body"]) for r in rows])
        got = Q.p4_found(spark, f"/root/testdata/{sf}").collect()
        assert want and {tuple(r) for r in got} == want and len(got) == len(want)


def line(series, no, fid, ln, case, **m):
    return (series, no, fid, ln, json.dumps({"case_id": case, "context_metrics": m}), 1, "x")


ROWS = [
    line("s", 1, 11, 1, "a", old=1, keep=True, lost="x", t="7"),
    line("s", 1, 11, 2, "b", old=2.5, keep=None, t="8"),
    line("s", 1, 11, 2, "b", old=2.5, keep=None, t="8"),  # the line again
    line("s", 4, 12, 1, "a", new=1.0, keep=False, t=7),
    line("s", 4, 12, 2, "b", new=2.5, t="stray"),
    line("s", 4, 12, 3, "c", new=9, t=1),
    ("s", 4, 12, 4, '{"case_id": "a", "context_metrics": {"new": 1', 1, "x"),
    ("s", 4, 12, 5, '{"case_id": "a", "context_metrics": []}', 1, "x"),
    ("s", 4, 12, 6, None, 1, "x"),
    ("s", 4, 12, 7, '{"case_id": "a", "context_metrics": {"junk": 1}} more', 1, "x"),
    ("s", 4, 12, 8, '{"case_id": "a", "context_metrics": {"junk": 1}}}', 1, "x"),
    ("s", 4, 12, 9, '{"case_id": "a", "context_metrics": {"junk": 1}}, {}', 1, "x"),
    ("s", 6, 13, 1, "no json at all", 1, "x"),
    line("s", 9, 14, 1, "a", last=1, t=3),
    line("other", 1, 21, 1, "a", p=[1], q={"a": 1}),
]


def test_steps_of_each_kind(spark):
    got = steps(spark, ROWS)
    assert got == brute([r[:5] for r in ROWS])
    assert (12, "renamed", "old", "new") in got and (12, "retyped", "t", "") in got and (13, "removed", "new", "") in got


def steps(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    lines = drift.read_lines(df)
    return {(r.file_id, r.change, r.field, r.new_field) for r in drift.migration_steps(lines, drift.file_history(lines)).collect()}


def test_empty_table_and_one_file(spark):
    assert steps(spark, []) == set()
    assert steps(spark, ROWS[:2]) == set()


def consistent(df):
    lines = drift.read_lines(df)
    history = drift.file_history(lines)
    return drift.consistent_table(lines, drift.routes(history, drift.migration_steps(lines, history))).collect()


def test_a_line_delivered_with_two_texts_is_taken_whole_from_the_last(spark):
    rows = [("s", 1, 1, 1, json.dumps({"case_id": c, "context_metrics": m}), at) for c, m, at in (("a", {"x": 9, "y": 1}, 2), ("b", {"x": 1, "z": 5}, 3), ("c", {"x": 7}, 1))]
    df = spark.createDataFrame([*rows, ("s", 1, 1, 1, "cut off {", 9), rows[1]], "series string, file_no int, file_id bigint, line_no int, body string, at int")
    df = df.withColumn("delivered_at", df["at"].cast("timestamp"))
    got = {(r.case_id, r.field, r.value) for r in consistent(df) if r.rule == "same"}
    assert got == {("b", "x", "1.0"), ("b", "z", "5.0")}


def test_consistent_table_chains_renames_defaults_and_casts(spark):
    rows = [
        line("s", 1, 1, 1, "a", x="5", gone=1),
        line("s", 2, 2, 1, "a", y="5"),
        line("s", 3, 3, 1, "a", z="5", n=1),
        line("s", 4, 4, 1, "a", z=6, n=True),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.file_id, r.field): (r.value, r.type, r.rule) for r in consistent(df)}
    assert got[1, "z"] == ("5.0", "number", "renamed+cast")
    assert got[2, "z"] == ("5.0", "number", "renamed+cast")
    assert got[3, "z"] == ("5.0", "number", "same+cast")
    assert got[1, "n"] == (None, "boolean", "default")
    assert got[3, "n"][2] == "same+lost"
    assert got[1, "gone"] == ("1.0", "number", "same")


def test_every_readable_line_has_the_latest_schema(spark, data):
    df = Q.p4_table(spark, data).toPandas()
    assert not df.duplicated(["file_id", "line_no", "field"]).any()
    raw = pq.read_table(f"{data}/matrix_lines.parquet").to_pandas()
    for _, files in raw.groupby("series"):
        final = None
        for fid in files.sort_values("file_no", ascending=False).file_id.drop_duplicates():
            fields = df[df.file_id == fid].groupby("line_no").field.agg(set)
            if final is None and len(fields):
                final = set.union(*fields)
            if len(fields):
                # a line may lack a field its file has; the file as a whole covers the latest schema
                assert final <= set.union(*fields)
