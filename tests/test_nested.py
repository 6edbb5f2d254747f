import json

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from shapelake.operators import nested
from shapelake.plans import data_queries as Q


def brute(rows):
    """p2_found by plain recursion over json.loads."""

    def text(x):
        while isinstance(x, str):
            try:
                y = json.loads(x)
            except ValueError:
                return x
            if not isinstance(y, (dict, list, str)):
                return x
            x = y
        return x

    def many(x):
        x = text(x)
        return [text(e) for e in (x if isinstance(x, list) else [] if x is None else [x])]

    out = set()
    for rid, payload in rows:
        try:
            root = text(json.loads(payload))
        except (ValueError, TypeError):
            continue
        if not isinstance(root, dict):
            continue
        for i, case in enumerate(many(root.get("screened_cases"))):
            if not isinstance(case, dict):
                continue
            for j, f in enumerate(many(case.get("failures"))):
                if isinstance(f, dict) and f.get("code") is not None:
                    out.add((rid, i, "failure", j, f["code"]))
            d = text(case.get("details"))
            features = text(d.get("identity_features")) if isinstance(d, dict) else None
            face = text(features.get("face")) if isinstance(features, dict) else None
            face = face.get("value") if isinstance(face, dict) else face
            try:
                if face is not None and not isinstance(face, bool):
                    out.add((rid, i, "face", 0, str(round(float(face) * 1e6))))
            except (ValueError, TypeError):
                pass
            ab = text(case.get("adopted_baseline"))
            for j, b in enumerate(many(ab.get("binding")) if isinstance(ab, dict) else []):
                if isinstance(b, dict) and b.get("baseline_artifact_id") is not None:
                    out.add((rid, i, "binding", j, b["baseline_artifact_id"]))
    return out


def test_matches_brute_force_on_whole_table(spark):
    for sf in ("sf0.001", "sf0.01"):
        rows = pq.read_table(f"/root/testdata/{sf}/raw_records.parquet", columns=["record_id", "payload"]).to_pylist()
        want = brute([(r["record_id"], r["payload"]) for r in rows])
        got = Q.p2_found(spark, f"/root/testdata/{sf}").collect()
        assert len(want) > 100 and {tuple(r) for r in got} == want and len(got) == len(want)


CASES = [
    None,
    "",
    "   ",
    "null",
    "[]",
    "7",
    '{"screened_cases": [{"failures": [null, {"code": "a"}, {"code": null}, "x", {"code": "a"}]}]}',
    '{"screened_cases": {"failures": {"code": "solo", "causes": [{"code": "deep"}]}, "details": {"identity_features": {"face": "5.0e-01"}, "face": 3}}}',
    '{"screened_cases": [null, {"details": "{\\"identity_features\\": {\\"face\\": {\\"value\\": 0}}}", "adopted_baseline": {"binding": [null, {"baseline_artifact_id": "z"}]}}]}',
    '{"screened_cases": [{"details": {"identity_features": {"face": true}}, "failures": "{\\"code\\": \\"t\\"}"}]}',
    '{"screened_cases": [{"failures": [{"code": "\\ud800 odd \\u0000"}]}]',
    '{"screened_cases": [{"details": {"identity_features": {"face": NaN}}}]}',
    json.dumps(json.dumps({"screened_cases": [{"failures": [{"code": "twice"}]}]})),
    '{"screened_cases": [{"failures": [{"code": "%s"}]}]}' % ("long " * 50_000),
]


def test_shapes_and_bad_payloads(spark, tmp_path):
    rows = [(i, p, "clash", "clash") for i, p in enumerate(CASES)] + [(None, CASES[6], "", ""), (6, CASES[6], "", "")]
    df = spark.createDataFrame(rows, "record_id bigint, payload string, tag string, ords string")
    df.write.parquet(f"{tmp_path}/raw_records.parquet")
    got = Q.p2_found(spark, str(tmp_path)).collect()
    assert len(got) == len(set(got))
    assert {tuple(r) for r in got} == brute([(r[0], r[1]) for r in rows if r[0] is not None])
    assert {r.content for r in got if r.item == "face"} == {"500000", "0"}


def test_empty_table_and_links(spark, data):
    empty = spark.createDataFrame([], "record_id bigint, payload string")
    flat = nested.FlatTables.write(nested.emit_tagged(empty, "record_id", "payload", Q.BATCH_TREE), Q.BATCH_TREE)
    assert flat.table("failure").count() == 0 and "code" in flat.table("failure").columns
    flat = Q.batch_tables(spark, data)
    parents = {c.tag: n.tag for n in flat.nodes.values() for c in n.children}
    assert flat.table("record").filter("parent_pk is not null").count() == 0
    for tag in flat.nodes:
        child = flat.table(tag)
        n = child.count()
        assert n > 0 and child.select("pk").distinct().count() == n
        if tag in parents:
            up = flat.table(parents[tag]).select(F.col("pk").alias("p"))
            assert child.join(up, child.parent_pk == F.col("p"), "left_anti").count() == 0


def restore(flat):
    """The readable payloads put together again from the flat tables, by key."""
    rows = {}
    for tag, node in flat.nodes.items():
        for r in flat.table(tag).collect():
            own = {f: r[f] for f in r.asDict() if f not in ("record_id", "pk", "parent_pk", "ords", "rest") and r[f] is not None}
            rows[r.pk] = (node, r, {**own, **json.loads(r.rest or "{}")})
    for pk in sorted(rows, key=lambda k: (-k.count("/"), k)):
        node, r, own = rows[pk]
        if r.parent_pk is not None:
            rows[r.parent_pk][2].setdefault(node.path[-1], []).append(own)
    return {pk: own for pk, (_, r, own) in rows.items() if r.parent_pk is None}


def test_nothing_is_lost_and_keys_tell_deliveries_apart(spark):
    case = {"case_id": "c", "note": {"deep": [1, 2.50]}, "failures": [{"code": "a", "part": {"x": None}}], "empty": [], "adopted_baseline": {"status": "s", "more": "m", "binding": {"baseline_artifact_id": "b", "extra": [7]}}}
    case["details"] = {"note": "n", "identity_features": {"hair": 0.5, "face": {"value": "0.25", "by": "me"}}}
    whole = json.dumps({"screened_cases": [case], "batch": True}).replace("2.5]", "2.50]")
    rows = [(1, whole), (1, json.dumps({"screened_cases": [{"case_id": "d", "failures": []}]})), (1, whole)]
    df = spark.createDataFrame(rows, "record_id bigint, payload string")
    flat = nested.FlatTables.write(nested.emit_tagged(df, "record_id", "payload", Q.BATCH_TREE), Q.BATCH_TREE)
    assert flat.table("screened_case").count() == 2 and flat.rows("screened_case").count() == 3
    want = {**case, "details": [{"note": "n", "identity_features": [{"hair": 0.5, "face": [{"value": "0.25", "by": "me"}]}]}]}
    want["adopted_baseline"] = [{"status": "s", "more": "m", "binding": [{"baseline_artifact_id": "b", "extra": [7]}]}]
    got = sorted(restore(flat).values(), key=lambda x: len(str(x)))
    assert got == [{"screened_cases": [{"case_id": "d", "failures": []}]}, {"screened_cases": [want], "batch": True}]
    assert '"deep":[1,2.50]' in flat.table("screened_case").filter("case_id = 'c'").first().rest


def test_any_depth_and_any_number_of_wrappings(spark):
    deep = "[" * 200_000 + "]" * 200_000
    body = '{"screened_cases": [{"failures": [{"code": "deep", "part": %s}]}]}' % deep
    wrapped = json.dumps({"screened_cases": [{"failures": [{"code": "w"}]}]})
    for _ in range(12):
        wrapped = json.dumps(wrapped)
    df = spark.createDataFrame([(1, body), (2, wrapped), (3, body[:-1])], "record_id bigint, payload string")
    flat = nested.FlatTables.write(nested.emit_tagged(df, "record_id", "payload", Q.BATCH_TREE), Q.BATCH_TREE)
    rows = {r.record_id: r for r in flat.table("failure").collect()}
    assert {k: r.code for k, r in rows.items()} == {1: "deep", 2: "w"} and rows[1].rest == '{"part":%s}' % deep


def test_parser_without_recursion_agrees_with_the_other():
    for text in ['{"a": [1, -2.5e3, "x\\u0041\\"", true, null, {}], "b": {"c": []}, "a": 2}', "[]", "{}", ' "s" ', "3", "[1,]", "{,}", '{"a"}', '{"a":}', "[1 2]", "]", "", "[", '{"a":1}x', "01", "NaN", "[1}", '{"a":[}']:
        try:
            want = json.loads(text, parse_float=nested.RawNumber, parse_int=nested.RawNumber, parse_constant=nested._refuse)
        except ValueError:
            want = ValueError
        try:
            got = nested.parse_deep(text)
        except ValueError:
            got = ValueError
        assert got == want, text
        if want is not ValueError:
            assert json.loads(nested.dump(got, False)) == json.loads(text)
