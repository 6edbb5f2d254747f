"""Queries of the general data problems 1, 2, 4 and 5 over the evaluation tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shapelake.operators import drift, nested, references, snapshots
from shapelake.session import blank_to_null, materialize, table

# ---- 1: what changed between full snapshots


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Cases added, removed or changed in determinism_sha256 or hard_evidence.passed per snapshot.

    A blank case_id is a case_id like any other; a null one is none.
    """
    out = snapshots.snapshot_changes(
        table(spark, folder, "case_snapshots"),
        snapshot="snapshot_no",
        key=F.lower(F.trim("case_id")),
        received="received_at",
        watched=[snapshots.digest_value(F.col("determinism_sha256")), snapshots.passed_entries(F.col("hard_evidence"))],
    )
    return out.select("snapshot_no", F.col("key").alias("case_id"), "change")


P1_SQL = """
WITH r AS (
  SELECT snapshot_no AS no, lower(trim(case_id)) AS k, received_at,
         CASE WHEN determinism_sha256 IS NULL THEN '-' ELSE
           '=' || trim(regexp_replace(trim(lower(determinism_sha256)), '^sha256:', '')) END AS d,
         list_sort(list_transform(list_filter(map_entries(hard_evidence), lambda x: x.value.passed IS NOT NULL),
                                  lambda x: x.key || '=' || x.value.passed::VARCHAR)) AS p
  FROM case_snapshots WHERE case_id IS NOT NULL AND snapshot_no IS NOT NULL),
l AS (SELECT no, k, d, coalesce(p, []) AS p FROM r
      QUALIFY row_number() OVER (PARTITION BY no, k ORDER BY received_at DESC NULLS LAST) = 1),
n AS (SELECT no, lag(no) OVER (ORDER BY no) AS before FROM (SELECT DISTINCT no FROM l)),
a AS (SELECT l.*, n.before FROM l JOIN n USING (no) WHERE n.before IS NOT NULL),
b AS (SELECT l.k, l.d, l.p, n.no FROM l JOIN n ON l.no = n.before)
SELECT coalesce(a.no, b.no) AS snapshot_no, coalesce(a.k, b.k) AS case_id,
       CASE WHEN b.k IS NULL THEN 'added' WHEN a.k IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM a FULL JOIN b ON a.no = b.no AND a.k = b.k
WHERE a.k IS NULL OR b.k IS NULL OR a.d <> b.d OR a.p <> b.p
"""

# ---- 2: deeply nested semi-structured records

BATCH_TREE = nested.Node(
    "record",
    (),
    "artifact_version string, screened_case_count string",
    (
        nested.Node(
            "screened_case",
            ("screened_cases",),
            "case_id string, source_kind string, admitted string",
            (
                nested.Node("failure", ("failures",), "category string, stage string, code string, detail string, value string, limit string"),
                nested.Node("details", ("details",), "", (nested.Node("identity_features", ("identity_features",), "", (nested.Node("face", ("face",), "status string, value string, reason string"),)),)),
                nested.Node(
                    "adopted_baseline",
                    ("adopted_baseline",),
                    "bound string, status string, reason string",
                    (nested.Node("binding", ("binding",), "adoption_transaction_id string, baseline_artifact_id string, binding_passed string"),),
                ),
            ),
        ),
    ),
)


def batch_tables(spark: SparkSession, folder: str, only: tuple[str, ...] | None = None) -> nested.FlatTables:
    """The flat tables of raw_records, all or those named, written once to the shared folder. Deliveries of a
    record that carry the same payload are one."""
    emission = nested.emit_tagged(table(spark, folder, "raw_records"), "record_id", "payload", BATCH_TREE, only=only)
    return nested.FlatTables.write(emission, BATCH_TREE)


def millionths(value):
    """A number's text in millionths as a whole number's text, halves to even; null if it is no number."""
    number = value.try_cast("decimal(38,15)")
    return F.bround(number * F.lit(1_000_000), 0).cast("decimal(38,0)").cast("bigint").cast("string")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Failures with a code, face scores and bound baseline artifacts of every screened case, by place."""
    parts = (("failure", F.col("ords")[1], F.col("code")), ("face", F.lit(0), millionths(F.col("value"))), ("binding", F.col("ords")[2], F.col("baseline_artifact_id")))
    flat = batch_tables(spark, folder, tuple(tag for tag, _, _ in parts))
    out = None
    for tag, pos, content in parts:
        rows = flat.rows(tag).select("record_id", F.col("ords")[0].alias("case_pos"), F.lit(tag).alias("item"), pos.alias("item_pos"), content.alias("content"))
        out = rows if out is None else out.unionByName(rows)
    return out.filter("content is not null").distinct()


def p2_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Every row of every flat table with its keys, one telling field, and the names of what it keeps besides."""
    telling = {"record": "artifact_version", "screened_case": "case_id", "failure": "code", "adopted_baseline": "status", "binding": "baseline_artifact_id"}
    flat = batch_tables(spark, folder)
    out = None
    for tag in flat.nodes:
        content = F.col(telling[tag]) if tag in telling else millionths(F.col("value")) if tag == "face" else F.lit(None).cast("string")
        kept = F.array_join(F.array_sort(F.json_object_keys("rest")), ",")
        rows = flat.table(tag).select(F.lit(tag).alias("tag"), "record_id", "pk", "parent_pk", content.alias("content"), F.coalesce(kept, F.lit("")).alias("kept"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _unwrapped(x: str) -> str:
    """SQL: text that holds JSON stands for that JSON, once."""
    return f"CASE WHEN json_type({x}) = 'VARCHAR' AND left(ltrim({x}->>'$'), 1) IN ('{{', '[', '\"') AND json_valid({x}->>'$') THEN ({x}->>'$')::JSON ELSE {x} END"


def _many(x: str) -> str:
    """SQL: a list, or what stands in its place as a list of one."""
    return f"CASE json_type({x}) WHEN 'ARRAY' THEN {x} WHEN 'NULL' THEN NULL ELSE json_array({x}) END"


P2_SQL = f"""
WITH p AS (SELECT DISTINCT record_id, payload::JSON AS v FROM raw_records WHERE json_valid(payload) AND record_id IS NOT NULL),
r AS (SELECT record_id, {_unwrapped('v')} AS v FROM p),
s AS (SELECT record_id, {_unwrapped("(v->'$.screened_cases')")} AS v FROM r WHERE json_type(v) = 'OBJECT'),
sl AS (SELECT record_id, {_many('v')} AS v FROM s),
c0 AS (SELECT record_id, v, unnest(range(json_array_length(v)::BIGINT)) AS i FROM sl WHERE v IS NOT NULL),
c1 AS (SELECT record_id, i, json_extract(v, '$[' || i || ']') AS v FROM c0),
c AS (SELECT record_id, i, {_unwrapped('v')} AS v FROM c1),
d AS (SELECT record_id, i, {_unwrapped("(v->'$.failures')")} AS f, {_unwrapped("(v->'$.details')")} AS d, {_unwrapped("(v->'$.adopted_baseline')")} AS a FROM c WHERE json_type(v) = 'OBJECT'),
e AS (SELECT record_id, i, {_many('f')} AS f, {_unwrapped("(d->'$.identity_features')")} AS d, {_unwrapped("(a->'$.binding')")} AS b FROM d),
g AS (SELECT record_id, i, f, {_unwrapped("(d->'$.face')")} AS face, {_many('b')} AS b FROM e),
fl AS (SELECT record_id, i, f, unnest(range(json_array_length(f)::BIGINT)) AS j FROM g WHERE f IS NOT NULL),
f2 AS (SELECT record_id, i, j, json_extract(f, '$[' || j || ']') AS x FROM fl),
bl AS (SELECT record_id, i, b, unnest(range(json_array_length(b)::BIGINT)) AS j FROM g WHERE b IS NOT NULL),
b2 AS (SELECT record_id, i, j, json_extract(b, '$[' || j || ']') AS x FROM bl),
u AS (
  SELECT record_id, i AS case_pos, 'failure' AS item, j AS item_pos, ({_unwrapped('x')})->>'$.code' AS content FROM f2
  UNION ALL SELECT record_id, i, 'binding', j, ({_unwrapped('x')})->>'$.baseline_artifact_id' FROM b2
  UNION ALL SELECT record_id, i, 'face', 0, round(try_cast(CASE json_type(face) WHEN 'OBJECT' THEN face->>'$.value' WHEN 'BOOLEAN' THEN NULL ELSE face->>'$' END AS DOUBLE) * 1000000)::BIGINT::VARCHAR FROM g)
SELECT DISTINCT record_id, case_pos::INT AS case_pos, item, item_pos::INT AS item_pos, content FROM u WHERE content IS NOT NULL
"""



def _kept(x: str, declared: str, parts: str) -> str:
    """SQL: names of the fields of an object that are neither declared nor rows of a child table, sorted."""
    return (
        f"CASE json_type({x}) WHEN 'OBJECT' THEN array_to_string(list_sort(list_filter(json_keys({x}), lambda k: NOT list_contains([{declared}], k)"
        f" AND NOT (list_contains([{parts}], k) AND coalesce({_gives_rows(f'json_extract({x}, k)')}, false)))), ',') ELSE '' END"
    )


def _gives_rows(x: str) -> str:
    """SQL: whether a part gives its child table a row: not null, and no list of only nulls."""
    y = _unwrapped(x)
    return f"CASE json_type({y}) WHEN 'NULL' THEN false WHEN 'ARRAY' THEN len(list_filter(({y})::JSON[], lambda e: json_type(e) <> 'NULL')) > 0 ELSE true END"


P2_TABLES_SQL = f"""
WITH p AS (SELECT DISTINCT record_id, record_id || '@' || left(md5(payload), 16) AS pk, payload::JSON AS v FROM raw_records WHERE json_valid(payload) AND record_id IS NOT NULL),
r AS (SELECT record_id, pk, {_unwrapped('v')} AS v FROM p),
r1 AS (SELECT * FROM r WHERE json_type(v) = 'OBJECT'),
sl AS (SELECT record_id, pk, {_many('v')} AS v FROM (SELECT record_id, pk, {_unwrapped("(v->'$.screened_cases')")} AS v FROM r1)),
c0 AS (SELECT record_id, pk, v, unnest(range(json_array_length(v)::BIGINT)) AS i FROM sl WHERE v IS NOT NULL),
c1 AS (SELECT record_id, pk, i, json_extract(v, '$[' || i || ']') AS v FROM c0),
c AS (SELECT record_id, pk || '/screened_case:' || i AS pk, pk AS parent_pk, {_unwrapped('v')} AS v FROM c1 WHERE json_type(v) <> 'NULL'),
part AS (
  SELECT 'failure' AS tag, record_id, pk AS parent_pk, {_unwrapped("(v->'$.failures')")} AS v FROM c WHERE json_type(v) = 'OBJECT'
  UNION ALL SELECT 'details', record_id, pk, {_unwrapped("(v->'$.details')")} FROM c WHERE json_type(v) = 'OBJECT'
  UNION ALL SELECT 'adopted_baseline', record_id, pk, {_unwrapped("(v->'$.adopted_baseline')")} FROM c WHERE json_type(v) = 'OBJECT'),
l0 AS (SELECT tag, record_id, parent_pk, {_many('v')} AS v FROM part),
l1 AS (SELECT tag, record_id, parent_pk, v, unnest(range(json_array_length(v)::BIGINT)) AS i FROM l0 WHERE v IS NOT NULL),
l2 AS (SELECT tag, record_id, parent_pk, parent_pk || '/' || tag || ':' || i AS pk, json_extract(v, '$[' || i || ']') AS v FROM l1),
l AS (SELECT tag, record_id, parent_pk, pk, {_unwrapped('v')} AS v FROM l2 WHERE json_type(v) <> 'NULL'),
part2 AS (
  SELECT 'identity_features' AS tag, record_id, pk AS parent_pk, {_unwrapped("(v->'$.identity_features')")} AS v FROM l WHERE tag = 'details' AND json_type(v) = 'OBJECT'
  UNION ALL SELECT 'binding', record_id, pk, {_unwrapped("(v->'$.binding')")} FROM l WHERE tag = 'adopted_baseline' AND json_type(v) = 'OBJECT'),
m0 AS (SELECT tag, record_id, parent_pk, {_many('v')} AS v FROM part2),
m1 AS (SELECT tag, record_id, parent_pk, v, unnest(range(json_array_length(v)::BIGINT)) AS i FROM m0 WHERE v IS NOT NULL),
m2 AS (SELECT tag, record_id, parent_pk, parent_pk || '/' || tag || ':' || i AS pk, json_extract(v, '$[' || i || ']') AS v FROM m1),
m AS (SELECT tag, record_id, parent_pk, pk, {_unwrapped('v')} AS v FROM m2 WHERE json_type(v) <> 'NULL'),
f0 AS (SELECT record_id, pk AS parent_pk, {_many('v')} AS v FROM (SELECT record_id, pk, {_unwrapped("(v->'$.face')")} AS v FROM m WHERE tag = 'identity_features' AND json_type(v) = 'OBJECT')),
f1 AS (SELECT record_id, parent_pk, v, unnest(range(json_array_length(v)::BIGINT)) AS i FROM f0 WHERE v IS NOT NULL),
f2 AS (SELECT record_id, parent_pk, parent_pk || '/face:' || i AS pk, json_extract(v, '$[' || i || ']') AS v FROM f1),
f AS (SELECT record_id, parent_pk, pk, {_unwrapped('v')} AS v FROM f2 WHERE json_type(v) <> 'NULL')
SELECT 'record' AS tag, record_id, pk, NULL AS parent_pk, v->>'$.artifact_version' AS content, {_kept('v', "'artifact_version', 'screened_case_count'", "'screened_cases'")} AS kept FROM r1
UNION ALL SELECT 'screened_case', record_id, pk, parent_pk, v->>'$.case_id', {_kept('v', "'case_id', 'source_kind', 'admitted'", "'failures', 'details', 'adopted_baseline'")} FROM c
UNION ALL SELECT tag, record_id, pk, parent_pk, v->>'$.code', {_kept('v', "'category', 'stage', 'code', 'detail', 'value', 'limit'", "''")} FROM l WHERE tag = 'failure'
UNION ALL SELECT tag, record_id, pk, parent_pk, NULL, {_kept('v', "''", "'identity_features'")} FROM l WHERE tag = 'details'
UNION ALL SELECT tag, record_id, pk, parent_pk, v->>'$.status', {_kept('v', "'bound', 'status', 'reason'", "'binding'")} FROM l WHERE tag = 'adopted_baseline'
UNION ALL SELECT tag, record_id, pk, parent_pk, NULL, {_kept('v', "''", "'face'")} FROM m WHERE tag = 'identity_features'
UNION ALL SELECT tag, record_id, pk, parent_pk, v->>'$.baseline_artifact_id', {_kept('v', "'adoption_transaction_id', 'baseline_artifact_id', 'binding_passed'", "''")} FROM m WHERE tag = 'binding'
UNION ALL SELECT 'face', record_id, pk, parent_pk, round(try_cast(CASE json_type(v) WHEN 'OBJECT' THEN v->>'$.value' WHEN 'BOOLEAN' THEN NULL ELSE v->>'$' END AS DOUBLE) * 1000000)::BIGINT::VARCHAR, {_kept('v', "'status', 'value', 'reason'", "''")} FROM f
"""

# ---- 4: schemas that drift between files


def _drift(spark: SparkSession, folder: str):
    """The typed lines and the files' history, both written: what follows reads them several times."""
    lines = materialize(drift.read_lines(table(spark, folder, "matrix_lines")), "lines")
    return lines, materialize(drift.file_history(lines), "history")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every field added, removed, renamed or retyped between neighbouring files of a series."""
    return drift.migration_steps(*_drift(spark, folder)).select("file_id", "change", "field", "new_field")


_P4_CTES = """
WITH files AS (SELECT DISTINCT series, file_no, file_id FROM matrix_lines WHERE file_id IS NOT NULL),
chain AS (SELECT file_id, lag(file_id) OVER (PARTITION BY series ORDER BY file_no, file_id) AS prev_id FROM files),
b AS (SELECT DISTINCT file_id, line_no, body::JSON AS j FROM matrix_lines WHERE json_valid(body)),
m AS (SELECT file_id, line_no, j->>'$.case_id' AS cid, j->'$.context_metrics' AS m FROM b WHERE json_type(j->'$.context_metrics') = 'OBJECT'),
k AS (SELECT file_id, line_no, cid, m, unnest(json_keys(m)) AS field FROM m),
v AS (SELECT file_id, line_no, cid, field, json_extract(m, '$."' || field || '"') AS x FROM k),
t AS (SELECT file_id, line_no, cid, field, CASE json_type(x) WHEN 'NULL' THEN NULL WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' ELSE 'number' END AS type,
  CASE WHEN json_type(x) IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT') THEN (x->>'$')::DOUBLE::VARCHAR WHEN json_type(x) = 'VARCHAR' THEN x->>'$' ELSE x::VARCHAR END AS value FROM v),
n AS (SELECT file_id, field, type, count(*) AS n FROM t GROUP BY ALL),
s AS (SELECT file_id, field, type FROM n QUALIFY row_number() OVER (PARTITION BY file_id, field ORDER BY type IS NULL, n DESC, type) = 1),
o AS (SELECT c.file_id AS id, c.prev_id, s.field, s.type FROM chain c JOIN s ON s.file_id = c.prev_id),
w AS (SELECT c.file_id AS id, c.prev_id, s.field, s.type FROM chain c JOIN s ON s.file_id = c.file_id WHERE c.prev_id IS NOT NULL),
gone AS (SELECT o.* FROM o LEFT JOIN w USING (id, field) WHERE w.id IS NULL),
born AS (SELECT w.* FROM w LEFT JOIN o USING (id, field) WHERE o.id IS NULL),
tv AS (SELECT DISTINCT file_id, cid, field, type, value FROM t WHERE type IS NOT NULL AND cid IS NOT NULL),
ga AS (SELECT g.id, g.field, g.type, tv.cid, tv.value FROM gone g JOIN tv ON tv.file_id = g.prev_id AND tv.field = g.field AND tv.type = g.type),
ba AS (SELECT g.id, g.field, g.type, tv.cid, tv.value FROM born g JOIN tv ON tv.file_id = g.id AND tv.field = g.field AND tv.type = g.type),
ren AS (SELECT ga.id, ga.field AS g, ba.field AS n FROM ga JOIN ba ON ga.id = ba.id AND ga.cid = ba.cid AND ga.type = ba.type GROUP BY ALL HAVING bool_and(ga.value = ba.value))
"""
P4_SQL = _P4_CTES + """
SELECT id AS file_id, 'renamed' AS change, g AS field, n AS new_field FROM ren
UNION ALL SELECT id, 'removed', field, '' FROM gone WHERE (id, field) NOT IN (SELECT (id, g) FROM ren)
UNION ALL SELECT id, 'added', field, '' FROM born WHERE (id, field) NOT IN (SELECT (id, n) FROM ren)
UNION ALL SELECT o.id, 'retyped', o.field, '' FROM o JOIN w ON o.id = w.id AND o.field = w.field AND o.type <> w.type
"""


P4_VERSIONS_SQL = _P4_CTES + """
, f AS (SELECT file_id, sha256(string_agg(field || ':' || coalesce(type, 'null'), chr(10) ORDER BY field || ':' || coalesce(type, 'null'))) AS fingerprint, count(*) AS fields FROM s GROUP BY file_id),
c AS (SELECT files.series, files.file_no, files.file_id, coalesce(fingerprint, '') AS fingerprint, coalesce(fields, 0) AS fields FROM files LEFT JOIN f USING (file_id)),
d AS (SELECT *, CASE WHEN lag(fingerprint) OVER (PARTITION BY series ORDER BY file_no, file_id) = fingerprint THEN 0 ELSE 1 END AS moved FROM c)
SELECT series, file_no, file_id, fingerprint, fields, sum(moved) OVER (PARTITION BY series ORDER BY file_no, file_id)::BIGINT AS version FROM d
"""


def p4_versions(spark: SparkSession, folder: str) -> DataFrame:
    """Schema fingerprint of every file with its version: the count of changes of fingerprint up to it."""
    return drift.versions(_drift(spark, folder)[1])


def p4_table(spark: SparkSession, folder: str) -> DataFrame:
    """All lines of all files in the latest schema of their series; numbers as numbers, all else as text."""
    lines, history = _drift(spark, folder)
    rows = drift.consistent_table(lines, drift.routes(history, drift.migration_steps(lines, history)))
    number = F.when(F.col("type") == "number", F.col("value").cast("double"))
    return rows.select("file_id", "line_no", "case_id", "field", "type", number.alias("number"), F.when(F.col("type") != "number", F.col("value")).alias("text"), "rule")


# The walk from a series' last file back to its first, one step per file, as a recursive query.
P4_TABLE_SQL = _P4_CTES.replace("WITH files", "WITH RECURSIVE files") + """
, rn AS (SELECT c.prev_id AS file_id, r.g, r.n FROM ren r JOIN chain c ON c.file_id = r.id
         QUALIFY row_number() OVER (PARTITION BY r.id, r.g ORDER BY r.n) = 1 AND row_number() OVER (PARTITION BY r.id, r.n ORDER BY r.g) = 1),
q AS (SELECT f.series, f.file_id, row_number() OVER (PARTITION BY f.series ORDER BY f.file_no DESC, f.file_id DESC) AS pos,
        list({'field': s.field, 'kind': s.type, 'dest': rn.n} ORDER BY rn.n IS NULL, s.field) AS fs
      FROM files f JOIN s USING (file_id) LEFT JOIN rn ON rn.file_id = s.file_id AND rn.g = s.field GROUP BY f.series, f.file_id, f.file_no),
walk AS (
  SELECT DISTINCT series, 0::BIGINT AS pos, NULL::BIGINT AS file_id, []::STRUCT(field VARCHAR, target VARCHAR, kind VARCHAR)[] AS routed, []::STRUCT(field VARCHAR, target VARCHAR, kind VARCHAR)[] AS later FROM q
  UNION ALL
  SELECT series, pos, file_id, routed, list_concat(list_filter(later, lambda x: NOT list_contains(list_transform(routed, lambda y: y.field), x.field) AND NOT list_contains(list_transform(fs, lambda y: coalesce(y.dest, '')), x.field)), routed)
  FROM (
    SELECT series, pos, file_id, fs, later,
      list_transform(raw, lambda x, i: {'field': fs[i].field, 'target': CASE WHEN list_position(list_transform(raw, lambda y: y.target), x.target) < i THEN fs[i].field || '#' || file_id ELSE x.target END,
        'kind': CASE WHEN list_position(list_transform(raw, lambda y: y.target), x.target) < i THEN fs[i].kind ELSE coalesce(x.kind, fs[i].kind) END}) AS routed
    FROM (
      SELECT q.series, q.pos, q.file_id, q.fs, w.later,
        list_transform(q.fs, lambda f: coalesce(list_filter(w.later, lambda y: y.field = coalesce(f.dest, f.field))[1], {'field': f.field, 'target': f.field, 'kind': f.kind})) AS raw
      FROM walk w JOIN q ON q.series IS NOT DISTINCT FROM w.series AND q.pos = w.pos + 1))),
rt AS (SELECT file_id, unnest(routed, max_depth := 2) FROM walk w WHERE pos > 0),
last AS (SELECT series, unnest(routed, max_depth := 2) FROM walk w WHERE pos = 1),
dflt AS (SELECT w.file_id, last.target, last.kind FROM walk w JOIN last ON w.series IS NOT DISTINCT FROM last.series WHERE w.pos > 0 AND NOT list_contains(list_transform(w.routed, lambda x: x.target), last.target)),
xr AS (
  SELECT t.file_id, t.line_no, t.cid AS case_id, r.target AS field, r.kind AS type, t.type IS NULL OR t.type = r.kind AS same, CASE WHEN r.target = t.field THEN 'same' ELSE 'renamed' END AS rule,
    CASE WHEN t.type IS NULL THEN NULL WHEN t.type = r.kind OR r.kind = 'string' THEN t.value
         WHEN r.kind = 'number' AND t.type = 'string' THEN try_cast(t.value AS DOUBLE)::VARCHAR
         WHEN r.kind = 'boolean' AND t.type = 'string' THEN try_cast(t.value AS BOOLEAN)::VARCHAR
         WHEN r.kind = 'array' THEN CASE WHEN t.type = 'string' THEN to_json([t.value])::VARCHAR ELSE '[' || t.value || ']' END END AS value
  FROM t JOIN rt r USING (file_id, field)
  UNION ALL SELECT m.file_id, m.line_no, m.cid, d.target, d.kind, true, 'default', NULL FROM m JOIN dflt d USING (file_id))
SELECT file_id, line_no, case_id, field, type, CASE WHEN type = 'number' THEN value::DOUBLE END AS number, CASE WHEN type <> 'number' THEN value END AS text,
  CASE WHEN same THEN rule WHEN value IS NULL THEN rule || '+lost' ELSE rule || '+cast' END AS rule
FROM xr
"""

# ---- 5: references to records that do not exist


def _artifact(c):
    return blank_to_null(F.regexp_replace(F.trim(c), "^drive:", ""))


def _path(c):
    slashes = F.regexp_replace(F.trim(c), r"[\\/]+", "/")
    return blank_to_null(F.regexp_replace(slashes, r"^(\./)+", ""))


def _kind(kind: str, c):
    """The key of a kind of record; kinds share one key space."""
    return F.concat(F.lit(f"{kind}:"), c)


def reference_parents(spark: SparkSession, folder: str) -> DataFrame:
    """Keys that can be referred to, with their intervals."""
    a = table(spark, folder, "adoptions")
    own = F.concat(F.lit("\u0000"), F.sha2(F.to_json(F.struct(*a.columns)), 256))  # a row without id stands for itself
    a = references.latest(
        a,
        F.coalesce(blank_to_null(F.col("adoption_transaction_id")), own),
        "received_at",
        {"s": references.micros(F.col("adopted_at")), "e": references.micros(F.col("withdrawn_at")), "artifact": F.col("baseline_artifact_id")},
    )
    g = table(spark, folder, "golden_cases").select(
        blank_to_null(F.col("adoption_transaction_id")).alias("id"),
        _artifact(F.col("assets.golden.drive_file_id")).alias("artifact"),
        references.micros(F.col("adopted_at")).alias("s"),
        references.micros(F.col("retired_at")).alias("e"),
    )
    t = references.latest(
        table(spark, folder, "transaction_sets").filter("set_id is not null"),
        F.col("set_id"),
        "received_at",
        {"s": references.micros(F.col("published_at")), "e": references.micros(F.col("retracted_at")), "paths": F.col("transactions.path")},
    )
    parts = [
        a.filter(~F.col("_key").startswith("\u0000")).select(_kind("adoption", F.col("_key")).alias("k"), "s", "e"),
        a.select(_kind("artifact", _artifact(F.col("artifact"))).alias("k"), "s", "e"),
        g.select(_kind("adoption", F.col("id")).alias("k"), "s", "e"),
        g.select(_kind("artifact", F.col("artifact")).alias("k"), "s", "e"),
        t.select(F.explode("paths").alias("p"), "s", "e").select(_kind("path", _path(F.col("p"))).alias("k"), "s", "e"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def reference_rows(spark: SparkSession, folder: str) -> DataFrame:
    """All references with their time."""
    e = table(spark, folder, "evaluations")
    b = F.col("adopted_baseline.binding")
    both = F.array(
        F.struct(F.lit("adoption_transaction_id").alias("f"), _kind("adoption", blank_to_null(b["adoption_transaction_id"])).alias("k")),
        F.struct(F.lit("baseline_artifact_id").alias("f"), _kind("artifact", _artifact(b["baseline_artifact_id"])).alias("k")),
    )
    ev = e.select(F.lit("evaluations").alias("tbl"), F.col("eval_id").alias("row_id"), "evaluated_at", "received_at", F.explode(both).alias("x"))
    ev = ev.select("tbl", F.col("x.f").alias("ref_field"), "row_id", F.col("evaluated_at").alias("at"), "received_at", F.col("x.k").alias("k"))
    s = table(spark, folder, "screened_cases").select(
        F.lit("screened_cases").alias("tbl"),
        F.lit("transaction_path").alias("ref_field"),
        F.col("screen_id").alias("row_id"),
        F.col("screened_at").alias("at"),
        "received_at",
        _kind("path", _path(F.col("transaction_path"))).alias("k"),
    )
    return ev.unionByName(s).select(
        "k",
        references.micros(F.col("at")).alias("t"),
        "tbl",
        "ref_field",
        "row_id",
        F.date_format("at", "yyyy-MM").alias("period"),
        references.micros(F.col("received_at")).alias("received"),
    )


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every reference whose record is missing, deleted or late at its time, with table and month."""
    misses = references.orphan_references(reference_parents(spark, folder), reference_rows(spark, folder))
    return references.one_per_reference(misses)


def p5_by_period(spark: SparkSession, folder: str) -> DataFrame:
    """Orphan references counted per table, field, month and kind."""
    return references.orphans_by_period(p5_found(spark, folder))


_P5_CTES = r"""
WITH a AS (
  SELECT trim(adoption_transaction_id) AS id, adopted_at AS s, withdrawn_at AS e,
         nullif(trim(regexp_replace(trim(baseline_artifact_id), '^drive:', '')), '') AS artifact
  FROM adoptions QUALIFY row_number() OVER (PARTITION BY trim(adoption_transaction_id) ORDER BY received_at DESC) = 1),
t AS (
  SELECT published_at AS s, retracted_at AS e, transactions FROM transaction_sets
  QUALIFY row_number() OVER (PARTITION BY set_id ORDER BY received_at DESC) = 1),
tp AS (SELECT s, e, unnest(transactions).path AS p FROM t),
parents AS (
  SELECT 'adoption:' || id AS k, s, e FROM a
  UNION ALL SELECT 'artifact:' || artifact, s, e FROM a
  UNION ALL SELECT 'adoption:' || trim(adoption_transaction_id), adopted_at, retired_at FROM golden_cases
  UNION ALL SELECT 'artifact:' || trim(regexp_replace(trim(assets.golden.drive_file_id), '^drive:', '')), adopted_at, retired_at FROM golden_cases
  UNION ALL SELECT 'path:' || regexp_replace(regexp_replace(trim(p), '[\\/]+', '/', 'g'), '^(\./)+', ''), s, e FROM tp),
refs AS (
  SELECT 'evaluations' AS tbl, 'adoption_transaction_id' AS ref_field, eval_id AS row_id, evaluated_at AS tm,
         'adoption:' || nullif(trim(adopted_baseline.binding.adoption_transaction_id), '') AS k FROM evaluations
  UNION ALL
  SELECT 'evaluations', 'baseline_artifact_id', eval_id, evaluated_at,
         'artifact:' || nullif(trim(regexp_replace(trim(adopted_baseline.binding.baseline_artifact_id), '^drive:', '')), '') FROM evaluations
  UNION ALL
  SELECT 'screened_cases', 'transaction_path', screen_id, screened_at,
         'path:' || nullif(regexp_replace(regexp_replace(trim(transaction_path), '[\\/]+', '/', 'g'), '^(\./)+', ''), '') FROM screened_cases),
r AS (SELECT DISTINCT tbl, ref_field, row_id, tm, k FROM refs WHERE k IS NOT NULL),
j AS (
  SELECT r.tbl, r.ref_field, r.row_id, r.tm, count(p.k) AS n, coalesce(bool_or(p.s <= r.tm), false) AS begun,
         coalesce(bool_or(p.s <= r.tm AND (p.e IS NULL OR r.tm < p.e)), false) AS live
  FROM r LEFT JOIN parents p ON p.k = r.k GROUP BY r.tbl, r.ref_field, r.row_id, r.tm, r.k),
found AS (
  SELECT tbl, ref_field, row_id, strftime(tm, '%Y-%m') AS period,
         CASE WHEN n = 0 THEN 'missing' WHEN begun THEN 'deleted' ELSE 'late' END AS kind
  FROM j WHERE NOT live)
"""
P5_SQL = _P5_CTES + "SELECT tbl, ref_field, row_id, period, kind FROM found"
P5_PERIOD_SQL = _P5_CTES + "SELECT tbl, ref_field, period, kind, count(*) AS n FROM found GROUP BY ALL"

QUERIES = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p2_tables": p2_tables,
    "p4_found": p4_found,
    "p4_versions": p4_versions,
    "p4_table": p4_table,
    "p5_found": p5_found,
    "p5_by_period": p5_by_period,
}
SQL = {"p1_found": P1_SQL, "p2_found": P2_SQL, "p2_tables": P2_TABLES_SQL, "p4_found": P4_SQL, "p4_versions": P4_VERSIONS_SQL, "p4_table": P4_TABLE_SQL, "p5_found": P5_SQL, "p5_by_period": P5_PERIOD_SQL}
