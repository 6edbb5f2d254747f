"""Schemas that drift between files of a series (problem 4).

Method: every file has a schema fingerprint (its fields and their types); a file's version is its place
in the series' chain of fingerprints. Neighbouring versions are compared, and every difference becomes
an explicit migration step: added, removed, renamed or retyped. A file's fields are then routed through
the chained steps to the series' latest schema by rename, default and cast rules, so that all files read
as one consistent table. The steps are the report of changes.

The lines are parsed once and written as typed lines, one row each. A file's fields and types come from one
combining aggregation over them; its schema and the one before then stand in one row, so gone, new and retyped
fields are array operations. Only the cases of files that lost and gained fields are compared for renames.
Nothing here groups the lines of a file in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shapelake.operators.ranking import lagged
from shapelake.session import materialize

TYPES = ("array", "boolean", "number", "object", "string")


def json_type(schema: Column) -> Column:
    """number, string, boolean, array or object from a variant's schema; null for JSON null."""
    return (
        F.when(schema == "VOID", F.lit(None))
        .when(schema == "STRING", "string")
        .when(schema == "BOOLEAN", "boolean")
        .when(schema.startswith("ARRAY"), "array")
        .when(schema.startswith("OBJECT"), "object")
        .otherwise("number")
    )


def _typed(x: Column) -> Column:
    """A value with its type, and as text: one text per number (adding 0.0 makes -0.0 and 0.0 one value)."""
    kind = json_type(x["schema"])
    number = (F.try_variant_get(x["x"], "$", "double") + F.lit(0.0)).cast("string")
    value = F.when(kind == "number", number).when(kind == "string", F.try_variant_get(x["x"], "$", "string")).when(kind.isNotNull(), F.to_json(x["x"]))
    return F.struct(x["field"].alias("field"), kind.alias("type"), value.alias("value"))


def read_lines(df: DataFrame, body: str = "body", group: str = "context_metrics", case: str = "case_id", delivered: str = "delivered_at") -> DataFrame:
    """One row per distinct line: series, file_no, file_id, line_no, delivered, digest, case_id, fields (array of
    field, type, value). Operators below read it several times, so callers write it once.

    A line is a (file_id, line_no) with its text; one delivered twice comes out once, with the later delivery;
    ``delivered`` may be absent. A line that is not JSON, has text after its object, repeats a key within an
    object, or whose ``group`` is no object, has null fields. Numbers get one text per value (28 and 28.0 are
    equal), arrays and objects a canonical text; JSON null has a null type and value. Values are parsed by the
    JVM. A null file_id is no file.
    """
    at = F.col(delivered) if delivered in df.columns else F.lit(None).cast("timestamp")
    once = df.filter("file_id is not null").groupBy("series", "file_no", "file_id", "line_no", F.col(body).cast("string").alias("text")).agg(F.max(at).alias("delivered"))
    # The parser stops behind the first value, so a line is parsed as a list's only element: text behind it fails.
    parsed = once.withColumn("v", F.try_parse_json(F.concat(F.lit("["), "text", F.lit("]"))))
    parsed = parsed.withColumn("v", F.when(F.try_variant_get("v", "$[1]", "variant").isNull(), F.col("v")))
    entries = F.map_entries(F.try_variant_get("v", f"$[0].{group}", "map<string,variant>"))
    schemas = F.transform(entries, lambda e: F.struct(e["key"].alias("field"), F.schema_of_variant(e["value"]).alias("schema"), e["value"].alias("x")))
    return parsed.select(
        "series",
        "file_no",
        "file_id",
        "line_no",
        "delivered",
        F.xxhash64("text").alias("digest"),
        F.try_variant_get("v", f"$[0].{case}", "string").alias("case_id"),
        schemas.alias("fields"),
    ).withColumn("fields", F.transform("fields", _typed))


def file_history(lines: DataFrame) -> DataFrame:
    """Every file with its schema and that of the file before it in its series, by file_no (ties by file_id):
    series, file_no, file_id, schema (array of field, type), fingerprint, prev_id, prev_schema, moved.

    A field's type is that of most non-null values (ties: the first by name; all null: null). The fingerprint is
    a digest of the sorted (field, type) list; a file without a readable line has the empty fingerprint and is a
    file too. ``moved`` is 1 where the fingerprint differs from the one before, and for the first file.
    """
    fields = lines.select("series", "file_no", "file_id", F.explode_outer("fields").alias("x")).select("series", "file_no", "file_id", "x.field", "x.type")
    counted = fields.groupBy("series", "file_no", "file_id", "field").agg(*[F.count_if(F.col("type") == t).alias(t) for t in TYPES])
    most = F.array_max(F.filter(F.array(*[F.struct(F.col(t).alias("n"), F.lit(-i).alias("r"), F.lit(t).alias("type")) for i, t in enumerate(TYPES)]), lambda x: x["n"] > 0))
    pair = F.when(F.col("field").isNotNull(), F.struct("field", F.col("most.type").alias("type")))
    per = counted.withColumn("most", most).groupBy("series", "file_no", "file_id").agg(F.array_sort(F.collect_list(pair)).alias("schema"))
    text = F.array_sort(F.transform("schema", lambda x: F.concat_ws(":", x["field"], F.coalesce(x["type"], F.lit("null")))))
    per = per.withColumn("fingerprint", F.when(F.size("schema") > 0, F.sha2(F.array_join(text, "\n"), 256)).otherwise(""))
    per = materialize(per.withColumn("now", F.struct("file_id", "schema", "fingerprint")), "schemas")
    out = lagged(per, ["series"], ["file_no", "file_id"], "now", "before")
    moved = F.when(F.col("before.fingerprint") == F.col("fingerprint"), 0).otherwise(1)
    return out.select("series", "file_no", "file_id", "schema", "fingerprint", F.col("before.file_id").alias("prev_id"), F.col("before.schema").alias("prev_schema"), moved.alias("moved"))


def versions(history: DataFrame) -> DataFrame:
    """Every file with its fingerprint, number of fields and version: the number of times its series' fingerprint
    changed up to it (1 for the first)."""
    w = W.partitionBy("series").orderBy("file_no", "file_id")
    return history.select("series", "file_no", "file_id", "fingerprint", F.size("schema").cast("bigint").alias("fields"), F.sum("moved").over(w).alias("version"))


def migration_steps(lines: DataFrame, history: DataFrame) -> DataFrame:
    """Differences between every file and the file before it: file_id (the later), prev_id, change, field,
    new_field, old_type, new_type.

    'renamed': ``field`` is gone, ``new_field`` is new, types are the same, and in all cases of both files
    that hold a value of that type in both (at least one) the values are equal; every such pair comes out.
    'removed' and 'added': gone or new, not renamed. 'retyped': present in both with values of different
    type. ``new_field`` is '' unless renamed. The first file of a series has no steps, and a file with the
    fingerprint of the one before it is not compared.
    """
    names = lambda c: F.transform(c, lambda x: x["field"])
    old, new = F.col("prev_schema"), F.col("schema")
    lost, born = F.array_except(names(old), names(new)), F.array_except(names(new), names(old))
    changed = F.filter(F.array_except(new, old), lambda x: ~F.array_contains(F.col("born"), x["field"]) & x["type"].isNotNull())
    before = lambda x: F.filter(F.col("prev_schema"), lambda y: y["field"] == x["field"])[0]["type"]
    d = history.filter("moved = 1 and prev_id is not null").withColumns({"lost": lost, "born": born})
    d = d.select(
        F.col("file_id").alias("id"),
        "prev_id",
        F.filter(old, lambda x: F.array_contains(F.col("lost"), x["field"])).alias("gone"),
        F.filter(new, lambda x: F.array_contains(F.col("born"), x["field"])).alias("new"),
        F.filter(F.transform(changed, lambda x: F.struct(x["field"].alias("field"), before(x).alias("old"), x["type"].alias("type"))), lambda x: x["old"].isNotNull()).alias("retyped"),
    )

    # A file is the earlier of one pair and the later of another: two wishes for its values at most.
    both = d.filter("size(gone) > 0 and size(new) > 0")
    wish = lambda f, side, fields: F.struct(F.col(f).alias("file_id"), F.col("id"), F.lit(side).alias("side"), F.col(fields).alias("fields"))
    wishes = both.select(F.explode(F.array(wish("prev_id", "g", "gone"), wish("id", "n", "new"))).alias("w")).select("w.file_id", F.struct("w.id", "w.side", "w.fields").alias("w"))
    wishes = wishes.groupBy("file_id").agg(F.collect_list("w").alias("ws"))
    asked = lines.filter("fields is not null and case_id is not null").select("file_id", "case_id", "fields").join(wishes, "file_id").select("case_id", "fields", F.explode("ws").alias("w"))
    values = asked.select("w.id", "case_id", "w.side", F.explode(F.filter("fields", lambda f: F.array_contains(F.col("w.fields"), F.struct(f["field"].alias("field"), f["type"].alias("type"))))).alias("f")).filter("f.type is not null")
    held = values.groupBy("id", "case_id", "f.type", "side", "f.field").agg(F.min("f.value").alias("lo"), F.max("f.value").alias("hi"))
    # What a case holds of the gone and of the new fields, as wide as the change of schema; the pairs of the two
    # sides are counted where they arise.
    side = lambda s: F.collect_list(F.when(F.col("side") == s, F.struct("field", "lo", "hi")))
    cases = held.groupBy("id", "case_id", "type").agg(side("g").alias("g"), side("n").alias("n"))
    pair = lambda x, y: F.struct(x["field"].alias("g"), y["field"].alias("n"), ((x["lo"] == y["lo"]) & (x["hi"] == y["hi"]) & (x["lo"] == x["hi"])).alias("eq"))
    pairs = cases.select("id", "type", F.explode(F.flatten(F.transform("g", lambda x: F.transform("n", lambda y: pair(x, y))))).alias("p"))
    renamed = pairs.groupBy("id", "type", "p.g", "p.n").agg(F.min("p.eq").alias("eq")).filter("eq")
    renamed = renamed.groupBy("id").agg(F.collect_list(F.struct("g", "n", "type")).alias("r"))

    none, untyped = F.lit(""), F.lit(None).cast("string")
    step = lambda change, field, new_field, old_type, new_type: F.struct(
        F.lit(change).alias("change"), field.alias("field"), new_field.alias("new_field"), old_type.alias("old_type"), new_type.alias("new_type")
    )
    gone = F.filter("gone", lambda x: ~F.exists("r", lambda y: y["g"] == x["field"]))
    fresh = F.filter("new", lambda x: ~F.exists("r", lambda y: y["n"] == x["field"]))
    all_ = F.concat(
        F.transform("r", lambda x: step("renamed", x["g"], x["n"], x["type"], x["type"])),
        F.transform(gone, lambda x: step("removed", x["field"], none, x["type"], untyped)),
        F.transform(fresh, lambda x: step("added", x["field"], none, untyped, x["type"])),
        F.transform("retyped", lambda x: step("retyped", x["field"], none, x["old"], x["type"])),
    )
    joined = d.join(renamed, "id", "left").withColumn("r", F.coalesce("r", F.array().cast("array<struct<g:string,n:string,type:string>>")))
    return joined.select(F.col("id").alias("file_id"), "prev_id", F.explode(all_).alias("s")).select("file_id", "prev_id", "s.*")


_ROUTE = "series string, file_id bigint, field string, target string, target_type string, rule string"


def _walk_back(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Reads a series' schemas and renames from its last file to its first and keeps, for the file just
    after, where each of its fields leads. Only that one mapping is held, its size is a schema's width."""
    series = file_id = object()
    after: dict[str, tuple[str, str | None]] = {}  # of the later file: field -> (target, its type)
    here: dict[str, str | None] = {}
    renames: dict[str, str] = {}
    final: dict[str, str | None] | None = None
    out: list[tuple] = []

    def close() -> None:
        nonlocal after, final
        if not isinstance(file_id, int):
            return
        routed: dict[str, tuple[str, str | None]] = {}
        taken: set[str] = set()
        fields = sorted(here, key=lambda f: (f not in renames, f))
        for f in fields:
            to = renames.get(f, f)
            target, kind = after.get(to, (f, here[f]))
            if target in taken:  # the name now belongs to another field's line
                target, kind = f"{f}#{file_id}", here[f]
            taken.add(target)
            routed[f] = (target, kind if kind is not None else here[f])
            rule = "same" if target == f else "renamed"
            out.append((series, file_id, f, *routed[f], rule + ("+cast" if here[f] is not None and here[f] != routed[f][1] else "")))
        if final is None:
            final = {t: k for t, k in routed.values()}
        for t in sorted(final.keys() - taken):
            out.append((series, file_id, None, t, final[t], "default"))
        after = {**{f: x for f, x in after.items() if f not in routed and f not in renames.values()}, **routed}

    for pdf in frames:
        for s, fid, kind, field, extra in zip(pdf["series"], pdf["file_id"], pdf["kind"], pdf["field"], pdf["extra"], strict=True):
            if s != series or fid != file_id:
                close()
                if s != series:
                    after, final = {}, None
                series, file_id, here, renames = s, int(fid), {}, {}
            if kind == "field":
                here[field] = extra
            elif kind == "rename" and extra not in renames.values():
                renames.setdefault(field, extra)
        yield pd.DataFrame(out, columns=["series", "file_id", "field", "target", "target_type", "rule"])
        out.clear()
    close()
    yield pd.DataFrame(out, columns=["series", "file_id", "field", "target", "target_type", "rule"])


def routes(history: DataFrame, steps: DataFrame) -> DataFrame:
    """Where each field of each file goes in its series' latest schema, through all renames after it.

    A removed field keeps its own name (with ``#file_id`` if another line of the series took that name);
    a field of the latest schema that a file lacks gets a 'default' row. A rename out of ``field`` has
    its row under the earlier file, so that the walk from the last file back meets it in time.
    """
    place = history.select("file_id", "series", "file_no")
    fields = history.select("series", "file_no", "file_id", F.explode("schema").alias("x")).select("series", "file_no", "file_id", F.lit("field").alias("kind"), "x.field", F.col("x.type").alias("extra"))
    renames = steps.filter("change = 'renamed'").select(F.col("prev_id").alias("file_id"), F.lit("rename").alias("kind"), "field", F.col("new_field").alias("extra"))
    rows = fields.unionByName(renames.join(place, "file_id"))
    ordered = (
        rows.withColumn("series", F.coalesce("series", F.lit("")))
        .select("series", "file_no", "file_id", "kind", "field", "extra")
        .repartition("series")
        .sortWithinPartitions("series", F.desc("file_no"), F.desc("file_id"), "kind", "field", "extra")
    )
    return ordered.mapInPandas(_walk_back, _ROUTE)


def _last_delivery(lines: DataFrame) -> DataFrame:
    """Of readable lines that were delivered with different texts, the one delivered last (ties: the greatest
    digest). Only such lines, not all, are joined."""
    key = F.struct("delivered", "digest")
    readable = lines.filter("fields is not null")
    twice = readable.groupBy("file_id", "line_no").agg(F.count("*").alias("n"), F.max(key).alias("best")).filter("n > 1")
    twice = materialize(twice.select("file_id", "line_no", F.col("best.digest").alias("best")), "twice")
    return readable.join(twice, ["file_id", "line_no"], "left").filter("best is null or best = digest").drop("best")


def consistent_table(lines: DataFrame, routed: DataFrame) -> DataFrame:
    """All lines in their series' latest schema: file_id, line_no, case_id, field, type, value, rule.

    A value of another type than the target's is cast where it can be (text of a number, a number or
    boolean as text); else the value is null and the rule ends in 'lost'. Default rows have a null value.
    Of a line delivered with different texts the delivery received last counts, as a whole.
    """
    target = F.struct("target", "target_type", F.split("rule", r"\+")[0].alias("rule"))
    per = routed.groupBy("file_id").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("field").isNotNull(), F.struct("field", target.alias("to"))))).alias("to"),
        F.collect_list(F.when(F.col("field").isNull(), target)).alias("absent"),
    )
    joined = _last_delivery(lines).join(per, "file_id")
    none = F.lit(None).cast("string")
    row = lambda to, kind, value: F.struct(to["target"].alias("field"), kind.alias("type"), value.alias("value"), to["target_type"].alias("target_type"), to["rule"].alias("rule"))
    rows = F.concat(F.transform("fields", lambda f: row(F.col("to")[f["field"]], f["type"], f["value"])), F.transform("absent", lambda t: row(t, none, none)))
    present = joined.select("file_id", "line_no", "case_id", F.explode(rows).alias("r")).select("file_id", "line_no", "case_id", "r.*")
    as_number = F.expr("try_cast(value as double)").cast("string")
    as_bool = F.expr("try_cast(value as boolean)").cast("string")
    same = F.col("type").isNull() | (F.col("type") == F.col("target_type"))
    as_list = F.when(F.col("type") == "string", F.to_json(F.array("value"))).otherwise(F.concat(F.lit("["), F.col("value"), F.lit("]")))
    value = (
        F.when(same | (F.col("target_type") == "string"), F.col("value"))
        .when((F.col("target_type") == "number") & (F.col("type") == "string"), as_number)
        .when((F.col("target_type") == "boolean") & (F.col("type") == "string"), as_bool)
        .when(F.col("target_type") == "array", as_list)
    )
    rule = F.when(same, F.col("rule")).otherwise(F.concat("rule", F.when(value.isNull(), F.lit("+lost")).otherwise(F.lit("+cast"))))
    return present.select("file_id", "line_no", "case_id", "field", F.col("target_type").alias("type"), value.alias("value"), rule.alias("rule"))
