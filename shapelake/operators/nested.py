"""Deeply nested semi-structured records as related flat tables (problem 2).

Method: one pass over the raw payloads. A depth-first visitor walks each payload along a declared tree
of nodes and emits, for every node it meets, a row of table tag, primary key, parent key and payload; the
record itself has a row, so every parent key links to a row.
The emission is written partitioned by tag, and each table is read back from its own partition with its
own schema. So the payloads are parsed once however many tables come out.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from json.decoder import scanstring
from json.encoder import encode_basestring_ascii

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shapelake.session import scratch_path


@dataclass(frozen=True)
class Node:
    """A table of the flattened tree.

    ``path`` leads from the parent's object to this node's value. Every value on the way may be text that
    holds JSON. At the end an array gives one row per element, anything else is a list of one; null
    elements keep their place in the numbering but give no row. ``schema`` is the payload's DDL schema;
    a value that is no object stands under ``value``. What of an object neither the schema names nor a
    child's rows hold stays with the row, as JSON, under ``rest``.
    """

    tag: str
    path: tuple[str, ...]
    schema: str
    children: tuple[Node, ...] = ()


def all_nodes(root: Node) -> Iterator[Node]:
    """The nodes of a tree, parents first."""
    todo = [root]
    while todo:
        node = todo.pop()
        yield node
        todo += reversed(node.children)


EMISSION = "tag string, record_id bigint, pk string, parent_pk string, ords array<int>, payload string, rest string"
_ARROW = pa.schema(
    [("tag", pa.string()), ("record_id", pa.int64()), ("pk", pa.string()), ("parent_pk", pa.string()), ("ords", pa.list_(pa.int32())), ("payload", pa.string()), ("rest", pa.string())]
)


class _Unreadable(ValueError):
    pass


def _refuse(text: str):
    raise _Unreadable(text)


class RawNumber(str):
    """A number kept as the text it has in the payload, so that no digit is lost on the way."""


_TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\],:"])|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)|(true|false|null))')
_END = re.compile(r"[ \t\n\r]*$")
_WORDS = {"true": True, "false": False, "null": None}


def parse_deep(text: str):
    """The JSON value of ``text`` with a stack of its own, so no depth of nesting is too much."""
    open_: list = []  # containers not closed yet
    keys: list = []  # the key that waits in each open object
    at, done, want = 0, False, "value"  # value, first (value or closing), key, first key, colon, comma
    value = None
    while not done:
        m = _TOKEN.match(text, at)
        if not m:
            raise _Unreadable("no JSON")
        at, mark = m.end(), m.group(1)
        if want in ("key", "first key") and mark == '"':
            keys[-1], at = scanstring(text, at, True)
            want = "colon"
            continue
        if want == "colon" and mark == ":":
            want = "value"
            continue
        if want == "comma" and mark == ",":
            want = "value" if isinstance(open_[-1], list) else "key"
            continue
        closes = (mark == "]" and want in ("first", "comma") and isinstance(open_[-1], list)) or (mark == "}" and want in ("first key", "comma") and isinstance(open_[-1], dict))
        if closes:
            value = open_.pop()
            keys.pop()
        elif want in ("value", "first"):
            if mark in ("{", "["):
                open_.append({} if mark == "{" else [])
                keys.append(None)
                want = "first key" if mark == "{" else "first"
                continue
            if mark == '"':
                value, at = scanstring(text, at, True)
            elif mark is None:
                value = RawNumber(m.group(2)) if m.group(2) is not None else _WORDS[m.group(3)]
            else:
                raise _Unreadable("no value")
        else:
            raise _Unreadable("no JSON")
        done, want = not open_, "comma"
        if open_ and isinstance(open_[-1], list):
            open_[-1].append(value)
        elif open_:
            open_[-1][keys[-1]] = value
    if not _END.match(text, at):
        raise _Unreadable("text after the value")
    return value


def parse(text: str):
    """The JSON value of ``text``; numbers stay text (``RawNumber``). Raises ValueError if unreadable."""
    try:
        return json.loads(text, parse_float=RawNumber, parse_int=RawNumber, parse_constant=_refuse)
    except RecursionError:
        return parse_deep(text)


def unwrap(value):
    """Text that holds JSON (an object, a list or text of such) stands for that JSON, however often it is
    wrapped; all else for itself."""
    while type(value) is str:
        if value.lstrip()[:1] not in ("{", "[", '"'):
            return value
        try:
            value = parse(value)
        except ValueError:
            return value
    return value


class _Mark(str):
    """Punctuation on its way to the output."""


def dump(value, quote_numbers: bool) -> str:
    """Compact ASCII JSON without recursion. Raw numbers stand as text (``quote_numbers``; schemas cast them on
    reading) or as they came. Escaping all else keeps lone surrogates, which Arrow's UTF-8 could not carry."""
    out: list[str] = []
    todo: list = [value]
    while todo:
        v = todo.pop()
        kind = type(v)
        if kind is _Mark:
            out.append(v)
        elif kind is RawNumber:
            out.append(f'"{v}"' if quote_numbers else v)
        elif kind is str:
            out.append(encode_basestring_ascii(v))
        elif kind is dict:
            parts: list = []
            for k, x in v.items():
                parts += [_Mark(("," if parts else "{") + encode_basestring_ascii(k) + ":"), x]
            todo += [_Mark("}" if parts else "{}"), *reversed(parts)]
        elif kind is list:
            parts = []
            for x in v:
                parts += [_Mark("," if parts else "["), x]
            todo += [_Mark("]" if parts else "[]"), *reversed(parts)]
        else:
            out.append("null" if v is None else "true" if v else "false")
    return "".join(out)


def _without(obj: dict, path: tuple[str, ...]) -> dict:
    """``obj`` without what stands at the end of ``path``, which is known to lead somewhere; all beside it stays."""
    if len(path) == 1:
        return {k: v for k, v in obj.items() if k != path[0]}
    inner = unwrap(obj[path[0]])
    inner = unwrap(inner[0]) if isinstance(inner, list) else inner
    return {**obj, path[0]: _without(inner, path[1:])}


class Visitor:
    """Walks one payload depth first and appends tagged rows, all or those of the tags ``only``."""

    def __init__(self, root: Node, declared: dict[str, frozenset[str]], only: frozenset[str] | None = None):
        self.root, self.declared = root, declared
        wanted = {n.tag for n in all_nodes(root)} if only is None else only
        self.emit = wanted
        self.enter = {n.tag for n in all_nodes(root) if any(x.tag in wanted for x in all_nodes(n))}

    def visit(self, record_id: int, delivery: str, payload: str | None, out: list[tuple]) -> None:
        if payload is None:
            return
        try:
            top = unwrap(parse(payload))
        except ValueError:
            return
        if isinstance(top, list) and len(top) == 1:
            top = unwrap(top[0])
        if isinstance(top, dict):
            self._row(self.root, top, record_id, f"{record_id}@{delivery}", None, (), out)

    def _row(self, node: Node, element, record_id: int, pk: str, parent_pk: str | None, ords: tuple[int, ...], out: list[tuple]) -> None:
        own = element if isinstance(element, dict) else {"value": element}
        if isinstance(element, dict):
            for child in node.children:
                if self._children(child, element, record_id, pk, ords, out) and node.tag in self.emit:
                    own = _without(own, child.path)
        if node.tag in self.emit:
            known = self.declared[node.tag]
            rest = {k: v for k, v in own.items() if k not in known}
            out.append((node.tag, record_id, pk, parent_pk, ords, dump({k: v for k, v in own.items() if k in known}, True), dump(rest, False) if rest else None))

    def _children(self, node: Node, parent: dict, record_id: int, parent_pk: str, ords: tuple[int, ...], out: list[tuple]) -> bool:
        """Rows of a child table; whether there are any."""
        value = parent
        for step in node.path:
            if isinstance(value, list) and len(value) == 1:
                value = unwrap(value[0])
            if not isinstance(value, dict):
                return False
            value = unwrap(value.get(step))
        if value is None:
            return False
        any_ = False
        for pos, element in enumerate(value if isinstance(value, list) else [value]):
            element = unwrap(element)
            if element is not None:
                any_ = True
                if node.tag in self.enter:
                    self._row(node, element, record_id, f"{parent_pk}/{node.tag}:{pos}", parent_pk, (*ords, pos), out)
        return any_


def delivery_digest(*columns: Column) -> Column:
    """Sixteen hex digits that tell apart the deliveries of a record."""
    return F.substring(F.md5(F.concat_ws("|", *columns)), 1, 16)


def emit_tagged(
    df: DataFrame, record_id: str, payload: str, root: Node, delivery: Column | None = None, only: tuple[str, ...] | None = None, batch_rows: int = 20_000
) -> DataFrame:
    """All rows of all tables of the tree, tagged, in one pass; with ``only``, the rows of those tags.

    Columns: ``tag``; ``record_id``; ``pk``, the record and its delivery, then the path of tags and positions;
    ``parent_pk``, null for the root; ``ords``, the positions along that path from below the root down;
    ``payload``, the fields that the table's schema names, as JSON; ``rest``, JSON of all else of the object
    that no child table holds, null if there is nothing. A part that gives its child table no row (a null, an
    empty list) stays in ``rest``, so nothing of a readable payload is lost.

    ``delivery`` tells apart the rows of one record (default: a digest of the payload), so keys of different
    deliveries differ. Rows equal in record, delivery and payload have equal keys and equal content.

    Defined cases: null, empty, truncated or otherwise unreadable payloads, scalars and lists of other than one
    element give nothing; a null record id gives nothing, as there would be no key to link by; nesting of any
    depth and any number of wrappings is followed; columns besides those named are not read. One payload is
    handled by one task; its size is the only memory bound.
    """
    declared = {n.tag: frozenset(StructType.fromDDL(n.schema).fieldNames()) if n.schema else frozenset() for n in all_nodes(root)}
    wanted = None if only is None else frozenset(only)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        visitor = Visitor(root, declared, wanted)
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [()] * len(_ARROW)
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _ARROW.types, strict=True)], schema=_ARROW)
            out.clear()
            return batch

        for batch in batches:
            for rid, dl, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if rid is not None:
                    visitor.visit(rid, dl, text, out)
                if len(out) >= batch_rows:
                    yield flush()
        if out:
            yield flush()

    text = F.col(payload).cast("string")
    by = delivery if delivery is not None else delivery_digest(text)
    source = df.select(F.col(record_id).cast("bigint").alias("record_id"), by.cast("string").alias("delivery"), text.alias("payload"))
    return source.mapInArrow(run, EMISSION)


class FlatTables:
    """The written emission: one partition folder per tag, each read with its node's schema."""

    def __init__(self, spark, path: str, root: Node):
        self.spark, self.path = spark, path
        self.nodes = {n.tag: n for n in all_nodes(root)}

    @classmethod
    def write(cls, emission: DataFrame, root: Node, path: str | None = None) -> FlatTables:
        """Write ``emission`` partitioned by tag; by default to the session's shared folder."""
        path = path or scratch_path(emission.sparkSession, "nested")
        emission.write.partitionBy("tag").parquet(path)
        return cls(emission.sparkSession, path, root)

    def rows(self, tag: str) -> DataFrame:
        """Rows of ``tag`` as emitted: record_id, pk, parent_pk, ords, the fields of its schema, and rest.
        A row of the source that was repeated as a whole comes out as often as it was there."""
        node = self.nodes[tag]
        rows = self.spark.read.schema(f"{EMISSION.split(', ', 1)[1]}, tag string").parquet(self.path).filter(F.col("tag") == tag)
        fields = [F.from_json("payload", node.schema).alias("f")] if node.schema else []
        return rows.select("record_id", "pk", "parent_pk", "ords", *fields, "rest").select("record_id", "pk", "parent_pk", "ords", *(["f.*"] if fields else []), "rest")

    def table(self, tag: str) -> DataFrame:
        """Table ``tag`` with unique ``pk``: rows of a source row repeated as a whole are equal and come out once."""
        return self.rows(tag).dropDuplicates(["pk"])
