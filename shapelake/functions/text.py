"""Ids, digests, canonical JSON, lookups and small array helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_id(prefix: str, *parts: Column) -> Column:
    """Prefix and the first 32 hex digits of the SHA-256 of the parts joined by U+001F."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\u001f", *[p.cast("string") for p in parts]), 256), 1, 32))


def is_sha256(value: Column) -> Column:
    """Whether text is a lower-case SHA-256 in hex; null is not."""
    return F.coalesce(value.rlike("^[0-9a-f]{64}$"), F.lit(False))


def canonical_json(**fields: Column) -> Column:
    """JSON text of the fields in order of their names."""
    return F.to_json(F.struct(*[fields[n].alias(n) for n in sorted(fields)]), {"ignoreNullFields": "false"})


def lookup(table: dict[str, float], key: Column, default: float) -> Column:
    """A number by key from a small fixed table, ``default`` for all other keys."""
    entries = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(float(v)))])
    return F.coalesce(F.try_element_at(entries, key), F.lit(float(default)))


def first_label(value: Column, labels: list[str]) -> Column:
    """The first of ``labels`` that the text contains, letter case aside; null if none."""
    text = F.lower(value)
    out = F.lit(None).cast("string")
    for label in reversed(labels):
        out = F.when(text.contains(label.lower()), label).otherwise(out)
    return out


def reasons(**checks: Column) -> Column:
    """Names of the checks that hold, in the order given; null counts as not."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))


def iso_timestamp(at: Column) -> Column:
    """A timestamp as ISO-8601 with microseconds and UTC offset."""
    return F.date_format(at.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
