"""What changed between full snapshots (problem 1).

Method: both snapshots of every consecutive pair are united, tagged by side, grouped by key, and each
group is classified from one row hash per side. That is a single aggregation shuffle, and it combines
on the map side: the aggregate is a maximum over a fixed-width number, so a key that holds a third of
all rows shrinks to one row per map task before anything moves.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shapelake.session import materialize

# A row's stamp is its receipt time in microseconds times 10**20 plus its hash moved to 0 .. 2**64-1,
# as DECIMAL(38, 0): the maximum is the row received last, equal times fall to the larger hash.
_SHIFT = Decimal(10**20)
_NEVER = -(10**17)


def row_stamp(received: Column, row_hash: Column) -> Column:
    """Fixed-width number that orders rows by receipt and carries the row hash."""
    micros = F.coalesce(F.unix_micros(received.cast("timestamp")), F.lit(_NEVER))
    moved = row_hash.cast("decimal(20,0)") + F.lit(Decimal(2**63))
    return (micros.cast("decimal(18,0)") * F.lit(_SHIFT) + moved).cast("decimal(38,0)")


def passed_entries(checks: Column) -> Column:
    """Order-free form of a map of checks: its (name, passed) pairs without null ``passed``, sorted."""
    kept = F.filter(F.map_entries(checks), lambda e: e["value"]["passed"].isNotNull())
    pairs = F.transform(kept, lambda e: F.struct(e["key"].alias("k"), e["value"]["passed"].alias("v")))
    return F.coalesce(F.array_sort(pairs), F.expr("cast(array() as array<struct<k:string,v:boolean>>)"))


def digest_value(digest: Column) -> Column:
    """A digest in lower case without outer blanks and without a leading ``sha256:``; null stays apart."""
    text = F.trim(F.regexp_replace(F.trim(F.lower(digest)), "^sha256:", ""))
    return F.coalesce(text, F.lit("\u0000"))


def snapshot_changes(df: DataFrame, snapshot: str, key: Column, received: str, watched: list[Column]) -> DataFrame:
    """Added, removed and changed keys of every snapshot against its neighbour before.

    ``df`` holds full snapshots numbered by ``snapshot`` (gaps allowed: neighbours are taken among the
    numbers present). Of several rows of a key within a snapshot the one received last counts; at equal
    times the larger row hash, so the result doesn't depend on row order. ``watched`` are the compared
    expressions; they should have a form in which equal means unchanged.

    Defined cases: a null key or snapshot number is no record; a null receipt time is older than any;
    a table with one snapshot, or none, gives no rows; other columns, of whatever name, don't matter.

    Output: ``snapshot_no``, ``key``, ``change``.
    """
    rows = df.select(
        F.col(snapshot).alias("no"),
        key.alias("key"),
        row_stamp(F.col(received), F.xxhash64(*watched)).alias("stamp"),
    ).filter("no is not null and key is not null")
    # Two rows per snapshot number; written, so Spark knows the size and broadcasts it while it is under its limit.
    numbers = df.select(F.col(snapshot).alias("no")).filter("no is not null").agg(F.array_sort(F.collect_set("no")).alias("a"))
    pairs = numbers.select(
        F.explode(
            F.expr(
                """concat(
                    transform(slice(a, 2, greatest(size(a) - 1, 0)), x -> named_struct('no', x, 'pair', x, 'after', true)),
                    transform(slice(a, 1, greatest(size(a) - 1, 0)),
                        (x, i) -> named_struct('no', x, 'pair', try_element_at(a, i + 2), 'after', false)))"""
            )
        ).alias("p")
    ).select("p.no", "p.pair", "p.after")
    sides = rows.join(materialize(pairs, "pairs"), "no").groupBy("pair", "key").agg(
        F.max(F.when(~F.col("after"), F.col("stamp"))).alias("old"),
        F.max(F.when(F.col("after"), F.col("stamp"))).alias("new"),
    )
    differs = F.pmod(F.col("old"), F.lit(_SHIFT)) != F.pmod(F.col("new"), F.lit(_SHIFT))
    change = (
        F.when(F.col("old").isNull(), "added")
        .when(F.col("new").isNull(), "removed")
        .when(differs, "changed")
    )
    return sides.select(F.col("pair").alias("snapshot_no"), "key", change.alias("change")).filter("change is not null")
