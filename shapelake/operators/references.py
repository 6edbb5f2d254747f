"""References to records that do not exist, or not at that time (problem 5).

Method: the key space is cut into ranges; the parents of each range stand as sorted arrays; batches of
references are probed against them by vectorised binary search; the misses come out and are aggregated.

The range of a key is a range of its 64-bit digest: ranges of equal width hold equally many distinct keys,
so no bounds need to be sampled, and equality of the keys themselves is checked at the probe.

The number of ranges follows from the number of parents and references, so a range stays small at any scale.

One key may hold a third of all rows, on either side. Counts per coarse range of the digest tell where such a
key can be; only there keys are counted. A key with more intervals or references than a parameter has parts of
its own: its intervals are cut into slices of time, a slice holding those that begin in it and what the earlier
slices leave (whether any began, and the latest end), so it answers for its times alone; a slice with more
references than a parameter is split by a salt of the row, and the slice's intervals go to every split. Keys
that are not hot are never copied, so rows stay linear in the input. References are streamed, never gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shapelake.session import materialize, shuffle_partitions

_FAR = 2**62  # later than any time in microseconds
_NULL_TIME = -(2**62)  # earlier than any
_OUT = "tbl string, ref_field string, row_id bigint, period string, kind string, received bigint"
_OUT_ARROW = pa.schema(
    [("tbl", pa.string()), ("ref_field", pa.string()), ("row_id", pa.int64()), ("period", pa.string()), ("kind", pa.string()), ("received", pa.int64())]
)


def micros(c: Column) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone (the session's zone is UTC)."""
    return F.unix_micros(c.cast("timestamp"))


def latest(df: DataFrame, key: Column, received: str, fields: dict[str, Column]) -> DataFrame:
    """Of several rows of a key the one received last (ties: the greatest field values). Combines map-side."""
    kept = F.max(F.struct(micros(F.col(received)).alias("_at"), *[c.alias(n) for n, c in fields.items()]))
    return df.groupBy(key.alias("_key")).agg(kept.alias("_r")).select("_key", *[F.col(f"_r.{n}").alias(n) for n in fields])


class _Range:
    """Parents of one range as sorted arrays."""

    def __init__(self, h: np.ndarray, keys: list, start: np.ndarray, end: np.ndarray):
        # Rows come sorted by (h, k, start). Each key is a block; within it, ``until`` is the greatest end
        # of the intervals begun so far, so one lookup tells whether any of them still lives.
        n = len(h)
        first = np.ones(n, bool)
        if n > 1:
            same = h[1:] == h[:-1]
            for i in np.flatnonzero(same):
                same[i] = keys[i] == keys[i + 1]
            first[1:] = ~same
        self.block = np.cumsum(first) - 1
        self.lo = np.flatnonzero(first)
        self.hash = h[self.lo]
        self.keys = np.array([keys[i] for i in self.lo], dtype=object)
        self.times = np.unique(start)
        self.width = len(self.times) + 1
        self.at = self.block * self.width + np.searchsorted(self.times, start, "right")
        self.until = np.empty(n, np.int64)
        bounds = [*self.lo, n]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            self.until[a:b] = np.maximum.accumulate(end[a:b])

    def probe(self, h: np.ndarray, keys: np.ndarray, t: np.ndarray) -> np.ndarray:
        """0 live, 1 missing, 2 deleted, 3 late."""
        kind = np.ones(len(h), np.int8)
        if not len(self.hash):
            return kind
        block = np.searchsorted(self.hash, h, "left")
        inside = block < len(self.hash)
        block[~inside] = 0
        # Digests that collide (never seen, but possible) are neighbouring blocks: step on to the key's own.
        found = inside & (self.hash[block] == h) & (self.keys[block] == keys)
        for i in np.flatnonzero(inside & (self.hash[block] == h) & ~found):
            b = block[i] + 1
            while b < len(self.hash) and self.hash[b] == h[i]:
                if self.keys[b] == keys[i]:
                    block[i], found[i] = b, True
                    break
                b += 1
        begun = np.searchsorted(self.at, block * self.width + np.searchsorted(self.times, t, "right"), "right") - 1
        has = begun >= self.lo[block]
        lives = has & (self.until[np.maximum(begun, 0)] > t)
        kind[found] = np.where(lives, 0, np.where(has, 2, 3))[found]
        return kind


_KINDS = np.array(["live", "missing", "deleted", "late"], dtype=object)


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (rng, slice, sub, is_ref, h, k, t): of each part first its parents, then its references."""
    part, held, ranges = None, [], None

    def arrays() -> _Range:
        h, k, s, e = ([], [], [], [])
        for x in held:
            h.append(x[0]), k.extend(x[1]), s.append(x[2]), e.append(x[3])
        cat = lambda a: np.concatenate(a) if a else np.empty(0, np.int64)
        return _Range(cat(h), k, cat(s), cat(e))

    for batch in batches:
        col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        where = [col[c].to_numpy() for c in ("rng", "slice", "sub")]
        is_ref = col["is_ref"].to_numpy(zero_copy_only=False).astype(np.int64)
        moved = np.zeros(max(0, len(is_ref) - 1), bool)
        for x in (*where, is_ref):
            moved |= np.diff(x) != 0
        edges = [0, *(np.flatnonzero(moved) + 1), len(is_ref)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if a == b:
                continue
            here = tuple(int(x[a]) for x in where)
            if part != here:
                part, held, ranges = here, [], None
            cut = {n: c.slice(a, b - a) for n, c in col.items()}
            h, t = cut["h"].to_numpy(), cut["t"].to_numpy()
            if not is_ref[a]:
                held.append((h, cut["k"].to_pylist(), t, cut["e"].to_numpy()))
                continue
            if ranges is None:
                ranges, held = arrays(), []
            kind = ranges.probe(h, cut["k"].to_numpy(zero_copy_only=False), t)
            miss = np.flatnonzero(kind)
            if len(miss):
                take = pa.array(miss)
                yield pa.RecordBatch.from_arrays(
                    [cut[n].take(take) if n != "kind" else pa.array(_KINDS[kind[miss]], pa.string()) for n in _OUT_ARROW.names], schema=_OUT_ARROW
                )


def _range_of(h: Column, n: int) -> Column:
    """Which of ``n`` equal ranges of the 64-bit digests holds ``h``."""
    return F.least(F.floor((h.cast("double") / F.lit(2.0**64) + F.lit(0.5)) * F.lit(n)), F.lit(n - 1)).cast("bigint")


def _coarse_counts(df: DataFrame) -> dict[int, int]:
    """Rows per coarse range of the digest: 4096 numbers at most, whatever the data."""
    coarse = F.shiftright("h", 52).alias("c")
    return {r["c"]: r["n"] for r in df.groupBy(coarse).agg(F.count("*").alias("n")).collect()}


def _hot_keys(df: DataFrame, counts: dict[int, int], most: int, *aggregates: Column) -> DataFrame:
    """Keys with more than ``most`` rows. Only coarse ranges with as many rows are counted by key; there are at
    most rows / ``most`` such keys."""
    heavy = [c for c, n in counts.items() if n > most]
    keys = df.filter(F.shiftright("h", 52).isin(heavy)) if heavy else df.filter("false")
    return keys.groupBy("k").agg(F.count("*").alias("n"), *aggregates).filter(F.col("n") > most)


def slice_of(t: str) -> Column:
    """The slice, from 1, of a time of a hot key; 0 for others."""
    at = F.floor((F.greatest(F.least(F.col(t), F.col("t0") + F.col("width") * F.col("slices")), F.col("t0")) - F.col("t0")) / F.col("width"))
    return F.when(F.col("slices").isNull(), 0).otherwise(F.coalesce(F.least(at, F.col("slices") - 1), F.lit(0)) + 1).cast("int")


def _sliced(p: DataFrame, hot: DataFrame) -> DataFrame:
    """Intervals of hot keys (k, t, e, h, slices, t0, width) by slice, with what earlier slices leave.

    Every slice of a key that has several gets a row that says the key occurs (it begins never), and one with
    the latest end of all earlier slices (it began before all times). The running maximum goes over a key's
    slices; rows added are two per slice, and a slice stands for ``parents_per_slice`` intervals.
    """
    d = p.join(hot, "k").withColumn("slice", slice_of("t"))
    key = d.groupBy("h", "k", "slices", "slice").agg(F.max(F.when(F.col("t") < _FAR, F.col("e"))).alias("m"))
    w = W.partitionBy("k").orderBy("slice")
    runs = key.withColumns({"top": F.max("m").over(w.rowsBetween(W.unboundedPreceding, 0)), "next": F.coalesce(F.lead("slice").over(w), F.col("slices"))})
    carry = runs.filter("top is not null and next > slice").select("k", F.lit(_NULL_TIME).alias("t"), F.col("top").alias("e"), "h", F.explode(F.sequence(F.col("slice") + 1, "next")).alias("slice"))
    known = key.select("h", "k", "slices").distinct().select("k", F.lit(_FAR).alias("t"), F.lit(_FAR).alias("e"), "h", F.explode(F.sequence(F.lit(1), "slices")).alias("slice"))
    return d.select("k", "t", "e", "h", "slice").unionByName(carry).unionByName(known)


def orphan_references(
    parents: DataFrame, refs: DataFrame, ranges: int | None = None, refs_per_split: int = 2_000_000, parents_per_slice: int = 1_000_000, parents_per_range: int = 250_000
) -> DataFrame:
    """References whose key does not live at their time.

    ``parents``: ``k`` (text: kind of key and key), ``s`` and ``e`` (microseconds; live from s up to, not
    including, e; a null s never begins, a null e never ends), any number of intervals per key.
    ``refs``: ``k``, ``t`` (microseconds), ``tbl``, ``ref_field``, ``row_id``, ``period``, ``received``.
    kind: 'missing' if the key occurs nowhere; else 'deleted' if some interval began by then, else 'late'.

    Defined cases: null keys and blank ones are no references and no parents (callers turn blank to null);
    a null time can't be judged against intervals, so only a missing key is reported; without parents
    every reference is missing; of several rows of a row_id and ref_field that miss, the one received last
    is given. ``ranges`` cuts the digest space (default: four per shuffle partition, and more until a range has
    at most ``parents_per_range`` parents and ``refs_per_split`` references on average). A key with more than
    ``parents_per_slice`` intervals or ``refs_per_split`` references is hot and gets parts of that size. The
    parameters bound what one task holds and probes, not what is probed.
    """
    spark = refs.sparkSession
    h = F.xxhash64("k")
    # Equal (key, start) intervals collapse before the shuffle; the longest says all of them.
    p = (
        parents.filter("k is not null")
        .select("k", F.coalesce("s", F.lit(_FAR)).alias("t"), F.coalesce("e", F.lit(_FAR)).alias("e"))
        .groupBy("k", "t")
        .agg(F.max("e").alias("e"))
        .withColumn("h", h)
    )
    p = materialize(p, "parents")
    r = refs.filter("k is not null").withColumn("h", h).withColumn("t", F.coalesce("t", F.lit(_NULL_TIME)))
    n_parents, n_refs = _coarse_counts(p), _coarse_counts(r)
    n = ranges or max(4 * shuffle_partitions(spark), -(-sum(n_parents.values()) // parents_per_range), -(-sum(n_refs.values()) // refs_per_split))
    rng = _range_of(F.col("h"), n)
    parent_columns = [F.lit(False).alias("is_ref"), "h", "k", "t", "e"] + [F.lit(None).cast(x).alias(c) for c, x in (("tbl", "string"), ("ref_field", "string"), ("row_id", "bigint"), ("period", "string"), ("received", "bigint"))]
    ref_columns = [F.lit(True).alias("is_ref"), "h", "k", "t", F.lit(0).cast("bigint").alias("e"), "tbl", "ref_field", "row_id", "period", "received"]
    cold = [rng.alias("rng"), F.lit(0).alias("slice"), F.lit(0).alias("sub")]

    hot = None
    if max(n_parents.values(), default=0) > parents_per_slice or max(n_refs.values(), default=0) > refs_per_split:
        began = F.when(F.col("t") < _FAR, F.col("t"))
        many = _hot_keys(p, n_parents, parents_per_slice, F.min(began).alias("t0"), F.max(began).alias("t1"))
        slices = F.when(F.col("t0").isNull(), 1).otherwise(F.ceil(F.col("n") / parents_per_slice))
        many = many.select("k", slices.cast("int").alias("slices"), F.coalesce("t0", F.lit(0)).alias("t0"), F.coalesce(F.ceil((F.col("t1") - F.col("t0") + 1) / slices), F.lit(1)).cast("bigint").alias("width"))
        asked = _hot_keys(r, n_refs, refs_per_split).select("k", F.lit(1).alias("slices"), F.lit(0).cast("bigint").alias("t0"), F.lit(1).cast("bigint").alias("width"))
        hot = materialize(many.unionByName(asked.join(many.select("k"), "k", "left_anti")), "hot")
        hot = hot if hot.take(1) else None
    if hot is None:
        return _probed(p.select(*cold, *parent_columns).unionByName(r.select(*cold, *ref_columns)))

    # A hot key's parts are named by its digest; Spark broadcasts the hot keys while they are under its size limit.
    rs = r.join(hot, "k", "left").withColumn("slice", slice_of("t")).withColumn("rng", F.when(F.col("slice") == 0, rng).otherwise(F.col("h")))
    splits = rs.filter("slice > 0").groupBy("rng", "slice").agg(F.ceil(F.count("*") / refs_per_split).cast("int").alias("splits")).filter("splits > 1")
    splits = materialize(splits, "splits")
    few = p.join(hot.select("k"), "k", "left_anti").select(*cold, *parent_columns)
    own = _sliced(p, hot).withColumn("rng", F.col("h")).join(splits, ["rng", "slice"], "left")
    own = own.select("rng", "slice", F.explode(F.sequence(F.lit(0), F.coalesce("splits", F.lit(1)) - 1)).alias("sub"), *parent_columns)
    salt = F.when(F.col("splits") > 1, F.pmod(F.xxhash64("tbl", "row_id", "received"), F.col("splits"))).otherwise(0).cast("int")
    rs = rs.join(splits, ["rng", "slice"], "left").select("rng", "slice", salt.alias("sub"), *ref_columns)
    return _probed(few.unionByName(own).unionByName(rs))


def _probed(packed: DataFrame) -> DataFrame:
    parts = packed.repartition("rng", "slice", "sub").sortWithinPartitions("rng", "slice", "sub", "is_ref", "h", "k", "t")
    return parts.mapInArrow(_probe, _OUT).filter("period is not null or kind = 'missing'")


def one_per_reference(misses: DataFrame) -> DataFrame:
    """One row per row_id and ref_field: of several deliveries that miss, the one received last."""
    best = F.max(F.struct("received", "period", "kind"))
    return misses.groupBy("tbl", "ref_field", "row_id").agg(best.alias("b")).select("tbl", "ref_field", "row_id", "b.period", "b.kind")


def orphans_by_period(orphans: DataFrame) -> DataFrame:
    """Misses per table, reference field, period and kind."""
    return orphans.groupBy("tbl", "ref_field", "period", "kind").agg(F.count("*").alias("n"))
