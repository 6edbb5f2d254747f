"""Frequency of every term and n-gram of terms (problem 3).

Method: suffix-sorted n-gram counting. Each record's term sequence gives its suffixes, cut to ``max_n``
terms. A suffix is routed by its first term, so all n-grams that begin with that term are counted in one
place; sorted in reverse lexicographic order, an n-gram comes after all its extensions, and a stack holds
the counts and record sets of just the prefixes of the current suffix. One shuffle counts all lengths.

A first term may hold a third of all suffixes. So the route is (first term, bucket of the record): a
record's suffixes of a term stay together, hence record counts of different buckets simply add up, and a
hot term spreads over all buckets. A second, combining aggregation of (term, counts) adds the buckets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shapelake.session import shuffle_partitions

RARE_BELOW = 4  # records
COMMON_SHARE = 0.2  # of all records

_OUT = "field string, term array<string>, n int, occurrences bigint, records bigint"
_OUT_ARROW = pa.schema([("field", pa.string()), ("term", pa.list_(pa.string())), ("n", pa.int32()), ("occurrences", pa.int64()), ("records", pa.int64())])


def normal_term(value: Column) -> Column:
    """Lower case, no outer white space, each run of white space, hyphens and underscores one underscore;
    blank values become null."""
    text = F.regexp_replace(F.lower(value), r"(?U)^\s+|\s+$", "")
    return F.nullif(F.regexp_replace(text, r"(?U)[\s\-_]+", "_"), F.lit(""))


_NAMELESS = -(2**63)


_Rows = tuple[np.ndarray, np.ndarray, np.ndarray]  # record, delivery, occurrences


def _merged(parts: list[_Rows]) -> _Rows:
    """One row per (record, delivery), sorted, with the occurrences of all parts added."""
    ids, deliveries, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((deliveries, ids))
    ids, deliveries, counts = ids[order], deliveries[order], counts[order]
    at = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (deliveries[1:] != deliveries[:-1])])
    return ids[at], deliveries[at], np.add.reduceat(counts, at)


def _totals(rows: _Rows) -> tuple[int, int]:
    """Occurrences, those of a record taken from its delivery that has most, and records; rows without an id
    all count as occurrences and are no record."""
    ids, _, counts = rows
    named = int(np.searchsorted(ids, _NAMELESS, "right"))  # the least id comes first
    nameless, ids, counts = int(counts[:named].sum()), ids[named:], counts[named:]
    if not len(ids):
        return nameless, 0
    at = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    return nameless + int(np.maximum.reduceat(counts, at).sum()), len(at)


class _Counter:
    """The stack: one level per term of the current suffix with the rows that begin with the terms so far."""

    def __init__(self):
        self.field: str | None = None
        self.path: list[str] = []
        self.rows: list[list[_Rows]] = []
        self.out: list[tuple] = []

    def _pop(self) -> None:
        rows = _merged(self.rows.pop())
        self.out.append((self.field, list(self.path), len(self.path), *_totals(rows)))
        self.path.pop()
        if self.path:  # what has this n-gram has its prefix too, in the same record and delivery
            self.rows[-1].append(rows)

    def close(self) -> None:
        while self.path:
            self._pop()

    def add(self, field: str, suffix: list[str], ids: np.ndarray, deliveries: np.ndarray) -> None:
        """Rows of one suffix; they come in reverse lexicographic order of suffixes."""
        same = 0
        if field == self.field:
            while same < len(suffix) and same < len(self.path) and suffix[same] == self.path[same]:
                same += 1
        while len(self.path) > same:
            self._pop()
        self.field = field
        for term in suffix[same:]:
            self.path.append(term)
            self.rows.append([])
        self.rows[-1].append((ids, deliveries, np.ones(len(ids), np.int64)))

    def take(self) -> pa.RecordBatch:
        cols = list(zip(*self.out, strict=True)) if self.out else [()] * len(_OUT_ARROW)
        self.out = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _OUT_ARROW.types, strict=True)], schema=_OUT_ARROW)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns: bucket, field, t0 .. tn, id, delivery."""
    counter, bucket = _Counter(), None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.columns[:-2]
        ids, deliveries = batch.column(batch.num_columns - 2).to_numpy(), batch.column(batch.num_columns - 1).to_numpy()
        edge = np.zeros(batch.num_rows, bool)
        edge[0] = True
        for k in keys:
            c = k.dictionary_encode().indices.fill_null(-1).to_numpy()
            edge[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(edge)
        heads = [k.take(pa.array(starts)).to_pylist() for k in keys]
        for i, (a, b) in enumerate(zip(starts, [*starts[1:], batch.num_rows], strict=True)):
            if heads[0][i] != bucket:
                counter.close()
                bucket = heads[0][i]
            counter.add(heads[1][i], [c[i] for c in heads[2:] if c[i] is not None], ids[a:b].copy(), deliveries[a:b].copy())
        if len(counter.out) >= 10_000:
            yield counter.take()
    counter.close()
    yield counter.take()


def ngram_frequency(
    df: DataFrame, record: str, fields: dict[str, Column], max_n: int = 1, delivery: Column | None = None, buckets: int | None = None
) -> DataFrame:
    """Occurrences and records of every n-gram, n up to ``max_n``, of each field's term sequence.

    ``fields`` maps a field's name to its sequence (array<string>); null elements are left out of it. A
    record is a distinct value of ``record``. With ``delivery`` (what tells apart the rows of a record that
    was delivered again) a record's occurrences of an n-gram are those in its delivery that has most of it, for
    every ``max_n`` alike; without it, and of equal deliveries, all rows add occurrences. Rows without a record id count as occurrences, but not as records. Null and empty
    sequences give nothing, an empty table no rows; columns not named aren't read. Record ids that aren't
    integers are compared by 64-bit digest. ``buckets`` (default: the shuffle's partitions) bounds the
    records of one term in one place to their share.

    Output: field, term (array of n terms), n, occurrences, records.
    """
    b = buckets or shuffle_partitions(df.sparkSession)
    kind = df.select(record).schema[0].dataType.simpleString()
    rid = F.col(record).cast("bigint") if kind in ("bigint", "int", "smallint", "tinyint") else F.when(F.col(record).isNotNull(), F.xxhash64(record))
    each = F.array(*[F.struct(F.lit(n).alias("f"), F.filter(c, lambda x: x.isNotNull()).alias("s")) for n, c in fields.items()])
    seqs = df.select(rid.alias("_id"), (F.xxhash64(delivery) if delivery is not None else F.lit(0).cast("bigint")).alias("_d"), F.explode(each).alias("_x"))
    seqs = seqs.filter(F.size("_x.s") > 0).select("_id", "_d", F.col("_x.f").alias("field"), F.col("_x.s").alias("s"))
    suffixes = F.transform(F.sequence(F.lit(1), F.size("s")), lambda i: F.slice("s", i, max_n))
    rows = seqs.select("_id", "_d", "field", F.explode(suffixes).alias("x")).select(
        F.pmod(F.xxhash64(F.coalesce("_id", F.col("_d"))), F.lit(b)).cast("int").alias("bucket"),
        "field",
        *[F.get("x", i).alias(f"t{i}") for i in range(max_n)],
        F.coalesce("_id", F.lit(_NAMELESS)).alias("id"),
        F.col("_d").alias("d"),
    )
    order = [F.col(f"t{i}").desc_nulls_last() for i in range(max_n)]
    routed = rows.repartition("field", "t0", "bucket").sortWithinPartitions("bucket", "field", *order)
    return routed.mapInArrow(_count, _OUT).groupBy("field", "term", "n").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def mark_terms(counts: DataFrame, df: DataFrame, record: str, rare_below: int = RARE_BELOW, common_share: float = COMMON_SHARE) -> DataFrame:
    """``counts`` with ``mark``: 'rare' below ``rare_below`` records, else 'common' above ``common_share`` of
    all records of ``df`` (those without terms count), else null. In a tiny table a term that is both is rare."""
    total = df.agg(F.count_distinct(record).alias("n")).select("n").scalar()
    return counts.withColumn("mark", F.when(F.col("records") < rare_below, "rare").when(F.col("records") > F.lit(common_share) * total, "common"))
