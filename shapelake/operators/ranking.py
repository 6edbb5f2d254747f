"""Ranking, top-k with quotas, apportionment and even sampling.

Every window is partitioned and totally ordered. A top-k within partitions first keeps the k best of each
salted part of a partition, so that a partition with a third of all rows is never sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shapelake.session import fresh_name, materialize, shuffle_partitions


def top_per_group(df: DataFrame, key: list[str], order: list[Column], k: Column | int, tie: list[str], rank: str = "rank", salts: int = 16) -> DataFrame:
    """The ``k`` first rows of each group (``k`` may be a column, constant within the group), with their rank.

    ``tie`` are columns that make the order total; they also spread a hot group over ``salts`` parts whose
    best k rows are all that meet in the second window.
    """
    k = F.lit(k) if isinstance(k, int) else k
    part, r = fresh_name(df, "_part"), fresh_name(df, "_r")
    order = [*order, *tie]
    salted = df.withColumn(part, F.pmod(F.xxhash64(*tie), F.lit(salts)))
    kept = salted.withColumn(r, F.row_number().over(W.partitionBy(*key, part).orderBy(*order))).filter(F.col(r) <= k).drop(part, r)
    return kept.withColumn(rank, F.row_number().over(W.partitionBy(*key).orderBy(*order))).filter(F.col(rank) <= k)


def best_per_group(df: DataFrame, key: list[str], score: Column, tie: str, keep: list[str]) -> DataFrame:
    """The row of least (score rounded to 12 digits, tie) of each group: a combining aggregate, no sort."""
    best = F.min(F.struct(F.round(score, 12).alias("score"), F.col(tie).alias("_tie"), *[F.col(c).alias(f"_{c}") for c in keep]))
    return df.groupBy(*key).agg(best.alias("_b")).select(*key, F.col("_b._tie").alias(tie), F.col("_b.score").alias("score"), *[F.col(f"_b._{c}").alias(c) for c in keep])


def quota_with_backfill(df: DataFrame, key: list[str], layer: str, quotas: dict[str, int], order: list[Column], fill: list[Column], tie: list[str]) -> DataFrame:
    """Each layer's first rows up to its quota; what the quotas leave unused goes to the best of all others.

    Layers without quota only take part in the filling. The result has ``picked``: 'quota' or 'fill'.
    """
    quota = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv]), F.col(layer)), F.lit(0))
    total = sum(quotas.values())
    top = top_per_group(df, [*key, layer], order, quota, tie, rank="_rank")
    used = top.groupBy(*key).agg(F.count("*").alias("_used")) if key else top.agg(F.count("*").alias("_used"))
    rest = df.join(top.select(*tie), tie, "left_anti")
    room = (rest.join(used, key, "left") if key else rest.withColumn("_used", used.scalar())).withColumn("_room", F.lit(total) - F.coalesce("_used", F.lit(0)))
    if key:
        filled = top_per_group(room.filter("_room > 0"), key, fill, F.col("_room"), tie, rank="_rank")
    else:
        filled = top_per_group(room.filter("_room > 0").withColumn("_one", F.lit(1)), ["_one"], fill, F.col("_room"), tie, rank="_rank").drop("_one")
    return top.drop("_rank").withColumn("picked", F.lit("quota")).unionByName(filled.drop("_rank", "_used", "_room").withColumn("picked", F.lit("fill")))


def balanced_take(df: DataFrame, key: list[str], side: str, limit: int, order: list[Column], tie: list[str], share: float = 0.40) -> DataFrame:
    """``limit`` rows per key: ``share`` of it from the left and from the right side each, the rest from the
    center; places that a side can't fill go to the best rows left of any side."""
    q = max(1, round(limit * share))
    quota = F.when(F.col(side).isin("left", "right"), q).when(F.col(side) == "center", max(0, limit - 2 * q)).otherwise(0)
    ranked = top_per_group(df, [*key, side], order, limit, tie, rank="_side_rank")
    first = F.when(F.col("_side_rank") <= quota, 0).otherwise(1)
    w = W.partitionBy(*key).orderBy(first, *order, *tie)
    return ranked.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).drop("_side_rank")


def layer_budget(target: int, ratios: dict[str, float], add: list[str], remove: list[str]) -> dict[str, int]:
    """Whole slots per layer in proportion to ``ratios``, at least one each, adding up to ``target`` (no less
    than one per layer). Lacking slots are handed out in rounds in the order ``add``, surplus ones taken back
    in rounds in the order ``remove``. A handful of numbers: driver arithmetic."""
    target = max(len(ratios), int(target))
    whole = sum(max(0.0, v) for v in ratios.values()) or 1.0
    slots = {k: max(1, int(target * max(0.0, v) / whole)) for k, v in ratios.items()}
    short = target - sum(slots.values())
    for i in range(short):
        slots[add[i % len(add)]] += 1
    while short < 0:
        able = [k for k in remove if slots[k] > 1][: -short]
        if not able:
            break
        for k in able:
            slots[k] -= 1
        short += len(able)
    return slots


def proportional_bounds(df: DataFrame, key: list[str], share: str, length: Column, order: list[Column]) -> DataFrame:
    """Consecutive segments [start, stop) of ``length``, one unit each plus the rest by share (largest
    remainders, ties to the earlier). With less length than segments, or no shares, equal segments."""
    w = W.partitionBy(*key)
    place = F.row_number().over(w.orderBy(*order)) - 1
    d = df.withColumns({"_i": place, "_n": F.count("*").over(w), "_t": F.sum(share).over(w), "_len": length})
    raw = F.coalesce(F.col(share) / F.nullif(F.col("_t"), F.lit(0.0)), F.lit(0.0)) * (F.col("_len") - F.col("_n"))
    d = d.withColumns({"_raw": raw, "_whole": F.floor(raw)})
    d = d.withColumn("_left", F.col("_len") - F.col("_n") - F.sum("_whole").over(w))
    d = d.withColumn("_extra", (F.row_number().over(w.orderBy(F.desc(F.round(F.col("_raw") - F.col("_whole"), 9)), "_i")) <= F.col("_left")).cast("int"))
    size = F.col("_whole") + F.col("_extra") + 1
    stop = F.sum(size).over(w.orderBy("_i").rowsBetween(W.unboundedPreceding, 0))
    even = (F.col("_len") < F.col("_n")) | (F.coalesce("_t", F.lit(0.0)) <= 0)
    e0 = F.bround(F.col("_i") * F.col("_len") / F.col("_n"), 0).cast("bigint")
    e1 = F.greatest(e0 + 1, F.bround((F.col("_i") + 1) * F.col("_len") / F.col("_n"), 0).cast("bigint"))
    d = d.withColumns({"_stop": stop, "_size": size})
    return d.select(*df.columns, F.when(even, e0).otherwise(F.col("_stop") - F.col("_size")).alias("start"), F.when(even, e1).otherwise(F.col("_stop")).alias("stop"))


def _split_hot(df: DataFrame, key: list[str], order: list[str], most: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of groups up to ``most`` rows, and those of larger groups cut into ordered pieces ``_pid``.

    The pieces come from one range partitioning on (key, order), so a group of any size is spread over tasks,
    and are written, so that they are the same whenever they are read. At most (rows / ``most``) groups can be
    that large; the list is written, so Spark knows its size and broadcasts it while it is under its limit.
    """
    hot = materialize(df.groupBy(*key).agg(F.count("*").alias("_size")).filter(F.col("_size") > most), "hot")
    rows = hot.agg(F.sum("_size").alias("s")).first()["s"]
    if not rows:
        return df, None
    same = [F.col(f"d.{k}").eqNullSafe(F.col(f"h.{k}")) for k in key]
    on = same[0]
    for c in same[1:]:
        on = on & c
    d, h = df.alias("d"), hot.alias("h")
    parts = max(shuffle_partitions(df.sparkSession), -(-rows // most))
    pieces = d.join(h, on, "left_semi").repartitionByRange(parts, *key, *order).withColumn("_pid", F.spark_partition_id())
    return d.join(h, on, "left_anti"), materialize(pieces, "pieces")


def numbered(df: DataFrame, key: list[str], order: list[str], most: int = 5_000_000) -> DataFrame:
    """``df`` with ``_i``, each row's place in its group from 1, and ``_n``, the group's size. ``order`` must be
    total. A group of more than ``most`` rows is numbered piece by piece, with offsets from the pieces' counts."""
    w = W.partitionBy(*key)
    cold, pieces = _split_hot(df, key, order, most)
    out = cold.withColumns({"_i": F.row_number().over(w.orderBy(*order)).cast("bigint"), "_n": F.count("*").over(w)})
    if pieces is None:
        return out
    per = pieces.groupBy(*key, "_pid").agg(F.count("*").alias("_c"))
    per = per.withColumns({"_before": F.coalesce(F.sum("_c").over(w.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)), "_n": F.sum("_c").over(w)})
    same = F.col("a._pid") == F.col("b._pid")
    for k in key:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    placed = pieces.withColumn("_i", F.row_number().over(W.partitionBy(*key, "_pid").orderBy(*order))).alias("a").join(per.alias("b"), same)
    return out.unionByName(placed.select(*[F.col(f"a.{c}") for c in df.columns], (F.col("a._i") + F.col("b._before")).alias("_i"), F.col("b._n").alias("_n")))


def lagged(df: DataFrame, key: list[str], order: list[str], value: str, name: str, most: int = 5_000_000) -> DataFrame:
    """``df`` with ``name``, the value of the row before in its group (null for the first). ``order`` must be total.
    In a group of more than ``most`` rows the first row of each piece takes the last value of the piece before."""
    cold, pieces = _split_hot(df, key, order, most)
    out = cold.withColumn(name, F.lag(value).over(W.partitionBy(*key).orderBy(*order)))
    if pieces is None:
        return out
    ends = pieces.groupBy(*key, "_pid").agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("_end"))
    ends = ends.withColumn("_end", F.lag("_end").over(W.partitionBy(*key).orderBy("_pid")))
    w = W.partitionBy(*key, "_pid").orderBy(*order)
    own = pieces.withColumns({"_first": F.row_number().over(w) == 1, "_lag": F.lag(value).over(w)})
    same = F.col("a._pid") == F.col("b._pid")
    for k in key:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    j = own.alias("a").join(ends.alias("b"), same)
    return out.unionByName(j.select(*[F.col(f"a.{c}") for c in df.columns], F.when(F.col("a._first"), F.col("b._end.v")).otherwise(F.col("a._lag")).alias(name)))


def even_sample(df: DataFrame, key: list[str], order: list[str], most: int, rows_per_task: int = 5_000_000) -> DataFrame:
    """Up to ``most`` rows of each group, evenly spaced in its order: places floor(k (n-1) / (most-1)).

    The sampling is the feature of this operator; callers that need all rows don't use it.
    """
    d = numbered(df, key, order, rows_per_task).withColumn("_i", F.col("_i") - 1)
    # place i is taken if some k gives floor(k (n-1)/(m-1)) = i: the first such k is ceil(i (m-1)/(n-1))
    m = F.lit(most)
    k = F.ceil(F.col("_i") * (m - 1) / F.greatest(F.col("_n") - 1, F.lit(1)))
    hit = F.floor(k * (F.col("_n") - 1) / (m - 1)) == F.col("_i")
    return d.filter((F.col("_n") <= m) | (hit & (k <= m - 1))).drop("_i", "_n")


def spacing(df: DataFrame, key: list[str], at: Column, tie: list[str], rows_per_task: int = 5_000_000) -> DataFrame:
    """Gaps between consecutive rows of each group."""
    d = lagged(df.withColumn("_at", at), key, ["_at", *tie], "_at", "_before", rows_per_task)
    return d.withColumn("gap", F.col("_at") - F.col("_before")).filter("gap is not null").drop("_at", "_before")


def padded_moving_average(df: DataFrame, key: list[str], order: str, value: str, radius: int) -> DataFrame:
    """Centered mean over 2 radius + 1 places with zeros beyond the ends."""
    w = W.partitionBy(*key).orderBy(order).rowsBetween(-radius, radius)
    return df.withColumn("smooth", F.sum(value).over(w) / (2 * radius + 1))


def semantic_budget(features: DataFrame, budget: int) -> DataFrame:
    """Primitives per feature of each case within ``budget``.

    ``features``: case_id, feature_id, disposition (required, optional, forbidden), importance,
    compression_policy (preserve, symbolic, omit). Required features get one each, then optional ones in order
    of priority while the budget lasts; the rest goes round the top tier. Closed form, no loop. A case whose
    required minimum exceeds the budget has null allocations.
    """
    rank = F.coalesce(*[F.when(F.col("importance") == n, i) for i, n in enumerate(("identity_critical", "important", "supporting", "compressible"))], F.lit(9))
    policy = F.coalesce("compression_policy", F.lit("preserve"))
    eligible = (F.col("disposition") != "forbidden") & (policy != "omit")
    d = features.withColumns({"_e": eligible, "_req": eligible & (F.col("disposition") == "required"), "_tier": F.when(F.col("disposition") == "required", 0).otherwise(1) * 100 + rank})
    case = W.partitionBy("case_id")
    d = d.withColumns({"_need": F.sum(F.col("_req").cast("int")).over(case), "_opt": F.row_number().over(W.partitionBy("case_id", "_e", "_req").orderBy("_tier", "feature_id"))})
    base = F.when(F.col("_req"), 1).when(F.col("_e") & (F.col("_opt") <= F.lit(budget) - F.col("_need")), 1).otherwise(0)
    d = d.withColumn("_base", base)
    d = d.withColumns({"_left": F.lit(budget) - F.sum("_base").over(case), "_top": F.min(F.when(F.col("_e"), F.col("_tier"))).over(case)})
    in_top = F.col("_e") & (F.col("_tier") == F.col("_top"))
    d = d.withColumns({"_width": F.sum(in_top.cast("int")).over(case), "_place": F.row_number().over(W.partitionBy("case_id", in_top).orderBy("feature_id")), "_in": in_top})
    extra = F.when(F.col("_in"), F.floor(F.col("_left") / F.col("_width")) + (F.col("_place") <= F.pmod(F.col("_left"), F.col("_width"))).cast("int")).otherwise(0)
    got = F.when(F.col("_need") <= budget, F.col("_base") + extra)
    return d.select("case_id", "feature_id", "disposition", "importance", got.cast("bigint").alias("allocated"))
