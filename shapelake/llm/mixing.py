"""Mixing sources to target weights (problem 7).

Method: cube-method balanced sampling. A source that must appear m times over puts floor(m) copies of each
document into the mix, and each document once more with inclusion probability m - floor(m). These
probabilities start a random walk in the null space of two constraints, the tokens and the documents of
the source, until each is 0 or 1: every step keeps both totals exactly. A step needs three documents
(one more than constraints), so a stream keeps three open and no more.

The walk runs in parallel: a stream takes the documents of one (mix, source, size class, bucket), size
classes being powers of two of tokens, in chunks whose lanes step together as vectors, and leaves at most two of
them open; only those meet per (mix, source) and walk on, class by class. What is then left, at most two documents per class, is the landing
problem, solved from the largest down so that each rounding makes up for those before. Documents of more
than a hundredth of their source, of which there can't be a hundred, settle first, and the rate of the
others absorbs what their rounding missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapelake.llm.tokens import DEFAULT_FILE, count_tokens
from shapelake.session import materialize, shuffle_partitions

_EPS = 1e-9


def clean_source(c):
    """A source in lower case without outer blanks; blank is no source."""
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


def _plan_mix(pdf: pd.DataFrame, priority: str) -> pd.DataFrame:
    """Tokens wanted of each source of one mix. A mix's rows are its configuration, one per source."""
    p = pdf.copy()
    p["weight"] = p["weight"].fillna(0.0).clip(lower=0.0)
    live = (p["weight"] > 0) & (p["source_tokens"] > 0)
    p["target_share"] = p["weight"] / p["weight"].sum() if p["weight"].sum() > 0 else 0.0
    share = p["weight"].where(live, 0.0)
    share = share / share.sum() if share.sum() > 0 else share
    budget = float(p["budget_ratio"].fillna(1.0).clip(lower=0.0).max() * p["all_tokens"].max())
    most = (p["max_repeats"].astype(float).fillna(float("inf")).clip(lower=0.0) * p["source_tokens"]).where(live, 0.0)
    if priority == "shares":
        size = min([budget, *(most[live] / share[live])])
        want = share * size
    else:  # size: sources at their cap stay there, the others take up the rest in proportion
        want, free = share * 0.0, live.copy()
        while free.any():
            rest = budget - want[~free].sum()
            part = share[free] / share[free].sum() * rest
            over = part > most[free]
            if not over.any():
                want[free] = part
                break
            capped = over.index[over]
            want[capped] = most[capped]
            free[capped] = False
    rate = (want / p["source_tokens"].where(live, 1.0)).where(live, 0.0)
    near = rate.round()
    rate = near.where((rate - near).abs() < _EPS, rate)
    p["budget_tokens"], p["want_tokens"], p["rate"] = budget, want, rate
    return p


_PLAN = """mix_name string, source string, weight double, max_repeats double, budget_ratio double, source_tokens bigint,
source_docs bigint, all_tokens bigint, target_share double, budget_tokens double, want_tokens double, rate double"""


def plan_mixes(sized: DataFrame, targets: DataFrame, priority: str = "shares") -> DataFrame:
    """How often each source of each mix is wanted.

    ``sized``: source, n_tokens of all documents; ``targets``: mix_name, source, target_weight, max_repeats
    (null: no limit), budget_ratio. Rows of a mix that name a source twice add their weights; the lower cap
    holds. A source without tokens, or with weight zero, gives nothing, and the others keep their proportions.

    ``priority`` says what yields when a cap binds. 'shares' (default): every source that has documents gets
    its exact share, and the mix is as large as the wished size and the caps allow. 'size': the mix has the
    wished size; a source at its cap falls short, and the others fill up in proportion to their weights.
    """
    totals = sized.groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"), F.sum((F.col("n_tokens") > 0).cast("bigint")).alias("source_docs"))
    wanted = (
        targets.filter("mix_name is not null")
        .select("mix_name", clean_source(F.col("source")).alias("source"), "target_weight", "max_repeats", "budget_ratio")
        .filter("source is not null")
        .groupBy("mix_name", "source")
        .agg(F.sum("target_weight").alias("weight"), F.min("max_repeats").cast("double").alias("max_repeats"), F.max("budget_ratio").alias("budget_ratio"))
    )
    everything = totals.agg(F.coalesce(F.sum("source_tokens"), F.lit(0)).alias("a")).select("a").scalar()
    rows = wanted.join(totals.filter("source is not null"), "source", "left").select(
        "mix_name", "source", "weight", "max_repeats", "budget_ratio", F.coalesce("source_tokens", F.lit(0)).alias("source_tokens"), F.coalesce("source_docs", F.lit(0)).alias("source_docs"), everything.alias("all_tokens")
    )
    return rows.groupBy("mix_name").applyInPandas(lambda pdf: _plan_mix(pdf, priority), _PLAN)


class Walk:
    """The flight phase for one stream of documents with two constraints."""

    def __init__(self):
        self.open: list[list] = []  # [payload, tokens, probability], at most two between steps

    def push(self, payload, tokens: float, p: float, coin: float) -> list[tuple]:
        """One document enters with probability ``p``; gives the documents decided by it as (payload, 0 or 1)."""
        if p <= _EPS or p >= 1 - _EPS:
            return [(payload, int(p > 0.5))]
        self.open.append([payload, tokens, p])
        if len(self.open) < 3:
            return []
        (_, x, _), (_, y, _), (_, z, _) = self.open
        u = (y - z, z - x, x - y)  # keeps the sums of documents and tokens
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = min((1 - o[2]) / v if v > 0 else -o[2] / v for o, v in zip(self.open, u, strict=True) if v)
        down = min(o[2] / v if v > 0 else -(1 - o[2]) / v for o, v in zip(self.open, u, strict=True) if v)
        step = up if coin * (up + down) < down else -down  # the expected probabilities stay
        done, rest = [], []
        for o, v in zip(self.open, u, strict=True):
            o[2] += step * v
            if o[2] <= _EPS or o[2] >= 1 - _EPS:
                done.append((o[0], int(o[2] > 0.5)))
            else:
                rest.append(o)
        self.open = rest
        return done


LANES, CHUNK = 128, 8192
FEW = 1024  # rows of a chunk below which lanes don't pay and its documents walk one by one


def fly_lanes(tokens: np.ndarray, p: np.ndarray, coin: np.ndarray, lanes: int = LANES) -> tuple[np.ndarray, np.ndarray]:
    """Many walks side by side: document i walks in lane i modulo ``lanes``, all lanes stepping at once. Gives each
    document's probability, 0 or 1 if it is decided, and whether it is; up to two documents of a lane stay open."""
    p = p.astype(float).copy()
    decided = (p <= _EPS) | (p >= 1 - _EPS)
    walking = np.flatnonzero(~decided)
    slot = np.full((lanes, 3), -1)  # places of the open documents of each lane
    full = np.zeros(lanes, int)
    for at in range(0, len(walking), lanes):
        new = walking[at : at + lanes]
        lane = np.arange(len(new))
        slot[lane, full[lane]] = new
        full[lane] += 1
        go = np.flatnonzero(full == 3)
        if not len(go):
            continue
        who = slot[go]
        x, q = tokens[who].astype(float), p[who]
        u = np.stack([x[:, 1] - x[:, 2], x[:, 2] - x[:, 0], x[:, 0] - x[:, 1]], 1)  # keeps the sums of documents and tokens
        u[~u.any(1)] = (1.0, -1.0, 0.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            rise = np.where(u > 0, (1 - q) / u, np.where(u < 0, -q / u, np.inf)).min(1)
            fall = np.where(u > 0, q / u, np.where(u < 0, -(1 - q) / u, np.inf)).min(1)
        step = np.where(coin[who[:, 2]] * (rise + fall) < fall, rise, -fall)  # the expected probabilities stay
        q = q + step[:, None] * u
        done = (q <= _EPS) | (q >= 1 - _EPS)
        p[who] = np.where(done, q > 0.5, q)
        decided[who] = done
        order = np.argsort(done, axis=1, kind="stable")
        slot[go] = np.where(np.take_along_axis(done, order, 1), -1, np.take_along_axis(who, order, 1))
        full[go] = 3 - done.sum(1)
    return p, decided


def settle(units: list[tuple]) -> list[tuple]:
    """Decide a small set of documents (payload, tokens, probability, coin): the walk within size classes,
    then the landing, from the largest open document down, each rounding nearest to the totals so far."""
    done, still = [], []
    classes: dict[int, list[tuple]] = {}
    for u in units:
        classes.setdefault(int(u[1]).bit_length(), []).append(u)
    for _, group in sorted(classes.items()):
        walk = Walk()
        for payload, tokens, p, coin in sorted(group, key=lambda u: u[3]):
            done += walk.push(payload, tokens, p, coin)
        still += walk.open
    missed = docs = 0.0
    for payload, tokens, p in sorted(still, key=lambda o: -o[1]):
        cost = [abs(missed + tokens * (p - k)) / max(tokens, 1.0) + 0.25 * abs(docs + p - k) for k in (0, 1)]
        taken = int(cost[1] < cost[0])
        missed, docs = missed + tokens * (p - taken), docs + p - taken
        done.append((payload, taken))
    return done


_COLUMNS = ["mix_name", "source", "doc_id", "n_tokens", "base", "p", "coin", "taken"]
_UNIT = "mix_name string, source string, doc_id {kind}, n_tokens bigint, base bigint, p double, coin double, taken int"


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_COLUMNS).astype({"taken": "Int32"})


def _fly(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Streams sorted by (mix_name, source, size, bucket). Decided documents leave with taken 0 or 1; what a
    stream leaves open comes out with taken null and its present probability. A stream is walked in chunks of a
    fixed number of its rows, so the result doesn't depend on how rows arrive; what the lanes of a chunk leave open
    walks on in the stream's own walk."""
    by = ["mix_name", "source", "size", "bucket"]
    names = ["mix_name", "source", "doc_id", "n_tokens", "base", "coin", "p"]
    key, walk, waiting = None, Walk(), []

    def left() -> list[tuple]:
        return [(*o[0][:5], o[2], o[0][5], None) for o in walk.open]

    def walked(rows) -> list[tuple]:
        out = []
        for row in rows:
            for payload, taken in walk.push(row[:6], float(row[3]), row[6], row[5]):
                out.append((*payload[:5], 0.0, payload[5], taken))
        return out

    def flown(rows: pd.DataFrame) -> list[pd.DataFrame]:
        if len(rows) < FEW:
            return [_frame(walked(zip(*(rows[c] for c in names), strict=True)))]
        p, decided = fly_lanes(rows["n_tokens"].to_numpy(), rows["p"].to_numpy(), rows["coin"].to_numpy())
        done = rows[decided].assign(taken=(p[decided] > 0.5).astype(int), p=0.0)
        rest = rows[~decided].assign(p=p[~decided])
        return [done[_COLUMNS].astype({"taken": "Int32"}), _frame(walked(zip(*(rest[c] for c in names), strict=True)))]

    def joined(out: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        full = [x for x in out if len(x)]
        if full:
            yield pd.concat(full, ignore_index=True)

    def close() -> list[pd.DataFrame]:
        nonlocal walk, waiting
        out = flown(pd.concat(waiting, ignore_index=True)) if waiting else []
        out.append(_frame(left()))
        walk, waiting = Walk(), []
        return out

    for pdf in frames:
        if not len(pdf):
            continue
        out, rows = [], []
        keys = [pdf[c].to_numpy() for c in by]
        moved = np.zeros(len(pdf), bool)
        for k in keys:
            moved[1:] |= k[1:] != k[:-1]
        edges = [0, *np.flatnonzero(moved), len(pdf)]
        lists = [pdf[c].tolist() for c in names]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            at = tuple(k[a] for k in keys)
            if at != key:
                out += close()
                key = at
            if not waiting and b < len(pdf) and b - a < FEW:  # a whole stream of few rows
                rows += walked(zip(*(c[a:b] for c in lists), strict=True))
                rows += left()
                walk, key = Walk(), None
                continue
            waiting.append(pdf.iloc[a:b])
            if sum(map(len, waiting)) >= CHUNK:
                held = pd.concat(waiting, ignore_index=True)
                whole = len(held) // CHUNK * CHUNK
                for i in range(0, whole, CHUNK):
                    out += flown(held.iloc[i : i + CHUNK].reset_index(drop=True))
                waiting = [held.iloc[whole:]] if whole < len(held) else []
        yield from joined([*out, _frame(rows)])
    yield from joined(close())


def _settle_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    """The open documents of one (mix, source): two per size class and bucket at most, or those that are
    larger than a hundredth of the source."""
    rows = pdf.sort_values(["coin", "doc_id"]).itertuples(index=False)
    units = [((r.mix_name, r.source, r.doc_id, r.n_tokens, r.base, r.coin), float(r.n_tokens), r.p, r.coin) for r in rows]
    return _frame([(*x[:5], 0.0, x[5], taken) for x, taken in settle(units)])


def mix_documents(docs: DataFrame, targets: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", file: str = DEFAULT_FILE, priority: str = "shares", seed: int = 7, buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The mixes (mix_name, source, doc_id, n_tokens, copies) and their plan.

    Documents without tokens (null, empty) carry no size and are in no mix; documents of null or unnamed
    sources count in the size of all documents only. No document has more copies than its source's cap.
    An empty table of documents or targets gives empty mixes. The same input, ``seed`` and ``buckets``
    (default: the shuffle's partitions) give the same mix, however the rows are spread.
    """
    spark = docs.sparkSession
    n = buckets or shuffle_partitions(spark)
    sized = count_tokens(docs.withColumn(source, clean_source(F.col(source))) if source in docs.columns else docs, doc_id, text, (source,), file)
    sized = materialize(sized.select("doc_id", F.col(source).alias("source"), "n_tokens"), "sized")
    plan = materialize(plan_mixes(sized, targets, priority), "plan")
    kind = sized.schema["doc_id"].dataType.simpleString()
    unit = _UNIT.format(kind=kind)
    h = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("mix_name"))
    coin = (F.pmod(h, F.lit(1 << 52)) / F.lit(float(1 << 52))).alias("coin")
    heavy = F.col("n_tokens") * 100 > F.col("source_tokens")

    def units(rate: DataFrame) -> DataFrame:
        # The plan is a configuration table with a row per (mix, source); Spark broadcasts it if it is small.
        rows = sized.filter("n_tokens > 0").join(rate, "source")
        return rows.select("mix_name", "source", "doc_id", "n_tokens", F.floor("rate").alias("base"), (F.col("rate") - F.floor("rate")).alias("p"), coin, heavy.alias("heavy"))

    first = units(plan.filter("rate > 0").select("mix_name", "source", "source_tokens", "rate"))
    large = materialize(first.filter("heavy").withColumn("taken", F.lit(None).cast("int")).groupBy("mix_name", "source").applyInPandas(_settle_rows, unit), "large")
    got = large.groupBy("mix_name", "source").agg(F.sum(F.col("n_tokens") * (F.col("base") + F.col("taken"))).alias("g"), F.sum("n_tokens").alias("t"))
    rest = F.greatest(F.lit(0.0), (F.col("want_tokens") - F.coalesce("g", F.lit(0))) / F.nullif(F.col("source_tokens") - F.coalesce("t", F.lit(0)), F.lit(0)))
    rate = F.when(F.col("g").isNull(), F.col("rate")).otherwise(F.least(rest, F.col("max_repeats")))
    second = units(plan.filter("rate > 0").join(got, ["mix_name", "source"], "left").withColumn("rate", rate).select("mix_name", "source", "source_tokens", "rate"))
    small = second.filter(~F.col("heavy")).withColumn("size", F.floor(F.log2("n_tokens")).cast("int")).withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(n)))
    by = ["mix_name", "source", "size", "bucket"]
    flown = materialize(small.repartition(*by).sortWithinPartitions(*by, "coin", "doc_id").mapInPandas(_fly, unit), "flown")
    landed = flown.filter("taken is null").groupBy("mix_name", "source").applyInPandas(_settle_rows, unit)
    mixed = flown.filter("taken is not null").unionByName(landed).unionByName(large).withColumn("copies", F.col("base") + F.col("taken"))
    return mixed.filter("copies > 0").select("mix_name", "source", "doc_id", "n_tokens", "copies"), plan


def mix_shares(mixed: DataFrame, plan: DataFrame) -> DataFrame:
    """Shares reached: of every (mix, source) its target share, the tokens and share reached, documents and
    the greatest number of copies, beside the mix's wished and reached size. The shares of a mix add to one."""
    got = mixed.groupBy("mix_name", "source").agg(
        F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"), F.sum("copies").alias("copies"), F.max("copies").alias("most_copies")
    )
    rows = plan.join(got, ["mix_name", "source"], "left").fillna(0, ["tokens", "documents", "copies", "most_copies"])
    size = rows.groupBy("mix_name").agg(F.sum("tokens").alias("mix_tokens"))
    return rows.join(size, "mix_name").select(
        "mix_name",
        "source",
        "target_share",
        (F.col("tokens") / F.nullif(F.col("mix_tokens"), F.lit(0))).alias("reached_share"),
        "want_tokens",
        "tokens",
        "documents",
        "copies",
        "most_copies",
        "max_repeats",
        "budget_tokens",
        "mix_tokens",
    )
