"""The set operators applied to whole tables of the test data, each with its SQL.

These queries run the package's operators with their semantics on tabular data; they are analogs and no
evidence about images. Floats are rounded to six digits on both sides, arrays come out as joined text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shapelake.functions import color, geometry, text, vectors
from shapelake.operators import evaluation, graph, guides, pixels, ranking, shapes
from shapelake.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c: Column) -> Column:
    return F.round(c.cast("double"), 6)


def r6_binary(c: Column) -> Column:
    """A number from 0 on to 6 digits as DuckDB rounds it: by the double c * 10^6, where Spark goes by the digits of c."""
    scaled = c * 1e6
    low = F.floor(scaled)
    return (low + (scaled - low >= 0.5).cast("int")) / 1e6


def joined(c: Column) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


# ---- signatures and survival


def _part_signatures(spark: SparkSession, folder: str, odd: int | None = None) -> DataFrame:
    p = table(spark, folder, "part")
    if odd is not None:
        p = p.filter(F.pmod("p_size", F.lit(2)) == odd)
    return pixels.signatures(p, ["p_brand"], [F.floor(F.col("p_size") / 8), F.floor(F.col("p_retailprice") / 200)], F.col("p_size") / 50.0, F.col("p_retailprice") / 2000.0, 0.002, 24)


_SIG = """
  SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY share DESC, c0, c1) AS rank FROM (
    SELECT p_brand, c0, c1, n, cx, cy, n / sum(n) OVER (PARTITION BY p_brand) AS share FROM (
      SELECT p_brand, floor(p_size / 8.0)::BIGINT AS c0, floor(p_retailprice / 200)::BIGINT AS c1, count(*) AS n,
             avg(p_size / 50.0) AS cx, avg(p_retailprice / 2000.0) AS cy FROM part {where} GROUP BY ALL))
  WHERE share >= 0.002 QUALIFY rank <= 24
"""


@query(f"SELECT p_brand, c0, c1, n, round(share, 6) AS share, round(cx, 6) AS cx, round(cy, 6) AS cy, rank FROM ({_SIG.format(where='')})")
def q_signature_topk(spark, folder):
    """Strongest grid cells per group by share."""
    s = _part_signatures(spark, folder)
    return s.select("p_brand", "c0", "c1", "n", r6(F.col("share")).alias("share"), r6(F.col("cx")).alias("cx"), r6(F.col("cy")).alias("cy"), F.col("rank").cast("bigint").alias("rank"))


def _near() -> Column:
    return F.abs(F.col("p.c0") - F.col("q.c0")) * 0.05 + F.abs(F.col("p.c1") - F.col("q.c1")) * 0.05 + F.abs(F.col("p.cx") - F.col("q.cx"))


_NEAR = "abs(p.c0 - q.c0) * 0.05 + abs(p.c1 - q.c1) * 0.05 + abs(p.cx - q.cx) <= 0.03"
_ODD, _EVEN = _SIG.format(where="WHERE p_size % 2 = 1"), _SIG.format(where="WHERE p_size % 2 = 0")


@query(f"WITH p AS ({_ODD}), q AS ({_EVEN}) SELECT p_brand, c0, c1, n FROM p WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.p_brand = p.p_brand AND {_NEAR})")
def q_survival_missing(spark, folder):
    """Signatures without a match within a distance (anti join)."""
    return pixels.supported(_part_signatures(spark, folder, 1), _part_signatures(spark, folder, 0), _near(), 0.03, ["p_brand"], missing=True).select("p_brand", "c0", "c1", "n")


@query(f"WITH p AS ({_ODD}), q AS ({_EVEN}) SELECT p_brand, c0, c1, n FROM p WHERE EXISTS (SELECT 1 FROM q WHERE q.p_brand = p.p_brand AND {_NEAR})")
def q_survival_required(spark, folder):
    """Signatures that another side supports within a distance (semi join)."""
    return pixels.supported(_part_signatures(spark, folder, 1), _part_signatures(spark, folder, 0), _near(), 0.03, ["p_brand"]).select("p_brand", "c0", "c1", "n")


# ---- statistics


def _cells(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as cells of an image per return flag, labelled by supplier."""
    return table(spark, folder, "lineitem").select(F.col("l_returnflag").alias("image_id"), F.col("l_suppkey").alias("region"), F.col("l_linenumber").alias("x"), F.col("l_quantity").cast("int").alias("y"), "l_discount")


_STATS = """
SELECT {key}, count(*) AS n, min(l_linenumber) AS x0, min(l_quantity::INT) AS y0, max(l_linenumber) AS x1, max(l_quantity::INT) AS y1,
  sum(l_linenumber)::DOUBLE AS sx, sum(l_quantity::INT)::DOUBLE AS sy, sum(l_linenumber * l_linenumber)::DOUBLE AS sxx,
  sum(l_quantity::INT * l_quantity::INT)::DOUBLE AS syy, sum(l_linenumber * l_quantity::INT)::DOUBLE AS sxy,
  round(sum(l_discount), 6) AS s_disc, round(sum(l_discount * l_discount), 6) AS ss_disc
FROM lineitem {join} GROUP BY ALL
"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: r6(F.col(c)) for c in df.columns if c.startswith(("s_", "ss_"))})


@query(_STATS.format(key="l_returnflag AS image_id, l_suppkey AS region", join=""))
def q_region_stats(spark, folder):
    """Sufficient statistics per region."""
    return _rounded(pixels.region_stats(_cells(spark, folder), {"disc": F.col("l_discount")}))


@query(_STATS.format(key="l_returnflag AS image_id, s_nationkey::BIGINT AS region", join="JOIN supplier ON l_suppkey = s_suppkey"))
def q_stats_merge(spark, folder):
    """Statistics of merged regions from those of the regions."""
    stats = pixels.region_stats(_cells(spark, folder), {"disc": F.col("l_discount")})
    to = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("region"), F.col("s_nationkey").cast("bigint").alias("target"))
    return _rounded(pixels.merge_stats(stats, stats.select("image_id", "region").join(to, "region")))


@query(
    """SELECT l_partkey, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS discount, bool_or(l_returnflag = 'R') AS any_returned, max(l_tax) AS top_tax,
    min(l_linenumber) AS x0, max(l_linenumber) AS x1 FROM lineitem GROUP BY l_partkey"""
)
def q_weighted_mean(spark, folder):
    """Weighted mean, any-flag, greatest score and extent of a group."""
    q = F.col("l_quantity")
    return table(spark, folder, "lineitem").groupBy("l_partkey").agg(
        r6(F.sum(F.col("l_discount") * q) / F.sum(q)).alias("discount"),
        F.bool_or(F.col("l_returnflag") == "R").alias("any_returned"),
        F.max("l_tax").alias("top_tax"),
        F.min("l_linenumber").alias("x0"),
        F.max("l_linenumber").alias("x1"),
    )


_HIST = """
SELECT l_returnflag, l_linestatus, bin, count(*) AS n FROM (
  SELECT l_returnflag, l_linestatus, least(31, greatest(0, floor(l_discount * 10 * 32)))::INT AS bin FROM lineitem) GROUP BY ALL
"""


def _histograms(spark: SparkSession, folder: str) -> DataFrame:
    return pixels.histogram(table(spark, folder, "lineitem"), ["l_returnflag", "l_linestatus"], F.col("l_discount") * 10)


@query(
    f"""WITH h AS ({_HIST}), k AS (SELECT DISTINCT l_returnflag, l_linestatus FROM h), b AS (SELECT unnest(range(32)) AS bin)
    SELECT l_returnflag, l_linestatus, string_agg(coalesce(n, 0)::VARCHAR, ',' ORDER BY bin) AS hist
    FROM k CROSS JOIN b LEFT JOIN h USING (l_returnflag, l_linestatus, bin) GROUP BY ALL"""
)
def q_hist32(spark, folder):
    """Histogram arrays of 32 bins."""
    return _histograms(spark, folder).withColumn("hist", joined(F.col("hist")))


@query(
    f"""WITH h AS ({_HIST}), k AS (SELECT DISTINCT l_returnflag, l_linestatus FROM h), b AS (SELECT unnest(range(32)) AS bin),
    f AS (SELECT l_returnflag, l_linestatus, bin, coalesce(n, 0) AS n FROM k CROSS JOIN b LEFT JOIN h USING (l_returnflag, l_linestatus, bin)),
    c AS (SELECT *, sum(n) OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY bin) AS run, sum(n) OVER (PARTITION BY l_returnflag, l_linestatus) AS total FROM f)
    SELECT l_returnflag, l_linestatus, round(min(bin) FILTER (run >= 0.5 * (total - 1) + 1) / 31.0, 6) AS q50, round(min(bin) FILTER (run >= 0.9 * (total - 1) + 1) / 31.0, 6) AS q90
    FROM c GROUP BY ALL"""
)
def q_hist_quantile(spark, folder):
    """Quantile bins from running counts."""
    h = F.col("hist")
    return _histograms(spark, folder).select("l_returnflag", "l_linestatus", r6(pixels.hist_quantile(h, 0.5)).alias("q50"), r6(pixels.hist_quantile(h, 0.9)).alias("q90"))


# ---- a grid of labels: vectors as rows, their places as columns


def _grid(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings").select(F.lit("g").alias("image_id"), F.col("vec_id").cast("int").alias("y"), F.posexplode("embedding").alias("x", "v"))
    return e.withColumns({"v": F.col("v").cast("double"), "region": F.floor(F.col("v").cast("double") * 8).cast("int")})


_GRID = "SELECT vec_id::INT AS y, unnest(range(len(embedding)))::INT AS x, unnest(embedding)::DOUBLE AS v FROM embeddings"
_LABELS = f"SELECT y, x, v, floor(v * 8)::INT AS region FROM ({_GRID})"
_PAIRS = f"""
  WITH l AS ({_LABELS}), p AS (
    SELECT a.region AS ra, b.region AS rb FROM l a JOIN l b ON a.y = b.y AND b.x = a.x + 1
    UNION ALL SELECT a.region, b.region FROM l a JOIN l b ON a.x = b.x AND b.y = a.y + 1)
"""


@query(_PAIRS + "SELECT least(ra, rb) AS a, greatest(ra, rb) AS b, count(*) AS shared_px FROM p WHERE ra <> rb GROUP BY ALL")
def q_adjacency(spark, folder):
    """Boundary length of touching labels of a grid."""
    return pixels.adjacency(_grid(spark, folder)).select("a", "b", "shared_px")


@query(
    _PAIRS
    + f""", t AS (SELECT region, 4 * count(*) AS sides FROM l GROUP BY region), s AS (SELECT ra AS region, 2 * count(*) AS inner_sides FROM p WHERE ra = rb GROUP BY ra)
    SELECT region, (sides - coalesce(inner_sides, 0))::BIGINT AS perimeter_px FROM t LEFT JOIN s USING (region)"""
)
def q_perimeters(spark, folder):
    """Boundary length of every label, the border of the grid included."""
    return pixels.perimeters(_grid(spark, folder)).select("region", F.col("perimeter_px").cast("bigint").alias("perimeter_px"))


@query(
    f"""WITH m AS (SELECT y, x FROM ({_GRID}) WHERE v > 0), i AS (SELECT y, x, x - row_number() OVER (PARTITION BY y ORDER BY x) AS k FROM m)
    SELECT y, min(x) AS x0, max(x) + 1 AS x1 FROM i GROUP BY y, k"""
)
def q_runs(spark, folder):
    """Run-length encoding of a mask."""
    return pixels.encode_runs(_grid(spark, folder).filter("v > 0"), ["image_id"]).select("y", "x0", "x1")


@query(f"SELECT y, count(*) AS n, sum(x)::BIGINT AS sx FROM ({_GRID}) WHERE v > 0 GROUP BY y")
def q_runs_decoded(spark, folder):
    """Pixels back from runs: counts and sums of places per row."""
    runs = pixels.encode_runs(_grid(spark, folder).filter("v > 0"), ["image_id"])
    good, _ = pixels.decode_runs(runs, ["image_id"])
    return good.groupBy("y").agg(F.count("*").alias("n"), F.sum("x").cast("bigint").alias("sx"))


@query(f"SELECT y, count(*) FILTER (v > 0 AND v < 0.5) AS both, count(*) AS either, round(count(*) FILTER (v > 0 AND v < 0.5) / count(*), 6) AS iou FROM ({_GRID}) WHERE v > 0 OR v < 0.5 GROUP BY y")
def q_iou(spark, folder):
    """Intersection over union of two masks per row."""
    g = _grid(spark, folder)
    return pixels.iou(g.filter("v > 0"), g.filter("v < 0.5"), ["y"], ["x"]).withColumn("iou", r6(F.col("iou")))


@query(
    """WITH c AS (SELECT l_suppkey, p_brand, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
    r AS (SELECT *, row_number() OVER w AS k, lead(n) OVER w AS second, sum(n) OVER (PARTITION BY l_suppkey) AS total FROM c WINDOW w AS (PARTITION BY l_suppkey ORDER BY n DESC, p_brand))
    SELECT l_suppkey, p_brand AS winner, n, coalesce(second, 0) AS second, round((n - coalesce(second, 0)) / total, 6) AS margin FROM r WHERE k = 1"""
)
def q_contingency_winner(spark, folder):
    """Most frequent partner of each key with the margin to the runner-up."""
    j = table(spark, folder, "lineitem").select("l_suppkey", "l_partkey").join(table(spark, folder, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return pixels.winner(j, ["l_suppkey"], "p_brand").withColumn("margin", r6(F.col("margin")))


# ---- guides and masks on the grid of labels


def _guide(spark: SparkSession, folder: str, least: float, names: int) -> DataFrame:
    g = _grid(spark, folder).filter(F.col("v") > least)
    return g.select("image_id", F.concat(F.lit("l"), F.pmod("x", F.lit(names)).cast("string")).alias("label"), "y", "x", F.abs("v").alias("confidence"))


@query(
    f"""WITH g AS ({_GRID}), u AS (SELECT 'l' || (x % 3)::VARCHAR AS label, y, x, abs(v) AS c FROM g WHERE v > 0.3 UNION ALL SELECT 'l' || (x % 4)::VARCHAR, y, x, abs(v) / 2 FROM g WHERE v > 0.1)
    SELECT label, y, x, round(max(c), 6) AS confidence FROM u GROUP BY ALL"""
)
def q_guide_fusion(spark, folder):
    """Greatest confidence of each label at each place over two guides."""
    second = _guide(spark, folder, 0.1, 4).withColumn("confidence", F.col("confidence") / 2)
    return guides.fuse_guides(_guide(spark, folder, 0.3, 3), second).select("label", "y", "x", r6(F.col("confidence")).alias("confidence"))


@query(
    f"""WITH l AS ({_LABELS}), n AS (SELECT y % 50 AS img, region, count(*) AS n FROM l GROUP BY ALL),
    s AS (SELECT y % 50 AS img, region, 'l' || (x % 3)::VARCHAR AS label, sum(abs(v)) AS s FROM l WHERE v > 0.3 GROUP BY ALL),
    b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY img, region ORDER BY s DESC, label) = 1)
    SELECT n.img::INT AS img, n.region, b.label, round(coalesce(b.s / n.n, 0), 6) AS confidence FROM n LEFT JOIN b USING (img, region)"""
)
def q_region_semantics(spark, folder):
    """Label of greatest mean confidence per region."""
    image = F.pmod("y", F.lit(50)).cast("string")
    out = guides.region_semantics(_grid(spark, folder).withColumn("image_id", image), _guide(spark, folder, 0.3, 3).withColumn("image_id", image))
    return out.select(F.col("image_id").cast("int").alias("img"), "region", "label", r6(F.col("confidence")).alias("confidence"))


@query(
    f"""WITH g AS ({_GRID}), m AS (SELECT (y // 50)::INT AS img, 'a' AS role, y, x FROM g WHERE v > 0.3 UNION ALL SELECT (y // 50)::INT, 'b', y, x FROM g WHERE v < -0.3 UNION ALL SELECT (y // 50)::INT, 'c', y, x FROM g WHERE v BETWEEN 0.28 AND 0.32),
    n AS (SELECT img, role, count(*) AS n FROM m GROUP BY ALL), p AS (SELECT i.img, i.role AS a, j.role AS b, i.n AS na, j.n AS nb FROM n i JOIN n j ON i.img = j.img AND i.role < j.role),
    s AS (SELECT i.img, i.role AS a, j.role AS b, count(*) AS shared FROM m i JOIN m j USING (img, y, x) WHERE i.role < j.role GROUP BY ALL),
    d AS (SELECT UNNEST(range(-1, 2)) AS d), w AS (SELECT DISTINCT img, role, y + d1.d AS y, x + d2.d AS x FROM m, d d1, d d2),
    c AS (SELECT w.img, w.role AS a, j.role AS b, count(*) AS contact FROM w JOIN m j ON w.img = j.img AND w.y = j.y AND w.x = j.x WHERE w.role < j.role GROUP BY ALL)
    SELECT img, a, b, CASE WHEN shared > 0 THEN 'OVERLAP' WHEN contact > 0 THEN 'TOUCHING' ELSE 'DISJOINT' END AS relation, coalesce(shared, 0) AS shared, coalesce(contact, 0) AS contact, round(coalesce(shared, 0) / na, 6) AS share_a, round(coalesce(shared, 0) / nb, 6) AS share_b
    FROM p LEFT JOIN s USING (img, a, b) LEFT JOIN c USING (img, a, b)"""
)
def q_mask_relations(spark, folder):
    """Overlap, contact or neither of every two masks."""
    g = _grid(spark, folder).withColumn("image_id", F.floor(F.col("y") / 50).cast("string"))
    v = F.col("v")
    roles = F.array_compact(F.array(F.when(v > 0.3, "a"), F.when(v < -0.3, "b"), F.when(v.between(0.28, 0.32), "c")))
    out = guides.mask_relations(g.select("image_id", F.explode(roles).alias("role"), "y", "x"))
    return out.select(F.col("image_id").cast("int").alias("img"), "a", "b", "relation", "shared", "contact", r6(F.col("share_a")).alias("share_a"), r6(F.col("share_b")).alias("share_b"))


@query(
    f"""WITH l AS ({_LABELS}), p AS (SELECT i.y AS y, i.x AS x, j.y AS y2, j.x AS x2, i.region <> j.region AS diff FROM l i JOIN l j ON i.y = j.y AND j.x = i.x + 1 UNION ALL SELECT i.y, i.x, j.y, j.x, i.region <> j.region FROM l i JOIN l j ON i.x = j.x AND j.y = i.y + 1),
    b AS (SELECT y, x FROM p WHERE diff UNION SELECT y2, x2 FROM p WHERE diff), d AS (SELECT UNNEST(range(-1, 2)) AS d), n AS (SELECT DISTINCT b.y + d1.d AS y, b.x + d2.d AS x FROM b, d d1, d d2),
    e AS (SELECT y, x, least(1, greatest(0, v)) AS w FROM l) SELECT round(sum(w) FILTER (n.y IS NOT NULL) / sum(w), 6) AS coverage FROM e LEFT JOIN n USING (y, x)"""
)
def q_edge_coverage(spark, folder):
    """Share of edge weight near label boundaries."""
    return guides.edge_coverage(_grid(spark, folder), "v").select(r6(F.col("coverage")).alias("coverage"))


@query(
    """WITH b AS (SELECT c_nationkey AS k, o_orderstatus AS s, o_orderkey AS id, o_totalprice / 1000 AS x, extract(day FROM o_orderdate) AS y FROM orders JOIN customer ON o_custkey = c_custkey)
    SELECT id FROM b WHERE NOT EXISTS (SELECT 1 FROM b o WHERE o.k = b.k AND o.s = b.s AND o.id <> b.id AND sqrt(pow(greatest(0, abs(o.x - b.x) - 1), 2) + pow(greatest(0, abs(o.y - b.y) - 0.5), 2)) <= 0.75)"""
)
def q_isolated(spark, folder):
    """Boxes without a neighbour of their layer within reach."""
    o = table(spark, folder, "orders").join(table(spark, folder, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    box = F.array(F.col("o_totalprice") / 1000, F.dayofmonth("o_orderdate").cast("double"), F.lit(1.0), F.lit(0.5))
    s = o.select(F.col("c_nationkey").alias("image_id"), F.col("o_orderstatus").alias("layer"), F.col("o_orderkey").alias("shape_id"), box.alias("box"))
    return shapes.isolated(s, F.lit(0.75)).select(F.col("shape_id").alias("id"))


@query(
    """WITH m AS (SELECT l_returnflag AS run_id, l_linenumber AS phase, avg(l_quantity) AS mean_seconds FROM lineitem GROUP BY ALL)
    SELECT run_id, phase, round(mean_seconds, 6) AS mean_seconds, round(mean_seconds / sum(mean_seconds) OVER (PARTITION BY run_id), 6) AS share FROM m"""
)
def q_phase_profile(spark, folder):
    """Mean of each phase and its share of the run."""
    t = table(spark, folder, "lineitem").select(F.col("l_returnflag").alias("run_id"), F.col("l_linenumber").alias("phase"), F.col("l_quantity").alias("seconds"))
    return shapes.phase_profile(t).withColumns({c: r6(F.col(c)) for c in ("mean_seconds", "share")})


@query(
    """WITH m AS (SELECT o_custkey, avg(o_totalprice) AS mean, max(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END) AS top FROM orders GROUP BY ALL)
    SELECT o_custkey, concat_ws(',', CASE WHEN NOT coalesce(mean <= 260000, false) THEN 'mean' END, CASE WHEN NOT coalesce(top <= 400000, false) THEN 'top' END) AS exceeded, coalesce(mean <= 260000, false) AND coalesce(top <= 400000, false) AS passed FROM m"""
)
def q_within_budget(spark, folder):
    """Measurements against limits; a missing one exceeds."""
    m = table(spark, folder, "orders").groupBy("o_custkey").agg(F.avg("o_totalprice").alias("mean"), F.max(F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice"))).alias("top"))
    return shapes.within_budget(m, ["o_custkey"], {"mean": 260000.0, "top": 400000.0}).withColumn("exceeded", F.array_join("exceeded", ","))


# ---- case rules and ranking


@query(
    """SELECT o_orderkey, CASE WHEN o_totalprice >= 200000 AND o_orderpriority LIKE '1%' THEN 'vertical' WHEN o_orderstatus = 'F' AND o_totalprice < 50000 THEN 'boat'
    WHEN o_orderstatus = 'P' THEN 'water' WHEN o_totalprice >= 100000 THEN 'structure' ELSE 'misc' END AS role FROM orders"""
)
def q_role_case(spark, folder):
    """Ordered case rules."""
    price, status = F.col("o_totalprice"), F.col("o_orderstatus")
    role = F.when((price >= 200000) & F.col("o_orderpriority").startswith("1"), "vertical").when((status == "F") & (price < 50000), "boat").when(status == "P", "water").when(price >= 100000, "structure").otherwise("misc")
    return table(spark, folder, "orders").select("o_orderkey", role.alias("role"))


_QUOTAS = {"BUILDING": 5, "MACHINERY": 3, "AUTOMOBILE": 4}
_QUOTA_SQL = "CASE c_mktsegment WHEN 'BUILDING' THEN 5 WHEN 'MACHINERY' THEN 3 WHEN 'AUTOMOBILE' THEN 4 ELSE 0 END"


@query(
    f"""WITH t AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS k FROM customer),
    q AS (SELECT c_custkey, c_nationkey FROM t WHERE k <= {_QUOTA_SQL}), u AS (SELECT c_nationkey, count(*) AS used FROM q GROUP BY ALL),
    f AS (SELECT t.c_custkey, t.c_nationkey, 12 - coalesce(used, 0) AS room, row_number() OVER (PARTITION BY t.c_nationkey ORDER BY c_acctbal DESC, t.c_custkey) AS k
          FROM t LEFT JOIN u USING (c_nationkey) WHERE t.c_custkey NOT IN (SELECT c_custkey FROM q))
    SELECT c_nationkey, c_custkey, 'quota' AS picked FROM q UNION ALL SELECT c_nationkey, c_custkey, 'fill' FROM f WHERE k <= room"""
)
def q_layer_topk_quota(spark, folder):
    """Top rows per layer by quota with the rest filled by the best of all others."""
    best = [F.desc("c_acctbal")]
    return ranking.quota_with_backfill(table(spark, folder, "customer"), ["c_nationkey"], "c_mktsegment", _QUOTAS, best, best, ["c_custkey"]).select("c_nationkey", "c_custkey", "picked")


@query(
    """WITH s AS (SELECT *, CASE WHEN c_acctbal < 2000 THEN 'left' WHEN c_acctbal > 7000 THEN 'right' ELSE 'center' END AS side FROM customer),
    r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey, side ORDER BY c_acctbal DESC, c_custkey) AS k FROM s),
    o AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN k <= CASE side WHEN 'center' THEN 2 ELSE 4 END THEN 0 ELSE 1 END, c_acctbal DESC, c_custkey) AS rank FROM r)
    SELECT c_nationkey, c_custkey, side, rank FROM o WHERE rank <= 10"""
)
def q_balanced_take(spark, folder):
    """A limit shared out between two sides and the center."""
    side = F.when(F.col("c_acctbal") < 2000, "left").when(F.col("c_acctbal") > 7000, "right").otherwise("center")
    c = table(spark, folder, "customer").withColumn("side", side)
    return ranking.balanced_take(c, ["c_nationkey"], "side", 10, [F.desc("c_acctbal")], ["c_custkey"]).select("c_nationkey", "c_custkey", "side", F.col("rank").cast("bigint").alias("rank"))


@query("SELECT l_suppkey, l_orderkey, l_linenumber, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS rank FROM lineitem) WHERE rank <= 3")
def q_top3(spark, folder):
    """Top three rows per group."""
    tie = ["l_orderkey", "l_linenumber", "l_partkey"]
    return ranking.top_per_group(table(spark, folder, "lineitem"), ["l_suppkey"], [F.desc("l_extendedprice")], 3, tie).select("l_suppkey", "l_orderkey", "l_linenumber", F.col("rank").cast("bigint").alias("rank"))


@query(
    """WITH c AS (SELECT l_partkey, l_suppkey, avg(l_extendedprice / l_quantity) AS p, avg(l_discount) AS d FROM lineitem GROUP BY ALL),
    s AS (SELECT *, round(p / 1000 - d, 12) AS score FROM c WHERE d <= 0.07)
    SELECT l_partkey, round(score, 9) AS score, l_suppkey FROM s QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY score, l_suppkey) = 1"""
)
def q_argmin_candidate(spark, folder):
    """Cheapest candidate that passes a gate, ties by id."""
    c = table(spark, folder, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("p"), F.avg("l_discount").alias("d"))
    best = ranking.best_per_group(c.filter("d <= 0.07"), ["l_partkey"], F.col("p") / 1000 - F.col("d"), "l_suppkey", [])
    return best.select("l_partkey", F.round("score", 9).alias("score"), "l_suppkey")


@query(
    """SELECT l_partkey, coalesce(string_agg(DISTINCT l_suppkey::VARCHAR, ',' ORDER BY l_suppkey::VARCHAR) FILTER (l_discount > 0.07), '') AS refused FROM lineitem GROUP BY l_partkey"""
)
def q_rejected_array(spark, folder):
    """Sorted ids of refused candidates."""
    ids = F.array_sort(F.collect_set(F.when(F.col("l_discount") > 0.07, F.col("l_suppkey").cast("string"))))
    return table(spark, folder, "lineitem").groupBy("l_partkey").agg(F.array_join(ids, ",").alias("refused"))


@query(
    """SELECT p_partkey, f.family, round(p_size * f.share, 6) AS covered, p_partkey::VARCHAR || ':' || f.family AS candidate_id FROM part
    JOIN (VALUES ('rectangle', 1.0::DOUBLE), ('trapezoid', 0.88::DOUBLE), ('triangle', 0.5::DOUBLE)) f(family, share) ON p_size * f.share >= 5"""
)
def q_candidate_explode(spark, folder):
    """Candidates per row from a list of families, with derived metrics."""
    fams = F.array(*[F.struct(F.lit(n).alias("family"), F.lit(s).alias("share")) for n, s in (("rectangle", 1.0), ("trapezoid", 0.88), ("triangle", 0.5))])
    p = table(spark, folder, "part").select("p_partkey", "p_size", F.explode(fams).alias("f")).filter(F.col("p_size") * F.col("f.share") >= 5)
    return p.select("p_partkey", "f.family", r6(F.col("p_size") * F.col("f.share")).alias("covered"), F.concat_ws(":", F.col("p_partkey").cast("string"), "f.family").alias("candidate_id"))


@query(
    """WITH c AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY ALL), s AS (SELECT *, n / sum(n) OVER () AS share FROM c),
    w AS (SELECT *, share / sum(share) OVER () * (400 - count(*) OVER ()) AS raw, row_number() OVER (ORDER BY n DESC, c_nationkey) - 1 AS i FROM s),
    e AS (SELECT *, floor(raw) AS whole, 400 - count(*) OVER () - sum(floor(raw)) OVER () AS rest FROM w),
    x AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY round(raw - whole, 9) DESC, i) <= rest THEN 1 ELSE 0 END AS extra FROM e),
    z AS (SELECT *, sum(whole + extra + 1) OVER (ORDER BY i) AS stop FROM x)
    SELECT c_nationkey, n, (stop - whole - extra - 1)::BIGINT AS start, stop::BIGINT AS stop FROM z"""
)
def q_cum_bounds(spark, folder):
    """Proportional segments by largest remainders."""
    c = table(spark, folder, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    total = c.agg(F.sum("n").alias("t")).select("t").scalar()
    s = c.withColumns({"share": F.col("n") / total, "one": F.lit(1)})
    out = ranking.proportional_bounds(s, ["one"], "share", F.lit(400), [F.desc("n"), F.col("c_nationkey")])
    return out.select("c_nationkey", "n", F.col("start").cast("bigint").alias("start"), F.col("stop").cast("bigint").alias("stop"))


@query(
    """WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
    k AS (SELECT unnest(range(8)) AS k)
    SELECT user_id, event_id FROM r WHERE n <= 8 UNION SELECT user_id, event_id FROM r, k WHERE n > 8 AND i = floor(k * (n - 1) / 7.0)"""
)
def q_even_sample(spark, folder):
    """Up to eight evenly spaced members of each group."""
    return ranking.even_sample(table(spark, folder, "events"), ["user_id"], ["ts", "event_id"], 8).select("user_id", "event_id")


@query(
    """WITH g AS (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)
    SELECT user_id, median(gap)::DOUBLE AS spacing, count(gap) AS gaps FROM g WHERE gap IS NOT NULL GROUP BY user_id"""
)
def q_spacing_median(spark, folder):
    """Median gap, in microseconds, between consecutive rows of each group."""
    e = table(spark, folder, "events")
    g = ranking.spacing(e, ["user_id"], F.unix_micros(F.col("ts").cast("timestamp")), ["event_id"])
    return g.groupBy("user_id").agg(F.median("gap").cast("double").alias("spacing"), F.count("gap").alias("gaps"))


@query(
    """WITH d AS (SELECT event_type, date_trunc('day', ts)::DATE AS day, count(*) AS n FROM events GROUP BY ALL)
    SELECT event_type, day, n, round(sum(n) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5, 6) AS smooth FROM d"""
)
def q_moving_avg(spark, folder):
    """Centered zero-padded mean over daily counts."""
    d = table(spark, folder, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return ranking.padded_moving_average(d, ["event_type"], "day", "n", 2).withColumn("smooth", r6(F.col("smooth")))


def _features(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part")
    disposition = F.when(F.pmod("p_partkey", F.lit(3)) == 0, "required").when(F.pmod("p_partkey", F.lit(3)) == 1, "optional").otherwise("forbidden")
    tier = F.element_at(F.array(*map(F.lit, ("identity_critical", "important", "supporting", "compressible"))), (F.pmod("p_size", F.lit(4)) + 1).cast("int"))
    return p.select(F.col("p_brand").alias("case_id"), F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("feature_id"), disposition.alias("disposition"), tier.alias("importance"), F.when(F.pmod("p_size", F.lit(7)) == 0, "omit").otherwise("preserve").alias("compression_policy"))


@query(
    """WITH f AS (SELECT p_brand AS case_id, lpad(p_partkey::VARCHAR, 9, '0') AS feature_id, CASE p_partkey % 3 WHEN 0 THEN 'required' WHEN 1 THEN 'optional' ELSE 'forbidden' END AS disposition,
      CASE p_size % 4 WHEN 0 THEN 'identity_critical' WHEN 1 THEN 'important' WHEN 2 THEN 'supporting' ELSE 'compressible' END AS importance, p_size % 4 AS imp,
      p_partkey % 3 <> 2 AND p_size % 7 <> 0 AS e FROM part),
    a AS (SELECT *, CASE WHEN disposition = 'required' THEN 0 ELSE 100 END + imp AS tier, e AND disposition = 'required' AS req FROM f),
    b AS (SELECT *, count(*) FILTER (req) OVER (PARTITION BY case_id) AS need, row_number() OVER (PARTITION BY case_id, e, req ORDER BY tier, feature_id) AS opt FROM a),
    c AS (SELECT *, CASE WHEN req THEN 1 WHEN e AND opt <= 90000 - need THEN 1 ELSE 0 END AS base FROM b),
    d AS (SELECT *, 90000 - sum(base) OVER (PARTITION BY case_id) AS rest, min(tier) FILTER (e) OVER (PARTITION BY case_id) AS top FROM c),
    g AS (SELECT *, e AND tier = top AS inn, count(*) FILTER (e AND tier = top) OVER (PARTITION BY case_id) AS width, row_number() OVER (PARTITION BY case_id, (e AND tier = top) ORDER BY feature_id) AS place FROM d)
    SELECT case_id, feature_id, disposition, importance, (base + CASE WHEN inn THEN floor(rest / width) + CASE WHEN place <= rest % width THEN 1 ELSE 0 END ELSE 0 END)::BIGINT AS allocated FROM g"""
)
def q_semantic_budget(spark, folder):
    """Slots by minimum and priority, the rest round the top tier."""
    return ranking.semantic_budget(_features(spark, folder), 90000)


@query(None)
def q_layer_budget(spark, folder):
    """Whole slots per layer adding up to a target (a handful of numbers; tested against the rule)."""
    got = ranking.layer_budget(100, {"skyline": 0.3, "midground": 0.3, "water": 0.1, "foreground": 0.1, "accents": 0.2}, ["midground", "skyline", "foreground", "accents", "water"], ["accents", "water", "foreground", "midground", "skyline"])
    return spark.createDataFrame(list(got.items()), "layer string, slots int")


# ---- joins


@query(
    """SELECT o_orderkey, n_name, r_name, c_mktsegment, round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY n_name), 9) AS ratio FROM orders
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
)
def q_palette_lookup(spark, folder):
    """Lookup through dimension tables, with the row's share of its group."""
    t = lambda n: table(spark, folder, n)
    j = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    sums = j.groupBy("n_name").agg(F.sum("o_totalprice").alias("t"))  # a third of all orders may be one nation's: sums combine, a window would not
    return j.join(sums, "n_name").select("o_orderkey", "n_name", "r_name", "c_mktsegment", F.round(F.col("o_totalprice") / F.col("t"), 9).alias("ratio"))


@query(
    """SELECT o_orderkey, l_linenumber, l_partkey, p_brand, (c_custkey IS NULL) AS no_customer FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
    LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0 WHERE l_quantity >= 45"""
)
def q_compose_join(spark, folder):
    """Three-way join with a strictness flag for what has no partner."""
    return _composed(spark, folder, table(spark, folder, "lineitem").filter("l_quantity >= 45"))


@query(
    """SELECT o_orderkey, l_linenumber, l_partkey, p_brand, (c_custkey IS NULL) AS no_customer FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
    LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0"""
)
def q_compose_all(spark, folder):
    """The three-way join over all line items."""
    return _composed(spark, folder, table(spark, folder, "lineitem"))


def _composed(spark: SparkSession, folder: str, lineitem: DataFrame) -> DataFrame:
    t = lambda n: table(spark, folder, n)
    l = lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    j = l.join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    j = j.join(t("customer").filter("c_acctbal > 0").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return j.select("o_orderkey", "l_linenumber", "l_partkey", "p_brand", F.col("c_custkey").isNull().alias("no_customer"))


@query(
    """WITH o AS (SELECT eval_id, max(pass_transaction::INT) = 1 AS passed FROM evaluations GROUP BY eval_id), f AS (SELECT DISTINCT screen_id, CASE WHEN admitted THEN 'required' ELSE 'forbidden' END AS disposition FROM screened_cases),
    j AS (SELECT screen_id::VARCHAR AS feature_id, disposition, CASE WHEN eval_id IS NULL THEN 'unknown' WHEN passed THEN 'present' ELSE 'absent' END AS state FROM f LEFT JOIN o ON eval_id = screen_id)
    SELECT feature_id, disposition, state, CASE WHEN (disposition = 'required' AND state <> 'present') OR (disposition = 'forbidden' AND state <> 'absent') THEN disposition || '_feature_' || state END AS failure FROM j"""
)
def q_feature_left_default(spark, folder):
    """Left join with default states and rule-based failures."""
    s = table(spark, folder, "screened_cases").select(F.lit("all").alias("case_id"), F.col("screen_id").cast("string").alias("feature_id"), F.when(F.col("admitted"), "required").otherwise("forbidden").alias("disposition")).distinct()
    e = table(spark, folder, "evaluations").groupBy("eval_id").agg((F.max(F.col("pass_transaction").cast("int")) == 1).alias("p"))
    o = e.select(F.lit("all").alias("case_id"), F.col("eval_id").cast("string").alias("feature_id"), F.when(F.col("p"), "present").otherwise("absent").alias("state"), F.lit("evaluation").alias("source"), F.lit(1.0).alias("confidence"))
    rows, _ = evaluation.feature_survival(s, o)
    return rows.select("feature_id", "disposition", "state", "failure")


@query("SELECT DISTINCT eval_id FROM evaluations WHERE eval_id NOT IN (SELECT screen_id FROM screened_cases WHERE screen_id IS NOT NULL)")
def q_unknown_fk(spark, folder):
    """Keys without a record in the other table."""
    return table(spark, folder, "evaluations").select("eval_id").distinct().join(table(spark, folder, "screened_cases").select(F.col("screen_id").alias("eval_id")), "eval_id", "left_anti")


@query(
    """WITH b AS (SELECT c_nationkey AS k, o_orderkey AS id, o_totalprice / 1000 AS x, extract(day FROM o_orderdate) AS y FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice >= 400000)
    SELECT a.id AS a, b.id AS b, round(greatest(0, least(a.x + 8, b.x + 8) - greatest(a.x, b.x)) * greatest(0, least(a.y + 4, b.y + 4) - greatest(a.y, b.y)) / 32, 6) AS overlap
    FROM b a JOIN b b ON a.k = b.k AND a.id < b.id AND abs(a.x - b.x) < 8 AND abs(a.y - b.y) < 4"""
)
def q_overlap_pairs(spark, folder):
    """Overlapping boxes within a key, met through grid cells."""
    o = _order_boxes(table(spark, folder, "orders").filter("o_totalprice >= 400000")).join(table(spark, folder, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return _overlapping(o, "c_nationkey")


_OVERLAP = """WITH b AS ({boxes})
    SELECT a.id AS a, b.id AS b, round(greatest(0, least(a.x + 8, b.x + 8) - greatest(a.x, b.x)) * greatest(0, least(a.y + 4, b.y + 4) - greatest(a.y, b.y)) / 32, 6) AS overlap
    FROM b a JOIN b b ON a.k = b.k AND a.id < b.id AND abs(a.x - b.x) < 8 AND abs(a.y - b.y) < 4"""


def _order_boxes(o: DataFrame) -> DataFrame:
    """Of orders, only the keys and the corner; a join moves a day in fewer bytes than a date."""
    return o.select("o_orderkey", "o_custkey", (F.col("o_totalprice") / 1000).alias("x"), F.dayofmonth("o_orderdate").cast("byte").alias("y"))


def _overlapping(o: DataFrame, key: str) -> DataFrame:
    from shapelake.operators.evidence import overlaps

    box = F.array(F.col("x"), F.col("y").cast("double"), F.lit(8.0), F.lit(4.0))
    r = o.select(F.col(key).alias("scene_id"), F.col("o_orderkey").alias("region_id"), box.alias("box"))
    return overlaps(r, cell=8.0).select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), r6_binary(F.col("confidence")).alias("overlap"))


@query(_OVERLAP.format(boxes="SELECT c_nationkey AS k, o_orderkey AS id, o_totalprice / 1000 AS x, extract(day FROM o_orderdate) AS y FROM orders JOIN customer ON o_custkey = c_custkey"))
def q_overlap_all(spark, folder):
    """Overlapping boxes of all orders within a nation; pairs grow with the square of a nation's orders."""
    o = _order_boxes(table(spark, folder, "orders")).join(table(spark, folder, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return _overlapping(o, "c_nationkey")


@query(_OVERLAP.format(boxes="SELECT o_custkey AS k, o_orderkey AS id, o_totalprice / 1000 AS x, extract(day FROM o_orderdate) AS y FROM orders"))
def q_overlap_customer(spark, folder):
    """Overlapping boxes of all orders within a customer."""
    return _overlapping(_order_boxes(table(spark, folder, "orders")), "o_custkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 30 DAY")
def q_residual_join(spark, folder):
    """Equi join with a range as residual."""
    l, o = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    on = (F.col("l_orderkey") == F.col("o_orderkey")) & F.col("l_shipdate").between(F.col("o_orderdate"), F.col("o_orderdate") + F.expr("INTERVAL 30 DAY"))
    return l.join(o, on).select("l_orderkey", "l_linenumber", "l_partkey", "o_orderdate")


# ---- vectors


@query(
    """WITH m AS (SELECT label AS center_id, list(m ORDER BY i) AS center FROM (SELECT label, i, avg(v)::DOUBLE AS m FROM (SELECT label, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY label, i) GROUP BY label),
    d AS (SELECT vec_id, center_id, list_sum(list_transform(list_zip(embedding, center), lambda p: pow(p[1]::DOUBLE - p[2], 2))) AS d FROM embeddings, m)
    SELECT center_id, count(*) AS n FROM (SELECT vec_id, center_id FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(d, 9), center_id) = 1) GROUP BY center_id"""
)
def q_nearest_center(spark, folder):
    """Members of the nearest of a few centers."""
    e = table(spark, folder, "embeddings")
    return nearest_center(e, _centers(e), "vec_id", "embedding").groupBy("center_id").agg(F.count("*").alias("n"))


def _centers(e: DataFrame) -> DataFrame:
    """Mean vector per label."""
    p = e.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    return p.groupBy(F.col("label").alias("center_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("center"))


def nearest_center(rows: DataFrame, centers: DataFrame, key: str, vec: str) -> DataFrame:
    """Nearest center of every row by squared distance, ties to the smaller id. The centers (their number is
    that of labels or palette colors) travel as one array in a scalar subquery; rows don't shuffle."""
    all_ = centers.agg(F.array_sort(F.collect_list(F.struct("center_id", "center"))).alias("c")).select("c").scalar()
    best = F.array_min(F.transform(F.col("_c"), lambda c: F.struct(F.round(vectors.squared_distance(F.col(vec), c["center"]), 9).alias("d"), c["center_id"].alias("center_id"))))
    return rows.withColumn("_c", all_).select(key, best["center_id"].alias("center_id"), best["d"].alias("d"))


_MEAN = """SELECT label, i, avg(v)::DOUBLE AS m FROM (SELECT label, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY label, i"""


@query(f"WITH m AS ({_MEAN}), n AS (SELECT label, sqrt(sum(m * m)) AS n FROM m GROUP BY label) SELECT label AS center_id, i, round(m / n, 6) AS value FROM m JOIN n USING (label)")
def q_centroid(spark, folder):
    """Unit mean vector per group, by place."""
    c = _centers(table(spark, folder, "embeddings")).withColumn("u", vectors.normalize(F.col("center")))
    return c.select("center_id", F.posexplode("u").alias("i", "value")).select("center_id", F.col("i").cast("bigint").alias("i"), r6(F.col("value")).alias("value"))


@query(
    f"""WITH m AS ({_MEAN}), n AS (SELECT label, i, m / sqrt(sum(m * m) OVER (PARTITION BY label)) AS u FROM m),
    d AS (SELECT i, max(u) FILTER (label = 1) - max(u) FILTER (label = 0) AS d FROM n GROUP BY i) SELECT i, round(d / sqrt(sum(d * d) OVER ()), 6) AS value FROM d"""
)
def q_contrast_dir(spark, folder):
    """Unit difference of two groups' unit means."""
    c = _centers(table(spark, folder, "embeddings").filter("label in (0, 1)"))
    both = c.agg(F.max_by("center", F.when(F.col("center_id") == 1, 1)).alias("p"), F.max_by("center", F.when(F.col("center_id") == 0, 1)).alias("q"))
    d = F.zip_with(vectors.normalize(F.col("p")), vectors.normalize(F.col("q")), lambda a, b: a - b)
    return both.select(F.posexplode(vectors.normalize(d)).alias("i", "value")).select(F.col("i").cast("bigint").alias("i"), r6(F.col("value")).alias("value"))


@query(
    """SELECT a.vec_id AS a, b.vec_id AS b, round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS loss FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"""
)
def q_cosine(spark, folder):
    """Cosine loss of aligned vectors."""
    a = table(spark, folder, "embeddings").select(F.col("vec_id").alias("a"), F.col("embedding").cast("array<double>").alias("ea"))
    b = table(spark, folder, "embeddings").select(F.col("vec_id").alias("b"), (F.col("vec_id") - 1).alias("a"), F.col("embedding").cast("array<double>").alias("eb"))
    return a.join(b, "a").select("a", "b", F.round(vectors.cosine_loss(F.col("ea"), F.col("eb")), 5).alias("loss"))


@query(
    """WITH m AS (SELECT label, i, median(v) AS m FROM (SELECT label, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY label, i),
    d AS (SELECT vec_id, e.label, sum(abs(v - m)) AS d FROM (SELECT vec_id, label, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings) e JOIN m ON m.label = e.label AND m.i = e.i GROUP BY ALL)
    SELECT label, vec_id, round(d, 5) AS d FROM d QUALIFY row_number() OVER (PARTITION BY label ORDER BY round(d, 9), vec_id) = 1"""
)
def q_medoid(spark, folder):
    """Member nearest to its group's median vector."""
    e = table(spark, folder, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "v")).withColumn("v", F.col("v").cast("double"))
    m = e.groupBy("label", "i").agg(F.median("v").alias("m"))
    d = e.join(m, ["label", "i"]).groupBy("label", "vec_id").agg(F.sum(F.abs(F.col("v") - F.col("m"))).alias("d"))
    best = F.min(F.struct(F.round("d", 9).alias("d"), "vec_id")).alias("b")
    return d.groupBy("label").agg(best).select("label", "b.vec_id", F.round("b.d", 5).alias("d"))


# ---- evaluation


@query(
    """WITH m AS (SELECT c_mktsegment, date_trunc('month', o_orderdate)::DATE AS month, round(sum(o_totalprice), 2) AS score FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
    l AS (SELECT *, lag(score) OVER (PARTITION BY c_mktsegment ORDER BY month) AS previous FROM m)
    SELECT c_mktsegment, month, score, previous, round(score - previous, 2) AS delta, CASE WHEN previous IS NULL THEN 'evaluated' WHEN score > previous THEN 'improved' WHEN score < previous THEN 'regressed' ELSE 'unchanged' END AS verdict FROM l"""
)
def q_delta_verdict(spark, folder):
    """Score against the run before, with verdict."""
    o = table(spark, folder, "orders").join(table(spark, folder, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    m = o.groupBy("c_mktsegment", F.to_date(F.date_trunc("month", "o_orderdate")).alias("month")).agg(F.round(F.sum("o_totalprice"), 2).alias("score"))
    return evaluation.verdicts(m, ["c_mktsegment"], ["month"], "score").withColumn("delta", F.round("delta", 2))


@query(
    """WITH d AS (SELECT unnest(map_entries(diagnostics)) AS e FROM case_snapshots)
    SELECT e.key AS name, count(*) FILTER (e.value.status = 'AVAILABLE') AS available, count(*) FILTER (e.value.status IS DISTINCT FROM 'AVAILABLE') AS unavailable,
    min(e.value.value) FILTER (e.value.status = 'AVAILABLE') AS least, max(e.value.value) FILTER (e.value.status = 'AVAILABLE') AS greatest FROM d GROUP BY ALL"""
)
def q_unpivot_minmax(spark, folder):
    """Available and unavailable counts and range of every diagnostic."""
    return evaluation.distributions(table(spark, folder, "case_snapshots"), F.col("diagnostics"))


@query(
    """WITH d AS (SELECT case_id, snapshot_no, unnest(map_entries(diagnostics)) AS e FROM case_snapshots)
    SELECT e.key AS name, CASE WHEN e.value.status IS NULL OR e.value.status NOT IN ('AVAILABLE', 'UNAVAILABLE') THEN 'status' WHEN e.value.status = 'UNAVAILABLE' AND coalesce(trim(e.value.reason), '') = '' THEN 'reason'
    WHEN e.value.status = 'AVAILABLE' AND (e.value.value IS NULL OR isnan(e.value.value)) THEN 'value' WHEN e.value.status = 'AVAILABLE' AND (e.value.value < 0 OR (e.value.value > 1 AND e.key <> 'teacher_primitive_disagreements')) THEN 'range' END AS error, count(*) AS n
    FROM d GROUP BY ALL HAVING error IS NOT NULL"""
)
def q_diagnostic_errors(spark, folder):
    """Diagnostics that break their record's rules."""
    e = evaluation.diagnostic_errors(table(spark, folder, "case_snapshots"), F.col("diagnostics"), ["teacher_primitive_disagreements"])
    return e.groupBy("name", "error").agg(F.count("*").alias("n"))


@query(
    """SELECT p_brand, count(*) AS cases, count(*) FILTER (p_size >= 5) AS passed, min(p_retailprice) AS min_p_retailprice, max(p_size)::DOUBLE AS max_p_size,
    coalesce(string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey) FILTER (NOT p_size >= 5), '') AS failing, count(*) = count(*) FILTER (p_size >= 5) AS all_passed FROM part GROUP BY p_brand"""
)
def q_corpus_summary(spark, folder):
    """Least scores, greatest penalties and failing cases per corpus."""
    s = evaluation.corpus_summary(table(spark, folder, "part"), ["p_brand"], "p_partkey", F.col("p_size") >= 5, ["p_retailprice"], ["p_size"])
    return s.withColumns({"failing": joined(F.col("failing")), "max_p_size": F.col("max_p_size").cast("double")})


@query(
    """WITH y AS (SELECT o_custkey, sum(o_totalprice) FILTER (extract(month FROM o_orderdate) <= 6) AS b, sum(o_totalprice) FILTER (extract(month FROM o_orderdate) > 6) AS a FROM orders GROUP BY ALL),
    j AS (SELECT c_nationkey, b - a AS g, a > 2 * b AS w, a < 1e6 AS ok FROM y JOIN customer ON c_custkey = o_custkey WHERE a IS NOT NULL AND b IS NOT NULL),
    s AS (SELECT c_nationkey, count(*) AS cases, count(*) FILTER (ok AND NOT w AND g > 0) AS accepted, count(*) FILTER (g > 0) AS improved, count(*) FILTER (g < 0 OR w) AS regressed, count(*) FILTER (NOT ok OR w) AS guard_failures, round(avg(g), 4) AS mean_gain FROM j GROUP BY ALL)
    SELECT *, CASE WHEN guard_failures = 0 AND regressed = 0 AND accepted = cases AND mean_gain > 0 THEN 'ADOPT' ELSE 'HOLD' END AS decision FROM s"""
)
def q_ab_decision(spark, folder):
    """Before and after per case, conditional counts, decision."""
    early = F.month("o_orderdate") <= 6
    y = table(spark, folder, "orders").groupBy("o_custkey").agg(F.sum(F.when(early, F.col("o_totalprice"))).alias("b"), F.sum(F.when(~early, F.col("o_totalprice"))).alias("a")).filter("a is not null and b is not null")
    j = y.join(table(spark, folder, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    out = evaluation.ab_summary(j, ["c_nationkey"], F.col("b"), F.col("a"), F.col("a") > F.col("b") * 2, F.col("a") < 1e6)
    return out.withColumn("mean_gain", F.round("mean_gain", 4))


@query(
    """WITH c AS (SELECT event_type, user_id % 10 AS g, count(*) AS n FROM events WHERE value <= 50 GROUP BY ALL),
    r AS (SELECT event_type, string_agg(g::VARCHAR || '=' || n::VARCHAR, ',' ORDER BY g) AS reasons FROM c GROUP BY event_type)
    SELECT event_type, count(DISTINCT user_id) AS runs, count(*) AS candidates, count(*) FILTER (value > 50) AS adopted, min(value) AS least, round(avg(CASE WHEN value > 10 THEN value - 10 END), 6) AS mean_delta,
    round(count(*) FILTER (value > 50) / count(*), 6) AS rate, any_value(reasons) AS reasons FROM events LEFT JOIN r USING (event_type) GROUP BY event_type"""
)
def q_observation_summary(spark, folder):
    """Distinct runs, adoption rate, reasons and null-skipping mean."""
    e = table(spark, folder, "events").withColumn("g", F.pmod("user_id", F.lit(10)))
    s = evaluation.observation_summary(e, ["event_type"], "user_id", F.col("value") > 50, "g", "value", F.when(F.col("value") > 10, F.col("value") - 10))
    why = F.array_join(F.transform("reasons", lambda x: F.concat_ws("=", x["reason"].cast("string"), x["n"].cast("string"))), ",")
    return s.withColumns({"mean_delta": r6(F.col("mean_delta")), "rate": r6(F.col("rate")), "reasons": why})


@query(
    """SELECT o_orderkey, concat_ws(',', CASE WHEN o_totalprice > 300000 THEN 'size' END, CASE WHEN o_orderstatus = 'F' THEN 'alpha' END, CASE WHEN o_orderpriority LIKE '5%' THEN 'anchor' END) AS blocked_by FROM orders"""
)
def q_reason_array(spark, folder):
    """Names of the violated predicates of every row."""
    why = text.reasons(size=F.col("o_totalprice") > 300000, alpha=F.col("o_orderstatus") == "F", anchor=F.col("o_orderpriority").startswith("5"))
    return table(spark, folder, "orders").select("o_orderkey", F.array_join(why, ",").alias("blocked_by"))


@query(
    """WITH y AS (SELECT l_returnflag, extract(year FROM l_shipdate) % 2 AS odd, avg(l_quantity) AS quantity, avg(l_discount) AS discount, max(l_tax) - max(l_tax) AS zero FROM lineitem GROUP BY ALL),
    u AS (UNPIVOT y ON quantity, discount, zero INTO NAME metric VALUE value)
    SELECT o.l_returnflag, o.metric, round(o.value, 6) AS old_value, round(n.value, 6) AS new_value, round(n.value - o.value, 6) AS delta, CASE WHEN abs(o.value) > 1e-12 THEN round((n.value - o.value) / abs(o.value), 6) END AS relative
    FROM u o JOIN u n ON o.l_returnflag = n.l_returnflag AND o.metric = n.metric AND o.odd = 0 AND n.odd = 1"""
)
def q_gap_compare(spark, folder):
    """Two reports joined by metric: delta and relative delta."""
    y = table(spark, folder, "lineitem").groupBy("l_returnflag", (F.year("l_shipdate") % 2).alias("odd")).agg(F.avg("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"), (F.max("l_tax") - F.max("l_tax")).alias("zero"))
    u = evaluation.unpivot(y, ["l_returnflag", "odd"], ["quantity", "discount", "zero"])
    out = evaluation.compare_metrics(u.filter("odd = 0").drop("odd"), u.filter("odd = 1").drop("odd"), ["l_returnflag"])
    return out.withColumns({c: r6(F.col(c)) for c in ("old_value", "new_value", "delta", "relative")})


@query(
    """SELECT o_custkey, coalesce(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) FILTER (o_totalprice > 250000), '') AS failures, CASE WHEN count(*) FILTER (o_totalprice > 250000) = 0 THEN 'PASS' ELSE 'FAIL' END AS gate FROM orders GROUP BY o_custkey"""
)
def q_bool_gate(spark, folder):
    """A gate per case from its failures alone."""
    o = table(spark, folder, "orders").withColumn("failure", F.when(F.col("o_totalprice") > 250000, F.col("o_orderkey")))
    return evaluation.case_gate(o, "o_custkey", "failure").withColumn("failures", joined(F.col("failures")))


@query(
    """WITH a AS (SELECT p_brand, avg(p_retailprice) FILTER (p_size <= 25) AS b, avg(p_retailprice) FILTER (p_size > 25) AS c FROM part GROUP BY p_brand)
    SELECT p_brand, CASE WHEN b IS NULL OR c IS NULL THEN 'UNAVAILABLE' WHEN c - b > 10 THEN 'IMPROVED' WHEN c - b < -10 THEN 'REGRESSED' ELSE 'STABLE' END AS trend FROM a"""
)
def q_trend(spark, folder):
    """Trend within a tolerance."""
    small = F.col("p_size") <= 25
    a = table(spark, folder, "part").groupBy("p_brand").agg(F.avg(F.when(small, F.col("p_retailprice"))).alias("b"), F.avg(F.when(~small, F.col("p_retailprice"))).alias("c"))
    return a.select("p_brand", evaluation.trend(F.col("b"), F.col("c"), 10.0).alias("trend"))


@query(
    """WITH a AS (SELECT trim(adoption_transaction_id) AS id, max_by(baseline_artifact_sha256, received_at) AS sha FROM adoptions GROUP BY ALL),
    e AS (SELECT eval_id, max_by(evaluation_transaction_id, received_at) AS t, max_by(candidate_sha256, received_at) AS c, max_by(adopted_baseline.binding.baseline_artifact_sha256, received_at) AS b, max_by(trim(adopted_baseline.binding.adoption_transaction_id), received_at) AS id FROM evaluations WHERE adopted_baseline.binding IS NOT NULL GROUP BY eval_id)
    SELECT eval_id AS evaluation_id, coalesce(t = e.id, false) AS same_transaction, c = b AS equal_bytes, coalesce(b = a.sha AND t IS DISTINCT FROM e.id, false) AS bound FROM e LEFT JOIN a ON a.id = e.id"""
)
def q_baseline_binding(spark, folder):
    """Evaluations joined to their adoption with the binding's links."""
    a = table(spark, folder, "adoptions").groupBy(F.trim("adoption_transaction_id").alias("adoption_id")).agg(F.max_by("baseline_artifact_sha256", "received_at").alias("baseline_sha256")).withColumn("source_sha256", F.lit(""))
    b = F.col("adopted_baseline.binding")
    last = lambda c: F.max_by(c, F.col("received_at"))
    e = table(spark, folder, "evaluations").filter(b.isNotNull()).groupBy(F.col("eval_id").alias("evaluation_id")).agg(
        last(F.col("evaluation_transaction_id")).alias("transaction_id"), last(F.col("candidate_sha256")).alias("candidate_sha256"), last(b["baseline_artifact_sha256"]).alias("baseline_sha256"), last(F.trim(b["adoption_transaction_id"])).alias("adoption_id")
    )
    return evaluation.baseline_binding(e.withColumn("source_sha256", F.lit("")), a).drop("adoption_id")


# ---- text, sets, graphs


@query("SELECT event_id, 'evt_' || substr(sha256(event_id::VARCHAR || chr(31) || event_type), 1, 32) AS id FROM events")
def q_stable_id(spark, folder):
    """Stable ids from joined parts."""
    return table(spark, folder, "events").select("event_id", text.stable_id("evt_", F.col("event_id"), F.col("event_type")).alias("id"))


@query("SELECT eval_id, received_at, coalesce(regexp_full_match(candidate_sha256, '[0-9a-f]{64}'), false) AS valid FROM evaluations")
def q_sha_regex(spark, folder):
    """Validity of digests."""
    return table(spark, folder, "evaluations").select("eval_id", "received_at", text.is_sha256(F.col("candidate_sha256")).alias("valid"))


@query("""SELECT n_nationkey, '{"name":"' || n_name || '","region":' || n_regionkey::VARCHAR || '}' AS json FROM nation""")
def q_canonical_json(spark, folder):
    """JSON with sorted keys."""
    return table(spark, folder, "nation").select("n_nationkey", text.canonical_json(region=F.col("n_regionkey"), name=F.col("n_name")).alias("json"))


@query("SELECT event_type, count(k) AS n, sum(k)::BIGINT AS total FROM (SELECT event_type, (props::JSON->>'k')::INT AS k FROM events) GROUP BY event_type")
def q_props_json(spark, folder):
    """A field out of JSON text."""
    k = F.from_json("props", "k int")["k"]
    return table(spark, folder, "events").groupBy("event_type").agg(F.count(k).alias("n"), F.sum(k).cast("bigint").alias("total"))


@query(
    """WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS a, o_custkey // 3 * 2 AS b FROM orders WHERE o_totalprice > 300000), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    c(v, m) AS (SELECT a, a FROM u UNION SELECT u.b, c.m FROM c JOIN u ON u.a = c.v WHERE u.b > c.m)
    SELECT v, least(v, min(m)) AS component FROM (SELECT a AS v, a AS m FROM u UNION ALL SELECT v, m FROM c) GROUP BY v"""
)
def q_components(spark, folder):
    """Connected components by least member."""
    return _components(table(spark, folder, "orders").filter("o_totalprice > 300000"))


@query(None)
def q_components_all(spark, folder):
    """Connected components of the edges of all orders (tested against brute force)."""
    return _components(table(spark, folder, "orders"))


def _components(orders: DataFrame) -> DataFrame:
    e = orders.select(F.col("o_custkey").alias("a"), (F.floor(F.col("o_custkey") / 3) * 2).alias("b")).distinct()
    return graph.connected_components(e, e.select(F.explode(F.array("a", "b")).alias("v")))


@query(
    """WITH RECURSIVE v AS (SELECT DISTINCT n_nationkey AS v FROM nation), e AS (SELECT a.v AS a, b.v AS b FROM v a JOIN v b ON b.v = a.v * 2 + 1 OR b.v = a.v * 3 + 2),
    p(v, l) AS (SELECT v, 0 FROM v UNION ALL SELECT e.b, p.l + 1 FROM p JOIN e ON e.a = p.v) SELECT v, max(l) AS level FROM p GROUP BY v"""
)
def q_topo_level(spark, folder):
    """Levels of a directed graph."""
    v = table(spark, folder, "nation").select(F.col("n_nationkey").alias("v"))
    e = v.select(F.col("v").alias("a"), F.explode(F.array(F.col("v") * 2 + 1, F.col("v") * 3 + 2)).alias("b")).join(v.withColumnRenamed("v", "b"), "b", "left_semi")
    return graph.levels(e, v)


@query(
    """WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 200000)
    SELECT 'both' AS part, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'either', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)
    UNION ALL SELECT 'first', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'second', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)"""
)
def q_set_ops(spark, folder):
    """Union, intersection and differences of key sets, from one tagged aggregation."""
    o = table(spark, folder, "orders")
    s = o.groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "F").alias("a"), F.bool_or(F.col("o_totalprice") > 200000).alias("b"))
    c = s.agg(F.count_if(F.col("a") & F.col("b")).alias("both"), F.count_if(F.col("a") | F.col("b")).alias("either"), F.count_if(F.col("a") & ~F.col("b")).alias("first"), F.count_if(~F.col("a") & F.col("b")).alias("second"))
    return c.unpivot([], ["both", "either", "first", "second"], "part", "n")


@query("SELECT user_id, string_agg(event_type, ',' ORDER BY first, event_id) AS types FROM (SELECT user_id, event_type, min(ts) AS first, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL) GROUP BY user_id")
def q_dedupe_first(spark, folder):
    """Distinct values in order of their first occurrence."""
    f = table(spark, folder, "events").groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("first"))
    order = F.array_sort(F.collect_list(F.struct("first", "event_type")))
    return f.groupBy("user_id").agg(F.array_join(F.transform(order, lambda x: x["event_type"]), ",").alias("types"))


@query(
    """WITH c AS (SELECT p_type, count(*) AS n FROM part GROUP BY p_type), s AS (SELECT *, row_number() OVER (ORDER BY n DESC, p_type) AS rank FROM c)
    SELECT p_type, n, round(n / (SELECT count(*) FROM part), 6) AS share, rank FROM s WHERE rank <= 5"""
)
def q_share_hist(spark, folder):
    """Most frequent categories with their shares."""
    p = table(spark, folder, "part")
    total = p.agg(F.count("*").alias("t")).select("t").scalar()
    c = p.groupBy("p_type").agg(F.count("*").alias("n")).withColumn("one", F.lit(1))
    top = ranking.top_per_group(c, ["one"], [F.desc("n")], 5, ["p_type"])
    return top.select("p_type", "n", r6(F.col("n") / total).alias("share"), F.col("rank").cast("bigint").alias("rank"))


@query(
    """SELECT l_suppkey, count(*) AS shapes, count(DISTINCT l_linenumber) AS colors, round(avg((l_quantity < 5)::INT), 6) AS tiny_share,
    round(least(1, greatest(0, 1.05 - count(*) / 900.0 * 0.45 - avg((l_quantity < 5)::INT) * 0.35)), 6) AS minimality FROM lineitem GROUP BY l_suppkey"""
)
def q_scene_quality(spark, folder):
    """Counts, tiny share and a clipped score per scene."""
    from shapelake.operators.regions import scene_quality

    s = table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("image_id"), F.lit("polygon").alias("kind"), (F.col("l_quantity") * 0.0012 / 5.0).alias("area"), F.lit(1.0).alias("canvas_area"), F.lit(4).alias("vertices"), F.col("l_linenumber").alias("fill"))
    out = scene_quality(s.withColumn("area", F.when(F.round(F.col("area"), 9) >= 0.0012, 0.0012).otherwise(0.0)), 900)
    return out.select(F.col("image_id").alias("l_suppkey"), "shapes", "colors", r6(F.col("tiny_share")).alias("tiny_share"), r6(F.col("minimality")).alias("minimality"))


# ---- scalar expressions over whole tables


@query(
    """SELECT p_partkey, '#' || lower(lpad(hex(p_size * 5 % 256), 2, '0') || lpad(hex(p_partkey % 256), 2, '0') || lpad(hex(p_partkey * 7 % 256), 2, '0')) AS hex, least(255, (p_partkey % 256) // 32 * 32 + 16)::INT AS cell FROM part"""
)
def q_hex_quantize(spark, folder):
    """Hex colors and quantized channels."""
    k, s = F.col("p_partkey"), F.col("p_size")
    return table(spark, folder, "part").select("p_partkey", color.hex_color(s * 5 % 256, k % 256, k * 7 % 256).alias("hex"), color.quantize(k % 256).alias("cell"))


@query(
    """WITH c AS (SELECT p_partkey, (p_partkey % 256) / 255.0 AS r, (p_partkey * 7 % 256) / 255.0 AS g, (p_partkey * 31 % 256) / 255.0 AS b FROM part),
    l AS (SELECT p_partkey, CASE WHEN r <= 0.04045 THEN r / 12.92 ELSE pow((r + 0.055) / 1.055, 2.4) END AS r, CASE WHEN g <= 0.04045 THEN g / 12.92 ELSE pow((g + 0.055) / 1.055, 2.4) END AS g, CASE WHEN b <= 0.04045 THEN b / 12.92 ELSE pow((b + 0.055) / 1.055, 2.4) END AS b FROM c),
    x AS (SELECT p_partkey, (0.4124564 * r + 0.3575761 * g + 0.1804375 * b) / 0.95047 AS x, 0.2126729 * r + 0.7151522 * g + 0.0721750 * b AS y, (0.0193339 * r + 0.1191920 * g + 0.9503041 * b) / 1.08883 AS z FROM l),
    f AS (SELECT p_partkey, CASE WHEN x > 216.0 / 24389 THEN cbrt(x) ELSE (24389.0 / 27 * x + 16) / 116 END AS x, CASE WHEN y > 216.0 / 24389 THEN cbrt(y) ELSE (24389.0 / 27 * y + 16) / 116 END AS y, CASE WHEN z > 216.0 / 24389 THEN cbrt(z) ELSE (24389.0 / 27 * z + 16) / 116 END AS z FROM x)
    SELECT p_partkey, round(116 * y - 16, 4) + 0.0 AS l, round(500 * (x - y), 4) + 0.0 AS a, round(200 * (y - z), 4) + 0.0 AS b FROM f"""
)
def q_lab(spark, folder):
    """Lab of colors."""
    k = F.col("p_partkey")
    v = color.lab(k % 256, k * 7 % 256, k * 31 % 256)
    return table(spark, folder, "part").select("p_partkey", v.alias("v")).select("p_partkey", *[(F.round(f"v.{c}", 4) + F.lit(0.0)).alias(c) for c in "lab"])


@query(
    """WITH b AS (SELECT o_orderkey, o_totalprice / 1000 AS x, extract(day FROM o_orderdate)::DOUBLE AS y FROM orders),
    c AS (SELECT o_orderkey, greatest(0, x - 50) AS x0, greatest(0, y - 10) AS y0, least(100, x) AS x1, least(20, y) AS y1 FROM b)
    SELECT o_orderkey, round(x1 - x0, 6) AS w, round(y1 - y0, 6) AS h FROM c WHERE x1 > x0 AND y1 > y0"""
)
def q_clip_boxes(spark, folder):
    """Boxes clipped to a canvas, empty ones dropped."""
    box = F.array(F.col("o_totalprice") / 1000 - 50, F.dayofmonth("o_orderdate").cast("double") - 10, F.lit(50.0), F.lit(10.0))
    o = table(spark, folder, "orders").select("o_orderkey", geometry.clip_box(box, F.lit(100), F.lit(20)).alias("b")).filter("b is not null")
    return o.select("o_orderkey", r6(F.col("b")[2]).alias("w"), r6(F.col("b")[3]).alias("h"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round_even(l_extendedprice * 0.25 + l_quantity * 0.75, 0)::INT AS blended FROM lineitem")
def q_blend_half_even(spark, folder):
    """Blends rounded half to even."""
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", color.blend(F.col("l_extendedprice"), F.col("l_quantity"), F.lit(0.75)).alias("blended"))
