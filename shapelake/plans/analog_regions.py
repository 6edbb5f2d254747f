"""Region and quality operators applied to region tables that are made of whole test tables, each with its SQL.

The regions are parts: a brand is an image, a part a region whose box, color and color group follow from its key and
size. These queries show the operators' semantics and are no evidence about images.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shapelake.functions import color
from shapelake.operators import abstraction, quality, regions
from shapelake.plans.analog import r6
from shapelake.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}

WIDTH, HEIGHT = 100, 80
# Fixed value: how far apart the keys of touching regions are at most.
REACH = 60


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _regions(spark: SparkSession, folder: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    d = table(spark, folder, "part").select(
        F.col("p_brand").alias("image_id"),
        k.alias("region_id"),
        (k * 7 % 90).alias("x"),
        (k * 13 % 70).alias("y"),
        (F.lit(1) + s * k % 83 % 60).alias("w"),
        (F.lit(1) + k % 10).alias("h"),
        (k % 256).alias("r"),
        (k * 7 % 256).alias("g"),
        (k * 31 % 256).alias("b"),
        (k % 6).alias("palette_id"),
        (s % 5 == 0).alias("is_accent"),
    )
    d = d.withColumns({"w": F.least("w", WIDTH - F.col("x")), "h": F.least("h", HEIGHT - F.col("y"))})
    area = F.greatest(F.lit(1), F.floor(F.col("w") * F.col("h") * (F.col("region_id") % 3 + 1) / 3.0))
    d = d.withColumns({"area": area, "touches_edge": (F.col("x") == 0) | (F.col("y") == 0), "cx": F.col("x") + F.col("w") / 2.0, "cy": F.col("y") + F.col("h") / 2.0})
    return d.withColumns({"area_ratio": F.col("area") / float(WIDTH * HEIGHT), "solidity": F.col("area") / (F.col("w") * F.col("h")), "structure_score": (F.col("region_id") % 11) / 10.0})


def _images(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(F.col("p_brand").alias("image_id")).distinct().select("image_id", F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"))


_REG = """reg0 AS (SELECT p_brand AS image_id, p_partkey AS region_id, p_partkey * 7 % 90 AS x, p_partkey * 13 % 70 AS y, 1 + p_size * p_partkey % 83 % 60 AS w, 1 + p_partkey % 10 AS h,
    p_partkey % 256 AS r, p_partkey * 7 % 256 AS g, p_partkey * 31 % 256 AS b, p_partkey % 6 AS palette_id, p_size % 5 = 0 AS is_accent FROM part),
  reg1 AS (SELECT * REPLACE (least(w, 100 - x) AS w, least(h, 80 - y) AS h) FROM reg0),
  reg2 AS (SELECT *, greatest(1, floor(w * h * (region_id % 3 + 1) / 3.0))::BIGINT AS area, x = 0 OR y = 0 AS touches_edge, x + w / 2.0 AS cx, y + h / 2.0 AS cy FROM reg1),
  reg AS (SELECT *, area / 8000.0 AS area_ratio, area / (w * h)::DOUBLE AS solidity, (region_id % 11) / 10.0 AS structure_score,
    CASE WHEN greatest(r, g, b) = 0 THEN 0 ELSE (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b)::DOUBLE END AS sat, (r * 0.299 + g * 0.587 + b * 0.114) / 255.0 AS lum FROM reg2)"""
_ROLE = """rol AS (SELECT *, CASE WHEN h / w::DOUBLE >= 2.0 AND area_ratio <= 0.008 AND cy / 80 < 0.92 THEN 'vertical'
    WHEN cy / 80 BETWEEN 0.44 AND 0.78 AND w / h::DOUBLE BETWEEN 1.4 AND 8.0 AND w / 100.0 BETWEEN 0.012 AND 0.28 AND h / 80.0 <= 0.18 AND area_ratio BETWEEN 0.0007 AND 0.020 AND NOT touches_edge THEN 'boat'
    WHEN cy / 80 > 0.58 AND w / h::DOUBLE >= 1.6 AND h / 80.0 <= 0.22 THEN 'water' WHEN cy / 80 < 0.80 AND area_ratio >= 0.0010 AND h / 80.0 >= 0.055 THEN 'structure'
    WHEN cy / 80 > 0.56 AND area_ratio <= 0.007 AND h / w::DOUBLE >= 1.15 AND NOT touches_edge THEN 'reflection'
    WHEN is_accent AND area_ratio <= 0.0035 AND greatest(w / 100.0, h / 80.0) <= 0.16 AND sat >= 0.35 THEN 'accent'
    WHEN cy / 80 > 0.60 AND area_ratio <= 0.0035 AND lum < 0.34 AND sat < 0.85 THEN 'reflection' ELSE 'misc' END AS role FROM reg)"""
_SEM = """sem AS (SELECT *, CASE WHEN role = 'accent' OR (is_accent AND area_ratio < 0.004) THEN 'accent' WHEN role = 'boat' THEN 'boat' WHEN role = 'water' THEN 'water' WHEN role = 'vertical' THEN 'elongated'
    WHEN role = 'reflection' THEN 'reflection' WHEN role = 'structure' AND least(1.0, area / (w * h)::DOUBLE) >= 0.72 AND w / h::DOUBLE >= 0.70 THEN 'building'
    WHEN role = 'structure' AND w / h::DOUBLE >= 1.7 AND h / 80.0 < 0.14 AND cy / 80 > 0.32 AND cy / 80 < 0.72 THEN 'bridge' WHEN role = 'structure' AND solidity < 0.70 AND cy / 80 < 0.58 THEN 'tree'
    WHEN role = 'structure' AND w / h::DOUBLE >= 1.25 AND h / 80.0 < 0.18 THEN 'roof' WHEN role = 'structure' THEN 'structure' WHEN h / w::DOUBLE >= 2.5 AND area_ratio < 0.015 THEN 'elongated'
    WHEN solidity < 0.62 AND area_ratio >= 0.003 THEN 'organic' ELSE 'generic' END AS semantic_type FROM rol)"""
_LAY = """lay AS (SELECT *, CASE WHEN semantic_type LIKE 'subject%' THEN 'midground' WHEN role IN ('accent', 'vertical') THEN 'accents' WHEN role IN ('water', 'reflection') THEN 'water' WHEN role = 'boat' THEN 'foreground'
    WHEN role = 'structure' THEN CASE WHEN cy / 80 < 0.57 THEN 'skyline' ELSE 'midground' END WHEN cy / 80 < 0.48 THEN 'skyline' WHEN cy / 80 > 0.68 THEN 'foreground' ELSE 'midground' END AS layer FROM sem)"""


def _named(spark: SparkSession, folder: str) -> DataFrame:
    i = _images(spark, folder)
    return regions.assign_layers(regions.assign_semantics(regions.assign_roles(_regions(spark, folder), i), i), i)


@query(f"WITH {_REG}, {_ROLE}, {_SEM}, {_LAY} SELECT region_id, role, semantic_type, layer FROM lay")
def q_region_roles(spark, folder):
    """Role, semantic type and layer of every region."""
    return _named(spark, folder).select("region_id", "role", "semantic_type", "layer")


@query(f"WITH {_REG} SELECT image_id, region_id AS background_id FROM reg QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY touches_edge DESC, area DESC, region_id) = 1")
def q_background_region(spark, folder):
    """Background region of every image."""
    return regions.background_region(_regions(spark, folder))


@query(
    f"""WITH {_REG}, {_ROLE}, {_SEM}, {_LAY} SELECT image_id, region_id, row_number() OVER (PARTITION BY image_id ORDER BY
    CASE layer WHEN 'skyline' THEN 20 WHEN 'midground' THEN 30 WHEN 'water' THEN 40 WHEN 'foreground' THEN 40 ELSE 50 END, area_ratio DESC, structure_score DESC, region_id) - 1 AS z FROM lay"""
)
def q_region_order(spark, folder):
    """Draw order of every region."""
    return regions.draw_order(_named(spark, folder).withColumn("importance", F.col("structure_score"))).select("image_id", "region_id", F.col("z").cast("bigint").alias("z"))


@query(
    f"""WITH {_REG}, {_ROLE}, m AS (SELECT image_id, median(y) FILTER (role IN ('water', 'boat') AND y BETWEEN 30.4 AND 62.4) AS wy, median(y + h) FILTER (role = 'structure' AND y + h BETWEEN 32 AND 62.4) AS gy FROM rol GROUP BY image_id)
    SELECT image_id, round(CASE WHEN coalesce(wy, gy) IS NULL THEN 46.4 ELSE least(greatest(coalesce(wy, gy), 38.4), 56) END, 6) AS horizon_y FROM m"""
)
def q_horizon(spark, folder):
    """Height of every image's horizon."""
    i = _images(spark, folder)
    return abstraction.horizon(regions.assign_roles(_regions(spark, folder), i), i).select("image_id", r6(F.col("horizon_y")).alias("horizon_y"))


def _lab_sql(r: str, g: str, b: str, source: str, keep: str) -> str:
    """SQL: ``keep`` and Lab of colors as l, a, bb."""
    lin = lambda c: f"CASE WHEN {c} / 255.0 <= 0.04045 THEN {c} / 255.0 / 12.92 ELSE pow(({c} / 255.0 + 0.055) / 1.055, 2.4) END"
    f = lambda c: f"CASE WHEN {c} > 216.0 / 24389 THEN cbrt({c}) ELSE (24389.0 / 27 * {c} + 16) / 116 END"
    return f"""(SELECT {keep}, 116 * fy - 16 AS l, 500 * (fx - fy) AS a, 200 * (fy - fz) AS bb FROM (SELECT *, {f('x_')} AS fx, {f('y_')} AS fy, {f('z_')} AS fz FROM (
      SELECT *, (0.4124564 * lr + 0.3575761 * lg + 0.1804375 * lb) / 0.95047 AS x_, 0.2126729 * lr + 0.7151522 * lg + 0.0721750 * lb AS y_, (0.0193339 * lr + 0.1191920 * lg + 0.9503041 * lb) / 1.08883 AS z_ FROM (
      SELECT *, {lin(r)} AS lr, {lin(g)} AS lg, {lin(b)} AS lb FROM {source}))))"""


def _de2000_sql(source: str, out: str = "de") -> str:
    """SQL: all columns of ``source``, which has l1, a1, b1, l2, a2, b2, with their CIEDE2000 difference."""
    hue = lambda a, b: f"CASE WHEN {a} = 0 AND {b} = 0 THEN 0 ELSE (degrees(atan2({b}, {a})) + 360) % 360 END"
    return f"""(SELECT * EXCLUDE (c7, g_, p1, p2, h1, h2, k1, k2, tn, sm, dh, mh, ml, mc, t_, rt, dx, dy, dz), sqrt(dx * dx + dy * dy + dz * dz + rt * dy * dz) AS {out} FROM (
      SELECT *, (l2 - l1) / (0.015 * pow(ml - 50, 2) / sqrt(20 + pow(ml - 50, 2)) + 1) AS dx, (k2 - k1) / (0.045 * mc + 1) AS dy, dh / (0.015 * mc * t_ + 1) AS dz,
        -sin(radians(60 * exp(-pow((mh - 275) / 25, 2)))) * 2 * sqrt(pow(mc, 7) / (pow(mc, 7) + pow(25.0, 7))) AS rt FROM (
      SELECT *, 1 - 0.17 * cos(radians(mh - 30)) + 0.24 * cos(radians(2 * mh)) + 0.32 * cos(radians(3 * mh + 6)) - 0.20 * cos(radians(4 * mh - 63)) AS t_ FROM (
      SELECT *, 2 * sqrt(k1 * k2) * sin(radians(CASE WHEN k1 * k2 = 0 THEN 0 WHEN tn > 180 THEN tn - 360 WHEN tn < -180 THEN tn + 360 ELSE tn END / 2)) AS dh,
        CASE WHEN k1 * k2 = 0 THEN sm WHEN abs(tn) <= 180 THEN sm / 2 WHEN sm < 360 THEN (sm + 360) / 2 ELSE (sm - 360) / 2 END AS mh, (l1 + l2) / 2 AS ml, (k1 + k2) / 2 AS mc FROM (
      SELECT *, h2 - h1 AS tn, h1 + h2 AS sm FROM (
      SELECT *, {hue('p1', 'b1')} AS h1, {hue('p2', 'b2')} AS h2, sqrt(p1 * p1 + b1 * b1) AS k1, sqrt(p2 * p2 + b2 * b2) AS k2 FROM (
      SELECT *, a1 * g_ AS p1, a2 * g_ AS p2 FROM (
      SELECT *, 1 + 0.5 * (1 - sqrt(c7 / (c7 + pow(25.0, 7)))) AS g_ FROM (
      SELECT *, pow((sqrt(a1 * a1 + b1 * b1) + sqrt(a2 * a2 + b2 * b2)) / 2, 7) AS c7 FROM {source})))))))))"""


@query(
    f"""WITH {_REG}, pal AS (SELECT image_id, palette_id, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY image_id) AS ratio FROM reg GROUP BY image_id, palette_id),
    pc AS (SELECT *, palette_id * 40 % 256 AS r, palette_id * 90 % 256 AS g, palette_id * 160 % 256 AS b FROM pal), pl AS {_lab_sql('r', 'g', 'b', 'pc', 'image_id, palette_id, ratio, r, g, b')},
    dom AS (SELECT image_id, l AS dl, a AS da, bb AS db FROM pl QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY ratio DESC, palette_id) = 1),
    rl AS {_lab_sql('r', 'g', 'b', 'reg', 'image_id, region_id, palette_id, area, area_ratio, is_accent, structure_score')},
    j AS (SELECT rl.*, pl.ratio, CASE WHEN greatest(pl.r, pl.g, pl.b) = 0 THEN 0 ELSE (greatest(pl.r, pl.g, pl.b) - least(pl.r, pl.g, pl.b)) / greatest(pl.r, pl.g, pl.b)::DOUBLE END AS ps, dl, da, db,
      max(area_ratio) OVER (PARTITION BY rl.image_id) AS top, median(area) OVER (PARTITION BY rl.image_id, rl.palette_id) AS med FROM rl JOIN pl USING (image_id, palette_id) JOIN dom ON dom.image_id = rl.image_id),
    s AS (SELECT *, 0.40 * least(1, area_ratio / greatest(top, 0.0008)) + 0.25 * least(1, sqrt(pow(l - dl, 2) + pow(a - da, 2) + pow(bb - db, 2)) / 90) + 0.20 * least(1, greatest(0, (0.25 - ratio) / 0.25)) + 0.15 * structure_score AS imp,
      area BETWEEN med * 0.25 AND med * 4 AND ps >= 0.45 AND ratio <= 0.20 AS near FROM j),
    t AS (SELECT *, near AND sum(near::INT) OVER (PARTITION BY image_id, palette_id) >= 3 AS saved FROM s)
    SELECT region_id, is_accent OR saved AS is_accent, round(CASE WHEN saved THEN greatest(imp, 0.55) ELSE imp END, 6) AS importance FROM t"""
)
def q_region_importance(spark, folder):
    """Importance of every region, with rescue of repeated accents."""
    r = _regions(spark, folder)
    p = r.groupBy("image_id", "palette_id").agg(F.count("*").alias("n"))
    total = r.groupBy("image_id").agg(F.count("*").alias("t"))
    k = F.col("palette_id")
    p = p.join(total, "image_id").select("image_id", "palette_id", (F.col("n") / F.col("t")).alias("ratio"), (k * 40 % 256).alias("r"), (k * 90 % 256).alias("g"), (k * 160 % 256).alias("b"))
    out = regions.score_importance(r, p, {"area": 0.40, "contrast": 0.25, "rarity": 0.20, "structure": 0.15}, 0.0008)
    return out.select("region_id", "is_accent", r6(F.col("importance")).alias("importance"))


def _touching(r: DataFrame) -> DataFrame:
    """Regions of an image in neighbouring keys (a chain) touch. They meet by image and stretch of ``REACH`` keys, so the
    work grows with the pairs found and not with the square of an image's regions: ``b`` is in the stretch of ``a`` or
    in the next one."""
    stretch = F.col("region_id") - F.pmod("region_id", F.lit(REACH))  # its first key, exact for any bigint
    a = r.select("image_id", F.col("region_id").alias("a"), stretch.alias("_at"))
    b = r.select("image_id", F.col("region_id").alias("b"), F.explode(F.array(stretch - REACH, stretch)).alias("_at"))
    return a.join(b, ["image_id", "_at"]).filter((F.col("b") - F.col("a")).between(1, REACH)).drop("_at")


@query(
    f"""WITH {_REG}, bg AS (SELECT image_id, region_id AS bid FROM reg QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY touches_edge DESC, area DESC, region_id) = 1),
    j AS (SELECT reg.*, bid, region_id = bid AS prim, w / 100.0 >= 0.5 AND h / 80.0 >= 0.84 AS never, abs(region_id - bid) BETWEEN 1 AND 60 AS beside FROM reg JOIN bg USING (image_id)),
    s AS (SELECT *, CASE WHEN NOT prim AND area_ratio >= 0.012 AND w / 100.0 >= 0.3 AND y / 80.0 <= 0.58 AND cy / 80 <= 0.62 AND sat <= 0.84 AND (beside OR y <= 16) THEN area_ratio + 0.15 * (w / 100.0) - 0.10 * sat END AS score FROM j),
    b AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC NULLS LAST, region_id) AS k FROM s)
    SELECT image_id, region_id, CASE WHEN prim THEN 'primary' WHEN w / 100.0 >= 0.84 AND h / 80.0 >= 0.84 AND area_ratio <= 0.10 AND area / (w * h)::DOUBLE < 0.22 THEN 'ring' ELSE 'sky' END AS why
    FROM b WHERE prim OR (w / 100.0 >= 0.84 AND h / 80.0 >= 0.84 AND area_ratio <= 0.10 AND area / (w * h)::DOUBLE < 0.22) OR (score IS NOT NULL AND k = 1)"""
)
def q_backdrop(spark, folder):
    """Backdrop regions, with wider limits than for pictures, as these regions are small."""
    r = _regions(spark, folder)
    r = r.join(regions.background_region(r), "image_id").withColumn("outer_area", F.col("w") * F.col("h"))
    wide = {**abstraction.SKY, "area": 0.012, "width": 0.3, "top": 0.58, "center": 0.62, "saturation": 0.84}
    return abstraction.backdrop(r, _images(spark, folder), _touching(r), sky=wide)


@query()
def q_merge_similar(spark, folder):
    """Regions merged with similar ones they touch."""
    r = _regions(spark, folder)
    pairs = abstraction.similar_pairs(r, _touching(r), 30.0)
    return abstraction.merged_regions(r, abstraction.merge_similar(r, pairs)).select("image_id", "region_id", "area", "members", r6(F.col("cx")).alias("cx"), "r", "g", "b")


def _pixels(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as pixels: a supplier's nation-like group is an image, the quantity's tens a region."""
    l = table(spark, folder, "lineitem")
    key = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return l.select((F.col("l_suppkey") % 5).alias("image_id"), F.floor(F.col("l_quantity") / 10).cast("int").alias("region"), (key * 100_000 + F.col("l_partkey")).alias("place"), (F.col("l_partkey") % 256).cast("int").alias("r"), (F.col("l_orderkey") % 256).cast("int").alias("g"), (F.col("l_linenumber") * 36).alias("b"))


_SAMPLES = 64
_MEDOID = f"""px AS (SELECT l_suppkey % 5 AS image_id, floor(l_quantity / 10)::INT AS region, (l_orderkey * 8 + l_linenumber) * 100000 + l_partkey AS place, l_partkey % 256 AS r, l_orderkey % 256 AS g, l_linenumber * 36 AS b FROM lineitem),
    nm AS (SELECT *, row_number() OVER (PARTITION BY image_id, region ORDER BY place) - 1 AS i, count(*) OVER (PARTITION BY image_id, region) AS n FROM px),
    ev AS (SELECT * FROM nm WHERE n <= {_SAMPLES} OR i IN (SELECT floor(k * (n - 1) / {_SAMPLES - 1}::DOUBLE) FROM range({_SAMPLES}) t(k))),
    lb AS {_lab_sql('r', 'g', 'b', 'ev', 'image_id, region, place, r, g, b, n')},
    md AS (SELECT image_id, region, median(l) AS ml, median(a) AS ma, median(bb) AS mb FROM lb GROUP BY ALL),
    nr AS (SELECT lb.*, row_number() OVER (PARTITION BY lb.image_id, lb.region ORDER BY round(sqrt(pow(l - ml, 2) + pow(a - ma, 2) + pow(bb - mb, 2)), 9), place) AS k FROM lb JOIN md USING (image_id, region)),
    pr AS (SELECT c.image_id, c.region, c.k, c.place, c.r, c.g, c.b, c.n, c.l AS l1, c.a AS a1, c.bb AS b1, s.l AS l2, s.a AS a2, s.bb AS b2 FROM nr c JOIN lb s USING (image_id, region) WHERE c.k <= 8),
    sm AS (SELECT image_id, region, k, any_value(place) AS place, any_value(r) AS r, any_value(g) AS g, any_value(b) AS b, any_value(n) AS n, round(sum(de), 6) AS d FROM {_de2000_sql('pr')} GROUP BY image_id, region, k),
    med AS (SELECT * FROM sm QUALIFY row_number() OVER (PARTITION BY image_id, region ORDER BY d, k) = 1)"""


@query(f"WITH {_MEDOID} SELECT image_id, region, place, r, g, b, n AS pixel_count FROM med")
def q_region_medoid(spark, folder):
    """The pixel that stands best for each region's color."""
    m = abstraction.robust_medoid(_pixels(spark, folder), samples=_SAMPLES, candidates=8)
    return m.select("image_id", "region", "place", "r", "g", "b", "pixel_count")


@query(
    f"""WITH {_MEDOID}, ml AS {_lab_sql('r', 'g', 'b', 'med', 'image_id, region, n / sum(n) OVER (PARTITION BY image_id) AS share')},
    p AS (SELECT x.image_id, x.region AS ra, y.region AS rb, x.l AS l1, x.a AS a1, x.bb AS b1, y.l AS l2, y.a AS a2, y.bb AS b2, x.share >= 0.03 AND y.share >= 0.03 AS big, y.region = x.region + 1 AS nxt FROM ml x JOIN ml y ON x.image_id = y.image_id AND x.region < y.region),
    d AS (SELECT * FROM {_de2000_sql('p')})
    SELECT image_id, ra AS a, rb AS b, round(de, 5) AS delta_e, round(l1 - l2, 5) AS delta_l,
      greatest(CASE WHEN nxt AND big THEN 0.80 ELSE 0 END, CASE WHEN big AND de >= 12 THEN 0.75 ELSE 0 END, CASE WHEN nxt AND ra % 2 = 0 THEN 0.90 ELSE 0 END)::DOUBLE AS protection,
      array_to_string(list_filter([CASE WHEN nxt AND big THEN 'adjacent_major' END, CASE WHEN big AND de >= 12 THEN 'major_mass' END, CASE WHEN nxt AND ra % 2 = 0 THEN 'semantic_boundary' END], lambda q: q IS NOT NULL), ',') AS reasons
    FROM d WHERE (nxt AND big) OR (big AND de >= 12) OR (nxt AND ra % 2 = 0)"""
)
def q_palette_relations(spark, folder):
    """Color relations of major and neighbouring regions."""
    px = _pixels(spark, folder)
    sizes = px.groupBy("image_id").agg(F.count("*").alias("pixels"))
    s = abstraction.region_samples(px, sizes, samples=_SAMPLES, candidates=8)
    a = px.select("image_id", "region").distinct()
    e = a.join(a.select("image_id", (F.col("region") - 1).alias("region"), F.col("region").alias("b")), ["image_id", "region"])
    e = e.select("image_id", F.col("region").alias("a"), "b", F.array_compact(F.array(F.when(F.col("region") % 2 == 0, "semantic_boundary"))).alias("reasons"))
    out = abstraction.palette_relations(s, e)
    return out.select("image_id", "a", "b", F.round("delta_e", 5).alias("delta_e"), F.round("delta_l", 5).alias("delta_l"), "protection", F.array_join("reasons", ",").alias("reasons"))


@query(f"WITH {_REG} SELECT image_id, count(*) AS regions, round(avg((area_ratio <= 0.001)::INT), 6) AS micro_ratio, round(avg((greatest(least(w, h), 1) / greatest(w, h, 1)::DOUBLE <= 0.15)::INT), 6) AS thin_ratio FROM reg GROUP BY image_id")
def q_region_ratios(spark, folder):
    """Shares of tiny and of thin regions."""
    return quality.region_ratios(_regions(spark, folder)).select("image_id", "regions", r6(F.col("micro_ratio")).alias("micro_ratio"), r6(F.col("thin_ratio")).alias("thin_ratio"))


def _anchors(k):
    """One or two anchors of a key, or none."""
    return F.filter(F.array(F.when(k % 3 == 0, k % 40), F.when(k % 5 == 0, k % 17 + 50)), lambda x: x.isNotNull()).cast("array<int>")


_ANCH = "list_filter([CASE WHEN region_id % 3 = 0 THEN region_id % 40 END, CASE WHEN region_id % 5 = 0 THEN region_id % 17 + 50 END], lambda q: q IS NOT NULL)"


@query(
    f"""WITH {_REG}, a AS (SELECT *, {_ANCH} AS anchors FROM reg), e AS (SELECT image_id, region_id, unnest(anchors) AS an FROM a),
    c AS (SELECT *, count(*) OVER (PARTITION BY image_id, an) AS n FROM e), l AS (SELECT image_id, region_id, min(n) <= 1 AS last FROM c GROUP BY ALL),
    s AS (SELECT a.*, coalesce(last, false) AS last, least(1.0, area_ratio / 0.04) AS mass, (region_id % 10) / 10.0 AS sil, (region_id % 7) / 7.0 AS con, (region_id % 11) / 10.0 AS pose FROM a LEFT JOIN l USING (image_id, region_id))
    SELECT region_id, round(least(1, 0.25 * sqrt(mass) + 0.20 * greatest(mass, sil, 0) + 0.20 * (len(anchors) > 0)::INT + 0.15 * con + 0.10 * pose), 6) AS importance,
      array_to_string(list_filter([CASE WHEN area_ratio >= 0.04 THEN 'structural_mass' END, CASE WHEN sil >= 0.30 THEN 'silhouette_contributor' END, CASE WHEN pose >= 0.80 THEN 'pose_structure' END,
        CASE WHEN region_id % 13 = 0 THEN 'critical_semantic' END, CASE WHEN last THEN 'last_characteristic_support' END], lambda q: q IS NOT NULL), ',') AS reasons FROM s"""
)
def q_shape_importance(spark, folder):
    """Importance of every shape and what protects it."""
    k = F.col("region_id")
    s = _regions(spark, folder).select("image_id", "region_id", F.col("area_ratio").alias("share"), ((k % 10) / 10.0).alias("silhouette"), F.lit(0.0).alias("protected_boundary"), ((k % 7) / 7.0).alias("contrast"), F.lit(None).cast("double").alias("semantic"), ((k % 11) / 10.0).alias("pose"), (k % 13 == 0).alias("critical"), _anchors(k).alias("anchor_ids"))
    return abstraction.shape_importance(s).select("region_id", r6(F.col("importance")).alias("importance"), F.array_join("protection_reasons", ",").alias("reasons"))


@query(f"WITH {_REG}, e AS (SELECT image_id, palette_id, unnest({_ANCH}) AS anchor_id FROM reg), k AS (SELECT DISTINCT image_id, palette_id, anchor_id FROM e WHERE anchor_id < 50) SELECT image_id, anchor_id, count(*) AS support FROM e JOIN k USING (image_id, palette_id, anchor_id) GROUP BY image_id, anchor_id")
def q_anchor_support(spark, folder):
    """Shapes that carry each anchor in a color that stands for it."""
    s = _regions(spark, folder).select("image_id", "palette_id", _anchors(F.col("region_id")).alias("anchor_ids"))
    e = s.select("image_id", "palette_id", F.filter("anchor_ids", lambda x: x < 50).alias("anchor_ids"))
    return abstraction.anchor_support(s, e)


@query(
    f"""WITH {_REG}, e AS (SELECT image_id, unnest({_ANCH}) AS anchor_id, region_id FROM reg), a AS (SELECT DISTINCT image_id, anchor_id, anchor_id % 4 > 0 AS sure FROM e), k AS (SELECT DISTINCT image_id, anchor_id FROM e WHERE region_id % 2 = 0)
    SELECT a.image_id, round(CASE WHEN count(*) FILTER (sure) = 0 THEN 1 ELSE count(*) FILTER (sure AND k.image_id IS NOT NULL) / (count(*) FILTER (sure))::DOUBLE END, 6) AS anchor_recall FROM a LEFT JOIN k ON k.image_id = a.image_id AND k.anchor_id = a.anchor_id GROUP BY a.image_id"""
)
def q_anchor_recall(spark, folder):
    """Share of sure anchors that a palette keeps."""
    k = F.col("region_id")
    r = _regions(spark, folder).select("image_id", "region_id", _anchors(k).alias("anchor_ids"))
    a = r.select("image_id", F.explode("anchor_ids").alias("anchor_id")).withColumn("confidence", F.when(F.col("anchor_id") % 4 > 0, 0.9).otherwise(0.5))
    return quality.anchor_recall(a, r.filter(k % 2 == 0)).select("image_id", r6(F.col("anchor_recall")).alias("anchor_recall"))


@query(
    f"""WITH {_REG}, rl AS {_lab_sql('r', 'g', 'b', 'reg', 'image_id, region_id')}, p AS (SELECT x.image_id, x.l AS l1, x.a AS a1, x.bb AS b1, y.l AS l2, y.a AS a2, y.bb AS b2, x.region_id AS k FROM rl x JOIN rl y ON x.image_id = y.image_id AND y.region_id - x.region_id BETWEEN 1 AND 60),
    d AS (SELECT *, (k % 5) * 10.0 AS de0, (k % 3) - 1.0 AS dl0 FROM {_de2000_sql('p', 'now')})
    SELECT image_id, round(coalesce(avg(CASE WHEN de0 > 1e-12 THEN least(1, now / de0) END), 1), 5) AS contrast_retention, count(*) FILTER (abs(dl0) > 1e-12 AND dl0 * (l1 - l2) < 0) AS lightness_flips FROM d GROUP BY image_id"""
)
def q_contrast_retention(spark, folder):
    """How much of wished contrasts the assigned colors keep."""
    r = _regions(spark, folder)
    rel = _touching(r).select("image_id", "a", "b", (F.col("a") % 5 * 10.0).alias("delta_e"), (F.col("a") % 3 - 1.0).alias("delta_l"))
    out = quality.contrast_retention(rel, r.select("image_id", F.col("region_id").alias("region"), color.lab(F.col("r"), F.col("g"), F.col("b")).alias("lab")))
    return out.select("image_id", F.round("contrast_retention", 5).alias("contrast_retention"), "lightness_flips")


@query(
    f"""WITH {_REG}, v AS (SELECT *, CASE region_id % 4 WHEN 0 THEN 'face' WHEN 1 THEN 'unknown' ELSE 'clothing' END AS cat, ['silhouette', 'identity_accent', 'major_mass', 'internal_detail'][region_id % 5] AS vis,
      ['root', 'body', 'connector', 'attached', 'unknown'][region_id % 6] AS str FROM reg),
    i AS (SELECT *, CASE WHEN cat = 'face' AND vis = 'internal_detail' THEN 0 ELSE round(least(1, CASE vis WHEN 'silhouette' THEN 0.45 WHEN 'identity_accent' THEN 0.40 WHEN 'major_mass' THEN 0.30 WHEN 'internal_detail' THEN 0.05 ELSE 0 END
      + CASE WHEN str IN ('root', 'body', 'connector') THEN 0.30 WHEN str = 'attached' THEN 0.15 ELSE 0 END + CASE WHEN is_accent THEN 0.15 ELSE 0 END + 0.10 * solidity), 6) END AS imp FROM v)
    SELECT region_id, round(imp, 6) AS importance, CASE WHEN cat = 'face' AND vis = 'internal_detail' THEN 'suppress' WHEN vis = 'identity_accent' THEN 'preserve' WHEN str IN ('body', 'connector') THEN 'simplify'
      WHEN cat = 'unknown' OR str = 'unknown' THEN 'conditional' WHEN imp >= 0.70 THEN 'preserve' WHEN imp >= 0.25 THEN 'simplify' ELSE 'conditional' END AS policy FROM i"""
)
def q_part_policy(spark, folder):
    """Importance of parts and what becomes of them."""
    k = F.col("region_id")
    cat = F.when(k % 4 == 0, "face").when(k % 4 == 1, "unknown").otherwise("clothing")
    pick = lambda names, at: F.get(F.array(*[F.lit(n) for n in names]), at - 1)
    vis = pick(["silhouette", "identity_accent", "major_mass", "internal_detail"], (k % 5).cast("int"))
    st = pick(["root", "body", "connector", "attached", "unknown"], (k % 6).cast("int"))
    d = _regions(spark, folder).withColumns({"c": cat, "v": vis, "s": st})
    d = d.withColumn("importance", abstraction.part_importance(F.col("c"), F.col("v"), F.col("s"), F.col("is_accent"), F.col("solidity")))
    return d.select("region_id", r6(F.col("importance")).alias("importance"), abstraction.part_policy(F.col("c"), F.col("v"), F.col("s"), F.col("importance")).alias("policy"))


@query(
    """WITH p AS (SELECT l_suppkey % 5 AS image_id, 'part' || (l_linenumber % 3) AS part, l_partkey % 97 AS x, l_orderkey % 61 AS y, l_partkey % 256 AS r, l_orderkey % 256 AS g, l_linenumber * 36 AS b FROM lineitem)
    SELECT image_id, part, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, round(sqrt(pow(max(x) - min(x) + 1, 2) + pow(max(y) - min(y) + 1, 2)), 6) AS diagonal, round(avg(r), 6) AS r, round(avg(g), 6) AS g, round(avg(b), 6) AS b, count(*) AS pixels,
      row_number() OVER (PARTITION BY image_id ORDER BY count(*) DESC, part) - 1 AS component_index FROM p GROUP BY image_id, part"""
)
def q_part_geometry(spark, folder):
    """Center, extent, mean color and place by size of every part."""
    l = table(spark, folder, "lineitem")
    p = l.select((F.col("l_suppkey") % 5).alias("image_id"), F.concat(F.lit("part"), (F.col("l_linenumber") % 3).cast("string")).alias("part"), (F.col("l_partkey") % 97).alias("x"), (F.col("l_orderkey") % 61).alias("y"), (F.col("l_partkey") % 256).alias("r"), (F.col("l_orderkey") % 256).alias("g"), (F.col("l_linenumber") * 36).alias("b"))
    d = abstraction.part_geometry(p).join(abstraction.part_colors(p), ["image_id", "part"])
    d = abstraction.component_index(d, ["image_id"], "pixels", ["part"])
    return d.select("image_id", "part", *[r6(F.col(c)).alias(c) for c in ("cx", "cy", "diagonal", "r", "g", "b")], "pixels", F.col("component_index").cast("bigint").alias("component_index"))


@query(
    """WITH r AS (SELECT DISTINCT p_brand AS case_id, 'p' || p_size % 7 AS a, 'p' || p_size % 5 AS b, 'r' || p_partkey % 3 AS relation FROM part),
    u AS (SELECT case_id, a AS part, b AS other, relation, true AS forward FROM r UNION SELECT case_id, b, a, relation, false FROM r)
    SELECT case_id, part, string_agg(other || ':' || relation || ':' || forward::VARCHAR, ',' ORDER BY other, relation, forward) AS others FROM u GROUP BY case_id, part"""
)
def q_relation_lookup(spark, folder):
    """Relations of every part, in both directions."""
    p = table(spark, folder, "part")
    name = lambda c, n: F.concat(F.lit(c), n.cast("string"))
    r = p.select(F.col("p_brand").alias("case_id"), name("p", F.col("p_size") % 7).alias("a"), name("p", F.col("p_size") % 5).alias("b"), name("r", F.col("p_partkey") % 3).alias("relation"))
    text = F.transform("others", lambda x: F.concat_ws(":", x["other"], x["relation"], x["forward"].cast("string")))
    return abstraction.relation_lookup(r).select("case_id", "part", F.array_join(text, ",").alias("others"))


@query(
    """WITH e AS (SELECT DISTINCT p_brand AS image_id, p_size % 9 AS a, p_partkey % 7 AS b FROM part)
    SELECT image_id, a, b, 'one_sided' AS why FROM e WHERE (image_id, b, a) NOT IN (SELECT (image_id, a, b) FROM e) UNION ALL SELECT image_id, a, b, 'self' FROM e WHERE a = b"""
)
def q_one_sided(spark, folder):
    """Adjacencies that the other end doesn't know."""
    e = table(spark, folder, "part").select(F.col("p_brand").alias("image_id"), (F.col("p_size") % 9).cast("bigint").alias("a"), (F.col("p_partkey") % 7).alias("b"))
    return abstraction.one_sided(e)


@query(f"WITH {_REG}, {_ROLE}, {_SEM}, {_LAY} SELECT image_id, 'layer' AS name, layer AS value, count(*) AS n FROM lay GROUP BY ALL UNION ALL SELECT image_id, 'role', role, count(*) FROM lay GROUP BY ALL UNION ALL SELECT image_id, 'semantic_type', semantic_type, count(*) FROM lay GROUP BY ALL")
def q_role_counts(spark, folder):
    """Regions per layer, role and semantic type of every image."""
    return abstraction.counts_by(_named(spark, folder), ["image_id"], ["layer", "role", "semantic_type"])


# ---- quality


@query(
    """WITH s AS (SELECT o_custkey AS case_id, o_orderpriority AS dimension, o_totalprice / 400000 AS score FROM orders), a AS (SELECT case_id, avg(CASE WHEN score BETWEEN 0 AND 1 AND dimension IN ('1-URGENT', '2-HIGH') THEN score END) AS mean,
      list_sort(list_distinct(list(dimension))) AS have, list_sort(list_distinct(list(dimension) FILTER (NOT score BETWEEN 0 AND 1))) AS bad FROM s GROUP BY case_id),
    g AS (SELECT c_custkey AS case_id, CASE c_custkey % 5 WHEN 0 THEN 'FAIL' WHEN 1 THEN 'MAYBE' ELSE 'PASS' END AS gate FROM customer),
    e AS (SELECT g.case_id, gate, mean, list_concat(list_concat(list_transform(list_filter(['1-URGENT', '2-HIGH'], lambda x: NOT list_contains(coalesce(have, []), x)), lambda x: 'missing:' || x),
      list_transform(list_filter(coalesce(have, []), lambda x: NOT list_contains(['1-URGENT', '2-HIGH'], x)), lambda x: 'unknown:' || x)), list_concat(list_transform(coalesce(bad, []), lambda x: 'range:' || x), CASE WHEN gate = 'MAYBE' THEN ['gate'] ELSE [] END)) AS errors FROM g LEFT JOIN a USING (case_id))
    SELECT case_id, CASE WHEN gate = 'PASS' THEN 'PASS' ELSE 'FAIL' END AS gate, CASE WHEN len(errors) = 0 THEN round(mean, 6) END AS diagnostic_mean, array_to_string(errors, ',') AS errors FROM e"""
)
def q_gap_report(spark, folder):
    """Gate, mean and errors of every case's gap report."""
    s = table(spark, folder, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderpriority").alias("dimension"), (F.col("o_totalprice") / 400000).alias("score"))
    k = F.col("c_custkey")
    g = table(spark, folder, "customer").select(k.alias("case_id"), F.when(k % 5 == 0, "FAIL").when(k % 5 == 1, "MAYBE").otherwise("PASS").alias("gate"))
    return quality.gap_report(s, g, ["1-URGENT", "2-HIGH"]).select("case_id", "gate", r6(F.col("diagnostic_mean")).alias("diagnostic_mean"), F.array_join("errors", ",").alias("errors"))


@query(
    """WITH r AS (SELECT o_custkey AS case_id, o_orderpriority AS label, max(o_totalprice) AS v FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 2 = 0 GROUP BY ALL), c AS (SELECT o_custkey AS case_id, o_orderpriority AS label, max(o_totalprice) AS v FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 2 = 1 GROUP BY ALL)
    SELECT r.case_id, r.label, round(coalesce(least(1, greatest(0, c.v / greatest(r.v, 1e-9))), 0), 6) AS retention FROM r LEFT JOIN c ON c.case_id = r.case_id AND c.label = r.label"""
)
def q_regional_retention(spark, folder):
    """How much of each label's coverage a later state keeps."""
    o = table(spark, folder, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderpriority").alias("label"), F.col("o_totalprice").alias("coverage"), F.when(F.col("o_orderstatus") == "P", 0.2).otherwise(0.9).alias("confidence"), (F.col("o_orderkey") % 2 == 0).alias("early"))
    return quality.regional_retention(o.filter("early"), o.filter("not early")).select("case_id", "label", r6(F.col("retention")).alias("retention"))


@query(
    """WITH o AS (SELECT o_custkey AS case_id, o_orderpriority AS part, max(o_totalprice / 500000) AS iou FROM orders GROUP BY ALL), k AS (SELECT DISTINCT case_id, unnest(['1-URGENT', '5-LOW']) AS part FROM o),
    f AS (SELECT coalesce(o.case_id, k.case_id) AS case_id, coalesce(o.part, k.part) AS part, coalesce(iou, 0) AS iou FROM o FULL JOIN k ON k.case_id = o.case_id AND k.part = o.part)
    SELECT case_id, round(min(iou), 6) AS least_iou, coalesce(string_agg(part, ',' ORDER BY part) FILTER (iou < 0.4), '') AS lost, count(*) FILTER (iou < 0.4) = 0 AS passed FROM f GROUP BY case_id"""
)
def q_ownership_retention(spark, folder):
    """Whether all parts kept their owner."""
    o = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("case_id"), F.col("o_orderpriority").alias("part")).agg(F.max(F.col("o_totalprice") / 500000).alias("iou"))
    return quality.ownership_retention(o, ["1-URGENT", "5-LOW"], 0.4).select("case_id", r6(F.col("least_iou")).alias("least_iou"), F.array_join("lost", ",").alias("lost"), "passed")


@query(
    """SELECT l_suppkey % 5 AS image_id, round(avg((sqrt(pow(l_partkey % 256 - 100, 2) + pow(l_orderkey % 256 - 120, 2) + pow(l_linenumber * 36 - 90, 2)) > 110)::INT), 6) AS forbidden_ratio, count(*) AS pixels FROM lineitem GROUP BY ALL"""
)
def q_forbidden_ratio(spark, folder):
    """Share of an area's pixels far from its base color."""
    base = F.struct(F.lit(100).alias("r"), F.lit(120).alias("g"), F.lit(90).alias("b"))
    p = _pixels(spark, folder).withColumn("base", base)
    return quality.forbidden_ratio(p, 110.0).select("image_id", r6(F.col("forbidden_ratio")).alias("forbidden_ratio"), "pixels")


@query(
    f"""WITH {_REG}, b AS (SELECT image_id, region_id, region_id % 2 = 0 AS limb, w * h AS before, ['t' || region_id % 3, 't' || region_id % 4] AS had FROM reg WHERE region_id % 4 < 3),
    c AS (SELECT image_id, region_id, CASE WHEN region_id % 19 = 0 THEN 'suppress' ELSE 'preserve' END AS pol, w * h * (region_id % 8) / 2.0 AS after, 't' || region_id % 3 AS has FROM reg WHERE region_id % 11 > 0),
    j AS (SELECT b.*, c.region_id IS NOT NULL AS there, pol, after, has FROM b LEFT JOIN c USING (image_id, region_id)),
    f AS (SELECT image_id, 'missing:' || region_id AS x FROM j WHERE NOT there UNION ALL SELECT image_id, 'suppressed:' || region_id FROM j WHERE there AND pol = 'suppress'
      UNION ALL SELECT image_id, 'extreme:' || region_id FROM j WHERE there AND limb AND (after / before < 0.35 OR after / before > 2.8) UNION ALL SELECT image_id, 'topology:' || region_id || ':' || had[2] FROM j WHERE there AND had[2] <> has)
    SELECT i.image_id AS case_id, count(x) AS failures, coalesce(string_agg(x, ',' ORDER BY x), '') AS texts, count(x) = 0 AS passed FROM (SELECT DISTINCT image_id FROM reg) i LEFT JOIN f ON f.image_id = i.image_id GROUP BY i.image_id"""
)
def q_anatomy_gate(spark, folder):
    """Failures of required parts of every case."""
    k = F.col("region_id")
    t = lambda n: F.concat(F.lit("t"), (k % n).cast("string"))
    r = _regions(spark, folder).withColumns({"case_id": F.col("image_id"), "part_id": k.cast("string")})
    b = r.select("case_id", "part_id", (k % 4 < 3).alias("required"), (k % 2 == 0).alias("limb"), F.lit("preserve").alias("policy"), (F.col("w") * F.col("h")).alias("box_area"), F.array(t(3), t(4)).alias("constraints"))
    c = r.filter(k % 11 > 0).select("case_id", "part_id", F.lit(True).alias("required"), F.lit(False).alias("limb"), F.when(k % 19 == 0, "suppress").otherwise("preserve").alias("policy"), (F.col("w") * F.col("h") * (k % 8) / 2.0).alias("box_area"), F.array(t(3)).alias("constraints"))
    return quality.anatomy_gate(b, c).select("case_id", F.size("failures").cast("bigint").alias("failures"), F.array_join("failures", ",").alias("texts"), "passed")


@query(
    """SELECT o_orderkey, round((1 - o_totalprice / 600000) * 3 + (o_orderkey % 10) / 10.0 + 2.0 * (o_custkey % 7) / 7.0 + 0.12 * (o_orderkey % 40) + 0.35 * (o_custkey % 3) / 3.0 + 0.08 * (o_orderkey % 13), 4) AS loss,
      round(pow(least(1, abs(o_totalprice / 600000 - 0.5) * 2), 2), 6) AS sure, CASE WHEN o_orderstatus <> 'F' THEN 'hard_gate' WHEN o_custkey % 4 = 0 THEN 'veto' WHEN o_orderkey % 3 - 1 < 0.000001 THEN 'no_improvement' ELSE 'accepted' END AS fate FROM orders"""
)
def q_candidate_objective(spark, folder):
    """Weighted loss, sureness and fate of candidates."""
    k, c, p = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice") / 600000
    loss = quality.objective(p, (k % 10) / 10.0, (c % 7) / 7.0, k % 40, (c % 3) / 3.0, k % 13)
    fate = quality.candidate_gate(F.col("o_orderstatus") == "F", F.array_compact(F.array(F.when(c % 4 == 0, "observer"))), (k % 3 - 1).cast("double"))
    return table(spark, folder, "orders").select("o_orderkey", F.round(loss, 4).alias("loss"), r6(quality.confidence_of(p)).alias("sure"), fate.alias("fate"))


@query(
    """WITH p AS (SELECT o_custkey, list({'l': o_totalprice / 6000, 'a': o_orderkey % 50 - 25.0, 'b': o_custkey % 40 - 20.0} ORDER BY o_orderkey) AS s FROM orders GROUP BY o_custkey)
    SELECT o_custkey, round(list_sum(list_transform(s, lambda x: sqrt(pow(x.l - 50, 2) + pow(x.a, 2) + pow(x.b, 2)) / 100)) / len(s), 6) AS loss FROM p"""
)
def q_palette_loss(spark, folder):
    """Mean Lab distance of aligned samples."""
    o = table(spark, folder, "orders")
    s = F.struct((F.col("o_totalprice") / 6000).alias("l"), (F.col("o_orderkey") % 50 - 25.0).alias("a"), (F.col("o_custkey") % 40 - 20.0).alias("b"))
    d = o.groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", s.alias("s")))), lambda x: x["s"]).alias("s"))
    gray = F.transform("s", lambda x: F.struct(F.lit(50.0).alias("l"), F.lit(0.0).alias("a"), F.lit(0.0).alias("b")))
    return d.select("o_custkey", r6(quality.palette_loss(F.col("s"), gray)).alias("loss"))


@query()
def q_spatial_similarity(spark, folder):
    """Similarity of grids of feature vectors: of each label its vectors in order against those in reverse."""
    e = table(spark, folder, "embeddings").select("label", "vec_id", F.col("embedding").cast("array<double>").alias("v"))
    n = e.groupBy("label").agg(F.count("*").alias("n"))
    from pyspark.sql import Window as W

    up = e.withColumn("i", F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1)
    down = e.withColumn("i", F.row_number().over(W.partitionBy("label").orderBy(F.desc("vec_id"))) - 1)
    g = up.select("label", "i", F.col("v").alias("a")).join(down.select("label", "i", F.col("v").alias("b")), ["label", "i"]).join(n, "label")
    g = g.withColumns({"w": F.lit(5), "h": F.ceil(F.col("n") / 5).cast("int"), "x": F.col("i") % 5, "y": F.floor(F.col("i") / 5)})
    return quality.spatial_similarity(g, ["label"]).select("label", *[F.round(c, 5).alias(c) for c in ("whole", "aligned", "coarse", "score")])


@query(
    f"""WITH {_REG}, s AS (SELECT *, region_id % 500 AS rid, region_id // 2 AS z FROM reg), c AS (SELECT image_id, unnest([{{'check': 'unique_regions', 'broken': count(*) - count(DISTINCT rid)}}, {{'check': 'unique_order', 'broken': count(*) - count(DISTINCT z)}},
      {{'check': 'known_canvas', 'broken': 0}}, {{'check': 'inside_canvas', 'broken': count(*) FILTER (x + w > 90 OR y + h > 80)}}, {{'check': 'known_colors', 'broken': count(*) FILTER (palette_id = 5)}}, {{'check': 'positive_size', 'broken': 0}},
      {{'check': 'unit_importance', 'broken': count(*) FILTER (structure_score > 0.95)}}], max_depth := 2) FROM s GROUP BY image_id)
    SELECT image_id, "check", broken::BIGINT AS broken, broken = 0 AS passed FROM c"""
)
def q_invariants(spark, folder):
    """What must hold in every scene, and how often it is broken."""
    r = _regions(spark, folder)
    scene = r.withColumns({"region_id": F.col("region_id") % 500, "z": F.floor(F.col("region_id") / 2), "importance": F.when(F.col("structure_score") <= 0.95, F.col("structure_score")).otherwise(2.0)})
    canvas = _images(spark, folder).withColumn("width", F.lit(90))
    return quality.invariants(scene, canvas, r.filter("palette_id < 5").select("image_id", "palette_id").distinct())


@query(f"WITH {_REG}, d AS (SELECT image_id, sha256(string_agg(r || '|' || g || '|' || area, chr(10) ORDER BY region_id)) AS digest FROM reg GROUP BY image_id) SELECT image_id, digest, true AS same FROM d")
def q_scene_digest(spark, folder):
    """Digest of every scene, and whether a second run in another order gives the same."""
    r = _regions(spark, folder)
    args = (["image_id"], ["region_id"], ["r", "g", "area"])
    return quality.scene_digest(r, *args).join(quality.determinism(r, _regions(spark, folder).repartition(5, "r"), *args), "image_id")


@query(
    """SELECT o_custkey, coalesce(bool_and(coalesce(o_totalprice > 60000, false)) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH')), true) AS passed, count(*) FILTER (o_totalprice <= 60000 AND o_orderpriority IN ('1-URGENT', '2-HIGH')) AS critical_failures,
      count(*) FILTER (o_totalprice <= 60000 AND o_orderpriority NOT IN ('1-URGENT', '2-HIGH')) AS other_failures FROM orders GROUP BY o_custkey"""
)
def q_critical_gate(spark, folder):
    """Gate over critical checks; others are counted only."""
    o = table(spark, folder, "orders").select("o_custkey", (F.col("o_totalprice") > 60000).alias("ok"), F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("critical"))
    return quality.all_pass(o, ["o_custkey"], "ok", "critical")


@query(
    f"""WITH {_REG}, k AS (SELECT region_id, area_ratio, solidity, structure_score AS s, (region_id % 9) / 90.0 AS c FROM reg)
    SELECT region_id, area_ratio <= 0.0008 AND solidity >= 0.35 AND c <= 0.08 AND c <= 0.15 AND s <= 0.05 AND region_id % 4 > 0 AS safe, region_id % 4 > 0 AND c <= 0.08 AND solidity >= 0.90 AND c / 2 <= 0.04 AND s <= 0.6 AS contour FROM k"""
)
def q_merge_guards(spark, folder):
    """Safe merges and contours that may replace their originals."""
    k, c, s = F.col("region_id"), (F.col("region_id") % 9) / 90.0, F.col("structure_score")
    safe = abstraction.safe_merge(F.col("area_ratio"), k % 4 > 0, {"color_cost": c, "boundary_cost": c, "structure_cost": s}, F.col("solidity"))
    ok = abstraction.contour_ok(k % 4 > 0, c, F.col("solidity"), c / 2, s, F.lit(0.6))
    return _regions(spark, folder).select("region_id", safe.alias("safe"), ok.alias("contour"))
