"""Confidence maps, role masks and their relations as pixel tables.

guide: image_id, label, y, x, confidence; masks: image_id, role, y, x; labels: image_id, y, x, region.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def fuse_guides(*guides: DataFrame) -> DataFrame:
    """All labels of all guides; where several speak of a pixel, the greatest confidence. Union and one combining
    aggregation, no join."""
    out = guides[0]
    for g in guides[1:]:
        out = out.unionByName(g)
    return out.groupBy("image_id", "label", "y", "x").agg(F.max("confidence").alias("confidence"))


def region_semantics(labels: DataFrame, guide: DataFrame) -> DataFrame:
    """The label of greatest mean confidence of every region (pixels without confidence count as 0; ties to the
    first label by name), and that mean. A region that no map touches has a null label and 0."""
    size = labels.groupBy("image_id", "region").agg(F.count("*").alias("n"))
    sums = guide.join(labels, ["image_id", "y", "x"]).groupBy("image_id", "region", "label").agg(F.sum("confidence").alias("s"))
    best = sums.groupBy("image_id", "region").agg(F.min(F.struct((-F.col("s")).alias("m"), "label")).alias("b"))
    return size.join(best, ["image_id", "region"], "left").select("image_id", "region", F.col("b.label").alias("label"), F.coalesce(-F.col("b.m") / F.col("n"), F.lit(0.0)).alias("confidence"))


def mask_relations(masks: DataFrame, z_order: DataFrame | None = None) -> DataFrame:
    """Relation of every two roles of an image: OVERLAP, TOUCHING (some pixel of one beside one of the other, 8
    neighbours) or DISJOINT, with pixels shared, pixels in contact, and overlap over each area. With ``z_order``
    (image_id, role, z) the one in front and behind; equal places leave them null.

    Pixels meet on equal (image, y, x); a mask's neighbourhood is its pixels moved to nine places, so there is
    no theta join. Roles of an image are a handful.
    """
    m = masks.select("image_id", "role", "y", "x").distinct()
    area = m.groupBy("image_id", "role").agg(F.count("*").alias("n"))
    a, b = area.withColumnsRenamed({"role": "a", "n": "na"}), area.withColumnsRenamed({"role": "b", "n": "nb"})
    pairs = a.join(b, "image_id").filter("a < b")
    key = ["image_id", "a", "b"]
    p, q = m.withColumnRenamed("role", "a"), m.withColumnRenamed("role", "b")
    both = p.join(q, ["image_id", "y", "x"]).filter("a < b").groupBy(*key).agg(F.count("*").alias("shared"))
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
    wide = p.select("image_id", "a", "y", "x", F.explode(steps).alias("s")).select("image_id", "a", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x")).distinct()
    contact = wide.join(q, ["image_id", "y", "x"]).filter("a < b").groupBy(*key).agg(F.count("*").alias("contact"))
    out = pairs.join(both, key, "left").join(contact, key, "left").fillna(0, ["shared", "contact"])
    kind = F.when(F.col("shared") > 0, "OVERLAP").when(F.col("contact") > 0, "TOUCHING").otherwise("DISJOINT")
    out = out.select(*key, kind.alias("relation"), "shared", "contact", (F.col("shared") / F.col("na")).alias("share_a"), (F.col("shared") / F.col("nb")).alias("share_b"))
    if z_order is None:
        return out
    za, zb = z_order.select("image_id", F.col("role").alias("a"), F.col("z").alias("za")), z_order.select("image_id", F.col("role").alias("b"), F.col("z").alias("zb"))
    d = out.join(za, ["image_id", "a"], "left").join(zb, ["image_id", "b"], "left")
    meets = F.col("relation") != "DISJOINT"
    front = F.when(meets & (F.col("za") > F.col("zb")), F.col("a")).when(meets & (F.col("za") < F.col("zb")), F.col("b"))
    back = F.when(meets & (F.col("za") > F.col("zb")), F.col("b")).when(meets & (F.col("za") < F.col("zb")), F.col("a"))
    return d.withColumns({"front": front, "back": back}).drop("za", "zb")


def role_gaps(candidate: DataFrame, golden: DataFrame, masks: DataFrame, areas: DataFrame) -> DataFrame:
    """Where a candidate differs from its reference, by role: mean absolute Lab difference, share of pixels whose
    edge flag differs, and their sum weighted by the role's share of the image, ranked.

    ``candidate``, ``golden``: image_id, y, x, l, ca, cb, edge (boolean); ``areas``: image_id, area.
    """
    j = masks.join(candidate.alias("c"), ["image_id", "y", "x"]).join(golden.alias("g"), ["image_id", "y", "x"])
    lab = sum((F.abs(F.col(f"c.{n}") - F.col(f"g.{n}")) for n in ("l", "ca", "cb")), F.lit(0.0)) / 3.0
    per = j.groupBy("image_id", "role").agg(F.count("*").alias("pixels"), F.avg(lab).alias("lab_mae"), F.avg((F.col("c.edge") != F.col("g.edge")).cast("int")).alias("edge_gap")).join(areas, "image_id")
    per = per.withColumn("gap", F.col("pixels") / F.col("area") * (F.col("lab_mae") / 255.0 + F.col("edge_gap")))
    return per.withColumn("rank", F.row_number().over(W.partitionBy("image_id").orderBy(F.desc("gap"), "role")))


def edge_coverage(labels: DataFrame, weight: str) -> DataFrame:
    """Per image, the share of edge weight that lies at most one pixel from a boundary of labels; 1 without
    weight. Complete grids: neighbours come from windows along rows and columns."""
    row, col = W.partitionBy("image_id", "y").orderBy("x"), W.partitionBy("image_id", "x").orderBy("y")
    differ = lambda w: F.coalesce(F.lag("region").over(w) != F.col("region"), F.lit(False)) | F.coalesce(F.lead("region").over(w) != F.col("region"), F.lit(False))
    d = labels.withColumn("_b", (differ(row) | differ(col)).cast("int"))
    d = d.withColumn("_n", F.max("_b").over(row.rowsBetween(-1, 1))).withColumn("_n", F.max("_n").over(col.rowsBetween(-1, 1)))
    v = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(weight)))
    return d.groupBy("image_id").agg(F.sum(v).alias("t"), F.sum(v * F.col("_n")).alias("c")).select("image_id", F.when(F.col("t") <= 1e-12, 1.0).otherwise(F.col("c") / F.col("t")).alias("coverage"))


def masses(pixels_: DataFrame, groups: DataFrame, similar: Column) -> DataFrame:
    """Edges between touching regions that may form one mass; feed them to ``graph.connected_components``.

    ``pixels_``: adjacency rows image_id, a, b, shared_px; ``groups``: image_id, region and attributes;
    ``similar`` speaks of structs ``p`` and ``q`` of the two regions' attributes."""
    s = groups.select("image_id", "region", F.struct(*[c for c in groups.columns if c not in ("image_id", "region")]).alias("s"))
    j = pixels_.join(s.withColumnsRenamed({"region": "a", "s": "p"}), ["image_id", "a"]).join(s.withColumnsRenamed({"region": "b", "s": "q"}), ["image_id", "b"])
    return j.filter(similar).select("image_id", "a", "b", "shared_px")
