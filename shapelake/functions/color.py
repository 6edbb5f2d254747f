"""Color as column expressions: everything stays inside whole-stage code generation.

Channels are 0..255; Lab values are structs ``l, a, b`` (D65). Lab agrees with 8-bit table-based
conversions only within their rounding.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# sRGB to XYZ under D65, its inverse, and the white point.
RGB_TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
XYZ_TO_RGB = ((3.2404542, -1.5371385, -0.4985314), (-0.9692660, 1.8760108, 0.0415560), (0.0556434, -0.2040259, 1.0572252))
WHITE = (0.95047, 1.0, 1.08883)
_E, _K = 216 / 24389, 24389 / 27


def linear(channel: Column) -> Column:
    """A gamma-coded channel as linear light in 0..1."""
    v = channel / F.lit(255.0)
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def _f(t: Column) -> Column:
    return F.when(t > _E, F.cbrt(t)).otherwise((t * _K + 16.0) / 116.0)


def lab(r: Column, g: Column, b: Column) -> Column:
    """CIE Lab of an sRGB color."""
    rgb = [linear(r), linear(g), linear(b)]
    x, y, z = (_f(sum((m * c for m, c in zip(row, rgb, strict=True)), F.lit(0.0)) / w) for row, w in zip(RGB_TO_XYZ, WHITE, strict=True))
    return F.struct((y * 116.0 - 16.0).alias("l"), ((x - y) * 500.0).alias("a"), ((y - z) * 200.0).alias("b"))


def rgb(lab_: Column) -> Column:
    """sRGB struct ``r, g, b`` of a Lab struct, clipped and rounded half to even."""
    fy = (lab_["l"] + 16.0) / 116.0
    fs = (fy + lab_["a"] / 500.0, fy, fy - lab_["b"] / 200.0)
    xyz = [F.when(F.pow(f, F.lit(3.0)) > _E, F.pow(f, F.lit(3.0))).otherwise((f * 116.0 - 16.0) / _K) * w for f, w in zip(fs, WHITE, strict=True)]

    def channel(row):
        v = sum((m * c for m, c in zip(row, xyz, strict=True)), F.lit(0.0))
        v = F.greatest(v, F.lit(0.0))
        v = F.when(v <= 0.0031308, v * 12.92).otherwise(F.pow(v, F.lit(1 / 2.4)) * 1.055 - 0.055)
        return F.bround(F.least(v, F.lit(1.0)) * 255.0, 0).cast("int")

    return F.struct(*[channel(row).alias(n) for row, n in zip(XYZ_TO_RGB, "rgb", strict=True)])


def delta_e76(p: Column, q: Column) -> Column:
    """Distance of two Lab structs."""
    return F.sqrt(sum((F.pow(p[n] - q[n], F.lit(2.0)) for n in "lab"), F.lit(0.0)))


def chroma(p: Column) -> Column:
    return F.hypot(p["a"], p["b"])


def hue_degrees(p: Column) -> Column:
    """Hue angle of a Lab struct in 0..360."""
    return F.pmod(F.degrees(F.atan2(p["b"], p["a"])), F.lit(360.0))


def with_delta_e2000(df: DataFrame, p: str, q: str, name: str = "delta_e") -> DataFrame:
    """``df`` with the CIEDE2000 difference of its Lab struct columns ``p`` and ``q``, as published (unit
    weights). Steps are columns of their own, so no term is repeated inside another."""
    made: list[str] = []

    def step(frame: DataFrame, **cols: Column) -> DataFrame:
        named = {f"_de_{k}": v for k, v in cols.items()}
        made.extend(named)
        return frame.withColumns(named)

    c = lambda n: F.col(f"_de_{n}")
    deg, two, seven = F.radians, F.lit(2.0), F.lit(7.0)
    hue = lambda a, b: F.when((a == 0) & (b == 0), F.lit(0.0)).otherwise(F.pmod(F.degrees(F.atan2(b, a)), F.lit(360.0)))
    d = step(df, c7=F.pow((chroma(F.col(p)) + chroma(F.col(q))) / 2.0, seven))
    d = step(d, g=(F.lit(1.0) - F.sqrt(c("c7") / (c("c7") + 25.0**7))) * 0.5 + 1.0)
    d = step(d, a1=F.col(f"{p}.a") * c("g"), a2=F.col(f"{q}.a") * c("g"))
    d = step(d, h1=hue(c("a1"), F.col(f"{p}.b")), h2=hue(c("a2"), F.col(f"{q}.b")), c1=F.hypot(c("a1"), F.col(f"{p}.b")), c2=F.hypot(c("a2"), F.col(f"{q}.b")))
    d = step(d, gray=c("c1") * c("c2") == 0, turn=c("h2") - c("h1"), sum=c("h1") + c("h2"), ml=(F.col(f"{p}.l") + F.col(f"{q}.l")) / 2.0, mc=(c("c1") + c("c2")) / 2.0)
    turn = F.when(c("gray"), F.lit(0.0)).when(c("turn") > 180, c("turn") - 360.0).when(c("turn") < -180, c("turn") + 360.0).otherwise(c("turn"))
    mean = F.when(c("gray"), c("sum")).when(F.abs("_de_turn") <= 180, c("sum") / 2.0).when(c("sum") < 360, (c("sum") + 360.0) / 2.0).otherwise((c("sum") - 360.0) / 2.0)
    d = step(d, dh=F.sqrt(c("c1") * c("c2")) * F.sin(deg(turn / 2.0)) * 2.0, mh=mean, ll=F.pow(c("ml") - 50.0, two), mc7=F.pow(c("mc"), seven))
    t = F.lit(1.0) - F.cos(deg(c("mh") - 30.0)) * 0.17 + F.cos(deg(c("mh") * 2.0)) * 0.24 + F.cos(deg(c("mh") * 3.0 + 6.0)) * 0.32 - F.cos(deg(c("mh") * 4.0 - 63.0)) * 0.20
    rot = -F.sin(deg(F.exp(-F.pow((c("mh") - 275.0) / 25.0, two)) * 60.0)) * F.sqrt(c("mc7") / (c("mc7") + 25.0**7)) * 2.0
    d = step(d, x=(F.col(f"{q}.l") - F.col(f"{p}.l")) / (c("ll") * 0.015 / F.sqrt(c("ll") + 20.0) + 1.0), y=(c("c2") - c("c1")) / (c("mc") * 0.045 + 1.0), z=c("dh") / (c("mc") * t * 0.015 + 1.0), rt=rot)
    return d.withColumn(name, F.sqrt(c("x") * c("x") + c("y") * c("y") + c("z") * c("z") + c("rt") * c("y") * c("z"))).drop(*made)


def euclid(p: Column, q: Column, fields: tuple[str, ...] = ("r", "g", "b")) -> Column:
    """Plain distance of two color structs."""
    return F.sqrt(sum((F.pow((p[n] - q[n]).cast("double"), F.lit(2.0)) for n in fields), F.lit(0.0)))


def saturation(r: Column, g: Column, b: Column) -> Column:
    """(max - min) / max of the channels, 0 for black."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    return F.when(top == 0, F.lit(0.0)).otherwise((top - low) / top)


def brightness(r: Column, g: Column, b: Column) -> Column:
    """Luma in 0..1."""
    return (r * 0.299 + g * 0.587 + b * 0.114) / 255.0


def quantize(channel: Column, step: int = 32) -> Column:
    """Middle of the channel's grid cell."""
    return F.least(F.lit(255), F.floor(channel / step).cast("int") * step + step // 2).cast("int")


def hex_color(r: Column, g: Column, b: Column) -> Column:
    """``#rrggbb``."""
    return F.lower(F.concat(F.lit("#"), *[F.lpad(F.hex(c.cast("int")), 2, "0") for c in (r, g, b)]))


def blend(a: Column, b: Column, t: Column) -> Column:
    """Linear blend of two channels, rounded half to even."""
    return F.bround(a * (F.lit(1.0) - t) + b * t, 0).cast("int")


def composite(channel: Column, alpha: Column, background: Column) -> Column:
    """A channel over a solid background by its alpha (0..255)."""
    return blend(background, channel, alpha / 255.0)


# Anchor colors of the hue families.
FAMILY_ANCHORS = {
    "red": (220, 45, 45),
    "orange": (235, 125, 35),
    "yellow": (238, 205, 55),
    "yellowgreen": (160, 190, 60),
    "green": (55, 155, 85),
    "cyan": (55, 190, 200),
    "blue": (70, 115, 220),
    "purple": (135, 85, 205),
    "pink": (230, 105, 170),
}
# For weak colors, hue ranges with the lightness that parts two names.
WEAK_FAMILIES = [
    (15, 75, 68, "beige", "brown"),
    (75, 125, 72, "beige", "yellow"),
    (125, 205, 72, "gray", "green"),
    (205, 270, 72, "bluegray", "blue"),
    (270, 330, 72, "mauve", "purple"),
]
# Hue ranges in which an anchor's distance is shortened.
FAMILY_PULL = {"red": (350, 22, 0.91), "yellow": (55, 100, 0.88), "yellowgreen": (90, 125, 0.94), "cyan": (170, 220, 0.90), "blue": (220, 285, 0.91), "purple": (285, 325, 0.91), "pink": (0, 360, 0.90)}


def lab_of(channels: tuple[int, int, int]) -> tuple[float, float, float]:
    """Lab of a constant color, on the driver."""
    rgb_ = [v / 12.92 if v <= 0.04045 else ((v + 0.055) / 1.055) ** 2.4 for v in (c / 255.0 for c in channels)]
    f = [math.cbrt(t) if t > _E else (_K * t + 16) / 116 for t in (sum(m * v for m, v in zip(row, rgb_, strict=True)) / w for row, w in zip(RGB_TO_XYZ, WHITE, strict=True))]
    return 116 * f[1] - 16, 500 * (f[0] - f[1]), 200 * (f[1] - f[2])


def color_family(p: Column, neutral: Column) -> Column:
    """Name of a Lab color's family; ``neutral`` is 'light', 'dark', 'neutral' or null. ``p`` should be a column,
    not an expression, as it is used many times."""
    # 28 and 38 part weak from strong chroma, 70 light from dark red, 0.48 and 0.62 weigh lightness.
    h, c = hue_degrees(p), chroma(p)
    weak = F.when((h >= 330) | (h < 15), F.when(p["l"] >= 70, "pink").otherwise("red"))
    for low, high, light, above, below in WEAK_FAMILIES:
        weak = F.when((h >= low) & (h < high), F.when(p["l"] >= light, above).otherwise(below)).otherwise(weak)
    ranked = []
    for order, (name, anchor) in enumerate(FAMILY_ANCHORS.items()):
        al, aa, ab = lab_of(anchor)
        dl = (p["l"] - al) * F.when(c < 38, 0.48).otherwise(0.62)
        d = F.sqrt(dl * dl + F.pow(p["a"] - aa, F.lit(2.0)) + F.pow(p["b"] - ab, F.lit(2.0)))
        if name in FAMILY_PULL:
            low, high, by = FAMILY_PULL[name]
            inside = ((h >= low) | (h < high)) if low > high else ((h >= low) & (h <= high))
            d = F.when(inside, d * by).otherwise(d)
        ranked.append(F.struct(d.alias("d"), F.lit(order).alias("o"), F.lit(name).alias("name")))
    strong = F.array_min(F.array(*ranked))["name"]
    return F.when(neutral == "light", "white").when(neutral == "dark", "black").when(neutral == "neutral", "gray").when(c < 28, weak).otherwise(strong)
