"""Colour columns: sRGB and CIELAB (D65), differences and names."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# The IEC sRGB primaries, the D65 white point and CIE's constants.
RGB_TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
WHITE = (0.95047, 1.00000, 1.08883)
EPSILON, KAPPA = 216.0 / 24389.0, 24389.0 / 27.0
XYZ_TO_RGB = tuple(map(tuple, np.linalg.inv(np.array(RGB_TO_XYZ)).tolist()))
# The rules of colour names, by lightness L, chroma C and hue h in degrees, in order.
NAME_RULES = {
    "black": "L < 20",
    "white": "L >= 78 and C < 15",
    "gray": "C < 10 and L >= 20 and L < 78",
    "red": "C >= 12 and h >= 8 and h < 45",
    "orange": "C >= 20 and h >= 45 and h < 72 and L >= 38",
    "yellow": "C >= 18 and h >= 72 and h < 110",
    "green": "C >= 10 and h >= 110 and h < 200",
    "blue": "C >= 8 and h >= 200 and h < 300",
    "purple": "C >= 10 and h >= 300 and h < 340",
    "brown": "h >= 8 and h < 70 and L < 48 and C >= 8 and C < 42",
    "skin": "h >= 20 and h < 60 and L >= 55 and L < 82 and C >= 8 and C < 33",
}


def srgb_to_lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """L, a and b of colours with components 0..255."""

    def linear(v: Column) -> Column:
        a = v.cast("double") / 255.0
        return F.when(a <= 0.04045, a / 12.92).otherwise(F.pow((a + 0.055) / 1.055, F.lit(2.4)))

    rgb = [linear(v) for v in (r, g, b)]

    def bent(row: int) -> Column:
        t = sum((F.lit(RGB_TO_XYZ[row][i]) * rgb[i] for i in range(1, 3)), F.lit(RGB_TO_XYZ[row][0]) * rgb[0]) / WHITE[row]
        return F.when(t > EPSILON, F.cbrt(t)).otherwise((KAPPA * t + 16.0) / 116.0)

    fx, fy, fz = (bent(i) for i in range(3))
    return 116.0 * fy - 16.0, 500.0 * (fx - fy), 200.0 * (fy - fz)


def lab_to_srgb(lightness: Column, a: Column, b: Column) -> tuple[Column, Column, Column]:
    """Components 0..255, clipped and truncated."""
    fy = (lightness + 16.0) / 116.0
    fx, fz = fy + a / 500.0, fy - b / 200.0

    def cube(f: Column) -> Column:
        c = f * f * f
        return F.when(c > EPSILON, c).otherwise((116.0 * f - 16.0) / KAPPA)

    xyz = [cube(fx) * WHITE[0], F.when(lightness > KAPPA * EPSILON, fy * fy * fy).otherwise(lightness / KAPPA) * WHITE[1], cube(fz) * WHITE[2]]

    def component(row: int) -> Column:
        v = sum((F.lit(XYZ_TO_RGB[row][i]) * xyz[i] for i in range(1, 3)), F.lit(XYZ_TO_RGB[row][0]) * xyz[0])
        s = F.when(v <= 0.0031308, 12.92 * v).otherwise(1.055 * F.pow(F.greatest(v, F.lit(0.0)), F.lit(1.0 / 2.4)) - 0.055)
        return F.floor(F.least(F.greatest(s * 255.0, F.lit(0.0)), F.lit(255.0))).cast("int")

    return component(0), component(1), component(2)


def delta_e(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    """CIE76: the Euclidean distance of two Lab colours."""
    d = [x - y for x, y in zip(a, b, strict=True)]
    return F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])


def chroma(a: Column, b: Column) -> Column:
    return F.sqrt(a * a + b * b)


def hue(a: Column, b: Column) -> Column:
    """Degrees in [0, 360)."""
    return F.pmod(F.degrees(F.atan2(b, a)), F.lit(360.0))


def color_classes(lightness: Column, a: Column, b: Column) -> Column:
    """All names whose rule the colour meets, in order."""
    lch = F.struct(lightness.alias("L"), chroma(a, b).alias("C"), hue(a, b).alias("h"))

    def rule(text: str, v: Column) -> Column:
        out = None
        for part in text.split(" and "):
            name, sign, value = part.split()
            c = v[name] < float(value) if sign == "<" else v[name] >= float(value)
            out = c if out is None else out & c
        return out

    return F.element_at(F.transform(F.array(lch), lambda v: F.array_compact(F.array(*(F.when(rule(t, v), n) for n, t in NAME_RULES.items())))), 1)


def primary_color(lightness: Column, a: Column, b: Column) -> Column:
    return F.coalesce(F.get(color_classes(lightness, a, b), F.lit(0)), F.lit("gray"))
