"""Colour science as Column expressions: sRGB, CIELAB (D65) and colour differences. Nothing here leaves codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The sRGB to XYZ matrix, its inverse's digits follow from it; the D65 white; joints of the transfer curves.
RGB_TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
WHITE = (0.95047, 1.0, 1.08883)
JOINT = 6 / 29


def _inverse(m):
    (a, b, c), (d, e, f), (g, h, i) = m
    det = a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    rows = ((e * i - f * h, c * h - b * i, b * f - c * e), (f * g - d * i, a * i - c * g, c * d - a * f), (d * h - e * g, b * g - a * h, a * e - b * d))
    return tuple(tuple(v / det for v in r) for r in rows)


XYZ_TO_RGB = _inverse(RGB_TO_XYZ)


def _dot(row, cols):
    return sum((F.lit(k) * c for k, c in zip(row[1:], cols[1:], strict=True)), F.lit(row[0]) * cols[0])


def lab_of(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """(L, a, b) of sRGB channels in [0, 1]; values outside are clipped first."""
    linear = []
    for c in (r, g, b):
        c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), c.cast("double")))
        linear.append(F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4))))
    f = []
    for row, w in zip(RGB_TO_XYZ, WHITE, strict=True):
        t = _dot(row, linear) / w
        f.append(F.when(t > JOINT**3, F.cbrt(t)).otherwise(t / (3 * JOINT**2) + 4 / 29))
    return 116 * f[1] - 16, 500 * (f[0] - f[1]), 200 * (f[1] - f[2])


def rgb_of(l: Column, a: Column, b: Column) -> tuple[Column, Column, Column]:  # noqa: E741
    """sRGB channels of (L, a, b), clipped to the gamut."""
    fy = (l + 16) / 116
    xyz = [F.when(t > JOINT, t * t * t).otherwise(3 * JOINT**2 * (t - 4 / 29)) * w for t, w in zip((fy + a / 500, fy, fy - b / 200), WHITE, strict=True)]
    out = []
    for row in XYZ_TO_RGB:
        v = F.greatest(F.lit(0.0), _dot(row, xyz))
        v = F.when(v <= 0.0031308, 12.92 * v).otherwise(1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055)
        out.append(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)))
    return out[0], out[1], out[2]


def delta_e_76(p, q) -> Column:
    return F.sqrt(sum((F.pow(x - y, F.lit(2.0)) for x, y in zip(p, q, strict=True)), F.lit(0.0)))


def delta_e_2000(p, q) -> Column:
    """CIEDE2000 of two (L, a, b), with hue 0 at zero chroma (Sharma, Wu and Dalal 2005)."""
    (l1, a1, b1), (l2, a2, b2) = p, q
    seven = lambda c: F.pow(c, F.lit(7.0)) / (F.pow(c, F.lit(7.0)) + 25.0**7)
    mean = (F.hypot(a1, b1) + F.hypot(a2, b2)) / 2
    stretch = 1.5 - 0.5 * F.sqrt(seven(mean))
    a1, a2 = a1 * stretch, a2 * stretch
    c1, c2 = F.hypot(a1, b1), F.hypot(a2, b2)
    hue = lambda a, b, c: F.when(c == 0, 0.0).otherwise(F.pmod(F.degrees(F.atan2(b, a)), F.lit(360.0)))
    h1, h2 = hue(a1, b1, c1), hue(a2, b2, c2)
    grey = c1 * c2 == 0
    turn = F.when(h2 - h1 > 180, h2 - h1 - 360).when(h2 - h1 < -180, h2 - h1 + 360).otherwise(h2 - h1)
    dh = 2 * F.sqrt(c1 * c2) * F.sin(F.radians(F.when(grey, 0.0).otherwise(turn)) / 2)
    total = h1 + h2
    h = F.when(grey, total).when(F.abs(h1 - h2) <= 180, total / 2).when(total < 360, (total + 360) / 2).otherwise((total - 360) / 2)
    cos = lambda k, off: F.cos(F.radians(k * h + off))
    t = 1 - 0.17 * cos(1, -30) + 0.24 * cos(2, 0) + 0.32 * cos(3, 6) - 0.2 * cos(4, -63)
    light, chroma = (l1 + l2) / 2, (c1 + c2) / 2
    off = F.pow(light - 50, F.lit(2.0))
    kl = (l2 - l1) / (1 + 0.015 * off / F.sqrt(20 + off))
    kc = (c2 - c1) / (1 + 0.045 * chroma)
    kh = dh / (1 + 0.015 * chroma * t)
    twist = -2 * F.sqrt(seven(chroma)) * F.sin(F.radians(60 * F.exp(-F.pow((h - 275) / 25, F.lit(2.0)))))
    return F.sqrt(kl * kl + kc * kc + kh * kh + twist * kc * kh)


def hex_of(r: Column, g: Column, b: Column) -> Column:
    """#rrggbb; halves round to even."""
    part = lambda c: F.lpad(F.lower(F.hex(F.bround(c * 255).cast("int"))), 2, "0")
    return F.concat(F.lit("#"), part(r), part(g), part(b))


def ink_on(r: Column, g: Column, b: Column) -> Column:
    """Black on light colours, white on dark ones."""
    return F.when(0.299 * r + 0.587 * g + 0.114 * b > 0.55, "black").otherwise("white")
