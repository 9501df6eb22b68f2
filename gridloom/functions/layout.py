"""Units, codes and text sizes as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

POINTS_A_MM = 72 / 25.4
# The printed codes of palette places 1 to 36, and a digit's width and height in font sizes.
CODES = "1234567890ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGIT_WIDTH, DIGIT_HEIGHT = 0.636, 0.729


def mm_to_pt(c: Column) -> Column:
    return c * POINTS_A_MM


def pt_to_mm(c: Column) -> Column:
    return c / POINTS_A_MM


def px_a_mm(scale: Column) -> Column:
    """Cells a mm from points a cell; 0 where no scale is set."""
    return F.when(scale > 0, POINTS_A_MM / scale).otherwise(0.0)


def content_box(width_mm: float, height_mm: float, margin_mm: float) -> tuple[float, float, float, float]:
    """(x, y, width, height) in pt inside the margins."""
    w, h = width_mm - 2 * margin_mm, height_mm - 2 * margin_mm
    if w <= 0 or h <= 0:
        raise ValueError("the margins leave no page")
    return margin_mm * POINTS_A_MM, margin_mm * POINTS_A_MM, w * POINTS_A_MM, h * POINTS_A_MM


def fixed(c: Column, decimals: int = 3) -> Column:
    """Text with fixed decimals as C prints it: by the exact binary value, ties to even; minus zero is zero. |c| < 2^52, decimals <= 3.

    The fraction's first 26 bits are scaled as a whole number, the rest as a double; both products are exact (but for
    fractions below 2^-17, far from any tie), so the sign of their sum's distance from one half is too.
    """
    ten, bit = 10**decimals, 1 << 26
    whole = F.floor(F.abs(c)).cast("bigint")
    f = F.abs(c) - whole.cast("double")
    head = F.floor(f * float(bit)).cast("bigint")
    t = head * ten
    q = F.shiftright(t, 26)
    off = (t.bitwiseAND(F.lit(bit - 1)) - bit // 2).cast("double") / float(bit) + (f - head.cast("double") / float(bit)) * float(ten)
    up = (off > 0) | ((off == 0) & (q % 2 == 1))
    k = whole * ten + q + up.cast("bigint")
    digits = F.concat(F.floor(k / ten).cast("string"), F.lit("."), F.lpad((k % ten).cast("string"), decimals, "0"))
    return F.concat(F.when((c < 0) & (k > 0), "-").otherwise(""), digits)


def escaped(c: Column) -> Column:
    """Text for XML."""
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def text_box(digits: Column, size: Column) -> tuple[Column, Column]:
    """Width and height of printed digits."""
    return digits * DIGIT_WIDTH * size, size * DIGIT_HEIGHT


def micro_size(radius: Column, digits: Column) -> Column:
    """A readable size (4.5) where the cell allows it, never across its border (0.16 kept free), 1 at least."""
    most = 2 * F.greatest(radius - 0.16, F.lit(0.0)) / F.sqrt(F.pow(digits * DIGIT_WIDTH, F.lit(2.0)) + DIGIT_HEIGHT**2)
    return F.greatest(F.least(F.greatest(fitted_size(radius, digits), F.lit(4.5)), most), F.lit(1.0))


def speck_floor(diameter_mm: Column, px_a_mm_: Column, divisor: int = 16) -> Column:
    """Cells below which a region is a speck."""
    return F.greatest(F.lit(4), F.floor(math.pi * F.pow(diameter_mm / 2 * px_a_mm_, F.lit(2.0)) / divisor).cast("int"))


def tolerance_scale(area: Column, diameter_mm: float) -> Column:
    """A factor of at most 1 for faces below nine times the least area (in pt; the diameter counts as 2.5 mm at least)."""
    least = math.pi * (max(diameter_mm, 2.5) / 2 * POINTS_A_MM) ** 2
    return F.least(F.lit(1.0), F.sqrt(F.greatest(area, F.lit(0.0)) / (9 * least)))


def stage_seed(seed: Column, stage: str, mark: str = "\x1f") -> Column:
    """The first 8 bytes of SHA-256 over seed, mark and stage, as an unsigned number's text."""
    return F.conv(F.substring(F.sha2(F.concat(seed.cast("string"), F.lit(mark + stage)).cast("binary"), 256), 1, 16), 16, 10)


def code_of(n: Column) -> Column:
    """The one-character code of place n (1 to 36); others raise."""
    return F.when(n.between(1, len(CODES)), F.substring(F.lit(CODES), n.cast("int"), F.lit(1))).otherwise(F.raise_error(F.concat(F.lit("no code for "), n.cast("string"))))


def fitted_size(radius: Column, digits: Column) -> Column:
    """The font size whose text box fits a circle of this radius less a margin of 0.8 pt."""
    return 2 * F.greatest(radius - 0.8, F.lit(0.0)) / F.sqrt(F.pow(digits * DIGIT_WIDTH, F.lit(2.0)) + DIGIT_HEIGHT**2)


def area_floor(diameter_mm: float, px_a_mm: float) -> float:
    return math.pi * (diameter_mm / 2) ** 2 * px_a_mm**2


def compactness(area: Column, perimeter: Column) -> Column:
    return 4 * math.pi * area / F.nullif(perimeter * perimeter, F.lit(0))


def compact_area(area: Column, perimeter: Column) -> Column:
    """The area, or that of the disk with twice its hydraulic radius if that is less."""
    return F.least(area, math.pi * F.pow(2 * area / F.nullif(perimeter, F.lit(0)), F.lit(2.0)))


def letterbox(width: int, height: int, box_w: float, box_h: float, margin_x: float, margin_y: float):
    """(scale, x -> pt, y -> pt) for corners in doubled, shifted cell coordinates."""
    scale = min(box_w / width, box_h / height)
    left, top = margin_x + (box_w - scale * width) / 2, margin_y + (box_h - scale * height) / 2
    return scale, lambda c: left + (c + 1) * (scale / 2), lambda c: top + (c + 1) * (scale / 2)
