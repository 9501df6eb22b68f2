"""Colour science on arrays; the Column forms are in functions/color.py and share its fixed values."""

from __future__ import annotations

import numpy as np

from gridloom.functions.color import JOINT, RGB_TO_XYZ, WHITE, XYZ_TO_RGB


def lab_of(rgb: np.ndarray) -> np.ndarray:
    """(..., 3) sRGB in [0, 1] to CIELAB; values outside are clipped first."""
    c = np.clip(rgb.astype(np.float64), 0, 1)
    linear = np.where(c <= 0.04045, c / 12.92, ((c + 0.055) / 1.055) ** 2.4)
    t = linear @ np.array(RGB_TO_XYZ).T / np.array(WHITE)
    f = np.where(t > JOINT**3, np.cbrt(t), t / (3 * JOINT**2) + 4 / 29)
    return np.stack((116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])), -1)


def rgb_of(lab: np.ndarray) -> np.ndarray:
    fy = (lab[..., 0] + 16) / 116
    f = np.stack((fy + lab[..., 1] / 500, fy, fy - lab[..., 2] / 200), -1)
    xyz = np.where(f > JOINT, f**3, 3 * JOINT**2 * (f - 4 / 29)) * np.array(WHITE)
    v = np.maximum(0, xyz @ np.array(XYZ_TO_RGB).T)
    return np.clip(np.where(v <= 0.0031308, 12.92 * v, 1.055 * v ** (1 / 2.4) - 0.055), 0, 1)


def delta_e_2000(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """CIEDE2000 of broadcast arrays (..., 3), with hue 0 at zero chroma."""
    (l1, a1, b1), (l2, a2, b2) = (np.moveaxis(np.asarray(v, float), -1, 0) for v in (p, q))
    seven = lambda c: c**7 / (c**7 + 25.0**7)
    stretch = 1.5 - 0.5 * np.sqrt(seven((np.hypot(a1, b1) + np.hypot(a2, b2)) / 2))
    a1, a2 = a1 * stretch, a2 * stretch
    c1, c2 = np.hypot(a1, b1), np.hypot(a2, b2)
    h1, h2 = (np.where(c == 0, 0, np.degrees(np.arctan2(b, a)) % 360) for a, b, c in ((a1, b1, c1), (a2, b2, c2)))
    grey, total = c1 * c2 == 0, h1 + h2
    turn = np.where(grey, 0, (h2 - h1 + 180) % 360 - 180)
    turn = np.where((turn == -180) & (h2 - h1 == 180), 180, turn)
    dh = 2 * np.sqrt(c1 * c2) * np.sin(np.radians(turn) / 2)
    h = np.where(grey, total, np.where(np.abs(h1 - h2) <= 180, total / 2, np.where(total < 360, (total + 360) / 2, (total - 360) / 2)))
    cos = lambda k, off: np.cos(np.radians(k * h + off))
    t = 1 - 0.17 * cos(1, -30) + 0.24 * cos(2, 0) + 0.32 * cos(3, 6) - 0.2 * cos(4, -63)
    off, chroma = ((l1 + l2) / 2 - 50) ** 2, (c1 + c2) / 2
    kl, kc, kh = (l2 - l1) / (1 + 0.015 * off / np.sqrt(20 + off)), (c2 - c1) / (1 + 0.045 * chroma), dh / (1 + 0.015 * chroma * t)
    twist = -2 * np.sqrt(seven(chroma)) * np.sin(np.radians(60 * np.exp(-(((h - 275) / 25) ** 2))))
    return np.sqrt(kl * kl + kc * kc + kh * kh + twist * kc * kh)


def table(lab: np.ndarray) -> np.ndarray:
    """All differences of a palette."""
    return delta_e_2000(lab[:, None, :], lab[None, :, :])
