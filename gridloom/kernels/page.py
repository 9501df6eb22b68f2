"""Pages as bytes: SVG in eight layers, a PDF of the same shapes, PNG previews."""

from __future__ import annotations

import hashlib
import struct
import xml.etree.ElementTree as ET
import zlib

import numpy as np

from gridloom.functions.layout import CODES, POINTS_A_MM

# Layers in order, colours and widths of lines (pt).
LAYERS = ("regions", "blackout", "ink", "labels", "leaders", "legend", "title", "frame")
STROKE, STROKE_COLOUR, LEADER_STROKE, CORNER, DASH, TITLE_SIZE, FONTS = 0.3, "#999", 0.25, 1.5, 2.0, 10.0, "DejaVu Sans"


def number(v: float, decimals: int = 3) -> str:
    """Fixed decimals, ties by the exact binary value (half to even); minus zero is zero."""
    text = f"{v:.{decimals}f}"
    return text[1:] if text[0] == "-" and not text.strip("-0.") else text


def escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def hex_colour(rgb) -> str:
    return "#" + "".join(f"{round(255 * float(c)):02x}" for c in rgb)


def ink_on(rgb) -> str:
    return "#000" if 0.299 * rgb[0] + 0.587 * rgb[1] + 0.114 * rgb[2] > 0.55 else "#fff"


def path(cubics: np.ndarray, start: bool = True, close: bool = False) -> str:
    at = lambda p: f"{number(p[0])} {number(p[1])}"
    out = [f"M {at(cubics[0][0])}"] if start else []
    out += [f"C {at(c[1])} {at(c[2])} {at(c[3])}" for c in cubics]
    return " ".join(out + ["Z"] * close)


def walk_path(walk, curves: list[np.ndarray]) -> str:
    """A closed path along the arcs of a face's walk."""
    parts = [curves[a][::-1, ::-1] if back else curves[a] for a, back in walk]
    return " ".join([path(parts[0])] + [path(p, start=False) for p in parts[1:]] + ["Z"])


def svg(page_mm, curves, sides, closed, faces, labels, legend, palette, blackout=(), ink=(), title: str | None = None, chip: float = 28.35, box: float = 96.38, font: float = 11.0) -> bytes:
    """The page; the same input gives the same bytes.

    curves: cubics of each arc; sides: the two printed numbers of each arc (0: none); faces: walks by region; legend: places
    from place.legend; palette: sRGB of each colour.
    """
    w, h, m = (v * POINTS_A_MM for v in page_mm)
    n = number
    line = n(STROKE)
    out = [
        '<?xml version="1.0" encoding="UTF-8"?>',
        f'<svg xmlns="http://www.w3.org/2000/svg" version="1.1" width="{n(page_mm[0])}mm" height="{n(page_mm[1])}mm" viewBox="0 0 {n(w)} {n(h)}">',
        f'<g id="regions" fill="none" stroke="{STROKE_COLOUR}" stroke-width="{line}" stroke-linecap="round" stroke-linejoin="round">',
    ]
    out += [f'<path id="arc-{i}" data-left="{sides[i][0]}" data-right="{sides[i][1]}" d="{path(c, close=bool(closed[i]))}"/>' for i, c in enumerate(curves)]
    out += ["</g>", f'<g id="blackout" fill="{STROKE_COLOUR}" stroke="none" fill-rule="evenodd">']
    out += [f'<path id="blackout-{r}" d="{" ".join(walk_path(k, curves) for k in faces[r])}"/>' for r in sorted(blackout)]
    out += ["</g>", f'<g id="ink" fill="none" stroke="{STROKE_COLOUR}" stroke-width="{line}" stroke-linecap="round" stroke-linejoin="round">']
    out += [f'<polyline id="ink-{i}" points="{" ".join(f"{n(x)},{n(y)}" for x, y in p)}"/>' for i, p in enumerate(ink)]
    out += ["</g>", f'<g id="labels" font-family="{FONTS}" fill="#000" text-anchor="middle" dominant-baseline="central">']
    out += [f'<text id="label-{b.region}" x="{n(b.x)}" y="{n(b.y)}" font-size="{n(b.size)}">{code(b.number)}</text>' for b in labels]
    out += ["</g>", f'<g id="leaders" stroke="#000" stroke-width="{n(LEADER_STROKE)}">']
    out += [f'<line id="leader-{b.region}" x1="{n(b.x)}" y1="{n(b.y)}" x2="{n(b.from_x)}" y2="{n(b.from_y)}"/>' for b in labels if b.leader]
    out += ["</g>", f'<g id="legend" font-family="{FONTS}" font-size="{n(font)}" text-anchor="middle">']
    for i, (bx, by, _, _) in enumerate(legend):
        out.append(f'<rect id="name-box-{i}" x="{n(bx)}" y="{n(by)}" width="{n(box)}" height="{n(chip)}" rx="{n(CORNER)}" fill="none" stroke="#000" stroke-width="{line}" stroke-dasharray="{n(DASH)}"/>')
    for i, (_, _, cx, cy) in enumerate(legend):
        out.append(f'<rect id="chip-{i}" x="{n(cx)}" y="{n(cy)}" width="{n(chip)}" height="{n(chip)}" rx="{n(CORNER)}" fill="{hex_colour(palette[i])}" stroke="#000" stroke-width="{line}"/>')
        out.append(f'<text id="chip-number-{i}" x="{n(cx + chip / 2)}" y="{n(cy + chip / 2)}" dominant-baseline="central" fill="{ink_on(palette[i])}">{code(i + 1)}</text>')
    out += ["</g>", f'<g id="title" font-family="{FONTS}" font-size="{n(TITLE_SIZE)}" fill="#000">']
    if title is not None:
        out.append(f'<text id="title-text" x="{n(m)}" y="{n(m / 2)}" dominant-baseline="central">{escape(title)}</text>')
    out += ["</g>", f'<g id="frame" fill="none" stroke="#000" stroke-width="{line}">', f'<rect id="content-frame" x="{n(m)}" y="{n(m)}" width="{n(w - 2 * m)}" height="{n(h - 2 * m)}"/>', "</g>", "</svg>"]
    return ("\n".join(out) + "\n").encode()


def code(k: int) -> str:
    if not 1 <= k <= len(CODES):
        raise ValueError(f"no code for {k}")
    return CODES[k - 1]


def check_svg(data: bytes, n_arcs: int | None = None) -> str | None:
    """What is wrong with a page, or None: XML, version, size in mm, the layers in order, each arc once in order."""
    try:
        root = ET.fromstring(data)
    except ET.ParseError as e:
        return f"not well-formed: {e}"
    ns = "{http://www.w3.org/2000/svg}"
    if root.tag != ns + "svg" or root.get("version") != "1.1" or not root.get("viewBox"):
        return "not an SVG 1.1 root with a viewBox"
    if not all(root.get(k, "").endswith("mm") for k in ("width", "height")):
        return "the size is not in mm"
    if tuple(g.get("id") for g in root if g.tag == ns + "g") != LAYERS:
        return "the layers are not in order"
    if n_arcs is not None and [p.get("id") for p in root.find(f"{ns}g[@id='regions']")] != [f"arc-{i}" for i in range(n_arcs)]:
        return "not every arc once in order"
    return None


def fingerprint(data: bytes) -> str:
    """A hash of a page's structure: arcs with their sides and numbers of segments, labels and chips, without coordinates."""
    root = ET.fromstring(data)
    ns = "{http://www.w3.org/2000/svg}"
    rows = sorted(f"{p.get('data-left')} {p.get('data-right')} {p.get('d').count('C ')}" for p in root.find(f"{ns}g[@id='regions']"))
    texts = sorted(t.text or "" for t in root.find(f"{ns}g[@id='labels']"))
    return hashlib.sha256("\n".join([*rows, "", *texts]).encode()).hexdigest()


def pdf(page_mm, curves, closed, labels, legend, palette, chip: float = 28.35, box: float = 96.38, font: float = 11.0) -> bytes:
    """One page with the same lines, numbers and legend; text in the built-in Helvetica."""
    w, h, m = (v * POINTS_A_MM for v in page_mm)
    n = number
    flip = lambda p: f"{n(p[0])} {n(h - p[1])}"
    ops = [f"{n(STROKE)} w 1 J 1 j 0.6 G"]
    for c, ring in zip(curves, closed, strict=True):
        ops.append(" ".join([flip(c[0][0]), "m", *[f"{flip(s[1])} {flip(s[2])} {flip(s[3])} c" for s in c], "s" if ring else "S"]))
    text = lambda x, y, size, t, g: f"BT {g} g /F1 {n(size)} Tf {n(x - 0.278 * size)} {n(h - y - 0.36 * size)} Td ({t}) Tj ET"
    ops += [text(b.x, b.y, b.size, code(b.number), 0) for b in labels]
    ops += [f"{n(LEADER_STROKE)} w 0 G {flip((b.x, b.y))} m {flip((b.from_x, b.from_y))} l S" for b in labels if b.leader]
    for i, (bx, by, cx, cy) in enumerate(legend):
        ops.append(f"{n(STROKE)} w 0 G [{n(DASH)}] 0 d {n(bx)} {n(h - by - chip)} {n(box)} {n(chip)} re S [] 0 d")
        ops.append(" ".join(n(float(v)) for v in palette[i]) + f" rg {n(cx)} {n(h - cy - chip)} {n(chip)} {n(chip)} re B")
        ops.append(text(cx + chip / 2, cy + chip / 2, font, code(i + 1), 0 if ink_on(palette[i]) == "#000" else 1))
    ops.append(f"{n(STROKE)} w 0 G {n(m)} {n(m)} {n(w - 2 * m)} {n(h - 2 * m)} re S")
    body = zlib.compress("\n".join(ops).encode("latin-1"), 9)
    size = f"[0 0 {n(w)} {n(h)}]"
    parts = [
        b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>",
        f"<< /Type /Page /Parent 2 0 R /MediaBox {size} /TrimBox {size} /Resources << /Font << /F1 5 0 R >> >> /Contents 4 0 R >>".encode(),
        f"<< /Length {len(body)} /Filter /FlateDecode >>\nstream\n".encode() + body + b"\nendstream", b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>",
    ]
    out, at = b"%PDF-1.4\n", []
    for i, p in enumerate(parts):
        at.append(len(out))
        out += f"{i + 1} 0 obj\n".encode() + p + b"\nendobj\n"
    table = "".join(f"{a:010d} 00000 n \n" for a in at)
    return out + f"xref\n0 {len(parts) + 1}\n0000000000 65535 f \n{table}trailer\n<< /Size {len(parts) + 1} /Root 1 0 R >>\nstartxref\n{len(out)}\n%%EOF\n".encode()


def check_pdf(data: bytes, page_mm) -> str | None:
    """One page, a trim box of the page's size to 0.001 pt, a readable content stream; None if all hold."""
    import re

    if not data.startswith(b"%PDF-") or data.count(b"/Type /Page ") != 1:
        return "not a PDF file of one page"
    box = re.search(rb"/TrimBox \[([\d. ]+)\]", data)
    if not box or any(abs(float(v) - s * POINTS_A_MM) > 1e-3 for v, s in zip(box[1].split()[2:], page_mm, strict=False)):
        return "the trim box is not the page"
    try:
        zlib.decompress(data[data.index(b"stream\n") + 7 : data.index(b"\nendstream")])
    except (ValueError, zlib.error) as e:
        return f"damaged content: {e}"
    return None


def scanlines(rings: list[np.ndarray], h: int, w: int) -> np.ndarray:
    """The cells (h, w) whose centres lie inside the rings (x, y), by the even-odd rule."""
    a = np.concatenate(rings)
    b = np.concatenate([np.roll(r, -1, axis=0) for r in rings])
    out = np.zeros((h, w + 1), np.int64)
    low, high = np.minimum(a[:, 1], b[:, 1]), np.maximum(a[:, 1], b[:, 1])
    y0, y1 = np.clip(np.ceil(low - 0.5), 0, h).astype(int), np.clip(np.ceil(high - 0.5), 0, h).astype(int)
    n = np.maximum(y1 - y0, 0)
    e = np.repeat(np.arange(len(a)), n)
    y = np.arange(len(e)) - np.repeat(np.cumsum(n) - n, n) + y0[e]
    x = a[e, 0] + (y + 0.5 - a[e, 1]) * (b[e, 0] - a[e, 0]) / (b[e, 1] - a[e, 1])
    np.add.at(out, (y, np.clip(np.ceil(x - 0.5), 0, w).astype(int)), 1)
    return (out.cumsum(1)[:, :w] % 2).astype(bool)


def png(rgb: np.ndarray) -> bytes:
    """An 8-bit PNG file of (h, w, 3) bytes; the same pixels give the same file."""
    h, w, _ = rgb.shape
    raw = np.zeros((h, 1 + 3 * w), np.uint8)
    raw[:, 1:] = rgb.reshape(h, -1)
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw.tobytes(), 9)) + chunk(b"IEND", b"")


def solved_png(page_mm, rings: list[list[np.ndarray]], colours: list, dpi: float = 150.0, skip=(), lines: bool = False) -> bytes:
    """Faces filled with their colours, by region; holes and skipped faces are white. lines: borders in grey on top, without fill elsewhere."""
    f = dpi / 72
    h, w = round(page_mm[1] * POINTS_A_MM * f), round(page_mm[0] * POINTS_A_MM * f)
    out, owner = np.full((h, w, 3), 255, np.uint8), np.full((h, w), -1, np.int64)
    for i, face in enumerate(rings):
        low = np.maximum(np.floor(np.concatenate(face).min(0) * f).astype(int), 0)
        high = np.ceil(np.concatenate(face).max(0) * f).astype(int) + 1
        inside = scanlines([r * f - low for r in face], min(high[1], h) - low[1], min(high[0], w) - low[0])
        part = (slice(low[1], low[1] + inside.shape[0]), slice(low[0], low[0] + inside.shape[1]))
        owner[part][inside] = i
        if i not in skip and not lines:
            out[part][inside] = np.rint(np.asarray(colours[i]) * 255)
    if lines:
        edge = np.zeros((h, w), bool)
        edge[:, 1:] |= owner[:, 1:] != owner[:, :-1]
        edge[1:] |= owner[1:] != owner[:-1]
        out[edge] = 153
    return png(out)


def palette_png(palette, chip: int = 48, gap: int = 8, row: int = 6) -> bytes:
    """Chips of all colours, six in a row."""
    n = len(palette)
    out = np.full((-(-n // row) * (chip + gap) + gap, min(n, row) * (chip + gap) + gap, 3), 255, np.uint8)
    for i, c in enumerate(palette):
        y, x = gap + i // row * (chip + gap), gap + i % row * (chip + gap)
        out[y : y + chip, x : x + chip] = np.rint(np.asarray(c) * 255)
    return png(out)
