"""Rasters of two renders: registration by phase correlation, ink difference, connected residuals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

INK, RESIDUAL, LEAST_AREA, BORDER, MOST_SHARE, MAX_PIXELS = 128, 40, 400, 0.05, 0.25, 20_000_000
#: Agreement of ink at which no turn is looked for.
SURE = 0.9


def ink_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """How much of two images' ink is the same; 0 without ink."""
    one, two = a < INK, b < INK
    union = (one | two).sum()
    return float((one & two).sum() / union) if union else 0.0


def shift_of(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """The (dx, dy) by which b is a moved, by phase correlation."""
    one, two = np.fft.rfft2(255.0 - a), np.fft.rfft2(255.0 - b)
    cross = two * np.conj(one)
    peak = np.fft.irfft2(cross / np.maximum(np.abs(cross), 1e-9), a.shape)
    dy, dx = np.unravel_index(int(peak.argmax()), a.shape)
    h, w = a.shape
    return int(dx - w if dx > w // 2 else dx), int(dy - h if dy > h // 2 else dy)


def moved(a: np.ndarray, dx: int, dy: int, fill: int = 255) -> np.ndarray:
    out = np.full_like(a, fill)
    h, w = a.shape
    out[max(0, dy) : h + min(0, dy), max(0, dx) : w + min(0, dx)] = a[max(0, -dy) : h + min(0, -dy), max(0, -dx) : w + min(0, -dx)]
    return out


Matrix = tuple[float, float, float, float, float, float]
STILL: Matrix = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)


def warped(a: np.ndarray, m: Matrix, fill: int = 255) -> np.ndarray:
    """a with each pixel (x, y) at (m0 x + m1 y + m2, m3 x + m4 y + m5), between pixels by the four around."""
    h, w = a.shape
    back = np.linalg.inv(np.array([[m[0], m[1], m[2]], [m[3], m[4], m[5]], [0, 0, 1]]))
    y, x = np.mgrid[0:h, 0:w]
    sx, sy = back[0, 0] * x + back[0, 1] * y + back[0, 2], back[1, 0] * x + back[1, 1] * y + back[1, 2]
    x0, y0 = np.floor(sx + 1e-6).astype(int), np.floor(sy + 1e-6).astype(int)
    fx, fy = np.clip(sx - x0, 0, 1), np.clip(sy - y0, 0, 1)
    padded = np.pad(a.astype(float), 1, constant_values=fill)
    at = lambda i, j: padded[np.clip(j + 1, 0, h + 1), np.clip(i + 1, 0, w + 1)]
    out = (at(x0, y0) * (1 - fx) + at(x0 + 1, y0) * fx) * (1 - fy) + (at(x0, y0 + 1) * (1 - fx) + at(x0 + 1, y0 + 1) * fx) * fy
    return np.rint(out).astype(a.dtype)


def turn_of(a: np.ndarray, b: np.ndarray, angles: int = 720, radii: int = 256) -> tuple[float, float]:
    """The angle in radians, up to a quarter turn either way, and the scale by which b is a turned and sized.

    Where a picture lies doesn't change its spectrum's magnitude; on a grid of angles and logarithms of the distance from
    the middle, turning and sizing move the magnitude along, which phase correlation finds.
    """
    n = 1 << int(max(a.shape) - 1).bit_length()
    window = np.outer(np.hanning(a.shape[0]), np.hanning(a.shape[1]))
    grid_a, grid_r = np.meshgrid(np.arange(angles) * np.pi / angles - np.pi / 2, np.arange(radii), indexing="ij")
    base = (n / 2) ** (1 / radii)
    r = base**grid_r
    x, y = np.rint(n / 2 + r * np.cos(grid_a)).astype(int) % n, np.rint(n / 2 + r * np.sin(grid_a)).astype(int) % n

    def polar(image: np.ndarray) -> np.ndarray:
        spectrum = np.fft.fftshift(np.abs(np.fft.fft2((255.0 - image) * window, (n, n))))
        return np.log1p(spectrum)[y, x] * (r > 4)

    one, two = np.fft.rfft2(polar(a)), np.fft.rfft2(polar(b))
    cross = two * np.conj(one)
    peak = np.fft.irfft2(cross / np.maximum(np.abs(cross), 1e-9), (angles, radii))
    da, dr = np.unravel_index(int(peak.argmax()), peak.shape)
    da, dr = da - angles if da > angles // 2 else da, dr - radii if dr > radii // 2 else dr
    return float(da * np.pi / angles), float(base**-dr)


def registration(a: np.ndarray, b: np.ndarray, least: float = 0.35) -> dict:
    """How a maps onto b: method, matrix over pixels, confidence (the share of ink that then agrees) and whether that is
    accepted. Of lying still, moving, and turning and sizing about the middle before moving, the best is taken; the
    simpler one of equals."""
    if a.shape != b.shape or not (a < INK).any() or not (b < INK).any():
        return {"method": "none", "matrix": STILL, "confidence": 0.0, "accepted": False}
    tried = [("identity", STILL)]
    dx, dy = shift_of(a, b)
    tried.append(("phase", (1.0, 0.0, float(dx), 0.0, 1.0, float(dy))))
    if max(ink_jaccard(warped(a, m), b) for _, m in tried) < SURE:
        angle, scale = turn_of(a, b)
        c, s = scale * np.cos(angle), scale * np.sin(angle)
        mx, my = (a.shape[1] - 1) / 2, (a.shape[0] - 1) / 2
        turned = (c, -s, mx - c * mx + s * my, s, c, my - s * mx - c * my)
        dx, dy = shift_of(warped(a, turned), b)
        tried.append(("log_polar", (*turned[:2], turned[2] + dx, *turned[3:5], turned[5] + dy)))
    scored = [(ink_jaccard(warped(a, m), b), -k, method, m) for k, (method, m) in enumerate(tried)]
    confidence, _, method, matrix = max(scored)
    return {"method": method, "matrix": tuple(map(float, matrix)), "confidence": confidence, "accepted": confidence >= least}


def _shrunk(x: np.ndarray, of) -> np.ndarray:
    fill = of is np.minimum
    p = np.pad(x, 1, constant_values=fill)
    rows = of(of(p[:-2], p[1:-1]), p[2:])
    return of(of(rows[:, :-2], rows[:, 1:-1]), rows[:, 2:])


def cleaned(mask: np.ndarray) -> np.ndarray:
    """Opened once and closed twice with a square of three."""
    x = _shrunk(_shrunk(mask, np.minimum), np.maximum)
    for of in (np.maximum, np.maximum, np.minimum, np.minimum):
        x = _shrunk(x, of)
    return x


def labelled(mask: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(area, x0, y0, x1, y1) of the components of 8 neighbours, by runs of rows and union-find."""
    parent: list[int] = []
    runs: list[tuple[int, int, int]] = []

    def find(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    last: list[int] = []
    for y, row in enumerate(mask):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], row.astype(np.int8), [0]])))
        own = []
        for x0, x1 in zip(edges[::2].tolist(), edges[1::2].tolist()):
            k = len(runs)
            runs.append((y, x0, x1))
            parent.append(k)
            for j in last:
                if runs[j][1] <= x1 and x0 <= runs[j][2]:
                    a, b = find(j), find(k)
                    parent[max(a, b)] = min(a, b)
            own.append(k)
        last = own
    out: dict[int, list[int]] = {}
    for k, (y, x0, x1) in enumerate(runs):
        o = out.setdefault(find(k), [0, x0, y, x1, y + 1])
        out[find(k)] = [o[0] + x1 - x0, min(o[1], x0), min(o[2], y), max(o[3], x1), max(o[4], y + 1)]
    return sorted(map(tuple, out.values()), reverse=True)


def residuals(a: np.ndarray, b: np.ndarray, matrix: Matrix = STILL, least: int = LEAST_AREA) -> list[dict]:
    """Ink that only b has (added) and only a has (removed), with a mapped by a matrix, as boxes in the unit square."""
    one, two = warped(a, matrix).astype(np.int16), b.astype(np.int16)
    h, w = b.shape
    bx, by = int(w * BORDER), int(h * BORDER)
    out = []
    for kind, diff in (("added", one - two), ("removed", two - one)):
        mask = cleaned(diff > RESIDUAL)
        inner = np.zeros_like(mask)
        inner[by : h - by, bx : w - bx] = mask[by : h - by, bx : w - bx]
        for area, x0, y0, x1, y1 in labelled(inner):
            if area >= least and (x1 - x0) * (y1 - y0) <= MOST_SHARE * w * h:
                out.append({"change_type": kind, "area": area, "x0": x0 / w, "y0": y0 / h, "x1": x1 / w, "y1": y1 / h})
    return out


PIXELS = ", ".join(f"p{k} double" for k in range(6))
RESIDUAL_COLUMNS = "change_type string, area long, x0 double, y0 double, x1 double, y1 double"


def _over_pages(pages: DataFrame, key: list[str], schema: str, of) -> DataFrame:
    """of(a, b, row) for each row of pages (key, width, height, pixels_a, pixels_b: grey bytes, row by row), as rows of schema.
    Images over the pixel cap, and those whose bytes don't fit their size, have None for a and b."""
    own = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pages.select(*key).schema)
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for p in batch.itertuples(index=False):
                fits = p.width * p.height <= MAX_PIXELS and all(x is not None and len(x) == p.width * p.height for x in (p.pixels_a, p.pixels_b))
                a, b = (np.frombuffer(x, np.uint8).reshape(p.height, p.width) if fits else None for x in (p.pixels_a, p.pixels_b))
                rows += [[getattr(p, k) for k in key] + [r[n] for n in names] for r in of(a, b, p)]
            yield pd.DataFrame(rows, columns=[*key, *names])

    return pages.mapInPandas(run, f"{own}, {schema}")


def page_registrations(pages: DataFrame, key: list[str]) -> DataFrame:
    """(key, method, confidence, accepted, width, height, p0 .. p5) for pages (key, width, height, pixels_a, pixels_b)."""

    def found(a, b, row) -> list[dict]:
        r = registration(a, b) if a is not None else {"method": "none", "matrix": STILL, "confidence": 0.0, "accepted": False}
        return [{**r, "width": row.width, "height": row.height} | {f"p{k}": v for k, v in enumerate(r["matrix"])}]

    return _over_pages(pages, key, f"method string, confidence double, accepted boolean, width int, height int, {PIXELS}", found)


def page_residuals(pages: DataFrame, key: list[str]) -> DataFrame:
    """(key, RESIDUAL_COLUMNS) for pages (key, width, height, pixels_a, pixels_b, p0 .. p5)."""
    found = lambda a, b, row: [] if a is None else residuals(a, b, tuple(getattr(row, f"p{k}") for k in range(6)))
    return _over_pages(pages, key, RESIDUAL_COLUMNS, found)


def deskewed(a: np.ndarray, least: float = 0.2, most: float = 15.0) -> np.ndarray:
    """A scan turned so that its lines of text lie level: of the angles in degrees whose rows of ink differ most, if it is within bounds."""
    ink = (a < INK).astype(np.uint8) * 255
    y, x = np.nonzero(ink)
    if len(x) < 2:
        return a

    def sharpness(angle: float) -> float:
        rows = np.rint(y * np.cos(np.radians(angle)) - x * np.sin(np.radians(angle))).astype(int)
        return float((np.bincount(rows - rows.min()).astype(float) ** 2).sum())

    coarse = max(np.arange(-most, most + 0.5, 0.5), key=lambda g: (sharpness(g), -abs(g)))
    angle = max(np.arange(coarse - 0.5, coarse + 0.51, 0.05), key=lambda g: (sharpness(g), -abs(g)))
    if not least < abs(angle) < most:
        return a
    c, s, mx, my = np.cos(np.radians(angle)), np.sin(np.radians(angle)), (a.shape[1] - 1) / 2, (a.shape[0] - 1) / 2
    return warped(a, (c, s, mx - c * mx - s * my, -s, c, my + s * mx - c * my))


def equalised(a: np.ndarray, tiles: int = 8, clip: float = 2.0) -> np.ndarray:
    """Contrast evened out tile by tile, where a tile's histogram is clipped at ``clip`` times its mean and mapped between tiles' middles."""
    h, w = a.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    maps = np.empty((tiles, tiles, 256))
    padded = np.pad(a, ((0, th * tiles - h), (0, tw * tiles - w)), mode="edge")
    for i in range(tiles):
        for j in range(tiles):
            n = np.bincount(padded[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel(), minlength=256).astype(float)
            top = max(1.0, clip * n.mean())
            n = np.minimum(n, top) + np.maximum(n - top, 0).sum() / 256
            maps[i, j] = np.cumsum(n) * 255 / n.sum()
    y, x = (np.clip((np.arange(n) + 0.5) / t - 0.5, 0, tiles - 1) for n, t in ((h, th), (w, tw)))
    y0, x0 = np.minimum(y.astype(int), tiles - 2), np.minimum(x.astype(int), tiles - 2)
    fy, fx = (y - y0)[:, None], (x - x0)[None]
    at = lambda i, j: maps[(y0 + i)[:, None], (x0 + j)[None], a]
    return np.rint((at(0, 0) * (1 - fx) + at(0, 1) * fx) * (1 - fy) + (at(1, 0) * (1 - fx) + at(1, 1) * fx) * fy).astype(np.uint8)
