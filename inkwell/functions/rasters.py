"""Grey rasters as numpy arrays (0 black, 255 white): kernels for use inside Arrow UDFs."""

from __future__ import annotations

import numpy as np


def otsu(grey: np.ndarray) -> int:
    """Threshold of the largest between-class variance; the first of ties."""
    n = np.bincount(grey.ravel().astype(int), minlength=256).astype(float)
    below, mass = np.cumsum(n), np.cumsum(n * np.arange(256))
    above = below[-1] - below
    ok = (below > 0) & (above > 0)
    if not ok.any():
        return int(grey.flat[0])
    var = np.zeros(256)
    var[ok] = below[ok] * above[ok] * (mass[ok] / below[ok] - (mass[-1] - mass[ok]) / above[ok]) ** 2
    return int(np.argmax(np.round(var, 6)))


def resized(grey: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear sampling at pixel centres."""
    y = np.clip((np.arange(height) + 0.5) * grey.shape[0] / height - 0.5, 0, grey.shape[0] - 1)
    x = np.clip((np.arange(width) + 0.5) * grey.shape[1] / width - 0.5, 0, grey.shape[1] - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, grey.shape[0] - 1), np.minimum(x0 + 1, grey.shape[1] - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None]
    top = grey[y0][:, x0] * (1 - fx) + grey[y0][:, x1] * fx
    return top * (1 - fy) + (grey[y1][:, x0] * (1 - fx) + grey[y1][:, x1] * fx) * fy


def ink_canvas(grey: np.ndarray, side: int = 224, margin: int = 8) -> np.ndarray:
    """Ink between 0 and 1 on a square: soft background removal, tight crop, aspect kept."""
    level = otsu(grey)
    ink = np.clip((level + 20 - grey.astype(float)) / 40, 0, 1) * (255 - grey) / 255
    rows, cols = np.flatnonzero((ink > 0.05).any(1)), np.flatnonzero((ink > 0.05).any(0))
    out = np.zeros((side, side))
    if not len(rows):
        return out
    ink = ink[max(0, rows[0] - margin) : rows[-1] + 1 + margin, max(0, cols[0] - margin) : cols[-1] + 1 + margin]
    scale = side / max(ink.shape)
    h, w = max(1, round(ink.shape[0] * scale)), max(1, round(ink.shape[1] * scale))
    y, x = (side - h) // 2, (side - w) // 2
    out[y : y + h, x : x + w] = resized(ink, h, w)
    return out


def binary_canvas(grey: np.ndarray, height: int = 128, width: int = 256) -> np.ndarray:
    """Black on white at the threshold, scaled with its aspect and centred on a white canvas."""
    scale = min(height / grey.shape[0], width / grey.shape[1])
    h, w = max(1, round(grey.shape[0] * scale)), max(1, round(grey.shape[1] * scale))
    out = np.full((height, width), 255.0)
    y, x = (height - h) // 2, (width - w) // 2
    out[y : y + h, x : x + w] = np.where(resized(grey, h, w) > otsu(grey), 255.0, 0.0)
    return out


def ink_patches(ink: np.ndarray, size: int = 14, least: float = 0.08) -> np.ndarray:
    """By patch: whether its mean ink is above ``least``."""
    h, w = ink.shape[0] // size, ink.shape[1] // size
    return ink[: h * size, : w * size].reshape(h, size, w, size).mean((1, 3)).ravel() > least


def principal_axis(ink: np.ndarray, least: float = 0.05) -> tuple[float, float, float]:
    """(angle in degrees within ±90, centre x, centre y) of the inked pixels."""
    y, x = np.nonzero(ink > least)
    if len(x) < 2:
        return 0.0, ink.shape[1] / 2, ink.shape[0] / 2
    cov = np.cov(x, y)
    return float(np.degrees(0.5 * np.arctan2(2 * cov[0, 1], cov[0, 0] - cov[1, 1]))), float(x.mean()), float(y.mean())


def aligned(moving: np.ndarray, fixed: np.ndarray) -> np.ndarray:
    """``moving`` turned by the difference of the principal angles about its centre and shifted onto ``fixed``."""
    (a, ax, ay), (b, bx, by) = principal_axis(moving), principal_axis(fixed)
    t = np.radians(b - a)
    yy, xx = np.mgrid[: fixed.shape[0], : fixed.shape[1]].astype(float)
    dx, dy = xx - round(bx), yy - round(by)
    x, y = np.cos(t) * dx + np.sin(t) * dy + ax, -np.sin(t) * dx + np.cos(t) * dy + ay
    inside = (x >= 0) & (y >= 0) & (x <= moving.shape[1] - 1) & (y <= moving.shape[0] - 1)
    x, y = np.clip(x, 0, moving.shape[1] - 1), np.clip(y, 0, moving.shape[0] - 1)
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    x1, y1 = np.minimum(x0 + 1, moving.shape[1] - 1), np.minimum(y0 + 1, moving.shape[0] - 1)
    fx, fy = x - x0, y - y0
    value = (moving[y0, x0] * (1 - fx) + moving[y0, x1] * fx) * (1 - fy) + (moving[y1, x0] * (1 - fx) + moving[y1, x1] * fx) * fy
    return np.where(inside, value, 0.0)


def ink_aspect(mask: np.ndarray) -> float:
    """Width over height of the box around the ink, 0 without any."""
    y, x = np.nonzero(mask)
    return float((np.ptp(x) + 1) / (np.ptp(y) + 1)) if len(x) else 0.0


def window_extreme(mask: np.ndarray, radius: int, most: bool = True) -> np.ndarray:
    """Maximum (or minimum) over a square of side 2 ``radius`` + 1: dilation and erosion."""
    out = np.pad(mask, radius, mode="edge")
    pick = np.maximum if most else np.minimum
    for axis in (0, 1):
        n = mask.shape[axis]
        parts = [np.take(out, range(k, k + n), axis=axis) for k in range(2 * radius + 1)]
        out = parts[0]
        for p in parts[1:]:
            out = pick(out, p)
    return out


def ink_union(a: np.ndarray, b: np.ndarray, reach: int = 7, least: float = 0.05) -> np.ndarray:
    return window_extreme((a > least) | (b > least), reach)


def smoothed(x: np.ndarray, taps: int = 11, sigma: float = 1.5) -> np.ndarray:
    k = np.exp(-((np.arange(taps) - taps // 2) ** 2) / (2 * sigma**2))
    k /= k.sum()
    for axis in (0, 1):
        x = np.apply_along_axis(lambda v: np.convolve(v, k, "same"), axis, x)
    return x


def masked_ssim(a: np.ndarray, b: np.ndarray, mask: np.ndarray | None = None, c1: float = 1e-4, c2: float = 9e-4) -> float:
    """Mean structural similarity over a mask: 0 for an empty one, everywhere without one."""
    ma, mb = smoothed(a), smoothed(b)
    va, vb, cov = smoothed(a * a) - ma * ma, smoothed(b * b) - mb * mb, smoothed(a * b) - ma * mb
    s = (2 * ma * mb + c1) * (2 * cov + c2) / ((ma**2 + mb**2 + c1) * (va + vb + c2))
    if mask is None:
        return float(s.mean())
    return float(s[mask].mean()) if mask.any() else 0.0


def longest_runs(mask: np.ndarray, axis: int = 0) -> np.ndarray:
    """Length of the longest run of True along an axis."""
    m = np.moveaxis(mask, axis, 0)
    run, best = np.zeros(m.shape[1:], int), np.zeros(m.shape[1:], int)
    for row in m:
        run = np.where(row, run + 1, 0)
        best = np.maximum(best, run)
    return best


def on_runs(mask: np.ndarray, axis: int, least: int) -> np.ndarray:
    """The pixels that lie on a run of True of at least ``least`` along an axis."""
    lines = np.moveaxis(mask, axis, 1)
    flat = np.pad(lines, ((0, 0), (1, 1))).ravel()
    edges = np.flatnonzero(flat[1:] != flat[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    long_ = ends - starts >= least
    turns = np.zeros(len(flat) + 1, int)
    turns[starts[long_]] += 1
    turns[ends[long_]] -= 1
    found = (np.cumsum(turns[:-1]) > 0).reshape(lines.shape[0], lines.shape[1] + 2)[:, 1:-1]
    return np.moveaxis(found, 1, axis)


def widened(mask: np.ndarray, reach: int) -> np.ndarray:
    """Dilated by ``reach`` columns to either side; nothing comes in over the edges."""
    sums = np.cumsum(np.pad(mask.astype(int), ((0, 0), (reach + 1, reach))), axis=1)
    return sums[:, 2 * reach + 1 :] > sums[:, : mask.shape[1]]


def spans(line: np.ndarray) -> list[tuple[int, int]]:
    """First and last place of every run of True in a line."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], line.astype(int), [0]]))).reshape(-1, 2)
    return [(int(a), int(b) - 1) for a, b in edges]


def staffs(mask: np.ndarray, height: float = 0.45, lean: float = 0.030, least_width: float = 0.004) -> list[tuple[int, int]]:
    """Column ranges whose leaning strokes reach a share of the height."""
    width = mask.shape[1]
    wide = widened(mask, max(int(lean * width), 1))
    tall = longest_runs(wide) >= height * mask.shape[0]
    return [(a, b) for a, b in spans(tall) if b - a + 1 >= max(int(least_width * width), 1)]


def staff_gaps(found: list[tuple[int, int]], height: int, close: float = 0.35) -> tuple[list[float], int]:
    """Distances between the centres of neighbours over the height, in hundredths, and how many are close."""
    centres = [(a + b) / 2 for a, b in found]
    gaps = [round((b - a) / height, 2) for a, b in zip(centres, centres[1:], strict=False)]
    return gaps, sum(g <= close for g in gaps)


def rule_pixels(mask: np.ndarray, share: float = 0.35, least: int = 30, thickness: float = 0.045) -> np.ndarray:
    """Pixels of printed rules: long level runs, in bands of few rows.

    A picture no wider than the run has none. What crosses a rule loses only the run's pixels.
    """
    need = max(int(share * mask.shape[1]), least)
    if need >= mask.shape[1]:
        return np.zeros_like(mask)
    level = on_runs(mask, 1, need)
    for a, b in spans(level.any(1)):
        if b - a + 1 > max(thickness * mask.shape[0], 4):
            level[a : b + 1] = False
    return level


def without_rules(mask: np.ndarray) -> np.ndarray:
    return mask & ~rule_pixels(mask)


def tall_strokes(mask: np.ndarray, share: float = 0.15, least: int = 12, lean: float = 0.012) -> np.ndarray:
    """Ink of tall strokes that may lean: runs are sought in the ink widened by the lean, and widened back."""
    need, reach = max(int(share * mask.shape[0]), least), max(int(lean * mask.shape[1]), 3)
    if need >= mask.shape[0]:
        return mask.copy()
    return widened(on_runs(widened(mask, reach), 0, need), reach) & mask


def erased(ink: np.ndarray, grey: np.ndarray, areas: list[tuple[str, float, float, float, float]]) -> np.ndarray:
    """Ink without what lies in areas (mode, left, top, right, bottom as fractions).

    ``box``: all of it; ``grey``: what is lighter than 80; ``vkeep``: all but tall strokes of the whole picture.
    """
    h, w = ink.shape
    out = ink.copy()
    for mode, *area in areas:
        x0, y0, x1, y1 = (int(f * s) for f, s in zip(area, (w, h, w, h), strict=True))
        part = (slice(y0, y1), slice(x0, x1))
        if mode == "box":
            out[part] = False
        elif mode == "grey":
            out[part] &= grey[part] <= 80
        elif mode == "vkeep":
            out[part] &= tall_strokes(out)[part]
        else:
            raise ValueError(f"unknown mode: {mode}")
    return out


def labelled(mask: np.ndarray) -> np.ndarray:
    """8-connected parts numbered from 1 in reading order, 0 elsewhere: runs of rows joined to those above that touch them."""
    h, w = mask.shape
    flat = np.pad(mask, ((0, 0), (1, 1))).ravel()
    edges = np.flatnonzero(flat[1:] != flat[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    row, first, last = starts // (w + 2), starts % (w + 2), (ends - 1) % (w + 2)
    root = list(range(len(starts)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    above = 0
    for k in range(len(starts)):
        while above < k and (row[above] < row[k] - 1 or (row[above] == row[k] - 1 and last[above] < first[k] - 1)):
            above += 1
        j = above
        while j < k and row[j] == row[k] - 1 and first[j] <= last[k] + 1:
            a, b = top(j), top(k)
            root[max(a, b)] = min(a, b)
            j += 1
    number = np.unique([top(k) for k in range(len(starts))], return_inverse=True)[1] + 1 if len(starts) else np.zeros(0, int)
    out = np.zeros((h, w), int)
    for k in range(len(starts)):
        out[row[k], first[k] - 1 : last[k]] = number[k]
    return out


def cleaned(mask: np.ndarray, least: int = 8, share: float = 0.30) -> np.ndarray:
    """Without rules, specks, parts shaped like a rule, and parts far smaller than the largest left.

    Where every part is shaped like a rule, none is taken for one.
    """
    parts = labelled(without_rules(mask))
    known = {}
    for k in range(1, parts.max() + 1):
        y, x = np.nonzero(parts == k)
        if len(x) >= least:
            known[k] = (np.ptp(x) + 1, np.ptp(y) + 1)
    strokes = {k: s for k, s in known.items() if not (s[0] >= 0.55 * mask.shape[1] and s[1] <= 0.06 * s[0])} or known
    top = max((float(np.hypot(*s)) for s in strokes.values()), default=0.0)
    return np.isin(parts, [k for k, s in strokes.items() if np.hypot(*s) >= share * top])


def gradient_histograms(grey: np.ndarray, cell: int = 16, bins: int = 9) -> np.ndarray:
    """Oriented gradients by cell, in blocks of two by two cells, clipped and normalised."""
    gy, gx = np.gradient(grey.astype(float))
    size, angle = np.hypot(gx, gy), np.degrees(np.arctan2(gy, gx)) % 180
    h, w = grey.shape[0] // cell, grey.shape[1] // cell
    at = np.minimum((angle / (180 / bins)).astype(int), bins - 1)
    cells = np.zeros((h, w, bins))
    for k in range(bins):
        part = np.where(at == k, size, 0)[: h * cell, : w * cell]
        cells[:, :, k] = part.reshape(h, cell, w, cell).sum((1, 3))
    blocks = []
    for y in range(h - 1):
        for x in range(w - 1):
            v = cells[y : y + 2, x : x + 2].ravel()
            v = np.minimum(v / np.sqrt((v**2).sum() + 1e-10), 0.2)
            blocks.append(v / np.sqrt((v**2).sum() + 1e-10))
    return np.concatenate(blocks) if blocks else np.zeros(0)


def perturbed(grey: np.ndarray, seed: int) -> np.ndarray:
    """A small turn, scale and shift, then thicker or thinner strokes: all from the seed."""
    rng = np.random.default_rng(seed)
    t, s = np.radians(rng.uniform(-3, 3)), rng.uniform(0.95, 1.05)
    sy, sx = rng.integers(-4, 5), rng.integers(-4, 5)
    h, w = grey.shape
    yy, xx = np.mgrid[:h, :w].astype(float)
    dy, dx = (yy - h / 2 - sy) / s, (xx - w / 2 - sx) / s
    y = np.round(-np.sin(t) * dx + np.cos(t) * dy + h / 2).astype(int)
    x = np.round(np.cos(t) * dx + np.sin(t) * dy + w / 2).astype(int)
    inside = (y >= 0) & (y < h) & (x >= 0) & (x < w)
    out = np.where(inside, grey[np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)], 255)
    return (out, window_extreme(out, 1, False), window_extreme(out, 1, True))[rng.integers(3)]


def white_fraction(grey: np.ndarray, level: int = 240) -> float:
    return float((grey >= level).mean())
