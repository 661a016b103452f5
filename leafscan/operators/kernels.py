"""Pixel kernels. Pages are height x width arrays of grey bytes; ink masks are of the same shape, 0 or 1."""

import numpy as np

from ..config import ContractError, Dialect

RULE_SPAN, RULE_LEAST, RULE_SHARE = 0.5, 15, 0.80
PAPER, SEARCH = 250, 0.12


def orient(image: np.ndarray, tag: int) -> np.ndarray:
    """The upright image of one stored under an orientation tag."""
    turned = {2: lambda a: a[:, ::-1], 3: lambda a: a[::-1, ::-1], 4: lambda a: a[::-1], 5: lambda a: a.swapaxes(0, 1), 6: lambda a: np.rot90(a, -1), 7: lambda a: a[::-1, ::-1].swapaxes(0, 1), 8: lambda a: np.rot90(a)}
    return np.ascontiguousarray(turned[tag](image)) if tag in turned else image


def flatten(image: np.ndarray) -> np.ndarray:
    """Without alpha: composed on white, with rounding, where any pixel isn't opaque."""
    if image.ndim == 2 or image.shape[2] in (1, 3):
        return image
    colour, alpha = image[..., :-1].astype(np.uint32), image[..., -1:].astype(np.uint32)
    if (alpha == 255).all():
        return image[..., :-1]
    return ((colour * alpha + 255 * (255 - alpha) + 127) // 255).astype(np.uint8)


def grey(image: np.ndarray) -> np.ndarray:
    """One byte a pixel, by the weights 299, 587, 114 in thousand, rounded."""
    if image.ndim == 2:
        return image
    if image.shape[2] == 1:
        return image[..., 0]
    return ((image[..., :3].astype(np.uint32) @ np.array([299, 587, 114], np.uint32) + 500) // 1000).astype(np.uint8)


def is_dark(page: np.ndarray) -> bool:
    """Whether the median of the four corner patches is below the middle."""
    h, w = page.shape
    if not page.size:
        return False
    dy, dx = min(h, max(3, h // 10)), min(w, max(3, w // 10))
    corners = [page[:dy, :dx], page[:dy, w - dx :], page[h - dy :, :dx], page[h - dy :, w - dx :]]
    return bool(np.median(np.concatenate([c.ravel() for c in corners])) < 128)


def dark_on_light(page: np.ndarray) -> np.ndarray:
    return 255 - page if is_dark(page) else page


def _gauss(page: np.ndarray, size: int) -> np.ndarray:
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    x = np.arange(size) - size // 2
    kernel = np.exp(-(x**2) / (2 * sigma**2))
    kernel /= kernel.sum()
    out = page.astype(float)
    for axis in (0, 1):
        pad = [(size // 2, size // 2) if a == axis else (0, 0) for a in (0, 1)]
        out = np.apply_along_axis(np.convolve, axis, np.pad(out, pad, mode="edge"), kernel, "valid")
    return out


def binarise(page: np.ndarray, dialect: Dialect) -> np.ndarray:
    """Ink: darker than the level, or (adaptive) than the Gaussian mean of 25 x 25 pixels by more than 10."""
    if dialect.binarise == "adaptive":
        return (page <= np.rint(_gauss(page, 25)) - 10).astype(np.uint8)
    return (page < dialect.level).astype(np.uint8)


def long_runs(mask: np.ndarray, least: int) -> np.ndarray:
    """Ink that lies in a horizontal run of `least` pixels or more."""
    h, w = mask.shape
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    (y, a), (_, b) = np.nonzero(edge == 1), np.nonzero(edge == -1)
    keep = b - a >= least
    out = np.zeros((h, w + 1), np.int32)
    np.add.at(out, (y[keep], a[keep]), 1)
    np.add.at(out, (y[keep], b[keep]), -1)
    return (np.cumsum(out, axis=1)[:, :w] > 0).astype(np.uint8)


def suppress_rules(mask: np.ndarray) -> np.ndarray:
    """The mask without printed rules, unless these would be more than 80 % of the ink."""
    h, w = mask.shape
    span = lambda n: max(RULE_LEAST, int(n * RULE_SPAN))
    rules = long_runs(mask, span(w)) | long_runs(mask.T, span(h)).T
    ink, ruled = int(mask.sum()), int(rules.sum())
    if not ink or not ruled or ruled > RULE_SHARE * ink:
        return mask
    return mask & ~rules & 1


def smooth(profile: np.ndarray, k: int, how: str) -> np.ndarray:
    if k <= 1:
        return profile.astype(float)
    half, n = k // 2, len(profile)
    ahead = (k - 1) // 2 if how == "true_k" else half
    total = np.r_[0.0, np.cumsum(profile, dtype=float)]
    lo, hi = np.maximum(0, np.arange(n) - half), np.minimum(n, np.arange(n) + ahead + 1)
    return (total[hi] - total[lo]) / ((hi - lo) if how == "visited" else k)


def gap_threshold(smoothed: np.ndarray, dialect: Dialect) -> float | None:
    """None where the page has no ink."""
    inked = smoothed[smoothed > 0]
    if not len(inked):
        return None
    return dialect.ratio * float(smoothed.max() if dialect.threshold == "max" else inked.mean())


def line_runs(profile: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    edge = np.diff(np.r_[0, (profile > threshold).astype(np.int8), 0])
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))


def typical_height(runs, min_line: int) -> int:
    """The upper median of the heights that are lines, or of all where none is."""
    heights = sorted(b - a for a, b in runs)
    tall = [h for h in heights if h >= min_line] or heights
    return max(1, tall[len(tall) // 2]) if tall else 1


def merge_runs(runs, profile, max_gap: int = 10, min_line: int = 10) -> list[tuple[int, int]]:
    """Neighbouring runs as one where the rows between hold ink or one is a fragment, up to twice the typical height."""
    typical, out = typical_height(runs, min_line), []
    for r0, r1 in runs:
        if out:
            a0, a1 = out[-1]
            sizes = sorted((a1 - a0, r1 - r0))
            bridged = all(0 <= y < len(profile) and profile[y] > 0 for y in range(a1, r0))
            fragment = 2 * sizes[0] <= typical and sizes[1] >= min_line
            if max(0, r0 - a1) <= max_gap and (bridged or fragment) and r1 - a0 <= 2 * typical:
                out[-1] = (a0, r1)
                continue
        out.append((r0, r1))
    return out


def padding(height: int, how: str) -> tuple[int, int]:
    """Vertical and horizontal padding of a band; of 20 and 15 % in whole numbers."""
    if how == "constant":
        return 4, 4
    up = 99 if how == "ceil" else 0
    return (20 * height + up) // 100, (15 * height + up) // 100


def boxes(mask: np.ndarray, dialect: Dialect) -> list[tuple[int, int, int, int]]:
    """(x, y, w, h) of each line from top to bottom."""
    h, w = mask.shape
    clean = suppress_rules(mask)
    profile = clean.sum(axis=1, dtype=np.int64)
    threshold = gap_threshold(smooth(profile, dialect.window, dialect.smooth), dialect)
    if threshold is None:
        return []
    out = []
    for r0, r1 in merge_runs(line_runs(profile, threshold), profile, dialect.max_gap, dialect.min_line):
        inked = np.flatnonzero(clean[r0:r1].any(axis=0)) if r1 - r0 >= dialect.min_line else []
        if len(inked):
            dy, dx = padding(r1 - r0, dialect.padding)
            x0, y0 = max(0, int(inked[0]) - dx), max(0, r0 - dy)
            out.append((x0, y0, min(w, int(inked[-1]) + dx) - x0, min(h, r1 + dy) - y0))
    return [b for b in out if b[2] > 0 and b[3] > 0]


def cut_column(line: np.ndarray, x0: int, ideal: int) -> int:
    """Where to cut before `ideal`: the last column without ink in the search window, else the first of least ink."""
    if ideal >= line.shape[1]:
        return line.shape[1]
    lo = max(x0 + 1, ideal - max(1, int((ideal - x0) * SEARCH)))
    if lo >= ideal:
        return ideal
    ink = (line[:, lo:ideal] < PAPER).sum(axis=0)
    white = np.flatnonzero(ink == 0)
    return lo + int(white[-1] if len(white) else ink.argmin())


def tiles(line: np.ndarray, height: int = 160, width: int = 1024) -> list[tuple[int, int]]:
    """(x0, x1) of the pieces of a line that each fit the canvas."""
    h, w = line.shape
    if not h or not w or int(w * height / h) <= width:
        return [(0, w)]
    most, out, x = max(1, int(width / (height / h))), [], 0
    while x < w:
        end = w if w - x <= most else max(x + 1, cut_column(line, x, x + most))
        out.append((x, end))
        x = end
    return out


def _cubic(x):
    x = np.abs(x)
    return np.where(x < 1, (1.5 * x - 2.5) * x * x + 1, np.where(x < 2, ((-0.5 * x + 2.5) * x - 4) * x + 2, 0))


#: Kernels and their reach; but for bilinear, which takes two neighbours at any scale, they widen where an image shrinks.
_KERNELS = {
    "bilinear": (lambda x: np.maximum(0, 1 - np.abs(x)), 1),
    "triangle": (lambda x: np.maximum(0, 1 - np.abs(x)), 1),
    "bicubic": (_cubic, 2),
    "lanczos3": (lambda x: np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0), 3),
}


def resize(image: np.ndarray, width: int, height: int, how: str = "bilinear") -> np.ndarray:
    """The image as floats of 0 to 255; bilinear keeps fractions, the others give whole levels."""
    if how not in _KERNELS:
        raise ContractError(f"no such way of resampling: {how}")
    kernel, reach = _KERNELS[how]

    def axis(n, m):
        scale = n / m
        wide = 1.0 if how == "bilinear" else max(1.0, scale)
        centre = (np.arange(m) + 0.5) * scale - 0.5
        at = np.floor(centre - reach * wide).astype(int)[:, None] + np.arange(int(2 * reach * wide) + 2)
        w = kernel((at - centre[:, None]) / wide)
        if how != "bilinear":  # what lies outside has no weight; bilinear repeats the border
            w = np.where((at >= 0) & (at < n), w, 0)
        return np.clip(at, 0, n - 1), w / w.sum(1, keepdims=True)

    (ys, wy), (xs, wx) = axis(image.shape[0], height), axis(image.shape[1], width)
    rows = np.zeros((height, image.shape[1]))
    for k in range(ys.shape[1]):
        rows += image[ys[:, k]] * wy[:, k, None]
    out = np.zeros((height, width))
    for k in range(xs.shape[1]):
        out += rows[:, xs[:, k]] * wx[:, k]
    return np.clip(out if how == "bilinear" else np.floor(out + 0.5), 0, 255)


def preprocess(crop: np.ndarray, dialect: Dialect) -> np.ndarray | None:
    """1 x 1 x height x width floats in [-1, 1], left-aligned on white; None for an empty crop."""
    if crop.ndim != 2:
        raise ContractError("a crop has one channel")
    h, w = crop.shape
    if not h or not w:
        return None
    page = dark_on_light(crop)
    wide = w * dialect.height / h
    target = min(int(wide) if dialect.width_rounding == "floor" else int(wide + 0.5), dialect.width)
    target = max(dialect.min_width, target)
    canvas = np.full((dialect.height, dialect.width), 255.0)
    if target:
        canvas[:, :target] = resize(page, target, dialect.height, dialect.resample)
    return (canvas / 127.5 - 1).astype(np.float32)[None, None]
