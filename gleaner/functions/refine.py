"""Mask refinement in numpy: grey values, thresholds, growth, cleaning, chains of steps, and what a mask's shape is like."""

from __future__ import annotations

import numpy as np

from gleaner.functions import masks


def to_gray(image: np.ndarray) -> np.ndarray:
    """Grey values of an RGB image by its luma weights; a flat image stays as it is."""
    return image if image.ndim == 2 else np.round(image[..., :3].astype(float) @ (0.299, 0.587, 0.114)).astype(np.uint8)


def shifted(mask: np.ndarray, square: bool = True) -> np.ndarray:
    """The mask and its neighbours, stacked: 3 x 3, or the cross of 4."""
    p = np.pad(mask, 1)
    h, w = mask.shape
    return np.stack([p[dy : dy + h, dx : dx + w] for dy in range(3) for dx in range(3) if square or 1 in (dy, dx)])


def dilate(mask: np.ndarray, steps: int = 1, square: bool = True) -> np.ndarray:
    for _ in range(steps):
        mask = shifted(mask, square).any(0)
    return mask


def erode(mask: np.ndarray, steps: int = 1, square: bool = True) -> np.ndarray:
    """Pixels outside the image count as set, so an edge erodes nothing."""
    return ~dilate(~mask, steps, square)


def opened(mask: np.ndarray) -> np.ndarray:
    return dilate(erode(mask))


def closed(mask: np.ndarray, steps: int = 1) -> np.ndarray:
    return erode(dilate(mask, steps), steps)


def smooth(mask: np.ndarray) -> np.ndarray:
    """Closed, then opened, by 3 x 3."""
    return opened(closed(mask))


def median(mask: np.ndarray, size: int = 3) -> np.ndarray:
    """Set where most of the size x size window is."""
    r = size // 2
    p = np.pad(mask, r).astype(np.int64)
    total = np.pad(p.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    h, w = mask.shape
    return 2 * (total[size : size + h, size : size + w] - total[:h, size : size + w] - total[size : size + h, :w] + total[:h, :w]) > size * size


def left_right(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two largest parts, the one further left first; an empty mask for a part that isn't there."""
    label = masks.components(mask)
    size = np.bincount(label.ravel())[1:]
    two = [label == 1 + k for k in np.argsort(-size, kind="stable")[:2]]
    two += [np.zeros_like(mask)] * (2 - len(two))
    return tuple(sorted(two, key=lambda m: np.nonzero(m)[1].mean() if m.any() else np.inf))


def count_parts(mask: np.ndarray) -> int:
    return int(masks.components(mask).max(initial=0))


def histogram_threshold(gray: np.ndarray, nu: float = 1.0, tau: float = 1.0, kappa: float = 1.0, omega: float = 0.5) -> int:
    """The grey value that the generalised histogram threshold picks: the split of the 256 bins whose two sides score best
    as Gaussians with priors on their spread (tau, weight nu) and on the share of the lower side (omega, weight kappa)."""
    n = np.bincount(gray.ravel().astype(np.uint8), minlength=256).astype(float)
    x = np.arange(256.0)
    low, low_x, low_xx = np.cumsum(n)[:-1], np.cumsum(n * x)[:-1], np.cumsum(n * x * x)[:-1]

    def side(w: np.ndarray, wx: np.ndarray, wxx: np.ndarray, share: float) -> np.ndarray:
        w = np.maximum(w, 1e-30)
        p = w / n.sum()
        spread = np.maximum(1e-30, (p * nu * tau**2 + wxx - wx**2 / w) / (p * nu + w))
        return -(wxx - wx**2 / w) / spread - w * np.log(spread) + 2 * (w + kappa * share) * np.log(w)

    score = side(low, low_x, low_xx, omega) + side(n.sum() - low, (n * x).sum() - low_x, (n * x * x).sum() - low_xx, 1 - omega)
    best = np.flatnonzero(score == score.max())
    return int(round(best.mean()))


def threshold(gray: np.ndarray, mask: np.ndarray, method: str = "otsu", value: int = 128, region: str = "in_bb", direction: str = "auto") -> np.ndarray:
    """Pixels on one side of a grey value within the mask, its box or anywhere; `auto` takes the side on which the mask's mean lies. An empty mask or result gives the mask back."""
    box = masks.box(mask)
    if box is None:
        return mask
    x, y, w, h = box
    where = np.zeros_like(mask)
    if region == "in_mask":
        where = mask.copy()
    elif region == "in_bb":
        where[y : y + h, x : x + w] = True
    else:
        where[:] = True
    cut = {"otsu": masks.otsu, "ght": histogram_threshold}[method](gray[where]) if method != "manual" else value
    above = direction == "above" or (direction == "auto" and gray[mask].mean() > cut)
    out = where & ((gray > cut) if above else (gray <= cut))
    return out if out.any() else mask


def wand(gray: np.ndarray, mask: np.ndarray, tolerance: float = 12.0, grow: int = 15) -> np.ndarray:
    """The mask and all parts of similar grey that touch it within its grown box."""
    if not mask.any():
        return mask
    x, y, w, h = masks.box(mask)
    near = np.zeros_like(mask)
    near[max(0, y - grow) : y + h + grow, max(0, x - grow) : x + w + grow] = True
    alike = near & (np.abs(gray.astype(float) - gray[mask].mean()) <= tolerance)
    label = masks.components(alike | mask)
    return mask | (alike & np.isin(label, np.unique(label[mask])))


def gated_dilate(gray: np.ndarray, mask: np.ndarray, share: float = 0.1) -> np.ndarray:
    """The mask and the pixels of its ring whose grey lies within a share of 255 from the interior's mean."""
    if not mask.any():
        return mask
    ring = dilate(mask) & ~mask
    return mask | (ring & (np.abs(gray.astype(float) - gray[mask].mean()) <= 255 * share))


def gated_erode(gray: np.ndarray, mask: np.ndarray, share: float = 0.1) -> np.ndarray:
    """The mask without the pixels of its edge whose grey lies further than a share of 255 from the interior's mean."""
    if not mask.any():
        return mask
    edge = mask & ~erode(mask)
    return mask & ~(edge & (np.abs(gray.astype(float) - gray[mask].mean()) > 255 * share))


def enhance(gray: np.ndarray, method: str = "stretch", gamma: float = 1.0) -> np.ndarray:
    """Grey values stretched from their 2nd to 98th percentile, or by a gamma curve."""
    g = gray.astype(float)
    if method == "gamma":
        return np.round(255 * (g / 255) ** gamma).astype(np.uint8)
    low, high = np.percentile(g, (2, 98))
    return gray if high <= low else np.clip(np.round((g - low) / (high - low) * 255), 0, 255).astype(np.uint8)


#: The steps of a chain by name: each takes (grey image, mask) and parameters.
STEPS = {
    "threshold": threshold, "otsu": threshold, "ght": lambda g, m, **kw: threshold(g, m, "ght", **kw), "wand": wand, "dilate": gated_dilate, "erode": gated_erode,
    "smooth": lambda g, m: smooth(m), "fill": lambda g, m: masks.fill(m), "largest": lambda g, m: masks.largest(m, 1), "top_k": lambda g, m, k=2: masks.largest(m, k), "median": lambda g, m, size=3: median(m, size),
}


def apply_steps(image: np.ndarray, mask: np.ndarray, steps: list[dict]) -> np.ndarray:
    """The mask after a chain of steps {name, **parameters}; `contrast` changes the image that later steps see."""
    gray = to_gray(image)
    for step in steps:
        kw = {k: v for k, v in step.items() if k != "name"}
        if step["name"] == "contrast":
            gray = enhance(gray, **kw)
        else:
            mask = STEPS[step["name"]](gray, mask, **kw)
    return mask


def combine(parts: list[np.ndarray], how: str = "union") -> np.ndarray:
    """Several masks as one: union, intersection, or the one picked by `pick:<place>`."""
    if how.startswith("pick:"):
        return parts[int(how[5:])]
    return np.logical_and.reduce(parts) if how == "intersection" else np.logical_or.reduce(parts)


def from_polygons(polygons: list[list[float]], height: int, width: int) -> np.ndarray:
    """Pixels whose centre lies inside an odd number of turns of each polygon (x, y, x, y, ...), all polygons together."""
    out = np.zeros((height, width), bool)
    cy = np.arange(height) + 0.5
    for flat in polygons:
        p = np.asarray(flat, float).reshape(-1, 2)
        part = np.zeros((height, width + 1), np.int64)
        for (x0, y0), (x1, y1) in zip(p, np.roll(p, -1, 0)):
            rows = np.flatnonzero((cy >= min(y0, y1)) & (cy < max(y0, y1)))
            if len(rows):
                x = x0 + (cy[rows] - y0) * (x1 - x0) / (y1 - y0)
                np.add.at(part, (rows, np.clip(np.ceil(x - 0.5), 0, width).astype(int)), 1)
        out |= part.cumsum(1)[:, :width] % 2 == 1
    return out


def split_parts(mask: np.ndarray, least_share: float = 0.0) -> list[np.ndarray]:
    """The mask's parts of at least a share of its area, largest first."""
    label = masks.components(mask)
    size = np.bincount(label.ravel())[1:]
    return [label == 1 + k for k in np.argsort(-size, kind="stable") if size[k] >= least_share * mask.sum()]


def shape_of(mask: np.ndarray) -> dict[str, float]:
    """Area, box, extent, aspect, centre, axes and direction of a mask's pixels, its edge length and thinness; zeros for an empty mask."""
    names = "area width height extent aspect cx cy major minor orientation elongation edge thinness parts".split()
    ys, xs = np.nonzero(mask)
    if not len(xs):
        return dict.fromkeys(names, 0.0)
    _, _, w, h = masks.box(mask)
    area = float(len(xs))
    cov = np.cov(np.stack([xs, ys]).astype(float), bias=True) if len(xs) > 1 else np.zeros((2, 2))
    value, vector = np.linalg.eigh(cov)
    minor, major = (4 * np.sqrt(np.maximum(value, 0))).tolist()
    angle = float(np.degrees(np.arctan2(vector[1, 1], vector[0, 1])) % 180)
    edge = float((mask & dilate(~np.pad(mask, 1), 1, False)[1:-1, 1:-1]).sum())
    made = (area, w, h, area / (w * h), w / h, xs.mean() / mask.shape[1], ys.mean() / mask.shape[0], major, minor, angle, major / max(minor, 1e-6), edge, 4 * np.pi * area / max(edge, 1.0) ** 2, count_parts(mask))
    return {k: float(v) for k, v in zip(names, made)}


def change_summary(ious: list[float]) -> dict[str, float]:
    """How a refinement changed masks, by their IoU before and after: n, unchanged (>= 0.98), large (< 0.5), median."""
    x = np.asarray(ious, float)
    return {"n": len(x), "unchanged": int((x >= 0.98).sum()), "large": int((x < 0.5).sum()), "median": float(np.median(x)) if len(x) else 0.0}
