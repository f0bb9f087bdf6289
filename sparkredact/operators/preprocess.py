"""Page images made ready for recognition: resolution, scaling, skew, noise.

What to do with an image is decided in columns from its height; pixels are touched only where needed.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .images import by_image

#: Page height in inches, least resolution, most scaling, and the angle below which nothing is turned.
PAGE_INCHES, LEAST_DPI, MOST_SCALING, DEAD_BAND = 11.0, 150.0, 4.0, 0.1
INSUFFICIENT = "Image quality is insufficient for reliable detection (estimated resolution below the 150 DPI threshold); no sensitive regions were identified."
UPSCALED = "Input resolution was below the 150 DPI threshold, so the image was upscaled %.1fx before detection. The returned image is larger than the original (%dx%d), and detection accuracy may be reduced because upscaling does not recover detail the source lacked."


def dpi(height: Column) -> Column:
    return height / F.lit(PAGE_INCHES)


def with_quality(images: DataFrame, passthrough: bool = False) -> DataFrame:
    """images (height, width) with dpi, upscaled, factor, new_height, new_width and sufficient."""
    own = dpi(F.col("height"))
    low = (own < LEAST_DPI) & F.lit(not passthrough)
    factor = F.when(low, F.least(F.lit(LEAST_DPI) / own, F.lit(MOST_SCALING))).otherwise(1.0)
    size = lambda c: F.when(low, F.greatest(F.rint(F.col(c) * F.col("factor")).cast("int"), F.lit(1))).otherwise(F.col(c))
    rows = images.withColumns({"dpi": own, "factor": factor, "upscaled": low & (factor > 1)})
    rows = rows.withColumns({"new_height": size("height"), "new_width": size("width")})
    return rows.withColumn("sufficient", F.lit(True) if passthrough else dpi(F.col("new_height")) >= LEAST_DPI)


def warnings_for(quality: DataFrame) -> DataFrame:
    """quality (of with_quality) with the warnings that scaling and resolution give."""
    none = F.array().cast("array<string>")
    scaled = F.when(F.col("upscaled") & F.col("sufficient"), F.array(F.format_string(UPSCALED, "factor", "width", "height"))).otherwise(none)
    return quality.withColumn("warnings", F.concat(scaled, F.when(F.col("sufficient"), none).otherwise(F.array(F.lit(INSUFFICIENT)))))


def resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bicubic interpolation, pixel centres aligned, edges repeated."""

    def along(x: np.ndarray, new: int) -> np.ndarray:
        old = x.shape[0]
        at = (np.arange(new) + 0.5) * old / new - 0.5
        base = np.floor(at).astype(int)
        t = (at - base)[(..., *[None] * (x.ndim - 1))]
        a = -0.75
        weights = [a * (t**3 - 2 * t**2 + t), (a + 2) * t**3 - (a + 3) * t**2 + 1, -(a + 2) * t**3 + (2 * a + 3) * t**2 - a * t, a * (t**2 - t**3)]
        return sum(w * x[np.clip(base + k, 0, old - 1)] for k, w in zip((-1, 0, 1, 2), weights, strict=True))

    out = along(along(image.astype(np.float64), height).swapaxes(0, 1), width).swapaxes(0, 1)
    return np.rint(out.clip(0, 255)).astype(np.uint8)


def grey(image: np.ndarray) -> np.ndarray:
    """Luma of blue, green, red (and alpha) or the one channel."""
    if image.shape[2] == 1:
        return image[:, :, 0]
    return np.rint(image[:, :, :3] @ np.array([0.114, 0.587, 0.299])).astype(np.uint8)


def otsu(values: np.ndarray) -> int:
    """The threshold that parts a histogram with the greatest variance between its parts."""
    n = np.bincount(values.ravel(), minlength=256).astype(np.float64)
    below = np.cumsum(n)
    mass = np.cumsum(n * np.arange(256))
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        between = below * above * (mass / below - (mass[-1] - mass) / above) ** 2
    return int(np.nanargmax(np.where(np.isfinite(between), between, -1)))


def skew(image: np.ndarray) -> float:
    """Degrees between -45 and 45 by which the dark pixels' smallest rectangle is turned; 0 for too few of them."""
    g = grey(image)
    ys, xs = np.nonzero(g <= otsu(g))
    if len(xs) < 2 or len(xs) == g.size:
        return 0.0
    # Only the ends of each row can be on the hull.
    order = np.lexsort((xs, ys))
    ys, xs = ys[order], xs[order]
    first = np.flatnonzero(np.diff(ys, prepend=-1))
    last = np.append(first[1:], len(ys)) - 1
    points = sorted({(int(x), int(y)) for x, y in np.concatenate([np.stack([xs[first], ys[first]], 1), np.stack([xs[last], ys[last]], 1)])})

    def chain(p):
        out = []
        for q in p:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    hull = np.array(chain(points) + chain(points[::-1]), np.float64)
    if len(hull) < 3:
        return 0.0
    edges = np.diff(np.vstack([hull, hull[:1]]), axis=0)
    angles = np.unique(np.arctan2(edges[:, 1], edges[:, 0]) % (np.pi / 2))
    c, s = np.cos(angles), np.sin(angles)
    u, v = np.outer(c, hull[:, 0]) + np.outer(s, hull[:, 1]), -np.outer(s, hull[:, 0]) + np.outer(c, hull[:, 1])
    best = float(np.degrees(angles[np.argmin((np.ptp(u, axis=1) + 1) * (np.ptp(v, axis=1) + 1))]))
    return best - 90 if best > 45 else best


def turned(image: np.ndarray, degrees: float) -> np.ndarray:
    """The image turned about its centre, bilinear, on white."""
    h, w = image.shape[:2]
    t = np.radians(degrees)
    y, x = np.mgrid[0:h, 0:w]
    dy, dx = y - (h - 1) / 2, x - (w - 1) / 2
    sx, sy = np.cos(t) * dx - np.sin(t) * dy + (w - 1) / 2, np.sin(t) * dx + np.cos(t) * dy + (h - 1) / 2
    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
    fx, fy = (sx - x0)[..., None], (sy - y0)[..., None]

    def at(yy, xx):
        inside = ((yy >= 0) & (yy < h) & (xx >= 0) & (xx < w))[..., None]
        return np.where(inside, image[yy.clip(0, h - 1), xx.clip(0, w - 1)], 255)

    out = (at(y0, x0) * (1 - fx) + at(y0, x0 + 1) * fx) * (1 - fy) + (at(y0 + 1, x0) * (1 - fx) + at(y0 + 1, x0 + 1) * fx) * fy
    return np.rint(out).astype(np.uint8)


def denoised(image: np.ndarray, strength: float = 10.0, patch: int = 3, search: int = 10) -> np.ndarray:
    """Non-local means: patches of 7 x 7 compared within 21 x 21; alpha stays as it is, and so does an image of one colour."""
    body = image[:, :, :3].astype(np.float32)
    if (body == body[:1, :1]).all():
        return image.copy()
    total, weight = np.zeros_like(body), np.zeros((*body.shape[:2], 1), np.float32)
    pad = np.pad(body, ((search, search), (search, search), (0, 0)), mode="reflect" if min(body.shape[:2]) > search else "edge")
    size = 2 * patch + 1
    for dy in range(-search, search + 1):
        for dx in range(-search, search + 1):
            other = pad[search + dy : search + dy + body.shape[0], search + dx : search + dx + body.shape[1]]
            gap = np.pad(((body - other) ** 2).mean(axis=2), patch, mode="edge").astype(np.float64)
            # Sums over patches from running sums along both axes.
            for axis in (0, 1):
                run = np.concatenate([np.zeros_like(gap.take([0], axis)), np.cumsum(gap, axis)], axis)
                n = run.shape[axis]
                gap = run.take(range(size, n), axis) - run.take(range(n - size), axis)
            w = np.exp(-gap / (size * strength) ** 2)[..., None].astype(np.float32)
            total += w * other
            weight += w
    out = image.copy()
    out[:, :, :3] = np.rint(total / weight)
    return out


def prepared(images: DataFrame, passthrough: bool = False) -> DataFrame:
    """images of with_quality() scaled, straightened and denoised, with residual_skew and raw_residual_skew in degrees.

    Images of insufficient quality keep their pixels: nothing further is done with them.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in images.schema.fields)

    def change(image: np.ndarray, row: dict) -> dict:
        left = raw = 0.0
        if row["sufficient"]:
            if row["upscaled"]:
                image = resized(image, int(row["new_height"]), int(row["new_width"]))
            if not passthrough:
                angle = skew(image)
                if abs(angle) > DEAD_BAND:
                    image = turned(image, angle)
                    angle = skew(image)
                raw, left = angle, min(abs(angle), 1.0)
            image = denoised(image, 3.0 if row["upscaled"] else 10.0)
        return {"data": image.tobytes(), "height": image.shape[0], "width": image.shape[1], "residual_skew": left, "raw_residual_skew": raw}

    return by_image(images, change, f"{schema}, residual_skew double, raw_residual_skew double")
