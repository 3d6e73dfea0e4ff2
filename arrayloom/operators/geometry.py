"""Resampling of images: bicubic, resize, rotation, polar forms, augmentation. numpy over Arrow batches.

Images are arrays of channels x rows x cols. A stage maps (id, label, channels,
rows, cols, data) to the same columns, row by row within a batch, so memory
holds a batch, and nothing is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

IMAGE = "id long, label int, channels int, rows int, cols int, data array<double>"


def stage(df: DataFrame, f: Callable[[np.ndarray, dict], Iterable[np.ndarray] | np.ndarray], extra: tuple[str, ...] = ()) -> DataFrame:
    """f over every image; an iterable of images gives one row each. extra columns are passed to f by name."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                image = np.asarray(r.data, dtype=float).reshape(r.channels, r.rows, r.cols)
                made = f(image, {c: getattr(r, c) for c in extra})
                for m in [made] if isinstance(made, np.ndarray) else made:
                    out.append((r.id, r.label, *m.shape, m.ravel()))
            yield pd.DataFrame(out, columns=["id", "label", "channels", "rows", "cols", "data"])

    return df.select("id", "label", "channels", "rows", "cols", "data", *extra).mapInPandas(run, IMAGE)


def slopes(a: np.ndarray, axis: int) -> np.ndarray:
    """Central differences over two, the border repeated."""
    p = np.pad(a, [(1, 1) if k == axis else (0, 0) for k in range(a.ndim)], mode="edge")
    n = a.shape[axis]
    return (np.take(p, range(2, n + 2), axis) - np.take(p, range(n), axis)) / 2


#: The matrix from values and slopes at 0 and 1 to a cubic's coefficients.
HERMITE = np.array([[1, 0, 0, 0], [0, 0, 1, 0], [-3, 3, -2, -1], [2, -2, 1, 1]], dtype=float)


def bicubic(image: np.ndarray, y: np.ndarray, x: np.ndarray, lo: float, hi: float) -> np.ndarray:
    """Values of a plane at real positions, cut to lo..hi; 0 outside."""
    rows, cols = image.shape
    inside = (y >= 0) & (y <= rows - 1) & (x >= 0) & (x <= cols - 1)
    y0 = np.clip(np.floor(y), 0, max(rows - 2, 0)).astype(int)
    x0 = np.clip(np.floor(x), 0, max(cols - 2, 0)).astype(int)
    y1, x1 = np.minimum(y0 + 1, rows - 1), np.minimum(x0 + 1, cols - 1)
    fx, fy = slopes(image, 1), slopes(image, 0)
    fxy = slopes(fx, 0)
    corner = lambda f: [[f[y0, x0], f[y0, x1]], [f[y1, x0], f[y1, x1]]]
    v, vx, vy, vxy = map(corner, (image, fx, fy, fxy))
    m = np.array([[v[0][0], v[0][1], vx[0][0], vx[0][1]], [v[1][0], v[1][1], vx[1][0], vx[1][1]], [vy[0][0], vy[0][1], vxy[0][0], vxy[0][1]], [vy[1][0], vy[1][1], vxy[1][0], vxy[1][1]]])
    coefficients = np.einsum("ij,jk...,lk->il...", HERMITE, m, HERMITE)
    ty, tx = y - y0, x - x0
    out = sum(coefficients[i, j] * ty**i * tx**j for i in range(4) for j in range(4))
    return np.where(inside, np.clip(out, lo, hi), 0.0)


def each_channel(image: np.ndarray, f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    return np.stack([f(c) for c in image])


def rescaled(plane: np.ndarray, rows: int, cols: int, lo: float, hi: float) -> np.ndarray:
    """Corner-aligned: old and new corners coincide."""
    step = lambda n, m: np.arange(m) * ((n - 1) / (m - 1) if m > 1 else 0.0)
    y, x = np.meshgrid(step(plane.shape[0], rows), step(plane.shape[1], cols), indexing="ij")
    return bicubic(plane, y, x, lo, hi)


def rescale(image: np.ndarray, rows: int, cols: int, lo: float = 0.0, hi: float = 255.0) -> np.ndarray:
    return each_channel(image, lambda p: rescaled(p, rows, cols, lo, hi))


def resize_longest(image: np.ndarray, n: int, hi: float = 255.0) -> np.ndarray:
    """The longer side becomes n, the other keeps the aspect (rounded half to even)."""
    _, rows, cols = image.shape
    r, c = (n, max(1, round(cols * n / rows))) if rows >= cols else (max(1, round(rows * n / cols)), n)
    return rescale(image, r, c, float(image.min()), hi)


def crop_square(image: np.ndarray) -> np.ndarray:
    _, rows, cols = image.shape
    n = min(rows, cols)
    return image[:, (rows - n) // 2 : (rows - n) // 2 + n, (cols - n) // 2 : (cols - n) // 2 + n]


def padded(image: np.ndarray, rows: int, cols: int, value: float = 0.0) -> np.ndarray:
    """Centred in at least rows x cols."""
    from .cells import pad_offset

    _, r, c = image.shape
    out = np.full((len(image), max(rows, r), max(cols, c)), value)
    y, x = pad_offset(r, rows), pad_offset(c, cols)
    out[:, y : y + r, x : x + c] = image[:, : out.shape[1] - y, : out.shape[2] - x]
    return out


def pad_square(image: np.ndarray, value: float = 0.0) -> np.ndarray:
    n = max(image.shape[1:])
    return padded(image, n, n, value)


def crop_resize(image: np.ndarray, n: int) -> np.ndarray:
    return rescale(crop_square(image), n, n)


def pad_resize(image: np.ndarray, n: int, value: float = 0.0) -> np.ndarray:
    return rescale(pad_square(image, value), n, n, min(value, float(image.min())))


def angles_of(step: float) -> list[float]:
    """All multiples of a step of degrees below 360; 0 alone for no step."""
    return [k * step for k in range(round(360 / step))] if step else [0.0]


def rotated(image: np.ndarray, degrees: float) -> np.ndarray:
    """Turned about its centre in the same extents; what comes from outside is 0."""
    _, rows, cols = image.shape
    t = math.radians(degrees)
    cy, cx = (rows - 1) / 2, (cols - 1) / 2
    y, x = np.meshgrid(np.arange(rows) - cy, np.arange(cols) - cx, indexing="ij")
    sy, sx = y * math.cos(t) - x * math.sin(t) + cy, y * math.sin(t) + x * math.cos(t) + cx
    near = lambda a: np.where(np.abs(a - np.round(a)) < 1e-9, np.round(a), a)
    return each_channel(image, lambda p: bicubic(p, near(sy), near(sx), float(p.min()), float(p.max())))


def rotated_whole(image: np.ndarray, degrees: float) -> np.ndarray:
    """Padded to its diagonal first, so corners survive."""
    n = math.ceil(math.hypot(*image.shape[1:]))
    return rotated(padded(image, n, n), degrees)


def pad_resize_rotate(image: np.ndarray, n: int, step: float, value: float = 0.0) -> Iterator[np.ndarray]:
    square = pad_resize(image, n, value)
    for a in angles_of(step):
        yield rotated(square, a)


@dataclass(frozen=True)
class Augmentation:
    """Ranges of random transforms, and the step of rotations in degrees."""

    rows: int
    cols: int
    step: float = 0.0
    scale: tuple[float, float] = (1.0, 1.0)
    gain: tuple[float, float] = (1.0, 1.0)
    bias: tuple[float, float] = (0.0, 0.0)

    def drawn(self, seed: int, row: int) -> tuple[float, float, float]:
        """Scale, gain and bias of a row, which depend only on the seed and its id."""
        rng = np.random.default_rng([seed, row & 0xFFFFFFFF])
        return rng.uniform(*self.scale), rng.uniform(*self.gain), rng.uniform(*self.bias)


def augmented(df: DataFrame, how: Augmentation, seed: int, value: float = 0.0, contrast: bool = True) -> DataFrame:
    """For every image and angle: scaled, turned, cropped and padded to rows x cols, and a x + b cut to 0..255."""

    def f(image: np.ndarray, at: dict) -> Iterator[np.ndarray]:
        scale, gain, bias = how.drawn(seed, int(at["key"]))
        _, rows, cols = image.shape
        large = rescale(image, max(1, round(rows * scale)), max(1, round(cols * scale)), float(image.min()), float(image.max()))
        for a in angles_of(how.step):
            t = rotated_whole(large, a) if how.step else large
            t = padded(t, how.rows, how.cols, value)
            y, x = (t.shape[1] - how.rows) // 2, (t.shape[2] - how.cols) // 2
            t = t[:, y : y + how.rows, x : x + how.cols]
            yield np.clip(gain * t + bias, 0, 255) if contrast else t

    return stage(df.withColumn("key", F.col("id")), f, ("key",))


def polar(image: np.ndarray, n_theta: int, n_r: int, center: tuple[float, float], radius: float, log: bool = False) -> np.ndarray:
    """channels x n_theta x n_r: rings about a centre (y, x).

    Plain radii are k radius / n_r, and values weigh as the area of their cell;
    logarithmic radii are exp(k ln radius / n_r), unweighted.
    """
    theta = np.arange(n_theta) * 2 * math.pi / n_theta
    k = np.arange(n_r)
    r = np.exp(k * math.log(radius) / n_r) if log else k * radius / n_r
    y, x = center[0] + np.outer(np.sin(theta), r), center[1] + np.outer(np.cos(theta), r)
    out = each_channel(image, lambda p: bicubic(p, y, x, float(p.min()), float(p.max())))
    return out if log else out * (2 * math.pi * (radius / n_r) * r / n_theta)


def log_polar_image(image: np.ndarray, n_theta: int, n_r: int, center: tuple[float, float], radius: float) -> np.ndarray:
    """The log-polar form, from least to greatest to 0..255."""
    return min_max(polar(image, n_theta, n_r, center, radius, log=True), 0.0, 255.0)


def from_log_polar(rings: np.ndarray, rows: int, cols: int, center: tuple[float, float], radius: float) -> np.ndarray:
    """The inverse look-up: each pixel's angle and log radius."""
    _, n_theta, n_r = rings.shape
    y, x = np.meshgrid(np.arange(rows) - center[0], np.arange(cols) - center[1], indexing="ij")
    r = np.hypot(y, x)
    t = np.mod(np.arctan2(y, x), 2 * math.pi) * n_theta / (2 * math.pi)
    k = np.where(r >= 1, np.log(np.maximum(r, 1)) * n_r / math.log(radius), -1.0)
    around = np.concatenate([rings, rings[:, :1]], axis=1)  # the circle closes
    return each_channel(around, lambda p: bicubic(p, t, k, float(p.min()), float(p.max())))


def log_polar_stack(df: DataFrame, n_theta: int, n_r: int, centers: list[tuple[float, float]] | None, radius: float) -> DataFrame:
    """A row for each image and centre (its place in `label`'s stead stays; column `point`), or for the row's own cy, cx."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                image = np.asarray(r.data, dtype=float).reshape(r.channels, r.rows, r.cols)
                for point, c in enumerate(centers or [(r.cy, r.cx)]):
                    out.append((r.id, r.label, point, r.channels, n_theta, n_r, polar(image, n_theta, n_r, c, radius, log=True).ravel()))
            yield pd.DataFrame(out, columns=["id", "label", "point", "channels", "rows", "cols", "data"])

    own = () if centers else ("cy", "cx")
    return df.select("id", "label", "channels", "rows", "cols", "data", *own).mapInPandas(run, IMAGE.replace("channels", "point int, channels", 1))


def min_max(a: np.ndarray, lo: float, hi: float) -> np.ndarray:
    """From its least and greatest to lo..hi; a constant array stays."""
    low, high = a.min(), a.max()
    return a if low == high else (a - low) / (high - low) * (hi - lo) + lo


def recentred(image: np.ndarray, sigma: float) -> np.ndarray:
    """On a canvas of twice the extents, the blurred channel sum's maximum in the middle."""
    _, rows, cols = image.shape
    s = image.sum(axis=0)
    fy, fx = np.fft.fftfreq(rows)[:, None], np.fft.fftfreq(cols)[None]
    blurred = np.fft.ifft2(np.fft.fft2(s) * np.exp(-2 * (math.pi * sigma) ** 2 * (fy**2 + fx**2))).real
    y, x = np.unravel_index(int(blurred.argmax()), s.shape)
    out = np.zeros((len(image), 2 * rows, 2 * cols))
    out[:, rows - y : 2 * rows - y, cols - x : 2 * cols - x] = image
    return out


def box(image: np.ndarray, x: int, y: int, w: int, h: int) -> np.ndarray:
    """A landmark's box; an error if it leaves the image."""
    if min(x, y) < 0 or y + h > image.shape[1] or x + w > image.shape[2]:
        raise ValueError("the box leaves the image")
    return image[:, y : y + h, x : x + w]


def square_box(image: np.ndarray, x: int, y: int, w: int, h: int, n: int) -> np.ndarray:
    """The box grown to a square about its centre (as far as the image goes), resized to n x n."""
    s = max(w, h)
    y0, x0 = max(0, y + h // 2 - s // 2), max(0, x + w // 2 - s // 2)
    return rescale(image[:, y0 : y0 + s, x0 : x0 + s], n, n)


def laplacian_pyramid(plane: np.ndarray, levels: int) -> list[np.ndarray]:
    """Differences from a blurred half-size copy, and the last copy; stops at an odd size."""
    k = np.array([0.05, 0.25, 0.4, 0.25, 0.05])
    out = []
    for _ in range(levels):
        if plane.shape[0] % 2 or plane.shape[1] % 2:
            break
        small = circular(plane, k)[::2, ::2]
        large = np.zeros_like(plane)
        large[::2, ::2] = small
        out.append(plane - circular(large, 2 * k))
        plane = small
    return [*out, plane]


def laplacian_inverse(bands: list[np.ndarray]) -> np.ndarray:
    """The plane of laplacian_pyramid(): from the last copy on, each doubled, blurred and added to the differences above it."""
    k = np.array([0.05, 0.25, 0.4, 0.25, 0.05])
    plane = bands[-1]
    for band in bands[-2::-1]:
        large = np.zeros_like(band)
        large[::2, ::2] = plane
        plane = band + circular(large, 2 * k)
    return plane


def circular(plane: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """Separable circular filtering with centred taps."""
    for axis in (0, 1):
        plane = sum(t * np.roll(plane, len(taps) // 2 - i, axis) for i, t in enumerate(taps))
    return plane


#: Low-pass taps of orthogonal wavelets.
WAVELETS = {"haar": [2**-0.5, 2**-0.5], "d4": [(1 + 3**0.5) / (4 * 2**0.5), (3 + 3**0.5) / (4 * 2**0.5), (3 - 3**0.5) / (4 * 2**0.5), (1 - 3**0.5) / (4 * 2**0.5)]}


def wavelet_step(a: np.ndarray, low: np.ndarray, axis: int) -> tuple[np.ndarray, np.ndarray]:
    high = low[::-1] * (-1.0) ** np.arange(len(low))
    f = lambda taps: sum(t * np.roll(a, -i, axis) for i, t in enumerate(taps)).take(range(0, a.shape[axis], 2), axis)
    return f(low), f(high)


def wavelet_transform(plane: np.ndarray, levels: int, name: str = "d4") -> list[list[np.ndarray]]:
    """Per level the three detail planes, and last the residual."""
    taps, out = np.array(WAVELETS[name]), []
    for _ in range(levels):
        lo, hi = wavelet_step(plane, taps, 1)
        (ll, lh), (hl, hh) = wavelet_step(lo, taps, 0), wavelet_step(hi, taps, 0)
        out.append([lh, hl, hh])
        plane = ll
    return [*out, [plane]]


def wavelet_inverse(bands: list[list[np.ndarray]], name: str = "d4") -> np.ndarray:
    taps = np.array(WAVELETS[name])
    high = taps[::-1] * (-1.0) ** np.arange(len(taps))

    def up(a: np.ndarray, t: np.ndarray, axis: int) -> np.ndarray:
        shape = list(a.shape)
        shape[axis] *= 2
        z = np.zeros(shape)
        z[tuple(slice(None, None, 2) if k == axis else slice(None) for k in range(2))] = a
        return sum(c * np.roll(z, i, axis) for i, c in enumerate(t))

    plane = bands[-1][0]
    for lh, hl, hh in bands[-2::-1]:
        plane = up(up(plane, taps, 0) + up(lh, high, 0), taps, 1) + up(up(hl, taps, 0) + up(hh, high, 0), high, 1)
    return plane


def steerable_windows(shape: tuple[int, int], bands: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """On an extent's frequencies: the first split's high and low windows, a level's oriented windows and its low one."""
    from .pyramids import frequencies, g1, h1, l1

    y, x = np.meshgrid(frequencies(shape[0]), frequencies(shape[1]), indexing="ij")
    r, a = np.hypot(y, x), np.arctan2(y, x)
    oriented = [h1(r) * (g1(k, bands, a) + g1(k, bands, a + math.pi) * (-1) ** (bands - 1)) * (1j) ** (bands - 1) for k in range(bands)]
    return h1(r / 2), l1(r / 2) / 2, np.stack(oriented), l1(r)


def steerable_pyramid(plane: np.ndarray, levels: int, bands: int = 3) -> list[list[np.ndarray]]:
    """The high residual, per level the oriented bands, and the low residual, by frequency windows."""
    f = np.fft.fft2(plane)
    high, low, _, _ = steerable_windows(plane.shape, bands)
    out = [[np.fft.ifft2(f * high).real]]
    f = f * low
    for _ in range(levels):
        _, _, oriented, low = steerable_windows(f.shape, bands)
        out.append(list(np.fft.ifft2(f * oriented).real))
        f = np.fft.fft2(np.fft.ifft2(f * low).real[::2, ::2])
    return [*out, [np.fft.ifft2(f).real]]


def steerable_inverse(parts: list[list[np.ndarray]]) -> np.ndarray:
    """The plane of steerable_pyramid(), whose windows' squares add up to 1; extents must be even at every level, bands two or more.

    A level's low part, set between zeros, has the spectrum of the smaller plane
    repeated; the low window keeps one copy.
    """
    f = np.fft.fft2(parts[-1][0])
    for planes in parts[-2:0:-1]:
        shape = planes[0].shape
        if len(planes) < 2 or shape != (2 * f.shape[0], 2 * f.shape[1]):
            raise ValueError("one band, or an odd extent was halved")
        _, _, oriented, low = steerable_windows(shape, len(planes))
        f = low * np.tile(f, (2, 2)) + (np.conj(oriented) * np.fft.fft2(np.stack(planes))).sum(0)
    high, low, _, _ = steerable_windows(parts[0][0].shape, 1)
    return np.fft.ifft2(low * f + high * np.fft.fft2(parts[0][0])).real


def drawn(image: np.ndarray, shapes: list[tuple], color: tuple[float, float, float]) -> np.ndarray:
    """A colour image with circles ("circle", y, x, radius) and points ("point", y, x) over it; grey becomes colour."""
    out = np.repeat(image, 3, axis=0) if len(image) == 1 else image.copy()
    y, x = np.mgrid[: image.shape[1], : image.shape[2]]
    for kind, cy, cx, *r in shapes:
        d = np.hypot(y - cy, x - cx)
        on = np.abs(d - r[0]) < 0.5 if kind == "circle" else d < 1e-9
        out[:, on] = np.array(color)[:, None]
    return out
