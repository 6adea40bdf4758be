"""Scale-invariant features after Lowe (2004), in numpy on stacks of gray images of one size.

Constants are those of the paper: three scales an octave, base blur 1.6, assumed camera blur
0.5, edge ratio 10, 36 orientation bins with peaks above 0.8 of the highest, descriptors of
4 x 4 cells with 8 directions, cut at 0.2. Peaks need a contrast of 3 gray levels.
"""

from __future__ import annotations

import functools
import math

import numpy as np

SCALES, BLUR, CAMERA, CONTRAST, EDGE = 3, 1.6, 0.5, 3.0, 10.0
BEFORE, AFTER = np.roll(np.arange(36), 1), np.roll(np.arange(36), -1)  # the bins beside each
EVEN = np.linalg.matrix_power((np.eye(36) + np.eye(36)[BEFORE] + np.eye(36)[AFTER]) / 3, 6)  # a histogram's means of three bins, six times
MATRIX_SIDE = 128  # longer sides are blurred by windows, as a matrix grows with the square of the side
STACK_PIXELS = 80_000  # of the images described at once
HELD_KEYPOINTS = 32  # whose patches are summed at once, so that they stay in a core's cache


def _kernel(sigma: float) -> np.ndarray:
    r = max(1, math.ceil(4 * sigma))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return k / k.sum()


@functools.lru_cache(maxsize=256)
def _blur(n: int, sigma: float) -> np.ndarray:
    """The blur of n pixels as a matrix; the outermost pixels stand for those beyond."""
    k, at = _kernel(sigma), np.arange(n)[:, None]
    out = np.zeros((n, n))
    np.add.at(out, (at, np.clip(at + np.arange(len(k)) - len(k) // 2, 0, n - 1)), k)
    return out


def _smooth(image: np.ndarray, sigma: float) -> np.ndarray:
    """The image, or each of a stack, blurred along its last two axes."""
    if sigma < 0.05:
        return image
    for axis in (image.ndim - 2, image.ndim - 1):
        n = image.shape[axis]
        if n <= MATRIX_SIDE:
            image = image @ _blur(n, sigma).T if axis == image.ndim - 1 else _blur(n, sigma) @ image
        else:
            k = _kernel(sigma)
            wide = np.pad(image, [(len(k) // 2,) * 2 if a == axis else (0, 0) for a in range(image.ndim)], mode="edge")
            image = np.tensordot(np.lib.stride_tricks.sliding_window_view(wide, len(k), axis), k, ([image.ndim], [0]))
    return image


def _octaves(stack: np.ndarray):
    """(step, levels of n images x SCALES + 3 x height x width) of each octave."""
    step = 2 ** (1 / SCALES)
    base = _smooth(stack, math.sqrt(max(BLUR**2 - CAMERA**2, 0)))
    for o in range(max(int(math.log2(min(stack.shape[1:]))) - 3, 1)):
        levels = np.empty((len(stack), SCALES + 3, *base.shape[1:]))
        levels[:, 0] = base
        for s in range(1, SCALES + 3):
            base = levels[:, s] = _smooth(base, BLUR * step ** (s - 1) * math.sqrt(step**2 - 1))
        yield 2**o, levels
        base = np.ascontiguousarray(levels[:, SCALES, ::2, ::2])
        if min(base.shape[1:]) < 8:
            return


def _peaks(dog: np.ndarray) -> np.ndarray:
    """Flat places, in order, of the extrema among 26 neighbours with some contrast; few pixels pass the two beside them."""
    flat, (_, scales, h, w) = dog.ravel(), dog.shape
    strong = np.abs(flat[1:-1]) > 0.8 * CONTRAST
    around = sorted(((a * h + b) * w + c for a, b, c in np.ndindex(3, 3, 3) if (a, b) != (1, 1)), key=lambda k: abs(k - (h + 1) * w - 1))
    found = []
    for beyond in (np.greater, np.less):
        at = np.flatnonzero(beyond(flat[1:-1], flat[:-2]) & beyond(flat[1:-1], flat[2:]) & strong) + 1
        _, s, y, x = np.unravel_index(at, dog.shape)
        at = at[(s > 0) & (s < scales - 1) & (y > 0) & (y < h - 1) & (x > 0) & (x < w - 1)]
        for k in around:
            at = at[beyond(flat[at], flat[at + (k - (h + 1) * w - 1)])]
        found.append(at)
    return np.sort(np.concatenate(found))


def _solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The solution of each system, nought where there is none."""
    try:
        return np.linalg.solve(a, b[..., None])[..., 0]
    except np.linalg.LinAlgError:
        return np.zeros(b.shape) if len(a) == 1 else np.concatenate([_solve(a[k:k + 1], b[k:k + 1]) for k in range(len(a))])


def _extrema(dog: np.ndarray):
    """(image, x, y, s), refined, of the extrema that pass contrast and edge tests, by image and place."""
    flat, (_, scales, h, w) = dog.ravel(), dog.shape
    at, n = _peaks(dog), h * w
    image, s, y, x = np.unravel_index(at, dog.shape)
    shift, value, edge, open_ = np.zeros((len(at), 3)), np.zeros(len(at)), np.zeros(len(at), bool), np.arange(len(at))
    for _ in range(5):
        here = ((image[open_] * scales + s[open_]) * h + y[open_]) * w + x[open_]
        c = lambda a, b, d: flat[here + (a * n + b * w + d)]  # noqa: B023, E731
        mid, sides = c(0, 0, 0), [(c(0, 0, 1), c(0, 0, -1)), (c(0, 1, 0), c(0, -1, 0)), (c(1, 0, 0), c(-1, 0, 0))]
        g = np.stack([(up - down) / 2 for up, down in sides], 1)
        dxx, dyy, dss = (up + down - 2 * mid for up, down in sides)
        dxy = (c(0, 1, 1) - c(0, 1, -1) - c(0, -1, 1) + c(0, -1, -1)) / 4
        dxs = (c(1, 0, 1) - c(1, 0, -1) - c(-1, 0, 1) + c(-1, 0, -1)) / 4
        dys = (c(1, 1, 0) - c(1, -1, 0) - c(-1, 1, 0) + c(-1, -1, 0)) / 4
        by = -_solve(np.stack([dxx, dxy, dxs, dxy, dyy, dys, dxs, dys, dss], 1).reshape(-1, 3, 3), g)
        det = dxx * dyy - dxy * dxy
        shift[open_], value[open_] = by, mid + (g * by).sum(axis=1) / 2
        edge[open_] = (det > 0) & ((dxx + dyy) ** 2 < (EDGE + 1) ** 2 / EDGE * det)
        move = (by[:, :2] > 0.6).astype(int) - (by[:, :2] < -0.6)
        nx, ny = x[open_] + move[:, 0], y[open_] + move[:, 1]
        on = move.any(axis=1) & (nx >= 1) & (nx < w - 1) & (ny >= 1) & (ny < h - 1)
        open_ = open_[on]
        x[open_], y[open_] = nx[on], ny[on]
        if not len(open_):
            break
    good = (np.abs(value) > CONTRAST) & edge & (np.abs(shift).max(axis=1, initial=0) < 1.5)
    return image[good], (x + shift[:, 0])[good], (y + shift[:, 1])[good], (s + shift[:, 2])[good]


def _gradients(levels: np.ndarray):
    gy, gx = np.gradient(levels, axis=(1, 2))
    angle = np.arctan2(gy, gx)
    angle += (angle < 0) * (2 * np.pi)
    return np.sqrt(gx * gx + gy * gy), angle


def _rows(y0, y1):
    """(keypoint, y) of each row of patches from y0 to before y1."""
    n = np.maximum(y1 - y0, 0)
    of = np.repeat(np.arange(len(n)), n)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n - y0, n)


def _orientations(mod, angle, page, x, y, sigma):
    """(keypoint, direction) of up to four directions each; mod and angle are pages of height x width."""
    (_, h, w), radius = mod.shape, 4.5 * sigma
    whole = lambda z: np.trunc(z).astype(np.int64)
    x0, x1 = np.maximum(whole(x - radius), 0), np.minimum(whole(x + radius) + 2, w)
    of, row = _rows(np.maximum(whole(y - radius), 0), np.minimum(whole(y + radius) + 2, h))
    n = (x1 - x0)[of]
    col = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - x0[of], n)
    at = np.repeat((page[of] * h + row) * w, n) + col
    near = np.exp(-((col - np.repeat(x[of], n)) ** 2 + np.repeat((row - y[of]) ** 2, n)) / np.repeat(2 * (1.5 * sigma[of]) ** 2, n))
    bins = (angle.ravel()[at] * (18 / np.pi)).astype(np.int64)
    bins[bins == 36] = 0
    hist = np.bincount(np.repeat(of * 36, n) + bins, mod.ravel()[at] * near, len(x) * 36).reshape(-1, 36)
    hist = hist @ EVEN
    left, right = hist[:, BEFORE], hist[:, AFTER]
    of, k = np.nonzero((hist > left) & (hist > right) & (hist > 0.8 * hist.max(axis=1, keepdims=True)))
    first = np.arange(len(of)) - np.searchsorted(of, of) < 4
    of, k = of[first], k[first]
    left, mid, right = left[of, k], hist[of, k], right[of, k]
    bend = left - 2 * mid + right  # below nought at a peak
    return of, ((k + 0.5 + 0.5 * (left - right) / bend) * 2 * np.pi / 36) % (2 * np.pi)


def _descriptors(mod, angle, page, x, y, sigma, theta) -> np.ndarray:
    """A descriptor of 128 of each keypoint; mod and angle are pages of height x width.

    A pixel's share of a cell is linear in its place between two cells, so each cell takes the sums of the weights
    times 1 and the fractions of the three places, and the shares of the eight corners are made of these sums.
    """
    (_, h, w), side, cos, sin = mod.shape, 3 * sigma, np.cos(theta), np.sin(theta)
    reach = 2.5 * side * (1 - 1e-12)  # a pixel on the border has no share
    far = reach * (np.abs(cos) + np.abs(sin))
    of, row = _rows(np.maximum(np.ceil(y - far), 0).astype(np.int64), np.minimum(np.floor(y + far) + 1, h).astype(np.int64))
    dy, lo, hi = row - y[of], -x[of], w - 1 - x[of]
    for a, b in ((cos, sin), (-sin, cos)):  # the pixels of a row with |a dx + b dy| < reach
        a = np.where(np.abs(a) < 1e-12, 1e-12, a)
        mid, half = -(b / a)[of] * dy, (reach / np.abs(a))[of]
        lo, hi = np.maximum(lo, mid - half), np.minimum(hi, mid + half)
    start = np.ceil(x[of] + lo)
    n = np.maximum(np.floor(x[of] + hi) - start + 1, 0).astype(np.int64)
    along = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = np.repeat((page[of] * h + row) * w + start.astype(np.int64), n) + along
    dx, c, s = start - x[of], (cos / side)[of], (sin / side)[of]
    u = np.repeat(c * dx + s * dy, n) + np.repeat(c, n) * along
    v = np.repeat(c * dy - s * dx, n) - np.repeat(s, n) * along
    weight = mod.ravel()[at] * np.exp((u * u + v * v) * -0.125)
    u, v, d = u + 1.5, v + 1.5, angle.ravel()[at] * (4 / np.pi) - np.repeat((theta * (4 / np.pi))[of], n)
    fu, fv, fd = np.floor(u), np.floor(v), np.floor(d)
    cell = np.repeat(of * 200 + 48, n) + (fv * 40 + fu * 8).astype(np.int64) + (fd.astype(np.int64) & 7)
    u, v, d = u - fu, v - fv, d - fd
    sums = np.empty((2, 2, len(x), 5, 5, 8))  # v, u and direction; the first and last take what lies outside the 4 x 4
    for i in (0, 1):
        across = weight * v if i else weight
        for j in (0, 1):
            both = across * u if j else across
            here, onward = (np.bincount(cell, z, len(x) * 200).reshape(-1, 5, 5, 8) for z in (both, both * d))
            np.subtract(here, onward, out=sums[i, j])
            sums[i, j, ..., 1:] += onward[..., :-1]
            sums[i, j, ..., 0] += onward[..., -1]
    sums = sums[:, 0, :, :, 1:] - sums[:, 1, :, :, 1:] + sums[:, 1, :, :, :-1]
    desc = (sums[0, :, 1:] - sums[1, :, 1:] + sums[1, :, :-1]).reshape(-1, 128)
    unit = lambda z: z / np.where(norm := np.linalg.norm(z, axis=1, keepdims=True), norm, 1)
    return unit(np.minimum(unit(np.minimum(unit(desc), 0.2)), 0.2))


def _descriptor(mod, angle, x, y, sigma, theta) -> np.ndarray:
    return _descriptors(mod[None], angle[None], np.zeros(1, np.int64), *(np.array([z]) for z in (x, y, sigma, theta)))[0]


def describe_stack(stack: np.ndarray):
    """(image, x, y, size, direction, descriptors) of the features of n images of one size, as arrays by image; descriptors are doubled and cut at 1."""
    found = []
    for scale, levels in _octaves(stack):
        image, x, y, s = _extrema(np.diff(levels, axis=1))
        level = np.clip(np.rint(s).astype(np.int64), 0, levels.shape[1] - 1)
        pages, page = np.unique(image * levels.shape[1] + level, return_inverse=True)
        mod, angle = _gradients(levels.reshape(-1, *levels.shape[2:])[pages])
        sigma = BLUR * 2 ** (s / SCALES)
        for k in range(0, len(x), HELD_KEYPOINTS):
            part = slice(k, k + HELD_KEYPOINTS)
            of, theta = _orientations(mod, angle, page[part], x[part], y[part], sigma[part])
            of += k
            desc = _descriptors(mod, angle, page[of], x[of], y[of], sigma[of], theta)
            found.append((image[of], x[of] * scale, y[of] * scale, sigma[of] * scale, theta, np.minimum(2 * desc, 1)))
    if not found:
        return np.zeros(0, np.int64), *(np.zeros(0) for _ in range(4)), np.zeros((0, 128))
    found = [np.concatenate(column) for column in zip(*found)]
    order = np.argsort(found[0], kind="stable")
    return tuple(column[order] for column in found)


def describe(image: np.ndarray):
    """(x, y, size, direction, descriptor of 128) of each feature of one image."""
    yield from zip(*describe_stack(image[None])[1:])


def place_keypoint(x: float, y: float, sigma: float, octaves: int, least_octave: int = 0, scales: int = SCALES) -> tuple[int, int, int, int, float]:
    """(octave, level, column, row, exact level) of a keypoint of an image given by place and scale.

    From sigma = BLUR * 2^(octave + level / scales): the greatest octave in which the level is at least half a step
    above the lowest one, both kept within the pyramid's levels -1 .. scales + 1.
    """
    phi = math.log2(sigma / BLUR)
    octave = min(max(math.floor(phi + 0.5 / scales), least_octave), least_octave + octaves - 1)
    exact = scales * (phi - octave)
    level = min(max(math.floor(exact + 0.5), 0), scales - 1)
    step = 2.0**octave
    return octave, level, math.floor(x / step + 0.5), math.floor(y / step + 0.5), exact


def distance(a: np.ndarray, b: np.ndarray) -> float:
    """Euclidean distance of two descriptors."""
    return float(np.linalg.norm(np.asarray(a, float) - np.asarray(b, float)))
