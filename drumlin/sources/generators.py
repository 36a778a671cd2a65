"""Synthetic clouds with known clusters, from NumPy's seeded generator."""

from __future__ import annotations

import numpy as np

DENSITIES, SHAPES = ("dense", "sparse", "mixed"), ("blobs", "moons", "spiral")


def gaussian_blobs(centres, per_blob: int, sigma: float, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    c = np.asarray(centres, dtype=float)
    x = np.repeat(c, per_blob, axis=0) + rng.normal(0, sigma, (len(c) * per_blob, c.shape[1]))
    return x, np.repeat(np.arange(len(c)), per_blob)


def uniform_noise(n: int, low, high, seed: int = 0) -> np.ndarray:
    return np.random.default_rng(seed).uniform(low, high, (n, len(np.atleast_1d(low))))


# Centre distances in spreads, and the shapes' jitter, scale and thickness.
SEPARATION = {"dense": 2.0, "sparse": 10.0, "mixed": 5.0}
JITTER, SCALE, THICKNESS = {"dense": 0.09, "sparse": 0.04, "mixed": 0.06}, {"dense": 6.0, "sparse": 12.0, "mixed": 9.0}, 0.10


def _finish(x: np.ndarray, y: np.ndarray, noise: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """With `noise` uniform points over the box, label -1, in an order that tells nothing."""
    if noise and len(x):
        low, high = x.min(axis=0), x.max(axis=0)
        x = np.vstack([x, rng.uniform(low, np.where(high > low, high, low + 1), (noise, x.shape[1]))])
        y = np.concatenate([y, np.full(noise, -1)])
    order = rng.permutation(len(x))
    return x[order], y[order]


def _populations(n: int, k: int, even: bool, rng: np.random.Generator) -> np.ndarray:
    """How many of n points each of k clusters has: alike, or drawn with five at least."""
    if even:
        return np.diff(np.arange(k + 1) * n // k)
    counts = np.maximum((rng.dirichlet(np.full(k, 2.0)) * n).astype(int), 5)
    over = counts.sum() - n
    while over > 0 and counts.max() > 5:
        take = min(over, int(counts.max()) - 5)
        counts[counts.argmax()] -= take
        over -= take
    counts[counts.argmin()] -= over
    return counts


def blobs_nd(n: int, dim: int, k: int, density: str = "dense", noise: float = 0.0, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """k blobs whose two nearest centres lie SEPARATION spreads apart (the widest spread, where
    they are mixed); a share `noise` of the n points is uniform background."""
    if density not in DENSITIES:
        raise ValueError(f"density must be one of {DENSITIES}")
    rng = np.random.default_rng(seed)
    background = int(round(n * noise))
    mixed = density == "mixed"
    sigma = rng.uniform(0.6, 1.5, k) if mixed else np.ones(k)
    centres = rng.normal(size=(k, dim)) if k > 1 else np.zeros((1, dim))
    if k > 1:
        gaps = np.linalg.norm(centres[:, None] - centres[None], axis=2)[np.triu_indices(k, 1)]
        centres *= SEPARATION[density] * sigma.max() / gaps.min()
    y = np.repeat(np.arange(k), _populations(n - background, k, not mixed, rng))
    return _finish(centres[y] + rng.normal(size=(len(y), dim)) * sigma[y, None], y, background, rng)


def moons(n: int, jitter: float = 0.08, scale: float = 10.0, seed: int = 0, spaced: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Two interleaving half circles, evenly spaced or drawn."""
    rng = np.random.default_rng(seed)
    y = np.repeat([0, 1], [n // 2, n - n // 2])
    t = np.concatenate([np.linspace(0, np.pi, m) if spaced else rng.uniform(0, np.pi, m) for m in (n // 2, n - n // 2)])
    x = np.where(y[:, None] == 0, np.c_[np.cos(t), np.sin(t)], np.c_[1 - np.cos(t), 0.5 - np.sin(t)])
    return (x + rng.normal(0, jitter, x.shape)) * scale, y


def spirals(n: int, jitter: float = 0.09, scale: float = 6.0, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Two interleaved arms that begin a quarter of the radius from the middle."""
    rng = np.random.default_rng(seed)
    y = np.repeat([0, 1], [n // 2, n - n // 2])
    r = 0.25 + 0.75 * np.sqrt(rng.uniform(size=n))
    a = 2.5 * np.pi * r + np.pi * y
    return (np.c_[r * np.cos(a), r * np.sin(a)] + rng.normal(0, jitter, (n, 2))) * scale, y


def shape_nd(shape: str, n: int, dim: int, density: str = "dense", noise: float = 0.0, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """A plane shape with a little thickness, turned into `dim` dimensions by a random rotation."""
    if density not in DENSITIES:
        raise ValueError(f"density must be one of {DENSITIES}")
    background, rng = int(round(n * noise)), np.random.default_rng(seed + 1)
    made = moons(n - background, JITTER[density], SCALE[density], seed, spaced=False) if shape == "moons" else spirals(n - background, JITTER[density], SCALE[density], seed)
    x, y = made
    if dim > 2:
        thick = rng.normal(0, THICKNESS, (len(x), dim - 2))
        x = np.hstack([x, thick]) @ np.linalg.qr(rng.normal(size=(dim, dim)))[0].T
    return _finish(x[:, :dim], y, background, rng)


def generate(n: int, dim: int, k: int, density: str = "dense", noise: float = 0.0, shape: str = "blobs", seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    if shape not in SHAPES:
        raise ValueError(f"shape must be one of {SHAPES}")
    return blobs_nd(n, dim, k, density, noise, seed) if shape == "blobs" else shape_nd(shape, n, dim, density, noise, seed)


def angular_blobs(n: int, dim: int, k: int, jitter: float = 0.12, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors around k random directions."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(k, dim))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    y = np.arange(n) % k
    x = centres[y] + rng.normal(0, jitter, (n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True), y


def toy(name: str, n: int = 600, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Plane toys: four blobs of one spread; moons; a dense, a wide and a long blob in noise;
    two tight blobs whose gap is less than the spacing inside a wide disk, in noise."""
    rng = np.random.default_rng(seed)
    if name == "moons":
        return moons(n, seed=seed)
    if name == "blobs":
        return gaussian_blobs([(-6, -6), (0, 5), (6, -1), (7, 6)], n // 4, 0.6, seed)
    if name == "varied":
        centres, spread = np.array([(-10, -8), (10, 8), (0, 10)]), np.array([(0.5, 0.5), (2.2, 2.2), (4.0, 0.4)])
        y = np.repeat(np.arange(3), n // 4)
        x, rest, box = centres[y] + rng.normal(size=(len(y), 2)) * spread[y], n - len(y), ((-16, -14), (16, 16))
    elif name == "density":
        tight, wide, rest = (max(1, int(round(n * share))) for share in (0.25, 0.32, 0.05))
        y = np.repeat(np.arange(3), [tight, tight, wide])
        r, a = 6 * np.sqrt(rng.uniform(size=wide)), rng.uniform(0, 2 * np.pi, wide)
        pair = np.array([(-1.0, 0.0), (1.0, 0.0)])[y[y < 2]] + rng.normal(0, 0.22, (2 * tight, 2))
        x, box = np.vstack([pair, np.c_[r * np.cos(a), 9 + r * np.sin(a)]]), ((-7, -4), (7, 16))
    else:
        raise ValueError("toys are blobs, moons, varied and density")
    order = rng.permutation(len(x) + rest)
    return np.vstack([x, rng.uniform(*box, (rest, 2))])[order], np.concatenate([y, np.full(rest, -1)])[order]
