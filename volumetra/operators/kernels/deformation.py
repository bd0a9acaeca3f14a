"""Non-rigid deformation by moving least squares (Schaefer et al. 2006) over corresponding points."""

from __future__ import annotations

import numpy as np

from volumetra.operators.kernels import detection, models


def deform(at: np.ndarray, source: np.ndarray, target: np.ndarray, alpha: float = 1.0, model: str = "AFFINE") -> np.ndarray:
    """Where the map from source to target points takes each place: a local model weighted by distance to the power -2 alpha."""
    out = np.zeros_like(at, dtype=float)
    if not len(source):
        return at.astype(float)
    for i, x in enumerate(at):
        d = ((source - x) ** 2).sum(axis=1)
        if d.min() < 1e-18:
            out[i] = target[d.argmin()]
            continue
        m = models.fit(source, target, model if len(source) >= models.NEEDED[model] + 1 else "TRANSLATION", 1 / d**alpha)
        out[i] = models.apply(m, x[None])[0]
    return out


def control_grid(low, high, spacing: float) -> tuple[list[np.ndarray], np.ndarray]:
    """Axes of a grid of control points that covers the box, and its points."""
    axes = [np.arange(a, b + spacing, spacing, dtype=float) for a, b in zip(low, high, strict=True)]
    return axes, np.stack(np.meshgrid(*axes, indexing="ij"), axis=-1).reshape(-1, 3)


def fuse_block(images: list[dict], low, high, spacing: float = 10.0, alpha: float = 1.0, width: float = 40.0) -> np.ndarray:
    """One block of the output: every view is looked up at the deformed place of each voxel, and the views are blended.

    Each of ``images`` has the array, its points ``own`` (in its pixels) and the places ``common`` they ought to have.
    """
    shape = [int(b - a + 1) for a, b in zip(low, high, strict=True)]
    voxels = np.stack(np.meshgrid(*[np.arange(a, b + 1, dtype=float) for a, b in zip(low, high, strict=True)], indexing="ij"), axis=-1).reshape(-1, 3)
    total, weight = np.zeros(len(voxels)), np.zeros(len(voxels))
    axes, control = control_grid(low, high, spacing)
    for image in images:
        moved = deform(control, image["common"], image["own"], alpha) - control
        field = moved.reshape(*[len(a) for a in axes], 3)
        scaled = (voxels - np.array([a[0] for a in axes])) / spacing
        at = voxels + np.stack([detection.sample(field[..., i], scaled) for i in range(3)], axis=-1)
        top = np.array(image["array"].shape) - 1
        edge = np.minimum(at, top - at)
        w = np.prod((1 - np.cos(np.pi * np.clip((edge + 1) / width, 0, 1))) / 2, axis=1) * (edge >= 0).all(axis=1)
        total += w * detection.sample(image["array"], at)
        weight += w
    return np.where(weight > 0, total / np.maximum(weight, 1e-12), 0).reshape(shape)
