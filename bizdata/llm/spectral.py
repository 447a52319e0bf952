"""Eigenvectors of a symmetric matrix by spectral divide and conquer.

The orthogonal factor of the polar decomposition of A - s I is the sign of that matrix, so (I + sign) / 2 projects on
the eigenvectors whose eigenvalue is above the shift s. The factor comes from the dynamically weighted Halley iteration
with QR steps, which converges in a handful of steps whatever the condition. The projector splits the space into two
invariant subspaces; the matrix is compressed to each, and each is split again, down to single directions.
"""

import numpy as np

EPS = np.finfo(float).eps
MAX_STEPS = 40


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal factor of the polar decomposition of a square matrix that is not singular."""
    n = len(a)
    x = a / np.linalg.norm(a)
    # the Frobenius norm of the inverse is at least the inverse of the smallest singular value
    triangle = np.linalg.qr(x, mode="r")
    diagonal = np.abs(np.diag(triangle))
    low = 1 / np.linalg.norm(np.linalg.inv(triangle)) if diagonal.min() > EPS * EPS else EPS
    low = float(np.clip(low, EPS * EPS, 1.0))
    eye = np.eye(n)
    for _ in range(MAX_STEPS):
        square = low * low
        g = (4 * (1 - square) / square**2) ** (1 / 3)
        root = np.sqrt(1 + g)
        p = root + 0.5 * np.sqrt(8 - 4 * g + 8 * (2 - square) / (square * root))
        q = (p - 1) ** 2 / 4
        r = p + q - 1
        stacked, _ = np.linalg.qr(np.vstack([np.sqrt(r) * x, eye]))
        new = q / r * x + (p - q / r) / np.sqrt(r) * stacked[:n] @ stacked[n:].T
        moved = np.linalg.norm(new - x)
        x = new
        low = min(low * (p + q * square) / (1 + r * square), 1.0)
        if moved < n * EPS ** (1 / 3) * 1e-1 and 1 - low < 10 * EPS:
            break
    # one Newton-Schulz step takes off what rounding has left
    return 1.5 * x - 0.5 * x @ (x.T @ x)


def split(a: np.ndarray, shift: float, rng: np.random.Generator) -> tuple[np.ndarray, int] | None:
    """An orthogonal basis whose first k columns span the eigenvectors above the shift, and k. None if the shift does not
    separate, or lies on an eigenvalue."""
    n = len(a)
    moved = a - shift * np.eye(n)
    if not np.linalg.norm(moved):
        return None
    sign = polar(moved)
    projector = (np.eye(n) + (sign + sign.T) / 2) / 2
    k = int(round(np.trace(projector)))
    if not 0 < k < n:
        return None
    basis, _ = np.linalg.qr(projector @ rng.normal(size=(n, k)), mode="complete")
    # a second application makes the range as exact as the projector is
    basis, _ = np.linalg.qr(projector @ basis[:, :k], mode="complete")
    left = np.linalg.norm(basis[:, :k].T @ a @ basis[:, k:])
    return (basis, k) if left <= 100 * n * EPS * np.linalg.norm(a) else None


def directions(a: np.ndarray, scale: float, rng: np.random.Generator) -> np.ndarray:
    """Orthonormal eigenvectors of a symmetric matrix as columns, in no order."""
    n = len(a)
    if n == 1:
        return np.eye(1)
    middle = np.trace(a) / n
    if np.linalg.norm(a - middle * np.eye(n)) <= n * EPS * scale:
        return np.eye(n)  # a multiple of the identity, as far as rounding tells: any basis will do
    diagonal = np.sort(np.diag(a))
    spread = max(diagonal[-1] - diagonal[0], np.linalg.norm(a - np.diag(np.diag(a))), EPS * scale)
    tried = [float(np.median(diagonal)), float(middle), *(middle + spread * rng.uniform(-0.5, 0.5, 40))]
    for shift in tried:
        found = split(a, shift, rng)
        if found:
            break
    else:
        return np.eye(n)  # no shift tells the eigenvalues apart
    basis, k = found
    parts = []
    for side in (basis[:, :k], basis[:, k:]):
        inner = side.T @ a @ side
        parts.append(side @ directions((inner + inner.T) / 2, scale, rng))
    return np.hstack(parts)


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric positive semi-definite matrix from the largest on, and their unit eigenvectors as columns.
    Deterministic; the sign of a column makes its largest entry positive."""
    if not len(a):
        return np.zeros(0), np.zeros((0, 0))
    a = (a + a.T) / 2
    vectors = directions(a, max(float(np.linalg.norm(a)), np.finfo(float).tiny), np.random.default_rng(0))
    vectors, _ = np.linalg.qr(vectors)
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")
    values, vectors = np.maximum(values[order], 0.0), vectors[:, order]
    largest = vectors[np.abs(vectors).argmax(0), np.arange(len(a))]
    return values, vectors * np.where(largest < 0, -1.0, 1.0)
