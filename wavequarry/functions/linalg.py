"""Batched algebra of symmetric positive-definite matrices in NumPy."""

from __future__ import annotations

import numpy as np

CLIP = 1e-12


def of_eigenvalues(m: np.ndarray, f) -> np.ndarray:
    """V f(L) V^T of symmetric matrices (..., n, n)."""
    values, vectors = np.linalg.eigh(m)
    return (vectors * f(values)[..., None, :]) @ np.swapaxes(vectors, -1, -2)


def log(m: np.ndarray, clip: float = CLIP) -> np.ndarray:
    return of_eigenvalues(m, lambda v: np.log(np.maximum(v, clip)))


def exp(m: np.ndarray) -> np.ndarray:
    return of_eigenvalues(m, np.exp)


def root(m: np.ndarray, clip: float = CLIP) -> np.ndarray:
    return of_eigenvalues(m, lambda v: np.sqrt(np.maximum(v, clip)))


def inverse_root(m: np.ndarray, clip: float = CLIP) -> np.ndarray:
    return of_eigenvalues(m, lambda v: 1 / np.sqrt(np.maximum(v, clip)))


def whiten(m: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """R^-1/2 M R^-1/2."""
    w = inverse_root(reference)
    return w @ m @ w


def distance(a: np.ndarray, b: np.ndarray, clip: float = CLIP) -> np.ndarray:
    """Affine-invariant distance: norm of the logarithms of the eigenvalues of A^-1/2 B A^-1/2."""
    values = np.linalg.eigvalsh(whiten(b, a))
    return np.sqrt((np.log(np.maximum(values, clip)) ** 2).sum(-1))


def tangent(m: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Upper triangle, row by row, of the logarithm of the whitened matrices; off-diagonal times sqrt 2."""
    return upper(log(whiten(m, reference)))


def upper(m: np.ndarray) -> np.ndarray:
    i, j = np.triu_indices(m.shape[-1])
    return m[..., i, j] * np.where(i == j, 1.0, np.sqrt(2.0))


def from_upper(v: np.ndarray) -> np.ndarray:
    """The symmetric matrices of ``upper``."""
    n = int((np.sqrt(8 * v.shape[-1] + 1) - 1) / 2)
    i, j = np.triu_indices(n)
    m = np.zeros((*v.shape[:-1], n, n))
    m[..., i, j] = v / np.where(i == j, 1.0, np.sqrt(2.0))
    return m + np.swapaxes(np.triu(m, 1), -1, -2)


def along(a: np.ndarray, b: np.ndarray, share: float) -> np.ndarray:
    """The point at ``share`` of the geodesic from A to B."""
    values, vectors = np.linalg.eigh(a)
    values, back = np.sqrt(np.maximum(values, CLIP))[..., None, :], np.swapaxes(vectors, -1, -2)
    r, w = (vectors * values) @ back, (vectors * (1 / values)) @ back
    m = r @ of_eigenvalues(w @ b @ w, lambda v: np.maximum(v, CLIP) ** share) @ r
    return (m + np.swapaxes(m, -1, -2)) / 2


def covariances(x: np.ndarray, ddof: int = 1, ridge: float = 1e-6) -> np.ndarray:
    """Covariances (k, c, c) of epochs (k, samples, c) with ``ridge`` on the diagonal."""
    z = x - x.mean(-2, keepdims=True)
    return np.swapaxes(z, -1, -2) @ z / (x.shape[-2] - ddof) + ridge * np.eye(x.shape[-1])
