"""Small dense algebra on the driver and inside tasks: a population's matrices have one row for each scale or mode."""

from __future__ import annotations

import numpy as np


def signed_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled so that each one's largest component is real and positive: a fixed choice of sign or phase."""
    at = np.abs(vectors).argmax(axis=1)
    lead = vectors[np.arange(len(vectors)), at]
    return vectors * (np.conj(lead) / np.maximum(np.abs(lead), 1e-300))[:, None]


def descending(matrix: np.ndarray, floor: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a Hermitian matrix from large to small and eigenvectors as rows."""
    values, vectors = np.linalg.eigh(matrix)
    values, vectors = values[::-1], signed_rows(vectors.T[::-1].conj()).conj()
    return (values if floor is None else np.maximum(values, floor)), vectors


def n_modes(values: np.ndarray, wanted: int | str, share: float = 0.95) -> int:
    """An integer as it is; "ev95" or "share": the fewest modes that explain the share, one if there is no variance."""
    if isinstance(wanted, (int, np.integer)) and not isinstance(wanted, bool):
        return max(1, min(int(wanted), len(values)))
    if wanted not in ("ev95", "share"):
        raise ValueError(f"n_modes is an integer, 'ev95' or 'share', not {wanted!r}; selection by folds is in operators.selection")
    total = values.sum()
    if total <= 0:
        return 1
    return min(int(np.searchsorted(np.cumsum(values) / total, share) + 1), len(values))


def cosine_modes(points: int, modes: int) -> np.ndarray:
    """Orthonormal cosine modes as rows: a basis that needs no fit."""
    j, m = np.arange(points), np.arange(modes)[:, None]
    return np.where(m == 0, np.sqrt(1 / points), np.sqrt(2 / points) * np.cos(np.pi * m * (j + 0.5) / points))


def fourier(hours: np.ndarray, harmonics: int, period: float = 24.0, intercept: bool = False) -> np.ndarray:
    """Columns cos and sin of each harmonic, after a column of ones if asked."""
    w = 2 * np.pi / period * np.asarray(hours, float)
    columns = [np.ones_like(w)] if intercept else []
    for r in range(1, harmonics + 1):
        columns += [np.cos(r * w), np.sin(r * w)]
    return np.stack(columns, axis=1)


def prior(spectra: np.ndarray, scale: float = 0.5) -> np.ndarray:
    """Block diagonal over harmonics of scale * [[Re, -Im], [Im, Re]]; within a block all cosines come first."""
    r, m, _ = spectra.shape
    out = np.zeros((2 * r * m, 2 * r * m))
    for k in range(r):
        s = spectra[k]
        out[2 * m * k : 2 * m * (k + 1), 2 * m * k : 2 * m * (k + 1)] = scale * np.block([[s.real, -s.imag], [s.imag, s.real]])
    return out


def aligned_order(harmonics: int, modes: int) -> np.ndarray:
    """Positions in the harmonic-by-harmonic prior of coefficients ordered mode by mode (cos 1, sin 1, cos 2, ...)."""
    return np.array([2 * modes * r + modes * part + m for m in range(modes) for r in range(harmonics) for part in (0, 1)])


def posterior_covariance(precision: np.ndarray, x: np.ndarray, modes: int, noise: float, ridge: float, form: str = "cheaper") -> np.ndarray:
    """Covariance of a subject's coefficients, mode by mode; the design repeats over modes, and nothing else of a subject enters.

    The primal form solves with a row for each coefficient, the dual form with one for each observed score, which is fewer where a subject has
    fewer hours than the design has columns; "cheaper" takes the smaller.
    """
    prior = precision + ridge * np.eye(len(precision))
    if form == "primal" or form == "cheaper" and len(x) >= x.shape[1]:
        p = prior + np.kron(np.eye(modes), x.T @ x) / noise
        return np.linalg.solve(p, np.eye(len(p)))
    h, spread = np.kron(np.eye(modes), x), np.linalg.inv(prior)
    across = h @ spread
    return spread - across.T @ np.linalg.solve(across @ h.T + noise * np.eye(len(h)), across)


def posterior(precision: np.ndarray, x: np.ndarray, centred: np.ndarray, noise: float, ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of a subject's coefficients."""
    covariance = posterior_covariance(precision, x, centred.shape[1], noise, ridge)
    return covariance @ (x.T @ centred).T.reshape(-1) / noise, covariance


def trapezoid(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((values[..., 1:] + values[..., :-1]) / 2 * np.diff(at)).sum(axis=-1)


def minimised(loss, start: np.ndarray, steps: int = 200, memory: int = 10, tolerance: float = 1e-8) -> tuple[np.ndarray, list[float]]:
    """Limited-memory quasi-Newton descent with backtracking. loss(w) returns the value and the gradient."""
    w = start.copy()
    value, g = loss(w)
    pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
    path = [value]
    for _ in range(steps):
        q, weights = g.copy(), []
        for s, y, rho in reversed(pairs):
            a = rho * (s @ q)
            weights.append(a)
            q -= a * y
        if pairs:
            s, y, _ = pairs[-1]
            q *= (s @ y) / (y @ y)
        for (s, y, rho), a in zip(pairs, reversed(weights), strict=True):
            q += s * (a - rho * (y @ q))
        slope = -(g @ q)
        if slope >= 0:
            q, slope, pairs = g, -(g @ g), []
        step = 1.0 if pairs else min(1.0, 1.0 / (np.abs(g).sum() + 1e-12))
        for _ in range(30):
            after, g_after = loss(w - step * q)
            if after <= value + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, y = -step * q, g_after - g
        if s @ y > 1e-12:
            pairs = [*pairs, (s, y, 1 / (s @ y))][-memory:]
        w, g = w + s, g_after
        path.append(after)
        if abs(value - after) <= tolerance * max(1.0, abs(value)):
            break
        value = after
    return w, path
