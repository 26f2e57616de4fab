"""State smoothing through the posterior precision, which is block tridiagonal; numpy.

The cost is linear in time and cubic in the state, with no covariance recursion: means
come from one factorisation and two sweeps, covariances from the selected inverse.
Observations can be collapsed to the state's dimension first, whatever their number.
"""

from __future__ import annotations

import numpy as np

from .statespace import StateSpace


def block_cholesky(D: np.ndarray, E: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower factor of a block tridiagonal matrix with diagonal blocks D[t] and blocks E[t] at (t + 1, t)."""
    L, B = np.zeros_like(D), np.zeros_like(E)
    for t in range(len(D)):
        S = D[t] - (B[t - 1] @ B[t - 1].T if t else 0)
        L[t] = np.linalg.cholesky((S + S.T) / 2)
        if t < len(E):
            B[t] = np.linalg.solve(L[t], E[t].T).T
    return L, B


def block_solve(L: np.ndarray, B: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solve with the factor; b has a row for each block."""
    n = len(L)
    x = b.astype(float).copy()
    for t in range(n):
        x[t] = np.linalg.solve(L[t], x[t] - (B[t - 1] @ x[t - 1] if t else 0))
    for t in range(n - 1, -1, -1):
        x[t] = np.linalg.solve(L[t].T, x[t] - (B[t].T @ x[t + 1] if t < n - 1 else 0))
    return x


def selected_inverse(L: np.ndarray, B: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of the inverse on the diagonal and at (t + 1, t), from the last to the first."""
    n, m = len(L), L.shape[1]
    S, C = np.zeros_like(L), np.zeros_like(B)
    I = np.eye(m)  # noqa: E741
    for t in range(n - 1, -1, -1):
        inv = np.linalg.solve(L[t], I)
        own = inv.T @ inv
        if t == n - 1:
            S[t] = own
        else:
            G = np.linalg.solve(L[t].T, B[t].T).T  # B L^-1
            C[t] = -S[t + 1] @ G
            S[t] = own + G.T @ S[t + 1] @ G
    return S, C


def precision_smoother(model: StateSpace, y: np.ndarray, floor: float = 1e-9) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smoothed means, covariances and lag-one covariances; Q gets a floor where it is singular."""
    n_t, m = len(y), len(model.a0)
    Qi = np.linalg.inv(model.Q + floor * np.eye(m))
    Pi = np.linalg.inv(model.P0 + floor * np.eye(m))
    TQ = model.T.T @ Qi
    D, E, b = np.zeros((n_t, m, m)), np.zeros((n_t - 1, m, m)), np.zeros((n_t, m))
    for t in range(n_t):
        ok = ~np.isnan(y[t])
        Z = model.z(t)[ok]
        W = Z.T / model.H[ok]
        D[t] = (Qi if t else Pi) + W @ Z + (TQ @ model.T if t < n_t - 1 else 0)
        b[t] = W @ y[t, ok] + (0 if t else Pi @ model.a0)
        if t < n_t - 1:
            E[t] = -Qi @ model.T
    L, B = block_cholesky(D, E)
    S, C = selected_inverse(L, B)
    return block_solve(L, B, b), S, np.concatenate([np.zeros((1, m, m)), C])


def collapse(model: StateSpace, y: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Per period the generalised least squares estimate of the observed combination of states, and its precision:
    sufficient for the state whatever the number of series."""
    est, precision = [], []
    for t in range(len(y)):
        ok = ~np.isnan(y[t])
        Z = model.z(t)[ok]
        W = Z.T / model.H[ok]
        P = W @ Z
        est.append(np.linalg.pinv(P) @ (W @ y[t, ok]))
        precision.append(P)
    return est, precision


def companion_blocks(T: np.ndarray) -> list[tuple[int, int]]:
    """(first, size) of the diagonal blocks of a transition matrix that don't interact."""
    n, link = len(T), (np.abs(T) + np.abs(T.T)) > 0
    seen, out = set(), []
    for i in range(n):
        if i in seen:
            continue
        group, todo = {i}, [i]
        while todo:
            for j in np.flatnonzero(link[todo.pop()]):
                if int(j) not in group:
                    group.add(int(j))
                    todo.append(int(j))
        seen |= group
        out.append((min(group), len(group)))
    return out
