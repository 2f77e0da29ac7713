"""Relative positions: an extended Kalman filter over double differences with ambiguities fixed to integers; a smoother."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from . import ambiguity
from .positioning import ranges


def update(x: np.ndarray, p: np.ndarray, h: np.ndarray, v: np.ndarray, r: np.ndarray, active: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """One measurement update of the active states (default: those that are set and have a variance)."""
    at = np.flatnonzero((x != 0) & (np.diag(p) > 0)) if active is None else active
    ha, pa = h[:, at], p[np.ix_(at, at)]
    k = pa @ ha.T @ np.linalg.inv(ha @ pa @ ha.T + r)
    x, p = x.copy(), p.copy()
    x[at] += k @ v
    p[np.ix_(at, at)] = (np.eye(len(at)) - k @ ha) @ pa
    return x, p


def smooth(forward: tuple[np.ndarray, np.ndarray], backward: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two estimates weighed by their inverse covariances."""
    (xf, qf), (xb, qb) = forward, backward
    wf, wb = np.linalg.inv(qf), np.linalg.inv(qb)
    q = np.linalg.inv(wf + wb)
    return q @ (wf @ xf + wb @ xb), q


@dataclass
class Filter:
    """State of one base line: rover position and single-difference ambiguities (cycles) by satellite."""

    base: np.ndarray
    wavelength: float
    position: np.ndarray
    variance: np.ndarray = field(default_factory=lambda: np.eye(3) * 900.0)
    bias: dict[int, float] = field(default_factory=dict)
    cross: np.ndarray | None = None  # covariance of (position, biases in order of satellite)
    fixed: np.ndarray | None = None
    ratio: float = 0.0
    turned: list[np.ndarray] = field(default_factory=list)  # the last epoch's reduction,
    turned_of: tuple[int, ...] = ()  # of these satellites, the reference first

    def epoch(self, sats: np.ndarray, where: np.ndarray, el: np.ndarray, p: tuple[np.ndarray, np.ndarray], phase: tuple[np.ndarray, np.ndarray], slip: np.ndarray, noise: tuple[float, float] = (0.3, 0.003), moving: float = 100.0) -> str:
        """Ranges and phases (cycles) of rover and base on common satellites. Returns 'fixed', 'float' or 'none'."""
        if len(sats) < 4:
            return "none"
        order = np.argsort(sats)
        sats, where, el, slip = sats[order], where[order], el[order], slip[order]
        sp, sl = (p[0] - p[1])[order], (phase[0] - phase[1])[order]
        old = sorted(self.bias)
        cov = self.cross if self.cross is not None else self.variance
        n = 3 + len(sats)
        q = np.zeros((n, n))
        keep = {s: i for i, s in enumerate(old)}
        to = [3 + i for i, s in enumerate(sats) if s in keep and not slip[i]]
        src = [3 + keep[s] for i, s in enumerate(sats) if s in keep and not slip[i]]
        q[np.ix_(to, to)] = cov[np.ix_(src, src)]
        # a moving rover forgets its position; ambiguities carry the information on
        q[:3, :3] = np.eye(3) * moving**2
        x = np.zeros(n)
        x[:3] = self.position
        for i, s in enumerate(sats):
            if 3 + i in to:
                x[3 + i] = self.bias[int(s)]
            else:
                x[3 + i] = sl[i] - sp[i] / self.wavelength
                q[3 + i, 3 + i] = 100.0**2
        ref = int(np.argmax(el))
        rest = [i for i in range(len(sats)) if i != ref]
        weight = 2 * (1 + 1 / np.sin(el) ** 2)
        prior = x.copy()
        for _ in range(8):  # iterated for the curvature of ranges
            ru, e = ranges(where, x[:3])
            rb, _ = ranges(where, self.base)
            dd = (ru - rb)[rest] - (ru - rb)[ref]
            de = -(e[rest] - e[ref])
            hp, hl = np.zeros((len(rest), n)), np.zeros((len(rest), n))
            hp[:, :3] = hl[:, :3] = de
            for k, i in enumerate(rest):
                hl[k, 3 + i], hl[k, 3 + ref] = self.wavelength, -self.wavelength
            amb = self.wavelength * (x[3:][rest] - x[3 + ref])
            v = np.concatenate([(sp[rest] - sp[ref]) - dd, self.wavelength * (sl[rest] - sl[ref]) - dd - amb])
            block = np.diag(weight[rest]) + weight[ref]
            r = np.zeros((2 * len(rest),) * 2)
            r[: len(rest), : len(rest)], r[len(rest) :, len(rest) :] = block * noise[0] ** 2, block * noise[1] ** 2
            h = np.vstack([hp, hl])
            k = q @ h.T @ np.linalg.inv(h @ q @ h.T + r)
            new = x + k @ (v + h @ (x - prior)) - (x - prior)
            moved, x = np.linalg.norm(new[:3] - x[:3]), new
            if moved < 1e-4:
                break
        q = (np.eye(n) - k @ h) @ q
        self.position, self.variance, self.cross = x[:3].copy(), q[:3, :3].copy(), q
        self.bias = {int(s): float(b) for s, b in zip(sats, x[3:], strict=True)}
        d = np.zeros((len(rest), n))
        for k_, i in enumerate(rest):
            d[k_, 3 + i], d[k_, 3 + ref] = 1, -1
        a, qa = d @ x, d @ q @ d.T
        names = (int(sats[ref]), *sats[rest].tolist())
        if names != self.turned_of:
            self.turned, self.turned_of = [], names
        try:
            best, s = ambiguity.resolve(a, (qa + qa.T) / 2, turned=self.turned)
        except np.linalg.LinAlgError:
            self.fixed = None
            return "float"
        if len(s) < 2:  # the search took too long
            self.fixed = None
            return "float"
        self.ratio = float(s[1] / s[0]) if s[0] > 0 else 999.9
        if ambiguity.accepted(s):
            self.fixed = x[:3] - (q[:3] @ d.T) @ np.linalg.solve(qa, a - best[0])
            return "fixed"
        self.fixed = None
        return "float"
