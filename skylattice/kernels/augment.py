"""Messages of satellite-based augmentation: masks, fast and long-term corrections, ionosphere grid. A message is 250 bits in 32 bytes or 226 data bits in 29.

The state keeps the masks that later messages refer to; a correction whose issue of mask differs is dropped."""

from __future__ import annotations

from dataclasses import dataclass, field

from .rtcm import Reader

#: Range accuracy indicator -> variance, m^2; 14 is not monitored, 15 do not use (fixed values).
VARIANCE = (0.0520, 0.0924, 0.1444, 0.2830, 0.4678, 0.8315, 1.2992, 1.8709, 2.5465, 3.3260, 5.1968, 20.7870, 230.9661, 2078.695)
#: Grid ionosphere indicator -> variance, m^2 (fixed values).
GRID_VARIANCE = (0.0084, 0.0333, 0.0749, 0.1331, 0.2079, 0.2994, 0.4075, 0.5322, 0.6735, 0.8315, 1.1974, 1.8709, 3.3260, 20.787, 187.0826)


def _fields(msg: bytes) -> tuple[int, Reader]:
    r = Reader(msg[:29])
    r.u(8)
    return r.u(6), r


def satellite(slot: int) -> str | None:
    """Mask slot (1 to 210) -> satellite."""
    if slot <= 37:
        return f"G{slot:02d}"
    if slot <= 61:
        return f"R{slot - 37:02d}"
    return f"S{slot:03d}" if 120 <= slot <= 138 else None


@dataclass
class Augmentation:
    iodp: int = -1
    sats: list[str | None] = field(default_factory=list)
    fast: dict[str, dict] = field(default_factory=dict)
    slow: dict[str, dict] = field(default_factory=dict)
    bands: dict[int, tuple[int, list[int]]] = field(default_factory=dict)
    grid: dict[tuple[int, int], dict] = field(default_factory=dict)

    def apply(self, t: float, msg: bytes) -> int:
        """Takes a message that came at t; returns its type, or -1 if the masks it needs aren't there."""
        kind, r = _fields(msg)
        if kind == 1:
            slots = [i for i in range(1, 211) if r.u(1)]
            self.iodp, self.sats = r.u(2), [satellite(i) for i in slots][:51]
            return kind
        if 2 <= kind <= 5 or kind == 0:
            kind = kind or 2
            iodf, iodp = r.u(2), r.u(2)
            if iodp != self.iodp:
                return -1
            prc, udre = [r.s(12) for _ in range(13)], [r.u(4) for _ in range(13)]
            for i, (p, u) in enumerate(zip(prc, udre, strict=True)):
                at = 13 * (kind - 2) + i
                if at < len(self.sats) and self.sats[at]:
                    was = self.fast.get(self.sats[at])
                    rate = (p * 0.125 - was["prc"]) / (t - was["t"]) if was and 0 < t - was["t"] <= 60 else 0.0
                    self.fast[self.sats[at]] = {"t": t, "prc": p * 0.125, "rate": rate, "iodf": iodf, "variance": VARIANCE[u] if u < 14 else None}
            return kind
        if kind == 18:
            r.u(4)
            band, iodi = r.u(4), r.u(2)
            self.bands[band] = (iodi, [i for i in range(201) if r.u(1)])
            return kind
        if kind == 25:
            for _ in range(2):
                velocity = r.u(1)
                for _ in range(1 if velocity else 2):
                    slot, iode = r.u(6), r.u(8)
                    if velocity:
                        d = [r.s(11) * 0.125 for _ in range(3)]
                        clock = r.s(11) * 2.0**-31
                        rates = [r.s(8) * 2.0**-11 for _ in range(3)]
                        drift, t0 = r.s(8) * 2.0**-39, r.u(13) * 16
                    else:
                        d, clock, rates, drift, t0 = [r.s(9) * 0.125 for _ in range(3)], r.s(10) * 2.0**-31, [0.0] * 3, 0.0, None
                    if 0 < slot <= len(self.sats) and self.sats[slot - 1]:
                        self.slow[self.sats[slot - 1]] = {"t": t, "iode": iode, "dpos": d, "dvel": rates, "dclk": clock, "drift": drift, "t0": t0}
                if r.u(2) != self.iodp:
                    return -1
                r.u(0 if velocity else 1)
            return kind
        if kind == 26:
            band, block = r.u(4), r.u(4)
            rows = [(r.u(9), r.u(4)) for _ in range(15)]
            iodi = r.u(2)
            if band not in self.bands or self.bands[band][0] != iodi:
                return -1
            nodes = self.bands[band][1]
            for i, (delay, give) in enumerate(rows):
                if 15 * block + i < len(nodes):
                    self.grid[band, nodes[15 * block + i]] = {"t": t, "delay": None if delay == 511 else delay * 0.125, "variance": GRID_VARIANCE[give] if give < 15 else None}
            return kind
        return kind

    def range_correction(self, sat: str, t: float, longest: float = 60.0) -> tuple[float, float] | None:
        """Fast correction carried on by its rate, and its variance; None if there is none, it is old or not to be used."""
        f = self.fast.get(sat)
        if f is None or f["variance"] is None or abs(t - f["t"]) > longest:
            return None
        return f["prc"] + f["rate"] * (t - f["t"]), f["variance"]
