"""Precise orbits (SP3), ionosphere maps (IONEX) and antenna calibrations (ANTEX): parsers on lines of text."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from .rinex import number, seconds


def sp3(lines: Iterable[str]) -> Iterator[tuple]:
    """(t, sat, x, y, z, clock) in metres and seconds; a missing position or clock is None."""
    t = None
    for line in lines:
        if line.startswith("*"):
            f = line[1:].split()
            t = seconds(*map(int, f[:5]), float(f[5]))
        elif line.startswith("P") and t is not None:
            sat = line[1:4].replace(" ", "0")
            sat = "G" + sat[1:] if sat[0] == "0" else sat
            x, y, z, c = (number(line[4 + 14 * i : 18 + 14 * i]) for i in range(4))
            none = x == y == z == 0.0
            yield (t, sat, *((None,) * 3 if none else (x * 1e3, y * 1e3, z * 1e3)), None if abs(c) >= 999999 or c == 0 else c * 1e-6)
        elif line.startswith("EOF"):
            return


def write_sp3(rows: list[tuple]) -> list[str]:
    out, last = ["#cP"], None
    from .rinex import _clock

    for t, sat, x, y, z, c in sorted(rows, key=lambda r: (r[0], r[1])):
        if t != last:
            yy, mo, d, h, mi, s = _clock(t)
            out.append(f"*  {yy:4d} {mo:2d} {d:2d} {h:2d} {mi:2d} {s:11.8f}")
            last = t
        out.append(f"P{sat}{(x or 0) / 1e3:14.6f}{(y or 0) / 1e3:14.6f}{(z or 0) / 1e3:14.6f}{999999.999999 if c is None else c * 1e6:14.6f}")
    return [*out, "EOF"]


def ionex(lines: Iterable[str]) -> Iterator[tuple]:
    """(t, kind, height km, lat, lon, value) of each present node; kind is TEC or RMS."""
    scale, t, kind, lon1, dlon, lat, h, values = 0.1, None, "", 0.0, 0.0, None, 0.0, []
    for line in lines:
        label = line[60:].strip()
        if label == "EXPONENT":
            scale = 10.0 ** int(line[:6])
        elif label in ("START OF TEC MAP", "START OF RMS MAP"):
            kind = label[9:12]
        elif label == "EPOCH OF CURRENT MAP":
            f = line[:36].split()
            t = seconds(*map(int, f[:5]), float(f[5]))
        elif label == "LAT/LON1/LON2/DLON/H":
            lat, lon1, _, dlon, h = (number(line[2 + 6 * i : 8 + 6 * i]) for i in range(5))
            values = []
        elif label.startswith("END OF") and label != "END OF HEADER":
            lat = None
        elif lat is not None and kind and t is not None:
            for i in range(0, len(line.rstrip("\n")), 5):
                v = line[i : i + 5].strip()
                if v:
                    if int(v) != 9999:
                        yield t, kind, h, lat, lon1 + dlon * len(values), int(v) * scale
                    values.append(v)


def antex(lines: Iterable[str]) -> Iterator[dict]:
    """One dict an antenna: type, serial, since, until, and by frequency offsets (n, e, u) and variations, in metres."""
    a: dict | None = None
    freq = ""
    for line in lines:
        label = line[60:].strip()
        if label == "START OF ANTENNA":
            a = {"type": "", "serial": "", "since": None, "until": None, "offsets": {}, "variations": {}}
        elif a is None:
            continue
        elif label == "TYPE / SERIAL NO":
            a |= {"type": line[:20].strip(), "serial": line[20:40].strip()}
        elif label in ("VALID FROM", "VALID UNTIL"):
            f = line[:43].split()
            a["since" if label == "VALID FROM" else "until"] = seconds(*map(int, f[:5]), float(f[5]))
        elif label == "START OF FREQUENCY":
            freq = line[3:6].strip()
        elif label == "END OF FREQUENCY":
            freq = ""
        elif label == "NORTH / EAST / UP" and freq:
            a["offsets"][freq] = [number(line[10 * i : 10 * i + 10]) * 1e-3 for i in range(3)]
        elif line.strip().startswith("NOAZI") and freq:
            a["variations"][freq] = [float(v) * 1e-3 for v in line.split()[1:]]
        elif label == "END OF ANTENNA":
            yield a
            a = None
