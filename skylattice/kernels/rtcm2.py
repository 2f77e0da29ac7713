"""RTCM 2 messages: 30-bit words of 24 data and 6 parity bits, sent as five bytes of six bits each, lowest bit first.

Decoded are differential corrections (1, 9), the reference position (3), time (14), text (16) and antenna offsets (22); other types are told by
number only."""

from __future__ import annotations

from dataclasses import dataclass, field

from .rtcm import Reader, Writer

PREAMBLE = 0x66
#: Data bits (1 to 24) in each parity bit, and which of the last word's two last bits goes in (fixed values of the interface document).
PARITY = (
    (29, (1, 2, 3, 5, 6, 10, 11, 12, 13, 14, 17, 18, 20, 23)), (30, (2, 3, 4, 6, 7, 11, 12, 13, 14, 15, 18, 19, 21, 24)), (29, (1, 3, 4, 5, 7, 8, 12, 13, 14, 15, 16, 19, 20, 22)),
    (30, (2, 4, 5, 6, 8, 9, 13, 14, 15, 16, 17, 20, 21, 23)), (30, (1, 3, 5, 6, 7, 9, 10, 14, 15, 16, 17, 18, 21, 22, 24)), (29, (3, 5, 6, 8, 9, 10, 11, 13, 15, 19, 22, 23, 24)),
)


def parity(data: int, last: int) -> int:
    """Six parity bits of 24 data bits (as before inversion); last: the two last bits of the word before."""
    bit = lambda i: data >> (24 - i) & 1
    out = 0
    for which, bits in PARITY:
        v = last >> (30 - which) & 1
        for i in bits:
            v ^= bit(i)
        out = out << 1 | v
    return out


def _six(v: int) -> int:
    return 0x40 | int(f"{v:06b}"[::-1], 2)


def encode(kind: int, station: int, zcount: float, body: bytes, seq: int = 0, health: int = 0, last: int = 0) -> bytes:
    """Two header words and the body in whole words of three bytes."""
    if len(body) % 3:
        raise ValueError("a body has whole words of three bytes")
    w = Writer()
    for v, n in ((PREAMBLE, 8), (kind, 6), (station, 10), (round(zcount / 0.6), 13), (seq, 3), (len(body) // 3, 5), (health, 3)):
        w.put(v, n)
    out = bytearray()
    raw = w.body() + body
    for i in range(0, len(raw), 3):
        data = int.from_bytes(raw[i : i + 3], "big")
        check = parity(data, last)
        sent = (data ^ 0xFFFFFF if last & 1 else data) << 6 | check
        out += bytes(_six(sent >> s & 63) for s in (24, 18, 12, 6, 0))
        last = check & 3
    return bytes(out)


@dataclass
class Decoder:
    """Finds messages in bytes; keeps what isn't finished."""

    bits: int = 0
    size: int = 0
    words: list[int] = field(default_factory=list)
    need: int = 0
    last: int = 0

    def feed(self, data: bytes) -> list[dict]:
        out = []
        for b in data:
            if b >> 6 != 1:
                continue
            self.bits = (self.bits << 6 | int(f"{b & 63:06b}"[::-1], 2)) & (1 << 32) - 1
            self.size += 6
            if not self.words:
                self._start()
            elif self.size == 30:
                self._word(out)
        return out

    def _data(self) -> int | None:
        """Data bits of the word in the register, with the two bits before it above; None if the parity is wrong."""
        last = self.bits >> 30 & 3
        data = self.bits >> 6 & 0xFFFFFF
        if last & 1:
            data ^= 0xFFFFFF
        return data if parity(data, last) == self.bits & 63 else None

    def _start(self) -> None:
        data = self._data()
        if data is not None and data >> 16 == PREAMBLE:
            self.words, self.size, self.need = [data], 0, 2

    def _word(self, out: list[dict]) -> None:
        data, self.size = self._data(), 0
        if data is None:
            self.words = []
            return
        self.words.append(data)
        if len(self.words) == 2:
            self.need = 2 + (data >> 3 & 31)
        if len(self.words) == self.need:
            out.append(message(b"".join(v.to_bytes(3, "big") for v in self.words)))
            self.words = []


def message(raw: bytes) -> dict:
    r = Reader(raw)
    r.u(8)
    out: dict = {"type": r.u(6), "station": r.u(10), "zcount": r.u(13) * 0.6, "seq": r.u(3)}
    n = r.u(5)
    out["health"] = r.u(3)
    kind = out["type"]
    if kind in (1, 9):
        out["rows"] = []
        while r.left >= 40:
            coarse, udre, prn, prc, rrc, iod = r.u(1), r.u(2), r.u(5), r.s(16), r.s(8), r.u(8)
            if prc != -32768 and rrc != -128:
                out["rows"].append({"prn": prn or 32, "udre": udre, "prc": prc * (0.32 if coarse else 0.02), "rrc": rrc * (0.032 if coarse else 0.002), "iod": iod})
    elif kind == 3 and n >= 4:
        out["position"] = [r.s(32) * 0.01 for _ in range(3)]
    elif kind == 14 and n >= 1:
        out |= {"week": r.u(10), "hour": r.u(8), "leap": r.u(6)}
    elif kind == 16:
        out["text"] = raw[6:].rstrip(b"\0").decode("latin-1")
    elif kind == 22 and n >= 1:
        out["delta"] = [r.s(8) / 25600 for _ in range(3)]
    return out
